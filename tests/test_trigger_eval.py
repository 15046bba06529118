import json

import pytest
from pyspark.sql import functions as F

from rubrica.config import UserError
from rubrica.operators import evaluation as old
from rubrica.operators import trigger_eval as E

CORPUS = [{"name": f"skill-{i}", "description": f'Does "{i}" things — well'} for i in range(30)]
BANK = {c["name"]: f"please do {c['name']}" for c in CORPUS}


def skills(spark, rows):
    return spark.createDataFrame(rows, "path string, name string, description string")


def test_draws_and_shuffles_are_those_of_the_generator(spark):
    texts = ["hello", "", "é\U0001f600", *[f"text {i}" for i in range(40)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: E.drawn(E.seed_of(F.col("t")), k)).alias("x"))
    for r in df.collect():
        draw = old.seeded(r.t)
        assert r.x == [draw() for _ in range(60)]
    rows = [("p", n, t) for n, t in [("x", "a"), ("skill-3", "b"), ("skill-29", "c"), ("y", "d" * 500)]]
    for r in E.scenarios(skills(spark, rows), CORPUS, BANK, "m").collect():
        want = old.scenario({"name": r.name, "description": r.description}, CORPUS, BANK)
        assert [d.asDict() for d in r.distractors] == want["distractors"] and r.positions == want["positions"] and r.negatives == want["negatives"]
        assert r.key == old.cache_key({"name": r.name, "description": r.description}, want["distractors"], "m") and r.problem is None


def test_corpora_that_are_too_small(spark, tmp_path):
    with pytest.raises(UserError):
        E.checked_corpus(CORPUS[:11])
    with pytest.raises(UserError):
        E.checked_corpus([*CORPUS, {"name": "", "description": "x"}])
    small = [{"name": "a" if i < 2 else f"b{i}", "description": "d"} for i in range(12)]
    got = [r.problem for r in E.scenarios(skills(spark, [("p", "a", "x"), ("q", "z", "x")]), small, BANK, "m").orderBy("path").collect()]
    assert got == ["distractor corpus too small: need 11, have 10", "the bank of requests does not cover the sampled distractors"]
    (tmp_path / "c.json").write_text(json.dumps(CORPUS, indent=2))
    assert E.load_corpus(spark, str(tmp_path / "c.json")) == CORPUS
    (tmp_path / "d.json").write_text("[")
    with pytest.raises(UserError):
        E.load_corpus(spark, str(tmp_path / "d.json"))


def test_prompts(spark):
    plan = E.scenarios(skills(spark, [("p", "tabler", "Makes {tables}.")]), CORPUS, BANK, "m").withColumn("positives", F.array(*[F.lit(f"ask {i}") for i in range(8)]))
    begun = plan.select(E.generation_prompt().alias("g")).first().g
    assert "  name: tabler\n  description: Makes {tables}.\n\nWrite 8 realistic" in begun and begun.endswith("JSON array of 8 strings. No prose, no code fences.")
    r = plan.first()
    for x in E.routed(plan).collect():
        lines = [y for y in x.prompt.split("\n") if y.startswith("- ")]
        assert len(lines) == 12 and lines[r.positions[x.i]] == "- tabler: Makes {tables}." and x.prompt.endswith('{"skill": "<name>"} or {"skill": null}')
        assert f"User request:\n{f'ask {x.i}' if x.i < 8 else r.negatives[x.i - 8]}\n\nWhich" in x.prompt


def test_replies_are_read_strictly(spark):
    eight = json.dumps([f"r{i}" for i in range(8)])
    cases = [(eight, 8), (f"```json\n{eight}\n```", 8), (f" ```\n{eight}```", 8), (json.dumps([f"r{i}" for i in range(12)]), 8), (json.dumps([1, "", " ", *[f"r{i}" for i in range(8)]]), 8), (json.dumps([1] * 9), None), ('["a"]', None), ('{"a": 1}', None), ("no", None), ("", None), ("null", None)]
    got = [len(r.x) if r.x is not None else None for r in spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", E.written_requests(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [n for _, n in cases]


def judge(spark, rows, takes, bad=()):
    """Recorded replies to every prompt of the skills: takes(path, i) decides; bad: (path, i, attempt), i = -1 for the request for requests."""
    plan = E.scenarios(skills(spark, rows), CORPUS, BANK, "m")
    asks = {p: [f"{p} asks {i}" for i in range(8)] for p, *_ in rows}
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256).alias("prompt_sha")
    first = plan.select("path", "name", F.lit(-1).alias("i"), sha(E.generation_prompt()))
    table = spark.createDataFrame(list(asks.items()), "path string, positives array<string>")
    rest = E.routed(plan.join(table, "path")).join(plan.select("path", "name"), "path").select("path", "name", "i", sha(F.col("prompt")))
    out = []
    for r in first.union(rest).collect():
        for attempt in (1, 2):
            said = json.dumps(asks[r.path]) if r.i < 0 else json.dumps({"skill": r.name if takes(r.path, r.i) else None})
            out.append((r.prompt_sha, attempt, "???" if (r.path, r.i, attempt) in bad else said))
    return spark.createDataFrame(out, "prompt_sha string, attempt int, reply string")


def score(e):
    return {r.path: (r.precision, r.recall, r.f1, r.problem) for r in e.results.collect()}


def test_scores_retries_and_cache(spark, tmp_path):
    rows = [("perfect", "alpha", "A skill"), ("shy", "beta", "B skill"), ("greedy", "gamma", "C skill"), ("retried", "delta", "D skill"), ("unread", "epsilon", "E skill"), ("silent", "zeta", "F skill")]

    def takes(path, i):
        return {"shy": 2 <= i < 8, "greedy": i < 12}.get(path, i < 8)

    bad = {("retried", -1, 1), ("retried", 3, 1), ("unread", 0, 1), ("unread", 0, 2), ("unread", 9, 1), ("unread", 9, 2), ("silent", -1, 1), ("silent", -1, 2)}
    replies, cache = judge(spark, rows, takes, bad), E.EvalCache(spark, f"file://{tmp_path}/cache")
    go = lambda said: E.evaluate(skills(spark, rows), CORPUS, BANK, said, "m", 1.0, 5.0, 1.0, cache)
    first = go(replies)
    silent = "judge model did not return a parseable JSON array of 8 user prompts after a retry"
    want = {"perfect": (1.0, 1.0, 1.0, None), "shy": (1.0, 0.75, 0.8571, None), "greedy": (0.6667, 1.0, 0.8, None), "retried": (1.0, 1.0, 1.0, None), "unread": (1.0, 0.875, 0.9333, None), "silent": (None, None, None, silent)}
    assert score(first) == want and first.asked.count() == 6
    # The cache answers what was scored, without a reply; what failed is asked for again
    none = replies.where("false")
    again = go(none)
    assert score(again) == want and {r.path for r in again.asked.collect()} == {"silent"}
    # A file that can't be read and a row of another shape are misses of their own skills only
    keys = {r.path: r.key for r in first.plan.collect()}
    shy, greedy = keys["shy"], keys["greedy"]
    for f in (tmp_path / "cache" / f"bucket={shy[:2]}").glob("*.parquet"):
        f.write_bytes(b"PAR1 not a table PAR1")
    for f in (tmp_path / "cache" / f"bucket={shy[:2]}").glob(".*.crc"):
        f.unlink()
    spark.createDataFrame([(greedy, '{"promptsVersion":1,"positives":[1],"responses":[]}', greedy[:2])], "key string, entry string, bucket string").withColumn("stored_at", F.expr("current_timestamp() + INTERVAL 1 DAY")).write.mode("append").partitionBy("bucket").parquet(cache.location)
    asked = {r.path for r in go(replies.where("false")).asked.collect()}
    same_bucket = {p for p, k in keys.items() if k[:2] == shy[:2]}
    assert asked == {"silent", "greedy"} | same_bucket


def test_the_cap_and_an_empty_table(spark):
    rows = [("cheap", "alpha", "A skill"), ("dear", "beta", "word " * 3000)]
    e = E.evaluate(skills(spark, rows), CORPUS, BANK, judge(spark, rows, lambda p, i: i < 8), "m", 1.0, 5.0, 0.05)
    got = score(e)
    assert got["cheap"][3] is None and got["dear"][3].startswith("estimated eval cost $0.0") and got["dear"][3].endswith("exceeds eval.maxUSD ($0.05)")
    none = E.evaluate(skills(spark, []), CORPUS, BANK, judge(spark, rows, lambda p, i: True), "m", 1.0, 5.0, 0.05)
    assert none.results.count() == 0 and none.asked.count() == 0


def test_replies_and_scenarios_are_worked_out_once(spark, tmp_path):
    from rubrica.plans import eval_queries

    spark.createDataFrame([(i, "red bolt") for i in range(20)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, f"NATION_{i}") for i in range(25)], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    said = eval_queries.recorded_replies(spark, str(tmp_path))
    plan = said._jdf.queryExecution().optimizedPlan().toString()
    assert "part.parquet" not in str(said.inputFiles()) and "Join" not in plan
    met = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(reply):
        met.add(1)
        return reply

    plan = E.scenarios(eval_queries.part_skills(spark, str(tmp_path)), *eval_queries.nations(spark, str(tmp_path)), eval_queries.MODEL)
    n, out = said.count(), E.answered(plan, said.withColumn("reply", seen.asNondeterministic()("reply")))
    assert out.where("size(responses) = 16").count() == 18 and met.value == n
