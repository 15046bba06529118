"""Plans that hold at any size: rows derived from small files are neither sent through the driver nor left to one task."""

import random
import time

from pyspark.sql import functions as F

import __spark_entry__
from rubrica.config import Config
from rubrica.functions import detectors as D
from rubrica.functions.text import SPACE_IN_CLASS, SPACES, matches, regex, trimmed
from rubrica.operators import joins, mcp_rules, skill_rules
from rubrica.plans import artifact_queries, eval_queries, queries
from rubrica.sources.mcp import servers
from rubrica.sources.references import BARE_WORD
from rubrica.sources.trees import skills


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_are_not_sent_through_the_driver(spark, tmp_path):
    rows = [("m", i, n, True) for i, n in enumerate(("read_filez", "read_files", "other_name"))]
    spark.createDataFrame(rows, "path string, ord int, name string, entry_valid boolean").write.parquet(f"{tmp_path}/tools")
    out = mcp_rules.confusable(spark.read.parquet(f"{tmp_path}/tools"))
    assert "BroadcastExchange" not in plan_of(out)
    assert [r.tool_name for r in out.collect()] == ["read_files"]


def test_keys_of_a_name_are_those_of_its_deletions(spark):
    names = ["", "a", "ab", "aa", "abca", "日本😀é", "abcdefgh" * 5]
    got = {r.n: r.k for r in spark.createDataFrame([(n,) for n in [*names, None]], "n string").select("n", joins.deletions(F.col("n")).alias("k")).collect()}
    left = lambda n: {n} | {n[:i] + n[i + 1 :] for i in range(len(n))} | {n[:i] + n[i + 1 : j] + n[j + 1 :] for i in range(len(n)) for j in range(i + 1, len(n))}
    assert got[None] is None and all(len(got[n]) == len(set(got[n])) == len(left(n)) for n in names)
    assert all(len({*got[a]} & {*got[b]}) == len(left(a) & left(b)) for a in names for b in names)


def test_texts_are_dealt_to_tasks(spark, tmp_path):
    spark.createDataFrame([(i, "text") for i in range(50)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for query in ("detect_hidden_unicode", "context_rule_hits"):
        assert "REPARTITION_BY_NUM" in plan_of(__spark_entry__.queries()[query](spark, str(tmp_path)))


def test_joiners_between_emoji(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices("a‍‍﻿️👨👩é\n", k=rng.randint(0, 12))) for _ in range(3000)]
    plain = rf"({D.EMOJI})\x{{200D}}(?={D.EMOJI})"
    t = F.regexp_replace("t", plain, "$1\x01")
    want = F.transform(matches(t, r"[\x{200B}-\x{200D}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{E0000}-\x{E007F}]|(?<=[\w\W])\x{FEFF}"), lambda h: h["pos"])
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.transform(D.hidden_unicode(F.col("t")), lambda h: h["pos"]).alias("got"), want.alias("want"))
    assert df.where("got <> want").count() == 0 and df.where("size(got) > 0").count() > 500


def test_context_files_end_with_as_many_bytes_as_their_sql_says(spark, tmp_path):
    spark.createDataFrame([(5 * n, "x" * n) for n in range(5978, 5990)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = __spark_entry__.queries()["context_rule_hits"](spark, str(tmp_path)).where("rule_id = 'CTX001'")
    assert sorted(int(r.path[1:]) // 5 for r in out.collect()) == [n for n in range(5978, 5990) if -(-(n + 18) // 4) > 1500]


def test_parts_are_dealt_to_tasks_and_not_sent_through_the_driver(spark, tmp_path):
    spark.createDataFrame([(i, "red bolt", "SMALL") for i in range(20)], "p_partkey long, p_name string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, f"NATION_{i}") for i in range(25)], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    replies = plan_of(eval_queries.recorded_replies(spark, str(tmp_path)))
    assert "REPARTITION_BY_NUM" in replies and "BroadcastExchange" not in replies
    for own in (artifact_queries.parts(spark, str(tmp_path)), queries.tool_tables(spark, str(tmp_path))[1], eval_queries.trigger_scenarios(spark, str(tmp_path))):
        assert "REPARTITION_BY_NUM" in plan_of(own)
    page = F.lit('{"tools":[{"name":"read_page"}]}')
    capture = artifact_queries.parts(spark, str(tmp_path)).select(F.col("p_partkey").cast("string").alias("path"), *[F.lit("x").alias(c) for c in ("name", "transport", "target", "initialize")], F.lit(None).cast("string").alias("initialize_error"), F.array(page).alias("pages"), F.lit(None).cast("string").alias("list_error"), F.lit(False).alias("probed"))
    assert all("BroadcastExchange" not in plan_of(t) for t in servers(capture))
    files = artifact_queries.derived_files(spark, str(tmp_path))
    assert all("BroadcastExchange" not in plan_of(t) for t in skills(files))


def test_trimming_takes_one_look_at_each_end(spark):
    assert spark.range(1).where(~F.lit(SPACES).rlike(f"^[{SPACE_IN_CLASS}]{{{len(SPACES)}}}$")).count() == 0
    whole = spark.createDataFrame([(chr(c),) for c in range(1, 0xD800)] + [(chr(c),) for c in range(0xE000, 0x10000)], "c string")
    assert {r.c for r in whole.where(trimmed(F.concat(F.col("c"), F.lit("x"), F.col("c"))) == "x").collect()} == {*SPACES} == {r.c for r in whole.where(F.col("c").rlike(f"[{SPACE_IN_CLASS}]")).collect()}
    began, gap = time.time(), 150000
    rows = [("\u3000 a\u2028 b \u0085\t",), (" \ufeff",), ("a" + " " * gap + "b",), (None,)]
    assert [r.t for r in spark.createDataFrame(rows, "t string").select(trimmed(F.col("t")).alias("t")).collect()] == ["a\u2028 b \u0085", "", rows[2][0], None]
    assert time.time() - began < 10


def test_texts_with_a_match_have_the_words_that_it_needs(spark):
    said = "Use this first|use this tool instead|Before calling any Other tool|always CALL this first|instead of using any other tools|~/.SSH x|Id_rsa|(.Env|Credential|KEYCHAIN|.aws/x|/etc/passwd|Private  key|does stuff|A tool.|The tool that x|tool for|Given x|REQUIRES|must provide|nothing".split("|")
    patterns = [*[(regex(p, "i"), w) for (_, p), w in zip([*mcp_rules.STEERING, *mcp_rules.SENSITIVE], [*mcp_rules.STEERING_WORDS, *mcp_rules.SENSITIVE_WORDS], strict=True)], (mcp_rules.PLACEHOLDER, [mcp_rules.PLACEHOLDER_WORDS]), (mcp_rules.IMPLIES_PARAMS, [mcp_rules.IMPLIES_WORDS]), (mcp_rules.MANDATORY, [mcp_rules.MANDATORY_WORDS])]
    df = spark.createDataFrame([(t,) for t in said], "t string")
    out = df.select(*[F.struct(F.col("t").rlike(p).alias("is"), D.holds(F.lower("t"), w).alias("has")).alias(f"p{i}") for i, (p, w) in enumerate(patterns)]).collect()
    assert all(x["has"] for r in out for x in r if x["is"]) and not any(x["has"] for x in out[-1])
    assert all(any(r[i]["is"] for r in out) for i in range(len(patterns)))


def test_a_long_description_that_restates_its_name(spark):
    rows = [("read_file", "Read file."), ("read_file", "\nREAD" + "- " * 300 + "File!"), ("read_file", "Read file and " + "word " * 300), ("o" * 210, "O" * 210), ("o" * 209, "O" * 210)]
    df = spark.createDataFrame(rows, "name string, description string").withColumn("bare", trimmed(F.col("description"))).withColumns({"low": F.lower("bare"), "entry_valid": F.lit(True)})
    told = df.select(F.exists(mcp_rules.tool_rules(Config())["MCP102"], lambda h: F.contains(h["message"], F.lit("restates"))).alias("x"))
    assert [r.x for r in told.collect()] == [False, True, False, True, False]


def test_bare_words_are_those_with_a_dot_or_slash(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choices("ab1é日_-:./ \n\t  |()[]\"'`,;=", k=rng.randint(0, 30))) for _ in range(3000)] + ["", "a.b", "x" * 30 + "/y."]
    words = F.filter(matches(F.col("t"), regex(r"[^\s|()\[\]\"'`,;=]+")), lambda m: m["match"].rlike("[./]"))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(matches(F.col("t"), BARE_WORD).alias("got"), words.alias("want"))
    assert df.where("got <> want").count() == 0 and df.where("size(got) > 1").count() > 500


def test_a_long_word_is_looked_at_once(spark):
    """Forty texts of one word each, ten million characters, where a word looked for at each of its places would take 10^12 steps."""
    began = time.time()
    df = spark.range(40).select(F.concat(F.repeat(F.lit("word"), 62_500), F.lit(" src/a.ts")).alias("t"))
    assert {len(r.m) for r in df.select(matches(F.col("t"), BARE_WORD).alias("m")).collect()} == {1}
    assert time.time() - began < 15


def test_texts_are_lowered_once_and_patterns_made_for_the_verbs_that_are_there(spark):
    one = spark.createDataFrame([("x", "x")], "t string, desc string").select(D.injection_phrases(F.col("t")).alias("t"))
    assert one._jdf.queryExecution().analyzed().toString().count("lower(") == 1
    texts = ["Validates and converts, reading none.", "Buildings rebuilt; PLOTTED, plots", "", "re-render un-sort xmerge"]
    skill = spark.createDataFrame([(t,) for t in [*texts, None]], "desc string")
    rule = skill_rules.row_rules(Config())["SK104"]
    cols = {c: F.lit(None).cast(k) for c, k in (("name_", "string"), ("body", "string"), ("raw", "string"))}
    long = skill.withColumns(cols).withColumn("desc", F.concat("desc", F.lit(" of the pages one and two in a place")))
    plan = long.select(F.size(rule).alias("n"), F.get(rule, F.lit(0))["message"].alias("m"))
    assert "contains(" in plan._jdf.queryExecution().analyzed().toString().lower()
    assert [r.n for r in plan.collect()] == [0, 1, 1, 0, 0]
