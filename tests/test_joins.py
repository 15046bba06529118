import itertools
import random
import re

from pyspark.sql import functions as F

from rubrica.config import Config
from rubrica.operators import joins, mcp_rules
from rubrica.operators.catalog import RULES
from rubrica.operators.context_rules import contradictions as context_contradictions
from rubrica.operators.skill_rules import contradictions as skill_contradictions
from rubrica.operators.skill_rules import similar_siblings


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_names_within_two_edits(spark):
    rng = random.Random(1)
    letters = "ab_é"
    names = {"".join(rng.choices(letters, k=rng.randint(6, 9))) for _ in range(120)}
    base = ["".join(rng.choices("abcdefgh", k=n)) for n in (38, 39, 40, 41, 42, 43, 90)]
    for s in base:
        for _ in range(12):
            t = s
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(t))
                t = rng.choice([t[:i] + t[i + 1 :], t[:i] + rng.choice("xyz") + t[i:], t[:i] + rng.choice("xyz") + t[i + 1 :]])
            names.add(t)
    names = sorted(names)
    got = {(r.a, r.b, r.distance) for r in joins.near_names(spark.createDataFrame([("p", n) for n in names] + [("q", n) for n in names[:1]], "path string, name string")).collect()}
    want = {(a, b, d) for a, b in itertools.combinations(names, 2) if abs(len(a) - len(b)) <= 2 and 1 <= (d := levenshtein(a, b)) <= 2}
    assert got == want and len(want) > 100


def test_a_prefix_that_all_share_makes_no_pairs(spark):
    rng = random.Random(2)
    names = spark.createDataFrame([("p", "company_internal_" + "".join(rng.choices("abcdefghijklmnop", k=9))) for _ in range(400)], "path string, name string")
    keys = names.select("name", F.explode(joins.deletions(F.col("name"))).alias("h")).groupBy("h").count().where("count > 1").count()
    assert keys == 0 and joins.near_names(names).count() == 0


def test_confusable_hits_are_in_the_order_of_tools(spark):
    rows = [("m", 0, "read_filez", True), ("m", 1, "Read_Files", True), ("m", 2, "read_filez", True), ("m", 3, "read_file_", False), ("m", 4, "abc", True)]
    got = sorted((r.tool_name, r.message.split('"')[1]) for r in mcp_rules.confusable(spark.createDataFrame(rows, "path string, ord int, name string, entry_valid boolean")).collect())
    assert got == [("Read_Files", "read_filez"), ("read_filez", "Read_Files")]


def test_siblings_named_with_precedence(spark):
    tools = [
        ("alpha_tool", "Always run this before beta_tool", True),
        ("beta_tool", "Reads one file.", True),
        ("get", "instead of alpha_tool, or get", True),
        ("web.search-2", "First call BETA_TOOL! rather than web.search-2 or search", True),
        ("search", "before web.search-2x, after web.search-2", True),
        ("日本語名", "first a日本語名b", True),
        ("other", "before x日本語名y and 日本語名", True),
        ("gone_tool", "x", False),
        ("last", "before gone_tool and last", True),
        ("last", "prior to nothing", True),
        ("none", None, True),
    ]
    rows = [("m", i, n, d, v) for i, (n, d, v) in enumerate(tools)] + [("other server", 0, "beta_tool", "before alpha_tool", True)]
    got = sorted((r.tool_name, re.search(r'sibling tool "(.*)" with', r.message)[1]) for r in mcp_rules.sibling_steering(spark.createDataFrame(rows, "path string, ord int, name string, description string, entry_valid boolean")).collect())
    word = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    want = sorted((n, o) for i, (n, d, _) in enumerate(tools) for j, (o, _, v) in enumerate(tools) if i != j and d and v and len(o) >= 4 and re.search(r"(?i)\b(before|instead of|first|prior to|rather than)\b", d) and re.search(f"(?i){word}{re.escape(o)}{word}", d))
    assert got == want and ("alpha_tool", "beta_tool") in got and ("last", "last") in got and ("other", "日本語名") in got


def test_alike_sets(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    sets = [(f"r{i % 2}", f"p{i:03}", sorted({"common", *rng.sample(words, rng.randint(0, 12))})) for i in range(120)]
    for i in range(60):
        repo, _, w = rng.choice(sets)
        sets.append((repo, f"q{i:03}", sorted(set(w) ^ set(rng.sample(words, rng.randint(0, 3))))))
    sets.append(("r0", "z", []))
    df = spark.createDataFrame(sets, "repo string, path string, w array<string>")
    for t in (0.6, 0.7, 0.34):
        got = {(r.repo, r.path, r.o_path, round(r.similarity, 9)) for r in joins.alike_sets(df, t).collect()}
        want = set()
        for (r, p, a), (s, q, b) in itertools.permutations(sets, 2):
            if r == s and a and b and len({*a} & {*b}) / len({*a} | {*b}) > t:
                want.add((r, p, q, round(len({*a} & {*b}) / len({*a} | {*b}), 9)))
        assert got == want and want


def test_a_word_in_all_descriptions_meets_nobody(spark):
    rows = [("r", f"p{i}", f"n{i}", f"always the converter of alpha{i} beta{i} gamma{i} delta{i}") for i in range(2000)] + [("r", "x", "x", "alpha1 beta1 gamma1 delta1 converter of the always")]
    out = similar_siblings(spark.createDataFrame(rows, "repo string, path string, name string, desc string"), 0.6)
    assert sorted((r.path, r.message.split('"')[1]) for r in out.collect()) == [("p1", "x"), ("x", "n1")]


def skill(spark, body):
    return skill_contradictions(spark.createDataFrame([("s", body, 3)], "path string, body string, body_start_line int"))


def test_contradictions_of_skills(spark):
    body = "Always use tabs\nnever use tabs for this\nNever put spaces\nalways use spaces\nalways `lint` code first\nnever lint code, ever\nnever lint\nalways the a\nAlways use tabs; never use tabs"
    got = {(r.message, r.line) for r in skill(spark, body).collect()}
    say = lambda o, a, n: (f'"always {o}" (line {a}) contradicts "never {o}" (line {n})', min(a, n))
    assert got == {say("tabs", 3, 4), say("tabs", 3, 11), say("tabs", 11, 4), say("tabs", 11, 11), say("spaces", 6, 5), say("lint code", 7, 8)}
    assert skill(spark, "").count() == 0


def test_many_claims_that_do_not_meet(spark):
    body = "\n".join(f"always call service{i} alpha{i}\nnever call service{i} beta{i}" for i in range(3000)) + "\nalways call service7 beta7"
    out = skill(spark, body).collect()
    assert len(out) == 1 and "service7 beta7" in out[0].message


def test_contradictions_of_context_files(spark):
    raw = "Always use tabs\nnever use tabs for code\nNEVER  use tabs\nalways use tabs\nalways test\nnever test twice\nnever test"
    got = sorted((r.message, r.line) for r in context_contradictions(spark.createDataFrame([("c", raw)], "path string, raw string")).collect())
    assert got == [('"Always use tabs" (line 1) contradicts "NEVER use tabs" (line 3)', 1), ('"Always use tabs" (line 1) contradicts "never use tabs for code" (line 2)', 1), ('"always test" (line 5) contradicts "never test" (line 7)', 5)]


def test_rules_use_the_joins(spark):
    tools = spark.createDataFrame([("m", 0, "alpha_tool", "run before beta_tool", None, 1, True), ("m", 1, "beta_tool", "Reads one file.", None, 1, True)], "path string, ord int, name string, description string, input_schema string, tokens int, entry_valid boolean")
    servers = spark.createDataFrame([("m", "m", "http", "http://h", True, None, "1", '{"a":1}', None, 2, False)], "path string, name string, transport string, target string, initialized boolean, initialize_error string, protocol_version string, capabilities string, tools_list_error string, tokens_total int, probed boolean")
    probes = spark.createDataFrame([], "path string, tool_name string, skipped boolean, latency_ms int, protocol_error boolean, error_structured boolean")
    assert ("MCP303", "alpha_tool") in {(h.rule_id, h.tool_name) for h in mcp_rules.mcp_hits(servers, tools, probes, Config(rules={r: "off" for r in RULES if r != "MCP303"})).collect()}


def test_places_of_many_matches(spark):
    from rubrica.functions import text as X

    rng = random.Random(6)
    texts = ["".join(rng.choices("ab\n é😀", k=n)) for n in (0, 1, 130, 131, 5000, 40_000)] + ["a" * 64, "a" * 65, "xa\n" * 64, "no", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.matches(F.col("t"), "a\n?").alias("h"))
    for r in df.collect():
        t = texts[r.i] or ""
        assert [tuple(x) for x in r.h or []] == [(m.start(), t.count("\n", 0, m.start()) + 1, m[0]) for m in re.finditer("a\n?", t)]
