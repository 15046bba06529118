import pytest
from pyspark.sql import functions as F

from rubrica.config import UserError, load_config, parse_rule_flags
from rubrica.operators import rollup, scoring
from rubrica.operators.catalog import RULES

FINDING = "artifact_type string, path string, rule_id string, severity string, dimension string, message string, fix string, foundational boolean, file string, line int, tool_name string, meta map<string,string>"
ARTIFACT = "artifact_type string, path string, name string, tokens long, probing boolean, rules_run int"


def finding(rule, severity=None, path="p", message="m", foundational=False, line=None, dimension=None):
    r = RULES[rule]
    return (r.applies_to, path, rule, severity or r.severity, dimension or r.dimension, message, r.fix, foundational, None, line, None, None)


def card(spark, findings, kind="skill", probing=False):
    a = spark.createDataFrame([(kind, "p", "p", 1, probing, 1)], ARTIFACT)
    return scoring.scorecards(a, spark.createDataFrame(findings, FINDING)).first()


def test_grades_of_scores(spark):
    scores = [100, 97, 96.99, 93, 90, 87, 83, 80, 77, 73, 70, 60, 59.99, 0]
    df = spark.createDataFrame([(float(s),) for s in scores], "s double")
    assert [r[0] for r in df.select(scoring.grade_for(F.col("s"))).collect()] == ["A+", "A+", "A", "A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D", "F", "F"]


def test_no_findings_is_perfect(spark):
    c = card(spark, [])
    assert (c.composite, c.grade, c.security_capped, c.foundational_capped, c.top_fixes) == (100.0, "A+", False, False, [])
    assert [d.dimension for d in c.dimensions] == ["structure", "trigger", "token", "instruction", "security"]


def test_decay_weights_and_zero_floor(spark):
    c = card(spark, [finding("SK102", message=f"m{i}") for i in range(5)])
    trigger = next(d for d in c.dimensions if d.dimension == "trigger")
    assert trigger.score == 100 - 5 * (1 + 0.5 + 0.25 + 0.1 + 0.1)
    assert c.composite == round(100 - 0.3 * (100 - trigger.score), 2)
    many = card(spark, [finding(r, "error", message=f"m{i}") for i in range(60) for r in ("SK101", "SK102", "SK103", "SK104", "SK105", "SK106")])
    assert next(d for d in many.dimensions if d.dimension == "trigger").score == 0


@pytest.mark.parametrize("n", [1000, 1001, 5000])
def test_occurrences_beyond_those_added_one_by_one(spark, n):
    """SK102 takes 5 off, decayed by occurrence; beyond 1,000 the tail is one term, equal up to rounding."""
    spark.range(n).createOrReplaceTempView("many")
    f = spark.table("many").join(F.broadcast(spark.createDataFrame([finding("SK102")], FINDING).drop("line").withColumnRenamed("message", "m"))).select(
        "artifact_type", "path", "rule_id", "severity", "dimension", F.concat("m", F.col("id").cast("string")).alias("message"), "fix", "foundational", "file", F.col("id").cast("int").alias("line"), "tool_name", "meta"
    )
    rules = scoring.rule_rows(f).select("terms", "n").first()
    want = [5.0, 2.5, 1.25] + [0.5] * (n - 3)
    assert rules.n == n and sum(rules.terms) == pytest.approx(sum(want), rel=1e-12) and len(rules.terms) == min(n, 1001)


def test_the_first_finding_decides_the_penalty(spark):
    two = [finding("SK201", "warn", message="b"), finding("SK201", "info", message="a")]
    assert next(d for d in card(spark, two).dimensions if d.dimension == "token").score == 100 - 1 * 1.5


def test_caps(spark):
    c = card(spark, [finding("SK401")])
    assert (c.grade, c.composite, c.security_capped) == ("C+", 79.0, True) and c.composite_raw == 97.0
    low = card(spark, [finding("SK401", "warn")])
    assert not low.security_capped and low.grade == "A+"
    f = card(spark, [finding("SK001", foundational=True), finding("SK401")])
    assert (f.grade, f.composite, f.foundational_capped, f.security_capped) == ("F", 55.0, True, False)
    ctx = card(spark, [finding("CTX006")], "context-file")
    assert ctx.composite_raw == 70.0 and ctx.composite == 70.0 and not ctx.security_capped


def test_an_uninitialized_server_keeps_its_grade(spark):
    c = card(spark, [finding("MCP001")], "mcp-server")
    assert (c.composite, c.grade) == (97.0, "A+")
    assert [d.dimension for d in card(spark, [], "mcp-server", True).dimensions][-1] == "reliability"


def test_known_composite(spark):
    found = [finding("SK401", message=str(i)) for i in range(2)] + [finding("SK402", message=str(i)) for i in range(3)] + [finding("SK403", message=str(i)) for i in range(2)] + [finding("SK404"), finding("SK405"), finding("SK406")]
    c = card(spark, found)
    assert next(d for d in c.dimensions if d.dimension == "security").score == 17.75 and c.composite_raw == 83.55 and c.composite == 79.0
    assert (c.n_error, c.n_warn, c.n_info) == (7, 2, 1)


def test_top_fixes_rank_by_gain(spark):
    c = card(spark, [finding("SK101"), finding("SK102"), finding("SK201"), finding("SK202"), finding("SK103")])
    assert [f.rule_id for f in c.top_fixes] == ["SK101", "SK102", "SK103"] and c.top_fixes[0].gain == 4.5
    assert c.top_fixes[0].projected_composite == round(c.composite + 4.5, 2)
    capped = card(spark, [finding("SK401"), finding("SK402")])
    assert capped.top_fixes == []  # either alone leaves the cap in place


def test_a_rule_of_several_dimensions_is_left_out_of_all(spark):
    found = [finding("SK102", message=str(i)) for i in range(4)] + [finding("SK102", message="t", dimension="token"), finding("SK202"), finding("SK202", "info", message="n")]
    c = card(spark, found)
    score = {"trigger": 100 - 5 * (1 + 0.5 + 0.25 + 0.1), "token": 100 - 5 - 5 * (1 + 0.5)}
    assert {d.dimension: (d.score, d.findings) for d in c.dimensions if d.findings} == {"trigger": (score["trigger"], 4), "token": (score["token"], 3)}
    first, second = c.top_fixes
    assert (first.rule_id, first["count"], first.dimension, first.message, first.gain) == ("SK102", 5, "token", "t", 3.78)  # 0.3 * 9.25 + 0.2 * 5, half up
    assert (second.rule_id, second["count"], second.severity, second.message, second.gain) == ("SK202", 2, "warn", "m", 1.5)
    assert second.projected_composite == round(c.composite + 1.5, 2) and second.projected_grade == "A"


def test_findings_are_grouped_without_what_follows_from_their_rule(spark, tmp_path):
    """Sorted by path first and joined to the catalogue once grouped; texts are carried only for fixes, and several terms only where there are several findings."""
    spark.createDataFrame([finding("SK102", message=m) for m in ("b", "a")] + [finding("SK401")], FINDING).write.parquet(f"{tmp_path}/f")
    found = spark.read.parquet(f"{tmp_path}/f")
    plan = scoring.rule_entries(found, texts=False)._jdf.queryExecution().optimizedPlan().toString()
    grouped = next(line for line in plan.splitlines() if "Aggregate" in line)
    assert grouped.split("Aggregate [")[1].startswith("path") and "multiplier" not in grouped and "security_cap" not in grouped and "fix" not in grouped
    rows = {r.rule_id: r for r in scoring.rule_entries(found).collect()}
    assert (rows["SK102"].n, rows["SK102"].message, rows["SK102"].each, rows["SK102"].terms, rows["SK102"].capping) == (2, "a", 5.0, [5.0, 2.5], False)
    assert (rows["SK401"].n, rows["SK401"].each, rows["SK401"].terms, rows["SK401"].capping) == (1, 15.0, None, True)


def test_rollup_and_gate(spark):
    cards = spark.createDataFrame([("r", "A", 95.0), ("r", "C", 74.0), ("q", "F", 10.0), ("s", "B", 84.0)], "repo string, grade string, composite double")
    assert {r.repo: r.overall for r in rollup.worst_grade(cards, "repo").collect()} == {"r": "C", "q": "F", "s": "B"}
    assert {r.grade for r in rollup.gate(cards, "B").collect()} == {"C", "F"}
    assert {r.grade for r in rollup.gate(cards, "F").collect()} == {"F"}
    assert rollup.exit_code(cards.where("repo = 's'")) == 0 and rollup.exit_code(cards) == 1
    with pytest.raises(UserError):
        rollup.gate(cards, "E")


def test_config(tmp_path):
    assert parse_rule_flags("sk101=off, MCP201=warn") == {"SK101": "off", "MCP201": "warn"}
    p = tmp_path / "c.json"
    p.write_text('{"budgets": {"mcpMaxTools": 5}, "rules": {"SK101": "info"}, "threshold": "A"}')
    c = load_config(str(p), rule_flags="SK101=off")
    assert c.budgets.mcpMaxTools == 5 and c.rules == {"SK101": "off"} and c.threshold == "A" and c.budgets.ctxTokensInfo == 1500
    assert load_config(None, str(tmp_path / "none.json")).threshold == "B"
    for bad in ('{"x": 1}', "[", '{"budgets": {"y": 1}}', '{"threshold": "E"}'):
        p.write_text(bad)
        with pytest.raises(UserError):
            load_config(str(p))
    for bad in ("SK101", "SK101=loud"):
        with pytest.raises(UserError):
            parse_rule_flags(bad)
