"""Scorecards: severity decay, weighted dimensions, caps, grades and ranked fixes.

Findings are pre-aggregated to a row for each artifact, dimension and rule, and then to an array of at most as many entries as there are
rules, so no shuffle carries single findings further than their first partial aggregate. Everything after that is an expression on the
artifact's row. Sums run in the order of rules and occurrences, because grades are taken from the unrounded sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.config import BANDS, DECAY, DECAY_TAIL, FOUNDATIONAL_CAP, GRADES, LABELS, PENALTY, PROBE_WEIGHTS, SECURITY_CAP, WEIGHTS
from rubrica.functions.text import let, round2
from rubrica.operators.catalog import RULES, rule_meta
from rubrica.operators.engine import sort_key

#: So many occurrences of a rule are added one by one, in order; those beyond all weigh the same and are added at once.
ONE_BY_ONE = 1000

KEYS = ["path", "artifact_type"]


def grade_for(score: Column) -> Column:
    """Halved at each step: within lambdas, a CASE walks its branches from the start for each one it tests."""

    def among(bands: list[tuple[float, str]]) -> Column:
        if len(bands) == 1:
            return F.lit(bands[0][1])
        half = len(bands) // 2
        return F.when(score >= bands[half - 1][0], among(bands[:half])).otherwise(among(bands[half:]))

    return among([*BANDS, (0.0, "F")])


def grade_floor(grade: Column) -> Column:
    """The least score of a grade; 0 for F."""
    out = F.when(grade == BANDS[0][1], BANDS[0][0])
    for least, g in BANDS[1:]:
        out = out.when(grade == g, least)
    return out.otherwise(0)


def grade_rank(grade: Column) -> Column:
    """0 for the best grade."""
    return F.array_position(F.array(*map(F.lit, GRADES)), grade) - 1


def weight_rows(weights: dict[str, float]) -> Column:
    return F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(LABELS[d]).alias("label"), F.lit(float(w)).alias("weight")) for d, w in weights.items()])


def weights_of(artifact_type: Column, probing: Column) -> Column:
    """The dimensions of an artifact, in order; probed servers have their own set."""
    out = F.when((artifact_type == "mcp-server") & probing, weight_rows(PROBE_WEIGHTS))
    for t, w in WEIGHTS.items():
        out = out.when(artifact_type == t, weight_rows(w))
    return out


def decay(i: Column) -> Column:
    out = F.when(i == 0, DECAY[0])
    for k, d in enumerate(DECAY[1:], 1):
        out = out.when(i == k, d)
    return out.otherwise(DECAY_TAIL)


def penalty_of(severity: Column) -> Column:
    out = F.when(severity == "error", PENALTY["error"])
    return out.when(severity == "warn", PENALTY["warn"]).when(severity == "info", PENALTY["info"])


def terms(each: Column, n: Column) -> Column:
    """What a rule's occurrences take off its dimension, in order; those beyond ONE_BY_ONE are one term."""
    few = F.slice(F.array(*[each * d for d in DECAY]), F.lit(1), n.cast("int"))
    first = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(ONE_BY_ONE)).cast("int") - 1), lambda i: each * decay(i))
    return F.when(n <= len(DECAY), few).when(n > ONE_BY_ONE, F.array_append(first, each * F.lit(DECAY_TAIL) * (n - ONE_BY_ONE))).otherwise(first)


def added(total: Column, rule: Column) -> Column:
    """The total after a rule's terms, one by one; a single occurrence is its own term."""
    return F.when(rule["n"] == 1, total + rule["each"]).otherwise(F.aggregate(rule["terms"], total, lambda acc, t: acc + t))


def dimension_score(rules: Column, dimension: Column, without: Column | None = None) -> Column:
    """The score of a dimension, or what it were without a rule. One fold, in order: arrays between would be made anew for each dimension and rule."""
    counts = lambda r: r["dimension"] == dimension if without is None else (r["dimension"] == dimension) & (r["rule_id"] != without)
    return F.greatest(F.lit(0.0), F.lit(100.0) - F.aggregate(rules, F.lit(0.0), lambda acc, r: F.when(counts(r), added(acc, r)).otherwise(acc)))


def scored(rules: Column, weights: Column) -> Column:
    """The weights with each dimension's unrounded score."""
    return F.transform(weights, lambda w: F.struct(w["dimension"].alias("dimension"), w["label"].alias("label"), w["weight"].alias("weight"), dimension_score(rules, w["dimension"]).alias("score")))


def composite_of(dims: Column) -> Column:
    return F.aggregate(dims, F.lit(0.0), lambda acc, d: acc + d["score"] * d["weight"])


def capped(raw: Column, founded: Column, insecure: Column) -> Column:
    """The foundational cap, else the security cap; a cap only lowers."""
    return F.when((raw > FOUNDATIONAL_CAP) & founded, F.lit(float(FOUNDATIONAL_CAP))).when((raw > SECURITY_CAP) & insecure, F.lit(float(SECURITY_CAP))).otherwise(raw)


def rule_entries(findings: DataFrame, meta: DataFrame | None = None, texts: bool = True) -> DataFrame:
    """One row for each artifact, dimension and rule: occurrences, the first finding's severity (with texts, also message and fix), what one occurrence
    takes off (and all, if there are several), and what it caps.

    Rows are sorted by the keys, so path comes first: it tells most rows apart, where types are few. What follows from a rule is joined to its row, not to each finding.
    """
    meta = meta if meta is not None else rule_meta(findings.sparkSession)
    own = meta.select("rule_id", "security_cap", "multiplier")
    shown = ["severity", "message", "fix"] if texts else ["severity"]
    grouped = findings.groupBy(*KEYS, "rule_id", "dimension").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(sort_key(within_rule=True).alias("key"), *shown)).alias("first"),
        F.bool_or(F.coalesce("foundational", F.lit(False))).alias("foundational"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in PENALTY],
    )
    joined = grouped.join(F.broadcast(own), "rule_id", "left")  # the catalogue is a fixed table of some dozens of rows
    capping = (F.col("n_error") > 0) & ((F.col("dimension") == "security") | F.coalesce("security_cap", F.lit(False)))
    out = joined.select(
        *KEYS,
        "rule_id",
        "dimension",
        "n",
        *[F.col(f"first.{c}").alias(c) for c in shown],
        (penalty_of(F.col("first.severity")) * F.coalesce("multiplier", F.lit(1.0))).alias("each"),
        "foundational",
        capping.alias("capping"),
        *[f"n_{s}" for s in PENALTY],
    )
    return out.withColumn("terms", F.when(F.col("n") > 1, terms(F.col("each"), F.col("n"))))


def rule_rows(findings: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """rule_entries, with the terms of single occurrences too."""
    return rule_entries(findings, meta).withColumn("terms", F.coalesce("terms", F.array("each")))


def scorecards(artifacts: DataFrame, findings: DataFrame, meta: DataFrame | None = None, fixes: bool = True) -> DataFrame:
    """artifacts (artifact_type, path, name, tokens, probing, rules_run) with their scores.

    Artifacts without findings score 100. Findings in dimensions without weight count for severity counts, caps and fixes.
    """
    entries = rule_entries(findings, meta, texts=fixes)
    entry = F.struct(*[c for c in entries.columns if c not in KEYS])
    per = entries.groupBy(*KEYS).agg(F.sort_array(F.collect_list(entry)).alias("rules"))
    out = artifacts.join(per, KEYS, "left")
    out = out.withColumn("rules", F.coalesce("rules", F.array().cast(out.schema["rules"].dataType)))
    out = out.withColumns({"founded": F.exists("rules", lambda r: r["foundational"]), "insecure": F.exists("rules", lambda r: r["capping"]), "dims": scored(F.col("rules"), weights_of(F.col("artifact_type"), F.coalesce("probing", F.lit(False))))})
    out = out.withColumn("raw", composite_of(F.col("dims")))
    out = out.withColumn("score", capped(F.col("raw"), F.col("founded"), F.col("insecure")))
    total = lambda c: F.aggregate("rules", F.lit(0).cast("long"), lambda a, r: a + r[c])
    n_findings = lambda d: F.aggregate("rules", F.lit(0).cast("long"), lambda a, r: F.when(r["dimension"] == d["dimension"], a + r["n"]).otherwise(a))
    dims = F.transform("dims", lambda d: F.struct(d["dimension"].alias("dimension"), d["label"].alias("label"), round2(d["score"]).alias("score"), grade_for(d["score"]).alias("grade"), d["weight"].alias("weight"), n_findings(d).alias("findings")))
    foundational = (F.col("raw") > FOUNDATIONAL_CAP) & F.col("founded")
    out = out.withColumns(
        {
            "composite": round2(F.col("score")),
            "composite_raw": round2(F.col("raw")),
            "grade": grade_for(F.col("score")),
            "foundational_capped": foundational,
            "security_capped": (F.col("raw") > SECURITY_CAP) & F.col("insecure") & ~foundational,
            "dimensions": dims,
            **{f"n_{s}": total(f"n_{s}") for s in PENALTY},
        }
    )
    if fixes:
        out = out.withColumn("top_fixes", top_fixes(F.col("rules"), F.col("dims"), F.col("score")))
    return out.drop("rules", "dims", "raw", "score", "founded", "insecure")


def top_fixes(rules: Column, dims: Column, score: Column, most: int = 3) -> Column:
    """The three rules whose absence would raise the score most: each rule is left out and its own dimension scored again, caps included.

    Texts and grades are told of the three only: whatever an array of structs holds is copied for every rule.
    """

    def left_out(rule: Column) -> Column:
        own = F.filter(rules, lambda r: r["rule_id"] == rule)["dimension"]
        return let(own, lambda dimensions: let(projected(rule, dimensions), lambda x: F.struct((-round2(x - score)).alias("order"), rule.alias("rule_id"), x.alias("score"))))

    def projected(rule: Column, dimensions: Column) -> Column:
        score_of = lambda d: F.when(F.exists(dimensions, lambda x: x == d["dimension"]), dimension_score(rules, d["dimension"], rule)).otherwise(d["score"])
        again = F.aggregate(dims, F.lit(0.0), lambda acc, d: acc + score_of(d) * d["weight"])
        others = lambda flag: F.exists(rules, lambda r: r[flag] & (r["rule_id"] != rule))
        return let(again, lambda raw: capped(raw, others("foundational"), others("capping")))

    def told(x: Column) -> Column:
        return let(F.filter(rules, lambda r: r["rule_id"] == x["rule_id"]), lambda own: shown(x, own, F.get(own, F.lit(0))))

    def shown(x: Column, own: Column, first: Column) -> Column:
        n = F.aggregate(own, F.lit(0).cast("long"), lambda a, r: a + r["n"])
        return F.struct(x["rule_id"].alias("rule_id"), *[first[c].alias(c) for c in ("severity", "dimension", "message", "fix")], n.alias("count"), (-x["order"]).alias("gain"), round2(x["score"]).alias("projected_composite"), grade_for(x["score"]).alias("projected_grade"))

    found = F.filter(F.transform(F.array_distinct(rules["rule_id"]), left_out), lambda x: x["order"] < 0)
    return F.transform(F.slice(F.sort_array(found), 1, most), told)


def rules_run(artifact_type: str, overrides: dict[str, str]) -> int:
    return sum(r.applies_to == artifact_type and overrides.get(r.id) != "off" for r in RULES.values())
