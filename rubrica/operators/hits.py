"""What a rule emits: arrays of hits on its artifact's row, exploded once for all rules of a scan."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.config import Config

HIT_FIELDS = {"severity": "string", "message": "string", "foundational": "boolean", "file": "string", "line": "int", "tool_name": "string", "meta": "map<string,string>"}
HIT_TYPE = "struct<" + ",".join(f"{k}:{v}" for k, v in HIT_FIELDS.items()) + ">"
HITS_TYPE = f"array<{HIT_TYPE}>"
HITS_SCHEMA = ["artifact_type", "path", "rule_id", *HIT_FIELDS]


def built_once(build: Callable[..., dict[str, Column]]) -> Callable[..., dict[str, Column]]:
    """Keeps rule expressions for a session, by budgets, the only settings that they hold. They name columns only, so any table can take them; making them is tens of thousands of calls to the JVM, however small the tables."""
    known: dict[tuple, dict[str, Column]] = {}

    @wraps(build)
    def again(*args: object) -> dict[str, Column]:
        context = SparkContext._active_spark_context
        key = (context and context.applicationId, *[repr(a.budgets) if isinstance(a, Config) else repr(a) for a in args])
        if key not in known:
            for old in [k for k in known if k[0] != key[0]] or list(known)[:-7]:  # another session's are of no use
                del known[old]
            known[key] = build(*args)
        return dict(known[key])

    return again


def hit(message: Column | str, **more) -> Column:
    """A hit; unnamed fields are null."""
    own = {"message": message} | more
    cols = []
    for name, kind in HIT_FIELDS.items():
        v = own.get(name)
        cols.append((v if isinstance(v, Column) else F.lit(v)).cast(kind).alias(name))
    return F.struct(*cols)


def none() -> Column:
    return F.array().cast(HITS_TYPE)


def when(condition: Column, *hits: Column) -> Column:
    """The hits if the condition holds; a null condition counts as false."""
    return F.when(condition, F.array(*hits)).otherwise(none())


def text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def by_row(table: DataFrame, artifact_type: str, rules: Mapping[str, Column]) -> DataFrame:
    """Hits of rules that look at one row each: one scan and one explode for all of them."""
    if not rules:
        return table.sparkSession.createDataFrame([], "artifact_type string, path string, rule_id string, " + ", ".join(f"{k} {v}" for k, v in HIT_FIELDS.items()))

    def tag(rule: str, hits: Column) -> Column:
        return F.transform(hits, lambda h: F.struct(F.lit(rule).alias("rule_id"), *[h[k].alias(k) for k in HIT_FIELDS]))

    tagged = [tag(rule, hits) for rule, hits in rules.items()]
    return table.select(F.lit(artifact_type).alias("artifact_type"), "path", F.explode(F.concat(*tagged)).alias("h")).select("artifact_type", "path", "h.*")


def rows(df: DataFrame, artifact_type: str, rule: str, one: Column) -> DataFrame:
    """Hits of a rule that has a row for each of them; df has path."""
    return df.select(F.lit(artifact_type).alias("artifact_type"), "path", F.lit(rule).alias("rule_id"), one.alias("h")).select("artifact_type", "path", "rule_id", "h.*")
