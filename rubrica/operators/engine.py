"""From hits to findings: overrides, defaults, fix hints and the total order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.config import Config
from rubrica.operators.catalog import active, rule_meta
from rubrica.tables import table_of

FINDING_COLUMNS = ["artifact_type", "path", "rule_id", "severity", "dimension", "message", "fix", "foundational", "file", "line", "tool_name", "meta"]


def sort_key(within_rule: bool = False) -> Column:
    """The order of an artifact's findings: rule (but within a rule), file, tool, line, message, by locale; missing ones first."""
    name = lambda c: F.collate(F.coalesce(F.col(c), F.lit("")), "UNICODE")
    return F.struct(*[] if within_rule else [name("rule_id").alias("r")], name("file").alias("f"), name("tool_name").alias("t"), F.coalesce("line", F.lit(0)).alias("l"), name("message").alias("m"))


def to_findings(hits: DataFrame, config: Config | None = None) -> DataFrame:
    """Findings of hits: severity is the override, else the hit's, else the rule's; rules that are off are left out. Unknown rules fail no row and are dropped."""
    config = config or Config()
    meta = rule_meta(hits.sparkSession).select("rule_id", F.col("severity").alias("_default"), "dimension", "fix")
    off = [r for r, s in config.rules.items() if s == "off"]
    over = {r: s for r, s in config.rules.items() if s != "off"}
    told = F.element_at(F.create_map(*[F.lit(x) for kv in over.items() for x in kv]), F.col("rule_id")) if over else F.lit(None).cast("string")
    kept = hits.where(~F.col("rule_id").isin(off)) if off else hits
    joined = kept.join(F.broadcast(meta), "rule_id")  # the catalogue is a fixed table of some dozens of rows
    return joined.withColumn("severity", F.coalesce(told, F.col("severity"), F.col("_default"))).withColumn("foundational", F.coalesce("foundational", F.lit(False))).select(*FINDING_COLUMNS)


class RuleCrash(RuntimeError):
    """A rule that failed: a mistake in the rule, never a finding."""

    def __init__(self, rule_id: str, cause: Exception):
        super().__init__(f"rule {rule_id} crashed: {cause}")
        self.rule_id = rule_id


def computed_findings(hits_of: Callable[[Config], DataFrame], artifact_type: str, config: Config | None = None) -> DataFrame:
    """The findings of hits_of(config) as a table in the shared folder, or RuleCrash with the rule that failed.

    All rules of a type run in one plan, which tells no rule from another. Only when it fails, while it's built or while it runs, is each rule run alone to find the one.
    """
    config = config or Config()
    try:
        return table_of(to_findings(hits_of(config), config), "findings")
    except Exception as e:
        own = active(artifact_type, config.rules)
        for rule in own:
            others = {r: "off" for r in own if r != rule}
            try:
                hits_of(replace(config, rules={**config.rules, **others})).write.format("noop").mode("overwrite").save()
            except Exception as cause:
                raise RuleCrash(rule, cause) from e
        raise


def in_order(findings: DataFrame) -> DataFrame:
    """Findings sorted for display."""
    return findings.orderBy("artifact_type", "path", sort_key())
