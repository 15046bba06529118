"""Gapless numbering of the rows of each group without bringing a group to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubrica.llm.common import written


def numbered(df: DataFrame, group: list[str], keys: list[str], to: str, blocks: int) -> DataFrame:
    """The columns group + keys, and `to`: 0, 1, 2, ... within each group, in the order of (block, keys, input partition).

    A row's block is a hash of its keys and its input partition modulo `blocks`. Ranks are taken within a block, and blocks start where the ones
    before them end, so the largest sorted unit is a block. Rows equal in group and keys are counted by input partition before the shuffle and spread
    out again at the end, so no task has more of them than one that read them; the counts are a table in the shared folder, since two plans read them. Nulls in keys
    sort first. Nulls in group are a group.
    """
    own = df.select(*group, *keys).withColumn("_part", F.spark_partition_id()).groupBy(*group, *keys, "_part").agg(F.count(F.lit(1)).alias("_c"))
    own = written(own.withColumn("_block", F.pmod(F.xxhash64(*keys, "_part"), F.lit(blocks)).cast("int")), "numbered")
    inner = Window.partitionBy(*group, "_block").orderBy(*keys, "_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = own.withColumn("_end", F.sum("_c").over(inner))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy(*group, "_block").agg(F.sum("_c").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    match = [ranked[c].eqNullSafe(starts[c]) for c in (*group, "_block")]
    placed = ranked.join(starts, match).select(*[ranked[c] for c in (*group, *keys)], "_c", (F.col("_start") + F.col("_end") - F.col("_c")).alias("_at"))
    return placed.select(*group, *keys, F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("_c") - 1)).alias(to))


def block_count(rows: int, per_block: int = 20_000, least: int = 64) -> int:
    """Blocks for so many rows: their number grows with the table, their size doesn't."""
    return max(least, -(-rows // per_block))
