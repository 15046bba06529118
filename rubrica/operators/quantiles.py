"""Exact quantiles by nearest rank, of groups of any size.

A group's values are counted by bucket, and only the bucket that holds the wanted rank is looked into: first among buckets of the group's whole range,
then among buckets of that bucket. What is sorted in the end is the values of one fine bucket, not those of the group, and what is shuffled is distinct values
with their counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
INF = float("inf")


def bucket_of(v: Column, low: Column, high: Column) -> Column:
    """Never falls as v rises: values up to low, even steps, values from high, infinity and NaN, which is the largest."""
    share = (v / 2 - low / 2) / (high / 2 - low / 2)  # halves, so that the range of any two finite numbers is finite
    inner = F.when(v <= low, 0).when(v >= high, BUCKETS).otherwise(F.greatest(F.lit(1), F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS).cast("int"))))
    return F.when(F.isnan(v), BUCKETS + 2).when(v == INF, BUCKETS + 1).when(v == -INF, -1).otherwise(inner)


def holding(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """The row of each group in which rank `_r` falls, with `_r` counted from that row's first value."""
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.withColumn("_to", upto).where("_to >= _r AND _to - _n < _r").withColumn("_r", F.col("_r") - (F.col("_to") - F.col("_n"))).drop("_to", "_n")


def nearest_rank(df: DataFrame, by: list[str], value: str, share: float, name: str = "p") -> DataFrame:
    """(by, name, n): each group's value of rank ceil(share * n), at least 1, among its n values. Null values don't count; a group without others has no row.

    by: columns without nulls. Ties need no rule, as equal values are one row with a count.
    """
    counted = df.select(*by, F.col(value).alias("_v")).where("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    v = F.col("_v").cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) < INF), v)
    ends = [F.min(finite).alias("_low"), F.max(finite).alias("_high")]
    totals = counted.groupBy(*by).agg(*ends, F.sum("_n").alias("n")).withColumn("_r", F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("n"))))
    ranged = totals
    for _ in range(2):
        placed = counted.join(ranged, by).withColumn("_b", bucket_of(v, F.col("_low"), F.col("_high")))
        hist = placed.groupBy(*by, "_b").agg(F.sum("_n").alias("_n"), F.first("_r").alias("_r"), *ends)
        found = holding(hist, by, "_b")
        counted = placed.drop("_low", "_high", "_r", "n").join(found.select(*by, "_b"), [*by, "_b"]).drop("_b")
        ranged = found.drop("_b")
    last = holding(counted.join(ranged.select(*by, "_r"), by), by, "_v").select(*by, F.col("_v").alias(name))
    return last.join(totals.select(*by, "n"), by)
