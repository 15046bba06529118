"""Weighted rendezvous hashing of stable record keys over shards.

A record goes to the shard with the largest score -weight / ln(u), where u in (0, 1) is a hash of key and shard name. A shard's score for
a record depends on nothing else, so adding a shard moves records only into it, and removing one moves only its own records.

Nulls: a null key hashes as no key, so all such rows share a shard. Null or empty texts have no bytes (size 1, crc32 0). Repeated rows
share a shard and get slots of their own. Texts of any length count whole. Ties: of shards with equal scores the smaller wins. An empty table gives no
row. Extra columns are not carried, so their names can't clash; join the result on the key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.llm.slots import block_count, numbered


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key, among shards with positive weights; ties go to the smaller shard number."""
    live = {int(s): float(w) for s, w in sorted(weights.items()) if w > 0}
    if not live:
        raise ValueError("no shard has a positive weight")

    def score(shard: int, weight: float) -> Column:
        # 53 bits of the hash, moved by a half so that u is neither 0 nor 1
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
        return F.struct((F.lit(-weight) / F.ln(u)).alias("score"), F.lit(-shard).alias("s"))

    best = F.array_max(F.array(*[score(s, w) for s, w in live.items()]))
    return (-best["s"]).cast("int")


def rendezvous(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of each row; grown_shard by the weights `grown`, null without them."""
    content = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(key), (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content).cast("long").alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of(F.col(key), weights))
    rows = rows.withColumn("grown_shard", shard_of(F.col(key), grown) if grown else F.lit(None).cast("int"))
    placed = numbered(rows, ["shard"], [key, "size", "text_crc32", "grown_shard"], "slot", block_count(docs.count() // len(weights) + 1))
    return placed.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op2_rendezvous(spark, sf_dir: str) -> DataFrame:
    from rubrica.llm.common import read

    return rendezvous(read(spark, sf_dir, "documents"), {s: 1.0 for s in range(16)}, {s: 1.0 for s in range(17)})
