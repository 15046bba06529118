"""Corpus pipeline: toxicity, quality, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the next stage's docs.
The first four return the columns of documents, for the rows they keep; the last returns the packed pieces. Stages decide on rows: a doc_id
may be null or repeated, and what happens to a row doesn't depend on others that share its id.

Nulls in any column, all stages: a null text counts as the empty one, which the quality stage rejects; a null id is kept as such. Texts of any length are judged
whole. Ties: a text at a threshold exactly is toxic, good, linked or leaked. Of rows alike in text one stays, whichever ids they have. Empty tables give empty
tables. Further columns of documents, whatever their names, are carried by the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.llm import decontaminate, jaccard, packing, quality, toxicity
from rubrica.llm.common import delete_path, forget, fresh_path, read, written

def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5."""
    model = toxicity.train(docs, labelled(spark, sf_dir))
    return toxicity.clean_rows(docs, model)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    model = quality.train(docs, labelled(spark, sf_dir))
    return quality.good_rows(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that five-word shingles link at 0.8 or more, one row: that of the smallest doc_id (null last).

    Rows get a key of their own, written with them, so repeated and null ids neither join groups nor escape them.
    """
    row = next(x for n in range(len(docs.columns) + 1) if (x := f"_row{n}") not in docs.columns)
    keyed = written(docs.select(F.monotonically_increasing_id().alias(row), "*"), "keyed")
    groups = jaccard.jaccard_components(keyed, k=5, num=80, den=100, key=row)
    members = groups.where("n_links > 0").select(F.col("doc_id").alias(row), F.col("component_id").alias("_group")).join(keyed.select(row, F.col("doc_id").alias("_id")), row)
    first = F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col(row)))
    tops = members.groupBy("_group").agg(first.alias("top")).select(F.col(f"top.{row}").alias(row))
    gone = written(members.select(row).join(tops, row, "left_anti"), "gone")
    forget(groups)
    return keyed.join(jaccard.hinted(gone, gone.count()), row, "left_anti").drop(row)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.leak_free_rows(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, packed into sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_copies", drop_near_copies), ("leaks", drop_leaks), ("packing", pack)]

#: No SQL: learned models, WAND and packing are not expressible; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. Each stage's table replaces the one before it in the shared folder."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
