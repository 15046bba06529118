"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word contracts: space and the five ASCII controls 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
SPACES_RE = r"[ \t\n\x0B\f\r]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder on a local master, where there is one machine; an error elsewhere."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rubrica/{name}-{uuid.uuid4().hex}"


#: Whether the files of a query's shuffles go when it is over; otherwise they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, once computed and cut from their lineage, as a Parquet table in the shared folder; nothing of the shuffles that led to it stays on disk."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def delete_path(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, so that a batch of long texts stays small in the workers. Plans have no option for it, so the session's is lowered, never raised."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which keeps what it caches in its own frame; when a task is over, the worker gives the freed memory back, as Spark hands it to the next stage."""

    @functools.wraps(run)
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return told


def pieces(batch: pa.RecordBatch, text: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts hold about most_bytes at most (one row at least)."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
        if size and size + (n or 0) > most_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def fold_of(doc_id: Column, k: int = 5) -> Column:
    """The fold of a row: crc32 of doc_id as text, modulo k (null: 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % k, F.lit(0)).cast("int")


def fold_of_value(doc_id: int | None, k: int = 5) -> int:
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % k


#: Training texts hold so many characters at most; whole texts only, in the order of their hashed ids.
TRAINING_CHARS = 48_000_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, most_chars: int = TRAINING_CHARS) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled texts outside fold 0, the ones whose hashed doc_id is smallest, and of `most_chars` characters.

    The label table holds only ids and marks, so the bound is applied to it before any text is touched; rows with null id or mark train
    nothing; an id that is labelled twice trains by its larger mark, and one that several rows have by the least of their texts.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna().where(fold_of(F.col("doc_id")) != 0)
    chosen = marks.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = spark.createDataFrame([(int(r[0]),) for r in chosen], "doc_id long")
    sizes = {r[0]: r[1] for r in slim.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max(F.length("text"))).collect()}
    kept, chars = [], 0
    for i, y in chosen:
        if i in sizes and chars + sizes[i] <= most_chars:
            chars += sizes[i]
            kept.append((int(i), int(y)))
    bounded = spark.createDataFrame(kept, "doc_id long, y int")
    return slim.join(F.broadcast(bounded), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def rows_kept(docs: DataFrame, told: Broadcast, judge: Callable[[Any], Callable[[list[str]], list[bool]]], text: str = "text") -> DataFrame:
    """The rows of docs, whole, that judge(told.value) keeps. Each is judged by its own text (null: empty), so rows that share an id, or have none, don't matter to each other."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = judge(told.value)
        for whole in batches:
            for b in pieces(whole, text):
                yield b.filter(pa.array(keep([t or "" for t in b.column(text).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
