"""Tables in the folder that driver and executors share, which cut a plan's lineage and are read several times, and rows dealt to tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local master, which is one machine, and an error elsewhere."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of df, dealt by keys to four tasks a core, for work that costs far more than reading: a row group, of up to a million rows, is one task's, and small shuffles are put together into a few."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def unsent(df: DataFrame) -> DataFrame:
    """df for a join by shuffle: sizes are guessed from files, where rows derived from small ones, or exploded, look small enough to be sent through the driver to every task."""
    return df.hint("merge")


def table_of(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, computed once, as a Parquet table in the shared folder; drop_table deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rubrica/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes a table made by table_of that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
