"""Grading of arriving file tables with Structured Streaming. An extension: each micro-batch is graded by itself and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rubrica.config import Config
from rubrica.plans.grading import grade_files


def grade_stream(files: DataFrame, to: str, checkpoint: str, config: Config | None = None, available_now: bool = True) -> StreamingQuery:
    """Grades a stream of file rows (repo, path, size, content) into Parquet, partitioned by batch so that a repeated batch replaces itself.

    All files of a repository are expected in one micro-batch, as links and siblings are looked up there.
    """

    def each(batch: DataFrame, n: int) -> None:
        grade_files(batch, config).write.mode("overwrite").parquet(f"{to}/batch={n}")

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
