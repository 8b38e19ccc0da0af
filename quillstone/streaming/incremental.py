"""Incremental runs: new files are taken from a folder as a stream, each exactly once.

The checkpoint of the stream is the record of what is done; with ``available_now`` a run takes all that is
there and ends, so it can be scheduled like a batch job. There is nothing to window: the stages are maps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.sources.files import readable, stem_of


def markdown_stream(spark: SparkSession, folder: str, pattern: str = "*.md", max_files: int | None = None) -> DataFrame:
    """doc_id, text of files as they arrive."""
    reader = spark.readStream.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    found = reader.text(folder, wholetext=True)
    return found.select(stem_of(F.col("_metadata.file_path")).alias("doc_id"), readable(F.col("value")).alias("text"))


def table_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(folder)


def run_stage(stream: DataFrame, stage: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> StreamingQuery:
    """Apply ``stage`` to every new micro-batch and append the result to ``output``.

    ``stage`` sees a batch DataFrame and may use windows and joins within it; a batch that is repeated after
    a failure overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(stream: DataFrame, time: str, delay: str = "1 day", width: str = "1 day", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows per window and key of a stream, rows later than ``delay`` left out by the watermark."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
