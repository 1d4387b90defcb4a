"""Session lines as they arrive: deduplicated by a watermark, with running counts by window and project."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """New parquet files of a folder; the file source sees new files only, so hashes stay the authority on changes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deduplicated(lines: DataFrame, late: str = "2 hours") -> DataFrame:
    """Re-delivered rows of one (session_id, line_no) pass once while the watermark remembers them."""
    return lines.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["session_id", "line_no"])


def activity(lines: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Lines by arrival window, project and type."""
    return lines.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", window).alias("w"), "project_name", "type").agg(F.count("*").alias("lines")).select(F.col("w.start").alias("window_start"), "project_name", "type", "lines")


def run(lines: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """foreachBatch with a checkpoint; a restarted run goes on after the last finished batch."""
    writer = lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
