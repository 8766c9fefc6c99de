"""LEAF files that keep arriving: a file stream over a drop folder.

Every micro-batch parses the files that are new, appends good rows and rejected
lines to Parquet, and ends (AvailableNow) or goes on. The stream's checkpoint
makes each file count once; a batch that is retried overwrites its own folder,
so nothing is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gapfold.operators.badrows import bad_rows, good_rows, layouts_of
from gapfold.session import Scratch

_FILES = "path string, modificationTime timestamp, length long, content binary"


def _lines(files: DataFrame) -> DataFrame:
    text = F.split(F.col("content").cast("string"), r"\r?\n", -1)
    return files.select(F.xxhash64("path").alias("file_id"), F.posexplode(text).alias("pos", "line_text")).select("file_id", (F.col("pos") + 1).alias("line_no"), "line_text")


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True, files_per_batch: int = 10_000) -> StreamingQuery:
    """Start the stream: rows to out/rows, rejects to out/rejects, each under a
    folder batch=<number>."""

    def write(batch: DataFrame, number: int) -> None:
        lines, scratch = _lines(batch), Scratch(batch.sparkSession)
        layouts = layouts_of(lines, scratch)
        good_rows(lines, layouts).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        bad_rows(lines, layouts).write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")
        scratch.clear()

    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.csv").load(folder)
    w = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()


def windowed_power(stream: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Mean battery voltage and temperature per instrument and window of a power
    log stream; rows later than `late` are dropped by the watermark."""
    return stream.withWatermark("datetime", late).groupBy(F.window("datetime", window), "serial_number").agg(
        F.avg("battery_voltage").alias("battery_voltage"), F.avg("temperature").alias("temperature"), F.count(F.lit(1)).alias("n"))
