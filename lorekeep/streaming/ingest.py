"""Streams: idempotent ingestion, the latest reading of each key, and (beyond the catalogue's needs) event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_readings(stream: DataFrame, out: str, checkpoint: str, key: list[str], at: str) -> StreamingQuery:
    """Each batch adds its newest reading of a key to out, in a folder of its own number: a batch that is run again
    overwrites itself. A late, older reading is written but never wins in ``current``."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), at).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, key: list[str], at: str) -> DataFrame:
    """The newest reading of each key over all batches; ties go to the later batch."""
    rows = spark.read.parquet(out)
    order = F.struct(at, "batch")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != "batch")), order).alias("r")).select("r.*")


def windowed(events: DataFrame, at: str, by: list[str], size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts by tumbling windows under a watermark; for streams and tables alike."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, size).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
