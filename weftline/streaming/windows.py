"""Structured Streaming: incremental ingest, event-time windows, stream deduplication. State is bounded by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, path: str, schema: StructType | str, format: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """A stream of files as they come; the text operators that only project apply to it unchanged."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def windowed_counts(df: DataFrame, at: str, group: str, size: str = "10 minutes", slide: str | None = None, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Tumbling or sliding counts (and sums) by group; rows later than the watermark are left out."""
    df = df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    out = df.groupBy(F.window(at, size, slide) if slide else F.window(at, size), group).agg(*aggs)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), group, *[a for a in ("n", "total") if a in out.columns])


def sessions(df: DataFrame, at: str, group: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by group that end after a gap."""
    df = df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    out = df.groupBy(F.session_window(at, gap), group).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), group, "n")


def deduplicated(df: DataFrame, at: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there, once, to Parquet; restarts go on from the checkpoint."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).format("parquet").trigger(availableNow=True).start()
    q.awaitTermination()
