"""Sinks as pipeline steps; each returns a DataFrame so that a pipeline can go on. Spark's committers make them safe to retry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.relational import reset_index
from weftline.operators.sampling import sampling
from weftline.plans.registry import op


@op("save_dataframe")
def save_dataframe(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = (), **options) -> DataFrame:
    """Write parquet, csv, json or orc; mode ignore keeps what is there."""
    if format not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"no format {format}")
    df.write.format(format).mode(mode).options(**({"header": True} if format == "csv" else {}) | options).partitionBy(*partition_by).save(path)
    return df


@op("save_as_json")
def save_as_json(df: DataFrame, path: str, compression: str = "none") -> DataFrame:
    df.write.mode("overwrite").option("compression", compression).json(path)
    return df


@op("save_as_text")
def save_as_text(df: DataFrame, path: str, text: str = "text", separator: str = "\n", order_by: str | None = None) -> DataFrame:
    """Non-null texts, each followed by the separator, in order if asked."""
    rows = df.where(F.col(text).isNotNull())
    rows = rows.orderBy(order_by) if order_by else rows
    rows.select(F.col(text).cast("string").alias("value")).write.mode("overwrite").option("lineSep", separator).text(path)
    return df


@op("save_metadata")
def save_metadata(df: DataFrame, path: str, meta_columns: Sequence[str], data_columns: Sequence[str]) -> DataFrame:
    """Write the metadata columns; go on with the data columns."""
    df.select(*meta_columns).write.mode("overwrite").parquet(path)
    return df.select(*data_columns)


@op("save_splits")
def save_splits(df: DataFrame, path: str, split: str = "split") -> DataFrame:
    """A folder for each split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)
    return df


@op("save_samples")
def save_samples(df: DataFrame, path: str, key: str, n: int = 10, text: str = "text", seed: int = 1) -> DataFrame:
    """n rows' texts by hash order as text; goes on with all rows."""
    sampling(df, key, n=n, seed=seed).select(F.col(text).alias("value")).coalesce(1).write.mode("overwrite").option("lineSep", "\n\n").text(path)
    return df


@op("save_shards")
def save_shards(df: DataFrame, path: str, shards: int, order_by: str, text: str = "text", copies: int = 1) -> DataFrame:
    """Contiguous shards in key order as text, a folder each; with copies, every row that often."""
    n = df.count() * copies
    rows = df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    placed = reset_index(rows.withColumn("__key", F.struct("__copy", order_by)), "__key", "__at")
    per = max(1, -(-n // shards))
    placed.select(F.floor(F.col("__at") / per).cast("int").alias("shard"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("shard").text(path)
    return df


@op("stdout_samples")
def stdout_samples(df: DataFrame, n: int = 5, columns: Sequence[str] | None = None, truncate: int = 80) -> DataFrame:
    """Print some rows; goes on with all."""
    (df.select(*columns) if columns else df).show(n, truncate)
    return df
