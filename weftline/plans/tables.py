"""Tables in the shared folder: they cut lineage, survive lost executors and fix what a range partition was given."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a local master gets a temporary one; on a cluster that would differ from machine to machine, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="weftline-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table of this application; it goes with the scope that is open, if any."""
    path = f"{shared_dir(spark).rstrip('/')}/weftline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    for scope in _SCOPES[-1:]:
        scope.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts lineage, survives lost executors and keeps repeated use from recomputing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written within; what is needed later has to be written or collected, and read, by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; frames that were read from them can no longer be used."""
    _delete(spark, f"{shared_dir(spark).rstrip('/')}/weftline/{spark.sparkContext.applicationId}")
