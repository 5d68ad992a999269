"""Zstandard archives of texts, committed by Spark's text writer so that a lost task is written again.

A file is a run of Zstandard frames with an empty skippable frame after each, which is the writer's line end; any
reader that goes on across frames reads it as one stream. `weftline.sources.readers.load_archives` reads them back
with `suffix` set, since the writer names its files part-*.txt.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.registry import op

_SKIP = struct.pack("<II", 0x184D2A50, 0)
#: Bytes of records at which a frame is closed, whatever their number.
FRAME_BYTES = 16 << 20
#: Frames of a file at most, so that a reader that holds a file whole holds no more than these.
FRAMES = 8

PACK = {
    "jsonl": lambda records: b"".join(r + b"\n" for r in records),
    "dat": lambda records: b"".join(b"%016d" % len(r) + r for r in records),
    "json": lambda records: json.dumps([r.decode() for r in records], ensure_ascii=False).encode(),
}


@op("save_archive")
def save_archive(df: DataFrame, path: str, kind: str = "jsonl", text: str = "text", meta: Sequence[str] = (), per_frame: int = 10_000, level: int = 3) -> DataFrame:
    """Non-null texts as jsonl (text and meta columns, a line each), dat (16-digit byte length, then the text) or json (an array of texts, a file each)."""
    if kind not in PACK:
        raise ValueError(f"no archive {kind}")
    line = F.to_json(F.struct(F.col(text).cast("string").alias("text"), *([F.struct(*meta).alias("meta")] if meta else []))) if kind == "jsonl" else F.col(text).cast("string")
    pack = PACK[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer, held, size = zstandard.ZstdCompressor(level=level), [], 0
        for batch in batches:
            for value in batch.column(0):
                held.append(value.as_py().encode())
                size += len(held[-1])
                if len(held) >= per_frame or size >= FRAME_BYTES:
                    yield pa.RecordBatch.from_pydict({"value": pa.array([packer.compress(pack(held))], pa.binary())})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"value": pa.array([packer.compress(pack(held))], pa.binary())})

    frames = df.where(F.col(text).isNotNull()).select(line.alias("value")).mapInArrow(run, "value binary")
    writer = frames.select(F.col("value").cast("string")).write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", _SKIP.decode("latin-1")).option("compression", "none")
    writer.option("maxRecordsPerFile", 1 if kind == "json" else FRAMES).text(path)
    return df


@op("save_chunks")
def save_chunks(df: DataFrame, path: str, rows_per_file: int, order_by: str | Sequence[str], text: str = "text") -> DataFrame:
    """Texts in key order, a line each, in files of at most rows_per_file lines."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    df.where(F.col(text).isNotNull()).orderBy(*keys).select(F.col(text).cast("string").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).text(path)
    return df
