"""What the operators share: written tables, the fold of a row, Arrow batches of bounded bytes."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.tables import new_path, scope, shared_dir, written  # noqa: F401

#: A word is a run of anything but ASCII white space, in texts and in UTF-8 bytes alike.
WORD = r"[^\x20\x09-\x0D]+"


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to differ from df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def remainder(doc_id: Column | str) -> Column:
    """crc32(doc_id as text) mod 3; a null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return remainder(doc_id) == 1


def released() -> None:
    """Gives memory that is no longer used back to the system: Spark keeps Python workers between stages, beside the next stage's own."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that hold at most `limit` bytes of `column` (one row at least), so memory follows neither row counts nor mean lengths."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch
        released()
