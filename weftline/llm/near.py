"""Near-duplicate groups by word shingles at a stated Jaccard similarity, one document of each kept.

Candidates come from two places: the covering tables of SimHash (`weftline.llm.simhash`), which miss no pair within
their radius, and bands of minimum hashes over the same shingles. The second is needed because two
texts at similarity 0.8 differ in about ten of 64 fingerprint bits, and a covering of that radius takes
thousands of tables; README.md has the figures. Every candidate is settled by the exact Jaccard similarity of
the documents' shingle sets.

In a bucket (a band's key, or fingerprints that the covering tables connect) each document is compared with the smallest id first.
Then every pair that shares a bucket and is not connected yet is compared, in salted blocks (`weftline.operators.dedup.settled`), so
all candidates of the stated similarity end in one group. Links become components by star steps; the smallest id stays.

Defined cases: null, empty and blank texts have no shingles and are all kept; a text of fewer words than a shingle has
its whole word sequence as one; rows with a null doc_id are kept; rows alike in doc_id are kept or dropped
together; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import simhash
from weftline.llm.common import slices, unused, written
from weftline.operators.dedup import band_keys, settled

BANDS, ROWS = 20, 5
#: Ids up to which dropped rows are found by broadcast (8 bytes each), by a shuffle beyond.
BROADCAST = 1_000_000
#: Comparisons with one document that one task makes.
OFTEN = 1024


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct XXH64 hashes of a text's word shingles, ascending; A-Z lower-cased."""
    return np.unique(simhash.hashes(text, size))


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of minimum hashes."""
    return band_keys(found, BANDS, ROWS)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, fp, keys) of every row with an id and shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, fps, keys = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = simhash.hashes(text, size)
                if len(found):
                    ids.append(doc_id)
                    fps.append(simhash.majority(found))
                    keys.append(_signed(bands(found)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("doc_id").type), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "fp", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint, keys array<bigint>")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, shingles) of the documents named in ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            found = [_signed(shingles(t, size)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], names=["id", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    few = ids.count() <= BROADCAST
    rows = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("__id"), "left_semi")
    return rows.mapInArrow(run, f"id {kind}, shingles array<bigint>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity is at least `similarity`; a row at a time in the JVM, so long documents do not gather in batches."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    # Sets of sizes that rule the similarity out are not intersected.
    fits = F.least(F.size("x"), F.size("y")) >= similarity * F.greatest(F.size("x"), F.size("y"))
    both = F.size(F.array_intersect("x", "y"))
    enough = F.when(fits, both >= similarity * (F.size("x") + F.size("y") - both)).otherwise(False)
    # A document that many are compared with is dealt to several tasks.
    often = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / OFTEN).cast("int").alias("pieces")).where("pieces > 1")
    often = written(often, "near-often")
    pieces = F.coalesce("pieces", F.lit(1))
    dealt = pairs.join(often, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), pieces).cast("int")).drop("pieces")
    two = two.join(often, "b", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("pieces")
    return dealt.join(one, "a").join(two, ["b", "salt"]).where(enough).select("a", "b").distinct()


def links(docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """Links (a, b), a > b, between ids of documents whose similarity is at least `similarity`: enough of them that all candidate pairs of it are connected."""
    rows = written(_sketches(docs, size), "near-sketches")
    nodes = written(rows.select("fp").distinct(), "near-nodes")
    roots = simhash.components(simhash.links(nodes, radius))
    by_bits = rows.join(roots, rows["fp"] == roots["node"], "left").select(F.xxhash64(F.lit(-1), F.coalesce("root", "fp")).alias("bucket"), "doc_id")
    by_band = rows.select("doc_id", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "doc_id")
    keyed = by_band.unionAll(by_bits)
    heads = written(keyed.groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("bucket", "lo"), "near-heads")
    members = written(keyed.join(heads, "bucket").distinct(), "near-members")
    ids = written(members.select(F.col("doc_id").alias("__id")).distinct(), "near-ids")
    sets = written(_sets(docs, ids, size), "near-sets")
    pairs = members.where("doc_id > lo").select(F.col("doc_id").alias("a"), F.col("lo").alias("b")).distinct()
    found = written(_similar(pairs, sets, similarity), "near-links")
    return settled(members.select("bucket", F.col("doc_id").alias("id")), sets.withColumnRenamed("shingles", "set"), found, similarity, simhash.components)


def groups(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, group_id) of every document in a group of two or more; group_id is its smallest doc_id."""
    roots = simhash.components(links(docs, **options))
    return roots.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without all but the smallest id of each group."""
    (i,) = unused(docs, "__id")
    dropped = written(groups(docs, **options).where("doc_id <> group_id").select(F.col("doc_id").alias(i)), "near-dropped")
    few = dropped.count() <= BROADCAST
    return docs.join(F.broadcast(dropped) if few else dropped, F.col("doc_id") == F.col(i), "left_anti")
