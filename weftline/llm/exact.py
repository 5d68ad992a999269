"""Exact deduplication against immutable snapshots.

A snapshot is a written table of distinct digests, dealt into shards by digest, with one static binary-fuse
filter a shard. An incoming batch first groups its own duplicates by digest; each distinct digest then meets
its shard's filter only. A negative is new for certain; positives join the snapshot's exact digests, and
groups of more than one row are compared byte by byte: their texts are regrouped by (digest, text), each
combined before the shuffle, and a digest with two texts stops the job.

Shards hold about `shard_keys` distinct digests, uniform by hash, so neither a filter nor its keys outgrow a
task; filters are 9 bits a key. Copies are combined before every shuffle; rows join their groups from written
tables, which adaptive execution can split where one digest holds a third of all rows.

Texts are equal when identical without the characters x20 and x09 to x0D. Of equal texts the row with the most
code points stays, then the smallest doc_id (a null id comes after all others).

Defined cases: null text counts as empty, and all empty or blank texts are one group; repeated rows count
towards group_size, and where several rows share keep_id and the number of code points each of those is kept;
an empty table gives an empty result; extra columns are ignored; long texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import unused, written

SPACE = " \t\n\x0b\x0c\r"
#: Ids up to which the rows to compare are found by broadcast (8 bytes each), by a shuffle beyond.
BROADCAST = 1_000_000
_SHARD = "shard int, seed long, segment int, filter binary"


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _slots(hashes: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots of each key in neighbouring segments."""
    first = ((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    base = first * np.uint64(segment)
    mask = np.uint64(segment - 1)
    return np.stack([base + (hashes & mask), base + np.uint64(segment) + ((hashes >> np.uint64(18)) & mask), base + np.uint64(2 * segment) + ((hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & mask)]).astype(np.int64)


def _prints(hashes: np.ndarray) -> np.ndarray:
    return (hashes ^ (hashes >> np.uint64(32))).astype(np.uint8)


def _shape(n: int) -> tuple[int, int]:
    """Length of a segment (a power of two) and number of segments a first slot can be in."""
    segment = 1 << min(18, max(3, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    size = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 32
    return segment, max(1, -(-size // segment) - 2)


def build_filter(keys: np.ndarray) -> tuple[int, int, bytes]:
    """(seed, segment, fingerprints) of a static binary-fuse filter over distinct 64-bit keys; peeled a layer at a time."""
    keys = np.unique(keys.astype(np.uint64))
    segment, segments = _shape(len(keys))
    size = (segments + 2) * segment
    for seed in range(1, 100):
        hashes = _mixed(keys, seed * 0x9E3779B97F4A7C15 % 2**64)
        slots = _slots(hashes, segment, segments)
        count = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(held, row, np.arange(len(keys)))
        layers, ready, done = [], np.flatnonzero(count == 1), 0
        while len(ready):
            who, at = np.unique(held[ready], return_index=True)
            layers.append((who, ready[at]))
            done += len(who)
            for row in slots[:, who]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(held, row, who)
            touched = np.unique(slots[:, who])
            ready = touched[count[touched] == 1]
        if done == len(keys):
            out, prints = np.zeros(size, np.uint8), _prints(hashes)
            for who, own in reversed(layers):
                out[own] = 0
                a, b, c = slots[:, who]
                out[own] = prints[who] ^ out[a] ^ out[b] ^ out[c]
            return seed, segment, out.tobytes()
    raise RuntimeError("no seed built the filter")


def may_hold(keys: np.ndarray, seed: int, segment: int, filter_: bytes) -> np.ndarray:
    """False where a key is certainly not in the filter."""
    table = np.frombuffer(filter_, np.uint8)
    hashes = _mixed(keys.astype(np.uint64), seed * 0x9E3779B97F4A7C15 % 2**64)
    a, b, c = _slots(hashes, segment, len(table) // segment - 2)
    return _prints(hashes) == table[a] ^ table[b] ^ table[c]


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, points, digest) of every row; points is the number of code points of the original text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    normal = F.translate(text, SPACE, "")
    return docs.select("doc_id", F.length(text).alias("points"), F.sha2(normal.cast("binary"), 256).alias("digest"))


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, n, best): a row for each digest; the least of best names the row that stays."""
    best = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("best"))


def _key(shards: int) -> list:
    key = F.xxhash64("digest")
    return [key.alias("key"), F.pmod(F.xxhash64(F.col("digest"), F.lit(1)), F.lit(shards)).cast("int").alias("shard")]


def snapshot(groups: DataFrame, shard_keys: int = 250_000) -> tuple[DataFrame, DataFrame, int]:
    """A written, immutable snapshot of distinct digests: the table, a filter for each shard, and the number of shards."""
    table = written(groups, "exact-snapshot")
    shards = max(1, -(-table.count() // shard_keys))

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        seed, segment, filter_ = build_filter(frame["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"shard": [key[0]], "seed": [seed], "segment": [segment], "filter": [filter_]})

    filters = table.select(*_key(shards)).groupBy("shard").applyInPandas(build, _SHARD)
    return table, written(filters, "exact-filters"), shards


def screen(groups: DataFrame, filters: DataFrame, shards: int, shard_keys: int = 250_000) -> DataFrame:
    """(digest, seen): whether the snapshot's filter may hold each distinct digest; each meets its own shard's filter only.

    A batch larger than the snapshot is dealt to several tasks a shard, each with a copy of the shard's filter, so that a task has about shard_keys digests whichever side is larger.
    """
    salts = max(1, -(-groups.count() // (shards * shard_keys)))

    def run(key: tuple, frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(len(frame), bool)
        for f in own.itertuples():
            seen = may_hold(frame["key"].to_numpy().view(np.uint64), f.seed, f.segment, f.filter)
        return pd.DataFrame({"digest": frame["digest"], "seen": seen})

    keyed = groups.select("digest", *_key(shards), F.pmod(F.xxhash64(F.col("digest"), F.lit(2)), F.lit(salts)).cast("int").alias("salt"))
    copies = filters.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return keyed.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(run, "digest string, seen boolean")


def merged(table: DataFrame, batch: DataFrame, seen: DataFrame) -> DataFrame:
    """Groups of snapshot and batch together; only the filter's positives join the exact table."""
    flagged = written(batch.join(seen, "digest"), "exact-screened")
    hits = flagged.where("seen").select("digest", F.col("n").alias("n2"), F.col("best").alias("best2"))
    old = table.join(hits, "digest", "left").select("digest", (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.least("best", "best2").alias("best"))
    wrong = flagged.where("seen").join(table.select("digest"), "digest", "left_anti")
    return old.unionByName(flagged.where("not seen").drop("seen")).unionByName(wrong.drop("seen"))


def _verified(docs: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """groups, after the texts behind each group of several rows have been compared byte by byte."""
    several = groups.where("n > 1").select("digest")
    (i,) = unused(docs, "__id")
    ids = written(rows.select("doc_id", "digest").join(several, "digest", "left_semi").select(F.col("doc_id").alias(i)).distinct(), "exact-positives")
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), SPACE, "")
    few = ids.count() <= BROADCAST
    texts = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col(i)), "left_semi").select(F.sha2(text.cast("binary"), 256).alias("digest"), text.alias("bytes"))
    differ = texts.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    if differ.limit(1).count():
        raise RuntimeError("two texts have one digest")
    return groups


def dedup(docs: DataFrame, in_snapshot=None, shard_keys: int = 250_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    in_snapshot (default: half of the rows by hash of the id) says which rows are the snapshot; the others are the incoming batch.
    """
    older = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0 if in_snapshot is None else in_snapshot
    rows = written(digests(docs).withColumn("older", older), "exact-digests")
    table, filters, shards = snapshot(grouped(rows.where("older")), shard_keys)
    batch = written(grouped(rows.where("not older")), "exact-batch")
    groups = written(merged(table, batch, screen(batch, filters, shards, shard_keys)), "exact-groups")
    _verified(docs, rows, groups)
    joined = rows.join(groups.select("digest", "n", "best"), "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("points") == -F.col("best.points"))
    return joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that dedup drops; of rows alike in id and text one stays."""
    i, d = unused(docs, "__id", "__digest")
    found = written(dedup(docs, **options).where("kept").select(F.col("doc_id").alias(i), F.col("text_sha256").alias(d)), "exact-kept")
    digest = F.sha2(F.translate(F.coalesce(F.col("text"), F.lit("")), SPACE, "").cast("binary"), 256)
    rows = docs.join(found.distinct(), F.col("doc_id").eqNullSafe(F.col(i)) & (digest == F.col(d)), "left_semi")
    repeated = found.groupBy(i, d).count().where("count > 1").limit(1).count()
    return rows.withColumn(d, digest).dropDuplicates(["doc_id", d]).drop(d) if repeated else rows
