"""Substring deduplication by level-wise doubling.

Levels are lengths that grow to the full window, each at most twice the one before (13, 25 and 50 words for windows
of 50). At each level every full window that is still alive is stood for by its least sub-window of that length
(by hash), which two documents that share the full window share too. Those found in one document only rule out
every window they stand for; those that repeat are extended to the next length, and at the full length the
window's own hash decides. `longest` goes on doubling from the survivors until no candidate is left.

A word's hash is the XXH3 of its bytes; a window's is made by doubling, of the hashes of its halves, so neither words
nor their order can be built to collide as sums of powers can. Full windows are compared by two such hashes of
independent seeds, 128 bits; whole documents by SHA-256 of their words.

A word is removed where a window of `window` words that also starts in a document with a smaller doc_id covers
it. Documents with the same word sequence are settled whole first. Minima per window
are combined before the shuffle and joined back from a written table, so a passage in a third of all
documents gathers in no task. Texts travel only to documents that hold candidates: by broadcast of the
candidates' keys while they are counted and small, by a shuffle join beyond.

Defined cases: null, empty and blank texts have no words; a null doc_id loses nothing and costs no other document
anything; rows alike in doc_id do not remove each other's words (`clean` asks for ids of one row each); extra columns are ignored; very long texts
are judged whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import slices, unused, written

#: Numbers in all lists of keys up to which the keys of candidates are broadcast (8 bytes each).
BROADCAST = 4_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the two 64-bit hashes of each of its words (rows of an array of two columns); a batch's distinct words are hashed once."""
    chunks = pc.ascii_split_whitespace(pc.cast(pc.fill_null(texts, ""), pa.large_string()))
    flat = chunks.flatten().dictionary_encode()
    digest = xxhash.xxh3_128_digest
    table = np.frombuffer(b"".join(digest(w.encode()) for w in flat.dictionary.to_pylist()), np.uint64).reshape(-1, 2)
    codes = np.asarray(flat.indices).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    blank = np.asarray(pc.equal(flat.dictionary, "")) if len(flat) else np.zeros(0, bool)  # before and after outer white space
    sizes = np.asarray(pc.list_value_length(chunks)).astype(np.int64)
    ends = np.cumsum(sizes)
    for start, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        own = codes[start:end]
        yield table[own[~blank[own]]]


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    return _mix((_mix(x + _STEP) ^ y) * _STEP + x)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` words, from those of its halves."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    if length == 1:
        return _mix(hashes)
    half = length - length // 2
    part = windows(hashes, half)
    return _pair(part[: len(hashes) - length + 1], part[length - half :])  # the halves of an odd length share a word


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    done, out = 1, x
    while 2 * done <= width:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    n = len(x) - width + 1
    return np.minimum(out[:n], out[width - done : width - done + n])


def levels(window: int, start: int = 13) -> list[int]:
    """Lengths up to the window, two at least, each at most twice the one before; the first is `start` or less."""
    found = [-(-window // 2), window]
    while found[0] > start:
        found.insert(0, -(-found[0] // 2))
    return found


def minima(hashes: np.ndarray, window: int, length: int) -> np.ndarray:
    """For each full window, the least hash among its sub-windows of a length."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64)
    return _sliding_min(windows(hashes, length), window - length + 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _profile(docs: DataFrame, window: int, length: int) -> DataFrame:
    """doc_id, n_words, seq1, seq2 (128 bits of sha), sha (of all words joined), mins (distinct least sub-windows)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = {k: [] for k in ("n_words", "seq1", "seq2", "sha", "mins")}
            for text, words in zip(batch.column("text"), hashed(batch.column("text")), strict=True):
                one, two, sha = _sequence(text.as_py())
                rows["n_words"].append(len(words))
                rows["seq1"].append(one)
                rows["seq2"].append(two)
                rows["sha"].append(sha)
                rows["mins"].append(np.unique(minima(words[:, 0], window, length)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows["n_words"], pa.int64()), pa.array(rows["seq1"], pa.int64()), pa.array(rows["seq2"], pa.int64()), pa.array(rows["sha"]), pa.array(rows["mins"], pa.list_(pa.int64()))], names=["doc_id", *rows])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, seq1 bigint, seq2 bigint, sha string, mins array<bigint>")


def _sequence(text: str | None) -> tuple[int, int, str]:
    """The SHA-256 of a text's words joined by spaces: its first 128 bits as two numbers, and all of it as text."""
    found = hashlib.sha256(b" ".join((text or "").encode().split()))
    one, two = np.frombuffer(found.digest()[:16], np.int64)
    return int(one), int(two), found.hexdigest()


def _joined(docs: DataFrame, keys: DataFrame, numbers: int) -> DataFrame:
    """docs with the columns of keys (_id, ...): by broadcast if keys holds at most BROADCAST numbers, else by a shuffle."""
    return docs.select("doc_id", "text").join(F.broadcast(keys) if numbers <= BROADCAST else keys, F.col("doc_id") == F.col("_id"))


def _extended(docs: DataFrame, survivors: DataFrame, numbers: int, window: int, length: int, after: int) -> DataFrame:
    """(m, doc_id): the least sub-windows of length `after` of each full window whose least one of `length` survived; distinct within a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, counts = [], []
            for words, alive in zip(hashed(batch.column("text")), batch.column("alive"), strict=True):
                at = np.isin(minima(words[:, 0], window, length), alive.values.to_numpy().view(np.uint64))
                found.append(np.unique(minima(words[:, 0], window, after)[at]))
                counts.append(len(found[-1]))
            ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(batch.num_rows), counts)))
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(found)), ids], names=["m", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _joined(docs.where("text is not null"), survivors, numbers).select("doc_id", "text", "alive").mapInArrow(run, f"m bigint, doc_id {kind}")


def _full(docs: DataFrame, survivors: DataFrame, numbers: int, window: int, length: int) -> DataFrame:
    """(h1, h2, doc_id, seq1, pos) of each full window whose least sub-window of `length` survived."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            for i, words in enumerate(hashed(batch.column("text"))):
                alive = batch.column("alive")[i].values.to_numpy().view(np.uint64)
                at = np.flatnonzero(np.isin(minima(words[:, 0], window, length), alive))
                if len(at):
                    n, seq = len(at), _sequence(batch.column("text")[i].as_py())[0]
                    yield pa.RecordBatch.from_arrays([
                        _signed(windows(words[:, 0], window)[at]), _signed(windows(words[:, 1], window)[at]),
                        pa.array([batch.column("doc_id")[i].as_py()] * n, batch.column("doc_id").type), pa.array([seq] * n, pa.int64()), pa.array(at, pa.int32()),
                    ], names=["h1", "h2", "doc_id", "seq1", "pos"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _joined(docs.where("text is not null"), survivors, numbers).select("doc_id", "text", "alive").mapInArrow(run, f"h1 bigint, h2 bigint, doc_id {kind}, seq1 bigint, pos int")


def _survivors(keys: DataFrame) -> tuple[DataFrame, int]:
    """(_id, alive): of keys (m, doc_id) those that two documents share, listed by document; and how many numbers that is."""
    shared = written(keys.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("m"), "substring-shared")
    found = written(keys.join(shared, "m").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("m").alias("alive")), "substring-survivors")
    return found, _size(found, "alive")


def _size(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(F.size(column) + 1).alias("n")).first()["n"] or 0


def _windows(docs: DataFrame, keys: DataFrame, window: int, lengths: list[int]) -> DataFrame:
    """(h1, h2, doc_id, seq1, pos) of the full windows that survive all shorter levels; keys (m, doc_id) are the first level's, of the documents to judge."""
    survivors, numbers = _survivors(keys)
    for length, after in zip(lengths, lengths[1:-1], strict=False):
        survivors, numbers = _survivors(written(_extended(docs, survivors, numbers, window, length, after), "substring-level"))
    return written(_full(docs, survivors, numbers, window, lengths[-2]), "substring-windows")


def _firsts(found: DataFrame) -> DataFrame:
    """(h1, h2, lo) of the windows that two documents share; lo is the smallest of them."""
    return written(found.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2", "lo"), "substring-firsts")


def repeated(docs: DataFrame, keys: DataFrame, window: int, lengths: list[int]) -> DataFrame:
    """(doc_id, seq1, runs): runs are starts and ends, in words, of what windows of smaller documents cover."""
    found = _windows(docs, keys, window, lengths)
    later = found.join(_firsts(found), ["h1", "h2"]).where("doc_id > lo").groupBy("doc_id", "seq1").agg(F.collect_list("pos").alias("at"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for at in batch.column("at"):
                at = np.sort(at.values.to_numpy())
                cut = np.flatnonzero(np.diff(at) > window)
                runs.append(np.stack([at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + window], axis=1).ravel().astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("seq1"), pa.array(runs, pa.list_(pa.int64()))], names=["doc_id", "seq1", "runs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(later.mapInArrow(cover, f"doc_id {kind}, seq1 bigint, runs array<bigint>"), "substring-runs")


def _cut(docs: DataFrame, runs: DataFrame, texts: bool) -> DataFrame:
    """(doc_id, seq1, n_removed, sha or kept text) of documents that lose words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            out: list[list] = [[], [], [], []]
            for i in range(batch.num_rows):
                data = batch.column("text")[i].as_py().encode()
                one = _sequence(batch.column("text")[i].as_py())[0]
                if one != batch.column("seq1")[i].as_py():
                    continue
                cut = batch.column("runs")[i].values.to_numpy()
                all_words = data.split()
                keep = np.ones(len(all_words) + 1, bool)
                for a, b in zip(cut[0::2], cut[1::2], strict=True):
                    keep[a:b] = False
                kept = b" ".join(w for w, k in zip(all_words, keep, strict=False) if k)
                for column, v in zip(out, (batch.column("doc_id")[i].as_py(), one, int(len(all_words) - keep[:-1].sum()), kept.decode() if texts else hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column("doc_id").type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["doc_id", "seq1", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = _joined(docs.where("text is not null"), runs.withColumnRenamed("doc_id", "_id"), _size(runs, "runs"))
    return joined.select("doc_id", "text", "seq1", "runs").mapInArrow(run, f"doc_id {kind}, seq1 bigint, n_removed bigint, kept string")


def _settled(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Every row's profile with `gone` (an earlier document has the same sequence, long enough), and the runs of the others."""
    lengths = levels(window)
    rows = written(_profile(docs, window, lengths[0]), "substring-profile")
    long = rows.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    alike = written(long.groupBy("seq1", "seq2", "n_words").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi"), "substring-alike")
    marked = rows.join(alike, ["seq1", "seq2", "n_words"], "left")
    gone = F.coalesce(F.col("doc_id") > F.col("lo"), F.lit(False))
    marked = written(marked.withColumn("gone", gone).drop("lo"), "substring-marked")
    heads = marked.where(~F.col("gone") & (F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    # Rows that are gone are shut out by their id; where an id stands on several rows, seq1 tells them apart later.
    return marked.drop("mins"), repeated(docs, heads.select(F.explode("mins").alias("m"), "doc_id"), window, lengths)


def dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows, runs = _settled(docs, window)
    cut = _cut(docs, runs, texts=False).dropDuplicates(["doc_id", "seq1"])
    found = rows.join(written(cut, "substring-cut"), ["doc_id", "seq1"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    removed = F.when(F.col("gone"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    sha = F.when(F.col("gone"), F.lit(empty)).otherwise(F.coalesce("kept", "sha"))
    return found.select("doc_id", "n_words", removed.alias("n_removed"), sha.alias("kept_sha256"))


def clean(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs with repeated words taken out of text; texts that lose nothing stay as they are."""
    i, k = unused(docs, "__id", "__kept")
    rows, runs = _settled(docs, window)
    cut = _cut(docs, runs, texts=True).dropDuplicates(["doc_id", "seq1"]).select(F.col("doc_id").alias(i), F.col("kept").alias(k))
    gone = rows.where("gone").select(F.col("doc_id").alias(i), F.lit("").alias(k)).distinct()
    joined = docs.join(written(cut.unionAll(gone), "substring-kept"), F.col("doc_id") == F.col(i), "left")
    return joined.select(*[F.coalesce(k, "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def _doubled(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """(h1, h2, doc_id, seq1, pos) of each window of twice the length both of whose halves are among places (doc_id, pos)."""
    lists = written(places.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("pos").alias("alive")), "substring-survivors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            for i, words in enumerate(hashed(batch.column("text"))):
                at = np.sort(batch.column("alive")[i].values.to_numpy())
                at = at[np.isin(at + length, at) & (at <= len(words) - 2 * length)]
                if len(at):
                    n, seq = len(at), _sequence(batch.column("text")[i].as_py())[0]
                    yield pa.RecordBatch.from_arrays([
                        _signed(windows(words[:, 0], 2 * length)[at]), _signed(windows(words[:, 1], 2 * length)[at]),
                        pa.array([batch.column("doc_id")[i].as_py()] * n, batch.column("doc_id").type), pa.array([seq] * n, pa.int64()), pa.array(at, pa.int32()),
                    ], names=["h1", "h2", "doc_id", "seq1", "pos"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _joined(docs.where("text is not null"), lists, _size(lists, "alive")).select("doc_id", "text", "alive").mapInArrow(run, f"h1 bigint, h2 bigint, doc_id {kind}, seq1 bigint, pos int")


def longest(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, repeated): the largest of window, 2 * window, 4 * window, ... at which a window of the document starts in a smaller document too.

    A length is tried only where both halves survived the one before, until nothing is left.
    """
    lengths = levels(window)
    rows = written(_profile(docs, window, lengths[0]), "substring-profile")
    keys = rows.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull()).select(F.explode("mins").alias("m"), "doc_id")
    found, length, out = _windows(docs, keys, window, lengths), window, None
    while True:
        places = written(found.join(_firsts(found), ["h1", "h2"]).select("doc_id", "pos", (F.col("doc_id") > F.col("lo")).alias("later")), "substring-places")
        level = places.where("later").select("doc_id").distinct().withColumn("repeated", F.lit(length).cast("long"))
        out = level if out is None else out.unionAll(level)
        if not places.limit(1).count():
            return out.groupBy("doc_id").agg(F.max("repeated").alias("repeated"))
        found = written(_doubled(docs, places, length), "substring-windows")
        length *= 2
