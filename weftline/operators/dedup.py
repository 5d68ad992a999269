"""Near-duplicate groups by minimum hashes of character shingles, and substrings that documents share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.registry import op
from weftline.plans.tables import written

#: Rows of a bucket that are compared with each other at a time, and members of a set that weigh as much as a row.
BLOCK, HEAVY = 128, 4096


def char_shingles(c: Column, size: int = 5) -> Column:
    """Distinct runs of `size` characters; a shorter text is its own shingle."""
    at = F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substring(c, i, F.lit(size))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def char_hashes(text: str, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's runs of `size` characters, ascending; a shorter text is its own run."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = min(size, len(codes))
    found = np.full(max(1, len(codes) - n + 1), n, np.uint64)
    for i in range(n):
        found = _mix((found ^ codes[i : i + len(found)]) + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(found)


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of `rows` minimum hashes over a set of 64-bit hashes."""
    factors = np.random.Generator(np.random.PCG64(3)).integers(0, 2**64, bands * rows, dtype=np.uint64) | np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 4096):
        x = found[i : i + 4096, None] * factors[None, :]
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0))
    keys = np.zeros(bands, np.uint64)
    for r in range(rows):
        keys = (keys ^ least[r::rows]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys


def banding(threshold: float, permutations: int, recall: float = 0.999) -> tuple[int, int]:
    """(bands, rows): the most rows at which a pair at the threshold shares a band with probability `recall` or more."""
    for rows in range(permutations, 1, -1):
        if 1 - (1 - threshold**rows) ** (permutations // rows) >= recall:
            return permutations // rows, rows
    return permutations, 1


def _block(rows: pa.Table, threshold: float) -> tuple[list, list]:
    """Positions of rows (root, set) of similarity threshold or more that link different roots, as few as connect them."""
    sets = [x.values.to_numpy() for x in rows.column("set").combine_chunks()]
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    found, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, often = np.repeat(np.arange(n), sizes), counts[at] > 1
    column = (np.cumsum(counts > 1) - 1)[at[often]]
    owner, order = owner[often], np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n))
    for c in range(0, int((counts > 1).sum()), 8192):
        lo, hi = np.searchsorted(column, (c, c + 8192))
        held = np.zeros((n, 8192), np.float32)
        held[owner[lo:hi], column[lo:hi] - c] = 1
        both += held @ held.T
    _, roots = np.unique(np.array(rows.column("root").to_pylist(), object), return_inverse=True)
    x, y = np.nonzero(np.triu(both >= threshold * (sizes[:, None] + sizes[None, :] - both), 1) & (roots[:, None] != roots[None, :]))
    return _spanning(x.tolist(), y.tolist(), roots)


def signature(found: np.ndarray) -> bytes:
    """A set of 64-bit hashes as its size and a bitmap of two to four bits for each; a bitmap folds to half its length by the union of its halves."""
    bits = max(64, 1 << (2 * len(found) - 1).bit_length())
    marked = np.zeros(bits, np.uint8)
    marked[(found & np.uint64(bits - 1)).astype(np.int64)] = 1
    return len(found).to_bytes(8, "little") + np.packbits(marked, bitorder="little").tobytes()


def _at_most(n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray, both: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of n and m elements can reach the threshold, given their bitmaps' counts p and q and what these share: a bit of one alone is an element of one alone."""
    most = np.minimum(n - p + both, m - q + both)
    return (np.minimum(n, m) >= threshold * np.maximum(n, m)) & (most >= threshold * (n + m - most))


def _signature_pair(x: bytes, y: bytes, threshold: float) -> bool:
    n, m = int.from_bytes(x[:8], "little"), int.from_bytes(y[:8], "little")
    if min(n, m) < threshold * max(n, m):
        return False
    a, b = np.frombuffer(x, np.uint64, offset=8), np.frombuffer(y, np.uint64, offset=8)
    while len(a) != len(b):
        a, b = (a[: len(a) // 2] | a[len(a) // 2 :], b) if len(a) > len(b) else (a, b[: len(b) // 2] | b[len(b) // 2 :])
    count = lambda z: int(np.bitwise_count(z).sum())
    return bool(_at_most(n, m, count(a), count(b), count(a & b), threshold))


def _signature_block(rows: pa.Table, threshold: float, few: bool) -> tuple[list, list]:
    """Positions of rows (root, set: signature) of different roots that can be similar: all of them, or as few as would connect their roots."""
    held = [x.as_py() for x in rows.column("set")]
    size = np.array([int.from_bytes(x[:8], "little") for x in held], np.int64)
    maps = [np.frombuffer(x, np.uint8, offset=8) for x in held]
    _, roots = np.unique(np.array(rows.column("root").to_pylist(), object), return_inverse=True)
    a, b = [], []
    widths = np.array([len(x) for x in maps])
    for width in np.unique(widths):
        # The other one's bitmap may be longer; sizes that fit the threshold tell how much longer at most.
        at = np.flatnonzero((widths >= width) & (size * threshold <= size[widths == width].max()))
        folded = np.stack([np.bitwise_or.reduce(maps[i].reshape(-1, width), axis=0) for i in at])
        both, ones = np.zeros((len(at), len(at))), np.zeros(len(at))
        for c in range(0, width, 1024):
            part = np.unpackbits(folded[:, c : c + 1024], axis=1).astype(np.float32)
            both += part @ part.T
            ones += part.sum(axis=1)
        n, own = size[at], widths[at] == width
        can = _at_most(n[:, None], n[None, :], ones[:, None], ones[None, :], both, threshold)
        x, y = np.nonzero(np.triu(can & (own[:, None] | own[None, :]) & (roots[at][:, None] != roots[at][None, :]), 1))
        a += at[x].tolist()
        b += at[y].tolist()
    return _spanning(a, b, roots) if few else (a, b)


def _spanning(x: list, y: list, roots: np.ndarray) -> tuple[list, list]:
    """Of the pairs those that join roots that are apart still."""
    a, b = [], []
    for i, j in zip(x, y, strict=True):
        if roots[i] != roots[j]:
            a.append(i)
            b.append(j)
            roots[roots == roots[i]] = roots[j]
    return a, b


def settled(
    members: DataFrame, sets: DataFrame, links: DataFrame, threshold: float, components: Callable[[DataFrame], DataFrame], block: Callable[[pa.Table, float], tuple[list, list]] | None = None, checked: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """`links` (a, b), a > b, and enough more that all pairs of similarity threshold or more that share a bucket are connected.

    members (bucket, id), sets (id, set of bigint). Pairs that the links connect already are left out; all others
    that share a bucket are compared exactly, a bucket in salted blocks of bounded size (rows with large sets weigh more): rows of a component that fills half a block
    lie in blocks of their own, which never meet each other, the rest of a bucket is dealt by a hash. `block` compares other forms of
    sets (binary ones weigh by their bits); pairs that it gives are links once `checked` has let them through.
    """
    block = block or _block
    binary = sets.schema["set"].dataType.simpleString() == "binary"
    roots = components(links)
    labelled = written(members.join(roots, members["id"] == roots["node"], "left").select("bucket", "id", F.coalesce("root", "id").alias("root")), "labelled")
    # Buckets of the same rows are compared once; one of two rows is settled by the comparison with its smallest id.
    name = lambda seed: F.bit_xor(F.xxhash64("id", F.lit(seed)))
    seen = labelled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), name(1).alias("x"), name(2).alias("y"))
    mixed = seen.where("lo < hi and n > 2").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    weights = sets.select("id", F.ceil((F.octet_length("set") * 4 if binary else F.size("set")) / HEAVY).alias("weight"))
    rest = written(labelled.join(written(mixed, "mixed"), "bucket", "left_semi").join(weights, "id"), "mixed-rows")
    if not rest.limit(1).count():
        return links
    parts = rest.groupBy("bucket", "root").agg(F.sum("weight").alias("n")).withColumn("part", F.when(F.col("n") >= BLOCK // 2, F.col("root")))
    parts = written(parts, "parts")
    counts = written(parts.groupBy("bucket", "part").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("pieces")), "pieces")
    unit = lambda salt: F.xxhash64("bucket", F.coalesce(F.col("part").cast("string"), F.lit("")), F.col("part").isNull(), salt)
    named = parts.join(counts, (parts["bucket"] == counts["bucket"]) & parts["part"].eqNullSafe(counts["part"])).select(parts["bucket"], "root", parts["part"], "pieces")
    placed = rest.join(named, ["bucket", "root"]).select("id", "root", unit(F.pmod(F.xxhash64("id", F.lit(3)), F.col("pieces")).cast("int")).alias("unit"))
    placed = written(placed, "placed")
    units = written(counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("bucket", "part", unit(F.col("salt")).alias("unit")), "units")
    other = units.select("bucket", F.col("part").alias("part_b"), F.col("unit").alias("unit_b"))
    meet = units.join(other, "bucket").where("unit <= unit_b and (part is null or part_b is null or part <> part_b)").where("unit <> unit_b or part is null")
    jobs = written(meet.select(F.xxhash64("unit", "unit_b").alias("job"), F.explode(F.array_distinct(F.array("unit", "unit_b"))).alias("unit")), "jobs")
    kind = members.schema["id"].dataType.simpleString()

    def compare(rows: pa.Table) -> pa.Table:
        a, b = block(rows, threshold)
        return pa.table({"a": rows.column("id").take(pa.array(a, pa.int64())), "b": rows.column("id").take(pa.array(b, pa.int64()))})

    shipped = jobs.join(placed, "unit").select("job", "id", "root").join(sets, "id").select("job", "id", "root", "set")
    more = shipped.groupBy("job").applyInArrow(compare, f"a {kind}, b {kind}")
    more = written(more.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "more-links")
    return links.unionAll(checked(more) if checked else more)


def _char_sketches(df: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(id, set, keys) of every row (id, text): the signature of its runs of characters, and its bands' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                sets = [char_hashes(t.as_py(), size) for t in part.column("text")]
                keys = [band_keys(x, bands, rows).view(np.int64) for x in sets]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([signature(x) for x in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "set", "keys"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, set binary, keys array<bigint>")


def _char_similar(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts' runs of characters have a similarity of threshold or more; texts travel, their sets are made where they are compared."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, second = None, np.zeros(0, np.uint64)
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                first, y = char_hashes(x.as_py(), size), y.as_py()
                if y != last:
                    last, second = y, char_hashes(y, size)
                both = len(np.intersect1d(first, second, assume_unique=True))
                kept.append(both >= threshold * (len(first) + len(second) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return written(joined.select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}").distinct(), "links")


def _possible(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that their signatures do not rule out."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_signature_pair(x.as_py(), y.as_py(), threshold) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return written(joined.select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}").distinct(), "possible")


@op("minhash_groups")
def minhash_groups(df: DataFrame, id_key: str, text: str = "text", size: int = 5, threshold: float = 0.5, permutations: int = 128, bands: int | None = None) -> DataFrame:
    """(id, group) of every row: documents linked by a Jaccard similarity of at least threshold in runs of `size` characters; the group is its smallest id.

    Equal texts are linked by their digests, and the smallest id stands for them. Candidates share a band of minima (by default as many rows to a band
    as keep a pair at the threshold with 99.9 %). Each is compared with the smallest id of its bucket first; what that leaves unconnected in a bucket is
    compared pair by pair. Bitmaps of the sets rule pairs out, texts decide on the others: sets, many times their texts' size, are neither written nor sent.
    Links settle by min-label steps over written tables. A null text or id is in no group but its own; empty texts are alike; rows alike in id are one document.
    """
    count, per = (bands, permutations // bands) if bands else banding(threshold, permutations)
    named = df.where(F.col(text).isNotNull() & F.col(id_key).isNotNull()).select(F.col(id_key).alias("id"), F.col(text).cast("string").alias("text"))
    digests = written(named.select("id", F.unhex(F.sha2("text", 256)).alias("digest")).distinct(), "digests")
    first = digests.groupBy("digest").agg(F.min("id").alias("lo"))
    copies = written(digests.join(first, "digest").select("id", "lo", "digest"), "copies")
    alone = copies.where("id = lo").select("id", "digest")
    texts = named.withColumn("digest", F.unhex(F.sha2("text", 256))).join(alone, ["id", "digest"], "left_semi").select("id", "text")
    rows = written(_char_sketches(texts, size, count, per), "sketches")
    keyed = rows.select("id", F.posexplode("keys").alias("band", "key")).select("id", F.xxhash64("band", "key").alias("bucket"))
    heads = written(keyed.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("bucket", "lo"), "heads")
    members = written(keyed.join(heads, "bucket").distinct(), "members")
    sets = written(rows.select("id", "set").join(members.select("id").distinct(), "id", "left_semi"), "sets")
    pairs = members.where("id > lo").select(F.col("id").alias("a"), F.col("lo").alias("b")).distinct()
    similar = lambda found: _char_similar(found, texts, size, threshold)
    links = similar(_possible(pairs, sets, threshold))
    # First as few pairs as would connect a block's rows if all were similar, then whatever is unconnected still.
    for few in (True, False):
        links = settled(members.select("bucket", "id"), sets, links, threshold, connected, lambda x, t, few=few: _signature_block(x, t, few), similar)
    labels = connected(links.unionAll(copies.where("id > lo").select(F.col("id").alias("a"), F.col("lo").alias("b"))))
    ids = df.select(F.col(id_key).alias("id"))
    return ids.join(labels, ids["id"] == labels["node"], "left").select(F.col("id").alias(id_key), F.coalesce("root", "id").alias("group"))


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of links (a, b): the smallest node reachable, by neighbours' minima and pointer jumps until nothing changes."""
    both = written(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        hop = labels.select(F.col("node").alias("root"), F.col("root").alias("hop"))
        step = labels.join(near, labels["node"] == near["a"]).join(hop, "root", "left").select("node", F.col("root").alias("old"), F.least("root", "near", F.coalesce("hop", "root")).alias("root"))
        step = written(step, "labels")
        labels = step.select("node", "root")
        if not step.where("old <> root").limit(1).count():
            return labels


@op("shared_substrings")
def shared_substrings(df: DataFrame, id_key: str, text: str = "text", k: int = 20, min_docs: int = 2) -> DataFrame:
    """(substring, n_docs) of runs of k characters that at least min_docs documents hold; no run crosses documents."""
    runs = df.where(F.length(text) >= k).select(id_key, F.explode(char_shingles(F.col(text), k)).alias("substring"))
    return runs.groupBy("substring").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)


@op("decontaminate")
def decontaminate(df: DataFrame, reference: DataFrame, tokens: str, reference_tokens: str, n: int = 13) -> DataFrame:
    """df with `overlap`: whether it shares a run of n tokens with the reference. The reference's runs are distinct before the join."""
    from weftline.operators.ngrams import contiguous

    runs = reference.select(F.explode(contiguous(F.col(reference_tokens), n, n)).alias("run")).distinct()
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    hit = rows.select("__row", F.explode(contiguous(F.col(tokens), n, n)).alias("run")).join(runs, "run", "left_semi").select("__row").distinct()
    return rows.join(hit.withColumn("overlap", F.lit(True)), "__row", "left").withColumn("overlap", F.coalesce("overlap", F.lit(False))).drop("__row")
