"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's 64-bit fingerprint takes, bit by bit, the majority of the XXH64 hashes of its word shingles.
To find all pairs within `radius` bits without comparing all, every bit position i gets a vector m(i) of
radius + 1 bits, and mask v has bit i set where <m(i), v> is odd. For any `radius` positions some v other than
zero is orthogonal to all their vectors, so a pair that differs in those positions only agrees under
that mask: each of the 2^(radius+1) - 1 tables is a join key, and together they miss no pair.

Documents alike in fingerprint are one node. A table's bucket of two nodes is compared as it is counted;
buckets of up to `listed` nodes are walked breadth first and yield a spanning forest, never all pairs;
larger ones are expanded to midpoints (every word within radius/2 free bits of a node): nodes that share
a midpoint are linked, and nodes within the radius share one, so the work is linear in the bucket. Links
become components by alternating large-star and small-star steps over written tables.

Defined cases: null, empty or blank texts have fingerprint zero and link like any other; a text of fewer words
than a shingle has its whole word sequence as one; a null doc_id belongs to its fingerprint's group but never
names it unless all ids there are null; repeated rows are each returned; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import slices, written

BITS = 64


def hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; A-Z lower-cased; a text of fewer words has its whole sequence as one."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[s:e], 42) for s, e in zip((ends - lengths).tolist(), stops, strict=False)), np.uint64, len(stops))


def majority(found: np.ndarray) -> int:
    """The word whose bits are set in over half of the hashes; zero of none."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(found), 1 << 16):
        part = found[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit majority of the shingles' hashes; repeats count."""
    return majority(hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp long) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def masks(radius: int) -> list[int]:
    """The covering masks, as signed 64-bit numbers."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(BITS)]
    found = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, size)]
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in found]


def _forest(nodes: np.ndarray, radius: int) -> tuple[list, list]:
    """Edges (larger, smaller) that span the components of nodes linked within radius bits; breadth first over what is not reached yet."""
    left, a, b = nodes, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= radius
            if near.any():
                for y in left[near].tolist():
                    a.append(max(int(x), y))
                    b.append(min(int(x), y))
                    queue.append(np.int64(y))
                left = left[~near]
    return a, b


def links(nodes: DataFrame, radius: int = 4, listed: int = 4096) -> DataFrame:
    """Links (a, b), a > b, between distinct fingerprints `fp`: enough of them that all pairs within radius are connected."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))])
    # Each node makes a row for every table, so nodes are spread over all tasks first.
    spread = nodes.select("fp").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    keyed = spread.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    buckets = written(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"), "simhash-buckets")
    twos = buckets.where((F.col("n") == 2) & (F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius)).select(F.col("hi").alias("a"), F.col("lo").alias("b"))

    def walk(frames):
        for frame in frames:
            pairs = [_forest(np.asarray(x, np.int64), radius) for x in frame["nodes"]]
            yield frame.iloc[:0].assign(a=[], b=[])[["a", "b"]] if not pairs else _frame(pairs)

    small = keyed.join(buckets.where((F.col("n") > 2) & (F.col("n") <= listed)).select("t", "key"), ["t", "key"])
    walked = small.groupBy("t", "key").agg(F.collect_list("fp").alias("nodes")).select("nodes").mapInPandas(walk, "a bigint, b bigint")
    found = twos.unionAll(walked)
    if buckets.where(F.col("n") > listed).limit(1).count():
        found = found.unionAll(_midpoints(keyed.join(buckets.where(F.col("n") > listed).select("t", "key"), ["t", "key"]), radius))
    return written(found.distinct(), "simhash-links")


def _frame(pairs: list):
    import pandas as pd

    return pd.DataFrame({"a": np.array([x for p in pairs for x in p[0]], np.int64), "b": np.array([x for p in pairs for x in p[1]], np.int64)})


def _midpoints(keyed: DataFrame, radius: int) -> DataFrame:
    """Links of oversized buckets: nodes that share a word within radius/2 free bits are within radius of each other."""
    near, odd = radius // 2, radius % 2
    rows = []
    for t, mask in enumerate(masks(radius)):
        free = [i for i in range(BITS) if not (mask >> i) & 1]
        for k in range(near + odd + 1):
            rows += [(t, _signed(sum(1 << i for i in c)), k) for c in combinations(free, k)]
    flips = F.broadcast(keyed.sparkSession.createDataFrame(rows, "t int, flip long, k int").groupBy("t").agg(F.collect_list(F.struct("flip", "k")).alias("flips")))
    spread = keyed.join(flips, "t").select("t", "fp", F.explode("flips").alias("f")).select("t", "fp", F.col("fp").bitwiseXOR(F.col("f.flip")).alias("mid"), "f.k")
    # With an odd radius one end may be a bit further off; pairs beyond the radius are then checked against the smallest near end.
    first = spread.where(F.col("k") <= near).groupBy("t", "mid").agg(F.min("fp").alias("b"))
    joined = spread.join(written(first, "simhash-midpoints"), ["t", "mid"]).where(F.col("fp") != F.col("b"))
    joined = joined.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= radius)
    return joined.select(F.greatest("fp", "b").alias("a"), F.least("fp", "b").alias("b")).distinct()


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b), a > b; root is the smallest node reachable. Large-star and small-star in turn until stars are left."""
    while rounds:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "stars-large")
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "stars-links")
        least = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "stars-small")
        stars = large.join(least, "a")
        after = stars.select("a", F.col("m").alias("b")).unionAll(stars.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges = written(after, "stars")
        rounds -= 1
        roots = edges.select(F.col("b").alias("a")).distinct()
        if not edges.groupBy("a").count().where("count > 1").limit(1).count() and not roots.join(edges, "a", "left_semi").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def groups(docs: DataFrame, shingle: int = 4, radius: int = 4, listed: int = 4096) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest doc_id reachable) of every row."""
    rows = written(fingerprints(docs, shingle), "simhash-fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(links(nodes, radius, listed))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "simhash-roots")
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(rooted.join(names, "root").select("fp", "component_id"), "simhash-names")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
