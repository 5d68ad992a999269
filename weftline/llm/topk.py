"""Exact top-k inner-product search by multi-resolution segment statistics.

Vectors are cut into segments at two resolutions. With a segment's mean and deviation, the squared distance of
two vectors is at least sum(L * (mean difference)^2 + (deviation difference)^2), so the inner product is
at most (|q|^2 + |x|^2 - that) / 2. Coarse bounds rule out most candidates, finer ones more, and exact integer
products are computed for survivors only. Bounds carry a margin for rounding; results are exact.

Queries are packed into blocks of `query_block` and candidates into blocks of `block`. While the queries' vectors
are few (counted: BROADCAST bytes) they are broadcast and candidates are searched where they are read, so no vector is
shuffled. Beyond that every candidate block meets every query block by an equi-join on (query block, salt). Either way the number of
tasks follows the data, a task keeps `k` rows a query at most and no pair of rows is shuffled.

Defined cases: vectors that are null or hold a null or non-finite component (before or after scaling), and rows without an id, take no part; products beyond 64 bits count as the largest;
missing components of shorter vectors count as zero; a candidate with the query's own id is its own row; queries
repeated as rows count once, repeated candidates each; fewer than k candidates give fewer rows; ties go to
the smaller id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import written

SEGMENTS = (4, 16)
#: Bytes of queries that are broadcast at most.
BROADCAST = 64 << 20
_BLOCK = "n int, dim int, ids binary, values binary"


def scaled(values: np.ndarray) -> np.ndarray:
    return np.floor(1024.0 * values.astype(np.float64))


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Usable vectors of batches (vec_id, embedding) as rows (n, dim, ids, values) of at most `size` vectors each."""
    ids: list[int] = []
    vectors: list[np.ndarray] = []

    def block() -> pa.RecordBatch:
        dim = max(map(len, vectors))
        table = np.zeros((len(vectors), dim))
        for i, v in enumerate(vectors):
            table[i, : len(v)] = v
        out = pa.RecordBatch.from_pydict({"n": pa.array([len(ids)], pa.int32()), "dim": pa.array([dim], pa.int32()), "ids": [np.array(ids, np.int64).tobytes()], "values": [table.tobytes()]})
        ids.clear()
        vectors.clear()
        return out

    for batch in batches:
        column = batch.column("embedding")
        for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
            item = column[i]
            if vec_id is None or not item.is_valid or item.values.null_count:
                continue
            v = scaled(item.values.to_numpy(zero_copy_only=False))
            if np.isfinite(v).all():
                ids.append(vec_id)
                vectors.append(v)
                if len(ids) >= size:
                    yield block()
    if ids:
        yield block()


def _usable(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").cast("long"), "embedding")


def packed(rows: DataFrame, size: int) -> DataFrame:
    """(n, dim, ids, values): rows (vec_id, embedding) in blocks of at most `size`; only usable vectors."""
    return _usable(rows).mapInArrow(lambda batches: blocks(batches, size), _BLOCK)


class Level:
    """Vectors' segment means and deviations, scaled so that a product of two rows bounds the inner product."""

    def __init__(self, x: np.ndarray, segments: int):
        dim = x.shape[1]
        length = max(1, -(-dim // segments))
        pad = np.zeros((len(x), length * -(-dim // length) if dim else length))
        pad[:, :dim] = x
        cut = pad.reshape(len(x), -1, length)
        mean = cut.mean(axis=2)
        dev = np.sqrt(((cut - mean[:, :, None]) ** 2).sum(axis=2))
        self.rows = np.concatenate([np.sqrt(length) * mean, dev], axis=1)


def bound(q: Level, x: Level, scale: float) -> np.ndarray:
    """(|q|^2 + |x|^2 - lower bound of the squared distance) / 2, with a margin; the norms cancel against the bound's squares."""
    return q.rows @ x.rows.T + scale


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    if np.abs(x).max(initial=0.0) * np.abs(q).max(initial=0.0) * max(1, x.shape[1]) < 2.0**53:
        return (x @ q).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in x]
    return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in whole], np.int64)


class Best:
    """The k best (score, id) so far of each query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        dim = max(self.q.shape[1], x.shape[1])
        q, x = (np.pad(a, ((0, 0), (0, dim - a.shape[1]))) for a in (self.q, x))
        scale = 1e-9 * (np.linalg.norm(q, axis=1).max(initial=0) * np.linalg.norm(x, axis=1).max(initial=0)) + 1e-3
        (cq, fq), (cx, fx) = ([Level(a, s) for s in SEGMENTS] for a in (q, x))
        coarse = bound(cq, cx, scale)
        for i in range(len(q)):
            others = ids != self.ids[i]
            likely = np.argpartition(-coarse[i], min(2 * self.k, len(x) - 1))[: 2 * self.k]
            likely = likely[others[likely]]
            self._merge(i, ids[likely], _exact(x[likely], q[i]))
            left = others & (coarse[i] >= self._least(i))
            left[likely] = False
            left = np.flatnonzero(left)
            if len(left):
                left = left[fx.rows[left] @ fq.rows[i] + scale >= self._least(i)]
            if len(left):
                self._merge(i, ids[left], _exact(x[left], q[i]))

    def _least(self, i: int) -> float:
        scores = self.found[i][0]
        return float(scores[-1]) if len(scores) >= self.k else -np.inf

    def _merge(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        s, v = np.concatenate([self.found[i][0], scores]), np.concatenate([self.found[i][1], ids])
        order = np.lexsort((v, ~s))[: self.k]
        self.found[i] = (s[order], v[order])

    def batch(self) -> pa.RecordBatch:
        sizes = [len(s) for s, _ in self.found]
        return pa.RecordBatch.from_pydict({
            "query_id": np.repeat(self.ids, sizes),
            "vec_id": np.concatenate([v for _, v in self.found] or [np.zeros(0, np.int64)]),
            "score": np.concatenate([s for s, _ in self.found] or [np.zeros(0, np.int64)]),
        })


def search(vectors: DataFrame, is_query: Column, k: int = 10, block: int = 4096, query_block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query row against every other row."""
    spark = vectors.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = vectors.where(is_query).select("vec_id", "embedding").distinct()
    queries = written(packed(chosen.repartition(max(1, -(-chosen.count() // query_block))), query_block).withColumn("row", F.monotonically_increasing_id()), "topk-queries")
    n_blocks = queries.count()
    if not n_blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    def read(b: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b["ids"], np.int64), np.frombuffer(b["values"], np.float64).reshape(b["n"], b["dim"])

    schema = "query_id long, vec_id long, score long"
    size = queries.agg(F.sum(F.octet_length("values") + F.octet_length("ids")).alias("n")).first()["n"]
    if size <= BROADCAST:
        shipped = spark.sparkContext.broadcast([r.asDict() for r in queries.select("n", "dim", "ids", "values").collect()])

        def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [Best(*read(b), k) for b in shipped.value]
            for packed_ in blocks(batches, block):
                x = read(packed_.to_pylist()[0])
                for own in best:
                    own.add(*x)
            for own in best:
                yield own.batch()

        found = _usable(vectors).mapInArrow(sweep, schema)
    else:
        spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        numbered = queries.select("row", (F.row_number().over(Window.orderBy("row")) - 1).alias("qb"))
        asked = queries.join(numbered, "row").select("qb", spread.alias("salt"), F.struct("n", "dim", "ids", "values").alias("q"))
        dealt = packed(vectors, block).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
        met = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("qb"), "salt", F.struct("n", "dim", "ids", "values").alias("x")).join(asked, ["qb", "salt"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, best = None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    key = batch.column("qb")[i].as_py()
                    if key != at:
                        if best:
                            yield best.batch()
                        at, best = key, Best(*read(batch.column("q")[i].as_py()), k)
                    best.add(*read(batch.column("x")[i].as_py()))
            if best:
                yield best.batch()

        found = met.select("qb", "q", "x").sortWithinPartitions("qb").mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
