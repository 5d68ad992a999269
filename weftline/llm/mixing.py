"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Each source's weight over training time (0 to 1) is a dealt weight times a schedule (piecewise linear). Its integral is the
source's weight in the mixture; its cumulative demand, inverted, turns a document's place in its source into a training
position; documents are then range-sorted by position.

Targets: weights are dealt to sources in code-point order (null last), share `share` times all words, stop at
`cap` times the source's own words, and what is cut off is reshared by weight until no target is above
its stop. Of a source's target, whole passes over the source come first; the rest is taken in hash order,
and the one document at the edge is taken in part, so a source's taken words equal its rounded target.

A hot source is never gathered: documents are dealt to about sqrt(rows)/2 hash buckets of each source,
bucket sums give offsets, and running sums stay within a bucket. Only scalars reach the driver.

Defined cases: null text has size 0; a null source is a source of its own; a document of size 0 takes 0 words;
an empty table gives an empty result; repeated rows each count, and rows alike in id, source and size share
one running sum's order but are all kept; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import WORD, unused, written

#: Weight over time of the sources dealt each weight: the common ones early, the rare ones late. Each has integral 1.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
_HEX = 2.0**32


def ranked(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with `rank`, from 0, by key with null last; key is unique. Range-partitioned: no task holds all rows."""
    spread = written(df.repartitionByRange(F.col(key).asc_nulls_last()).withColumn("part", F.spark_partition_id()), name)
    sizes = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col(key).asc_nulls_last())) - 1
    return spread.withColumn("place", place).join(before, "part").withColumn("rank", F.col("place") + F.col("before")).drop("part", "place", "before")


def integral(knots: tuple) -> float:
    """A schedule's integral over training time."""
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))


def targets(sources: DataFrame, weights: tuple, share: float, cap: float, schedules: tuple = SCHEDULES) -> DataFrame:
    """sources (skey, source, source_size) with weight (the dealt weight times its schedule's integral), class and target double."""
    n = len(weights)
    weights = [float(w) * integral(schedules[k % len(schedules)]) for k, w in enumerate(weights)]
    kind = (F.col("rank") % n).cast("int")
    table = ranked(sources, "source", "mix-ranks").withColumn("kind", kind)
    table = written(table.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("kind") + 1)).withColumn("stop", F.lit(float(cap)) * F.col("source_size")), "mix-sources")
    total = table.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level, budget = 0.0, float(share) * total
    while True:
        full = F.col("stop") <= F.lit(level) * F.col("weight")
        row = table.agg(F.sum(F.when(full, F.col("stop")).otherwise(0.0)).alias("cut"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        after = (budget - (row["cut"] or 0.0)) / row["w"] if row["w"] else math.inf
        if not row["w"] or after <= level:
            break
        level = after
    if level == math.inf or not row["w"]:
        return table.withColumn("target", F.col("stop"))
    return table.withColumn("target", F.least(F.col("stop"), F.lit(level) * F.col("weight")))


def _inverse(knots: tuple, share: Column) -> Column:
    """The time at which a piecewise linear schedule has given out `share` of its integral."""
    areas = [integral((a, b)) for a, b in zip(knots, knots[1:], strict=False)]
    whole, done, out = sum(areas), 0.0, None
    for (a, b), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        rest = share * F.lit(whole) - F.lit(done)
        slope = (b[1] - a[1]) / (b[0] - a[0])
        time = F.lit(float(a[0])) + F.lit(2.0) * rest / (F.lit(float(a[1])) + F.sqrt(F.greatest(F.lit(float(a[1] ** 2)) + F.lit(2.0 * slope) * rest, F.lit(0.0))))
        done += area
        out = F.when(share * F.lit(whole) <= F.lit(done), time) if out is None else out.when(share * F.lit(whole) <= F.lit(done), time)
    return out.otherwise(F.lit(float(knots[-1][0])))


def plan(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0, schedules: tuple = SCHEDULES) -> DataFrame:
    """Every document's size, source_size, target, taken, whole passes `base`, its place and its training position; not sorted."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    code = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = written(docs.select("doc_id", "source", key.alias("skey"), size.alias("size"), code.alias("code")), "mix-sizes")
    n = rows.count()
    sources = written(rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), "mix-source-sizes")
    table = written(targets(sources, weights, share, cap, schedules).select("skey", "source_size", "target", "kind"), "mix-targets")

    parts = max(1, math.ceil(math.sqrt(n) / 2))
    bucket = F.floor(F.conv(F.substring("code", 1, 8), 16, 10).cast("double") * F.lit(parts / _HEX)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("skey", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("skey", "bucket").orderBy("code", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["skey", "bucket"]).join(table, "skey")

    at = F.col("offset") + F.col("inside")
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    placed = placed.withColumn("at", at).withColumn("base", base)
    rest = F.round("target").cast("long") - F.col("base") * F.col("source_size")
    placed = placed.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("at"))).cast("long"))
    taken = F.col("base") * F.col("size") + F.col("extra")
    placed = placed.withColumn("taken", taken)
    return placed.withColumn("position", position(F.lit(0), schedules))


def position(copy: Column, schedules: tuple = SCHEDULES) -> Column:
    """Training position, 0 to 1, of the given pass over a document."""
    total = F.greatest(F.round("target"), F.lit(1.0))
    share = F.least((copy * F.col("source_size") + F.col("at")).cast("double") / total, F.lit(1.0))
    out = None
    for k, knots in enumerate(schedules):
        time = _inverse(knots, share)
        out = F.when(F.col("kind") % len(schedules) == k, time) if out is None else out.when(F.col("kind") % len(schedules) == k, time)
    return out


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document, range-sorted by training position."""
    rows = written(plan(docs, **options).select("doc_id", "size", "source_size", "target", "taken", "position"), "mix-plan")
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def apply(docs: DataFrame, schedules: tuple = SCHEDULES, **options) -> DataFrame:
    """The mixture itself: a row of docs for each pass that takes the document, its text cut where the pass ends, in training order.

    Rows alike in doc_id are taken alike, as the one of them with the largest size.
    """
    need = ["size", "source_size", "target", "kind", "at", "base", "extra"]
    i, m = unused(docs, "__id", "__mix")
    planned = plan(docs, schedules=schedules, **options).where("taken > 0")
    once = planned.groupBy("doc_id").agg(F.max(F.struct(*need)).alias("row")).select("doc_id", "row.*")
    words = F.when(F.col("copy") < F.col("base"), F.col("size")).otherwise(F.col("extra"))
    passes = once.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("base").cast("int")))).withColumn("words", words).where("words > 0")
    passes = written(passes.select(F.col("doc_id").alias(i), F.struct("words", "size", position(F.col("copy"), schedules).alias("position")).alias(m)), "mix-passes")
    ends = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.when(F.col(f"{m}.words") < F.col(f"{m}.size"), F.array_join(F.slice(ends, F.lit(1), F.col(f"{m}.words").cast("int")), "")).otherwise(F.col("text"))
    rows = docs.join(passes, docs["doc_id"].eqNullSafe(F.col(i)))
    rows = rows.repartitionByRange(f"{m}.position", "doc_id").sortWithinPartitions(f"{m}.position", "doc_id")
    return rows.select(*[cut.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
