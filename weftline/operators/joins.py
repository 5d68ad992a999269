"""Joins: equal keys with null matching, semi and anti, as-of in both directions, ranges, upserts and keyed fixes.

Catalyst picks the physical join; hints are given only where a side is bounded by design. As-of joins never
compare all pairs: both sides are put in one timeline and the last known value is carried along it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from weftline.plans.registry import op
from weftline.plans.tables import written


def _list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


@op("merge_dataframe")
def merge_dataframe(df: DataFrame, right: DataFrame, on: str | Sequence[str] | None = None, left_on: str | Sequence[str] | None = None, right_on: str | Sequence[str] | None = None, how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"), null_safe: bool = False) -> DataFrame:
    """Join on equal keys. With null_safe nulls match nulls; columns that both sides have besides the keys get suffixes."""
    if how == "cross":
        return df.crossJoin(right)
    lk, rk = (_list(on), _list(on)) if on is not None else (_list(left_on), _list(right_on))
    both = (set(df.columns) - set(lk)) & (set(right.columns) - set(rk))
    left = df.withColumnsRenamed({c: c + suffixes[0] for c in both})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in both})
    if on is not None and not null_safe:
        return left.join(right, lk, how)
    right = right.withColumnsRenamed({c: f"__r_{c}" for c in rk})
    match = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(f"__r_{b}")) if null_safe else F.col(a) == F.col(f"__r_{b}") for a, b in zip(lk, rk, strict=True)])
    joined = left.join(right, match, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if on is None:
        return joined.withColumnsRenamed({f"__r_{c}": c if c not in left.columns else c + suffixes[1] for c in rk})
    keys = {a: F.coalesce(F.col(a), F.col(f"__r_{a}")) for a in lk}
    return joined.withColumns(keys).drop(*[f"__r_{c}" for c in rk])


@op("merge_metadata")
def merge_metadata(df: DataFrame, metadata: DataFrame, on: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Left join of the metadata columns that df lacks."""
    keys = _list(on)
    wanted = [c for c in (columns or metadata.columns) if c not in df.columns and c not in keys]
    return df.join(metadata.select(*keys, *wanted), keys, "left")


@op("anti_join")
def anti_join(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(other.select(*_list(on)), _list(on), "left_anti")


@op("semi_join")
def semi_join(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(other.select(*_list(on)), _list(on), "left_semi")


@op("upsert")
def upsert(df: DataFrame, other: DataFrame, on: str | Sequence[str], prefer: str = "existing") -> DataFrame:
    """Full outer join by key; each column takes the preferred side's value, else the other's."""
    keys = _list(on)
    new = other.withColumnsRenamed({c: f"__n_{c}" for c in other.columns if c not in keys})
    joined = df.join(new, keys, "full")
    columns = list(dict.fromkeys([*df.columns, *other.columns]))

    def value(c: str) -> Column:
        if c in keys or c not in other.columns or c not in df.columns:
            return F.col(c if c in keys or c in df.columns else f"__n_{c}")
        pair = (F.col(c), F.col(f"__n_{c}"))
        return F.coalesce(*(pair if prefer == "existing" else pair[::-1]))

    return joined.select(*[value(c).alias(c) for c in columns])


@op("apply_fixes")
def apply_fixes(df: DataFrame, fixes: DataFrame, on: str | Sequence[str], column: str = "labels", annotation: str = "annotation", status: str = "status") -> DataFrame:
    """Validated fixes overwrite a column by key; Discarded ones delete the row."""
    keys = _list(on)
    found = fixes.select(*keys, F.col(annotation).alias("__a"), F.col(status).alias("__s"))
    joined = df.join(found, keys, "left").where(~F.col("__s").eqNullSafe(F.lit("Discarded")))
    return joined.withColumn(column, F.when(F.col("__s") == "Validated", F.col("__a")).otherwise(F.col(column))).drop("__a", "__s")


@op("asof_join")
def asof_join(df: DataFrame, source: DataFrame, on: str, values: Sequence[str], by: str | Sequence[str] = (), direction: str = "backward", strict: bool = True, offset: str | None = None) -> DataFrame:
    """Each row takes the values of the latest source row before its time (or, forward, the earliest after), within the same `by` keys; none gives null.

    offset is an interval taken from (backward) or added to (forward) the row's time. One sort of the union by
    (by, time) carries the last source row along; without `by` the timeline is first cut into ranges of time and the last
    row of each range is carried over, so no task holds the whole timeline.
    """
    keys = list(_list(by)) if by else []
    backward = direction == "backward"
    shift = F.expr(f"INTERVAL {offset}") if offset else None
    at = F.col(on) if shift is None else F.col(on) - shift if backward else F.col(on) + shift
    carried = F.struct(F.col(on).alias(f"__{on}"), *[F.col(v).alias(f"__{v}") for v in values])
    left = df.withColumn("__t", at).withColumn("__src", F.lit(None).cast(source.select(carried.alias("s")).schema["s"].dataType)).withColumn("__k", F.lit(1))
    empty = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns if c not in keys]
    right = source.select(*keys, *empty, F.col(on).alias("__t"), carried.alias("__src"), F.lit(2 if strict else 0).alias("__k"))
    both = left.unionByName(right)
    order = [F.col("__t").asc() if backward else F.col("__t").desc(), F.col("__k").asc()]
    if keys:
        parts = [F.col(k) for k in keys]
        last = F.last("__src", True).over(Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        found = both.withColumn("__hit", last)
    else:
        spread = written(both.repartitionByRange(F.col("__t").asc() if backward else F.col("__t").desc()).withColumn("__part", F.spark_partition_id()), "timeline")
        inside = F.last("__src", True).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        best = F.max_by("__src", "__t") if backward else F.min_by("__src", "__t")
        ends = spread.where("__src is not null").groupBy("__part").agg(best.alias("__end"))
        parts = spread.select("__part").distinct().join(ends, "__part", "left")
        carry = parts.select("__part", F.last("__end", True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
        found = spread.join(F.broadcast(carry), "__part").withColumn("__hit", F.coalesce(inside, F.col("__carry")))
    out = found.where("__k = 1")
    return out.select(*df.columns, *[F.col(f"__hit.__{v}").alias(v if v not in df.columns else f"{v}_asof") for v in values], F.col(f"__hit.__{on}").alias(f"{on}_asof"))


def _axis(df: DataFrame, c: str) -> Column | None:
    """A column as a number in its own order; None where its type has none."""
    kind = df.schema[c].dataType
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.col(c).cast("timestamp").cast("double")
    return F.col(c).cast("double") if isinstance(kind, NumericType) else None


@op("range_join")
def range_join(df: DataFrame, ranges: DataFrame, at: str, start: str, end: str, value: str, default=None, order_by: str | None = None, bins: int = 200) -> DataFrame:
    """The first range by order_by (or start; then start, end, value) with start < at < end, both strict, gives its value; none gives the default.

    Distinct times meet ranges by equality on bins of the axis, cut at quantiles of the ranges' starts, then come back to their rows,
    so nothing is compared across bins and no wide row is grouped. A range is listed once for each bin it reaches into, `bins` times at
    most. Columns without a numeric order (text) share one bin. Null times and ranges with a null end match nothing.
    """
    keyed = ranges.select(F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(value).alias("__v"), F.col(order_by or start).alias("__o")).where("__s < __e")
    points = df.select(F.col(at).alias("__at")).where("__at is not null").distinct()
    axes = [_axis(points, "__at"), _axis(keyed, "__s"), _axis(keyed, "__e")]
    if any(a is None for a in axes):
        point_bin, range_bins = F.lit(0), F.array(F.lit(0))
    else:
        cuts = keyed.select(axes[1].alias("x")).approxQuantile("x", [i / bins for i in range(1, bins)], 1 / (4 * bins)) if bins > 1 else []
        edges = F.array(*map(F.lit, sorted(set(cuts)))).cast("array<double>")
        of = lambda x: F.size(F.filter(edges, lambda e: e <= x))
        point_bin, range_bins = of(axes[0]), F.sequence(of(axes[1]), of(axes[2]))
    hits = points.withColumn("__bin", point_bin).join(keyed.withColumn("__bin", F.explode(range_bins)), "__bin").where("__s < __at and __at < __e")
    first = F.min(F.struct(F.isnull("__o").alias("n"), "__o", "__s", "__e", "__v"))
    best = hits.groupBy("__at").agg(first.alias("__best")).select("__at", F.struct(F.col("__best.__v").alias("v")).alias("__found"))
    rows = df.join(best, F.col(at) == F.col("__at"), "left")
    found = F.col("__found.v") if default is None else F.coalesce("__found.v", F.lit(default))
    return rows.withColumn(value, found).select(*[c for c in df.columns if c != value], value)


@op("lookup")
def lookup(df: DataFrame, table: DataFrame, on: str | Sequence[str], value: str) -> DataFrame:
    """The value at the equal key, or null; the table has unique keys."""
    return df.join(table.select(*_list(on), value), _list(on), "left")
