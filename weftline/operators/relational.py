"""Projection, filtering, reshaping, aggregation and set operators on whole DataFrames; all built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.plans.registry import op
from weftline.plans.tables import written


def _list(x: str | Sequence[str] | None) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


@op("split_column")
def split_column(df: DataFrame, source: str, target: str | Sequence[str], pat: str = " ", n: int = -1, expand: bool = False, regex: bool | None = None) -> DataFrame:
    """Split text by a pattern. A one-character pattern is literal unless regex says otherwise; n is the most splits (0 or less: all).

    With expand, target names a column for each part, null where there are fewer; else target is an array.
    """
    pattern = pat if (len(pat) > 1 if regex is None else regex) else T.quoted(pat)
    parts = F.split(F.col(source), pattern, n + 1 if n > 0 else -1)
    if not expand:
        return df.withColumn(_list(target)[0], parts)
    return df.withColumns({name: F.get(parts, F.lit(i)) for i, name in enumerate(_list(target))})


@op("eval_columns")
def eval_columns(df: DataFrame, expressions: dict[str, str] | Sequence[str]) -> DataFrame:
    """SQL expressions into columns, in order, each seeing those before it; a list holds "name = expression". No Python is evaluated."""
    pairs = expressions.items() if isinstance(expressions, dict) else [tuple(x.strip() for x in e.split("=", 1)) for e in expressions]
    return reduce(lambda d, p: d.withColumn(p[0], F.expr(p[1])), pairs, df)


@op("combine_columns")
def combine_columns(df: DataFrame, columns: Sequence[str], into: str, separator: str = " ") -> DataFrame:
    """Columns as text, null as empty, joined by a separator whose \\n and \\t are read as escapes."""
    sep = separator.replace("\\n", "\n").replace("\\t", "\t")
    return df.withColumn(into, F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


@op("combine_ids")
def combine_ids(df: DataFrame, columns: Sequence[str], into: str = "id") -> DataFrame:
    """A composite id of columns joined by "_"."""
    return combine_columns(df, columns, into, "_")


@op("drop")
def drop(df: DataFrame, columns: str | Sequence[str], errors: str = "ignore") -> DataFrame:
    missing = [c for c in _list(columns) if c not in df.columns]
    if missing and errors == "raise":
        raise KeyError(f"no columns {', '.join(missing)}")
    return df.drop(*_list(columns))


@op("select")
def select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


@op("melt")
def melt(df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str] | None = None, var_name: str = "variable", value_name: str = "value") -> DataFrame:
    values = value_vars or [c for c in df.columns if c not in id_vars]
    return df.unpivot(list(id_vars), list(values), var_name, value_name)


@op("pivot")
def pivot(df: DataFrame, index: str | Sequence[str], columns: str, values: str | Sequence[str], labels: Sequence | None = None, fillna=None) -> DataFrame:
    """One column `value_label` for each value and label. More than one row for an index and label raises; labels, when given, save a pass over the data."""
    index, values = _list(index), _list(values)
    once = lambda v: F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("pivot: more than one row for an index and label"))).otherwise(F.first(v))
    grouped = df.groupBy(*index).pivot(columns, list(labels) if labels is not None else None)
    out = grouped.agg(*[once(v).alias(v) for v in values])
    names = [c for c in out.columns if c not in index]
    for c in names:
        v = values[0] if len(values) == 1 else next(x for x in sorted(values, key=len, reverse=True) if c.endswith(f"_{x}"))
        out = out.withColumnRenamed(c, f"{v}_{c if len(values) == 1 else c[: -len(v) - 1]}")
    return out if fillna is None else out.fillna(fillna, [c for c in out.columns if c not in index])


@op("top_values")
def top_values(df: DataFrame, id_var: str | Sequence[str], label_var: str, value_var: str, n: int = 3, into: str = "top_values", separator: str = ", ") -> DataFrame:
    """Beside every row, its group's n largest values as "label[NN%]", largest first; ties by label. Joined back by the group."""
    keys = _list(id_var)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value_var), label_var))
    shown = F.format_string("%s[%d%%]", F.col(label_var), F.round(F.col(value_var) * 100).cast("long"))
    top = df.withColumn("__rank", rank).where(F.col("__rank") <= n).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__rank", shown.alias("s")))).alias("__top"))
    joined = top.select(*keys, F.array_join(F.transform("__top", lambda x: x["s"]), separator).alias(into))
    return df.join(joined, keys, "left")


#: Aggregates by the names that specifications use.
AGGREGATES = {
    "sum": F.sum, "sum_exact": lambda c: F.sum(F.col(c).cast("decimal(28,6)")), "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "median": F.median, "std": F.stddev_samp, "var": F.var_samp,
    "first": F.first, "last": F.last, "nunique": F.count_distinct, "size": lambda c: F.count(F.lit(1)), "list": F.collect_list, "set": F.collect_set,
}


@op("aggregate_columns")
def aggregate_columns(df: DataFrame, groupby: str | Sequence[str], aggregations: dict[str, str | Sequence[str]] | None = None, onto: str | None = None, order_by: str | None = None, separator: str = "\n", keep_null_keys: bool = False) -> DataFrame:
    """Group and aggregate (columns `column_function`, or `column` for a single function), or join `onto` as text in `order_by` order. Null keys are dropped unless kept."""
    keys = _list(groupby)
    df = df if keep_null_keys else df.dropna(subset=keys)
    if aggregations is None:
        order = F.struct(F.col(order_by).alias("o"), F.coalesce(F.col(onto).cast("string"), F.lit("")).alias("v"))
        return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["v"]), separator).alias(onto))
    out = []
    for column, functions in aggregations.items():
        single = isinstance(functions, str)
        out += [AGGREGATES[f](column).alias(column if single else f"{column}_{f}") for f in _list(functions)]
    return df.groupBy(*keys).agg(*out)


@op("explode_splits")
def explode_splits(df: DataFrame, id_key: str, text: str = "text", separator: str = "\n\n", split_key: str = "seq", regex: bool = False) -> DataFrame:
    """A row for each part of a text, numbered from 0 within its row; ids are unique, so no window is needed."""
    pattern = separator if regex else T.quoted(separator)
    rest = [F.col(c) for c in df.columns if c != text]
    return df.select(*rest, F.posexplode_outer(F.split(F.col(text), pattern, -1)).alias(split_key, text))


@op("rename_columns")
def rename_columns(df: DataFrame, new_names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in new_names.items() if k in df.columns})


@op("reset_index")
def reset_index(df: DataFrame, order_by: str | Sequence[str], index: str = "id", drop_index: bool = False) -> DataFrame:
    """A dense index from 0 in the order of explicit keys. Range-partitioned, so no task holds all rows: offsets of partitions come from their counts."""
    keys = _list(order_by)
    if drop_index:
        df = df.drop(index)
    # Written: range bounds are sampled, so a second evaluation could deal rows to other partitions.
    spread = written(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "ranged")
    sizes = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    return spread.withColumn("__place", place).join(F.broadcast(before), "__part").withColumn(index, (F.col("__place") + F.col("__before")).cast("long")).drop("__part", "__place", "__before")


@op("fillna")
def fillna(df: DataFrame, fill_with="", columns: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(fill_with, list(columns) if columns else None)


@op("general_function")
def general_function(df: DataFrame, method: str, **options) -> DataFrame:
    """A DataFrame method by name, from a fixed list."""
    allowed = {"replace": lambda d, to_replace, value=None, subset=None: d.replace(to_replace, value, subset), "dropna": lambda d, **o: d.dropna(**o), "astype": lambda d, types: d.withColumns({c: F.col(c).cast(t) for c, t in types.items()}), "limit": lambda d, n: d.limit(n)}
    if method not in allowed:
        raise KeyError(f"{method} is not one of {', '.join(sorted(allowed))}")
    return allowed[method](df, **options)


@op("replace_regex")
def replace_regex(df: DataFrame, columns: str | Sequence[str], patterns: dict[str, str]) -> DataFrame:
    """Ordered replacements, trimmed after every one; \\1 in a replacement is group 1."""
    return df.withColumns({c: T.replace_all(F.col(c), patterns) for c in _list(columns)})


@op("remove_startswith")
def remove_startswith(df: DataFrame, columns: str | Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """Each prefix, if the lower-cased text starts with it, is cut off and the rest trimmed."""

    def cut(c: Column, p: str) -> Column:
        return F.when(F.lower(c).startswith(p), F.trim(F.substring(c, len(p) + 1, 2**31 - 1))).otherwise(c)

    return df.withColumns({c: reduce(cut, prefixes, F.col(c)) for c in _list(columns)})


@op("filter_length")
def filter_length(df: DataFrame, columns: str | Sequence[str] = "text", min_length: int | None = None, max_length: int | None = None, len_func: str = "len_bytes", keep_length: bool = False) -> DataFrame:
    """Rows whose columns' lengths lie within the bounds; the length column is named after the function."""
    for c in _list(columns):
        length = T.LENGTHS[len_func](F.col(c))
        if keep_length:
            df = df.withColumn(f"{c}_num_{len_func.removeprefix('len_')}", length)
        if min_length is not None:
            df = df.where(length >= min_length)
        if max_length is not None:
            df = df.where(length <= max_length)
    return df


@op("filter_query")
def filter_query(df: DataFrame, query: str | Sequence[str]) -> DataFrame:
    """SQL conditions, all of which must hold."""
    return reduce(lambda d, q: d.where(F.expr(q)), _list(query), df)


@op("drop_duplicates")
def drop_duplicates(df: DataFrame, subset: str | Sequence[str], order_by: str | Sequence[str]) -> DataFrame:
    """The first row of each subset in an explicit order, nulls first; null keys are one key.

    The least row of each key is combined before the shuffle, so a key that a third of all rows hold gathers in no task.
    """
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*_list(order_by))).alias("row")
    return df.groupBy(*_list(subset)).agg(best).select("row.*")


@op("concat_dataframes")
def concat_dataframes(df: DataFrame, others: DataFrame | Sequence[DataFrame] | dict[str, DataFrame], key: str | None = None, name: str | None = None) -> DataFrame:
    """Union by name, missing columns null. With key, a constant column says which frame a row came from."""
    frames = [(name, df)] + (list(others.items()) if isinstance(others, dict) else [(None, d) for d in ([others] if isinstance(others, DataFrame) else others)])
    frames = [d if key is None else d.withColumn(key, F.lit(n)) for n, d in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


@op("union_common")
def union_common(df: DataFrame, others: Sequence[DataFrame]) -> DataFrame:
    """Union of the columns that all frames have, in name order."""
    shared = sorted(set(df.columns).intersection(*[o.columns for o in others]))
    return reduce(lambda a, b: a.unionByName(b), [d.select(*shared) for d in (df, *others)])


@op("summary_stats")
def summary_stats(df: DataFrame, column: str = "text", len_func: str = "len_bytes", by: str | None = None) -> DataFrame:
    """count, sum, median, max and min of a derived length; with `by`, also a row for the whole (by is null there), in one rollup."""
    n = T.LENGTHS[len_func](F.col(column))
    stats = [F.count(F.lit(1)).alias("num_examples"), F.sum(n).alias("total"), F.median(n).alias("median"), F.max(n).alias("max"), F.min(n).alias("min")]
    if by is None:
        return df.agg(*stats)
    return df.rollup(by).agg(F.grouping(by).alias("is_total"), *stats)


@op("share_of_total")
def share_of_total(df: DataFrame, group: str, weight: Column | None = None) -> DataFrame:
    """Rows (or summed weights) of each group and their percentage of all; the total is taken over groups, not rows."""
    counted = df.groupBy(group).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    return counted.withColumn("percent", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100)


@op("make_table")
def make_table(df: DataFrame, group: str, name: str, size: str) -> DataFrame:
    """Sizes by name with percentages, subtotals by group and a grand total, by grouping sets; human-readable bytes beside."""
    total = df.groupingSets([[group, name], [group], []], group, name).agg(F.sum(size).alias("bytes"), F.grouping_id().alias("level"))
    whole = F.sum(F.when(F.col("level") == 0, F.col("bytes"))).over(Window.partitionBy())
    return total.withColumn("percent", F.round(F.col("bytes") / whole * 100, 2)).withColumn("human", T.human_bytes(F.col("bytes")))


@op("intersect")
def intersect(df: DataFrame, other: DataFrame, keep_all: bool = False) -> DataFrame:
    return df.intersectAll(other) if keep_all else df.intersect(other)


@op("except")
def except_(df: DataFrame, other: DataFrame, keep_all: bool = False) -> DataFrame:
    return df.exceptAll(other) if keep_all else df.subtract(other)


@op("append_constant")
def append_constant(df: DataFrame, **constants) -> DataFrame:
    """Provenance columns such as corpus, dataset or split."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


@op("to_datetime")
def to_datetime(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Text columns to timestamps by format; what does not parse becomes null."""
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string"), F.lit(f)) for c, f in columns.items()})


@op("prefix_values")
def prefix_values(df: DataFrame, name: str, value: str = "value", rest: Sequence[str] = ()) -> DataFrame:
    """A series' value column takes the series' name; further value columns get it as a prefix."""
    return df.withColumnsRenamed({value: name} | {c: f"{name}_{c}" for c in rest})
