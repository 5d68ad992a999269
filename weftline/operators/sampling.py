"""Samples, splits and folds by hash order, so that any engine with md5 can replay them; no row order is assumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.relational import reset_index
from weftline.plans.registry import op


#: Rows up to which a sample is gathered in one task.
SMALL = 100_000


def shuffled(key: str, seed: int = 1) -> Column:
    """A column whose order is a reproducible shuffle of the key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))


def _n(count: Column, n: int | None, frac: float | None) -> Column:
    return F.least(count, F.lit(n)) if n is not None else F.round(count * F.lit(frac))


@op("sampling")
def sampling(df: DataFrame, key: str, n: int | None = None, frac: float | None = None, groupby: str | None = None, seed: int = 1) -> DataFrame:
    """n rows, or a fraction, of all rows or of each group: those first in hash order. Without groups, up to SMALL rows are the top of a partial sort; more are ranked by range, so no task holds them all."""
    if groupby is None:
        size = n if n is not None else round(df.count() * frac)
        if size > SMALL:
            return _ranked(df, shuffled(key, seed), F.col(key)).where(F.col("__rank") < size).drop("__rank")
        return df.orderBy(shuffled(key, seed), key).limit(size)
    rank = F.row_number().over(Window.partitionBy(groupby).orderBy(shuffled(key, seed), key))
    if n is not None:
        return df.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")
    count = df.groupBy(groupby).agg(F.count(F.lit(1)).alias("__n"))
    return df.withColumn("__r", rank).join(count, groupby).where(F.col("__r") <= _n(F.col("__n"), n, frac)).drop("__r", "__n")


@op("subset")
def subset(df: DataFrame, key: str, head_n: int = 0, tail_n: int = 0, sample_n: int = 0, sample_frac: float = 0.0, seed: int = 1) -> DataFrame:
    """The first, the last and sampled rows by key, one after another; a row can come more than once."""
    parts = [df.orderBy(key).limit(head_n)] if head_n else []
    parts += [df.orderBy(F.desc(key)).limit(tail_n)] if tail_n else []
    parts += [sampling(df, key, n=sample_n, seed=seed)] if sample_n else []
    parts += [sampling(df, key, frac=sample_frac, seed=seed)] if sample_frac else []
    out = parts[0] if parts else df.limit(0)
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def tile(rank: Column, n: int, k: int) -> Column:
    """Part 0 to k - 1 of a row at rank (from 0) of n: contiguous, the first n mod k parts a row longer."""
    q, r = divmod(n, k)
    cut = F.lit(r * (q + 1))
    return F.when(rank < cut, F.floor(rank / F.lit(q + 1))).otherwise(F.lit(r) + F.floor((rank - cut) / F.lit(max(q, 1)))).cast("int")


def _ranked(df: DataFrame, *order) -> DataFrame:
    """df with __rank from 0; range-partitioned, no task holds all rows."""
    keys = [f"__o{i}" for i in range(len(order))]
    return reset_index(df.withColumns(dict(zip(keys, order, strict=True))), keys, "__rank").drop(*keys)


@op("split_sampling")
def split_sampling(df: DataFrame, key: str, test_size: float = 0.2, dev_size: float = 0.0, stratify: str | None = None, seed: int = 1, into: str = "split") -> DataFrame:
    """train, test and dev by hash order within each stratum; test is ceil(n * test_size), dev that share of what remains."""
    if stratify is None:
        rows, n = _ranked(df, shuffled(key, seed), F.col(key)), F.lit(df.count())
    else:
        counts = df.groupBy(F.col(stratify).alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
        rank = F.row_number().over(Window.partitionBy(stratify).orderBy(shuffled(key, seed), key)) - 1
        rows, n = df.withColumn("__rank", rank).join(counts, F.col(stratify).eqNullSafe(F.col("__s"))).drop("__s"), F.col("__n")
    test = F.ceil(n * F.lit(test_size))
    dev = F.ceil((n - test) * F.lit(dev_size))
    return rows.withColumn(into, F.when(F.col("__rank") < test, "test").when(F.col("__rank") < test + dev, "dev").otherwise("train")).drop("__rank", "__n")


@op("split_dataframe")
def split_dataframe(df: DataFrame, k: int, order_by: str, into: str = "part") -> DataFrame:
    """Contiguous parts 0 to k - 1 in key order; the first n mod k parts have a row more."""
    return _ranked(df, F.col(order_by)).withColumn(into, tile(F.col("__rank"), df.count(), k)).drop("__rank")


@op("kfold")
def kfold(df: DataFrame, k: int, key: str, seed: int = 1, into: str = "fold") -> DataFrame:
    """Folds 0 to k - 1 of equal size in hash order."""
    return _ranked(df, shuffled(key, seed), F.col(key)).withColumn(into, tile(F.col("__rank"), df.count(), k)).drop("__rank")


@op("percent_slice")
def percent_slice(df: DataFrame, order_by: str, percent: float, tail: bool = False) -> DataFrame:
    """The first (or, with tail, all but the first) percent of rows in key order."""
    cut = int(df.count() * percent / 100)
    return _ranked(df, F.col(order_by)).where(F.col("__rank") >= cut if tail else F.col("__rank") < cut).drop("__rank")


@op("oversample")
def oversample(df: DataFrame, factor: int, into: str = "copy") -> DataFrame:
    """Every row `factor` times, numbered from 0."""
    return df.withColumn(into, F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))


@op("shuffle")
def shuffle(df: DataFrame, key: str, seed: int = 1) -> DataFrame:
    return df.orderBy(shuffled(key, seed), key)
