"""Window operators: running counts and sums, shifts, rolling means, top rows of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.registry import op


def _list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def ordered(by: str | Sequence[str], order_by: str | Sequence[str]):
    return Window.partitionBy(*_list(by)).orderBy(*_list(order_by))


def rolling_mean(value: Column, window, n: int) -> Column:
    """Mean of n rows; null until there are n."""
    frame = window.rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))


@op("cumcount")
def cumcount(df: DataFrame, by: str | Sequence[str], order_by: str | Sequence[str], into: str = "cumcount") -> DataFrame:
    return df.withColumn(into, F.row_number().over(ordered(by, order_by)) - 1)


@op("head_per_group")
def head_per_group(df: DataFrame, by: str | Sequence[str], order_by: Sequence, n: int = 1) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*_list(by)).orderBy(*order_by))
    return df.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


@op("cumsum")
def cumsum(df: DataFrame, value: str, by: str | Sequence[str], order_by: str | Sequence[str], into: str = "cumsum") -> DataFrame:
    return df.withColumn(into, F.sum(F.expr(value)).over(ordered(by, order_by).rowsBetween(Window.unboundedPreceding, 0)))


@op("rolling")
def rolling(df: DataFrame, value: str, n: int, by: str | Sequence[str], order_by: str | Sequence[str], into: str) -> DataFrame:
    return df.withColumn(into, rolling_mean(F.col(value), ordered(by, order_by), n))


@op("shift")
def shift(df: DataFrame, value: str, periods: int, by: str | Sequence[str], order_by: str | Sequence[str], into: str) -> DataFrame:
    """Value of the row `periods` before (negative: after)."""
    w = ordered(by, order_by)
    return df.withColumn(into, F.lag(value, periods).over(w) if periods >= 0 else F.lead(value, -periods).over(w))


@op("decision")
def decision(df: DataFrame, value: str, by: str | Sequence[str], order_by: str | Sequence[str], ahead: int = 3, into: str = "decision") -> DataFrame:
    """Sign of the change from the previous row's value to that `ahead` rows on: -1, 0 or 1."""
    w = ordered(by, order_by)
    return df.withColumn(into, F.signum(F.lead(value, ahead).over(w) - F.lag(value, 1).over(w)).cast("int"))


@op("argmax_per_group")
def argmax_per_group(df: DataFrame, by: str | Sequence[str], value: str, columns: Sequence[str]) -> DataFrame:
    """Columns of each group's row with the largest value, by a hash aggregate without a sort."""
    return df.groupBy(*_list(by)).agg(*[F.max_by(c, value).alias(c) for c in columns], F.max(value).alias(value))


@op("sentence_ids")
def sentence_ids(df: DataFrame, words: str = "words", by: str | Sequence[str] = "file", order_by: str = "line_no") -> DataFrame:
    """CoNLL rows: document markers go, a blank line ends a sentence, sentences are numbered, blanks go."""
    blank = F.when(F.trim(words) == "", 1).otherwise(0)
    rows = df.where(~F.coalesce(F.col(words), F.lit("")).startswith("-DOCSTART-"))
    ids = F.sum(blank).over(ordered(by, order_by).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("sentence_id", ids).where(F.trim(words) != "")
