"""Lexicon sentiment: n-grams looked up in a lexicon, polarity by sentence, document and group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.plans.registry import op

EPS = 1e-6


def polarity(pos: Column, neg: Column) -> Column:
    return (pos - neg) / (pos + neg + F.lit(EPS))


def last_match(value: Column, classes: Sequence[tuple[str, float, float]]) -> Column:
    """The label of the last closed interval that holds the value."""
    out = F.lit(None).cast("string")
    for label, low, high in classes:
        out = F.when(value.between(low, high), label).otherwise(out)
    return out


def first_match(value: Column, classes: Sequence[tuple[str, float, float]]) -> Column:
    """The label of the first closed interval that holds the value."""
    out = F.lit(None).cast("string")
    for label, low, high in reversed(list(classes)):
        out = F.when(value.between(low, high), label).otherwise(out)
    return out


CLASSES = (("negative", -1.0, -0.2), ("neutral", -0.2, 0.2), ("positive", 0.2, 1.0))


#: Entries up to which a lexicon's words are broadcast, a count that is made first.
BROADCAST = 200_000


def known(rows: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """rows whose key is among the words, if these are few enough to be broadcast; else all rows, for a join that follows."""
    few = words.limit(BROADCAST + 1).count() <= BROADCAST
    return rows.join(F.broadcast(words), key, "left_semi") if few else rows


@op("lexicon_features")
def lexicon_features(df: DataFrame, lexicon: DataFrame, id_key: str, text: str = "text", word: str = "word", features: Sequence[str] = ("positive", "negative"), min_tokens: int = 5, lowercase: bool = True) -> DataFrame:
    """(id, num_tokens, one sum for each feature): every row, zero where nothing matched, null where there are fewer than min_tokens words.

    Words that a lexicon of bounded size does not have go before anything is shuffled; the others are counted within the row first, so a
    row joins the lexicon once for each distinct word.
    """
    tokens = T.words(F.lower(text) if lowercase else F.col(text))
    rows = df.select(id_key, tokens.alias("__t"))
    listed = known(rows.select(id_key, F.explode("__t").alias(word)), lexicon.select(word), word)
    counted = listed.groupBy(id_key, word).agg(F.count(F.lit(1)).alias("__c"))
    hits = counted.join(lexicon.select(word, *features), word).groupBy(id_key).agg(*[F.sum(F.col(f) * F.col("__c")).alias(f) for f in features])
    n = F.coalesce(F.size("__t"), F.lit(0))
    joined = rows.select(id_key, n.alias("num_tokens")).join(hits, id_key, "left")
    return joined.select(id_key, "num_tokens", *[F.when(F.col("num_tokens") >= min_tokens, F.coalesce(f, F.lit(0))).alias(f) for f in features])


@op("score_polarity")
def score_polarity(df: DataFrame, positive: str = "positive", negative: str = "negative", into: str = "polarity", classes: Sequence[tuple] = CLASSES) -> DataFrame:
    """Polarity and its label; where intervals meet, the later one wins."""
    p = polarity(F.col(positive), F.col(negative))
    return df.withColumn(into, p).withColumn(f"{into}_label", last_match(F.col(into), classes))


@op("article_scores")
def article_scores(df: DataFrame, id_key: str, score: str = "polarity", bound: float = 0.1) -> DataFrame:
    """mean, median, sum and diffusion ((positive - negative) / scored) of sentence scores by document."""
    pos, neg = F.sum(F.when(F.col(score) > bound, 1).otherwise(0)), F.sum(F.when(F.col(score) < -bound, 1).otherwise(0))
    n = F.count(score)
    return df.groupBy(id_key).agg(n.alias("num_examples"), F.avg(score).alias("mean"), F.median(score).alias("median"), F.sum(score).alias("sum"), F.try_divide(pos - neg, n).alias("diffusion"))


@op("aggregate_scores")
def aggregate_scores(df: DataFrame, groupby: str | Sequence[str], score: str = "polarity", min_examples: int = 0, classes: Sequence[tuple] = CLASSES) -> DataFrame:
    """Polarity of each group from its rows' signs; null unless there are more than min_examples; where intervals meet, the earlier one wins."""
    keys = [groupby] if isinstance(groupby, str) else list(groupby)
    pos, neg = F.sum(F.when(F.col(score) > 0, 1).otherwise(0)), F.sum(F.when(F.col(score) < 0, 1).otherwise(0))
    grouped = df.dropna(subset=keys).groupBy(*keys).agg(F.count(score).alias("num_examples"), pos.alias("num_positive"), neg.alias("num_negative"))
    value = F.when(F.col("num_examples") > min_examples, polarity(F.col("num_positive"), F.col("num_negative")))
    return grouped.withColumn("polarity", value).withColumn("label", first_match(F.col("polarity"), classes))
