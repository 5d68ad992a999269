"""Words cut where their branching entropies spike: substring counts, entropies and cuts are joins and aggregates over all distinct words.

Every word is read between marks. A piece is a substring of at most `max_length` characters, marks included, that occurs at
least `min_count` times. The continuations of a prefix are the pieces that begin with it and that no longer piece begins with;
backwards, the same holds of reversed words. Entropies and cohesions take digamma(n) for log n.

Defined cases: a null text or an empty word has no pieces; a word never seen in training stays whole unless its ends are
known; characters of a word beyond max_length from both of its ends have no entropies, so it is not cut there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.ngrams import ngram_counts, placed_ngrams
from weftline.plans.registry import op
from weftline.plans.tables import written

MARK = "▁"
#: Decimals kept of entropies and cohesions, so that the order in which sums are taken decides no cut.
DIGITS = 10


def digamma(n: Column) -> Column:
    """digamma of a positive number: the recurrence up to 6, then the asymptotic series."""
    n = n.cast("double")
    up = F.greatest(F.ceil(F.lit(6.0) - n), F.lit(0)).cast("int")
    steps = F.when(up > 0, F.sequence(F.lit(0), F.greatest(up, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    below = F.aggregate(steps, F.lit(0.0), lambda s, k: s - 1 / (n + k))
    x = n + up
    inv = 1 / (x * x)
    return below + F.log(x) - 0.5 / x - inv * (F.lit(1 / 12) - inv * (F.lit(1 / 120) - inv / 252))


@op("word_table")
def word_table(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all distinct words of all rows."""
    return ngram_counts(df.select(T.words(F.col(text)).alias("__words")), "__words", 1).select(F.col("words").alias("word"), F.col("frequency").alias("n"))


def _heads(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda k: F.substring(c, F.lit(1), k))


@op("piece_counts")
def piece_counts(words: DataFrame, max_length: int = 20, min_count: int = 2) -> DataFrame:
    """(piece, n) of all substrings of marked words; runs from each character are combined before they are cut to prefixes."""
    letters = F.split(F.concat(F.lit(MARK), "word", F.lit(MARK)), "", -1)
    letters = F.filter(letters, lambda x: x != "")
    runs = F.transform(F.sequence(F.lit(1), F.size(letters)), lambda i: F.array_join(F.slice(letters, i, F.lit(max_length)), ""))
    windows = words.where("word <> ''").select(F.explode(runs).alias("run"), "n").groupBy("run").agg(F.sum("n").alias("n"))
    counted = windows.select(F.explode(_heads(F.col("run"))).alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


@op("piece_entropies")
def piece_entropies(pieces: DataFrame, backward: bool = False) -> DataFrame:
    """(piece, entropy) of what continues each marked word beginning; backward: what goes before each marked word end, read from the end."""
    at = F.reverse("piece") if backward else F.col("piece")
    ends = pieces.select(at.alias("piece"), "n").where(F.col("piece").startswith(MARK) & (F.length("piece") > 1))
    shorter = ends.select(F.expr("substring(piece, 1, length(piece) - 1)").alias("piece")).distinct()
    leaves = ends.join(shorter, "piece", "left_anti")
    d = digamma(F.col("n"))
    below = leaves.select(F.explode(_heads(F.col("piece"))).alias("piece"), "n", d.alias("d")).where(F.length("piece") > 1)
    sums = below.groupBy("piece").agg(F.sum("n").alias("s"), F.sum(F.exp("d")).alias("a"), F.sum(F.exp("d") * F.col("d")).alias("b"))
    total = digamma(F.col("s") + F.col("n"))
    return sums.join(ends, "piece").withColumn("t", total).select("piece", F.round((F.col("t") * F.col("a") - F.col("b")) / F.exp("t"), DIGITS).alias("entropy"))


@op("piece_cohesions")
def piece_cohesions(pieces: DataFrame) -> DataFrame:
    """(piece, cohesion) of pieces of two letters or more without a mark at either end: (count / count of the first letter) ^ (1 / (letters - 1))."""
    inner = pieces.where(~F.col("piece").startswith(MARK) & ~F.col("piece").endswith(MARK))
    first = inner.where(F.length("piece") == 1).select(F.col("piece").alias("first"), F.col("n").alias("f"))
    longer = inner.where(F.length("piece") > 1).withColumn("first", F.substring("piece", 1, 1))
    return longer.join(first, "first").select("piece", F.round(F.exp((digamma(F.col("n")) - digamma(F.col("f"))) / (F.length("piece") - 1)), DIGITS).alias("cohesion"))


@op("branching_segments")
def branching_segments(words: DataFrame, pieces: DataFrame, max_length: int = 20, branching_threshold: float = 0.0, cohesion_threshold: float | None = 0.0) -> DataFrame:
    """(word, pieces array<string>) of each distinct word, the first piece with the mark in front.

    After a letter but the first and the last a word is cut where the backward entropy has risen by more than the threshold
    after it fell; before the last letter where the forward entropy rises so and then falls; and wherever the next letter changes
    the cohesion by less than cohesion_threshold (None: no such cuts). Entropies that are absent or zero count as unchanged.
    """
    pieces = written(pieces, "branching-pieces")
    named = words.select("word").where("word <> ''").distinct().withColumn("size", F.length("word"))
    near = F.array_union(F.sequence(F.lit(1), F.least(F.col("size"), F.lit(max_length))), F.sequence(F.greatest(F.col("size") - max_length, F.lit(1)), F.col("size")))
    at = named.select("word", "size", F.explode(near).alias("i"))
    left = F.col("size") - F.col("i")
    keyed = at.select(
        "word", "size", "i",
        F.when(F.col("i") < max_length, F.concat(F.lit(MARK), F.substring("word", F.lit(1), F.col("i")))).alias("head"),
        F.when(left.between(1, max_length - 1), F.concat(F.lit(MARK), F.reverse(F.substring("word", -left, left)))).alias("tail"),
        F.when(F.col("i").between(2, max_length), F.substring("word", F.lit(1), F.col("i"))).alias("inner"),
    )
    joined = keyed.join(piece_entropies(pieces).select(F.col("piece").alias("head"), F.col("entropy").alias("f")), "head", "left")
    joined = joined.join(piece_entropies(pieces, True).select(F.col("piece").alias("tail"), F.col("entropy").alias("b")), "tail", "left")
    joined = joined.join(piece_cohesions(pieces).select(F.col("piece").alias("inner"), F.col("cohesion").alias("c")), "inner", "left")
    known = joined.select("word", "size", "i", *[F.nullif(F.col(x), F.lit(0.0)).alias(x) for x in ("f", "b", "c")])
    by = Window.partitionBy("word").orderBy("i")
    step = lambda c, a, b: F.coalesce((a(c) - b(c)), F.lit(0.0))
    here, before, after = F.col, (lambda c: F.lag(c).over(by)), (lambda c: F.lead(c).over(by))
    rises, fell = step("b", here, after) > branching_threshold, step("b", before, here) < 0
    peaks = (step("f", here, before) > branching_threshold) & (step("f", after, here) < 0)
    cut = F.when(F.col("i") < F.col("size") - 1, rises & fell).otherwise(peaks)
    if cohesion_threshold is not None:
        cut = cut | (step("c", after, here) < cohesion_threshold)
    marked = known.withColumn("cut", cut & F.col("i").between(2, F.col("size") - 1))
    cuts = marked.groupBy("word", "size").agg(F.array_sort(F.collect_set(F.when(F.col("cut"), F.col("i")))).alias("cuts"))
    starts, ends = F.concat(F.array(F.lit(0)), "cuts"), F.concat("cuts", F.array("size"))
    parts = F.zip_with(starts, ends, lambda s, e: F.concat(F.when(s == 0, MARK).otherwise(""), F.substring("word", s + 1, e - s)))
    return cuts.select("word", parts.alias("pieces"))


@op("branching_tokens")
def branching_tokens(df: DataFrame, id_key: str, text: str = "text", trained: DataFrame | None = None, **options) -> DataFrame:
    """(id, place, pieces) of each word of each row; pieces are counted in df itself unless `trained` (piece, n) is given. Each distinct word is cut once."""
    words = written(word_table(df, text), "branching-words")
    limit = options.get("max_length", 20)
    counted = trained if trained is not None else piece_counts(words, limit, options.pop("min_count", 2))
    segments = written(branching_segments(words, counted, **options), "branching-segments")
    # A word meets its pieces once for each run of rows that hold it.
    placed = placed_ngrams(df.select(id_key, T.words(F.col(text)).alias("__words")), id_key, "__words")
    met = placed.join(segments, placed["words"] == segments["word"]).select("pieces", F.explode(F.arrays_zip("ids", "starts")).alias("p"))
    return met.select(F.col("p.ids").alias(id_key), F.col("p.starts").alias("place"), "pieces")
