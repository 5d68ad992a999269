"""Labels and evaluation: encoders, classification and ranking metrics, label models, error candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.sentiment import known
from weftline.plans.registry import op
from weftline.plans.tables import written


@op("label_codes")
def label_codes(df: DataFrame, column: str, into: str = "code") -> DataFrame:
    """Codes 0, 1, ... of the sorted distinct non-null labels; the label table is small and Spark's size check decides how it joins."""
    labels = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = labels.select(column, (F.row_number().over(Window.orderBy(column)) - 1).alias(into))
    return df.join(codes, column, "left")


@op("confusion")
def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n); rows with a null in either are left out."""
    return df.dropna(subset=[truth, predicted]).groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@op("classification_metrics")
def classification_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1. One pass over the rows; the rest is on counts."""
    c = confusion(df, truth, predicted)
    ends = F.array(F.struct(F.col("truth").cast("string").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("given")), F.struct(F.col("predicted").cast("string").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("given")))
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    each = c.select(F.explode(ends).alias("e"), hit.alias("hit")).select("e.*", "hit").groupBy("label").agg(F.sum("support").alias("support"), F.sum("given").alias("given"), (F.sum("hit") / 2).alias("hit"))
    p, r = F.coalesce(F.try_divide("hit", "given"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    scored = each.select("support", "hit", p.alias("p"), r.alias("r")).withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    mean = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support"))
    return scored.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"), F.sum("support").alias("n"))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token arrays as multisets."""
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))
    return F.coalesce(F.try_divide(2 * both, F.size(a) + F.size(b)), F.lit(1.0))


@op("correlations")
def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Pearson, and Spearman from average ranks; ranks are taken over distinct values' counts, dealt by range so that no task holds all values. Rows with a null in either are left out."""
    rows = df.dropna(subset=[x, y])

    def ranks(c: str, into: str) -> DataFrame:
        counts = rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")).repartitionByRange(c).withColumn("__part", F.spark_partition_id())
        counts = written(counts, "value-counts")
        earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
        before = counts.groupBy("__part").agg(F.sum("n").alias("s")).select("__part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"))
        inside = F.sum("n").over(Window.partitionBy("__part").orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
        return counts.withColumn("inside", inside).join(before, "__part").select(c, (F.col("before") + F.col("inside") - (F.col("n") - 1) / 2).alias(into))

    ranked = rows.join(ranks(x, "__rx"), x).join(ranks(y, "__ry"), y)
    return ranked.agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("pearson"), F.corr("__rx", "__ry").alias("spearman"))


@op("label_matrix")
def label_matrix(df: DataFrame, item: str, annotator: str, label: str, annotators: Sequence[str] | None = None) -> DataFrame:
    """A row for each item, a column for each annotator; the least label where one annotated twice."""
    return df.groupBy(item).pivot(annotator, list(annotators) if annotators else None).agg(F.min(label))


@op("majority_vote")
def majority_vote(df: DataFrame, item: str, label: str) -> DataFrame:
    """The most frequent label of each item; ties to the smaller label; abstentions (null) do not count."""
    counts = df.dropna(subset=[label]).groupBy(item, label).agg(F.count(F.lit(1)).alias("votes"))
    return counts.groupBy(item).agg(F.min_by(label, F.struct((-F.col("votes")).alias("v"), F.col(label).alias("l"))).alias(label), F.max("votes").alias("votes"))


@op("label_model")
def label_model(df: DataFrame, item: str, annotator: str, label: str, rounds: int = 10) -> DataFrame:
    """(item, label, probability): annotators weighted by their smoothed agreement with the current labels, in turn with weighted votes."""
    votes = df.dropna(subset=[item, annotator, label]).select(item, annotator, label)
    current = majority_vote(votes, item, label).select(item, F.col(label).alias("__now"))
    scored = None
    k = max(votes.select(label).distinct().count(), 2)
    for _ in range(rounds):
        right = F.sum(F.when(F.col(label) == F.col("__now"), 1.0).otherwise(0.0))
        skill = votes.join(current, item).groupBy(annotator).agg(((right + 1) / (F.count(F.lit(1)) + k)).alias("__a"))
        weighed = votes.join(skill, annotator).withColumn("__w", F.log(F.col("__a") * (k - 1) / (1 - F.col("__a"))))
        sums = weighed.groupBy(item, label).agg(F.exp(F.sum("__w")).alias("__e"))
        scored = sums.withColumn("probability", F.col("__e") / F.sum("__e").over(Window.partitionBy(item)))
        current = scored.groupBy(item).agg(F.min_by(label, F.struct((-F.col("probability")).alias("p"), F.col(label).alias("l"))).alias("__now"))
        current = written(current, "labels")
    best = scored.groupBy(item).agg(F.min_by(F.struct(label, "probability"), F.struct((-F.col("probability")).alias("p"), F.col(label).alias("l"))).alias("b"))
    return best.select(item, "b.*")


@op("label_errors")
def label_errors(df: DataFrame, label: str, probabilities: Sequence[str]) -> DataFrame:
    """Rows whose given label is probably wrong: another label's probability reaches that label's mean self-confidence. Least likely first.

    probabilities are columns named after the labels.
    """
    means = df.agg(*[F.avg(F.when(F.col(label) == p, F.col(p))).alias(f"__m_{p}") for p in probabilities])
    own = F.coalesce(*[F.when(F.col(label) == p, F.col(p)) for p in probabilities])
    best = F.array_max(F.array(*[F.when((F.col(p) >= F.col(f"__m_{p}")), F.struct(F.col(p).alias("p"), F.lit(p).alias("l"))) for p in probabilities]))
    rows = df.crossJoin(F.broadcast(means)).withColumn("likelihood", own).withColumn("suggested", best["l"])
    return rows.where(F.col("suggested") != F.col(label)).drop(*[f"__m_{p}" for p in probabilities]).orderBy("likelihood")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


@op("analogy")
def analogy(df: DataFrame, a: str, b: str, c: str, word: str = "word", vector: str = "vector", n: int = 10) -> DataFrame:
    """The n words nearest to vector(b) - vector(a) + vector(c) by cosine, the three themselves left out."""
    three = df.where(F.col(word).isin(a, b, c)).groupBy().agg(*[F.max(F.when(F.col(word) == w, F.col(vector))).alias(k) for k, w in zip("abc", (a, b, c), strict=True)])
    goal = F.zip_with(F.zip_with("b", "a", lambda x, y: x - y), F.col("c"), lambda x, y: x + y)
    rest = df.where(~F.col(word).isin(a, b, c)).crossJoin(F.broadcast(three.select(goal.alias("__goal"))))
    return rest.select(word, cosine(F.col(vector), F.col("__goal")).alias("score")).orderBy(F.desc("score"), word).limit(n)


@op("group_texts")
def group_texts(df: DataFrame, ids: str, order_by: str, block: int, by: str | None = None) -> DataFrame:
    """Token ids of a partition key's rows, end to end in order, cut into blocks of `block`; the rest of each key is dropped. Without `by`, keys are hash buckets of the order column."""
    key = F.col(by) if by else F.pmod(F.xxhash64(order_by), F.lit(256))
    rows = df.select(key.alias("__k"), order_by, ids)
    w = Window.partitionBy("__k").orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__at", F.coalesce(F.sum(F.size(ids)).over(w), F.lit(0)))
    # A row goes to each of its blocks as one slice, not as single tokens.
    at, end = F.col("__at"), F.col("__at") + F.size(ids)
    spread = placed.where(F.size(ids) > 0).withColumn("block", F.explode(F.sequence(F.floor(at / block), F.floor((end - 1) / block))))
    low, high = F.greatest(at, F.col("block") * block), F.least(end, (F.col("block") + 1) * block)
    cut = spread.select("__k", "block", F.struct(low.alias("a"), F.slice(ids, (low - at + 1).cast("int"), (high - low).cast("int")).alias("ids")).alias("e"))
    blocks = cut.groupBy("__k", "block").agg(F.array_sort(F.collect_list("e")).alias("x"))
    full = blocks.select(F.col("__k").alias("part"), "block", F.flatten(F.transform("x", lambda e: e["ids"])).alias(ids))
    return full.where(F.size(ids) == block)


@op("topic_coherence")
def topic_coherence(df: DataFrame, topics: DataFrame, id_key: str, tokens: str, measure: str = "u_mass") -> DataFrame:
    """(topic, coherence) of topics (topic, word, rank) by documents' co-occurrence: u_mass or c_npmi, means over word pairs."""
    words = topics.select("word").distinct()
    # The topics' words are few, as a rule: others go where they are read, and texts are cut once.
    seen = known(df.select(F.col(id_key).alias("d"), F.explode(F.array_distinct(tokens)).alias("word")), words, "word")
    seen = written(seen.join(words, "word", "left_semi"), "topic-words")
    n = F.lit(float(df.count()))
    single = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    pairs = topics.alias("x").join(topics.alias("y"), (F.col("x.topic") == F.col("y.topic")) & (F.col("x.rank") > F.col("y.rank"))).select("x.topic", F.col("x.word").alias("a"), F.col("y.word").alias("b"))
    left, right = seen.select("d", F.col("word").alias("a")), seen.select("d", F.col("word").alias("b"))
    wanted = pairs.select("a", "b").distinct()
    both = left.join(wanted, "a").join(right, ["d", "b"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("ab"))
    j = pairs.join(both, ["a", "b"], "left").join(single.select(F.col("word").alias("a"), F.col("n").alias("na")), "a", "left").join(single.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b", "left").fillna(0)
    ab = F.col("ab").cast("double")
    score = {"u_mass": F.log((ab + 1) / F.nullif(F.col("nb").cast("double"), F.lit(0.0))), "c_npmi": F.when(ab == 0, -1.0).otherwise(F.coalesce(F.try_divide(F.log(ab * n / (F.col("na") * F.col("nb"))), -F.log(ab / n)), F.lit(1.0)))}[measure]
    return j.groupBy("topic").agg(F.avg(score).alias("coherence"))
