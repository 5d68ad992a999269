"""Lexicons of n-grams with features: which entries a text holds, how often, and scores declared as conditions, sums and an expression.

Entries are found by joins on (row, n-gram) tables, and hits that overlap are settled by joins on (row, position), so neither a text's
hits nor the lexicon are gathered anywhere; the lexicon is broadcast only where Spark's own size check allows it.

Defined cases: a null or empty text has no tokens, no hits and null scores; entries that differ in letter case only are one entry with the
greatest value of each feature; rows alike in id count as one text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import ngrams
from weftline.operators.sentiment import CLASSES, EPS, known, last_match
from weftline.plans.registry import op
from weftline.plans.tables import written


@dataclass(frozen=True)
class Score:
    """conditions: name -> SQL over an entry's features; a hit that meets one adds its count (or 1) to the name's sum. score: SQL over the sums, num_examples and eps."""

    conditions: Mapping[str, str]
    score: str
    count: bool = True
    classes: Sequence[tuple[str, float, float]] = ()


@dataclass(frozen=True)
class Lexicon:
    """How a lexicon table is read and matched. features None: all columns but words and count. tags: n-grams of several tokens need one whose text holds a tag."""

    words: str
    features: Sequence[str] | None = None
    score: str | None = None
    count: str = "count"
    lowercase: bool = False
    max_n: int = 1
    max_window: int = 1
    max_skip: int = 0
    overlaps: str = "keep"
    tags: Sequence[str] = ()
    surfaces: bool = False
    scores: Mapping[str, Score] = field(default_factory=dict)


def share(feature: str, condition: str = "{} > 0") -> Score:
    """Hits with the feature per token."""
    return Score({"feat": condition.format(f"`{feature}`")}, "feat / num_examples + eps")


_BALANCE = "(pos - neg) / (pos + neg + eps)"

# Columns, windows and policies of the published lexicons.
LM_FEATURES = ("Negative", "Positive", "Uncertainty", "Litigious", "Constraining", "Superfluous", "Interesting", "Modal")
LM = Lexicon(
    "Word", LM_FEATURES, "Negative", lowercase=True,
    scores={"polarity": Score({"pos": "Positive > 0", "neg": "Negative > 0"}, _BALANCE, True, CLASSES)} | {f.lower(): share(f) for f in LM_FEATURES[2:]},
)
HIV4 = Lexicon(
    "Entry", None, "Positiv", lowercase=True,
    scores={"polarity": Score({"pos": "Positiv is not null", "neg": "Negativ is not null"}, _BALANCE, True, CLASSES), "legal": share("Legal", "{} is not null")},
)
MPKO = Lexicon("word", ("label", "polarity", "intensity", "pos_score", "neg_score"), "polarity", max_n=5, max_window=7, max_skip=2, overlaps="longest", tags=("/NN",), surfaces=True)


def _surface(gram: Column) -> Column:
    """The tokens without their tags, run together."""
    return F.array_join(F.transform(gram, lambda t: F.substring_index(t, "/", 1)), "")


def _entries(table: DataFrame, spec: Lexicon) -> tuple[DataFrame, list[str]]:
    features = list(spec.features) if spec.features is not None else [c for c in table.columns if c not in (spec.words, spec.count)]
    word = F.lower(spec.words) if spec.lowercase else F.col(spec.words)
    key = _surface(F.split(word, ngrams.SEP)) if spec.surfaces else word
    return table.groupBy(key.alias("__key")).agg(*[F.max(f).alias(f) for f in features]).where("__key is not null"), features


def _placed(tokens: Column, spec: Lexicon) -> Column:
    """Structs of an n-gram's tokens and positions: every index pattern of the window at every start."""
    found = []
    for idx in ngrams.skip_indices(spec.max_window, spec.max_n, spec.max_skip):
        at = F.when(F.size(tokens) > idx[-1], F.sequence(F.lit(0), F.size(tokens) - 1 - idx[-1])).otherwise(F.array().cast("array<int>"))
        found.append(F.transform(at, _picked(tokens, idx)))
    return F.concat(*found)


def _picked(tokens: Column, idx: tuple[int, ...]):
    return lambda i: F.struct(F.array(*[F.get(tokens, i + k) for k in idx]).alias("gram"), F.array(*[i + k for k in idx]).alias("at"))


def _beats(policy: str) -> Column:
    """Whether hit b puts hit a aside; both have several tokens."""
    n, m, s, r = F.size("a.gram"), F.size("b.gram"), F.col("a.__s"), F.col("b.__s")
    later = F.col("b.gram") > F.col("a.gram")
    if policy == "longest":
        return (m > n) | ((m == n) & later)
    if policy == "shortest":
        return (m < n) | ((m == n) & (F.abs(r) > F.abs(s)))
    if policy == "highest_abs":
        s, r = F.abs(s), F.abs(r)
    elif policy != "highest":
        raise ValueError(f"no policy {policy}")
    return (r > s) | ((r == s) & ((m < n) | ((m == n) & later)))


def _apart(hits: DataFrame, id_key: str, policy: str) -> DataFrame:
    """Hits that no overlapping hit puts aside; single tokens go where a hit that stays covers them."""
    hits = written(hits, "lexicon-hits")
    spread = hits.withColumn("__at", F.explode("at"))
    several = spread.where(F.size("gram") > 1)
    on = (F.col(f"a.{id_key}") == F.col(f"b.{id_key}")) & (F.col("a.__at") == F.col("b.__at")) & (F.col("a.gram") != F.col("b.gram"))
    lost = several.alias("a").join(several.alias("b"), on & _beats(policy)).select(f"a.{id_key}", "a.gram", "a.at").distinct()
    kept = written(hits.where(F.size("gram") > 1).join(lost, [id_key, "gram", "at"], "left_anti"), "lexicon-kept")
    covered = kept.select(id_key, F.explode("at").alias("__at")).distinct()
    single = spread.where(F.size("gram") == 1).join(covered, [id_key, "__at"], "left_anti").drop("__at")
    return kept.unionByName(single)


@op("lexicon_entries")
def lexicon_entries(df: DataFrame, table: DataFrame, spec: Lexicon, id_key: str, tokens: str) -> DataFrame:
    """(id, words, count, one column for each feature): the lexicon's entries that each row's tokens hold."""
    entries, features = _entries(table, spec)
    t = F.transform(tokens, lambda w: F.lower(w)) if spec.lowercase else F.col(tokens)
    listed = df.select(id_key, t.alias("__t"))
    if spec.max_n == 1:
        key = _surface(F.array("words")) if spec.surfaces else F.col("words")
        held = known(listed.select(id_key, F.explode("__t").alias("words")).withColumn("__key", key), entries.select("__key"), "__key")
        counted = held.groupBy(id_key, "words", "__key").agg(F.count(F.lit(1)).alias("count"))
        return counted.join(entries, "__key").select(id_key, "words", "count", *features)
    placed = listed.select(id_key, F.explode(_placed(F.col("__t"), spec)).alias("g")).select(id_key, "g.gram", "g.at")
    if spec.tags:
        tagged = F.exists("gram", lambda w: F.greatest(*[F.contains(w, F.lit(x)) for x in spec.tags], F.lit(False)))
        placed = placed.where((F.size("gram") == 1) | tagged)
    key = _surface(F.col("gram")) if spec.surfaces else F.array_join("gram", ngrams.SEP)
    score = F.col(spec.score).cast("double") if spec.score else F.lit(None).cast("double")
    hits = known(placed.withColumn("__key", key), entries.select("__key"), "__key").join(entries, "__key").select(id_key, "gram", "at", score.alias("__s"), *features)
    if spec.overlaps != "keep":
        hits = _apart(hits, id_key, spec.overlaps)
    return hits.groupBy(id_key, F.array_join("gram", ngrams.SEP).alias("words")).agg(F.count(F.lit(1)).alias("count"), *[F.first(f).alias(f) for f in features])


@op("lexicon_scores")
def lexicon_scores(df: DataFrame, table: DataFrame, spec: Lexicon, id_key: str, tokens: str, scores: Sequence[str] = ("polarity",), min_examples: int = 5) -> DataFrame:
    """(id, num_tokens, one column for each score, and its label where it has classes) of every row.

    A score is null where no entry was found or num_tokens is not above min_examples; where classes meet, the later one wins.
    """
    hits = lexicon_entries(df, table, spec, id_key, tokens)
    sums = [F.sum(F.when(F.expr(c), F.col("count") if spec.scores[s].count else F.lit(1)).otherwise(0)).alias(f"__{s}_{name}") for s in scores for name, c in spec.scores[s].conditions.items()]
    found = hits.groupBy(id_key).agg(*sums)
    rows = df.groupBy(id_key).agg(F.sum(F.coalesce(F.size(tokens), F.lit(0))).alias("num_tokens"))
    out = rows.join(found.withColumn("__found", F.lit(True)), id_key, "left")
    columns: list[str] = []
    for s in scores:
        rule = spec.scores[s]
        inputs = {name: F.col(f"__{s}_{name}") for name in rule.conditions} | {"num_examples": F.col("num_tokens"), "eps": F.lit(EPS)}
        value = F.when(F.col("__found") & (F.col("num_tokens") > min_examples), F.expr(rule.score))
        out = out.withColumns(inputs).withColumn(s, value).drop(*inputs)
        columns.append(s)
        if rule.classes:
            out = out.withColumn(f"{s}_label", last_match(F.col(s), rule.classes))
            columns.append(f"{s}_label")
    return out.select(id_key, "num_tokens", *columns)
