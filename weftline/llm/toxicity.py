"""Toxicity by a weighted finite-state grammar over clauses.

A clause's words become symbols (sets of word classes). Small transducers each read symbols and write them on with a
flag more: negation, target and modal verbs within REACH words, reported speech to the clause's end, insults beside
insults. Targets and insults that follow are flagged by the same machines read from the right. `compose` feeds
each transducer's output to the next and tabulates the composed machine's states as they are met; its last part gives each
insult, and each threat after a modal verb, one pattern. A clause scores the largest product of lexeme probability and pattern
weight, and a document 1 - prod(1 - clause score). A lone lexeme is the pattern `plain`, whose weight before learning
is below any threshold in use: the written lexicon alone marks a text only through a target, a threat or several insults together.

A small written lexicon seeds the grammar. Labelled training rows, at most `max_toxic` and `max_clean`
of them (documented bounds of the fit, dealt by hash), set every lexeme's and pattern's weight and add words and stems (a prefix of
4 to 7 letters) by sequential covering: the best feature by covered toxic documents is taken while it is
significant after correction for all features tried.

Defined cases: null or empty text scores 0.0; null labels and unlabelled rows are not learnt from; a
document labelled twice counts as toxic if either label says so; without labels the seed lexicon stands;
repeated rows are each scored; extra columns are ignored; long texts are read whole, in time linear in
their length; words of any length are learnt.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import held_out, slices, written

_LETTERS = regex.compile(r"\p{L}+")
_ENDS = regex.compile(r"[.!?;:\n]")
STEMS = (4, 5, 6, 7)

INSULT = "loser idiot pathetic scum worthless moron trash clown disgusting stupid imbecile jerk scumbag bastard filth garbage dumb ugly fool idiota estúpido basura asqueroso trottel dummkopf abschaum idiotin ordure imbécile crétin".split()
THREAT = "kill hurt destroy murder strangle shoot stab burn beat matar töten tuer".split()
TARGET = frozenset("you your yours yourself u he she him her they them their this these those du dich dir ihr euch tu te vous votre ton tú usted ustedes".split())
NEGATION = frozenset("not no never none nobody nothing cannot without nicht kein keine nie ne pas jamais nunca ningún".split())
REPORTED = frozenset("said says say wrote writes called calls quoted quotes claimed claims told reported sagte schrieb dit écrit dijo escribió".split())
MODAL = frozenset("will gonna going shall should must werde werden vais voy".split())
#: Weights of the patterns before learning.
PATTERNS = {"plain": 0.5, "stacked": 0.9, "targeted": 1.0, "negated": 0.4, "reported": 0.45, "threat": 1.0}
#: Words over which a transducer's state lasts.
REACH = 4

# Word classes and flags, a bit each; a symbol is their sum.
IS_INSULT, IS_THREAT, IS_TARGET, IS_NEGATION, IS_REPORTED, IS_MODAL, NEGATED, QUOTED, AIMED, STACKED, MENACED = (1 << i for i in range(11))
_CLASSES = ((IS_TARGET, TARGET), (IS_NEGATION, NEGATION), (IS_REPORTED, REPORTED), (IS_MODAL, MODAL))


class Transducer:
    """A deterministic transducer: `step` takes (state, symbol) to (state, output); state 0 is the start."""

    def __init__(self, step: Callable[[int, int], tuple[int, int]]):
        self._step = step
        self.table: dict[tuple[int, int], tuple[int, int]] = {}

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        found = self.table.get((state, symbol))
        if found is None:
            found = self.table[state, symbol] = self._step(state, symbol)
        return found

    def run(self, symbols: list[int]) -> list[int]:
        state, out = 0, []
        for symbol in symbols:
            state, written_ = self.step(state, symbol)
            out.append(written_)
        return out


def near(trigger: int, flag: int, reach: int = REACH) -> Transducer:
    """Flags the `reach` symbols after each one of class `trigger`; its state counts those that are left."""
    return Transducer(lambda left, symbol: (reach if symbol & trigger else max(0, left - 1), symbol | flag if left else symbol))


def after(trigger: int, flag: int) -> Transducer:
    """Flags every symbol after the first of class `trigger`."""
    return Transducer(lambda seen, symbol: (1 if seen or symbol & trigger else 0, symbol | flag if seen else symbol))


def compose(*parts: Transducer) -> Transducer:
    """The machine that feeds each part's output to the next; its states number the parts' states as they are met."""
    names: dict[tuple[int, ...], int] = {(0,) * len(parts): 0}
    states = list(names)

    def step(state: int, symbol: int) -> tuple[int, int]:
        after_ = []
        for part, own in zip(parts, states[state], strict=True):
            own, symbol = part.step(own, symbol)
            after_.append(own)
        key = tuple(after_)
        if key not in names:
            names[key] = len(states)
            states.append(key)
        return names[key], symbol

    return Transducer(step)


def pattern(symbol: int) -> str | None:
    """The pattern of a symbol with all its flags, if it is a match."""
    if not (symbol & IS_INSULT or (symbol & IS_THREAT and symbol & MENACED)):
        return None
    if symbol & NEGATED:
        return "negated"
    if symbol & QUOTED:
        return "reported"
    if not symbol & IS_INSULT:
        return "threat"
    return "targeted" if symbol & AIMED else "stacked" if symbol & STACKED else "plain"


class Grammar:
    """The composed transducers with their weights: insult words and stems, threat words, pattern weights."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], threats: dict[str, float], patterns: dict[str, float]):
        self.words, self.stems, self.threats, self.patterns = words, stems, threats, patterns
        self.lengths = sorted({len(s) for s in stems})
        self.classes: dict[str, int] = {}
        for bit, lexicon in (*_CLASSES, (IS_THREAT, threats)):
            for w in lexicon:
                self.classes[w] = self.classes.get(w, 0) | bit
        self.backward = compose(near(IS_TARGET, AIMED), near(IS_INSULT, STACKED))
        self.forward = compose(near(IS_NEGATION, NEGATED), after(IS_REPORTED, QUOTED), near(IS_TARGET, AIMED), near(IS_INSULT, STACKED), near(IS_MODAL, MENACED))
        self.scan = ahocorasick.Automaton()
        for kind, lexicon in (("word", words), ("stem", stems), ("word", threats)):
            for w in lexicon:
                old = self.scan.get(w, None)
                self.scan.add_word(w, ("stem" if "stem" in (kind, old and old[0]) else "word", len(w)))
        if len(self.scan):
            self.scan.make_automaton()

    def lexeme(self, w: str) -> float:
        found = self.words.get(w, 0.0)
        for n in self.lengths:
            if len(w) < n:
                break
            found = max(found, self.stems.get(w[:n], 0.0))
        return found

    def clause(self, words: list[str]) -> list[tuple[str, float]]:
        """(pattern, lexeme probability) of each match."""
        weights = [self.lexeme(w) for w in words]
        symbols = [self.classes.get(w, 0) | (IS_INSULT if p else 0) for w, p in zip(words, weights, strict=True)]
        symbols = self.forward.run(self.backward.run(symbols[::-1])[::-1])
        found = ((pattern(x), w, p) for x, w, p in zip(symbols, words, weights, strict=True))
        return [(kind, p or self.threats[w]) for kind, w, p in found if kind]

    def matches(self, text: str | None) -> list[list[tuple[str, float]]]:
        """The matches of each clause that has any."""
        if not text or not len(self.scan):
            return []
        low = text.lower()
        hits = []
        for end, (kind, n) in self.scan.iter(low):
            start = end - n + 1
            if (start == 0 or not low[start - 1].isalpha()) and (kind == "stem" or end + 1 == len(low) or not low[end + 1].isalpha()):
                hits.append(start)
        if not hits:
            return []
        ends = [m.start() for m in _ENDS.finditer(low)]
        clauses = sorted({bisect_right(ends, h) for h in hits})
        out = []
        for c in clauses:
            piece = low[ends[c - 1] + 1 if c else 0 : ends[c] if c < len(ends) else len(low)]
            if found := self.clause(_LETTERS.findall(piece)):
                out.append(found)
        return out

    def score(self, text: str | None) -> float:
        clean = 1.0
        for found in self.matches(text):
            clean *= 1.0 - min(0.98, max(p * self.patterns[k] for k, p in found))
        return 1.0 - clean


def seeded(words: dict | None = None, stems: dict | None = None, threats: dict | None = None, patterns: dict | None = None) -> Grammar:
    """The grammar of the written lexicon, with what was learnt put over it."""
    return Grammar(dict.fromkeys(INSULT, 0.9) | (words or {}), stems or {}, dict.fromkeys(THREAT, 0.9) | (threats or {}), PATTERNS | (patterns or {}))


def training_rows(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """(doc_id, text, toxic) of a bounded sample of labelled rows that are not held out; the sampled labels are broadcast, 16 bytes a row."""
    known = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(5)), F.col("doc_id")]
    some = known.where("toxic = 1").orderBy(*order).limit(max_toxic).unionAll(known.where("toxic = 0").orderBy(*order).limit(max_clean))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(written(some, "toxicity-labels")), "doc_id")
    return written(rows, "toxicity-training")


def _prefixes(words: Column, n: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.concat(w.substr(1, n), F.lit("*")))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 4000, max_clean: int = 8000) -> Grammar:
    """Learn lexeme and pattern weights; everything sent to the driver is bounded by the sampled rows."""
    rows = training_rows(docs, labels, max_toxic, max_clean)
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    stems = [_prefixes(words, n) for n in STEMS]
    features = F.array_distinct(F.concat(F.filter(words, lambda w: F.length(w) >= 3), *stems))
    toxic_only = rows.where("toxic = 1").select(F.explode(features).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("a")).where("a >= 3")
    clean = rows.where("toxic = 0").select(F.explode(features).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("b"))
    counted = written(toxic_only.join(clean, "f", "left").select("f", "a", F.coalesce("b", F.lit(0)).alias("b")), "toxicity-features")
    tried = counted.count()
    seeds = set(INSULT) | set(THREAT)
    known = {r["f"]: (r["a"], r["b"]) for r in counted.where(F.col("f").isin(sorted(seeds))).collect()}
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    chosen = {}
    if n_toxic and n_clean:
        # A feature in `need` toxic documents is no chance find among all that were tried; no other can be taken.
        need = max(3, math.ceil((math.log(max(tried, 1)) + 1.0) / math.log((n_toxic + n_clean) / n_toxic)))
        best = counted.where(f"a > 4 * b and a >= {need}").collect()
        chosen = _cover(rows, {r["f"]: (r["a"], r["b"]) for r in best} | {k: v for k, v in known.items() if k in INSULT}, need)
    blend = lambda w: (known[w][0] + 2 * 0.9) / (sum(known[w]) + 2)
    grammar = seeded(
        words={w: blend(w) for w in known if w in INSULT} | {f: p for f, p in chosen.items() if f[-1] != "*" and f not in seeds},
        stems={f[:-1]: p for f, p in chosen.items() if f[-1] == "*"},
        threats={w: blend(w) for w in known if w in THREAT},
    )
    return _weigh(rows, grammar)


def _cover(rows: DataFrame, candidates: dict, need: int) -> dict[str, float]:
    """Sequential covering of the sampled toxic documents."""
    names = sorted(candidates)

    def run(frames):
        at = {f: i for i, f in enumerate(names)}
        for frame in frames:
            for text in frame["text"]:
                words = set(_LETTERS.findall(text.lower()))
                has = {at[w] for w in words if w in at} | {at[s] for w in words for n in STEMS if len(w) >= n and (s := w[:n] + "*") in at}
                if has:
                    yield frame.iloc[:1].assign(has=[sorted(has)])[["has"]]

    docs_of: dict[int, set] = {}
    for d, r in enumerate(rows.where("toxic = 1").select("text").mapInPandas(run, "has array<int>").collect()):
        for f in r["has"]:
            docs_of.setdefault(f, set()).add(d)
    chosen, covered = {}, set()
    while docs_of:
        new = {f: len(d - covered) for f, d in docs_of.items()}
        f = max(new, key=lambda f: (new[f] - 4 * candidates[names[f]][1], len(names[f]), names[f]))
        a, b = candidates[names[f]]
        if new[f] < need or new[f] <= 4 * b:
            break
        chosen[names[f]] = (a + 0.5) / (a + b + 1)
        covered |= docs_of.pop(f)
        docs_of = {f: d for f, d in docs_of.items() if len(d - covered) >= 3}
    return chosen


def _weigh(rows: DataFrame, grammar: Grammar) -> Grammar:
    """Set pattern weights by the share of toxic documents among those where only that pattern matched."""

    def run(frames):
        for frame in frames:
            kinds = [{k for c in grammar.matches(t) for k, _ in c} for t in frame["text"]]
            frame["kind"] = [next(iter(k)) if len(k) == 1 else None for k in kinds]
            yield frame[["kind", "toxic"]]

    counts = rows.select("text", "toxic").mapInPandas(run, "kind string, toxic int").where("kind is not null").groupBy("kind").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).collect()
    share = {r["kind"]: (r["a"] + 3 * PATTERNS[r["kind"]]) / (r["n"] + 3) for r in counts}
    grammar.patterns = {k: min(1.0, share.get(k, v)) for k, v in PATTERNS.items()}
    return grammar


def score_all(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **bounds: int) -> DataFrame:
    """Score every row: doc_id, held_out, score, predicted; one pass over the texts and no shuffle of them."""
    grammar = fit(docs, labels, **bounds)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scores = pa.array([grammar.score(t) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **bounds: int) -> DataFrame:
    """docs without the rows that score at least threshold; rows are judged where they are read, with no join."""
    grammar = fit(docs, labels, **bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array([grammar.score(t) < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
