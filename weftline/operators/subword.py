"""Subword vocabularies: counting in Spark over all rows, merging on the driver over a bounded word table, encoding in Arrow batches.

Training sees `max_words` distinct words, the most frequent first (a documented bound of the fit); counts cover all rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T

END = "</w>"
#: Words whose pieces a task remembers at most, and texts that it hands on at a time.
KNOWN, ROWS = 100_000, 64


def word_counts(df: DataFrame, text: str = "text", max_words: int = 50_000) -> dict[str, int]:
    """The most frequent words of all rows with their counts; ties by word."""
    counted = df.select(F.explode(T.words(F.col(text))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return {r["w"]: r["n"] for r in counted.orderBy(F.desc("n"), "w").limit(max_words).collect()}


def _pairs(words: dict[tuple, int]) -> tuple[Counter, dict]:
    counts, where = Counter(), defaultdict(set)
    for w, n in words.items():
        for p in zip(w, w[1:], strict=False):
            counts[p] += n
            where[p].add(w)
    return counts, where


def _merged(w: tuple, pair: tuple, joined: str) -> tuple:
    out, i = [], 0
    while i < len(w):
        if i + 1 < len(w) and (w[i], w[i + 1]) == pair:
            out.append(joined)
            i += 2
        else:
            out.append(w[i])
            i += 1
    return tuple(out)


def _train(words: dict[tuple, int], merges: int, rank, join) -> list[tuple[str, str]]:
    """Merge the pair of least rank, time after time; only words that hold it are counted again. rank(pair, its count, counts of pieces)."""
    counts, where = _pairs(words)
    single = Counter()
    for w, n in words.items():
        for p in w:
            single[p] += n
    found = []
    while counts and len(found) < merges:
        pair = min(counts, key=lambda p: (rank(p, counts[p], single), p))
        found.append(pair)
        for w in list(where.pop(pair, ())):
            n = words.pop(w, 0)
            if not n:
                continue
            new = _merged(w, pair, join(*pair))
            for old, sign in ((w, -n), (new, n)):
                for p in old:
                    single[p] += sign
            for p in zip(w, w[1:], strict=False):
                counts[p] -= n
                if counts[p] <= 0:
                    del counts[p]
                where[p].discard(w)
            words[new] = words.get(new, 0) + n
            for p in zip(new, new[1:], strict=False):
                counts[p] += n
                where[p].add(new)
    return found


def train_bpe(counts: dict[str, int], merges: int) -> list[tuple[str, str]]:
    """Byte-pair merges, most frequent first, ties to the smaller pair; </w> ends a word."""
    return _train({(*w, END): n for w, n in counts.items()}, merges, lambda p, n, _: -n, lambda a, b: a + b)


def _inside(a: str, b: str) -> str:
    return a + b.removeprefix("##")


def train_wordpiece(counts: dict[str, int], merges: int) -> list[str]:
    """A WordPiece vocabulary by the score f(ab) / (f(a) f(b)), ties to the smaller pair; pieces inside a word begin with ##."""
    words = {(w[0], *("##" + c for c in w[1:])): n for w, n in counts.items() if w}
    letters = {p for w in words for p in w}
    pairs = _train(words, merges, lambda p, n, single: -n / (single[p[0]] * single[p[1]]), _inside)
    return sorted(letters | {_inside(*p) for p in pairs})


def bpe_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """A word's pieces: learnt merges in the order in which they were learnt."""
    w = (*word, END)
    while len(w) > 1:
        pair = min(zip(w, w[1:], strict=False), key=lambda p: ranks.get(p, math.inf))
        if pair not in ranks:
            break
        w = _merged(w, pair, pair[0] + pair[1])
    return list(w)


def wordpiece_word(word: str, vocabulary: set[str], unknown: str = "[UNK]") -> list[str]:
    """Longest pieces first; a word with a part that is unknown is unknown as a whole."""
    out, at = [], 0
    while at < len(word):
        end = len(word)
        while end > at and (word[at:end] if not at else "##" + word[at:end]) not in vocabulary:
            end -= 1
        if end == at:
            return [unknown]
        out.append(word[at:end] if not at else "##" + word[at:end])
        at = end
    return out


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence to x >= 6, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        out -= np.where(x < 6, 1 / x, 0)
        x = np.where(x < 6, x + 1, x)
    inv = 1 / x**2
    return out + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv / 252))


def train_unigram(counts: dict[str, int], size: int, max_length: int = 8, rounds: int = 4, shrink: float = 0.75) -> dict[str, float]:
    """A unigram vocabulary's log probabilities by EM on best paths, pruned step by step to `size`; single characters stay."""
    freq: Counter = Counter()
    for w, n in counts.items():
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + max_length) + 1):
                freq[w[i:j]] += n
    keep = {p: n for p, n in freq.items() if len(p) == 1 or n > 1}

    def logs(f: dict) -> dict[str, float]:
        return dict(zip(f, (digamma(np.array(list(f.values()), float)) - digamma(np.array([float(sum(f.values()))]))).tolist(), strict=True))

    model = logs(keep)
    while True:
        for _ in range(rounds):
            seen = Counter(dict.fromkeys((p for p in model if len(p) == 1), 0.5))
            low = unknown_weight(model)
            for w, n in counts.items():
                for p in unigram_word(w, model, max_length, low):
                    seen[p] += n
            model = logs(seen)
        if len(model) <= size:
            return model
        singles = [p for p in model if len(p) == 1]
        rest = sorted((p for p in model if len(p) > 1), key=lambda p: (-seen[p], p))
        room = max(size, int(len(model) * shrink)) - len(singles)
        if room >= len(rest):
            return model
        model = logs({p: max(seen[p], 0.5) for p in [*singles, *rest[: max(room, 0)]]})
        if len(model) <= size or room <= 0:
            return model


def unknown_weight(model: dict[str, float]) -> float:
    """The weight of a character without a piece: below all pieces."""
    return min(model.values(), default=0.0) - 10


def unigram_word(word: str, model: dict[str, float], max_length: int = 8, low: float | None = None) -> list[str]:
    """The best path over pieces; characters without a piece stand alone at a low weight, which callers with many words take once from the model."""
    low = unknown_weight(model) if low is None else low
    best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - max_length), j):
            p = model.get(word[i:j], low if j - i == 1 else -math.inf)
            if best[i][0] + p > best[j][0]:
                best[j] = (best[i][0] + p, i)
    out, j = [], len(word)
    while j:
        out.append(word[best[j][1] : j])
        j = best[j][1]
    return out[::-1]


def _pieces(word: Callable[[str], list[str]]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, list[str]] = {}

        def one(t):
            if t is None:
                return None
            out: list[str] = []
            for w in t.split():
                if w not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[w] = word(w)
                out += known[w]
            return out

        for texts in batches:
            for i in range(0, len(texts), ROWS):
                yield pa.array([one(t.as_py()) for t in texts.slice(i, ROWS)], pa.list_(pa.string()))

    return run


def encode(c: Column, word) -> Column:
    """Pieces of a text's words by a function of one word, in Arrow batches; repeated words are cut once while they are remembered.

    A few texts are handed on at a time and KNOWN words remembered at most, so memory does not grow with the rows of a batch.
    """
    run = _pieces(word)

    @F.arrow_udf("array<string>")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(batches)

    return apply(c)


def decode_bpe(pieces: list[str]) -> str:
    return "".join(pieces).replace(END, " ").strip()


def padded(ids: Column, length: int, pad: int = 0) -> Column:
    """Ids cut or filled to a length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0)).cast("int"))), 1, length)
