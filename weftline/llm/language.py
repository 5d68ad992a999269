"""Language identification by words first, backing off to ever shorter character n-grams.

A word that the training documents had is scored by its log frequency in each language. A word that they
had not falls back to its padded character n-grams of length 4; where fewer than half of those are known,
to length 3, then 2, then 1. A run of over LONG letters (a sentence without spaces) is scored by the n-grams of
pieces of about PIECE letters, each of which counts as a word. A document's score adds its words'; the posterior is tempered by length.

The counts come from Spark over at most about `docs_per_lang` training documents of each language (a documented
bound of the fit, dealt by a hash of the row key). All words and n-grams of those are kept, of every language, as one
matrix of log frequencies; only the sample bounds what is shipped to the executors.

Defined cases: null text or text without a letter gives `und` with score 0.0; no training document at all
gives `und` everywhere; ties go to the language that sorts first; repeated rows are each predicted; extra
columns are ignored; very long texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import held_out, slices, written

GRAMS = (4, 3, 2, 1)
UND = "und"
#: Languages up to which their sizes are broadcast to the rows.
BROADCAST = 100_000
#: Letters of a run up to which it counts as one word, and of the pieces of a longer one.
LONG, PIECE = 40, 10
_LETTERS = regex.compile(r"\p{L}+")
#: Words at which the evidence of a document counts in full; more do not make the posterior sharper.
FULL_WORDS = 60


def training_rows(docs: DataFrame, train: Column, docs_per_lang: int) -> DataFrame:
    """At most about docs_per_lang (text, lang) rows of each language, chosen by hash."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-sizes")
    share = F.lit(float(docs_per_lang)) / F.col("n")
    spread = (F.xxhash64(F.col("doc_id"), F.lit(11)).cast("double") / F.lit(2.0**64)) + 0.5
    few = counts.count() <= BROADCAST
    return rows.join(F.broadcast(counts) if few else counts, "lang").where(spread < share).select("lang", "text")


def fit(docs: DataFrame, train: Column, docs_per_lang: int = 1500) -> dict:
    """Languages, and for words and n-grams of each length their keys and a matrix of log frequencies (keys x languages)."""
    rows = training_rows(docs, train, docs_per_lang)
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    counts = written(rows.select("lang", F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "language-words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    model = {"langs": langs, "words": _logs(counts.where(F.length("word") <= LONG), "word", langs, totals), "grams": {}}
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    # Runs of any length, in parts that are continued by the n - 1 letters after them, so that no n-gram is lost and substrings stay cheap.
    part, after = (F.regexp_extract_all(padded, F.lit(p), F.lit(1)) for p in (r"(?s)(.{1,500})", r"(?s).{1,500}(?=(.{0,3}))"))
    parts = counts.select("lang", "n", F.length(padded).alias("length"), F.explode(F.arrays_zip(part.alias("part"), after.alias("after"))).alias("x"))
    for n in GRAMS:
        piece = F.concat("x.part", F.substring("x.after", 1, n - 1))
        at = F.sequence(F.lit(1), F.greatest(F.length(piece) - (n - 1), F.lit(1)))
        grams = parts.select("lang", "n", "length", F.explode(F.transform(at, lambda i: piece.substr(i, F.lit(n)))).alias("gram"))
        grams = grams.where((F.length("gram") == n) | (F.col("length") < n))
        model["grams"][n] = _logs(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram", langs)
    return model


def _logs(counts: DataFrame, key: str, langs: list[str], totals: dict | None = None) -> tuple[list[str], np.ndarray]:
    """Keys in order and their log frequencies by language, with half a count for each key that was not seen; totals default to the counts' own."""
    table = counts.select(key, "lang", "n").toArrow()
    names = table.column(key).combine_chunks().dictionary_encode()
    keys = names.dictionary.to_pylist()
    order = sorted(range(len(keys)), key=keys.__getitem__)
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    at = {lang: i for i, lang in enumerate(langs)}
    found = np.zeros((len(keys), len(langs)))
    if len(keys):
        column = np.array([at[x] for x in table.column("lang").to_pylist()], np.int64)
        found[place[np.asarray(names.indices)], column] += np.asarray(table.column("n"))
    sums = np.array([float(totals[x]) for x in langs]) if totals else found.sum(axis=0)
    return [keys[i] for i in order], (np.log(found + 0.5) - np.log(sums + 0.5 * len(keys) + 1)).astype("float32")


class Scorer:
    """Scores texts against a model: words become rows of one matrix of log frequencies, summed by numpy."""

    def __init__(self, model: dict):
        parts = [np.zeros((1, len(model["langs"])), "float32")]

        def numbered(table: tuple[list[str], np.ndarray]) -> dict[str, int]:
            start = sum(map(len, parts))
            parts.append(table[1])
            return {k: start + i for i, k in enumerate(table[0])}

        self.words = numbered(model["words"])
        self.grams = [(n, numbered(model["grams"][n])) for n in GRAMS]
        self.rows = np.concatenate(parts)

    def word(self, w: str) -> list[int]:
        """The rows whose mean is the word's score: its own, or those of its longest n-grams that are known by half or more."""
        found = self.words.get(w)
        if found is not None:
            return [found]
        return self.piece(f" {w} ", 0, len(w) + 2)

    def piece(self, padded: str, start: int, stop: int) -> list[int]:
        """The rows of the longest n-grams beginning in padded[start:stop] that are known by half or more."""
        for n, table in self.grams:
            grams = [padded[i : i + n] for i in range(start, max(start + 1, min(stop, len(padded) - n + 1)))]
            hits = [v for v in map(table.get, grams) if v is not None]
            if hits and 2 * len(hits) >= len(grams):
                return hits
        return [0]

    def chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed scores and numbers of the words (letter runs, or pieces of long ones) of chunks of lower-case text."""
        rows: list[int] = []
        sizes: list[int] = []  # rows of each word
        counts: list[int] = []  # words of each chunk
        for t in texts:
            words = (t,) if t.isalpha() else _LETTERS.findall(t)
            before = len(sizes)
            for w in words:
                if len(w) <= LONG:
                    found = self.word(w)
                    rows += found
                    sizes.append(len(found))
                    continue
                padded, k = f" {w} ", len(w) // PIECE
                for i in range(k):
                    found = self.piece(padded, len(padded) * i // k, len(padded) * (i + 1) // k)
                    rows += found
                    sizes.append(len(found))
            counts.append(len(sizes) - before)
        scores = np.zeros((len(texts), self.rows.shape[1]))
        if rows:
            n, k = np.array(sizes), np.array(counts)
            means = np.add.reduceat(self.rows[np.array(rows)], np.cumsum(n) - n, axis=0) / n[:, None]
            full = k > 0
            scores[full] = np.add.reduceat(means, (np.cumsum(k) - k)[full], axis=0)
        return scores, np.array(counts, "float64")

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Summed scores (rows x languages) and word counts of texts."""
        chunks = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        flat = chunks.flatten().dictionary_encode()
        scores, sizes = self.chunks([x or "" for x in flat.dictionary.to_pylist()])
        codes = np.asarray(flat.indices) if len(flat) else np.zeros(0, int)
        ends = np.cumsum(np.asarray(pc.list_value_length(chunks)))
        starts = np.concatenate([[0], ends[:-1]])
        sums = np.zeros((len(texts), self.rows.shape[1]))
        counts = np.zeros(len(texts))
        full = ends > starts
        if full.any():
            counts[full] = np.add.reduceat(sizes[codes], starts[full])
            for j in range(sums.shape[1]):
                sums[full, j] = np.add.reduceat(scores[codes, j], starts[full])
        return sums, counts


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, in one pass over the texts and without a shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        langs = np.array(shipped.value["langs"] or [UND], dtype=object)
        for batch in slices(batches, "text"):
            sums, counts = scorer.texts(batch.column("text"))
            if sums.shape[1]:
                sums = sums * np.minimum(1.0, FULL_WORDS / np.maximum(counts, 1))[:, None]
                p = np.exp(sums - sums.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best, top = p.argmax(axis=1), p.max(axis=1)
            else:
                best, top = np.zeros(len(counts), int), np.zeros(len(counts))
            spoken = counts > 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.where(spoken, langs[best], UND), pa.string()), pa.array(np.where(spoken, top, 0.0), pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, **bounds: int) -> DataFrame:
    """Fit on rows that are not held out; predict every row: doc_id, held_out, lang_pred, score."""
    model = fit(docs.select("doc_id", "text", "lang"), ~held_out(), **bounds)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
