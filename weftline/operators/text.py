"""Text operators on DataFrames: the expressions of weftline.functions.text as pipeline steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.plans.registry import op


def _list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


@op("normalize")
def normalize(df: DataFrame, columns: str | Sequence[str] = "text", steps: Sequence[str] = T.DEFAULT_STEPS, form: str | None = None) -> DataFrame:
    return df.withColumns({c: T.normalize(F.col(c), steps, form) for c in _list(columns)})


@op("segment")
def segment(df: DataFrame, columns: str | Sequence[str] = "text", merge_lines: str = "never", keep_short: bool = False) -> DataFrame:
    return df.withColumns({c: T.segment(F.col(c), merge_lines, keep_short) for c in _list(columns)})


@op("chunk")
def chunk(df: DataFrame, text: str = "text", size: int = 1000, len_func: str = "len_chars", into: str = "chunk", chunk_key: str = "chunk_id") -> DataFrame:
    """A row for each chunk of at most `size`, numbered from 0."""
    parts = T.chunk(F.col(text), size, T.LENGTHS[len_func])
    return df.select(*[c for c in df.columns if c != text], F.posexplode(parts).alias(chunk_key, into))


@op("tokenize")
def tokenize(df: DataFrame, columns: str | Sequence[str] = "text", lowercase: bool = False) -> DataFrame:
    """Words of each line joined by one space, lines kept."""
    return df.withColumns({c: T.per_line(F.col(c), lambda x: F.array_join(T.tokenize(x, lowercase), " ")) for c in _list(columns)})


@op("extract_tokens")
def extract_tokens(df: DataFrame, columns: str | Sequence[str] = "text", include: Sequence[str] = (), exclude: Sequence[str] = (), stopwords: Sequence[str] = (), strip_pos: bool = True) -> DataFrame:
    """Of each line's tokens `surface/POS`, those whose POS passes."""
    return df.withColumns({c: T.per_line(F.col(c), lambda x: F.array_join(T.pos_filter(T.words(x), include, exclude, stopwords, strip_pos=strip_pos), " ")) for c in _list(columns)})


@op("filter_stopwords")
def filter_stopwords(df: DataFrame, stopwords: Sequence[str], columns: str | Sequence[str] = "text", lowercase: bool = True) -> DataFrame:
    return df.withColumns({c: T.per_line(F.col(c), lambda x: F.array_join(T.drop_stopwords(T.words(x), stopwords, lowercase), " ")) for c in _list(columns)})


@op("keep_language")
def keep_language(df: DataFrame, keep: Sequence[str], lang: str = "lang", score: str | None = None, min_score: float = 0.5, literal: bool = False) -> DataFrame:
    """Rows in a kept language (nulls too). With literal, the rule as written elsewhere: a row goes only if foreign and its score is low."""
    foreign = ~F.coalesce(F.col(lang).isin(list(keep)), F.lit(True))
    if literal and score:
        return df.where(~(foreign & (F.col(score) < min_score)))
    return df.where(~foreign)


@op("replace_sequences")
def replace_sequences(df: DataFrame, column: str, sequences: dict[str, str]) -> DataFrame:
    """Runs of words in an array of tokens, given as "a b", become one token; longer runs first."""
    joined = F.concat(F.lit("\x01"), F.array_join(column, "\x01\x01"), F.lit("\x01"))
    for seq in sorted(sequences, key=lambda s: (-len(s.split()), s)):
        joined = F.replace(joined, F.lit("\x01" + "\x01\x01".join(seq.split()) + "\x01"), F.lit("\x01" + sequences[seq] + "\x01"))
    return df.withColumn(column, F.filter(F.split(joined, "\x01+"), lambda t: t != ""))


@op("speaker")
def speaker(df: DataFrame, text: str = "text", into: str = "speaker", pattern: str = r"^\s*((?:MR|MS|MRS|CHAIRMAN|CHAIR|VICE CHAIRMAN|VICE CHAIR)\.? [A-Z'\-]+)\.") -> DataFrame:
    """The speaker named at the start of a section, or null."""
    found = F.regexp_extract(text, pattern, 1)
    return df.withColumn(into, F.when(found != "", found))


@op("bio_labels")
def bio_labels(df: DataFrame, tokens: str, tags: str, into: str = "labels") -> DataFrame:
    """B-/I-/O labels of an array of types (null or "O": outside): a run of one type begins with B-."""
    t = F.transform(F.col(tags), lambda x: F.coalesce(x, F.lit("O")))
    before = F.concat(F.array(F.lit("O")), F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))))
    return df.withColumn(into, F.zip_with(t, before, lambda x, b: F.when(x == "O", "O").otherwise(F.concat(F.when(x == b, "I-").otherwise("B-"), x))))


@op("repeated_sentences")
def repeated_sentences(df: DataFrame, text: str = "text", min_chars: int = 0, min_words: int = 0, skip: Sequence[str] = (), min_sentences: int = 0) -> DataFrame:
    """In every paragraph, sentences (lines) once each, without those too short or of a skipped pattern; empty documents and those of too few sentences go."""

    def keep(line):
        ok = (F.length(line) >= min_chars) & (F.size(T.words(line)) >= min_words)
        for p in skip:
            ok = ok & ~F.rlike(line, F.lit(p))
        return ok

    paragraphs = F.transform(F.split(text, "\n\n", -1), lambda p: F.array_distinct(F.filter(F.split(p, "\n", -1), lambda x: (F.trim(x) != "") & keep(x))))
    full = F.filter(paragraphs, lambda p: F.size(p) > 0)
    rows = df.withColumn("__n", F.size(F.flatten(full))).withColumn(text, F.array_join(F.transform(full, lambda p: F.array_join(p, "\n")), "\n\n"))
    return rows.where((F.col("__n") >= min_sentences) & (F.col(text) != "")).drop("__n")


@op("slice_between")
def slice_between(df: DataFrame, markers: DataFrame, text: str = "text", begin: str = "begin", end: str = "end") -> DataFrame:
    """For each row and marker pair found in it, the text from the begin marker up to the end marker (or the text's end). markers is a small lookup."""
    joined = df.join(markers, F.contains(text, begin))
    rest = F.expr(f"substring(`{text}`, locate(`{begin}`, `{text}`))")
    stop = F.expr(f"locate(`{end}`, {text}, locate(`{begin}`, `{text}`) + length(`{begin}`))")
    return joined.withColumn("section", F.when(stop > 0, F.substring(rest, F.lit(1), stop - F.expr(f"locate(`{begin}`, `{text}`)"))).otherwise(rest))
