"""Text as column expressions: normalisation, predicates, lengths, segmentation, tokens. All run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's \\s matches in text, NBSP and the ideographic space included.
SPACE = r"(?U)\s+"


def quoted(literal: str) -> str:
    """A literal as a Java regular expression."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def java_replacement(text: str) -> str:
    """Python's \\1 in a replacement as Java's $1; a literal dollar is escaped."""
    return re.sub(r"\\(\d)", r"$\1", text.replace("$", r"\$"))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def replace_all(c: Column, patterns: dict[str, str]) -> Column:
    return reduce(lambda x, p: stripped(F.regexp_replace(x, p[0], java_replacement(p[1]))), patterns.items(), c)


# Normalisation, in the order in which `normalize` applies it.

# The characters that each step maps.
CONTROL = "\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f\x11\x12\x13\x14\x15\x16\x17\x18\x19\x1a\x1b"
HYPHENS = "‐‑⁃‒–—―−－⁻"
SINGLE_QUOTES, DOUBLE_QUOTES = "‘’‚‛՚Ꞌꞌ＇`´′‵", "“”„‟"
#: Primes of several strokes, and how many.
PRIMES = {"″": 2, "‶": 2, "‴": 3, "‷": 3, "⁗": 4}
SLASHES, TILDES = "⁄∕", "˜⁓∼∽∿〜～"


def _to(chars: str, target: str) -> Callable[[Column], Column]:
    return lambda c: F.translate(c, chars, target * len(chars))


remove_control_chars = _to(CONTROL, "")
fix_slashes = _to(SLASHES, "/")
fix_tildes = _to(TILDES, "~")
fix_whitespaces = _to("\x0b\x0c\x85", " ")


def fix_hyphens(c: Column) -> Column:
    """Hyphens, dashes and minus signs become "-"; soft hyphens go."""
    return F.translate(c, HYPHENS + "\u00ad", "-" * len(HYPHENS))


def uncurl_quotes(c: Column) -> Column:
    """Quotes, accents and primes become ASCII; a prime of several strokes becomes as many single quotes."""
    plain = F.translate(c, SINGLE_QUOTES + DOUBLE_QUOTES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit("'" * p[1])), PRIMES.items(), plain)


def fix_ellipsis(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("…"), F.lit("...")), F.lit(" . . . "), F.lit(" ... "))


def replace_tabs(c: Column, spaces: int = 4) -> Column:
    return F.replace(c, F.lit("\t"), F.lit(" " * spaces))


def collapse_whitespaces(c: Column) -> Column:
    """Runs of U+0020 only."""
    return F.regexp_replace(c, " +", " ")


def single_quotes_only(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit("'"))


def regular_parentheses_only(c: Column) -> Column:
    return F.translate(c, "[]{}（）", "()()()")


def repeat_normalize(c: Column, keep: int = 2) -> Column:
    """Runs of one word character longer than `keep` are cut to it."""
    return F.regexp_replace(c, rf"(?U)(\w)\1{{{keep},}}", "$1" * keep)


STEPS: dict[str, Callable[[Column], Column]] = {
    "control_chars": remove_control_chars, "hyphens": fix_hyphens, "quotes": uncurl_quotes, "ellipsis": fix_ellipsis, "slashes": fix_slashes, "tildes": fix_tildes,
    "tabs": replace_tabs, "whitespaces": fix_whitespaces, "collapse": collapse_whitespaces, "strip": stripped, "single_quotes": single_quotes_only, "parentheses": regular_parentheses_only,
    "repeats": repeat_normalize,
}
DEFAULT_STEPS = ("control_chars", "hyphens", "quotes", "ellipsis", "slashes", "tildes", "tabs", "whitespaces", "collapse", "strip")


def normalize(c: Column, steps: Sequence[str] = DEFAULT_STEPS, form: str | None = None) -> Column:
    """The named steps in the fixed order of STEPS; `form` first applies a Unicode form and unescapes HTML in an Arrow function."""
    if form:
        c = unicode_form(form)(c)
    unknown = set(steps) - set(STEPS)
    if unknown:
        raise KeyError(f"no steps {', '.join(sorted(unknown))}")
    return reduce(lambda x, name: STEPS[name](x) if name in steps else x, STEPS, c)


def unicode_form(form: str = "NFC"):
    """A pandas UDF: HTML entities unescaped, then the Unicode form; the JVM has no expression for it."""
    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        import html
        import unicodedata

        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, html.unescape(t)))

    return apply


# Predicates and scalars.


def bracket_level(c: Column, opened: str = "([{", closed: str = ")]}") -> Column:
    """Opening minus closing brackets."""
    count = lambda chars: F.length(c) - F.length(F.translate(c, chars, ""))
    return count(opened) - count(closed)


def is_punct(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^\p{P}*$"))


def is_ascii(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^\p{ASCII}*$"))


TLDS = "com|org|edu|gov|net|mil|int|info|io|co|kr|de|fr|es|uk|us|jp|cn|eu"


def like_url(c: Column) -> Column:
    """Starts with a web scheme or www, or ends in a known top-level domain after a dot, with no white space or @."""
    return F.rlike(c, F.lit(rf"^(?:https?://|www\.)\S+$|^[^\s@/]+\.(?:{TLDS})$"))


NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion".split()


def like_number(c: Column) -> Column:
    """Digits (with , and .), a fraction of digits, or a number word."""
    bare = F.translate(c, ",.", "")
    return F.rlike(bare, F.lit(r"^\d+$")) | F.rlike(bare, F.lit(r"^\d+/\d+$")) | F.lower(c).isin(NUMBER_WORDS)


def word_shape(c: Column) -> Column:
    """Letters as X or x, digits as d, runs of a class cut to four; texts of 100 characters or more are "LONG"."""
    shape = reduce(lambda x, p: F.regexp_replace(x, *p), [(r"[\p{Lu}\p{Lt}]", "\x01"), (r"[\p{Ll}\p{Lm}\p{Lo}]", "x"), ("\x01", "X"), (r"\p{Nd}", "d"), (r"(.)\1{4,}", "$1$1$1$1")], c)
    return F.when(F.length(c) >= 100, F.lit("LONG")).otherwise(shape)


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def best_substring_distance():
    """A pandas UDF: least edit distance of the first text to any substring of the second."""
    @F.pandas_udf("int")
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None:
                return None
            row = [0] * (len(y) + 1)
            for i, p in enumerate(x, 1):
                last, row[0] = row[0], i
                for j, q in enumerate(y, 1):
                    last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
            return min(row)

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return apply


def hangul_only(c: Column, english: bool = False, number: bool = False, punctuation: bool = False) -> Column:
    """Korean letters, and what the flags add; anything else is a space, runs of which collapse."""
    keep = "가-힣ㄱ-ㅎㅏ-ㅣ" + ("a-zA-Z" if english else "") + ("0-9" if number else "") + (r".,?!\"'\-" if punctuation else "")
    return stripped(F.regexp_replace(F.regexp_replace(c, f"[^{keep}]", " "), SPACE, " "))


def contains_hangul(c: Column) -> Column:
    return F.rlike(c, F.lit("[가-힣]"))


_LEADS, _VOWELS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ", "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
_TAILS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"


def jamo(c: Column) -> Column:
    """Lead, vowel and tail ("" if none) of a syllable as an array; null for anything else."""
    at = F.ascii(c) - F.lit(0xAC00)
    pick = lambda chars, i: F.substring(F.lit(chars), i.cast("int") + 1, F.lit(1))
    parts = F.array(pick(_LEADS, F.floor(at / 588)), pick(_VOWELS, F.floor((at % 588) / 28)), F.trim(pick(_TAILS, at % 28)))
    return F.when(F.rlike(c, F.lit("^[가-힣]$")), parts)


def has_final_consonant(c: Column) -> Column:
    """Whether the last character is a syllable with a tail."""
    last = F.right(c, F.lit(1))
    return F.rlike(last, F.lit("[가-힣]")) & ((F.ascii(last) - F.lit(0xAC00)) % 28 != 0)


def compose_jamo(lead: Column, vowel: Column, tail: Column) -> Column:
    """The syllable of three jamo; tail may be empty. Null where one is no jamo of its place."""
    at = lambda chars, c: F.instr(F.lit(chars), c) - 1
    end = F.when(tail == "", 0).otherwise(at(_TAILS, tail))
    code = F.lit(0xAC00) + at(_LEADS, lead) * 588 + at(_VOWELS, vowel) * 28 + end
    valid = (at(_LEADS, lead) >= 0) & (at(_VOWELS, vowel) >= 0) & (end >= 0)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


# Lengths.


def words(c: Column) -> Column:
    """Words as str.split() gives them: no empty ones."""
    return F.array_remove(F.split(c, SPACE), "")


def lines(c: Column) -> Column:
    return F.split(c, r"\r?\n", -1)


LENGTHS: dict[str, Callable[[Column], Column]] = {
    "len_bytes": lambda c: F.octet_length(c),
    "len_chars": lambda c: F.length(c),
    "len_words": lambda c: F.size(words(c)),
    "len_sents": lambda c: F.size(F.filter(lines(c), lambda x: F.trim(x) != "")),
    "len_segments": lambda c: F.size(F.filter(F.split(c, r"\n\s*\n", -1), lambda x: F.trim(x) != "")),
    "len_wospc": lambda c: F.octet_length(F.regexp_replace(c, SPACE, "")),
}


def human_bytes(c: Column) -> Column:
    """Binary units, two decimals, ties to the even digit."""
    units = ["bytes", "KiB", "MiB", "GiB", "TiB", "PiB"]
    out = F.concat(c.cast("string"), F.lit(" bytes"))
    for i in range(1, len(units)):
        out = F.when(c >= 1024**i, F.format_string(f"%.2f {units[i]}", F.bround(c / F.lit(float(1024**i)), 2))).otherwise(out)
    return out


# Stop words and tokens.


def drop_stopwords(tokens: Column, stopwords: Sequence[str], lowercase: bool = False) -> Column:
    known = F.array(*[F.lit(w.lower() if lowercase else w) for w in stopwords])
    return F.filter(tokens, lambda t: ~F.array_contains(known, F.lower(t) if lowercase else t))


def tokenize(c: Column, lowercase: bool = False) -> Column:
    return words(F.lower(c) if lowercase else c)


def per_line(c: Column, f: Callable[[Column], Column], separator: str = "\n") -> Column:
    """f applied to each line, joined again."""
    return F.array_join(F.transform(F.split(c, "\n", -1), f), separator)


def pos_filter(tokens: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), stopwords: Sequence[str] = (), delimiter: str = "/", strip_pos: bool = True) -> Column:
    """Tokens `surface/POS` by prefixes of their POS; a token of another shape always passes."""
    bar = quoted(delimiter)
    pos = lambda t: F.element_at(F.split(t, bar), -1)
    shaped = lambda t: F.size(F.split(t, bar)) == 2
    any_of = lambda t, tags: reduce(lambda a, b: a | b, [pos(t).startswith(p) for p in tags])

    def keep(t: Column) -> Column:
        ok = F.lit(True)
        if include:
            ok = ok & any_of(t, include)
        if exclude:
            ok = ok & ~any_of(t, exclude)
        return ~shaped(t) | ok

    kept = F.filter(tokens, keep)
    bare = F.transform(kept, lambda t: F.when(shaped(t), F.element_at(F.split(t, bar), 1)).otherwise(t)) if strip_pos else kept
    return drop_stopwords(bare, stopwords) if stopwords else bare


# Segmentation.


def split_sentences(line: Column) -> Column:
    """Sentences end at . ! ? (or a Korean ending with a full stop) before white space."""
    return F.filter(F.split(line, r"(?<=[.!?])(?U)\s+"), lambda s: s != "")


def long_sentence(s: Column, min_words: int = 3, min_chars: int = 10) -> Column:
    return (F.size(words(s)) >= min_words) & (F.length(s) >= min_chars)


def merge_ratio(c: Column) -> Column:
    """Whether lines look broken inside sentences: over 0.6 empty, or over 0.4 of the others not ending in a full stop."""
    ls = F.split(c, "\n", -1)
    empty = F.size(F.filter(ls, lambda x: F.trim(x) == ""))
    broken = F.size(F.filter(ls, lambda x: (F.trim(x) != "") & ~F.trim(x).endswith(".")))
    full = F.size(ls) - empty
    return (empty / F.size(ls) > 0.6) | F.coalesce(F.try_divide(broken, full) > 0.4, F.lit(False))


def segment(c: Column, merge_lines: str = "never", keep_short: bool = False, separator: str = "\n\n") -> Column:
    """Segments (split at blank lines) of lines of sentences, one to a line; merge_lines is never, always or auto."""
    collapsed = F.regexp_replace(c, r"\n(?:[ \t]*\n)+", "\n\n")

    def one(seg: Column) -> Column:
        merged = F.regexp_replace(seg, "\n", " ")
        text = {"never": seg, "always": merged, "auto": F.when(merge_ratio(seg), merged).otherwise(seg)}[merge_lines]
        sentences = F.flatten(F.transform(F.split(text, "\n", -1), split_sentences))
        kept = sentences if keep_short else F.filter(sentences, lambda x: long_sentence(x))
        return F.array_join(kept, "\n")

    return F.array_join(F.filter(F.transform(F.split(collapsed, "\n\n", -1), one), lambda s: s != ""), separator)


def chunk(c: Column, size: int, length: Callable[[Column], Column] = F.length, separator: str = "\n") -> Column:
    """Lines packed greedily into chunks of at most `size` (a longer line is a chunk of its own), as an array."""

    def add(state: Column, line: Column) -> Column:
        n = length(line)
        fits = (state["n"] + n <= size) | (state["n"] == 0)
        grown = F.struct(state["done"].alias("done"), F.when(state["n"] == 0, line).otherwise(F.concat(state["open"], F.lit(separator), line)).alias("open"), (state["n"] + n).cast("int").alias("n"))
        fresh = F.struct(F.concat(state["done"], F.array(state["open"])).alias("done"), line.alias("open"), n.cast("int").alias("n"))
        return F.when(fits, grown).otherwise(fresh)

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))
    kept = F.filter(F.split(c, "\n", -1), lambda x: x != "")
    return F.aggregate(kept, start, add, lambda s: F.when(s["n"] == 0, s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
