"""Korean text: Hanja readings, laughter repair, sentence endings. Logic with state runs in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = 0xAC00
_LEAD, _VOWEL = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ", "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
_TAIL = ["", *"ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"]


def is_syllable(c: str) -> bool:
    return "가" <= c <= "힣"


def decompose(c: str) -> tuple[str, str, str] | None:
    if not is_syllable(c):
        return None
    n = ord(c) - BASE
    return _LEAD[n // 588], _VOWEL[n % 588 // 28], _TAIL[n % 28]


def compose(lead: str, vowel: str, tail: str = "") -> str:
    return chr(BASE + _LEAD.index(lead) * 588 + _VOWEL.index(vowel) * 28 + _TAIL.index(tail))


def initial_sound(c: str, before: str = "") -> str:
    """The initial-sound rule for a syllable, given the character before it.

    At a word's start ㄴ falls to ㅇ before ㅕ ㅛ ㅠ ㅣ, ㄹ to ㅇ before ㅑ ㅕ ㅖ ㅛ ㅠ ㅣ and to ㄴ before ㅏ ㅐ ㅗ ㅚ ㅜ ㅡ. After a letter or digit only
    렬 and 률 change, and only where the syllable before has no tail or ends in ㄴ (taken as its tail's second place, ㄲ, in the table of tails).
    """
    parts = decompose(c)
    if parts is None:
        return c
    lead, vowel, tail = parts
    if before.isalnum():
        open_ = is_syllable(before) and (ord(before) - BASE) % 28 in (0, 2)
        return compose("ㅇ", vowel, tail) if c in "렬률" and open_ else c
    if lead == "ㄴ" and vowel in "ㅕㅛㅠㅣ" or lead == "ㄹ" and vowel in "ㅑㅕㅖㅛㅠㅣ":
        return compose("ㅇ", vowel, tail)
    return compose("ㄴ", vowel, tail) if lead == "ㄹ" and vowel in "ㅏㅐㅗㅚㅜㅡ" else c


def read_hanja(text: str, table: dict[str, str], mode: str = "substitution") -> str:
    """Hanja by a reading table: substitution, combination-text (漢字(한자)), combination-text-reversed or combination-html."""

    def one(m: re.Match) -> str:
        run = m[0]
        before, sound = text[m.start() - 1] if m.start() else "", ""
        for c in run:
            before = initial_sound(table.get(c, c), before)
            sound += before
        return {"substitution": sound, "combination-text": f"{run}({sound})", "combination-text-reversed": f"{sound}({run})", "combination-html": f'<span class="hanja">{run}</span><span class="hangul">({sound})</span>'}[mode]

    known = "".join(map(re.escape, table))
    return re.sub(f"[{known}]+", one, text) if known else text


def hanja_column(c: Column, table: dict[str, str], mode: str = "substitution") -> Column:
    """table is a character's reading; its size is bounded by the script."""

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else read_hanja(t, table, mode))

    return apply(c)


def fix_laughter(text: str) -> str:
    """A laughing jamo glued to a syllable as its tail is parted from it (핰ㅋㅋ to 하ㅋㅋㅋ); then runs are cut to two."""
    out = []
    for i, ch in enumerate(text):
        parts = decompose(ch)
        after = text[i + 1] if i + 1 < len(text) else ""
        if parts and parts[2] and parts[2] == after and after in "ㅋㅎㅠㅜ":
            out.append(compose(parts[0], parts[1]) + parts[2])
        else:
            out.append(ch)
    return re.sub(r"([ㄱ-ㅣ])\1{2,}", r"\1\1", "".join(out))


_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "‘": "’", "「": "」", "『": "』"}
_ENDING = re.compile(r"(?:다|요|까|죠|네|군|라|지|음|임|함)[.!?]?$|[.!?…]$")


def split_sentences(text: str) -> list[str]:
    """Sentences of Korean or other text: at end marks and endings before a space, never inside quotes or brackets; text of any length in one pass."""
    out: list[str] = []
    for line in text.splitlines():
        start, closers, word = 0, [], 0
        for i, ch in enumerate([*line, " "]):
            if closers and ch == closers[-1]:
                closers.pop()
            elif ch in _PAIRS and _PAIRS[ch] in line[i + 1 :]:
                closers.append(_PAIRS[ch])
            elif ch == " ":
                token = line[word:i]
                ends = token[-1:] in ".!?…" if not any(map(is_syllable, token)) else bool(_ENDING.search(token)) and token[-1:] in ".!?…다요까죠"
                if token and not closers and ends and i > start:
                    out.append(line[start:i].strip())
                    start = i + 1
                word = i + 1
        if line[start:].strip():
            out.append(line[start:].strip())
    return out


def sentences_column(c: Column) -> Column:
    @F.pandas_udf("array<string>")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_sentences(t))

    return apply(c)


def codes(text: str, length: int) -> list[int]:
    """Jamo codes of a text, 0 for anything else, three a character, cut or filled to `length` characters."""
    table = {x: i + 1 for i, x in enumerate(dict.fromkeys([*_LEAD, *_VOWEL, *_TAIL[1:]]))}
    out: list[int] = []
    for ch in text[:length]:
        out += [table.get(x, 0) for x in (decompose(ch) or ("", "", ""))]
    return out + [0] * (3 * length - len(out))
