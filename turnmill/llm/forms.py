"""One consistent form for text that looks the same but differs in its characters.

The quick-check properties of normalization say, character by character, where a
text may be unstable.  Only the unstable segments, widened to the base letter
before and the marks after them, are normalised; the canonical segments are then
spliced into the unchanged rest.

Unstable are: letters, digits and ideographs in a compatibility form (``NFKC_QC``
= No), separate combining accents (``NFC_QC`` = Maybe), spaces and hyphens other
than the plain ones, characters without width or shape, and letters of another
script inside a word.  Stable, and left as they are: words wholly in their own
script, composed letters, Chinese punctuation and quotation marks, emoji and
what joins or styles them.

Defined results: NULL stays NULL, an empty text stays empty, every text of any
length is treated whole, and the result is idempotent.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike letters of Greek and Cyrillic and their Latin twins.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u", "κ": "k",
    "ε": "e", "τ": "t", "χ": "x", "ϲ": "c", "Ϲ": "C", "ϳ": "j",
    "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "г": "r", "п": "n", "и": "u", "з": "3",
}
_BACK = {script: {v: k for k, v in reversed(LOOKALIKES.items()) if lo <= ord(k) <= hi} for script, lo, hi in (("g", 0x370, 0x3FF), ("c", 0x400, 0x52F))}

HYPHENS = "‐‑﹣－"
SPACES = "   -   　"
INVISIBLE = (
    "\\x00-\\x08\\x0e-\\x1f\\x7f-\\x84\\x86-\\x9f­͏؜ᅟᅠ឴឵᠋-᠎"
    "​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻"
    "\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)
MARKS = "̀-͎͐-ͯ᪰-᫿᷀-゙゚᷿︠-︯"
_BLANKS = frozenset("͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ")
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ"
_OTHER = "Ͱ-ͳͶ-ͽͿΆ-ϿЀ-ҁҊ-ԯ"

@cache
def _compat_class() -> str:
    """Letters, digits and ideographs whose ``NFKC_QC`` is No, as a character class."""
    out, start, prev = [], None, None
    blocks = [(0xA0, 0x250), (0x2B0, 0x300), (0x370, 0x590), (0x600, 0x700), (0xE00, 0xF00), (0x10F0, 0x1100), (0x1C80, 0x1C90), (0x1D00, 0x1DC0), (0x1E00, 0x2000), (0x2070, 0x2190), (0x2460, 0x2500), (0x2C60, 0x2E80), (0x2E80, 0x3000), (0x3003, 0x3400), (0xA640, 0xABFF), (0xF900, 0x10000), (0x1D400, 0x1D800), (0x1EE00, 0x1F300), (0x1FB00, 0x1FC00), (0x2F800, 0x2FA20)]
    for lo, hi in blocks:
        for c in range(lo, hi):
            ch = chr(c)
            plain = unicodedata.normalize("NFKC", ch)
            if plain != ch and any(x.isalnum() for x in plain) and (unicodedata.category(ch)[0] in "LN" or 0x2E80 <= c < 0x2FE0):
                if start is None:
                    start = c
                prev = c
            elif start is not None:
                out.append((start, prev))
                start = None
        if start is not None:
            out.append((start, prev))
            start = None
    # letters that only NFC changes (Angstrom, Kelvin, Ohm signs) are among them
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" if a != b else re.escape(chr(a)) for a, b in out)


# What a text of no suspects may hold, but for compatibility letters among it, as ranges of code points.
_STABLE = [
    (0x09, 0x0D), (0x20, 0x7E), (0x85, 0x85), (0xA1, 0xA7), (0xA9, 0xA9), (0xAB, 0xAC), (0xAE, 0xAE), (0xB0, 0xB1), (0xB6, 0xB7), (0xBB, 0xBB), (0xBF, 0x2AF),
    (0x2013, 0x2016), (0x2018, 0x2022), (0x2026, 0x2026), (0x2030, 0x2030), (0x2190, 0x22FF), (0x2500, 0x27BF), (0x3001, 0x3020), (0x4E00, 0x9FFF),
    (0xFF01, 0xFF0C), (0xFF0E, 0xFF0F), (0xFF1A, 0xFF20),
]


def _java_suspect() -> str:
    """A Java class of all but the stable characters; what ``_compat_class`` holds is never stable."""
    compat = re.compile(f"[{_compat_class()}]")
    out = []
    for lo, hi in _STABLE:
        start = lo
        for c in [*(c for c in range(lo, hi + 1) if compat.match(chr(c))), hi + 1]:
            if start < c:
                out.append(f"\\u{start:04x}" + (f"-\\u{c - 1:04x}" if start < c - 1 else ""))
            start = c + 1
    return "[^" + "".join(out) + "]"


#: Rows outside this Java pattern hold nothing unstable and never leave the JVM.
JAVA_SUSPECT = _java_suspect()


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    compat = _compat_class()
    unstable = re.compile(f"[{compat}{HYPHENS}{SPACES}{INVISIBLE}{MARKS}]")
    segment = re.compile(f"[^\\s{MARKS}{INVISIBLE}]?[{INVISIBLE}]*[{MARKS}]+[{MARKS}{INVISIBLE}]*|[{compat}{HYPHENS}{SPACES}{INVISIBLE}{MARKS}]+")
    both = _LATIN + _OTHER
    mixed = re.compile(f"(?<![{both}])(?:[{_LATIN}]++[{_OTHER}][{both}]*|[{_OTHER}]++[{_LATIN}][{both}]*)")
    return unstable, segment, mixed


def _is_emoji(ch: str) -> bool:
    c = ord(ch)
    return unicodedata.category(ch) in ("So", "Sk") and (0x203C <= c <= 0x3299 and not 0x2E80 <= c < 0x3000 or c >= 0x1F000) or ch in "\u203c\u2049"


def _joins_emoji(text: str, i: int) -> bool:
    """Whether the invisible or enclosing character at ``i`` only joins or styles an emoji."""
    ch = text[i]
    before = text[i - 1] if i else ""
    after = text[i + 1] if i + 1 < len(text) else ""
    if ch == "‍":
        j = i - 1
        while j >= 0 and text[j] in "️⃣":
            j -= 1
        return j >= 0 and _is_emoji(text[j]) and bool(after) and _is_emoji(after)
    if "︀" <= ch <= "️":
        return bool(before) and (_is_emoji(before) or before in "#*0123456789©®" and after in ("⃣", ""))
    if "\U000e0020" <= ch <= "\U000e007f":
        j = i - 1
        while j >= 0 and "\U000e0020" <= text[j] <= "\U000e007f":
            j -= 1
        return j >= 0 and _is_emoji(text[j])
    return False


def _fold(segment: str, text: str, at: int) -> str:
    out = []
    for k, ch in enumerate(segment):
        c = unicodedata.category(ch)
        if ch in HYPHENS:
            out.append("-")
        elif c == "Zs":
            out.append(" ")
        elif c in ("Cf", "Cc") and ch not in "\t\n\r\x0b\x0c\x85" or "\ufe00" <= ch <= "\ufe0f" or ch in _BLANKS or ch >= "\U000e0000":
            if _joins_emoji(text, at + k):
                out.append(ch)
        else:
            out.append(unicodedata.normalize("NFKC", ch))
    return unicodedata.normalize("NFC", "".join(out))


def _one_script(word: str) -> str:
    """The word in the script of its letters that have no look-alike; Latin where all have one."""
    latin = sum(1 for c in word if ord(c) < 0x250)
    greek = sum(1 for c in word if 0x370 <= ord(c) < 0x400)
    sure = [c for c in word if ord(c) >= 0x370 and c not in LOOKALIKES]
    if sure or len(word) - latin > latin and any(c in "кмтнвгпиз" for c in word):
        back = _BACK["g" if greek > len(word) - latin - greek else "c"]
        folded = "".join(back.get(c, c) for c in word)
        if not any(ord(c) < 0x250 for c in folded):
            return folded
    return "".join(LOOKALIKES.get(c, c) for c in word)


def canonical(text: str | None) -> str | None:
    """The consistent form of one text."""
    if text is None:
        return None
    unstable, _, mixed = _patterns()
    if unstable.search(text):
        text = _spliced(text)
    if mixed.search(text):
        text = mixed.sub(lambda m: _one_script(m.group()), text)
        if unstable.search(text):  # a mark may compose with the letter now before it
            text = _spliced(text)
    return text


def _spliced(text: str) -> str:
    """The text with its unstable segments normalised."""
    parts, done = [], 0
    for m in _patterns()[1].finditer(text):
        parts += (text[done : m.start()], _fold(m.group(), text, m.start()))
        done = m.end()
    parts.append(text[done:])
    return "".join(parts)


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return pd.Series([canonical(t) for t in texts], dtype=object)


def canonical_form(text: Column) -> Column:
    """Column form of :func:`canonical`; texts without suspects skip Python (they reach it as NULL)."""
    suspect = text.rlike(JAVA_SUSPECT)
    return F.coalesce(_canonical(F.when(suspect, text)), text)


def canonical_values(df: DataFrame, key: str, text: str, field: str) -> DataFrame:
    """``(field, row_id, plain, changed)`` of each distinct row of ``df``; NULL texts come out as NULL, unchanged."""
    return df.select(
        F.lit(field).alias("field"),
        F.col(f"`{key}`").cast("bigint").alias("row_id"),
        F.col(f"`{text}`").alias("raw"),
        canonical_form(F.col(f"`{text}`")).alias("plain"),
    ).withColumn("changed", F.coalesce(F.col("plain") != F.col("raw"), F.lit(False)))


def found_forms(segments: DataFrame, corrections: DataFrame) -> DataFrame:
    """The values whose characters differ from the consistent form; a repeated row counts once."""
    sides = [(segments, "segment_id", "text", "segments.text"), (corrections, "correction_id", "from_text", "corrections.from_text")]
    # rows without suspects equal their form: the filter keeps them from Python altogether
    parts = [
        canonical_values(df.where(F.col(f"`{text}`").rlike(JAVA_SUSPECT)), key, text, field).where("changed").select("field", "row_id")
        for df, key, text, field in sides
    ]
    return parts[0].unionByName(parts[1]).distinct()
