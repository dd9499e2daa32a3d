"""What a segment repeats of the end of the one before is hidden from display.

The canonical transcript is never changed: the result is a display text with the
provenance of what it hides.  Only overlaps that were spoken twice for certain
are hidden: provider times overlap by a quarter of a second, one speaker, the
same characters at a sentence's beginning, nothing critical or conditional in
them, and not more than can be said in the overlap.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.functions import lexicon as lx
from turnmill.functions import text as tx
from turnmill.operators.timeline import SESSION, in_order, temporal_overlap

# Least units of a certain overlap, speeds of speech, tolerance, and connectors that mean something in technical words.
LEAST_CJK, LEAST_LETTERS, LEAST_LONG_WORD = 4, 10, 12
CJK_PER_SECOND, LETTERS_PER_SECOND, WORDS_PER_SECOND, TOLERANCE = 12, 30, 6, 0.2
TECHNICAL = frozenset(["+", "*", "#", "@", "%", ":", "\\"])
_CJK = re.compile("[㐀-鿿豈-﫿぀-ヿ가-힯]")
_QUALIFIER = re.compile(lx.UNSAFE_QUALIFIER.replace("\\x{", "\\u{").replace("\\u{a0}", "\\xa0").replace("\\u{1680}", "\\u1680").replace("\\u{2000}", "\\u2000").replace("\\u{200a}", "\\u200a").replace("\\u{2028}", "\\u2028").replace("\\u{2029}", "\\u2029").replace("\\u{202f}", "\\u202f").replace("\\u{205f}", "\\u205f").replace("\\u{3000}", "\\u3000").replace("\\u{feff}", "\\ufeff"))
_FACT = re.compile(tx.FACT_PATTERN.replace("(?iu)", "(?i)"))


def _kind(ch: str) -> str:
    return unicodedata.category(ch)[0]


def units(text: str) -> list[tuple[str, int, int]]:
    """The folded characters that are compared, each with the source span of its grapheme."""
    graphemes: list[list] = []
    for i, ch in enumerate(text):
        if graphemes and _kind(ch) == "M":
            graphemes[-1][0] += ch
            graphemes[-1][2] = i + 1
        else:
            graphemes.append([ch, i, i + 1])
    word = lambda k: 0 <= k < len(graphemes) and all(_kind(c) in "LN" for c in unicodedata.normalize("NFKC", graphemes[k][0]))
    out = []
    for k, (value, a, b) in enumerate(graphemes):
        for ch in unicodedata.normalize("NFKC", value).lower():
            if _kind(ch) in "LNMS" or ch == "‍":
                out.append((ch, a, b))
            elif (ch in "'’._/&" or unicodedata.category(ch) == "Pd") and word(k - 1) and word(k + 1):
                out.append(("'" if ch == "’" else "-" if unicodedata.category(ch) == "Pd" else ch, a, b))
            elif ch in TECHNICAL and (word(k - 1) or word(k + 1)):
                out.append((ch, a, b))
    return out


def runs(text: str) -> list[str]:
    """Units that stand together in the source."""
    out: list[str] = []
    end = -1
    for value, a, b in units(text):
        if out and a <= end:
            out[-1] += value
        else:
            out.append(value)
        end = max(end, b)
    return out


def longest_overlap(left: list[str], right: list[str]) -> int:
    """The longest proper suffix of ``left`` that begins ``right``, by the prefix function of both end to end."""
    both = [*right, None, *left]
    border = [0] * len(both)
    for i in range(1, len(both)):
        k = border[i - 1]
        while k and both[i] != both[k]:
            k = border[k - 1]
        border[i] = k + 1 if both[i] == both[k] else 0
    return min(border[-1], len(right)) if both else 0


def _measure(folded: str, source: str) -> tuple[int, int, int]:
    cjk = len(_CJK.findall(folded))
    letters = sum(_kind(c) in "LN" for c in folded) - cjk
    words = sum(1 for r in runs(source) if any(_kind(c) in "LN" for c in r) and not all(_CJK.match(c) for c in r))
    return cjk, letters, words


def hidden_overlap(left: str, right: str, seconds: float) -> tuple[int, int, int, int] | None:
    """``(left start, left end, right end, hidden end)`` of a certain overlap, or None."""
    lu, ru = units(left), units(right)
    n = longest_overlap([u[0] for u in lu], [u[0] for u in ru])
    if not n or (n < len(lu) and lu[-n - 1][1] == lu[-n][1]) or (n < len(ru) and ru[n - 1][1] == ru[n][1]):
        return None
    a, z, s, e = lu[-n][1], lu[-1][2], ru[0][1], ru[n - 1][2]
    folded, said, again = "".join(u[0] for u in ru[:n]), left[a:z], right[s:e]
    context = re.split("[。！？!?\n]", left[:a])[-1][-200:]
    before, after = left[:a].strip(), left[z:].strip()
    cjk, letters, words = _measure(folded, again)
    alike = unicodedata.normalize("NFC", said) == unicodedata.normalize("NFC", again) and runs(said) == runs(again)
    plain = not (_FACT.search(unicodedata.normalize("NFKC", again).lower()) or _FACT.search(unicodedata.normalize("NFKC", context).lower()))
    sure = not (_QUALIFIER.search(context) or _QUALIFIER.search(again))
    unwrapped = not (before and not units(before)) and not (after and not re.fullmatch("[、，。．：；,.:;]", after)) and not re.search("[!?！？؟]", left[z:])
    edge = lambda c: not c or _kind(c) not in "LNMC"
    whole = not any(_kind(c) in "LN" for c in folded) or (edge(left[a - 1 : a]) and edge(right[e : e + 1]))
    spoken = re.findall(r"[^\W_]+(?:['’\-‐-―][^\W_]+)*", again)
    count = sum(_kind(c) == "L" for c in folded)
    strong = cjk >= LEAST_CJK or cjk == 0 and count >= LEAST_LETTERS and (len(spoken) >= 2 or count >= LEAST_LONG_WORD)
    head = left[:a].rstrip()
    stands = not units(head) or re.search("[。！？!?؟.][”’\"'）)\\]]*$", head) is not None
    led = right[:s].strip()
    fits = max(cjk / CJK_PER_SECOND, letters / LETTERS_PER_SECOND, words / WORDS_PER_SECOND) <= seconds + TOLERANCE
    if not (alike and plain and sure and unwrapped and whole and strong and stands and fits) or (led and not units(led)):
        return None
    m = re.match(r"\s*(?:[、，。,](?:\s*)|[．：；.:;](?:\s+|$))?", right[e:])
    hidden = e + (m.end() if m and m.group().strip() else len(right[e:]) - len(right[e:].lstrip()))
    rest = right[hidden:].strip()
    if folded in "".join(u[0] for u in units(right[hidden:])):
        return None
    if rest and (_kind(rest[0]) in "PMSC" or not units(rest) or cjk > 8 or words > 4):
        return None
    return a, z, e, hidden


_RESULT = T.StructType([T.StructField(n, T.IntegerType()) for n in ("matched_start", "matched_end", "source_end", "hidden_end")])


@F.pandas_udf(_RESULT)
def _hidden(left: pd.Series, right: pd.Series, seconds: pd.Series) -> pd.DataFrame:
    rows = [hidden_overlap(a, b, s) if a and b else None for a, b, s in zip(left, right, seconds)]
    return pd.DataFrame([r or (None,) * 4 for r in rows], columns=["matched_start", "matched_end", "source_end", "hidden_end"], dtype="Int32")


def display_projection(norm: DataFrame) -> DataFrame:
    """Display texts and the provenance of what each hides; only overlapping pairs of one speaker reach Python."""
    w = in_order()
    rows = temporal_overlap(norm)
    key = lambda c: F.trim(F.regexp_replace(F.lower(tx.nfkc(c)), f"{tx.S}+", " "))
    pair = F.col("overlaps") & (key(F.col("speaker")) == key(F.lag("speaker").over(w)))
    rows = rows.withColumn("left_", F.when(pair, F.lag("text").over(w))).withColumn("left_id", F.lag("segment_id").over(w))
    rows = rows.withColumn("h", _hidden.asNondeterministic()(F.col("left_"), F.when(F.col("left_").isNotNull(), F.col("text")), F.col("overlap_seconds")))
    hides = F.col("h.hidden_end").isNotNull()
    return rows.select(
        "segment_id", *SESSION, "pos", F.when(hides, tx.js_trim(F.substring(F.col("text"), F.col("h.hidden_end") + 1, F.char_length("text")))).otherwise(F.col("text")).alias("display_text"),
        F.when(hides, F.col("left_id")).alias("matched_segment_id"), "h.matched_start", "h.matched_end", "h.source_end", "h.hidden_end",
    )
