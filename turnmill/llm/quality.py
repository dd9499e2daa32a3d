"""Per-document text quality statistics and the kind of text they tell.

Each text is measured whole, line by line and word by word, in Arrow batches.
Which documents are no prose is told by an ordered rule list, induced by
incremental reduced-error pruning (:mod:`turnmill.llm.rules`) on ``SAMPLE``
labelled documents and exported to one SQL ``CASE``, which is applied natively.

Defined results: NULL, empty and blank texts have NULL statistics and no class;
repeated rows count once; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm import rules
from turnmill.llm.samples import labelled_documents

#: Bound of the labelled sample that the rules are induced on.
SAMPLE = 6000

# Common words of running English and Chinese.
COMMON_ENGLISH = "the of and to a in is that it was for on are as with they be at this have from or one had by but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look more go see no way could people my than first been call who its now find long down day did get come made may part"
COMMON_CHINESE = "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实"
_COMMON = frozenset(COMMON_ENGLISH.split()) | frozenset(COMMON_CHINESE)

#: Statistics in the order of their columns; shares are of non-blank characters, of words or of lines.
STATISTICS = [
    "n_chars", "n_words", "mean_word", "distinct_words", "repetition", "letter_share", "digit_share", "symbol_share", "garble_share",
    "rare_share", "vowel_share", "common_share", "n_lines", "ended_share", "marked_share", "short_share", "row_share", "inline_share", "run_length",
]
#: Those that rules may use: the others tell the size or the subject of a text rather than its kind.
TELLING = ["repetition", "noise_share", "garble_share", "rare_share", "odd_share", "row_share", "item_share", "code_share"]
STATISTICS += ["noise_share", "odd_share", "item_share", "code_share"]
#: A text can be the same few words over and over if so many different words make up three quarters of it.
FEW = 25

_WORD = re.compile(r"[^\W\d_\u3400-\u9fff\uf900-\ufaff]+|[\u3400-\u9fff\uf900-\ufaff]")
_HAN = re.compile(r"[\u3400-\u9fff\uf900-\ufaff]+")
_WRONG = r"\x80-\xff\ufffd\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u2022\u2026\u2030\u2039\u203a\u20ac\u2122"
_GARBLE = re.compile(rf"[\x80-\xff\ufffd][{_WRONG}]+|[\ufffd\x00-\x08\x0e-\x1f]")
_MARK = re.compile(
    r"(?:[-*\u2022\u00b7\u2023\u25aa\u25e6\u25cf\u25cb\u2014\u2013]|\[[ xX]?\])\s+\S|[(\uff08]?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4})[.)\uff09\u3001]\s*\S"
    r"|[\uff08(][零〇一二三四五六七八九十百]{1,3}[)\uff09]|[零〇一二三四五六七八九十]{1,3}\u3001|\d{1,2}:\d\d[ \t]+(?!-->)\S"
)
_SENTENCE_INSIDE = re.compile(r"[。！？]|[^\W\d_]{2}[.!?](?:\s|$)")
_INNER = re.compile(r"[,，。！？!?;；、|\t=<>]|\.\s")
_TAG = re.compile(r"</?(?:table|thead|tbody|tr|td|th)\b", re.I)
_PAIR = re.compile(r"[^\s=]=(?:\S|\s|$)")
_GAP = re.compile(r"\S {3,}\S")
_CODE = re.compile(r"(?<![^\s])(?:[0-9a-f]{2}|[0-9a-f]{8}|[A-Za-z0-9+/=]{30,})(?![^\s])")
_ENDS = frozenset(".。！？!?…;；")
_ODD = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}|^[^aeiouy]{3,}$|^.{25,}$")


class _Odd(dict):
    """Whether a word looks like no word: no vowel, five consonants on end, or very long."""

    def __missing__(self, word: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        self[word] = odd = _ODD.search(word) is not None
        return odd


_odd = _Odd()


@cache
def common_ideographs() -> frozenset[str]:
    """The commonest 3,755 ideographs, by the rule of their national standard's first level."""
    cells = (bytes([row, cell]) for row in range(0xB0, 0xD8) for cell in range(0xA1, 0xFF) if (row, cell) < (0xD7, 0xFA))
    return frozenset(c.decode("gb2312") for c in cells)


def is_row(line: str) -> bool:
    """Whether a stripped line is a row of columns or fields."""
    if line[0] in "|+" and line[-1] in "|+" and len(line) > 2:
        return True
    if line[0] == "<" and _TAG.match(line):
        return True
    if "\t" in line and not _SENTENCE_INSIDE.search(line):
        return True
    if line.count("=") > 1 and len(_PAIR.findall(line)) > 1 and not _SENTENCE_INSIDE.search(line):
        return True
    for comma in (",", ";"):
        n = line.count(comma)
        if n and comma + " " not in line and max(map(len, line.split(comma))) <= 40 and not _SENTENCE_INSIDE.search(line):
            return True
    return "   " in line and _GAP.search(line) is not None and not _SENTENCE_INSIDE.search(line)


def measure(text: str | None) -> list[float] | None:
    """The statistics of one text; None without text."""
    if text is None or not text.strip():
        return None
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    low = text.lower()
    runs = text.split()
    n = sum(map(len, runs))
    words = _WORD.findall(low)
    letters, counts = sum(map(len, words)), Counter(words)
    distinct, core, covered = len(counts), 0, 0
    for core, k in enumerate(sorted(counts.values(), reverse=True), 1):  # noqa: B007
        covered += k
        if covered * 4 >= 3 * len(words):
            break
    han = "".join(_HAN.findall(text))
    latin = letters - len(han)
    rare = 0
    if len(han) * 5 > letters:
        common = common_ideographs()
        rare = sum(k for ch, k in Counter(han).items() if ch not in common)
    digits = sum(map(text.count, "0123456789"))
    vowels = sum(map(low.count, "aeiou"))
    garble = sum(map(len, _GARBLE.findall(text))) if not text.isascii() else 0
    n_lines = rows = ended = 0
    marked = short = inline = other = 0.0
    changes = text.startswith("+ ") or "\n+ " in text  # lines of a comparison: their signs mark no items
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            continue
        if changes and line[:2] in ("+ ", "- "):
            line = line[2:].strip() or "."
            quoted = True
        else:
            quoted = False
        n_lines += 1
        size = len(line)
        last = line[-1]
        ended += last in _ENDS
        if is_row(line):
            rows += 1
        elif quoted:
            other += 1
        elif size > 30 and (numbers := _numbered(line)):
            inline += numbers
        elif _MARK.match(line):
            marked += 1
        elif (size <= 15 or size <= 45 and line.isascii()) and last not in "!?！？>" and line[0] not in ">#[(【（" and not _INNER.search(line, 0, size - 1):
            short += 1
        else:
            stops = line.count("。") + line.count("！") + line.count("？") + line.count(". ") + line.count("? ") + line.count("! ")
            items, least = line.count("、"), 4
            if items < least:
                items, least = max(line.count("；"), line.count("; "), line.count(", "), line.count(" / "), line.count("，") if stops == 0 else 0), 5
            if items >= least and items > 3 * stops and size / (items + 1) <= 36:
                inline += max(items, 4)
            else:  # as many units as sentences, and no fewer than its width tells
                other += max(1, stops, (size if line.isascii() else size + 2 * len("".join(_HAN.findall(line)))) // 100)
    if marked + short + inline < 3:  # fewer make no list
        marked, short, inline, other = 0.0, 0.0, 0.0, other + marked + short + inline
    units = marked + short + inline + other or 1.0
    latin_words = [w for w in counts if w.isascii()]
    share, coarse = lambda x: round(x, 2), lambda x: round(x, 1)
    return [
        n, len(words), letters / max(1, len(words)), distinct, float((len(words) // core).bit_length()) if 0 < core <= FEW and len(words) >= 6 * core else 0.0, letters / n, digits / n,
        share((n - letters - digits) / n), coarse(garble / n), coarse(rare / max(1, len(han))), vowels / max(1, latin),
        sum(map(_COMMON.__contains__, words)) / max(1, len(words)), n_lines, ended / n_lines, share(marked / units), share(short / units), share(rows / n_lines),
        share(inline / units), max(map(len, runs)), max(0.5, coarse((n - letters - digits) / n)),
        coarse(sum(map(_odd.__getitem__, latin_words)) / len(latin_words) if latin * 3 > letters and latin_words else 0.0),
        share((marked + short + inline) / units), coarse(sum(map(len, _CODE.findall(text))) / n),
    ]


_NUMBER = re.compile(r"(?<![^\s])[(\uff08]?(\d{1,2}|[a-z])[)\uff09.][ ]?(?=\S)")


def _numbered(line: str) -> int:
    """How many items the line counts off: 1) ... 2) ... 3) ..., if at least four."""
    found = _NUMBER.findall(line) if ")" in line or "）" in line or "2." in line else ()
    return len(set(found)) if len(set(found)) >= 4 else 0


def statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the columns of ``STATISTICS`` of each row."""
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = df.schema[key].dataType
    arrow_key = to_arrow_type(key_type)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([None if r is None else float(r[i]) for r in rows], pa.float64()) for i in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow_key), *columns], [key, *STATISTICS])

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    return rows.mapInArrow(work, f"`{key}` {key_type.simpleString()}, " + ", ".join(f"{c} double" for c in STATISTICS))


@cache
def fitted_case(sample: int = SAMPLE, seed: int = 7) -> str:
    """The rule list induced on the labelled sample, as a SQL ``CASE`` over ``STATISTICS``."""
    rows = labelled_documents(sample, seed)
    x = rules.matrix([measure(t) for t, _ in rows], [STATISTICS.index(c) for c in TELLING])
    fit = rules.induce(x, [label for _, label in rows], TELLING, default="prose", order=["table", "junk", "list"], seed=seed)
    return rules.to_sql(fit, "prose")


def classified(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics and ``text_class`` (prose, list, table or junk; NULL without text) of each row."""
    return statistics(documents, key, text).withColumn("text_class", F.when(F.col("n_chars").isNotNull(), F.expr(fitted_case())))


def found_classes(documents: DataFrame) -> DataFrame:
    """The documents that are not prose."""
    return classified(documents).where("text_class != 'prose'").select("doc_id", "text_class").distinct()
