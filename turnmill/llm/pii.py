"""Personal information inside free text, replaced by typed placeholders.

A skip-chain conditional random field (:mod:`turnmill.llm.field`) labels the tokens
of every text, from its first to its last, as email, phone, id_number, address,
person_name or none.  Chain potentials come from token, context, ending and format
features; skip potentials tie tokens of a text that repeat or resemble each other,
and loopy max-product message passing makes their labels agree.  All weights, those
of the skip potentials too, are trained here, on ``SAMPLE`` composed sentences
(:mod:`turnmill.llm.pii_samples`); nothing but the field decides what is a value.

Defined results: NULL stays NULL; a text without values comes out unchanged;
placeholders already there are kept; every character outside a value is kept as
it was; texts of any length are read whole; repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm import pii_samples
from turnmill.llm.field import Batch, Field, Lexicon, train
from turnmill.llm.forms import LOOKALIKES
from turnmill.llm.quality import COMMON_ENGLISH

KINDS = ["email", "phone", "id_number", "address", "person_name"]
LABELS = ["none", *KINDS]
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
#: Bound of the labelled sample, passes over it, and the least count of a feature.
SAMPLE = 50_000
PASSES = 5
LEAST_COUNT = 4
#: Characters labelled at a time; a text is never divided.
CHUNK = 1 << 18

_DIGIT_WORD = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple|plus)"
_HAN_DIGIT = "[〇零幺一二三四五六七八九]"
_STREET = "(?:street|road|avenue|lane|close|court|drive|place|square|terrace|crescent|gardens|grove|boulevard|hill|row|walk|way|parade|mews|st|rd|ave|ln|blvd)"
_HAN_STREET = "(?:路|街|巷|大道|胡同|弄|道)"
_HAN_NUMBER = r"[\d零〇一二三四五六七八九十百两]{1,5}"

#: Format features: the tokens a match covers have them.
FORMATS = {
    "mail": re.compile(r"<?[\w.+\-]+ ?@ ?[\w\-]+(?: ?\. ?[\w\-]+)+>?"),
    "said_mail": re.compile(r"\b[a-z0-9_\-]+(?: (?:dot|plus|dash|underscore) [a-z0-9_\-]+)* at [a-z0-9\-]+(?: dot [a-z0-9\-]+)+\b", re.I),
    "han_mail": re.compile(r"[A-Za-z0-9_.\-]+ ?(?:艾特|圈[aA]|＠) ?[A-Za-z0-9\-]+(?: ?点 ?[A-Za-z0-9\-]+)+|[A-Za-z0-9_\-]+(?: ?(?:点|杠|下划线) ?[A-Za-z0-9_\-]+)* ?(?:艾特|圈[aA]) ?[A-Za-z0-9\-]+(?: ?点 ?[A-Za-z0-9\-]+)+"),
    "mobile": re.compile(r"(?<![\d.\-])(?:\+?86[ \-]?)?1[3-9]\d[ \-]?\d{4}[ \-]?\d{4}(?![\d]|[.\-]\d)"),
    "phone": re.compile(r"(?<![\w.\-])(?:\+\d{1,3}[ \-.]?)(?:\(?\d{1,4}\)?[ \-.]?){2,4}\d{2,4}(?!\d)|(?<![\w.\-])\(\d{3}\) ?\d{3}[ \-.]\d{4}(?!\d)|(?<![\w.\-])\d{3}[ \-.]\d{3}[ \-.]\d{4}(?![\d]|[.\-]\d)|(?<![\w.\-])0\d{2,3}[ \-]\d{7,8}(?!\d)|(?<![\w.\-])0\d{2,4}[ \-]\d{3,4}[ \-]\d{3,4}(?![\d]|[.\-]\d)|\(0\d{2,4}\) ?\d{3,4}[ \-]?\d{3,4}(?!\d)|(?<![\w.\-])\d{10} ?(?:ext\.?|x|extension) ?\d{1,5}\b"),
    "said_number": re.compile(rf"\b(?:{_DIGIT_WORD}[ ,\-]+){{6,}}{_DIGIT_WORD}\b", re.I),
    "han_number": re.compile(rf"{_HAN_DIGIT}(?:[ 、，,\-]?{_HAN_DIGIT}){{6,}}"),
    "id18": re.compile(r"(?<![\w.\-])\d{6}[ \-]?(?:19|20)\d{6}[ \-]?\d{3}[\dXx](?![\w])"),
    "ssn": re.compile(r"(?<![\w.\-])\d{3}[ \-]\d{2}[ \-]\d{4}(?![\d]|[.\-]\d)"),
    "passport": re.compile(r"(?<![\w\-])[A-Z]{1,2} ?\d{7,8}(?!\w|-)"),
    "street": re.compile(rf"(?:\b(?:flat|unit|apartment|apt|suite|room) \w+,? )?\b\d{{1,4}}[a-z]?,? (?:[a-z'’\-]+ ){{1,3}}{_STREET}\b(?:,? (?:flat|unit|apartment|apt|suite|room) \w+)?(?:,? (?:in |at )?[A-Z][a-z]+(?: [A-Z][a-z]+)?)?", re.I),
    "han_street": re.compile(rf"(?:[㐀-鿿]{{2,4}}?市)?(?:[㐀-鿿]{{1,4}}?[区县镇])?[㐀-鿿]{{1,4}}?{_HAN_STREET} ?{_HAN_NUMBER} ?号(?: ?{_HAN_NUMBER} ?(?:号楼|栋|幢|座|单元|楼|室|层|号)){{0,4}}"),
    "ip": re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|\b(?:[0-9a-f]{0,4}:){3,}[0-9a-f]{0,4}\b", re.I),
    "weekday": re.compile("(?:周|星期|礼拜)[一二三四五六日天末](?:之?前|以?后)?"),
    "held": re.compile(r"\[[A-Z_]{2,}\]"),
}


_DIGIT_WORDS = "zero oh one two three four five six seven eight nine double triple plus"
_STREET_WORDS = "street road avenue lane close court drive place square terrace crescent gardens grove boulevard hill row walk way parade mews st rd ave ln blvd"
_QUIET = {"@": "@", "dot": "dot", "at": "at", "han at": "艾 圈", "han said": "〇 零 幺 一 二 三 四 五 六 七 八 九", "number": "号", "[": "[", "week": "周 星 礼", "points": ". :"}
#: What a text must have for a format to match in it, so that the others need not be searched.
NEEDS = {
    "mail": lambda has, digits: has("@") > 0,
    "said_mail": lambda has, digits: (has("dot") > 0) & (has("at") > 0),
    "han_mail": lambda has, digits: has("han at") > 0,
    "said_number": lambda has, digits: has("said") >= 7,
    "han_number": lambda has, digits: has("han said") >= 7,
    "street": lambda has, digits: (digits > 0) & (has("street") > 0),
    "han_street": lambda has, digits: has("number") > 0,
    "weekday": lambda has, digits: has("week") > 0,
    "ip": lambda has, digits: (digits >= 3) & (has("points") >= 3),
    "held": lambda has, digits: has("[") > 0,
    **{name: (lambda has, digits, least=least: digits >= least) for name, least in (("mobile", 11), ("phone", 7), ("id18", 17), ("ssn", 9), ("passport", 7))},
}

_CALENDAR = "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december mon tue wed thu fri sat sun"
_TITLES = "mr mrs ms miss dr prof professor sir madam"


@cache
def lexicon() -> Lexicon:
    classes = {"calendar": _CALENDAR.split(), "title": _TITLES.split(), "said": _DIGIT_WORDS.split(), "street": _STREET_WORDS.split(), "common": COMMON_ENGLISH.split()}
    quiet = {name: words.split() for name, words in _QUIET.items()}
    return Lexicon(classes, pii_samples.SURNAMES, sorted(pii_samples.COMPOUND_SURNAMES), {name: (pattern, NEEDS[name]) for name, pattern in FORMATS.items()}, quiet, ("common", "calendar"))


_STAYS = "\n -~À-ÖØ-öø-ıĴ-ľŁ-ňŊ-ž一-鿿，。！？：；（）、…“”‘’【】♪"
_PLAIN, _ODD = re.compile(f"[{_STAYS}]*"), re.compile(f"[^{_STAYS}]")


@cache
def _plain_piece(ch: str) -> str:
    """What stands for a character outside the plain ones."""
    c = unicodedata.category(ch)
    if c in ("Cf", "Cc") or "︀" <= ch <= "️":
        return "\n" if ch in "\x85" else ""
    if c == "Zs":
        return " "
    return "-" if ch in "‐‑﹣－" else unicodedata.normalize("NFKC", ch)


def plain_with_offsets(text: str) -> tuple[str, list[int] | range]:
    """The text in plain characters, and for each of its characters the place it comes from."""
    if _PLAIN.fullmatch(text):
        return text, range(len(text) + 1)
    out, at, done = [], [], 0
    for m in _ODD.finditer(text):
        i, ch = m.start(), m.group()
        if done < i:
            out.append(text[done:i])
            at += range(done, i)
        done = i + 1
        piece = _plain_piece(ch)
        out.append(piece)
        at += [i] * len(piece)
    out.append(text[done:])
    at += range(done, len(text))
    plain = "".join(out)
    if re.search("[Ͱ-ϿЀ-ԯ]", plain):  # look-alikes in Latin words or mixed into other signs
        plain = re.sub(
            r"[\wͰ-ϿЀ-ԯ.@\-]+",
            lambda m: "".join(LOOKALIKES.get(c, c) for c in m.group()) if re.search("[A-Za-z]", m.group()) else m.group(),
            plain,
        )
    at.append(len(text))
    return plain, at


@cache
def trained(sample: int = SAMPLE, seed: int = 11, passes: int = PASSES) -> Field:
    """The field, trained on the composed sentences."""
    some = pii_samples.sentences(sample, seed)
    plains = [plain_with_offsets(text) for text, _ in some]

    def gold(batch: Batch, begin: int) -> np.ndarray:
        out = np.zeros(len(batch), np.int8)
        for r, (_, spans) in enumerate(some[begin : begin + len(batch.texts)]):
            a = batch.row_start[r]
            places = [plains[begin + r][1][s - batch.text_start[r]] for s in batch.start[a : a + batch.row_size[r]]]
            for lo, hi, kind in spans:
                for i, place in enumerate(places):
                    if lo <= place < hi:
                        out[a + i] = LABELS.index(kind)
        return out

    return train([p for p, _ in plains], gold, lexicon(), len(LABELS), passes, LEAST_COUNT, seed)


def find_all(texts: list[str | None], field: Field) -> list[list[tuple[int, int, str]]]:
    """``(start, end, kind)`` of every value of each text, in characters of the text."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    same: dict[str, list] = {}
    rows = []
    for i, text in enumerate(texts):
        if text:
            if text in same:
                out[i] = same[text]
            else:
                same[text] = out[i]
                rows.append(i)
    begin = 0
    while begin < len(rows):
        end, size = begin, 0
        while end < len(rows) and (end == begin or size + len(texts[rows[end]]) <= CHUNK):
            size += len(texts[rows[end]])
            end += 1
        some = rows[begin:end]
        plains = [plain_with_offsets(texts[i]) for i in some]
        batch = Batch([p for p, _ in plains], lexicon())
        path = field.decode(batch.row, field.emissions(batch), batch.edges())
        last = -2
        for t in np.flatnonzero(path).tolist():
            r, label = int(batch.row[t]), LABELS[path[t]]
            plain, at = plains[r]
            s, e = int(batch.start[t] - batch.text_start[r]), int(batch.end[t] - batch.text_start[r])
            found = out[some[r]]
            start, stop = at[s], at[e - 1] + 1
            if last == t - 1 and found and found[-1][2] == label and path[last] == path[t] and not plain[int(batch.end[last] - batch.text_start[r]) : s].strip(" "):
                found[-1] = (found[-1][0], stop, label)
            else:
                found.append((start, stop, label))
            last = t
        begin = end
    return out


def find(text: str | None, field: Field) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of every value, in characters of ``text``."""
    return find_all([text], field)[0]


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with placeholders in place of its values."""
    parts, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            parts += [text[done:a], PLACEHOLDERS[kind]]
            done = b
    return "".join([*parts, text[done:]])


def redact(text: str | None, field: Field) -> tuple[str | None, list[str]]:
    """The text with placeholders in place of its values, and their kinds."""
    spans = find(text, field)
    return (replaced(text, spans) if spans else text), sorted({k for _, _, k in spans})


def redacted(df: DataFrame, key: str, text: str, field_name: str) -> DataFrame:
    """``(field, row_key, text, kinds)`` of each row: the text with placeholders, and the kinds it mentioned."""
    shared = df.sparkSession.sparkContext.broadcast(trained())  # trained once, on the driver; of bounded size

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = find_all(texts, field)
            kinds = [sorted({k for _, _, k in s}) for s in spans]
            texts = [replaced(t, s) if s else t for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], ["row_key", "text", "kinds"])

    # rows go through as a stream: as a column function over segments this took over half a GB of disk at 0.06 GB
    return (
        df.select(F.col(f"`{key}`").cast("string").alias("row_key"), F.col(f"`{text}`").alias("text"))
        .mapInArrow(label, "row_key string, text string, kinds array<string>")
        .select(F.lit(field_name).alias("field"), "row_key", "text", "kinds")
    )


def found_kinds(segments: DataFrame, meetings: DataFrame) -> DataFrame:
    """``(field, row_key, pii_kind)`` of every text and each kind of value it mentions."""
    shared = segments.sparkSession.sparkContext.broadcast(trained())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            pairs = [(key, kind) for key, spans in zip(batch.column(0).to_pylist(), find_all(batch.column(1).to_pylist(), field)) for kind in sorted({k for *_, k in spans})]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.string()), pa.array([k for _, k in pairs], pa.string())], ["row_key", "pii_kind"])

    parts = [
        df.select(F.col(f"`{key}`").cast("string").alias("row_key"), F.col(f"`{text}`").alias("text"))
        .where("text is not null and text != ''")
        .mapInArrow(work, "row_key string, pii_kind string")
        .select(F.lit(name).alias("field"), "row_key", "pii_kind")
        for df, key, text, name in ((segments, "segment_id", "text", "segments.text"), (meetings, "recording_id", "summary", "meetings.summary"))
    ]
    return parts[0].unionByName(parts[1]).distinct()
