"""Scalar text functions as native columns.

Lengths and offsets count code points.  White space is that of the scripting
world: the ASCII controls, every Unicode space separator and U+FEFF.
NFKC has no built-in; texts of plain characters, ideographs and full-width signs
are folded natively, the few others in an Arrow batch.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space, as the inside of a character class that Java and RE2 both read.
SPACES = r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
S = f"[{SPACES}]"

# The signs that comparable texts lose at their ends, and that correction keys lose everywhere.
END_SIGNS = "“”‘’\"'「」『』《》〈〉，。！？、；：,.!?;:()（）…"
KEY_SIGNS = "，。！？、；：“”‘’()（）,.!?;:'\"…"

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
_NATIVE = r"^[\x{0}-\x{7f}\x{2014}\x{2018}-\x{201d}\x{2026}\x{266a}\x{3001}-\x{3002}\x{3008}-\x{3011}\x{4e00}-\x{9fff}\x{ff01}-\x{ff5e}\x{3000}]*$"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Normalization form KC."""
    native = F.replace(F.translate(text, _WIDE, _NARROW), F.lit("…"), F.lit("..."))
    plain = text.rlike(_NATIVE)
    return F.when(plain, native).otherwise(_nfkc(F.when(~plain, text)))


def fold(df, *columns: str):
    """Text columns folded by NFKC in a step of their own, so that array functions may use them."""
    apart = _nfkc.asNondeterministic()
    out = {}
    for name in columns:
        t = F.coalesce(F.col(name), F.lit(""))
        plain = t.rlike(_NATIVE)
        out[name] = F.when(plain, F.replace(F.translate(t, _WIDE, _NARROW), F.lit("…"), F.lit("..."))).otherwise(apart(F.when(~plain, t)))
    return df.withColumns(out)


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{S}+|{S}+$", "")


def string_or(text: Column, default: str) -> Column:
    """The trimmed text, or a default if nothing is left."""
    return F.coalesce(F.nullif(js_trim(text), F.lit("")), F.lit(default))


def no_space(text: Column) -> Column:
    return F.regexp_replace(text, f"{S}+", "")


def _class(signs: str) -> str:
    return "".join("\\" + c if c in "\\]^-[\"'" else c for c in signs)


def comparable_text(text: Column) -> Column:
    """Folded, lower case, without white space, and without signs at both ends."""
    return folded_comparable(nfkc(F.coalesce(text, F.lit(""))))


def folded_comparable(text: Column) -> Column:
    """C1 of a text that is folded already (usable inside array functions)."""
    signs = _class(END_SIGNS)
    return F.regexp_replace(no_space(F.lower(text)), f"^[{signs}]+|[{signs}]+$", "")


def correction_text(text: Column) -> Column:
    """Folded, lower case, without white space, dashes and signs."""
    return F.regexp_replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), rf"[{SPACES}\p{{Pd}}{_class(KEY_SIGNS)}]+", "")


def term_key(text: Column) -> Column:
    """Folded, lower case, without white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), rf"[{SPACES}\p{{P}}\p{{S}}]+", "")


def mapping_alias_key(text: Column) -> Column:
    """Folded, lower case, without white space, dashes and underscores."""
    return F.regexp_replace(F.lower(js_trim(nfkc(F.coalesce(text, F.lit(""))))), rf"[{SPACES}\p{{Pd}}_]+", "")


def spelling_key(text: Column) -> Column:
    """C8 and C9."""
    return js_trim(nfkc(F.coalesce(text, F.lit(""))))


def match_text(text: Column) -> Column:
    """Folded, lower case, without white space but line ends, dashes and invisible joiners."""
    return F.regexp_replace(
        F.lower(nfkc(F.coalesce(text, F.lit("")))), r"[\t\x0B\f \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}\p{Pd}\x{ad}\x{200b}\x{2060}\x{2212}]+", ""
    )


def truncate_text(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last three dots where cut."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def middle_truncate(text: Column, most: int) -> Column:
    """Head and tail, three dots between."""
    keep = most - 3
    head = (keep + 1) // 2
    tail = keep - head
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, head), F.lit("..."), F.right(text, F.lit(tail)))).otherwise(text)


def compact(text: Column, most: int) -> Column:
    """C23."""
    return F.substring(js_trim(F.coalesce(text, F.lit(""))), 1, most)


def seconds_or_zero(value: Column) -> Column:
    """A number clamped at 0; NULL, NaN and infinities are 0."""
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(ok, F.greatest(value, F.lit(0.0))).otherwise(0.0)


def strict_timestamp(value: Column) -> Column:
    """A finite number of at least 0, else NULL."""
    v = value.try_cast("double")
    return F.when(~F.isnan(v) & (v >= 0) & (v != F.lit(float("inf"))), v)


def round_up(value: Column, scale: int) -> Column:
    """Half up toward positive infinity."""
    return F.floor(value * float(scale) + 0.5) / float(scale)


def clock(seconds: Column, vtt: bool = False) -> Column:
    """``mm:ss``, ``hh:mm:ss`` from an hour on, or ``hh:mm:ss.mmm``."""
    total = seconds_or_zero(seconds)
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    h, m, s = F.floor(total / 3600), F.floor((total % 3600) / 60), F.floor(total % 60)
    if vtt:
        return F.concat(two(h), F.lit(":"), two(m), F.lit(":"), two(s), F.lit("."), F.lpad(F.floor((total % 1) * 1000).cast("string"), 3, "0"))
    short = F.concat(two(m), F.lit(":"), two(s))
    return F.when(h > 0, F.concat(two(h), F.lit(":"), short)).otherwise(short)


def html_escape(text: Column) -> Column:
    """C56."""
    t = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(raw), F.lit(safe))
    return t


def regex_escape(text: Column) -> Column:
    """C57."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def clauses(text: Column) -> Column:
    """The non-blank clauses of a text."""
    return F.filter(F.transform(F.split(text, r"[，。；;,.!?！？\n]+"), js_trim), lambda c: c != "")


def join_texts(left: Column, right: Column) -> Column:
    """Two texts joined, a space between only where scripts ask for one."""
    a, b = F.regexp_replace(left, f"{S}+$", ""), F.regexp_replace(right, f"^{S}+", "")
    cjk = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
    l_cjk, r_cjk = a.rlike(cjk + "$"), b.rlike("^" + cjk)
    word = a.rlike(r"[\p{L}\p{N}]$") & b.rlike(r"^[\p{L}\p{N}]")
    latin = b.rlike(r"^[\p{IsLatin}\p{N}]") & a.rlike(r"[\p{IsLatin}\p{N},:;.!?]$")
    gap = (word & ~l_cjk & ~r_cjk) | latin | (l_cjk & b.rlike(r"^\p{IsLatin}"))
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.when(gap, " ").otherwise(""), b))


def strip_boundary(text: Column) -> Column:
    """Without the full stops and semicolons at the end, unless nothing else is there."""
    t = js_trim(text)
    stripped = F.regexp_replace(F.regexp_replace(t, "[。；;.]+$", ""), f"{S}+$", "")
    return F.when(stripped != "", stripped).otherwise(t)


def restore_boundary(text: Column, source: Column) -> Column:
    """The source's closing signs, where the text has none of its own."""
    t = F.regexp_replace(text, f"{S}+$", "")
    signs = F.regexp_extract(js_trim(source), "([。！？!?；;.]+)$", 1)
    return F.when((t == "") | t.rlike("[。！？!?；;.,，：:]$"), t).otherwise(F.concat(t, signs))


def retrieval_tokens(text: Column) -> Column:
    """Distinct Latin words, and runs of ideographs with their 2- to 4-grams."""
    t = F.lower(nfkc(text))
    latin = F.regexp_extract_all(t, F.lit("[a-z0-9+#]{2,}"), F.lit(0))
    runs = F.regexp_extract_all(t, F.lit(r"\p{IsHan}+"), F.lit(0))
    wide = lambda pattern: F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(pattern), F.lit(1))))
    grams = [wide(pattern) for pattern in ("(?=(.{2}))", "(?=(.{3}))", "(?=(.{4}))")]
    whole = F.filter(runs, lambda r: (F.char_length(r) <= 12) & (F.char_length(r) >= 2))
    return F.array_distinct(F.concat(latin, whole, *grams))


# Fixed value: numbers with units and dates, polarity, comparison and outcome words, in order of appearance.
FACT_PATTERN = (
    r"(?iu)[¥$€£]?[+-]?\d+(?:[.:/-]\d+)*(?:%|元|万|亿|年|月|日|点|时|分|秒)?|(?:高|低)(?:风险|成本|延迟|优先级|概率|置信度|价格|质量|性能)"
    r"|(?:风险|成本|延迟|优先级|概率|置信度|价格|质量|性能)(?:很|较|更|极|偏)?[高低]|没有|不能|不会|不可|不要|切勿|勿|不|没|无|未|非|否|拒绝|反对|禁止|支持|同意|通过|驳回|接受|否决|录用|淘汰|成功|失败|增加|减少|上升|下降"
    r"|\b(?:no|not|never|without|cannot|can't|won't|don't|doesn't|didn't|isn't|aren't|shouldn't|mustn't|support|oppose|accept|reject|approve|deny|hire|fail|increase|decrease|success|failure|high[ -]?risk|low[ -]?risk)\b"
)
# Fixed value: the further facts of meetings.
MEETING_FACT_PATTERN = "决定|确认|批准|否决|同意|通过|安排|负责|完成|上线|发布|交付|采用|选择|必须|需要|不得|取消|延期|[零一二两三四五六七八九十百千万亿]+(?:元|人|天|周|月|年|%|个|次|份|台|套)"


def ascii_edges(pattern: str) -> str:
    """The pattern for Java with word edges between ASCII word characters and others, as RE2 and scripts have them."""
    word = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))")


def critical_fingerprint(text: Column) -> Column:
    """C14: the critical facts of a text, in order, joined by bars."""
    return F.array_join(F.regexp_extract_all(F.lower(nfkc(text)), F.lit(ascii_edges(FACT_PATTERN)), F.lit(0)), "|")


_FACTS = re.compile(ascii_edges(FACT_PATTERN).replace("(?iu)", ""), re.IGNORECASE | re.ASCII)


def fact_tokens(text: str) -> list[str]:
    """C14 for one text: its critical facts in order."""
    return [m.group() for m in _FACTS.finditer(unicodedata.normalize("NFKC", text).lower())]


def meeting_facts(text: Column) -> Column:
    """The distinct critical facts of a meeting's text."""
    t = F.lower(nfkc(text))
    found = F.concat(F.regexp_extract_all(t, F.lit(ascii_edges(FACT_PATTERN)), F.lit(0)), F.regexp_extract_all(t, F.lit(MEETING_FACT_PATTERN), F.lit(0)))
    signs = _class(END_SIGNS)
    return F.filter(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(no_space(x), f"^[{signs}]+|[{signs}]+$", ""))), lambda x: x != "")


def literal_count(text: Column, term: Column) -> Column:
    """How often a literal term occurs, without overlaps."""
    return F.when(term == "", 0).otherwise(((F.char_length(text) - F.char_length(F.replace(text, term))) / F.char_length(term)).cast("bigint"))


def bounded_distance(left: Column, right: Column, limit: Column) -> Column:
    """The edit distance, or one more than the limit beyond it."""
    return F.least(F.levenshtein(left, right).cast("double"), limit + 1)


def plausible_pair(alias: Column, canonical: Column) -> Column:
    """F16: whether an alias can be a misheard form of a name."""
    a, c = correction_text(alias), correction_text(canonical)
    long = F.greatest(F.char_length(a), F.char_length(c))
    limit = F.greatest(F.lit(2.0), F.ceil(long * 0.45))
    ascii_ = r"^[a-z0-9+#]+$"
    return (
        F.when((F.char_length(a) < 3) | (F.char_length(c) < 3), False)
        .when(a == c, nfkc(alias) != nfkc(canonical))
        .when(a.rlike(ascii_) & c.rlike(ascii_) & (F.substring(a, 1, 1) != F.substring(c, 1, 1)), False)
        .otherwise(F.levenshtein(a, c) <= limit)
    )


def fnv1a32_all(texts: list[str]) -> list[str]:
    """FNV-1a, 32 bits, over UTF-16 units, of many texts at once: one unit of all texts at a time."""
    data = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16) for t in texts]
    sizes = np.array([len(x) for x in data], np.int64)
    order = np.argsort(-sizes, kind="stable")
    units = np.concatenate([data[i] for i in order]).astype(np.uint32) if len(data) else np.zeros(0, np.uint32)
    starts = np.cumsum(sizes[order]) - sizes[order]
    reach = len(order) - np.searchsorted(sizes[order][::-1], np.arange(sizes.max(initial=0)), "right")
    h = np.full(len(order), 0x811C9DC5, np.uint32)
    for i, n in enumerate(reach):
        h[:n] = (h[:n] ^ units[starts[:n] + i]) * np.uint32(0x01000193)
    out = np.zeros(len(order), np.uint32)
    out[order] = h
    return [f"fnv1a32:{x:08x}" for x in out.tolist()]


def fnv1a32(text: str) -> str:
    """FNV-1a, 32 bits, over UTF-16 units."""
    return fnv1a32_all([text])[0]


def js_number(value: float | None) -> str:
    """A number as scripts write it."""
    if value is None or value != value or value in (float("inf"), float("-inf")):
        return "0"
    if value == int(value) and abs(value) < 1e21:
        return str(int(value))
    r = repr(float(value))
    if "e" in r:
        mantissa, exponent = r.split("e")
        e = int(exponent)
        if -7 < e < 0:
            digits = mantissa.replace(".", "").lstrip("-")
            r = ("-" if mantissa.startswith("-") else "") + "0." + "0" * (-e - 1) + digits
        else:
            r = f"{mantissa}e{'+' if e > 0 else '-'}{abs(e)}"
    return r


def _identity(seg_idx: int | None, start: float | None, end: float | None, speaker: str | None, text: str | None) -> str:
    """C17: a segment's identity, times, speaker and text, as they are hashed."""
    i = "null" if seg_idx is None or seg_idx != seg_idx else str(int(seg_idx))
    return f"[{i},{js_number(start)},{js_number(end)},{json.dumps(speaker or '', ensure_ascii=False)},{json.dumps(text or '', ensure_ascii=False)}]"


def source_hash_of(seg_idx: int | None, start: float | None, end: float | None, speaker: str | None, text: str | None) -> str:
    """C17: the hash of a segment."""
    return fnv1a32(_identity(seg_idx, start, end, speaker, text))


@F.pandas_udf(T.StringType())
def _source_hash(seg_idx: pd.Series, start: pd.Series, end: pd.Series, speaker: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series(fnv1a32_all([_identity(*row) for row in zip(seg_idx, start, end, speaker, text)]), dtype=object)


def source_hash(seg_idx: Column, start: Column, end: Column, speaker: Column, text: Column) -> Column:
    return _source_hash(seg_idx, start, end, speaker, text)
