"""Pieces of oracle SQL: the text functions of :mod:`turnmill.functions.text` in DuckDB."""

from __future__ import annotations

import unicodedata
from functools import cache

from turnmill.functions import lexicon as lx
from turnmill.functions import text as tx

S = tx.S


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@cache
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters that NFKC changes to one other, those in order, and those that become several."""
    one, to, many = [], [], []
    for lo, hi in ((0xA0, 0x2500), (0x2E80, 0x2FE0), (0x3000, 0x3001), (0xF900, 0xFB07), (0xFF00, 0xFFF0), (0x1D400, 0x1D800)):
        for c in range(lo, hi):
            ch = chr(c)
            plain = unicodedata.normalize("NFKC", ch)
            if plain != ch:
                if len(plain) == 1:
                    one.append(ch)
                    to.append(plain)
                elif c <= 0x17F or 0x2024 <= c <= 0x2026 or 0xFB00 <= c <= 0xFB06 or c in (0x2122, 0x2103, 0x2116):
                    many.append((ch, plain))
    return "".join(one), "".join(to), tuple(many)


def nfkc(x: str) -> str:
    one, to, many = _folds()
    for ch, plain in many:
        x = f"replace({x}, {lit(ch)}, {lit(plain)})"
    return f"nfc_normalize(translate({x}, {lit(one)}, {lit(to)}))"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def trim(x: str) -> str:
    return sub(x, f"^{S}+|{S}+$")


def string_or(x: str, default: str) -> str:
    return f"coalesce(nullif({trim(x)}, ''), {lit(default)})"


def comparable(x: str) -> str:
    signs = tx._class(tx.END_SIGNS)
    return sub(sub(f"lower({nfkc(f'coalesce({x}, {chr(39) * 2})')})", f"{S}+"), f"^[{signs}]+|[{signs}]+$")


def correction(x: str) -> str:
    return sub(f"lower({nfkc(f'coalesce({x}, {chr(39) * 2})')})", rf"[{tx.SPACES}\p{{Pd}}{tx._class(tx.KEY_SIGNS)}]+")


def term_key(x: str) -> str:
    return sub(f"lower({nfkc(f'coalesce({x}, {chr(39) * 2})')})", rf"[{tx.SPACES}\p{{P}}\p{{S}}]+")


def alias_key(x: str) -> str:
    return sub(f"lower({trim(nfkc(f'coalesce({x}, {chr(39) * 2})'))})", rf"[{tx.SPACES}\p{{Pd}}_]+")


def match_text(x: str) -> str:
    return sub(
        f"lower({nfkc(f'coalesce({x}, {chr(39) * 2})')})",
        r"[\t\x0B\f \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}\p{Pd}\x{ad}\x{200b}\x{2060}\x{2212}]+",
    )


def clamp(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN 0.0 ELSE greatest({x}, 0.0) END"


def clock(x: str, vtt: bool = False) -> str:
    t = f"({clamp(x)})"
    two = lambda e: f"lpad(CAST(CAST(floor({e}) AS BIGINT) AS VARCHAR), 2, '0')"
    h, m, s = f"{t} / 3600", f"({t} % 3600) / 60", f"{t} % 60"
    if vtt:
        return f"({two(h)} || ':' || {two(m)} || ':' || {two(s)} || '.' || lpad(CAST(CAST(floor(({t} % 1) * 1000) AS BIGINT) AS VARCHAR), 3, '0'))"
    short = f"{two(m)} || ':' || {two(s)}"
    return f"CASE WHEN floor({h}) > 0 THEN {two(h)} || ':' || {short} ELSE {short} END"


def clauses(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '[，。；;,.!?！？\\n]+'), lambda c: {trim('c')}), lambda c: c <> '')"


def question(x: str) -> str:
    t = trim(x)
    asks = f"len(list_filter({clauses(t)}, lambda c: {has('c', lx.WH_ZH)} AND ({has('c', lx.CONCRETE_ACTION)} OR {has('c', lx.DECISION)}))) > 0"
    predicate = f"({has(t, lx.CONCRETE_ACTION)} OR {has(t, lx.DECISION)})"
    settled = f"({has(t, lx.ANSWERED)} OR {has(t, lx.GENERIC_POLICY)})"
    open_ = f"({has(t, lx.CHOICE_ZH)} OR {has(t, lx.OPEN_EN)})"
    return f"({t} <> '' AND ({has(t, lx.QUESTION_END)} OR {has(t, lx.QUESTION_IS)} OR ({predicate} AND ((NOT {settled} AND ({asks} OR {open_})) OR {has(t, lx.INVERTED_EN)}))))"


def html_escape(x: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = f"replace({x}, {lit(raw)}, {lit(safe)})"
    return x


#: Each segment once, however often it was delivered.
SEG = """seg AS (SELECT DISTINCT segment_id, recording_id, session_no, seg_idx, start_seconds, end_seconds, timing_source, speaker, text, join_next FROM segments)"""
#: Normalised segments: blank ones dropped, ordered by start, positions counted from 0.
NORM = f"""{SEG},
norm AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY recording_id, session_no ORDER BY sort_start, seg_idx, segment_id) - 1 AS INT) AS pos
  FROM (SELECT segment_id, recording_id, session_no, seg_idx, start_seconds, end_seconds, join_next,
          coalesce(nullif(speaker, ''), '发言人 1') AS speaker, {trim('text')} AS text,
          CASE WHEN timing_source IN ('provider', 'inferred') THEN timing_source
               WHEN start_seconds >= 0 AND end_seconds > start_seconds THEN 'provider' ELSE 'inferred' END AS timing_source,
          CASE WHEN start_seconds >= 0 THEN start_seconds ELSE CAST('Infinity' AS DOUBLE) END AS sort_start
        FROM seg) WHERE text <> '')"""
