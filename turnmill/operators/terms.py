"""Terminology: the naming language, alias graphs, occurrences, consensus and rewriting."""

import bisect
import operator
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.functions import text as tx
from turnmill.runtime import cut

#: The most entries of a context and characters of an entry.
MOST_ENTRIES = 200
MOST_CHARACTERS = 120
# Fixed value: the labels of clauses.
_LABELS = r"(?i)^(术语|专有名词|项目名|产品名|公司名|组织名|人名|姓名|负责人|参会人|人员|别名|terms?|project|product|company|organization|names?|aliases?)[ \t]*[:：=]?[ \t]*(.+)$"


def _entries(contexts: DataFrame, key: str, text: str) -> DataFrame:
    """Every entry of the labelled clauses, numbered by ``ord``."""
    clause = F.posexplode(F.split(F.col(text), r"[；;\n]+"))
    rows = contexts.select(F.col(key).alias("k_"), clause.alias("c_", "clause")).withColumn("clause", tx.js_trim(F.col("clause")))
    rows = rows.where(F.col("clause").rlike(_LABELS)).select("k_", "c_", F.regexp_extract("clause", _LABELS, 1).alias("label"), F.regexp_extract("clause", _LABELS, 2).alias("rest"))
    parts = F.when(F.col("rest").rlike("->|→"), F.split("rest", r"[、,，|]+")).otherwise(F.split("rest", r"[、,，|/]+"))
    rows = rows.select("k_", "c_", "label", F.posexplode(F.filter(F.transform(parts, tx.js_trim), lambda x: x != "")).alias("e_", "entry"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("k_").orderBy("c_", "e_")))


def context_overflow(contexts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, entries, overflow)`` of every context: how many entries it has, and whether ``parse_context`` leaves some out."""
    n = _entries(contexts, key, text).groupBy("k_").agg(F.max("ord").alias("n_"))
    keys = contexts.select(F.col(key)).distinct()
    j = keys.join(n, keys[key].eqNullSafe(n["k_"]), "left").select(key, F.coalesce("n_", F.lit(0)).alias("entries"))
    return j.withColumn("overflow", F.col("entries") > MOST_ENTRIES)


def parse_context(contexts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, ord, kind, alias, canonical, alias_key)`` of a labelled context's entries, the first 200 of each.

    Clauses end at semicolons and line ends; entries are split by commas and bars,
    and by slashes where the clause maps nothing; ``a -> b`` maps an alias.
    ``context_overflow`` tells which contexts have more.
    """
    rows = _entries(contexts, key, text).where(F.col("ord") <= MOST_ENTRIES)
    arrow = r"^(.+?)[ \t]*(?:->|→)[ \t]*(.+)$"
    maps = F.col("entry").rlike(arrow)
    alias, canonical = tx.js_trim(F.regexp_extract("entry", arrow, 1)), tx.js_trim(F.regexp_extract("entry", arrow, 2))
    out = rows.select(
        F.col("k_").alias(key), "ord", F.when(maps, "mapping").when(~F.col("label").rlike("(?i)^(别名|aliases?)$"), "term").alias("kind"),
        F.when(maps, alias).alias("alias"), F.when(maps, canonical).otherwise(F.col("entry")).alias("canonical"),
    ).where("kind is not null")
    out = out.withColumn("alias_key", F.when(F.col("kind") == "mapping", tx.correction_text(F.col("alias"))))
    good = (
        (F.char_length("alias") <= MOST_CHARACTERS) & (F.char_length("canonical") <= MOST_CHARACTERS) & (F.char_length("alias_key") >= 2)
        & (F.char_length(tx.correction_text(F.col("canonical"))) >= 2) & (tx.nfkc(F.col("alias")) != tx.nfkc(F.col("canonical")))
    )
    size = F.char_length("canonical")
    return out.where(F.when(F.col("kind") == "mapping", good).otherwise((size >= 2) & (size <= MOST_CHARACTERS)))


def alias_edges(pairs: DataFrame, keys: Sequence[str], alias: str, canonical: str, ord_: str) -> DataFrame:
    """One edge an alias key; ``conflict`` where it is given more than one canonical spelling."""
    rows = pairs.select(*keys, F.col(ord_).alias("o_"), tx.correction_text(F.col(alias)).alias("alias_key"), F.col(canonical).alias("canonical"), tx.nfkc(F.col(canonical)).alias("c_"))
    rows = rows.where("char_length(alias_key) >= 2")
    return rows.groupBy(*keys, "alias_key").agg(F.min_by("canonical", F.struct("o_", "canonical")).alias("canonical"), (F.countDistinct("c_") > 1).alias("conflict"))


def close_aliases(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """G1: every alias with its terminal canonical; NULL where its walk meets a cycle or a conflicting alias.

    Pointer jumping: after ``k`` rounds each alias has walked ``2**k`` edges.  It
    goes on until no alias walks, or until as many edges are walked as there are
    aliases; what still walks then runs in a cycle.  An alias whose canonical has
    its own key is terminal.
    """
    e = edges.select(*keys, "alias_key", "canonical", tx.correction_text(F.col("canonical")).alias("next_key"), "conflict")
    known = e.select(*keys, F.col("alias_key").alias("next_key"), F.col("conflict").alias("next_conflict"), F.lit(True).alias("goes_on"))
    state = e.join(known, [*keys, "next_key"], "left").select(
        *keys, "alias_key", "canonical", "next_key",
        (F.col("conflict") | F.coalesce("next_conflict", F.lit(False))).alias("bad"),
        (F.coalesce("goes_on", F.lit(False)) & (F.col("next_key") != F.col("alias_key"))).alias("open"),
    )
    state = cut(state)
    aliases, walked = state.count(), 1
    while walked <= aliases and not state.where("open and not bad").isEmpty():
        walked *= 2
        ahead = state.select(*keys, F.col("alias_key").alias("next_key"), F.col("canonical").alias("c2"), F.col("next_key").alias("n2"), F.col("bad").alias("b2"), F.col("open").alias("o2"))
        moves = F.col("open") & ~F.col("bad") & F.col("n2").isNotNull()
        state = cut(
            state.join(ahead, [*keys, "next_key"], "left").select(
                *keys, "alias_key", F.when(moves, F.col("c2")).otherwise(F.col("canonical")).alias("canonical"),
                F.when(moves, F.col("n2")).otherwise(F.col("next_key")).alias("next_key"),
                (F.col("bad") | (moves & F.col("b2"))).alias("bad"), F.when(moves, F.col("o2")).otherwise(F.col("open") & F.col("n2").isNotNull()).alias("open"),
            )
        )
    return state.select(*keys, "alias_key", F.when(~F.col("bad") & ~F.col("open"), F.col("canonical")).alias("terminal"))


def components(edges: DataFrame, left: str, right: str, rounds: int | None = None) -> DataFrame:
    """``(node, component)``, the component named by its least node; contraction in an order drawn by hash anew in each round.

    In a round each node goes over to the first of itself and its neighbours, and the edges
    go with it.  At least a fixed share of the nodes is expected to vanish, however the graph
    lies, so all rounds together cost little more than the first.  Goes on until no edge is
    left; where ``rounds`` are given and do not suffice, it raises.
    """
    ends = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ((left, right), (right, left))])
    both, moves = cut(edges.select(F.inline(ends)).where("a is not null and b is not null")), []
    of, none = Window.partitionBy("a"), F.lit(None).cast(both.schema["a"].dataType)
    while not moves or not both.isEmpty():
        if len(moves) == rounds:
            raise ValueError(f"components are not settled after {rounds} rounds")
        order = lambda x: F.struct(F.xxhash64(F.lit(len(moves)), x).alias("h"), F.col(x).alias("to"))  # noqa: B023, E731
        # windows, as Spark's estimates of joined joins grow beyond memory within some rounds
        first = both.withColumn("to", F.least(F.min(order("b")).over(of), order("a"))["to"])
        rows = F.array(F.struct("a", none.alias("b"), "to"), F.struct(F.col("b").alias("a"), F.col("to").alias("b"), none.alias("to")))
        gone = cut(first.select(F.inline(rows)).distinct())
        moves.append(gone.where("b is null").select("a", "to"))
        ahead = gone.withColumn("to", F.max("to").over(of)).where("b != to").select(F.col("to").alias("a"), "b")
        both = cut(ahead.distinct())
    labels = moves.pop()
    while moves:  # where the nodes of a round went in the later ones
        later = labels.select(F.col("a").alias("to"), F.col("to").alias("last"))
        labels = moves.pop().join(later, "to", "left").select("a", F.coalesce("last", "to").alias("to"))
    labels = cut(labels)
    names = labels.groupBy("to").agg(F.min("a").alias("component"))
    return labels.join(names, "to").select(F.col("a").alias("node"), "component")


def _match_units(text: str) -> tuple[str, list[tuple[int, int]]]:
    """C11: the text as terms are matched in it, and the source span of each of its characters."""
    out, spans = [], []
    i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.category(text[j])[0] == "M":
            j += 1
        piece = unicodedata.normalize("NFKC", text[i:j]).lower()
        for ch in piece:
            if ch in "\n\r" or not (ch.isspace() or ch in "\xad​⁠﻿−" or unicodedata.category(ch) == "Pd"):
                out.append(ch)
                spans.append((i, j))
        i = j
    return "".join(out), spans


_WORD = re.compile(r"[0-9a-zß-öø-ɏ_]")


def ranges_in(text: str | None, term: str | None) -> list[tuple[int, int]]:
    """The source ranges where the term occurs; Latin terms only between word boundaries."""
    if not text or not term:
        return []
    needle, _ = _match_units(term)
    hay, spans = _match_units(text)
    out = []
    at = hay.find(needle) if needle else -1
    while at >= 0:
        a, b = spans[at][0], spans[at + len(needle) - 1][1]
        before, after = text[a - 1 : a].lower(), text[b : b + 1].lower()
        if not (_WORD.match(needle[0]) and before and _WORD.match(before)) and not (_WORD.match(needle[-1]) and after and _WORD.match(after)):
            out.append((a, b))
        at = hay.find(needle, at + 1)
    return out


def ranges_outside(text: str | None, term: str | None, canonical: str | None) -> list[tuple[int, int]]:
    """Ranges of an alias that do not lie inside a range of its canonical."""
    inside = ranges_in(text, canonical)
    return [(a, b) for a, b in ranges_in(text, term) if not any(x <= a and b <= y and (x, y) != (a, b) for x, y in inside)]


_RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(_RANGES)
def _ranges(text: pd.Series, term: pd.Series, canonical: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b} for a, b in ranges_outside(*row)] for row in zip(text, term, canonical)], dtype=object)


def match_ranges(text: Column, term: Column, canonical: Column) -> Column:
    """C11 to C13 and J18 as a column of ``(start, end)`` ranges."""
    return _ranges(text, term, canonical)


def select_spans(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Leftmost, then longest, without overlaps."""
    out: list[tuple[int, int, str]] = []
    for a, b, to in sorted(spans, key=lambda x: (x[0], -x[1], x[2])):
        if not out or a >= out[-1][1]:
            out.append((a, b, to))
    return out


def rewrite_text(text: str | None, mappings: list[tuple[str, str]]) -> str | None:
    """The text with every mapped alias replaced by its canonical."""
    if not text:
        return text
    spans = select_spans([(a, b, c) for alias, c in mappings for a, b in ranges_outside(text, alias, c) if text[a:b] != c])
    for a, b, to in reversed(spans):
        text = text[:a] + to + text[b:]
    return text


def replay_spans(text: str, spans: list[tuple[int, int, str, str]]) -> str | None:
    """L3: the text after ``(start, end, from, to)`` replacements; None if one does not read back or two overlap."""
    ends: list[int] = []
    for a, b, was, _ in sorted(spans):
        if not 0 <= a < b <= len(text) or text[a:b] != was or (ends and a < ends[-1]):
            return None
        bisect.insort(ends, b)
    for a, b, _, to in sorted(spans, reverse=True):
        text = text[:a] + to + text[b:]
    return text


@F.pandas_udf(T.StringType())
def _replayed(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([replay_spans(t, [(x["start_offset"], x["end_offset"], x["from_text"], x["to_text"]) for x in s]) for t, s in zip(text, spans)], dtype=object)


def replayed(text: Column, spans: Column) -> Column:
    """L3 as a column: ``spans`` is an array of ``(start_offset, end_offset, from_text, to_text)``."""
    return _replayed(text, spans)


# Fixed value: a technical surface: Latin words with signs, cases or digits of identifiers.
SURFACE = r"[A-Za-z][A-Za-z0-9+#_\-]*[A-Za-z0-9+#]"
IDENTIFIER = r"[_\-]|[a-z][A-Z]|[A-Z]{2,}|[0-9+#]"


def surfaces(df: DataFrame, key: str, text: str) -> DataFrame:
    """The distinct surfaces of each text by key, how often each occurs and whether it looks like an identifier."""
    rows = df.select(F.col(key).alias("k_"), F.explode(F.regexp_extract_all(F.col(text), F.lit(SURFACE), F.lit(0))).alias("surface"))
    return (
        rows.where(F.length("surface") >= 3)
        .groupBy("surface")
        .agg(F.count("*").alias("occurrences"), F.countDistinct("k_").alias("texts"))
        .withColumn("identifier", F.col("surface").rlike(IDENTIFIER))
        .withColumn("term_key", F.lower(F.regexp_replace("surface", r"[^A-Za-z0-9]", "")))
    )


#: The letters of surfaces, small, and spaces for all other bytes.
_FOLDED = bytes(ord(chr(b).lower()) if re.match(r"[A-Za-z0-9+#_\-]", chr(b)) else 32 for b in range(256))


def surface_keys(df: DataFrame, text: str) -> DataFrame:
    """The distinct ``key`` of all surfaces.

    A surface lies within a run of its letters, so the texts are only cut into such runs,
    and the surfaces are looked for in the distinct runs of a batch.
    """
    find = re.compile(SURFACE.encode()).findall

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs: set[bytes] = set()
            for t in batch.column(0).to_pylist():
                runs.update(t.translate(_FOLDED).split())
            keys = {re.sub(rb"[^a-z0-9]", b"", x) for run in runs for x in find(run) if len(x) >= 3}
            yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k in keys], pa.string())], ["key"])

    rows = df.select(F.col(text).cast("binary").alias("t_")).where("t_ is not null")
    return rows.mapInArrow(work, "key string").distinct()


def variant_limit(length: Column) -> Column:
    """The most edits between variants of which the longer has ``length`` characters."""
    return F.greatest(F.lit(1), F.floor(length / 4).cast("int"))


#: The longest keys that are cut into segments.
SEGMENTED = 32
#: Fixed value: how often a letter may stand in a longer key for its count to be told apart.
COUNTED = 6


def _unary(keys: pd.Series, letters: int, times: int) -> np.ndarray:
    """For each key and count up to ``times``, a bit for every letter (modulo ``letters``) that stands in the key so often."""
    codes = np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32) % letters
    of = np.repeat(np.arange(len(keys)), [len(w) for w in keys])
    counts = np.bincount(of * letters + codes, minlength=len(keys) * letters).reshape(len(keys), 1, letters)
    return np.packbits(counts > np.arange(times)[:, None], axis=2, bitorder="little")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _letter_counts(keys: pd.Series) -> pd.Series:
    """For each count up to ``COUNTED``, a bit for every letter (modulo 64)."""
    return pd.Series(list(_unary(keys, 64, COUNTED).view(np.int64)[:, :, 0]), dtype=object)


@F.pandas_udf(T.LongType())
def _letter_bits(keys: pd.Series) -> pd.Series:
    """A bit for every letter (modulo 32), and one for every letter that stands in the key twice."""
    return pd.Series(_unary(keys, 32, 2).reshape(len(keys), 8).view(np.int64)[:, 0])


def _long_pairs(all_: DataFrame) -> DataFrame:
    """The pairs of keys of which the longer has more than ``SEGMENTED`` characters, that may be variants.

    Keys that begin alike are met by their length, each as one row, and first compared by
    their letters: ``k`` edits change the counts of letters by ``2 k`` less the difference in
    length at most.
    """
    # a key of the longest segmented sizes may be a variant of one that is just too long for it
    big = cut(all_.where(F.col("n_") > SEGMENTED - 2).select("w_", "n_", F.substring("w_", 1, 1).alias("a_"), _letter_counts("w_").alias("c_")))
    sizes = F.filter(F.sequence(F.col("n_"), F.col("n_") + 2), lambda x: x > SEGMENTED)
    short = big.select(F.col("w_").alias("short"), F.col("n_").alias("nr"), "a_", *[F.col("c_")[t].alias(f"s{t}") for t in range(COUNTED)], F.explode(sizes).alias("ns"))
    long = big.select(F.col("w_").alias("long"), F.col("n_").alias("ns"), "a_", *[F.col("c_")[t].alias(f"l{t}") for t in range(COUNTED)])
    changed = reduce(operator.add, [F.bit_count(F.col(f"s{t}").bitwiseXOR(F.col(f"l{t}"))) for t in range(COUNTED)])
    near = short.join(long, ["a_", "ns"]).where((F.col("nr") < F.col("ns")) | (F.col("short") < F.col("long"))).where(changed <= 2 * variant_limit(F.col("ns")) - (F.col("ns") - F.col("nr")))
    return near.select("short", "long", "ns")


def _pieces() -> tuple[list[tuple[int, ...]], list[tuple[int, ...]]]:
    """The pieces of the shorter and of the longer key, of up to ``SEGMENTED`` characters, that are compared: rows ``(n_, ns, nr, i, a, b, c, d, e)``.

    A piece of a key of ``n_`` characters is what stands from ``a`` before ``b``, from ``c``
    before ``d`` and from ``e`` on; it is compared with those of the same sizes ``ns`` and
    ``nr`` of both keys and the same number ``i``.  The first characters are the same and in
    no piece.
    """
    short, long = [], []
    for nr in range(2, SEGMENTED + 1):
        for ns in range(nr, min(nr + 2, SEGMENTED) + 1):
            k, rest, more = max(1, ns // 4), nr - 1, ns - nr
            if more > k:
                continue
            if k == 1 and not more:  # one changed character: the others stand where they stood
                rows = [(nr, ns, nr, p, 1, p, 1, 1, p + 1) for p in range(1, nr)]
                short, long = short + rows, long + rows
            elif more == k and rest < 2 * (k + 1):  # the longer key without ``k`` characters; segments would be too short
                short.append((nr, ns, nr, 0, 1, 1, 1, 1, 1))
                long += [(ns, ns, nr, 0, 1, at[0], at[0] + 1, at[-1], at[-1] + 1) for at in combinations(range(1, ns), k)]
            else:
                for i in range(k + 1):
                    p, e = 1 + i * rest // (k + 1), 1 + (i + 1) * rest // (k + 1)
                    short.append((nr, ns, nr, i, p, e, 1, 1, nr))
                    long += [(ns, ns, nr, i, p + h, e + h, 1, 1, ns) for h in range(max(-i, more - (k - i)), min(i, more + (k - i)) + 1) if p + h >= 1 and e + h <= ns]
    return short, long


def variant_pairs(keys: DataFrame, key: str) -> DataFrame:
    """pairs of keys within edit distance ``max(1, floor(n / 4))`` that begin alike and differ by less than three in length, neither inside the other.

    Hash joins that lose no pair.  Keys of up to ``SEGMENTED`` characters: within ``k``
    edits one of ``k + 1`` segments of what follows the shorter key's first character stands
    in the longer one, at a place that the edits before and after it allow; the shortest keys
    are met by what is left of them without an edited character.  Longer keys, whose segments
    would be too many, are met by their length.  All are compared by their letters first: ``k``
    edits change the counts of letters by ``2 k`` less the difference in length at most.
    """
    # the keys are written, lest each join gather them anew
    all_ = cut(keys.select(F.col(key).alias("w_")).where("w_ != ''").distinct().withColumn("m_", _letter_bits("w_"))).withColumn("n_", F.char_length("w_"))
    tables = [F.broadcast(all_.sparkSession.createDataFrame(rows, ", ".join(f"{c} int" for c in ("n_", "ns", "nr", "i", "a", "b", "c", "d", "e")))) for rows in _pieces()]
    piece = F.expr("xxhash64(ns, nr, i, substring(w_, 1, 1), concat(substring(w_, a + 1, b - a), substring(w_, c + 1, d - c), substring(w_, e + 1)))")
    own, other = [all_.join(t, "n_").select(F.col("w_").alias(name), F.col("m_").alias(f"m_{name}"), piece.alias("piece")) for name, t in zip(("short", "long"), tables)]
    changed, nr, ns = F.bit_count(F.col("m_short").bitwiseXOR(F.col("m_long"))), F.char_length("short"), F.char_length("long")
    pairs = own.hint("shuffle_hash").join(other, "piece").where(changed <= 2 * variant_limit(ns) - (ns - nr))
    pairs = pairs.where((nr < ns) | (F.col("short") < F.col("long"))).where(F.substring("short", 1, 1) == F.substring("long", 1, 1))
    pairs = pairs.select("short", "long", ns.alias("ns")).unionByName(_long_pairs(all_)).withColumn("k", variant_limit(F.col("ns")))
    pairs = pairs.where(~F.contains("long", "short") & F.expr("levenshtein(short, long, k) between 0 and k"))
    return pairs.select(F.least("short", "long").alias("left"), F.greatest("short", "long").alias("right")).distinct()


def single_letter_token(text: Column) -> Column:
    """Whether a surface has a token of one letter."""
    return text.rlike(r"(?:^|[\s_-])[A-Za-z](?:$|[\s_-])")


def likely_variants(left: Column, right: Column, left_key: Column, right_key: Column) -> Column:
    """F17 as a predicate of two surfaces: equal keys, or near ones that begin alike; lengths may differ by three or more only beside a token of one letter."""
    long = F.greatest(F.char_length(left_key), F.char_length(right_key))
    apart = F.abs(F.char_length(left_key) - F.char_length(right_key)) >= 3
    near = (
        (F.substring(left_key, 1, 1) == F.substring(right_key, 1, 1)) & ~F.contains(left_key, right_key) & ~F.contains(right_key, left_key)
        & (~apart | single_letter_token(left) | single_letter_token(right)) & (F.levenshtein(left_key, right_key) <= variant_limit(long))
    )
    return (left_key != "") & (right_key != "") & ((left_key == right_key) | near)


def prefix_variants(left_key: Column, right_key: Column) -> Column:
    """short keys that begin alike and are two edits apart at most."""
    size = [F.char_length(left_key), F.char_length(right_key)]
    return (left_key != "") & (right_key != "") & (F.substring(left_key, 1, 1) == F.substring(right_key, 1, 1)) & (F.greatest(*size) <= 6) & (F.abs(size[0] - size[1]) <= 2) & (F.levenshtein(left_key, right_key) <= 2)


def signals(spelled: DataFrame, grouped: DataFrame) -> DataFrame:
    """Groups of surfaces that mean one term, and whether each must be mapped or only reviewed.

    ``spelled`` are surfaces ``(surface, term_key, identifier)``, ``grouped`` the
    components ``(node, component)`` of their keys' variants; a key without variants
    is a group of its own.  A group has two keys or two spellings; it must be mapped
    if one key has two spellings and a surface looks like an identifier.
    """
    s = spelled.where("term_key != ''").join(grouped.select(F.col("node").alias("term_key"), "component"), "term_key", "left").withColumn("component", F.coalesce("component", "term_key"))
    keys = s.groupBy("component", "term_key").agg(F.count_distinct("surface").alias("spellings"), F.max("identifier").alias("identifier"))
    groups = keys.groupBy("component").agg(F.count("*").alias("keys"), F.sum("spellings").alias("spellings"), F.max("spellings").alias("most_"), F.max("identifier").alias("id_"))
    sure = (F.col("most_") >= 2) & F.col("id_")
    return groups.where("keys >= 2 or spellings >= 2").select("component", "keys", "spellings", F.when(sure, "mapped").otherwise("review").alias("required_disposition"))


# The words that make a mixed term technical, and the least length of a surface's key.
_SUFFIXES = "调度|绑定|接口|任务|节点|副本|状态|类型|策略|服务"
MIXED = rf"(?<![A-Za-z0-9+#])[A-Za-z][A-Za-z0-9+#]{{0,11}}(?:{_SUFFIXES})"
LEAST_KEY = 7


def contextual_signals(norm: DataFrame) -> DataFrame:
    """Terms of mixed script that stand within a segment of a group of surface variants of their recording.

    ``(recording_id, term_key, term, occurrences, segments, related, dismissal_policy)``; ``related``
    counts the groups.  A term of one Latin letter is dismissed only by ear.  Neighbours
    are met by a hash join on the position, three a segment.
    """
    of, at = ["recording_id"], ["recording_id", "session_no", "pos"]
    found = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    words = F.filter(found(r"[A-Za-z][A-Za-z0-9+#]*"), lambda x: F.char_length(x) >= LEAST_KEY)
    # the texts are put in order and read once, for words and terms
    rows = cut(norm.select(*at, "segment_id", words.alias("words"), found(MIXED).alias("terms")).where("size(words) > 0 or size(terms) > 0"))
    tokens = rows.select(*at, F.explode("words").alias("surface")).withColumn("term_key", F.lower("surface")).withColumn("term_key", F.regexp_replace("term_key", r"[^a-z0-9]", "")).where(F.char_length("term_key") >= LEAST_KEY)
    pairs = variant_pairs(tokens.select(F.col("term_key").alias("key")), "key")
    groups = components(pairs, "left", "right").select(F.col("node").alias("term_key"), "component")
    named = tokens.join(groups, "term_key", "left").withColumn("component", F.coalesce("component", "term_key"))
    varied = named.groupBy(*of, "component").agg(F.count_distinct("surface").alias("n_")).where("n_ >= 2").select(*of, "component")
    anchors = named.join(varied, [*of, "component"]).select(*at, "component").distinct().withColumn("pos", F.explode(F.array(F.col("pos") - 1, F.col("pos"), F.col("pos") + 1)))
    mixed = rows.select(*at, "segment_id", F.explode("terms").alias("term")).withColumn("term_key", F.lower("term"))
    counts = mixed.groupBy(*of, "term_key").agg(F.max_by("term", F.struct("session_no", "pos")).alias("term"), F.count("*").alias("occurrences"), F.count_distinct("segment_id").alias("segments"))
    near = mixed.select(*at, "term_key").distinct().join(anchors, at).groupBy(*of, "term_key").agg(F.count_distinct("component").alias("related"))
    policy = F.when(F.col("term").rlike(rf"^[A-Za-z](?:{_SUFFIXES})"), "map_or_audio_review").otherwise("text_evidence")
    return counts.join(near, [*of, "term_key"]).withColumn("dismissal_policy", policy)
