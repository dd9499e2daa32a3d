"""Freely typed names mapped to the canonical list.

Token-level repair: every distinct value is brought to its consistent form and
cut into tokens; tokens that are no part of any name (articles, a trailing
"service", particles; read off the known aliases) are set aside.  A value is read
in several ways: as its tokens stand, and written together and cut anew.

Each distinct token of all readings is joined to the reference vocabulary: by
edit distance (transpositions count once, characters that aliases swap a third)
and by equal sound.  Candidates come from a hash join on the rarest characters:
two strings within the distance share one of them, so none is lost.  The repaired
tokens of a reading are then joined to the entries that have just these parts,
and soft TF-IDF over both token bags ranks the entries; equal scores go to the
lower ``eval_id``.  A value spelled like a known alias means its entry.

Defined results: blank and NULL values give no row; values that mean no entry
give ``none``, as do values with a token over three times as long as any part of
a name; an empty list gives ``none`` for every value; repeated rows count once.
The list is read by the driver, which learns from it; it has no limit of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.forms import canonical, canonical_form
from turnmill.runtime import cut

#: The least likeness of a repaired token, and of a whole name.
LEAST_TOKEN = 0.55
LEAST_NAME = 0.65
NONE = "none"

_TOKEN = re.compile(r"[A-Z]?[a-zà-öø-ÿ]+|[A-Z]+(?![a-z])|\d+|[㐀-鿿]+|[^\W\d_a-zA-Zà-öø-ÿ㐀-鿿]+")
_HAN = re.compile(r"[㐀-鿿]+")


def tokens(value: str) -> list[str]:
    """The tokens of a value: words, cut at changes of case and script, in lower case."""
    return [t.lower() for t in _TOKEN.findall(canonical(value) or "")]


def distance(a: str, b: str, alike: frozenset[tuple[str, str]] = frozenset(), most: float = 99.0) -> float:
    """Edit distance with transpositions; swapping characters that sound alike costs a third."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[float] = []
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [float(i)]
        for j, y in enumerate(b, 1):
            swap = 0.0 if x == y else 0.34 if (x, y) in alike else 1.0
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + swap)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


def sound(token: str) -> str:
    """A rough key of how a Latin token sounds: consonants, spellings of one sound made one."""
    s = token
    for spelling, key in (("dge", "j"), ("dg", "j"), ("tch", "S"), ("che", "S"), ("ch", "S"), ("sh", "S"), ("ck", "k"), ("ph", "f"), ("qu", "k"), ("q", "k"), ("c", "k"), ("z", "s")):
        s = s.replace(spelling, key)
    s = s[:1] + re.sub(r"[aeiouyhw]", "", s[1:])
    return re.sub(r"(.)\1+", r"\1", s)


class Names:
    """The reference list, cut into parts, with what its aliases teach."""

    def __init__(self, rows: list[tuple[str, str, list[str] | None]]):
        self.rows = sorted(rows)
        han = [_HAN.findall(canonical(c) or "") for _, c, _ in self.rows]
        self.cuts = self._han_cuts(["".join(h) for h in han if h])
        self.parts: dict[str, tuple[str, ...]] = {e: tuple(p for t in tokens(c) for p in self._cut(t)) for e, c, _ in self.rows}
        heard: Counter[str] = Counter(p for ps in self.parts.values() for p in set(ps))
        n = max(1, len(self.parts))
        self.weight = {p: 1.0 + math.log(n / k) for p, k in heard.items()}
        self.alike: frozenset[tuple[str, str]] = frozenset()
        self.noise: set[str] = set()
        self.known: dict[str, str] = {}
        self.heard: dict[tuple[int, str], set[str]] = defaultdict(set)
        self._learn()
        self.most_parts = max(map(len, self.parts.values()), default=0)
        self.longest = max((len(p) for ps in self.parts.values() for p in ps), default=0)
        self.same = self._classes()
        seen = Counter(x for ps in self.parts.values() for p in ps for x in set(self.plain(p)))
        self.rank = {x: i for i, (x, _) in enumerate(sorted(seen.items(), key=lambda c: (c[1], c[0])))}

    @staticmethod
    def _han_cuts(names: list[str]) -> dict[str, int]:
        """Where each undivided name is cut: at the beginning and the end most shared with other names."""
        heads, tails = Counter(), Counter()
        for name in set(names):
            heads.update(name[:i] for i in range(2, len(name) - 1))
            tails.update(name[i:] for i in range(2, len(name) - 1))
        out = {}
        for name in set(names):
            places = range(2, len(name) - 1)
            if places:
                best = max(places, key=lambda i: (heads[name[:i]] * tails[name[i:]], -abs(2 * i - len(name))))
                if heads[name[:best]] * tails[name[best:]] > 1:
                    out[name] = best
        return out

    def _cut(self, token: str) -> list[str]:
        at = self.cuts.get(token)
        return [token[:at], token[at:]] if at else [token]

    def _learn(self) -> None:
        """Characters that aliases swap, tokens that are no part of a name, and the aliases themselves."""
        swaps: set[tuple[str, str]] = set()
        noise: Counter[str] = Counter()
        claimed: dict[str, set[str]] = defaultdict(set)
        for e, c, aliases in self.rows:
            own = "".join(self.parts[e])
            for alias in [c, *(aliases or [])]:
                key = self.key(alias or "")
                if key:
                    claimed[key].add(e)
                ts = tokens(alias or "")
                plain = "".join(ts)
                if len(plain) == len(own) and _HAN.fullmatch(own):
                    pairs = [(a, b) for a, b in zip(plain, own) if a != b]
                    if len(pairs) <= len(own) // 2:
                        swaps |= set(pairs) | {(b, a) for a, b in pairs}
                if len(ts) > 1 and distance(plain, own) > 1:
                    for t in (ts[0], ts[-1]):
                        rest = "".join(ts[1:] if t == ts[0] else ts[:-1])
                        if distance(rest, own) < distance(plain, own) - 1 and len(t) <= 3:
                            noise[t] += 1
                m = re.fullmatch(rf"({re.escape(own[:2])}.*)(.)({re.escape(own[-2:])})", plain) if _HAN.fullmatch(own) else None
                if m and len(plain) == len(own) + 1:
                    noise[m.group(2)] += 1
        self.alike = frozenset(swaps)
        self.noise = {t for t, k in noise.items() if k > 1}
        for e, _, aliases in self.rows:  # spellings by ear that aliases show, part by part
            for alias in aliases or []:
                ts = [t for t in tokens(alias or "") if t not in self.noise]
                if len(ts) == len(self.parts[e]):
                    for k, (t, p) in enumerate(zip(ts, self.parts[e])):
                        if t != p and t.isascii() and sound(t) == sound(p) and t[:1] == p[:1]:
                            self.heard[k, p].add(t)
        self.known = {k: min(es) for k, es in claimed.items() if len(es) == 1}

    def key(self, value: str) -> str:
        """A value without case, spacing and signs."""
        return "".join(tokens(value))

    def _classes(self) -> dict[str, str]:
        """For every character that sounds like others the least of them."""
        least: dict[str, str] = {}
        for a, b in sorted(self.alike):
            x, y = sorted((least.get(a, a), least.get(b, b)))
            for c in [c for c, v in least.items() if v == y] + [a, b, y]:
                least[c] = x
        return least

    def plain(self, token: str) -> str:
        """The token with characters that sound alike made one."""
        return "".join(self.same.get(c, c) for c in token)

    def keys(self, token: str) -> list[str]:
        """The rarest characters of a token, numbered where they repeat: of two strings within the distance, both have one of them.

        The longer of the two keeps at least 0.55 of its characters, so the strings
        share so many, and one of the others and one more is shared.
        """
        seen: Counter[str] = Counter()
        elements = []
        for c in self.plain(token):
            elements.append((self.rank.get(c, -1), c, seen[c]))
            seen[c] += 1
        elements.sort()
        least = max(1, min(len(token) - 1, math.ceil(LEAST_TOKEN * len(token) - 1e-9)))
        return [f"{c}{k}" for _, c, k in elements[: len(token) - least + 1]]

    def _readings(self, ts: list[str]) -> Iterator[tuple[tuple[str, ...], float]]:
        """The ways to read the tokens as the parts of a name, with what each costs: as they stand, or written together and cut anew."""
        whole = "".join(ts)
        yield tuple(ts), 0.0
        yield (whole,), 0.0
        for begin in range(0, 5):
            if begin == 0 or begin > 1 and len(whole) - begin > 5 and self._noisy(whole[:begin]):
                for i in range(begin + 2, len(whole) - 1):
                    yield (whole[begin:i], whole[i:]), 0.12 if begin else 0.02

    def _noisy(self, token: str) -> bool:
        """Whether the token is no part of any name, or a slip of such a token."""
        if token in self.noise:
            return True
        return token.isascii() and 2 <= len(token) <= 4 and any(len(x) == 3 and distance(token, x) <= 1 for x in self.noise)

    def _stripped(self, ts: list[str]) -> Iterator[list[str]]:
        """The tokens, and the tokens without such as are no part of a name."""
        yield ts
        kept = list(ts)
        while len(kept) > 1 and self._noisy(kept[0]):
            kept = kept[1:]
        while len(kept) > 1 and self._noisy(kept[-1]):
            kept = kept[:-1]
        if kept != ts:
            yield kept
        for x in self.noise:
            if not x.isascii() and len(x) == 1:
                for k, t in enumerate(kept):
                    if x in t[1:-1]:
                        yield [*kept[:k], t.replace(x, ""), *kept[k + 1 :]]
                if x in kept[1:-1]:
                    yield [t for t in kept if t != x]

    def ways(self, value: str) -> Iterator[tuple[int, str, float, tuple[str, ...] | None]]:
        """``(turn, key, cost, tokens)``: for every way to strip a value its key, then the ways to read it whose tokens can be parts of a name."""
        ts = tokens(value)
        if not ts or len(ts) > 4 * self.most_parts + 8:
            return
        for turn, some in enumerate(self._stripped(ts)):
            yield turn, "".join(some), 0.0, None
            if len("".join(some)) <= 3 * self.longest * self.most_parts:
                for reading, cost in dict(reversed([*self._readings(some)])).items():
                    if len(reading) <= self.most_parts and all(len(t) <= 3 * self.longest for t in reading):
                        yield turn, "", cost, reading


def distances(a: list[str], b: list[str], alike: frozenset[tuple[str, str]] = frozenset()) -> np.ndarray:
    """:func:`distance` of many pairs at once."""
    out = np.zeros(len(a))
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    swaps = np.sort(np.array([ord(x) << 21 | ord(y) for x, y in alike], np.int64))
    for n, m in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes[:, 0] == n) & (sizes[:, 1] == m))
        if not n or not m:
            out[at] = n + m
            continue
        x = np.array([list(map(ord, a[i])) for i in at], np.int64)
        y = np.array([list(map(ord, b[i])) for i in at], np.int64)
        older = before = None
        row = np.tile(np.arange(m + 1.0), (len(at), 1))
        for i in range(n):
            older, before, row = before, row, np.full((len(at), m + 1), i + 1.0)
            for j in range(m):
                same = x[:, i] == y[:, j]
                swap = np.where(same, 0.0, 1.0)
                if len(swaps):
                    pair = x[:, i] << 21 | y[:, j]
                    near = np.minimum(np.searchsorted(swaps, pair), len(swaps) - 1)
                    swap = np.where(~same & (swaps[near] == pair), 0.34, swap)
                d = np.minimum(np.minimum(before[:, j + 1], row[:, j]) + 1, before[:, j] + swap)
                if i and j:
                    d = np.where((x[:, i] == y[:, j - 1]) & (x[:, i - 1] == y[:, j]) & ~same, np.minimum(d, older[:, j - 1] + 1), d)
                row[:, j + 1] = d
        out[at] = row[:, m]
    return out


def likeness(names: Names, pairs: pd.DataFrame) -> np.ndarray:
    """How much each ``token`` is like the ``part`` that the ``form`` stands for; 0 where it is not."""
    token, part, form = list(pairs["token"]), list(pairs["part"]), list(pairs["form"])
    own = np.array([p == f for p, f in zip(part, form)], bool)
    size = np.array([max(len(t), len(f)) for t, f in zip(token, form)], float)
    d = np.where(own, 0.0, 0.0)
    for which, alike in ((own, names.alike), (~own, frozenset())):
        at = np.flatnonzero(which)
        d[at] = distances([token[i] for i in at], [form[i] for i in at], alike)
    like = np.where(own, np.where(d <= np.maximum(1, (1 - LEAST_TOKEN) * size), 1 - d / size, 0.0), np.where(d <= 0.3 * size, 0.95 - d / size, 0.0))
    like = np.where(own & (size <= 2) & (like < 0.5), 0.0, like)
    for i in np.flatnonzero(own & (size > 2)):
        t, p = token[i], part[i]
        if t.isascii() and t[:1] == p[:1] and len(sound(t)) > 1 and sound(t) == sound(p):
            like[i] = max(like[i], 0.78)
    return np.where(like >= np.array([LEAST_TOKEN if p.isascii() else 0.5 for p in part]), like, 0.0)


def load_names(terms: DataFrame) -> Names:
    """The reference list and what it teaches."""
    return Names([(r[0], r[1], r[2]) for r in terms.select("eval_id", "canonical", "aliases").where("canonical is not null").collect()])


def _vocabulary(names: Names) -> list[tuple[int, str, str]]:
    """``(place, part, form)``: every part of a name, at its place, as it is spelled or heard."""
    parts = {(k, p) for ps in names.parts.values() for k, p in enumerate(ps)}
    return sorted({(k, p, p) for k, p in parts} | {(k, p, f) for (k, p), forms in names.heard.items() if (k, p) in parts for f in forms})


def map_values(values: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """Each distinct non-blank value of ``column`` with the ``eval_id`` it means."""
    spark = values.sparkSession
    names = load_names(terms)
    shared = spark.sparkContext.broadcast(names)
    distinct = values.select(F.col(f"`{column}`").alias("value")).where(F.col("value").rlike(r"\S")).distinct()
    # the values are few bytes but much work: spread them over all cores, which sizes alone would not
    cores = spark.sparkContext.defaultParallelism
    distinct = distinct.repartition(cores, "value")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(v, n, turn, key, cost, list(ts) if ts else None) for v in batch["value"] for n, (turn, key, cost, ts) in enumerate(shared.value.ways(v))]
            yield pd.DataFrame(rows, columns=["value", "way", "turn", "key", "cost", "tokens"])

    ways = cut(distinct.mapInPandas(read, "value string, way int, turn int, key string, cost double, tokens array<string>"))
    known = spark.createDataFrame(sorted(names.known.items()), "key string, eval_id string")
    told = ways.where("tokens is null").join(known, "key").groupBy("value").agg(F.min_by("eval_id", "turn").alias("told"))

    readings = ways.where("tokens is not null").select("value", "way", "cost", F.size("tokens").alias("n"), F.posexplode("tokens").alias("place", "token"))
    matches = cut(_matches(readings.select("place", "token").distinct().repartition(cores, "token"), names, shared))
    # the readings all of whose tokens are repaired, with every choice of parts
    whole = (
        readings.join(matches, ["place", "token"])
        .groupBy("value", "way", "cost", "n")
        .agg(F.array_sort(F.collect_list(F.struct("place", "parts"))).alias("m"))
        .where(F.size("m") == F.col("n"))
    )
    chosen = "struct(concat(a.parts, if(a.parts = '', '', '|'), x.part) as parts, concat(a.likes, array(x.like)) as likes)"
    start = "array(struct('' as parts, cast(array() as array<double>) as likes))"
    choices = whole.select("value", "cost", F.explode(F.expr(f"aggregate(m, {start}, (acc, p) -> flatten(transform(acc, a -> transform(p.parts, x -> {chosen}))))")).alias("c"))
    weights = sorted((e, "|".join(ps), [float(names.weight[p]) for p in ps]) for e, ps in names.parts.items() if ps)
    entries = spark.createDataFrame(weights, "eval_id string, parts string, w array<double>")
    # soft TF-IDF: a repaired token weighs in the value what its part weighs in the name
    square = "aggregate(w, 0D, (s, x) -> s + x * x)"
    score = F.expr(f"aggregate(zip_with(w, c.likes, (x, l) -> x * x * l), 0D, (s, x) -> s + x) / (sqrt({square}) * sqrt({square}))")
    ranked = choices.join(entries, choices["c.parts"] == entries["parts"]).withColumn("score", score).where((F.col("score") >= LEAST_NAME) & (F.array_min("c.likes") >= 0.5))
    best = ranked.groupBy("value").agg(F.min_by("eval_id", F.struct((F.col("cost") - F.col("score")).alias("s"), "eval_id")).alias("best"))
    out = distinct.join(told, "value", "left").join(best, "value", "left")
    return out.select("value", F.coalesce("told", "best", F.lit(NONE)).alias("eval_id"))


def _matches(wanted: DataFrame, names: Names, shared) -> DataFrame:
    """``(place, token, parts)``: the parts that each token can mean at its place, with their likeness."""
    spark = wanted.sparkSession

    def keyed(column: str):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keys = [[*shared.value.keys(t), *([f"~{t[0]}{sound(t)}"] if t.isascii() and len(sound(t)) > 1 else [])] for t in batch[column]]
                yield batch.assign(keys=keys)

        return work

    vocabulary = spark.createDataFrame(_vocabulary(names), "place int, part string, form string")
    own = vocabulary.mapInPandas(keyed("form"), "place int, part string, form string, keys array<string>").select("place", "part", "form", F.explode("keys").alias("key"))
    ours = wanted.mapInPandas(keyed("token"), "place int, token string, keys array<string>").select("place", "token", F.explode("keys").alias("key"))
    pairs = ours.join(own, ["place", "key"]).where((F.char_length("token") <= 2 * F.char_length("form") + 2) & (F.char_length("form") <= 2 * F.char_length("token") + 2)).select("place", "token", "part", "form").distinct()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = batch.assign(like=likeness(shared.value, batch))
            yield got.loc[got["like"] > 0, ["place", "token", "part", "like"]]

    liked = pairs.mapInPandas(judge, "place int, token string, part string, like double").groupBy("place", "token", "part").agg(F.max("like").alias("like"))
    return liked.groupBy("place", "token").agg(F.array_sort(F.collect_list(F.struct("part", "like"))).alias("parts"))


def found_terms(corrections: DataFrame, terms: DataFrame) -> DataFrame:
    """``(correction_id, side, eval_id)`` of each non-blank text of the ledger."""
    sides = corrections.select(
        F.col("correction_id").cast("bigint").alias("correction_id"),
        F.explode(F.create_map(F.lit("from"), F.col("from_text"), F.lit("to"), F.col("to_text"))).alias("side", "raw"),
    ).withColumn("value", canonical_form(F.col("raw")))
    rows = sides.where(F.col("value").rlike(r"(?U)\S")).select("correction_id", "side", "value").distinct()
    return rows.join(map_values(rows, "value", terms), "value").select("correction_id", "side", "eval_id").distinct()
