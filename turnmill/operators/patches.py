"""Proposed replacements of terms: merged, scoped, judged and applied.

A proposal is a row ``(segment_id, ord, from_text, to_text)``; ``ord`` orders all
proposals.  A naming context is a table ``(alias_key, canonical, reason, conflict)``
with one row an alias, as :func:`turnmill.operators.terms.alias_edges` gives it.

Defined results: a NULL or blank side is an ``invalid_replacement``; a proposal of
a segment that is not there is an ``unknown_segment``; of equal proposals each is
judged for itself; a proposal of a term that occurs several times gives a row for
each occurrence; empty tables give empty results.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.functions import text as tx
from turnmill.operators import terms

_SIGNATURE = ["segment_id", "from_text", "to_text"]


def merge_proposals(model: DataFrame, reusable: DataFrame) -> DataFrame:
    """The model's proposals and, once each, the reusable ones that it does not make itself.

    Signatures are compared as they are: spaces and case tell them apart, and NULL equals NULL.
    """
    same = F.lit(True)
    mine = model.select(*[F.col(c).alias(f"m_{c}") for c in _SIGNATURE]).distinct()
    for c in _SIGNATURE:
        same = same & F.col(c).eqNullSafe(F.col(f"m_{c}"))
    fresh = reusable.join(mine, same, "left_anti")
    first = fresh.groupBy(*_SIGNATURE).agg(F.min("ord").alias("ord"))
    columns = [*_SIGNATURE, "ord"]
    return model.select(*columns, F.lit("model").alias("origin")).unionByName(first.select(*columns, F.lit("reusable").alias("origin")))


def scope_proposals(proposals: DataFrame, index: str, begin: Column, size: Column) -> DataFrame:
    """Each proposal with ``scoped``, and the reason of those outside their batch."""
    at = F.col(index)
    inside = F.coalesce((at >= begin) & (at < begin + size), F.lit(False))
    return proposals.withColumn("scoped", inside).withColumn("reason", F.when(~inside, "out_of_batch_segment"))


def with_mapping(proposals: DataFrame, context: DataFrame) -> DataFrame:
    """Each proposal with its trimmed sides and what the context says of its alias (``canonical``, ``why``, ``conflict``) and of its ``to`` (``to_canonical``, ``to_why``, ``is_canonical``)."""
    p = proposals.withColumn("from_", tx.js_trim(F.coalesce("from_text", F.lit("")))).withColumn("to_", tx.js_trim(F.coalesce("to_text", F.lit(""))))
    p = p.withColumn("from_key", tx.correction_text(F.col("from_"))).withColumn("to_key", tx.correction_text(F.col("to_")))
    own = context.select(F.col("alias_key").alias("from_key"), "canonical", F.col("reason").alias("why"), "conflict")
    other = context.where("not conflict").select(F.col("alias_key").alias("to_key"), F.col("canonical").alias("to_canonical"), F.col("reason").alias("to_why"))
    names = context.select(tx.correction_text(F.col("canonical")).alias("to_key")).distinct().withColumn("is_canonical", F.lit(True))
    return p.join(own, "from_key", "left").join(other, "to_key", "left").join(names, "to_key", "left").withColumn("is_canonical", F.coalesce("is_canonical", F.lit(False)))


def unresolved(mapped: DataFrame) -> DataFrame:
    """The proposals that the context does not settle already.

    Settled is a proposal whose ``to`` leads to the canonical of its alias; inferred
    mappings (``recording_consensus``) are no links of such a chain.
    """
    terminal = F.when(F.col("to_canonical").isNotNull() & (F.col("to_why") != "recording_consensus"), F.col("to_canonical")).otherwise(F.col("to_"))
    settled = F.col("canonical").isNotNull() & ~F.col("conflict") & (tx.nfkc(terminal) == tx.nfkc(F.col("canonical")))
    return mapped.where(~F.coalesce(settled, F.lit(False)))


def naming_reason(mapped: DataFrame) -> Column:
    """The first reason by which names alone speak against a proposal; NULL if none does."""
    usable = F.col("canonical").isNotNull() & ~F.col("conflict")
    return (
        F.when((F.col("from_") == "") | (F.col("to_") == ""), "invalid_replacement")
        .when(F.coalesce("conflict", F.lit(False)), "conflicting_alias_mapping")
        .when(~usable & F.col("is_canonical"), "explicit_alias_required")
        .when(~usable, "unknown_canonical")
        .when(tx.nfkc(F.col("to_")) != tx.nfkc(F.col("canonical")), "canonical_mismatch")
    )


def judged(proposals: DataFrame, context: DataFrame, segments: DataFrame) -> DataFrame:
    """The proposals with ``reason`` (NULL: to be applied), the segment's ``text`` and the ``ranges`` at which the alias stands in it."""
    m = with_mapping(proposals, context)
    j = m.withColumn("reason", naming_reason(m)).join(segments.select("segment_id", "text", F.lit(True).alias("there_")), "segment_id", "left")
    open_ = F.col("reason").isNull() & F.col("there_")
    j = j.withColumn("ranges", F.when(open_, terms.match_ranges(F.coalesce("text", F.lit("")), F.when(open_, F.col("from_")), F.when(open_, F.col("canonical")))))
    return j.withColumn("reason", F.when(F.col("there_").isNull(), "unknown_segment").when(open_ & (F.size("ranges") == 0), "from_not_found").otherwise(F.col("reason")))


def _fits(taken: list[tuple[int, int, str]], start: int, end: int, to: str) -> str:
    """How a range stands to those taken, which are in order and apart: free, the same as one, or overlapping."""
    k = bisect.bisect_left(taken, (start, end, to))
    for near in taken[max(0, k - 1) : k + 1]:
        if near == (start, end, to):
            return "same"
        if start < near[1] and end > near[0]:
            return "overlaps"
    return "free"


def place(text: str | None, proposals: list[dict]) -> tuple[list[dict], list[dict]]:
    """The ranges of a segment's proposals that are placed, none over another, and the candidates that need a check of their facts.

    Proposals are taken in order, the ranges of each from left to right.  A range
    that reads like its canonical already is passed over; the same range again adds nothing.
    """
    taken: list[tuple[int, int, str]] = []
    out: list[dict] = []
    changed = [(text[: x["start"]] + p["canonical"] + text[x["end"] :]) for p in proposals for x in p["ranges"]] if text else []
    kept = iter(_fingerprints([text or "", *changed]))
    own = next(kept)
    for p in proposals:
        for x in p["ranges"]:
            facts, start, end = next(kept), x["start"], x["end"]
            if text[start:end] == p["canonical"]:
                continue
            how = _fits(taken, start, end, p["canonical"])
            if how == "same":
                continue
            reason = "overlapping_replacement" if how == "overlaps" else "critical_fact_change" if facts != own else None
            good = reason is None
            if good:
                bisect.insort(taken, (start, end, p["canonical"]))
            out.append({
                "ord": p["ord"], "from_text": text[start:end] if good else p["from_"], "to_text": p["canonical"] if good else p["to_"], "status": "accepted" if good else "rejected",
                "reason": (p["why"] or "explicit_alias") if good else reason, "start_offset": start if good else None, "end_offset": end if good else None,
            })
    return out, [{"start": a, "end": b, "to": c} for a, b, c in taken]


def _fingerprints(texts: list[str]) -> list[str]:
    return ["|".join(tx.fact_tokens(t)) for t in texts]


_ENTRY = T.StructType([
    T.StructField("ord", T.LongType()), T.StructField("from_text", T.StringType()), T.StructField("to_text", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("start_offset", T.IntegerType()), T.StructField("end_offset", T.IntegerType()),
])


@F.pandas_udf(T.StructType([T.StructField("entries", T.ArrayType(_ENTRY)), T.StructField("text", T.StringType())]))
def _placed(text: pd.Series, proposals: pd.Series) -> pd.DataFrame:
    rows = []
    for t, ps in zip(text, proposals):
        entries, taken = place(t, [{"ord": p["ord"], "from_": p["from_"], "to_": p["to_"], "canonical": p["canonical"], "why": p["why"], "ranges": list(p["ranges"])} for p in ps])
        for x in reversed(taken):
            t = t[: x["start"]] + x["to"] + t[x["end"] :]
        rows.append((entries, t))
    return pd.DataFrame(rows, columns=["entries", "text"])


def apply_proposals(proposals: DataFrame, context: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger ``(segment_id, ord, from_text, to_text, status, reason, start_offset, end_offset)`` and the rewritten texts ``(segment_id, text)``.

    What names or the text alone decide is decided row by row; only the proposals that
    stand somewhere in a segment are brought together, by segment.
    """
    j = judged(proposals, context, segments)
    refused = j.where("reason is not null").select(
        "segment_id", "ord", F.col("from_").alias("from_text"), F.col("to_").alias("to_text"), F.lit("rejected").alias("status"), "reason", F.lit(None).cast("int").alias("start_offset"), F.lit(None).cast("int").alias("end_offset")
    )
    some = (
        j.where("reason is null").groupBy("segment_id")
        .agg(F.first("text").alias("text"), F.array_sort(F.collect_list(F.struct("ord", "from_", "to_", "canonical", "why", "ranges"))).alias("ps"))
        .select("segment_id", _placed("text", "ps").alias("r"))
    )
    placed = some.select("segment_id", F.inline("r.entries"))
    return refused.unionByName(placed), some.select("segment_id", F.col("r.text").alias("text"))


def changed_range(left: Column, right: Column) -> Column:
    """``(start, end)`` of what is new in ``right``: all but the longest common beginning and, in the rest, the longest common end."""
    n = F.least(F.char_length(left), F.char_length(right))
    head = _common(left, right, n)
    # the end is sought in what the beginning leaves of the shorter one
    tail = _common(F.reverse(left), F.reverse(right), n - head)
    return F.struct(head.alias("start"), (F.char_length(right) - tail).alias("end"))


def _common(a: Column, b: Column, most: Column) -> Column:
    """How many characters two texts share at their beginning, at most ``most``: halving the doubt."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(20))])
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when((n + k <= most) & (F.substring(a, F.lit(1), n + k) == F.substring(b, F.lit(1), n + k)), n + k).otherwise(n))


def thinned(lines: DataFrame, keys: list[str], pos: str, cost: Column, most: int) -> DataFrame:
    """The lines of each key that are kept: while they cost too much, every other one, the first and the last are.

    After ``k`` rounds the positions divisible by ``2**k`` and the last are left, so
    the sums of all rounds come from one aggregation and no key is ever brought together.
    ``pos`` counts from 0.
    """
    w = lines.groupBy(*keys).agg(F.max(pos).alias("last_"))
    of_key = F.lit(True)
    for k in keys:
        of_key = of_key & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    l = lines.withColumn("cost_", cost).join(w.select(*[F.col(k).alias(f"k_{k}") for k in keys], "last_"), of_key)
    stays = [(F.col(pos) % (1 << k) == 0) | (F.col(pos) == F.col("last_")) for k in range(31)]
    sums = l.groupBy(*[f"k_{k}" for k in keys]).agg(*[F.sum(F.when(s, F.col("cost_") + 1)).alias(f"c{i}_") for i, s in enumerate(stays)], *[F.count_if(s).alias(f"n{i}_") for i, s in enumerate(stays)])
    fits = F.array(*[F.when((F.col(f"c{i}_") - 1 <= most) | (F.col(f"n{i}_") <= 2), i) for i in range(31)])
    rounds = sums.select(*[F.col(f"k_{k}").alias(f"r_{k}") for k in keys], F.array_min(F.filter(fits, lambda x: x.isNotNull())).alias("rounds"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"k_{k}").eqNullSafe(F.col(f"r_{k}"))
    out = l.join(rounds, same)
    return out.where((F.col(pos) % F.expr("shiftleft(1, rounds)") == 0) | (F.col(pos) == F.col("last_"))).select(*lines.columns, "rounds")


def excerpts(text: Column, size: int, most: int = 3) -> Column:
    """The text if it is short enough, or its distinct excerpts at the beginning, the middle and the end."""
    t = tx.js_trim(text)
    last = F.char_length(t) - size
    cut = lambda at: tx.js_trim(F.substring(t, at.cast("int") + 1, F.lit(size)))
    three = F.array(cut(F.lit(0)), cut(F.floor(last / 2)), cut(last))
    some = F.filter(F.array_distinct(three), lambda x: x != "")
    return F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>")).when(F.char_length(t) <= size, F.array(t)).otherwise(F.slice(some, 1, most))


def first_use(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the one that comes first."""
    return rows.withColumn("u_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("u_ = 1").drop("u_")
