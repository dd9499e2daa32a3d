"""Overlapping and gapped intervals: run bitmaps per entity and time shard.

Time is discretised into whole milliseconds.  An entity's covered milliseconds
form a bitmap, kept in run form: an ordered array of ``(s, e, cut)`` with
``[s, e)`` set.  The bitmap is split into shards of ``2**16`` ms, so no task
ever holds more than 65,536 runs of an entity, however hot it is:

1. every interval is clipped to the shards it touches; of several runs with one
   start only the longest is kept (map-side ``max``), which bounds a shard;
2. the runs of a shard are united (:func:`union_runs`);
3. inner set runs are periods and the clear runs between them are gaps, final
   at once; only the first and the last run of a shard go on to the next level,
   which unites at most 1,024 shards, and so on up to the whole entity.

``cut`` marks a run whose right neighbour stood in the same shard: the clear
run between the two is already reported.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.runtime import cut

SHARD_BITS = 16
FANOUT_BITS = 10
LEVELS = 3

_RUN = "struct<s:bigint,e:bigint,cut:boolean>"


def to_millis(seconds: Column) -> Column:
    """Seconds to whole milliseconds, half up; NULL for NULL, NaN and infinities."""
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(9.0e12))
    return F.when(finite, F.floor(seconds * 1000 + 0.5).cast("bigint"))


def union_runs(runs: Column) -> Column:
    """Unite an array of runs: sorted, disjoint, not touching unless marked ``cut``."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & ~last["cut"] & (x["s"] <= last["e"])
        grown = F.struct(
            last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), x["cut"].alias("cut")
        )
        return F.when(
            joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))
        ).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(runs), F.expr(f"cast(array() as array<{_RUN}>)"), step)


def _level(df: DataFrame, keys: Sequence[str], shard: Column, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Unite the runs of each shard; the finished spans, and what the next level must still join."""
    by = [*keys, "shard_"]
    runs = (
        df.withColumn("shard_", shard)
        .groupBy(*by)
        .agg(F.collect_list(F.struct("s", "e", "cut")).alias("r_"))
        .withColumn("r_", union_runs(F.col("r_")))
        .withColumn("n_", F.size("r_"))
    )
    gaps = F.expr(
        "transform(filter(sequence(1, n_), i -> i < n_ and not r_[i - 1].cut),"
        " i -> struct('gap' as span_kind, r_[i - 1].e as start_ms, r_[i].s as end_ms))"
    )
    first, upto = ("1", "n_") if last else ("2", "n_ - 2")
    done = F.expr(
        f"transform(slice(r_, {first}, greatest({upto}, 0)),"
        " x -> struct('period' as span_kind, x.s as start_ms, x.e as end_ms))"
    )
    ends = F.expr(
        "if(n_ = 1, r_, array(struct(r_[0].s as s, r_[0].e as e, true as cut),"
        " struct(r_[n_ - 1].s as s, r_[n_ - 1].e as e, false as cut)))"
    )
    both = runs.select(*by, F.concat(done, gaps).alias("spans_"), ends.alias("ends_"))
    return both, None if last else both.select(*keys, "shard_", F.inline("ends_"))


def merge_intervals(df: DataFrame, keys: Sequence[str], start_ms: str, end_ms: str) -> DataFrame:
    """Continuous periods of each entity and the gaps between successive periods.

    ``keys`` name the entity; NULL keys form an entity of their own.  Rows whose
    start or end is NULL, or whose end is not after the start, carry no interval.
    Overlapping, nested and touching intervals form one period; repeated rows
    and ties change nothing; further columns are ignored.  An empty table gives
    an empty result.

    Returns ``(*keys, span_kind, start_ms, end_ms)``; ``span_kind`` is ``period``
    or ``gap``.
    """
    names = [f"k{i}_" for i in range(len(keys))]
    width = 1 << SHARD_BITS
    pieces = (
        df.select(
            *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)],
            F.col(f"`{start_ms}`").cast("bigint").alias("a_"),
            F.col(f"`{end_ms}`").cast("bigint").alias("b_"),
        )
        .where("a_ < b_")
        .withColumn("shard_", F.explode(F.expr(f"sequence(shiftright(a_, {SHARD_BITS}), shiftright(b_ - 1, {SHARD_BITS}))")))
        .select(
            *names,
            "shard_",
            F.greatest("a_", F.col("shard_") * width).alias("s"),
            F.least("b_", (F.col("shard_") + 1) * width).alias("e"),
        )
        .groupBy(*names, "shard_", "s")
        .agg(F.max("e").alias("e"))
        .withColumn("cut", F.lit(False))
    )
    spans = []
    level = pieces
    for i in range(LEVELS + 1):
        last = i == LEVELS
        shard = F.col("shard_") if i == 0 else F.lit(0) if last else F.shiftright("shard_", FANOUT_BITS)
        both, level = _level(level, names, shard, last)
        if i == 0:  # read the input once, though every later level builds on this one
            both = cut(both)
            level = both.select(*names, "shard_", F.inline("ends_"))
        spans.append(both.select(*names, F.inline("spans_")))
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "span_kind", "start_ms", "end_ms")


def session_spans(segments: DataFrame) -> DataFrame:
    """Periods and gaps of every transcript session; see :func:`merge_intervals`."""
    timed = segments.select(
        "recording_id",
        "session_no",
        to_millis(F.col("start_seconds")).alias("start_ms"),
        to_millis(F.col("end_seconds")).alias("end_ms"),
    )
    return merge_intervals(timed, ["recording_id", "session_no"], "start_ms", "end_ms")
