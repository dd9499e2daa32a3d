"""Ordered transcript segments: normalisation, timing, boundaries, joins and cues.

A transcript is a ``(recording_id, session_no)``; its order is carried in ``pos``.
Everything but the budgeted joins is a window over the session; those stream
through in order with a constant state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import text as tx

SESSION = ["recording_id", "session_no"]
READABLE_CHARACTERS = 800
READABLE_SECONDS = 90.0
JOIN_GAP = 3.0
JOIN_OVERLAP = 0.25
SPEAKER = "发言人"
FIRST_SPEAKER = "发言人 1"


def distinct_segments(segments: DataFrame) -> DataFrame:
    """Each segment once; redeliveries differ in ``ingested_at`` only."""
    return segments.select(
        "segment_id", *SESSION, "seg_idx", "start_seconds", "end_seconds", "timing_source", "speaker", "text", "join_next"
    ).dropDuplicates(["segment_id"])


def timing_source() -> Column:
    """P2."""
    given = F.col("timing_source").isin("provider", "inferred")
    good = (F.col("start_seconds") >= 0) & (F.col("end_seconds") > F.col("start_seconds"))
    return F.when(given, F.col("timing_source")).when(good, "provider").otherwise("inferred")


def in_order() -> Window:
    return Window.partitionBy(*SESSION).orderBy("pos")


def normalized(segments: DataFrame) -> DataFrame:
    """Blank segments dropped, stable order by start (an invalid one last), positions from 0."""
    df = distinct_segments(segments).withColumn("text", tx.js_trim(F.col("text"))).where("text != ''")
    df = df.withColumn("timing_source", timing_source()).withColumn("speaker", F.coalesce(F.nullif("speaker", F.lit("")), F.lit(FIRST_SPEAKER)))
    start = F.when(F.col("start_seconds") >= 0, F.col("start_seconds")).otherwise(F.lit(float("inf")))
    w = Window.partitionBy(*SESSION).orderBy(start, "seg_idx", "segment_id")
    return df.withColumn("pos", F.row_number().over(w) - 1)


def offset_segments(norm: DataFrame, duration: Column, offset: Column) -> DataFrame:
    """Chunk-local times made absolute, bounded by the chunk, missing ends filled from the next start."""
    bound = F.greatest(duration, F.lit(0.0))
    start = F.least(bound, tx.seconds_or_zero(F.col("start_seconds")))
    df = norm.withColumn("bound_", bound).withColumn("offset_", offset).withColumn("s_", start)
    w = Window.partitionBy(*SESSION).orderBy("s_", "pos")
    following = F.lead("s_").over(w)
    own = F.when(F.col("end_seconds").isNotNull(), F.least(F.col("bound_"), F.greatest(F.col("end_seconds"), F.lit(0.0))))
    end = F.when(own > F.col("s_"), own).when(following > F.col("s_"), following).otherwise(F.col("bound_"))
    return df.withColumn("e_", end).withColumns(
        {"start_seconds": F.col("s_") + F.col("offset_"), "end_seconds": F.least(F.col("bound_"), F.greatest(F.col("s_"), F.col("e_"))) + F.col("offset_")}
    ).drop("bound_", "offset_", "s_", "e_")


# Hesitation sounds that may repeat over a boundary, and the signs around them.
FILLERS = "嗯呃啊哦"
FILLER_SIGNS = "，,。！？!?、"
_AROUND = f"[{tx.SPACES}{FILLER_SIGNS}]"
FILLER_END = f"([{FILLERS}]){_AROUND}*$"
FILLER_HEAD = f"^{_AROUND}*([{FILLERS}])(?:{_AROUND}+|$)"


def boundaries(norm: DataFrame) -> DataFrame:
    """A hesitation sound that ends one segment is taken off the head of the next.

    Both must be of one speaker, overlap in provider time, and something must be
    left.  A removal never changes what the following boundary looks at, so one
    lag over the source texts is enough.
    """
    w = in_order()
    previous = {c: F.lag(c).over(w) for c in ("text", "speaker", "end_seconds", "timing_source")}
    same = F.lower(tx.js_trim(previous["speaker"])) == F.lower(tx.js_trim(F.col("speaker")))
    overlap = (previous["timing_source"] == "provider") & (F.col("timing_source") == "provider") & (previous["end_seconds"] > F.col("start_seconds"))
    sound = F.regexp_extract(previous["text"], FILLER_END, 1)
    own = F.regexp_extract(F.col("text"), FILLER_HEAD, 1)
    rest = F.regexp_replace(F.col("text"), FILLER_HEAD, "")
    removes = F.coalesce(same & overlap & (sound != "") & (sound == own) & (rest != ""), F.lit(False))
    return norm.withColumn("removes", removes).withColumn("after", F.when(F.col("removes"), rest).otherwise(F.col("text")))


def reconciliations(norm: DataFrame, version: str = "boundary-v1") -> DataFrame:
    """The ledger of boundary removals, one row each, with hash, span and reason."""
    df = boundaries(norm).where("removes")
    cut = F.char_length("text") - F.char_length("after")
    return df.select(
        F.lit(version).alias("algorithm_version"),
        *SESSION,
        "pos",
        tx.source_hash(F.col("pos"), F.col("start_seconds"), F.col("end_seconds"), F.col("speaker"), F.col("text")).alias("source_hash"),
        F.lit(0).alias("start_offset"),
        cut.alias("end_offset"),
        F.expr("substring(text, 1, char_length(text) - char_length(after))").alias("from_text"),
        F.lit("").alias("to_text"),
        tx.round_up(F.col("start_seconds"), 1000).alias("at_seconds"),
        F.lit("chinese_filler_overlap").alias("reason"),
        cut.alias("removed_characters"),
        F.lit("next").alias("removed_from"),
    )


def replay_reconciliations(norm: DataFrame, ledger: DataFrame) -> DataFrame:
    """The texts after replay, for the sessions whose whole ledger is derived again field by field; others give no row."""
    fields = ["algorithm_version", "source_hash", "start_offset", "end_offset", "from_text", "to_text", "at_seconds", "reason", "removed_characters", "removed_from"]
    mine = reconciliations(norm).select(*SESSION, "pos", F.struct(*fields).alias("mine_"))
    theirs = ledger.select(*SESSION, "pos", F.struct(*fields).alias("theirs_"))
    bad = theirs.join(mine, [*SESSION, "pos"], "left").where(~F.col("mine_").eqNullSafe(F.col("theirs_"))).select(*SESSION).distinct()
    told = ledger.select(*SESSION, "pos", F.lit(True).alias("told_")).distinct()
    return (
        boundaries(norm)
        .join(bad, SESSION, "left_anti")
        .join(told, [*SESSION, "pos"], "left")
        .withColumn("text", F.when(F.col("told_"), F.col("after")).otherwise(F.col("text")))
        .drop("told_", "after", "removes")
    )


def joinable(norm: DataFrame) -> DataFrame:
    """whether each segment may be joined to the next one, and the gap between them."""
    w = in_order()
    nxt = {c: F.lead(c).over(w) for c in ("speaker", "start_seconds")}
    a, b = F.greatest("start_seconds", F.lit(0.0)), F.greatest(nxt["start_seconds"], F.lit(0.0))
    gap = b - F.col("end_seconds")
    ok = (
        (tx.comparable_text(F.col("speaker")) == tx.comparable_text(nxt["speaker"]))
        & (b >= a) & (F.col("end_seconds") > a) & (gap >= -JOIN_OVERLAP) & (gap <= JOIN_GAP)
    )
    return norm.withColumn("gap_seconds", tx.round_up(gap, 1000)).withColumn("joinable", F.coalesce(ok, F.lit(False)))


def in_sequence(step: Callable[[list, list], Iterator[tuple]], columns: Sequence[str]):
    """A ``mapInPandas`` function for rows sorted by session and position: ``step(state, row)`` gives output rows; state is one list a partition."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list = []
        for batch in batches:
            rows = [out for row in zip(*[batch[c].tolist() for c in batch.columns]) for out in step(state, row)]
            yield pd.DataFrame(rows, columns=list(columns))

    return work


def _number(x: float | None) -> float:
    return float(x) if x is not None and x == x else 0.0


def _join_step(state: list, row: tuple) -> Iterator[tuple]:
    """A paragraph goes on while joins are proposed and possible and its budgets hold."""
    recording, session, pos, start, end, size, stops, space, goes_on = row
    a, e = max(0.0, _number(start)), _number(end)
    joined = reach = None
    if state and state[0] == (recording, session) and state[5]:
        # the text joined so far loses its closing stops when another follows
        joined, reach = state[2] - state[6] + state[7] + size, max(state[4], e or _number(start) or state[4])
    if joined is not None and joined <= READABLE_CHARACTERS and reach - state[3] <= READABLE_SECONDS:
        head, began = state[1], state[3]
        state[:] = [(recording, session), head, joined, began, reach, goes_on, stops, space]
    else:
        state[:] = [(recording, session), pos, size, a, max(a, e or a), goes_on, stops, space]
    yield recording, session, pos, state[1]


def semantic_joins(norm: DataFrame) -> DataFrame:
    """Each segment's paragraph (the position it begins at), and whether its proposed join to the next one holds.

    Sessions stream through in order, a few numbers a row; what is kept between
    rows is one paragraph's state, however long the session.
    """
    w = in_order()
    text, nxt = F.col("text"), F.lead("text").over(w)
    bare = tx.strip_boundary(text)
    space = F.char_length(tx.join_texts(bare, nxt)) > F.char_length(bare) + F.char_length(nxt)
    rows = joinable(norm).select(
        *SESSION, "pos", "start_seconds", "end_seconds", F.char_length(text).alias("size"), (F.char_length(text) - F.char_length(bare)).alias("stops"),
        F.coalesce(space, F.lit(False)).cast("int").alias("space_next"), (F.coalesce("join_next", F.lit(False)) & F.col("joinable")).alias("goes_on"),
    )
    names = [*SESSION, "pos", "paragraph"]
    out = rows.repartition(*SESSION).sortWithinPartitions(*SESSION, "pos").mapInPandas(in_sequence(_join_step, names), "recording_id string, session_no int, pos int, paragraph int")
    last = F.lead("paragraph").over(Window.partitionBy(*SESSION).orderBy("pos"))
    return out.withColumn("accepted", F.coalesce(last == F.col("paragraph"), F.lit(False)))


def paragraphs(norm: DataFrame) -> DataFrame:
    """The readable paragraphs, with the segments each is made of."""
    joined = norm.join(semantic_joins(norm), [*SESSION, "pos"])
    piece = F.when(F.col("accepted"), tx.strip_boundary(F.col("text"))).otherwise(F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece"), "segment_id")))
    return (
        joined.groupBy(*SESSION, "paragraph")
        .agg(F.min("start_seconds").alias("start_seconds"), F.max("end_seconds").alias("end_seconds"), F.min_by("speaker", "pos").alias("speaker"), rows.alias("rows"))
        .select(
            *SESSION, "paragraph", "start_seconds", "end_seconds", "speaker",
            F.aggregate("rows", F.lit(""), lambda acc, x: tx.join_texts(acc, x["piece"])).alias("text"),
            F.col("rows.segment_id").alias("segment_ids"),
        )
    )


def cues(norm: DataFrame) -> DataFrame:
    """One caption cue a segment; its end is its own, the next start, or four seconds on."""
    w = in_order()
    a = tx.seconds_or_zero(F.col("start_seconds"))
    nxt = tx.seconds_or_zero(F.lead("start_seconds").over(w))
    end = F.when(F.col("end_seconds") > a, F.col("end_seconds")).when(nxt > a, nxt).otherwise(a + 4)
    cue = F.concat(F.coalesce("speaker", F.lit(SPEAKER)), F.lit("："), F.col("text"))
    return norm.select(*SESSION, "pos", (F.col("pos") + 1).alias("number"), F.concat(tx.clock(a, True), F.lit(" --> "), tx.clock(end, True)).alias("timing"), cue.alias("cue"))


def temporal_overlap(norm: DataFrame, least: float = 0.25) -> DataFrame:
    """Seconds by which each segment overlaps the one before, where both times are the provider's."""
    w = in_order()
    p = {c: F.lag(c).over(w) for c in ("start_seconds", "end_seconds", "timing_source")}
    sure = (F.col("timing_source") == "provider") & (p["timing_source"] == "provider") & (F.col("end_seconds") > F.col("start_seconds")) & (p["end_seconds"] > p["start_seconds"])
    seconds = F.greatest(F.lit(0.0), F.least(p["end_seconds"], F.col("end_seconds")) - F.greatest(p["start_seconds"], F.col("start_seconds")))
    return norm.withColumn("overlap_seconds", F.when(sure, tx.round_up(seconds, 1000)).otherwise(0.0)).withColumn(
        "overlaps", F.coalesce(sure & (seconds >= least), F.lit(False))
    )


def committed_prefix(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """How many indices from 0 on are there without a gap, and whether the whole run is contiguous."""
    d = df.select(*keys, F.col(index).cast("bigint").alias("i_")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("i_")) - 1
    return (
        d.withColumn("ok_", F.col("i_") == rank)
        .groupBy(*keys)
        .agg(F.count_if("ok_").alias("prefix"), F.count("*").alias("n"), (F.max("i_") + 1).alias("high"))
        .withColumn("contiguous", (F.col("prefix") == F.col("n")) & (F.col("high") == F.col("n")))
    )


def _expand(rows: pd.DataFrame) -> pd.DataFrame:
    """W6 over one island: the group around each segment, grown backward and then forward within the budgets."""
    rows = rows.sort_values("pos").reset_index(drop=True)
    n = len(rows)
    size, space = rows["size"].tolist(), rows["space_next"].astype(int).tolist()
    start = [max(0.0, x) if x == x else 0.0 for x in rows["start_seconds"]]
    end = [e if e == e and e else s for e, s in zip(rows["end_seconds"], start)]
    first, last = [], []
    for i in range(n):
        a = b = i
        length, reach = size[i], max(start[i], end[i])
        while a > 0 and length + size[a - 1] + space[a - 1] <= READABLE_CHARACTERS and reach - start[a - 1] <= READABLE_SECONDS:
            a -= 1
            length += size[a] + space[a]
        while b < n - 1 and length + size[b + 1] + space[b] <= READABLE_CHARACTERS and max(reach, end[b + 1]) - start[a] <= READABLE_SECONDS:
            length += size[b + 1] + space[b]
            b += 1
            reach = max(reach, end[b])
        first.append(int(rows["pos"][a]))
        last.append(int(rows["pos"][b]))
    return rows[[*SESSION, "pos"]].assign(first=first, last=last)


def context_groups(norm: DataFrame) -> DataFrame:
    """The first and the last position of the joined text around each segment."""
    w = in_order()
    text, nxt = F.col("text"), F.lead("text").over(w)
    space = F.char_length(tx.join_texts(text, nxt)) > F.char_length(text) + F.char_length(nxt)
    rows = joinable(norm).select(
        *SESSION, "pos", "start_seconds", "end_seconds", F.char_length(text).alias("size"), F.coalesce(space, F.lit(False)).alias("space_next"),
        (F.coalesce("join_next", F.lit(False)) & F.col("joinable")).alias("goes_on"),
    )
    rows = rows.withColumn("from_last", F.coalesce(F.lag("goes_on").over(w), F.lit(False)))
    rows = rows.withColumn("island", F.max(F.when(~F.col("from_last"), F.col("pos"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    alone = rows.where("not from_last and not goes_on").select(*SESSION, "pos", F.col("pos").alias("first"), F.col("pos").alias("last"))
    grown = rows.where("from_last or goes_on").groupBy(*SESSION, "island").applyInPandas(_expand, "recording_id string, session_no int, pos int, first int, last int")
    return alone.unionByName(grown)
