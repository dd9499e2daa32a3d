"""Grounding of claims and the joins of reviews, votes and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import text as tx
from turnmill.operators.timeline import SESSION, SPEAKER, in_order

TOLERANCE = 0.5
BUCKET = 60.0


def candidates(norm: DataFrame) -> DataFrame:
    """Segments with the end that evidence may lie before: their own, the next start, or five seconds on."""
    w = in_order()
    a = tx.seconds_or_zero(F.col("start_seconds"))
    nxt = tx.seconds_or_zero(F.lead("start_seconds").over(w))
    end = F.when(F.col("end_seconds") > a, F.col("end_seconds")).when(nxt > a, nxt).otherwise(a + 5)
    return norm.withColumn("a_", a).withColumn("e_", end)


def ground(claims: DataFrame, norm: DataFrame) -> DataFrame:
    """``claim_id, session, at_seconds, quote, speaker_hint`` placed in the one segment that says it.

    A segment must hold the quote and its time, within half a second.  Those of the
    hinted speaker are preferred if there are any; then the nearest start wins, and
    a tie leaves the claim without evidence.  Both sides are cut into minutes, so
    the interval join is a hash join whatever a session's length.
    """
    c = claims.select("claim_id", *SESSION, tx.strict_timestamp(F.col("at_seconds")).alias("t_"), tx.comparable_text(F.col("quote")).alias("q_"), tx.comparable_text(F.col("speaker_hint")).alias("h_"))
    c = c.where("t_ is not null and char_length(q_) >= 2").withColumn("minute_", F.floor(F.col("t_") / BUCKET))
    s = candidates(norm).select(
        *SESSION, "pos", "segment_id", "a_", "e_", tx.comparable_text(F.col("text")).alias("x_"), tx.comparable_text(F.coalesce("speaker", F.lit(SPEAKER))).alias("w_"),
        F.explode(F.sequence(F.floor((F.col("a_") - TOLERANCE) / BUCKET), F.floor((F.col("e_") + TOLERANCE) / BUCKET))).alias("minute_"),
    )
    hit = c.join(s, [*SESSION, "minute_"]).where((F.col("t_") >= F.col("a_") - TOLERANCE) & (F.col("t_") <= F.col("e_") + TOLERANCE) & F.contains("x_", "q_"))
    w = Window.partitionBy("claim_id")
    hit = hit.withColumn("m_", (F.col("h_") != "") & (F.col("w_") == F.col("h_"))).withColumn("any_", F.max("m_").over(w)).where(F.col("m_") | ~F.col("any_"))
    d = F.abs(F.col("a_") - F.col("t_"))
    o = w.orderBy("d_", "pos")
    ranked = hit.withColumn("d_", d).withColumn("r_", F.row_number().over(o)).withColumn("n_", F.lead("d_").over(o))
    return ranked.where((F.col("r_") == 1) & (F.col("n_").isNull() | (F.abs(F.col("n_") - F.col("d_")) >= 1e-9))).select("claim_id", "segment_id", "pos", tx.round_up(F.col("d_"), 1000).alias("distance"))


def unique_quote(text: Column, quote: Column) -> Column:
    """The whole text if the quote occurs in it once (whatever its case), or reads the same; NULL if it repeats or is absent."""
    t = tx.js_trim(text)
    h, n = F.lower(t), F.lower(tx.js_trim(quote))
    at = F.position(n, h)
    again = F.contains(F.substring(h, at + 1, F.char_length(h)), n)
    alike = F.contains(tx.comparable_text(text), tx.comparable_text(quote))
    return F.when((t == "") | (n == ""), None).when(at > 0, F.when(~again, t)).when(alike, t)


def exact_coverage(reviews: DataFrame, wanted: DataFrame, key: str, kind: str) -> DataFrame:
    """Every key must be reviewed once, with its own kind; violations as ``(key, violation)``."""
    r = reviews.groupBy(key).agg(F.count("*").alias("n_"), F.min(kind).alias("kind_"))
    w = wanted.select(key, F.col(kind).alias("want_")).distinct()
    code = (
        F.when(F.col("n_").isNull(), "missing")
        .when(F.col("want_").isNull(), "unknown")
        .when(F.col("n_") > 1, "duplicate")
        .when(~F.col("kind_").eqNullSafe(F.col("want_")), "kind_mismatch")
    )
    return r.join(w, key, "full_outer").select(key, code.alias("violation")).where("violation is not null")


def covered(groups: DataFrame, members: DataFrame, group: str, member: str) -> DataFrame:
    """Relational division: whether every member of a group is covered, and how many are not."""
    have = members.select(member).distinct().withColumn("have_", F.lit(1))
    return (
        groups.select(group, member).distinct().join(have, member, "left").groupBy(group)
        .agg(F.count("*").alias("wanted"), F.count("have_").alias("got"))
        .withColumn("covered", F.col("wanted") == F.col("got"))
    )


def votes(ballots: DataFrame, group: str, choice: str, confidence: str) -> DataFrame:
    """A10: three of three alike and all high is authoritative; else the plurality, at most medium; ties take the lesser choice."""
    w = Window.partitionBy(group).orderBy(F.desc("n"), "c_")
    per = ballots.groupBy(group, F.col(choice).alias("c_")).agg(F.count("*").alias("n"), F.count_if(F.col(confidence) == "high").alias("high"))
    total = per.withColumn("votes", F.sum("n").over(Window.partitionBy(group))).withColumn("options", F.count("*").over(Window.partitionBy(group)))
    best = total.withColumn("r_", F.row_number().over(w)).where("r_ = 1")
    sure = (F.col("votes") >= 3) & (F.col("options") == 1) & (F.col("high") == F.col("votes"))
    return best.select(group, F.col("c_").alias(choice), "votes", F.when(sure, "authoritative").when(F.col("high") > 0, "medium").otherwise("low").alias("standing"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with one key the first in order."""
    return df.withColumn("r_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("r_ = 1").drop("r_")


def keep_last_value(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Of values with one key the last, in the place of the first."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.min(order).alias("place"))


def merge_notes(df: DataFrame, keys: Sequence[str], point: str, order: str, most: int = 12) -> DataFrame:
    """The distinct points of each key in order of appearance, ``most`` of them."""
    first = df.groupBy(*keys, point).agg(F.min(order).alias("o_"))
    ranked = first.withColumn("r_", F.row_number().over(Window.partitionBy(*keys).orderBy("o_", point))).where(F.col("r_") <= most)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r_", point))), lambda x: x[point]).alias("points"))
