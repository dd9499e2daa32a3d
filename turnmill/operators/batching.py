"""Prompt fragments, size-bounded batches, representative picks and lexical retrieval."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import text as tx
from turnmill.operators.timeline import SESSION, SPEAKER, in_sequence

LINE = 2000
BATCH = 17_700


def fragments(norm: DataFrame, most: int = LINE) -> DataFrame:
    """Lines ``[mm:ss] speaker：text``, long texts over several lines; ``ord`` counts a session's lines."""
    speaker = tx.truncate_text(F.coalesce(F.nullif("speaker", F.lit("")), F.lit(SPEAKER)), 80)
    rows = norm.withColumn("who", speaker).withColumn("prefix", F.concat(F.lit("["), tx.clock(F.col("start_seconds")), F.lit("] "), F.col("who"), F.lit("：")))
    step = F.greatest(F.lit(1), most - F.char_length("prefix"))
    rows = rows.withColumn("step", step).withColumn("at", F.explode(F.sequence(F.lit(0), F.char_length("text") - 1, F.col("step"))))
    part = F.substring(F.col("text"), F.col("at") + 1, F.col("step"))
    ord_ = F.row_number().over(Window.partitionBy(*SESSION).orderBy("pos", "at")) - 1
    return rows.select(*SESSION, "pos", ord_.alias("ord"), F.concat("prefix", part).alias("line"), F.concat("who", F.lit(" "), part).alias("searchable"))


def greedy_batches(df: DataFrame, keys: Sequence[str], order: str, cost: Column, most: int, separator: int) -> DataFrame:
    """The batch of each row when rows are packed in order and a batch may cost ``most`` at the most.

    The running cost starts anew with each batch, which no window frame can say;
    rows stream through in order, one number each, and what is kept between rows
    is one batch's size, however many rows a key has.
    """
    n = len(keys)
    rows = df.select(*keys, F.col(order).cast("bigint").alias(order), cost.cast("bigint").alias("c_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys) + f", `{order}` bigint, batch bigint"

    def step(state: list, row: tuple) -> Iterator[tuple]:
        key, c = row[:n], row[n + 1]
        if not state or state[0] != key:
            state[:] = [key, 0, c]
        elif state[2] + separator + c > most:
            state[:] = [key, state[1] + 1, c]
        else:
            state[2] += separator + c
        yield (*row[: n + 1], state[1])

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, order)
    return ordered.mapInPandas(in_sequence(step, [*keys, order, "batch"]), schema)


def round_robin(df: DataFrame, keys: Sequence[str], speaker: str, order: str, groups: int = 30, each: int = 40, most: int = 120) -> DataFrame:
    """Speakers taken in turn: at most ``groups`` of them by first appearance, ``each`` rows of each, ``most`` in all."""
    w = Window.partitionBy(*keys, speaker)
    rows = df.withColumn("first_", F.min(order).over(w)).withColumn("turn_", F.row_number().over(w.orderBy(order)))
    rows = rows.withColumn("rank_", F.dense_rank().over(Window.partitionBy(*keys).orderBy("first_")))
    rows = rows.where((F.col("rank_") <= groups) & (F.col("turn_") <= each))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("turn_", "first_"))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("first_", "turn_", "rank_")


def representatives(df: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """Of each group the first, the longest in between (the earliest of several) and the last row's order."""
    w = Window.partitionBy(*keys)
    rows = df.select(*keys, F.col(order).alias("o_"), F.char_length(text).alias("n_"), F.min(order).over(w).alias("a_"), F.max(order).over(w).alias("z_"))
    inner = (F.col("o_") > F.col("a_")) & (F.col("o_") < F.col("z_"))
    return rows.groupBy(*keys).agg(F.min("o_").alias("first"), F.max_by("o_", F.when(inner, F.struct("n_", -F.col("o_")))).alias("middle"), F.max("o_").alias("last"))


def lexical_scores(lines: DataFrame, questions: DataFrame, keys: Sequence[str], question: str) -> DataFrame:
    """O2: the score of each line for its session's question: the lengths, less one, of the question's tokens it holds."""
    q = questions.select(*keys, tx.retrieval_tokens(F.col(question)).alias("tokens_"))
    rows = lines.join(q, list(keys)).withColumn("hay_", tx.comparable_text(F.col("searchable")))
    score = F.aggregate(
        F.filter("tokens_", lambda t: F.contains(F.col("hay_"), t)), F.lit(0), lambda a, t: a + F.greatest(F.lit(1), F.char_length(t) - 1)
    )
    return rows.withColumn("score", score).drop("tokens_", "hay_")


def priorities(scored: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The order in which lines are considered: hits by score, then their neighbours; or, without hits, both ends in turn."""
    w = Window.partitionBy(*keys)
    rows = scored.select(*keys, F.col(order).alias("o_"), "score", F.max("score").over(w).alias("best_"), F.count("*").over(w).alias("n_"))
    rank = F.row_number().over(w.orderBy(F.desc("score"), "o_"))
    hits = rows.where("score > 0").withColumn("r_", rank)
    own = hits.select(*keys, "o_", F.struct(F.lit(0).alias("a"), F.col("r_").alias("b"), F.lit(0).alias("c")).alias("p_"), "n_")
    near = hits.select(*keys, F.posexplode(F.array(F.col("o_") - 1, F.col("o_") + 1)).alias("i_", "x_"), "r_", "n_").where("x_ >= 0 and x_ < n_")
    near = near.select(*keys, F.col("x_").alias("o_"), F.struct(F.lit(1).alias("a"), F.col("r_").alias("b"), F.col("i_").alias("c")).alias("p_"), "n_")
    ends = rows.where("best_ = 0").select(*keys, "o_", F.struct(F.lit(2).alias("a"), F.least(F.col("o_"), F.col("n_") - 1 - F.col("o_")).cast("int").alias("b"), F.col("o_").cast("int").alias("c")).alias("p_"), "n_")
    ends = ends.withColumn("p_", F.struct(F.col("p_.a").alias("a"), F.col("p_.b").alias("b"), F.when(F.col("p_.c") == F.col("p_.b"), 0).otherwise(1).alias("c")))
    every = own.unionByName(near).unionByName(ends).groupBy(*keys, "o_").agg(F.min("p_").alias("p_"))
    return every.select(*keys, F.col("o_").alias(order), F.row_number().over(w.orderBy("p_")).alias("priority"))


def pack_by_priority(rows: DataFrame, keys: Sequence[str], order: str, priority: str, size: str, most: int) -> DataFrame:
    """O2: rows taken by priority, those skipped that no longer fit; a separator costs one.  Rows stream through; only the size so far is kept."""
    n = len(keys)
    r = rows.select(*keys, F.col(order).cast("bigint").alias(order), F.col(priority).cast("bigint").alias("p_"), F.col(size).cast("bigint").alias("s_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in r.schema.fields if f.name in keys) + f", `{order}` bigint"

    def step(state: list, row: tuple) -> Iterator[tuple]:
        if not state or state[0] != row[:n]:
            state[:] = [row[:n], 0]
        cost = row[n + 2] + (1 if state[1] else 0)
        if state[1] + cost <= most:
            state[1] += cost
            yield row[: n + 1]

    return r.repartition(*keys).sortWithinPartitions(*keys, "p_").mapInPandas(in_sequence(step, [*keys, order]), schema)
