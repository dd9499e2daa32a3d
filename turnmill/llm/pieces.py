"""Splitting oversized texts at natural boundaries.

Dynamic programming over boundary positions: of all cut sequences whose pieces
keep the length limit, the one with the least sum of cut penalties and of
squared deviations from an even size is taken; among equals the earliest cut.
A piece after the first begins with the last ``overlap`` characters of the piece
before it.  Where no natural boundary lies within reach, cuts between characters are
allowed on a grid of ``HARD_STEP``; none tears a combined character apart.

Defined results: NULL and texts within the limit come out as one piece equal to
the text (an empty text as one empty piece, NULL as no piece).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 800
OVERLAP = 80

_CLOSERS = "\"'”’）)】』」》\\]"
# (pattern whose match END is a boundary, penalty); the lowest penalty of a position counts
_BOUNDARIES = [
    (re.compile(r"\n[ \t\r]*\n\s*"), 0.0),
    (re.compile(r"\r?\n"), 0.02),
    (re.compile(f"(?:[。！？!?…]+|\\.(?=[\\s{_CLOSERS}]|$))[{_CLOSERS}]*\\s*"), 0.05),
    (re.compile(r"[；;]\s*"), 0.12),
    (re.compile(r"[，,、：:]\s*"), 0.2),
    (re.compile(r"\s+"), 0.5),
]
HARD = 4.0
HARD_STEP = 8
SIZE_WEIGHT = 1.0
_TIED = re.compile("[̀-ͯ᪰-᫿‍⃐-⃿︀-️︠-︯\U0001f3fb-\U0001f3ff\U000e0020-\U000e007f]")


def boundaries(text: str, limit: int, overlap: int) -> tuple[list[int], list[float]]:
    """Cut positions in order and their penalties; the text's end is the last."""
    cost: dict[int, float] = {}
    for pattern, penalty in _BOUNDARIES:
        for m in pattern.finditer(text):
            if penalty < cost.get(m.end(), HARD):
                cost[m.end()] = penalty
    n = len(text)
    cost.pop(0, None)
    cost[n] = 0.0
    natural = sorted(cost)
    reach = limit - overlap
    before = 0
    for position in natural:
        if position - before > reach // 2:  # too far apart to rely on: cuts between characters, on a grid
            step = min(HARD_STEP, max(1, reach // 4))
            for p in range(before + step, position, step):
                while p < position and (_TIED.match(text, p) or text[p - 1] == "\u200d"):
                    p += 1
                if p < position:
                    cost.setdefault(p, HARD)
        before = position
    places = sorted(cost)
    return places, [cost[p] for p in places]


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of ``text``, overlaps included."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    places, costs = boundaries(text, limit, overlap)
    step = limit - overlap
    even = n / -(-(n - overlap) // step)  # new characters of a piece when all are alike
    at, best = np.array(places, float), np.full(len(places), np.inf)
    back = np.full(len(places), -1)
    for j, end in enumerate(places):
        if end <= limit and (end > overlap or end == n):
            best[j] = costs[j] + SIZE_WEIGHT * ((end - even) / even) ** 2
        i = bisect_left(places, end - step)
        if i < j:
            total = best[i:j] + SIZE_WEIGHT * ((end - even - at[i:j]) / even) ** 2
            k = int(total.argmin())
            if total[k] + costs[j] < best[j]:
                best[j], back[j] = total[k] + costs[j], i + k
    if best[-1] == np.inf:  # tied characters fill a whole reach: cut them
        ends = [*range(limit, n, step), n]
    else:
        ends, j = [], len(places) - 1
        while j >= 0:
            ends.append(places[j])
            j = int(back[j])
        ends.reverse()
    return [(max(0, a - overlap), b) for a, b in zip([0, *ends], ends)]


def split_long(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(key, piece_no, start_offset, end_offset, piece)`` of the texts of more than ``limit`` characters.

    Texts within the limit never leave the JVM and give no row here; lengths and
    offsets count code points.  A repeated key with the same text counts once.
    """
    key_type = df.schema[key].dataType.simpleString()
    long = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where(F.char_length("text") > limit)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, no, a, b, t[a:b])
                for k, t in zip(batch["key"], batch["text"])
                for no, (a, b) in enumerate(cuts(t, limit, overlap))
            ]
            yield pd.DataFrame(rows, columns=["key", "piece_no", "start_offset", "end_offset", "piece"])

    out = long.distinct().mapInPandas(
        work, f"key {key_type}, piece_no int, start_offset int, end_offset int, piece string"
    )
    return out.withColumnRenamed("key", key)


def rejoined(pieces: DataFrame, key: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(key, text, fits)``: the texts that the pieces make up again, and whether each keeps the limit and begins with the end of the one before."""
    order = Window.partitionBy(key).orderBy("piece_no")
    before = F.lag("piece").over(order)
    shared = F.when(before.isNull(), 0).otherwise(F.lag("end_offset").over(order) - F.col("start_offset"))
    p = pieces.withColumn("before_", before).withColumn("shared_", shared)
    good = (F.char_length("piece") <= limit) & (F.col("before_").isNull() | ((F.col("shared_") == overlap) & (F.substring(F.col("piece"), F.lit(1), F.col("shared_")) == F.expr("right(before_, shared_)"))))
    fresh = F.substring(F.col("piece"), F.col("shared_") + 1, F.char_length("piece"))
    # the pieces of one text, which is one row's own size
    joined = p.select(key, good.alias("good_"), F.struct("piece_no", fresh.alias("t")).alias("x_")).groupBy(key).agg(F.array_sort(F.collect_list("x_")).alias("x_"), F.min("good_").alias("fits"))
    return joined.select(key, F.array_join(F.transform("x_", lambda x: x["t"]), "").alias("text"), "fits")


def found_long(segments: DataFrame) -> DataFrame:
    """The segments that had to be split."""
    return split_long(segments, "segment_id", "text").where("piece_no = 1").select("segment_id").distinct()
