"""The transcript quality gate."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.functions import text as tx

# The gate's thresholds.
GRAM = 6
LEAST_REPETITION_CHARACTERS = 120
LEAST_RATIO = 0.45
LEAST_OCCURRENCES = 8
LEAST_DENSITY_CHARACTERS = 240
MOST_CHARACTERS_PER_SECOND = 24
LEAST_DENSITY_TOKENS = 120
MOST_TOKENS_PER_SECOND = 12


@cache
def _kept() -> np.ndarray:
    """Which code points a term key keeps: all but white space, punctuation and symbols."""
    space = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), tx.S))
    return np.array([not (unicodedata.category(ch)[0] in "PS" or space.match(ch)) for ch in map(chr, range(0x110000))])


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("analyzed_character_count", "analyzed_ngram_count", "repeated", "max_ngram_occurrences")]))
def _gram_counts(texts: pd.Series) -> pd.DataFrame:
    rows, kept = [], _kept()
    for text in texts:
        key = unicodedata.normalize("NFKC", text or "").lower()
        codes = np.frombuffer(key.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = codes[kept[codes]].astype(np.uint64)
        n = len(codes) - GRAM + 1
        if n <= 0:
            rows.append((len(codes), 0, 0, 0))
            continue
        low, high = codes[:n], codes[GRAM // 2 : GRAM // 2 + n]  # a code point has 21 bits: three to a word
        for i in range(1, GRAM // 2):
            low, high = low << np.uint64(21) | codes[i : i + n], high << np.uint64(21) | codes[GRAM // 2 + i : GRAM // 2 + i + n]
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        edges = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]), [True]]))
        counts = np.diff(edges)
        rows.append((len(codes), n, int(counts[counts >= 3].sum()), int(counts.max())))
    return pd.DataFrame(rows, columns=["analyzed_character_count", "analyzed_ngram_count", "repeated", "max_ngram_occurrences"])


def repetition(df: DataFrame, text: str) -> DataFrame:
    """A1: character 6-grams that occur three times or more, as a share of all, and the most frequent one's count.

    Every row is measured where it is: nothing is shuffled, and no gram is left out.
    """
    rows = df.withColumn("g_", _gram_counts(F.col(text)))
    ratio = F.when(F.col("g_.analyzed_ngram_count") > 0, F.col("g_.repeated") / F.col("g_.analyzed_ngram_count")).otherwise(0.0)
    return rows.select(*df.columns, "g_.analyzed_character_count", "g_.analyzed_ngram_count", ratio.alias("repeated_ngram_ratio"), "g_.max_ngram_occurrences")


def reasons(characters: Column, duration: Column, tokens: Column, analyzed: Column, ratio: Column, most: Column) -> Column:
    """A2: the reason codes in order of priority; unrounded values are compared, no duration disables density tests."""
    d = F.when(duration > 0, duration)
    return F.array_compact(
        F.array(
            F.when(characters == 0, F.lit("empty_transcript")),
            F.when((analyzed >= LEAST_REPETITION_CHARACTERS) & (ratio >= LEAST_RATIO) & (most >= LEAST_OCCURRENCES), F.lit("repetitive_generation")),
            F.when((characters >= LEAST_DENSITY_CHARACTERS) & (characters / d > MOST_CHARACTERS_PER_SECOND), F.lit("excessive_character_density")),
            F.when((tokens >= LEAST_DENSITY_TOKENS) & (tokens / d > MOST_TOKENS_PER_SECOND), F.lit("excessive_completion_token_density")),
        )
    )


def quality_gate(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key, text, duration_seconds, completion_tokens`` judged; one row a chunk."""
    characters = F.char_length(tx.no_space(F.coalesce("text", F.lit(""))))
    rows = chunks.select(key, "text", characters.alias("character_count"), "duration_seconds", "completion_tokens")
    judged = repetition(rows, "text")
    codes = reasons(F.col("character_count"), F.col("duration_seconds"), F.col("completion_tokens"), F.col("analyzed_character_count"), F.col("repeated_ngram_ratio"), F.col("max_ngram_occurrences"))
    d = F.when(F.col("duration_seconds") > 0, F.col("duration_seconds"))
    return judged.select(
        key, "character_count", tx.round_up(F.col("character_count") / d, 1000).alias("characters_per_second"), "analyzed_character_count", "analyzed_ngram_count",
        tx.round_up(F.col("repeated_ngram_ratio"), 1000).alias("repeated_ngram_ratio"), "max_ngram_occurrences", F.array_join(codes, ",").alias("reason_codes"),
        F.coalesce(F.try_element_at(codes, F.lit(1)), F.lit("ok")).alias("reason_code"), (F.size(codes) == 0).alias("ok"),
    )


def silence(samples: Column) -> Column:
    """Root mean square, peak and silence of an array of samples; what is no number counts as 0."""
    clean = F.transform(samples, lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x.cast("double")))
    n = F.greatest(F.size(clean), F.lit(1))
    rms = F.sqrt(F.aggregate(clean, F.lit(0.0), lambda a, x: a + x * x) / n)
    peak = F.aggregate(clean, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    return F.struct(tx.round_up(rms, 1_000_000).alias("rms"), tx.round_up(peak, 1_000_000).alias("peak"), ((rms <= 1e-6) & (peak <= 1e-5)).alias("silence"))


def split_plan(samples: Column, rate: Column, fallback: float = 10.0, least: float = 5.0) -> Column:
    """Near-equal sizes of the pieces that a suspect chunk is cut into; empty if it is too short."""
    small = F.ceil(F.greatest(F.lit(1.0), F.lit(least)) * rate)
    big = F.greatest(small, F.floor(F.greatest(F.lit(1.0), F.lit(fallback)) * rate))
    pieces = F.greatest(F.lit(2), F.ceil(samples / big))
    fits = (samples >= small * 2) & (F.floor(samples / pieces) >= small)
    # the remaining samples, divided up evenly: the first (samples mod pieces) pieces are one longer
    sizes = F.transform(F.sequence(F.lit(1), pieces.cast("int")), lambda i: F.floor(samples / pieces) + F.when(i <= samples % pieces, 1).otherwise(0))
    return F.when(fits, sizes).otherwise(F.array().cast("array<bigint>"))
