"""Sinks: documents, atomic files, chunk logs and audio."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("text", "markdown", "json", "vtt", "html")


def write_atomic(df: DataFrame, path: str, force: bool = False, fmt: str = "parquet") -> None:
    """Written as a whole or not at all; without ``force`` nothing there is overwritten."""
    df.write.mode("overwrite" if force else "errorifexists").format(fmt).save(path)


def append_chunks(df: DataFrame, path: str) -> None:
    """Chunks appended to the log, one folder a recording."""
    df.write.mode("append").partitionBy("recording_id").parquet(path)


def compact(chunks: DataFrame, payload: str = "payload") -> DataFrame:
    """Each recording's chunks joined in order, for those whose indices run from 0 without a gap."""
    rows = chunks.groupBy("recording_id", "chunk_index").agg(F.first(payload).alias("p_"))
    return (
        rows.groupBy("recording_id")
        .agg(F.array_sort(F.collect_list(F.struct("chunk_index", "p_"))).alias("c_"), F.max("chunk_index").alias("high_"), F.min("chunk_index").alias("low_"))
        .where("low_ = 0 and high_ + 1 = size(c_)")
        .select("recording_id", F.unhex(F.array_join(F.transform("c_", lambda x: F.hex(x["p_"])), "")).alias(payload))
    )


def wav_bytes(samples, rate: int) -> bytes:
    """16-bit mono WAV, samples clipped to -1 and 1."""
    pcm = b"".join(struct.pack("<h", int(max(-1.0, min(1.0, s)) * (32768 if s < 0 else 32767))) for s in samples)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(pcm))
    return head + pcm


@F.pandas_udf(T.BinaryType())
def _wav(samples: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([wav_bytes(s, int(r)) if s is not None else None for s, r in zip(samples, rate)], dtype=object)


def wav(samples: Column, rate: Column) -> Column:
    return _wav(samples, rate)


def html_document(title: Column, rows: Column, payload: Column) -> Column:
    """K5: a page that carries its payload; no ``<`` of the payload ends a script early."""
    safe = F.replace(payload, F.lit("<"), F.lit("\\u003c"))
    return F.concat(
        F.lit('<!doctype html><html lang="zh"><head><meta charset="utf-8"><title>'), title, F.lit("</title></head><body>"), rows,
        F.lit('<script type="application/json" id="payload">'), safe, F.lit("</script></body></html>"),
    )
