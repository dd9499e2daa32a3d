"""Provider envelopes, shared links and embedded payloads as tables."""

from __future__ import annotations

import base64
import gzip
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.functions import text as tx

_SEGMENT = "struct<start_seconds:string,end_seconds:string,start:string,end:string,begin_time:string,end_time:string,speaker:string,speaker_id:string,text:string,transcript:string>"
_USAGE = "struct<completion_tokens:string,output_tokens:string>"
ENVELOPE = f"text string, transcript string, choices array<struct<message:struct<content:string>>>, segments array<{_SEGMENT}>, usage {_USAGE}, raw struct<usage:{_USAGE}>, response struct<usage:{_USAGE}>"


def recognised(body: Column) -> Column:
    """Whether a text is an envelope at all."""
    e = F.from_json(body, ENVELOPE)
    return F.coalesce(e["text"].isNotNull() | e["transcript"].isNotNull() | e["segments"].isNotNull() | F.exists(e["choices"], lambda c: c["message"]["content"].isNotNull()), F.lit(False))


def _times(s: Column) -> Column:
    """S3: the first naming convention of which either time is there decides; invalid times give none, another convention does not step in."""

    def pair(a: str, b: str, scale: float) -> Column:
        start, end = tx.strict_timestamp(s[a]), tx.strict_timestamp(s[b])
        return F.when(end > start, F.struct((start * scale).alias("start"), (end * scale).alias("end")))

    there = lambda a, b: s[a].isNotNull() | s[b].isNotNull()
    return (
        F.when(there("start_seconds", "end_seconds"), pair("start_seconds", "end_seconds", 1.0))
        .when(there("start", "end"), pair("start", "end", 1.0))
        .when(there("begin_time", "end_time"), pair("begin_time", "end_time", 0.001))
    )


def completion_tokens(e: Column) -> Column:
    """The first finite count of at least 0 among three places."""
    found = [tx.strict_timestamp(F.coalesce(u["completion_tokens"], u["output_tokens"])) for u in (e["usage"], e["raw"]["usage"], e["response"]["usage"])]
    return F.coalesce(*found)


def parse_responses(responses: DataFrame, key: str, body: str) -> DataFrame:
    """``key, seg_idx, start_seconds, end_seconds, timing_source, speaker, text`` of each envelope.

    Blank segments are dropped; an envelope with a text but no segments gives one
    of inferred time; a body that is no JSON gives none.
    """
    e = F.from_json(F.col(body), ENVELOPE)
    rows = responses.select(F.col(key).alias(key), e.alias("e")).where("e is not null")
    text = tx.js_trim(F.coalesce("e.text", "e.transcript", F.try_element_at("e.choices", F.lit(1))["message"]["content"], F.lit("")))
    each = rows.select(key, text.alias("whole_"), F.posexplode_outer("e.segments").alias("i_", "s_"))
    parsed = each.select(
        key, "whole_", F.col("i_").alias("seg_idx"), _times(F.col("s_")).alias("t_"), F.coalesce("s_.speaker", "s_.speaker_id", F.concat(F.lit("发言人 "), F.col("i_") + 1)).alias("speaker"),
        tx.js_trim(F.coalesce("s_.text", "s_.transcript", F.lit(""))).alias("text"),
    )
    good = parsed.where("text != ''").select(
        key, "seg_idx", F.coalesce("t_.start", F.lit(0.0)).alias("start_seconds"), F.coalesce("t_.end", F.lit(0.0)).alias("end_seconds"),
        F.when(F.col("t_").isNotNull(), "provider").otherwise("inferred").alias("timing_source"), "speaker", "text",
    )
    lone = parsed.groupBy(key).agg(F.max("whole_").alias("text"), F.count_if(F.col("text") != "").alias("n_")).where("n_ = 0 and text != ''")
    return good.unionByName(lone.select(key, F.lit(0).alias("seg_idx"), F.lit(0.0).alias("start_seconds"), F.lit(0.0).alias("end_seconds"), F.lit("inferred").alias("timing_source"), F.lit("发言人 1").alias("speaker"), "text"))


def lenient_json(text: Column) -> Column:
    """A JSON object read from a code fence or between the outermost braces, else ``{"summary": text}``."""
    bare = F.regexp_replace(F.regexp_replace(tx.js_trim(text), r"^```(?:json)?[\s]*", ""), r"[\s]*```$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    valid = lambda c: F.when(F.get_json_object(c, "$").startswith("{"), c)
    return F.coalesce(valid(bare), valid(F.nullif(inner, F.lit(""))), F.to_json(F.struct(tx.js_trim(text).alias("summary"))))


def response_text(body: Column) -> Column:
    """The text of a model's answer in any of three shapes."""
    e = F.from_json(body, "output_text string, output array<struct<content:array<struct<type:string,text:string>>>>, choices array<struct<message:struct<content:string>>>")
    parts = F.array_join(F.filter(F.transform(F.flatten(F.transform(e["output"], lambda o: F.coalesce(o["content"], F.expr("array()")))), lambda c: c["text"]), lambda t: t.isNotNull()), "")
    return F.coalesce(F.nullif(e["output_text"], F.lit("")), F.nullif(parts, F.lit("")), F.try_element_at(e["choices"], F.lit(1))["message"]["content"])


def embedded_json(html: Column, begin: str, end: str) -> Column:
    """The JSON text between two markers of a page."""
    return F.nullif(F.trim(F.substring_index(F.substring_index(html, begin, -1), end, 1)), F.lit(""))


def encode_link(payload: str) -> str:
    """A payload as the fragment of a link."""
    return "g." + base64.urlsafe_b64encode(gzip.compress(payload.encode(), mtime=0)).decode().rstrip("=")


def decode_link(fragment: str | None) -> str | None:
    """The payload of a link's fragment; None if it holds no transcript."""
    try:
        kind, data = fragment[:2], fragment[2:]
        raw = base64.urlsafe_b64decode(data + "=" * (-len(data) % 4))
        text = (gzip.decompress(raw) if kind == "g." else raw if kind == "j." else b"").decode()
        return text if isinstance(json.loads(text).get("segments"), list) else None
    except (ValueError, TypeError, AttributeError, OSError, EOFError):
        return None


@F.pandas_udf(T.StringType())
def _encode(texts: pd.Series) -> pd.Series:
    return texts.map(encode_link, na_action="ignore")


@F.pandas_udf(T.StringType())
def _decode(texts: pd.Series) -> pd.Series:
    return pd.Series([decode_link(t) for t in texts], dtype=object)


def link_of(payload: Column) -> Column:
    return _encode(payload)


def payload_of(link: Column) -> Column:
    return _decode(link)


# Extensions and the largest size of a local recording.
EXTENSIONS = ("wav", "mp3", "m4a", "mp4", "aac", "flac", "ogg", "webm", "mov")
MOST_BYTES = 512 * 1024 * 1024


def local_files(spark, path: str) -> DataFrame:
    """The files of a folder that are not empty, with their size and why each is refused, if it is; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    refused = F.when(~extension.isin(*EXTENSIONS), "extension").when(F.col("length") > MOST_BYTES, "too_large")
    return files.select("path", "length", extension.alias("extension"), refused.alias("refused"))
