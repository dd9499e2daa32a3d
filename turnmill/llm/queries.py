"""Registered queries of the text operators and, where SQL can say the same, their oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnmill.llm import encode, forms, leaks, pieces, pii, quality, terms, turns
from turnmill.runtime import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.found_forms(read_table(spark, sf_dir, "segments"), read_table(spark, sf_dir, "corrections"))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every segment text and of every typed term of the corrections."""
    texts = forms.canonical_values(read_table(spark, sf_dir, "segments"), "segment_id", "text", "segments.text")
    typed = forms.canonical_values(read_table(spark, sf_dir, "corrections"), "correction_id", "from_text", "corrections.from_text")
    return texts.unionByName(typed).select("field", "row_id", "plain").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.found_long(read_table(spark, sf_dir, "segments"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_long(read_table(spark, sf_dir, "segments"), "segment_id", "text")


def p2_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long texts as their pieces make them up again, and whether the pieces keep the limit and the overlap."""
    return pieces.rejoined(p2_pieces(spark, sf_dir), "segment_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.found_terms(read_table(spark, sf_dir, "corrections"), read_table(spark, sf_dir, "terminology_eval"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_kinds(read_table(spark, sf_dir, "segments"), read_table(spark, sf_dir, "meetings"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment text and every meeting summary with placeholders."""
    segments = read_table(spark, sf_dir, "segments").select("segment_id", "text").distinct()
    return pii.redacted(segments, "segment_id", "text", "segments.text").unionByName(
        pii.redacted(read_table(spark, sf_dir, "meetings"), "recording_id", "summary", "meetings.summary")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.speaker_turns(read_table(spark, sf_dir, "segments"))


def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.clean_turn_parts(read_table(spark, sf_dir, "segments"))


def p5_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the hidden Markov model infers where a fifth of the labels is withheld, beside what the labels state."""
    return turns.withheld_labels(read_table(spark, sf_dir, "segments"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_corpus(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the ids of ``p7_ids`` stand for."""
    return encode.decode_corpus(p7_ids(spark, sf_dir), "doc_id", "ids")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_passages"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.found_classes(read_table(spark, sf_dir, "documents"))


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_forms, p2_found, p2_pieces, p2_rejoined, p3_found, p4_found, p4_redacted, p5_found, p5_turns, p5_withheld, p7_ids, p7_decoded, p8_found, p9_found, p9_statistics)}

ORACLE = {
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p2_rejoined": "SELECT DISTINCT segment_id, text, true AS fits FROM segments WHERE length(text) > 800",
    "p2_found": "SELECT DISTINCT segment_id FROM segments WHERE length(text) > 800",
}
