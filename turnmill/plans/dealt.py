"""Registered queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnmill.operators.intervals import session_spans
from turnmill.runtime import read_table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_spans(read_table(spark, sf_dir, "segments"))


QUERIES = {"p6_found": p6_found}

ORACLE = {
    "p6_found": """
WITH i AS (
  SELECT DISTINCT recording_id, session_no,
         CAST(floor(start_seconds * 1000 + 0.5) AS BIGINT) AS a,
         CAST(floor(end_seconds * 1000 + 0.5) AS BIGINT) AS b
  FROM segments WHERE end_seconds IS NOT NULL AND start_seconds IS NOT NULL),
v AS (SELECT * FROM i WHERE a < b),
m AS (SELECT *, max(b) OVER (PARTITION BY recording_id, session_no ORDER BY a, b
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END)
        OVER (PARTITION BY recording_id, session_no ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM m),
p AS (SELECT recording_id, session_no, grp, min(a) AS start_ms, max(b) AS end_ms FROM g GROUP BY ALL),
q AS (SELECT *, lead(start_ms) OVER (PARTITION BY recording_id, session_no ORDER BY start_ms) AS nxt FROM p)
SELECT recording_id, session_no, 'period' AS span_kind, start_ms, end_ms FROM q
UNION ALL
SELECT recording_id, session_no, 'gap' AS span_kind, end_ms AS start_ms, nxt AS end_ms FROM q WHERE nxt IS NOT NULL
""",
}
