"""Registered queries of the transcript operators and their oracle SQL.

Every query runs over its whole tables.  ``ORACLE`` says the same in DuckDB; a
query without an entry is one that SQL cannot say, and is tested otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnmill.functions import lexicon as lx
from turnmill.functions import text as tx
from turnmill.operators import batching, evidence, quality, terms, timeline
from turnmill.operators.timeline import SESSION
from turnmill.plans import sql as q
from turnmill.runtime import cut, read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return register


def _seg(spark: SparkSession, d: str) -> DataFrame:
    return timeline.distinct_segments(read_table(spark, d, "segments"))


def _norm(spark: SparkSession, d: str) -> DataFrame:
    return timeline.normalized(read_table(spark, d, "segments"))


# ---- quality (A1, A2, A4, L18) -------------------------------------------------------------

_GATE = f"""
WITH RECURSIVE chunks AS (SELECT doc_id AS chunk_id, text, 10.0 + doc_id % 50 AS duration_seconds, CAST(floor(length(coalesce(text, '')) / 4) AS BIGINT) AS completion_tokens FROM documents),
n AS (SELECT chunk_id, {q.term_key('text')} AS t, length({q.sub("coalesce(text, '')", q.S + '+')}) AS character_count, duration_seconds AS d, completion_tokens AS k FROM chunks),
g AS (SELECT chunk_id, substr(t, CAST(i AS BIGINT), 6) AS gram, count(*) AS c FROM n, LATERAL unnest(generate_series(1, length(t) - 5)) u(i) GROUP BY ALL),
r AS (SELECT chunk_id, sum(c) AS total, sum(CASE WHEN c >= 3 THEN c ELSE 0 END) AS rep, max(c) AS most FROM g GROUP BY chunk_id),
j AS (SELECT n.*, length(t) AS analyzed, coalesce(total, 0) AS total, coalesce(rep / total, 0.0) AS ratio, coalesce(most, 0) AS most FROM n LEFT JOIN r USING (chunk_id)),
x AS (SELECT *, list_filter([
  CASE WHEN character_count = 0 THEN 'empty_transcript' END,
  CASE WHEN analyzed >= 120 AND ratio >= 0.45 AND most >= 8 THEN 'repetitive_generation' END,
  CASE WHEN character_count >= 240 AND character_count / d > 24 THEN 'excessive_character_density' END,
  CASE WHEN k >= 120 AND k / d > 12 THEN 'excessive_completion_token_density' END], lambda c: c IS NOT NULL) AS codes FROM j)
"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("chunk_id"), "text", (F.col("doc_id") % 50 + 10.0).alias("duration_seconds"),
        F.floor(F.char_length(F.coalesce("text", F.lit(""))) / 4).cast("bigint").alias("completion_tokens"),
    )


@query(
    _GATE
    + """SELECT chunk_id, character_count, floor(character_count / d * 1000 + 0.5) / 1000 AS characters_per_second, analyzed AS analyzed_character_count,
  CAST(total AS BIGINT) AS analyzed_ngram_count, floor(ratio * 1000 + 0.5) / 1000 AS repeated_ngram_ratio, CAST(most AS BIGINT) AS max_ngram_occurrences,
  array_to_string(codes, ',') AS reason_codes, coalesce(codes[1], 'ok') AS reason_code, len(codes) = 0 AS ok FROM x"""
)
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """A1, A2, C50 to C52."""
    return quality.quality_gate(_chunks(spark, d))


@query(
    """WITH e AS (SELECT event_id, recording_id, session_no, action, metrics, unnest(CASE WHEN len(reason_codes) = 0 THEN ['ok'] ELSE reason_codes END) AS reason FROM quality_events)
SELECT reason, action, count(*) AS events, count(metrics.characters_per_second) AS measured, floor(avg(metrics.characters_per_second) * 1000 + 0.5) / 1000 AS mean_density, max(metrics.max_ngram_occurrences) AS most FROM e GROUP BY ALL"""
)
def quality_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by reason and action."""
    e = read_table(spark, d, "quality_events")
    reason = F.explode(F.when(F.size("reason_codes") == 0, F.array(F.lit("ok"))).otherwise(F.col("reason_codes")))
    m = F.col("metrics")
    return e.select(reason.alias("reason"), "action", m["characters_per_second"].alias("density"), m["max_ngram_occurrences"].alias("n")).groupBy("reason", "action").agg(
        F.count("*").alias("events"), F.count("density").alias("measured"), tx.round_up(F.avg("density"), 1000).alias("mean_density"), F.max("n").alias("most")
    )


@query(
    """SELECT event_id, list_filter([
  CASE WHEN metrics.character_count = 0 THEN 'empty_transcript' END,
  CASE WHEN metrics.analyzed_character_count >= 120 AND metrics.repeated_ngram_ratio >= 0.45 AND metrics.max_ngram_occurrences >= 8 THEN 'repetitive_generation' END,
  CASE WHEN metrics.character_count >= 240 AND duration_seconds > 0 AND metrics.character_count / duration_seconds > 24 THEN 'excessive_character_density' END,
  CASE WHEN metrics.completion_tokens >= 120 AND duration_seconds > 0 AND metrics.completion_tokens / duration_seconds > 12 THEN 'excessive_completion_token_density' END], lambda c: c IS NOT NULL).array_to_string(',') AS codes FROM quality_events"""
)
def quality_event_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The gate's verdict derived again from the metrics of each event."""
    e = read_table(spark, d, "quality_events")
    m = F.col("metrics")
    codes = quality.reasons(m["character_count"], F.col("duration_seconds"), m["completion_tokens"], m["analyzed_character_count"], m["repeated_ngram_ratio"], m["max_ngram_occurrences"])
    return e.select("event_id", F.array_join(codes, ",").alias("codes"))


@query(
    """WITH e AS (SELECT event_id, CAST(floor(duration_seconds * 16000) AS BIGINT) AS n FROM quality_events WHERE action = 'split'), p AS (SELECT *, greatest(2, CAST(ceil(n / 160000.0) AS BIGINT)) AS k FROM e)
SELECT event_id, n AS samples, CAST(i AS INT) AS piece, n // k + CASE WHEN i < n % k THEN 1 ELSE 0 END AS size FROM p, LATERAL unnest(range(0, k)) u(i) WHERE n >= 160000 AND n // k >= 80000"""
)
def split_plan(spark: SparkSession, d: str) -> DataFrame:
    """The pieces that each event's chunk would be cut into."""
    e = read_table(spark, d, "quality_events").where("action = 'split'")
    samples = F.floor(F.col("duration_seconds") * 16000).cast("bigint")
    return e.select("event_id", samples.alias("samples"), F.posexplode(quality.split_plan(samples, F.lit(16000))).alias("piece", "size"))


# ---- timeline (P1 to P4, W1 to W4, W13, W14, K4, F23 to F26) -------------------------------


@query(f"WITH {q.NORM} SELECT segment_id, recording_id, session_no, pos, speaker, text, timing_source FROM norm")
def segment_normalize(spark: SparkSession, d: str) -> DataFrame:
    """P1, P2, P4, P9, P16, O1, K8, K9."""
    return _norm(spark, d).select("segment_id", *SESSION, "pos", "speaker", "text", "timing_source")


@query(
    f"""WITH {q.NORM}, b AS (SELECT *, 3600.0 AS bound, least(3600.0, {q.clamp('start_seconds')}) AS s FROM norm),
w AS (SELECT *, lead(s) OVER (PARTITION BY recording_id, session_no ORDER BY s, pos) AS nxt, CASE WHEN end_seconds IS NOT NULL THEN least(bound, greatest(end_seconds, 0.0)) END AS own FROM b)
SELECT segment_id, floor((s + 100.0) * 1000 + 0.5) / 1000 AS start_seconds,
  floor((least(bound, greatest(s, CASE WHEN own > s THEN own WHEN nxt > s THEN nxt ELSE bound END)) + 100.0) * 1000 + 0.5) / 1000 AS end_seconds FROM w"""
)
def offset_segments(spark: SparkSession, d: str) -> DataFrame:
    """An hour's chunk set off by 100 seconds."""
    out = timeline.offset_segments(_norm(spark, d), F.lit(3600.0), F.lit(100.0))
    return out.select("segment_id", tx.round_up(F.col("start_seconds"), 1000).alias("start_seconds"), tx.round_up(F.col("end_seconds"), 1000).alias("end_seconds"))


_BOUNDARY = f"""WITH {q.NORM},
b AS (SELECT *, lag(text) OVER w AS ptext, lag(speaker) OVER w AS pspeaker, lag(end_seconds) OVER w AS pend, lag(timing_source) OVER w AS psource
  FROM norm WINDOW w AS (PARTITION BY recording_id, session_no ORDER BY pos)),
r AS (SELECT *, regexp_extract(ptext, {q.lit(timeline.FILLER_END)}, 1) AS a, regexp_extract(text, {q.lit(timeline.FILLER_HEAD)}, 1) AS z, regexp_replace(text, {q.lit(timeline.FILLER_HEAD)}, '') AS rest FROM b),
m AS (SELECT *, coalesce(lower({q.trim('pspeaker')}) = lower({q.trim('speaker')}) AND psource = 'provider' AND timing_source = 'provider' AND pend > start_seconds AND a <> '' AND a = z AND rest <> '', false) AS removes FROM r)"""


@query(_BOUNDARY + "SELECT segment_id, removes, CASE WHEN removes THEN rest ELSE text END AS after FROM m")
def boundary_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """W1, W2, J3, F24, L20, T8."""
    return timeline.boundaries(_norm(spark, d)).select("segment_id", "removes", "after")


@query()
def reconciliation_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger with source hashes."""
    return timeline.reconciliations(_norm(spark, d))


@query(_BOUNDARY + "SELECT segment_id, CASE WHEN removes THEN rest ELSE text END AS text FROM m")
def ledger_replay(spark: SparkSession, d: str) -> DataFrame:
    """The ledger derived, then replayed and checked field by field; all of it holds, so all texts come out changed."""
    norm = _norm(spark, d)
    return timeline.replay_reconciliations(norm, timeline.reconciliations(norm)).select("segment_id", "text")


_JOINABLE = f"""WITH RECURSIVE {q.NORM},
l AS (SELECT *, lead(speaker) OVER w AS nspeaker, lead(start_seconds) OVER w AS nstart, lead(text) OVER w AS ntext, lead(end_seconds) OVER w AS nend
  FROM norm WINDOW w AS (PARTITION BY recording_id, session_no ORDER BY pos)),
jo AS (SELECT *, floor((greatest(nstart, 0.0) - end_seconds) * 1000 + 0.5) / 1000 AS gap_seconds,
  coalesce({q.comparable('speaker')} = {q.comparable('nspeaker')} AND nspeaker IS NOT NULL AND greatest(nstart, 0.0) >= greatest(start_seconds, 0.0) AND end_seconds > greatest(start_seconds, 0.0)
    AND greatest(nstart, 0.0) - end_seconds BETWEEN -0.25 AND 3.0, false) AS joinable FROM l)"""


@query(_JOINABLE + "SELECT segment_id, gap_seconds, joinable FROM jo")
def semantic_join_candidates(spark: SparkSession, d: str) -> DataFrame:
    """F23, F43."""
    return timeline.joinable(_norm(spark, d)).select("segment_id", "gap_seconds", "joinable")


_CJK = r"[\p{Han}\p{Hiragana}\p{Katakana}]"
_BARE = "coalesce(nullif(" + q.sub(q.sub("text", "[。；;.]+$"), f"{q.S}+$") + ", ''), text)"
_FOLD = (
    _JOINABLE
    + f""", st AS (SELECT *, {_BARE} AS bare, coalesce(join_next, false) AND joinable AS goes_on FROM jo),
sp AS (SELECT *, length(text) - length(bare) AS stops,
  CASE WHEN ({q.has('bare', '[\\p{L}\\p{N}]$')} AND {q.has('ntext', '^[\\p{L}\\p{N}]')} AND NOT {q.has('bare', _CJK + '$')} AND NOT {q.has('ntext', '^' + _CJK)})
      OR ({q.has('ntext', '^[\\p{Latin}\\p{N}]')} AND {q.has('bare', '[\\p{Latin}\\p{N},:;.!?]$')}) OR ({q.has('bare', _CJK + '$')} AND {q.has('ntext', '^\\p{Latin}')}) THEN 1 ELSE 0 END AS space_next FROM st),
f(recording_id, session_no, pos, head, size, s, e) AS (
  SELECT recording_id, session_no, pos, pos, length(text), greatest(start_seconds, 0.0), greatest(greatest(start_seconds, 0.0), coalesce(nullif(end_seconds, 0.0), start_seconds)) FROM sp WHERE pos = 0
  UNION ALL
  SELECT n.recording_id, n.session_no, n.pos,
    CASE WHEN ok THEN head ELSE n.pos END, CASE WHEN ok THEN joined ELSE length(n.text) END, CASE WHEN ok THEN s ELSE greatest(n.start_seconds, 0.0) END,
    CASE WHEN ok THEN reach ELSE greatest(greatest(n.start_seconds, 0.0), coalesce(nullif(n.end_seconds, 0.0), n.start_seconds)) END
  FROM (SELECT f.*, c.goes_on AND f.size - c.stops + c.space_next + length(c.ntext) <= 800 AND greatest(f.e, coalesce(nullif(c.nend, 0.0), nullif(c.nstart, 0.0), f.e)) - f.s <= 90.0 AS ok,
      f.size - c.stops + c.space_next + length(c.ntext) AS joined, greatest(f.e, coalesce(nullif(c.nend, 0.0), nullif(c.nstart, 0.0), f.e)) AS reach
    FROM f JOIN sp c ON c.recording_id = f.recording_id AND c.session_no = f.session_no AND c.pos = f.pos) p
  JOIN sp n ON n.recording_id = p.recording_id AND n.session_no = p.session_no AND n.pos = p.pos + 1)"""
)


@query(_FOLD + "SELECT recording_id, session_no, pos, head AS paragraph FROM f")
def semantic_joins(spark: SparkSession, d: str) -> DataFrame:
    """The paragraph that each segment belongs to, under its budgets."""
    return timeline.semantic_joins(_norm(spark, d)).select(*SESSION, "pos", "paragraph")


@query()
def readable_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """W4, P14, P15, C24, C25."""
    return timeline.paragraphs(_norm(spark, d)).withColumn("segment_ids", F.array_join(F.transform("segment_ids", lambda x: x.cast("string")), ","))


@query(
    f"""WITH {q.NORM}, c AS (SELECT *, {q.clamp('start_seconds')} AS a FROM norm), n AS (SELECT *, lead(a) OVER (PARTITION BY recording_id, session_no ORDER BY pos) AS nxt FROM c),
e AS (SELECT *, CASE WHEN end_seconds > a THEN end_seconds WHEN nxt > a THEN nxt ELSE a + 4 END AS z FROM n)
SELECT recording_id, session_no, pos, {q.clock('a', True)} || ' --> ' || {q.clock('z', True)} AS timing, pos + 1 AS number, speaker || '：' || text AS cue FROM e"""
)
def vtt_cues(spark: SparkSession, d: str) -> DataFrame:
    """K4, W14, C46."""
    return timeline.cues(_norm(spark, d))


@query(
    f"""WITH {q.NORM}, p AS (SELECT *, lag(start_seconds) OVER w AS ps, lag(end_seconds) OVER w AS pe, lag(timing_source) OVER w AS pt FROM norm WINDOW w AS (PARTITION BY recording_id, session_no ORDER BY pos)),
o AS (SELECT *, coalesce(timing_source = 'provider' AND pt = 'provider' AND end_seconds > start_seconds AND pe > ps, false) AS sure, greatest(0.0, least(pe, end_seconds) - greatest(ps, start_seconds)) AS sec FROM p)
SELECT segment_id, CASE WHEN sure THEN floor(sec * 1000 + 0.5) / 1000 ELSE 0.0 END AS overlap_seconds, sure AND sec >= 0.25 AS overlaps FROM o"""
)
def display_overlap_seconds(spark: SparkSession, d: str) -> DataFrame:
    """F25, F26, C42."""
    return timeline.temporal_overlap(_norm(spark, d)).select("segment_id", "overlap_seconds", "overlaps")


@query(
    f"""WITH {q.SEG}, i AS (SELECT DISTINCT recording_id, session_no, seg_idx FROM seg), r AS (SELECT *, seg_idx = row_number() OVER (PARTITION BY recording_id, session_no ORDER BY seg_idx) - 1 AS ok FROM i)
SELECT recording_id, session_no, count(*) FILTER (WHERE ok) AS prefix, count(*) AS n, CAST(max(seg_idx) + 1 AS BIGINT) AS high, count(*) FILTER (WHERE ok) = count(*) AND max(seg_idx) + 1 = count(*) AS contiguous FROM r GROUP BY ALL"""
)
def committed_prefix(spark: SparkSession, d: str) -> DataFrame:
    """W13, T6, T9, T10, S13."""
    return timeline.committed_prefix(_seg(spark, d), SESSION, "seg_idx")


@query(
    f"""WITH {q.SEG} SELECT segment_id, recording_id FROM seg WHERE start_seconds < 90.0 AND end_seconds > 30.0"""
)
def time_range_scan(spark: SparkSession, d: str) -> DataFrame:
    """The segments of a range of a recording."""
    return _seg(spark, d).where("start_seconds < 90.0 and end_seconds > 30.0").select("segment_id", "recording_id")


# ---- batching and retrieval (P8, W7 to W12, O2, C31) ---------------------------------------

_LINES = f"""WITH RECURSIVE {q.NORM},
fr AS (SELECT recording_id, session_no, pos, text, CASE WHEN length(coalesce(nullif(speaker, ''), '发言人')) > 80 THEN substr(speaker, 1, 77) || '...' ELSE coalesce(nullif(speaker, ''), '发言人') END AS who, {q.clock('start_seconds')} AS t FROM norm),
px AS (SELECT *, '[' || t || '] ' || who || '：' AS prefix, greatest(1, 2000 - length('[' || t || '] ' || who || '：')) AS step FROM fr),
li AS (SELECT recording_id, session_no, pos, CAST(row_number() OVER (PARTITION BY recording_id, session_no ORDER BY pos, k) - 1 AS INT) AS ord, prefix || substr(text, CAST(k AS BIGINT) + 1, step) AS line, who || ' ' || substr(text, CAST(k AS BIGINT) + 1, step) AS searchable
  FROM px, LATERAL unnest(range(0, length(text), step)) u(k))"""


@query(_LINES + "SELECT recording_id, session_no, pos, ord, line, searchable FROM li")
def prompt_fragments(spark: SparkSession, d: str) -> DataFrame:
    """P8, C21."""
    return batching.fragments(_norm(spark, d))


@query(
    _LINES
    + """, f(recording_id, session_no, ord, batch, size) AS (
  SELECT recording_id, session_no, ord, 0, length(line) FROM li WHERE ord = 0
  UNION ALL
  SELECT l.recording_id, l.session_no, l.ord, CASE WHEN f.size + 1 + length(l.line) > 4000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.size + 1 + length(l.line) > 4000 THEN length(l.line) ELSE f.size + 1 + length(l.line) END
  FROM f JOIN li l ON l.recording_id = f.recording_id AND l.session_no = f.session_no AND l.ord = f.ord + 1)
SELECT recording_id, session_no, CAST(ord AS BIGINT) AS ord, CAST(batch AS BIGINT) AS batch FROM f"""
)
def prompt_batches(spark: SparkSession, d: str) -> DataFrame:
    """W7."""
    return batching.greedy_batches(batching.fragments(_norm(spark, d)), SESSION, "ord", F.char_length("line"), 4000, 1)


@query(
    f"""WITH RECURSIVE {q.NORM}, c AS (SELECT recording_id, session_no, pos, length(text) + length(speaker) + 40 AS cost FROM norm),
f(recording_id, session_no, pos, batch, size) AS (
  SELECT recording_id, session_no, pos, 0, cost FROM c WHERE pos = 0
  UNION ALL
  SELECT c.recording_id, c.session_no, c.pos, CASE WHEN f.size + cost > 8000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.size + cost > 8000 THEN cost ELSE f.size + cost END
  FROM f JOIN c ON c.recording_id = f.recording_id AND c.session_no = f.session_no AND c.pos = f.pos + 1)
SELECT recording_id, session_no, CAST(pos AS BIGINT) AS pos, CAST(batch AS BIGINT) AS batch FROM f"""
)
def segment_batches(spark: SparkSession, d: str) -> DataFrame:
    """W8."""
    return batching.greedy_batches(_norm(spark, d), SESSION, "pos", F.char_length("text") + F.char_length("speaker") + 40, 8000, 0)


@query(
    f"""WITH {q.NORM}, r AS (SELECT recording_id, session_no, speaker, pos, segment_id, min(pos) OVER (PARTITION BY recording_id, session_no, speaker) AS fst, row_number() OVER (PARTITION BY recording_id, session_no, speaker ORDER BY pos) AS turn FROM norm),
k AS (SELECT *, dense_rank() OVER (PARTITION BY recording_id, session_no ORDER BY fst) AS rnk FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY recording_id, session_no ORDER BY turn, fst) AS place FROM k WHERE rnk <= 30 AND turn <= 40)
SELECT recording_id, session_no, segment_id, CAST(place AS INT) AS place FROM p WHERE place <= 120"""
)
def round_robin_speakers(spark: SparkSession, d: str) -> DataFrame:
    """W9, W19."""
    return batching.round_robin(_norm(spark, d), SESSION, "speaker", "pos").select(*SESSION, "segment_id", "place")


@query(
    f"""WITH {q.NORM}, r AS (SELECT recording_id, session_no, pos, length(text) AS n, min(pos) OVER w AS a, max(pos) OVER w AS z FROM norm WINDOW w AS (PARTITION BY recording_id, session_no))
SELECT recording_id, session_no, min(pos) AS first, arg_max(pos, (n, -pos)) FILTER (WHERE pos > a AND pos < z) AS middle, max(pos) AS last FROM r GROUP BY ALL"""
)
def representative_segments(spark: SparkSession, d: str) -> DataFrame:
    """W10."""
    return batching.representatives(_norm(spark, d), SESSION, "pos", "text")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """The title of each meeting, asked of each of its sessions."""
    return read_table(spark, d, "meetings").where("title is not null").select("recording_id", "title").dropDuplicates(["recording_id"])


_TOKENS_SQL = f"""tk AS (SELECT recording_id, lower({q.nfkc('title')}) AS t FROM meetings WHERE title IS NOT NULL),
han AS (SELECT recording_id, unnest(regexp_extract_all(t, '\\p{{Han}}+')) AS run FROM tk),
tok AS (SELECT DISTINCT recording_id, token FROM (
  SELECT recording_id, unnest(regexp_extract_all(t, '[a-z0-9+#]{{2,}}')) AS token FROM tk
  UNION ALL SELECT recording_id, run FROM han WHERE length(run) BETWEEN 2 AND 12
  UNION ALL SELECT recording_id, substr(run, CAST(i AS BIGINT), CAST(w AS BIGINT)) FROM han, LATERAL unnest([2, 3, 4]) a(w), LATERAL unnest(generate_series(1, length(run) - w + 1)) b(i)))"""


@query(f"WITH {_TOKENS_SQL} SELECT recording_id, token FROM tok")
def retrieval_tokens(spark: SparkSession, d: str) -> DataFrame:
    """C31."""
    return _questions(spark, d).select("recording_id", F.explode(tx.retrieval_tokens(F.col("title"))).alias("token"))


_SCORES = _LINES + f""", {_TOKENS_SQL}, hay AS (SELECT recording_id, session_no, ord, length(line) AS size, {q.comparable('searchable')} AS h FROM li WHERE recording_id IN (SELECT recording_id FROM tk)),
sc AS (SELECT h.recording_id, session_no, ord, size, coalesce(sum(CASE WHEN contains(h, token) THEN greatest(1, length(token) - 1) ELSE 0 END), 0) AS score FROM hay h LEFT JOIN tok USING (recording_id) GROUP BY ALL)"""


@query(_SCORES + "SELECT recording_id, session_no, ord, CAST(score AS INT) AS score FROM sc")
def retrieval_scores(spark: SparkSession, d: str) -> DataFrame:
    """O2: scores of every line for its meeting's title."""
    lines = batching.fragments(_norm(spark, d))
    return batching.lexical_scores(lines, _questions(spark, d), ["recording_id"], "title").select(*SESSION, "ord", "score")


@query(
    _SCORES
    + """, s AS (SELECT *, max(score) OVER w AS best, count(*) OVER w AS n FROM sc WINDOW w AS (PARTITION BY recording_id, session_no)),
h AS (SELECT *, row_number() OVER (PARTITION BY recording_id, session_no ORDER BY score DESC, ord) AS r FROM s WHERE score > 0),
u AS (SELECT recording_id, session_no, ord, 0 AS a, r AS b, 0 AS c FROM h
  UNION ALL SELECT recording_id, session_no, ord - 1, 1, r, 0 FROM h WHERE ord > 0 UNION ALL SELECT recording_id, session_no, ord + 1, 1, r, 1 FROM h WHERE ord + 1 < n
  UNION ALL SELECT recording_id, session_no, ord, 2, least(ord, n - 1 - ord), CASE WHEN ord <= n - 1 - ord THEN 0 ELSE 1 END FROM s WHERE best = 0),
m AS (SELECT recording_id, session_no, ord, min((a, b, c)) AS p FROM u GROUP BY ALL)
SELECT recording_id, session_no, ord, CAST(row_number() OVER (PARTITION BY recording_id, session_no ORDER BY p) AS INT) AS priority FROM m"""
)
def retrieval_priorities(spark: SparkSession, d: str) -> DataFrame:
    """Hits, their neighbours, or both ends in turn."""
    lines = batching.fragments(_norm(spark, d))
    scored = batching.lexical_scores(lines, _questions(spark, d), ["recording_id"], "title")
    return batching.priorities(scored, SESSION, "ord")


@query()
def retrieval_selection(spark: SparkSession, d: str) -> DataFrame:
    """O2: the lines that fit into 2,000 characters, by priority."""
    lines = batching.fragments(_norm(spark, d))
    scored = batching.lexical_scores(lines, _questions(spark, d), ["recording_id"], "title")
    sized = batching.priorities(scored, SESSION, "ord").join(lines.select(*SESSION, "ord", F.char_length("line").alias("size")), [*SESSION, "ord"])
    return batching.pack_by_priority(sized, SESSION, "ord", "priority", "size", 2000)


# ---- evidence (J1, J2, J12 to J17, A7, A10, A17) -------------------------------------------

_CLAIMS = "cl AS (SELECT DISTINCT correction_id AS claim_id, recording_id, session_no, start_seconds AS t, from_text AS quote FROM corrections)"


@query(
    f"""WITH {q.NORM}, {_CLAIMS}, qs AS (SELECT claim_id, recording_id, session_no, t, {q.comparable('quote')} AS qq FROM cl WHERE t >= 0),
ca AS (SELECT *, {q.clamp('start_seconds')} AS a FROM norm), cb AS (SELECT *, lead(a) OVER (PARTITION BY recording_id, session_no ORDER BY pos) AS nxt FROM ca),
cc AS (SELECT *, CASE WHEN end_seconds > a THEN end_seconds WHEN nxt > a THEN nxt ELSE a + 5 END AS e, {q.comparable('text')} AS x FROM cb),
hit AS (SELECT claim_id, segment_id, pos, abs(a - t) AS dist FROM qs JOIN cc USING (recording_id, session_no) WHERE length(qq) >= 2 AND t >= a - 0.5 AND t <= e + 0.5 AND contains(x, qq)),
r AS (SELECT *, row_number() OVER w AS rn, lead(dist) OVER w AS nd FROM hit WINDOW w AS (PARTITION BY claim_id ORDER BY dist, pos))
SELECT claim_id, segment_id, pos, floor(dist * 1000 + 0.5) / 1000 AS distance FROM r WHERE rn = 1 AND (nd IS NULL OR abs(nd - dist) >= 1e-9)"""
)
def evidence_grounding(spark: SparkSession, d: str) -> DataFrame:
    """The ledger's terms as quotes, placed in the one segment that says them."""
    claims = read_table(spark, d, "corrections").select(
        F.col("correction_id").alias("claim_id"), *SESSION, F.col("start_seconds").alias("at_seconds"), F.col("from_text").alias("quote"), F.lit("").alias("speaker_hint")
    )
    return evidence.ground(claims.dropDuplicates(["claim_id"]), _norm(spark, d))


@query(
    f"""WITH {q.SEG}, c AS (SELECT DISTINCT correction_id, segment_id, from_text FROM corrections WHERE from_text IS NOT NULL),
j AS (SELECT correction_id, {q.trim('text')} AS t, lower({q.trim('text')}) AS h, lower({q.trim('from_text')}) AS n, {q.comparable('text')} AS ct, {q.comparable('from_text')} AS cn FROM c JOIN seg USING (segment_id))
SELECT correction_id, CASE WHEN t = '' OR n = '' THEN NULL WHEN instr(h, n) > 0 THEN CASE WHEN instr(substr(h, instr(h, n) + 1), n) = 0 THEN t END WHEN contains(ct, cn) THEN t END AS quote FROM j"""
)
def context_quotes(spark: SparkSession, d: str) -> DataFrame:
    """C45, F15, F37."""
    c = read_table(spark, d, "corrections").where("from_text is not null").select("correction_id", "segment_id", "from_text").distinct()
    return c.join(_seg(spark, d).select("segment_id", "text"), "segment_id").select("correction_id", evidence.unique_quote(F.col("text"), F.col("from_text")).alias("quote"))


@query(
    """WITH a AS (SELECT DISTINCT recording_id AS k, 'meeting' AS kind FROM meetings), r AS (SELECT recording_id AS k, CASE WHEN status = 'applied' THEN 'meeting' ELSE status END AS kind FROM (SELECT DISTINCT correction_id, recording_id, status FROM corrections)
  UNION ALL SELECT recording_id, 'meeting' FROM tombstones),
g AS (SELECT k, count(*) AS n, min(kind) AS kind FROM r GROUP BY k)
SELECT coalesce(g.k, a.k) AS recording_id, CASE WHEN g.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unknown' WHEN n > 1 THEN 'duplicate' WHEN g.kind <> a.kind THEN 'kind_mismatch' END AS violation
FROM g FULL JOIN a ON g.k = a.k WHERE g.k IS NULL OR a.k IS NULL OR n > 1 OR g.kind <> a.kind"""
)
def exact_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of every meeting, wanted exactly once."""
    wanted = read_table(spark, d, "meetings").select("recording_id").distinct().withColumn("kind", F.lit("meeting"))
    reviews = read_table(spark, d, "corrections").select("correction_id", "recording_id", "status").distinct().select("recording_id", F.when(F.col("status") == "applied", "meeting").otherwise(F.col("status")).alias("kind"))
    reviews = reviews.unionByName(read_table(spark, d, "tombstones").select("recording_id", F.lit("meeting").alias("kind")))
    return evidence.exact_coverage(reviews, wanted, "recording_id", "kind")


@query(
    f"""WITH {q.SEG}, g AS (SELECT DISTINCT recording_id, speaker FROM seg WHERE speaker IS NOT NULL), m AS (SELECT DISTINCT s.speaker FROM corrections c JOIN seg s USING (segment_id) WHERE status = 'applied')
SELECT recording_id, count(*) AS wanted, count(m.speaker) AS got, count(*) = count(m.speaker) AS covered FROM g LEFT JOIN m USING (speaker) GROUP BY recording_id"""
)
def coverage_division(spark: SparkSession, d: str) -> DataFrame:
    """Recordings all of whose labels occur beside an applied correction."""
    seg = _seg(spark, d).where("speaker is not null")
    hit = read_table(spark, d, "corrections").where("status = 'applied'").join(seg, "segment_id").select("speaker")
    return evidence.covered(seg, hit, "recording_id", "speaker")


@query(
    """WITH b AS (SELECT recording_id, to_text, CASE WHEN reason = 'recording_consensus' THEN 'high' ELSE 'low' END AS conf FROM (SELECT DISTINCT correction_id, recording_id, to_text, reason FROM corrections WHERE to_text IS NOT NULL)),
p AS (SELECT recording_id, to_text, count(*) AS n, count(*) FILTER (WHERE conf = 'high') AS high FROM b GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY recording_id) AS votes, count(*) OVER (PARTITION BY recording_id) AS options, row_number() OVER (PARTITION BY recording_id ORDER BY n DESC, to_text) AS r FROM p)
SELECT recording_id, to_text, CAST(votes AS BIGINT) AS votes, CASE WHEN votes >= 3 AND options = 1 AND high = votes THEN 'authoritative' WHEN high > 0 THEN 'medium' ELSE 'low' END AS standing FROM t WHERE r = 1"""
)
def vote_majority(spark: SparkSession, d: str) -> DataFrame:
    """A10, A35, F44."""
    b = read_table(spark, d, "corrections").where("to_text is not null").select("correction_id", "recording_id", "to_text", F.when(F.col("reason") == "recording_consensus", "high").otherwise("low").alias("conf")).distinct()
    return evidence.votes(b, "recording_id", "to_text", "conf")


@query(
    f"""WITH c AS (SELECT DISTINCT correction_id, recording_id, to_text FROM corrections WHERE to_text IS NOT NULL), k AS (SELECT *, {q.comparable('to_text')} AS key FROM c)
SELECT recording_id, key, arg_min(to_text, correction_id) AS to_text FROM k WHERE key <> '' GROUP BY ALL"""
)
def distinct_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """A17, A18, A20, A23, A26, C1."""
    c = read_table(spark, d, "corrections").where("to_text is not null").select("correction_id", "recording_id", "to_text").distinct()
    c = c.withColumn("key", tx.comparable_text(F.col("to_text"))).where("key != ''")
    return evidence.keep_first(c, ["recording_id", "key"], ["correction_id"]).select("recording_id", "key", "to_text")


@query(
    f"""WITH c AS (SELECT DISTINCT correction_id, recording_id, to_text FROM corrections WHERE to_text IS NOT NULL), k AS (SELECT *, {q.trim(q.nfkc('to_text'))} AS key FROM c)
SELECT recording_id, key, arg_max(to_text, correction_id) AS to_text, min(correction_id) AS place FROM k GROUP BY ALL"""
)
def distinct_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """A21, A22, A37, C8, C9, F45, F46."""
    c = read_table(spark, d, "corrections").where("to_text is not null").select("correction_id", "recording_id", "to_text").distinct()
    return evidence.keep_last_value(c.withColumn("key", tx.spelling_key(F.col("to_text"))), ["recording_id", "key"], "to_text", "correction_id")


@query(
    f"""WITH {q.NORM}, f AS (SELECT recording_id, session_no, speaker, text, min(pos) AS o FROM norm GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, session_no, speaker ORDER BY o, text) AS n FROM f)
SELECT recording_id, session_no, speaker, string_agg(text, '|' ORDER BY n) AS points FROM r WHERE n <= 12 GROUP BY ALL"""
)
def merge_speaker_points(spark: SparkSession, d: str) -> DataFrame:
    """A7 to A9, A13, A24, P11."""
    return evidence.merge_notes(_norm(spark, d), [*SESSION, "speaker"], "text", "pos").withColumn("points", F.array_join("points", "|"))


# ---- terminology (S22, J4, J7, A5, A6, G1, G2, F16 to F22, L3, L5, L21) --------------------


def _context(spark: SparkSession, d: str) -> DataFrame:
    """The reference list written in the naming language, a context for each entry."""
    t = read_table(spark, d, "terminology_eval").select("eval_id", "canonical", F.explode("aliases").alias("alias")).distinct()
    bare = lambda c: F.translate(F.col(c), ",，|、；;", "      ")
    entry = F.concat(bare("alias"), F.lit(" -> "), bare("canonical"))
    return t.groupBy("eval_id").agg(F.concat(F.lit("别名: "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("alias", entry.alias("e")))), lambda x: x["e"]), "，")).alias("text"))


@query(
    """WITH t AS (SELECT eval_id, canonical, unnest(aliases) AS alias FROM terminology_eval), m AS (SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY alias) AS ord FROM (SELECT DISTINCT eval_id, canonical, alias FROM t)),
"""
    + f"""k AS (SELECT eval_id, ord, {q.trim("translate(alias, ',，|、；;', '      ')")} AS alias, {q.trim("translate(canonical, ',，|、；;', '      ')")} AS canonical FROM m)
SELECT eval_id, CAST(row_number() OVER (PARTITION BY eval_id ORDER BY ord) AS INT) AS n, alias, canonical, {q.correction('alias')} AS alias_key FROM k
WHERE alias <> '' AND length({q.correction('alias')}) >= 2 AND length({q.correction('canonical')}) >= 2 AND {q.nfkc('alias')} <> {q.nfkc('canonical')} AND length(alias) <= 120 AND length(canonical) <= 120"""
)
def terminology_context(spark: SparkSession, d: str) -> DataFrame:
    """The reference list written in the naming language, and parsed again."""
    out = terms.parse_context(_context(spark, d), "eval_id", "text").where("kind = 'mapping'")
    n = F.row_number().over(Window.partitionBy("eval_id").orderBy("ord"))
    return out.select("eval_id", n.alias("n"), "alias", "canonical", "alias_key")


@query()
def terminology_overflow(spark: SparkSession, d: str) -> DataFrame:
    """Of each context of ``terminology_context``, how many entries it has and whether some are left out."""
    return terms.context_overflow(_context(spark, d), "eval_id", "text")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "corrections").where("status = 'applied' and from_text is not null and to_text is not null")
    return c.select("correction_id", "recording_id", "from_text", "to_text").distinct()


_EDGES = f"""pr AS (SELECT DISTINCT correction_id, recording_id, {q.correction('from_text')} AS k, to_text, {q.nfkc('to_text')} AS c FROM corrections WHERE status = 'applied' AND from_text IS NOT NULL AND to_text IS NOT NULL),
ed AS (SELECT recording_id, k, arg_min(to_text, (correction_id, to_text)) AS canonical, count(DISTINCT c) > 1 AS conflict FROM pr WHERE length(k) >= 2 GROUP BY ALL)"""


@query(f"WITH {_EDGES} SELECT recording_id, k AS alias_key, canonical, conflict FROM ed")
def alias_edges(spark: SparkSession, d: str) -> DataFrame:
    """One mapping an alias, or a conflict."""
    return terms.alias_edges(_pairs(spark, d), ["recording_id"], "from_text", "to_text", "correction_id")


@query(
    f"""WITH RECURSIVE {_EDGES}, e AS (SELECT recording_id, k, canonical, {q.correction('canonical')} AS nk, conflict FROM ed),
w(recording_id, k, here, canonical, bad, fin, seen) AS (
  SELECT recording_id, k, k, NULL::VARCHAR, false, false, [k] FROM e
  UNION ALL
  SELECT w.recording_id, w.k, e.nk, e.canonical,
    e.conflict OR coalesce((SELECT x.conflict FROM e x WHERE x.recording_id = e.recording_id AND x.k = e.nk), false) OR (e.nk <> e.k AND list_contains(w.seen, e.nk)),
    e.nk = e.k OR NOT EXISTS (SELECT 1 FROM e x WHERE x.recording_id = e.recording_id AND x.k = e.nk), list_append(w.seen, e.nk)
  FROM w JOIN e ON e.recording_id = w.recording_id AND e.k = w.here WHERE NOT w.bad AND NOT w.fin)
SELECT recording_id, k AS alias_key, max(CASE WHEN fin AND NOT bad THEN canonical END) AS terminal FROM w GROUP BY ALL"""
)
def alias_closure(spark: SparkSession, d: str) -> DataFrame:
    """G1, A26, J8 of the graph: each alias with its terminal canonical, NULL for cycles and conflicts."""
    e = terms.alias_edges(_pairs(spark, d), ["recording_id"], "from_text", "to_text", "correction_id")
    return terms.close_aliases(e, ["recording_id"])


@query(
    f"""WITH {q.SEG}, t AS (SELECT eval_id, canonical FROM terminology_eval UNION SELECT eval_id, unnest(aliases) FROM terminology_eval), n AS (SELECT DISTINCT eval_id, canonical AS term FROM t WHERE canonical <> '')
SELECT eval_id, term, CAST(sum((length(text) - length(replace(text, term, ''))) // length(term)) AS BIGINT) AS occurrences, count(*) AS segments FROM n JOIN seg ON contains(text, term) GROUP BY ALL"""
)
def alias_occurrence_count(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of every term and alias; each text is read once for all of them."""
    t = read_table(spark, d, "terminology_eval")
    names = t.select("eval_id", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.expr("cast(array() as array<string>)")))).alias("term")).where("term != ''").distinct()
    # a text is compared only with the terms whose first three characters (short terms: all) it holds
    rows = _seg(spark, d).select("segment_id", "text")
    found = None
    for size, some in ((3, names.where("char_length(term) >= 3")), (2, names.where("char_length(term) = 2")), (1, names.where("char_length(term) = 1"))):
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("text") - (size - 1)), lambda i: F.substring(F.col("text"), i, F.lit(size))))
        j = rows.where(F.char_length("text") >= size).select("text", F.explode(grams).alias("gram")).join(some.withColumn("gram", F.substring("term", 1, size)), "gram").where(F.contains("text", "term"))
        found = j if found is None else found.unionByName(j)
    return found.groupBy("eval_id", "term").agg(F.sum(tx.literal_count(F.col("text"), F.col("term"))).alias("occurrences"), F.count("*").alias("segments"))


@query()
def term_match_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Where each correction's term occurs in its segment, outside what already is canonical."""
    c = read_table(spark, d, "corrections").where("from_text is not null").select("correction_id", "segment_id", "from_text", "to_text").distinct()
    j = c.join(_seg(spark, d).select("segment_id", "text"), "segment_id")
    r = terms.match_ranges(F.col("text"), F.col("from_text"), F.col("to_text"))
    return j.select("correction_id", F.explode(r).alias("r")).select("correction_id", F.col("r.start").alias("start_offset"), F.col("r.end").alias("end_offset"))


@query(
    """WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+#_\\-]*[A-Za-z0-9+#]')) AS surface FROM documents)
SELECT surface, count(*) AS occurrences, count(DISTINCT doc_id) AS texts, regexp_matches(surface, '[_\\-]|[a-z][A-Z]|[A-Z]{2,}|[0-9+#]') AS identifier, lower(regexp_replace(surface, '[^A-Za-z0-9]', '', 'g')) AS term_key
FROM d WHERE length(surface) >= 3 GROUP BY surface"""
)
def surface_tokens(spark: SparkSession, d: str) -> DataFrame:
    """J7, F19 to F22, A36, C3."""
    return terms.surfaces(read_table(spark, d, "documents"), "doc_id", "text")


_VARIANTS = """d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+#_\\-]*[A-Za-z0-9+#]')) AS surface FROM documents),
k AS (SELECT lower(regexp_replace(surface, '[^A-Za-z0-9]', '', 'g')) AS key FROM d WHERE length(surface) >= 3 GROUP BY 1),
v AS (SELECT a.key AS l, b.key AS r FROM k a JOIN k b ON substr(a.key, 1, 1) = substr(b.key, 1, 1) AND a.key < b.key AND abs(length(a.key) - length(b.key)) < 3
  WHERE a.key <> '' AND NOT contains(a.key, b.key) AND NOT contains(b.key, a.key) AND levenshtein(a.key, b.key) <= greatest(1, CAST(floor(0.25 * greatest(length(a.key), length(b.key))) AS INT)))"""


def _keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys of all surfaces."""
    return terms.surface_keys(read_table(spark, d, "documents"), "text")


@query(f"WITH {_VARIANTS} SELECT l AS left, r AS right FROM v".replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"'))
def surface_variants(spark: SparkSession, d: str) -> DataFrame:
    """Variants among all keys, however rare."""
    return terms.variant_pairs(_keys(spark, d), "key")


@query(
    f"""WITH RECURSIVE {_VARIANTS}, e AS (SELECT l AS a, r AS b FROM v UNION SELECT r, l FROM v), reach(a, b) AS (SELECT a, a FROM e UNION SELECT a, b FROM e UNION SELECT x.a, e.b FROM reach x JOIN e ON e.a = x.b)
SELECT a AS node, min(b) AS component FROM reach GROUP BY a"""
)
def variant_components(spark: SparkSession, d: str) -> DataFrame:
    """G2, J7."""
    return terms.components(terms.variant_pairs(_keys(spark, d), "key"), "left", "right")


@query(
    f"""WITH RECURSIVE {_VARIANTS}, e AS (SELECT l AS a, r AS b FROM v UNION SELECT r, l FROM v), reach(a, b) AS (SELECT a, a FROM e UNION SELECT a, b FROM e UNION SELECT x.a, e.b FROM reach x JOIN e ON e.a = x.b), g AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
s AS (SELECT DISTINCT surface, lower(regexp_replace(surface, '[^A-Za-z0-9]', '', 'g')) AS term_key, regexp_matches(surface, {q.lit(terms.IDENTIFIER)}) AS identifier FROM d WHERE length(surface) >= 3),
p AS (SELECT coalesce(g.component, term_key) AS component, term_key, count(DISTINCT surface) AS n, bool_or(identifier) AS i FROM s LEFT JOIN g ON g.node = s.term_key WHERE term_key <> '' GROUP BY ALL)
SELECT component, count(*) AS keys, CAST(sum(n) AS BIGINT) AS spellings, CASE WHEN max(n) >= 2 AND bool_or(i) THEN 'mapped' ELSE 'review' END AS required_disposition FROM p GROUP BY component HAVING count(*) >= 2 OR sum(n) >= 2"""
)
def term_signals(spark: SparkSession, d: str) -> DataFrame:
    """Groups of spellings and variants of one term, with what must become of each."""
    spelled = cut(terms.surfaces(read_table(spark, d, "documents"), "doc_id", "text").select("surface", "term_key", "identifier"))
    pairs = terms.variant_pairs(spelled.select(F.col("term_key").alias("key")), "key")
    return terms.signals(spelled, terms.components(pairs, "left", "right"))


@query(
    f"""WITH {q.SEG}, c AS (SELECT DISTINCT correction_id, segment_id, from_text, start_offset, end_offset FROM corrections WHERE start_offset IS NOT NULL AND end_offset IS NOT NULL AND from_text IS NOT NULL)
SELECT correction_id, substr(text, start_offset + 1, end_offset - start_offset) = from_text AS reads_back FROM c JOIN seg USING (segment_id)"""
)
def ledger_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Whether each row of the ledger reads back its term at its offsets."""
    c = read_table(spark, d, "corrections").where("start_offset is not null and end_offset is not null and from_text is not null").select("correction_id", "segment_id", "from_text", "start_offset", "end_offset").distinct()
    j = c.join(_seg(spark, d).select("segment_id", "text"), "segment_id")
    return j.select("correction_id", (F.substring(F.col("text"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")) == F.col("from_text")).alias("reads_back"))


def _typed_pairs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "corrections").where("from_text is not null and to_text is not null").select("correction_id", "from_text", "to_text").distinct()


@query(
    f"""WITH c AS (SELECT DISTINCT correction_id, {q.correction('from_text')} AS a, {q.correction('to_text')} AS k, {q.nfkc('from_text')} AS fa, {q.nfkc('to_text')} AS fk FROM corrections WHERE from_text IS NOT NULL AND to_text IS NOT NULL)
SELECT correction_id, CASE WHEN length(a) < 3 OR length(k) < 3 THEN false WHEN a = k THEN fa <> fk WHEN regexp_matches(a, '^[a-z0-9+#]+$') AND regexp_matches(k, '^[a-z0-9+#]+$') THEN substr(a, 1, 1) = substr(k, 1, 1) AND levenshtein(a, k) <= greatest(2, ceil(greatest(length(a), length(k)) * 0.45)) END AS plausible
FROM c WHERE (length(a) < 3 OR length(k) < 3 OR a = k OR (regexp_matches(a, '^[a-z0-9+#]+$') AND regexp_matches(k, '^[a-z0-9+#]+$')))"""
)
def plausible_pairs(spark: SparkSession, d: str) -> DataFrame:
    """F16 of the pairs that the oracle can decide: ASCII keys (its edit distance counts bytes), equal or short ones."""
    c = _typed_pairs(spark, d)
    a, k = tx.correction_text(F.col("from_text")), tx.correction_text(F.col("to_text"))
    ascii_ = r"^[a-z0-9+#]+$"
    c = c.where((F.char_length(a) < 3) | (F.char_length(k) < 3) | (a == k) | (a.rlike(ascii_) & k.rlike(ascii_)))
    return c.select("correction_id", tx.plausible_pair(F.col("from_text"), F.col("to_text")).alias("plausible"))


@query()
def plausible_pairs_all(spark: SparkSession, d: str) -> DataFrame:
    """F16 of every pair, whatever its script."""
    return _typed_pairs(spark, d).select("correction_id", tx.plausible_pair(F.col("from_text"), F.col("to_text")).alias("plausible"))


@query(
    f"""WITH {q.SEG}, c AS (SELECT DISTINCT correction_id, segment_id, recording_id, {q.correction('from_text')} AS k, from_text, to_text, {q.nfkc('to_text')} AS tk FROM corrections WHERE from_text IS NOT NULL AND to_text IS NOT NULL AND to_text <> ''),
j AS (SELECT c.*, (length(text) - length(replace(text, from_text, ''))) // length(from_text) AS occ FROM c JOIN seg USING (segment_id) WHERE from_text <> '' AND contains(text, from_text)),
a AS (SELECT recording_id, k, min(to_text) AS canonical, count(DISTINCT tk) AS options, sum(occ) AS occ FROM j WHERE length(k) >= 2 GROUP BY ALL),
g AS (SELECT recording_id, canonical, count(*) AS aliases, CAST(sum(occ) AS BIGINT) AS occurrences FROM a WHERE options = 1 GROUP BY ALL)
SELECT recording_id, canonical, aliases, occurrences FROM g WHERE occurrences >= 2"""
)
def consensus_mapping(spark: SparkSession, d: str) -> DataFrame:
    """A5: canonicals on which all proposals of a recording agree, with two occurrences or more."""
    c = read_table(spark, d, "corrections").where("from_text is not null and from_text != '' and to_text is not null and to_text != ''").select("correction_id", "segment_id", "recording_id", "from_text", "to_text").distinct()
    j = c.join(_seg(spark, d).select("segment_id", "text"), "segment_id").where(F.contains("text", "from_text"))
    a = (
        j.select("recording_id", tx.correction_text(F.col("from_text")).alias("k"), "to_text", tx.nfkc(F.col("to_text")).alias("tk"), tx.literal_count(F.col("text"), F.col("from_text")).alias("occ"))
        .where("char_length(k) >= 2").groupBy("recording_id", "k").agg(F.min("to_text").alias("canonical"), F.countDistinct("tk").alias("options"), F.sum("occ").alias("occ"))
    )
    return a.where("options = 1").groupBy("recording_id", "canonical").agg(F.count("*").alias("aliases"), F.sum("occ").alias("occurrences")).where("occurrences >= 2")


# ---- ledgers (L3, L5 to L9, C14, C17) ------------------------------------------------------


@query(
    f"""WITH {q.SEG}, c AS (SELECT DISTINCT segment_id, start_offset AS s, end_offset AS e, from_text AS f, to_text AS t FROM corrections WHERE status = 'applied' AND start_offset IS NOT NULL AND end_offset IS NOT NULL AND from_text IS NOT NULL AND to_text IS NOT NULL),
j AS (SELECT c.*, text, max(e) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, 0 <= s AND s < e AND e <= length(text) AND substr(text, s + 1, e - s) = f AS reads FROM c JOIN seg USING (segment_id) WINDOW w AS (PARTITION BY segment_id ORDER BY s, e, f, t))
SELECT segment_id, CASE WHEN bool_and(coalesce(reads, false) AND coalesce(s >= before, true)) THEN string_agg(substr(text, CAST(coalesce(before, 0) AS BIGINT) + 1, CAST(s - coalesce(before, 0) AS BIGINT)) || t, '' ORDER BY s, e) || substr(any_value(text), CAST(max(e) AS BIGINT) + 1) END AS text FROM j GROUP BY segment_id"""
)
def corrected_texts(spark: SparkSession, d: str) -> DataFrame:
    """Applied corrections that read back replayed onto their segments; where two overlap, none is."""
    c = read_table(spark, d, "corrections").where("status = 'applied' and start_offset is not null and end_offset is not null and from_text is not null and to_text is not null")
    c = c.select("segment_id", F.struct("start_offset", "end_offset", "from_text", "to_text").alias("s")).groupBy("segment_id").agg(F.array_sort(F.collect_set("s")).alias("spans"))
    j = c.join(_seg(spark, d).select("segment_id", "text"), "segment_id")

    return j.select("segment_id", terms.replayed(F.col("text"), F.col("spans")).alias("text"))


@query(
    f"""WITH c AS (SELECT DISTINCT correction_id, status, reason, {q.correction('from_text')} AS k, from_text, to_text, start_offset FROM corrections),
SELECT""".replace(",\nSELECT", "\nSELECT")
    + """ correction_id, CASE WHEN from_text IS NULL OR from_text = '' OR to_text IS NULL OR to_text = '' THEN 'invalid_replacement' WHEN length(k) < 2 THEN 'unknown_canonical' WHEN start_offset IS NULL THEN 'from_not_found' WHEN status <> 'applied' THEN coalesce(reason, 'rejected') ELSE 'accepted' END AS verdict FROM c"""
)
def patch_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What the ledger's own columns say of each proposal; ``applied_patches`` derives the reasons."""
    c = read_table(spark, d, "corrections").select("correction_id", "status", "reason", "from_text", "to_text", "start_offset").distinct()
    blank = lambda n: F.col(n).isNull() | (F.col(n) == "")
    verdict = (
        F.when(blank("from_text") | blank("to_text"), "invalid_replacement").when(F.char_length(tx.correction_text(F.col("from_text"))) < 2, "unknown_canonical")
        .when(F.col("start_offset").isNull(), "from_not_found").when(F.col("status") != "applied", F.coalesce("reason", F.lit("rejected"))).otherwise("accepted")
    )
    return c.select("correction_id", verdict.alias("verdict"))


@query()
def source_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The FNV hash of every segment."""
    n = _norm(spark, d)
    return n.select("segment_id", tx.source_hash(F.col("pos"), F.col("start_seconds"), F.col("end_seconds"), F.col("speaker"), F.col("text")).alias("source_hash"))


@query(f"WITH {q.SEG} SELECT segment_id, array_to_string(regexp_extract_all(lower({q.nfkc('text')}), {q.lit(tx.FACT_PATTERN.replace('(?iu)', '(?i)'))}), '|') AS fingerprint FROM seg")
def critical_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """C14: numbers, dates, polarity and comparison of every segment."""
    return _seg(spark, d).select("segment_id", tx.critical_fingerprint(F.col("text")).alias("fingerprint"))


_FACTS = lambda x: f"list_concat(regexp_extract_all(lower({q.nfkc(x)}), {q.lit(tx.FACT_PATTERN.replace('(?iu)', '(?i)'))}), regexp_extract_all(lower({q.nfkc(x)}), {q.lit(tx.MEETING_FACT_PATTERN)}))"
_SIGNS = tx._class(tx.END_SIGNS)


@query(
    f"""WITH {q.SEG}, f AS (SELECT recording_id, unnest({_FACTS('text')}) AS x FROM seg), have AS (SELECT DISTINCT recording_id, {q.sub(q.sub('x', q.S + '+'), f'^[{_SIGNS}]+|[{_SIGNS}]+$')} AS fact FROM f),
g AS (SELECT recording_id, unnest({_FACTS('summary')}) AS x FROM meetings WHERE summary IS NOT NULL), want AS (SELECT DISTINCT recording_id, {q.sub(q.sub('x', q.S + '+'), f'^[{_SIGNS}]+|[{_SIGNS}]+$')} AS fact FROM g)
SELECT w.recording_id, w.fact FROM want w LEFT JOIN have h ON h.recording_id = w.recording_id AND h.fact = w.fact WHERE h.fact IS NULL AND w.fact <> ''"""
)
def missing_critical_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a summary that its transcript does not have."""
    have = _seg(spark, d).select("recording_id", F.explode(tx.meeting_facts(F.col("text"))).alias("fact")).distinct()
    want = read_table(spark, d, "meetings").where("summary is not null").select("recording_id", F.explode(tx.meeting_facts(F.col("summary"))).alias("fact")).distinct()
    return want.join(have, ["recording_id", "fact"], "left_anti")


# ---- classifiers (F1 to F15, F29, F38, C29, C30) -------------------------------------------

_Q = q.question("text")
_U2 = f"({q.has('text', '[?？]')} OR {_Q} OR {q.has('text', lx.NOT_MADE)} OR {q.has('text', lx.UNRESOLVED)})"
_U5 = f"({q.has('text', '[?？]')} OR {_Q} OR {q.has('text', lx.NOT_MADE)} OR {q.has('text', lx.UNCERTAIN_ACTION)} OR {q.has('text', lx.NEGATED_ACTION)} OR {q.has('text', lx.REJECTED_ACTION)})"
_F8 = f"({q.has('text', lx.DECISION)} OR {q.has('text', lx.COMMITTED)})"


@query(
    f"""WITH {q.SEG} SELECT segment_id, {q.has('text', lx.DECISION)} AS decision_words, {_U2} AS unresolved, {q.has('text', lx.CONCRETE_ACTION)} AS action_words, {_U5} AS uncertain_action, {_Q} AS question, {q.has('text', lx.NOT_MADE)} AS not_made,
{_F8} AS committed, {q.has('text', lx.DECISION)} AND NOT {_U2} AS decision, {q.has('text', lx.CONCRETE_ACTION)} AND {_F8} AND NOT {_U2} AND NOT {_U5} AS affirmative, {q.trim('text')} <> '' AND NOT {q.has('text', '[?？]')} AND NOT {_Q} AND NOT {q.has('text', lx.NOT_MADE)} AS floor_passed,
{q.has('text', lx.DUE)} AS due, {q.has('text', lx.UNSAFE_QUALIFIER)} AS qualified FROM seg"""
)
def commitment_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every classifier over every segment."""
    return lx.classify(_seg(spark, d), "segment_id", "text")


@query(f"WITH {q.SEG} SELECT segment_id, length(text) > 800 OR coalesce(end_seconds - start_seconds > 90.0, false) AS oversized FROM seg")
def oversized_evidence(spark: SparkSession, d: str) -> DataFrame:
    """F38."""
    return _seg(spark, d).select("segment_id", ((F.char_length("text") > 800) | F.coalesce(F.col("end_seconds") - F.col("start_seconds") > 90.0, F.lit(False))).alias("oversized"))


@query(f"WITH {q.SEG} SELECT segment_id, array_to_string({q.clauses('text')}, '|') AS clauses, len({q.clauses('text')}) AS n FROM seg")
def evidence_clauses(spark: SparkSession, d: str) -> DataFrame:
    """C29, C30, O7."""
    c = tx.clauses(F.col("text"))
    return _seg(spark, d).select("segment_id", F.array_join(c, "|").alias("clauses"), F.size(c).alias("n"))


@query(
    f"""WITH {q.SEG} SELECT segment_id, {q.comparable('text')} AS comparable, {q.correction('text')} AS correction, {q.term_key('text')} AS term, {q.alias_key('text')} AS alias, {q.match_text('text')} AS matching,
CASE WHEN length(text) > 80 THEN substr(text, 1, 77) || '...' ELSE text END AS cut, CASE WHEN length(text) > 60 THEN substr(text, 1, 29) || '...' || right(text, 28) ELSE text END AS middle, {q.clock('start_seconds')} AS clock, {q.html_escape('text')} AS html FROM seg"""
)
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    """The text functions over every segment."""
    t = F.col("text")
    return _seg(spark, d).select(
        "segment_id", tx.comparable_text(t).alias("comparable"), tx.correction_text(t).alias("correction"), tx.term_key(t).alias("term"), tx.mapping_alias_key(t).alias("alias"), tx.match_text(t).alias("matching"),
        tx.truncate_text(t, 80).alias("cut"), tx.middle_truncate(t, 60).alias("middle"), tx.clock(F.col("start_seconds")).alias("clock"), tx.html_escape(t).alias("html"),
    )


# ---- records and sinks (S12 to S15, J8 to J10, K1 to K9, K16, K20, K21, O6, P6, W16 to W18) --


@query("SELECT recording_id, status FROM meetings WHERE recording_id NOT IN (SELECT recording_id FROM tombstones)")
def tombstone_anti(spark: SparkSession, d: str) -> DataFrame:
    """J8, S12, S15, K15."""
    return read_table(spark, d, "meetings").join(read_table(spark, d, "tombstones"), "recording_id", "left_anti").select("recording_id", "status")


@query(
    """WITH k AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, recording_id) AS r FROM meetings WHERE recording_id NOT IN (SELECT recording_id FROM tombstones))
SELECT recording_id, CAST(r AS INT) AS place, CASE WHEN status IN ('transcribing', 'correcting', 'summarizing') THEN 'error' ELSE status END AS status FROM k WHERE r <= 40"""
)
def newest_records(spark: SparkSession, d: str) -> DataFrame:
    """The newest 40 records (the list's length is the feature), those in flight as errors.

    The first 40 are taken before they are numbered, so no task sorts more than a partition.
    """
    live = read_table(spark, d, "meetings").join(read_table(spark, d, "tombstones"), "recording_id", "left_anti")
    top = live.orderBy(F.desc("created_at"), "recording_id").limit(40)
    place = F.row_number().over(Window.orderBy(F.desc("created_at"), "recording_id"))
    return top.select("recording_id", place.alias("place"), F.when(F.col("status").isin("transcribing", "correcting", "summarizing"), "error").otherwise(F.col("status")).alias("status"))


@query("SELECT recording_id, 'pending' AS state FROM meetings WHERE status = 'error' AND recording_id NOT IN (SELECT recording_id FROM tombstones) UNION ALL SELECT DISTINCT recording_id, state FROM tombstones")
def write_tombstones(spark: SparkSession, d: str) -> DataFrame:
    """Failed records buried, each once."""
    graves = read_table(spark, d, "tombstones").distinct()
    fresh = read_table(spark, d, "meetings").where("status = 'error'").join(graves, "recording_id", "left_anti").select("recording_id", F.lit("pending").alias("state"))
    return fresh.unionByName(graves)


@query(
    f"""WITH {q.NORM}, p AS (SELECT *, sum(18 + 20 * CAST(ceil(length(text) / 40.0) AS BIGINT)) OVER (PARTITION BY recording_id, session_no ORDER BY pos ROWS UNBOUNDED PRECEDING) AS bottom FROM norm)
SELECT segment_id, CAST(floor(pos / 200) AS BIGINT) AS page, CAST(bottom AS BIGINT) AS bottom, {q.html_escape('text')} AS html, lower(speaker || ' ' || text) AS search FROM p"""
)
def share_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 200 rows, their heights and search text."""
    h = F.sum(18 + 20 * F.ceil(F.char_length("text") / 40.0)).over(timeline.in_order().rowsBetween(Window.unboundedPreceding, 0))
    return _norm(spark, d).select("segment_id", F.floor(F.col("pos") / 200).alias("page"), h.cast("bigint").alias("bottom"), tx.html_escape(F.col("text")).alias("html"), F.lower(F.concat_ws(" ", "speaker", "text")).alias("search"))


@query(
    f"""WITH {q.NORM}, p AS (SELECT *, sum(18 + 20 * CAST(ceil(length(text) / 40.0) AS BIGINT)) OVER (PARTITION BY recording_id, session_no ORDER BY pos ROWS UNBOUNDED PRECEDING) AS bottom FROM norm),
f AS (SELECT recording_id, session_no, coalesce(max(pos) FILTER (WHERE bottom <= 1000) + 1, 0) AS top FROM p GROUP BY ALL)
SELECT segment_id FROM norm JOIN f USING (recording_id, session_no) WHERE pos >= top AND pos < top + 180"""
)
def visible_window(spark: SparkSession, d: str) -> DataFrame:
    """The 180 rows seen from offset 1,000 on (the window's height is the feature)."""
    n = _norm(spark, d)
    h = F.sum(18 + 20 * F.ceil(F.char_length("text") / 40.0)).over(timeline.in_order().rowsBetween(Window.unboundedPreceding, 0))
    rows = n.select(*SESSION, "pos", "segment_id", h.alias("bottom"))
    top = F.coalesce(F.max(F.when(F.col("bottom") <= 1000, F.col("pos"))).over(Window.partitionBy(*SESSION)) + 1, F.lit(0))
    return rows.withColumn("top", top).where("pos >= top and pos < top + 180").select("segment_id")


@query(
    f"""WITH {q.NORM}, l AS (SELECT recording_id, session_no, pos, '**[' || {q.clock('start_seconds')} || '] ' || speaker || '：** ' || text AS line FROM norm)
SELECT recording_id, session_no, pos // 200 AS page, string_agg(line, chr(10) || chr(10) ORDER BY pos) AS body, count(*) AS segments FROM l GROUP BY ALL"""
)
def markdown_export(spark: SparkSession, d: str) -> DataFrame:
    """Each session as a document, in pages of 200 rows."""
    line = F.concat(F.lit("**["), tx.clock(F.col("start_seconds")), F.lit("] "), F.col("speaker"), F.lit("：** "), F.col("text"))
    rows = _norm(spark, d).select(*SESSION, F.floor(F.col("pos") / 200).cast("int").alias("page"), F.struct("pos", line.alias("line")).alias("x"))
    return rows.groupBy(*SESSION, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n\n").alias("body"), F.count("*").alias("segments"))


@query(
    f"""WITH {q.NORM} SELECT recording_id, m.title, coalesce(nullif({q.trim('m.summary')}, ''), '-') AS summary, count(n.segment_id) AS segments, count(DISTINCT n.speaker) AS speakers, coalesce(max(n.end_seconds), 0.0) AS length_seconds
FROM meetings m LEFT JOIN norm n USING (recording_id) GROUP BY ALL"""
)
def public_meetings(spark: SparkSession, d: str) -> DataFrame:
    """The public header of every meeting."""
    n = _norm(spark, d).groupBy("recording_id").agg(F.count("*").alias("segments"), F.countDistinct("speaker").alias("speakers"), F.max("end_seconds").alias("length_seconds"))
    m = read_table(spark, d, "meetings").select("recording_id", "title", tx.string_or(F.col("summary"), "-").alias("summary"))
    return m.join(n, "recording_id", "left").select("recording_id", "title", "summary", F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("speakers", F.lit(0)).alias("speakers"), F.coalesce("length_seconds", F.lit(0.0)).alias("length_seconds"))


@query(
    f"""WITH {q.NORM}, b AS (SELECT recording_id, session_no, pos, CASE WHEN pos = 0 OR start_seconds - max(coalesce(end_seconds, start_seconds)) OVER (PARTITION BY recording_id, session_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 4.0 THEN 1 ELSE 0 END AS brk, start_seconds FROM norm)
SELECT recording_id, session_no, pos, CAST(sum(brk) OVER (PARTITION BY recording_id, session_no ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM b"""
)
def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a session that silence of more than four seconds separates."""
    w = timeline.in_order()
    reach = F.max(F.coalesce("end_seconds", "start_seconds")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    brk = F.when((F.col("pos") == 0) | (F.col("start_seconds") - reach > 4.0), 1).otherwise(0)
    return _norm(spark, d).withColumn("brk", brk).select(*SESSION, "pos", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("part"))


@query(
    f"""WITH {q.NORM} SELECT recording_id, session_no, CAST(floor(start_seconds / 30.0) AS BIGINT) AS window_no, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS characters, count(DISTINCT speaker) AS speakers FROM norm GROUP BY ALL"""
)
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    """T1 in batch: windows of 30 seconds of each session's clock."""
    return _norm(spark, d).groupBy(*SESSION, F.floor(F.col("start_seconds") / 30.0).alias("window_no")).agg(F.count("*").alias("segments"), F.sum(F.char_length("text")).alias("characters"), F.countDistinct("speaker").alias("speakers"))


@query("SELECT recording_id, duration_seconds, CASE WHEN duration_seconds > 0 THEN duration_seconds ELSE 0.0 END AS stored, CASE WHEN coalesce(duration_seconds, 0) > 14400 THEN 'too_long' WHEN duration_seconds IS NULL THEN 'unknown' ELSE 'ok' END AS verdict, coalesce(duration_seconds > 0 AND duration_seconds <= 1800, false) AS fallback FROM meetings")
def upload_limits(spark: SparkSession, d: str) -> DataFrame:
    """Admission of a recording by its length."""
    n = F.col("duration_seconds")
    return read_table(spark, d, "meetings").select(
        "recording_id", "duration_seconds", F.when(n > 0, n).otherwise(0.0).alias("stored"), F.when(n > 14400, "too_long").when(n.isNull(), "unknown").otherwise("ok").alias("verdict"), F.coalesce((n > 0) & (n <= 1800), F.lit(False)).alias("fallback")
    )


@query(
    f"""WITH {q.NORM}, k AS (SELECT recording_id, {q.comparable('speaker')} AS key, arg_min(speaker, (session_no, pos)) AS speaker, count(*) AS n FROM norm GROUP BY ALL), f AS (SELECT DISTINCT recording_id, {q.comparable('speaker')} AS key FROM corrections c JOIN norm USING (recording_id) WHERE c.segment_id = norm.segment_id)
SELECT recording_id, key, speaker, n FROM k WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.recording_id = k.recording_id AND f.key = k.key)"""
)
def uncorrected_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Speakers of a recording none of whose segments was corrected."""
    n = _norm(spark, d).withColumn("key", tx.comparable_text(F.col("speaker")))
    hit = read_table(spark, d, "corrections").select("segment_id").distinct()
    fixed = n.join(hit, "segment_id", "left_semi").select("recording_id", "key").distinct()
    each = n.groupBy("recording_id", "key").agg(F.min_by("speaker", F.struct("session_no", "pos")).alias("speaker"), F.count("*").alias("n"))
    return each.join(fixed, ["recording_id", "key"], "left_anti")


# ---- sources and display (S2 to S5, S16, S20, K10, W5, K7) ---------------------------------


@query(
    f"""WITH {q.NORM} SELECT recording_id, session_no, CAST(pos AS INT) AS seg_idx, CASE WHEN start_seconds >= 0 AND end_seconds > start_seconds THEN start_seconds ELSE 0.0 END AS start_seconds,
CASE WHEN start_seconds >= 0 AND end_seconds > start_seconds THEN end_seconds ELSE 0.0 END AS end_seconds, CASE WHEN start_seconds >= 0 AND end_seconds > start_seconds THEN 'provider' ELSE 'inferred' END AS timing_source, speaker, text FROM norm"""
)
def provider_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Every session written as a provider's answers of 256 segments, and parsed."""
    from turnmill.sources.envelopes import parse_responses

    seg = F.struct(F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"), "speaker", "text")
    page = F.floor(F.col("pos") / 256).cast("int")
    body = _norm(spark, d).groupBy(*SESSION, page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("pos", seg.alias("s")))).alias("x"))
    body = body.select(F.to_json(F.struct(*SESSION, "page")).alias("id"), F.to_json(F.struct(F.transform("x", lambda x: x["s"]).alias("segments"))).alias("body"))
    out = parse_responses(body, "id", "body").withColumn("k", F.from_json("id", "recording_id string, session_no int, page int"))
    return out.select("k.recording_id", "k.session_no", (F.col("k.page") * 256 + F.col("seg_idx")).alias("seg_idx"), "start_seconds", "end_seconds", "timing_source", "speaker", "text")


@query("SELECT recording_id, title, summary IS NOT NULL AS told FROM meetings")
def share_links(spark: SparkSession, d: str) -> DataFrame:
    """Every meeting written as a link, and read again."""
    from turnmill.sources.envelopes import link_of, payload_of

    m = read_table(spark, d, "meetings").select("recording_id", "title", "summary", F.array().cast("array<string>").alias("segments"))
    link = link_of(F.to_json(F.struct("recording_id", "title", "summary", "segments")))
    back = F.from_json(payload_of(link), "recording_id string, title string, summary string")
    return m.select(back.alias("b")).select("b.recording_id", "b.title", F.col("b.summary").isNotNull().alias("told"))


@query()
def display_projection(spark: SparkSession, d: str) -> DataFrame:
    """Display texts and what each hides."""
    from turnmill.operators.display import display_projection as project

    return project(_norm(spark, d))


@query()
def context_groups(spark: SparkSession, d: str) -> DataFrame:
    """The joined text around each segment."""
    return timeline.context_groups(_norm(spark, d))


@query()
def action_support(spark: SparkSession, d: str) -> DataFrame:
    """Whether each corrected segment commits to its term, as owner, and to a day."""
    from turnmill.operators import actions

    c = read_table(spark, d, "corrections").where("to_text is not null and to_text != ''").select("correction_id", "segment_id", "to_text").distinct()
    j = tx.fold(c.join(_seg(spark, d).select("segment_id", "text"), "segment_id"), "text", "to_text")
    day = F.nullif(F.regexp_extract("text", "((?i)周[一二三四五六日]|monday|tuesday|wednesday|thursday|friday)", 1), F.lit(""))
    t = F.col("text")
    return j.select(
        "correction_id", actions.holds(t, F.col("to_text")).alias("named"), actions.owner_supported(t, F.col("to_text")).alias("owner"),
        actions.due_supported(t, F.coalesce(day, F.lit("")), F.col("to_text"), F.col("to_text")).alias("due"),
    )


# ---- further joins, aggregates and ledgers -------------------------------------------------


@query(f"WITH {q.SEG} SELECT recording_id, session_no, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS characters FROM seg GROUP BY ALL")
def stream_intake(spark: SparkSession, d: str) -> DataFrame:
    """The segments taken in as a stream, redeliveries once, then counted."""
    from turnmill.streaming.intake import stream_table, take_in

    log = take_in(stream_table(spark, d, "segments"), "segment_id")
    return log.groupBy(*SESSION).agg(F.count("*").alias("segments"), F.sum(F.char_length("text")).alias("characters"))


@query(
    f"""WITH {q.NORM}, a AS (SELECT recording_id, session_no, pos, segment_id FROM norm WHERE regexp_matches(text, '[0-9]{{5,}}')), b AS (SELECT recording_id, session_no, pos, segment_id FROM norm WHERE join_next)
SELECT a.segment_id AS number_segment, b.segment_id AS joined_segment FROM a JOIN b ON a.recording_id = b.recording_id AND a.session_no = b.session_no AND abs(a.pos - b.pos) <= 1"""
)
def band_join(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours at most one position apart, as a hash join on the positions beside each."""
    n = _norm(spark, d)
    a = n.where(F.col("text").rlike("[0-9]{5,}")).select(*SESSION, F.col("segment_id").alias("number_segment"), F.explode(F.array(F.col("pos") - 1, F.col("pos"), F.col("pos") + 1)).alias("pos"))
    b = n.where("join_next").select(*SESSION, "pos", F.col("segment_id").alias("joined_segment"))
    return a.join(b, [*SESSION, "pos"]).select("number_segment", "joined_segment")


@query("SELECT recording_id, CAST(sum(metrics.completion_tokens) AS BIGINT) AS tokens, CAST(sum(metrics.character_count) AS BIGINT) AS characters, count(*) AS calls FROM quality_events GROUP BY recording_id")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    """A11, A12, C63."""
    m = F.col("metrics")
    return read_table(spark, d, "quality_events").groupBy("recording_id").agg(F.sum(m["completion_tokens"]).alias("tokens"), F.sum(m["character_count"]).alias("characters"), F.count("*").alias("calls"))


@query(
    f"""WITH {q.SEG}, c AS (SELECT canonical FROM terminology_eval WHERE regexp_matches(canonical, '^[A-Za-z0-9]+$')), t AS (SELECT segment_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS word FROM seg)
SELECT canonical, count(*) AS occurrences, count(DISTINCT segment_id) AS segments FROM t JOIN c ON word = canonical GROUP BY canonical"""
)
def bounded_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of canonical identifiers between word boundaries."""
    names = read_table(spark, d, "terminology_eval").where(F.col("canonical").rlike("^[A-Za-z0-9]+$")).select("canonical")
    words = _seg(spark, d).select("segment_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("canonical")).join(names, "canonical")
    each = words.groupBy("segment_id", "canonical").count()
    return each.groupBy("canonical").agg(F.sum("count").alias("occurrences"), F.count("*").alias("segments"))


@query(
    """WITH c AS (SELECT DISTINCT correction_id, recording_id, status, reason FROM corrections), k AS (SELECT *, CASE status WHEN 'applied' THEN 'decision' WHEN 'rejected' THEN 'highlight' ELSE 'action' END AS kind FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, kind ORDER BY correction_id) AS n FROM k),
b AS (SELECT *, CASE kind WHEN 'action' THEN 1 WHEN 'decision' THEN 2 ELSE 3 END AS prio FROM r WHERE n <= CASE kind WHEN 'action' THEN 60 ELSE 30 END),
t AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY prio, n) AS place FROM b)
SELECT recording_id, kind || '-' || n AS id, correction_id, CAST(place AS INT) AS place FROM t WHERE place <= 400"""
)
def evidence_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Entries numbered by kind, in order of priority, under the ledger's caps (caps are the feature)."""
    c = read_table(spark, d, "corrections").select("correction_id", "recording_id", "status", "reason").distinct()
    kind = F.when(F.col("status") == "applied", "decision").when(F.col("status") == "rejected", "highlight").otherwise("action")
    r = c.withColumn("kind", kind).withColumn("n", F.row_number().over(Window.partitionBy("recording_id", "kind").orderBy("correction_id")))
    r = r.where(F.col("n") <= F.when(F.col("kind") == "action", 60).otherwise(30)).withColumn("prio", F.when(F.col("kind") == "action", 1).when(F.col("kind") == "decision", 2).otherwise(3))
    r = r.withColumn("place", F.row_number().over(Window.partitionBy("recording_id").orderBy("prio", "n"))).where("place <= 400")
    return r.select("recording_id", F.concat("kind", F.lit("-"), "n").alias("id"), "correction_id", "place")


@query(
    f"""WITH c AS (SELECT DISTINCT correction_id, recording_id, {q.correction('from_text')} AS k, to_text, reason FROM corrections WHERE from_text IS NOT NULL AND to_text IS NOT NULL AND to_text <> ''),
x AS (SELECT {q.correction('canonical')} AS k, min(canonical) AS canonical FROM terminology_eval GROUP BY 1), ra AS (SELECT recording_id, k, CASE WHEN count(DISTINCT to_text) = 1 THEN min(to_text) END AS agreed FROM c WHERE reason = 'recording_consensus' GROUP BY ALL),
ks AS (SELECT DISTINCT recording_id, k FROM c WHERE length(k) >= 2)
SELECT recording_id, k AS alias_key, coalesce(canonical, agreed) AS canonical, CASE WHEN canonical IS NOT NULL THEN 'explicit' WHEN agreed IS NOT NULL THEN 'review' ELSE 'open' END AS authority FROM ks LEFT JOIN x USING (k) LEFT JOIN ra USING (recording_id, k)"""
)
def authority_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The canonical of each alias by authority: the list, then the one spelling all reviews agree on."""
    c = read_table(spark, d, "corrections").where("from_text is not null and to_text is not null and to_text != ''").select("correction_id", "recording_id", tx.correction_text(F.col("from_text")).alias("alias_key"), "to_text", "reason").distinct()
    listed = read_table(spark, d, "terminology_eval").groupBy(tx.correction_text(F.col("canonical")).alias("alias_key")).agg(F.min("canonical").alias("listed"))
    reviews = c.where("reason = 'recording_consensus'").groupBy("recording_id", "alias_key").agg(F.when(F.countDistinct("to_text") == 1, F.min("to_text")).alias("agreed"))
    keys = c.where("char_length(alias_key) >= 2").select("recording_id", "alias_key").distinct()
    j = keys.join(listed, "alias_key", "left").join(reviews, ["recording_id", "alias_key"], "left")
    return j.select("recording_id", "alias_key", F.coalesce("listed", "agreed").alias("canonical"), F.when(F.col("listed").isNotNull(), "explicit").when(F.col("agreed").isNotNull(), "review").otherwise("open").alias("authority"))


@query(
    """WITH s AS (SELECT recording_id, list_sort(list(DISTINCT speaker)) AS want FROM segments WHERE speaker IS NOT NULL GROUP BY recording_id), c AS (SELECT s.recording_id, count(*) AS n FROM (SELECT DISTINCT correction_id, recording_id FROM corrections) s GROUP BY 1)
SELECT m.recording_id, coalesce(c.n, 0) AS corrections, coalesce(len(s.want), 0) AS labels, c.n IS NULL AS untouched FROM meetings m LEFT JOIN c USING (recording_id) LEFT JOIN s USING (recording_id)"""
)
def competency_join(spark: SparkSession, d: str) -> DataFrame:
    """How many corrections and labels each recording has; recordings without any are kept."""
    m = read_table(spark, d, "meetings").select("recording_id")
    s = read_table(spark, d, "segments").where("speaker is not null").groupBy("recording_id").agg(F.countDistinct("speaker").alias("labels"))
    c = read_table(spark, d, "corrections").groupBy("recording_id").agg(F.countDistinct("correction_id").alias("n"))
    j = m.join(c, "recording_id", "left").join(s, "recording_id", "left")
    return j.select("recording_id", F.coalesce("n", F.lit(0)).alias("corrections"), F.coalesce("labels", F.lit(0)).alias("labels"), F.col("n").isNull().alias("untouched"))


@query()
def commitment_proofs(spark: SparkSession, d: str) -> DataFrame:
    """The hash of each meeting's transcript, over the hashes of its segments in order."""
    n = _norm(spark, d)
    h = n.select("recording_id", "session_no", "pos", "end_seconds", tx.source_hash(F.col("pos"), F.col("start_seconds"), F.col("end_seconds"), F.col("speaker"), F.col("text")).alias("h"))
    # a thousand hashes at a time, so that no row holds a whole hot session
    p = h.groupBy(*SESSION, F.floor(F.col("pos") / 1024).alias("page")).agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("x"), F.max("end_seconds").alias("end_seconds"), F.count("*").alias("n"))
    p = p.withColumn("h", F.sha2(F.array_join(F.transform("x", lambda x: x["h"]), ","), 256))
    g = p.groupBy(*SESSION).agg(F.array_sort(F.collect_list(F.struct("page", "h"))).alias("x"), F.max("end_seconds").alias("end_seconds"), F.sum("n").alias("segments"))
    return g.select(*SESSION, F.sha2(F.array_join(F.transform("x", lambda x: x["h"]), ","), 256).alias("signature"), "end_seconds", "segments")


@query(
    f"""WITH {q.SEG}, f AS (SELECT segment_id, recording_id, lower({q.nfkc('text')}) AS t FROM seg), han AS (SELECT segment_id, unnest(regexp_extract_all(t, '\\p{{Han}}+')) AS run FROM f),
g AS (SELECT DISTINCT segment_id, substr(run, CAST(i AS BIGINT), 2) AS token FROM han, LATERAL unnest(generate_series(1, length(run) - 1)) u(i) UNION SELECT DISTINCT segment_id, unnest(regexp_extract_all(t, '[a-z0-9]{{3,}}')) FROM f),
m AS (SELECT recording_id, lower({q.nfkc('title')}) AS t FROM meetings WHERE title IS NOT NULL), mh AS (SELECT recording_id, unnest(regexp_extract_all(t, '\\p{{Han}}+')) AS run FROM m),
mg AS (SELECT DISTINCT recording_id, substr(run, CAST(i AS BIGINT), 2) AS token FROM mh, LATERAL unnest(generate_series(1, length(run) - 1)) u(i) UNION SELECT DISTINCT recording_id, unnest(regexp_extract_all(t, '[a-z0-9]{{3,}}')) FROM m)
SELECT s.segment_id, count(*) AS shared FROM seg s JOIN g USING (segment_id) JOIN mg ON mg.recording_id = s.recording_id AND mg.token = g.token GROUP BY s.segment_id HAVING count(*) >= 2"""
)
def context_match(spark: SparkSession, d: str) -> DataFrame:
    """segments that share two tokens or more (ideograph pairs, Latin words) with their meeting's title."""

    def tokens(c):
        t = F.lower(tx.nfkc(c))
        runs = F.regexp_extract_all(t, F.lit(r"\p{IsHan}+"), F.lit(0))
        pairs = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit("(?=(.{2}))"), F.lit(1))))
        return F.array_distinct(F.concat(pairs, F.regexp_extract_all(t, F.lit("[a-z0-9]{3,}"), F.lit(0))))

    s = _seg(spark, d).select("segment_id", "recording_id", tokens(F.col("text")).alias("a"))
    m = read_table(spark, d, "meetings").where("title is not null").select("recording_id", tokens(F.col("title")).alias("b"))
    j = s.join(m, "recording_id").select("segment_id", F.size(F.array_intersect("a", "b")).cast("bigint").alias("shared"))
    return j.where("shared >= 2")


@query(
    f"""WITH c AS (SELECT recording_id, unnest({q.clauses("coalesce(summary, '')")}) AS clause, unnest(generate_series(1, len({q.clauses("coalesce(summary, '')")}))) AS i, len({q.clauses("coalesce(summary, '')")}) AS n FROM meetings)
SELECT recording_id, string_agg(clause, '；' ORDER BY i) FILTER (WHERE n <= 8 OR i = 1 OR i = n OR i % 2 = 1) AS thinned, greatest(12, CAST(max(n) AS INT) * 2) AS least FROM c GROUP BY recording_id"""
)
def summary_thinning(spark: SparkSession, d: str) -> DataFrame:
    """Of a summary of more than eight clauses the first, the last and every other one between."""
    m = read_table(spark, d, "meetings").select("recording_id", tx.clauses(F.coalesce("summary", F.lit(""))).alias("c")).where(F.size("c") > 0)
    kept = F.filter("c", lambda x, i: (F.size("c") <= 8) | (i == 0) | (i == F.size("c") - 1) | (i % 2 == 0))
    return m.select("recording_id", F.array_join(kept, "；").alias("thinned"), F.greatest(F.lit(12), F.size("c") * 2).alias("least"))


@query(
    """WITH v AS (SELECT DISTINCT recording_id, correction_id, coalesce(reason, 'none') AS reason FROM corrections WHERE status <> 'applied'), r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY correction_id, reason) AS n FROM v)
SELECT recording_id, string_agg(reason, ',' ORDER BY n) FILTER (WHERE n <= 40) AS shown, greatest(0, count(*) - 40) AS omitted FROM r GROUP BY recording_id"""
)
def bounded_violations(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 violations of a recording (the report's length is the feature) and how many are left out."""
    v = read_table(spark, d, "corrections").where("status != 'applied'").select("recording_id", "correction_id", F.coalesce("reason", F.lit("none")).alias("reason")).distinct()
    v = v.withColumn("n", F.row_number().over(Window.partitionBy("recording_id").orderBy("correction_id", "reason")))
    shown = F.collect_list(F.when(F.col("n") <= 40, F.struct("n", "reason")))
    return v.groupBy("recording_id").agg(F.array_join(F.transform(F.array_sort(shown), lambda x: x["reason"]), ",").alias("shown"), F.greatest(F.lit(0), F.count("*") - 40).alias("omitted"))
