"""Registered queries of proposals, evidence and admission, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnmill.functions import lexicon as lx
from turnmill.functions import text as tx
from turnmill.operators import evidence, patches, terms, timeline
from turnmill.operators.timeline import SESSION
from turnmill.plans import sql as q
from turnmill.runtime import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return register


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    """Each row of the ledger once, as a proposal; its ``ord`` is its id."""
    c = read_table(spark, d, "corrections")
    return c.select("correction_id", "segment_id", "recording_id", *[x for x in ("session_no", "seg_idx", "start_seconds")], "from_text", "to_text", "status", F.col("correction_id").alias("ord")).distinct()


def _context(spark: SparkSession, d: str) -> DataFrame:
    """The reference list as a naming context: every alias with its canonical name."""
    pairs = read_table(spark, d, "terminology_eval").select("eval_id", "canonical", F.explode("aliases").alias("alias"))
    return terms.alias_edges(pairs, [], "alias", "canonical", "eval_id").withColumn("reason", F.lit("explicit_alias"))


# ---- proposals (L5 to L7, J19 to J21) ------------------------------------------------------

_PROPOSALS = f"""c AS (SELECT DISTINCT correction_id, segment_id, status, from_text, to_text, {q.trim("coalesce(from_text, '')")} AS f, {q.trim("coalesce(to_text, '')")} AS t FROM corrections),
k AS (SELECT *, {q.correction('f')} AS fk, {q.correction('t')} AS tk FROM c),
al AS (SELECT {q.correction('alias')} AS key, canonical, eval_id FROM (SELECT eval_id, canonical, unnest(aliases) AS alias FROM terminology_eval)),
ctx AS (SELECT key, arg_min(canonical, (eval_id, canonical)) AS canonical, count(DISTINCT {q.nfkc('canonical')}) > 1 AS conflict FROM al WHERE length(key) >= 2 GROUP BY key),
nm AS (SELECT DISTINCT {q.correction('canonical')} AS key FROM ctx),
m AS (SELECT k.*, a.canonical, a.conflict, b.canonical AS to_canonical, nm.key IS NOT NULL AS is_canonical FROM k LEFT JOIN ctx a ON a.key = k.fk LEFT JOIN ctx b ON b.key = k.tk AND NOT b.conflict LEFT JOIN nm ON nm.key = k.tk)"""
_NAMING = f"""CASE WHEN f = '' OR t = '' THEN 'invalid_replacement' WHEN conflict THEN 'conflicting_alias_mapping' WHEN canonical IS NULL AND is_canonical THEN 'explicit_alias_required'
WHEN canonical IS NULL THEN 'unknown_canonical' WHEN {q.nfkc('t')} <> {q.nfkc('canonical')} THEN 'canonical_mismatch' END"""


@query(f"WITH {_PROPOSALS} SELECT correction_id, {_NAMING} AS reason FROM m")
def patch_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The first of the reasons that names alone give against each proposal."""
    m = patches.with_mapping(_ledger(spark, d), _context(spark, d))
    return m.select("correction_id", patches.naming_reason(m).alias("reason"))


@query()
def applied_patches(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of all proposals, applied to their segments."""
    segments = timeline.distinct_segments(read_table(spark, d, "segments"))
    return patches.apply_proposals(_ledger(spark, d), _context(spark, d), segments)[0]


@query()
def patched_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts with their proposals applied."""
    segments = timeline.distinct_segments(read_table(spark, d, "segments"))
    return patches.apply_proposals(_ledger(spark, d), _context(spark, d), segments)[1]


@query(
    """WITH c AS (SELECT DISTINCT correction_id, segment_id, from_text, to_text, status FROM corrections), m AS (SELECT * FROM c WHERE status = 'applied'),
r AS (SELECT segment_id, from_text, to_text, min(correction_id) AS ord FROM c WHERE status <> 'applied' AND NOT EXISTS (SELECT 1 FROM m WHERE m.segment_id = c.segment_id AND m.from_text IS NOT DISTINCT FROM c.from_text AND m.to_text IS NOT DISTINCT FROM c.to_text) GROUP BY ALL)
SELECT segment_id, from_text, to_text, correction_id AS ord, 'model' AS origin FROM m UNION ALL SELECT segment_id, from_text, to_text, ord, 'reusable' FROM r"""
)
def merged_patches(spark: SparkSession, d: str) -> DataFrame:
    """The applied proposals and, once each, those of the others that they do not hold."""
    c = _ledger(spark, d)
    return patches.merge_proposals(c.where("status = 'applied'"), c.where("status != 'applied'"))


@query(f"WITH {_PROPOSALS} SELECT correction_id FROM m WHERE NOT coalesce(canonical IS NOT NULL AND NOT conflict AND {q.nfkc('coalesce(to_canonical, t)')} = {q.nfkc('canonical')}, false)")
def unresolved_patches(spark: SparkSession, d: str) -> DataFrame:
    """The proposals that the naming context does not settle."""
    return patches.unresolved(patches.with_mapping(_ledger(spark, d), _context(spark, d))).select("correction_id")


@query("SELECT DISTINCT correction_id, coalesce(seg_idx >= 0 AND seg_idx < 40, false) AS scoped, CASE WHEN coalesce(seg_idx >= 0 AND seg_idx < 40, false) THEN NULL ELSE 'out_of_batch_segment' END AS reason FROM corrections")
def scoped_patches(spark: SparkSession, d: str) -> DataFrame:
    """The proposals in and out of the first batch of 40 segments of each session."""
    return patches.scope_proposals(_ledger(spark, d), "seg_idx", F.lit(0), F.lit(40)).select("correction_id", "scoped", "reason")


@query(
    """WITH c AS (SELECT DISTINCT correction_id, from_text AS a, to_text AS b FROM corrections WHERE from_text IS NOT NULL AND to_text IS NOT NULL),
h AS (SELECT *, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, 1, i) = substr(b, 1, i))) AS s FROM c),
e AS (SELECT *, len(list_filter(range(1, least(length(a), length(b)) - s + 1), lambda i: right(a, i) = right(b, i))) AS z FROM h)
SELECT correction_id, CAST(s AS INT) AS start, CAST(length(b) - z AS INT) AS "end" FROM e"""
)
def changed_ranges(spark: SparkSession, d: str) -> DataFrame:
    """What each proposal changes in its term."""
    c = _ledger(spark, d).where("from_text is not null and to_text is not null")
    return c.select("correction_id", patches.changed_range(F.col("from_text"), F.col("to_text")).alias("r")).select("correction_id", "r.*")


# ---- evidence (L11 to L15, A8, A32, A33, J14, O7, W15) -------------------------------------

_CLAIMS = "cl AS (SELECT DISTINCT correction_id AS claim_id, recording_id, session_no, start_seconds AS t, from_text AS quote, speaker AS hint FROM corrections LEFT JOIN (SELECT segment_id, min(speaker) AS speaker FROM seg GROUP BY 1) USING (segment_id))"
_GROUNDED = f"""qs AS (SELECT claim_id, recording_id, session_no, t, quote, {q.comparable('quote')} AS qq, {q.comparable('hint')} AS hh FROM cl WHERE t >= 0),
ca AS (SELECT *, {q.clamp('start_seconds')} AS a FROM norm), cb AS (SELECT *, lead(a) OVER (PARTITION BY recording_id, session_no ORDER BY pos) AS nxt FROM ca),
cc AS (SELECT *, CASE WHEN end_seconds > a THEN end_seconds WHEN nxt > a THEN nxt ELSE a + 5 END AS e, {q.comparable('text')} AS x, {q.comparable('speaker')} AS sp FROM cb),
hi AS (SELECT claim_id, qs.recording_id, quote, qq, segment_id, pos, a, speaker, abs(a - t) AS dist, hh <> '' AND sp = hh AS mine FROM qs JOIN cc USING (recording_id, session_no) WHERE length(qq) >= 2 AND t >= a - 0.5 AND t <= e + 0.5 AND contains(x, qq)),
hj AS (SELECT *, bool_or(mine) OVER (PARTITION BY claim_id) AS any_mine FROM hi),
r AS (SELECT *, row_number() OVER w AS rn, lead(dist) OVER w AS nd FROM hj WHERE mine OR NOT any_mine WINDOW w AS (PARTITION BY claim_id ORDER BY dist, pos)),
gr AS (SELECT claim_id, recording_id, segment_id, speaker, a, qq FROM r WHERE rn = 1 AND (nd IS NULL OR abs(nd - dist) >= 1e-9))"""


def _grounded(spark: SparkSession, d: str) -> DataFrame:
    """The ledger's terms as quotes with the label of their segment as hint, and where they are said."""
    norm = timeline.normalized(read_table(spark, d, "segments"))
    hints = read_table(spark, d, "segments").groupBy("segment_id").agg(F.min("speaker").alias("speaker_hint"))
    c = _ledger(spark, d).join(hints, "segment_id", "left")
    claims = c.select(F.col("correction_id").alias("claim_id"), *SESSION, F.col("start_seconds").alias("at_seconds"), F.col("from_text").alias("quote"), "speaker_hint").dropDuplicates(["claim_id"])
    said = evidence.ground(claims, norm).join(norm.select("segment_id", "speaker", tx.seconds_or_zero(F.col("start_seconds")).alias("a")), "segment_id")
    return said.join(claims.select("claim_id", "recording_id", tx.comparable_text(F.col("quote")).alias("qq")), "claim_id")


@query(
    f"""WITH {q.NORM}, {_CLAIMS}, {_GROUNDED}, u AS (SELECT *, row_number() OVER (PARTITION BY recording_id, a, qq ORDER BY claim_id) AS k FROM gr), n AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY claim_id) AS place FROM u WHERE k = 1)
SELECT recording_id, CAST(place AS INT) AS place, claim_id, segment_id, speaker FROM n WHERE place <= 20"""
)
def verified_highlights(spark: SparkSession, d: str) -> DataFrame:
    """The quotes of a recording that are said where they claim, each once, the first 20 (the report's length is the feature)."""
    once = patches.first_use(_grounded(spark, d), ["recording_id", "a", "qq"], ["claim_id"])
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("recording_id").orderBy("claim_id"))).where("place <= 20")
    return ranked.select("recording_id", "place", "claim_id", "segment_id", "speaker")


@query(
    f"""WITH {q.NORM}, {_CLAIMS}, {_GROUNDED}, nm AS (SELECT DISTINCT correction_id AS claim_id, to_text AS name, {q.comparable('to_text')} AS ck FROM corrections WHERE {q.trim("coalesce(to_text, '')")} <> ''),
w AS (SELECT {q.comparable('canonical')} AS ck, min(eval_id) AS eval_id FROM terminology_eval GROUP BY 1),
ev AS (SELECT gr.*, ck, eval_id FROM gr JOIN nm USING (claim_id) JOIN w USING (ck)),
d1 AS (SELECT *, row_number() OVER (PARTITION BY recording_id, ck, a, qq ORDER BY claim_id) AS k FROM ev), d2 AS (SELECT *, row_number() OVER (PARTITION BY recording_id, ck ORDER BY claim_id) AS i FROM d1 WHERE k = 1),
d3 AS (SELECT *, row_number() OVER (PARTITION BY recording_id, a, qq ORDER BY eval_id) AS u FROM d2 WHERE i <= 6), e AS (SELECT recording_id, eval_id, count(*) AS n FROM d3 WHERE u = 1 GROUP BY ALL)
SELECT m.recording_id, w.eval_id, coalesce(e.n, 0) AS evidence, CASE WHEN e.n IS NULL THEN 'insufficient' ELSE 'mixed' END AS rating FROM meetings m CROSS JOIN w LEFT JOIN e ON e.recording_id = m.recording_id AND e.eval_id = w.eval_id"""
)
def interview_report(spark: SparkSession, d: str) -> DataFrame:
    """For each recording every name asked for, in order, beside its evidence: said where it claims, once a name, six a name, and counted for the first name alone."""
    said = _grounded(spark, d)
    named = _ledger(spark, d).where(tx.js_trim(F.coalesce("to_text", F.lit(""))) != "").select(F.col("correction_id").alias("claim_id"), tx.comparable_text(F.col("to_text")).alias("ck")).distinct()
    asked = read_table(spark, d, "terminology_eval").groupBy(tx.comparable_text(F.col("canonical")).alias("ck")).agg(F.min("eval_id").alias("eval_id"))
    own = patches.first_use(said.join(named, "claim_id").join(asked, "ck"), ["recording_id", "ck", "a", "qq"], ["claim_id"])
    six = own.withColumn("i_", F.row_number().over(Window.partitionBy("recording_id", "ck").orderBy("claim_id"))).where("i_ <= 6")
    counted = patches.first_use(six, ["recording_id", "a", "qq"], ["eval_id"]).groupBy("recording_id", "eval_id").agg(F.count("*").alias("n"))
    # every recording is asked for all names of the fixed list: one scalar, unfolded in the recording's own row
    wanted = asked.groupBy().agg(F.collect_set("eval_id").alias("e_")).scalar()
    rows = read_table(spark, d, "meetings").select("recording_id", F.explode(wanted).alias("eval_id"))
    j = rows.join(counted, ["recording_id", "eval_id"], "left")
    return j.select("recording_id", "eval_id", F.coalesce("n", F.lit(0)).alias("evidence"), F.when(F.col("n").isNull(), "insufficient").otherwise("mixed").alias("rating"))


def _said_by_kind(spark: SparkSession, d: str, test, kind: str, most: int) -> DataFrame:
    """The segments of a recording that pass a test of their text and are said once, numbered, the first ``most``."""
    norm = timeline.normalized(read_table(spark, d, "segments"))
    like = norm.where(test(F.col("text")))
    claims = like.select(F.col("segment_id").alias("claim_id"), *SESSION, F.col("start_seconds").alias("at_seconds"), F.col("text").alias("quote"), F.lit("").alias("speaker_hint"))
    said = evidence.ground(claims, norm).drop("pos").join(norm.select("segment_id", *SESSION, "pos", "text", tx.seconds_or_zero(F.col("start_seconds")).alias("a")), "segment_id")
    said = said.withColumn("qq", tx.comparable_text(F.col("text"))).where("char_length(qq) >= 2")
    once = patches.first_use(said, [*SESSION, "a", "qq"], ["pos", "segment_id"])
    ranked = once.withColumn("n_", F.row_number().over(Window.partitionBy("recording_id").orderBy("session_no", "pos", "segment_id"))).where(F.col("n_") <= most)
    return ranked.select("recording_id", F.concat(F.lit(f"{kind}-"), "n_").alias("id"), "segment_id", "a")


@query()
def verified_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What a recording decided: segments that read like a decision, said once, numbered; the first 30 (the report's length is the feature)."""
    return _said_by_kind(spark, d, lx.decision, "decision", 30)


@query()
def meeting_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of a recording, each entry said where it claims and numbered by kind: sixty actions, thirty decisions, twenty highlights (the ledger's size is the feature)."""
    actions = _said_by_kind(spark, d, lx.affirmative_action, "action", 60)
    highlights = verified_highlights(spark, d).select("recording_id", F.concat(F.lit("highlight-"), "place").alias("id"), "segment_id")
    return actions.drop("a").unionByName(verified_decisions(spark, d).drop("a")).unionByName(highlights)


_T = q.trim("coalesce(text, '')")
_PIECE = "substr(t, CAST(floor({at}) AS BIGINT) + 1, 240)"


@query(
    f"""WITH {q.SEG}, x AS (SELECT segment_id, {_T} AS t FROM seg), y AS (SELECT segment_id, t, CASE WHEN t = '' THEN CAST([] AS VARCHAR[]) WHEN length(t) <= 240 THEN [t] ELSE [{q.trim(_PIECE.format(at='0'))}, {q.trim(_PIECE.format(at='(length(t) - 240) / 2.0'))}, {q.trim(_PIECE.format(at='length(t) - 240'))}] END AS a FROM x),
z AS (SELECT segment_id, unnest(a) AS excerpt, unnest(range(1, len(a) + 1)) AS i FROM y), d AS (SELECT segment_id, excerpt, min(i) AS i FROM z WHERE excerpt <> '' GROUP BY ALL)
SELECT segment_id, excerpt, CAST(row_number() OVER (PARTITION BY segment_id ORDER BY i) AS INT) AS place FROM d"""
)
def transcript_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts of each segment: the whole of a short one, beginning, middle and end of a long one."""
    s = timeline.distinct_segments(read_table(spark, d, "segments"))
    return s.select("segment_id", F.posexplode(patches.excerpts(F.col("text"), 240)).alias("p_", "excerpt")).select("segment_id", "excerpt", (F.col("p_") + 1).alias("place"))


@query(
    f"""WITH RECURSIVE {q.NORM}, l0 AS (SELECT recording_id, session_no, pos, max(pos) OVER (PARTITION BY recording_id, session_no) AS last, length('[' || {q.clock('start_seconds')} || '] ' || CASE WHEN length({q.string_or('speaker', '发言人')}) > 80 THEN substr({q.string_or('speaker', '发言人')}, 1, 80) ELSE {q.string_or('speaker', '发言人')} END || '：') + 1 AS cost FROM norm),
k AS (SELECT i AS rounds, CAST(pow(2, i) AS BIGINT) AS step FROM range(0, 31) t(i)),
c AS (SELECT recording_id, session_no, rounds, sum(cost + 1) - 1 AS total, count(*) AS n FROM l0 JOIN k ON pos % step = 0 OR pos = last GROUP BY ALL),
b AS (SELECT recording_id, session_no, min(rounds) AS rounds FROM c WHERE total <= 4000 OR n <= 2 GROUP BY ALL)
SELECT recording_id, session_no, pos, CAST(b.rounds AS INT) AS rounds FROM l0 JOIN b USING (recording_id, session_no) WHERE pos % CAST(pow(2, b.rounds) AS BIGINT) = 0 OR pos = last"""
)
def summary_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each session's summary that are left when it is thinned until it can hold 4,000 characters."""
    norm = timeline.normalized(read_table(spark, d, "segments"))
    who = tx.string_or(F.col("speaker"), "发言人")
    prefix = F.concat(F.lit("["), tx.clock(F.col("start_seconds")), F.lit("] "), F.substring(who, 1, 80), F.lit("："))
    lines = norm.select(*SESSION, "pos", (F.char_length(prefix) + 1).alias("size"))
    return patches.thinned(lines, SESSION, "pos", F.col("size"), 4000).select(*SESSION, "pos", "rounds")


@query(
    f"""WITH {q.NORM}, {_CLAIMS}, {_GROUNDED}, v AS (SELECT gr.*, {q.comparable('speaker')} AS sk, quote FROM gr JOIN (SELECT DISTINCT claim_id, quote FROM cl) USING (claim_id)),
u AS (SELECT *, row_number() OVER (PARTITION BY recording_id, sk, a, qq ORDER BY claim_id) AS k FROM v), n AS (SELECT *, row_number() OVER (PARTITION BY recording_id, sk ORDER BY claim_id) AS i FROM u WHERE k = 1),
g AS (SELECT recording_id, sk, arg_min(speaker, claim_id) AS speaker, min(claim_id) AS o, count(*) AS points, string_agg({q.trim('quote')}, '；' ORDER BY i) AS joined FROM n WHERE i <= 12 GROUP BY ALL),
pl AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY o) AS place FROM g) SELECT recording_id, CAST(place AS INT) AS place, speaker, points, CASE WHEN length(joined) > 1200 THEN substr(joined, 1, 1199) || '…' ELSE joined END AS summary FROM pl WHERE place <= 30"""
)
def verified_speaker_notes(spark: SparkSession, d: str) -> DataFrame:
    """What each speaker of a recording says for certain: twelve distinct quotes a speaker, thirty speakers (the report's size is the feature)."""
    quotes = _ledger(spark, d).select(F.col("correction_id").alias("claim_id"), tx.js_trim(F.col("from_text")).alias("quote")).dropDuplicates(["claim_id"])
    said = _grounded(spark, d).join(quotes, "claim_id").withColumn("sk", tx.comparable_text(F.col("speaker")))
    own = patches.first_use(said, ["recording_id", "sk", "a", "qq"], ["claim_id"])
    twelve = own.withColumn("i_", F.row_number().over(Window.partitionBy("recording_id", "sk").orderBy("claim_id"))).where("i_ <= 12")
    groups = twelve.groupBy("recording_id", "sk").agg(
        F.min_by("speaker", "claim_id").alias("speaker"), F.min("claim_id").alias("o_"), F.count("*").alias("points"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i_", "quote"))), lambda x: x["quote"]), "；").alias("joined"),
    )
    ranked = groups.withColumn("place", F.row_number().over(Window.partitionBy("recording_id").orderBy("o_"))).where("place <= 30")
    return ranked.select("recording_id", "place", "speaker", "points", tx.truncate_text(F.col("joined"), 1200).alias("summary"))


@query("SELECT segment_id, count(*) AS accepted, string_agg(from_text || '→' || to_text, '、' ORDER BY correction_id) AS changes FROM (SELECT DISTINCT correction_id, segment_id, from_text, to_text FROM corrections WHERE status = 'applied') GROUP BY segment_id")
def corrections_by_segment(spark: SparkSession, d: str) -> DataFrame:
    """The applied corrections of each segment, in order."""
    c = _ledger(spark, d).where("status = 'applied'").select("segment_id", "correction_id", F.concat("from_text", F.lit("→"), "to_text").alias("c")).distinct()
    return c.groupBy("segment_id").agg(F.count("*").alias("accepted"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("correction_id", "c"))), lambda x: x["c"]), "、").alias("changes")).withColumn("changes", F.nullif("changes", F.lit("")))


@query("WITH a AS (SELECT DISTINCT segment_id, speaker, text FROM segments), c AS (SELECT segment_id, string_agg(from_text, ' ' ORDER BY correction_id) AS sources FROM (SELECT DISTINCT correction_id, segment_id, from_text FROM corrections WHERE from_text <> '') GROUP BY 1) SELECT segment_id, lower(coalesce(speaker, '') || ' ' || coalesce(text, '') || ' ' || coalesce(sources, '')) AS search_text FROM a LEFT JOIN c USING (segment_id)")
def search_texts(spark: SparkSession, d: str) -> DataFrame:
    """What a segment is searched by: its speaker, its text and what stood there before it was corrected."""
    a = read_table(spark, d, "segments").select("segment_id", "speaker", "text").distinct()
    c = _ledger(spark, d).where("from_text != ''").select("segment_id", "correction_id", "from_text").distinct()
    c = c.groupBy("segment_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("correction_id", "from_text"))), lambda x: x["from_text"]), " ").alias("sources"))
    none = F.lit("")
    return a.join(c, "segment_id", "left").select("segment_id", F.lower(F.concat_ws(" ", F.coalesce("speaker", none), F.coalesce("text", none), F.coalesce("sources", none))).alias("search_text"))


@query(f"SELECT DISTINCT eval_id, {q.alias_key('alias')} || '=>' || {q.trim(q.nfkc('canonical'))} AS mapping_key FROM (SELECT eval_id, canonical, unnest(aliases) AS alias FROM terminology_eval)")
def mapping_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key of every mapping of an alias."""
    t = read_table(spark, d, "terminology_eval").select("eval_id", "canonical", F.explode("aliases").alias("alias"))
    return t.select("eval_id", F.concat(tx.mapping_alias_key(F.col("alias")), F.lit("=>"), tx.spelling_key(F.col("canonical"))).alias("mapping_key")).distinct()


_PARTS = f"list_filter(list_transform(regexp_split_to_array(coalesce(summary, ''), '[、,，;；\n]+'), lambda x: {q.trim('x')}), lambda x: x <> '')"


@query(f"WITH p AS (SELECT recording_id, unnest({_PARTS}) AS name, unnest(range(1, len({_PARTS}) + 1)) AS i FROM meetings), d AS (SELECT recording_id, name, min(i) AS i FROM p GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY i) AS place FROM d) SELECT recording_id, CAST(place AS INT) AS place, name FROM n WHERE place <= 20")
def split_names(spark: SparkSession, d: str) -> DataFrame:
    """A typed list cut into its distinct names, twenty at most (the list's length is the feature)."""
    parts = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("summary", F.lit("")), r"[、,，;；\n]+"), tx.js_trim), lambda x: x != ""))
    rows = read_table(spark, d, "meetings").select("recording_id", F.posexplode(F.slice(parts, 1, 20)).alias("p_", "name"))
    return rows.select("recording_id", (F.col("p_") + 1).alias("place"), "name")


@query(f"SELECT recording_id, substr(coalesce(nullif({q.trim('m.summary')}, ''), coalesce(s.joined, '')), 1, 1200) AS review FROM meetings m LEFT JOIN (SELECT recording_id, string_agg(t, ' ' ORDER BY session_no, pos) AS joined FROM (SELECT recording_id, session_no, seg_idx AS pos, {q.trim('text')} AS t, row_number() OVER (PARTITION BY recording_id ORDER BY session_no, seg_idx, segment_id, text) AS k FROM (SELECT DISTINCT recording_id, session_no, seg_idx, segment_id, text FROM segments WHERE {q.trim('text')} <> '')) WHERE k <= 1200 GROUP BY 1) s USING (recording_id)")
def review_texts(spark: SparkSession, d: str) -> DataFrame:
    """What a review says of a recording: its summary or else its texts, 1,200 characters of it.

    Every text has a character and is followed by a space, so no more than 1,200 texts are ever joined.
    """
    s = read_table(spark, d, "segments").select("recording_id", "session_no", "seg_idx", "segment_id", "text").distinct().withColumn("t", tx.js_trim(F.col("text"))).where("t != ''")
    first = s.withColumn("k_", F.row_number().over(Window.partitionBy("recording_id").orderBy("session_no", "seg_idx", "segment_id", "text"))).where("k_ <= 1200")
    joined = first.groupBy("recording_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k_", "t"))), lambda x: x["t"]), " ").alias("joined"))
    m = read_table(spark, d, "meetings").select("recording_id", tx.js_trim(F.col("summary")).alias("direct")).join(joined, "recording_id", "left")
    return m.select("recording_id", F.substring(F.coalesce(F.nullif("direct", F.lit("")), F.col("joined"), F.lit("")), 1, 1200).alias("review"))


@query()
def contextual_signals(spark: SparkSession, d: str) -> DataFrame:
    """Terms of mixed script beside groups of surface variants."""
    return terms.contextual_signals(timeline.normalized(read_table(spark, d, "segments")))


# ---- records (S12, S15, K16, K20, U4) ------------------------------------------------------


@query("SELECT recording_id, title, status, duration_seconds FROM meetings WHERE recording_id = 'rec-hot-0001'")
def one_record(spark: SparkSession, d: str) -> DataFrame:
    """One recording by its id; the filter reaches the scan."""
    return read_table(spark, d, "meetings").where("recording_id = 'rec-hot-0001'").select("recording_id", "title", "status", "duration_seconds")


@query("SELECT segment_id, coalesce(epoch_us(max(ingested_at)), -1) AS ingested_us, count(*) AS copies FROM segments GROUP BY segment_id")
def latest_copies(spark: SparkSession, d: str) -> DataFrame:
    """The latest copy of every stored segment, and how many there are."""
    return read_table(spark, d, "segments").groupBy("segment_id").agg(F.coalesce(F.unix_micros(F.max("ingested_at")), F.lit(-1)).alias("ingested_us"), F.count("*").alias("copies"))


@query("WITH l AS (SELECT recording_id, row_number() OVER (ORDER BY created_at DESC, recording_id) AS r FROM meetings WHERE recording_id NOT IN (SELECT recording_id FROM tombstones)) SELECT recording_id, 'deleted' AS state FROM l WHERE r > 40 UNION SELECT recording_id, state FROM tombstones")
def evicted_records(spark: SparkSession, d: str) -> DataFrame:
    """The tombstones after a list of the newest 40 records (the list's length is the feature) is saved: those there, and the records that no longer fit."""
    stones = read_table(spark, d, "tombstones").select("recording_id", "state")
    live = read_table(spark, d, "meetings").join(stones, "recording_id", "left_anti").select("recording_id", "created_at")
    kept = live.orderBy(F.desc("created_at"), "recording_id").limit(40).select("recording_id")
    return live.join(kept, "recording_id", "left_anti").select("recording_id", F.lit("deleted").alias("state")).unionByName(stones).distinct()


_ROW = "md5(concat_ws('|', CAST(segment_id AS VARCHAR), coalesce(CAST(CAST(floor(start_seconds * 1000 + 0.5) AS BIGINT) AS VARCHAR), '-'), coalesce(CAST(CAST(floor(end_seconds * 1000 + 0.5) AS BIGINT) AS VARCHAR), '-'), coalesce(speaker, '-'), coalesce(text, '-'), CASE WHEN join_next THEN '1' ELSE '0' END))"


@query(
    f"""WITH f AS (SELECT *, {_ROW} AS h FROM (SELECT DISTINCT segment_id, recording_id, session_no, start_seconds, end_seconds, speaker, text, join_next FROM segments)), g AS (SELECT *, {_ROW} AS h FROM (SELECT DISTINCT segment_id, recording_id, session_no, start_seconds, end_seconds, speaker, text, join_next FROM segments WHERE ingested_at IS NOT NULL)),
a AS (SELECT recording_id, session_no, segment_id // 1000 AS part, md5(string_agg(h, '' ORDER BY segment_id, h)) AS p FROM f GROUP BY ALL), b AS (SELECT recording_id, session_no, segment_id // 1000 AS part, md5(string_agg(h, '' ORDER BY segment_id, h)) AS p FROM g GROUP BY ALL),
x AS (SELECT recording_id, session_no, md5(string_agg(p, '' ORDER BY part)) AS s FROM a GROUP BY ALL), y AS (SELECT recording_id, session_no, md5(string_agg(p, '' ORDER BY part)) AS s FROM b GROUP BY ALL)
SELECT recording_id, session_no, x.s AS signature, coalesce(x.s = y.s, false) AS commits FROM x LEFT JOIN y USING (recording_id, session_no)"""
)
def signature_guard(spark: SparkSession, d: str) -> DataFrame:
    """U4: whether a result derived from the timed deliveries of a session may be committed: the content's signature is still the same.

    A signature is that of the signatures of parts of a thousand ids, so no row holds a whole hot session.
    """
    ms = lambda c: F.coalesce(F.floor(F.col(c) * 1000 + 0.5).cast("bigint").cast("string"), F.lit("-"))
    h = F.md5(F.concat_ws("|", F.col("segment_id").cast("string"), ms("start_seconds"), ms("end_seconds"), F.coalesce("speaker", F.lit("-")), F.coalesce("text", F.lit("-")), F.when(F.col("join_next"), "1").otherwise("0")))

    def signed(rows: DataFrame, name: str) -> DataFrame:
        one = rows.select("segment_id", *SESSION, "start_seconds", "end_seconds", "speaker", "text", "join_next").distinct().select("segment_id", *SESSION, h.alias("h"))
        in_order = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), "")
        parts = one.groupBy(*SESSION, F.floor(F.col("segment_id") / 1000).alias("part")).agg(F.md5(in_order("segment_id", "h")).alias("p"))
        return parts.groupBy(*SESSION).agg(F.md5(in_order("part", "p")).alias(name))

    s = read_table(spark, d, "segments")
    j = signed(s, "signature").join(signed(s.where("ingested_at is not null"), "then_"), SESSION, "left")
    return j.select(*SESSION, "signature", F.coalesce(F.col("signature") == F.col("then_"), F.lit(False)).alias("commits"))


# ---- admission (A38, C61, S25, S26) --------------------------------------------------------


@query(
    """SELECT event_id, CASE WHEN len(reason_codes) = 0 OR reason_codes[1] = 'empty_transcript' THEN 'passed' ELSE 'rejected' END AS verdict, CASE WHEN len(reason_codes) > 0 AND reason_codes[1] <> 'empty_transcript' THEN 0.0 END AS start_seconds,
CASE WHEN len(reason_codes) > 0 AND reason_codes[1] <> 'empty_transcript' THEN CASE WHEN duration_seconds > 0 THEN duration_seconds ELSE 0.0 END END AS duration_seconds FROM quality_events"""
)
def whole_file_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whole files are refused for every first reason but an empty transcript; a refusal is an event of the whole length."""
    first = F.try_element_at("reason_codes", F.lit(1))
    refused = F.coalesce(first != "empty_transcript", F.lit(False))
    n = F.col("duration_seconds")
    return read_table(spark, d, "quality_events").select(
        "event_id", F.when(refused, "rejected").otherwise("passed").alias("verdict"), F.when(refused, F.lit(0.0)).alias("start_seconds"), F.when(refused, F.when(n > 0, n).otherwise(0.0)).alias("duration_seconds")
    )


#: The most seconds and bytes of a streamed upload, and of the fallback to one whole file.
MOST_SECONDS, MOST_BYTES = 4 * 3600, 512 << 20
FALLBACK_SECONDS, FALLBACK_BYTES = 30 * 60, 40 << 20


@query(
    f"""WITH p AS (SELECT unnest(['streamed', 'standard']) AS protocol), m AS (SELECT recording_id, protocol, CASE WHEN duration_seconds > 0 THEN duration_seconds END AS s, 44 + CAST(floor(coalesce(CASE WHEN duration_seconds > 0 THEN duration_seconds END, 0) * 16000) AS BIGINT) * 2 AS bytes FROM meetings CROSS JOIN p)
SELECT recording_id, protocol, bytes, CASE WHEN protocol = 'standard' THEN '' WHEN s > {MOST_SECONDS} THEN 'too_long' WHEN bytes > {MOST_BYTES} THEN 'too_large' ELSE '' END AS refusal, coalesce(bytes <= {FALLBACK_BYTES} AND s <= {FALLBACK_SECONDS}, false) AS fallback FROM m"""
)
def upload_admission(spark: SparkSession, d: str) -> DataFrame:
    """Whether a recording, as 16 kHz mono sound, may be uploaded by either protocol, and sent whole instead."""
    n = F.col("duration_seconds")
    m = read_table(spark, d, "meetings").select("recording_id", F.explode(F.array(F.lit("streamed"), F.lit("standard"))).alias("protocol"), F.when(n > 0, n).alias("s"))
    m = m.withColumn("bytes", F.lit(44) + F.floor(F.coalesce("s", F.lit(0.0)) * 16000).cast("bigint") * 2)
    refusal = F.when(F.col("protocol") == "standard", "").when(F.col("s") > MOST_SECONDS, "too_long").when(F.col("bytes") > MOST_BYTES, "too_large").otherwise("")
    return m.select("recording_id", "protocol", "bytes", refusal.alias("refusal"), F.coalesce((F.col("bytes") <= FALLBACK_BYTES) & (F.col("s") <= FALLBACK_SECONDS), F.lit(False)).alias("fallback"))


@query("SELECT recording_id, CASE WHEN meeting_mode IN ('meeting', 'interview') THEN meeting_mode ELSE 'meeting' END AS mode, CASE WHEN status IN ('done', 'error') THEN status ELSE 'error' END AS status FROM meetings")
def meeting_enums(spark: SparkSession, d: str) -> DataFrame:
    """Values outside their list become the list's default."""
    known = lambda c, values, default: F.when(F.col(c).isin(values), F.col(c)).otherwise(default)
    return read_table(spark, d, "meetings").select("recording_id", known("meeting_mode", ["meeting", "interview"], "meeting").alias("mode"), known("status", ["done", "error"], "error").alias("status"))
