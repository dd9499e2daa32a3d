"""Transcript segments into clean, ordered speaker turns.

Labels are read from ``speaker``, or else from the head of ``text``.  Segments
with neither get theirs from a hidden Markov model of the session: states are
its participants, emissions their language profiles (smoothed shares of hashed
words and ideographs over their labelled segments), transitions the counted
changes of speaker.  Timestamps, labels, hesitation sounds and sound annotations
are taken out of the text.

A session may be as hot as it likes: it is cut into blocks of ``2**BLOCK_BITS``
milliseconds (segments without a start: of ``2**NULL_BITS`` numbers).  Runs
inside a block are final; only the first and the last run of each block are
joined across the blocks of a session.  The model decodes the session as a whole:
each block gives its best scores from every state before it to every state at its
end, these small matrices are linked along the session, and each block is then
decoded between the states so found.

Defined results: a redelivered segment counts once; ties in start and ``seg_idx``
are ordered by ``segment_id``; segments with a NULL, blank or wholly removed text
belong to no turn and end none; a NULL start sorts first; a session without any
label has one participant, ``NULL``; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.llm.forms import canonical_form
from turnmill.operators.intervals import to_millis
from turnmill.runtime import cut

BLOCK_BITS = 22
NULL_BITS = 12
BUCKETS = 256
SESSION = ["recording_id", "session_no"]
ORDER = ["start_ms", "seg_idx", "segment_id"]

# The words for numbers that labels use.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12,
    "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "十一": 11, "十二": 12,
    "两": 2, "壹": 1, "贰": 2, "叁": 3,
    "один": 1, "два": 2, "три": 3, "четыре": 4, "пять": 5, "шесть": 6,
}

_WORDS = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
_NUMBER = rf"(?:\p{{Nd}}{{1,4}}|(?:{_WORDS})(?![\p{{L}}]))"
_NAME = r"(?:发言[人者]|發言[人者]|说话[人者]|說話[人者]|讲话人|與會者|与会者|speaker|spkr|spk|talker|говорящий|спикер|s)"
#: A label: its word, then its number in the one group.
LABEL = rf"(?iu)^[\s\[(（【<]*{_NAME}[\s_#＃.:：\-‐‑]*0*({_NUMBER})"
STAMP = r"[\[(（【<]?\p{Nd}{1,3}(?:[:：]\p{Nd}{2}){1,2}(?:[.,]\p{Nd}{1,3})?[\])）】>]?(?:\s*-{1,2}>)?"
_HEAD = rf"^(?:\s*{STAMP})*+\s*"
HEAD_LABEL = rf"(?iu){_HEAD}[\[(（【]?{_NAME}[\s_#＃\-‐‑]*0*({_NUMBER})[\])）】]?\s*[:：>]"
HESITATION = r"(?:u+h*m+|u+h+|e+r+m*|e+h+|h+m+|m+h*m+|m{2,}|a+h+|o+h+|э+м*|嗯+|呃+|额+|啊+|哦+|唔+|噢+|诶+|欸+)"
# a bracketed note, unless it is a placeholder such as [EMAIL] or a number
ANNOTATION = (
    r"\[\s*(?!(?:EMAIL|PHONE|ID|ID_NUMBER|ADDRESS|NAME|PERSON|PERSON_NAME|URL)\s*\])[^\[\]\p{Nd}]{1,40}\]"
    r"|【[^【】\p{Nd}]{1,40}】|（[^（）\p{Nd}]{1,30}）|\([^()\p{Nd}]{1,40}\)|<[a-zA-Z][a-zA-Z _\-]{1,30}>|\*[\p{L} ]{1,30}\*|[♪♫][^♪♫\n]{0,60}[♪♫]|[♪♫]"
)
_PAUSE = r"[\s,，、.。…;；!！?？~—\-]"


def label_number(number: Column) -> Column:
    """The number a label states, in digits of any script or in words."""
    digits = F.translate(number, "０１２３４５６７８９", "0123456789")
    table = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    return F.coalesce(digits.try_cast("int"), table[F.lower(number)])


def _group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def bare(text: Column) -> Column:
    """The text without leading label, timestamps and sound annotations."""
    t = F.regexp_replace(text, HEAD_LABEL, " ")
    t = F.regexp_replace(t, rf"(?u){STAMP}", " ")
    return F.regexp_replace(t, ANNOTATION, " ")


def speech(bared: Column) -> Column:
    """What is left after hesitation sounds are taken out too, in plain spacing."""
    t = F.regexp_replace(bared, rf"(?iu)(?<![\p{{L}}\p{{Nd}}']){HESITATION}(?![\p{{L}}\p{{Nd}}']){_PAUSE}*", "")
    t = F.regexp_replace(t, r"(?u)\s+", " ")
    return F.trim(F.regexp_replace(t, r"^[\s,，、.。…;；]+", ""))


def is_speech(bared: Column) -> Column:
    """Whether anything is left but hesitation sounds and punctuation."""
    return ~bared.rlike(rf"(?iu)^(?:[\s\p{{P}}\p{{Sm}}\p{{Sk}}\p{{Sc}}]++|{HESITATION}(?![\p{{L}}&&[^嗯呃额啊哦唔噢诶欸]]))*+$")


def labelled(segments: DataFrame, with_text: bool = False) -> DataFrame:
    """Each distinct segment with ``speaker_no`` (NULL where no label stands anywhere), its block and whether it speaks."""
    text = canonical_form(F.coalesce(F.col("text"), F.lit("")))
    t = segments.select("recording_id", "session_no", "segment_id", "seg_idx", "start_seconds", "speaker", text.alias("text"))
    # the regular expressions run once a row: what follows is used in several places
    t = t.withColumn("bare_", bare(F.col("text")))
    told = F.coalesce(_group(F.col("speaker"), LABEL), _group(F.col("text"), HEAD_LABEL))
    start = to_millis(F.col("start_seconds"))
    cols = [
        "recording_id",
        "session_no",
        "segment_id",
        "seg_idx",
        start.alias("start_ms"),
        F.coalesce(F.shiftright(start, BLOCK_BITS), F.lit(-(2**62)) + F.shiftright(F.coalesce("seg_idx", F.lit(-(2**31))), NULL_BITS)).alias("block"),
        label_number(told).alias("speaker_no"),
        is_speech(F.col("bare_")).alias("speaks"),
    ]
    if with_text:
        cols.append(speech(F.col("bare_")).alias("clean"))
    keys = ["recording_id", "session_no", "block"]
    return t.select(*cols).repartition(*keys).dropDuplicates([*keys, "segment_id"])


def viterbi(emission: np.ndarray, transition: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """The likeliest states (log scores; ``fixed[i] >= 0`` forces a state; ties take the lower state)."""
    n, k = emission.shape
    score = np.where((fixed[:, None] < 0) | (fixed[:, None] == np.arange(k)), emission, -np.inf)
    back = np.zeros((n, k), int)
    best = score[0]
    for i in range(1, n):
        through = best[:, None] + transition
        back[i] = through.argmax(0)
        best = through.max(0) + score[i]
    path = np.zeros(n, int)
    path[-1] = int(best.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


class Model:
    """The hidden Markov model of a session from its counts ``(kind, a, b, n)``: speakers ("s"), their words ("w") and their changes ("c")."""

    def __init__(self, counts: list):
        rows = [(c["kind"], c["a"], c["b"], c["n"]) for c in counts] if counts is not None else []
        self.speakers = sorted({a for kind, a, _, _ in rows if kind == "s"})
        self.at = {s: i for i, s in enumerate(self.speakers)}
        profile = np.full((len(self.speakers), BUCKETS), 0.1)
        change = np.full((len(self.speakers), len(self.speakers)), 0.5)
        for kind, a, b, n in rows:
            if kind == "w":
                profile[self.at[a], b] += n
            elif kind == "c":
                change[self.at[a], self.at[b]] += n
        self.profile = np.log(profile / profile.sum(1, keepdims=True))
        self.change = np.log(change / change.sum(1, keepdims=True))

    def scores(self, block: pd.DataFrame) -> np.ndarray:
        """Log scores of the states of each segment; a stated speaker leaves no other state."""
        words = np.zeros((len(block), BUCKETS))
        for i, row in enumerate(block["words"]):
            if row is not None and len(row):
                np.add.at(words[i], np.asarray(row, int), 1)
        fixed = np.array([self.at.get(int(s), -1) if pd.notna(s) else -1 for s in block["speaker_no"]])
        return np.where((fixed[:, None] < 0) | (fixed[:, None] == np.arange(len(self.speakers))), words @ self.profile.T, -np.inf)


def _in_order(block: pd.DataFrame) -> pd.DataFrame:
    return block.sort_values(ORDER, na_position="first").reset_index(drop=True)


def transfer(block: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """The best scores of a block, from each state before it (the last row: from none) to each state at its end."""
    out = block[[*SESSION, "block"]].head(1).copy()
    m = Model(model["m"].iloc[0] if len(model) else None)
    k = len(m.speakers)
    best = np.zeros((0, 0))
    if k:
        scores = m.scores(_in_order(block))
        best = np.vstack([m.change, np.zeros((1, k))]) + scores[0]
        for row in scores[1:]:
            best = (best[:, :, None] + m.change).max(1) + row
    out["size"] = k
    out["best"] = [best.ravel().tolist()] * len(out)
    return out


def link(blocks: pd.DataFrame) -> pd.DataFrame:
    """The states at the end of each block of a session on its likeliest path, and those before it (-1: none)."""
    blocks = blocks.sort_values("block").reset_index(drop=True)
    out = blocks[[*SESSION, "block"]].copy()
    k = int(blocks["size"].iloc[0])
    before = np.full(len(blocks), -1)
    after = np.full(len(blocks), -1)
    if k:
        tables = [np.asarray(b, float).reshape(k + 1, k) for b in blocks["best"]]
        score, back = tables[0][k], []
        for table in tables[1:]:
            through = score[:, None] + table[:k]
            back.append(through.argmax(0))
            score = through.max(0)
        after[-1] = int(score.argmax())
        for i in range(len(blocks) - 1, 0, -1):
            before[i] = after[i - 1] = back[i - 1][after[i]]
    out["before"], out["after"] = before, after
    return out


def decode(block: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """The speaker numbers of a block's segments between the states that its session's path has around it."""
    block = _in_order(block)
    out = block[["segment_id"]].copy()
    m = Model(model["m"].iloc[0] if len(model) else None)
    if not m.speakers:
        out["guess"] = pd.Series([None] * len(block), dtype="Int32")
        return out
    scores = m.scores(block)
    before, after = int(model["before"].iloc[0]), int(model["after"].iloc[0])
    if before >= 0:
        scores[0] = scores[0] + m.change[before]
    fixed = np.full(len(block), -1)
    fixed[-1] = after
    out["guess"] = pd.array([m.speakers[p] for p in viterbi(scores, m.change, fixed)], dtype="Int32")
    return out


def _inferred(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """``segment_id`` and ``guess``, the inferred speaker, of the segments of every session in which a label is missing."""
    lost = rows.where(F.col("speaker_no").isNull() & F.col("speaks")).select(*SESSION).distinct()
    mine = rows.alias("r").join(lost.alias("l"), F.expr("r.recording_id <=> l.recording_id AND r.session_no <=> l.session_no"), "left_semi").select("r.*")
    words = F.expr(
        "transform(regexp_extract_all(lower(bare_), '(?u)[\\\\p{L}&&[^\\\\p{IsHan}]]+|\\\\p{IsHan}', 0),"
        f" w -> cast(pmod(hash(w), {BUCKETS}) as int))"
    )
    spoken = segments.select("segment_id", bare(canonical_form(F.coalesce(F.col("text"), F.lit("")))).alias("bare_")).select("segment_id", words.alias("words")).dropDuplicates(["segment_id"])
    data = mine.select(*SESSION, "block", *ORDER, "speaker_no").join(spoken, "segment_id").select(*SESSION, "block", *ORDER, "speaker_no", "words")
    one, told = F.lit(1).cast("bigint"), data.where("speaker_no is not null")
    earlier = F.lag("speaker_no").over(Window.partitionBy(*SESSION, "block").orderBy(*ORDER))
    counts = (
        told.select(*SESSION, F.lit("s").alias("kind"), F.col("speaker_no").alias("a"), F.lit(0).alias("b"))
        .unionByName(told.select(*SESSION, F.lit("w").alias("kind"), F.col("speaker_no").alias("a"), F.explode("words").alias("b")))
        .unionByName(told.select(*SESSION, F.lit("c").alias("kind"), earlier.alias("a"), F.col("speaker_no").alias("b")).where("a is not null"))
        .groupBy(*SESSION, "kind", "a", "b")
        .agg(F.sum(one).alias("n"))
        .groupBy(*SESSION)
        .agg(F.collect_list(F.struct("kind", "a", "b", "n")).alias("m"))  # at most participants x (256 words + participants)
    )
    # other names, so that the two sides of a cogroup are told apart
    block, other = [*SESSION, "block"], ["r_", "s_", "b_"]
    of_session = F.expr("r_ <=> recording_id AND s_ <=> session_no")
    models = data.select(*[F.col(c).alias(o) for c, o in zip(block, other)]).distinct().join(counts, of_session, "left").select(*other, "m")
    keys = "recording_id string, session_no int, block bigint"
    tables = data.groupBy(*block).cogroup(models.groupBy(*other)).applyInPandas(transfer, f"{keys}, size int, best array<double>")
    states = tables.groupBy(*SESSION).applyInPandas(link, f"{keys}, before int, after int")
    linked = models.join(states, of_session & F.expr("b_ = block")).select(*other, "m", "before", "after")
    return data.groupBy(*block).cogroup(linked.groupBy(*other)).applyInPandas(decode, "segment_id bigint, guess int")


def with_speakers(segments: DataFrame, with_text: bool = False) -> DataFrame:
    """Speaking segments, each with its speaker."""
    rows = cut(labelled(segments, with_text))
    if rows.where("speaks and speaker_no is null").isEmpty():
        return rows.where("speaks")
    told = rows.where("speaks and speaker_no is not null")
    lost = rows.where("speaks and speaker_no is null")
    guessed = lost.drop("speaker_no").join(_inferred(rows, segments), "segment_id", "left").withColumnRenamed("guess", "speaker_no")
    return told.unionByName(guessed)


def withheld_labels(segments: DataFrame, every: int = 5) -> DataFrame:
    """``(segment_id, stated, inferred)`` of a share of the segments, whose labels are withheld and then inferred: how good the model is.

    All segments are read; every ``every``-th label, by hash of ``segment_id``, is taken out of ``speaker`` and ``text``.
    """
    stated = labelled(segments).where("speaker_no is not null and speaks").select("segment_id", F.col("speaker_no").alias("stated"))
    hidden = F.pmod(F.xxhash64("segment_id"), F.lit(every)) == 0
    text = canonical_form(F.coalesce(F.col("text"), F.lit("")))
    rest = segments.withColumn("text", F.when(hidden, F.regexp_replace(text, HEAD_LABEL, "")).otherwise(F.col("text")))
    rest = rest.withColumn("speaker", F.when(~hidden, F.col("speaker")))
    found = with_speakers(rest).select("segment_id", F.col("speaker_no").alias("inferred"))
    return stated.where(hidden).dropDuplicates(["segment_id"]).join(found, "segment_id", "left").select("segment_id", "stated", "inferred")


def turn_parts(rows: DataFrame) -> DataFrame:
    """Runs of one speaker within a block, numbered in ``run_``; ``runs_`` is how many the block has."""
    session, block = ["recording_id", "session_no"], ["recording_id", "session_no", "block"]
    order = ["start_ms", "seg_idx", "segment_id"]
    w = Window.partitionBy(*block).orderBy(*order)
    same = F.col("speaker_no").eqNullSafe(F.lag("speaker_no").over(w)) & (F.row_number().over(w) > 1)
    texts = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "clean"))), lambda x: x["clean"]), " ").alias("text")] if "clean" in rows.columns else []
    runs = (
        rows.withColumn("new_", (~same).cast("int"))
        .withColumn("run_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*block, "run_")
        .agg(
            F.first("speaker_no").alias("speaker_no"),
            F.min_by("segment_id", F.struct(*order)).alias("first_segment_id"),
            F.max_by("segment_id", F.struct(*order)).alias("last_segment_id"),
            *texts,
        )
    )
    return runs.withColumn("runs_", F.max("run_").over(Window.partitionBy(*block)))


def joined_turns(runs: DataFrame) -> DataFrame:
    """The turns that runs make up: the first and the last run of each block joined across the blocks of a session.

    ``block`` and ``run_`` are those of a turn's first part, so they order the turns of a session.
    """
    session = ["recording_id", "session_no"]
    texts = ["text"] if "text" in runs.columns else []
    out = [*session, "block", "run_", "speaker_no", "first_segment_id", "last_segment_id", *texts]
    inner = runs.where("run_ > 1 and run_ < runs_").select(*out)
    # the first and the last run of each block: a stretch of equal speakers is one turn,
    # unless other runs of the same block lie between
    w = Window.partitionBy(*session).orderBy("block", "run_")
    ends = runs.where("run_ = 1 or run_ = runs_")
    joins = F.col("speaker_no").eqNullSafe(F.lag("speaker_no").over(w)) & (F.lag("block").over(w) != F.col("block"))
    at = F.struct("block", "run_")
    joined = (
        ends.withColumn("new_", F.when(joins, 0).otherwise(1))
        .withColumn("turn_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*session, "turn_")
        .agg(
            F.min(at).alias("at_"),
            F.first("speaker_no").alias("speaker_no"),
            F.min_by("first_segment_id", at).alias("first_segment_id"),
            F.max_by("last_segment_id", at).alias("last_segment_id"),
            *[F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "run_", "text"))), lambda x: x["text"]), " ").alias(t) for t in texts],
        )
        .select(*[F.col(f"at_.{c}").alias(c) if c in ("block", "run_") else c for c in out])
    )
    return inner.unionByName(joined)


def speaker_turns(segments: DataFrame) -> DataFrame:
    """``(recording_id, session_no, speaker_no, first_segment_id, last_segment_id)`` of every turn."""
    return joined_turns(turn_parts(with_speakers(segments))).select("recording_id", "session_no", "speaker_no", "first_segment_id", "last_segment_id")


def clean_turn_parts(segments: DataFrame) -> DataFrame:
    """Clean text of the turns, one row for each whole turn, in order of ``(block, part_no)``: where its first part stands."""
    return joined_turns(turn_parts(with_speakers(segments, with_text=True))).select(
        "recording_id", "session_no", "block", F.col("run_").alias("part_no"), "speaker_no", "first_segment_id", "last_segment_id", "text"
    )
