from itertools import product

import numpy as np
import pytest

from turnmill.llm import pii_samples
from turnmill.llm.field import Batch, Field
from turnmill.llm.pii import KINDS, LABELS, find, find_all, found_kinds, lexicon, plain_with_offsets, redact, redacted, trained
from turnmill.llm.queries import p4_redacted


@pytest.fixture(scope="module")
def field():
    return trained()


def test_templates_that_training_never_saw(field):
    right = {k: [0, 0, 0] for k in KINDS}
    texts = pii_samples.sentences(1500, 4321, held_out=True)
    for (_, spans), got in zip(texts, find_all([t for t, _ in texts], field)):
        want, got = {k for *_, k in spans}, {k for *_, k in got}
        for k in KINDS:
            right[k][0] += k in want and k in got
            right[k][1] += k in want and k not in got
            right[k][2] += k not in want and k in got
    for k, (hit, missed, wrong) in right.items():
        assert hit / (hit + missed) >= 0.9 and hit / (hit + wrong) > 0.95, (k, right[k])


def test_placeholders_leave_the_rest_alone(field):
    text, kinds = redact("Please ask Ottoline Marsh first, call me on +1 202 555 0143. Ticket INC-10293-2231 stays.", field)
    assert text == "Please ask [PERSON_NAME] first, call me on [PHONE]. Ticket INC-10293-2231 stays." and kinds == ["person_name", "phone"]
    text, kinds = redact("我的邮箱是 ab.c@example.org，打​1900000​0123找我。地址 10.0.3.4", field)
    assert text == "我的邮箱是 [EMAIL]，打​[PHONE]找我。地址 10.0.3.4" and kinds == ["email", "phone"]
    for same in [None, "", "the address was already replaced by [EMAIL]", "we counted 9,980,269 frames on Tuesday", "如果解码器失败，就检查路线图"]:
        assert redact(same, field) == (same, [])


def test_names_that_are_words_too(spark, field):
    named = {"Please ask Mark first, then deploy.": "Mark", "Please ask Will about the cache.": "Will", "Mark said the queue is late.": "Mark", "Thanks to Mark for the notes.": "Mark"}
    for text, name in named.items():
        assert redact(text, field) == (text.replace(name, "[PERSON_NAME]"), ["person_name"])
    plain = ["Mark the ticket as done.", "Mark the chunk as unlabelled like and give it a grace period.", "Will you send it?", "May we begin?", "It is due in May."]
    for text in plain:
        assert redact(text, field) == (text, [])
    df = spark.createDataFrame(list(enumerate([*named, *plain])), "segment_id bigint, text string")
    assert {r.row_key for r in found_kinds(df, df.selectExpr("cast(segment_id as string) as recording_id", "text as summary").limit(0)).collect()} == {str(i) for i in range(len(named))}


def test_offsets_lead_back():
    plain, at = plain_with_offsets("ａ​Ｂ ﬁ中")
    assert plain == "aB fi中" and [("ａ​Ｂ ﬁ中")[i] for i in at[:-1]] == ["ａ", "Ｂ", " ", "ﬁ", "ﬁ", "中"]


def test_message_passing_is_exact_on_small_fields():
    rng = np.random.default_rng(3)
    k, none = len(LABELS), (np.zeros(0, int),) * 3
    for _ in range(20):
        f = Field(np.zeros(0, np.uint64), np.zeros((0, k)), rng.normal(size=(k, k)), np.zeros((3, k)))
        e = rng.normal(size=(10, k)).astype(np.float32)
        e[:, 0] += 0.7
        row = np.array([0, 0, 0, 0, 0, 1, 2, 2, 2, 2])
        want = []
        for lo, hi in ((0, 5), (5, 6), (6, 10)):
            want += max(product(range(k), repeat=hi - lo), key=lambda p: sum(e[lo + i, x] for i, x in enumerate(p)) + sum(f.transition[a, b] for a, b in zip(p, p[1:])))
        # passing tokens over that are surely none changes nothing
        assert f.decode(row, e, none).tolist() == f.decode(row, e, none, every=True).tolist() == want
    # a skip edge makes a doubtful repetition agree with a sure one, by the weight of its kind and label
    skip = np.zeros((3, k))
    skip[0, 5] = 3.0
    f = Field(np.zeros(0, np.uint64), np.zeros((0, k)), np.zeros((k, k)), skip)
    e = np.zeros((4, k), np.float32)
    e[0, 5], e[3, 0], e[3, 5], e[1, 0], e[2, 0] = 6.0, 1.0, 0.5, 4.0, 4.0
    row, at = np.zeros(4, int), lambda kind: (np.array([0]), np.array([3]), np.array([kind]))
    assert f.decode(row, e, none)[3] == 0 and f.decode(row, e, at(0))[3] == 5 and f.decode(row, e, at(1))[3] == 0


def test_loopy_fields_against_enumeration():
    rng = np.random.default_rng(5)
    same = 0
    for _ in range(40):
        skip = np.zeros((3, 3))
        skip[0, 1:] = rng.uniform(0, 2, 2)
        f = Field(np.zeros(0, np.uint64), np.zeros((0, 3)), rng.normal(size=(3, 3)) * 0.5, skip)
        e = rng.normal(size=(6, 3)).astype(np.float32) * 2
        edges = (np.array([0, 1]), np.array([3, 5]), np.array([0, 0]))
        score = lambda p: sum(e[i, x] for i, x in enumerate(p)) + sum(f.transition[a, b] for a, b in zip(p, p[1:])) + sum(skip[0, p[a]] for a, b in zip(*edges[:2]) if p[a] == p[b])
        best = max(product(range(3), repeat=6), key=score)
        got = f.decode(np.zeros(6, int), e, edges)
        same += tuple(got) == best
        assert got.tolist() == f.decode(np.zeros(6, int), e, edges, every=True).tolist() or score(got) >= score(f.decode(np.zeros(6, int), e, edges, every=True))
    assert same >= 36  # loopy inference is nearly always right, not always


def test_skip_weights_are_learned_and_tie_mentions(field):
    assert field.skip[0, LABELS.index("person_name")] > 0 and (field.skip[:, 0] == 0).all()
    batch = Batch(["Ask Quillon Marwick now. Then Marwick's note, marwick, 190000055512 and 190000055512; 欧阳青 and 欧阳青", "The Marwick"], lexicon())
    words = [batch.texts[batch.row[i]][batch.start[i] - batch.text_start[batch.row[i]] : batch.end[i] - batch.text_start[batch.row[i]]] for i in range(len(batch))]
    ties = {(words[a], words[b], kind) for a, b, kind in zip(*batch.edges())}
    assert ties == {("Marwick", "Marwick's", 1), ("190000055512", "190000055512", 0), ("欧", "欧", 2), ("阳", "阳", 2)}


def test_batches_give_what_single_texts_give(field):
    texts = [t for t, _ in pii_samples.sentences(120, 77)] + [None, "", "x" * 5000, "call me on (202) 555-0143", "call me on (202) 555-0143"]
    assert find_all(texts, field) == [find(t, field) for t in texts]


def test_tables(spark, field):
    seg = spark.createDataFrame([(1, "mail a@example.org or b@example.com", "c"), (1, "mail a@example.org or b@example.com", "c"), (2, None, "c"), (3, "", "c"), (4, "x " * 40_000 + "call me on (202) 555-0143", "c")], "segment_id bigint, text string, kinds string")
    meet = spark.createDataFrame([("r1", "他现在住在澄江市鹿鸣区听雨巷27号。"), ("r2", None), ("r3", "")], "recording_id string, summary string")
    got = [tuple(r) for r in found_kinds(seg, meet).collect()]
    assert sorted(got) == [("meetings.summary", "r1", "address"), ("segments.text", "1", "email"), ("segments.text", "4", "phone")]
    out = {r.row_key: (r.text, r.kinds) for r in redacted(meet, "recording_id", "summary", "s").collect()}
    assert out == {"r1": ("他现在住在[ADDRESS]。", ["address"]), "r2": (None, []), "r3": ("", [])}
    assert found_kinds(seg.limit(0), meet.limit(0)).count() == 0


def test_query_redacts_segments_and_summaries(spark, tmp_path):
    texts = [(1, "mail a@example.org now", 0), (1, "mail a@example.org now", 1), (2, None, 0), (3, "", 0), (4, "x " * 40_000 + "call me on (202) 555-0143", 0), (5, "nothing here", 0), (6, "他现在住在澄江市鹿鸣区听雨巷27号。", 0)]
    spark.createDataFrame(texts, "segment_id bigint, text string, ingested_at int").write.parquet(f"{tmp_path}/segments.parquet")
    spark.createDataFrame([("1", "write to b@example.org"), ("r2", None)], "recording_id string, summary string").write.parquet(f"{tmp_path}/meetings.parquet")
    got = sorted(((r.field, r.row_key, r.text, r.kinds) for r in p4_redacted(spark, str(tmp_path)).collect()), key=lambda x: x[:2])
    assert got == [
        ("meetings.summary", "1", "write to [EMAIL]", ["email"]), ("meetings.summary", "r2", None, []), ("segments.text", "1", "mail [EMAIL] now", ["email"]), ("segments.text", "2", None, []),
        ("segments.text", "3", "", []), ("segments.text", "4", "x " * 40_000 + "call me on [PHONE]", ["phone"]), ("segments.text", "5", "nothing here", []), ("segments.text", "6", "他现在住在[ADDRESS]。", ["address"]),
    ]
