import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from turnmill.llm.forms import JAVA_SUSPECT, canonical, canonical_values, found_forms
from turnmill.llm.queries import p1_forms


def test_cases():
    same = ["", "plain", "Проверим очередь", "1️⃣ ok", "\U0001f9d1‍\U0001f52c", "，。！？：；（）【】“”…", "café", "β版", "naïve — fine", "™ ♪", "tab\there\r\n"]
    for text in same:
        assert canonical(text) == text
    pairs = [
        ("ｗａｉｔ２", "wait2"), ("ﬁrst", "first"), ("⼀共列", "一共列"), ("café", "café"), ("a b　c", "a b c"),
        ("INC‑5", "INC-5"), ("f﻿ai​ls", "fails"), ("еntriеs", "entries"), ("\U0001d5bb\U0001d5c8ard", "board"),
        ("Прoверим", "Проверим"), ("a‍b", "ab"), ("x­y", "xy"), ("SEΤ", "SET"),
    ]
    for raw, plain in pairs:
        assert canonical(raw) == plain
    assert canonical(None) is None


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab ȩ́́ ​‍️1⃣ａ⼀一еожο‑\U0001f9d1\U0001f52c，\n゙か"), max_size=12))
def test_idempotent_and_composed(text):
    once = canonical(text)
    assert canonical(once) == once
    assert unicodedata.normalize("NFC", once) == once or "⃣" in once


def test_found_counts_repeated_rows_once(spark):
    seg = spark.createDataFrame([(1, "a b", 9), (1, "a b", 8), (2, "ok", 1), (3, None, 1), (4, "", 1), (5, "x" * 50_000 + "​", 1)], "segment_id bigint, text string, row_id int")
    cor = spark.createDataFrame([(7, "ｑ"), (8, None)], "correction_id bigint, from_text string")
    assert {tuple(r) for r in found_forms(seg, cor).collect()} == {("segments.text", 1), ("segments.text", 5), ("corrections.from_text", 7)}
    assert found_forms(seg.limit(0), cor.limit(0)).count() == 0
    plain = {r.row_id: r.plain for r in canonical_values(seg, "segment_id", "text", "f").collect()}
    assert plain == {1: "a b", 2: "ok", 3: None, 4: "", 5: "x" * 50_000}


def test_query_gives_forms_of_segments_and_corrections(spark, tmp_path):
    spark.createDataFrame([(1, "use ＮettleHook​ now", 9), (1, "use ＮettleHook​ now", 8), (2, None, 1)], "segment_id bigint, text string, row_id int").write.parquet(f"{tmp_path}/segments.parquet")
    spark.createDataFrame([(1, "Nеttle​Hook"), (1, "Nеttle​Hook"), (2, None), (3, ""), (4, "磐石")], "correction_id bigint, from_text string").write.parquet(f"{tmp_path}/corrections.parquet")
    rows = [tuple(r) for r in p1_forms(spark, str(tmp_path)).collect()]
    assert len(rows) == 6 and set(rows) == {
        ("segments.text", 1, "use NettleHook now"), ("segments.text", 2, None),
        ("corrections.from_text", 1, "NettleHook"), ("corrections.from_text", 2, None), ("corrections.from_text", 3, ""), ("corrections.from_text", 4, "磐石"),
    }


def test_prefilter_keeps_every_text_that_changes(spark):
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and canonical(chr(c)) != chr(c)]
    assert set("ĲĳĿŀŉſǄǌǱǳ") <= set(letters)
    assert [c for c in letters if not re.search(JAVA_SUSPECT, c)] == []
    seg = spark.createDataFrame(list(enumerate(letters)), "segment_id bigint, text string")
    cor = spark.createDataFrame([(1, "ĳs"), (2, "naïve Łódź")], "correction_id bigint, from_text string")
    assert {tuple(r) for r in found_forms(seg, cor).collect()} == {*(("segments.text", i) for i in range(len(letters))), ("corrections.from_text", 1)}
    assert {r.row_id: r.plain for r in canonical_values(seg, "segment_id", "text", "f").collect()} == {i: canonical(c) for i, c in enumerate(letters)}
