"""Timeline, boundaries, joins, display and quality on small transcripts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from turnmill.functions import lexicon as lx
from turnmill.functions import text as tx
from turnmill.operators import actions, batching, display, evidence, quality, terms, timeline

SEG = "segment_id bigint, recording_id string, session_no int, seg_idx int, start_seconds double, end_seconds double, timing_source string, speaker string, text string, join_next boolean, ingested_at string"


def segments(spark, rows):
    """Rows of (start, end, speaker, text, join_next)."""
    return spark.createDataFrame([(i, "r", 0, i, a, b, "provider", s, t, j, "now") for i, (a, b, s, t, j) in enumerate(rows)], SEG)


def test_quality_gate_cases(spark):
    rows = [("empty", " \n", 10.0, 0), ("ok", "A normal sentence about the garden.", 10.0, 9), ("again", "我担心的是旧的录音" * 40, 60.0, 50), ("dense", "".join(chr(0x4E00 + i) for i in range(300)), 10.0, 50), ("tokens", "x", 10.0, 121), ("free", "".join(chr(0x4E00 + i) for i in range(300)), None, 500)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, duration_seconds double, completion_tokens int")
    got = {r.chunk_id: r.reason_codes for r in quality.quality_gate(df).collect()}
    assert got == {"empty": "empty_transcript", "ok": "", "again": "repetitive_generation", "dense": "excessive_character_density", "tokens": "excessive_completion_token_density", "free": ""}


def test_split_plan_is_near_equal(spark):
    df = spark.createDataFrame([(n,) for n in (10, 159_999, 160_000, 300_000, 480_001)], "n bigint")
    got = {r.n: r.p for r in df.select("n", quality.split_plan(F.col("n"), F.lit(16000)).alias("p")).collect()}

    def brute(n):
        if n < 160_000:
            return []
        k, out, left = max(2, -(-n // 160_000)), [], n
        if n // k < 80_000:
            return []
        for i in range(k):
            size = -(-left // (k - i))
            out.append(size)
            left -= size
        return out

    assert got == {n: brute(n) for n in got}


def test_silence(spark):
    df = spark.createDataFrame([([0.0, 0.5, float("nan"), None],), ([0.0] * 4,), ([],)], "s array<double>")
    got = [r.q for r in df.select(quality.silence(F.col("s")).alias("q")).collect()]
    assert [r.silence for r in got] == [False, True, True] and got[0].peak == 0.5 and got[0].rms == 0.25


def test_boundary_fillers_and_replay(spark):
    seg = segments(spark, [(0.0, 2.0, "A", "好的，嗯", False), (1.5, 3.0, " a ", "嗯，我们开始", False), (2.5, 4.0, "A", "嗯", False), (3.9, 5.0, "B", "嗯，别的", False), (4.5, 6.0, "B", "继续啊。", False), (5.5, 7.0, "B", "嗯 不同", False)])
    norm = timeline.normalized(seg)
    after = {r.segment_id: r.after for r in timeline.boundaries(norm).collect()}
    assert after[1] == "我们开始" and after[2] == "嗯" and after[3] == "嗯，别的" and after[5] == "嗯 不同"
    ledger = timeline.reconciliations(norm)
    [row] = ledger.collect()
    assert (row.from_text, row.start_offset, row.end_offset, row.removed_characters, row.at_seconds) == ("嗯，", 0, 2, 2, 1.5) and row.source_hash.startswith("fnv1a32:")
    assert {r.segment_id: r.text for r in timeline.replay_reconciliations(norm, ledger).collect()} == after
    forged = ledger.withColumn("end_offset", F.lit(3))
    assert timeline.replay_reconciliations(norm, forged).count() == 0


def test_boundaries_equal_the_sequential_form(spark):
    rng = random.Random(8)
    rows, t = [], 0.0
    for _ in range(400):
        rows.append((t, t + rng.choice([0.5, 2.0]), rng.choice("AB"), "".join(rng.choice(["嗯", "啊", "，", "好", " "]) for _ in range(rng.randrange(1, 6))), False))
        t += 1.0
    norm = timeline.normalized(segments(spark, rows))
    src = sorted((r.pos, r.text, r.speaker, r.start_seconds, r.end_seconds) for r in norm.collect())
    import re

    texts = [x[1] for x in src]
    for i in range(1, len(src)):
        p, c = src[i - 1], src[i]
        m, k = re.search("([嗯呃啊哦])[\\s，,。！？!?、]*$", texts[i - 1]), re.match("[\\s，,。！？!?、]*([嗯呃啊哦])(?=$|[\\s，,。！？!?、])", texts[i])
        if p[2] == c[2] and p[4] > c[3] and m and k and m[1] == k[1]:
            rest = re.sub("^[\\s，,。！？!?、]+", "", texts[i][k.end() :])
            texts[i] = rest or texts[i]
    got = {r.pos: r.after for r in timeline.boundaries(norm).collect()}
    assert [got[i] for i in range(len(src))] == texts


def test_paragraphs_and_context(spark):
    long = "长" * 500
    seg = segments(spark, [(0.0, 2.0, "A", "We start.", True), (2.5, 4.0, "A", "and go on", True), (4.5, 6.0, "A", "here", True), (20.0, 21.0, "A", "far", True), (21.0, 22.0, "A", long, True), (22.0, 23.0, "A", long, False), (23.0, 24.0, "B", "end", False)])
    norm = timeline.normalized(seg)
    p = sorted((r.paragraph, r.text, list(r.segment_ids)) for r in timeline.paragraphs(norm).collect())
    assert [(a, c) for a, _, c in p] == [(0, [0, 1, 2]), (3, [3, 4]), (5, [5]), (6, [6])] and p[0][1] == "We start and go on here"
    c = {r.pos: (r.first, r.last) for r in timeline.context_groups(norm).collect()}
    assert c[1] == (0, 2) and c[3] == (3, 4) and c[5] == (5, 5) and c[6] == (6, 6)


def test_display_overlap():
    assert display.hidden_overlap("前面。我们今天讨论计划", "我们今天讨论计划，然后开始", 2.0) is not None
    a, z, e, hidden = display.hidden_overlap("前面。我们今天讨论计划", "我们今天讨论计划，然后开始", 2.0)
    assert (a, z, e, hidden) == (3, 11, 8, 9)
    for left, right, seconds in [("我们不讨论计划吧", "我们不讨论计划吧，好", 2.0), ("前面。我们今天讨论计划", "我们今天讨论计划，然后开始", 0.1), ("前面我们今天讨论计划", "我们今天讨论计划", 2.0), ("good day", "good day to you", 2.0), ("如果我们今天讨论计划", "如果我们今天讨论计划", 2.0), ("a", "b", 9.0), ("", "x", 1.0)]:
        assert display.hidden_overlap(left, right, seconds) is None, left
    rng = random.Random(1)
    for _ in range(300):
        x, y = ([rng.choice("ab") for _ in range(rng.randrange(1, 8))] for _ in "xy")
        brute = max((n for n in range(1, min(len(x), len(y)) + 1) if x[-n:] == y[:n]), default=0)
        assert display.longest_overlap(x, y) == brute


def test_classifiers(spark):
    cases = {
        "我们决定下周发布": ("decision", True), "是否决定下周发布": ("decision", False), "We will ship it": ("decision", True), "Maybe we will ship it": ("decision", False), "还没有决定": ("not_made", True), "nobody approved it": ("not_made", True),
        "谁来负责发布": ("question", True), "Who will deploy it": ("question", True), "我负责完成部署": ("affirmative", True), "我不负责部署": ("affirmative", False), "Is it done?": ("question", True), "好的": ("floor", True),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    t = F.col("t")
    rows = df.select("t", lx.decision(t).alias("decision"), lx.not_made(t).alias("not_made"), lx.direct_question(t).alias("question"), lx.affirmative_action(t).alias("affirmative"), lx.defensive_floor(t).alias("floor")).collect()
    for r in rows:
        name, want = cases[r.t]
        assert r[name] == want, r.t


def test_owner_and_due(spark):
    rows = [("由张三负责发布，周五之前", "张三", "周五", "发布", True, True), ("由张三负责发布，再说，周五之前", "张三", "周五", "发布", True, False), ("张三负责发布，周五前", "张三", "周五", "发布", True, True), ("张三可能负责发布", "张三", "周五", "发布", False, False), ("Tom will ship the page by Friday", "Tom", "Friday", "ship the page", True, True), ("李四说好", "张三", "周五", "发布", False, False)]
    df = spark.createDataFrame(rows, "e string, o string, d string, t string, owner boolean, due boolean")
    got = tx.fold(df, "e", "o", "d", "t").select("e", "owner", "due", actions.owner_supported(F.col("e"), F.col("o")).alias("o2"), actions.due_supported(F.col("e"), F.col("d"), F.col("t"), F.col("o")).alias("d2")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.o2, r.d2) == (r.owner, r.due), r.e


def test_grounding_ties_and_hints(spark):
    seg = segments(spark, [(0.0, 5.0, "A", "the plan is set", False), (1.0, 5.0, "B", "the plan is set", False), (30.0, 31.0, "A", "other plan", False), (59.8, 61.0, "A", "over the minute", False)])
    claims = spark.createDataFrame([(1, "r", 0, 0.5, "plan is", ""), (2, "r", 0, 0.5, "plan is", "b"), (3, "r", 0, 30.2, "OTHER  plan!", ""), (4, "r", 0, 90.0, "plan", ""), (5, "r", 0, 60.5, "the minute", ""), (6, "r", 0, None, "plan", ""), (7, "r", 0, 30.0, "x", "")], "claim_id int, recording_id string, session_no int, at_seconds double, quote string, speaker_hint string")
    got = {r.claim_id: r.segment_id for r in evidence.ground(claims, timeline.normalized(seg)).collect()}
    assert got == {2: 1, 3: 2, 5: 3}


def test_aliases_close_over_cycles_and_conflicts(spark):
    pairs = [("aa", "bb"), ("bb", "cc"), ("cc", "dd"), ("xx", "yy"), ("yy", "xx"), ("tail", "xx"), ("k1", "one"), ("k1", "two"), ("into", "k1"), ("self", "Self")]
    df = spark.createDataFrame([(i, "r", a, b) for i, (a, b) in enumerate(pairs)], "i int, recording_id string, a string, b string")
    e = terms.alias_edges(df, ["recording_id"], "a", "b", "i")
    got = {r.alias_key: r.terminal for r in terms.close_aliases(e, ["recording_id"]).collect()}
    assert got == {"aa": "dd", "bb": "dd", "cc": "dd", "xx": None, "yy": None, "tail": None, "k1": None, "into": None, "self": "Self"}


def test_context_overflow(spark):
    rows = [("at", "terms: " + ",".join(f"term{i}" for i in range(200))), ("over", "terms: " + ",".join(f"term{i}" for i in range(150)) + "；别名: " + "，".join(f"a{i} -> b{i}" for i in range(51))), ("none", "no label here"), ("blank", None)]
    df = spark.createDataFrame(rows, "k string, t string")
    assert {tuple(r) for r in terms.context_overflow(df, "k", "t").collect()} == {("at", 200, False), ("over", 201, True), ("none", 0, False), ("blank", 0, False)}
    got = terms.parse_context(df, "k", "t").groupBy("k").count().collect()
    assert {tuple(r) for r in got} == {("at", 200), ("over", 200)}


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r.node: r.component for r in terms.components(df, "a", "b").collect()}
    assert got == {n: find(n) for n in parent}


def test_components_never_end_unsettled(spark):
    df = spark.createDataFrame([(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)], "a string, b string")
    with pytest.raises(ValueError, match="not settled"):
        terms.components(df, "a", "b", 2)
    assert {r.component for r in terms.components(df, "a", "b").collect()} == {"c000"}


def test_plausible_pairs_of_every_script(spark, tmp_path):
    import unicodedata

    import __spark_entry__ as entry

    texts = ["磐石网关", "磐石往关", "磐石网", "网关磐石系统", "听雨巷", "Nettle网关", "nettle 网关", "Mettle往关", "NettleHook", "nettlehok", "Kettlehook", "Очередь", "очереть", "ａｂｃ", "abc", "关", "磐石网关服务", "盘古网观服务"]
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)]
    spark.createDataFrame([*pairs, pairs[5], (-1, None, "磐石网关"), (-2, "磐石网关", None)], "correction_id bigint, from_text string, to_text string").write.parquet(f"{tmp_path}/corrections.parquet")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def brute(a, b):
        x, y = (unicodedata.normalize("NFKC", t).lower().replace(" ", "") for t in (a, b))
        if min(len(x), len(y)) < 3:
            return False
        if x == y:
            return unicodedata.normalize("NFKC", a) != unicodedata.normalize("NFKC", b)
        if x.isascii() and y.isascii() and x[0] != y[0]:
            return False
        return distance(x, y) <= max(2, -(-max(len(x), len(y)) * 45 // 100))

    want = {i: brute(a, b) for i, a, b in pairs}
    rows = entry.queries()["plausible_pairs_all"](spark, str(tmp_path)).collect()
    assert len(rows) == len(want) and {r.correction_id: r.plausible for r in rows} == want
    assert {brute(a, b) for _, a, b in pairs if not (a + b).isascii()} == {True, False}
    part = {r.correction_id: r.plausible for r in entry.queries()["plausible_pairs"](spark, str(tmp_path)).collect()}
    assert part.items() <= want.items() and len(part) < len(want)


def test_terms_in_text():
    assert terms.ranges_in("Use Nettle-Hook, not nettlehooks", "nettle hook") == [(4, 15)]
    assert terms.ranges_in("ａｂｃ abc xabc", "ABC") == [(0, 3), (4, 7)]
    assert terms.ranges_outside("NettleHook and Nettle", "Nettle", "NettleHook") == [(15, 21)]
    assert terms.rewrite_text("用磐石往关和磐石往关", [("磐石往关", "磐石网关")]) == "用磐石网关和磐石网关"
    assert terms.replay_spans("abcdef", [(0, 2, "ab", "X"), (4, 6, "ef", "YY")]) == "XcdYY"
    assert terms.replay_spans("abcdef", [(0, 2, "xx", "X")]) is None and terms.replay_spans("abcdef", [(0, 3, "abc", "X"), (2, 4, "cd", "Y")]) is None


def test_packing(spark):
    df = spark.createDataFrame([("k", i, c) for i, c in enumerate([5, 5, 5, 20, 1, 1])], "k string, o int, c int")
    got = [r.batch for r in batching.greedy_batches(df, ["k"], "o", F.col("c"), 11, 1).orderBy("o").collect()]
    assert got == [0, 0, 1, 2, 3, 3]
    rows = spark.createDataFrame([("k", 0, 1, 6), ("k", 1, 2, 9), ("k", 2, 3, 3)], "k string, o int, p int, s int")
    assert [r.o for r in batching.pack_by_priority(rows, ["k"], "o", "p", "s", 10).orderBy("o").collect()] == [0, 2]


def test_hash_and_numbers():
    assert [tx.js_number(x) for x in (5.0, 0.1, None, 1e21, 1e-7, 1.5e-5, -2.0)] == ["5", "0.1", "0", "1e+21", "1e-7", "0.000015", "-2"]
    assert tx.fnv1a32("") == "fnv1a32:811c9dc5" and tx.fnv1a32("a") == "fnv1a32:e40c292c"


def test_text_functions(spark):
    df = spark.createDataFrame([("“Ａ b，c。”　",), (None,), ("",)], "t string")
    t = F.col("t")
    rows = df.select(tx.comparable_text(t).alias("c"), tx.correction_text(t).alias("k"), tx.term_key(t).alias("x"), tx.html_escape(F.lit("<a&'\">")).alias("h")).collect()
    assert [r.c for r in rows] == ["ab,c", "", ""] and [r.k for r in rows] == ["abc", "", ""] and rows[0].h == "&lt;a&amp;&#39;&quot;&gt;"
    joined = spark.createDataFrame([("hello", "world"), ("你好", "世界"), ("说", "API ok"), ("end.", "Next"), ("", "x"), ("ok，", "好")], "a string, b string")
    assert [r[0] for r in joined.select(tx.join_texts(F.col("a"), F.col("b"))).collect()] == ["hello world", "你好世界", "说 API ok", "end. Next", "x", "ok，好"]
    with pytest.raises(ValueError):
        json.loads("{")
