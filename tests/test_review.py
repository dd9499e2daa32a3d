"""Proposals, evidence and admission on small fixtures, against plain restatements of the rules."""

import random

from pyspark.sql import functions as F

from turnmill.operators import patches, terms

CONTEXT = "alias_key string, canonical string, reason string, conflict boolean"
PROPOSALS = "segment_id bigint, ord bigint, from_text string, to_text string, clash string"


def context(spark):
    rows = [("lantrn", "Lantern", "explicit_alias", False), ("lantern", "Lantern", "recording_consensus", False), ("two", "Twoo", "explicit_alias", True), ("five", "5 Sails", "explicit_alias", False), ("trnha", "Tern Halo", "recording_consensus", False), ("halo", "Halo Gate", "explicit_alias", False)]
    return spark.createDataFrame(rows, CONTEXT)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], PROPOSALS)


def test_every_reason(spark):
    segments = spark.createDataFrame([(1, "lantrn and Lantrn, Lantern; five men"), (2, None), (3, "trn ha lantrn")], "segment_id bigint, text string")
    rows = [
        (1, 1, None, "Lantern"), (1, 2, "lantrn", " "), (1, 3, "two", "Twoo"), (1, 4, "xx", "Lantern"), (1, 5, "xx", "yy"), (1, 6, "lantrn", "lantern"), (1, 7, "trn ha", "Tern Halo"),
        (1, 8, " lantrn ", "Lantern"), (1, 9, "lantrn", "Lantern"), (9, 10, "lantrn", "Lantern"), (1, 11, "five", "5 Sails"), (2, 12, "lantrn", "Lantern"), (3, 13, "trn ha", "Tern Halo"), (3, 14, "halo", "Halo Gate"), (1, 15, "lantern", "Lantern"),
    ]
    ledger, texts = patches.apply_proposals(frame(spark, rows), context(spark), segments)
    got = sorted((r.ord, r.from_text, r.status, r.reason, r.start_offset) for r in ledger.collect())
    assert got == [
        (1, "", "rejected", "invalid_replacement", None), (2, "lantrn", "rejected", "invalid_replacement", None), (3, "two", "rejected", "conflicting_alias_mapping", None), (4, "xx", "rejected", "explicit_alias_required", None),
        (5, "xx", "rejected", "unknown_canonical", None), (6, "lantrn", "rejected", "canonical_mismatch", None), (7, "trn ha", "rejected", "from_not_found", None),
        (8, "Lantrn", "accepted", "explicit_alias", 11), (8, "lantrn", "accepted", "explicit_alias", 0), (10, "lantrn", "rejected", "unknown_segment", None), (11, "five", "rejected", "critical_fact_change", None),
        (12, "lantrn", "rejected", "from_not_found", None), (13, "trn ha", "accepted", "recording_consensus", 0), (14, "halo", "rejected", "from_not_found", None),
    ]
    assert {r.segment_id: r.text for r in texts.collect()} == {1: "Lantern and Lantern, Lantern; five men", 3: "Tern Halo lantrn"}
    empty = frame(spark, [])
    assert patches.apply_proposals(empty, context(spark), segments)[0].count() == 0


def test_ranges_that_overlap_are_refused():
    p = lambda ord_, canonical, *ranges: {"ord": ord_, "from_": "f", "to_": canonical, "canonical": canonical, "why": None, "ranges": [{"start": a, "end": b} for a, b in ranges]}
    entries, taken = patches.place("abcdefgh", [p(1, "XX", (2, 4)), p(2, "YY", (3, 5), (6, 8)), p(3, "XX", (2, 4)), p(4, "ZZ", (0, 2))])
    assert [(e["ord"], e["status"], e["reason"]) for e in entries] == [(1, "accepted", "explicit_alias"), (2, "rejected", "overlapping_replacement"), (2, "accepted", "explicit_alias"), (4, "accepted", "explicit_alias")]
    assert taken == [{"start": 0, "end": 2, "to": "ZZ"}, {"start": 2, "end": 4, "to": "XX"}, {"start": 6, "end": 8, "to": "YY"}]


def test_placing_against_a_quadratic_scan():
    some = random.Random(2)
    for _ in range(60):
        proposals = [{"ord": i, "from_": "f", "to_": "T", "canonical": some.choice("TUV"), "why": None, "ranges": [{"start": a, "end": a + some.randrange(1, 4)} for a in sorted(some.sample(range(20), some.randrange(0, 4)))]} for i in range(6)]
        want = []
        for p in proposals:
            for x in p["ranges"]:
                if not any(x["start"] < b and x["end"] > a for a, b, _ in want):
                    want.append((x["start"], x["end"], p["canonical"]))
        assert [(x["start"], x["end"], x["to"]) for x in patches.place("abcdefghijklmnopqrstuvwxyz", proposals)[1]] == sorted(want)


def test_merging_scoping_and_settling(spark):
    model = frame(spark, [(1, 1, "a", "b"), (None, 2, "a", None)])
    reusable = frame(spark, [(1, 3, "a", "b"), (1, 4, "A", "b"), (1, 5, "A", "b"), (None, 6, "a", None)])
    got = sorted((r.ord, r.origin) for r in patches.merge_proposals(model, reusable).collect())
    assert got == [(1, "model"), (2, "model"), (4, "reusable")]
    scoped = patches.scope_proposals(reusable, "segment_id", F.lit(0), F.lit(1)).collect()
    assert [(r.scoped, r.reason) for r in scoped] == [(False, "out_of_batch_segment")] * 4
    rows = [(1, 1, "lantrn", "Lantern"), (1, 2, "lantrn", "ｌantrn"), (1, 3, "trn ha", "halo"), (1, 4, "two", "Twoo"), (1, 5, "zz", "z"), (1, 6, "lantrn", "trn ha")]
    left = patches.unresolved(patches.with_mapping(frame(spark, rows), context(spark)))
    assert sorted(r.ord for r in left.collect()) == [3, 4, 5, 6]


def test_changed_range(spark):
    pairs = [("abc", "abc"), ("", "x"), ("x", ""), ("aa", "aaa"), ("abXcd", "abYYcd"), ("abab", "ab"), ("日本語", "日語"), ("a" * 5000 + "x" + "b" * 9, "a" * 5000 + "y" + "b" * 9)]

    def plain(a, b):
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        j = 0
        while j < min(len(a), len(b)) - i and a[len(a) - 1 - j] == b[len(b) - 1 - j]:
            j += 1
        return i, len(b) - j

    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", patches.changed_range(F.col("a"), F.col("b")).alias("r")).collect()
    assert all((r.r.start, r.r.end) == plain(r.a, r.b) for r in got)


def test_thinning_against_the_loop(spark):
    some = random.Random(5)
    lines = {k: [some.randrange(1, 60) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 3), ("d", 40), ("e", 101), (None, 17))}
    df = spark.createDataFrame([(k, i, c) for k, cs in lines.items() for i, c in enumerate(cs)], "k string, pos int, c int")
    got = {}
    for r in patches.thinned(df, ["k"], "pos", F.col("c"), 300).collect():
        got.setdefault(r.k, []).append(r.pos)
    for k, cs in lines.items():
        kept = list(range(len(cs)))
        while sum(cs[i] + 1 for i in kept) - 1 > 300 and len(kept) > 2:
            kept = [x for j, x in enumerate(kept) if j % 2 == 0 or j == len(kept) - 1]
        assert sorted(got[k]) == kept


def test_excerpts(spark):
    texts = [None, "", "  ", "short", "x" * 240, "ab" * 400, " " + "y" * 241, "a" * 240 + " " * 240 + "b" * 240]
    got = [r.e for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(patches.excerpts(F.col("t"), 240).alias("e")).collect()]
    assert got == [[], [], [], ["short"], ["x" * 240], ["ab" * 120], ["y" * 240], ["a" * 240, "b" * 240]]


def test_chains_of_any_length_are_closed(spark):
    n = 5000
    rows = [(f"k{i:05d}", f"k{i + 1:05d}", False) for i in range(n)] + [("p", "q", False), ("q", "p", False)]
    got = {r.alias_key: r.terminal for r in terms.close_aliases(spark.createDataFrame(rows, "alias_key string, canonical string, conflict boolean"), []).collect()}
    assert got["k00000"] == got[f"k{n - 1:05d}"] == f"k{n:05d}" and got["p"] is None and got["q"] is None


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_variants_against_all_pairs(spark):
    some = random.Random(8)
    words = {"".join(some.choices("abc", k=some.randrange(1, 9))) for _ in range(150)}
    for w in list(words)[:60]:  # longer words and their slips
        base = w + "".join(some.choices("abcdefgh", k=some.randrange(4, 18)))
        words.add(base)
        for _ in range(3):
            i = some.randrange(1, len(base))
            words.add(base[:i] + some.choice(["", "x", "yz"]) + base[i + some.choice([0, 1, 2]) :])
    for n in (29, 30, 31, 32, 33, 34, 35, 60, 200):  # about and beyond the longest that are cut into segments
        base = "".join(some.choices("abcdefgh", k=n))
        for _ in range(5):
            w = base
            for _ in range(some.randrange(1, max(2, n // 5))):
                i = some.randrange(1, len(w))
                w = w[:i] + some.choice("abxy") + w[i + 1 :]
            words |= {base, w, w[: n - 1], w + "q"}
    want = {(a, b) for a in words for b in words if a < b and a[0] == b[0] and abs(len(a) - len(b)) < 3 and a not in b and b not in a and _edits(a, b) <= max(1, max(len(a), len(b)) // 4)}
    df = spark.createDataFrame([(w,) for w in [*words, *list(words)[:9], "", None]], "key string")
    got = [tuple(r) for r in terms.variant_pairs(df, "key").collect()]
    assert set(got) == want and len(got) == len(want) > 50
    assert terms.variant_pairs(df.limit(0), "key").count() == 0


def test_variants_gather_their_keys_once(spark):
    some = random.Random(4)
    words = sorted({c + "".join(some.choices("abc", k=some.randrange(0, 12))) for c in "ab" for _ in range(250)})
    want = {(a, b) for a in words for b in words if a < b and a[0] == b[0] and abs(len(a) - len(b)) < 3 and a not in b and b not in a and _edits(a, b) <= max(1, max(len(a), len(b)) // 4)}
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    df = spark.createDataFrame([(w,) for w in words], "key string").mapInPandas(counted, "key string")
    got = [tuple(r) for r in terms.variant_pairs(df, "key").collect()]
    assert set(got) == want and len(got) == len(want) > 400
    assert read.value == len(words)


def test_components_read_the_texts_once(spark, monkeypatch):
    from turnmill.plans import reference

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    texts = ["Lanternbox 和 Lanternbux", "lanternbax", "Kettle-98 kettle99", "alone", "Quillasync Quillasink"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").mapInPandas(counted, "doc_id long, text string")
    monkeypatch.setattr(reference, "read_table", lambda *_: df)
    got = {r.node: r.component for r in reference.variant_components(spark, "").collect()}
    assert got == {"lanternbax": "lanternbax", "lanternbox": "lanternbax", "lanternbux": "lanternbax", "kettle98": "kettle98", "kettle99": "kettle98", "quillasync": "quillasink", "quillasink": "quillasink"}
    assert read.value == len(texts)


def test_late_rounds_of_components_are_small(spark, monkeypatch):
    sizes = []

    def counted(df):
        sizes.append(df.count())
        return df.localCheckpoint()

    monkeypatch.setattr(terms, "cut", counted)
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(240)] + [("x", "x"), ("y", None)]
    got = {r.node: r.component for r in terms.components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {f"c{i:03d}": "c000" for i in range(241)} | {"x": "x"}
    assert sum(sizes[len(sizes) // 2 : -1]) < 120  # all nodes were joined to all edges in every round


def test_keys_of_surfaces_are_distinct_in_a_batch(spark):
    texts = ["Lanternbox 和 Lanternbox, lantern-box\n", None, "", "C++ x# a- _ab 9abc9 --Foo_bar-_，调用Bar#+ f_ é1ab aéb K2", "ab", "cd ef", "G-h-", "A1-#", *["Quilla sync"] * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {r.term_key for r in terms.surfaces(df, "doc_id", "text").collect()}
    keys = terms.surface_keys(df, "text")
    got = [r.key for r in keys.collect()]
    assert set(got) == want and len(got) == len(want) > 8
    assert "Generate" not in keys._jdf.queryExecution().executedPlan().toString()  # no row for each of a text's words


def test_letters_of_variants_in_every_script(spark):
    some = random.Random(6)
    words = {"q" + "".join(some.choices("aAbB!1和平😀é", k=some.randrange(2, 12))) for _ in range(60)}
    for w in sorted(words):
        i = some.randrange(1, len(w))
        words.add(w[:i] + some.choice(["", "和", "aa"]) + w[i + some.choice([0, 1, 2]) :])
    want = {(a, b) for a in words for b in words if a < b and abs(len(a) - len(b)) < 3 and a not in b and b not in a and _edits(a, b) <= max(1, max(len(a), len(b)) // 4)}
    pairs = terms.variant_pairs(spark.createDataFrame([(w,) for w in words], "key string"), "key")
    got = [tuple(sorted(r)) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want) > 20
    assert "bit_count" in pairs.where("left != ''")._jdf.queryExecution().optimizedPlan().toString()
    # the counts of letters tell apart what segments let meet
    bits = {r.w: r.m for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", terms._letter_bits("w").alias("m")).collect()}
    for a, b in want:
        assert ((bits[a] ^ bits[b]) & (1 << 64) - 1).bit_count() <= 2 * max(1, max(len(a), len(b)) // 4) - abs(len(a) - len(b))


def test_variants_of_very_long_keys(spark):
    some = random.Random(3)
    words = ["".join(some.choices("abcdefghijklmnop0123456789", k=20_000 + 3 * i)) for i in range(40)]
    near = words[7][:9000] + "z" + words[7][9001:]
    df = spark.createDataFrame([(w,) for w in [*words, near]], "key string").coalesce(1)
    assert [tuple(sorted(r)) for r in terms.variant_pairs(df, "key").collect()] == [tuple(sorted((words[7], near)))]


def test_predicates_of_surfaces(spark):
    rows = [
        ("Data-Vault", "datavault", "data vault", "datavault", True), ("vector", "vector", "vectro", "vectro", False), ("vectoring", "vectoring", "vectorinq", "vectorinq", True), ("abcdefghijkl", "abcdefghijkl", "abcdefghi", "abcdefghi", False),
        ("abcdefghixyzabcd", "abcdefghixyzabcd", "abcdefqhixyza", "abcdefqhixyza", False), ("a bcdefghixyzabcd", "abcdefghixyzabcd", "abcdefqhixyza", "abcdefqhixyza", True), ("", "", "x", "x", False), ("bold", "bold", "cold", "cold", False),
    ]
    df = spark.createDataFrame(rows, "l string, lk string, r string, rk string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", terms.likely_variants(*[F.col(c) for c in ("l", "r", "lk", "rk")])).collect())
    pairs = [("kube", "kubr", True), ("kube", "kb", True), ("kube", "k", False), ("kubernet", "kubernes", False), ("abcdef", "axcdyf", True), ("abcdef", "axcdyz", False), ("b", "c", False)]
    df = spark.createDataFrame(pairs, "l string, r string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", terms.prefix_variants(F.col("l"), F.col("r"))).collect())


def test_grams_are_counted_in_their_row(spark):
    from collections import Counter

    from turnmill.operators import quality

    texts = [None, "", "abcde", "abcdef", "嗯嗯好" * 60, "la " * 100, "x" * 30_000, "\U0001f389" * 9 + "abcabcabcabcabc"]
    got = quality.repetition(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string"), "text").orderBy("k").collect()
    for r in got:
        t = "".join(c for c in (texts[r.k] or "").lower() if c.isalnum())
        c = Counter(t[i : i + 6] for i in range(len(t) - 5))
        n = sum(c.values())
        assert (r.analyzed_ngram_count, r.max_ngram_occurrences) == (n, max(c.values(), default=0)) and abs(r.repeated_ngram_ratio - (sum(v for v in c.values() if v >= 3) / n if n else 0)) < 1e-12


def test_mixed_terms_beside_variants(spark):
    rows = [
        ("r", 0, 0, 1, "Lanternbox 和 Lanternbux"), ("r", 0, 1, 2, "K8S调度 与 P节点"), ("r", 0, 2, 3, "P节点"), ("r", 0, 9, 4, "API接口"), ("r", 1, 0, 5, "X任务"),
        ("q", 0, 0, 6, "Lanternbox"), ("q", 0, 1, 7, "P节点"), ("p", 0, 0, 8, "KestrelHub kestrelhub"), ("p", 0, 1, 9, "xK8S服务中"),
    ]
    got = terms.contextual_signals(spark.createDataFrame(rows, "recording_id string, session_no int, pos int, segment_id bigint, text string")).collect()
    assert sorted((r.recording_id, r.term, r.occurrences, r.segments, r.related, r.dismissal_policy) for r in got) == [
        ("p", "xK8S服务", 1, 1, 1, "text_evidence"), ("r", "K8S调度", 1, 1, 1, "text_evidence"), ("r", "P节点", 2, 2, 1, "map_or_audio_review"),
    ]


def test_hashes_of_many_texts():
    from turnmill.functions.text import fnv1a32_all

    def plain(text):
        h = 0x811C9DC5
        data = text.encode("utf-16-le", "surrogatepass")
        for i in range(0, len(data), 2):
            h = ((h ^ int.from_bytes(data[i : i + 2], "little")) * 0x01000193) & 0xFFFFFFFF
        return f"fnv1a32:{h:08x}"

    texts = ["", "a", "逐字稿", "\U0001f389x", "b" * 3000, "", "\ud800"]
    assert fnv1a32_all(texts) == [plain(t) for t in texts] and fnv1a32_all([]) == []
