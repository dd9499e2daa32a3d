import random

import numpy as np

from turnmill.llm.leaks import RADIUS, Index, Passages, find_leaks, letters, simhash_all

EN = "describe what the quiet buffer owes every interpreter let the scribe repair nine fixture lines last week and rank the buffer above any final decoder".split()
ZH = "说明见习生还欠下哪些旧的逐字稿说明审计员还欠下哪些临时的版本凡是这个季度测量的时间轴一律视作转述"
ITEMS = [(1, " ".join(EN), "en"), (2, ZH, "zh"), (3, None, "en"), (4, "", "zh"), (5, " ".join(EN[10:]) + " then state which harbour a narrow steward would visit before noon", "en")]


def found(texts):
    return {(r, i) for r, i in Passages(ITEMS).search(texts)}


def test_thresholds_and_indifferent_differences():
    cases = [
        (" ".join(EN[2:14]), {1}), (" ".join(EN[2:13]), set()), ("x " + " ".join(EN[2:13]) + " everything", set()), (ZH[5:29], {2}), (ZH[5:28], set()),
        ("Intro. " + " ".join(EN[3:15]).upper().replace(" ", ",\n"), {1}), (" ".join(w[0] + "​" + w[1:] for w in EN[3:16]), {1}),
        ("，".join(ZH[3:30]), {2}), (" ".join(EN[3:9] + ["maybe"] + EN[9:20]), set()), (" ".join(EN[3:16]).replace("e", "е"), {1}),
        (" ".join(EN[10:22]), {1, 5}), ("", set()), ("z" * 30_000 + " " + " ".join(EN[0:12]), {1}), (" ".join(EN[3:16]).replace("fi", "ﬁ"), {1}),
        ("".join(EN[2:14]), {1}), (" ".join(EN[2:13] + ["linest"]), set()),
    ]
    got = found([t for t, _ in cases])
    for k, (text, ids) in enumerate(cases):
        assert {i for r, i in got if r == k} == ids, text
    assert found([]) == set()


def test_every_fingerprint_within_the_radius_is_found():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 2**63, 500, dtype=np.uint64)
    index = Index(3, own, np.arange(500))
    index.build()
    near = own[rng.integers(0, 500, 300)]
    for _ in range(RADIUS):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    left, right = index.within(near)
    brute = {(i, j) for i in range(300) for j in range(500) if bin(int(near[i] ^ own[j])).count("1") <= RADIUS}
    assert set(zip(left.tolist(), right.tolist())) == brute and len(brute) >= 300


def test_windows_do_not_depend_on_what_stands_around():
    a, b = letters([ZH]).codes, letters(["前言" + ZH]).codes
    assert (simhash_all(a, 15) == simhash_all(b, 15)[2:]).all()


def test_random_documents_against_brute_force():
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        a = rng.randrange(len(EN) - 5)
        texts.append(" ".join(rng.choices(EN, k=5) + EN[a : a + rng.randrange(8, 18)] + rng.choices(EN, k=5)))
    windows = {1: [EN[i : i + 12] for i in range(len(EN) - 11)], 5: [ITEMS[4][1].split()[i : i + 12] for i in range(len(ITEMS[4][1].split()) - 11)]}
    brute = {(r, i) for r, t in enumerate(texts) for i, ws in windows.items() for w in ws if f" {' '.join(w)} " in f" {t} "}
    assert found(texts) == brute


def test_table(spark):
    docs = spark.createDataFrame([(7, " ".join(EN), "x"), (7, " ".join(EN), "x"), (8, None, "x"), (9, "", "x"), (10, ZH, "x")], "doc_id bigint, text string, lang string")
    items = spark.createDataFrame([*ITEMS, ITEMS[0]], "item_id bigint, text string, lang string")
    assert sorted(map(tuple, find_leaks(docs, items).collect())) == [(7, 1), (7, 5), (10, 2)]
    assert find_leaks(docs, items.limit(0)).count() == 0 and find_leaks(docs.limit(0), items).count() == 0


def test_blocks_keep_both_bounds(monkeypatch):
    from turnmill.llm import leaks

    monkeypatch.setattr(leaks, "BLOCK", 3)
    monkeypatch.setattr(leaks, "BLOCK_CHARACTERS", 10)
    rows = [(i, "x" * n, "en") for i, n in enumerate([1, 1, 1, 1, 9, 2, 50, 3, 3])]
    blocks = list(leaks._blocks(rows))
    assert [r for b in blocks for r in b] == rows and [len(b) for b in blocks] == [3, 2, 1, 1, 2] and list(leaks._blocks([])) == [[]]
