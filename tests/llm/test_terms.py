import random

import pandas as pd
from pyspark.sql import functions as F

from turnmill.llm import terms
from turnmill.llm.forms import canonical, canonical_form
from turnmill.llm.terms import Names, distance, distances, found_terms, likeness, map_values, sound, tokens

ROWS = [
    ("t1", "NettleHook", ["nettle huck", "the NettleHook"]), ("t2", "RuvoCache", ["the ruvo cash"]), ("t3", "OrrinBoard", ["orrin bored"]), ("t4", "磐石网关", ["盘石往关", "磐石的网关"]),
    ("t5", "磐石账本", ["“磐石账本”"]), ("t6", "云栈网关", ["云栈的网关"]), ("t7", "OrrinCache", None), ("t8", "NettleBoard", ["NettleBoard 服务", "NettleBoard 服务"]),
]


def test_repairs(spark):
    ref = spark.createDataFrame(ROWS, "eval_id string, canonical string, aliases array<string>")
    meant = {
        "NettleHook": "t1", "nettle-hook": "t1", "NETTLE_HOOK": "t1", "net tlehook": "t1", "Netle hok": "t1", "nettle huck": "t1", "“NettleHook”": "t1", "NettleHook.": "t1", "nеttle hоok": "t1",
        "the ruvo cash": "t2", "ruvocache": "t2", "orrin bored": "t3", "orrin cash": "t7", "盘石往关": "t4", "磐石 网关": "t4", "磐石账本": "t5", "云栈的网关": "t6", "nettle bored": "t8",
        "NettleBoard 服务": "t8",
    }
    for value in ["garnet ring", "orrin", "hook", "数据库", "磐石计划书", "gateway", "…", "x" * 20_000, "12345", "a b c d e f g h i j k l m n o p q"]:
        meant[value] = "none"
    values = spark.createDataFrame([(v,) for v in meant], "v string").withColumn("v", canonical_form(F.col("v")))
    got = {r.value: r.eval_id for r in map_values(values, "v", ref).collect()}
    assert got == {canonical(v): e for v, e in meant.items()}


def test_distance_against_plain_recursion():
    def slow(a, b):
        if not a or not b:
            return len(a) + len(b)
        best = min(slow(a[1:], b) + 1, slow(a, b[1:]) + 1, slow(a[1:], b[1:]) + (a[0] != b[0]))
        if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
            best = min(best, slow(a[2:], b[2:]) + 1)
        return best

    rng = random.Random(0)
    for _ in range(150):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(6))) for _ in "ab")
        assert distance(a, b) == slow(a, b)
    assert sound("board") == sound("bored") and sound("cache") == sound("cash") and tokens("NettleHook v2") == ["nettle", "hook", "v", "2"]


def test_table(spark):
    cor = spark.createDataFrame(
        [(1, "nettle huck", None, "x"), (1, "nettle huck", None, "x"), (2, " ", "Ruvo Cache", "x"), (3, "", "the old one", "x"), (4, "ＲuvoＣache", "RuvoCache", "x")],
        "correction_id bigint, from_text string, to_text string, eval_id string",
    )
    ref = spark.createDataFrame(ROWS, "eval_id string, canonical string, aliases array<string>")
    want = {(1, "from", "t1"), (2, "to", "t2"), (3, "to", "none"), (4, "from", "t2"), (4, "to", "t2")}
    got = [tuple(r) for r in found_terms(cor, ref).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {tuple(r)[2] for r in found_terms(cor, ref.limit(0)).collect()} == {"none"}
    assert found_terms(cor.limit(0), ref).count() == 0


def test_candidates_lose_no_likeness():
    names = Names(ROWS)
    rng = random.Random(1)
    forms = terms._vocabulary(names)
    for _ in range(3000):
        place, part, form = rng.choice(forms)
        token = list(form)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(token) + 1)
            token[i : i + rng.choice([0, 1, 1])] = rng.choice(["", rng.choice(form), rng.choice("abehko往盘庄")])
        token = "".join(token) or "x"
        [like] = likeness(names, pd.DataFrame({"token": [token], "part": [part], "form": [form]}))
        if like > 0:
            by_sound = token.isascii() and token[:1] == form[:1] and sound(token) == sound(form)
            assert by_sound or set(names.keys(token)) & set(names.keys(form)), (token, form)


def test_many_distances_at_once():
    rng = random.Random(2)
    alike = frozenset([("a", "b"), ("b", "a")])
    words = ["".join(rng.choices("abc", k=rng.randrange(7))) for _ in range(400)]
    a, b = words[:200], words[200:]
    assert list(distances(a, b)) == [distance(x, y) for x, y in zip(a, b)]
    assert max(abs(p - q) for p, q in zip(distances(a, b, alike), [distance(x, y, alike) for x, y in zip(a, b)])) < 1e-9


def test_long_lists(spark):
    """Every entry of a long list is found by its name, a slip and its parts cut anew."""
    rng = random.Random(3)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    parts = sorted({"".join(rng.choices(syllables, k=3)) for _ in range(300)})
    pairs = sorted({(x.capitalize(), y.capitalize()) for x, y in zip(rng.choices(parts, k=2500), rng.choices(parts, k=2500)) if x != y})
    ref = spark.createDataFrame([(f"e{i:05d}", x + y, None) for i, (x, y) in enumerate(pairs)], "eval_id string, canonical string, aliases array<string>")
    some = rng.sample(range(len(pairs)), 40)
    values = [(f"{pairs[i][0]} {pairs[i][1]}", f"e{i:05d}") for i in some]
    got = {r.value: r.eval_id for r in map_values(spark.createDataFrame(values, "v string, want string"), "v", ref).collect()}
    assert got == dict(values)
