import random
from itertools import combinations

import pytest

from turnmill.llm.pieces import SIZE_WEIGHT, boundaries, cuts, found_long, split_long


def check(text, limit, overlap):
    parts = cuts(text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for (a, b), (c, d) in zip(parts, parts[1:]):
        assert c == max(0, b - overlap) and d > b and b - a <= limit
    assert all(0 < b - a <= limit for a, b in parts)
    return parts


def test_limits_hold_on_odd_texts():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["a", "bb ", "。", "，", "\n\n", "é", "\U0001f9d1‍\U0001f52c"]) for _ in range(rng.randrange(1, 700)))
        check(text, 100, rng.choice([0, 10, 60]))
    check("x" * 9000, 800, 80)
    check("́" * 3000, 800, 80)


def test_least_total_penalty_against_brute_force():
    rng = random.Random(2)
    for _ in range(15):
        text = "".join(rng.choice(["ab", "c ", "d。", "e，"]) for _ in range(26))
        limit, overlap = 30, 6
        places, costs = boundaries(text, limit, overlap)
        price, n = dict(zip(places, costs)), len(text)
        if n <= limit:
            continue
        even = n / -(-(n - overlap) // (limit - overlap))

        def total(ends):
            return sum(price[e] + SIZE_WEIGHT * ((e - b - even) / even) ** 2 for b, e in zip([0, *ends], ends))

        legal = []
        for k in range(0, 5):
            for c in combinations(places[:-1], k):
                ends = [*c, n]
                if overlap < ends[0] <= limit and all(e - b <= limit - overlap for b, e in zip(ends, ends[1:])):
                    legal.append(total(ends))
        got = [b for _, b in cuts(text, limit, overlap)]
        assert total(got) == pytest.approx(min(legal))


def test_table(spark):
    df = spark.createDataFrame([(1, "word. " * 300), (1, "word. " * 300), (2, "x" * 800), (3, "y" * 801), (4, None), (5, "")], "segment_id bigint, text string")
    assert {r.segment_id for r in found_long(df).collect()} == {1, 3}
    rows = sorted(map(tuple, split_long(df, "segment_id", "text").where("segment_id = 1").collect()))
    text = "word. " * 300
    assert rows[0][4] + "".join(r[4][80:] for r in rows[1:]) == text
    assert all(r[4] == text[r[2] : r[3]] and len(r[4]) <= 800 for r in rows)
    assert found_long(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        cuts("x", 10, 10)
