import random

from turnmill.operators.intervals import merge_intervals, session_spans

SCHEMA = "who string, a bigint, b bigint, span_kind string"


def brute(rows):
    out = set()
    for who in {r[0] for r in rows}:
        end = start = None
        for a, b in sorted((r[1], r[2]) for r in rows if r[0] == who and r[1] is not None and r[2] is not None and r[1] < r[2]):
            if end is None:
                start, end = a, b
            elif a <= end:
                end = max(end, b)
            else:
                out |= {(who, "period", start, end), (who, "gap", end, a)}
                start, end = a, b
        if end is not None:
            out.add((who, "period", start, end))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = [tuple(r) for r in merge_intervals(df, ["who"], "a", "b").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_matches_brute_force_over_all_levels(spark):
    rng = random.Random(3)
    rows = []
    for who in ("x", None, "hot"):
        for _ in range(60):
            a = rng.choice([rng.randrange(0, 400_000), rng.randrange(0, 2**27), rng.randrange(-(2**28), 2**38)])
            rows.append((who, a, a + rng.choice([0, 1, 1000, 65_536, 70_000, -5])))
    rows += [("edge", 0, 65_536), ("edge", 65_536, 131_072), ("edge", 2**26 - 5, 2**26), ("edge", 2**26, 2**26 + 9)]
    rows += [("null", None, 5), ("null", 5, None)]
    rows += rows[:20]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == set()


def test_session_times_are_rounded_to_milliseconds(spark):
    df = spark.createDataFrame(
        [("r", 0, 0.0004, 1.0), ("r", 0, 1.0000002, 2.0), ("r", 0, 3.0, float("nan")), ("r", 0, 4.0, 4.0000001), ("r", 0, 5.0, None), ("r", 0, 2.5, 2.75)],
        "recording_id string, session_no int, start_seconds double, end_seconds double",
    )
    got = {tuple(r)[2:] for r in session_spans(df).collect()}
    assert got == {("period", 0, 2000), ("gap", 2000, 2500), ("period", 2500, 2750)}
