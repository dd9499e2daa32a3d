import numpy as np
from pyspark.sql import functions as F

from turnmill.llm import rules
from turnmill.llm.quality import STATISTICS, TELLING, classified, fitted_case, found_classes, measure
from turnmill.llm.samples import labelled_documents


def test_held_out_accuracy(spark):
    rows = labelled_documents(1500, seed=4242)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: r.text_class for r in classified(df).select("doc_id", "text_class").collect()}
    right = np.mean([got[i] == label for i, (_, label) in enumerate(rows)])
    assert right > 0.97


def test_statistics_of_plain_cases():
    of = lambda t, name: measure(t)[STATISTICS.index(name)]
    assert measure(None) is None and measure("") is None and measure(" \n\t") is None
    assert of("one two\nthree.", "n_lines") == 2 and of("one two\nthree.", "ended_share") == 0.5
    assert of("one two three", "n_words") == 3 and of("one three", "mean_word") == 4
    assert of("- a b\n- c d\n- e f\n- g h", "marked_share") == 1 and of("a|b", "row_share") == 0
    assert of("a\tb\tc\n1\t2\t3", "row_share") == 1 and of("甲、乙、丙、丁、戊、己、庚、辛、壬、癸、子、丑、寅、卯、辰、巳、午", "inline_share") == 1


def test_found(spark):
    rows = [
        (1, None), (2, ""), (3, "  \n"), (4, "- milk\n- bread\n- salt\n- two eggs\n- tea"), (5, "a,b,c\n1,2,3\n4,5,6\n7,8,9"), (6, "好，好，" * 40), (6, "好，好，" * 40),
        (7, "We went to the market, and nobody was there. It was late.\n> He said so, too."), (8, "k3J9+/" * 300), (9, "word " * 60_000),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.lit("clash"))
    assert sorted(map(tuple, found_classes(df).collect())) == [(4, "list"), (5, "table"), (6, "junk"), (8, "junk"), (9, "junk")]
    assert found_classes(df.limit(0)).count() == 0


def test_rules_and_their_sql_agree():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    labels = np.where(x[:, 0] > 0.7, "a", np.where((x[:, 1] <= 0.3) & (x[:, 2] > 0.5), "b", "c")).tolist()
    fit = rules.induce(x, labels, ["u", "v", "w"], default="c")
    assert np.mean(np.array(rules.predict(fit, x, ["u", "v", "w"], "c")) == labels) > 0.97
    import duckdb
    import pandas as pd

    df = pd.DataFrame(x, columns=["u", "v", "w"])  # noqa: F841
    sql = rules.to_sql(fit, "c").replace("D AND", " AND").replace("D THEN", " THEN")
    assert [r[0] for r in duckdb.sql(f"SELECT {sql} FROM df").fetchall()] == rules.predict(fit, x, ["u", "v", "w"], "c")
    assert all(t in STATISTICS for t in TELLING) and "CASE" in fitted_case()
