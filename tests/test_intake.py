from turnmill.streaming.intake import stream_table, take_in


def test_late_and_redelivered_rows_once(spark, tmp_path):
    schema = "k bigint, text string"
    folder = str(tmp_path / "t.parquet")
    for rows in ([(1, "a"), (2, "b")], [(2, "b"), (3, None)], [(1, "a")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    log = take_in(stream_table(spark, str(tmp_path), "t", files_per_trigger=1), "k", f"file://{tmp_path}")
    assert sorted(map(tuple, log.collect())) == [(1, "a"), (2, "b"), (3, None)]


def test_a_table_of_one_file(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"k": [1, 1, 2]}), tmp_path / "one.parquet")
    assert take_in(stream_table(spark, str(tmp_path), "one"), "k", f"file://{tmp_path}").count() == 2
