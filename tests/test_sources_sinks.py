import json
import struct

import pytest
from pyspark.sql import functions as F

from turnmill.functions import text as tx
from turnmill.sinks import writers
from turnmill.sources import envelopes as env


def test_envelopes(spark):
    bodies = {
        "a": {"segments": [{"start": "1", "end": 2, "speaker": "X", "text": " hi "}, {"begin_time": 500, "end_time": 1500, "speaker_id": 7, "transcript": "ms"}, {"text": " "}, {"start_seconds": 5, "end": 9, "text": "first convention decides"}]},
        "b": {"text": " only text "}, "c": {"choices": [{"message": {"content": "chat"}}]}, "d": {"segments": [], "usage": {"output_tokens": 12}}, "e": {"other": 1},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in bodies.items()] + [("bad", "no json"), ("null", None)], "id string, body string")
    got = {(r.id, r.seg_idx): tuple(r)[2:] for r in env.parse_responses(df, "id", "body").collect()}
    assert got == {
        ("a", 0): (1.0, 2.0, "provider", "X", "hi"), ("a", 1): (0.5, 1.5, "provider", "7", "ms"), ("a", 3): (0.0, 0.0, "inferred", "发言人 4", "first convention decides"),
        ("b", 0): (0.0, 0.0, "inferred", "发言人 1", "only text"), ("c", 0): (0.0, 0.0, "inferred", "发言人 1", "chat"),
    }
    seen = {r.id: r.ok for r in df.select("id", env.recognised(F.col("body")).alias("ok")).collect()}
    assert [seen[k] for k in "abcde"] == [True, True, True, True, False]
    tokens = {r.id: r.n for r in df.select("id", env.completion_tokens(F.from_json("body", env.ENVELOPE)).alias("n")).collect()}
    assert tokens["d"] == 12.0 and tokens["a"] is None


def test_lenient_json_and_links(spark):
    rows = ['```json\n{"a": 1}\n```', 'text {"a": 2} more', "plain"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [json.loads(r[0]) for r in df.select(env.lenient_json(F.col("t"))).collect()] == [{"a": 1}, {"a": 2}, {"summary": "plain"}]
    page = spark.createDataFrame([('<x><script id="p">{"k": 1}</script>',)], "h string")
    assert page.select(env.embedded_json(F.col("h"), '<script id="p">', "</script>")).first()[0] == '{"k": 1}'
    link = env.encode_link('{"segments": []}')
    assert env.decode_link(link) == '{"segments": []}' and all(env.decode_link(x) is None for x in (None, "", "g.###", "x.abc", env.encode_link("{}")))
    answers = spark.createDataFrame([('{"output_text": "x"}',), ('{"output": [{"content": [{"text": "a"}, {"text": "b"}]}]}',), ('{"choices": [{"message": {"content": "c"}}]}',)], "b string")
    assert [r[0] for r in answers.select(env.response_text(F.col("b"))).collect()] == ["x", "ab", "c"]


def test_local_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    (tmp_path / "c.mp3").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: r.refused for r in env.local_files(spark, str(tmp_path)).collect()}
    assert got == {"a.wav": None, "b.txt": "extension"}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("r", 0, b"ab"), ("r", 1, b"c"), ("r", 1, b"c"), ("gap", 0, b"x"), ("gap", 2, b"y")], "recording_id string, chunk_index int, payload binary")
    assert [(r.recording_id, bytes(r.payload)) for r in writers.compact(df).collect()] == [("r", b"abc")]
    path = str(tmp_path / "log")
    writers.append_chunks(df, path)
    writers.append_chunks(df, path)
    assert spark.read.parquet(path).count() == 10
    out = str(tmp_path / "out")
    writers.write_atomic(df, out)
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_atomic(df, out)
    writers.write_atomic(df.limit(1), out, force=True)
    assert spark.read.parquet(out).count() == 1
    wav = writers.wav_bytes([0.0, 2.0, -2.0], 16000)
    assert struct.unpack("<3h", wav[44:]) == (0, 32767, -32768) and len(wav) == 50
    page = spark.createDataFrame([("t", "<p>", '{"x": "</script>"}')], "t string, r string, p string").select(writers.html_document(F.col("t"), F.col("r"), F.col("p"))).first()[0]
    assert page.count("</script>") == 1
    assert bytes(spark.createDataFrame([([0.5],)], "s array<float>").select(writers.wav(F.col("s"), F.lit(8000))).first()[0])[:4] == b"RIFF"


def test_context_language(spark):
    from turnmill.operators.terms import parse_context

    df = spark.createDataFrame([(1, "术语: Alpha、Beta；别名: alfa -> Alpha, b/c -> Beta\nnothing\nnames: x"), (2, "terms: " + ",".join(f"name{i}" for i in range(300)))], "id int, t string")
    rows = parse_context(df, "id", "t").collect()
    one = sorted((r.ord, r.kind, r.alias, r.canonical) for r in rows if r.id == 1)
    assert one == [(1, "term", None, "Alpha"), (2, "term", None, "Beta"), (3, "mapping", "alfa", "Alpha"), (4, "mapping", "b/c", "Beta")]
    assert sum(r.id == 2 for r in rows) == 200 and tx.END_SIGNS
