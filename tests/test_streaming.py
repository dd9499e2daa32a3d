import time

import numpy as np
import pytest

from turnmill.streaming.pcm import Resampler, Windower, downmix, resample, window_batch, window_stream


def test_windows():
    w = Windower(10, 1.0)
    assert w.push(np.ones(5), 0.0) == []
    [(start, pcm)] = w.push(np.ones(5), 0.6)  # a gap of one frame is silence
    assert start == 0.0 and pcm.tolist() == [1] * 5 + [0] + [1] * 4
    assert w.push(np.full(4, 2.0), 0.9) == []  # two frames come again and are trimmed
    out = w.push(np.ones(3), 5.0)  # a large gap ends the window
    assert [(s, len(p)) for s, p in out] == [(1.0, 3)]
    assert [(s, len(p)) for s, p in w.finish()] == [(5.0, 3)]
    assert [len(p) for _, p in Windower(10, 1.0).push(np.ones(35), 0.0)] == [10, 10, 10]
    with pytest.raises(ValueError):
        Windower(0, 1)


def test_resampling_does_not_depend_on_the_batches():
    x = np.sin(np.arange(4800) / 30)
    whole = Resampler(48000, 16000).push(x, 0.0)[1]
    r, parts = Resampler(48000, 16000), []
    for a, b in [(0, 1000), (1000, 1001), (1001, 3333), (3333, 4800)]:
        out = r.push(x[a:b], a / 48000)
        if out is not None:
            parts.append(out[1])
    assert np.allclose(np.concatenate(parts), whole, atol=1e-5)
    r = Resampler(4, 2)
    r.push([0, 1, 2, 3], 0.0)
    start, out = r.push([5, 6, 7, 8], 10.0)
    assert start == 10.0 and out.tolist() == [5, 7]
    assert len(resample(np.ones(10), 10, 5)) == 5 and downmix([1, 3, 5, 7], 2).tolist() == [2, 6]


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    schema = "recording_id string, start_seconds double, samples array<float>"
    rows = [(r, i * 0.5, [float(i)] * 5) for r in ("a", "b") for i in range(9)]
    folder = tmp_path / "in"
    for k in range(0, 9, 3):
        spark.createDataFrame([x for x in rows if k * 0.5 <= x[1] < (k + 3) * 0.5], schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = window_stream(stream, 10, 2.0, idle_ms=1).writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(processingTime="200 milliseconds").start()
    want = {(r.recording_id, r.start_seconds, tuple(r.samples)) for r in window_batch(spark.createDataFrame(rows, schema), 10, 2.0).collect()}
    try:
        for _ in range(240):
            got = {(r.recording_id, r.start_seconds, tuple(r.samples)) for r in spark.table("windows").collect()}
            full = {x for x in want if len(x[2]) == 20}
            if full <= got:
                break
            time.sleep(0.25)
    finally:
        q.stop()
    assert full <= got and len(want) == 6
