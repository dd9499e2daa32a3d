"""Chunked audio as a stream: tumbling windows on event time, and resampling.

The state of a recording is what stands in the open window (at most one window
of samples) and where the next sample belongs.  Small gaps are filled with
silence, larger ones end the window; samples that come again are trimmed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW = "recording_id string, start_seconds double, duration_seconds double, samples array<float>"


@dataclass
class Windower:
    """Tumbling windows of ``seconds``; ``push`` and ``finish`` give finished ones as ``(start, samples)``."""

    rate: float
    seconds: float
    start: float = 0.0
    gap: float = 0.25
    frame: int = field(init=False)
    held: np.ndarray = field(init=False)

    def __post_init__(self):
        if not (self.rate > 0 and self.seconds > 0):
            raise ValueError("the rate and the window must be positive")
        self.size = max(1, math.floor(self.seconds * self.rate + 0.5))
        self.frame = max(0, math.floor(self.start * self.rate + 0.5))  # of the first sample held
        self.held = np.zeros(0, np.float32)

    def push(self, samples, start: float) -> list[tuple[float, np.ndarray]]:
        samples = np.asarray(samples, np.float32)
        at = max(0, math.floor(start * self.rate + 0.5))
        ahead = at - (self.frame + len(self.held))
        out = []
        if ahead > math.floor(self.gap * self.rate + 0.5):
            out = self.finish()
            self.frame = at
        elif ahead > 0:
            samples = np.concatenate([np.zeros(ahead, np.float32), samples])
        else:
            samples = samples[-ahead:] if ahead else samples
        self.held = np.concatenate([self.held, samples])
        while len(self.held) >= self.size:
            out.append(self._take(self.size))
        return out

    def finish(self) -> list[tuple[float, np.ndarray]]:
        return [self._take(len(self.held))] if len(self.held) else []

    def _take(self, n: int) -> tuple[float, np.ndarray]:
        out = (self.frame / self.rate, self.held[:n])
        self.frame, self.held = self.frame + n, self.held[n:]
        return out


@dataclass
class Resampler:
    """Linear resampling whose grid goes on from batch to batch and begins anew after a jump."""

    source: float
    target: float
    next: int | None = None
    last: tuple[float, float] | None = None  # time and value of the last sample

    def push(self, samples, start: float) -> tuple[float, np.ndarray] | None:
        samples = np.asarray(samples, np.float64)
        if not len(samples):
            return None
        times = start + np.arange(len(samples)) / self.source
        last = (times[-1], samples[-1])
        if self.last is not None and abs(start - self.last[0] - 1 / self.source) <= 0.5 / self.source:
            samples = np.concatenate([[self.last[1]], samples])
            times = self.last[0] + np.arange(len(samples)) / self.source
        if self.next is None or self.next / self.target < times[0] - 0.5 / self.target:
            self.next = max(0, math.ceil(times[0] * self.target - 1e-7))
        end = times[0] + (len(samples) - 1) / self.source
        first, n = self.next, max(0, math.floor(end * self.target + 1e-7) - self.next + 1)
        self.next, self.last = first + n, last
        if not n:
            return None
        at = (first + np.arange(n)) / self.target
        return first / self.target, np.interp((at - times[0]) * self.source, np.arange(len(samples)), samples).astype(np.float32)


def resample(samples, source: float, target: float) -> np.ndarray:
    """A whole recording at another rate."""
    samples = np.asarray(samples, np.float64)
    n = max(1, math.floor(len(samples) * target / source + 0.5))
    return np.interp(np.arange(n) * source / target, np.arange(len(samples)), samples).astype(np.float32)


def downmix(samples, channels: int) -> np.ndarray:
    """The mean of the channels of interleaved samples."""
    a = np.asarray(samples, np.float32)
    return a[: len(a) // channels * channels].reshape(-1, channels).mean(1)


def _frame(recording: str, windows: list[tuple[float, np.ndarray]], rate: float) -> pd.DataFrame:
    return pd.DataFrame({"recording_id": [recording] * len(windows), "start_seconds": [s for s, _ in windows], "duration_seconds": [len(p) / rate for _, p in windows], "samples": [p.tolist() for _, p in windows]})


def window_batch(chunks: DataFrame, rate: float, seconds: float) -> DataFrame:
    """T1 over a table of ``recording_id, start_seconds, samples``: a recording's chunks in order of time."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        w, out = Windower(rate, seconds), []
        for start, samples in group.sort_values("start_seconds", kind="stable")[["start_seconds", "samples"]].itertuples(index=False):
            out += w.push(samples, start)
        return _frame(group["recording_id"].iloc[0], [*out, *w.finish()], rate)

    return chunks.select("recording_id", "start_seconds", "samples").groupBy("recording_id").applyInPandas(work, WINDOW)


def window_stream(chunks: DataFrame, rate: float, seconds: float, idle_ms: int = 4000) -> DataFrame:
    """T1, T8, T9 on a stream: finished windows as they fill; a recording idle for ``idle_ms`` is flushed and forgotten."""

    def work(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        w = Windower(rate, seconds)
        if state.exists:
            frame, held = state.get
            w.frame, w.held = frame, np.asarray(held, np.float32)
        if state.hasTimedOut:
            state.remove()
            yield _frame(key[0], w.finish(), rate)
            return
        rows = pd.concat(list(groups)).sort_values("start_seconds", kind="stable")
        out = []
        for start, samples in rows[["start_seconds", "samples"]].itertuples(index=False):
            out += w.push(samples, start)
        state.update((w.frame, w.held.tolist()))
        state.setTimeoutDuration(idle_ms)
        yield _frame(key[0], out, rate)

    return chunks.select("recording_id", "start_seconds", "samples").groupBy("recording_id").applyInPandasWithState(
        work, WINDOW, "frame bigint, held array<float>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
