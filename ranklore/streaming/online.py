"""Online quantiles, latency summaries and cancellation."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class P2Quantile:
    """The P-square estimator of one quantile: five markers, moved by parabolas, no samples kept.

    Until five values have come the exact (nearest-rank) quantile of them is told."""

    def __init__(self, share: float):
        if not 0.0 < share < 1.0:
            raise ValueError("a share lies between 0 and 1")
        self.share, self.heights, self.places = share, [], [0, 1, 2, 3, 4]
        self.wanted = [0.0, 2 * share, 4 * share, 2 + 2 * share, 4.0]

    def add(self, x: float) -> None:
        h, n = self.heights, self.places
        if len(h) < 5:
            h.append(float(x))
            h.sort()
            return
        if x < h[0]:
            h[0], cell = float(x), 0
        elif x >= h[4]:
            h[4], cell = float(x), 3
        else:
            cell = next(i for i in range(4) if x < h[i + 1])
        for i in range(cell + 1, 5):
            n[i] += 1
        for i, step in enumerate((0.0, self.share / 2, self.share, (1 + self.share) / 2, 1.0)):
            self.wanted[i] += step
        for i in (1, 2, 3):
            off = self.wanted[i] - n[i]
            if (off >= 1 and n[i + 1] - n[i] > 1) or (off <= -1 and n[i - 1] - n[i] < -1):
                self._move(i, 1 if off > 0 else -1)

    def _move(self, i: int, by: int) -> None:
        h, n = self.heights, self.places
        up, down = (h[i + 1] - h[i]) / (n[i + 1] - n[i]), (h[i] - h[i - 1]) / (n[i] - n[i - 1])
        curve = h[i] + by / (n[i + 1] - n[i - 1]) * ((n[i] - n[i - 1] + by) * up + (n[i + 1] - n[i] - by) * down)
        h[i] = curve if h[i - 1] < curve < h[i + 1] else h[i] + by * (h[i + by] - h[i]) / (n[i + by] - n[i])
        n[i] += by

    @property
    def value(self) -> float | None:
        if len(self.heights) < 5:
            return self.heights[min(int(self.share * len(self.heights)), len(self.heights) - 1)] if self.heights else None
        return self.heights[2]


class OnlineStats:
    """count, min, max, average and online quantiles of a stream of numbers; its state is a short text."""

    def __init__(self, shares: Iterable[float] = (0.5, 0.95, 0.99)):
        self.count, self.total, self.low, self.high = 0, 0.0, None, None
        self.quantiles = [P2Quantile(q) for q in shares]

    def add(self, values: Iterable[float]) -> OnlineStats:
        for x in values:
            self.count, self.total = self.count + 1, self.total + x
            self.low = x if self.low is None else min(self.low, x)
            self.high = x if self.high is None else max(self.high, x)
            for q in self.quantiles:
                q.add(x)
        return self

    def row(self) -> list:
        return [self.count, self.low, self.high, self.total / self.count if self.count else None, *[q.value for q in self.quantiles]]

    def dump(self) -> str:
        told = vars(self) | {"quantiles": [vars(q) for q in self.quantiles]}
        return json.dumps(told)

    @classmethod
    def load(cls, text: str) -> OnlineStats:
        told = json.loads(text)
        made = cls(())
        made.quantiles = []
        for state in told.pop("quantiles"):
            q = P2Quantile(state["share"])
            vars(q).update(state)
            made.quantiles.append(q)
        vars(made).update(told)
        return made


def online_quantiles(stream: DataFrame, group: str, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """group, count, min, max, avg, q0, q1, ... of all values so far, one row a group that got some, in update mode.

    The state of a group is its markers: a few hundred bytes whatever has passed."""
    names = [f"q{i}" for i in range(len(shares))]
    kind = stream.schema[group].dataType.simpleString()
    out = f"{group} {kind}, count bigint, min double, max double, avg double, " + ", ".join(f"{n} double" for n in names)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stats = OnlineStats.load(state.get[0]) if state.exists else OnlineStats(shares)
        for frame in frames:
            stats.add(frame[value].dropna().astype(float).tolist())
        state.update((stats.dump(),))
        yield pd.DataFrame([[key[0], *stats.row()]], columns=[group, "count", "min", "max", "avg", *names])

    return stream.select(group, value).groupBy(group).applyInPandasWithState(update, out, "state string", "update", GroupStateTimeout.NoTimeout)


def summarize_latency(ns: list[int]) -> dict[str, float]:
    """Average and nearest-rank 95th and 99th percentile of timings."""
    if not ns:
        return {"avg": 0.0, "p95": 0.0, "p99": 0.0}
    held = sorted(ns)
    at = lambda q: float(held[max(0, -(-int(q * len(held) * 100) // 100) - 1)])
    return {"avg": sum(held) / len(held), "p95": at(0.95), "p99": at(0.99)}


def measure_latency(call: Callable[[int], object], times: int) -> dict[str, float]:
    """Timings of ``call(0)``, ``call(1)``, ... after one call that is not counted."""
    call(0)
    out = []
    for i in range(times):
        begun = time.perf_counter_ns()
        call(i)
        out.append(time.perf_counter_ns() - begun)
    return summarize_latency(out)


class Cancelled(RuntimeError):
    """Work that was stopped by its deadline or on demand."""


@contextmanager
def interruptible(spark: SparkSession, seconds: float | None = None) -> Iterator[Callable[[], None]]:
    """Jobs started inside belong together; the yielded function stops them, as does the deadline.

    Stopped jobs raise ``Cancelled``. Other jobs of the session go on."""
    context, group = spark.sparkContext, f"ranklore-{time.monotonic_ns()}"
    held = [(k, context.getLocalProperty(k)) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")]
    stopped = threading.Event()

    def stop() -> None:
        stopped.set()
        context.cancelJobGroup(group)

    context.setJobGroup(group, group, interruptOnCancel=True)
    timer = threading.Timer(seconds, stop) if seconds else None
    if timer:
        timer.daemon = True
        timer.start()
    try:
        yield stop
    except Exception as error:
        if stopped.is_set():
            raise Cancelled("stopped before the end") from error
        raise
    finally:
        if timer:
            timer.cancel()
        for name, value in held:
            context.setLocalProperty(name, value)
