"""Per-code running state: exponential mean and drawdown without re-reading history."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "code string, date date, close double, ema double, peak double, drawdown double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State of the queries started inside is kept in RocksDB, beside the heap; the session's
    own setting is put back after."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class RunningState(StatefulProcessor):
    """Mean and peak of one code, in the order of dates.

    ``waiting`` holds bars in the order of dates until the watermark passes them, so a late bar
    inside the bound takes its place; a timer on the earliest of them releases what is due. It
    is one value a code, so a batch costs a read and a write of the state per code, not per bar.
    ``totals`` is four numbers. A code without a bar for ``keep_days`` of event time loses its
    state.
    """

    def __init__(self, span: int, keep_days: int):
        self.span, self.keep = span, keep_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "ema double, peak double, seen bigint, newest bigint")
        self.waiting = handle.getValueState("waiting", "at array<bigint>, day array<int>, close array<double>")

    def _held(self) -> list[tuple[int, int, float | None]]:
        return list(zip(*self.waiting.get(), strict=True)) if self.waiting.exists() else []

    def _hold(self, bars: list[tuple[int, int, float | None]]) -> None:
        if bars:
            self.waiting.update(tuple(list(part) for part in zip(*bars, strict=True)))
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = []
        for frame in rows:
            arrived += zip(frame["at"].tolist(), frame["seq"].tolist(), frame["day"].tolist(), frame["close"].tolist(), strict=True)
        if arrived:
            # One bar a session: the last by sequence.
            arrived.sort(key=lambda bar: bar[:2])
            bars = {bar[0]: bar for bar in self._held()}
            bars.update((at, (at, day, None if close is None or close != close else close)) for at, _, day, close in arrived)
            self._hold([bars[at] for at in sorted(bars)])
            self.handle.registerTimer(arrived[0][0])
            self.handle.registerTimer(arrived[-1][0] + self.keep)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        due = bisect_right(held, now, key=lambda bar: bar[0])
        if due:
            if len(held) > due:
                self.handle.registerTimer(held[due][0])
            self._hold(held[due:])
            yield self._released(key[0], held[:due])
        elif held:
            self.handle.registerTimer(held[0][0])
        elif self.totals.exists() and self.totals.get()[3] + self.keep <= now:
            self.totals.clear()

    def _released(self, code: str, due: list[tuple[int, int, float | None]]) -> pd.DataFrame:
        ema, peak, seen, _ = self.totals.get() if self.totals.exists() else (None, None, 0, 0)
        share = 2.0 / (self.span + 1)
        means, peaks, drawdowns = [], [], []
        # A bar without a close carries the values on.
        for _, _, close in due:
            if close is not None:
                ema = close if ema is None else ema * (1 - share) + close * share
                peak = close if peak is None else max(peak, close)
                seen += 1
            means.append(ema if seen >= self.span else None)
            peaks.append(peak)
            drawdowns.append(None if close is None else close / peak - 1)
        self.totals.update((ema, peak, seen, due[-1][0]))
        days = pd.Series(np.array([bar[1] for bar in due], dtype="datetime64[D]").astype(object))
        numbers = {"close": [bar[2] for bar in due], "ema": means, "peak": peaks, "drawdown": drawdowns}
        return pd.DataFrame({"code": code, "date": days, **{name: np.array(x, dtype=float) for name, x in numbers.items()}})

    def close(self) -> None:
        pass


def running_state(bars: DataFrame, span: int = 12, late: str = "35 days", keep_days: int = 3650) -> DataFrame:
    """Running mean and drawdown of each code over streamed bars (ST3).

    ``bars``: ``code, date, seq, close``; a row comes out once the watermark, ``late`` behind
    the newest date, has passed it. Later bars are dropped, and counted in the progress of the
    query. To be started inside ``rocksdb``.
    """
    rows = bars.select("code", F.unix_date("date").alias("day"), "seq", "close", F.col("date").cast("timestamp").alias("ts"))
    rows = rows.withColumn("at", F.unix_millis("ts")).withWatermark("ts", late)
    return rows.groupBy("code").transformWithStateInPandas(
        statefulProcessor=RunningState(span, keep_days), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime"
    )
