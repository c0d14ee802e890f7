"""Structured Streaming: greedy duplicate suppression of a journal stream, alert crossings, the two-clock loop."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def suppress_stream(entries: DataFrame, window_s: int = 120, keys: tuple[str, ...] = ("action", "file", "reason")) -> DataFrame:
    """The batch rule on a stream: an entry goes on only if the last *kept* one of its keys is over `window_s` older.

    The state of a key is one stamp; entries of a batch are taken in stamp order. State of a key is dropped once event
    time has passed its window, for which the stream needs a watermark on `stamp`.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema.fields)
    names = entries.columns

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        pdf = pd.concat(list(batches)).sort_values("stamp", kind="stable")
        stamps = pdf["stamp"].dt.tz_localize(None) if pdf["stamp"].dt.tz is not None else pdf["stamp"]
        kept = []
        for s in stamps:
            new = last is None or (s - last).total_seconds() > window_s
            kept.append(new)
            last = s if new else last
        state.update((int(last.value // 1000),))
        mark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(int(last.value // 1_000_000) + 1000 * (window_s + 1), mark + 1))
        yield pdf[kept][names]

    return entries.groupBy(*keys).applyInPandasWithState(keep, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def alert_crossings(live: DataFrame, journaled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new crossings, next state): an alert is journaled once while it lives, and again after it has cleared."""
    return live.join(journaled, ["file", "kind"], "left_anti"), live.select("file", "kind").distinct()


class TwoClocks:
    """A cheap pass on every tick, a heavy one when its interval has gone by. `clock` is injectable for tests."""

    def __init__(self, cheap: Callable[[], None], heavy: Callable[[], None], heavy_every_s: float, clock: Callable[[], float]):
        self.cheap, self.heavy, self.every, self.clock = cheap, heavy, heavy_every_s, clock
        self.last: float | None = None

    def tick(self) -> bool:
        now = self.clock()
        due = self.last is None or now - self.last >= self.every
        if due:
            self.heavy()
            self.last = now
        self.cheap()
        return due


def monitor(ticks: DataFrame, loop: TwoClocks, interval_s: int, checkpoint: str):
    """Run the loop on a rate source: one tick a micro-batch, at least a second apart."""
    return ticks.writeStream.trigger(processingTime=f"{max(1, interval_s)} seconds").option("checkpointLocation", checkpoint).foreachBatch(lambda d, i: loop.tick()).start()


def day_counts(entries: DataFrame, late: str = "1 day") -> DataFrame:
    """Journal entries per day on a stream, late ones up to `late`."""
    return entries.withWatermark("stamp", late).groupBy(F.window("stamp", "1 day").alias("w"), "action").agg(F.count("*").alias("n"))
