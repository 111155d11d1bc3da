"""Streams of change events: debouncing, deduplication, tuning, and incremental index cycles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.paths import is_secret_file
from tessera.sources.files import IGNORED

# Quiet gap and longest batch in milliseconds, changed paths beyond which everything is scanned.
GAP_MS, CAP_MS, DELTA_PATHS = 750, 3000, 512
BATCHES = "key string, first timestamp, last timestamp, events long"


def relevant(events: DataFrame) -> DataFrame:
    """Events (path, ts) of files that may be indexed."""
    return events.where(~is_secret_file(F.col("path")) & ~F.exists(F.split("path", "/"), lambda p: p.isin(*IGNORED)))


def split_batches(times: list[pd.Timestamp], gap: pd.Timedelta, cap: pd.Timedelta) -> Iterator[tuple[pd.Timestamp, pd.Timestamp, int]]:
    """Batches of sorted times: one fires when its gap or its cap has passed, whichever is first; repeats extend it too."""
    first = last = None
    n = 0
    for t in times:
        if first is not None and t > min(last + gap, first + cap):
            yield first, last, n
            first, n = None, 0
        first, last, n = (t if first is None else first), t, n + 1
    if n:
        yield first, last, n


def debounce_batch(events: DataFrame, gap_ms: int = GAP_MS, cap_ms: int = CAP_MS) -> DataFrame:
    """key, first, last, events: the batches of each key's events (key, ts), over a finished table.

    Sessions by the gap are built by Spark; only a session longer than the cap has to be walked through.
    """
    order = W.partitionBy("key").orderBy("ts")
    quiet = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order)) > gap_ms * 1000
    session = F.sum(F.when(quiet, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0))
    marked = events.select("key", "ts", session.alias("session"))
    gap, cap = pd.Timedelta(milliseconds=gap_ms), pd.Timedelta(milliseconds=cap_ms)
    whole = marked.groupBy("key", "session").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("events"))
    short = F.unix_micros("last") - F.unix_micros("first") <= cap_ms * 1000

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        rows = list(split_batches(sorted(part["ts"]), gap, cap))
        return pd.DataFrame([(part["key"].iloc[0], *r) for r in rows], columns=["key", "first", "last", "events"])

    long = marked.join(whole.where(~short).select("key", "session"), ["key", "session"], "left_semi")
    return whole.where(short).select("key", "first", "last", "events").unionByName(long.groupBy("key", "session").applyInPandas(walk, BATCHES))


def debounce_stream(events: DataFrame, gap_ms: int = GAP_MS, cap_ms: int = CAP_MS, late: str = "1 second") -> DataFrame:
    """As debounce_batch() over a stream: a batch is given out once the watermark has passed its deadline."""
    gap, cap = pd.Timedelta(milliseconds=gap_ms), pd.Timedelta(milliseconds=cap_ms)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [pd.Timestamp(x) for x in state.get[0]] if state.exists else []
        times = sorted([*held, *(t for p in parts for t in p["ts"])])
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        done, open_ = [], []
        at = 0
        for first, last, n in split_batches(times, gap, cap):
            if min(last + gap, first + cap) <= mark:
                done.append((key[0], first, last, n))
            else:
                open_ += times[at : at + n]
            at += n
        if open_:
            state.update(([t.isoformat() for t in open_],))
            first, last, _ = next(split_batches(open_, gap, cap))
            state.setTimeoutTimestamp(max(int(min(last + gap, first + cap).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(done, columns=["key", "first", "last", "events"])

    grouped = events.withWatermark("ts", late).groupBy("key")
    return grouped.applyInPandasWithState(step, BATCHES, "times array<string>", "append", "EventTimeTimeout")


def dedup_stream(events: DataFrame, keys: list[str], within: str = "750 milliseconds") -> DataFrame:
    """The first event of each key within the time that the watermark keeps."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def repeats_dropped(events: DataFrame, keys: list[str], within_ms: int) -> DataFrame:
    """Batch form: an event that follows one of its key within the time is dropped."""
    before = F.lag("ts").over(W.partitionBy(*keys).orderBy("ts", "event_id"))
    return events.withColumn("_b", before).where(F.col("_b").isNull() | (F.unix_micros("ts") - F.unix_micros("_b") > within_ms * 1000)).drop("_b")


@dataclass
class Tuner:
    """Adapts the debounce to the load: three levels, up at once, down by one after three quiet cycles."""

    level: int = 0
    quiet: int = 0

    LEVELS = ((750, 3000), (1500, 6000), (3000, 12_000))

    def after_cycle(self, p95_ms: int | None, pending: int, success: bool) -> tuple[int, int]:
        """(gap, cap) in milliseconds for the next cycle."""
        wanted = max(0 if p95_ms is None else (p95_ms >= 2000) + (p95_ms >= 8000), (pending >= 64) + (pending >= 256), 0 if success else 1)
        if wanted >= self.level:
            self.level, self.quiet = wanted, 0
        else:
            self.quiet += 1
            if self.quiet >= 3:
                self.level, self.quiet = self.level - 1, 0
        return self.LEVELS[self.level]


def run_cycles(spark: SparkSession, batches: DataFrame, cycle: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs an index cycle for every micro-batch of a stream of batches, once for all that is there; cycles must be idempotent by their number."""
    return batches.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
