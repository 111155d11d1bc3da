"""Windows of change events with state and timers: debounced, capped, forced by control messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.debounce import CAP_MS, DELTA_PATHS, GAP_MS

WINDOWS = "key string, first timestamp, last timestamp, events long, reason string, full_scan boolean, paths array<string>"
#: The state store that timers and several states of a key need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(t: pd.Timestamp) -> int:
    return t.value // 1_000_000


class ChangeWindows(StatefulProcessor):
    """One open window for each key: its first and last event, their number, and its distinct paths.

    A window fires `gap` after its last event or `cap` after its first one, by a timer or by the first event beyond; or at once, by a
    control message. Repeats of a path extend the window without another entry. Beyond `most` paths none are kept, and everything is to be scanned.
    """

    def __init__(self, gap_ms: int, cap_ms: int, most: int) -> None:
        self.gap, self.cap, self.most = gap_ms, cap_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "first long, last long, events long, kept long, timer long")
        self.paths = handle.getMapState("paths", "path string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        out = []
        part = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "control", "path"], kind="stable")
        now = self.window.get() if self.window.exists() else None
        first, last, events, kept, timer = now or (None, None, 0, 0, None)
        held = {k[0]: v[0] for k, v in self.paths.iterator()} if now and kept <= self.most else {}

        def fire(reason: str) -> None:
            nonlocal first, last, events, kept, held
            full = kept > self.most
            out.append((key[0], first, last, events, reason, full, [] if full else sorted(held)))
            first, last, events, kept, held = None, None, 0, 0, {}

        for at, path, control in zip(map(_ms, part["ts"]), part["path"], part["control"], strict=True):
            if first is not None and at > min(last + self.gap, first + self.cap):
                fire("cap" if first + self.cap < last + self.gap else "gap")
            if control:
                first, last = first if first is not None else at, at
                fire("forced")
                continue
            first, last, events = first if first is not None else at, at, events + 1
            if kept <= self.most and path not in held:
                kept += 1
                held[path] = at
        # an open window is stored with a timer for its deadline
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.paths.clear()
        if first is None:
            self.window.clear()
        else:
            deadline = max(min(last + self.gap, first + self.cap), timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(deadline)
            self.window.update((first, last, events, kept, deadline))
            if kept <= self.most:
                for path, at in held.items():
                    self.paths.updateValue((path,), (at,))
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        first, last, events, kept, _ = self.window.get()
        full = kept > self.most
        paths = [] if full else sorted(k[0] for k in self.paths.keys())
        self.window.clear()
        self.paths.clear()
        yield self._rows([(key[0], first, last, events, "cap" if first + self.cap < last + self.gap else "gap", full, paths)])

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in WINDOWS.split(", ")])
        return out.assign(first=pd.to_datetime(out["first"], unit="ms"), last=pd.to_datetime(out["last"], unit="ms"))


def change_windows(events: DataFrame, gap_ms: int = GAP_MS, cap_ms: int = CAP_MS, most: int = DELTA_PATHS, late: str = "1 second") -> DataFrame:
    """key, first, last, events, reason (gap, cap or forced), full_scan, paths: windows of a stream of events (key, path, ts, control).

    * An event with `control` set fires its key's window at once, also an empty one; it is no change itself. A null control is none, a null path
      is the empty one; an event with a null time, or later than the watermark allows, is left out. Times count in milliseconds.
    * paths are the distinct ones in order, none where full_scan says that there were more than `most`.
    * A key's open window is all of its state, `most` paths at most. The session has to name STATE_STORE in
      spark.sql.streaming.stateStore.providerClass, and states outlive restarts in the query's checkpoint.
    """
    rows = events.select("key", F.coalesce("path", F.lit("")).alias("path"), "ts", F.coalesce("control", F.lit(False)).alias("control")).where("ts IS NOT NULL")
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(ChangeWindows(gap_ms, cap_ms, most), WINDOWS, "Append", "EventTime")
