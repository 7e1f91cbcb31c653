"""ST2 with keyed state: the saturation of every training run as its rows arrive.

A run's state is its settled summary (steps, first saturated step and value, broken
steps, last value) and the rows that may still be overtaken.  Rows come in any
order; those up to the watermark are settled in the order of (time, id), so a late
row within ``LATE`` takes its place.  Every batch writes, for the runs it touched,
the settled summary carried on over the waiting rows.  A timer settles a run that
gets no further rows, and one ``IDLE`` after its last row drops its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How late a row may come, and how long after a run's last row its state stays.
LATE, IDLE_DAYS = "1 day", 365

_DAY_MS = 86_400_000
_SUMMARY = "n long, first_sat long, sat_value double, n_broken long, last_broken long, last_value double, last_ms long"
_WAITING = "ms long, us long, event_id long, value double"
RESULT = ("run long, n_steps long, first_sat_step long, sat_value double, n_broken long, last_broken_step long, "
          "last_value double")
_START = (0, None, None, 0, None, None, 0)


def advance(summary: tuple, rows: list[tuple], threshold: float) -> tuple:
    """The summary after rows (ms, us, event_id, value) in order.  Steps count from
    0; null values are steps without a measure."""
    n, first, at_first, broken, last_broken, last, last_ms = summary
    for ms, _, _, value in rows:
        if value is not None and value == value:
            if first is None:
                if value > threshold:
                    first, at_first = n, value
            elif value < threshold:
                broken, last_broken = broken + 1, n
            last = value
        n, last_ms = n + 1, ms
    return n, first, at_first, broken, last_broken, last, last_ms


class RunSaturation(StatefulProcessor):
    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.summary = handle.getValueState("summary", _SUMMARY)
        self.waiting = handle.getListState("waiting", _WAITING)

    def _settle(self, watermark: int, new: list[tuple]) -> tuple[tuple, list[tuple]]:
        """Settles what the watermark has passed; the summary and the rows left."""
        rows = sorted([tuple(r) for r in self.waiting.get()] + new, key=lambda r: r[1:3])
        done = [r for r in rows if r[0] <= watermark]
        left = rows[len(done):]
        summary = advance(tuple(self.summary.get() or _START), done, self.threshold)
        if done:
            self.summary.update(summary)
        if done or new:
            self.waiting.clear()
            if left:
                self.waiting.put(left)
        return summary, left

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in rows:
            values = part["value"].astype(object).where(part["value"].notna(), None)
            new += list(zip((part["us"] // 1000).tolist(), part["us"].tolist(), part["event_id"].tolist(), values.tolist()))
        summary, left = self._settle(timerValues.getCurrentWatermarkInMs(), new)
        if left:
            self.handle.registerTimer(left[-1][0] + 1)
        n, first, at_first, broken, last_broken, last, _ = advance(summary, left, self.threshold)
        yield pd.DataFrame({"run": [key[0]], "n_steps": [n], "first_sat_step": pd.array([first], "Int64"),
                            "sat_value": pd.array([at_first], "Float64"), "n_broken": [broken],
                            "last_broken_step": pd.array([last_broken], "Int64"), "last_value": pd.array([last], "Float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        summary, left = self._settle(watermark, [])
        if not left:
            quiet = summary[6] + IDLE_DAYS * _DAY_MS
            if watermark >= quiet:
                self.summary.clear()
                self.waiting.clear()
            else:
                self.handle.registerTimer(quiet)
        return iter([])

    def close(self) -> None:
        pass


def saturation(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows``: a stream of run, event_id, ts (an instant) and value."""
    stream = (rows.withColumn("us", F.unix_micros("ts")).withWatermark("ts", LATE)
              .select("run", "event_id", "ts", "us", "value"))
    return stream.groupBy("run").transformWithStateInPandas(
        RunSaturation(threshold), outputStructType=RESULT, outputMode="Update", timeMode="EventTime")
