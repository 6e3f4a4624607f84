"""Funnels of visits: arbitrary state by key, with timers of event time.

A visit is a key's rows without a pause of over `gap`. How far it came is the number of steps that it reached in their order,
which no window aggregate can tell. Rows wait in the key's state until the watermark has passed them, so that they are
taken in the order of their times however they arrived; a visit comes when the watermark has passed its last row by the gap.
State is a row for each that waits and one for the open visit; it lives in RocksDB, with the stream's checkpoints. A task
holds what waits of one key: what the key gets within a batch and the delay, so batches bound it (files_per_batch).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.tables import clock, event_time

ROWS = "at long, step string"
VISIT = "first long, last long, n long, reached int"


class Visits(StatefulProcessor):
    """One key's rows to visits; times in microseconds."""

    def __init__(self, steps: tuple[str, ...], gap: int):
        self.steps, self.gap = steps, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROWS)
        self.open = handle.getValueState("open", VISIT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found, least = False, None
        for part in rows:
            self.waiting.appendList(list(zip(part["at"].astype("int64").tolist(), part["step"].tolist())))
            found, least = True, min(int(part["at"].min()), least) if found else int(part["at"].min())
        if found:
            self._wake(least)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get(), key=lambda r: (r[0], r[1] or ""))
        ready = [r for r in waiting if r[0] <= seen]
        visit = list(self.open.get()) if self.open.exists() else None
        done = []
        for at, step in ready:
            if visit is not None and at - visit[1] > self.gap:
                done.append(visit)
                visit = None
            if visit is None:
                visit = [at, at, 0, 0]
            visit[1], visit[2] = at, visit[2] + 1
            if visit[3] < len(self.steps) and step == self.steps[visit[3]]:
                visit[3] += 1
        if visit is not None and visit[1] + self.gap < seen:
            done.append(visit)
            visit = None
        left = waiting[len(ready) :]
        if left:
            self.waiting.put(left)
            self._wake(left[0][0])
        else:
            self.waiting.clear()
        if visit is None:
            self.open.clear()
        else:
            self.open.update(tuple(visit))
            self._wake(visit[1] + self.gap)
        if done:
            yield pd.DataFrame([(*key, *v) for v in done], columns=["key", "first", "last", "n", "reached"])

    def close(self) -> None:
        pass

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(micros // 1000 + 1)


def funnels(events: DataFrame, key_col: str, time_col: str, step_col: str, steps: tuple[str, ...], gap_seconds: int, delay: str) -> DataFrame:
    """key, visit_start, visit_end (its last row), n_events, n_steps (how many of steps the visit reached in their order) of a stream, in append mode.

    Rows of one time count in the order of their steps' names; rows with a null key or time belong to no visit; a row that comes
    after the watermark has passed it still joins what is open then, as one more row in its key's order of arrival.
    The stream needs its state in RocksDB: run it with drain(..., settings=ROCKSDB).
    """
    rows = event_time(events, time_col).where(F.col(key_col).isNotNull() & F.col(time_col).isNotNull())
    kind = rows.schema[key_col].dataType.simpleString()
    rows = rows.withWatermark(time_col, delay).select(F.col(key_col).alias("key"), F.col(time_col).alias("time"), F.unix_micros(F.col(time_col)).alias("at"), F.col(step_col).cast("string").alias("step"))
    out = rows.groupBy("key").transformWithStateInPandas(Visits(tuple(steps), gap_seconds * 1_000_000), f"key {kind}, first long, last long, n long, reached int", "Append", "EventTime")
    return out.select(F.col("key").alias(key_col), clock(F.timestamp_micros("first")).alias("visit_start"), clock(F.timestamp_micros("last")).alias("visit_end"), F.col("n").alias("n_events"), F.col("reached").alias("n_steps"))
