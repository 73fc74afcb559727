"""Keyed state over streams: follow-up timers and the exact throttle."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from jobloom import lexicons as lx
from jobloom.operators.throttle import accept

DAY_MS = 86_400_000
BUCKETS = 1024
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FollowUpTimers(StatefulProcessor):
    """Emits ``follow_up`` after 7 days and ``ghosted`` after 14 without news.

    A key is a bucket of applications: its state lists those that wait, each
    with its start and what is due next, and one timer stands at the earliest.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "ids array<long>, starts array<long>, due array<long>")

    def _read(self) -> dict[int, tuple[int, int]]:
        ids, starts, due = self.waiting.get() if self.waiting.exists() else ((), (), ())
        return {i: (start, at) for i, start, at in zip(ids, starts, due)}

    def _write(self, waiting: dict[int, tuple[int, int]]) -> None:
        if waiting:
            self.waiting.update((list(waiting), [start for start, _ in waiting.values()], [at for _, at in waiting.values()]))
        else:
            self.waiting.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if waiting:
            self.handle.registerTimer(min(at for _, at in waiting.values()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changes = []
        for pdf in rows:
            changes += zip(pdf["saved_id"].tolist(), pdf["seq"].tolist(), pdf["status"].tolist(), pdf["changed_ms"].tolist())
        waiting = self._read()
        for i, _, status, ms in sorted(changes):
            if status == "applied":
                start = waiting[i][0] if i in waiting else ms
                waiting[i] = (start, start + lx.FOLLOW_UP_DAYS * DAY_MS)
            else:
                waiting.pop(i, None)
        self._write(waiting)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, waiting, events = timerValues.getCurrentWatermarkInMs(), self._read(), []
        for i, (start, at) in list(waiting.items()):
            ghosted = start + lx.GHOSTED_DAYS * DAY_MS
            if at < ghosted and at <= now:
                events.append((i, "follow_up", at))
                at = ghosted
                waiting[i] = (start, at)
            if at == ghosted and at <= now:
                events.append((i, "ghosted", at))
                del waiting[i]
        self._write(waiting)
        return iter([pd.DataFrame(events, columns=["saved_id", "event", "at_ms"])] if events else [])

    def close(self) -> None:
        pass


def followup_events(changes: DataFrame, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """(saved_id, event, at_ms) from a stream of status changes.

    ``changes`` has saved_id, seq, status and changed_at; timers follow the
    event clock, which the watermark on ``changed_at`` drives.  State is kept
    by ``buckets`` of saved_id, so that it is read and written once per bucket
    and batch and not once per application; their number is fixed for a
    checkpoint.
    """
    rows = changes.withWatermark("changed_at", late).withColumn("changed_ms", F.unix_millis("changed_at"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("saved_id"), F.lit(buckets)))
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=FollowUpTimers(), outputStructType="saved_id long, event string, at_ms long",
        outputMode="Append", timeMode="EventTime")


class Throttle(StatefulProcessor):
    """At most ``limit`` accepted events per trailing period and key."""

    def __init__(self, limit: int, period: int):
        self.limit, self.period = limit, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "secs array<long>, counts array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        per_second = {}
        for pdf in rows:
            for sec, n in pdf.groupby("sec").size().items():
                per_second[int(sec)] = per_second.get(int(sec), 0) + int(n)
        seconds = sorted(per_second)
        old = self.recent.get() if self.recent.exists() else ([], [])
        state = list(zip(old[0], old[1]))
        counts = [per_second[s] for s in seconds]
        taken = accept(seconds, counts, state, self.limit, self.period)
        self.recent.update(([int(s) for s, _ in state], [int(m) for _, m in state]))
        yield pd.DataFrame({"key": [key[0]] * len(seconds), "sec": seconds, "n": counts, "accepted": taken})

    def close(self) -> None:
        pass


def throttle_stream(events: DataFrame, limit: int, period: int) -> DataFrame:
    """(key, sec, n, accepted) per micro-batch; equals the batch rule when
    events arrive in time order."""
    rows = events.withColumn("sec", F.unix_seconds("ts")).select("key", "sec")
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Throttle(limit, period), outputStructType="key long, sec long, n long, accepted long",
        outputMode="Append", timeMode="None")
