"""The stage queue as a streaming query: the batch replay's transitions over keyed state, leases as timers.

Time is the events' own: a timer stands at each lease's end, and when the stream's watermark has passed it the run is
taken back, whether or not another event of the run ever comes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.stage_queue import LEASE_MS, MAX_ATTEMPTS, RUN, Run

_STATE = "state string, attempts int, due_ms long, lease_ms long, error_class string, error_code string, finished_ms long, token string, version long"
#: What the stream gives: runs, and how often each has been given.
VERSIONED = f"{RUN}, version long"
_NAMES = [c.split()[0] for c in VERSIONED.split(", ")]


class Runs(StatefulProcessor):
    def __init__(self, lease_ms: int = LEASE_MS, max_attempts: int = MAX_ATTEMPTS):
        self.lease_ms, self.most = lease_ms, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", _STATE)

    def _load(self) -> tuple[Run, int]:
        if (held := self.run.get()) is None:
            return Run(), 0
        *fields, version = held
        return Run(*fields), version

    def _given(self, key, run: Run, version: int, timers: list[int]) -> Iterator[Row]:
        """``timers`` are those that stand; one that stays is left alone, since each call is a message to the JVM."""
        self.run.update((*run.row(key[0])[1:], run.token, version + 1))
        for timer in timers:
            if timer != run.lease_ms:
                self.handle.deleteTimer(timer)
        if run.lease_ms and run.lease_ms not in timers:
            self.handle.registerTimer(run.lease_ms)
        if run.state:
            yield Row(*_NAMES)(*run.row(key[0]), version + 1)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        run, version = self._load()
        timers = [run.lease_ms] if run.lease_ms else []  # a run has a timer while it has a lease
        for e in sorted(rows, key=lambda e: (e.ts_ms, e.op is None, e.op or "")):
            run.apply(e.op, e.ts_ms, e.kind, e.error_code, e.delay_ms or 0, self.lease_ms, self.most, e.token)
        yield from self._given(key, run, version, timers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        run, version = self._load()
        run.expire(expiredTimerInfo.getExpiryTimeInMs(), self.most)
        yield from self._given(key, run, version, list(self.handle.listTimers()))

    def close(self) -> None:
        pass


def runs(events: DataFrame, lease_ms: int = LEASE_MS, max_attempts: int = MAX_ATTEMPTS, late: str = "0 seconds") -> DataFrame:
    """A row for each run that a batch of the stream touches or whose lease ends, as it is then; the highest version is the last.

    ``late`` is how much later than others an event may come. Needs the RocksDB state store.
    """
    timed = events.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    return timed.groupBy("run_key").transformWithState(Runs(lease_ms, max_attempts), VERSIONED, "update", "eventTime")


def latest(rows: DataFrame) -> DataFrame:
    """Of each run's rows the last one, out of a table that batches were written to."""
    names = [n for n in _NAMES if n != "version"]
    return rows.groupBy("run_key").agg(F.max_by(F.struct(*names[1:]), "version").alias("r")).select("run_key", "r.*")
