"""The stage queue as a state machine: one transition function for batch and streaming.

A run is keyed work; events enqueue, claim, prolong, defer, complete, fail or expire it. All times are epoch
milliseconds. Claims are handed out in the order of due time and run, not in random order, so replays agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ATTEMPTS = 5
LEASE_MS = 60_000
CODE, MESSAGE = 128, 2048
RUN = "run_key string, state string, attempts int, due_ms long, lease_ms long, error_class string, error_code string, finished_ms long"
EVENT = "run_key string, ts_ms long, op string, kind string, error_code string, delay_ms long, token string"


@dataclass
class Run:
    state: str = ""
    attempts: int = 0
    due_ms: int = 0
    lease_ms: int = 0
    error_class: str | None = None
    error_code: str | None = None
    finished_ms: int | None = None
    token: str | None = None

    def expire(self, now: int, most: int) -> None:
        """A lease that has run out gives the run back, or ends it after its last attempt."""
        if self.state in ("leased", "running") and self.lease_ms <= now:
            self._retry(self.lease_ms, 0, "retryable", "lease_expired", most)

    def _retry(self, now: int, delay: int, kind: str, code: str | None, most: int) -> None:
        self.error_class, self.error_code = kind, (code or "")[:CODE] or None
        if kind == "blocked":
            self.state, self.finished_ms = "blocked", now
        elif kind == "retryable" and self.attempts < most:
            self.state, self.due_ms = "queued", now + delay
        else:
            self.state, self.finished_ms = "failed", now
        self.lease_ms, self.token = 0, None

    def apply(self, op: str, now: int, kind: str | None = None, code: str | None = None, delay: int = 0, lease: int = LEASE_MS, most: int = MAX_ATTEMPTS, token: str | None = None) -> None:
        """A token that isn't the lease's is a former holder's: its event changes nothing. Events without one are trusted."""
        self.expire(now, most)
        held = self.state in ("leased", "running") and (token is None or self.token is None or token == self.token)
        if op == "enqueue" and not self.state:
            self.state, self.due_ms = "queued", now + max(0, delay)
        elif op == "claim" and self.state == "queued" and self.due_ms <= now:
            self.state, self.attempts, self.lease_ms = "leased", self.attempts + 1, now + lease
            self.error_class, self.error_code, self.token = None, None, token
        elif op == "heartbeat" and held:
            self.state, self.lease_ms = "running", now + lease
        elif op == "defer" and held:  # the attempt is not given back
            self.state, self.due_ms, self.lease_ms, self.error_class, self.error_code, self.token = "queued", now + max(0, delay), 0, None, None, None
        elif op == "complete" and held:
            self.state, self.lease_ms, self.finished_ms, self.token = "succeeded", 0, now, None
        elif op == "fail" and held:
            self._retry(now, max(0, delay), kind or "retryable", code, most)

    def row(self, key: str) -> tuple:
        return key, self.state, self.attempts, self.due_ms, self.lease_ms, self.error_class, self.error_code, self.finished_ms


def replay(events: DataFrame, lease_ms: int = LEASE_MS, max_attempts: int = MAX_ATTEMPTS, now_ms: int | None = None) -> DataFrame:
    """The runs after all events, each run's in the order of time; ``events`` has the columns of ``EVENT``.

    Events are sorted in the shuffle and streamed, so a run may have any number of them. With ``now_ms`` leases that have
    run out by then are taken back, as timers do in the stream.
    """
    names = [c.split()[0] for c in RUN.split(", ")]

    def last(key: str, state: Run) -> tuple:
        if now_ms is not None:
            state.expire(now_ms, max_attempts)
        return state.row(key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, Run()
        for frame in frames:
            out = []
            for e in frame.itertuples(index=False):
                if e.run_key != key:
                    if key is not None and state.state:
                        out.append(last(key, state))
                    key, state = e.run_key, Run()
                state.apply(e.op, int(e.ts_ms), e.kind, e.error_code, 0 if pd.isna(e.delay_ms) else int(e.delay_ms), lease_ms, max_attempts, e.token)
            yield pd.DataFrame(out, columns=names)
        if key is not None and state.state:
            yield pd.DataFrame([last(key, state)], columns=names)

    ordered = events.select(*(c.split()[0] for c in EVENT.split(", "))).repartition("run_key").sortWithinPartitions("run_key", "ts_ms", "op")
    return ordered.mapInPandas(run, RUN)


def claims(events: DataFrame, interval_ms: int) -> DataFrame:
    """origin, ts_ms, at_ms: when a polite origin can serve each request, at least the interval after the one before.

    With a fixed interval, request k of an origin is served at the largest of ts_j + (k - j) * interval over j <= k.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("origin").orderBy("ts_ms", "id")
    k = F.row_number().over(w)
    ranked = events.withColumn("k", k)
    lead = F.max(F.col("ts_ms") - F.col("k") * interval_ms).over(Window.partitionBy("origin").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("at_ms", lead + F.col("k") * interval_ms)


def counts(runs: DataFrame, now: Column) -> DataFrame:
    """state, n: queued runs are ready or delayed by their due time."""
    state = F.when((F.col("state") == "queued") & (F.col("due_ms") > now), "delayed").when(F.col("state") == "queued", "ready").otherwise(F.col("state"))
    return runs.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def snapshot(runs: DataFrame, now: Column, most: int = 50) -> DataFrame:
    """A bounded view: leased runs first, then due, delayed, failed and blocked ones."""
    rank = F.when(F.col("state").isin("leased", "running"), 0).when((F.col("state") == "queued") & (F.col("due_ms") <= now), 1).when(F.col("state") == "queued", 2).when(F.col("state") == "failed", 3).when(F.col("state") == "blocked", 4)
    return runs.withColumn("rank", rank).where("rank is not null").orderBy("rank", "due_ms", "run_key").limit(most)


def first_of(requests: DataFrame, key: Column) -> DataFrame:
    """Adds created: true for the first request of each key, by time and id."""
    from pyspark.sql import Window

    return requests.withColumn("created", F.row_number().over(Window.partitionBy(key).orderBy("ts", "event_id")) == 1)


def grant(runs: DataFrame, origins: DataFrame, now: Column, most: int) -> DataFrame:
    """run_key, origin of the fetch runs that may start now; a micro-batch's claim, for ``foreachBatch``.

    An origin gives runs while it is past its next allowed time and its backoff and has slots left, one for each
    call if it has an interval; of all origins' offers the first by due time and run are granted, up to the slots that
    are left in the whole. ``runs`` has run_key, origin, state, due_ms; ``origins`` has origin, next_ms, backoff_ms,
    interval_ms, in_flight, max_in_flight.
    """
    from pyspark.sql import Window

    open_ = origins.where(now >= F.greatest("next_ms", "backoff_ms")).withColumn("slots", F.col("max_in_flight") - F.col("in_flight"))
    slots = open_.select("origin", F.when(F.col("interval_ms") > 0, F.least(F.lit(1), F.col("slots"))).otherwise(F.col("slots")).alias("slots")).where("slots > 0")
    due = runs.where((F.col("state") == "queued") & (F.col("due_ms") <= now)).join(slots, "origin")
    turn = F.row_number().over(Window.partitionBy("origin").orderBy("due_ms", "run_key"))
    left = origins.agg((most - F.coalesce(F.sum("in_flight"), F.lit(0))).alias("left"))  # one row
    offered = due.withColumn("turn", turn).where("turn <= slots").orderBy("due_ms", "run_key").limit(most)
    place = F.row_number().over(Window.orderBy("due_ms", "run_key"))  # of as many as the limit in the whole, at most
    return offered.withColumn("place", place).crossJoin(F.broadcast(left)).where("place <= left").select("run_key", "origin")


def reserve(origins: DataFrame, granted: DataFrame, now: Column) -> DataFrame:
    """Origins after a grant: slots taken, and the next allowed time an interval ahead."""
    n = granted.groupBy("origin").agg(F.count("*").alias("granted"))
    taken = F.coalesce("granted", F.lit(0))
    return origins.join(n, "origin", "left").select(
        "origin", F.when(taken > 0, now + F.col("interval_ms")).otherwise(F.col("next_ms")).alias("next_ms"), "backoff_ms", "interval_ms", (F.col("in_flight") + taken).alias("in_flight"), "max_in_flight"
    )


def release(origins: DataFrame, finished: DataFrame, now: Column) -> DataFrame:
    """Origins after runs ended: each gives its slot back, 0 at least are taken, and a failure may hold its origin back.

    ``finished`` has a row for each run that completed or failed under its own lease: origin and backoff_ms, null or 0 if
    the origin need not wait. The wait never gets shorter.
    """
    n = finished.groupBy("origin").agg(F.count("*").alias("ended"), F.max(F.coalesce("backoff_ms", F.lit(0))).alias("wait"))
    until = F.when(F.coalesce("wait", F.lit(0)) > 0, F.greatest("backoff_ms", now + F.col("wait"))).otherwise(F.col("backoff_ms"))
    return origins.join(n, "origin", "left").select("origin", "next_ms", until.alias("backoff_ms"), "interval_ms", F.greatest(F.lit(0), F.col("in_flight") - F.coalesce("ended", F.lit(0))).alias("in_flight"), "max_in_flight")


def admit(items: DataFrame, seen: DataFrame, failed: DataFrame, key: str = "url") -> tuple[DataFrame, DataFrame]:
    """Items to enqueue, each key once and none that was seen; and the keys seen afterwards, without those whose enqueuing failed."""
    new = items.dropDuplicates([key]).join(seen.select(key), key, "left_anti")
    lost = failed.select(key).distinct()
    return new, seen.select(key).union(new.join(lost, key, "left_anti").select(key)).distinct()


def cleared(runs: DataFrame, stage: str) -> DataFrame:
    """Runs without those of a stage; a run's key begins with its stage."""
    return runs.where(~F.col("run_key").startswith(stage + ":"))


def configure(origins: DataFrame, limits: DataFrame, now: Column) -> DataFrame:
    """New limits for some origins; the next allowed time never moves back, and reserves from now if asked."""
    new = limits.select("origin", F.col("interval_ms").alias("i"), F.col("max_in_flight").alias("m"), F.col("reserve_from_now").alias("r"))
    return origins.join(new, "origin", "left").select(
        "origin",
        F.when(F.col("r"), F.greatest(F.col("next_ms"), now + F.coalesce("i", "interval_ms"))).otherwise(F.col("next_ms")).alias("next_ms"),
        "backoff_ms",
        F.coalesce("i", "interval_ms").alias("interval_ms"),
        "in_flight",
        F.coalesce("m", "max_in_flight").alias("max_in_flight"),
    )


def requeue(runs: DataFrame, states: tuple[str, ...], now: Column) -> DataFrame:
    """Runs in the given states are queued again as new."""
    again = F.col("state").isin(*states)
    return runs.withColumn("due_ms", F.when(again, now).otherwise(F.col("due_ms"))).withColumn("state", F.when(again, "queued").otherwise(F.col("state")))
