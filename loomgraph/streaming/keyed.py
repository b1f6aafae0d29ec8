"""Jobs as keyed state: what happens to a job is an event, and a stateful stream makes its states of them.

Events (submitted, claimed, beat, done, failed, and ticks of the clock) are JSON files in
a folder.  The stream keeps of each job its status, attempts and last sign of life, in a
state store that checkpoints with the stream.  Timers by event time put a job back that
was claimed and not heard of for ``idle`` seconds, and let one go ``ttl`` seconds after
its last change.  What a micro-batch makes of its events is written under the batch's own
number, so a batch that was killed and runs again writes the same once more; an attempt
counts when it's claimed, in the state, so none is lost with a worker.

Jobs themselves are Spark jobs and run beside the stream, several at a time: ``work``
claims what waits, runs it, and tells how it ended.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from loomgraph.session import drop, exists
from loomgraph.streaming.jobs import ERROR_CHARS, MAX_ATTEMPTS, STATE_TTL, Terminal

EVENT = "job_id string, kind string, payload string, error string, at double"
CHANGE = "job_id string, status string, attempts int, error string, payload string, at double"
#: Seconds without a sign of life after which a claimed job goes back.
IDLE = 60.0
#: Kinds of events, in the order in which they count at one time; those of a tick's own key have no job.
KINDS = ("submitted", "claimed", "beat", "done", "failed", "terminal", "tick")
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Job(NamedTuple):
    """A job's state; seen: its last sign of life or change."""

    status: str
    attempts: int
    payload: str | None
    seen: float


class Change(NamedTuple):
    status: str
    attempts: int
    error: str | None
    payload: str | None
    at: float


def step(job: Job | None, kind: str, payload: str | None, error: str | None, at: float, most: int = MAX_ATTEMPTS) -> tuple[Job | None, Change | None]:
    """What an event makes of a job, and the change to tell. Events that don't fit the status, such as those told twice or too late, change nothing."""
    if kind == "submitted" and job is None:
        job = Job("pending", 0, payload, at)
    elif job is None:
        return None, None
    elif kind == "claimed" and job.status == "pending":
        job = job._replace(status="running", attempts=job.attempts + 1, seen=at)
    elif kind == "beat" and job.status == "running":
        return job._replace(seen=max(at, job.seen)), None
    elif kind == "done" and job.status == "running":
        job = job._replace(status="completed", payload=None, seen=at)
    elif kind in ("failed", "terminal") and job.status == "running":
        last = kind == "terminal" or job.attempts >= most
        job = job._replace(status="failed" if last else "pending", seen=at)
    else:
        return job, None
    return job, Change(job.status, job.attempts, error and error[:ERROR_CHARS], job.payload if job.status in ("pending", "failed") else None, at)


def silent(job: Job, at: float, idle: float, ttl: float, most: int = MAX_ATTEMPTS) -> tuple[Job | None, Change | None]:
    """What the passing of time makes of a job: back or given up if nothing was heard of it, gone if it has expired."""
    if job.status == "running" and at >= job.seen + idle:
        return step(job, "failed", None, "abandoned", job.seen + idle, most)
    if at >= job.seen + ttl:
        return None, Change("expired", job.attempts, None, None, job.seen + ttl)
    return job, None


def due(job: Job, idle: float, ttl: float) -> float:
    """When the next silence counts."""
    return job.seen + (min(idle, ttl) if job.status == "running" else ttl)


class Machine(StatefulProcessor):
    def __init__(self, idle: float, ttl: float, most: int):
        self.idle, self.ttl, self.most = idle, ttl, most

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts int, payload string, seen double")

    def _keep(self, job: Job | None) -> None:
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        if job is None:
            self.job.clear()
        else:
            self.job.update(tuple(job))
            self.handle.registerTimer(int(due(job, self.idle, self.ttl) * 1000))

    def _told(self, key, changes: Iterable[Change]) -> Iterator[pd.DataFrame]:
        rows = [(key[0], c.status, c.attempts, c.error, c.payload, c.at) for c in changes]
        if rows:
            yield pd.DataFrame(rows, columns=["job_id", "status", "attempts", "error", "payload", "at"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return  # ticks
        job = Job(*self.job.get()) if self.job.exists() else None
        events = sorted((r for pdf in rows for r in pdf.itertuples(index=False)), key=lambda r: (r.at, KINDS.index(r.kind) if r.kind in KINDS else len(KINDS)))
        changes = []
        text = lambda x: x if isinstance(x, str) else None
        for e in events:
            if job is not None:  # what was silent before this event
                job, change = silent(job, e.at, self.idle, self.ttl, self.most)
                changes.append(change)
            job, change = step(job, e.kind, text(e.payload), text(e.error), e.at, self.most)
            changes.append(change)
        if job is not None or self.job.exists():
            self._keep(job)
        yield from self._told(key, filter(None, changes))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.job.exists():
            return
        job, change = silent(Job(*self.job.get()), expiredTimerInfo.getExpiryTimeInMs() / 1000, self.idle, self.ttl, self.most)
        self._keep(job)
        yield from self._told(key, filter(None, [change]))

    def close(self) -> None:
        pass


def tell(spark: SparkSession, events: str, rows: list[tuple]) -> None:
    """Events (job_id, kind, payload, error, at), as one file that is there when it's complete, in a folder of its own: several tell at once."""
    spark.createDataFrame(rows, EVENT).coalesce(1).write.json(f"{events}/{uuid.uuid4().hex}")


def start(spark: SparkSession, events: str, root: str, *, idle: float = IDLE, ttl: float = STATE_TTL, most: int = MAX_ATTEMPTS, late: str = "0 seconds", once: bool = False):
    """The streaming query that keeps the states of jobs and writes their changes under ``root``; of an expired job the result goes.

    A timer goes off when later events, or ticks, have moved the watermark past it.
    """
    stream = spark.readStream.schema(EVENT).option("recursiveFileLookup", True).json(events).withColumn("time", F.timestamp_millis((F.col("at") * 1000).cast("long"))).withWatermark("time", late)

    def write(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        path = f"{root}/changes/batch={number}"
        batch.coalesce(1).write.mode("overwrite").parquet(path)
        for r in s.read.schema(CHANGE).parquet(path).where("status = 'expired'").select("job_id").distinct().toLocalIterator():
            drop(s, f"{root}/results/{r.job_id}")

    had = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        made = stream.groupBy("job_id").transformWithStateInPandas(Machine(idle, ttl, most), CHANGE, "Update", "EventTime")
        writer = made.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{root}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
    finally:
        spark.conf.set(_STORE, had) if had else spark.conf.unset(_STORE)


def changes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(CHANGE + ", batch long").parquet(f"{root}/changes") if exists(spark, f"{root}/changes") else spark.createDataFrame([], CHANGE + ", batch long")


def states(spark: SparkSession, root: str) -> DataFrame:
    """(job_id, status, attempts, error, payload, updated_at) of the jobs that haven't expired."""
    order = F.struct("batch", "at", F.when(F.col("status") == "running", 1).otherwise(F.when(F.col("status") == "pending", 0).otherwise(2)))
    last = changes(spark, root).groupBy("job_id").agg(F.max_by(F.struct("status", "attempts", "error", "payload", "at"), order).alias("c"))
    return last.select("job_id", "c.status", "c.attempts", "c.error", "c.payload", F.col("c.at").alias("updated_at")).where("status <> 'expired'")


def work(spark: SparkSession, events: str, root: str, run: Callable[[SparkSession, str], DataFrame], *, most: int = 16, threads: int = 4, now: Callable[[], float] = time.time) -> list[str]:
    """Claims up to ``most`` of the jobs that wait, the oldest first, runs them, ``threads`` at a time, and tells how each ended; their ids. A result is written under its job's name."""
    waiting = states(spark, root).where("status = 'pending'").orderBy("updated_at", "job_id").limit(most).collect()

    def one(job) -> None:
        tell(spark, events, [(job.job_id, "claimed", None, None, now())])
        try:
            run(spark, job.payload).write.mode("overwrite").option("compression", "gzip").json(f"{root}/results/{job.job_id}")
            end = (job.job_id, "done", None, None, now())
        except Exception as e:
            end = (job.job_id, "terminal" if isinstance(e, Terminal) else "failed", None, str(e), now())
        tell(spark, events, [end])

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(one, waiting))
    return [r.job_id for r in waiting]


def replay(events: DataFrame, most: int = MAX_ATTEMPTS, idle: float = IDLE, ttl: float = STATE_TTL) -> DataFrame:
    """The changes that a table of events makes of its jobs, without a stream: (job_id, n, status, attempts), n from 1. A job's events are few."""

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        job, out = None, []
        rank = {k: i for i, k in enumerate(KINDS)}
        for e in sorted(pdf.itertuples(index=False), key=lambda r: (r.at, rank.get(r.kind, len(KINDS)))):
            if job is not None:
                job, change = silent(job, e.at, idle, ttl, most)
                out.append(change)
            job, change = step(job, e.kind, None, None, e.at, most)
            out.append(change)
        rows = [(key[0], n, c.status, c.attempts) for n, c in enumerate(filter(None, out), 1)]
        return pd.DataFrame(rows, columns=["job_id", "n", "status", "attempts"])

    return events.where("job_id is not null").select("job_id", "kind", "at").groupBy("job_id").applyInPandas(fold, "job_id string, n int, status string, attempts int")
