"""Durable jobs: a directory of job files as the queue, a checkpoint as its cursor.

A job is claimed by the micro-batch that reads its file; the checkpoint replays a batch
that didn't commit, and results are written under the job's own name, so a job that
runs twice overwrites its own result: at least once in, once out.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import blob_id
from loomgraph.operators.stats import eta, percent
from loomgraph.session import exists, stored

JOB = "job_id string, payload string, attempts int, created_at double"
#: Attempts before a job is dead, jobs that a listing shows, and seconds that states and blobs live.
MAX_ATTEMPTS, LISTED, STATE_TTL, BLOB_TTL = 3, 128, 86_400, 21_600
BEAT = "job_id string, processed_docs long, total_docs long, beat_at double"
ERROR_CHARS = 1000


class Terminal(Exception):
    """A failure of the job itself, which no retry mends."""


def enqueue(spark: SparkSession, queue: str, payload: str, attempts: int = 0, job_id: str | None = None) -> str:
    """A new file in the queue's directory, visible when complete."""
    job_id = job_id or uuid.uuid4().hex
    spark.createDataFrame([(job_id, payload, attempts, time.time())], JOB).coalesce(1).write.mode("append").json(queue)
    return job_id


def _append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def start(spark: SparkSession, queue: str, root: str, work: Callable[[SparkSession, str], DataFrame], *, max_files: int = 16, once: bool = False):
    """A streaming query that runs ``work(spark, payload)`` for every job and keeps states, results and dead letters under ``root``."""
    jobs = spark.readStream.schema(JOB).option("maxFilesPerTrigger", max_files).json(queue)

    def event(job_id: str, status: str, attempts: int, at: float, error: str | None = None) -> tuple:
        return (job_id, status, attempts, at, error and error[:ERROR_CHARS])

    def run(batch: DataFrame, number: int) -> None:
        s, events, again, dead = batch.sparkSession, [], [], []
        for job in batch.collect():  # at most max_files jobs; their rows hold a payload's text or path
            attempt = (job.attempts or 0) + 1
            events.append(event(job.job_id, "running", attempt, time.time()))
            try:
                work(s, job.payload).write.mode("overwrite").option("compression", "gzip").json(f"{root}/results/{job.job_id}")
                events.append(event(job.job_id, "completed", attempt, time.time()))
            except Exception as e:
                last = isinstance(e, Terminal) or attempt >= MAX_ATTEMPTS
                (dead if last else again).append((job.job_id, job.payload, attempt, str(e)))
                events.append(event(job.job_id, "failed" if last else "pending", attempt, time.time(), str(e)))
        if events:
            _append(s.createDataFrame(events, "job_id string, status string, attempts int, at double, error string"), f"{root}/events")
        if dead:
            _append(s.createDataFrame([(j, p, n, e[:ERROR_CHARS]) for j, p, n, e in dead], "job_id string, payload string, attempts int, error string"), f"{root}/dead_letter")
        for job_id, payload, attempt, _ in again:
            enqueue(s, queue, payload, attempt, job_id)

    writer = jobs.writeStream.foreachBatch(run).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def states(events: DataFrame, now: float | None = None) -> DataFrame:
    """(job_id, status, attempts, error, updated_at): each job's last event; expired ones are gone."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in {"pending": 0, "running": 1, "failed": 2, "completed": 3}.items() for x in kv]), F.col("status"))
    order = F.struct("at", rank)
    out = events.groupBy("job_id").agg(F.max_by("status", order).alias("status"), F.max("attempts").alias("attempts"), F.max_by("error", order).alias("error"), F.max("at").alias("updated_at"))
    return out if now is None else out.where(F.col("updated_at") > now - STATE_TTL)


def listing(state: DataFrame, order: str = "updated_at") -> DataFrame:
    return state.orderBy(F.desc(order), "job_id").limit(LISTED)


def known(asked: DataFrame, state: DataFrame) -> DataFrame:
    """The states of the jobs asked for (job_id); those that are gone are left out."""
    return state.join(asked.select("job_id").distinct(), "job_id", "left_semi")


def bounded(state: DataFrame, most: int = LISTED) -> DataFrame:
    """A store of at most ``most`` jobs: above that the finished ones go, the oldest first; those that run or wait always stay."""
    over = max(0, state.count() - most)
    old = state.where(F.col("status").isin("completed", "failed")).orderBy("updated_at", "job_id").limit(over).select("job_id")
    return state.join(old, "job_id", "left_anti")


def progress(state: DataFrame) -> DataFrame:
    """Adds percent and eta to (processed_docs, total_docs, elapsed)."""
    return state.withColumn("percent", percent(F.col("processed_docs"), F.col("total_docs"))).withColumn("eta", eta(F.col("processed_docs"), F.col("total_docs"), F.col("elapsed")))


def beat(spark: SparkSession, root: str, job_id: str, processed: int, total: int) -> None:
    """A running job's sign of life and its progress so far."""
    _append(spark.createDataFrame([(job_id, processed, total, time.time())], BEAT), f"{root}/beats")


def with_beats(state: DataFrame, beats: DataFrame) -> DataFrame:
    """Adds processed_docs, total_docs and seen_at: the last beat, or the last event of a job without one."""
    last = beats.groupBy("job_id").agg(F.max_by(F.struct("processed_docs", "total_docs"), "beat_at").alias("b"), F.max("beat_at").alias("beat_at"))
    return state.join(last, "job_id", "left").select(*state.columns, "b.processed_docs", "b.total_docs", F.greatest("updated_at", "beat_at").alias("seen_at"))


def abandoned(state: DataFrame, beats: DataFrame, idle: float, now: float | None = None) -> DataFrame:
    """The jobs said to run of which nothing was heard for ``idle`` seconds."""
    return with_beats(state, beats).where((F.col("status") == "running") & (F.col("seen_at") < (time.time() if now is None else now) - idle))


def reclaim(spark: SparkSession, queue: str, root: str, idle: float) -> int:
    """Puts abandoned jobs back into the queue, with the attempts they have used, and notes that they wait; their number.

    A job that was slow rather than lost runs twice, and overwrites its own result.
    """
    beats = spark.read.parquet(f"{root}/beats") if exists(spark, f"{root}/beats") else spark.createDataFrame([], BEAT)
    lost = abandoned(states(spark.read.parquet(f"{root}/events")), beats, idle).select("job_id", "attempts")
    payload = spark.read.schema(JOB).json(queue).groupBy("job_id").agg(F.max_by("payload", "created_at").alias("payload"))
    again = payload.join(lost, "job_id").select("job_id", "payload", "attempts", F.lit(time.time()).alias("created_at"))
    again = stored(again)  # the queue is read above and written below
    again.write.mode("append").json(queue)
    _append(again.select("job_id", F.lit("pending").alias("status"), "attempts", F.col("created_at").alias("at"), F.lit("abandoned").alias("error")), f"{root}/events")
    return again.count()


def result(spark: SparkSession, root: str, job_id: str) -> DataFrame:
    """A completed job's result; KeyError if there is no such job or it has expired, RuntimeError if it isn't done or has failed."""
    found = states(spark.read.parquet(f"{root}/events"), time.time()).where(F.col("job_id") == job_id).collect()
    if not found:
        raise KeyError(job_id)
    if found[0].status == "failed":
        raise RuntimeError(found[0].error)
    if found[0].status != "completed":
        raise RuntimeError(f"{job_id} is {found[0].status}")
    return spark.read.json(f"{root}/results/{job_id}")


def put_blobs(blobs: DataFrame, path: str, content: str = "content") -> DataFrame:
    """Stores contents by their address, each once, also across calls while it lives; returns (key, content)."""
    now = time.time()
    keyed = blobs.select(blob_id(content).alias("key"), F.col(content).alias("content"), F.lit(now + BLOB_TTL).alias("expires_at")).dropDuplicates(["key"])
    new = keyed
    if exists(blobs.sparkSession, path):
        there = blobs.sparkSession.read.parquet(path).where(F.col("expires_at") > now).select("key")
        new = keyed.join(there, "key", "left_anti")
    _append(new, path)
    return keyed


def get_blob(spark: SparkSession, path: str, key: str) -> str:
    rows = spark.read.parquet(path).where((F.col("key") == key) & (F.col("expires_at") > time.time())).limit(1).collect()
    if not rows:
        raise KeyError(f"{key} is unknown or has expired")
    return rows[0].content
