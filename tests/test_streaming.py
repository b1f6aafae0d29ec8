import time

import pytest

from loomgraph.streaming import jobs


def test_jobs_run_retry_and_die(spark, tmp_path):
    queue, root = str(tmp_path / "queue"), str(tmp_path / "root")
    good, bad, hopeless = (jobs.enqueue(spark, queue, p) for p in ("good", "bad", "hopeless"))
    tries = []

    def work(s, payload):
        tries.append(payload)
        if payload == "bad":
            raise RuntimeError("later")
        if payload == "hopeless":
            raise jobs.Terminal("never")
        return s.createDataFrame([(payload,)], "v string")

    for _ in range(jobs.MAX_ATTEMPTS):
        jobs.start(spark, queue, root, work, once=True).awaitTermination()
    state = {r.job_id: (r.status, r.attempts, r.error) for r in jobs.states(spark.read.parquet(f"{root}/events")).collect()}
    assert state[good][:2] == ("completed", 1) and state[bad] == ("failed", 3, "later") and state[hopeless] == ("failed", 1, "never")
    assert tries.count("bad") == 3 and tries.count("good") == 1
    assert {r.job_id for r in spark.read.parquet(f"{root}/dead_letter").collect()} == {bad, hopeless}
    assert jobs.result(spark, root, good).first().v == "good"
    with pytest.raises(KeyError):
        jobs.result(spark, root, "none")
    with pytest.raises(RuntimeError, match="later"):
        jobs.result(spark, root, bad)


def test_blobs(spark, tmp_path):
    path = str(tmp_path / "blobs")
    keys = [r.key for r in jobs.put_blobs(spark.createDataFrame([("x",), ("x",), ("y",)], "content string"), path).collect()]
    assert len(keys) == 2 and all(k.startswith("blob:") for k in keys)
    assert {jobs.get_blob(spark, path, k) for k in keys} == {"x", "y"}
    with pytest.raises(KeyError):
        jobs.get_blob(spark, path, "blob:none")


def test_states_expire(spark):
    now = time.time()
    e = spark.createDataFrame([("a", "running", 1, now, None), ("a", "completed", 1, now, None), ("b", "failed", 3, now - 2 * jobs.STATE_TTL, "x")], "job_id string, status string, attempts int, at double, error string")
    assert {(r.job_id, r.status) for r in jobs.states(e, now).collect()} == {("a", "completed")}
    assert [r.job_id for r in jobs.listing(jobs.states(e)).collect()] == ["a", "b"]


def test_abandoned_jobs_run_again(spark, tmp_path):
    queue, root = str(tmp_path / "queue"), str(tmp_path / "root")
    lost, busy = (jobs.enqueue(spark, queue, p) for p in ("lost", "busy"))
    old = time.time() - 100
    jobs._append(spark.createDataFrame([(j, "running", 1, old, None) for j in (lost, busy)], "job_id string, status string, attempts int, at double, error string"), f"{root}/events")
    jobs.beat(spark, root, busy, 3, 10)
    state = jobs.states(spark.read.parquet(f"{root}/events"))
    seen = {r.job_id: r for r in jobs.with_beats(state, spark.read.parquet(f"{root}/beats")).collect()}
    assert (seen[busy].processed_docs, seen[busy].total_docs) == (3, 10) and seen[lost].processed_docs is None
    assert jobs.reclaim(spark, queue, root, 50) == 1 and jobs.reclaim(spark, queue, root, 50) == 0
    waiting = [(r.job_id, r.payload, r.attempts) for r in spark.read.schema(jobs.JOB).json(queue).where("attempts > 0").collect()]
    assert waiting == [(lost, "lost", 1)]
