"""Jobs as keyed state: the machine by itself, and the stream with timers, restarts and expiry."""

import os

import pytest

from loomgraph.streaming import jobs, keyed


def fold(events, **more):
    job, out = None, []
    for kind, at in events:
        if job is not None:
            job, c = keyed.silent(job, at, more.get("idle", 60), more.get("ttl", 1000))
            out += [(c.status, c.attempts)] if c else []
        job, c = keyed.step(job, kind, "p", "e", at)
        out += [(c.status, c.attempts)] if c else []
    return out


@pytest.mark.parametrize(
    "events, want",
    [
        ([("submitted", 0), ("claimed", 1), ("done", 2), ("done", 3), ("failed", 4)], [("pending", 0), ("running", 1), ("completed", 1)]),
        ([("claimed", 0), ("submitted", 1), ("submitted", 2), ("beat", 3)], [("pending", 0)]),
        ([("submitted", 0)] + [x for i in range(4) for x in (("claimed", 2 * i + 1), ("failed", 2 * i + 2))], [("pending", 0), ("running", 1), ("pending", 1), ("running", 2), ("pending", 2), ("running", 3), ("failed", 3)]),
        ([("submitted", 0), ("claimed", 1), ("terminal", 2)], [("pending", 0), ("running", 1), ("failed", 1)]),
        ([("submitted", 0), ("claimed", 1), ("beat", 50), ("beat", 100), ("tick", 161)], [("pending", 0), ("running", 1), ("pending", 1)]),
        ([("submitted", 0), ("claimed", 1), ("done", 2), ("tick", 1003), ("submitted", 1004)], [("pending", 0), ("running", 1), ("completed", 1), ("expired", 1), ("pending", 0)]),
    ],
)
def test_steps(events, want):
    assert fold(events) == want


def once(spark, events, root, **more):
    q = keyed.start(spark, events, root, once=True, **more)
    assert q.awaitTermination(240)
    return {r.job_id: (r.status, r.attempts, r.error) for r in keyed.states(spark, root).collect()}


def test_stream_of_jobs(spark, tmp_path):
    """One job ends, one fails until it's given up, one is claimed by a worker that dies, and the results of ended jobs go with them."""
    events, root = str(tmp_path / "events"), str(tmp_path / "root")
    clock = [1_000_000.0]

    def now():
        clock[0] += 1
        return clock[0]

    def run(s, payload):
        if payload == "bad":
            raise RuntimeError("later")
        if payload == "hopeless":
            raise jobs.Terminal("never")
        return s.createDataFrame([(payload,)], "v string")

    keyed.tell(spark, events, [(j, "submitted", p, None, now()) for j, p in (("a", "good"), ("b", "bad"), ("c", "hopeless"), ("d", "lost"))])
    assert {s[0] for s in once(spark, events, root).values()} == {"pending"}
    keyed.tell(spark, events, [("d", "claimed", None, None, now())])  # by a worker that tells nothing more
    once(spark, events, root)
    assert set(keyed.work(spark, events, root, run, threads=1, now=now)) == {"a", "b", "c"}
    seen = once(spark, events, root)
    assert seen == {"a": ("completed", 1, None), "b": ("pending", 1, "later"), "c": ("failed", 1, "never"), "d": ("running", 1, None)}
    assert spark.read.json(f"{root}/results/a").first().v == "good"

    # the batch that was last written runs again, as after a crash before its commit: nothing is told twice
    before = sorted(map(tuple, keyed.changes(spark, root).collect()))
    commits = sorted((int(f) for f in os.listdir(f"{root}/checkpoint/commits") if f.isdigit()))
    os.remove(f"{root}/checkpoint/commits/{commits[-1]}")
    crc = f"{root}/checkpoint/commits/.{commits[-1]}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert once(spark, events, root) == seen and sorted(map(tuple, keyed.changes(spark, root).collect())) == before

    clock[0] += keyed.IDLE
    keyed.tell(spark, events, [(None, "tick", None, None, now())])
    assert once(spark, events, root)["d"] == ("pending", 1, "abandoned")
    keyed.work(spark, events, root, run, threads=2, now=now)
    seen = once(spark, events, root)
    assert seen["d"] == ("completed", 2, None) and seen["b"][:2] == ("pending", 2)
    keyed.work(spark, events, root, run, threads=1, now=now)
    assert once(spark, events, root)["b"] == ("failed", 3, "later")

    clock[0] += keyed.STATE_TTL
    keyed.tell(spark, events, [(None, "tick", None, None, now())])
    assert once(spark, events, root) == {} and not os.path.exists(f"{root}/results/a")
