"""Blocks of bounded size, and merges by a judge."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import judged


def test_blocks(spark):
    rows = [(i, [float(i % 3) * 10, i / 1000]) for i in range(50)] + [(99, None)]
    v = spark.createDataFrame(rows, "k long, v array<double>")
    got = judged.blocks(v, "k", "v", size=8).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(tuple(r.block), []).append(r.k)
    assert sorted(k for ks in sizes.values() for k in ks) == list(range(50)) and max(map(len, sizes.values())) <= 8
    assert judged.blocks(v.limit(0), "k", "v").count() == 0
    assert judged.blocks(v, "k", "v", size=100).select("block").distinct().count() == 1


def test_merges(spark):
    items = ["car", "cars", "bus", "buses", "tram", "bad", "bads"]
    placed = spark.createDataFrame([(x, 1 if x.startswith("bad") else 0) for x in items], "item string, block int")
    near = placed.select("item", F.array(F.regexp_replace("item", "e?s$", ""), F.concat("item", F.lit("s")), F.lit("buses"), F.lit("elsewhere")).alias("candidates"))

    def judge(item, candidates):
        if item == "bads":
            raise RuntimeError("no answer")
        stem = item.removesuffix("es") if item == "buses" else item.removesuffix("s") if item != "bus" else item
        return stem, [c for c in candidates if c.startswith(stem) and c != item]

    failed = judged.verdicts(placed, near, judge).where("error is not null").collect()
    assert [(r.block, r.canonical, r.member, r.error) for r in failed] == [('{"block":1}', None, "bads", "RuntimeError: no answer")]
    got = {(r.canonical, r.member) for r in judged.merges(placed, near, judge).collect()}
    assert got == {("car", "car"), ("car", "cars"), ("bus", "buses"), ("bus", "bus")}  # the block whose judge failed stays as it was


def loops(rows, centres, room):
    """The same rounds one item after another."""
    left, waiting, out = [room] * len(centres), dict(rows), {}
    while waiting:
        asks = {}
        for k, v in waiting.items():
            far, cell = min((math.dist(v, c), i) for i, c in enumerate(centres) if left[i])
            asks.setdefault(cell, []).append((far, k))
        for cell, some in asks.items():
            for _, k in sorted(some)[: left[cell]]:
                out[k] = cell
                del waiting[k]
            left[cell] -= min(left[cell], len(some))
    return out


@pytest.mark.parametrize("room", (10, 13, 100))
def test_cells_take_what_they_have_room_for(spark, room):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 3))
    rows = [(i, (centres[0 if i < 60 else rng.integers(10)] + 0.3 * rng.normal(size=3)).tolist()) for i in range(100)]  # most ask one cell
    v = spark.createDataFrame(rows, "k long, v array<double>").repartition(3)
    got = {r.k: r.cell for r in judged.assign(v, centres, room).collect()}
    assert got == loops(rows, centres.tolist(), room)
    assert judged.assign(v.limit(0), centres, room).count() == 0


def test_neighbours_share_a_block(spark):
    """Items in tight families of unequal size: nine in ten have their nearest in their block, though no block holds more than its size."""
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for n in [40] * 4 + [12] * 10 + [3] * 20:
        c = rng.normal(size=8) * 10
        for _ in range(n):
            rows.append((i, (c + 0.05 * rng.normal(size=8)).tolist()))
            i += 1
    got = {r.k: tuple(r.block) for r in judged.blocks(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", size=48).collect()}
    assert len(got) == len(rows) and max(Counter(got.values()).values()) <= 48
    m = np.array([v for _, v in rows])
    d = np.linalg.norm(m[:, None] - m[None], axis=2)
    np.fill_diagonal(d, np.inf)
    kept = [got[a] == got[int(b)] for a, b in enumerate(d.argmin(axis=1))]
    assert sum(kept) >= 0.9 * len(kept)
