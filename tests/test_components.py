"""Components against a union-find, and components of a graph that grows."""

import random

import pytest

from loomgraph.operators import components as C
from loomgraph.operators.components import Forest, connected_components


def least(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def frame(spark, edges, kind="long"):
    return spark.createDataFrame(edges, f"src {kind}, dst {kind}").repartition(3)


def found(df):
    rows = df.collect()
    out = {r.node: r.component for r in rows}
    assert len(out) == len(rows)
    return out


def edges_of(seed, n=120, nodes=100):
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)] + [(None, 1), (2, None), (500, 500)]


@pytest.mark.parametrize("held, finish", ((3, 0), (10_000, 0), (10_000, 10_000)))
def test_components(spark, monkeypatch, held, finish):
    monkeypatch.setattr(C, "HELD", held)
    monkeypatch.setattr(C, "FINISH", finish)
    path = [(i, i + 1) for i in range(1000, 1200)]
    assert found(connected_components(frame(spark, edges_of(1) + path))) == least(edges_of(1) + path)
    names = [(f"n{a}", f"n{b}") for a, b in path]
    assert found(connected_components(frame(spark, names, "string"))) == least(names)


@pytest.mark.parametrize("seed", (2, 3))
def test_forest_after_every_addition(spark, tmp_path, seed):
    """Sparse parts first, so that later edges join components in chains; one part comes twice."""
    all_edges = edges_of(seed)
    parts = [all_edges[:30], all_edges[30:50], all_edges[50:90], all_edges[30:50], all_edges[90:], [(5, 900), (900, 901), (99, 5), (901, 50)]]
    forest, so_far = Forest(spark, str(tmp_path / "forest"), buckets=4), []
    for part in parts:
        forest.add(frame(spark, part))
        so_far += part
        assert found(forest.components()) == least(so_far)
        forest = Forest(spark, str(tmp_path / "forest"), buckets=4)  # as another session would open it
    forest.add(frame(spark, []))
    assert found(forest.components()) == least(so_far)


def test_an_addition_goes_through_rounds_alone(spark, tmp_path, monkeypatch):
    """What is contracted is as many edges as were added."""
    forest = Forest(spark, str(tmp_path / "forest"), buckets=4)
    forest.add(frame(spark, [(i, i + 1) for i in range(0, 2000, 2)]))
    seen = []
    monkeypatch.setattr(C, "connected_components", lambda e, a, b: seen.append(e.count()) or connected_components(e, a, b))
    forest.add(frame(spark, [(1, 2), (3, 5000), (1999, 0)]))
    assert seen == [3] and found(forest.components())[1998] == 0
