"""The queries over the whole graph against brute force over all mentions and triples."""

import pytest
from test_queries import DATA, con, text  # noqa: F401

from loomgraph.plans import queries as Q
from loomgraph.plans import star


@pytest.fixture(scope="module")
def graph(con):  # noqa: F811
    names = {r[0] for r in con.execute(f"select surface_form from ({star.sql_mentions()})").fetchall()}
    return names, con.execute(f"select s, p, o from ({star.sql_triples()})").fetchall()


@pytest.fixture(scope="module")
def component(graph):
    names, triples = graph
    root = {x: x for x in names | {x for s, _, o in triples for x in (s, o)}}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for s, _, o in triples:
        a, b = find(s), find(o)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark, component):
    assert dict(Q.QUERIES["connected_places"](spark, DATA).select("node", "component").collect()) == component


def test_stats(spark, graph, component):
    names, triples = graph
    n, m, ends = len(component), len(triples), {x for s, _, o in triples for x in (s, o)}
    want = {"entities": n, "relations": m, "relation_types": 7, "clusters": 0, "isolated": len(names - ends), "components": len(set(component.values())), "average_degree": round(2 * m / n, 2), "density": round(m / (n * (n - 1)), 3)}
    assert Q.QUERIES["graph_stats"](spark, DATA).first().asDict() == want
