"""Provenance as a table: the same whatever the order and number of additions, and no other key's files touched."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import aggregate
from loomgraph.operators import provenance as P

KEYS = ["surface_form", "type_label"]
SCHEMA = "doc_id string, ord long, surface_form string, type_label string, uri string, description string, type_uri string, provenance_ids array<string>"


def mentions(n, seed=0):
    rng = random.Random(seed)
    some = lambda *x: rng.choice([*x, None])
    return [(f"d{rng.randrange(30):02}", i, rng.choice("abcdefgh"), some("T", "U"), some("u1", "u2"), some("x", "y"), some("t"), some([], ["s1"], ["s2", "s1"], [f"s{rng.randrange(9)}"])) for i in range(n)]


def loops(rows):
    """(key: (uri, type_uri, description, sources)) by plain loops."""
    out = {}
    for d, o, sf, label, uri, description, type_uri, ids in sorted(rows, key=lambda r: r[:2]):
        e = out.setdefault((sf, label), [None, None, description, {}])
        e[0], e[1] = e[0] or uri, e[1] or type_uri
        for s in sorted(ids or []):
            e[3].setdefault(s, (d, o))
    return {k: (*v[:3], tuple(s for s, _ in sorted(v[3].items(), key=lambda x: (x[1], x[0])))) for k, v in out.items()}


def table_of(df):
    return {(r.surface_form, r.type_label): (r.uri, r.type_uri, r.description, tuple(r.provenance_ids)) for r in df.collect()}


def facts(df):
    return P.facts(df, KEYS, ("uri", "type_uri"), ("description",))


def listed(table):
    return table_of(P.listed(table, KEYS, ("uri", "type_uri", "description")))


def test_merges_keep_first_seen_order(spark):
    rows = mentions(120)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = loops(rows)
    assert table_of(aggregate.merge_mentions(df)) == want and listed(facts(df)) == want
    assert {(r.surface_form, r.type_label): r.n_sources for r in P.merged(facts(df), KEYS).collect()} == {k: len(v[3]) for k, v in want.items()}
    assert aggregate.merge_mentions(df.limit(0)).count() == 0


@pytest.mark.parametrize("order", ([0, 1, 2], [2, 0, 1]))
def test_additions_in_any_order(spark, tmp_path, order):
    rows = mentions(90, 1)
    parts = [rows[i::3] for i in range(3)]
    ledger = P.Ledger(spark, str(tmp_path / "ledger"), KEYS, buckets=4)
    for i in [*order, order[0]]:
        added = ledger.add(facts(spark.createDataFrame(parts[i], SCHEMA)))
    assert added == 0  # the first part again
    assert listed(ledger.read()) == loops(rows)
    assert ledger.compact(most=1) == [0, 1, 2, 3] and listed(ledger.read()) == loops(rows)
    assert ledger.compact() == []


def test_other_buckets_stay(spark, tmp_path):
    ledger = P.Ledger(spark, str(tmp_path / "ledger"), KEYS, buckets=16)
    ledger.add(facts(spark.createDataFrame(mentions(90, 2), SCHEMA)))
    files = lambda: {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(ledger.path) for f in fs if f.startswith("part-")}
    before = files()
    new = [("e1", 0, "new", "T", None, None, None, ["s"])]
    assert ledger.add(facts(spark.createDataFrame(new, SCHEMA))) == 3  # seen, its source, its description
    after = files()
    assert before.items() <= after.items() and len({d for d, _ in after.keys() - before.keys()}) == 1
    assert ledger.read().where(F.col("surface_form") == "new").count() == 3


def test_nothing_to_add(spark, tmp_path):
    ledger = P.Ledger(spark, str(tmp_path / "ledger"), KEYS)
    none = facts(spark.createDataFrame([], SCHEMA))
    assert ledger.add(none) == 0
    ledger.add(facts(spark.createDataFrame(mentions(5), SCHEMA)))
    assert ledger.add(none) == 0
