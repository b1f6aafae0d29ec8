"""A graph's JSON document in many files."""

import glob
import gzip
import json

import pytest

from loomgraph.sources import corpus


@pytest.mark.parametrize("compress", (False, True))
@pytest.mark.parametrize("n", (0, 1, 40))
def test_document(spark, tmp_path, n, compress):
    path = str(tmp_path / "graph")
    odd = ['quote " and \\ slash', "line\nbreak", "]: x", "ü😀", ", comma", ""]
    es = [(f"e{i}" if i else 'e"]: \\0', odd[i % 6], [str(i)] if i % 2 else None) for i in range(n)]
    rs = [(f"e{i}", odd[i % 6], i) for i in range(n)] * 2  # repeats stay
    e = spark.createDataFrame(es, "entity_id string, surface_form string, ids array<string>").repartition(3)
    r = spark.createDataFrame(rs, "subject_id string, predicate string, k int").repartition(3)
    told = corpus.write_document(e, r, path, compress=compress, kind="map", stats={"a": 1})
    assert (told["num_entities"], told["num_relations"]) == (n, 2 * n)
    text = "\n".join((gzip.open(f, "rt") if compress else open(f)).read() for f in sorted(glob.glob(f"{path}/part-*")))
    got = json.loads(text)
    assert got["kind"] == "map" and got["stats"] == {"a": 1}
    assert got["entities"] == {i: {"surface_form": s} | ({"ids": x} if x else {}) for i, s, x in es}
    assert sorted(map(str, got["relations"])) == sorted(str({"subject_id": a, "predicate": b, "k": c}) for a, b, c in rs)
    back, relations = corpus.read_document(spark, path)
    assert {x.entity_id: json.loads(x.entity) for x in back.collect()} == got["entities"]
    assert sorted(map(str, (json.loads(x.relation) for x in relations.collect()))) == sorted(map(str, got["relations"]))
