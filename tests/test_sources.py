"""References, saved graphs, validation, proposals, and the loop that asks again."""

import pytest
from pyspark.sql import functions as F
from test_graph import TTL, mention, onto  # noqa: F401

from loomgraph.operators import conformance, dedup, stats, view_model
from loomgraph.plans import pipeline
from loomgraph.sources import corpus
from loomgraph.sources import references as R
from loomgraph.sources.validate import validate_graph
from loomgraph.streaming import jobs

ITEM = "surface_form string, uri string"


def test_references(spark, tmp_path):
    blobs, text = str(tmp_path / "blobs"), '[{"surface_form": "a"}, {"surface_form": "b", "uri": "u"}]'
    (tmp_path / "list.json").write_text(text)
    (tmp_path / "o.ttl").write_text(TTL)
    key = jobs.put_blobs(spark.createDataFrame([(text,)], "content string"), blobs).first().key
    jobs.put_blobs(spark.createDataFrame([(text,)], "content string"), blobs)
    assert spark.read.parquet(blobs).count() == 1  # stored once, though put twice
    want = [("a", None), ("b", "u")]
    for value in ([{"surface_form": "a", "uri": None}, {"surface_form": "b", "uri": "u"}], str(tmp_path / "list.json"), key):
        assert sorted(map(tuple, R.records(spark, value, ITEM, blobs).collect())) == want
    with pytest.raises(ValueError):
        R.records(spark, "blob:none", ITEM, blobs)
    assert R.turtle_text(spark, None) is None and R.turtle_text(spark, TTL) == TTL
    assert R.turtle_text(spark, str(tmp_path / "o.ttl")) == TTL and R.turtle_text(spark, "no such file") == "no such file"


def test_saved_graphs(spark, tmp_path):
    folder = str(tmp_path / "graphs")
    assert R.saved_graphs(spark, folder).count() == 0
    e = spark.createDataFrame([("e0", "x"), ("e1", "y")], "entity_id string, surface_form string")
    r = spark.createDataFrame([("x", "knows", "y")], "subject string, predicate string, object string")
    for title in ("beta", "Alpha"):
        R.save_graph(e, r, folder, title)
    assert [x.slug for x in R.saved_graphs(spark, folder).collect()] == ["Alpha", "beta"]
    entities, triples = R.load_graph(spark, folder, "beta")
    assert {x.surface_form for x in entities.collect()} == {"x", "y"} and triples.first().predicate == "knows"
    with pytest.raises(KeyError):
        R.load_graph(spark, folder, "gamma")


def test_loading_keeps_all(spark):
    text = """{"entities": {"e0": {"surface_form": "x", "uri": "u", "type": {"label": "T", "uri": "t"}, "provenance_ids": ["d"]}, "e1": {"surface_form": "y", "description": "z"}},
    "relations": [], "clusters": {"entities": {"x": [{"surface_form": "xs"}, {"surface_form": "x"}]}}, "edge_clusters": {"p": ["q", "p"]}}"""
    rows = spark.createDataFrame([(text,), ('{"nodes": ["a", {"id": "b"}]}',), (None,), ("{}",)], "value string")
    got = {tuple(r) if r.provenance_ids else tuple(r)[:6] for r in corpus.graph_entities(rows).select("entity_id", "surface_form", "uri", "description", "type_label", "type_uri", F.array_join("provenance_ids", ",").alias("provenance_ids")).collect()}
    assert got == {("e0", "x", "u", None, "T", "t", "d"), ("e1", "y", None, "z", None, None), (None, "a", None, None, None, None), ("b", "b", None, None, None, None)}
    assert [tuple(r) for r in corpus.graph_clusters(rows).collect()] == [("x", ["x", "xs"])]
    assert [tuple(r) for r in corpus.graph_clusters(rows, kind="edges").collect()] == [("p", ["p", "q"])]


def test_validation(spark):
    good = '{"entities": {"e0": {"surface_form": "x", "uri": null}}, "relations": [{"subject_id": "e0", "predicate": {"label": "p"}, "object_value": "1", "is_literal": true}], "stats": {}}'
    bad = '{"entities": {"e0": {"uri": 1}, "e1": "x"}, "relations": [{"subject_id": null, "predicate": {}, "is_literal": "no"}], "clusters": []}'
    rows = spark.createDataFrame([(1, good), (2, bad), (3, "no JSON"), (4, None), (5, "[]"), (6, '{"entities": [], "relations": {}, "stats": {}}')], "id int, value string")
    got = {r.id: (r.valid, r.errors) for r in validate_graph(rows).collect()}
    assert got[1] == (True, [])
    assert got[2] == (False, ["stats: is missing", "clusters: isn't an object", "entities.e0.surface_form: is missing", "entities.e0.uri: isn't text", "entities.e1. isn't an object", "relations.0.subject_id: isn't text", "relations.0.is_literal: isn't a truth value"])
    assert all(not got[i][0] and len(got[i][1]) == 1 for i in (3, 4, 5))
    assert got[6] == (False, ["entities: isn't an object", "relations: isn't a list"])


def test_methods_and_proposals(spark, tmp_path, onto):  # noqa: F811
    m = mention(spark, [("d", "ship", None), ("d", "ships", None), ("d", "port", None)])
    t = spark.createDataFrame([("d", 0, "ship", "calls", "port", ["d"])], "doc_id string, ord long, subject_sf string, predicate_sf string, object_sf string, provenance_ids array<string>")
    assert dedup.run(m, t, "semhash")[0].count() == 2
    for method in ("full", "other"):
        with pytest.raises(ValueError):
            dedup.run(m, t, method)
    assert dedup.run(m.limit(0), t.limit(0), "semhash")[0].count() == 0
    told = dedup.write_proposal(dedup.suggest_clusters(m), str(tmp_path / "p"))
    assert (told["num_entity_clusters"], told["num_clustered_entities"]) == (1, 2)
    assert {(r.canonical, r.member) for r in dedup.read_proposal(spark, str(tmp_path / "p")).collect()} == {("ship", "ship"), ("ship", "ships")}
    shown = view_model.view(m, t, dedup.suggest_clusters(m))
    assert shown["isolated"].count() == 1 and shown["stats"].first().clusters == 1 and shown["clusters"].first().size == 2


def test_asked_again(spark, onto):  # noqa: F811
    docs = spark.createDataFrame([(d, d) for d in ("good", "mends", "never", "breaks", "late")], "id string, text string")
    m = mention(spark, [(d, s, k) for d in ("good", "mends", "never", "breaks", "late") for s, k in (("Ann", "Tanker"), ("Ulm", "Port"))])

    def relater(text, entities, predicates, feedback):
        assert entities == [("Ann", "Tanker"), ("Ulm", "Port")] and "calls at" in predicates and "moored at" not in predicates
        if text == "breaks" or (text == "late" and feedback):
            raise RuntimeError("no answer")
        right = text == "good" or (text == "mends" and feedback and "not in domain" in feedback)
        return [("Ann", "calls at", "Ulm") if right else ("Ulm", "calls at", "Ann")]

    got = {r.doc_id: ([x.subject for x in r.relations], r.error, r.score) for r in pipeline.relate(docs, m, relater, onto).collect()}
    assert got["good"] == got["mends"] == (["Ann"], None, 1.0)
    assert got["never"] == got["late"] == (["Ulm"], None, 0.0)
    assert got["breaks"] == ([], "RuntimeError: no answer", 1.0)


def test_order_of_messages(spark):
    rows = [("d", 1, "domain", False, "c"), ("d", 0, "range", False, "b"), ("d", 0, "domain", False, "a"), ("d", 5, "type", False, "t"), ("d", 1, "range", True, None)]
    checked = spark.createDataFrame(rows, "doc_id string, ord long, check string, ok boolean, message string")
    r = conformance.score(checked.select("doc_id"), checked).first()
    assert (r.errors, r.score) == ("t; a; b; c", 0.2)


def test_settings_and_reports(spark):
    assert pipeline.model_settings("gpt-5-mini", 0.0, 100) == (1.0, 16000) and pipeline.model_settings("other", 0.0, 100) == (0.0, 100)
    n = spark.range(1, 201).select("id", stats.reports(F.col("id"), F.lit(200)).alias("r")).where("r")
    assert [r.id for r in n.orderBy("id").collect()] == list(range(10, 201, 10))
