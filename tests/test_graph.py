import pytest
from pyspark.sql import functions as F

from loomgraph.operators import aggregate, conformance, dedup, narrowing, retrieval, serialize, stats, view_model, views
from loomgraph.operators import components, skew
from loomgraph.operators.components import connected_components
from loomgraph.plans import pipeline
from loomgraph.sources import corpus
from loomgraph.sources import ontology as O

NS = "http://e/"
TTL = f"""@prefix : <{NS}> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix skos: <http://www.w3.org/2004/02/skos/core#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:Vessel a owl:Class ; rdfs:label "Vessel" . :Ship a owl:Class ; rdfs:label "Ship" ; rdfs:subClassOf :Vessel .
:Tanker a owl:Class ; rdfs:label "Tanker" ; rdfs:subClassOf :Ship . :Barge a owl:Class ; rdfs:label "Barge" ; rdfs:subClassOf :Vessel .
:Site a owl:Class ; rdfs:label "Site" . :Port a owl:Class ; rdfs:label "Port" ; skos:altLabel "Harbour" ; rdfs:subClassOf :Site .
:Berth a owl:Class ; rdfs:label "Berth" ; skos:hiddenLabel "quay" ; rdfs:subClassOf :Site .
:Company a owl:Class ; rdfs:label "Company" ; skos:altLabel "Operator", "Ship" .
:moored_at a owl:ObjectProperty ; rdfs:label "moored at" ; rdfs:domain :Vessel ; rdfs:range :Berth .
:calls_at a owl:ObjectProperty ; rdfs:label "calls at" ; rdfs:domain :Ship ; rdfs:range :Port .
:part_of a owl:ObjectProperty ; rdfs:label "part of" ; rdfs:domain :Site ; rdfs:range :Site .
:operated_by a owl:ObjectProperty ; rdfs:label "operated by" ; rdfs:domain :Vessel ; rdfs:range :Company .
:draught a owl:DatatypeProperty ; rdfs:label "draught" ; rdfs:domain :Ship ; rdfs:range xsd:decimal .
:opened a owl:DatatypeProperty ; rdfs:label "opened" ; rdfs:domain :Port ; rdfs:range xsd:gYear .
:remark a owl:ObjectProperty ; rdfs:label "remark" ."""


@pytest.fixture(scope="module")
def onto(spark):
    return O.ontology(O.triples(spark, TTL))


def mention(spark, rows):
    """(doc, surface form, type)"""
    data = [(d, i, s, None, None, t, t and NS + t, [d]) for i, (d, s, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id string, ord long, surface_form string, uri string, description string, type_label string, type_uri string, provenance_ids array<string>")


def triple(spark, rows):
    return spark.createDataFrame([(d, i, s, p, o, [d]) for i, (d, s, p, o) in enumerate(rows)], "doc_id string, ord long, subject_sf string, predicate_sf string, object_sf string, provenance_ids array<string>")


def rows(df, *cols):
    return {tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.select(*cols).collect()}


def test_narrowing(spark, onto):
    """Domains are met by subclasses two steps down, ranges too; datatypes always fit; a free predicate fits everywhere."""
    kinds = {"sea": ["Tanker", "Port"], "river": ["Barge", "Berth"], "firm": ["Company"], "site": ["Site"]}
    want = {"sea": {"calls_at", "part_of", "draught", "opened", "remark"}, "river": {"moored_at", "part_of", "remark"}, "firm": {"remark"}, "site": {"part_of", "remark"}}
    groups = spark.createDataFrame([(g, NS + k) for g, ks in kinds.items() for k in ks], "group string, type_uri string")
    listed = lambda df: {g: {p.removeprefix(NS) for h, p in rows(df, "group", "predicate_uri") if h == g} for g in kinds}
    assert listed(narrowing.narrow(onto, groups)) == want
    of, answers, legend = narrowing.narrow_batch(onto, groups)
    assert {r.group: {p.replace(" ", "_") for p in r.predicates} for r in of.join(answers, "answer").collect()} == want
    assert [r.label for r in legend.collect()] == ["calls at", "draught", "moored at", "opened", "part of", "remark"]
    assert narrowing.narrow(onto, groups, domain=False, range_=False).count() == 7 * len(kinds)
    named = [("sea", None, "TANKER"), ("sea", "x:unknown", "harbour"), ("river", None, "barge"), ("river", None, "Quay"), ("firm", None, "operator"), ("site", NS + "Site", None)]
    assert listed(narrowing.narrow(onto, spark.createDataFrame(named, "group string, type_uri string, type_label string"))) == want


def test_aliases_and_collisions(spark, onto):
    index = dict(rows(O.alias_index(onto.classes, onto.triples), "key", "label"))
    assert (index["harbour"], index["quay"], index["ship"], index["operator"]) == ("Port", "Berth", "Ship", "Company")
    t = O.triples(spark, '@prefix r: <http://www.w3.org/2000/01/rdf-schema#> . <x:1> r:label "Dry Dock" . <x:2> r:label "dryDock" . <x:3> r:label "dock" .')
    assert [(r.form, r.uris) for r in O.collisions(t).collect()] == [("dry dock", ["x:1", "x:2"])]
    kinds = spark.createDataFrame([(NS + "Tanker", "x"), (None, "Harbour"), (None, "raft"), ("x:y", "Site")], "u string, l string")
    assert {r.class_uri for r in O.resolve_class(onto, kinds, "u", "l").collect()} == {NS + "Tanker", NS + "Port", None, NS + "Site"}


def test_closure_is_safe_on_cycles():
    assert set(O.superclasses([("a", "b"), ("b", "a")], ["a"])) == {("a", "a"), ("a", "b")}


def test_conformance(spark, onto):
    """Types by URI, and the same by other names without one."""
    m = mention(spark, [("d", "Orca", "Tanker"), ("d", "Gull", "Barge"), ("d", "Kai 3", "Berth"), ("d", "Norrvik", "Port"), ("d", "Lindahl", "Guild"), ("d", "fog", None)])
    t = triple(spark, [("d", "Orca", "calls at", "Norrvik"), ("d", "Gull", "callsAt", "Norrvik"), ("d", "Orca", "moored at", "Norrvik"), ("d", "Gull", "sank near", "Kai 3"), ("d", "fog", "moored_at", "Kai 3")])
    got = conformance.checks(m, t, onto, predicate=True, types=True)
    assert rows(got.where("not ok"), "check", "message") == {
        ("type", "Entity Lindahl: type Guild not in allowed types"),
        ("predicate", "Relation Gull -[sank near]-> Kai 3: Predicate sank near not in ontology"),
        ("domain", "Relation Gull -[callsAt]-> Norrvik: Subject type Barge not in domain Ship"),
        ("range", "Relation Orca -[moored at]-> Norrvik: Object type Port not in range Berth"),
    }
    assert got.where("ok").count() == 5 + 4 + 2 + 3  # types, predicates, domains, ranges
    s = conformance.score(spark.createDataFrame([("d",), ("empty",)], "doc_id string"), got)
    assert {r.doc_id: round(r.score, 4) for r in s.collect()} == {"d": round(14 / 18, 4), "empty": 1.0}
    by_name = m.withColumn("type_uri", F.lit(None).cast("string")).replace({"Port": "harbour", "Berth": "QUAY", "Tanker": "tanker"}, subset=["type_label"])
    again = conformance.checks(by_name, t, onto, predicate=True, types=True)
    assert rows(again, "check", "ord", "ok") == rows(got, "check", "ord", "ok")


def test_string_dedup_and_provenance(spark):
    m = mention(spark, [("p1", "Cats", None), ("p2", "Cat", None), ("p3", "Dog", None), ("p1", "CEO", None), ("p1", "Chief Executive Officer", None), ("p2", "CBS", None), ("p2", "CB", None)])
    t = triple(spark, [("p1", "Cats", "chases", "Dog"), ("p2", "Cat", "Chases", "Dog"), ("p3", "Cat", "weighs", "5 kg")])
    e, r, clusters, edges = dedup.deduplicate(m, t)
    assert rows(e, "surface_form", "provenance_ids") == {("Cat", ("p1", "p2")), ("Dog", ("p3",)), ("CEO", ("p1",)), ("Chief Executive Officer", ("p1",)), ("CBS", ("p2",)), ("CB", ("p2",))}
    assert rows(r, "subject_sf", "predicate_sf", "object_sf", "provenance_ids") == {("Cat", "Chases", "Dog", ("p1", "p2")), ("Cat", "weighs", "5 kg", ("p3",))}
    assert rows(clusters, "canonical", "members") == {("Cat", ("Cat", "Cats"))}
    assert rows(edges, "canonical", "members") == {("Chases", ("Chases", "chases"))}
    assert dedup.deduplicate(m, t, edges=False)[1].count() == 3


def test_type_buckets(spark, onto):
    """A class merges with one above it, but not with one beside it; untyped forms merge with any; one form is one entity."""
    kinds = [("Polar Star", "Tanker"), ("polar stars", "Ship"), ("Heron", "Barge"), ("Herons", "Tanker"), ("Mole", "Berth"), ("Moles", "Company"), ("Anchor", None), ("anchor", "Port"), ("Delta", "Port"), ("Delta", "Company")]
    sizes = onto.closure.groupBy("uri").agg(F.count("*").alias("size"))
    e, _, _, _ = dedup.deduplicate(mention(spark, [("d", *k) for k in kinds]), triple(spark, [("d", "Heron", "met", "Herons")]), pairs=O.compatible_pairs(onto), closure_sizes=sizes)
    assert rows(e, "surface_form") == {(x,) for x in ("Polar Star", "Heron", "Herons", "Mole", "Moles", "Anchor", "Delta")}


def test_semantic_dedup(spark):
    m = mention(spark, [("a", "CEO", None), ("b", "Chief Executive Officer", None), ("c", "Boss", None), ("d", "Cat", None)])
    v = spark.createDataFrame([("CEO", [1.0, 0.0]), ("Chief Executive Officer", [0.95, 0.3]), ("Boss", [0.8, 0.6]), ("Cat", [0.0, 1.0])], "surface_form string, embedding array<double>")
    e, _, clusters, _ = dedup.deduplicate(m, triple(spark, [("a", "CEO", "owns", "Cat")]), vectors=v, threshold=0.9)
    assert rows(clusters, "canonical", "members") == {("Boss", ("Boss", "CEO", "Chief Executive Officer"))}
    assert rows(e, "surface_form") == {("Boss",), ("Cat",)}


def test_aggregate_back_fills(spark):
    m = mention(spark, [("a", "X", "Person"), ("b", "X", "Person"), ("b", "X", None)])
    m = m.withColumn("uri", F.when(F.col("doc_id") == "b", "u:x")).withColumn("description", F.when(F.col("ord") == 1, "late"))
    assert rows(aggregate.merge_mentions(m), "surface_form", "type_label", "uri", "description", "provenance_ids") == {("X", "Person", "u:x", None, ("a", "b")), ("X", None, "u:x", None, ("b",))}


def test_serialize(spark, onto):
    m = mention(spark, [("d", "Orca", "Tanker"), ("d", "Lindahl", "Company"), ("d", "Delta", "Port"), ("d", "Delta", "Company")])
    t = triple(spark, [("d", "Orca", "operatedBy", "Lindahl"), ("d", "Orca", "draught", "9.5"), ("d", "Orca", "seen", "17"), ("d", "ghost", "seen", "Orca"), ("d", "Orca", "seen", "Delta")])
    e = serialize.entities(aggregate.merge_mentions(m), onto)
    assert [(r.entity_id, r.surface_form, r.type.label) for r in e.orderBy("entity_id").collect()] == [("e0", "Delta", "Company"), ("e1", "Delta", "Port"), ("e2", "Lindahl", "Company"), ("e3", "Orca", "Tanker")]
    r = serialize.relations(t, e, onto)
    assert rows(r, "subject_id", "predicate.label", "object_id", "object_value", "object_datatype") == {("e3", "operated by", "e2", None, None), ("e3", "draught", None, "9.5", "xsd:decimal"), ("e3", "seen", None, "17", "xsd:integer"), ("e3", "seen", "e1", None, None)}
    assert serialize.without_subject(t, e) == 1
    terms = spark.createDataFrame([("Lighthouse", None, "a", 1), ("Lighthouse", None, "b", 2), ("Harbour", None, "c", 3), ("ferries to", "u:9", "d", 4)], "label string, uri string, description string, ord long")
    assert rows(serialize.extensions(terms, onto.classes, onto.triples), "label", "uri", "description") == {("Lighthouse", None, "a"), ("ferries to", "u:9", "d")}
    out = corpus.graph_json(e, r).first().value
    ents, trs = corpus.normalize_graph(spark.createDataFrame([('{"nodes": [{"id": "a"}, "b"], "edges": [{"source": "a", "label": "p", "target": "b"}, ["b", "q", "a"]]}',)], "value string"))
    assert '"e0"' in out and rows(ents, "surface_form") == {("a",), ("b",)} and rows(trs, "subject", "predicate", "object") == {("a", "p", "b"), ("b", "q", "a")}


def test_apply_clusters(spark):
    """A later cluster overrides an earlier one; relations follow, and their own clusters too."""
    m = mention(spark, [("d1", "Norrvik", "Port"), ("d2", "Port of Norrvik", "Port"), ("d1", "Orca", None)])
    t = triple(spark, [("d1", "Orca", "calls at", "Norrvik"), ("d2", "Orca", "visits", "Port of Norrvik")])
    c = spark.createDataFrame([("Sundvik", "Port of Norrvik", 0), ("Norrvik", "Port of Norrvik", 1)], "canonical string, member string, ord long")
    p = spark.createDataFrame([("calls at", "visits", 1)], "canonical string, member string, ord long")
    e, r = aggregate.apply_clusters(m, t, c, p)
    assert rows(e, "surface_form", "provenance_ids") == {("Norrvik", ("d1", "d2")), ("Orca", ("d1",))}
    assert rows(r, "subject_sf", "predicate_sf", "object_sf", "provenance_ids") == {("Orca", "calls at", "Norrvik", ("d1", "d2"))}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    df = spark.createDataFrame(chain + [(None, 5)], "src long, dst long")
    got = dict(connected_components(df).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert connected_components(df.limit(0)).count() == 0


def test_view_model(spark):
    m, t = mention(spark, [("d", "a", None), ("d", "b", None), ("d", "lone", None)]), triple(spark, [("d", "a", "p", "b"), ("d", "b", "q", "b"), ("d", "a", "p", "c")])
    assert rows(view_model.degrees(m, t), "node", "degree", "in_degree", "out_degree", "radius") == {("a", 2, 0, 2, 22), ("b", 3, 2, 1, 24), ("c", 1, 1, 0, 20), ("lone", 0, 0, 0, 18)}
    assert rows(view_model.isolated(m, t), "surface_form") == {("lone",)}
    s = view_model.graph_stats(m, t).first()
    assert (s.entities, s.relations, s.relation_types, s.isolated, s.components, s.average_degree, s.density) == (4, 3, 2, 1, 2, 1.5, 0.25)
    assert rows(view_model.edges(t), "edge_id", "subject_sf", "object_sf") == {("e0", "a", "b"), ("e1", "a", "c"), ("e2", "b", "b")}
    assert rows(view_model.simple_digraph(t), "src", "dst", "relation") == {("a", "b", "p"), ("b", "b", "q"), ("a", "c", "p")}


def test_context_and_retrieval(spark):
    t = triple(spark, [("d", "a", "p", "b"), ("d", "c", "p", "b"), ("d", "c", "p", "d"), ("d", "x", "p", "y")])
    seeds = spark.createDataFrame([("a",)], "node string")
    assert rows(retrieval.context(t, seeds, 1), "sentence") == {("a p b.",)}
    assert rows(retrieval.context(t, seeds, 2), "sentence") == {("a p b.",), ("c p b.",)}
    nodes = spark.createDataFrame([("a", [1.0, 0.0]), ("x", [0.0, 1.0]), ("z", [0.0, 0.0])], "node string, embedding array<double>")
    assert retrieval.retrieve(nodes, t, [1.0, 0.1], k=1, depth=1) == "a p b."
    assert retrieval.embed(nodes.select("node"), lambda xs: [[float(len(x))] for x in xs]).first().embedding == [1.0]


def test_corpus(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"id": "1", "text": "x", "terms": ["Alice", {"surface_form": "Google", "type": {"label": "Organization"}}]}\n\n{"id": "2", "text": "y"}\n')
    docs = corpus.read_corpus(spark, str(good))
    typed, untyped = views.split_terms(docs)
    assert docs.count() == 2 and rows(typed, "surface_form", "type_label", "provenance_ids") == {("Google", "Organization", ())} and rows(untyped, "surface_form", "provenance_ids") == {("Alice", ("1",))}
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": "1", "text": "x"}\ninvalid json\n')
    with pytest.raises(corpus.BadCorpus):
        corpus.read_corpus(spark, str(bad))


def test_relation_replies(spark):
    replies = spark.createDataFrame([("d", '{"relations": [{"subject": "a", "predicate": "p", "object": "b"}, {"subject": "a", "predicate": "p"}]}'), ("e", '[{"subject": "a", "predicate": "p", "object": "zzz"}]'), ("f", "no json")], "doc_id string, reply string")
    known = spark.createDataFrame([(d, s) for d in "def" for s in "ab"], "doc_id string, surface_form string")
    assert rows(corpus.parse_relations(replies, known), "doc_id", "subject", "predicate", "object") == {("d", "a", "p", "b")}


def test_pipeline_with_failures(spark, onto):
    docs = spark.createDataFrame([("good", "x"), ("bad", "fail")], "id string, text string")

    def extractor(text):
        if text == "fail":
            raise ValueError("no")
        return [("Orca", "Tanker"), ("Lindahl", "operator"), ("Norrvik", "Port")], [("Orca", "operated by", "Lindahl"), ("Norrvik", "operated by", "Lindahl"), ("Orca", "sank", "nobody")]

    g = pipeline.generate(docs, extractor, onto, enforce=True)
    assert rows(g.failed, "id", "error") == {("bad", "ValueError: no")}
    assert rows(g.triples, "subject_sf", "predicate_sf", "object_sf") == {("Orca", "operated by", "Lindahl")}
    e, r = pipeline.knowledge_graph(g, onto)
    assert e.count() == 3 and r.count() == 1
    with pytest.raises(stats.AllFailed):
        pipeline.generate(docs.where("id = 'bad'"), extractor)
    both = pipeline.aggregate_and_deduplicate([pipeline.generate(docs.where("id = 'good'"), extractor, deduplicate=False)] * 2)
    assert both.entities.count() == 3


def test_usage(spark):
    calls = spark.createDataFrame([("a", 1, 2, None), ("a", 3, 4, 9), ("b", 5, 6, None)], "step string, input_tokens long, output_tokens long, total_tokens long")
    assert rows(stats.usage(calls), "step", "prompt_tokens", "completion_tokens", "total_tokens") == {("a", 4, 6, 12), ("b", 5, 6, 11), (None, 9, 12, 23)}
    h = spark.createDataFrame([("a", "ok"), ("b", "名"), ("c", "x" * 2000)], "name string, value string")
    assert rows(stats.headers(h), "name") == {("a",)}


def test_heavy_nodes(spark, monkeypatch):
    """A star that holds nearly all edges, beside a path: the broadcast way and the shuffled way give the same."""
    monkeypatch.setattr(skew, "LIGHT", 5)
    monkeypatch.setattr(skew, "SHARE", 0.2)
    monkeypatch.setattr(components, "FINISH", 0)  # rounds, however few the edges
    edges = [(7, 100 + i) for i in range(60)] + [(k, k + 1) for k in range(20, 30)] + [(3, 130)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {**{n: 3 for e in edges if e[0] in (7, 3) for n in e}, **{k: 20 for k in range(20, 31)}}
    rows, keyed = spark.createDataFrame([(1,)] * 9 + [(2,), (4,)], "k long"), spark.createDataFrame([(1, 9, "x"), (2, 1, "y"), (3, 1, "z")], "k long, n long, v string")
    assert sorted(map(tuple, skew.heavy_join(rows, keyed, ["k"], "n", 11, "left").collect()), key=str) == sorted([(1, "x")] * 9 + [(2, "y"), (4, None)], key=str)


def test_components_raise_unfinished(spark, monkeypatch):
    monkeypatch.setattr(components, "FINISH", 0)
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    with pytest.raises(RuntimeError):
        connected_components(path, max_rounds=1)
    assert {r.component for r in connected_components(path).collect()} == {0}
