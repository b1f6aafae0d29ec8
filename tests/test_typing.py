"""Typing of terms with a second attempt, and size guards that raise."""

import pytest

from loomgraph.operators import retrieval
from loomgraph.plans import pipeline, star
from loomgraph.sources import corpus


def test_terms_are_typed_again(spark):
    docs = spark.createDataFrame([("good", "t", ["a", "b"]), ("mended", "t", ["a"]), ("stays", "t", ["a", "b"]), ("fails", "t", None), ("once", "t", ["a"]), ("none", None, [])], "id string, text string, terms array<string>")

    def typer(text, terms, types, feedback):
        assert "Place" in types and "Vendor" not in types
        if terms is None:
            raise RuntimeError("no answer")
        if terms == ["a"]:
            return [("a", "Vendor" if feedback else "Thing")]
        return [(t, "Place" if t == "a" or feedback is None else "Thing") for t in terms]

    got = {r.doc_id: (r.score, r.error, [tuple(e) for e in r.entities]) for r in pipeline.type_terms(docs, typer, star.onto(spark)).collect()}
    assert got["good"] == got["stays"] == (1.0, None, [("a", "Place"), ("b", "Place")])
    assert got["mended"] == got["once"] == (1.0, None, [("a", "Vendor")])
    assert got["fails"] == (None, "RuntimeError: no answer", []) and got["none"] == (1.0, None, [])


def test_the_best_attempt_stays(spark):
    docs = spark.createDataFrame([("d", "t")], "id string, text string")
    answers = lambda text, terms, types, feedback: [("a", "Place"), ("b", "Thing")] if feedback is None else [("a", "Thing")]
    r = pipeline.type_terms(docs, answers, star.onto(spark), attempts=3).first()
    assert r.score == 0.5 and [e.type_label for e in r.entities] == ["Place", "Thing"]


def test_size_guards(spark):
    df = spark.createDataFrame([("1", "abc"), ("2", "é")], "id string, text string")
    assert corpus.checked(df, 5).count() == 2
    with pytest.raises(corpus.TooLarge, match="5 bytes are more than 4"):
        corpus.checked(df, 4)
    with pytest.raises(corpus.Empty, match="1 of 3"):
        corpus.checked(df.union(spark.createDataFrame([("3", "")], df.schema)))
    with pytest.raises(corpus.Empty, match="no documents"):
        corpus.checked(df.limit(0))


def test_relation_vectors(spark):
    r = spark.createDataFrame([("a", "p", "b"), ("c", "p", "b"), ("a", "qq", "b")], "subject_sf string, predicate_sf string, object_sf string")
    got = retrieval.embed_relations(r, lambda texts: [[float(len(t))] for t in texts]).collect()
    assert sorted((x.predicate_sf, list(x.embedding)) for x in got) == [("p", [1.0]), ("qq", [2.0])]
