"""N-Triples against the Turtle reader, and collections."""

import pytest

from loomgraph.plans import star
from loomgraph.sources import ntriples, turtle
from loomgraph.sources import ontology as O


def line(s, p, o, kind, lang):
    node = lambda x: x if x.startswith("_:") else f"<{x}>"
    return f"{node(s)} <{p}> {node(o) if kind != 'literal' else turtle._quote(o) + (f'@{lang}' if lang else '')} ."


def test_one_ontology_in_two_syntaxes(spark, tmp_path):
    rows = turtle.parse(star.TURTLE)
    path = str(tmp_path / "onto.nt")
    with open(path, "w") as f:
        f.write("# an ontology\n\n" + "\n".join(line(*r) for r in rows))
    read = ntriples.read(spark, path)
    assert {tuple(r) for r in read.collect()} == set(rows)
    a, b = O.ontology(read), O.ontology(O.triples(spark, star.TURTLE))
    for name in ("domains", "ranges", "closure"):
        assert {tuple(r) for r in getattr(a, name).collect()} == {tuple(r) for r in getattr(b, name).collect()}


def test_lines(spark, tmp_path):
    good = {
        '<a:s> <a:p> "x \\"y\\" \\u00e9\\n\\U0001F600" .': ("a:s", "a:p", 'x "y" é\n😀', "literal", None),
        '<a:s><a:p>""@en-GB.': ("a:s", "a:p", "", "literal", "en-GB"),
        '<a:s> <a:p> "1"^^<x:int> . # a # b': ("a:s", "a:p", "1", "literal", None),
        '<a:s> <a:p> "<a:b> ." .': ("a:s", "a:p", "<a:b> .", "literal", None),
        "<a:s>\t<a:p>\t<a:o>\t.": ("a:s", "a:p", "a:o", "iri", None),
        "_:x <a:p> _:y.z .": ("_:x", "a:p", "_:y.z", "blank", None),
    }
    bad = ["<a:s> <a:p> .", "<a:s> <a:p> <a:o>", '<a:s> "p" <a:o> .', "junk", '<a:s> <a:p> "open .']
    df = spark.createDataFrame([(x,) for x in [*good, *bad, "", "  # only a comment"]], "value string")
    got = {r.line: tuple(r)[1:] for r in ntriples.parse(df).collect()}
    assert got == good | {x: (None,) * 5 for x in bad}
    for i, text in enumerate(["_:x <a:p> _:x .", "_:x <a:p> <a:o> ."]):
        (tmp_path / f"{i}.nt").write_text(text)
    nodes = {r.s for r in ntriples.read(spark, str(tmp_path / "*.nt")).collect()}
    assert len(nodes) == 2  # a file's blank nodes are its own
    (tmp_path / "2.nt").write_text("<a:s> junk")
    with pytest.raises(ntriples.BadTriples, match="junk"):
        ntriples.read(spark, str(tmp_path / "*.nt"))


def test_collections():
    got = turtle.parse('@prefix : <u:> . :a :p (:x "y" (1)) ; :q () . (:z) :r :s .')
    first, rest, nil = turtle.RDF + "first", turtle.RDF + "rest", turtle.RDF + "nil"
    of = {(s, p): o for s, p, o, _, _ in got}
    head = of["u:a", "u:p"]
    assert of[head, first] == "u:x" and of[of[head, rest], first] == "y"
    inner = of[of[of[head, rest], rest], first]
    assert of[inner, first] == "1" and of[inner, rest] == nil and of[of[of[head, rest], rest], rest] == nil
    assert of["u:a", "u:q"] == nil and [o for (s, p), o in of.items() if p == "u:r"] == ["u:s"]
