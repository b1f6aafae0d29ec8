import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomgraph.operators import chunk


def column(spark, f, values):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalize_label(spark):
    from loomgraph.functions.text import normalize_label

    given = ["birth place", "birth_date", "birthPlace", "Birth Place", "  birth   place ", "ex-spouse", "CEO", "HTTPServer", None, "Straße", "中国"]
    assert column(spark, normalize_label, given) == ["birth place", "birth date", "birth place", "birth place", "birth place", "ex spouse", "ceo", "http server", "", "strasse", ""]


def test_singularize(spark):
    from loomgraph.functions.text import dedup_form, singularize

    same = ["1970s", "CBS", "Governor-General", "bus", "class", "is"]
    assert column(spark, singularize, same) == same
    assert column(spark, singularize, ["Cats", "PGA Championships", "cities", "Children", "boxes", "churches"]) == ["Cat", "PGA Championship", "city", "Child", "box", "church"]
    a, b = column(spark, singularize, ["Comanches", "Comanche"])
    assert a == b
    assert column(spark, dedup_form, ["ＣＡＴｓ", "cat"]) == ["cat", "cat"]


def test_xsd_guess(spark):
    from loomgraph.functions.xsd import guess

    cases = {"": "string", "12": "integer", "99999999999999999999": "integer", "1.5": "decimal", "1e3": "decimal", "1e999": "string", "nan": "string", "TRUE": "boolean", "2020-13-45": "date", "2020-01-01T00:00:00Z": "dateTime", "x": "string"}
    assert column(spark, guess, list(cases)) == [f"xsd:{v}" for v in cases.values()]


def test_predicate_datatype(spark):
    from pyspark.sql import functions as F

    from loomgraph.functions.xsd import NAMESPACE, predicate_datatype

    rows = [("owl:DatatypeProperty", [NAMESPACE + "date"]), ("owl:ObjectProperty", ["xsd:date"]), ("owl:DatatypeProperty", []), ("owl:ObjectProperty", ["http://x/A"]), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, r array<string>")
    assert [r.x for r in df.select("i", predicate_datatype(F.col("k"), F.col("r")).alias("x")).orderBy("i").collect()] == ["xsd:date", "xsd:date", "", None, None]


def test_colour_and_blob(spark):
    import colorsys
    import hashlib

    from loomgraph.functions.text import blob_id, colour

    names = ["entity::a", "entity::Ada", "edge::works for", ""]

    def want(x):
        h, s, light = (b / 255 for b in hashlib.sha1(x.encode()).digest()[:3])
        return "#" + "".join(f"{int(c * 255):02x}" for c in colorsys.hls_to_rgb(h, 0.45 + light * 0.25, 0.55 + s * 0.3))

    assert column(spark, colour, names) == [want(x) for x in names]
    assert column(spark, blob_id, ["x"]) == ["blob:" + hashlib.sha256(b"x").hexdigest()[:16]]


@given(st.text(alphabet="ab. !\n", max_size=300), st.integers(5, 60))
def test_chunks_lose_no_word_and_keep_the_limit(text, most):
    out = chunk.chunks(text, most)
    assert " ".join(out).split() == text.split()
    assert all(c for c in out)
    assert all(len(c) <= most or " " not in c for c in out)


def test_chunk_sentences():
    assert chunk.chunks("Short text.") == ["Short text."]
    assert chunk.sentences("Dr. Who came. He left! Why?") == ["Dr. Who came.", "He left!", "Why?"]
    assert all(len(c) <= 20 for c in chunk.chunks("word " * 100, 20))


def test_turtle():
    from loomgraph.sources import turtle

    text = '@prefix e: <http://e/> .\ne:a a e:C ; e:p "x"@en, """long "q" """, 1.5 ; e:q [ e:r e:b ] . # end\n'
    rows = turtle.parse(text)
    assert ("http://e/a", turtle.RDF + "type", "http://e/C", "iri", None) in rows
    assert ("http://e/a", "http://e/p", "x", "literal", "en") in rows
    assert ("_:b1", "http://e/r", "http://e/b", "iri", None) in rows
    assert len(rows) == 6
    for bad in ("e:a e:b e:c .", '<a> <b> "x', "<a> <b> <c>"):
        with pytest.raises(turtle.TurtleError):
            turtle.parse(bad)


def test_turtle_round_trip():
    from loomgraph.sources import turtle

    classes = [{"uri": "http://e/A", "label": 'An "A"', "description": "two\nlines"}, {"uri": None, "label": "left out"}]
    predicates = [{"uri": "http://e/p", "label": "p", "domain": ["http://e/A"], "range": [turtle.XSD + "date"]}]
    rows = {(s.rsplit("/")[-1], p.rsplit("#")[-1], o) for s, p, o, _, _ in turtle.parse(turtle.write(classes, predicates))}
    assert ("A", "label", 'An "A"') in rows and ("A", "comment", "two\nlines") in rows
    assert ("p", "type", turtle.OWL + "DatatypeProperty") in rows and ("p", "domain", "http://e/A") in rows
    assert len({s for s, _, _ in rows}) == 2
