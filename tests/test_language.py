"""Plurals, case folding and mixed replies."""

import pytest

from loomgraph.functions.plurals import IRREGULAR
from loomgraph.functions.text import FOLDED, casefold, dedup_form, nfkc, singularize
from loomgraph.sources import corpus

PAIRS = {
    "buses": "bus", "viruses": "virus", "campuses": "campus", "houses": "house", "causes": "cause", "uses": "use", "clauses": "clause", "gases": "gas", "databases": "database", "diseases": "disease", "cases": "case", "aliases": "alias", "atlases": "atlas",
    "indices": "index", "vertices": "vertex", "matrices": "matrix", "appendices": "appendix", "services": "service", "prices": "price", "analyses": "analysis", "theses": "thesis", "hypotheses": "hypothesis", "diagnoses": "diagnosis", "crises": "crisis", "roses": "rose", "phases": "phase", "exercises": "exercise",
    "criteria": "criterion", "phenomena": "phenomenon", "bacteria": "bacterium", "alumni": "alumnus", "nuclei": "nucleus", "larvae": "larva", "plateaux": "plateau",
    "wolves": "wolf", "knives": "knife", "lives": "life", "olives": "olive", "gloves": "glove", "caves": "cave", "valves": "valve", "curves": "curve", "leaves": "leaf", "shelves": "shelf", "drives": "drive", "archives": "archive",
    "cities": "city", "movies": "movie", "ties": "tie", "pies": "pie", "beaches": "beach", "branches": "branch", "caches": "cache", "headaches": "headache", "niches": "niche", "boxes": "box", "dishes": "dish", "classes": "class", "buzzes": "buzz", "quizzes": "quiz", "potatoes": "potato", "shoes": "shoe", "toes": "toe", "videos": "video",
    "businessmen": "businessman", "women": "woman", "policewomen": "policewoman", "grandchildren": "grandchild", "specimen": "specimen", "omen": "omen", "people": "person", "mice": "mouse", "lenses": "lens", "responses": "response", "courses": "course", "nurses": "nurse", "horses": "horse",
    "series": "series", "species": "species", "news": "news", "physics": "physics", "status": "status", "basis": "basis", "glass": "glass", "bus": "bus", "gas": "gas", "Texas": "Texas", "is": "is", "James": "James",
    "cats": "cat", "dogs": "dog", "Cats": "Cat", "Analyses": "Analysis", "Criteria": "Criterion", "Wolves": "Wolf", "CEOs": "CEO", "CBS": "CBS", "U.S.": "U.S.", "B2Bs": "B2Bs", "well-beings": "well-beings", "": "", "s": "s", "as": "as",
}


def test_singular_forms(spark):
    df = spark.createDataFrame([(k,) for k in PAIRS], "w string")
    got = {r.w: r.s for r in df.select("w", singularize("w").alias("s")).collect()}
    assert {k: (v, PAIRS[k]) for k, v in got.items() if v != PAIRS[k]} == {}


def test_singular_of_a_singular(spark):
    words = sorted({v for v in PAIRS.values() if v and v != "CEO"} | set(IRREGULAR.values()) - {"die"})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [(r.w, r.s) for r in df.select("w", singularize("w").alias("s")).collect() if r.w != r.s and r.w not in ("lens",)] == []


def test_folding_is_unicodes(spark):
    words = ["Straße", "STRASSE", "ẞ", "ΟΔΟΣ", "οδος", "ὈΔΥΣΣΕΎΣ", "ᾳ", "ﬁne", "İstanbul", "ΐ", "Ꭰꭰ", "plain", "", "ŉ", "ſ", "Ⅷ"]
    df = spark.createDataFrame([(w,) for w in [*words, None]], "w string")
    import unicodedata

    got = {r.w: (r.a, r.n) for r in df.select("w", casefold("w").alias("a"), casefold(nfkc("w")).alias("n")).collect()}
    assert got.pop(None) == (None, None)
    same = lambda a, b: a == b or (a, b) == ("Ꭰꭰ".lower(), "Ꭰꭰ".casefold())
    for w, (a, n) in got.items():
        assert same(a, w.casefold()), w
        assert same(n, unicodedata.normalize("NFKC", w).casefold()), w
    assert "ς" in FOLDED and "ß" in FOLDED


def test_forms_that_merge(spark):
    df = spark.createDataFrame([(w,) for w in ("Person", "person", "PERSON", "cat", "cats", "Buses", "bus", "kitten", "CEO")], "w string")
    got = {r.w: r.k for r in df.select("w", dedup_form("w").alias("k")).collect()}
    assert got["Person"] == got["person"] == got["PERSON"] and got["cat"] == got["cats"] and got["Buses"] == got["bus"]
    assert len(set(got.values())) == 5


@pytest.mark.parametrize(
    "reply, want",
    [
        ('["junk", {"subject": "a", "predicate": "p", "object": "b"}]', [(1, "p")]),
        ('{"relations": [{"subject": "a", "predicate": "p", "object": "b"}, 5]}', [(0, "p")]),
        ('[null, [1], {"subject": "a", "predicate": "p", "object": "b", "extra": {"x": [1]}}, {"subject": "a"}]', [(2, "p")]),
        ('[{"subject": "a", "predicate": "", "object": "b"}, {"subject": "", "predicate": "p", "object": "b"}]', []),
        ('[{"subject": {"name": "a"}, "predicate": "p", "object": "b"}, {"subject": 1, "predicate": "p", "object": "b"}, {"subject": "b", "predicate": "q", "object": "a"}]', [(2, "q")]),
        ('["{\\"subject\\": \\"a\\", \\"predicate\\": \\"p\\", \\"object\\": \\"b\\"}"]', []),
        ('{"subject": "a", "predicate": "p", "object": "b"}', []),
        ('{"relations": {"subject": "a"}}', []),
        ("[{broken", []),
        ("5", []),
        (None, []),
        ('[{"subject": "a", "predicate": "p", "object": "1"}, {"subject": "a", "predicate": "p", "object": "z"}]', [(0, "p")]),
    ],
)
def test_replies_item_by_item(spark, reply, want):
    known = spark.createDataFrame([("d", x) for x in ("a", "b", "1")], "doc_id string, surface_form string")
    got = corpus.parse_relations(spark.createDataFrame([("d", reply)], "doc_id string, reply string"), known)
    assert sorted((r.ord, r.predicate) for r in got.collect()) == want
