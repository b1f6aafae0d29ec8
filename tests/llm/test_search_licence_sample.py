"""Operators 11 to 13 against brute force, odd rows included."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import _words, importance, lexical_search, license_scan, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_pieces(odd_rows):
    for _, t in odd_rows:
        for size in (5, 1000, _words.PIECE):
            assert [w.decode() for part in _words.pieces((t or "").encode(), size) for w in part] == words(t)


# 11 --------------------------------------------------------------------------------------------

ITEMS = [(0, "word start END"), (1, None), (2, ""), (3, "nothing-of-it qqqqq"), (4, "A b c one two THREE 中文😀"), (4, "d e f"), (4, "d e f"), (None, "word"), (5, "word word word x y z one")]


def best(rows, items, k):
    docs = [(i, words(t)) for i, t in rows]
    n_docs, n_terms = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    of = {}
    for i, t in items:
        if i is not None:
            of.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in of.items():
        scores = []
        for d, w in docs:
            tf, m = Counter(w), 100 - 90 + 90 * len(w) * n_docs // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return ordered(out)


@pytest.mark.parametrize("k", (1, 3, 10))
def test_lexical_search(spark, odd, odd_rows, empty, listed, k):
    cols = ("item_id", "rank", "doc_id", "score")
    rng = random.Random(2)
    vocabulary = sorted({w for _, t in odd_rows for w in words(t)})
    items = ITEMS + [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))) for i in range(20)]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("s")).withColumn("doc_id", F.lit("d"))
    assert listed(lexical_search.ranked(odd, asked, k), *cols) == best(odd_rows, items, k)
    assert lexical_search.ranked(empty, asked, k).count() == 0
    assert lexical_search.ranked(odd, asked.limit(0), k).count() == 0


def test_lexical_search_in_small_blocks(spark, odd, odd_rows, listed, monkeypatch):
    """Many blocks, groups of queries one after another, and ties at the cut."""
    monkeypatch.setattr(lexical_search, "QUERY_BYTES", 40)
    monkeypatch.setattr(lexical_search, "TOGETHER", 2)
    rows = odd_rows + [(1000 + i, f"same words here {i % 3}") for i in range(200)]
    items = [(i, t) for i, t in enumerate(["same", "words here 1", "here 2 0", "one two", "word x"])]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert listed(lexical_search.ranked(docs, asked, 10), "item_id", "rank", "doc_id", "score") == best(rows, items, 10)


@pytest.mark.parametrize("seed", range(6))
def test_block_of_bit_slices(seed):
    rng = np.random.default_rng(seed)
    n, terms = int(rng.integers(1, 300)), 12
    table = np.where(rng.random((terms, n)) < 0.4, rng.integers(1, [5, 1 << 34][seed % 2], (terms, n)), 0)
    table[0] = 0  # a term in no document
    term, doc = np.nonzero(table)
    block = lexical_search.Block(np.arange(n) * 3, doc, term, table[term, doc], terms)
    asked = [np.array(sorted(rng.choice(terms, rng.integers(1, 9), replace=False))) for _ in range(7)] + [np.array([0]), np.array([-1])]
    for q, (ids, scores) in zip(asked, block.top(asked, 10)):
        total = table[q[q >= 0]].sum(axis=0)
        want = sorted((-int(s), 3 * i) for i, s in enumerate(total) if s > 0)[:10]
        assert sorted(zip((-scores).tolist(), ids.tolist())) == want


def test_block_without_documents():
    none = np.zeros(0, np.int64)
    assert [len(x) for x, _ in lexical_search.Block(none, none, none, none, 3).top([np.array([0, 1])], 5)] == [0]


# 12 --------------------------------------------------------------------------------------------


def base(t):
    w = words(t)
    found = sorted((s, label) for label, p in license_scan.PHRASES for s in range(len(w)) if w[s : s + len(p.split())] == p.split())
    return len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))


def filled(t):
    """The wording with two words put in after its ninth, where it is long; no key phrase stands there."""
    w = t.split()
    return " ".join(w[:9] + ["Example", "Holder"] + w[9:] if len(w) > 20 else w)


def test_license_scan(spark, odd, odd_rows, empty, listed):
    rows = odd_rows + [
        (100, "Released under the MIT-License. The apache\nLICENSE; GNU General Public License, mit license mit license"), (101, "mit"), (102, "license mit"), (103, "apache license"), (104, "general public general public license"), (105, "mit " * 30_000 + "license"),
        (106, "permission to use this general software is granted"), (107, "a license for the software, without restriction"),
    ]
    whole = [(200 + i, "intro words. " + filled(t.text) + " more words") for i, t in enumerate(license_scan.TEMPLATES)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows + whole], "doc_id long, text string, base string").repartition(3)
    got = listed(license_scan.report(df), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == ordered((i, *base(t)) for i, t in rows + whole)
    found = {r.doc_id: r for r in license_scan.report(df).collect() if r.doc_id is not None}
    for i, t in enumerate(license_scan.TEMPLATES):
        assert t.label in found[200 + i].labels.split(","), t.label
    assert set(found[100].labels.split(",")) == {"mit", "apache", "gpl"} and found[100].score == 1.0
    for i in (1, 2, 6, 41, 42, 70, 101, 102, 106, 107):  # clean
        assert found[i].labels == "" and found[i].score < 0.8 and found[i].n_base == 0
    assert all(0 <= r.score <= 1 for r in found.values())
    assert license_scan.report(empty).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_license_regions(seed):
    """What the index finds is what a search of every place finds, words in between or missing."""
    rng = random.Random(seed)
    t = license_scan.TEMPLATES[seed % len(license_scan.TEMPLATES)]
    w = words(t.text)
    text = [rng.choice(["the", "of", "software", "x", "license"]) for _ in range(40)] + [x for x in w if rng.random() > 0.1] + ["end"] * 10
    index = license_scan.Index((t,), (), 100, Counter(), 0.8)
    weight = index.weight[0]
    got = [(a, s) for _, a, _, s, _ in index.scan(" ".join(text).encode(), slack=0)[1] if s >= 0.8]
    want = []
    for s in range(-len(w) + 1, len(text)):
        share = sum(weight[q] for q in range(len(w)) if 0 <= s + q < len(text) and text[s + q] == w[q])
        if share >= 0.8:
            want.append((max(0, s), share))
    assert [a for a, _ in got] == [a for a, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])


def test_license_phrases_are_required():
    t = license_scan.Template("demo", "alpha beta gamma delta epsilon zeta eta theta iota kappa", ("alpha beta",))
    index = license_scan.Index((t,), (), 10, Counter(), 0.8)
    assert index.scan(b"alpha beta gamma delta epsilon zeta eta theta iota kappa")[1][0][4]
    assert not index.scan(b"alpha x gamma delta epsilon zeta eta theta iota kappa")[1][0][4]


# 13 --------------------------------------------------------------------------------------------


def sampled(rows, target, percent=5, least=20):
    def runs(t):
        w = words(t)
        return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    bucket = lambda x: zlib.crc32(x.encode()) % 10_000
    s, t = (Counter(bucket(x) for _, text in r for x in runs(text)) for r in (rows, target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    out = []
    for i, text in rows:
        f = runs(text)
        weight = sum(gain[bucket(x)] for x in f)
        h = None if i is None else int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))])
    able = sorted((r for r in out if r[0] is not None and r[4] >= least), key=lambda r: (-r[3], *r[:3]))
    rank = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return ordered((*r[:4], rank.get(id(r))) for r in out)


@pytest.mark.parametrize("percent", (5, 60))
def test_importance(spark, odd, odd_rows, empty, listed, percent):
    cols = ("doc_id", "n_features", "weight", "score", "rank")
    target = [(0, None), (1, ""), (2, "one two"), (3, " ".join((odd_rows[5][1] or "").split()[:60])), (3, "word word word")]
    wanted = spark.createDataFrame(target, "item_id long, text string").withColumn("buckets", F.lit(1))
    assert listed(importance.report(odd, wanted, percent=percent), *cols) == sampled(odd_rows, target, percent)
    assert listed(importance.report(odd, wanted.limit(0), percent=percent), *cols) == sampled(odd_rows, [], percent)
    assert importance.report(empty, wanted).count() == 0


def test_importance_prefers_the_target(spark):
    rng = random.Random(3)
    kind = lambda k: " ".join(f"{k}{rng.randrange(50)}" for _ in range(60))
    rows = [(i, kind("a" if i % 10 else "b")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit("kept"))
    drawn = importance.resample(docs, spark.createDataFrame([(kind("b"),) for _ in range(20)], "text string"), percent=10)
    assert drawn.columns == docs.columns and {r.doc_id % 10 for r in drawn.collect()} == {0}


def test_new_queries_are_registered():
    assert {"op11_ranked_lexical_search", "op12_license_scan", "op13_importance_resampling"} <= set(queries.QUERIES)
