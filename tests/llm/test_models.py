"""Classifiers by held-out accuracy, top-k against brute force, the pipeline stage by stage."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from loomgraph.llm import ngram_join, pii, quality, topk, toxicity

DATA = "/root/testdata/sf0.01"


def held(rows, modulus, fold):
    return [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % modulus == fold]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.mark.parametrize("module,label,modulus,fold,least", [(quality, "quality", 4, 2, 0.95), (toxicity, "toxic", 5, 0, 0.9)])
def test_held_out_accuracy(tables, module, label, modulus, fold, least):
    docs, labels = tables
    truth = {r.doc_id: r[label] for r in labels.collect()}
    out = module.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.doc_id for r in out if r.held_out} == {r.doc_id for r in held(out, modulus, fold)}
    tested = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) >= least


def test_classifiers_take_odd_rows(odd, empty, tables):
    docs, labels = tables
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        weights = module.train(docs, labels, label)
        out = module.scored(odd, weights)
        assert out.count() == odd.count() and set(out.columns) > set(odd.columns) - {"score"}
        assert module.classify(odd, labels.limit(0)).count() == odd.count()
        assert module.classify(empty, labels).count() == 0


def test_columns_of_any_name_stay(spark, tables):
    """Columns whose names hold dots, or are those that the operators use while they work."""
    import public_tokenizers as P

    from loomgraph.llm import byte_bpe

    df = spark.createDataFrame([(1, "some text", 1, "x", 2)], "doc_id long, text string, `a.b` int, given string, `__given_text` int")
    w = quality.fit(["good", "bad"], [1, 0])
    assert quality.scored(df, w).drop("score").collect() == df.collect()
    assert toxicity.scored(df, np.zeros((1 << toxicity.BITS) + 1, np.float32)).drop("toxic_score", "toxic_sentences").collect() == df.collect()
    assert pii.sanitise(df).collect() == df.collect()
    assert byte_bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).drop("ids", "decoded").collect() == df.collect()


def test_ftrl_is_the_plain_loop():
    """Fitting, against follow-the-regularised-leader written out by coordinate in plain numbers."""
    rng = np.random.default_rng(3)
    words = ["good", "fine", "bad", "junk", "!!", "text", "more"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 6))) for _ in range(40)]
    labels = [int("good" in t or "fine" in t) for t in texts]
    got = quality.fit(texts, labels, updates=120)
    row, place, value = quality.features([t.encode() for t in texts])
    bias = math.log((sum(labels) + 0.5) / (len(labels) - sum(labels) + 0.5))
    z, n = Counter(), Counter()

    def weight(i, alpha=0.5, beta=1.0, l1=0.02, l2=0.1):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for t, y in enumerate(labels):
            x = [(int(i), float(np.float32(v))) for i, v in zip(place[row == t], value[row == t])]
            w = {i: weight(i) for i, _ in x}
            p = 1 / (1 + math.exp(-(sum(w[i] * v for i, v in x) + bias)))
            for i, v in x:
                g = (p - y) * v
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5
                z[i] += g - s * w[i]
                n[i] += g * g
    assert {i: pytest.approx(weight(i), abs=1e-4) for i in z} == {i: float(got[i]) for i in z}
    assert got[-1] == pytest.approx(bias, abs=1e-6) and np.count_nonzero(got) <= len(z) + 1


def test_noisy_or_and_its_gradient():
    """Document scores by the product formula; the gradient that fitting follows, by finite differences of the log likelihood."""
    texts = [b"calm words here. vile insult now! more calm", b"calm words", b"", b"vile vile. insult"]
    rng = np.random.default_rng(5)
    w = rng.normal(0, 0.5, (1 << toxicity.BITS) + 1)
    w[-1] = -1.0
    place, where, doc, *_ = toxicity.instances(texts)

    def scores(w):
        s = [w[-1] + sum(w[p] for p, k in zip(place, where) if k == i) for i in range(len(doc))]
        clean = np.ones(len(texts))
        for i, d in enumerate(doc):
            clean[d] *= 1 - 1 / (1 + math.exp(-s[i]))
        return 1 - clean

    assert toxicity.sentence_scores(texts, w)[0] == pytest.approx(scores(w), abs=1e-9)
    y = np.array([1.0, 0.0, 0.0, 1.0])
    loss = lambda w: -sum(math.log(p) if t else math.log(1 - p) for p, t in zip(scores(w), y) if not (t and p == 0)) / len(y)
    g, bias = toxicity.gradient(place, where, doc, y, w[:-1], w[-1])
    for p in [*sorted(set(place.tolist()))[::7], -1]:
        step = np.zeros(len(w))
        step[p] = 1e-5
        assert (bias if p == -1 else g[p]) == pytest.approx((loss(w + step) - loss(w - step)) / 2e-5, abs=1e-6)


def test_offending_sentences_are_located():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    sentence = lambda bad=False: " ".join(rng.choices(words, k=8) + ["idiot"] * bad) + ". "
    texts, labels = [], []
    for i in range(300):
        at = rng.randrange(6) if i % 3 == 0 else -1
        texts.append("".join(sentence(k == at) for k in range(6)))
        labels.append(int(at >= 0))
    w = toxicity.fit(texts, labels)
    t = (sentence() + sentence(True) + sentence()).encode()
    total, doc, start, end, each = toxicity.sentence_scores([t, b""], w)
    worst = int(np.argmax(each))
    assert total[0] > 0.5 and total[1] == 0 and b"idiot" in t[start[worst] : end[worst]] and (each > 0.5).sum() == 1


def test_a_text_of_unknown_words_gets_the_bias():
    w = quality.fit(["good words here"] * 9 + ["bad !! junk !!"], [1] * 9 + [0])
    assert quality.scores([b""], w)[0] == pytest.approx(9.5 / 11, abs=1e-5)


def brute(rows, k):
    ok = [(i, np.floor(64 * np.array(v))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    out = []
    for i, v in {(i, tuple(v)) for i, v in ok if i % 20 == 0}:
        dot = lambda w: int(sum(a * b for a, b in zip(v, w)))
        best = sorted(((-dot(w), j) for j, w in ok if j != i))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("n,k", [(300, 7), (4, 20)])
def test_top_k(spark, monkeypatch, n, k):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = random.Random(n)
    rows = [(i, [rng.choice([-0.5, 0.25, 1.0, rng.random()]) for _ in range(8)]) for i in range(n)]
    rows += [(1000, None), (1020, [None, 1.0]), (1040, [float("nan")] * 8), (1060, [float("inf")] * 8), (1001, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in topk.top_k(df.where("vec_id % 20 = 0"), df, k=k).collect())
    assert got == brute(rows, k)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_of_components_that_scale_beyond_doubles(spark):
    """Finite components whose scaled value is infinite: their vectors take no part; what is just below does."""
    rows = [(i, [1e307 * i, 2.0]) for i in range(1, 18)] + [(40, [1e306, 1.0]), (60, [-1e306, 1.0]), (80, [0.0, 1.0]), (100, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df.where("vec_id >= 40"), df, k=20).collect()
    some = {r.vec_id for r in got}
    assert some == {40, 60, 80} and {r.query_id for r in got} == {40, 60, 80}
    assert {(r.query_id, r.vec_id): r.score for r in got}[80, 40] == 64 * 64


@pytest.mark.parametrize("size", [1 << 21, 1 << 23, 1 << 40])
def test_top_k_beyond_floating_point(spark, size):
    """Scores over 2**53, which floats would round together, and over 2**63, which are cut off."""
    rng = random.Random(size)
    rows = [(i, [float(size + rng.randrange(-9, 10)) for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df.where("vec_id % 20 = 0"), df, k=5).collect())
    if size < 1 << 30:
        assert got == brute(rows, 5) and max(r[3] for r in got) > 1 << 53
    else:
        assert len(got) == 50 and {r[3] for r in got} == {(1 << 63) - 1}


def test_large_components_stay_exact():
    a = np.array([[1 << 30, 3]], np.int64)
    assert int(sum(topk._products(a, a, 2))[0, 0]) == (1 << 60) + 9


def test_pipeline(spark, tables):
    docs, labels = tables
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "pii", "byte_bpe"]
    kept, ids = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    bad = {r.doc_id for r in labels.collect() if not r.quality}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, kept, DATA))
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= ids
        if name != "byte_bpe":
            assert out.columns == docs.columns
        if name == "quality_classifier":
            assert len(now & bad) <= 0.1 * len(bad) and len(ids - now - bad) <= 0.1 * len(ids)
        if name == "ngram_jaccard_join":
            again = ngram_join.near_duplicates(out)
            assert again.where("doc_id <> component_id").count() == 0
            assert now == {r.component_id for r in ngram_join.near_duplicates(kept).collect()}
        if name == "pii":
            assert not any(pii.base_spans(r.text) for r in out.collect()) and now == ids
        kept, ids = out, now
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()} == ids


def test_pipeline_takes_odd_rows(spark, odd_rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in odd_rows], "doc_id long, text string, lang string, source string, n_chars long")
    first = corpus_pipeline.stored(corpus_pipeline.keep_good(spark, docs.selectExpr("*", "1 as score", "2 as `a.b`", "3 as node"), DATA))
    assert first.columns == [*docs.columns, "score", "a.b", "node"] and first.count() <= docs.count()
    assert corpus_pipeline.keep_one(spark, first, DATA).columns == first.columns
    assert corpus_pipeline.keep_good(spark, docs.limit(0), DATA).count() == 0
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.stored(stage(spark, docs, DATA))
    assert docs.where("doc_id = 1").count() == 1 and docs.where("doc_id = 60").count() == 1


def test_keep_one_tells_shared_ids_apart(spark):
    rows = [(7, "one two three four five six"), (7, "one two three four five six"), (7, "wholly different words stand in this row"), (8, "ONE two three four five six"), (None, "one two three four five six"), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.keep_one(spark, df, "").collect()))
    assert got == [(0, rows[0][1]), (7, rows[0][1]), (7, rows[2][1]), (9, "")]
