"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of its
hashed words and word beginnings; the document's is their noisy-or, 1 minus the
product of (1 - score).  Only document labels are learnt from, by the gradient
through the noisy-or; afterwards the sentence scores locate what offends.

Fitted on a bounded sample (``most`` documents); nothing but the text is an input.
Defined cases: null or empty text, or one without words, has score 0 and no
sentences; without any usable label every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _labels
from . import _vec as V
from ._columns import free, map_rows, quoted

BITS = 20
#: Beginnings of words, in bytes, that are features besides the words.
PREFIXES = (4, 5, 6)
_VALUES = V.byte_values(7, fold_case=True)
_GAPS = ~V.byte_class([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_ENDS = V.byte_class(b".!?\n")


def instances(texts: list[bytes]):
    """Place and sentence of each distinct feature of a sentence; of each sentence its document, first byte and end there."""
    buf, at = V.pack(texts)
    start, end, *hashes = V.words(buf, _GAPS, _VALUES, PREFIXES)
    stops = np.flatnonzero(_ENDS[buf])
    number = np.searchsorted(stops, start)
    first = np.ones(len(number), bool)
    first[1:] = number[1:] != number[:-1]
    sentence = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    doc = np.searchsorted(at, start[heads], side="right") - 1
    last = np.append(heads[1:], len(number)) - 1
    place, where = [], []
    for h in hashes:
        has = h != 0
        place.append((h[has] >> np.uint64(64 - BITS)).astype(np.int64))
        where.append(sentence[has])
    once = np.unique(np.concatenate(where) << BITS | np.concatenate(place))
    return (once & ((1 << BITS) - 1)).astype(np.int32), (once >> BITS).astype(np.int32), doc, (start[heads] - at[doc] if len(heads) else heads), (end[last] - at[doc] if len(heads) else heads)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def gradient(place: np.ndarray, where: np.ndarray, doc: np.ndarray, y: np.ndarray, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Of the mean negative log likelihood of the documents' labels, by weight and by bias.

    A clean document's loss is the sum of its sentences' softplus; a toxic one's share
    of that is weighted by the odds that all its sentences are clean.
    """
    s = bias + np.bincount(where, weights=w[place], minlength=len(doc))
    mass = np.bincount(doc, weights=_softplus(s), minlength=len(y))
    g = np.where(y > 0, -1 / np.expm1(np.clip(mass, 1e-12, 500)), 1.0)[doc] * _logistic(s) / len(y)
    return np.bincount(place, weights=g[where], minlength=len(w)), float(g.sum())


def fit(texts: list[str], labels: list[int], updates: int = 450, rate: float = 0.4, least: int = 3, l1: float = 2e-4) -> np.ndarray:
    """Weights by place, the last the bias; features of fewer than ``least`` documents of the sample stay at 0.

    About so many updates by batches of 400 documents shrink weights to choose features; as many more fit the chosen ones.
    """
    epochs = max(1, updates // max(1, -(-len(texts) // 400)))
    out = np.zeros((1 << BITS) + 1, np.float32)
    out[-1] = -35
    parts, seen = [], np.zeros(1 << BITS, np.int32)
    for lo in range(0, len(texts), 400):
        place, where, doc, _, _ = instances([t.encode() for t in texts[lo : lo + 400]])
        pairs = np.unique(place.astype(np.int64) << 16 | doc[where])
        seen += np.bincount(pairs >> 16, minlength=1 << BITS).astype(np.int32)
        parts.append((place, where, doc, np.array(labels[lo : lo + 400], np.float64)))
    known = np.flatnonzero(seen >= least)
    if not len(parts) or not any(labels):
        return out
    to = np.full(1 << BITS, -1, np.int32)
    to[known] = np.arange(len(known))
    for i, (place, where, doc, y) in enumerate(parts):
        place = to[place]
        parts[i] = (place[place >= 0], where[place >= 0], doc, y)
    w, bias = np.zeros(len(known)), -5.0
    square, bias_square = np.full(len(known), 1e-6), 1e-6
    for epoch in range(2 * epochs):
        if epoch == epochs:
            chosen = w != 0
            parts = [(place[chosen[place]], where[chosen[place]], doc, y) for place, where, doc, y in parts]
            square, bias_square, l1 = np.full(len(known), 1e-6), 1e-6, l1 / 4
        for place, where, doc, y in parts:
            grad, at_bias = gradient(place, where, doc, y, w, bias)
            square += grad * grad
            step = rate / np.sqrt(square)
            w -= step * grad
            w = np.sign(w) * np.maximum(np.abs(w) - step * l1 * (grad != 0), 0)
            bias_square += at_bias**2
            bias -= rate / np.sqrt(bias_square) * at_bias
    out[known], out[-1] = w, bias
    return out


def sentence_scores(texts: list[bytes], weights: np.ndarray):
    """Document scores; of each sentence its document, start, end (bytes) and score."""
    place, where, doc, start, end = instances(texts)
    s = weights[-1] + np.bincount(where, weights=weights[place], minlength=len(doc))
    mass = np.bincount(doc, weights=_softplus(s), minlength=len(texts))
    return -np.expm1(-mass), doc, start, end, _logistic(s)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held: int = 0, most: int = 6000, most_bytes: int = 65536) -> np.ndarray:
    return fit(*_labels.sample(docs, labels, label, modulus, held, most, most_bytes))


def scored(docs: DataFrame, weights: np.ndarray, text_col: str = "text", offending: float = 0.5) -> DataFrame:
    """The table with toxic_score and toxic_sentences (start, end in bytes, score of each offending sentence), in place of columns of these names."""
    docs = docs.select(quoted(text_col).cast("string").alias(free(docs.columns, "given")), *[quoted(c) for c in docs.columns if c not in ("toxic_score", "toxic_sentences")])
    schema = T.StructType(docs.schema.fields[1:]).add("toxic_score", "double").add("toxic_sentences", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            total, bad, at, size = [], [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size < 2 << 20 and i < len(texts) - 1:
                    continue
                score, doc, start, end, each = sentence_scores(texts[at : i + 1], shared.value)
                found = [[] for _ in score]
                for k in np.flatnonzero(each >= offending).tolist():
                    found[doc[k]].append({"start": int(start[k]), "end": int(end[k]), "score": float(each[k])})
                total += score.tolist()
                bad += found
                at, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(total, pa.float64()), pa.array(bad, kind)], names=schema.names)

    return map_rows(docs, run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, modulus: int = 5, held: int = 0, most: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, and how many sentences offend."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scored(plain, train(docs, labels, "toxic", modulus, held, most))
    held_out = F.coalesce(_labels.crc_mod("doc_id", modulus) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= threshold).cast("int").alias("predicted"), F.size("toxic_sentences").cast("long").alias("n_offending"))
