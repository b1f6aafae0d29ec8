"""Quality classifier: hashed word n-gram logistic regression, fitted by
follow-the-regularised-leader and scored as sparse dot products.

Tokens are runs of letters and digits, and runs of punctuation; features are
unigrams and bigrams hashed to 2**BITS places (a token that repeats the one before
it gives one feature for all such bigrams), weighted by the square root of their
count and scaled to length one.

Fitted on a bounded sample (``most`` documents); nothing but the text is an input.
Defined cases: null or empty text, or one without tokens, gets the score of the
bias alone; without any usable label the score is 0.5; extra columns are ignored.
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

BITS = 19
_VALUES = V.byte_values(8)
_WORD = V.byte_class([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_PUNCT = ~_WORD & ~V.byte_class(range(33))
_REPEAT = np.uint64(0x7265706561743221)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of each feature, sorted by row and place."""
    buf, at = V.pack(texts)
    a, _, ha = V.words(buf, ~_WORD, _VALUES)
    b, _, hb = V.words(buf, ~_PUNCT, _VALUES)
    start = np.concatenate((a, b))
    order = np.argsort(start, kind="stable")
    token, row = np.concatenate((ha, hb))[order], np.searchsorted(at, start[order], side="right") - 1
    same = row[1:] == row[:-1]
    pair = np.where(token[1:] == token[:-1], _REPEAT, V.mix(token[:-1] * np.uint64(3) + token[1:]))[same]
    place = (np.concatenate((token, pair)) >> np.uint64(64 - BITS)).astype(np.int64)
    whole, count = np.unique(np.concatenate((row, row[1:][same])) << BITS | place, return_counts=True)
    row, place, value = whole >> BITS, whole & ((1 << BITS) - 1), np.sqrt(count)
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=len(texts)))
    return row, place, value / norm[row]


class Ftrl:
    """Follow-the-regularised-leader, by coordinate."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, y: int, bias: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x + bias, -35, 35)))
        g = (p - y) * x
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - s * w
        self.n[at] += g * g


def fit(texts: list[str], labels: list[int], updates: int = 18_000, epochs: int = 30) -> np.ndarray:
    """Weights by place; the last is the bias, the log odds of the labels: what a text of unknown words gets.

    Passes over the sample until there are about so many updates, at most ``epochs``.
    """
    epochs = max(1, min(epochs, -(-updates // max(1, len(texts)))))
    model = Ftrl(1 << BITS)
    parts = []
    for lo in range(0, len(texts), 100):
        row, place, value = features([t.encode() for t in texts[lo : lo + 100]])
        at = V.slices(row, len(texts[lo : lo + 100]))
        parts += [(place[a:b].astype(np.int32), value[a:b].astype(np.float32)) for a, b in zip(at[:-1], at[1:])]
    bias = float(np.log((sum(labels) + 0.5) / (len(labels) - sum(labels) + 0.5))) if labels else 0.0
    for _ in range(epochs):
        for (place, value), y in zip(parts, labels):
            model.update(place, value, y, bias)
    return np.append(model.weights(), bias).astype(np.float32)


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    row, place, value = features(texts)
    dot = np.bincount(row, weights=weights[place] * value, minlength=len(texts)) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(dot, -35, 35)))


def scored(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The table with a score column (0 to 1), in place of one of that name."""
    docs = docs.select(quoted(text_col).cast("string").alias(free(docs.columns, "given")), *[quoted(c) for c in docs.columns if c != score_col])
    out = T.StructType([*docs.schema.fields[1:], T.StructField(score_col, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            total, at, size = [np.zeros(0)], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= 2 << 20 or i == len(texts) - 1:
                    total.append(scores(texts[at : i + 1], shared.value))
                    at, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(total))], names=out.names)

    return map_rows(docs, run, out)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held: int = 2, most: int = 6000, most_bytes: int = 65536) -> np.ndarray:
    """Weights from labelled rows outside the held-out fold; at most ``most`` documents of at most ``most_bytes``."""
    return fit(*_labels.sample(docs, labels, label, modulus, held, most, most_bytes))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 4, held: int = 2, most: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scored(plain, train(docs, labels, "quality", modulus, held, most))
    return out.select("doc_id", F.coalesce(_labels.crc_mod("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
