"""Ranked lexical search over a bit-sliced impact index.

A term's impact on a document is an integer that grows with its rarity and its
frequency there and falls with the document's length; a document's score for a query
is the sum of its terms' impacts.  Documents stand in blocks.  In a block every term
has, for each bit of its impacts, a bitmap of the documents that have that bit set;
a query's scores come from adding its terms' bitmaps by bitwise carry arithmetic, 64
documents a machine word and all queries of a group together, and the highest k are
found by descending from the most significant slice of the sums.

Texts are read once: what is stored of a document is its length and how often each
term of the queries occurs.  Statistics cover all documents.  Queries travel to the
documents; where their texts exceed ``QUERY_BYTES``, they go in groups below it, one
after another.  A task sends on k documents a query, whatever number of blocks it reads.

Defined cases: null or empty text has no terms; such documents count nowhere; a
document without doc_id counts in the statistics and is no result; rows that share a
doc_id are documents each; queries that share an id are one, with the terms of all;
queries without id or terms have no results; a term counts once however often a query
holds it; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import batched, stored

from ._columns import quoted
from ._memory import tidy
from ._words import pieces
from .decontamination import words

#: Bytes of query texts in a group.
QUERY_BYTES = 16 << 20
#: Documents, and terms of documents, in a block at most; queries that are added up together.
BLOCK_DOCS, BLOCK_TERMS, TOGETHER = 8192, 1 << 19, 256

#: Parameters of the impacts, in thousandths where they are fractions: fixed values.
SCALE, K1, B = 1_000_000_000, 8, 90


def postings(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), term (places in the list, ascending), tf; of documents with at least one term of any kind."""
    number = {t.encode(): i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()
            keep, lengths, found, times = [], [], [], []
            for i, raw in zip(ids, texts):
                n, have = 0, Counter()
                for part in pieces(raw or b""):
                    n += len(part)
                    have.update(filter(None.__ne__, map(number.get, part)))
                if n:
                    order = sorted(have)
                    keep.append(i)
                    lengths.append(n)
                    found.append(order)
                    times.append([have[t] for t in order])
            columns = [pa.array(keep, pa.int64()), pa.array(lengths, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "term", "tf"])

    rows = batched(docs).select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n long, term array<int>, tf array<long>")


class Block:
    """The bit-sliced index of some documents: slices[b, g] has bit b of the impacts of one term on 64 neighbouring documents."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        #: ids ascending; doc, term, impact: of each occurrence, by term and then document.
        self.ids, self.words = ids, -(-len(ids) // 64)
        key = term.astype(np.int64) * self.words + (doc >> 6)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.at = key[first] % self.words
        self.start = np.searchsorted(key[first], np.arange(terms + 1) * self.words)
        self.bits = int(impact.max(initial=0)).bit_length()
        place, one = (doc & 63).astype(np.uint64), np.uint64(1)
        self.slices = np.zeros((self.bits, len(first)), np.uint64)
        for b in range(self.bits if len(key) else 0):
            self.slices[b] = np.bitwise_or.reduceat(((impact >> b).astype(np.uint64) & one) << place, first)

    def spread(self, terms: np.ndarray) -> np.ndarray:
        """[bit, query, word]: the slices of one term for each query; -1 stands for none."""
        out = np.zeros((self.bits, len(terms), self.words), np.uint64)
        known = np.maximum(terms, 0)
        low, size = self.start[known], np.where(terms < 0, 0, self.start[known + 1] - self.start[known])
        row = np.repeat(np.arange(len(terms)), size)
        group = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        out[:, row, self.at[group]] = self.slices[:, group]
        return out

    def sums(self, queries: list[np.ndarray]) -> np.ndarray:
        """[bit, query, word]: the slices of the queries' scores, by carry arithmetic."""
        longest = max(map(len, queries))
        padded = np.full((longest, len(queries)), -1, np.int64)
        for j, q in enumerate(queries):
            padded[: len(q), j] = q
        acc = np.zeros((self.bits + longest.bit_length(), len(queries), self.words), np.uint64)
        for terms in padded:
            more, carry = self.spread(terms), None
            for b in range(len(acc)):
                if b < self.bits:
                    a, x = acc[b].copy(), more[b]
                    half = a ^ x
                    if carry is None:
                        acc[b], carry = half, a & x
                    else:
                        acc[b], carry = half ^ carry, (a & x) | (half & carry)
                else:
                    if carry is None or not carry.any():
                        break
                    acc[b], carry = acc[b] ^ carry, acc[b] & carry
        return acc

    def top(self, queries: list[np.ndarray], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of its k best documents, scores above 0, ties to the smaller id."""
        acc = self.sums(queries)
        count = lambda x: np.bitwise_count(x).sum(axis=1)
        open_, sure = np.bitwise_or.reduce(acc, axis=0), np.zeros(acc.shape[1:], np.uint64)
        for b in range(len(acc) - 1, -1, -1):
            with_bit = open_ & acc[b]
            n = count(sure | with_bit)[:, None]
            sure = np.where(n <= k, sure | with_bit, sure)
            open_ = np.where(n > k, with_bit, open_ & ~acc[b])
        out = []
        for j in range(len(queries)):
            best, ties = _members(sure[j]), _members(open_[j])
            docs = np.concatenate((best, ties[: k - len(best)]))
            bits = (acc[:, j, docs >> 6] >> (docs & 63).astype(np.uint64)) & np.uint64(1)
            scores = sum((bits[b].astype(np.int64) << b for b in range(len(acc))), np.zeros(len(docs), np.int64))
            out.append((self.ids[docs], scores))
        return out


def _members(bitmap: np.ndarray) -> np.ndarray:
    """Places of the bits that are set, ascending."""
    some = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[some].astype("<u8").view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return some[row] * 64 + bit


def _blocks(batches: Iterator[pa.RecordBatch], weight: np.ndarray, n_docs: int, all_terms: int) -> Iterator[Block]:
    """Rows of ``postings`` as indexes of bounded size; a document of more terms than a block holds is a block of its own."""

    def made(rows: list) -> Block:
        rows.sort(key=lambda r: (r[0], r[1]))
        size = np.array([len(r[2]) for r in rows])
        doc = np.repeat(np.arange(len(rows)), size)
        term, tf = (np.concatenate([r[c] for r in rows]).astype(np.int64) for c in (2, 3))
        m = np.array([100 - B + B * r[1] * n_docs // all_terms for r in rows], np.int64)[doc]
        impact = weight[term] * ((SCALE * tf) // (1000 * tf + K1 * m))
        order = np.argsort(term, kind="stable")
        return Block(np.array([r[0] for r in rows], np.int64), doc[order], term[order], impact[order], len(weight))

    rows, held = [], 0
    for batch in batches:
        term, tf = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3)))
        ids, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(len(ids)):
            r = (ids[i], lengths[i], *(values[at[i] : at[i + 1]] for values, at in (term, tf)))
            if rows and (len(rows) >= BLOCK_DOCS or held + len(r[2]) > BLOCK_TERMS):
                yield made(rows)
                rows, held = [], 0
            rows.append(r)
            held += len(r[2])
    if rows:
        yield made(rows)


def _search(post: DataFrame, asked: dict, terms: list[str], k: int) -> DataFrame:
    """(query, doc_id, score): of each task the k best documents of every query, at most."""
    n_docs, all_terms = post.agg(F.count("*"), F.sum("n")).first()
    df = {r.term: r.df for r in post.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row a term of the group's queries
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))], np.int64)
    names = sorted(asked)
    # terms of weight 0 or in no document add nothing
    queries = [np.array(sorted(t for t in asked[q] if df.get(t) and weight[t]), np.int64) for q in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        for block in _blocks(batches, weight, n_docs, all_terms):
            for at in range(0, len(queries), TOGETHER):
                for j, (ids, scores) in enumerate(block.top([q if len(q) else np.array([-1]) for q in queries[at : at + TOGETHER]], k), at):
                    best[j] = sorted([*best[j], *zip((-scores).tolist(), ids.tolist())])[:k]
        rows = [(j, i, -s) for j, found in enumerate(best) for s, i in found]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in columns[0]], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["query", "doc_id", "score"])

    return post.where("doc_id is not null and size(term) > 0").mapInArrow(tidy(run), "query long, doc_id long, score long")


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: of each query its k highest scores above 0, ties to the smaller doc_id."""
    asked = queries.select(quoted(query_id).cast("long").alias("query"), F.array_distinct(words(quoted(query_text).cast("string"))).alias("terms")).where("query is not null and size(terms) > 0")
    groups = 1 + int(asked.agg(F.sum(F.octet_length(F.array_join("terms", " ")))).first()[0] or 0) // QUERY_BYTES
    found = None
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(groups)) == g).collect()  # QUERY_BYTES, about
        terms = sorted({t for r in rows for t in r.terms})
        number, of = {t: i for i, t in enumerate(terms)}, {}
        for r in rows:
            of.setdefault(r["query"], set()).update(number[t] for t in r.terms)
        part = _search(stored(postings(docs, terms, id_col, text_col)), of, terms, k)
        found = part if found is None else found.unionAll(part)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("item_id"), "rank", "doc_id", "score")
