"""Substring dedup: Rabin-Karp hashes of every fixed-length token window.

Every window of ``window`` consecutive words is hashed (two polynomial bases:
64 bits, and further bits that name the bucket); Spark deals the hashes out by
bucket, finds for each the smallest document that has it, and the windows of
other documents merge into maximal removal intervals.

Defined cases: a null or empty text has no words; a text of fewer words than a
window keeps all; rows that share a doc_id don't remove each other's words; a
row without doc_id neither removes nor loses words; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _exchange as X
from . import _vec as V

_VALUES = V.byte_values(9)
_NONE = np.iinfo(np.int64).max


def _windows(ids: list, texts: list[bytes], k: int, buckets: int):
    """Of each window of rows with an id: bucket and key, row, first word; and the words' rows."""
    buf, at = V.pack(texts)
    starts, _, hashes = V.words(buf, V.SPACES, _VALUES)
    per = np.searchsorted(starts, at)
    keys, other = V.windows(hashes, k), V.windows(hashes, k, second=True)
    row = np.searchsorted(at, starts[: len(keys)], side="right") - 1 if len(keys) else np.zeros(0, np.int64)
    known = np.array([i is not None for i in ids], dtype=bool)
    fits = (np.arange(len(keys)) + k <= per[row + 1]) & known[row]
    place = np.flatnonzero(fits)
    return per, place, row[place], keys[place], (other[place] % np.uint64(buckets)).astype(np.int64)


def _unique(bucket: np.ndarray, keys: np.ndarray):
    """Windows sorted by bucket and key; of each distinct one where it begins in that order."""
    order = np.lexsort((keys, bucket))
    b, k = bucket[order], keys[order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
    return order, new


def repeated_windows(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", *, chunks: int | None = None, buckets: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, spans (word intervals removed, start and end), kept_text's sha256.

    ``spans`` holds maximal [start, end) word intervals as a flat array.
    """
    a, b = X.sizes(docs, text_col)
    chunks, buckets = chunks or a, buckets or b
    dealt = X.dealt(docs, chunks, id_col, text_col)

    def send(table: pa.Table) -> pa.Table:
        chunk, ids, texts = X.rows_of(table)
        _, _, row, keys, bucket = _windows(ids, texts, window, buckets)
        order, new = _unique(bucket, keys)
        # the smallest document of each distinct window; rows are in order of ids, and windows in order of rows
        first = np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order
        first.sort()
        order = first[np.argsort(bucket[first], kind="stable")]
        bucket, keys = bucket[order], keys[order]
        doc = np.array([0 if i is None else i for i in ids], np.int64)[row[order]]
        present, at = np.unique(bucket, return_index=True)
        rows = []
        for bkt, lo, hi in zip(present.tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)]):
            d = doc[lo:hi]
            cut = np.flatnonzero(np.diff(d, prepend=d[0] - 1))
            rows.append((bkt, chunk, keys[lo:hi].tobytes(), d[cut].tobytes(), np.diff(cut, append=hi - lo).astype(np.uint32).tobytes()))
        return X.batches(rows, ["bucket", "chunk", "keys", "ids", "runs"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])

    def answer(table: pa.Table) -> pa.Table:
        """A bit per window: whether a smaller document has it too."""
        keys = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
        doc = [np.repeat(np.frombuffer(i.as_py(), np.int64), np.frombuffer(r.as_py(), np.uint32)) for i, r in zip(table.column("ids"), table.column("runs"))]
        sizes = [len(x) for x in keys]
        k, d = np.concatenate(keys), np.concatenate(doc)
        order = np.argsort(k, kind="stable")
        ks = k[order]
        new = np.ones(len(ks), bool)
        new[1:] = ks[1:] != ks[:-1]
        heads = np.flatnonzero(new)
        least = np.minimum.reduceat(d[order], heads)
        late = np.empty(len(k), bool)
        late[order] = d[order] > np.repeat(least, np.diff(heads, append=len(ks)))
        out, at = [], 0
        for n in sizes:
            out.append(np.packbits(late[at : at + n]).tobytes())
            at += n
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "late": pa.array(out, pa.binary())})

    def use(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_removed", "spans", "kept_sha256"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
        if not left.num_rows:
            return X.batches([], names, types)
        _, ids, texts = X.rows_of(left)
        per, place, row, keys, bucket = _windows(ids, texts, window, buckets)
        gone = np.zeros(int(per[-1]) + 1, np.int32)
        if len(keys):
            order, new = _unique(bucket, keys)
            heads = np.flatnonzero(new)
            first = np.minimum.reduceat(order, heads)
            rank = np.sort(first)
            rank = rank[np.argsort(bucket[rank], kind="stable")]
            late = np.zeros(len(keys), bool)
            by = dict(zip(right.column("bucket").to_pylist(), right.column("late").to_pylist()))
            present, at = np.unique(bucket[rank], return_index=True)
            for b, lo, hi in zip(present.tolist(), at.tolist(), [*at[1:].tolist(), len(rank)]):
                late[rank[lo:hi]] = np.unpackbits(np.frombuffer(by[b], np.uint8), count=hi - lo).astype(bool)
            doc = np.array([0 if i is None else i for i in ids], np.int64)[row]
            n = np.diff(heads, append=len(order))
            bad = np.empty(len(keys), bool)
            bad[order] = np.repeat(late[first], n) | (doc[order] > np.repeat(doc[first], n))
            np.add.at(gone, place[bad], 1)
            np.add.at(gone, place[bad] + window, -1)
        gone = np.cumsum(gone[:-1]) > 0
        rows = []
        for i, (doc_id, text) in enumerate(zip(ids, texts)):
            lo, hi = int(per[i]), int(per[i + 1])
            g = gone[lo:hi]
            n = int(g.sum())
            kept, spans = text.split(), []
            if n:
                spans = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0)).tolist()
                kept = compress(kept, (~g).tolist())
            rows.append((doc_id, hi - lo, n, spans, hashlib.sha256(b" ".join(kept)).hexdigest()))
        return X.batches(rows, names, types)

    answers = X.ask(dealt, send, "bucket int, chunk int, keys binary, ids binary, runs binary", answer, "chunk int, bucket int, late binary")
    return X.gather(dealt, answers, use, "doc_id long, n_words long, n_removed long, spans array<long>, kept_sha256 string")
