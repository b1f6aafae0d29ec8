"""Suffix-array dedup: repeated byte strings by threshold-bounded interval expansion.

Every byte covered by a ``length``-byte string that also starts earlier (in a smaller
doc_id, or earlier in the same document) is found and removed.

1. Each window of ``length`` bytes belongs to its anchor, the leftmost of its
   ``length // 2``-grams with the least hash; the windows of one anchor are
   consecutive and span a region of less than twice the length. Equal windows have
   equal anchors, so regions are dealt out by the anchor's hash.
2. Regions that equal an earlier one (copies, common passages) collapse by hash, in
   their chunk first: they are repeated as a whole.
3. Where an anchor has several different regions, the first of each comes together
   with the rest of its bucket in one text. Its Burrows-Wheeler transform is
   expanded breadth first: from the interval of the empty string, every interval is
   extended backward by the symbols that precede it, level by level; an interval's
   end that is new at level l has a common prefix of l bytes with its neighbour.
   Expansion stops at ``length``: neighbours that no level has parted share at least
   that many bytes, and of each such class all but the earliest are repeated.

Defined cases: null text is empty; shorter texts lose nothing; matches never cross
documents; rows that share a doc_id are ordered by a hash and their text, so that a
repeated row is removed once; rows without doc_id come last; an empty table gives an
empty table; other columns are ignored; ``length`` is at most ``MOST``, and a chunk
of 4 GiB or more is refused rather than cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _exchange as X
from . import _vec as V
from ._memory import tidy

_U = np.uint64
_VALUES = V.byte_values(2)
_TILE = 1 << 19
_LAST = np.iinfo(np.int64).max
#: Longest ``length``: a region's windows and distances are kept in a byte each.
MOST = 500


def regions(buf: np.ndarray, at: np.ndarray, length: int):
    """Anchor position, distance from the first window to it, windows, anchor hash and content hash of every region."""
    gram = length // 2
    width = length - gram + 1
    out = []
    n = len(buf)
    for lo in range(0, n, _TILE):
        hi = min(n, lo + _TILE)
        to = min(n, hi + length)  # windows that start before hi end before it
        part = buf[lo:to]
        m = len(part)
        if m < length:
            continue
        up, down = V.powers(m)
        total = np.concatenate((np.zeros(1, _U), np.cumsum(_VALUES[part] * up[:m], dtype=_U)))
        grams = V.mix((total[gram:] - total[:-gram]) * down[: m - gram + 1])
        least = (grams >> _U(20) << _U(20)) | np.arange(len(grams), dtype=_U)
        span = 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        least = least[: hi - lo]
        anchor = (least & _U(0xFFFFF)).astype(np.int64)
        start = np.arange(len(anchor))
        end_of = at[np.searchsorted(at, start + lo, side="right")] - 1  # of the window's document, without the byte that parts it from the next
        inside = start + lo + length <= end_of
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (end_of[1:] != end_of[:-1])
        first = np.flatnonzero(new)
        count = np.diff(first, append=len(anchor))
        ok = inside[first]
        a, c = first[ok], count[ok]
        p = anchor[a]
        content = V.mix((total[a + c - 1 + length] - total[a]) * down[a] ^ (c.astype(_U) << _U(8)) ^ (p - a).astype(_U))
        out.append((p + lo, p - a, c, grams[p], content))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    return tuple(np.concatenate(x) for x in zip(*out))


_REGION = np.dtype([("p", "<u4"), ("d", "u1"), ("c", "u1")])
_ENTRY = np.dtype([("key", "u1", 5), ("content", "u1", 6), ("p", "<u4"), ("d", "u1"), ("c", "u1")])


def _low(x: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :n]


def _high(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, : x.shape[1]] = x
    return out.reshape(-1).view(_U)


def common_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a text of small integers and whether each suffix shares ``length`` symbols with the one before.

    The order is by the first ``length`` symbols or more, which is all that the expansion reads.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    step = 63 // bits
    padded = np.concatenate((text.astype(np.int64), np.zeros(step, np.int64)))
    key = np.zeros(n, np.int64)
    for i in range(step):
        key = key << bits | padded[i : n + i]
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], key[order[1:]] != key[order[:-1]])))
        if step >= length or rank[order[-1]] == n - 1:
            break
        following = np.zeros(n, np.int64)
        if step < n:
            following[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + following
        step *= 2
    bwt = text[order - 1].astype(np.int64)  # the first suffix is preceded by the last symbol, a separator
    before = np.argsort(bwt, kind="stable")
    table = bwt[before] * (n + 1) + before  # sorted: where a symbol's occurrences up to a place end
    follow = np.empty(n, np.int64)
    follow[before] = np.arange(n)
    symbols = np.unique(bwt)
    parted = np.zeros(n + 1, bool)
    parted[0] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        size = hi - lo
        one = size == 1
        ends = [follow[lo[one]] + 1]
        starts = [follow[lo[one]]]
        few, many = (~one) & (size <= len(symbols)), size > len(symbols)
        for pick in (few, many):
            a, b = lo[pick], hi[pick]
            if not len(a):
                continue
            if pick is few:
                which = np.repeat(np.arange(len(a)), b - a)
                place = np.arange(len(which)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[which]
                pairs = np.unique(which * 512 + bwt[place])
                which, c = pairs >> 9, pairs & 511
            else:
                which, c = np.repeat(np.arange(len(a)), len(symbols)), np.tile(symbols, len(a))
            x, y = np.searchsorted(table, c * (n + 1) + a[which]), np.searchsorted(table, c * (n + 1) + b[which])
            some = x < y
            starts.append(x[some])
            ends.append(y[some])
        x, y = np.concatenate(starts), np.concatenate(ends)
        new = ~parted[y]
        lo, hi = x[new], y[new]
        parted[hi] = True
        if not len(lo):
            break
    return order, ~parted[:n]


def _classes(texts: list[np.ndarray], metas: list[np.ndarray], docs: list[np.ndarray], chunks: np.ndarray, length: int) -> list[np.ndarray]:
    """Of the regions of each chunk the repeated windows: rows (start, 1)."""
    meta, doc = np.concatenate(metas), np.concatenate(docs)
    chunk = np.repeat(np.arange(len(metas)), [len(m) for m in metas])
    sizes = meta["c"].astype(np.int64) - 1 + length
    symbols = np.zeros(int(sizes.sum()) + len(meta), np.int16)
    begin = np.cumsum(sizes + 1) - sizes - 1
    body = np.ones(len(symbols), bool)
    body[begin + sizes] = False
    symbols[body] = np.concatenate(texts).astype(np.int16) + 1
    order, shared = common_prefixes(symbols, length)
    region = np.searchsorted(begin, order, side="right") - 1
    offset = order - begin[region]
    valid = offset < meta["c"][region]
    group = np.cumsum(~shared)[valid]
    region, offset = region[valid], offset[valid]
    start = meta["p"][region].astype(np.int64) - meta["d"][region] + offset
    by = np.lexsort((start, chunks[chunk[region]], doc[region], group))
    later = np.zeros(len(by), bool)
    later[1:] = group[by[1:]] == group[by[:-1]]
    of, start = chunk[region[by[later]]], start[by[later]]
    return [np.stack((s, np.ones_like(s)), axis=1) for i in range(len(metas)) for s in [np.sort(start[of == i])]]


def _spans(region: np.ndarray) -> np.ndarray:
    """Rows (first window, windows)."""
    return np.stack((region["p"].astype(np.int64) - region["d"], region["c"].astype(np.int64)), axis=1)


def repeated_bytes(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", *, chunks: int | None = None, buckets: int | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, spans (flat start, end, in bytes) and kept_sha256."""
    if not 2 <= length <= MOST:
        raise ValueError(f"length must be from 2 to {MOST}")
    a, b = X.sizes(docs, text_col)
    chunks, buckets = chunks or a, buckets or b
    dealt = X.dealt(docs, chunks, id_col, text_col)
    binary = pa.binary()

    def send(table: pa.Table) -> pa.Table:
        """Of each chunk the first region of each content; the others of the chunk are repeated as a whole."""
        chunk, ids, texts = X.rows_of(table)
        buf, at = V.pack(texts)
        if len(buf) >= 1 << 32:
            raise ValueError("a chunk of 4 GiB or more: raise spark.sql.shuffle.partitions")
        p, d, c, key, content = regions(buf, at, length)
        bucket = (key >> _U(44)).astype(np.int64) % buckets
        order = np.lexsort((p, content, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order[1:]] != key[order[:-1]]) | (content[order[1:]] != content[order[:-1]])
        first = np.zeros(len(order), bool)
        first[order[new]] = True
        doc = np.array([_LAST if i is None else i for i in ids], np.int64)[np.searchsorted(at, p, side="right") - 1]
        entry = np.empty(len(p), _ENTRY)
        entry["key"], entry["content"], entry["p"], entry["d"], entry["c"] = _low(key, 5), _low(content, 6), p, d, c
        order = np.argsort(bucket, kind="stable")
        present, at = np.unique(bucket[order], return_index=True)
        rows = []
        for bkt, lo, hi in zip(present.tolist(), at.tolist(), [*at[1:].tolist(), len(order)]):
            mine, rest = order[lo:hi][first[order[lo:hi]]], order[lo:hi][~first[order[lo:hi]]]
            who = doc[mine]
            cut = np.flatnonzero(np.diff(who, prepend=-1 if who[0] != -1 else 0))
            cut = cut if len(cut) and cut[0] == 0 else np.concatenate(([0], cut))
            local = np.empty(len(rest), _REGION)
            local["p"], local["d"], local["c"] = p[rest], d[rest], c[rest]
            rows.append((bkt, chunk, entry[mine].tobytes(), who[cut].tobytes(), np.diff(cut, append=len(who)).astype(np.uint32).tobytes(), local.tobytes()))
        return X.batches(rows, ["bucket", "chunk", "entries", "ids", "runs", "local"], [pa.int32(), pa.int32(), *[binary] * 4])

    def answer(table: pa.Table) -> pa.Table:
        """Regions that equal an earlier one, and those whose text is needed."""
        parts = [np.frombuffer(x.as_py(), _ENTRY) for x in table.column("entries")]
        doc = np.concatenate([np.repeat(np.frombuffer(i.as_py(), np.int64), np.frombuffer(r.as_py(), np.uint32)) for i, r in zip(table.column("ids"), table.column("runs"))])
        chunk = table.column("chunk").to_numpy()
        of = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        e = np.concatenate(parts)
        key, content = _high(e["key"]), _high(e["content"])
        order = np.lexsort((e["p"], chunk[of], doc, content, key))
        k, c = key[order], content[order]
        head = np.ones(len(order), bool)
        head[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        keyed = np.ones(len(order), bool)
        keyed[1:] = k[1:] != k[:-1]
        kinds = np.add.reduceat(head, np.flatnonzero(keyed))
        several = np.repeat(kinds > 1, np.diff(np.flatnonzero(keyed), append=len(order)))
        copy, need = np.empty(len(order), bool), np.empty(len(order), bool)
        copy[order], need[order] = ~head, head & several
        rows, at = [], 0
        for i, (x, bkt, local) in enumerate(zip(parts, table.column("bucket").to_pylist(), table.column("local").to_pylist())):
            region = np.empty(len(x), _REGION)
            for f in "pdc":
                region[f] = x[f]
            mine = slice(at, at + len(x))
            rows.append((int(chunk[i]), bkt, region[copy[mine]].tobytes() + local, region[need[mine]].tobytes(), doc[mine][need[mine]].tobytes()))
            at += len(x)
        return X.batches(rows, ["chunk", "bucket", "copies", "need", "ids"], [pa.int32(), pa.int32(), *[binary] * 3])

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        """The texts of the regions that are needed."""
        rows = []
        if left.num_rows:
            buf, _ = V.pack(X.rows_of(left)[2])
            for chunk, bkt, copies, need, ids in zip(*(right.column(x).to_pylist() for x in ("chunk", "bucket", "copies", "need", "ids"))):
                r = np.frombuffer(need, _REGION)
                sizes = r["c"].astype(np.int64) - 1 + length
                begin = np.cumsum(sizes) - sizes
                place = np.arange(int(sizes.sum())) + np.repeat(r["p"].astype(np.int64) - r["d"] - begin, sizes)
                rows.append((bkt, chunk, copies, need, ids, buf[place].tobytes()))
        return X.batches(rows, ["bucket", "chunk", "copies", "need", "ids", "text"], [pa.int32(), pa.int32(), *[binary] * 4])

    def expand(table: pa.Table) -> pa.Table:
        read = lambda c, t: [np.frombuffer(x.as_py(), t) for x in table.column(c)]
        metas, chunk = read("need", _REGION), table.column("chunk").to_numpy()
        found = [_spans(r) for r in read("copies", _REGION)]
        if sum(len(m) for m in metas):
            found = [np.concatenate(x) for x in zip(found, _classes(read("text", np.uint8), metas, read("ids", np.int64), chunk, length))]
        return pa.table({"chunk": table.column("chunk"), "spans": pa.array([x.astype(np.uint32).tobytes() for x in found], binary)})

    def use(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"]
        types = [*[pa.int64()] * 4, pa.list_(pa.int64()), pa.string()]
        rows = []
        if left.num_rows:
            _, ids, texts = X.rows_of(left)
            buf, at = V.pack(texts)
            gone = np.zeros(len(buf) + 1, np.int32)
            for x in right.column("spans").to_pylist():
                s = np.frombuffer(x, np.uint32).reshape(-1, 2).astype(np.int64)
                np.add.at(gone, s[:, 0], 1)
                np.add.at(gone, s[:, 0] + s[:, 1] - 1 + length, -1)
            gone = np.cumsum(gone[:-1]) > 0
            for i, (doc, text) in enumerate(zip(ids, texts)):
                g = gone[at[i] : at[i] + len(text)]
                n, spans = int(g.sum()), []
                if n:
                    spans = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0)).tolist()
                    text = buf[at[i] : at[i] + len(text)][~g].tobytes()
                rows.append((doc, len(g), n, len(spans) // 2, spans, hashlib.sha256(text).hexdigest()))
        return X.batches(rows, names, types)

    replies = X.ask(dealt, send, "bucket int, chunk int, entries binary, ids binary, runs binary, local binary", answer, "chunk int, bucket int, copies binary, need binary, ids binary")
    texts = X.gather(dealt, replies, fetch, "bucket int, chunk int, copies binary, need binary, ids binary, text binary")
    spans = texts.groupBy("bucket").applyInArrow(tidy(expand), "chunk int, spans binary")
    return X.gather(dealt, spans, use, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept_sha256 string")
