"""Byte-level BPE by corpus-level merge replay, and decoding.

A batch's distinct pieces are laid out in one symbol array.  An inverted index
from the rank of an adjacent pair to its positions is replayed in rank order: the
lowest rank is taken, all its positions merge at once (one, the leftmost, in each
piece: a merge there may bring forth a pair of lower rank), and only the pairs
with touched neighbours enter the index anew.  A piece of more than ``LONG`` bytes, such
as a run of one character, merges on its own, by a heap of ranks and a linked list: one
position at a time there would mean as many rounds over the index as the piece has merges.

Defined cases: a long piece takes time in proportion to its length and about 200 times
its bytes of memory while it is merged; null or empty text has no tokens; lone surrogates don't occur in
Spark strings; ids are those of the rank file, special strings are plain text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomgraph.session import batched

from ._columns import free, map_rows, quoted
from ._memory import tidy

#: White space by Unicode's property, as the pattern's \s has it (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words with the space before them, and runs of white space: the pattern never joins what this parts.
_COARSE = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Entries that a worker keeps between the batches of a task, about.
CACHE = 250_000
#: Bytes of the longest piece that is replayed with others.
LONG = 256


class ByteBpe:
    """Encoder and decoder of a tiktoken rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.merged = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        self.ranks, self.pairs = ranks, pairs
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of what each pair merges to, or -1."""
        want = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.merged[at], -1)

    def replay(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        n = int(sizes.sum())
        symbol = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            at = at[after[at] >= 0]
            rank = self._rank(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, lo, hi in zip(rank[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(at[lo:hi])

        enter(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            at = at[alive[at]]
            at = at[after[at] >= 0]
            at = at[self._rank(symbol[at], symbol[after[at]]) == r]
            if not len(at):
                continue
            first = np.ones(len(at), bool)
            first[1:] = piece[at[1:]] != piece[at[:-1]]
            if not first.all():
                index[r] = [at[~first]]
                heapq.heappush(heap, r)
                at = at[first]
            gone = after[at]
            beyond = after[gone]
            symbol[at], alive[gone], after[at] = r, False, beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            left = before[at]
            enter(np.concatenate((left[left >= 0], at)))
        kept = symbol[alive].astype("<u4")
        counts = np.bincount(piece[alive], minlength=len(pieces))
        return np.split(kept, np.cumsum(counts)[:-1]) if len(pieces) else []

    def linked(self, raw: bytes) -> np.ndarray:
        """Token ids of one long piece: the lowest rank first, of equal ones the leftmost."""
        n, pairs = len(raw), self.pairs
        symbols = self.single[np.frombuffer(raw, np.uint8)].tolist()
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [r << 32 | i for i in range(n - 1) if (r := pairs.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j < 0 or pairs.get(symbols[i] << 32 | symbols[j]) != r:
                continue  # one of the two has merged meanwhile
            symbols[i], symbols[j] = r, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := pairs.get(symbols[i] << 32 | symbols[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := pairs.get(symbols[h] << 32 | symbols[i])) is not None:
                heapq.heappush(heap, r << 32 | h)
        return np.array([x for x in symbols if x >= 0], "<u4")

    def forget(self) -> None:
        """Drops what is kept between batches: a worker lives on after its task, beside those of other stages."""
        self.words.clear()
        self.pieces.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text the ids, as little-endian unsigned 32-bit integers."""
        if len(self.words) > CACHE:
            self.words.clear()
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        parts = [_COARSE.findall(t) for t in texts]
        words = self.words
        new = {w for p in parts for w in p if w not in words}
        split = {w: self.pattern.findall(w) if not w.isspace() else [w] for w in new}
        fresh = list({x for p in split.values() for x in p if x not in self.pieces})
        raw = [x.encode() for x in fresh]
        known = [self.ranks.get(x) for x in raw]
        for x, r in zip(fresh, known):
            if r is not None:  # a whole token
                self.pieces[x] = r.to_bytes(4, "little")
        for x, y, r in zip(fresh, raw, known):
            if r is None and len(y) > LONG:
                self.pieces[x] = self.linked(y).tobytes()
        todo = [(x, y) for x, y, r in zip(fresh, raw, known) if r is None and len(y) <= LONG]
        for (x, _), ids in zip(todo, self.replay([y for _, y in todo])):
            self.pieces[x] = ids.tobytes()
        for w, p in split.items():
            words[w] = self.pieces[p[0]] if len(p) == 1 else b"".join([self.pieces[x] for x in p])
        return [b"".join([words[w] for w in p]) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def bpe(path: str, pattern: str) -> ByteBpe:
    """The tokenizer of a file, loaded once in a process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


def groups(batches: Iterator[pa.RecordBatch], text: int, most: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of consecutive batches with texts (in the numbered column; null: empty) of about so many bytes; one row at least."""
    held, size = [], 0

    def together() -> tuple[pa.RecordBatch, list[str]]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return rows, [t or "" for t in rows.column(text).to_pylist()]

    for batch in batches:
        at = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
            size += n
            if size >= most:
                held.append(batch.slice(at, i + 1 - at))
                yield together()
                held, size, at = [], 0, i + 1
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield together()


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with ``ids`` (array of int) and ``decoded`` (string of the decoded bytes), in place of columns of these names."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "decoded")]
    given = docs.select(*map(quoted, keep), quoted(text_col).cast("string").alias(free(docs.columns, "given")))
    out = T.StructType(given.schema.fields[:-1]).add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def run(batches):
        tok = bpe(path, pattern)
        # fewer at a time than for digests: ids and decoded texts are sent on beside them
        for rows, texts in groups(batches, len(out.fields) - 2, 2 << 20):
            coded = tok.encode(texts)
            ids = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in coded], pa.list_(pa.int32()))
            back = pa.array([tok.decode(x).decode("utf-8", "replace") for x in coded], pa.string())
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], ids, back], names=out.names)
        tok.forget()

    return map_rows(given, run, out)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes."""

    def run(batches):
        tok = bpe(path, pattern)
        for rows, texts in groups(batches, 1):
            coded = tok.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array([len(x) // 4 for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                    pa.array([hashlib.sha256(tok.decode(x)).hexdigest() for x in coded]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        tok.forget()

    return batched(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
