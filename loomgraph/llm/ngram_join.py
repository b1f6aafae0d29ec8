"""N-gram Jaccard join: a prefix-tree join of globally ordered shingle sets.

1. Document frequencies of all shingles are counted through the packed exchange.
   A document of which fewer than ``threshold`` of the shingles occur in another
   document has no link, so most documents end here.
2. Equal sets collapse to a representative (the smallest doc_id), and every set
   is put in one global order, rare shingles first.
3. By the prefix principle two linked sets share a shingle of their prefixes.
   Shared prefix shingles join representatives into rooms; rooms are cut into
   blocks of bounded size, so large that sending a block costs little beside
   comparing it with another.
4. Every block of a room meets itself and every other block in a task of its own. The
   ordered sets of one block form a trie, path-compressed; all sets of the other
   descend together, sharing the overlaps of common paths, and leave a subtree as
   soon as the shingles remaining on either side can't reach the overlap needed.
5. A task counts the links it finds and sends a spanning forest of them on, so no row
   per link leaves it; components are those of the forests.

``links`` enumerates every linked pair of different sets instead.

Defined cases: null or empty text, or one of separators alone: an empty set,
linked with nothing; fewer words than ``n``: the whole sequence is one shingle;
rows that share a doc_id are one node; a row without doc_id keeps its n_shingles
and has no component and no number of links; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components
from loomgraph.operators.skew import heavy_join
from loomgraph.session import stored

from . import _exchange as X
from . import _vec as V
from ._memory import tidy

_VALUES = V.byte_values(1, fold_case=True)
_U = np.uint64
#: Sets and shingles in a block of a room, on average at most.
BLOCK_DOCS, BLOCK_TOKENS = 8192, 1 << 20
#: Bytes of the matrix of probing sets by shingles at a time.
MATRIX_BYTES = 16 << 20


def shingle_pairs(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each distinct shingle of each text, sorted by both."""
    buf, at = V.pack(texts)
    starts, _, hashes = V.words(buf, V.SPACES, _VALUES)
    per = np.searchsorted(starts, at)
    counts = np.diff(per)
    whole = V.windows(hashes, n)
    row = np.repeat(np.arange(len(texts)), counts)
    ok = np.flatnonzero(np.arange(len(whole)) + n <= per[row[: len(whole)] + 1]) if len(whole) else np.zeros(0, np.int64)
    rows, keys = [row[ok]], [whole[ok]]
    for k in range(1, n):  # short texts: one shingle of k words
        short = np.flatnonzero(counts == k)
        if len(short):
            rows.append(short)
            keys.append(V.mix(V.windows(hashes, k)[per[short]] + _U(k)))
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def _frequencies(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """Per chunk and bucket: a byte per distinct shingle of the chunk, the bit length of its document frequency."""
    bits = buckets.bit_length() - 1

    def send(table: pa.Table) -> pa.Table:
        chunk, _, texts = X.rows_of(table)
        _, key = shingle_pairs(texts, n)
        u, count = np.unique(key >> _U(32 - bits), return_counts=True)
        return X.by_bucket(chunk, (u >> _U(32)).astype(np.int64), (u & _U(0xFFFFFFFF)).astype(np.uint32), {"counts": np.minimum(count, 255).astype(np.uint8)})

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("keys")]
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("counts")])
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, weights=counts)
        level = (np.frexp(total)[1]).astype(np.uint8)[which]  # 1: once, 2: 2-3, 3: 4-7, ...
        out, at = [], 0
        for x in keys:
            out.append(level[at : at + len(x)].tobytes())
            at += len(x)
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "levels": pa.array(out, pa.binary())})

    return X.ask(docs, send, "bucket int, chunk int, keys binary, counts binary", answer, "chunk int, bucket int, levels binary")


def shingle_sets(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, chunks: int | None = None, buckets: int | None = None) -> DataFrame:
    """A row for each set of a chunk that may have a link: its documents, the set's two fingerprints, its size and its ordered shared shingles.

    The other documents, and rows without doc_id, are in one row per chunk, without
    fingerprints and with a size each.
    """
    a, b = X.sizes(docs, text_col)
    chunks, buckets = chunks or a, buckets or b
    bits = buckets.bit_length() - 1
    dealt = X.dealt(docs, chunks, id_col, text_col)
    names = ["docs", "sizes", "f1", "f2", "n", "tokens"]
    types = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def use(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return X.batches([], names, types)
        _, ids, texts = X.rows_of(left)
        row, key = shingle_pairs(texts, n)
        _, which = np.unique(key >> _U(32 - bits), return_inverse=True)
        by = dict(zip(right.column("bucket").to_pylist(), right.column("levels").to_pylist()))
        level = np.frombuffer(b"".join(by[x] for x in sorted(by)), np.uint8)[which]
        at = V.slices(row, len(ids))
        f1 = np.concatenate((np.zeros(1, _U), np.cumsum(V.mix(key), dtype=_U)))
        f2 = np.concatenate((np.zeros(1, _U), np.cumsum(V.mix(key ^ _U(0x5851F42D4C957F2D)), dtype=_U)))
        f1, f2 = ((f[at[1:]] - f[at[:-1]]).astype(np.int64).tolist() for f in (f1, f2))
        shared = np.concatenate(([0], np.cumsum(level >= 2)))
        alone, sets = ([], []), {}
        for i, doc in enumerate(ids):
            lo, hi = at[i], at[i + 1]
            size, common = int(hi - lo), int(shared[hi] - shared[lo])
            if doc is None or not size or 100 * common < percent * size:
                alone[0].append(doc)
                alone[1].append(size)
                continue
            mark = (f1[i], f2[i])
            if mark not in sets:
                keep = level[lo:hi] >= 2
                # one global order: by frequency, then by hash; the frequency takes the upper six bits
                tokens = np.sort((level[lo:hi][keep].astype(_U) << _U(58)) | (key[lo:hi][keep] >> _U(6))).tobytes()
                sets[mark] = ([], None, *mark, size, tokens)
            sets[mark][0].append(doc)
        return X.batches([(*alone, None, None, None, None), *sets.values()], names, types)

    return X.gather(dealt, _frequencies(dealt, n, buckets), use, "docs array<long>, sizes array<long>, f1 long, f2 long, n long, tokens binary")


class Forest:
    """A spanning forest of links, taken as they come."""

    def __init__(self, n: int):
        self.label, self.links = np.arange(n), []

    def add(self, one: int, many: np.ndarray) -> None:
        label = self.label
        for i in many[label[many] != label[one]].tolist():
            if label[i] != label[one]:
                self.links.append((one, i))
                label[label == label[i]] = label[one]


class Trie:
    """A path-compressed prefix tree of ordered sets; node: tokens of its path, children, sets that end there."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, members: list[int] | None = None):
        """All sets may probe; the tree holds those of ``members`` only, or all."""
        self.members = sorted(range(len(sets)) if members is None else members, key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets, self.sizes = sets, sizes
        self.root = self._node(self.members, 0) if self.members else None

    def _node(self, members: list[int], depth: int) -> dict:
        """Iterative descent over long paths; recursion only where sets part."""
        first, last = self.sets[members[0]], self.sets[members[-1]]  # sorted: what these two share all share
        m = min(len(first), len(last))
        unlike = np.flatnonzero(first[depth:m] != last[depth:m])
        end = depth + int(unlike[0]) if len(unlike) else m
        node = {"path": first[depth:end], "ends": [i for i in members if len(self.sets[i]) == end], "children": [], "longest": max(len(self.sets[i]) for i in members) - end, "least": min(int(self.sizes[i]) for i in members), "most": max(int(self.sizes[i]) for i in members)}
        rest = [i for i in members if len(self.sets[i]) > end]
        at = 0
        while at < len(rest):
            to = at
            while to < len(rest) and self.sets[rest[to]][end] == self.sets[rest[at]][end]:
                to += 1
            node["children"].append((rest[at:to], end))
            at = to
        return node

    def join(self, probes: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """A set of the tree and the probes linked with it, 100 * intersection >= percent * union, itself left out; a set may come repeatedly."""
        if not self.members or not len(probes):
            return
        # a shingle counts only where a probe and a set of the tree both may have it
        tokens, many = np.unique(np.concatenate([self.sets[i] for i in self.members]), return_counts=True)
        asked, often = np.unique(np.concatenate([self.sets[i] for i in probes]), return_counts=True)
        tokens, x, y = np.intersect1d(tokens, asked, assume_unique=True, return_indices=True)
        if len(probes) == len(self.members) and np.array_equal(np.sort(probes), np.sort(self.members)):
            tokens = tokens[many[x] > 1]
        step = max(1, MATRIX_BYTES // (5 * max(1, len(tokens))))
        for lo in range(0, len(probes), step):
            yield from self._join(probes[lo : lo + step], tokens, percent)

    def _join(self, probes: np.ndarray, tokens: np.ndarray, percent: int):
        has = np.zeros((len(probes), len(tokens)), np.uint8)
        for r, i in enumerate(probes):
            mine = self.sets[i]
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, mine), len(tokens) - 1)
                has[r, at[tokens[at] == mine]] = 1
        passed = np.zeros((len(probes), len(tokens) + 1), np.int32)
        np.cumsum(has, axis=1, dtype=np.int32, out=passed[:, 1:])
        size, total = self.sizes[probes].astype(np.int64), passed[:, -1]
        stack = [(self.root, np.arange(len(probes)), np.zeros(len(probes), np.int64))]
        while stack:
            node, live, overlap = stack.pop()
            path = node["path"]
            left = total[live]
            if len(path) and len(tokens):
                at = np.minimum(np.searchsorted(tokens, path), len(tokens) - 1)
                at = at[tokens[at] == path]
                if len(at):
                    overlap = overlap + has[np.ix_(live, at)].sum(axis=1)
                left = left - passed[live, np.searchsorted(tokens, path[-1], side="right")]
            for i in node["ends"]:
                good = (100 + percent) * overlap >= percent * (size[live] + int(self.sizes[i]))
                found = probes[live[good]]
                found = found[found != i]
                if len(found):
                    yield i, found
            if node["children"]:
                can = overlap + np.minimum(left, node["longest"])
                fits = ((100 + percent) * can >= percent * (size[live] + node["least"])) & (100 * np.minimum(size[live], node["most"]) >= percent * np.maximum(size[live], node["least"]))
                live, overlap = live[fits], overlap[fits]
                if len(live):
                    for members, depth in node["children"]:
                        stack.append((self._node(members, depth), live, overlap))


def _rooms(reps: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(doc, room): sets, by their smallest document, that share a prefix shingle, directly or through others."""

    def send(batches):
        bits = buckets.bit_length() - 1
        for batch in batches:
            parts, ids, sizes = [], [], []
            for rep, n, tokens in zip(*(batch.column(c).to_pylist() for c in ("doc", "n", "tokens"))):
                t = np.frombuffer(tokens, _U)
                prefix = n - (percent * n + 99) // 100 + 1 - (n - len(t))
                if prefix > 0:
                    parts.append(t[:prefix])
                    ids.append(np.full(len(parts[-1]), rep, np.int64))
                    sizes.append(np.full(len(parts[-1]), n, np.int64))
            if not parts:
                continue
            key, doc, n = np.concatenate(parts), np.concatenate(ids), np.concatenate(sizes)
            bucket = (V.mix(key) >> _U(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            yield from X.by_bucket(0, bucket[order], key[order], {"ids": doc[order], "sizes": n[order]}).drop_columns("chunk").to_batches()

    def star(table: pa.Table) -> pa.Table:
        read = lambda c, t: np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(c)])
        key, doc, n = read("keys", _U), read("ids", np.int64), read("sizes", np.int64)
        order = np.lexsort((doc, n, key))
        key, doc, n = key[order], doc[order], n[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (100 * n[:-1] < percent * n[1:])  # too far apart in size: no link across
        head = np.repeat(doc[new], np.diff(np.flatnonzero(new), append=len(key)))
        e = np.unique(np.stack((doc, head))[:, ~new], axis=1)
        return pa.table({"src": pa.array(e[0], pa.int64()), "dst": pa.array(e[1], pa.int64())})

    edges = reps.select("doc", "n", "tokens").mapInArrow(tidy(send), "bucket int, keys binary, ids binary, sizes binary").groupBy("bucket").applyInArrow(tidy(star), "src long, dst long")
    return connected_components(edges).withColumnRenamed("node", "doc").withColumnRenamed("component", "room")


def _link_tasks(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``shingle_sets``, the distinct sets with their smallest document and their copies, and these dealt to pairs of blocks."""
    sets = stored(shingle_sets(docs, n, percent, id_col, text_col))
    may = sets.where("f1 is not null")
    reps = stored(may.groupBy("f1", "f2").agg(F.min(F.array_min("docs")).alias("doc"), F.sum(F.size("docs")).alias("copies"), F.first("n").alias("n"), F.first("tokens").alias("tokens")))
    inside = _rooms(reps, percent, X.sizes(docs, text_col)[1]).join(reps, "doc")
    size = F.greatest(F.count("*") / F.lit(BLOCK_DOCS), F.sum(F.octet_length("tokens")) / F.lit(8 * BLOCK_TOKENS))
    inside = stored(inside)
    # few rooms have several blocks, and the others need no number
    several = inside.groupBy("room").agg(F.count("*").alias("m"), F.least(F.ceil(size), F.count("*")).cast("int").alias("blocks")).where("blocks > 1")
    placed = heavy_join(inside, several, ["room"], "m", reps.count(), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("f1", "f2"), "blocks").cast("int"))
    dealt = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return sets, reps, dealt.select("room", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "f1", "f2", "doc", "copies", "n", "tokens")


def _meet(table: pa.Table, percent: int) -> tuple[np.ndarray, bool, Iterator[tuple[int, np.ndarray]]]:
    """The sets' order in the table; whether each link comes from both its ends; a set and those linked with it, as places in that order."""
    order = np.lexsort((table.column("f2").to_numpy(), table.column("f1").to_numpy()))
    b, sizes, tokens = table.column("b").to_numpy()[order], table.column("n").to_numpy()[order], table.column("tokens").to_pylist()
    sets = [np.frombuffer(tokens[i], _U) for i in order.tolist()]
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    return order, i == j, Trie(sets, sizes, np.flatnonzero(b == j).tolist()).join(np.flatnonzero(b == i), percent)


def links(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every link: (f1, f2, g1, g2) once for each linked pair of different sets, and (doc_id, f1, f2) of the rows; rows of one set are linked too.

    Rows without a set have no link.
    """
    sets, _, tasks = _link_tasks(docs, n, percent, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        order, both, found = _meet(table, percent)
        f1, f2 = (table.column(c).to_numpy()[order] for c in ("f1", "f2"))
        for one, many in found:
            many = many[many > one] if both else many
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(many), f1[one]), np.full(len(many), f2[one]), f1[many], f2[many])], names=["f1", "f2", "g1", "g2"])

    pairs = tasks.groupBy("room", "i", "j").applyInArrow(tidy(run), "f1 long, f2 long, g1 long, g2 long")
    return pairs, sets.where("f1 is not null").select(F.explode("docs").alias("doc_id"), "f1", "f2")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included) and n_links (other rows with a doc_id that it's linked with)."""
    sets, reps, tasks = _link_tasks(docs, n, percent, id_col, text_col)

    def run(table: pa.Table) -> pa.Table:
        order, both, found = _meet(table, percent)
        f1, f2, ids, copies = (table.column(c).to_numpy()[order] for c in ("f1", "f2", "doc", "copies"))
        total, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        for one, many in found:
            total[one] += copies[many].sum()
            if not both:
                total[many] += copies[one]
            forest.add(one, many)
        some, tree = np.flatnonzero(total), np.array(forest.links, np.int64).reshape(-1, 2)
        none = pa.nulls(len(some), pa.int64()), pa.nulls(len(tree), pa.int64())
        counts = [pa.concat_arrays([pa.array(x[some]), none[1]]) for x in (f1, f2, total)]
        return pa.table([*counts, *(pa.concat_arrays([none[0], pa.array(ids[tree[:, k]])]) for k in (0, 1))], names=["f1", "f2", "k", "src", "dst"])

    found = stored(tasks.groupBy("room", "i", "j").applyInArrow(tidy(run), "f1 long, f2 long, k long, src long, dst long"))
    number = reps.select("f1", "f2", "doc", "copies").join(found.where("f1 is not null").groupBy("f1", "f2").agg(F.sum("k").alias("k")), ["f1", "f2"], "left")
    # a doc_id of several rows may have several sets, and joins them
    each = sets.where("f1 is not null").select(F.explode("docs").alias("d"), "f1", "f2")
    several = each.groupBy("d").agg(F.min(F.struct("f1", "f2")).alias("x"), F.max(F.struct("f1", "f2")).alias("y")).where("x <> y").select("d")
    shared = each.join(several, "d").join(reps.select("f1", "f2", "doc"), ["f1", "f2"]).select(F.col("d").alias("src"), F.col("doc").alias("dst"))
    classes = connected_components(found.where("src is not null").select("src", "dst").unionByName(shared))
    known = number.join(classes, F.col("doc") == F.col("node"), "left").select("f1", "f2", F.coalesce("component", "doc").alias("component_id"), (F.col("copies") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), "copies")
    linked = heavy_join(sets.where("f1 is not null").select("docs", "n", "f1", "f2"), known, ["f1", "f2"], "copies", reps.agg(F.sum("copies")).first()[0] or 0)
    linked = linked.select(F.explode("docs").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = sets.where("f1 is null").select(F.explode(F.arrays_zip("docs", "sizes")).alias("x"))
    return linked.unionByName(alone.select(F.col("x.docs").alias("doc_id"), F.col("x.sizes").alias("n_shingles"), F.col("x.docs").alias("component_id"), F.expr("if(x.docs is null, null, 0L)").alias("n_links")))
