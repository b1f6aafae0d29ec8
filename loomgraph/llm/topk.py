"""Exact top-k search by a three-phase uniform threshold.

Vectors become integers, floor(scale * x), and are cut into ``slices`` of
dimensions; each slice's partial scores are a list of their own.  Queries and
candidates are dealt into blocks; every block of queries meets every block of
candidates in a task of its own.

1. A block sends its best total scores among the leaders of its slices' lists
   (scores only). The k-th of all of them is a safe cutoff for a query.
2. The cutoff, less what the slices can hold at least, divided evenly over them, is
   the uniform threshold: an entry below it in every slice can't reach the cutoff.
3. The others' totals are resolved exactly; those that reach the cutoff are ranked.

Defined cases: null vectors and ones with null or non-finite components take no
part, nor do those with a component that is no finite double once it is scaled; shorter vectors count as ending in zeros; ties go to the smaller id; with
fewer candidates than k, all are returned; rows without id take no part; rows that
share an id are candidates of their own, but never of that id's queries; scores
beyond 64 bits count as the largest or smallest number of 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates and of one of queries, about.
BLOCK, QUERIES = 1024, 2048


def _products(q: np.ndarray, c: np.ndarray, slices: int) -> list[np.ndarray]:
    """Partial inner products of each slice: exact, in floating point where every sum fits its mantissa."""
    dim = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (q, c))
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(dim, 1)
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object
    q, c = (x.astype(kind) if kind is not object else np.array([[int(v) for v in r] for r in x.tolist()], object) for x in (q, c))
    cuts = np.linspace(0, dim, slices + 1).astype(int)
    return [q[:, a:b] @ c[:, a:b].T for a, b in zip(cuts[:-1], cuts[1:])]


def _long(total: np.ndarray) -> np.ndarray:
    """Exact totals as 64-bit integers."""
    return np.clip(total, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _matrix(table: pa.Table, scale: float) -> np.ndarray:
    """The integer vectors, zeros after the shorter ones."""
    v = table.column("v").combine_chunks()
    flat, sizes = v.flatten().to_numpy(), np.diff(v.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.floor(scale * flat)
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: float = 64.0, slices: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of each query, its own id left out."""

    def usable(df: DataFrame) -> DataFrame:
        x = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return x.where(f"id is not null and v is not null and not exists(v, e -> e is null or isnan(e) or abs(e * double('{scale}')) = double('infinity') or abs(e) = double('infinity'))")

    q, c = usable(queries).dropDuplicates(), usable(candidates)
    n_q, n_c = max(1, -(-q.count() // QUERIES)), max(1, -(-c.count() // BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q_grid = q.select("id", "v", block(n_q).alias("qb"), other(n_c).alias("cb"))
    c_grid = c.select("id", "v", block(n_c).alias("cb"), other(n_q).alias("qb"))

    def partial(left: pa.Table, right: pa.Table):
        qi, ci = left.column("id").to_numpy(), right.column("id").to_numpy()
        qm, cm = _matrix(left, scale), _matrix(right, scale)
        for lo in range(0, len(qi), 512):  # bounds the score matrices
            yield slice(lo, lo + 512), qi[lo : lo + 512], ci, _products(qm[lo : lo + 512], cm, slices)

    def leaders(left: pa.Table, right: pa.Table) -> pa.Table:
        """Phase 1: the best totals of each query among the leaders of the slices' lists."""
        ids, best = [], []
        for _, qi, ci, parts in partial(left, right) if left.num_rows and right.num_rows else ():
            m = min(k + 1, len(ci))
            at = np.concatenate([np.argpartition(p, len(ci) - m, axis=1)[:, len(ci) - m :] for p in parts], axis=1)
            at.sort(axis=1)
            total = _long(sum(np.take_along_axis(p, at, axis=1) for p in parts))
            use = ci[at] != qi[:, None]
            use[:, 1:] &= at[:, 1:] != at[:, :-1]
            for i, t, u in zip(qi.tolist(), total, use):
                ids.append(i)
                best.append(sorted(t[u].tolist(), reverse=True)[:k])
        return pa.table({"query_id": pa.array(ids, pa.int64()), "best": pa.array(best, pa.list_(pa.int64()))})

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        """Phases 2 and 3: entries at the uniform threshold in some slice, of them those whose total reaches the cutoff."""
        rows = ([], [], [])
        known = left.column("cutoff").is_valid().to_numpy()
        cutoff = left.column("cutoff").fill_null(-(1 << 63)).to_numpy()  # integers: a float would round past the k-th score
        for part, qi, ci, parts in partial(left, right) if left.num_rows and right.num_rows else ():
            cut = np.where(known[part], cutoff[part].astype(float), -np.inf)[:, None]
            # any offsets are safe: what is below offset + share in every slice is below the cutoff in total
            offsets = [p.mean(axis=1, keepdims=True).astype(float) for p in parts]
            share = (cut - sum(offsets)) / len(parts)
            slack = 1e-6 * (np.abs(share) + 1)
            may = np.zeros(parts[0].shape, bool)
            for p, o in zip(parts, offsets):
                may |= p >= o + share - slack - 1e-6 * np.abs(o)
            a, b = np.nonzero(may & (ci[None, :] != qi[:, None]))
            total = _long(sum(p[a, b] for p in parts))
            good = total >= cutoff[part][a]
            rows[0].append(qi[a[good]])
            rows[1].append(ci[b[good]])
            rows[2].append(total[good])
        return pa.table({n: pa.array(np.concatenate(x) if x else [], pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), rows)})

    by = ["qb", "cb"]
    first = q_grid.groupBy(*by).cogroup(c_grid.groupBy(*by)).applyInArrow(leaders, "query_id long, best array<long>")
    gathered = first.select("query_id", F.explode("best").alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    cutoffs = gathered.withColumn("n", nth).where(F.col("n") == k).select("query_id", F.col("score").alias("cutoff"))
    asked = q_grid.join(cutoffs, q_grid["id"] == cutoffs["query_id"], "left").select("id", "v", "qb", "cb", "cutoff")
    found = asked.groupBy(*by).cogroup(c_grid.groupBy(*by)).applyInArrow(resolve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
