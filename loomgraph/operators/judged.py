"""Deduplication by a judge (a language model, or any callable), within blocks of items that lie near each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.aggregate import placed
from loomgraph.operators.similarity import portions
from loomgraph.session import drop, kept, stored

#: Takes an item and its nearest others; returns the name that stands for all of them, and its duplicates.
Judge = Callable[[str, list[str]], tuple[str, list[str]]]
#: Items in a block, rounds of k-means, and centres that are broadcast at most; with more items, a cell is several blocks.
BLOCK, ROUNDS, CENTRES = 128, 20, 1024


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds each row's place in its cell by (far, k), from 0: a global order, so that a large cell isn't one task's."""
    at = placed(rows, ["cell", "far", "k"], "at")
    first = at.groupBy("cell").agg(F.min("at").alias("__first"))  # a row a centre
    return at.join(F.broadcast(first), "cell").withColumn("at", F.col("at") - F.col("__first")).drop("__first")


def assign(vectors: DataFrame, centres: np.ndarray, room: int) -> DataFrame:
    """(k, cell, far) of (k, v): each item in one cell, none of which takes more than ``room``; there must be room for all.

    An item asks the nearest centre that has room left. A cell asked by more than it has
    room for takes the nearest of them, ties to the smaller key; the others ask again in the
    next round, in which only they take part. A round fills a cell or is the last, so there
    are no more rounds than centres.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)["k"]
    left = np.full(len(centres), room)
    waiting, path = kept(vectors.select("k", "v"))
    done = []
    while not waiting.isEmpty():
        some = np.flatnonzero(left > 0)

        def ask(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            for batch in portions(batches, len(some)):
                m, c = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1), centres[some]
                d = np.sqrt(np.maximum(0.0, (m**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * m @ c.T))
                best = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(some[best].astype(np.int32)), pa.array(d[np.arange(len(d)), best])], names=["k", "v", "cell", "far"])

        asked = _ranked(stored(waiting.mapInArrow(ask, f"k {kind}, v array<double>, cell int, far double")))
        fits = F.element_at(F.array(*[F.lit(int(n)) for n in left]), F.col("cell") + 1)
        ranked, _ = kept(asked.withColumn("in", F.col("at") < fits))
        drop(spark, path)
        for r in ranked.where("in").groupBy("cell").count().collect():  # a row a centre
            left[r.cell] -= r["count"]
        done.append(ranked.where("in").select("k", "cell", "far"))
        waiting, path = kept(ranked.where("not in").select("k", "v"))
    out = vectors.select("k", F.lit(0).alias("cell"), F.lit(0.0).alias("far")).limit(0)
    for part in done:
        out = out.unionAll(part)
    return out


def blocks(vectors: DataFrame, key: str, vector: str, size: int = BLOCK, seed: int = 0) -> DataFrame:
    """(key, block) of every item with a vector: k-means cells that each take no more than they have room for (``assign``), a block of ``size`` items or, above CENTRES cells, several, which its items fill by distance from the centre.

    Null vectors are in no block.
    """
    v = stored(vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")))
    n = v.count()
    many = -(-n // size)  # blocks that hold all
    k = max(1, min(many, CENTRES))
    if k == 1:
        cells = v.select("k", F.lit(0).alias("cell"), F.lit(0.0).alias("far"))
    else:
        model = KMeans(k=k, initMode="random", maxIter=ROUNDS, tol=0.0, seed=seed, featuresCol="x", predictionCol="cell").fit(v.select(array_to_vector("v").alias("x")))
        centres = np.array(model.clusterCenters())  # of equal vectors there may be fewer than asked for
        cells = stored(assign(v, centres, size * -(-many // len(centres))))
    block = F.struct("cell", F.floor(F.col("at") / size).alias("part"))
    return _ranked(cells).select(F.col("k").alias(key), block.alias("block"))


def verdicts(placed: DataFrame, near: DataFrame, judge: Judge) -> DataFrame:
    """(block, canonical, member, error) of the merges that a judge makes.

    placed: (item, block); near: (item, candidates), a bounded list, as of ``fuse``. The
    items of a block are judged in turn, from the last; those named duplicates that the
    block still holds merge and aren't judged again. A block whose judge fails stays unmerged:
    it has one row, of its last item and the failure.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        waiting = dict(zip(pdf["item"], pdf["candidates"]))
        out, item = [], None
        try:
            while waiting:
                item, candidates = waiting.popitem()
                alias, named = judge(item, list(candidates) if candidates is not None else [])
                found = [x for x in dict.fromkeys(named) if waiting.pop(x, waiting) is not waiting]
                if found:
                    out += [(alias, x, None) for x in (item, *found)]
        except Exception as e:  # the judge's own: it is told in the row
            out = [(None, item, f"{type(e).__name__}: {e}")]
        made = pd.DataFrame(out, columns=["canonical", "member", "error"])
        made.insert(0, "block", pdf["__block"].iloc[0])
        return made

    rows = placed.join(near, "item", "left").select("item", F.to_json(F.struct("block")).alias("__block"), "candidates")
    return rows.groupBy("__block").applyInPandas(run, "block string, canonical string, member string, error string")


def merges(placed: DataFrame, near: DataFrame, judge: Judge) -> DataFrame:
    """(canonical, member, ord) of ``verdicts``, as ``apply_clusters`` takes them; failed blocks are left out."""
    return verdicts(placed, near, judge).where("error is null").select("canonical", "member", F.xxhash64("canonical").alias("ord"))
