"""Connected components by alternating large-star and small-star rounds.

Every round is four grouped joins; the edge set never grows and converges in
O(log^2 n) rounds whatever the diameter.  A round's edges are stored in the shared
folder, so that lineage stays flat and a lost executor costs one round at most, and
the round before is deleted.  Before the first round every task joins what is connected
within its own edges, HELD nodes at a time, so that rounds begin with stars; where FINISH
edges or fewer are left, one task does the same with them, and no round is needed.  A node with many edges, such as the centre of a star,
doesn't gather them in one task: its least neighbour is aggregated in the map tasks
first and goes to its edges by a broadcast of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import children, drop, exists, kept, stored

from .skew import heavy_join


#: Edges in a file of a round, about: the edges don't grow, so few need few files and few tasks to read them.
ROWS = 50_000


#: Nodes that a task joins at a time before the first round, and edges left after that which one task finishes.
HELD, FINISH = 500_000, 1_000_000


def _stars(held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes of edges (a, b) edges from each node to the least one that a task's edges join it with, ``held`` nodes at a time; of a node that meets no other, a loop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}
        kind = None

        def find(x):
            while (up := root[x]) != x:
                root[x] = x = root[up]
            return x

        def out() -> pa.RecordBatch:
            ends = [find(x) for x in root]
            centres = {y for x, y in zip(root, ends) if x != y}
            rows = [(x, y) for x, y in zip(root, ends) if x != y or x not in centres]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            kind = batch.column(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(root.setdefault(a, a)), find(root.setdefault(b, b))
                if x != y:
                    root[max(x, y)] = min(x, y)
            if len(root) >= held:
                yield out()
        if root:
            yield out()

    return run


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """(a, b, m): each edge with the least neighbour of its end a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
    return heavy_join(edges, least, ["a"], "k", total)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge; component: its smallest reachable node.

    Null ends are ignored; a self-loop alone makes its node a component; order of
    edges and repeats don't matter; no edges, no rows.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    e, path = kept(pairs.mapInArrow(_stars(HELD), pairs.schema).distinct())
    before = _mark(e)
    if before[0] <= FINISH:
        e, last = kept(e.coalesce(1).mapInArrow(_stars(2 * FINISH + 1), e.schema))
        drop(spark, path)
        before = (0,)
    for _ in range(max_rounds if before[0] else 0):
        both = e.where("a <> b").unionAll(e.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * before[0]).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = _with_least(large, before[0])
        turned = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e, last = kept(turned.unionAll(small.select("a", F.col("m").alias("b"))).unionAll(e.where("a = b")).distinct().coalesce(1 + before[0] // ROWS))
        now = _mark(e)
        drop(spark, path)
        path = last
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components haven't converged in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots).groupBy("node").agg(F.min("component").alias("component"))


class Forest:
    """Components of a graph that grows: what is added costs its own number of edges, not the graph's.

    Every node is written once, with the least node of its component at that time, its
    label.  When components merge, the labels that no longer stand for one get a root;
    labels and roots together give the components.  New edges are contracted to the
    components of their ends, which are looked up in those nodes' buckets, and only the
    contracted edges go through rounds.  Labels that have merged are written anew at each
    addition: they are fewer than the merges so far.  An addition that was cut short can
    be made again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        written = [int(n[6:]) for n in children(spark, self.path) if n.startswith("roots-") and exists(spark, f"{self.path}/{n}/_SUCCESS")]
        self.version = max(written, default=0)

    def _roots(self, version: int) -> str:
        return f"{self.path}/roots-{version}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("node"), F.lit(self.buckets)).cast("int")

    def _resolved(self, members: DataFrame) -> DataFrame:
        """(node, component) of (node, label)."""
        if not self.version:
            return members.select("node", F.col("label").alias("component"))
        roots = self.spark.read.parquet(self._roots(self.version))
        return members.join(roots, "label", "left").select("node", F.coalesce("component", "label").alias("component"))

    def components(self) -> DataFrame:
        """(node, component): as ``connected_components`` of all edges added so far."""
        return self._resolved(self.spark.read.parquet(f"{self.path}/members").select("node", "label"))

    def add(self, edges: DataFrame, src: str = "src", dst: str = "dst") -> None:
        pairs = stored(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null"))
        ends = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().withColumn("bucket", self._bucket()))
        if ends.isEmpty():
            return
        known = None
        if exists(self.spark, f"{self.path}/members"):
            touched = [r.bucket for r in ends.select("bucket").distinct().collect()]  # of a fixed number
            members = self.spark.read.parquet(f"{self.path}/members").where(F.col("bucket").isin(touched))
            known = stored(self._resolved(members.join(ends.select("node"), "node", "left_semi")))
            for end in ("a", "b"):
                of = known.select(F.col("node").alias(end), F.col("component").alias("__c"))
                pairs = pairs.join(of, end, "left").withColumn(end, F.coalesce("__c", end)).drop("__c")
        joined = stored(connected_components(pairs, "a", "b"))
        new = ends if known is None else ends.join(known, "node", "left_anti")
        rows = new.join(joined, "node").select("node", F.col("component").alias("label"), "bucket")
        rows.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/members")
        if known is None:
            return
        moved = joined.join(known.select(F.col("component").alias("node")).distinct(), "node", "left_semi").where("node <> component").select(F.col("node").alias("label"), "component")
        if self.version:
            further = moved.select(F.col("label").alias("component"), F.col("component").alias("__to"))
            old = self.spark.read.parquet(self._roots(self.version))
            moved = moved.unionByName(old.join(further, "component", "left").select("label", F.coalesce("__to", "component").alias("component")))
        moved.write.mode("overwrite").parquet(self._roots(self.version + 1))
        self.version += 1
        if self.version > 1:
            drop(self.spark, self._roots(self.version - 1))
