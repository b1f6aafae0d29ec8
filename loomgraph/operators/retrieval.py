"""Retrieval: nearest nodes, their context within a few hops, and fused text ranking."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators.similarity import nearest
from loomgraph.session import cut, stored


def sentence(s="subject_sf", p="predicate_sf", o="object_sf"):
    return F.format_string("%s %s %s.", s, p, o)


def embed(nodes: DataFrame, encoder: Callable[[list[str]], list[list[float]]], col: str = "node") -> DataFrame:
    """Adds ``embedding`` by a pluggable encoder, called once per Arrow batch."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(encoder(s.tolist()))

    return nodes.withColumn("embedding", run(col))


def embed_relations(relations: DataFrame, encoder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(predicate_sf, embedding) of the distinct predicates, for relations to be found by meaning as nodes are."""
    return embed(relations.select("predicate_sf").distinct(), encoder, "predicate_sf")


def context(relations: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(sentence) of relations that touch a node fewer than ``depth`` steps from a seed (column node), either way."""
    r = relations.select("subject_sf", "predicate_sf", "object_sf").distinct()
    near = seeds.select("node").distinct()
    for _ in range(depth - 1):
        ahead = r.join(near, r["subject_sf"] == near["node"], "left_semi").select(F.col("object_sf").alias("node"))
        back = r.join(near, r["object_sf"] == near["node"], "left_semi").select(F.col("subject_sf").alias("node"))
        near = cut(near.union(ahead).union(back).distinct())
    s, o = near.withColumnRenamed("node", "subject_sf"), near.withColumnRenamed("node", "object_sf")
    return r.join(s, "subject_sf", "left_semi").unionByName(r.join(o, "object_sf", "left_semi")).select(sentence().alias("sentence")).distinct()


def contexts(relations: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(query, sentence) of ``context`` for every query of (query, node): all their frontiers grow together."""
    r = relations.select("subject_sf", "predicate_sf", "object_sf").distinct()
    near = seeds.select("query", "node").distinct()
    for _ in range(depth - 1):
        ahead = r.join(near, r["subject_sf"] == near["node"]).select("query", F.col("object_sf").alias("node"))
        back = r.join(near, r["object_sf"] == near["node"]).select("query", F.col("subject_sf").alias("node"))
        near = stored(near.union(ahead).union(back).distinct())
    touch = r.join(near, r["subject_sf"] == near["node"]).unionByName(r.join(near, r["object_sf"] == near["node"]))
    return touch.select("query", sentence().alias("sentence")).distinct()


def retrieve(nodes: DataFrame, relations: DataFrame, query: list[float], k: int = 8, depth: int = 2) -> str:
    """The sentences around the nodes nearest to a query, in order, as one text."""
    seeds = nearest(nodes, query, "node", "embedding", k)
    rows = context(relations, seeds, depth).orderBy("sentence").collect()  # a context for reading: k nodes' neighbourhood
    return " ".join(r.sentence for r in rows)


#: Rows of query terms up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def bm25(docs: DataFrame, queries: DataFrame, *, id_col: str, query_id: str, text: str = "text", query_text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, id, bm25) of the documents (ids are unique) that share a word with a query (Okapi, idf floored at a quarter of its mean).

    Only occurrences of query terms travel, once, to their document's partition: counts,
    scores and a ranking's first cut by query need no further exchange.
    """
    tokens = docs.select(F.col(id_col).alias("id"), T.bm25_tokens(text).alias("w")).withColumn("dl", F.size("w"))
    stats = tokens.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    q = queries.select(F.col(query_id).alias("query_id"), F.explode(T.bm25_tokens(query_text)).alias("t")).groupBy("query_id", "t").agg(F.count("*").alias("qf"))
    idf = tokens.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    idf = stored(idf.withColumn("idf", F.log((F.lit(stats.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))))
    floor = 0.25 * (idf.agg(F.avg("idf")).first()[0] or 0.0)
    asked = stored(q.join(idf.select("t", F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")).alias("idf")), "t"))
    small = F.broadcast if asked.count() <= BROADCAST_ROWS else (lambda df: df)
    found = tokens.select("id", "dl", F.explode("w").alias("t")).join(small(asked.select("t").distinct()), "t", "left_semi")
    tf = found.repartition("id").groupBy("id", "t", "dl").agg(F.count("*").alias("tf"))
    weight = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(stats.avgdl)))
    return tf.join(small(asked), "t").groupBy("query_id", "id").agg(F.sum(weight).alias("bm25"))


def fuse(lexical: DataFrame, cosine: DataFrame, k: int = 16, share: float = 0.5) -> DataFrame:
    """(query_id, id, score, rank) by share * bm25 + (1 - share) * cosine, both raw; a missing one counts 0."""
    both = lexical.join(cosine, ["query_id", "id"], "full").select("query_id", "id", (share * F.coalesce("bm25", F.lit(0.0)) + (1 - share) * F.coalesce("cosine", F.lit(0.0))).alias("score"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
