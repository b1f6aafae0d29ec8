"""A training-data pipeline: every stage takes what its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
the rows that stay, with the columns of ``documents``; the last one returns tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import byte_bpe, decontamination, ngram_join, pii, quality
from loomgraph.llm._columns import free
from loomgraph.session import stored

#: Documents score at least so much to stay.
QUALITY = 0.7


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: rejected documents go."""
    weights = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", modulus=4, held=2)
    score = free(docs.columns, "score")
    return quality.scored(docs, weights, score_col=score).where(F.col(score) >= QUALITY).drop(score)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each component the row of the smallest doc_id stays; rows without doc_id have no component and stay.

    Rows that share a doc_id are told apart by their text; of rows alike in both, one stays.
    """
    node = free(docs.columns, "node")
    named = docs.where("doc_id is not null").withColumn(node, F.xxhash64("doc_id", "text"))
    found = ngram_join.near_duplicates(named, n=5, percent=80, id_col=node).select(F.col("doc_id").alias(node), "component_id").distinct()
    best = found.join(named.select(node, "doc_id"), node).groupBy("component_id").agg(F.min(F.struct("doc_id", node)).getField(node).alias(node))
    n = free([*docs.columns, node], "n")
    one = named.join(best.select(node), node, "left_semi").withColumn(n, F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(node))).where(F.col(n) == 1)
    return one.drop(n, node).unionByName(docs.where("doc_id is null"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, one_in=20)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: personal data and what discloses it are replaced; n_chars follows the new text."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids, their number, and a digest of what they decode to."""
    out = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", keep_one),
    ("benchmark_decontamination", keep_clean),
    ("pii", sanitise),
    ("byte_bpe", encode),
]

#: A fitted classifier and corpus statistics have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result stored as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
