"""Target-distribution importance resampling over hashed word n-grams.

A document's features are its runs of 1 to n consecutive words, each hashed to one of
a fixed number of buckets.  A bucket's gain is the logarithm of how much more often
the target's features fall into it than the corpus's; a document's weight is the sum
of gains over its features.  Weights with Gumbel noise added are scores, of which the
highest are drawn: sampling without replacement in proportion to the exponential of
the weights.

Higher-order functions make each document's array of buckets, which is stored once as
it is read twice, to count and to score.  A score is an aggregate over ``element_at``
of a literal array of gains, one entry for each bucket, so no feature becomes a row
there.  Only sums by bucket are exchanged, and, to number the draw, a few numbers of
each eligible document.

Defined cases: null or empty text has no words, no features and weight 0; a row
without doc_id has no score and isn't eligible; rows that share a doc_id are documents
each, ties between them go by features and weight; no documents, no rows; no target,
all buckets' target counts are 0; other columns are ignored, by ``resample`` kept.
A text's arrays stand in memory while it is read, some 100 bytes for each word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.aggregate import placed
from loomgraph.session import stored

from ._columns import free, quoted
from .decontamination import words

#: Parameters of the noise: a document's draw depends on them and its doc_id alone.
SEED = 42


def _but_last(x: Column) -> Column:
    return F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0)))


def bucketed(docs: DataFrame, n: int = 3, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, buckets: of each document the buckets of its features, from 1, repeats kept."""
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), words(quoted(text_col).cast("string")).cast("array<binary>").alias("w"))
    runs, all_runs = "w", ["w"]
    for k in range(1, n):  # a column each, so that no run is made twice
        rows = rows.withColumn(f"w{k}", F.zip_with(_but_last(F.col(runs)), F.slice("w", F.lit(k + 1), F.size("w")), lambda a, b: F.concat(a, F.lit(b" "), b)))
        runs = f"w{k}"
        all_runs.append(runs)
    bucket = lambda x: (F.crc32(x) % buckets + 1).cast("int")
    return rows.select("doc_id", F.size("w").alias("n_words"), F.transform(F.concat(*all_runs), bucket).alias("buckets"))


def counts(rows: DataFrame) -> DataFrame:
    """(bucket, n): features in each bucket; sums are made in the map tasks first, so at most a row for each bucket leaves one."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of every bucket, from counts of corpus and target: a list of fixed length."""
    s, t = ({r.bucket: r.n for r in x.collect()} for x in (corpus, target))  # a row for each bucket at most
    all_s, all_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return [math.floor(1000 * math.log(float(t.get(b, 0) + 1) * all_s / (float(s.get(b, 0) + 1) * all_t))) for b in range(1, buckets + 1)]


def weights(docs: DataFrame, target: DataFrame, n: int = 3, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""
    rows = stored(bucketed(docs, n, buckets, id_col, text_col))
    wanted = bucketed(target.select(F.lit(None).cast("long").alias("doc_id"), quoted(target_text).alias("text")), n, buckets)
    gain = F.expr("array({})".format(",".join(f"{g}L" for g in gains(counts(rows), counts(wanted), buckets))))
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(gain, b))
    return rows.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the document's identifier alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(weighted: DataFrame, percent: int = 5, least_words: int = 20, seed: int = SEED) -> DataFrame:
    """Adds score, and rank (from 1) to the drawn: of N documents of enough words, the floor(percent * N / 100) highest scores, ties to the smaller doc_id.

    Eligible rows are put in a global order by a range exchange and numbered in place.
    """
    rows = stored(weighted.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    eligible = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    at = placed(rows.where(eligible).withColumn("down", -F.col("score")), ["down", "doc_id", "n_features", "weight"], "rank")
    drawn = rows.where(eligible).count() * percent // 100
    out = at.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1)).drop("down")
    return out.unionByName(rows.where(~F.coalesce(eligible, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def report(docs: DataFrame, target: DataFrame, n: int = 3, buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document."""
    return draw(weights(docs, target, n, buckets), percent, least_words, seed).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, n: int = 3, buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = SEED) -> DataFrame:
    """The drawn documents, whole, with all their columns; rows that share a doc_id are all drawn if one is."""
    drawn = draw(weights(docs, target, n, buckets), percent, least_words, seed).where("rank is not null")
    key = free(docs.columns, "drawn")
    return docs.join(drawn.select(F.col("doc_id").alias(key)).distinct(), quoted("doc_id") == F.col(key), "left_semi")
