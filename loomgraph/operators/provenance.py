"""Provenance as a table: one row for each thing that is known of a key and the record that told it first.

A list of sources for each key grows with the corpus, and so would the row that holds
it.  Here (key, attribute, value, doc_id, ord) rows are kept instead, each once, with
the first record in the order of doc_id and ord; lists are made on export alone.  A
ledger keeps the rows in files by bucket of the key.  What documents add is appended
to their keys' buckets, without reading or rewriting any other; adding them again adds
nothing, and documents may come in any order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import exists, stored

#: Buckets of a ledger, and files of a bucket above which ``compact`` rewrites it.
BUCKETS, FILES = 64, 8
#: The attribute of a source, and the one that every key has.
SOURCE, SEEN = "source", "seen"
_ORDER = ("doc_id", "ord")


def facts(rows: DataFrame, keys: list[str], attributes: tuple[str, ...] = (), firsts: tuple[str, ...] = (), sources: str = "provenance_ids") -> DataFrame:
    """(keys, attribute, value, doc_id, ord): every source of a key once; of each attribute the first value that isn't null; of ``firsts`` that of the first record, null or not."""
    order = F.struct(*_ORDER)
    each = rows.select(*keys, *_ORDER, F.lit(SOURCE).alias("attribute"), F.explode(sources).alias("value")).groupBy(*keys, "attribute", "value").agg(F.min(order).alias("o"))
    entries = [F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in (*attributes, *firsts)] + [F.struct(F.lit(SEEN).alias("attribute"), F.lit(None).cast("string").alias("value"))]
    known = F.filter(F.array(*entries), lambda e: e["value"].isNotNull() | e["attribute"].isin(SEEN, *firsts))
    rest = rows.select(*keys, *_ORDER, F.inline(known)).groupBy(*keys, "attribute").agg(F.min_by("value", order).alias("value"), F.min(order).alias("o"))
    return each.unionByName(rest).select(*keys, "attribute", "value", "o.*")


def sources(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, doc_id, ord)."""
    return table.where(F.col("attribute") == SOURCE).select(*keys, F.col("value").alias("source"), *_ORDER)


def merged(table: DataFrame, keys: list[str], attributes: tuple[str, ...] = ()) -> DataFrame:
    """(keys, attributes, n_sources): a row for each key, without lists."""
    order = F.struct(*_ORDER)
    value = lambda a: F.min_by("value", F.when(F.col("attribute") == a, order)).alias(a)
    return table.groupBy(*keys).agg(*[value(a) for a in attributes], F.count_if(F.col("attribute") == SOURCE).alias("n_sources"))


def listed(table: DataFrame, keys: list[str], attributes: tuple[str, ...] = (), name: str = "provenance_ids") -> DataFrame:
    """For export: (keys, attributes, provenance_ids), sources in the order in which they were first seen, ties by name."""
    order = F.struct(*_ORDER)
    is_source = F.col("attribute") == SOURCE
    value = lambda a: F.min_by("value", F.when(F.col("attribute") == a, order)).alias(a)
    ids = F.transform(F.array_sort(F.collect_list(F.when(is_source, F.struct(*_ORDER, "value")))), lambda x: x["value"])
    return table.groupBy(*keys).agg(*[value(a) for a in attributes], ids.alias(name))


class Ledger:
    """The table under a path, by buckets of the key."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _same(self, a: DataFrame, b: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in (*self.keys, "attribute", "value")])

    def _files(self, of: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        return rows if of is None else rows.where(F.col("bucket").isin(of))

    def add(self, table: DataFrame) -> int:
        """Appends what isn't known yet, or was told by an earlier record than any so far; the number of rows."""
        new = stored(table.withColumn("bucket", self._bucket()))
        if exists(self.spark, self.path):
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # of a fixed number
            if not touched:
                return 0
            old = self._files(touched)
            # of a first value it matters when it was told; a later one adds nothing, whatever it says
            told = old.where(F.col("attribute") != SOURCE).groupBy(*self.keys, "attribute").agg(F.min(F.struct(*_ORDER)).alias("o"))
            first, other = new.where(F.col("attribute") != SOURCE), new.where(F.col("attribute") == SOURCE)
            same = reduce(lambda x, y: x & y, [first[c].eqNullSafe(told[c]) for c in (*self.keys, "attribute")])
            first = first.join(told, same & (told["o"] <= F.struct(first["doc_id"], first["ord"])), "left_anti")
            other = other.join(old, self._same(other, old) & (F.struct(old["doc_id"], old["ord"]) <= F.struct(other["doc_id"], other["ord"])), "left_anti")
            new = stored(first.unionByName(other))
        n = new.count()
        if n:
            new.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(self.path)
        return n

    def read(self, of: list[int] | None = None) -> DataFrame:
        """The table, or some buckets of it, as ``facts`` of all rows added would be: files may tell a thing twice, the earlier record counts."""
        order = F.struct(*_ORDER)
        rows = self._files(of).drop("bucket")
        each = rows.where(F.col("attribute") == SOURCE).groupBy(*self.keys, "attribute", "value").agg(F.min(order).alias("o"))
        rest = rows.where(F.col("attribute") != SOURCE).groupBy(*self.keys, "attribute").agg(F.min_by("value", order).alias("value"), F.min(order).alias("o"))
        return each.unionByName(rest).select(*self.keys, "attribute", "value", "o.*")

    def compact(self, most: int = FILES) -> list[int]:
        """Rewrites the buckets of more files than ``most``, each whole; the others aren't read. Their numbers."""
        names = self.spark.read.parquet(self.path).select("bucket", F.input_file_name().alias("file")).distinct()
        of = sorted(r.bucket for r in names.groupBy("bucket").count().where(F.col("count") > most).collect())
        if of:
            rows = stored(self.read(of).withColumn("bucket", self._bucket()))
            rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return of
