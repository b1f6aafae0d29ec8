"""Merging documents' graphs: grouping with first-record-wins, URI back-fill and provenance union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_known(c: str, order: Column) -> Column:
    """The first value that isn't null in an order."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), order))


def provenance(c: str = "provenance_ids") -> Column:
    """The union of provenance lists, sorted: the lists are exploded nowhere, and sets combine before the shuffle."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))


def ordered_provenance(c: str, order: Column) -> Column:
    """First-seen order, without repeats."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(c).alias("ids")))), lambda x: x.ids)))


def _merge(rows: DataFrame, keys: list[str], known: tuple[str, ...], first: tuple[str, ...] = ()) -> DataFrame:
    """A row for each key: of ``known`` columns the first value that isn't null, of ``first`` that of the first record, and the sources in the order in which they were first seen.

    Repeats of a source meet before the list is made, which holds each once.
    """
    order = F.struct("doc_id", "ord")
    told = lambda c: F.min(F.when(F.col(c).isNotNull() | F.lit(c in first), F.struct(order.alias("o"), F.col(c).alias("v")))).alias(c)
    each = rows.withColumn("__source", F.explode_outer("provenance_ids")).groupBy(*keys, "__source").agg(*map(told, (*known, *first)), F.min(order).alias("__o"))
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("__source").isNotNull(), F.struct("__o", "__source")))), lambda x: x["__source"])
    return each.groupBy(*keys).agg(*[F.min(c).getField("v").alias(c) for c in (*known, *first)], ids.alias("provenance_ids"))


def merge_mentions(mentions: DataFrame) -> DataFrame:
    """Entities by surface form and type label; graphs in the order of doc_id, ord. ``provenance.Ledger`` keeps the same without lists."""
    return _merge(mentions, ["surface_form", "type_label"], ("uri", "type_uri"), ("description",))


def merge_triples(triples: DataFrame) -> DataFrame:
    """Relations by the three surface forms; types play no part."""
    return _merge(triples, ["subject_sf", "predicate_sf", "object_sf"], tuple(c for c in ("subject_uri", "predicate_uri", "object_uri") if c in triples.columns))


def merge_metadata(rows: DataFrame, key: str = "entity", values: str = "values") -> DataFrame:
    return rows.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(values)))).alias(values))


def apply_clusters(mentions: DataFrame, triples: DataFrame, entity_clusters: DataFrame, edge_clusters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Reviewed merges (canonical, member, ord): later clusters override; provenance is concatenated, repeats and all."""

    def mapping(c: DataFrame) -> DataFrame:
        return c.groupBy("member").agg(F.max_by("canonical", "ord").alias("canonical"))

    def canon(df: DataFrame, col: str, m: DataFrame) -> DataFrame:
        m = m.select(F.col("member").alias("__m"), F.col("canonical").alias("__c"))
        return df.join(m, df[col] == m["__m"], "left").withColumn(col, F.coalesce("__c", col)).drop("__m", "__c")

    joined = lambda order: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "provenance_ids"))), lambda x: x.provenance_ids)).alias("provenance_ids")
    m = mapping(entity_clusters)
    order = F.struct("doc_id", "ord").alias("o")
    e = canon(mentions, "surface_form", m).groupBy("surface_form").agg(F.max_by("type_label", order).alias("type_label"), F.max_by("uri", order).alias("uri"), joined(order))
    t = canon(canon(triples, "subject_sf", m), "object_sf", m)
    if edge_clusters is not None:
        t = canon(t, "predicate_sf", mapping(edge_clusters))
    return e, t.groupBy("subject_sf", "predicate_sf", "object_sf").agg(joined(order))


def placed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds every row's place, from 0, in a global order, without sorting in one partition.

    Rows are range-partitioned and sorted by the order; each partition's rows are
    numbered in place, after the counts of the partitions before it, which are as many
    numbers as partitions. No second exchange follows.
    """
    from loomgraph.session import cut

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = cut(ranged.withColumn("__id", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__id", 33)))  # a row's partition, above its place there
    counts = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__b", F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).select("__p", F.coalesce("__b", F.lit(0)).alias("__b"))
    at = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__b")
    return parts.join(F.broadcast(before), "__p").withColumn(name, at).drop("__p", "__b", "__id")


def numbered(df: DataFrame, order: list[str], name: str, prefix: str = "e") -> DataFrame:
    """Consecutive identifiers in a global order: a prefix and the row's place."""
    return placed(df, order, name).withColumn(name, F.concat(F.lit(prefix), F.col(name).cast("string")))
