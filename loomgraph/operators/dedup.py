"""Deduplication by normalised keys with type buckets, and by vector similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators.components import connected_components
from loomgraph.operators.similarity import similar_groups


def string_keys(items: DataFrame, col: str = "surface_form", ascii_only: bool = False) -> DataFrame:
    """(surface_form, key): every form with the key under which it merges."""
    return items.select(F.col(col).alias("surface_form")).distinct().withColumn("key", T.dedup_form("surface_form", ascii_only))


def type_buckets(typed: DataFrame, pairs: DataFrame, closure_sizes: DataFrame) -> DataFrame:
    """(surface_form, key) with a suffix for buckets after the first.

    typed: (surface_form, key, type_uri, type_label); forms of a key are taken in
    order, each into the first bucket whose type is compatible, which then takes the
    more specific type. A key's forms are distinct spellings, so groups are small; the
    pairs that a group needs travel with its rows.
    """
    near = pairs.groupBy("a").agg(F.collect_set("b").alias("compatible"))
    rows = typed.join(near, typed["type_uri"] == near["a"], "left").join(closure_sizes.withColumnRenamed("uri", "__u"), F.col("type_uri") == F.col("__u"), "left")
    rows = rows.select("surface_form", "key", "type_uri", "type_label", "compatible", F.coalesce("size", F.lit(0)).alias("size"), T.normalize_label(F.coalesce("type_label", "type_uri")).alias("norm"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        known = lambda v: isinstance(v, str)

        def agree(x, y) -> bool:
            if not (known(x.type_uri) or known(x.type_label)) or not (known(y.type_uri) or known(y.type_label)):
                return True
            if x.compatible is not None and y.compatible is not None:
                return y.type_uri in x.compatible
            return x.norm == y.norm

        heads, out = [], {}
        for row in pdf.sort_values(["surface_form", "type_label"], na_position="first").itertuples():
            for i, head in enumerate(heads):
                if agree(head, row):
                    out[row.surface_form] = i
                    typed_head = known(head.type_uri) or known(head.type_label)
                    heads[i] = row if row.size > head.size or not typed_head else head
                    break
            else:
                out[row.surface_form] = len(heads)
                heads.append(row)
        key = pdf["key"].iloc[0]
        return pd.DataFrame({"surface_form": list(out), "key": [key if i == 0 else f"{key}\0{i}" for i in out.values()]})

    return rows.groupBy("key").applyInPandas(fold, "surface_form string, key string")


def canonical_forms(keys: DataFrame) -> DataFrame:
    """(surface_form, canonical): the least form of each key."""
    return keys.join(keys.groupBy("key").agg(F.min("surface_form").alias("canonical")), "key").select("surface_form", "canonical")


def clusters(canonical: DataFrame) -> DataFrame:
    """(canonical, members) of the forms that merge with another."""
    return canonical.groupBy("canonical").agg(F.array_sort(F.collect_set("surface_form")).alias("members")).where(F.size("members") > 1)


def reduction(canonical: DataFrame) -> DataFrame:
    """One row: total, deduplicated, duplicates, reduction in per cent (0 if there are none)."""
    n = canonical.agg(F.count("*").alias("total_items"), F.countDistinct("canonical").alias("deduplicated_items"))
    n = n.withColumn("duplicate_items", F.col("total_items") - F.col("deduplicated_items"))
    return n.withColumn("reduction", F.when(F.col("total_items") > 0, 100.0 * F.col("duplicate_items") / F.col("total_items")).otherwise(0.0))


def rewrite(triples: DataFrame, entity_forms: DataFrame, edge_forms: DataFrame | None = None) -> DataFrame:
    """Triples over canonical forms; objects that are no entity pass unchanged; equal ones merge, provenance without repeats."""

    def canon(df: DataFrame, col: str, forms: DataFrame) -> DataFrame:
        f = forms.select(F.col("surface_form").alias("__s"), F.col("canonical").alias("__c"))
        return df.join(f, df[col] == f["__s"], "left").withColumn(col, F.coalesce("__c", col)).drop("__s", "__c")

    t = canon(canon(triples, "subject_sf", entity_forms), "object_sf", entity_forms)
    if edge_forms is not None:
        t = canon(t, "predicate_sf", edge_forms)
    return t.groupBy("subject_sf", "predicate_sf", "object_sf").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("provenance_ids")))).alias("provenance_ids"))


def deduplicate(mentions: DataFrame, triples: DataFrame, *, edges: bool = True, pairs: DataFrame | None = None, closure_sizes: DataFrame | None = None, vectors: DataFrame | None = None, threshold: float = 0.8, ascii_only: bool = False):
    """(entities, triples, entity clusters, edge clusters) of a graph after merging.

    With ``pairs`` and ``closure_sizes`` incompatible types stay apart; with ``vectors``
    (surface_form, embedding) similar canonical forms merge besides, whatever their types.
    Of mentions with one surface form the last type wins, so homonyms merge.
    """
    keys = string_keys(mentions, ascii_only=ascii_only)
    if pairs is not None:
        last = mentions.groupBy("surface_form").agg(F.max_by("type_uri", F.struct("doc_id", "ord")).alias("type_uri"), F.max_by("type_label", F.struct("doc_id", "ord")).alias("type_label"))
        keys = type_buckets(keys.join(last, "surface_form"), pairs, closure_sizes)
    forms = canonical_forms(keys)
    if vectors is not None:
        forms = semantic(forms, vectors, threshold)
    f = forms.withColumnRenamed("surface_form", "__s")
    order = F.struct("doc_id", "ord")
    e = mentions.join(f, mentions["surface_form"] == f["__s"]).groupBy("canonical").agg(
        F.min_by("type_label", F.struct(F.col("surface_form") != F.col("canonical"), order)).alias("type_label"),
        F.min_by("type_uri", F.struct(F.col("surface_form") != F.col("canonical"), order)).alias("type_uri"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("provenance_ids")))).alias("provenance_ids"),
    )
    edge_forms = canonical_forms(string_keys(triples, "predicate_sf", ascii_only)) if edges else None
    return e.withColumnRenamed("canonical", "surface_form"), rewrite(triples, forms, edge_forms), clusters(forms), clusters(edge_forms) if edges else None


def semantic(forms: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(surface_form, canonical) after similar canonical forms have merged too: components of the pairs at the threshold, least form first."""
    heads = forms.select("canonical").distinct().join(vectors.withColumnRenamed("surface_form", "canonical"), "canonical")
    pairs, copies = similar_groups(heads, "canonical", "embedding", threshold)
    edges = pairs.select("a", "b").unionAll(copies.where("canonical <> head").select("canonical", "head"))
    merged = connected_components(edges, "a", "b").withColumnRenamed("node", "__n")
    return forms.join(merged, forms["canonical"] == merged["__n"], "left").select("surface_form", F.coalesce("component", "canonical").alias("canonical"))


def suggest_clusters(mentions: DataFrame, vectors: DataFrame | None = None, threshold: float = 0.8) -> DataFrame:
    """Merges to review, none of them made."""
    forms = canonical_forms(string_keys(mentions))
    return clusters(semantic(forms, vectors, threshold) if vectors is not None else forms)


#: The methods that can be asked for; only the first is there, as the others need a language model.
METHODS = ("semhash", "lm_based", "full")


def run(mentions: DataFrame, triples: DataFrame, method: str = "full", vectors: DataFrame | None = None, threshold: float = 0.95, **more):
    """``deduplicate`` by the name of a method; an empty graph comes back as it is.

    ValueError for a method that isn't offered, or one besides the first without vectors.
    """
    if method not in METHODS or (method != METHODS[0] and vectors is None):
        raise ValueError(f"{method}: no such method, or no vectors for it")
    if mentions.isEmpty() and triples.isEmpty():
        return mentions, triples, None, None
    if method != METHODS[0]:
        raise ValueError(f"{method}: needs a language model")
    return deduplicate(mentions, triples, vectors=vectors, threshold=threshold, **more)


def write_proposal(proposal: DataFrame, path: str) -> dict:
    """Proposed clusters (canonical, members) as JSON lines for review, and their numbers."""
    rows = proposal.select(F.col("canonical").alias("representative"), "members")
    rows.write.mode("overwrite").json(path)
    n = proposal.sparkSession.read.schema("representative string, members array<string>").json(path).agg(F.count("*").alias("clusters"), F.sum(F.size("members")).alias("members")).first()
    return {"num_entity_clusters": n.clusters, "num_clustered_entities": n.members or 0, "output_file": path}


def read_proposal(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, member, ord) of a reviewed proposal, as ``apply_clusters`` takes it."""
    rows = spark.read.schema("representative string, members array<string>").json(path)
    return rows.select(F.col("representative").alias("canonical"), F.explode("members").alias("member"), F.xxhash64("representative").alias("ord"))
