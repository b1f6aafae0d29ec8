"""A graph as a canonical knowledge graph: identifiers, reconciled terms, literals, extensions, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.functions import xsd
from loomgraph.operators.aggregate import numbered
from loomgraph.sources.ontology import Ontology, alias_index, resolve


def entities(merged: DataFrame, onto: Ontology | None = None) -> DataFrame:
    """(entity_id, surface_form, uri, description, type, provenance_ids) in the order of surface forms."""
    e = numbered(merged, ["surface_form", "type_label"], "entity_id")
    if onto is not None:
        e = resolve(e, onto.classes, alias_index(onto.classes, onto.triples), "type_uri", "type_label", "__t")
        e = e.withColumn("type_uri", F.coalesce("__t.uri", "type_uri")).withColumn("type_label", F.coalesce("__t.label", "type_label"))
    kind = F.when(F.col("type_label").isNotNull(), F.struct(F.col("type_label").alias("label"), F.col("type_uri").alias("uri")))
    return e.select("entity_id", "surface_form", "uri", "description", kind.alias("type"), "provenance_ids")


def relations(triples: DataFrame, kg_entities: DataFrame, onto: Ontology | None = None) -> DataFrame:
    """(subject_id, predicate, object_id, object_value, object_datatype, is_literal, provenance_ids).

    A surface form that several entities share stands for the last of them. Without an
    entity as subject a relation is dropped; an object that is no entity, or of a
    datatype predicate, is a literal.
    """
    last = kg_entities.groupBy("surface_form").agg(F.max_by("entity_id", F.substring("entity_id", 2, 20).cast("long")).alias("id"))
    s = last.select(F.col("surface_form").alias("subject_sf"), F.col("id").alias("subject_id"))
    o = last.select(F.col("surface_form").alias("object_sf"), F.col("id").alias("__o"))
    r = triples.join(s, "subject_sf").join(o, "object_sf", "left")
    declared, label, uri = F.lit(None).cast("string"), F.col("predicate_sf"), F.col("predicate_uri") if "predicate_uri" in triples.columns else F.lit(None).cast("string")
    if onto is not None:
        if "predicate_uri" not in r.columns:
            r = r.withColumn("predicate_uri", F.lit(None).cast("string"))
        r = resolve(r, onto.predicates, alias_index(onto.predicates, onto.triples), "predicate_uri", "predicate_sf", "__p")
        ranges = onto.ranges.groupBy("predicate_uri").agg(F.collect_set("class_uri").alias("__r")).withColumnRenamed("predicate_uri", "__ru")
        kinds = onto.predicates.select(F.col("uri").alias("__pu"), F.col("property_type").alias("__k"))
        r = r.join(kinds, F.col("__p.uri") == F.col("__pu"), "left").join(ranges, F.col("__p.uri") == F.col("__ru"), "left")
        declared = F.when(F.col("__p").isNotNull(), xsd.predicate_datatype("__k", "__r"))
        label, uri = F.coalesce("__p.label", "predicate_sf"), F.coalesce("__p.uri", "predicate_uri")
    r = r.withColumn("__d", declared).withColumn("is_literal", F.col("__d").isNotNull() | F.col("__o").isNull())
    return r.select(
        "subject_id",
        F.struct(label.alias("label"), uri.alias("uri")).alias("predicate"),
        F.when(~F.col("is_literal"), F.col("__o")).alias("object_id"),
        F.when(F.col("is_literal"), F.col("object_sf")).alias("object_value"),
        F.when(F.col("is_literal"), F.coalesce(F.nullif("__d", F.lit("")), xsd.guess("object_sf"))).alias("object_datatype"),
        "is_literal",
        "provenance_ids",
    )


def without_subject(triples: DataFrame, kg_entities: DataFrame) -> int:
    """How many relations have no entity as subject, and so are dropped."""
    return triples.join(kg_entities.select(F.col("surface_form").alias("subject_sf")), "subject_sf", "left_anti").count()


def extensions(terms: DataFrame, known: DataFrame, triple: DataFrame | None = None) -> DataFrame:
    """(label, uri, description) of the terms (label, uri, description, ord) that the ontology lacks, once by URI, or by label without one."""
    index = alias_index(known, triple).select(F.col("key").alias("__k"))
    new = terms.join(known.where("uri is not null").select("uri"), "uri", "left_anti")
    new = new.join(index, T.normalize_label("label") == index["__k"], "left_anti")
    once = new.groupBy(F.coalesce("uri", "label").alias("__t"), F.col("uri").isNull().alias("__u")).agg(*[F.min_by(c, "ord").alias(c) for c in ("label", "uri", "description")])
    return once.select("label", "uri", "description")


def cluster_output(clusters: DataFrame, kg_entities: DataFrame) -> DataFrame:
    """(entity_id, members) of the clusters whose canonical form has an identifier."""
    return clusters.join(kg_entities.select("entity_id", F.col("surface_form").alias("canonical")), "canonical").select("entity_id", "members")
