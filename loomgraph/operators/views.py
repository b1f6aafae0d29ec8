"""Views of a graph: entities with their types, relations with class assertions, predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IS_A = "is a"


def entity_view(mentions: DataFrame) -> DataFrame:
    """(surface_form, uri, description) once per surface form; types are entities too."""
    own = mentions.select("surface_form", "uri", "description", F.lit(0).alias("o"))
    types = mentions.where("type_label is not null").select(F.col("type_label").alias("surface_form"), F.col("type_uri").alias("uri"), F.lit(None).cast("string").alias("description"), F.lit(1).alias("o"))
    first = lambda c: F.min_by(c, F.struct("o", F.coalesce("uri", F.lit("")), F.coalesce("description", F.lit("")))).alias(c)
    return own.unionByName(types).groupBy("surface_form").agg(first("uri"), first("description"))


def class_assertions(mentions: DataFrame) -> DataFrame:
    """(subject_sf, predicate_sf, object_sf, provenance_ids): each typed mention is a ... its type."""
    return mentions.where("type_label is not null").select(F.col("surface_form").alias("subject_sf"), F.lit(IS_A).alias("predicate_sf"), F.col("type_label").alias("object_sf"), "provenance_ids")


def relation_view(triples: DataFrame, mentions: DataFrame, assertions: bool = True) -> DataFrame:
    own = triples.select("subject_sf", "predicate_sf", "object_sf", "provenance_ids")
    return own.unionByName(class_assertions(mentions)) if assertions else own


def predicates(relations: DataFrame) -> DataFrame:
    return relations.select("predicate_sf").distinct()


def split_terms(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Given terms: those already typed, with their own provenance, and those still to type, stamped with their document."""
    t = corpus.select(F.col("id").alias("doc_id"), F.posexplode("terms").alias("ord", "t")).select("doc_id", F.col("ord").cast("long"), "t.*")
    flat = lambda d, p: d.select("doc_id", "ord", "surface_form", "uri", "description", F.col("type.label").alias("type_label"), F.col("type.uri").alias("type_uri"), p.alias("provenance_ids"))
    return flat(t.where("type.label is not null"), F.coalesce("provenance_ids", F.array().cast("array<string>"))), flat(t.where("type.label is null"), F.array("doc_id"))


def document_mentions(mentions: DataFrame) -> DataFrame:
    """One mention per document, surface form and type: the first."""
    rest = [c for c in mentions.columns if c not in ("doc_id", "surface_form", "type_label", "ord")]
    return mentions.groupBy("doc_id", "surface_form", "type_label").agg(F.min("ord").alias("ord"), *[F.min_by(c, "ord").alias(c) for c in rest]).select(mentions.columns)


def candidate_prompt(predicates: DataFrame) -> DataFrame:
    """(label, line): how a predicate is offered to an extractor; an empty domain or range reads Any."""
    names = lambda c: F.when(F.size(c) > 0, F.array_join(F.array_sort(c), ", ")).otherwise("Any")
    tail = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" ("), F.col("description"), F.lit(")"))).otherwise("")
    return predicates.select("label", F.concat(F.lit("- "), "label", F.lit(": subject is ["), names("domain"), F.lit("], object is ["), names("range"), F.lit("]"), tail).alias("line"))


def without_quotes(mentions: DataFrame) -> DataFrame:
    return mentions.where(~F.col("surface_form").contains('"'))
