"""How well extracted relations respect an ontology: one row per check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.sources.ontology import Ontology, alias_index, with_class_uris


def checks(mentions: DataFrame, triples: DataFrame, onto: Ontology, *, domain: bool = True, range_: bool = True, predicate: bool = False, types: bool = False) -> DataFrame:
    """(doc_id, ord, check, ok, message). Types count by URI or, without one, by label. An unknown predicate has no further checks; an end that is untyped, unknown or unconstrained has none."""
    out = []
    if types:
        index = alias_index(onto.classes, onto.triples).select(F.col("key").alias("__k"))
        m = mentions.join(index, T.normalize_label("type_label") == index["__k"], "left")
        ok = F.col("type_label").isNull() | F.col("__k").isNotNull()
        out.append(m.select("doc_id", "ord", F.lit("type").alias("check"), ok.alias("ok"), F.when(~ok, F.concat(F.lit("Entity "), "surface_form", F.lit(": type "), "type_label", F.lit(" not in allowed types"))).alias("message")))
    pred = alias_index(onto.predicates, onto.triples).select(F.col("key").alias("__k"), F.col("uri").alias("__p"))
    t = triples.join(pred, T.normalize_label("predicate_sf") == pred["__k"], "left").drop("__k")
    name = F.concat(F.lit("Relation "), "subject_sf", F.lit(" -["), "predicate_sf", F.lit("]-> "), "object_sf", F.lit(": "))
    if predicate:
        ok = F.col("__p").isNotNull()
        out.append(t.select("doc_id", "ord", F.lit("predicate").alias("check"), ok.alias("ok"), F.when(~ok, F.concat(name, F.lit("Predicate "), "predicate_sf", F.lit(" not in ontology"))).alias("message")))
    last = with_class_uris(onto, mentions).groupBy("doc_id", F.col("surface_form").alias("__s")).agg(F.max_by("type_label", "ord").alias("type_label"), F.max_by("type_uri", "ord").alias("type_uri"))
    up = onto.closure.groupBy(F.col("uri").alias("__c")).agg(F.collect_set("ancestor_uri").alias("up"))
    for on, what, of, col, ends, place in ((domain, "domain", "Subject", "subject_sf", onto.domains, "domain"), (range_, "range", "Object", "object_sf", onto.ranges, "range")):
        if not on:
            continue
        allowed = ends.groupBy(F.col("predicate_uri").alias("__q")).agg(F.collect_set("class_uri").alias("uris"), F.array_sort(F.collect_set("class_label")).alias("labels"))
        x = t.where("__p is not null").join(allowed, F.col("__p") == F.col("__q")).withColumnRenamed("doc_id", "__d")
        x = x.join(last, (F.col("__d") == last["doc_id"]) & (F.col(col) == F.col("__s"))).where("type_label is not null").join(up, F.col("type_uri") == F.col("__c"), "left")
        ok = F.array_contains("labels", F.col("type_label")) | F.coalesce(F.arrays_overlap("up", "uris"), F.lit(False))
        out.append(x.select(F.col("__d").alias("doc_id"), "ord", F.lit(what).alias("check"), ok.alias("ok"), F.when(~ok, F.concat(name, F.lit(f"{of} type "), "type_label", F.lit(f" not in {place} "), F.array_join("labels", ", "))).alias("message")))
    if not out:
        return triples.select("doc_id", "ord", F.lit("").alias("check"), F.lit(True).alias("ok"), F.lit("").alias("message")).limit(0)
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def score(documents: DataFrame, checked: DataFrame) -> DataFrame:
    """(doc_id, score, errors): share of checks passed, 1 without any; messages of types first, then by relation: predicate, domain, range."""
    place = F.when(F.col("check") == "type", 0).otherwise(1), F.col("ord"), F.array_position(F.array(*map(F.lit, ("type", "predicate", "domain", "range"))), F.col("check"))
    per = checked.groupBy("doc_id").agg(F.avg(F.col("ok").cast("double")).alias("score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct(*[x.alias(f"o{i}") for i, x in enumerate(place)], "message")))), lambda x: x.message), "; ").alias("errors"))
    return documents.select("doc_id").distinct().join(per, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(1.0)).alias("score"), F.coalesce("errors", F.lit("")).alias("errors"))
