"""Predicates that fit the types at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import xsd
from loomgraph.sources.ontology import Ontology, with_class_uris


def narrow(onto: Ontology, groups: DataFrame, domain: bool = True, range_: bool = True) -> DataFrame:
    """(group, predicate_uri) of the predicates whose domain and range fit a group's types (group, type_uri).

    An end fits if it is unconstrained, not enforced, met by a type or a superclass of
    one, or, for ranges, a datatype. With a column type_label, types are resolved by
    label where they have no URI of the ontology.
    """
    if "type_label" in groups.columns:
        groups = with_class_uris(onto, groups)
    up = groups.join(onto.closure, groups["type_uri"] == onto.closure["uri"]).select("group", "ancestor_uri").distinct()
    wanted = groups.select("group").distinct().join(F.broadcast(onto.predicates.select(F.col("uri").alias("predicate_uri"))))

    def fits(end: DataFrame, enforced: bool, datatypes: bool) -> DataFrame:
        if not enforced:
            return wanted
        free = onto.predicates.select(F.col("uri").alias("predicate_uri")).join(end, "predicate_uri", "left_anti")
        if datatypes:
            free = free.union(end.where(F.col("class_uri").startswith(xsd.NAMESPACE)).select("predicate_uri")).distinct()
        met = up.join(end, up["ancestor_uri"] == end["class_uri"]).select("group", "predicate_uri").distinct()
        return wanted.join(free, "predicate_uri", "left_semi").select("group", "predicate_uri").union(met).distinct()

    return fits(onto.domains, domain, False).join(fits(onto.ranges, range_, True), ["group", "predicate_uri"])


def suggest_predicates(onto: Ontology, types: DataFrame, **flags) -> DataFrame:
    """(uri, label, property_type, description, domain, range) of the predicates that fit the types found (type_uri, type_label); domain and range are class labels."""
    fit = narrow(onto, types.select(F.lit(0).alias("group"), "type_uri", "type_label"), **flags).select(F.col("predicate_uri").alias("uri"))
    labels = lambda end, name: end.groupBy(F.col("predicate_uri").alias("uri")).agg(F.array_sort(F.collect_set("class_label")).alias(name))
    out = onto.predicates.join(fit, "uri", "left_semi").join(labels(onto.domains, "domain"), "uri", "left").join(labels(onto.ranges, "range"), "uri", "left")
    none = F.array().cast("array<string>")
    return out.select("uri", "label", "property_type", "description", F.coalesce("domain", none).alias("domain"), F.coalesce("range", none).alias("range"))


def target_types(onto: Ontology) -> DataFrame:
    """(label, uri, description) of the classes to extract, by label."""
    return onto.classes.select("label", "uri", "description").orderBy("label", "uri")


def narrow_batch(onto: Ontology, groups: DataFrame, **flags) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for many groups, each set of types answered once.

    Returns (group, answer), (answer, predicates) and the legend (label, uri) of all
    predicates used, by label. Answers are numbered by their first group.
    """
    signed = groups.groupBy("group").agg(F.array_sort(F.collect_set(F.coalesce("type_uri", F.lit("")))).alias("types"))
    signed = signed.withColumn("signature", F.sha2(F.array_join("types", "\n"), 256))
    kinds = signed.select("signature", F.explode("types").alias("type_uri")).distinct().select(F.col("signature").alias("group"), "type_uri")
    names = onto.predicates.select(F.col("uri").alias("predicate_uri"), "label")
    answers = narrow(onto, kinds, **flags).join(names, "predicate_uri").groupBy("group").agg(F.array_sort(F.collect_set("label")).alias("predicates"))
    each = signed.join(answers.withColumnRenamed("group", "signature"), "signature", "left").select("group", F.coalesce("predicates", F.array().cast("array<string>")).alias("predicates"))
    order = each.groupBy("predicates").agg(F.min("group").alias("first"))
    order = order.withColumn("answer", F.row_number().over(Window.orderBy("first")) - 1)  # as many rows as distinct answers
    legend = onto.predicates.join(order.select(F.explode("predicates").alias("label")).distinct(), "label", "left_semi").select("label", "uri", "description").orderBy("label")
    return each.join(order, "predicates").select("group", "answer"), order.select("answer", "predicates"), legend
