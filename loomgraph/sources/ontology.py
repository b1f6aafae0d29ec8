"""Ontologies as DataFrames: classes, predicates, domains, ranges, aliases and the superclass closure.

An ontology is small and comes from one file, so its text is parsed on the driver;
everything derived from it is DataFrames, which Spark broadcasts by their size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.functions import text as T
from loomgraph.functions import xsd
from loomgraph.sources import turtle as tt

_CLASSES = (tt.OWL + "Class", tt.RDFS + "Class")
_OBJECT, _DATA = tt.OWL + "ObjectProperty", tt.OWL + "DatatypeProperty"
#: SKOS labels by the order in which they count.
ALIAS_PROPERTIES = (tt.SKOS + "prefLabel", tt.SKOS + "altLabel", tt.SKOS + "hiddenLabel")


@dataclass
class Ontology:
    """triples(s, p, o, o_kind, lang); classes(uri, label, description, ord); predicates(uri, label, description, property_type, ord); domains and ranges(predicate_uri, class_uri, class_label); closure(uri, ancestor_uri)."""

    triples: DataFrame
    classes: DataFrame
    predicates: DataFrame
    domains: DataFrame
    ranges: DataFrame
    closure: DataFrame


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """The triples of a Turtle file, in any file system that Spark reads."""
    return triples(spark, "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def triples(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(tt.parse(text), schemas.ONTO_TRIPLE)


def superclasses(edges: list[tuple[str, str]], nodes: list[str]) -> list[tuple[str, str]]:
    """(node, itself or an ancestor), safe on cycles."""
    up: dict[str, list[str]] = {}
    for a, b in edges:
        up.setdefault(a, []).append(b)
    out = []
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for b in up.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out += [(n, s) for s in sorted(seen)]
    return out


def ontology(triple: DataFrame) -> Ontology:
    """The frames of an ontology. Blank subjects are skipped; a range or domain that is no declared class (nor, for ranges, an XSD type) is dropped; a property declared both ways is a datatype property."""
    spark = triple.sparkSession
    t = triple.where(~F.col("s").startswith("_:"))
    of = lambda p: t.where((F.col("p") == p) & (F.col("o_kind") == "literal")).groupBy("s").agg(F.min("o").alias("v"))
    label, comment = of(tt.RDFS + "label").withColumnRenamed("v", "label"), of(tt.RDFS + "comment").withColumnRenamed("v", "comment")
    alias = skos_labels(t).groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("prio", "label"))), lambda x: x.label).alias("aliases"))
    typed = t.where(F.col("p") == tt.RDF + "type")

    def described(subjects: DataFrame) -> DataFrame:
        d = subjects.join(label, "s", "left").join(comment, "s", "left").join(alias, "s", "left")
        d = d.withColumn("label", F.coalesce("label", T.label_fallback("s")))
        return d.withColumn("description", T.describe("comment", "label", "aliases")).withColumn("ord", F.row_number().over(Window.orderBy("s")))

    classes = described(typed.where(F.col("o").isin(*_CLASSES)).select("s").distinct()).select(F.col("s").alias("uri"), "label", "description", "ord")
    kinds = typed.where(F.col("o").isin(_OBJECT, _DATA)).groupBy("s").agg(F.max(F.col("o") == _DATA).alias("data"))
    predicates = described(kinds).select(F.col("s").alias("uri"), "label", "description", F.when(F.col("data"), "owl:DatatypeProperty").otherwise("owl:ObjectProperty").alias("property_type"), "ord")
    named = classes.select(F.col("uri").alias("class_uri"), F.col("label").alias("class_label"))
    simple = spark.createDataFrame([(xsd.NAMESPACE + x, x) for x in xsd.TYPES], "class_uri string, class_label string")

    def linked(p: str, to: DataFrame) -> DataFrame:
        return t.where(F.col("p") == p).select(F.col("s").alias("predicate_uri"), F.col("o").alias("class_uri")).join(predicates.select(F.col("uri").alias("predicate_uri")), "predicate_uri", "left_semi").join(to, "class_uri").select("predicate_uri", "class_uri", "class_label").distinct()

    edges = [(r.s, r.o) for r in t.where(F.col("p") == tt.RDFS + "subClassOf").select("s", "o").collect()]
    nodes = sorted({r.s for r in t.select("s").distinct().collect()})
    closure = spark.createDataFrame(superclasses(edges, nodes), "uri string, ancestor_uri string")
    return Ontology(t, classes, predicates, linked(tt.RDFS + "domain", named), linked(tt.RDFS + "range", named.union(simple)), closure)


def skos_labels(triple: DataFrame) -> DataFrame:
    """(s, prio, label): preferred, alternative and hidden labels."""
    order = F.array(*map(F.lit, ALIAS_PROPERTIES))
    return triple.where(F.col("p").isin(*ALIAS_PROPERTIES)).select("s", F.array_position(order, F.col("p")).cast("int").alias("prio"), F.col("o").alias("label"))


def alias_index(items: DataFrame, triple: DataFrame | None = None) -> DataFrame:
    """(key, uri, label): normalised names of items (uri, label, ord); a label beats the URI's last part, that a SKOS label; then the first item wins."""
    names = items.select("uri", "label", "ord", F.lit(0).alias("prio"), T.normalize_label("label").alias("key"))
    names = names.unionByName(items.select("uri", "label", "ord", F.lit(1).alias("prio"), T.normalize_label(T.uri_local_name("uri")).alias("key")))
    if triple is not None:
        skos = skos_labels(triple).select(F.col("s").alias("uri"), (F.col("prio") + 1).alias("prio"), T.normalize_label("label").alias("key"))
        names = names.unionByName(items.select("uri", "label", "ord").join(skos, "uri"), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("key").orderBy("prio", "ord"))
    return names.where("key <> ''").withColumn("n", first).where("n = 1").select("key", "uri", "label")


def resolve(rows: DataFrame, items: DataFrame, index: DataFrame, uri: str, label: str, into: str) -> DataFrame:
    """Adds ``into`` (uri, label of the item): by URI, or else by normalised label; null if neither is known."""
    by_uri = items.where("uri is not null").select(F.col("uri").alias("__u"), F.struct("uri", "label").alias("__a"))
    by_name = index.select(F.col("key").alias("__k"), F.struct("uri", "label").alias("__b"))
    out = rows.join(by_uri, rows[uri] == by_uri["__u"], "left").withColumn("__n", T.normalize_label(label)).join(by_name, F.col("__n") == F.col("__k"), "left")
    return out.withColumn(into, F.coalesce("__a", "__b")).drop("__u", "__a", "__k", "__b", "__n")


def collisions(triple: DataFrame) -> DataFrame:
    """(form, uris): normalised rdfs:labels that several resources have."""
    named = triple.where((F.col("p") == tt.RDFS + "label") & ~F.col("s").startswith("_:")).select(T.normalize_label("o").alias("form"), "s")
    return named.groupBy("form").agg(F.array_sort(F.collect_set("s")).alias("uris")).where(F.size("uris") > 1).orderBy("form")


def resolve_class(onto: Ontology, rows: DataFrame, uri: str, label: str, into: str = "class_uri") -> DataFrame:
    """Adds the URI that a type resolves to: its own if the ontology has it as a subject, or else the first resource whose label, preferred, alternative or hidden, normalises alike."""
    subjects = onto.triples.select(F.col("s").alias("__s")).distinct()
    order = F.array(*map(F.lit, (tt.RDFS + "label", *ALIAS_PROPERTIES)))
    named = onto.triples.where(F.array_contains(order, F.col("p"))).select(T.normalize_label("o").alias("__k"), "s", F.array_position(order, F.col("p")).alias("prio")).where("__k <> ''")
    named = named.withColumn("n", F.row_number().over(Window.partitionBy("__k").orderBy("prio", "s"))).where("n = 1").select("__k", F.col("s").alias("__by"))
    out = rows.join(subjects, rows[uri] == subjects["__s"], "left").withColumn("__n", T.normalize_label(label)).join(named, F.col("__n") == F.col("__k"), "left")
    return out.withColumn(into, F.coalesce("__s", "__by")).drop("__s", "__k", "__by", "__n")


def with_class_uris(onto: Ontology, rows: DataFrame) -> DataFrame:
    """The rows with the ``type_uri`` that their type resolves to, by URI or by label; one that doesn't resolve stays as it is.

    Each distinct type is resolved once.
    """
    kinds = resolve_class(onto, rows.select("type_uri", "type_label").where("type_uri is not null or type_label is not null").distinct(), "type_uri", "type_label", "__r")
    known = kinds.where("__r is not null").select(F.col("type_uri").alias("__u"), F.col("type_label").alias("__l"), "__r")
    same = F.col("type_uri").eqNullSafe(F.col("__u")) & F.col("type_label").eqNullSafe(F.col("__l"))
    return rows.join(known, same, "left").withColumn("type_uri", F.coalesce("__r", "type_uri")).drop("__u", "__l", "__r")


def compatible_pairs(onto: Ontology) -> DataFrame:
    """(a, b) of class URIs of which one is the other or an ancestor of it."""
    up = onto.closure.select(F.col("uri").alias("a"), F.col("ancestor_uri").alias("b"))
    return up.union(up.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
