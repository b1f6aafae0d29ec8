"""The star schema as a knowledge graph: mentions and triples by rule, and the ontology they are held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources import ontology as O

NS = "http://example.org/onto#"
TURTLE = f"""
@prefix : <{NS}> .
@prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix skos: <http://www.w3.org/2004/02/skos/core#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:Place a owl:Class ; rdfs:label "Place" .
:Region a owl:Class ; rdfs:label "Region" ; rdfs:subClassOf :Place .
:Nation a owl:Class ; rdfs:label "Nation" ; rdfs:subClassOf :Place ; skos:altLabel "Country" .
:Agent a owl:Class ; rdfs:label "Agent" .
:Customer a owl:Class ; rdfs:label "Customer" ; rdfs:subClassOf :Agent .
:Supplier a owl:Class ; rdfs:label "Supplier" ; rdfs:subClassOf :Agent ; skos:altLabel "Vendor" .
:Product a owl:Class ; rdfs:label "Product" .
:Part a owl:Class ; rdfs:label "Part" ; rdfs:subClassOf :Product .
:Brand a owl:Class ; rdfs:label "Brand" .
:Order a owl:Class ; rdfs:label "Order" .
:in a owl:ObjectProperty ; rdfs:label "in" ; rdfs:domain :Place ; rdfs:range :Place .
:located_in a owl:ObjectProperty ; rdfs:label "located in" ; rdfs:domain :Agent ; rdfs:range :Place .
:has_brand a owl:ObjectProperty ; rdfs:label "has brand" ; rdfs:domain :Product ; rdfs:range :Brand .
:placed_by a owl:ObjectProperty ; rdfs:label "placed by" ; rdfs:domain :Order ; rdfs:range :Customer .
:supplies a owl:ObjectProperty ; rdfs:label "supplies" ; rdfs:domain :Supplier ; rdfs:range :Part .
:order_date a owl:DatatypeProperty ; rdfs:label "order date" ; rdfs:domain :Order ; rdfs:range xsd:date .
:size a owl:DatatypeProperty ; rdfs:label "size" ; rdfs:domain :Product ; rdfs:range xsd:integer .
:related a owl:ObjectProperty ; rdfs:label "related" .
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def onto(spark: SparkSession) -> O.Ontology:
    return O.ontology(O.triples(spark, TURTLE))


#: Table, key, surface form and type of every kind of entity.
ENTITIES = (
    ("region", "r_regionkey", "r_name", "Region"), ("nation", "n_nationkey", "n_name", "Nation"), ("customer", "c_custkey", "c_name", "Customer"), ("supplier", "s_suppkey", "s_name", "Supplier"),
    ("part", "p_partkey", "p_name", "Part"), ("part", "p_partkey", "p_brand", "Brand"), ("orders", "o_orderkey", "concat('Order ', o_orderkey)", "Order"),
)


def mentions(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """One mention per row and kind; provenance table:key."""
    parts = []
    for name, key, form, kind in ENTITIES:
        if kinds is None or kind in kinds:
            parts.append(
                table(spark, sf_dir, name).selectExpr(
                    f"'{name}' as doc_id", f"cast({key} as long) as ord", f"{form} as surface_form", "cast(null as string) as uri", "cast(null as string) as description",
                    f"'{kind}' as type_label", f"'{NS}{kind}' as type_uri", f"array(concat('{name}:', {key})) as provenance_ids",
                )
            )
    return reduce(DataFrame.unionByName, parts)


def triples(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, ord, subject_sf, predicate_sf, object_sf, provenance_ids); joins only where a name stands in another table."""
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation")
    makes = {
        "in": lambda: nation.join(t("region"), F.expr("n_regionkey = r_regionkey")).selectExpr("'nation' d", "n_nationkey k", "n_name s", "r_name o"),
        "located in": lambda: t("customer").join(nation, F.expr("c_nationkey = n_nationkey")).selectExpr("'customer' d", "c_custkey k", "c_name s", "n_name o").union(
            t("supplier").join(nation, F.expr("s_nationkey = n_nationkey")).selectExpr("'supplier' d", "s_suppkey k", "s_name s", "n_name o")
        ),
        "has brand": lambda: t("part").selectExpr("'part' d", "p_partkey k", "p_name s", "p_brand o"),
        "placed by": lambda: t("orders").join(t("customer"), F.expr("o_custkey = c_custkey")).selectExpr("'orders' d", "o_orderkey k", "concat('Order ', o_orderkey) s", "c_name o"),
        "supplies": lambda: t("lineitem").select("l_suppkey", "l_partkey").distinct().join(t("supplier"), F.expr("l_suppkey = s_suppkey")).join(t("part"), F.expr("l_partkey = p_partkey")).selectExpr("'supplies' d", "l_suppkey * 100000000 + l_partkey k", "s_name s", "p_name o"),
        "order date": lambda: t("orders").selectExpr("'orders' d", "o_orderkey k", "concat('Order ', o_orderkey) s", "date_format(o_orderdate, 'yyyy-MM-dd') o"),
        "size": lambda: t("part").selectExpr("'part' d", "p_partkey k", "p_name s", "cast(p_size as string) o"),
    }
    parts = [make().withColumn("p", F.lit(p)) for p, make in makes.items() if kinds is None or p in kinds]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(F.col("d").alias("doc_id"), F.col("k").cast("long").alias("ord"), F.col("s").alias("subject_sf"), F.col("p").alias("predicate_sf"), F.col("o").alias("object_sf"), F.array(F.concat("d", F.lit(":"), F.col("k").cast("string"))).alias("provenance_ids"))


# --- the same in DuckDB's SQL ---------------------------------------------------------------------------


def sql_mentions(kinds: tuple[str, ...] | None = None) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS doc_id, CAST({k} AS BIGINT) AS ord, {f} AS surface_form, '{kind}' AS type_label, '{NS}{kind}' AS type_uri, concat('{n}:', {k}) AS prov FROM {n}" for n, k, f, kind in ENTITIES if kinds is None or kind in kinds
    )


_SQL_TRIPLES = {
    "in": "SELECT 'nation' AS doc_id, CAST(n_nationkey AS BIGINT) AS ord, n_name AS s, 'in' AS p, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey",
    "located in": "SELECT 'customer', c_custkey, c_name, 'located in', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'supplier', s_suppkey, s_name, 'located in', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "has brand": "SELECT 'part' AS doc_id, p_partkey AS ord, p_name AS s, 'has brand' AS p, p_brand AS o FROM part",
    "placed by": "SELECT 'orders', o_orderkey, concat('Order ', o_orderkey), 'placed by', c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "supplies": "SELECT 'supplies', l_suppkey * 100000000 + l_partkey, s_name, 'supplies', p_name FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey",
    "order date": "SELECT 'orders', o_orderkey, concat('Order ', o_orderkey), 'order date', strftime(o_orderdate, '%Y-%m-%d') FROM orders",
    "size": "SELECT 'part', p_partkey, p_name, 'size', CAST(p_size AS VARCHAR) FROM part",
}


def sql_triples(kinds: tuple[str, ...] | None = None) -> str:
    rows = " UNION ALL ".join(q for p, q in _SQL_TRIPLES.items() if kinds is None or p in kinds)
    return f"SELECT doc_id, ord, s, p, o, concat(doc_id, ':', ord) AS prov FROM ({rows}) AS t(doc_id, ord, s, p, o)"
