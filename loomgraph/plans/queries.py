"""The registered queries of the knowledge-graph operators, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.functions import xsd
from loomgraph.functions.vectors import cosine
from loomgraph.operators import aggregate, chunk, conformance, dedup, narrowing, retrieval, serialize, similarity, stats, view_model, views
from loomgraph.operators.components import connected_components
from loomgraph.plans import star
from loomgraph.session import stored
from loomgraph.sources import ontology as O
from loomgraph.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_NS = star.NS


def query(sql: str | None):
    """Registers a query with its SQL, if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _joined(c: str = "provenance_ids"):
    return F.array_join(F.array_sort(F.array_distinct(c)), ",")


def _onto_sql() -> str:
    """The ontology of the star schema as relations: super(c, a), dom(p, c), rng(p, c)."""
    up = {"Region": "Place", "Nation": "Place", "Customer": "Agent", "Supplier": "Agent", "Part": "Product"}
    classes = ["Place", "Region", "Nation", "Agent", "Customer", "Supplier", "Product", "Part", "Brand", "Order"]
    dom = {"in": "Place", "located in": "Agent", "has brand": "Product", "placed by": "Order", "supplies": "Supplier", "order date": "Order", "size": "Product"}
    rng = {"in": "Place", "located in": "Place", "has brand": "Brand", "placed by": "Customer", "supplies": "Part"}
    rows = lambda d: ", ".join(f"('{a}', '{b}')" for a, b in d)
    return f"""super AS (SELECT * FROM (VALUES {rows([(c, c) for c in classes] + [*up.items()])}) v(c, a)),
        dom AS (SELECT * FROM (VALUES {rows(dom.items())}) v(p, c)), rng AS (SELECT * FROM (VALUES {rows(rng.items())}) v(p, c)),
        preds AS (SELECT p FROM dom UNION SELECT 'related')"""


@query("SELECT CAST(doc_id AS VARCHAR) AS id, length(text) AS n, concat('doc:', doc_id) AS provenance FROM documents WHERE text <> ''")
def corpus_scan(spark, d):
    return star.table(spark, d, "documents").where("text <> ''").select(F.col("doc_id").cast("string").alias("id"), F.length("text").cast("long").alias("n"), F.concat(F.lit("doc:"), "doc_id").alias("provenance"))


_CAMEL_SQL = r"trim(regexp_replace(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"SELECT DISTINCT v AS label, {_CAMEL_SQL.format('v')} AS form FROM (SELECT c_name AS v FROM customer UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_name FROM part UNION ALL SELECT concat(p_type, 'HTTPServer_', replace(p_name, ' ', 'X')) FROM part UNION ALL SELECT list_extract(regexp_split_to_array(url, '[#/]'), -1) FROM pages)"
)
def label_normalize(spark, d):
    t = lambda n: star.table(spark, d, n)
    v = t("customer").select(F.col("c_name").alias("v")).union(t("part").select("p_brand")).union(t("part").select("p_name"))
    v = v.union(t("part").select(F.concat("p_type", F.lit("HTTPServer_"), F.replace("p_name", F.lit(" "), F.lit("X"))))).union(t("pages").select(T.uri_local_name("url")))
    return v.distinct().select(F.col("v").alias("label"), T.normalize_label("v").alias("form"))


_GUESS_SQL = r"""CASE WHEN v = '' THEN 'xsd:string' WHEN regexp_full_match(v, '\s*[+-]?\d+\s*') THEN 'xsd:integer'
    WHEN regexp_full_match(v, '\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*') THEN 'xsd:decimal' WHEN lower(v) IN ('true', 'false') THEN 'xsd:boolean'
    WHEN regexp_full_match(v, '\d{4}-\d{2}-\d{2}') THEN 'xsd:date' WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}') THEN 'xsd:dateTime' ELSE 'xsd:string' END"""


@query(
    f"""SELECT kind, {_GUESS_SQL} AS datatype, count(*) AS n FROM (
    SELECT 'key' AS kind, CAST(o_orderkey AS VARCHAR) AS v FROM orders UNION ALL SELECT 'date', strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT 'time', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') FROM orders
    UNION ALL SELECT 'status', o_orderstatus FROM orders UNION ALL SELECT 'price', CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS VARCHAR) FROM part UNION ALL SELECT 'flag', CAST(p_size > 10 AS VARCHAR) FROM part
    UNION ALL SELECT 'props', props FROM events UNION ALL SELECT 'long', concat('99999999999999999999', o_orderkey) FROM orders UNION ALL SELECT 'none', '' FROM region) GROUP BY ALL"""
)
def xsd_guess(spark, d):
    t = lambda n, k, e: star.table(spark, d, n).selectExpr(f"'{k}' as kind", f"{e} as v")
    rows = t("orders", "key", "cast(o_orderkey as string)")
    for more in (
        ("orders", "date", "date_format(o_orderdate, 'yyyy-MM-dd')"), ("orders", "time", "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\")"), ("orders", "status", "o_orderstatus"),
        ("part", "price", "cast(cast(p_retailprice as decimal(12, 2)) as string)"), ("part", "flag", "cast(p_size > 10 as string)"), ("events", "props", "props"), ("orders", "long", "concat('99999999999999999999', o_orderkey)"), ("region", "none", "''"),
    ):
        rows = rows.union(t(*more))
    return rows.groupBy("kind", xsd.guess("v").alias("datatype")).agg(F.count("*").alias("n"))


@query(f"SELECT surface_form, type_label, min(type_uri) AS type_uri, string_agg(DISTINCT prov, ',' ORDER BY prov) AS provenance FROM ({star.sql_mentions()}) GROUP BY surface_form, type_label")
def mention_aggregate(spark, d):
    return aggregate.merge_mentions(star.mentions(spark, d)).select("surface_form", "type_label", "type_uri", _joined().alias("provenance"))


@query(f"SELECT s AS subject, p AS predicate, o AS object, string_agg(DISTINCT prov, ',' ORDER BY prov) AS provenance FROM ({star.sql_triples()}) GROUP BY s, p, o")
def relation_aggregate(spark, d):
    return aggregate.merge_triples(star.triples(spark, d)).select(F.col("subject_sf").alias("subject"), F.col("predicate_sf").alias("predicate"), F.col("object_sf").alias("object"), _joined().alias("provenance"))


@query(f"SELECT surface_form AS subject, 'is a' AS predicate, type_label AS object, prov AS provenance FROM ({star.sql_mentions()})")
def class_assertions(spark, d):
    return views.class_assertions(star.mentions(spark, d)).select(F.col("subject_sf").alias("subject"), F.col("predicate_sf").alias("predicate"), F.col("object_sf").alias("object"), _joined().alias("provenance"))


@query(f"SELECT p AS predicate, count(*) AS n, count(DISTINCT s) AS subjects FROM (SELECT s, p FROM ({star.sql_triples()}) UNION ALL SELECT surface_form, 'is a' FROM ({star.sql_mentions()})) GROUP BY p")
def relation_view(spark, d):
    v = views.relation_view(star.triples(spark, d), star.mentions(spark, d))
    return v.groupBy(F.col("predicate_sf").alias("predicate")).agg(F.count("*").alias("n"), F.countDistinct("subject_sf").alias("subjects"))


@query(f"SELECT DISTINCT surface_form FROM (SELECT surface_form FROM ({star.sql_mentions()}) UNION ALL SELECT type_label FROM ({star.sql_mentions()}))")
def entity_view(spark, d):
    return views.entity_view(star.mentions(spark, d)).select("surface_form")


@query(f"SELECT type_uri AS class, count(*) AS n FROM ({star.sql_mentions()}) GROUP BY type_uri")
def class_usage(spark, d):
    return stats.class_usage(star.mentions(spark, d))


@query(f"SELECT p AS predicate, count(*) AS n FROM ({star.sql_triples()}) GROUP BY p")
def predicate_usage(spark, d):
    return stats.predicate_usage(star.triples(spark, d))


_GROUPS_SQL = "grp AS (SELECT DISTINCT concat('r', n_regionkey) AS g, 'Nation' AS c FROM nation UNION SELECT concat('o', o_orderstatus), 'Order' FROM orders UNION SELECT concat('o', o_orderstatus), 'Customer' FROM orders UNION SELECT concat('t', p_type), 'Part' FROM part UNION SELECT concat('t', p_type), 'Brand' FROM part WHERE p_size > 25 UNION SELECT 'x', 'Region' UNION SELECT 'x', 'Supplier')"
_NARROW_SQL = f"""WITH {_onto_sql()}, {_GROUPS_SQL}, up AS (SELECT DISTINCT g, a FROM grp JOIN super USING (c)), all_p AS (SELECT * FROM (SELECT DISTINCT g FROM grp) CROSS JOIN preds),
    fit AS (SELECT g, p FROM all_p WHERE (p NOT IN (SELECT p FROM dom) OR EXISTS (SELECT 1 FROM dom JOIN up ON dom.c = up.a WHERE dom.p = all_p.p AND up.g = all_p.g))
        AND (p NOT IN (SELECT p FROM rng) OR EXISTS (SELECT 1 FROM rng JOIN up ON rng.c = up.a WHERE rng.p = all_p.p AND up.g = all_p.g)))"""


def _groups(spark, d) -> DataFrame:
    t = lambda n, g, c, w="true": star.table(spark, d, n).where(w).selectExpr(f"{g} as group", f"'{_NS}{c}' as type_uri")
    rows = t("nation", "concat('r', n_regionkey)", "Nation")
    for more in (("orders", "concat('o', o_orderstatus)", "Order"), ("orders", "concat('o', o_orderstatus)", "Customer"), ("part", "concat('t', p_type)", "Part"), ("part", "concat('t', p_type)", "Brand", "p_size > 25"), ("region", "'x'", "Region"), ("region", "'x'", "Supplier")):
        rows = rows.union(t(*more))
    return rows.distinct()


@query(_NARROW_SQL + " SELECT g AS grp, p AS predicate FROM fit")
def predicate_narrowing(spark, d):
    onto = star.onto(spark)
    fit = narrowing.narrow(onto, _groups(spark, d))
    return fit.join(onto.predicates.select(F.col("uri").alias("predicate_uri"), "label"), "predicate_uri").select(F.col("group").alias("grp"), F.col("label").alias("predicate"))


@query(_NARROW_SQL + ", each AS (SELECT g, string_agg(p, ',' ORDER BY p) AS predicates FROM fit GROUP BY g) SELECT g AS grp, predicates, dense_rank() OVER (ORDER BY f) - 1 AS answer FROM (SELECT *, min(g) OVER (PARTITION BY predicates) AS f FROM each)")
def predicate_narrowing_batch(spark, d):
    of, answers, _ = narrowing.narrow_batch(star.onto(spark), _groups(spark, d))
    return of.join(answers, "answer").select(F.col("group").alias("grp"), F.array_join("predicates", ",").alias("predicates"), F.col("answer").cast("long").alias("answer"))


@query(
    f"""WITH RECURSIVE sub(c, a) AS (VALUES ('Region', 'Place'), ('Nation', 'Place'), ('Customer', 'Agent'), ('Supplier', 'Agent'), ('Part', 'Product')),
    used AS (SELECT type_label AS c, count(*) AS n FROM ({star.sql_mentions()}) GROUP BY type_label), up(c, a) AS (SELECT c, c FROM used UNION SELECT up.c, sub.a FROM up JOIN sub ON up.a = sub.c)
    SELECT c AS class, a AS ancestor, n FROM up JOIN used USING (c)"""
)
def superclass_closure(spark, d):
    """The classes of the graph's mentions with all that they are besides, and how many mentions that concerns."""
    local = lambda c: T.uri_local_name(c)
    used = stats.class_usage(star.mentions(spark, d)).withColumnRenamed("class", "uri")
    return star.onto(spark).closure.join(used, "uri").select(local("uri").alias("class"), local("ancestor_uri").alias("ancestor"), "n")


_REVERSED_SQL = f"""tr AS (SELECT doc_id, ord, s, p, o FROM ({star.sql_triples()}) UNION ALL SELECT 'reversed', n_nationkey, r_name, 'located in', n_name FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'reversed', 1000 + n_nationkey, n_name, 'borders', r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
    kind AS (SELECT DISTINCT surface_form AS sf, type_label AS c FROM ({star.sql_mentions()})),
    checks AS (SELECT doc_id, ord, 'predicate' AS "check", p IN (SELECT p FROM preds) AS ok FROM tr
        UNION ALL SELECT doc_id, ord, 'domain', EXISTS (SELECT 1 FROM super JOIN dom ON super.a = dom.c WHERE super.c = k.c AND dom.p = tr.p) FROM tr JOIN kind k ON k.sf = tr.s WHERE p IN (SELECT p FROM dom)
        UNION ALL SELECT doc_id, ord, 'range', EXISTS (SELECT 1 FROM super JOIN rng ON super.a = rng.c WHERE super.c = k.c AND rng.p = tr.p) FROM tr JOIN kind k ON k.sf = tr.o WHERE p IN (SELECT p FROM rng))"""


def _conformance(spark, d, types=lambda m: m):
    t = star.triples(spark, d).select("doc_id", "ord", "subject_sf", "predicate_sf", "object_sf")
    pairs = star.table(spark, d, "nation").join(star.table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    t = t.union(pairs.selectExpr("'reversed'", "cast(n_nationkey as long)", "r_name", "'located in'", "n_name")).union(pairs.selectExpr("'reversed'", "cast(1000 + n_nationkey as long)", "n_name", "'borders'", "r_name"))
    m = types(star.mentions(spark, d).select("surface_form", "type_label", "type_uri").distinct())
    ends = t.select("doc_id", F.col("subject_sf").alias("surface_form")).union(t.select("doc_id", "object_sf")).distinct()
    m = ends.join(m, "surface_form").select("doc_id", F.lit(0).cast("long").alias("ord"), "surface_form", "type_label", "type_uri")
    return t, conformance.checks(m, t, star.onto(spark), predicate=True)


def _conformance_rows(spark, d, types):
    return _conformance(spark, d, types)[1]


_WHOLE_GRAPH = f'WITH {_onto_sql()}, {_REVERSED_SQL} SELECT doc_id, ord, "check", ok FROM checks'


@query(f'WITH {_onto_sql()}, {_REVERSED_SQL} SELECT doc_id, ord, "check", ok FROM checks')
def conformance_checks(spark, d):
    return _conformance(spark, d)[1].select("doc_id", "ord", "check", "ok")


@query(f"WITH {_onto_sql()}, {_REVERSED_SQL} SELECT doc_id, round(avg(CAST(ok AS DOUBLE)), 6) AS score FROM checks GROUP BY doc_id")
def conformance_score(spark, d):
    t, checked = _conformance(spark, d)
    return conformance.score(t, checked).select("doc_id", F.round("score", 6).alias("score"))


_TERMS_SQL = "term AS (SELECT DISTINCT event_type AS label FROM events UNION SELECT DISTINCT p_type FROM part UNION SELECT * FROM (VALUES ('COUNTRY'), ('vendor'), ('hasBrand'), ('Customer'), ('place'), ('ORDER')))"
_KNOWN_SQL = "known AS (SELECT * FROM (VALUES ('place', 'Place'), ('region', 'Region'), ('nation', 'Nation'), ('country', 'Nation'), ('agent', 'Agent'), ('customer', 'Customer'), ('supplier', 'Supplier'), ('vendor', 'Supplier'), ('product', 'Product'), ('part', 'Part'), ('brand', 'Brand'), ('order', 'Order')) v(form, class))"


def _terms(spark, d) -> DataFrame:
    extra = spark.createDataFrame([(x,) for x in ("COUNTRY", "vendor", "hasBrand", "Customer", "place", "ORDER")], "label string")
    return star.table(spark, d, "events").select(F.col("event_type").alias("label")).union(star.table(spark, d, "part").select("p_type")).union(extra).distinct().withColumn("uri", F.lit(None).cast("string"))


@query(f"WITH {_TERMS_SQL}, {_KNOWN_SQL} SELECT label, class FROM term LEFT JOIN known ON {_CAMEL_SQL.format('label')} = form")
def label_match(spark, d):
    onto = star.onto(spark)
    found = O.resolve(_terms(spark, d), onto.classes, O.alias_index(onto.classes, onto.triples), "uri", "label", "found")
    return found.select("label", F.col("found.label").alias("class"))


@query(f"WITH {_TERMS_SQL}, {_KNOWN_SQL} SELECT label FROM term WHERE {_CAMEL_SQL.format('label')} NOT IN (SELECT form FROM known)")
def ontology_extensions(spark, d):
    onto = star.onto(spark)
    terms = _terms(spark, d).withColumn("description", F.lit("new")).withColumn("ord", F.col("label"))
    return serialize.extensions(terms, onto.classes, onto.triples).select("label")


_FORMS_SQL = "forms AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN concat(p_name, 's') WHEN 1 THEN upper(p_name[1]) || p_name[2:] ELSE p_name END AS sf FROM part), keyed AS (SELECT sf, regexp_replace(lower(sf), 's$', '') AS k FROM forms), canon AS (SELECT sf, min(sf) OVER (PARTITION BY k) AS canonical FROM keyed)"


def _forms(spark, d) -> DataFrame:
    return star.table(spark, d, "part").selectExpr("'part' as doc_id", "p_partkey as ord", "case p_partkey % 3 when 0 then concat(p_name, 's') when 1 then concat(upper(substring(p_name, 1, 1)), substring(p_name, 2)) else p_name end as surface_form")


@query(f"WITH {_FORMS_SQL} SELECT canonical, string_agg(sf, ',' ORDER BY sf) AS members FROM canon GROUP BY canonical HAVING count(*) > 1")
def string_dedup(spark, d):
    forms = dedup.canonical_forms(dedup.string_keys(_forms(spark, d), ascii_only=True))
    return dedup.clusters(forms).select("canonical", F.array_join("members", ",").alias("members"))


@query(f"WITH {_FORMS_SQL} SELECT count(*) AS total_items, count(DISTINCT canonical) AS deduplicated_items, count(*) - count(DISTINCT canonical) AS duplicate_items, round(100.0 * (count(*) - count(DISTINCT canonical)) / count(*), 6) AS reduction FROM canon")
def dedup_stats(spark, d):
    return dedup.reduction(dedup.canonical_forms(dedup.string_keys(_forms(spark, d), ascii_only=True))).withColumn("reduction", F.round("reduction", 6))


@query(f"WITH {_FORMS_SQL}, tr AS (SELECT CASE p_partkey % 3 WHEN 0 THEN concat(p_name, 's') WHEN 1 THEN upper(p_name[1]) || p_name[2:] ELSE p_name END AS s, p_brand AS o, concat('part:', p_partkey) AS prov FROM part) SELECT canonical AS subject, o AS object, string_agg(DISTINCT prov, ',' ORDER BY prov) AS provenance FROM tr JOIN canon ON s = sf GROUP BY canonical, o")
def relation_rewrite(spark, d):
    forms = dedup.canonical_forms(dedup.string_keys(_forms(spark, d), ascii_only=True))
    brand = star.table(spark, d, "part").selectExpr("p_partkey as ord", "p_brand as object_sf")
    t = _forms(spark, d).join(brand, "ord").select(F.col("surface_form").alias("subject_sf"), F.lit("has brand").alias("predicate_sf"), "object_sf", F.array(F.concat(F.lit("part:"), "ord")).alias("provenance_ids"))
    return dedup.rewrite(t, forms).select(F.col("subject_sf").alias("subject"), F.col("object_sf").alias("object"), _joined().alias("provenance"))


#: Types of the three forms of a name, by its length: place in a list, the last of which stands for none.
_BUCKET_KINDS = ("Supplier", "Agent", "Customer", "Brand", None)
_BUCKET_SQL = """WITH name AS (SELECT DISTINCT p_name AS w FROM part), kind(k, c, size) AS (VALUES (0, 'Supplier', 2), (1, 'Agent', 1), (2, 'Customer', 2), (3, 'Brand', 1), (4, NULL, 0)),
    ok AS (SELECT x.k AS a, y.k AS b, x.c IS NULL OR y.c IS NULL OR x.c = y.c OR (x.c = 'Agent' AND y.size = 2) OR (y.c = 'Agent' AND x.size = 2) AS fits, CASE WHEN y.size > x.size OR x.c IS NULL THEN y.k ELSE x.k END AS head FROM kind x, kind y),
    f AS (SELECT w, length(w) % 5 AS k1, (length(w) * 2 + 1) % 5 AS k2, (length(w) * 3 + ascii(w)) % 5 AS k3 FROM name),
    two AS (SELECT f.*, ok.fits AS same2, CASE WHEN ok.fits THEN ok.head ELSE k1 END AS head0 FROM f JOIN ok ON ok.a = k1 AND ok.b = k2),
    three AS (SELECT two.*, x.fits AS in0, NOT same2 AND y.fits AS in1 FROM two JOIN ok x ON x.a = head0 AND x.b = k3 JOIN ok y ON y.a = k2 AND y.b = k3)
    SELECT concat(upper(w[1]), w[2:]) AS surface_form, w AS key FROM three UNION ALL SELECT w, CASE WHEN same2 THEN w ELSE concat(w, '|1') END FROM three
    UNION ALL SELECT concat(w, 's'), CASE WHEN in0 THEN w WHEN in1 THEN concat(w, '|1') WHEN same2 THEN concat(w, '|1') ELSE concat(w, '|2') END FROM three"""


@query(_BUCKET_SQL)
def type_buckets(spark, d):
    """Three spellings of every part's name, whose types agree or not: each goes to the first bucket of its key that it agrees with."""
    onto = star.onto(spark)
    n = F.length("w")
    at = F.array(n % 5, (n * 2 + 1) % 5, (n * 3 + F.ascii("w")) % 5)
    form = F.array(F.concat(F.upper(F.substring("w", 1, 1)), F.expr("substring(w, 2)")), F.col("w"), F.concat("w", F.lit("s")))
    rows = star.table(spark, d, "part").select(F.col("p_name").alias("w")).distinct().select(F.inline(F.arrays_zip(form.alias("surface_form"), at.alias("k"))))
    label = F.get(F.array(*[F.lit(k) for k in _BUCKET_KINDS]), F.col("k").cast("int"))
    typed = rows.select("surface_form", label.alias("type_label"), F.concat(F.lit(_NS), label).alias("type_uri"))
    typed = typed.join(dedup.string_keys(typed), "surface_form")
    out = dedup.type_buckets(typed, O.compatible_pairs(onto), onto.closure.groupBy("uri").agg(F.count("*").alias("size")))
    return out.select("surface_form", F.replace("key", F.lit("\0"), F.lit("|")).alias("key"))


_KG_SQL = f"""merged AS (SELECT surface_form, type_label, string_agg(DISTINCT prov, ',' ORDER BY prov) AS prov FROM ({star.sql_mentions()}) GROUP BY surface_form, type_label),
    kge AS (SELECT row_number() OVER (ORDER BY surface_form, type_label) - 1 AS n, * FROM merged)"""


@query(f"WITH {_KG_SQL} SELECT concat('e', n) AS entity_id, surface_form, type_label, prov AS provenance FROM kge")
def kg_entities(spark, d):
    e = serialize.entities(aggregate.merge_mentions(star.mentions(spark, d)), star.onto(spark))
    return e.select("entity_id", "surface_form", F.col("type.label").alias("type_label"), _joined().alias("provenance"))


@query(
    f"""WITH {_KG_SQL}, ids AS (SELECT surface_form AS sf, concat('e', max(n)) AS id FROM kge GROUP BY surface_form), tr AS (SELECT DISTINCT s, p, o FROM ({star.sql_triples()}))
    SELECT a.id AS subject_id, p AS predicate, CASE WHEN p IN ('order date', 'size') THEN NULL ELSE b.id END AS object_id, CASE WHEN p IN ('order date', 'size') THEN o END AS object_value,
    CASE p WHEN 'order date' THEN 'xsd:date' WHEN 'size' THEN 'xsd:integer' END AS object_datatype FROM tr JOIN ids a ON a.sf = s LEFT JOIN ids b ON b.sf = o"""
)
def kg_relations(spark, d):
    onto = star.onto(spark)
    e = serialize.entities(aggregate.merge_mentions(star.mentions(spark, d)), onto)
    r = serialize.relations(aggregate.merge_triples(star.triples(spark, d)), e, onto)
    return r.select("subject_id", F.col("predicate.label").alias("predicate"), "object_id", "object_value", "object_datatype")


@query("SELECT concat(regexp_extract(p_name, '[a-z]+$'), ' family') AS surface_form, count(*) AS n, md5(string_agg(concat('part:', p_partkey), ',' ORDER BY p_partkey)) AS provenance FROM part GROUP BY 1")
def apply_clusters(spark, d):
    m, t = star.mentions(spark, d, ("Part",)), star.triples(spark, d, ("has brand",))
    reviewed = m.select(F.concat(F.regexp_extract("surface_form", "[a-z]+$", 0), F.lit(" family")).alias("canonical"), F.col("surface_form").alias("member")).distinct().withColumn("ord", F.lit(0))
    return aggregate.apply_clusters(m, t, reviewed)[0].select("surface_form", F.size("provenance_ids").cast("long").alias("n"), F.md5(F.array_join("provenance_ids", ",")).alias("provenance"))


def _graph(spark, d, kinds=None, predicates=None):
    return star.mentions(spark, d, kinds), star.triples(spark, d, predicates)


_DEGREE_SQL = f"deg AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree FROM (SELECT s AS node, 0 AS i, 1 AS o FROM ({star.sql_triples()}) UNION ALL SELECT o, 1, 0 FROM ({star.sql_triples()}) UNION ALL SELECT surface_form, 0, 0 FROM ({star.sql_mentions()})) GROUP BY node)"


@query(f"WITH {_DEGREE_SQL} SELECT node, degree, in_degree, out_degree, 18 + least(degree, 8) * 2 AS radius FROM deg")
def degrees(spark, d):
    return view_model.degrees(*_graph(spark, d)).select("node", "degree", "in_degree", "out_degree", "radius")


@query(f"WITH {_DEGREE_SQL} SELECT node, degree FROM deg ORDER BY degree DESC, lower(node), node LIMIT 10")
def top_entities(spark, d):
    return view_model.top_entities(view_model.degrees(*_graph(spark, d)))


@query(f"SELECT p AS predicate, count(*) AS n FROM ({star.sql_triples()}) GROUP BY p ORDER BY n DESC, lower(p), p LIMIT 10")
def top_relations(spark, d):
    return view_model.top_relations(star.triples(spark, d)).withColumnRenamed("predicate_sf", "predicate")


@query(f"WITH tr AS ({star.sql_triples()}) SELECT DISTINCT surface_form FROM ({star.sql_mentions()}) WHERE surface_form NOT IN (SELECT s FROM tr UNION SELECT o FROM tr)")
def isolated_entities(spark, d):
    return view_model.isolated(*_graph(spark, d))


@query(None)
def connected_places(spark, d):
    """Components of the whole graph; the tests hold them against a union-find."""
    return view_model.components(*_graph(spark, d)).select("node", "component")


@query(None)
def graph_stats(spark, d):
    return view_model.graph_stats(*_graph(spark, d))


@query(f"SELECT concat('e', row_number() OVER (ORDER BY lower(p), lower(s), lower(o), p, s, o) - 1) AS edge_id, s AS subject, p AS predicate, o AS object FROM (SELECT DISTINCT s, p, o FROM ({star.sql_triples()}))")
def edge_ids(spark, d):
    e = view_model.edges(aggregate.merge_triples(star.triples(spark, d)))
    return e.select("edge_id", F.col("subject_sf").alias("subject"), F.col("predicate_sf").alias("predicate"), F.col("object_sf").alias("object"))


@query(f"SELECT s AS src, o AS dst, arg_max(p, (doc_id, ord)) AS relation FROM ({star.sql_triples()}) GROUP BY s, o")
def simple_digraph(spark, d):
    return view_model.simple_digraph(star.triples(spark, d).withColumn("o", F.struct("doc_id", "ord")), "o")


@query(
    f"""WITH tr AS (SELECT DISTINCT s, p, o FROM ({star.sql_triples()})), seed AS (SELECT n_name AS node FROM nation WHERE n_nationkey = 0),
    near AS (SELECT node FROM seed UNION SELECT o FROM tr JOIN seed ON s = node UNION SELECT s FROM tr JOIN seed ON o = node) SELECT DISTINCT concat(s, ' ', p, ' ', o, '.') AS sentence FROM tr WHERE s IN (SELECT node FROM near) OR o IN (SELECT node FROM near)"""
)
def khop_context(spark, d):
    seeds = star.table(spark, d, "nation").where("n_nationkey = 0").select(F.col("n_name").alias("node"))
    return retrieval.context(star.triples(spark, d), seeds, depth=2)


@query("SELECT e.vec_id, round(list_cosine_similarity(e.embedding, q.embedding), 5) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_similarity(e.embedding, q.embedding) DESC, e.vec_id LIMIT 8")
def cosine_topk(spark, d):
    v = star.table(spark, d, "embeddings")
    q = v.where("vec_id = 0").first().embedding
    return similarity.nearest(v, q, "vec_id", "embedding", 8).withColumn("similarity", F.round("similarity", 5))


_PAIRS_SQL = "pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS s FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)"


@query(f"WITH {_PAIRS_SQL} SELECT a, b, round(s, 5) AS similarity FROM pairs WHERE s >= 0.37")
def cosine_pairs(spark, d):
    return similarity.similar_pairs(star.table(spark, d, "embeddings"), "vec_id", "embedding", 0.37).withColumn("similarity", F.round("similarity", 5))


@query(f"WITH RECURSIVE {_PAIRS_SQL}, e AS (SELECT a, b FROM pairs WHERE s >= 0.4 UNION SELECT b, a FROM pairs WHERE s >= 0.4), reach(a, b) AS (SELECT a, a FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a) SELECT a AS vec_id, min(b) AS cluster FROM reach GROUP BY a")
def semantic_clusters(spark, d):
    pairs = similarity.similar_pairs(star.table(spark, d, "embeddings"), "vec_id", "embedding", 0.4)
    return connected_components(pairs, "a", "b").select(F.col("node").alias("vec_id"), F.col("component").alias("cluster"))


_BM25_SQL = r"""tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
    tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM tok) GROUP BY doc_id, t), idf0 AS (SELECT t, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY t, n),
    idf AS (SELECT t, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0), q AS (SELECT item_id, t, count(*) AS qf FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS t FROM benchmark) GROUP BY item_id, t),
    bm AS (SELECT item_id, doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avgdl))) AS s FROM q JOIN idf USING (t) JOIN tf USING (t) JOIN tok USING (doc_id), st GROUP BY item_id, doc_id)"""


def _bm25(spark, d) -> DataFrame:
    return retrieval.bm25(star.table(spark, d, "documents"), star.table(spark, d, "benchmark"), id_col="doc_id", query_id="item_id")


@query(f"WITH {_BM25_SQL} SELECT item_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 4) DESC, doc_id) AS rank FROM bm) WHERE rank <= 5")
def bm25_topk(spark, d):
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 4)), "id"))
    return _bm25(spark, d).withColumn("rank", rank).where("rank <= 5").select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank")


def _cosines(spark, d, lexical: DataFrame, k: int) -> DataFrame:
    """(query_id, id, cosine) of every item that has a vector: with its k nearest vectors, and with what it shares a word with. No other can be among its k best by both."""
    v = star.table(spark, d, "embeddings").select("vec_id", "embedding")
    items = star.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).distinct().join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")), "query_id")
    near = similarity.nearest_of(items, v, "query_id", "qv", "vec_id", "embedding", k, digits=6)
    of_words = lexical.select("query_id", "id").join(items, "query_id").join(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id")
    of_words = of_words.select("query_id", "id", F.round(cosine(F.col("qv"), F.col("v")), 6).alias("cosine"))
    return near.select(F.col("query").alias("query_id"), F.col("key").alias("id"), F.col("similarity").alias("cosine")).unionByName(of_words).dropDuplicates(["query_id", "id"])


@query(
    f"""WITH {_BM25_SQL}, c AS (SELECT i.item_id, b.vec_id AS doc_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS c FROM (SELECT DISTINCT item_id FROM benchmark) i JOIN embeddings a ON a.vec_id = i.item_id CROSS JOIN embeddings b),
    f AS (SELECT item_id, doc_id, 0.5 * coalesce(s, 0) + 0.5 * coalesce(c, 0) AS score FROM (SELECT item_id, doc_id, round(s, 4) AS s FROM bm) FULL JOIN c USING (item_id, doc_id))
    SELECT item_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 16"""
)
def rank_fusion(spark, d):
    """Candidates of either side: of the words alone, or of the vectors alone."""
    lexical = stored(_bm25(spark, d).withColumn("bm25", F.round("bm25", 4)))
    out = retrieval.fuse(lexical, _cosines(spark, d, lexical, 16), 16, 0.5)
    return out.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank")


@query(None)
def chunk_pack(spark, d):
    return chunk.chunk(star.table(spark, d, "documents"), 500).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


_STATUS_SQL = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END"


@query(f"SELECT CAST(user_id AS VARCHAR) AS job_id, arg_max({_STATUS_SQL}, (ts, CASE {_STATUS_SQL} WHEN 'pending' THEN 0 WHEN 'running' THEN 1 WHEN 'failed' THEN 2 ELSE 3 END)) AS status, CAST(max(event_id % 7) AS INTEGER) AS attempts FROM events GROUP BY user_id")
def job_status(spark, d):
    e = star.table(spark, d, "events").selectExpr("cast(user_id as string) as job_id", f"{_STATUS_SQL} as status", "cast(event_id % 7 as int) as attempts", "ts as at", "cast(null as string) as error")
    return jobs.states(e).select("job_id", "status", "attempts")


@query("SELECT user_id, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS done, count(*) AS total, round(100.0 * count(*) FILTER (event_type = 'purchase') / count(*), 1) AS percent FROM events GROUP BY user_id")
def job_progress(spark, d):
    e = star.table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("done"), F.count("*").alias("total"))
    return e.withColumn("percent", stats.percent(F.col("done"), F.col("total")))


@query("SELECT role AS step, CAST(sum(length(text)) AS BIGINT) AS prompt_tokens, CAST(sum(turn) AS BIGINT) AS completion_tokens, CAST(sum(length(text) + turn) AS BIGINT) AS total_tokens FROM conversations GROUP BY ROLLUP (role)")
def token_usage(spark, d):
    calls = star.table(spark, d, "conversations").select(F.col("role").alias("step"), F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"))
    return stats.usage(calls).select("step", "prompt_tokens", "completion_tokens", "total_tokens")


@query("SELECT concat('blob:', substr(sha256(text), 1, 16)) AS key, count(*) AS n FROM documents GROUP BY 1")
def blob_handle(spark, d):
    return star.table(spark, d, "documents").groupBy(T.blob_id("text").alias("key")).agg(F.count("*").alias("n"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 'toxic' AS error FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def failed_documents(spark, d):
    x = star.table(spark, d, "documents").select("doc_id").join(star.table(spark, d, "labels"), "doc_id", "left")
    return stats.failures(x.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("toxic") == 1, "toxic").alias("error")))


@query(None)
def generate_graph(spark, d):
    """The whole pipeline over documents with the offline extractor: merged entities and how often each is an end."""
    from loomgraph.plans import pipeline

    corpus = star.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    g = pipeline.generate(corpus)
    return view_model.degrees(g.entities, g.triples).select("node", "degree")
