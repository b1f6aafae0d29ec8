"""More registered queries: operators of views, sources, ontologies, clusters and jobs, each over whole tables and with its SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.functions import xsd
from loomgraph.operators import aggregate, dedup, judged, narrowing, provenance, retrieval, serialize, similarity, stats, view_model, views
from loomgraph.operators.components import Forest
from loomgraph.plans import star
from loomgraph.plans.queries import _CAMEL_SQL, _PAIRS_SQL, _FORMS_SQL, _KNOWN_SQL, _NARROW_SQL, _STATUS_SQL, _WHOLE_GRAPH, _conformance_rows, _forms, _joined, query
from loomgraph.sources import corpus, ntriples
from loomgraph.sources import ontology as O
from loomgraph.session import scratch
from loomgraph.sources.validate import validate_graph
from loomgraph.streaming import jobs, keyed

_NS = star.NS


@query(f"SELECT DISTINCT p AS predicate FROM ({star.sql_triples()})")
def distinct_predicates(spark, d):
    return views.predicates(star.triples(spark, d)).withColumnRenamed("predicate_sf", "predicate")


@query("SELECT doc_id, CAST(turn AS BIGINT) AS ord, text AS surface_form FROM (SELECT conv_id AS doc_id, turn, text FROM conversations) WHERE NOT contains(text, '\"')")
def quote_filter(spark, d):
    rows = star.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("ord"), F.col("text").alias("surface_form"))
    return views.without_quotes(rows)


_URIS_SQL = f"SELECT concat('{xsd.NAMESPACE}', event_type) AS v FROM events UNION SELECT concat('xsd:', event_type) FROM events UNION SELECT url FROM pages UNION SELECT NULL"


@query(f"SELECT v, coalesce(starts_with(v, 'xsd:') OR starts_with(v, '{xsd.NAMESPACE}'), false) AS is_xsd, CASE WHEN starts_with(v, '{xsd.NAMESPACE}') THEN concat('xsd:', substr(v, {len(xsd.NAMESPACE) + 1})) ELSE v END AS short FROM ({_URIS_SQL})")
def xsd_shorthand(spark, d):
    e = star.table(spark, d, "events")
    v = e.select(F.concat(F.lit(xsd.NAMESPACE), "event_type").alias("v")).union(e.select(F.concat(F.lit("xsd:"), "event_type"))).union(star.table(spark, d, "pages").select("url")).union(spark.createDataFrame([(None,)], "v string")).distinct()
    return v.select("v", xsd.is_xsd("v").alias("is_xsd"), xsd.shorthand("v").alias("short"))


@query("SELECT p_brand AS label, concat('- ', p_brand, ': subject is [', array_to_string(list_sort(list(DISTINCT p_type)), ', '), '], object is [Any]', CASE WHEN max(p_size) > 49 THEN concat(' (', max(p_name), ')') ELSE '' END) AS line FROM part GROUP BY p_brand")
def prompt_lines(spark, d):
    p = star.table(spark, d, "part").groupBy(F.col("p_brand").alias("label")).agg(F.collect_set("p_type").alias("domain"), F.when(F.max("p_size") > 49, F.max("p_name")).alias("description"))
    return views.candidate_prompt(p.withColumn("range", F.array().cast("array<string>")))


@query("SELECT doc_id, n_chars FROM documents WHERE strlen(text) > 0 AND strlen(text) <= 2000")
def payload_guard(spark, d):
    return corpus.within(star.table(spark, d, "documents"), 2000).select("doc_id", "n_chars")


@query("SELECT user_id AS entity, string_agg(DISTINCT v, ',' ORDER BY v) AS vals FROM (SELECT user_id, event_type AS v FROM events UNION ALL SELECT user_id, concat('k', event_id % 5) FROM events) GROUP BY user_id")
def metadata_merge(spark, d):
    e = star.table(spark, d, "events").select(F.col("user_id").alias("entity"), F.array("event_type", F.concat(F.lit("k"), (F.col("event_id") % 5).cast("string"))).alias("values"))
    return aggregate.merge_metadata(e).select("entity", F.array_join("values", ",").alias("vals"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS seen FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id")
def provenance_order(spark, d):
    e = star.table(spark, d, "events").withColumn("ids", F.array("event_type"))
    return e.groupBy("user_id").agg(F.array_join(aggregate.ordered_provenance("ids", F.col("event_id")), ",").alias("seen"))


@query(
    f"""SELECT form, string_agg(s, ',' ORDER BY s) AS uris FROM (SELECT DISTINCT {_CAMEL_SQL.format("v")} AS form, s FROM (SELECT concat('u:', p_partkey) AS s, p_brand AS v FROM part UNION ALL SELECT concat('v:', p_partkey), upper(p_type) FROM part UNION ALL SELECT concat('w:', n_nationkey), n_name FROM nation))
    GROUP BY form HAVING count(*) > 1"""
)
def label_collisions(spark, d):
    p, n = star.table(spark, d, "part"), star.table(spark, d, "nation")
    rows = p.selectExpr("concat('u:', p_partkey) as s", "p_brand as o").union(p.selectExpr("concat('v:', p_partkey)", "upper(p_type)")).union(n.selectExpr("concat('w:', n_nationkey)", "n_name"))
    named = rows.selectExpr("s", "'http://www.w3.org/2000/01/rdf-schema#label' as p", "o", "'literal' as o_kind", "cast(null as string) as lang")
    return O.collisions(named).select("form", F.array_join("uris", ",").alias("uris"))


@query(f"SELECT surface_form, row_number() OVER (ORDER BY lower(surface_form), surface_form) - 1 AS place FROM (SELECT DISTINCT surface_form FROM ({star.sql_mentions()}))")
def entity_order(spark, d):
    return view_model.by_name(star.mentions(spark, d))


def _states(spark, d):
    return star.table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("job_id")).agg(F.max_by(F.expr(_STATUS_SQL), "event_id").alias("status"), F.max("ts").alias("updated_at"))


_STATE_SQL = f"st AS (SELECT CAST(user_id AS VARCHAR) AS job_id, arg_max({_STATUS_SQL}, event_id) AS status, max(ts) AS updated_at FROM events GROUP BY user_id)"


@query(f"WITH {_STATE_SQL} SELECT job_id, status FROM st ORDER BY updated_at DESC, job_id LIMIT 128")
def job_listing(spark, d):
    return jobs.listing(_states(spark, d)).select("job_id", "status")


@query(f"WITH {_STATE_SQL} SELECT job_id, status FROM st WHERE job_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)")
def jobs_known(spark, d):
    return jobs.known(star.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("job_id")), _states(spark, d)).select("job_id", "status")


@query(
    f"""WITH {_STATE_SQL}, old AS (SELECT job_id, row_number() OVER (ORDER BY updated_at, job_id) AS n FROM st WHERE status IN ('completed', 'failed'))
    SELECT job_id, status FROM st WHERE job_id NOT IN (SELECT job_id FROM old WHERE n <= greatest(0, (SELECT count(*) FROM st) - 128))"""
)
def jobs_bounded(spark, d):
    return jobs.bounded(_states(spark, d)).select("job_id", "status")


@query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, role AS surface_form, CAST(min(turn) AS BIGINT) AS ord, arg_min(text, turn) AS description FROM conversations GROUP BY conv_id, role")
def document_mentions(spark, d):
    m = star.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("long").alias("ord"), F.col("role").alias("surface_form"), F.lit(None).cast("string").alias("type_label"), F.col("text").alias("description"))
    return views.document_mentions(m).select("doc_id", "surface_form", "ord", "description")


@query(
    f"""SELECT surface_form, string_agg(DISTINCT prov, ',' ORDER BY prov) AS provenance FROM (SELECT regexp_replace(lower(surface_form), 's$', '') AS k, prov FROM ({star.sql_mentions(("Region", "Nation", "Part"))}) UNION ALL SELECT regexp_replace(lower(surface_form), 's$', ''), prov FROM ({star.sql_mentions(("Brand", "Part"))}))
    JOIN (SELECT regexp_replace(lower(surface_form), 's$', '') AS k, min(surface_form) AS surface_form FROM ({star.sql_mentions(("Region", "Nation", "Part", "Brand"))}) GROUP BY 1) USING (k) GROUP BY surface_form"""
)
def graph_union(spark, d):
    from loomgraph.plans import pipeline

    graph = lambda kinds, preds: pipeline.Graph(star.mentions(spark, d, kinds), star.triples(spark, d, preds))
    g = pipeline.aggregate_and_deduplicate([graph(("Region", "Nation", "Part"), ("in",)), graph(("Brand", "Part"), ("has brand",))])
    return g.entities.select("surface_form", _joined().alias("provenance"))


_LAST_SQL = "list_extract(regexp_split_to_array({0}, '[#/]'), -1)"


@query("SELECT event_type AS comment, p_name AS label, concat_ws(' ', event_type, CASE WHEN upper(p_type) <> upper(p_name) THEN concat('Also known as: ', p_type, '.') END) AS description FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN (SELECT DISTINCT p_name, p_type FROM part)")
def described(spark, d):
    p = star.table(spark, d, "part").select("p_name", "p_type").distinct()
    e = star.table(spark, d, "events").select("event_type").distinct()
    return p.join(F.broadcast(e)).select(F.col("event_type").alias("comment"), F.col("p_name").alias("label"), T.describe("event_type", "p_name", F.array(F.upper("p_name"), "p_type", "p_type")).alias("description"))


_TYPED_SQL = f"typed AS (SELECT DISTINCT event_type AS label, CAST(NULL AS VARCHAR) AS uri FROM events UNION SELECT * FROM (VALUES ('COUNTRY', NULL), ('vendor', NULL), ('Customer', NULL), ('whatever', '{_NS}Part'), ('place', '{_NS}Unknown')) v(label, uri))"


@query(f"WITH {_TYPED_SQL}, {_KNOWN_SQL} SELECT label, coalesce(CASE WHEN uri = '{_NS}Part' THEN uri END, '{_NS}' || class) AS class_uri FROM typed LEFT JOIN known ON {_CAMEL_SQL.format('label')} = form")
def class_resolution(spark, d):
    """Types by URI, else by a label or another name of a class."""
    more = [("COUNTRY", None), ("vendor", None), ("Customer", None), ("whatever", _NS + "Part"), ("place", _NS + "Unknown")]
    rows = star.table(spark, d, "events").select(F.col("event_type").alias("label")).distinct().withColumn("uri", F.lit(None).cast("string")).union(spark.createDataFrame(more, "label string, uri string"))
    return O.resolve_class(star.onto(spark), rows, "uri", "label").select("label", "class_uri")


@query(_WHOLE_GRAPH)
def conformance_by_label(spark, d):
    """The checks of the whole graph with types that have no URI and other names: the same result."""
    other = {"Supplier": "vendor", "Nation": "COUNTRY", "Order": "order", "Customer": "CUSTOMER", "Part": " part "}
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in other.items() for x in kv])[F.col("type_label")], F.col("type_label"))
    return _conformance_rows(spark, d, lambda m: m.withColumn("type_label", label).withColumn("type_uri", F.lit(None).cast("string"))).select("doc_id", "ord", "check", "ok")


@query(f"WITH {_FORMS_SQL} SELECT canonical, sf AS member FROM canon WHERE canonical IN (SELECT canonical FROM canon GROUP BY canonical HAVING count(*) > 1)")
def suggest_clusters(spark, d):
    return dedup.suggest_clusters(_forms(spark, d)).select("canonical", F.explode("members").alias("member"))


@query("SELECT concat('e', n) AS entity_id, k AS members FROM (SELECT n_name AS sf, row_number() OVER (ORDER BY n_name) - 1 AS n FROM nation) JOIN (SELECT n_name AS canonical, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name) ON sf = canonical")
def cluster_ids(spark, d):
    n = star.table(spark, d, "nation")
    e = aggregate.numbered(n.select(F.col("n_name").alias("surface_form")), ["surface_form"], "entity_id")
    c = star.table(spark, d, "customer").join(n, F.expr("c_nationkey = n_nationkey")).groupBy(F.col("n_name").alias("canonical")).agg(F.collect_list("c_name").alias("members"))
    return serialize.cluster_output(c, e).select("entity_id", F.size("members").cast("long").alias("members"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text, CAST(2 AS BIGINT) AS n_terms, source AS first_term, lang AS second_type FROM documents WHERE text IS NOT NULL")
def corpus_lines(spark, d):
    """Documents written as JSON lines and read again, with a plain term and a typed one."""
    term = F.to_json(F.struct(F.col("source").alias("surface_form"), F.struct(F.col("lang").alias("label")).alias("type")))
    lines = star.table(spark, d, "documents").where("text is not null").select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "text", F.array("source", term).alias("terms"))).alias("value"))
    t = corpus.parse_lines(lines)
    return t.select("id", "text", F.size("terms").cast("long").alias("n_terms"), F.col("terms")[0].surface_form.alias("first_term"), F.col("terms")[1].type.label.alias("second_type"))


@query(
    "SELECT c_name AS doc_id, 'located in' AS predicate, n_name AS object FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 2 AND c_acctbal > 0"
)
def relation_replies(spark, d):
    """Replies as a list, as an object or broken; a relation whose object is no entity of the document goes."""
    c = star.table(spark, d, "customer").join(star.table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    item = F.array(F.struct(F.col("c_name").alias("subject"), F.lit("located in").alias("predicate"), F.col("n_name").alias("object")), F.struct(F.col("c_name").alias("subject"), F.lit("near").alias("predicate"), F.lit("nowhere").alias("object")))
    reply = F.when(F.expr("c_custkey % 3 = 0"), F.to_json(item)).when(F.expr("c_custkey % 3 = 1"), F.to_json(F.struct(item.alias("relations")))).otherwise("[{broken")
    ends = c.selectExpr("c_name as doc_id", "c_name as surface_form").union(c.where("c_acctbal > 0").selectExpr("c_name", "n_name"))
    return corpus.parse_relations(c.select(F.col("c_name").alias("doc_id"), reply.alias("reply")), ends).select("doc_id", "predicate", "object")


@query('SELECT DISTINCT p_brand AS "group", p_type AS type FROM part')
def type_groups(spark, d):
    p = star.table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("t"))
    return corpus.type_groups(p.select(F.to_json(F.map_from_arrays(F.array("p_brand"), F.array("t"))).alias("groups")))


@query("SELECT conv_id, turn, role FROM conversations")
def inline_list(spark, d):
    rows = star.table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("conv_id", "turn", "role")).alias("r"))
    return corpus.parse_list(rows.select(F.to_json("r").alias("value")), "conv_id: bigint, turn: bigint, role: string")


@query("SELECT r_name AS subject, 'has' AS predicate, n_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey")
def graph_normalize(spark, d):
    """Graphs under other names of their parts, by region."""
    n = star.table(spark, d, "nation").join(star.table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    edge = F.when(F.col("r_regionkey") % 2 == 0, F.to_json(F.struct(F.col("r_name").alias("source"), F.lit("has").alias("relation"), F.col("n_name").alias("target")))).otherwise(F.to_json(F.array("r_name", F.lit("has"), "n_name")))
    g = n.groupBy("r_name").agg(F.concat(F.lit('{"nodes": [], "edges": ['), F.array_join(F.collect_list(edge), ","), F.lit("]}")).alias("value"))
    return corpus.normalize_graph(g)[1].select("subject", "predicate", "object")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS surface_form, lang AS type_label, 'typed' AS part FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), lang, NULL, 'open' FROM documents")
def term_partition(spark, d):
    kind = lambda label: F.struct(label.alias("label"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("string").alias("description"))
    none = F.lit(None).cast("string")
    term = lambda sf, label: F.struct(sf.alias("surface_form"), none.alias("uri"), none.alias("description"), kind(label).alias("type"), F.lit(None).cast("array<string>").alias("provenance_ids"))
    t = star.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.array(term(F.col("source"), F.col("lang")), term(F.col("lang"), none)).alias("terms"))
    typed, rest = views.split_terms(t)
    return typed.withColumn("part", F.lit("typed")).unionByName(rest.withColumn("part", F.lit("open"))).select("doc_id", "surface_form", "type_label", "part")


@query(
    "WITH c AS (SELECT n_regionkey, count(*) AS size, min(lower(n_name)) AS low FROM nation GROUP BY 1) SELECT row_number() OVER (ORDER BY size DESC, low) - 1 AS rank, CAST(n_regionkey AS BIGINT) AS component, size FROM c"
)
def component_order(spark, d):
    return view_model.component_order(star.table(spark, d, "nation").selectExpr("cast(n_regionkey as bigint) as component", "n_name as node"))


@query(_NARROW_SQL + " SELECT DISTINCT p AS label FROM fit WHERE g = 'x'")
def suggest_predicates(spark, d):
    """Predicates for the types found, given by label."""
    types = star.table(spark, d, "region").select(F.lit("REGION").alias("type_label")).union(star.table(spark, d, "supplier").select(F.lit("Vendor"))).distinct().withColumn("type_uri", F.lit(None).cast("string"))
    return narrowing.suggest_predicates(star.onto(spark), types).select("label")


@query(f"WITH {_KNOWN_SQL}, used AS (SELECT type_label AS class, count(*) AS n FROM ({star.sql_mentions()}) GROUP BY type_label) SELECT class AS label, concat('{_NS}', class) AS uri, coalesce(any_value(n), 0) AS n FROM known LEFT JOIN used USING (class) GROUP BY class")
def target_types(spark, d):
    """The types that may be given, and how many mentions of the graph have each."""
    used = stats.class_usage(star.mentions(spark, d)).withColumnRenamed("class", "uri")
    return narrowing.target_types(star.onto(spark)).select("label", "uri").join(used, "uri", "left").select("label", "uri", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"""SELECT concat('Graph with:', chr(10), chr(9), count(DISTINCT surface_form), ' entities', chr(10), chr(9), (SELECT count(DISTINCT p) FROM ({star.sql_triples()})), ' edges', chr(10), chr(9),
    (SELECT count(*) FROM (SELECT DISTINCT s, p, o FROM ({star.sql_triples()}))), ' relations') AS text FROM ({star.sql_mentions()})"""
)
def graph_summary(spark, d):
    return view_model.summary(star.mentions(spark, d), star.triples(spark, d))


@query("SELECT concat('h', user_id) AS name, v AS value FROM (SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS v FROM events GROUP BY user_id) WHERE length(v) <= 1024")
def stat_headers(spark, d):
    e = star.table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x.event_type), ",").alias("value"))
    return stats.headers(e.select(F.concat(F.lit("h"), "user_id").alias("name"), "value"))


@query("SELECT user_id, CAST(round(greatest(n - k, 0) / (k / 60.0), 6) AS DOUBLE) AS eta FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS k FROM events GROUP BY user_id) WHERE k > 0")
def job_eta(spark, d):
    e = star.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total_docs"), F.count_if(F.col("event_type") == "purchase").alias("processed_docs")).withColumn("elapsed", F.lit(60.0))
    return jobs.progress(e).where("eta is not null").select("user_id", F.round("eta", 6).alias("eta"))


#: A graph written as one JSON text and taken apart again.
@query("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def graph_roundtrip(spark, d):
    n = star.table(spark, d, "nation").join(star.table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    e = n.select(F.concat(F.lit("e"), "n_nationkey").alias("entity_id"), F.col("n_name").alias("surface_form"))
    g = corpus.graph_json(e, n.select(F.col("n_name").alias("subject"), F.lit("in").alias("predicate"), F.col("r_name").alias("object")), kind="map")
    return corpus.normalize_graph(g)[1].select(F.col("subject").alias("name"), F.col("object").alias("region"))


_CHECKED = "concat('{\"entities\": {\"e0\": {', CASE WHEN p_size % 2 = 0 THEN concat('\"surface_form\": \"', p_brand, '\"') ELSE '' END, '}}, \"relations\": [{\"subject_id\": \"e0\", \"predicate\": {}, \"is_literal\": ', CASE WHEN p_size % 3 = 0 THEN 'true' ELSE '0' END, '}]', CASE WHEN p_size % 5 = 0 THEN '' ELSE ', \"stats\": {}' END, '}')"


@query(
    """SELECT p_partkey, p_size % 2 = 0 AND p_size % 3 = 0 AND p_size % 5 <> 0 AS valid, array_to_string(list_filter([CASE WHEN p_size % 5 = 0 THEN 'stats: is missing' END,
    CASE WHEN p_size % 2 <> 0 THEN 'entities.e0.surface_form: is missing' END, CASE WHEN p_size % 3 <> 0 THEN 'relations.0.is_literal: isn''t a truth value' END], lambda x: x IS NOT NULL), '; ') AS errors FROM part"""
)
def graph_validation(spark, d):
    rows = star.table(spark, d, "part").select("p_partkey", F.expr(_CHECKED).alias("value"))
    return validate_graph(rows).select("p_partkey", "valid", F.array_join("errors", "; ").alias("errors"))


@query("SELECT concat('e', n_nationkey) AS entity_id, n_name AS surface_form, concat('n:', n_nationkey) AS uri, r_name AS type_label, concat('r:', r_regionkey) AS type_uri, concat(n_nationkey, ',', r_regionkey) AS provenance FROM nation JOIN region ON n_regionkey = r_regionkey")
def graph_entities(spark, d):
    """Entities written into a graph's JSON and loaded with all that it tells of them."""
    n = star.table(spark, d, "nation").join(star.table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    kind = F.struct(F.col("r_name").alias("label"), F.concat(F.lit("r:"), "r_regionkey").alias("uri")).alias("type")
    sources = F.array(F.col("n_nationkey").cast("string"), F.col("r_regionkey").cast("string")).alias("provenance_ids")
    e = n.select(F.concat(F.lit("e"), "n_nationkey").alias("entity_id"), F.col("n_name").alias("surface_form"), F.concat(F.lit("n:"), "n_nationkey").alias("uri"), kind, sources)
    loaded = corpus.graph_entities(corpus.graph_json(e, n.selectExpr("n_name as subject", "'in' as predicate", "r_name as object")))
    return loaded.select("entity_id", "surface_form", "uri", "type_label", "type_uri", F.array_join("provenance_ids", ",").alias("provenance"))


_BEATS_SQL = "SELECT CAST(user_id AS VARCHAR) AS job_id, event_id % 11 AS processed_docs, event_id AS beat_at FROM events WHERE event_type <> 'signup'"


def _beats(spark, d):
    e = star.table(spark, d, "events")
    state = e.groupBy(F.col("user_id").cast("string").alias("job_id")).agg(F.when(F.max("event_id") % 2 == 0, "running").otherwise("completed").alias("status"), (F.min("event_id") + 100).cast("double").alias("updated_at"))
    beats = e.where("event_type <> 'signup'").selectExpr("cast(user_id as string) as job_id", "event_id % 11 as processed_docs", "11L as total_docs", "cast(event_id as double) as beat_at")
    return state, beats


@query(
    f"""SELECT s.job_id, b.processed_docs, CAST(greatest(s.updated_at, coalesce(b.beat_at, s.updated_at)) AS BIGINT) AS seen_at FROM (SELECT CAST(user_id AS VARCHAR) AS job_id, min(event_id) + 100 AS updated_at FROM events GROUP BY 1) s
    LEFT JOIN (SELECT job_id, arg_max(processed_docs, beat_at) AS processed_docs, max(beat_at) AS beat_at FROM ({_BEATS_SQL}) GROUP BY 1) b USING (job_id)"""
)
def job_beats(spark, d):
    return jobs.with_beats(*_beats(spark, d)).select("job_id", F.col("processed_docs").cast("long").alias("processed_docs"), F.col("seen_at").cast("long").alias("seen_at"))


@query(
    f"""SELECT s.job_id FROM (SELECT CAST(user_id AS VARCHAR) AS job_id, min(event_id) + 100 AS updated_at, max(event_id) AS m FROM events GROUP BY 1) s LEFT JOIN (SELECT job_id, max(beat_at) AS beat_at FROM ({_BEATS_SQL}) GROUP BY 1) b USING (job_id)
    WHERE m % 2 = 0 AND greatest(updated_at, coalesce(beat_at, updated_at)) < 400"""
)
def jobs_abandoned(spark, d):
    return jobs.abandoned(*_beats(spark, d), idle=600.0, now=1000.0).select("job_id")


@query("SELECT doc_id, (doc_id + 1 = n OR floor((doc_id + 1) * 100 / (n * 5.0)) > floor(doc_id * 100 / (n * 5.0))) AS due FROM documents, (SELECT count(*) AS n FROM documents)")
def progress_reports(spark, d):
    docs = star.table(spark, d, "documents").select("doc_id")
    return docs.select("doc_id", stats.reports(F.col("doc_id") + 1, F.lit(docs.count())).alias("due"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, s_name AS subject, 'located in' AS predicate, n_name AS object FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def relate_again(spark, d):
    """A relater that answers rightly only when told what was wrong: every supplier, at the second attempt."""
    from loomgraph.plans import pipeline

    n = star.table(spark, d, "supplier").join(star.table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey"))
    doc = n.select(F.col("s_suppkey").cast("string").alias("id"), F.concat_ws("|", "s_name", "n_name").alias("text"))
    parts = F.split("text", r"\|")
    m = doc.select(F.col("id").alias("doc_id"), F.posexplode(F.array(F.struct(parts[0].alias("surface_form"), F.lit("Vendor").alias("type_label")), F.struct(parts[1].alias("surface_form"), F.lit("Country").alias("type_label")))).alias("ord", "e"))
    m = m.select("doc_id", F.col("ord").cast("long").alias("ord"), "e.*", F.lit(None).cast("string").alias("type_uri"))

    def relater(text, entities, predicates, feedback):
        a, b = text.split("|")
        return [(a, "located in", b)] if feedback else [(b, "located in", a)]

    out = pipeline.relate(doc, m, relater, star.onto(spark))
    return out.where("score = 1").select("doc_id", F.explode("relations").alias("r")).select("doc_id", "r.*")


@query("SELECT count(*) AS items, true AS whole, true AS bounded FROM embeddings WHERE embedding IS NOT NULL")
def judged_blocks(spark, d):
    """Blocks of items for a judge: each item in one, none above its size."""
    b = judged.blocks(star.table(spark, d, "embeddings"), "vec_id", "embedding")
    each = b.groupBy("block").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("k"))
    return each.agg(F.sum("n").alias("items"), (F.sum("n") == F.sum("k")).alias("whole"), (F.max("n") <= judged.BLOCK).alias("bounded"))


@query("SELECT n_name AS canonical, concat(n_name, v) AS member FROM nation, (VALUES (''), (' (N)')) t(v)")
def judged_merges(spark, d):
    """Nations under two names each, judged in blocks by region: the shorter name stands for both."""
    n = star.table(spark, d, "nation")
    names = n.select("n_regionkey", "n_name", F.explode(F.array(F.lit(""), F.lit(" (N)"))).alias("v")).select(F.concat("n_name", "v").alias("item"), F.col("n_regionkey").alias("block"), "n_name")
    near = names.select("item", F.array("n_name", F.concat("n_name", F.lit(" (N)"))).alias("candidates"))
    merged = judged.merges(names.select("item", "block"), near, lambda item, c: (min(c, key=len), [x for x in c if x != item]))
    return merged.select("canonical", "member")


_MENTION_KEYS, _TRIPLE_KEYS = ["surface_form", "type_label"], ["subject_sf", "predicate_sf", "object_sf"]
_FIRST = "arg_min(doc_id, (doc_id, ord)) AS doc_id, arg_min(ord, (doc_id, ord)) AS ord"


@query(f"SELECT surface_form, type_label, prov AS source, {_FIRST} FROM ({star.sql_mentions()}) GROUP BY surface_form, type_label, prov")
def mention_sources(spark, d):
    """Provenance of the graph's entities as a table."""
    return provenance.sources(provenance.facts(star.mentions(spark, d), _MENTION_KEYS), _MENTION_KEYS)


@query(f"SELECT s AS subject, p AS predicate, o AS object, prov AS source, {_FIRST} FROM ({star.sql_triples()}) GROUP BY s, p, o, prov")
def relation_sources(spark, d):
    t = provenance.sources(provenance.facts(star.triples(spark, d), _TRIPLE_KEYS), _TRIPLE_KEYS)
    return t.select(F.col("subject_sf").alias("subject"), F.col("predicate_sf").alias("predicate"), F.col("object_sf").alias("object"), "source", "doc_id", "ord")


@query(f"SELECT surface_form, type_label, min(type_uri) AS type_uri, count(DISTINCT prov) AS n_sources FROM ({star.sql_mentions()}) GROUP BY surface_form, type_label")
def provenance_upsert(spark, d):
    """A ledger to which the graph's mentions come in three parts, the last of which holds all again: the same as of all at once."""
    m = star.mentions(spark, d)
    ledger = provenance.Ledger(spark, scratch(spark), _MENTION_KEYS, buckets=8)
    for part in (m.where("ord % 3 = 2"), m.where("ord % 3 = 0"), m):
        ledger.add(provenance.facts(part, _MENTION_KEYS, ("type_uri",)))
    return provenance.merged(ledger.read(), _MENTION_KEYS, ("type_uri",))


_REACH_SQL = "e AS (SELECT a, b FROM pairs WHERE s >= 0.4 UNION SELECT b, a FROM pairs WHERE s >= 0.4), reach(a, b) AS (SELECT a, a FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), least AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)"


def _forest(spark, d, parts: int):
    """Components of similar vectors, whose pairs come in several additions."""
    pairs = similarity.similar_pairs(star.table(spark, d, "embeddings"), "vec_id", "embedding", 0.4)
    forest = Forest(spark, scratch(spark), buckets=8)
    for i in range(parts):
        forest.add(pairs.where((F.col("a") + F.col("b")) % parts == i), "a", "b")
    return forest.components()


@query(f"WITH RECURSIVE {_PAIRS_SQL}, {_REACH_SQL} SELECT node, component FROM least")
def growing_components(spark, d):
    return _forest(spark, d, 3)


@query(f"WITH RECURSIVE {_PAIRS_SQL}, {_REACH_SQL}, c AS (SELECT component, count(*) AS size, min(lower(CAST(node AS VARCHAR))) AS low FROM least GROUP BY component) SELECT row_number() OVER (ORDER BY size DESC, low) - 1 AS rank, component, size FROM c")
def growing_component_order(spark, d):
    """The same components by size, then by the least of their members' names."""
    return view_model.component_order(_forest(spark, d, 2).select("component", F.col("node").cast("string").alias("node")))


_WORDS_SQL = "SELECT DISTINCT unnest(string_split(lower(concat_ws(' ', p_name, p_type)), ' ')) AS w FROM part UNION SELECT lower(n_name) FROM nation UNION SELECT lower(split_part(c_name, '#', 1)) FROM customer"
_PLURAL_SQL = r"CASE WHEN {0} LIKE '%s' OR {0} LIKE '%x' OR {0} LIKE '%ch' OR {0} LIKE '%sh' THEN concat({0}, 'es') WHEN {1}({0}, '[^aeiou]y$') THEN concat(left({0}, length({0}) - 1), 'ies') ELSE concat({0}, 's') END"


@query(f"SELECT {_PLURAL_SQL.format('w', 'regexp_matches')} AS form, w AS key FROM ({_WORDS_SQL}) WHERE length(w) > 2 AND w <> 'new' AND NOT regexp_matches(w, '[0-9 ]|(ss|us|is|s)$')")
def singular_forms(spark, d):
    """Plurals made of the words of names by the school's rule; their singulars are the words again."""
    w = star.table(spark, d, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("w"))
    w = w.union(star.table(spark, d, "nation").select(F.lower("n_name"))).union(star.table(spark, d, "customer").select(F.lower(F.substring_index("c_name", "#", 1)))).distinct()
    w = w.where(r"length(w) > 2 and w <> 'new' and not w rlike '[0-9 ]|(ss|us|is|s)$'")  # news is no plural
    return w.select(F.expr(_PLURAL_SQL.format("w", "regexp_like")).alias("form")).select("form", T.dedup_form("form").alias("key"))


@query(
    """SELECT c_name AS doc_id, k AS ord, 'located in' AS predicate, n_name AS object FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES (1), (3)) t(k)
    WHERE (k = 1 AND c_custkey % 2 = 0) OR (k = 3 AND c_acctbal > 0)"""
)
def mixed_replies(spark, d):
    """Replies in whose lists good items stand beside text, numbers, lists, null, and relations with an empty or a nested part."""
    c = star.table(spark, d, "customer").join(star.table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    rel = lambda s, p, o: F.to_json(F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object")))
    good = rel(F.col("c_name"), F.lit("located in"), F.col("n_name"))
    first = F.when(F.col("c_custkey") % 2 == 0, good).otherwise(rel(F.col("c_name"), F.lit(""), F.col("n_name")))
    third = F.when(F.col("c_acctbal") > 0, good).otherwise(F.to_json(F.struct(F.struct("c_name").alias("subject"), F.lit("located in").alias("predicate"), F.col("n_name").alias("object"))))
    items = F.concat(F.lit("["), F.array_join(F.array(F.lit('"junk"'), first, F.lit("[5, {}]"), third, F.lit("null"), F.col("c_custkey").cast("string")), ", "), F.lit("]"))
    reply = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('{"note": 1, "relations": '), items, F.lit("}"))).otherwise(items)
    ends = c.selectExpr("c_name as doc_id", "c_name as surface_form").union(c.selectExpr("c_name", "n_name"))
    return corpus.parse_relations(c.select(F.col("c_name").alias("doc_id"), reply.alias("reply")), ends).select("doc_id", "ord", "predicate", "object")


#: Kinds of events by turns, for jobs named after users.
_KIND_SQL = "CASE event_id % 6 WHEN 0 THEN 'submitted' WHEN 1 THEN 'claimed' WHEN 2 THEN 'failed' WHEN 3 THEN 'claimed' WHEN 4 THEN 'beat' ELSE 'done' END"


@query(
    f"""WITH RECURSIVE ev AS (SELECT CAST(user_id AS VARCHAR) AS job_id, {_KIND_SQL} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    f(job_id, rn, status, attempts, changed) AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT), 'none', 0, false FROM ev UNION ALL
        SELECT f.job_id, ev.rn, CASE WHEN status = 'none' AND kind = 'submitted' THEN 'pending' WHEN status = 'pending' AND kind = 'claimed' THEN 'running' WHEN status = 'running' AND kind = 'done' THEN 'completed'
            WHEN status = 'running' AND kind = 'failed' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE status END,
        CASE WHEN status = 'pending' AND kind = 'claimed' THEN attempts + 1 ELSE attempts END,
        (status = 'none' AND kind = 'submitted') OR (status = 'pending' AND kind = 'claimed') OR (status = 'running' AND kind IN ('done', 'failed')) FROM f JOIN ev ON ev.job_id = f.job_id AND ev.rn = f.rn + 1)
    SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY rn) AS INTEGER) AS n, status, attempts FROM f WHERE changed"""
)
def job_lifecycle(spark, d):
    """The changes that events make of jobs' states, none of them by time."""
    e = star.table(spark, d, "events").selectExpr("cast(user_id as string) as job_id", f"{_KIND_SQL} as kind", "cast(event_id as double) as at")
    return keyed.replay(e, idle=1e18, ttl=1e18)


@query(
    """SELECT query, vec_id, round(s, 6) AS similarity, rank FROM (SELECT q.vec_id AS query, e.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) DESC, e.vec_id) AS rank FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0) WHERE rank <= 8"""
)
def nearest_vectors(spark, d):
    """The eight nearest of every twentieth vector, itself included."""
    v = star.table(spark, d, "embeddings")
    n = similarity.nearest_of(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", "vec_id", "embedding", 8, digits=9)
    return n.select("query", F.col("key").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "rank")


@query(
    f"""WITH tr AS (SELECT DISTINCT s, p, o FROM ({star.sql_triples()})), seed AS (SELECT n_name AS query, n_name AS node FROM nation),
    near AS (SELECT query, node FROM seed UNION SELECT query, o FROM tr JOIN seed ON s = node UNION SELECT query, s FROM tr JOIN seed ON o = node)
    SELECT DISTINCT query, concat(s, ' ', p, ' ', o, '.') AS sentence FROM tr JOIN near ON s = node OR o = node"""
)
def khop_contexts(spark, d):
    """What is within two steps of each nation, for all nations at once."""
    seeds = star.table(spark, d, "nation").select(F.col("n_name").alias("query"), F.col("n_name").alias("node"))
    return retrieval.contexts(star.triples(spark, d), seeds, depth=2)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, s_name AS surface_form, 'Vendor' AS type_label FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), n_name, 'Nation' FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def typed_terms(spark, d):
    """Given terms, typed by a typer that for every other document gives a class of the ontology only when told what was wrong."""
    from loomgraph.plans import pipeline

    n = star.table(spark, d, "supplier").join(star.table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey"))
    docs = n.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("text"), F.array("s_name", "n_name").alias("terms"))

    def typer(text, terms, types, feedback):
        right = feedback == "no such type: Thing" or int(text) % 2
        return [(terms[0], "Vendor" if right else "Thing"), (terms[1], "Nation" if "Nation" in types else None)]

    out = pipeline.type_terms(docs, typer, star.onto(spark))
    return out.where("score = 1").select("doc_id", F.inline("entities"))


@query(
    """SELECT concat('u:c', c_custkey) AS s, 'u:label' AS p, concat('a "', c_name, '"', chr(10), 'b') AS o, 'literal' AS o_kind, CASE WHEN c_custkey % 2 = 0 THEN 'en' END AS lang FROM customer
    UNION ALL SELECT concat('u:c', c_custkey), 'u:in', concat('u:n', c_nationkey), 'iri', NULL FROM customer UNION ALL SELECT concat('u:n', n_nationkey), 'u:size', CAST(n_nationkey AS VARCHAR), 'literal', NULL FROM nation"""
)
def ntriples_lines(spark, d):
    """N-Triples made of customers and nations, with escapes, languages, datatypes, comments and repeats, read again."""
    c, n = star.table(spark, d, "customer"), star.table(spark, d, "nation")
    label = F.concat(F.lit("<u:c"), "c_custkey", F.lit('> <u:label> "a \\"'), "c_name", F.lit('\\"\\nb"'), F.when(F.col("c_custkey") % 2 == 0, "@en").otherwise(""), F.lit(" ."))
    place = F.concat(F.lit("  <u:c"), "c_custkey", F.lit("> <u:in>\t<u:n"), "c_nationkey", F.lit("> . # where"))
    size = F.concat(F.lit("<u:n"), "n_nationkey", F.lit('> <u:size> "'), "n_nationkey", F.lit(f'"^^<{xsd.NAMESPACE}integer>.'))
    lines = c.select(F.explode(F.array(label, place, place, F.lit("# nothing"), F.lit(""))).alias("value")).union(n.select(size))
    return ntriples.triples(lines)


@query(f"SELECT DISTINCT s AS subject, p AS predicate, o AS object FROM ({star.sql_triples()})")
def graph_document(spark, d):
    """The whole graph written as one JSON document in many files, and its relations read again with their ends' names."""
    m = aggregate.numbered(star.mentions(spark, d).select("surface_form").distinct(), ["surface_form"], "entity_id").select("entity_id", "surface_form")
    t = star.triples(spark, d).select("subject_sf", "predicate_sf", "object_sf").distinct()
    ids = m.select(F.col("surface_form").alias("subject_sf"), F.col("entity_id").alias("subject_id"))
    r = t.join(ids, "subject_sf").select("subject_id", F.col("predicate_sf").alias("predicate"), F.col("object_sf").alias("object"))
    path = scratch(spark)
    corpus.write_document(m, r, path, kind="star")
    e, r = corpus.read_document(spark, path)
    of = lambda c, n: F.get_json_object(c, f"$.{n}").alias(n)
    e = e.select(F.col("entity_id").alias("subject_id"), F.get_json_object("entity", "$.surface_form").alias("subject"))
    return r.select(of("relation", "subject_id"), of("relation", "predicate"), of("relation", "object")).join(e, "subject_id").select("subject", "predicate", "object")
