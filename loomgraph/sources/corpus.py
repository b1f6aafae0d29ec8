"""Corpora, relation replies, type groups and graphs read from JSON, and graphs written."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schemas


class BadCorpus(ValueError):
    """Lines that are no documents; the request fails as a whole."""


class TooLarge(ValueError):
    """A payload above the limit."""


class Empty(ValueError):
    """A corpus without documents, or a document without text."""


def _lifted(terms: Column) -> Column:
    """Terms as structs; a bare string becomes a struct with that surface form."""
    return F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.when(t.startswith("{"), F.from_json(t, schemas.TERM)).otherwise(F.struct(t.alias("surface_form"), *(F.lit(None).cast(k).alias(n) for n, k in (("uri", "string"), ("description", "string"), ("type", schemas.TYPE), ("provenance_ids", "array<string>"))))))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, text, terms, bad): one document a line, blank lines skipped."""
    raw = lines.select(F.trim(column).alias("line")).where("line <> ''")
    doc = F.from_json("line", "id string, text string, terms array<string>")
    return raw.select("line", doc.alias("d")).select("d.id", "d.text", _lifted(F.col("d.terms")).alias("terms"), (F.col("d.id").isNull() | F.col("d.text").isNull()).alias("bad"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a JSONL file; one bad line fails them all."""
    docs = parse_lines(spark.read.text(path))
    if docs.where("bad").limit(1).count():
        raise BadCorpus(f"{path}: a line is no document with id and text")
    return docs.drop("bad")


def parse_list(texts: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The records of lists given inline, as JSON text; text that is no list has none."""
    return texts.select(F.explode(F.from_json(column, f"array<struct<{schema}>>")).alias("r")).select("r.*")


def read_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that holds a list of records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def parse_relations(replies: DataFrame, entities: DataFrame, column: str = "reply") -> DataFrame:
    """(doc_id, ord, subject, predicate, object) of extractor replies: a list or {"relations": list}; bad JSON, or anything else, gives none.

    Every item is taken on its own, whatever its neighbours are: one that is no object, or
    in which a part is missing, empty or no text, is skipped, and so is one whose ends
    aren't entities of the document. ord is the item's place in its list.
    """
    parsed = replies.select("doc_id", F.try_parse_json(column).alias("__v"))
    items = F.coalesce(F.try_variant_get("__v", "$.relations", "array<variant>"), F.try_variant_get("__v", "$", "array<variant>"))
    part = lambda name: F.when(F.schema_of_variant(F.try_variant_get("__item", f"$.{name}", "variant")) == "STRING", F.nullif(F.try_variant_get("__item", f"$.{name}", "string"), F.lit(""))).alias(name)
    rows = parsed.select("doc_id", F.posexplode(items).alias("ord", "__item")).select("doc_id", F.col("ord").cast("long"), part("subject"), part("predicate"), part("object"))
    rows = rows.where("subject is not null and predicate is not null and object is not null")
    known = entities.select("doc_id", F.col("surface_form").alias("__sf")).distinct()
    for end in ("subject", "object"):
        rows = rows.join(known.withColumnRenamed("__sf", end), ["doc_id", end], "left_semi")
    return rows.select("doc_id", "ord", "subject", "predicate", "object")


def type_groups(rows: DataFrame, column: str = "groups") -> DataFrame:
    """(group, type) of JSON objects that map a key to a list of types."""
    return rows.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("group", "types")).select("group", F.explode("types").alias("type"))


def graph_json(entities: DataFrame, relations: DataFrame, **attributes) -> DataFrame:
    """One row: the graph as JSON text; entities keyed by id."""
    e = entities.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_id", F.struct(*[c for c in entities.columns if c != "entity_id"]).alias("entity"))))).alias("entities"))
    r = relations.agg(F.array_sort(F.collect_list(F.struct(*relations.columns))).alias("relations"))
    return e.join(F.broadcast(r)).select(F.to_json(F.struct("entities", "relations", *[F.lit(v).alias(k) for k, v in attributes.items()])).alias("value"))


def write_graph(entities: DataFrame, relations: DataFrame, path: str, compress: bool = False) -> dict:
    """Entities and relations as JSON lines under the path, and their numbers."""
    for name, df in (("entities", entities), ("relations", relations)):
        df.write.mode("overwrite").json(f"{path}/{name}", compression="gzip" if compress else "none")
    return {"num_entities": entities.count(), "num_relations": relations.count(), "output_file": path}


def write_document(entities: DataFrame, relations: DataFrame, path: str, compress: bool = False, **attributes) -> dict:
    """One JSON document {"entities": {id: entity}, "relations": [...], attributes} in many files, and its numbers.

    The files' lines in the order of their names are the document: its head, an entity
    or a relation a line, and its foot, sorted across partitions, so no row holds more
    than one of them. entities: entity_id, which is unique, and more; relations by their columns' order.
    """
    name = F.to_json(F.array(F.col("entity_id").cast("string")))
    key = F.substring(name, F.lit(2), F.length(name) - 2)
    e = entities.select(F.lit(1).alias("part"), key.alias("key"), F.lit(1).alias("n"), F.concat(key, F.lit(": "), F.to_json(F.struct(*[c for c in entities.columns if c != "entity_id"]))).alias("line"))
    each = relations.select(F.to_json(F.struct(*relations.columns)).alias("key")).groupBy("key").agg(F.count("*").cast("int").alias("n"))
    r = each.select(F.lit(3).alias("part"), "key", F.explode(F.sequence(F.lit(1), "n")).alias("n"), F.col("key").alias("line"))
    first = {part: df.agg(F.min("key")).first()[0] for part, df in ((1, e), (3, r))}
    is_first = (F.col("n") == 1) & (F.col("key") == F.when(F.col("part") == 1, F.lit(first[1])).otherwise(F.lit(first[3])))
    rows = e.unionByName(r).withColumn("line", F.concat(F.when(is_first, " ").otherwise(","), "line"))
    more = "".join(f", {json.dumps(k)}: {json.dumps(v)}" for k, v in attributes.items())
    frame = entities.sparkSession.createDataFrame([(0, "", 0, '{"entities": {'), (2, "", 0, '}, "relations": ['), (4, "", 0, f"]{more}}}")], "part int, key string, n int, line string")
    ordered = rows.unionByName(frame).repartitionByRange("part", "key", "n").sortWithinPartitions("part", "key", "n")
    ordered.select("line").write.mode("overwrite").text(path, compression="gzip" if compress else "none")
    return {"num_entities": entities.count(), "num_relations": relations.count(), "output_file": path}


def read_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entity_id, entity) and (relation), JSON text each, of a document written in parts; every line on its own."""
    lines = spark.read.text(path).select(F.substring("value", 1, 1).alias("mark"), F.expr("substring(value, 2)").alias("item")).where("mark in (' ', ',')")
    key = F.regexp_extract("item", r'^("(?:[^"\\]|\\.)*"): ', 1)
    e = lines.where(F.col("item").startswith('"')).withColumn("key", key)
    e = e.select(F.get_json_object(F.concat(F.lit('{"k": '), F.col("key"), F.lit("}")), "$.k").alias("entity_id"), F.expr("substring(item, length(key) + 3)").alias("entity"))
    return e, lines.where(F.col("item").startswith("{")).select(F.col("item").alias("relation"))


def _nodes(rows: DataFrame, column: str) -> DataFrame:
    """(entity_id, n, surface_form): a graph's nodes as JSON text, whether listed or keyed by id."""
    given = F.coalesce(F.get_json_object(column, "$.entities"), F.get_json_object(column, "$.nodes"))
    keyed, listed = F.from_json(given, "map<string,string>"), F.from_json(given, "array<string>")
    pairs = F.when(F.ltrim(given).startswith("{"), F.map_entries(keyed)).otherwise(F.transform(listed, lambda n: F.struct(F.get_json_object(n, "$.id").alias("key"), n.alias("value"))))
    n = rows.select(F.explode(pairs).alias("x")).select(F.col("x.key").alias("entity_id"), F.col("x.value").alias("n"))
    return n.withColumn("surface_form", F.coalesce(*[F.get_json_object("n", f"$.{k}") for k in ("surface_form", "id", "label")], "n"))


def graph_entities(rows: DataFrame, column: str = "value") -> DataFrame:
    """(entity_id, surface_form, uri, description, type_label, type_uri, provenance_ids) of graph JSON: all that it tells of its entities."""
    of = lambda path: F.get_json_object("n", f"$.{path}")
    ids = F.coalesce(F.from_json(of("provenance_ids"), "array<string>"), F.array().cast("array<string>"))
    return _nodes(rows, column).select("entity_id", "surface_form", of("uri").alias("uri"), of("description").alias("description"), of("type.label").alias("type_label"), of("type.uri").alias("type_uri"), ids.alias("provenance_ids"))


def graph_clusters(rows: DataFrame, column: str = "value", kind: str = "entities") -> DataFrame:
    """(canonical, members) of graph JSON's clusters of entities or edges, members by surface form."""
    single = {"entities": "entity_clusters", "edges": "edge_clusters"}[kind]
    given = F.coalesce(F.get_json_object(column, f"$.clusters.{kind}"), F.get_json_object(column, f"$.{single}"))
    c = rows.select(F.explode(F.from_json(given, "map<string,array<string>>")).alias("canonical", "m"))
    name = lambda m: F.coalesce(F.get_json_object(m, "$.surface_form"), m)
    return c.select("canonical", F.array_sort(F.transform("m", name)).alias("members"))


def normalize_graph(rows: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Entities (surface_form) and triples (subject, predicate, object) of graph JSON under any of the usual names."""
    field = lambda *names: F.coalesce(*[F.get_json_object(F.col(column), f"$.{n}") for n in names])
    entities = _nodes(rows, column).select("surface_form").distinct()
    edge = rows.select(F.posexplode(F.from_json(field("relations", "triples", "edges"), "array<string>")).alias("ord", "r"))
    part = lambda i, *names: F.coalesce(*[F.get_json_object("r", f"$.{n}") for n in names], F.get_json_object("r", f"$[{i}]"))
    return entities, edge.select("ord", part(0, "subject", "source").alias("subject"), part(1, "predicate", "relation", "label").alias("predicate"), part(2, "object", "target").alias("object"))


def within(corpus: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """Payloads that aren't empty and not larger than the limit."""
    return corpus.where((F.octet_length("text") > 0) & (F.octet_length("text") <= most_bytes))


def checked(corpus: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """The corpus itself, if it has documents, each has text, and together they aren't larger than the limit; else Empty or TooLarge, with the numbers."""
    size = F.octet_length("text")
    n = corpus.agg(F.count("*").alias("n"), F.count_if(F.coalesce(size, F.lit(0)) == 0).alias("empty"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    if not n.n or n.empty:
        raise Empty("no documents" if not n.n else f"{n.empty} of {n.n} documents have no text")
    if n["size"] > most_bytes:
        raise TooLarge(f"{n['size']} bytes are more than {most_bytes}")
    return corpus
