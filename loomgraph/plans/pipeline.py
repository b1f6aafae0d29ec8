"""Text to knowledge graph: extractors in partitions, then merging, deduplication and serialisation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import aggregate, conformance, dedup, narrowing, serialize, stats, views
from loomgraph.session import stored
from loomgraph.sources.ontology import Ontology, compatible_pairs, resolve_class, with_class_uris

#: An extractor takes a document's text and returns entities (surface form, type or None) and relations (subject, predicate, object).
Extractor = Callable[[str], tuple[list[tuple[str, str | None]], list[tuple[str, str, str]]]]
_ENTITY = "array<struct<surface_form:string,type_label:string>>"
_RELATION = "array<struct<subject:string,predicate:string,object:string>>"


def rule_extractor(text: str) -> tuple[list[tuple[str, str | None]], list[tuple[str, str, str]]]:
    """Offline default: capitalised words inside sentences are entities, and two in one sentence are related by the words between, up to three."""
    entities, relations = {}, []
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", text):
        found = [m for m in re.finditer(r"[^\W\d_a-z][^\W\d_]+(?: [^\W\d_a-z][^\W\d_]+)*", sentence) if m[0][:1].isupper()]
        for m in found:
            entities.setdefault(m[0])
        for a, b in zip(found, found[1:]):
            between = sentence[a.end() : b.start()].split()
            if 0 < len(between) <= 3:
                relations.append((a[0], " ".join(between), b[0]))
    return [(e, None) for e in entities], relations


def extract(corpus: DataFrame, extractor: Extractor = rule_extractor) -> DataFrame:
    """(doc_id, entities, relations, error): a document that fails has an error, and no other fails with it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for doc, text in zip(pdf["id"], pdf["text"]):
                try:
                    e, r = extractor(text or "")
                    rows.append((doc, [dict(zip(("surface_form", "type_label"), x)) for x in e], [dict(zip(("subject", "predicate", "object"), x)) for x in r], None))
                except Exception as error:
                    rows.append((doc, [], [], f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["doc_id", "entities", "relations", "error"])

    return corpus.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(run, f"doc_id string, entities {_ENTITY}, relations {_RELATION}, error string")


@dataclass
class Graph:
    """Frames of a graph: entities, triples, clusters, failed documents."""

    entities: DataFrame
    triples: DataFrame
    entity_clusters: DataFrame | None = None
    edge_clusters: DataFrame | None = None
    failed: DataFrame | None = None


def mentions_of(extracted: DataFrame, onto: Ontology | None = None) -> DataFrame:
    m = extracted.select("doc_id", F.posexplode("entities").alias("ord", "e")).select("doc_id", F.col("ord").cast("long").alias("ord"), "e.surface_form", F.lit(None).cast("string").alias("uri"), F.lit(None).cast("string").alias("description"), "e.type_label", F.array("doc_id").alias("provenance_ids"))
    if onto is None:
        return m.withColumn("type_uri", F.lit(None).cast("string"))
    return with_class_uris(onto, m.withColumn("type_uri", F.lit(None).cast("string")))


def triples_of(extracted: DataFrame) -> DataFrame:
    """Relations whose ends are entities of their document; repeats stay."""
    r = extracted.select("doc_id", "entities", F.posexplode("relations").alias("ord", "r"))
    known = F.transform("entities", lambda e: e.surface_form)
    r = r.where(F.array_contains(known, F.col("r.subject")) & F.array_contains(known, F.col("r.object")))
    return r.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("r.subject").alias("subject_sf"), F.col("r.predicate").alias("predicate_sf"), F.col("r.object").alias("object_sf"), F.array("doc_id").alias("provenance_ids"))


def conforming(mentions: DataFrame, triples: DataFrame, onto: Ontology, **flags) -> DataFrame:
    """Triples of the documents that pass every check, and of the others those that pass their own."""
    failed = conformance.checks(mentions, triples, onto, **flags).where(~F.col("ok") & (F.col("check") != "type")).select("doc_id", "ord").distinct()
    return triples.join(failed, ["doc_id", "ord"], "left_anti")


#: Takes a text, the terms to type (None: find them), the types that may be given, and what was wrong the time before (None at first); returns entities (surface form, type or None).
Typer = Callable[[str, list[str] | None, list[str], str | None], list[tuple[str, str | None]]]


def type_terms(corpus: DataFrame, typer: Typer, onto: Ontology, attempts: int = 2) -> DataFrame:
    """(doc_id, entities, error, score) of every document (id, text and, where they are known, terms), by a typer that is told the ontology's types.

    score: the share of entities whose type is a class of the ontology, by label or another
    name; entities without a type, and documents without entities, are right. Documents
    below 1, or that failed, are asked again, with what was wrong as feedback; the best
    answer stays, of equal ones the first. Only a document that never answered has an error.
    """
    types = [r.label for r in narrowing.target_types(onto).select("label").orderBy("label").collect()]  # of an ontology
    terms = F.col("terms") if "terms" in corpus.columns else F.lit(None)
    none = F.lit(None).cast("string")
    rows = corpus.select(F.col("id").cast("string").alias("doc_id"), "text", terms.cast("array<string>").alias("terms"), none.alias("feedback"), F.lit(None).cast(_ENTITY).alias("entities"), F.lit(-1.0).alias("score"), none.alias("error"))
    schema = f"doc_id string, text string, terms array<string>, feedback string, entities {_ENTITY}, score double, error string, answer {_ENTITY}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found, errors = [], []
            for text, terms, feedback in zip(pdf["text"], pdf["terms"], pdf["feedback"]):
                answer, error = None, None
                try:
                    answer = [dict(zip(("surface_form", "type_label"), e)) for e in typer(text or "", None if terms is None else list(terms), types, feedback)]
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                found.append(answer)
                errors.append(error)
            yield pdf.assign(error=pd.Series(errors, pdf.index, object), answer=pd.Series(found, pdf.index, object))

    done = None
    for attempt in range(attempts):
        out = stored(rows.mapInPandas(run, schema).withColumn("__row", F.monotonically_increasing_id()))
        kinds = out.select(F.explode("answer").alias("e")).select("e.type_label", none.alias("type_uri")).where("type_label is not null").distinct()
        bad = resolve_class(onto, kinds, "type_uri", "type_label").where("class_uri is null").select(F.col("type_label").alias("__t"))
        each = out.select("__row", F.explode("answer").alias("e")).select("__row", "e.type_label")
        judged = each.join(bad, F.col("type_label") == F.col("__t"), "left").groupBy("__row").agg(F.avg(F.when(F.col("__t").isNull(), 1.0).otherwise(0.0)).alias("__s"), F.array_sort(F.collect_set("__t")).alias("__bad"))
        now = F.when(F.col("answer").isNull(), -1.0).otherwise(F.coalesce("__s", F.lit(1.0)))
        out = out.join(judged, "__row", "left").withColumn("__now", now)
        wrong = F.concat(F.lit("no such type: "), F.array_join("__bad", ", "))
        better = F.col("__now") > F.col("score")
        out = stored(out.select("doc_id", "text", "terms", F.when(F.col("answer").isNull(), F.col("error")).otherwise(wrong).alias("feedback"), F.when(better, F.col("answer")).otherwise(F.col("entities")).alias("entities"), F.greatest("score", "__now").alias("score"), "error"))
        good = F.col("score") == 1
        taken = out if attempt == attempts - 1 else out.where(good)
        answered = F.col("entities").isNotNull()
        taken = taken.select("doc_id", F.coalesce("entities", F.array().cast(_ENTITY)).alias("entities"), F.when(~answered, F.col("error")).alias("error"), F.when(answered, F.col("score")).alias("score"))
        done = taken if done is None else done.unionByName(taken)
        rows = out.where(~good)
    return done


#: Takes a text, its entities (surface form, type or None), the predicates that fit them, and what was wrong the time before (None at first); returns relations.
Relater = Callable[[str, list[tuple[str, str | None]], list[str], str | None], list[tuple[str, str, str]]]


def relate(corpus: DataFrame, mentions: DataFrame, relater: Relater, onto: Ontology, attempts: int = 2, **flags) -> DataFrame:
    """(doc_id, entities, relations, error, score) of every document, by a relater that is told the predicates narrowed to its types.

    Relations that pass every check are taken; other documents are asked again, with
    the messages as feedback. After the last attempt a document's last answer stays,
    whatever its score; only one that never answered has an error. With ``predicate``
    among the flags a document that no predicate fits has no relations.
    """
    ends = {k: v for k, v in flags.items() if k in ("domain", "range_")}
    labels = onto.predicates.select(F.col("uri").alias("predicate_uri"), "label")
    fit = narrowing.narrow(onto, mentions.select(F.col("doc_id").alias("group"), "type_uri", "type_label"), **ends)
    fit = fit.join(F.broadcast(labels), "predicate_uri").groupBy(F.col("group").alias("doc_id")).agg(F.array_sort(F.collect_set("label")).alias("predicates"))
    named = mentions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "surface_form", "type_label"))).alias("e"))
    named = named.select("doc_id", F.transform("e", lambda x: F.struct(x.surface_form.alias("surface_form"), x.type_label.alias("type_label"))).alias("entities"))
    rows = corpus.select(F.col("id").cast("string").alias("doc_id"), "text").join(named, "doc_id", "left").join(fit, "doc_id", "left")
    rows = rows.select("doc_id", "text", F.coalesce("entities", F.array().cast(_ENTITY)).alias("entities"), F.coalesce("predicates", F.array().cast("array<string>")).alias("predicates"))
    rows = rows.select("*", F.lit(None).cast("string").alias("feedback"), F.lit(None).cast(_RELATION).alias("relations"), F.lit(None).cast("string").alias("error"))
    schema = f"doc_id string, text string, entities {_ENTITY}, predicates array<string>, feedback string, relations {_RELATION}, error string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found, errors = [], []
            for text, entities, predicates, feedback, last in zip(pdf["text"], pdf["entities"], pdf["predicates"], pdf["feedback"], pdf["relations"]):
                error = None
                try:
                    if flags.get("predicate") and not len(predicates):
                        last = []
                    else:
                        got = relater(text or "", [(e["surface_form"], e["type_label"]) for e in entities], list(predicates), feedback)
                        last = [dict(zip(("subject", "predicate", "object"), r)) for r in got]
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                found.append(last)
                errors.append(error)
            yield pdf.assign(relations=pd.Series(found, pdf.index, object), error=pd.Series(errors, pdf.index, object))

    done = None
    for attempt in range(attempts):
        out = stored(rows.mapInPandas(run, schema))
        scored = stored(conformance.score(out, conformance.checks(mentions, triples_of(out), onto, **flags)))
        out = out.join(scored.withColumnRenamed("doc_id", "__d"), F.col("doc_id") == F.col("__d")).drop("__d")
        good = F.col("error").isNull() & (F.col("score") == 1)
        taken = out if attempt == attempts - 1 else out.where(good)
        none = F.col("relations").isNull()
        taken = taken.select("doc_id", "entities", F.coalesce("relations", F.array().cast(_RELATION)).alias("relations"), F.when(none, F.col("error")).alias("error"), "score")
        done = taken if done is None else done.unionByName(taken)
        rows = out.where(~good).withColumn("feedback", F.when(F.col("error").isNull(), F.col("errors")).otherwise(F.col("feedback"))).select(*rows.columns)
    return done


def model_settings(model: str, temperature: float, max_tokens: int) -> tuple[float, int]:
    """Temperature and number of tokens that a model takes: one family wants 1.0 at least and 16,000 at least."""
    return (max(temperature, 1.0), max(max_tokens, 16_000)) if "gpt-5" in model else (temperature, max_tokens)


def generate(corpus: DataFrame, extractor: Extractor = rule_extractor, onto: Ontology | None = None, *, deduplicate: bool = True, enforce: bool = False) -> Graph:
    """Corpus (id, text) to a merged graph. Extraction runs once and is stored; edges merge only without an ontology."""
    extracted = stored(extract(corpus, extractor))
    mentions, triples = views.document_mentions(mentions_of(extracted, onto)), triples_of(extracted)
    if onto is not None and enforce:
        triples = conforming(mentions, triples, onto)
    failed = stats.failures(extracted.select(F.col("doc_id").alias("id"), "error"))
    if not deduplicate:
        return Graph(aggregate.merge_mentions(mentions), aggregate.merge_triples(triples), failed=failed)
    typed = {} if onto is None else {"pairs": compatible_pairs(onto), "closure_sizes": onto.closure.groupBy("uri").agg(F.count("*").alias("size"))}
    return Graph(*dedup.deduplicate(mentions, triples, edges=onto is None, **typed), failed=failed)


def knowledge_graph(graph: Graph, onto: Ontology | None = None) -> tuple[DataFrame, DataFrame]:
    """Canonical entities and relations of a graph."""
    e = graph.entities
    for c in ("uri", "description", "type_uri"):
        if c not in e.columns:
            e = e.withColumn(c, F.lit(None).cast("string"))
    entities = stored(serialize.entities(e, onto))
    return entities, serialize.relations(graph.triples, entities, onto)


def aggregate_and_deduplicate(graphs: list[Graph]) -> Graph:
    """Several graphs merged; entities by surface form and type, then by normalised key."""
    m, t = graphs[0].entities, graphs[0].triples
    for g in graphs[1:]:
        m, t = m.unionByName(g.entities, True), t.unionByName(g.triples, True)
    stamp = lambda d: d.select("*", *[F.lit(v).alias(c) for c, v in (("doc_id", ""), ("ord", 0)) if c not in d.columns])
    return Graph(*dedup.deduplicate(stamp(m), stamp(t)))
