"""Checks of a graph's JSON against the schema in which graphs are kept, within each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRING, _OBJECT, _ARRAY, _BOOLEAN = ("STRING", "text"), ("OBJECT", "an object"), ("ARRAY", "a list"), ("BOOLEAN", "a truth value")
#: Fields of an entity, a relation and a whole graph: kind, and whether a graph must have them.
_ENTITY = {"surface_form": (_STRING, True), "uri": (_STRING, False), "description": (_STRING, False), "type": (_OBJECT, False), "provenance_ids": (_ARRAY, False)}
_RELATION = {
    "subject_id": (_STRING, True),
    "predicate": (_OBJECT, True),
    "object_id": (_STRING, False),
    "object_value": (_STRING, False),
    "object_datatype": (_STRING, False),
    "is_literal": (_BOOLEAN, True),
    "provenance_ids": (_ARRAY, False),
}
_GRAPH = {"entities": (_OBJECT, True), "relations": (_ARRAY, True), "stats": (_OBJECT, True), "ontology_extensions": (_OBJECT, False), "clusters": (_OBJECT, False)}


def _faults(v: Column, fields: dict, at: Column) -> Column:
    """Messages on the fields of one object; a value that is no object has one message."""
    of = lambda x: F.schema_of_variant(x)

    def fault(name: str, kind: tuple[str, str], must: bool) -> Column:
        k = of(F.try_variant_get(v, f"$.{name}", "variant"))
        place = F.concat(at, F.lit(name))
        missing = F.concat(place, F.lit(": is missing")) if must else F.lit(None).cast("string")
        wrong = F.when(~k.startswith(kind[0]) & ((k != "VOID") | F.lit(must)), F.concat(place, F.lit(f": isn't {kind[1]}")))
        return F.when(k.isNull(), missing).otherwise(wrong)

    each = F.filter(F.array(*[fault(n, *f) for n, f in fields.items()]), lambda m: m.isNotNull())
    return F.when(F.coalesce(of(v).startswith("OBJECT"), F.lit(False)), each).otherwise(F.array(F.concat(at, F.lit(" isn't an object"))))


def validate_graph(rows: DataFrame, column: str = "value") -> DataFrame:
    """The rows with valid and errors ("place: what is wrong") of the graph that each holds as JSON text.

    Null, or text that isn't JSON, is no graph. An entity's place is entities.<id>., a relation's relations.<number>.
    """
    v = F.try_parse_json(column)
    entities = F.map_entries(F.coalesce(F.try_variant_get(v, "$.entities", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    relations = F.coalesce(F.try_variant_get(v, "$.relations", "array<variant>"), F.array().cast("array<variant>"))
    inner = F.concat(
        F.flatten(F.transform(entities, lambda e: _faults(e["value"], _ENTITY, F.concat(F.lit("entities."), e["key"], F.lit("."))))),
        F.flatten(F.transform(relations, lambda r, i: _faults(r, _RELATION, F.concat(F.lit("relations."), i.cast("string"), F.lit("."))))),
    )
    errors = F.concat(_faults(v, _GRAPH, F.lit("")), inner)
    return rows.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
