"""XSD datatypes: guessing them from values and reading them from predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE = "http://www.w3.org/2001/XMLSchema#"
#: The datatypes that a range may name.
TYPES = ("string", "integer", "decimal", "double", "boolean", "date", "dateTime", "time", "gYear")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_xsd(x) -> Column:
    return F.coalesce(_c(x).startswith("xsd:") | _c(x).startswith(NAMESPACE), F.lit(False))


def shorthand(x) -> Column:
    return F.when(_c(x).startswith(NAMESPACE), F.concat(F.lit("xsd:"), F.substring(_c(x), len(NAMESPACE) + 1, 1 << 20))).otherwise(_c(x))


def guess(x) -> Column:
    """Datatype of a literal by its form alone; dates aren't checked against the calendar, null is a string."""
    v = F.coalesce(_c(x), F.lit(""))
    number = v.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$")
    finite = F.abs(F.trim(v).try_cast("double")) <= 1.7976931348623157e308
    return (
        F.when(v == "", "xsd:string")
        .when(v.rlike(r"^\s*[+-]?\d+\s*$"), "xsd:integer")
        .when(number & F.coalesce(finite, F.lit(False)), "xsd:decimal")
        .when(F.lower(v).isin("true", "false"), "xsd:boolean")
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), "xsd:date")
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), "xsd:dateTime")
        .otherwise("xsd:string")
    )


def predicate_datatype(property_type, ranges) -> Column:
    """The datatype of a literal predicate ('' if none or several are declared), null for an object predicate.

    ``ranges``: array of range URIs.
    """
    r = F.coalesce(_c(ranges), F.array().cast("array<string>"))
    simple = F.filter(r, is_xsd)
    literal = F.coalesce(_c(property_type).endswith("DatatypeProperty"), F.lit(False)) | ((F.size(r) > 0) & (F.size(simple) == F.size(r)))
    return F.when(literal, F.when(F.size(simple) == 1, shorthand(F.element_at(simple, 1))).otherwise(""))
