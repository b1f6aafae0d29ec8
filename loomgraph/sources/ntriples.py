"""N-Triples: a statement a line, so files of any size are read in parts, by expressions of the JVM.

Only literals with a backslash go to Python to be unescaped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.turtle import _plain

_IRI, _BLANK, _GAP = r"<(?!>)([^<>\"{}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]+[^<>\"{}|^`\\\x00-\x20]*)*)>", r"(_:[^\s<>\"]*[^\s<>\".])", r"[ \t]*"
#: subject (iri, blank), predicate, object (iri, blank, literal, language, datatype)
_LINE = rf'^{_GAP}(?:{_IRI}|{_BLANK}){_GAP}{_IRI}{_GAP}(?:{_IRI}|{_BLANK}|"((?:[^"\\\n\r]|\\.)*)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^{_IRI})?){_GAP}\.{_GAP}(?:#.*)?$'


class BadTriples(ValueError):
    """Lines that are no statements."""


def _text(raw: Column) -> Column:
    @F.pandas_udf("string")
    def unescaped(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else _plain(t))

    return F.coalesce(unescaped(F.when(raw.contains("\\"), raw)), raw)


def parse(lines: DataFrame, column: str = "value", scope: Column | None = None) -> DataFrame:
    """(line, s, p, o, o_kind, lang) of every line that isn't blank or a comment; of one that is no statement all but the line is null.

    Blank nodes are a file's own: with a ``scope``, such as its name, theirs differ by it.
    """
    rows = lines.select(F.col(column).alias("line"), (F.lit("") if scope is None else F.concat(F.substring(F.md5(scope), 1, 12), F.lit("."))).alias("scope")).where(~F.col("line").rlike(rf"^{_GAP}(#.*)?$"))
    part = lambda i: F.regexp_extract("line", _LINE, i)
    good = F.col("line").rlike(_LINE)
    node = lambda blank: F.concat(F.lit("_:"), F.col("scope"), F.substring(blank, 3, 1 << 20))
    either = lambda iri, blank: F.when(blank != "", node(blank)).otherwise(_text(iri))
    kind = F.when(part(5) != "", "blank").when(part(4) != "", "iri").otherwise("literal")
    o = F.when(kind == "blank", node(part(5))).when(kind == "iri", _text(part(4))).otherwise(_text(part(6)))
    out = rows.select("line", either(part(1), part(2)).alias("s"), _text(part(3)).alias("p"), o.alias("o"), kind.alias("o_kind"), F.nullif(part(7), F.lit("")).alias("lang"), good.alias("good"))
    return out.select("line", *[F.when(F.col("good"), F.col(c)).alias(c) for c in ("s", "p", "o", "o_kind", "lang")])


def triples(lines: DataFrame, column: str = "value", scope: Column | None = None) -> DataFrame:
    """Distinct (s, p, o, o_kind, lang) of the lines that are statements."""
    return parse(lines, column, scope).where("s is not null").drop("line").distinct()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The triples of N-Triples files; BadTriples, with the first of them, if a line is no statement."""
    rows = parse(spark.read.text(path), scope=F.input_file_name())
    bad = rows.where("s is null").limit(1).collect()
    if bad:
        raise BadTriples(bad[0].line)
    return rows.drop("line").distinct()
