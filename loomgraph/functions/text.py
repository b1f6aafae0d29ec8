"""Text functions as Column expressions; Arrow only where Spark has no builtin and the value isn't ASCII."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.plurals import singular

_CAMEL = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: By rule: characters whose full case folding isn't what lower case makes of them, with what they fold to. A sigma at a word's end is one.
FOLDED = {c: f for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]) if (f := c.casefold()) != c and c.lower() == c}


def casefold(x) -> Column:
    """Unicode's full case folding: lower case, and character by character only where one is met that folds further."""
    low = F.lower(_c(x))
    by_character = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.element_at(F.from_json(F.lit(json.dumps(FOLDED)), "map<string,string>"), c), c)), "")
    return F.when(F.length(low) == F.octet_length(low), low).when(low.rlike("[" + "".join(FOLDED) + "]"), by_character).otherwise(low)


def normalize_label(x) -> Column:
    """camelCase parted, folded, every run of other characters than a-z and 0-9 one space; null gives the empty string."""
    spaced = F.regexp_replace(F.coalesce(_c(x), F.lit("")), _CAMEL, " ")
    return F.trim(F.regexp_replace(casefold(spaced), "[^a-z0-9]+", " "))


def uri_local_name(x) -> Column:
    """What follows the last # or /; null gives the empty string."""
    return F.coalesce(F.element_at(F.split(_c(x), "[#/]"), -1), F.lit(""))


def label_fallback(x) -> Column:
    """The label of a resource without one: its last path segment, then its last fragment."""
    return F.substring_index(F.substring_index(_c(x), "/", -1), "#", -1)


def nfkc(x, ascii_only: bool = False) -> Column:
    """Unicode's NFKC form; ASCII has it already, so only other values go to Python. Declare the column ASCII to stay in the JVM."""
    if ascii_only:
        return _c(x)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))

    return F.coalesce(run(F.when(F.length(_c(x)) != F.octet_length(_c(x)), _c(x))), _c(x))


def singularize_token(t: Column) -> Column:
    """The singular of one token; tokens with digits, acronyms and hyphenated words stay."""
    keep = t.rlike("[0-9]") | (t.rlike("^[A-Z0-9.&-]+$") & (F.length(t) > 1)) | t.contains("-")
    return F.when(keep, t).otherwise(F.coalesce(singular(t), t))


def singularize(x) -> Column:
    """Each token made singular, single spaces between."""
    return F.array_join(F.transform(F.split(F.trim(F.regexp_replace(_c(x), r"\s+", " ")), " "), singularize_token), " ")


def dedup_form(x, ascii_only: bool = False) -> Column:
    """The key under which surface forms merge: normalised, singular, folded."""
    return casefold(singularize(nfkc(x, ascii_only)))


def describe(comment, label, aliases) -> Column:
    """A description that names the other labels; those that normalise to the label, or repeat, don't count."""
    label, aliases = _c(label), F.coalesce(_c(aliases), F.array().cast("array<string>"))
    other = F.array_distinct(F.filter(aliases, lambda a: normalize_label(a) != normalize_label(label)))
    known = F.when(F.size(other) > 0, F.concat(F.lit("Also known as: "), F.array_join(other, ", "), F.lit(".")))
    return F.nullif(F.concat_ws(" ", _c(comment), known), F.lit(""))


def blob_id(x) -> Column:
    """Content address: the first 16 hex digits of SHA-256."""
    return F.concat(F.lit("blob:"), F.substring(F.sha2(_c(x), 256), 1, 16))


def bm25_tokens(x) -> Column:
    return F.filter(F.split(F.lower(_c(x)), r"\s+"), lambda t: t != "")


def colour(x) -> Column:
    """A deterministic #rrggbb of a label, from the first three bytes of its SHA-1 as hue, saturation and lightness."""
    byte = lambda i: F.conv(F.substring(F.sha1(_c(x)), 2 * i + 1, 2), 16, 10).cast("double") / 255
    h, s, light = byte(0), 0.55 + byte(1) * 0.3, 0.45 + byte(2) * 0.25
    m2 = F.when(light <= 0.5, light * (1 + s)).otherwise(light + s - light * s)
    m1 = 2 * light - m2

    def channel(t: Column) -> Column:
        t = t - F.floor(t)
        v = F.when(t < 1 / 6, m1 + (m2 - m1) * t * 6).when(t < 0.5, m2).when(t < 2 / 3, m1 + (m2 - m1) * (2 / 3 - t) * 6).otherwise(m1)
        return F.lpad(F.lower(F.hex((v * 255).cast("int"))), 2, "0")

    return F.concat(F.lit("#"), channel(h + 1 / 3), channel(h), channel(h - 1 / 3))
