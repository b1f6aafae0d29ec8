"""Bounded samples of labelled documents, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crc_mod(id_col, modulus: int):
    """crc32 of an id as text, modulo a number; the folds are told by it."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus if isinstance(id_col, str) else F.crc32(id_col.cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int, most_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``most`` documents outside the held-out fold, the first by a hash of the id.

    Documents whose labels contradict each other, aren't 0 or 1, or whose text is
    longer than ``most_bytes`` aren't taken: so at most ``most * most_bytes`` bytes
    come to the driver.  A text that an id has several times over comes once.
    """
    of = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (crc_mod(id_col, modulus) != held))
    of = of.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min(label).alias("__y"), F.max(label).alias("__z")).where("__y = __z")
    chosen = of.select("__id", F.col("__y").cast("int").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("__doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")).where(F.octet_length("__text") <= most_bytes)
    rows = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).groupBy("__id").agg(F.min("__text").alias("t"), F.min("__y").alias("y")).orderBy(F.xxhash64("__id"), "__id")
    table = rows.select("t", "y").toArrow()
    return table.column("t").to_pylist(), table.column("y").to_pylist()
