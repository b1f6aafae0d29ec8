"""Arguments that are given inline, as a path, or as the handle of a blob."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import _path, exists
from loomgraph.sources import corpus
from loomgraph.streaming.jobs import get_blob

#: Fixed value: how a blob's handle begins.
HANDLE = "blob:"


def read_reference(spark: SparkSession, value: str, blobs: str | None = None) -> str:
    """The text behind a handle or a path; ValueError for a handle that is unknown or has expired."""
    if not value.startswith(HANDLE):
        return spark.read.text(value, wholetext=True).first().value
    try:
        if blobs is None:
            raise KeyError(f"{value}: there is no store")
        return get_blob(spark, blobs, value)
    except KeyError as e:
        raise ValueError(str(e.args[0])) from e


def turtle_text(spark: SparkSession, value: str | None, blobs: str | None = None) -> str | None:
    """Turtle given as itself, as a handle, or as a path, which is one line and names what exists."""
    if value is None:
        return None
    named = "\n" not in value.strip() and not value.lstrip().startswith(("@", "<")) and exists(spark, value)
    return read_reference(spark, value, blobs) if named or value.startswith(HANDLE) else value


def records(spark: SparkSession, value: list[dict] | str, schema: str, blobs: str | None = None) -> DataFrame:
    """The records of a list: given as one, or as a path or handle of JSON text that holds one."""
    if not isinstance(value, str):
        return spark.createDataFrame(value, schema)
    if value.startswith(HANDLE):
        return corpus.parse_list(spark.createDataFrame([(read_reference(spark, value, blobs),)], "value string"), schema)
    return corpus.read_list(spark, value, schema)


def save_graph(entities: DataFrame, relations: DataFrame, folder: str, title: str) -> str:
    """A graph (entities with entity_id) as JSON under its title; its path. A graph of that title is replaced."""
    path = f"{folder.rstrip('/')}/{title}.json"
    corpus.graph_json(entities, relations).write.mode("overwrite").text(path)
    return path


def saved_graphs(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, path) of the graphs in a folder, by title without regard to case; none where there is no folder."""
    where, fs = _path(spark, f"{folder.rstrip('/')}/*.json")
    found = [s.getPath().toString() for s in fs.globStatus(where) or []]
    rows = spark.createDataFrame([(p,) for p in found], "path string")
    return rows.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("slug"), "path").orderBy(F.lower("slug"), "slug")


def load_graph(spark: SparkSession, folder: str, slug: str) -> tuple[DataFrame, DataFrame]:
    """Entities and triples of a saved graph; KeyError if there is none of that name."""
    found = saved_graphs(spark, folder).where(F.col("slug") == slug).first()
    if found is None:
        raise KeyError(slug)
    return corpus.normalize_graph(spark.read.text(found.path, wholetext=True))
