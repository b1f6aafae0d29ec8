"""Names of columns that tables bring along: they may hold dots, or be the operator's own."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.session import batched

from ._memory import tidy


def quoted(name: str) -> Column:
    """A column by its name, which may hold a dot."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(taken: Iterable[str], name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name: they have numbers on the way."""
    numbered = [f"c{i}" for i in range(len(schema.fields))]
    out = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(numbered, schema.fields)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=numbered)

    return batched(df).toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(tidy(renamed), out).toDF(*schema.names)
