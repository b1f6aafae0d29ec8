"""A packed exchange of hashes between blocks of documents and hash buckets.

Sending one Spark row per word window would shuffle several times the input.
Here documents are dealt into blocks ("chunks") by a hash; each chunk sends one
binary row per hash bucket; a bucket's answers go back as one row per chunk and
meet the chunk's documents again.  The documents' exchange is planned once and
reused, nothing passes through the driver, and a lost executor costs only the
usual recomputation of shuffle files.  A key that occurs everywhere is sent once
per chunk, so hot keys don't gather in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import batched

from ._memory import tidy


#: Bytes of text in a chunk and of hashes in a bucket, about, where the input is large.
CHUNK_BYTES, BUCKET_BYTES = 64 << 20, 128 << 20
#: Most buckets: a chunk sends each a row, so more would make the rows small.
MOST_BUCKETS = 1 << 16


def input_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of the input: as the plan's files have them, or else counted."""
    known = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return known if known < 1 << 60 else int(docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0)


def sizes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Numbers of chunks and buckets: they follow the input's bytes, and spark.sql.shuffle.partitions where it asks for more."""
    p, size = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), input_bytes(docs, text_col)
    buckets = 16
    while buckets < max(p, size / BUCKET_BYTES) and buckets < MOST_BUCKETS:
        buckets *= 2
    return max(2 * p, -(-size // CHUNK_BYTES)), buckets


def dealt(docs: DataFrame, chunks: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and text columns alone, with the number of the chunk that each row belongs to."""
    return batched(docs).select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(chunks)).cast("int").alias("chunk"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
    )


def rows_of(table: pa.Table) -> tuple[int, list, list[bytes]]:
    """A chunk's number, ids (None for null) and texts as bytes (null: empty), in an order that is always the same."""
    ids = table.column("doc_id").to_pylist()
    texts = table.column("text").cast(pa.large_binary()).to_pylist()
    texts = [t or b"" for t in texts]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return table.column("chunk")[0].as_py(), [ids[i] for i in order], [texts[i] for i in order]


def binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary column over one contiguous array; offsets in bytes."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def by_bucket(chunk: int, bucket: np.ndarray, keys: np.ndarray, extra: dict[str, np.ndarray]) -> pa.Table:
    """A row per bucket present. bucket: of each key, ascending; columns of fixed width, packed."""
    present, first = np.unique(bucket, return_index=True)
    bounds = np.concatenate((first, [len(bucket)]))
    columns = {"bucket": pa.array(present.astype(np.int32)), "chunk": pa.array(np.full(len(present), chunk, np.int32))}
    for name, x in {"keys": keys, **extra}.items():
        columns[name] = binary(bounds * x.dtype.itemsize, x)
    return pa.table(columns)


def ask(spark_docs: DataFrame, send: Callable[[pa.Table], pa.Table], send_schema: str, answer: Callable[[pa.Table], pa.Table], answer_schema: str) -> DataFrame:
    """Chunks -> buckets -> answers, one row per chunk and bucket."""
    return spark_docs.groupBy("chunk").applyInArrow(tidy(send), send_schema).groupBy("bucket").applyInArrow(tidy(answer), answer_schema)


def gather(spark_docs: DataFrame, answers: DataFrame, use: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Each chunk's documents with the answers to it."""
    return spark_docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tidy(use), schema)


def batches(rows: Iterator, names: list[str], types: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=names)
