"""Session helpers: the shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that cluster or session names in spark.checkpoint.dir; a temporary one only where none is set and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: files in the shared folder, which survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it isn't there."""
    where, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def scratch(spark: SparkSession) -> str:
    """A new path beside the checkpoints, which goes with all below it when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    where, fs = _path(spark, path)
    fs.deleteOnExit(where)
    return path


def kept(df: DataFrame) -> tuple[DataFrame, str]:
    """``stored``, and where: for ``drop``."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """The rows written to a Parquet table beside the checkpoints and read again; it goes when the application ends.

    Against a checkpoint it is compressed, and later reads take only the columns they use.
    """
    return kept(df)[0]


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing will read any more."""
    where, fs = _path(spark, path)
    fs.delete(where, True)


#: Rows of an Arrow batch, in place of Spark's default: whole documents are wide rows, and executors keep buffers for several batches.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: set[str] = set()


def batched(df: DataFrame) -> DataFrame:
    """The same rows; where the session has Spark's default of rows in an Arrow batch, BATCH_ROWS take its place."""
    if df.sparkSession.conf.get(_BATCH) == "10000":
        df.sparkSession.conf.set(_BATCH, BATCH_ROWS)
    return df


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once in an application, so that they needn't have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))  # the driver serves it to every executor
    _SHIPPED.add(app)
