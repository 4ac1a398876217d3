"""Tables that an operator writes once and reads several times.

They go to the shared folder that the cluster names in ``spark.checkpoint.dir``, so a lost executor
costs a re-read of a file and never a recomputation or a missing block.  Only in local mode, where one
machine runs all, a missing setting gives a folder of our own; on a cluster it is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "llm-tables"
#: Whether a query's shuffle files go as soon as it ends; a table that is written needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; set here only when the session has none."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='llm-checkpoint-')}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


_scope = "default"


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables written in the block are released by this name."""
    global _scope
    before, _scope = _scope, name
    try:
        yield
    finally:
        _scope = before


def _root(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{_FOLDER}/{spark.sparkContext.applicationId}/{name}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of that table."""
    spark = df.sparkSession
    path = f"{_root(spark, _scope)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the tables that ``df``, a result of ``written``, reads."""
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, name: str = "default") -> None:
    """Delete the tables of a scope; frames that still read them must have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_root(spark, name))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
