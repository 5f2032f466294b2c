"""Where a plan is cut: a table written once in the cluster's shared folder."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

from swipelake.sources.files import remove_path


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="swipelake-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_folder()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one written table."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


_tables: list[str] = []


def release(spark: SparkSession) -> None:
    """Remove the tables that ``written`` has made so far. Call it when no frame made from them is needed."""
    while _tables:
        remove_path(spark, _tables.pop())


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans that run meanwhile send at most ``rows`` rows at a time to Python workers.

    An executor holds a batch several times outside its heap, and the worker once more. A smaller setting of the
    session stays; it has its own again afterwards.
    """
    before = spark.conf.get(_BATCH_ROWS, None)
    if before is not None and 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(_BATCH_ROWS, rows)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_ROWS)
        else:
            spark.conf.set(_BATCH_ROWS, before)


def written(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    Every later use sees the same rows and values, a lost executor re-reads files instead
    of recomputing, readers still prune columns, and Catalyst knows the true size. ``batch_rows``
    bounds the batches that its Python workers get.
    """
    path = scratch_path(df.sparkSession, label)
    with nullcontext() if batch_rows is None else arrow_batches(df.sparkSession, batch_rows):
        df.write.parquet(path)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
