"""Partition layout and batch-wise user code."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swipelake.scratch import scratch_path
from swipelake.skew import source_bytes

MAX_SHUFFLE_PARTITIONS = 200_000


def partition_profile(df: DataFrame) -> DataFrame:
    """One row: non-empty partitions and their smallest, largest and average row count."""
    sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("num_partitions"),
        F.min("n").alias("min_size"),
        F.max("n").alias("max_size"),
        F.avg("n").alias("avg_size"),
    )


def rebalance(df: DataFrame) -> DataFrame:
    """Partitions of AQE's advisory size, split or merged by their real bytes at run time."""
    return df.hint("rebalance")


def size_shuffles(df: DataFrame, partition_bytes: int = 128 << 20, growth: float = 3.0) -> int:
    """Set the session's shuffle partitions for ``df``'s source size; AQE merges what is too many.

    ``growth`` is how much larger rows are in a shuffle than in their compressed files.
    """
    wanted = math.ceil(source_bytes(df) * growth / partition_bytes)
    spark = df.sparkSession
    wanted = max(wanted, spark.sparkContext.defaultParallelism)
    if wanted > MAX_SHUFFLE_PARTITIONS:
        raise ValueError(f"{wanted} shuffle partitions; choose larger partition_bytes")
    spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return wanted


def repartition_to(df: DataFrame, partitions: int, *columns: str) -> DataFrame:
    return df.repartition(partitions, *[F.col(c) for c in columns])


def coalesce_to(df: DataFrame, rows: int, partitions: int, min_rows: int = 10_000) -> DataFrame:
    """Fewer partitions when they hold under ``min_rows`` rows each; no shuffle."""
    if partitions <= 1 or rows / partitions >= min_rows:
        return df
    return df.coalesce(max(1, int(rows / min_rows)))


def coalesce_if_needed(df: DataFrame, min_rows: int = 10_000) -> DataFrame:
    """``coalesce_to`` after counting rows and non-empty partitions, which takes one pass."""
    found = partition_profile(df).first()
    partitions = found["num_partitions"]
    return coalesce_to(df, int((found["avg_size"] or 0) * partitions), partitions, min_rows)


def compact(df: DataFrame, path: str | None = None, max_records: int = 0) -> DataFrame:
    """Write in evenly sized files and read back."""
    path = path or scratch_path(df.sparkSession, "compact")
    rebalance(df).write.option("maxRecordsPerFile", max_records).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(
    df: DataFrame,
    function: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    batch_size: int = 10_000,
) -> DataFrame:
    """User code over pandas batches of at most ``batch_size`` rows, on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                yield function(batch.iloc[start : start + batch_size])

    return df.mapInPandas(run, schema)
