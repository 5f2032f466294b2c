"""Equi-joins: size-checked broadcast, salting for skew, joins with aggregates of the rows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swipelake.columns import present
from swipelake.functions.bands import mapped
from swipelake.scratch import scratch_path, written
from swipelake.skew import (
    ROWS_PER_TASK,
    HotKeys,
    count_hot_keys,
    find_hot_keys,
    hashable,
)

BROADCAST_BYTES = 64 << 20


def measured_bytes(df: DataFrame) -> float:
    """Bytes of a frame by one aggregate: text by its length, other columns by type width.

    Nested columns, whose width no type tells, count as infinite.
    """
    nested = (T.ArrayType, T.MapType, T.StructType)
    if any(isinstance(f.dataType, nested) for f in df.schema.fields):
        return math.inf
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    lengths = [F.sum(F.octet_length(c)).alias(f"t{i}") for i, c in enumerate(texts)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *lengths).first()
    return row["n"] * (8 + 16 * len(df.columns)) + sum(row[f"t{i}"] or 0 for i in range(len(texts)))


def broadcast_join(
    large: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join with ``small`` sent to all executors if it measures at most ``max_bytes``.

    A larger side is joined by a shuffle, where AQE splits skewed partitions.
    """
    if measured_bytes(small) <= max_bytes:
        small = F.broadcast(small)
    return large.join(small, list(on), how)


def lookup(key: Column, table: Mapping, default=None) -> Column:
    """Value of ``key`` in a small Python dict, as a literal map in the plan."""
    return mapped(key, table, default)


def colocated(df: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Hash-partition by the join keys, so that several joins or aggregates share one shuffle."""
    by = [F.col(k) for k in present(df, keys)]
    return df.repartition(partitions, *by) if partitions else df.repartition(*by)


def bucket_count(*tables: DataFrame, least: int = 1, rows_per_bucket: int = 1_000_000) -> int:
    """Buckets for tables that are to be joined: so many that one of the largest table holds about ``rows_per_bucket``.

    A bucket is written, sorted and joined by one task, so its memory does not grow with the tables.
    """
    return max(least, *(math.ceil(t.count() / rows_per_bucket) for t in tables))


def bucketed(
    df: DataFrame,
    keys: Sequence[str],
    buckets: int | None = None,
    sort: Sequence[str] = (),
    name: str | None = None,
) -> DataFrame:
    """``df`` stored once as a table hashed by ``keys`` into ``buckets``, each sorted by keys and ``sort``.

    Joins of two tables with as many buckets, and windows and aggregates by the keys, then need no shuffle, however
    often they run. The default is the session's number of shuffle partitions; ``bucket_count`` tells how many large
    tables need. Each bucket is written by one task, so a key that fills a task alone belongs in ``salted_join``. The table stays under ``name`` (default: a fresh one)
    until the caller drops it; its files lie in the shared folder.
    """
    spark = df.sparkSession
    by = present(df, keys)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = name or f"bucketed_{uuid.uuid4().hex}"
    placed = df.repartition(n, *[F.col(k) for k in by]).write.bucketBy(n, *by).sortBy(*by, *present(df, sort))
    placed.option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def bucketed_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Merge join of two ``bucketed`` tables where they lie; sides of unequal layout are shuffled as usual."""
    return left.join(right.hint("merge"), list(on), how)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    salts: int = 16,
    how: str = "inner",
    hot: HotKeys | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Equi-join with each hot key of ``big`` spread over tasks: ``salts``, or more for a larger key.

    A key gets as many salts as it holds times ``rows_per_task`` rows. Hot keys are searched for unless given; without any this is a plain join. The salt is a
    hash of the row, so a recomputed task gives the same rows. Only the rows of ``small`` that
    have a hot key are repeated, once per salt.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salting the left side cannot give a {how} join")
    on = list(on)
    hot = hot or find_hot_keys(big, on, rows_per_task)
    if hot is None:
        return big.join(small, on, how)
    if [big.schema[k].dataType for k in on] != [small.schema[k].dataType for k in on]:
        # Equal keys of unequal type have unequal hashes, so both sides take the wider type.
        wide = big.select(*on).limit(0).union(small.select(*on).limit(0)).schema
        casts = {k: F.col(k).cast(wide[k].dataType) for k in on}
        again = {k: F.col(k).cast(big.schema[k].dataType) for k in on}
        big, small = big.withColumns(casts), small.withColumns(casts)
        hot = find_hot_keys(big, on, hot.rows_per_task)
        joined = big.join(small, on, how) if hot is None else _salted(big, small, on, salts, how, hot)
        return joined.withColumns(again)
    return _salted(big, small, on, salts, how, hot)


def _salted(
    big: DataFrame, small: DataFrame, on: list[str], salts: int, how: str, hot: HotKeys
) -> DataFrame:
    wanted = F.greatest(F.lit(salts), F.ceil(F.col("_hot_rows") / hot.rows_per_task)).cast("int")
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in hashable(big)]), wanted).cast("int")
    is_hot, none = F.col("_hot_rows").isNotNull(), F.array(F.lit(0))
    left = hot.mark(big).withColumn("_salt", F.when(is_hot, salt).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), wanted - 1)).otherwise(none)
    right = hot.mark(small).withColumn("_salt", F.explode(copies))
    joined = left.drop("_hot_rows").join(right.drop("_hot_rows"), [*on, "_salt"], how)
    return joined.drop("_salt")


def join_group_stats(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Mapping[str, Column],
    rows: DataFrame | None = None,
) -> DataFrame:
    """Aggregates per key of ``rows`` (default ``df``) left-joined to each row of ``df``.

    The aggregate is written first: its measured size decides on a broadcast, and beyond that its row
    counts name the hot keys to salt.
    Column order of ``df`` is kept; a NULL key matches nothing.
    """
    keys = list(keys)
    stats = (df if rows is None else rows).groupBy(*keys).agg(
        *[c.alias(n) for n, c in aggs.items()], F.count(F.lit(1)).alias("_rows")
    )
    kept = [*keys, *aggs]
    stats = written(stats, "stats")
    if measured_bytes(stats) <= BROADCAST_BYTES:
        joined = df.join(F.broadcast(stats.select(*kept)), keys, "left")
    elif hot := count_hot_keys(stats, keys, F.col("_rows"), ROWS_PER_TASK):
        joined = salted_join(df, stats.select(*kept), keys, 64, "left", hot)
    else:
        joined = df.join(stats.select(*kept), keys, "left")
    return joined.select(*df.columns, *aggs)
