"""Versioned Parquet tables with time travel, and upsert.

Each write is one folder of Parquet files under ``data``; a small JSON list says which folders make up
which version. A version becomes visible only when its line is added after the data is
complete, so a failed write leaves the table as it was. There is no protection between
writers: use one writer per table.

All folders of a version are read in one scan. An upsert writes the rows of those folders (and, in
a partitioned table, of those partitions) that hold a matched key anew, together with the new
rows, and carries the others over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swipelake.scratch import written
from swipelake.sources.files import path_exists, write_parquet

_VERSIONS = (
    "version LONG, committed_at TIMESTAMP, operation STRING, row_count LONG, total_rows LONG,"
    " columns STRING, table_schema STRING, partition_by ARRAY<STRING>, parts ARRAY<STRING>,"
    " inserted LONG, updated LONG, batch STRING"
)
_PART = "_part_folder"
_PLACE = "_part_place"
MODES = ("overwrite", "append", "error", "ignore")


class Merge(NamedTuple):
    """What an upsert did: the version it made (or found), rows added and rows changed."""

    version: int
    inserted: int
    updated: int


def versions(spark: SparkSession, path: str) -> DataFrame:
    """One row per version."""
    return spark.read.schema(_VERSIONS).json(f"{path}/_versions")


def _latest(spark: SparkSession, path: str, condition: Column | None = None) -> Row | None:
    if not table_exists(spark, path):
        return None
    found = versions(spark, path)
    if condition is not None:
        found = found.filter(condition)
    return found.orderBy(F.desc("version")).first()


def _folders(spark: SparkSession, path: str, folder: str) -> list[str]:
    """Leaf folders below ``data`` that one write has filled."""
    root = f"/data/{_PART}={folder}"
    files = spark.read.schema("_none INT").parquet(f"{path}{root}").inputFiles()
    return sorted({root[6:] + unquote(f.rpartition("/")[0].rpartition(root)[2]) for f in files})


def _commit(
    df: DataFrame,
    path: str,
    operation: str,
    last: Row | None,
    parts: Sequence[str],
    held_rows: int,
    partition_by: Sequence[str],
    committed_at: datetime | None,
    counts: dict[str, Column] | None = None,
    batch: str | None = None,
    drop: Sequence[str] = (),
) -> Row:
    """Write ``df`` as one folder on top of ``parts``, then the line of the new version.

    ``row_count`` is the rows written; ``total_rows`` those of ``held_rows`` and what was inserted.
    """
    spark, folder, seen = df.sparkSession, uuid.uuid4().hex, Observation()
    counts = counts or {"inserted": F.count(F.lit(1)), "updated": F.lit(0).cast("long")}
    counted = df.observe(
        seen, F.count(F.lit(1)).alias("rows"), *[F.coalesce(c, F.lit(0)).alias(n) for n, c in counts.items()]
    ).drop(*drop)
    write_parquet(counted, f"{path}/data/{_PART}={folder}", "error", partition_by)
    got = seen.get
    line = Row(
        version=0 if last is None else last["version"] + 1,
        committed_at=committed_at or datetime.now(timezone.utc),
        operation=operation,
        row_count=got["rows"],
        total_rows=held_rows + got["inserted"],
        columns=",".join(counted.columns),
        table_schema=counted.schema.json(),
        partition_by=list(partition_by),
        parts=[*parts, *_folders(spark, path, folder)],
        inserted=got["inserted"],
        updated=got["updated"],
        batch=batch,
    )
    made = spark.createDataFrame([line], _VERSIONS)
    made.coalesce(1).write.mode("append").json(f"{path}/_versions")
    return line


# Types that hold all values of another one.
_WIDER = {
    "tinyint": ("smallint", "int", "bigint"),
    "smallint": ("int", "bigint"),
    "int": ("bigint", "double"),
    "float": ("double",),
    "date": ("timestamp", "timestamp_ntz"),
}


def _fits(given: T.DataType, held: T.DataType) -> bool:
    if given.simpleString() == held.simpleString():
        return True
    if isinstance(given, T.DecimalType) and isinstance(held, T.DecimalType):
        whole = held.precision - held.scale >= given.precision - given.scale
        return whole and held.scale >= given.scale
    return held.simpleString() in _WIDER.get(given.simpleString(), ())


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the table's column order and types.

    Other columns raise, and so do types that the table's cannot hold without loss.
    """
    if set(schema.names) != set(df.columns):
        raise ValueError(f"the table has the columns {schema.names}")
    wrong = [f"{f.name} {df.schema[f.name].dataType.simpleString()}" for f in schema.fields if not _fits(df.schema[f.name].dataType, f.dataType)]
    if wrong:
        raise TypeError(f"{wrong} do not fit the table's {schema.simpleString()}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def _schema(found: Row) -> T.StructType:
    return T.StructType.fromJson(json.loads(found["table_schema"]))


def _partitions(partition_by: Sequence[str], last: Row | None) -> Sequence[str]:
    """A table keeps its partitioning while versions build on each other."""
    if last is None:
        return partition_by
    if partition_by and list(partition_by) != list(last["partition_by"]):
        raise ValueError(f"the table is partitioned by {last['partition_by']}")
    return last["partition_by"]


def write_snapshot(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    committed_at: datetime | None = None,
) -> int:
    """Write a new version and return its number, starting at 0.

    ``overwrite``: the version holds ``df``. ``append``: it holds the latest version and ``df``; only ``df``
    is written, with the table's types and partitioning. ``error``: raises when there is a table.
    ``ignore``: leaves an existing table as it is and returns its latest version.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    last = _latest(df.sparkSession, path)
    if last is not None and mode == "error":
        raise FileExistsError(f"there is a table at {path}")
    if last is not None and mode == "ignore":
        return last["version"]
    by = [c for c in partition_by if c in df.columns]
    if mode != "append" or last is None:
        return _commit(df, path, "overwrite" if mode != "append" else mode, last, [], 0, by, committed_at)["version"]
    by = _partitions(by, last)
    rows = conformed(df, _schema(last))
    return _commit(rows, path, mode, last, last["parts"], last["total_rows"], by, committed_at)["version"]


def read_snapshot(
    spark: SparkSession,
    path: str,
    version: int | None = None,
    timestamp: str | datetime | None = None,
) -> DataFrame:
    """The latest version, a given one, or the last one committed at or before a time.

    Only the folders of that version are listed and read.
    """
    condition = None
    if version is not None:
        condition = F.col("version") == version
    elif timestamp is not None:
        condition = F.col("committed_at") <= F.lit(timestamp).cast("timestamp")
    found = _latest(spark, path, condition)
    if found is None:
        raise LookupError(f"no such version of {path}")
    return _assembled(spark, path, found, found["parts"]).drop(_PART, _PLACE)


def _assembled(spark: SparkSession, path: str, found: Row, parts: Sequence[str]) -> DataFrame:
    """The rows of some folders in one scan, each with its folder below ``data``."""
    schema = _schema(found)
    wanted = T.StructType([*schema.fields, T.StructField(_PART, T.StringType())])
    if not parts:
        return spark.createDataFrame([], wanted).withColumn(_PLACE, F.lit(""))
    base = f"{path}/data"
    df = spark.read.schema(wanted).option("basePath", base).parquet(*[f"{base}/{p}" for p in parts])
    place = F.regexp_extract(F.col("_metadata.file_path"), f"/data/({_PART}=.*)/[^/]*$", 1)
    return df.withColumn(_PLACE, place).select(*schema.names, _PART, _PLACE)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a version has been made there."""
    return path_exists(spark, f"{path}/_versions")


def has_batch(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether some version of the table was made by the work named ``batch``."""
    return table_exists(spark, path) and versions(spark, path).filter(F.col("batch") == batch).limit(1).count() > 0


def history(spark: SparkSession, path: str, limit: int = 10) -> DataFrame:
    """Versions, newest first, with rows written and held."""
    kept = versions(spark, path).drop("parts", "table_schema", "partition_by", "batch")
    return kept.orderBy(F.desc("version")).limit(limit)


class DuplicateKeyError(ValueError):
    """Source rows of an upsert share a key."""


def _require_unique(source: DataFrame, keys: Sequence[str]) -> None:
    counts = source.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if counts.filter(F.col("_n") > 1).limit(1).count():
        raise DuplicateKeyError(f"source rows share a key {list(keys)}")


def merged(
    target: DataFrame, source: DataFrame, keys: Sequence[str], update: bool = True
) -> DataFrame:
    """Upsert: matched rows take the source's values (with ``update``), unmatched are added.

    One full outer join. A NULL key matches nothing. Duplicate source keys raise, which takes one
    aggregate.
    """
    if set(target.columns) != set(source.columns):
        raise ValueError("upsert needs equal columns on both sides")
    _require_unique(source, keys)
    return _merge(target, source, list(keys), update).drop("_held", "_given")


def _merge(target: DataFrame, source: DataFrame, keys: list[str], update: bool) -> DataFrame:
    """Rows of both sides with ``_held`` and ``_given``: whether the target and the source had them."""
    names = target.columns
    held = target.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*names).alias("_old"))
    given = source.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*names).alias("_new"))
    both = held.join(given, [f"_k{i}" for i in range(len(keys))], "full_outer")
    first, second = ("_new", "_old") if update else ("_old", "_new")
    taken = F.when(F.col(first).isNotNull(), F.col(first)).otherwise(F.col(second))
    return both.select(
        *[taken[c].alias(c) for c in names],
        F.col("_old").isNotNull().alias("_held"),
        F.col("_new").isNotNull().alias("_given"),
    )


def upsert(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    update: bool = True,
    partition_by: Sequence[str] = (),
    committed_at: datetime | None = None,
    batch: str | None = None,
) -> Merge:
    """Merge ``df`` into the latest version as a new version; creates the table when absent.

    ``df`` is evaluated once. Only folders and partitions with a matched key are written anew (none
    when ``update`` is off). ``row_count`` of the version is the rows written, ``inserted`` and ``updated``
    say how many were new and changed. Rows with a NULL key match nothing and are added.
    ``batch`` names the work: when a version with that name exists, nothing is done, so a replay is safe.
    """
    spark, keys = df.sparkSession, list(keys)
    last = _latest(spark, path)
    if last is not None and batch is not None:
        done = versions(spark, path).filter(F.col("batch") == batch).first()
        if done is not None:
            return Merge(done["version"], 0, 0)
    rows = df if last is None else conformed(df, _schema(last))
    source = written(rows, "upsert")
    _require_unique(source, keys)
    by = _partitions([c for c in partition_by if c in df.columns], last)
    if last is None:
        line = _commit(source, path, "overwrite", None, [], 0, by, committed_at, batch=batch)
        return Merge(line["version"], line["inserted"], 0)
    table = _assembled(spark, path, last, last["parts"])
    if not update:
        new = source.join(table.select(*keys), keys, "left_anti").select(*source.columns)
        line = _commit(
            new, path, "upsert", last, last["parts"], last["total_rows"], by, committed_at, batch=batch
        )
        return Merge(line["version"], line["inserted"], 0)
    matched = table.select(*keys, _PLACE).join(source.select(*keys), keys, "left_semi")
    # One row for each folder of the table at most.
    places = {unquote(r[0]) for r in matched.select(_PLACE).distinct().collect()}
    touched = [p for p in last["parts"] if p in places]
    kept = [p for p in last["parts"] if p not in places]
    held = _assembled(spark, path, last, touched).drop(_PART, _PLACE)
    both = _merge(held, source, keys, True)
    counts = {"inserted": F.count_if(~F.col("_held")), "updated": F.count_if(F.col("_held") & F.col("_given"))}
    line = _commit(
        both, path, "upsert", last, kept, last["total_rows"], by, committed_at, counts, batch, ("_held", "_given")
    )
    return Merge(line["version"], line["inserted"], line["updated"])
