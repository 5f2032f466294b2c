"""File scans and sinks. Missing paths raise Spark's own PATH_NOT_FOUND error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _store(spark: SparkSession, path: str):
    """The path and its store, in any file system that Spark reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    place, store = _store(spark, path)
    return store.exists(place)


def remove_path(spark: SparkSession, path: str) -> None:
    place, store = _store(spark, path)
    store.delete(place, True)


def publish_path(spark: SparkSession, staged: str, path: str) -> None:
    """Put a complete folder in the place of another. The old one stays until the new one is there."""
    new, store = _store(spark, staged)
    place, _ = _store(spark, path)
    aside, _ = _store(spark, f"{staged}.replaced")
    if store.exists(place):
        store.rename(place, aside)
    elif place.getParent() is not None:
        store.mkdirs(place.getParent())
    if not store.rename(new, place):
        if store.exists(aside):
            store.rename(aside, place)
        raise OSError(f"could not publish {staged} as {path}")
    store.delete(aside, True)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    header: bool = True,
    infer_schema: bool = True,
    delimiter: str = ",",
    null_value: str = "",
    **options,
) -> DataFrame:
    """CSV scan. Give a schema at scale: inferring one reads all files once more."""
    reader = spark.read.options(header=header, sep=delimiter, nullValue=null_value, **options)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", infer_schema).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_json(
    spark: SparkSession,
    path: str,
    multiline: bool = False,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_since(
    spark: SparkSession,
    path: str,
    watermark_column: str,
    last: object | None = None,
    source_format: str = "parquet",
    **options,
) -> DataFrame:
    """Rows above the last high-water mark (all rows without one); the filter reaches the scan."""
    if source_format == "csv":
        df = read_csv(spark, path, **options)
    else:
        df = spark.read.format(source_format).options(**options).load(path)
    if last is None:
        return df
    mark: Column = F.lit(last).cast(df.schema[watermark_column].dataType)
    return df.filter(F.col(watermark_column) > mark)


def next_watermark(df: DataFrame, watermark_column: str) -> DataFrame:
    """The mark to give ``read_since`` next time."""
    return df.agg(F.max(watermark_column).alias("watermark"))


def _existing(df: DataFrame, partition_by: Sequence[str] | None) -> list[str]:
    return [c for c in partition_by or () if c in df.columns]


def write_parquet(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] | None = None,
    compression: str = "snappy",
    **options,
) -> None:
    """Parquet sink, partitioned by those of ``partition_by`` that exist.

    Partitioned output is rebalanced first: rows of one folder meet in few tasks, and AQE
    splits a folder that is too large for one, so files are neither tiny nor huge.
    """
    by = _existing(df, partition_by)
    df = df.hint("rebalance", *by) if by else df
    writer = df.write.mode(mode).option("compression", compression).options(**options)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    header: bool = True,
    delimiter: str = ",",
    partition_by: Sequence[str] | None = None,
    **options,
) -> None:
    """CSV sink, partitioned by those of ``partition_by`` that exist, as for Parquet."""
    by = _existing(df, partition_by)
    df = df.hint("rebalance", *by) if by else df
    writer = df.write.mode(mode).options(header=header, sep=delimiter, **options)
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    df.write.mode(mode).options(**options).json(path)


def sql_over(query: str, **frames: DataFrame) -> DataFrame:
    """SQL over frames named in braces, e.g. ``sql_over("SELECT * FROM {t}", t=df)``."""
    if not frames:
        raise ValueError("give at least one frame")
    spark = next(iter(frames.values())).sparkSession
    return spark.sql(query, **frames)
