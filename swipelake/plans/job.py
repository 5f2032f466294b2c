"""One configured job: read, clean, band, check, write."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swipelake.columns import CARD_COLUMNS, DEFAULT_COLUMNS
from swipelake.operators.clean import amount_bands, chain, cleanse, date_parts, rename_columns
from swipelake.sources.files import (
    publish_path,
    read_csv,
    read_parquet,
    remove_path,
    write_csv,
    write_parquet,
)

_READERS = ("csv", "parquet")
_WRITERS = ("csv", "parquet")


@dataclass(frozen=True)
class JobConfig:
    name: str = "transactions"
    input_path: str = "data/raw"
    output_path: str = "data/processed"
    input_format: str = "csv"
    output_format: str = "parquet"
    schema: T.StructType | str | None = None
    partition_by: tuple[str, ...] = ("year", "month")
    max_null_ratio: float | None = None
    min_rows: int = 0
    enable_checks: bool = True

    def __post_init__(self):
        if self.input_format not in _READERS:
            raise ValueError(f"unsupported input format {self.input_format!r}")
        if self.output_format not in _WRITERS:
            raise ValueError(f"unsupported output format {self.output_format!r}")


class JobError(RuntimeError):
    """The written rows fail the job's checks; ``metrics`` says how."""

    def __init__(self, message: str, metrics: dict):
        super().__init__(message)
        self.metrics = metrics


@dataclass
class JobResult:
    output: DataFrame
    metrics: dict = field(default_factory=dict)


def transform(df: DataFrame) -> DataFrame:
    """Distinct rows, normal column names, amount band and, with a timestamp, date parts."""
    names = {
        CARD_COLUMNS.timestamp: DEFAULT_COLUMNS.timestamp,
        CARD_COLUMNS.amount: DEFAULT_COLUMNS.amount,
    }
    steps = [cleanse, lambda d: rename_columns(d, names), amount_bands]
    if {CARD_COLUMNS.timestamp, DEFAULT_COLUMNS.timestamp} & set(df.columns):
        steps.append(date_parts)
    return chain(df, *steps)


def run_job(spark: SparkSession, config: JobConfig) -> JobResult:
    """Run it. Counts and NULL counts are observed while writing, so the data is read once.

    The rows are written to a folder beside the output, checked, and only then put in its place: a failed check
    raises JobError and leaves the old output as it was. ``enable_checks`` off publishes without checks.
    """
    if config.input_format == "csv":
        df = read_csv(spark, config.input_path, config.schema)
    else:
        df = read_parquet(spark, config.input_path)
    read, made = Observation(), Observation()
    df = df.observe(read, F.count(F.lit(1)).alias("rows"))
    out = transform(df)
    out = out.observe(
        made,
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(c + "#nulls") for c in out.columns],
    )
    staged = f"{config.output_path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    write = write_parquet if config.output_format == "parquet" else write_csv
    write(out, staged, "error", partition_by=config.partition_by)
    seen = made.get
    nulls = {c: seen[c + "#nulls"] for c in out.columns}
    metrics = {
        "extract_count": read.get["rows"],
        "transform_count": seen["rows"],
        "null_counts": nulls,
        "success": True,
    }
    problems = []
    if config.enable_checks and seen["rows"] < config.min_rows:
        problems.append(f"{seen['rows']} rows, at least {config.min_rows} required")
    if config.enable_checks and config.max_null_ratio is not None and seen["rows"]:
        bad = [c for c, n in nulls.items() if n / seen["rows"] > config.max_null_ratio]
        if bad:
            problems.append(f"too many NULLs in {bad}")
    if problems:
        remove_path(spark, staged)
        metrics |= {"success": False, "error": "; ".join(problems)}
        raise JobError(metrics["error"], metrics)
    publish_path(spark, staged, config.output_path)
    if config.output_format == "parquet":
        return JobResult(spark.read.parquet(config.output_path), metrics)
    return JobResult(read_csv(spark, config.output_path, out.schema), metrics)
