"""Cleaning, typed projection and row filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from swipelake.columns import numeric_columns, present
from swipelake.functions import bands

Step = Callable[[DataFrame], DataFrame]


def snake_case_columns(df: DataFrame, lowercase: bool = True) -> DataFrame:
    """Names without punctuation, blanks as underscores; names that become equal raise."""
    names = []
    for name in df.columns:
        kept = re.sub(r"[^\w\s]", "", name).strip()
        kept = re.sub(r"\s+", "_", kept)
        names.append(kept.lower() if lowercase else kept)
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise ValueError(f"cleaned names collide: {sorted(twice)}")
    return df.toDF(*names)


def audit_columns(df: DataFrame, job_name: str = "default", row_id: bool = True) -> DataFrame:
    """Processing time (ISO text), job name, partition and, if wanted, a rising row id."""
    added = [
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(
            "_processing_timestamp"
        ),
        F.lit(job_name).alias("_pipeline_name"),
        F.spark_partition_id().alias("_spark_partition_id"),
    ]
    if row_id:
        added.append(F.monotonically_increasing_id().alias("_row_id"))
    return df.select("*", *added)


def standardize_dates(
    df: DataFrame,
    columns: Sequence[str],
    pattern: str = "yyyy-MM-dd",
    output_pattern: str | None = None,
    missing: str = "raise",
) -> DataFrame:
    """Text to timestamp by ``pattern`` (unreadable text gives NULL), or to text again."""

    def parsed(name: str) -> Column:
        ts = F.try_to_timestamp(F.col(name), F.lit(pattern))
        return F.date_format(ts, output_pattern) if output_pattern else ts

    return df.withColumns({c: parsed(c) for c in present(df, columns, missing)})


# ---- NULLs --------------------------------------------------------------------------------


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(subset) if subset is not None else None)


def fill_nulls(
    df: DataFrame, values: Mapping[str, object] | None = None, subset: Sequence[str] | None = None
) -> DataFrame:
    """Given values, or 0 for every numeric and empty text for every string column."""
    if values:
        return df.na.fill(dict(values))
    chosen = list(df.columns if subset is None else subset)
    types = {f.name: f.dataType for f in df.schema.fields}
    defaults = {c: F.lit(0).cast(types[c]) for c in numeric_columns(df, chosen)}
    defaults |= {c: F.lit("") for c in chosen if isinstance(types.get(c), T.StringType)}
    return _fill_with(df, defaults)


def _fill_with(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in values.items()})


def _fill_from_aggregate(
    df: DataFrame, subset: Sequence[str] | None, of: Callable[[str], Column]
) -> DataFrame:
    """One aggregate over all columns as a scalar subquery; column types are kept."""
    names = numeric_columns(df, subset)
    if not names:
        return df
    types = {f.name: f.dataType for f in df.schema.fields}
    found = df.agg(F.struct(*[of(c).alias(c) for c in names])).scalar()
    return _fill_with(df, {c: found[c].cast(types[c]) for c in names})


def fill_nulls_mean(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Column mean; integer columns take its integer part."""
    return _fill_from_aggregate(df, subset, F.avg)


def fill_nulls_median(
    df: DataFrame, subset: Sequence[str] | None = None, accuracy: int = 1_000_000
) -> DataFrame:
    """Median by a mergeable sketch; its rank error is at most rows / ``accuracy``."""
    return _fill_from_aggregate(df, subset, lambda c: F.percentile_approx(c, 0.5, accuracy))


def fill_nulls_mode(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value, the lowest on ties; all columns are counted in one pass by one shuffle."""
    names = present(df, df.columns if subset is None else subset)
    if not names:
        return df
    types = [df.schema[c].dataType for c in names]
    kinds = list(dict.fromkeys(t.simpleString() for t in types))

    def place(kind: str) -> str:
        return f"v{kinds.index(kind)}"

    def value(at: int, name: str) -> Column:
        own = types[at].simpleString()
        typed = [(F.col(name) if k == own else F.lit(None).cast(k)).alias(place(k)) for k in kinds]
        return F.struct(F.lit(at).alias("at"), *typed)

    flat = df.select(F.inline(F.array(*[value(i, c) for i, c in enumerate(names)])))
    held = reduce(lambda a, b: a | b, [F.col(place(k)).isNotNull() for k in kinds])
    counts = flat.filter(held).groupBy("at", *map(place, kinds)).agg(F.count(F.lit(1)).alias("n"))

    def most_frequent(at: int) -> Column:
        own = F.col(place(types[at].simpleString()))
        return F.min_by(own, F.when(F.col("at") == at, F.struct(-F.col("n"), own)))

    found = counts.agg(F.struct(*[most_frequent(i).alias(c) for i, c in enumerate(names)])).scalar()
    return _fill_with(df, {c: found[c] for c in names})


# ---- filters and derived columns -----------------------------------------------------------


def filter_dates(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows from ``start`` to ``end``, both included. The bounds take the column's type."""
    kind = df.schema[column].dataType
    return df.filter(F.col(column).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def filter_amounts(
    df: DataFrame, column: str = "amount", low: float | None = None, high: float | None = None
) -> DataFrame:
    if low is not None:
        df = df.filter(F.col(column) >= low)
    return df if high is None else df.filter(F.col(column) <= high)


def date_parts(df: DataFrame, column: str = "transaction_time") -> DataFrame:
    """Year to hour, day of week (1 = Sunday) and a weekend flag."""
    present(df, [column])
    ts = F.col(column).cast("timestamp")
    day = F.dayofweek(ts)
    return df.withColumns(
        {
            "year": F.year(ts),
            "month": F.month(ts),
            "day": F.dayofmonth(ts),
            "hour": F.hour(ts),
            "day_of_week": day,
            "is_weekend": F.coalesce(day.isin(1, 7), F.lit(False)),
        }
    )


def amount_bands_basic(df: DataFrame, column: str = "amount") -> DataFrame:
    present(df, [column])
    return df.withColumn("amount_category", bands.band_basic(F.col(column)))


def amount_bands(df: DataFrame, column: str = "amount") -> DataFrame:
    present(df, [column])
    return df.withColumns(
        {"amount_category": bands.band_etl(F.col(column)), "amount_log": F.log1p(column)}
    )


def derived_columns(
    df: DataFrame, timestamp: str = "transaction_time", amount: str = "amount"
) -> DataFrame:
    """Date parts and the four-level amount band, for the columns that exist."""
    if timestamp in df.columns:
        df = date_parts(df, timestamp)
    return amount_bands_basic(df, amount) if amount in df.columns else df


def fraud_flags(df: DataFrame, amount: str = "amount", hour: str = "hour") -> DataFrame:
    """High amount (above 1000) and late night (from 23 to 5)."""
    present(df, [amount, hour])
    return df.withColumns(
        {
            "is_high_amount": F.coalesce(F.col(amount) > 1000, F.lit(False)),
            "is_late_night": F.coalesce((F.col(hour) >= 23) | (F.col(hour) <= 5), F.lit(False)),
        }
    )


def category_groups(df: DataFrame, column: str = "merchant_category") -> DataFrame:
    present(df, [column])
    return df.withColumn("category_group", bands.category_group(F.col(column)))


# ---- projection ------------------------------------------------------------------------------

# Castable type names (fixed values).
CASTS = ("string", "int", "double", "timestamp")


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Casts by name; unreadable values give NULL, unknown columns or types are left alone."""
    return df.withColumns(
        {c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns and t in CASTS}
    )


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


# ---- duplicates and chains ---------------------------------------------------------------------


def drop_duplicates(
    df: DataFrame, keys: Sequence[str] | None = None, keep_first_by: Sequence[str] | None = None
) -> DataFrame:
    """Distinct rows, or one row per key: the first by ``keep_first_by``, then all columns.

    Distinct rows are pre-aggregated. Per key a row number picks the row; Spark keeps each map task's
    first row of a key before the shuffle, so the copies of a hot key shrink there.
    """
    if keys is None:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct().select(*df.columns)
    first = list(keep_first_by or [])
    by_order = Window.partitionBy(*keys).orderBy(*first, *[c for c in rest if c not in first])
    return df.withColumn("_at", F.row_number().over(by_order)).filter(F.col("_at") == 1).drop("_at")


def cleanse(
    df: DataFrame,
    duplicates: bool = True,
    nulls: bool = False,
    subset: Sequence[str] | None = None,
) -> DataFrame:
    """Duplicates out first, then rows with NULLs, both over ``subset`` (or all columns)."""
    if duplicates:
        df = drop_duplicates(df, subset)
    return drop_nulls(df, subset) if nulls else df


def chain(df: DataFrame, *steps: Step) -> DataFrame:
    """Apply the steps from left to right; the plan itself is the log."""
    return reduce(DataFrame.transform, steps, df)


class Chain:
    """The same with a readable log of step names."""

    def __init__(self, df: DataFrame):
        self._df = df
        self.log: list[str] = []

    def then(self, step: Callable[..., DataFrame], *args, **kwargs) -> Chain:
        self._df = step(self._df, *args, **kwargs)
        self.log.append(getattr(step, "__name__", str(step)))
        return self

    def result(self) -> DataFrame:
        return self._df
