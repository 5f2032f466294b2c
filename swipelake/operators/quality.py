"""Data quality: checks, rules and profiles as result frames, each one aggregate pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from swipelake.columns import numeric_columns, present


def _unpivot(one: DataFrame, rows: Sequence[Column]) -> DataFrame:
    """A one-row aggregate to one row per struct."""
    return one.select(F.inline(F.array(*rows)))


# ---- checks --------------------------------------------------------------------------------


@dataclass(frozen=True)
class NullCheck:
    """NULL share of each column (default all) at most ``max_ratio``."""

    columns: tuple[str, ...] | None = None
    max_ratio: float = 0.05


@dataclass(frozen=True)
class RangeCheck:
    """No value below or above the column's limits; NULL passes."""

    limits: Mapping[str, tuple[float, float]]


@dataclass(frozen=True)
class DuplicateCheck:
    """Share of rows beyond the first of their key at most ``max_ratio``."""

    keys: tuple[str, ...]
    max_ratio: float = 0.01


def _result(check: str, column: str, bad: Column, total: Column, limit: float) -> Column:
    ratio = F.coalesce(F.try_divide(bad.cast("double"), total), F.lit(0.0))
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(column).alias("column_name"),
        bad.alias("failed_rows"),
        total.alias("total_rows"),
        F.round(ratio, 4).alias("ratio"),
        F.lit(float(limit)).alias("threshold"),
        (ratio <= limit).alias("passed"),
    )


def run_checks(df: DataFrame, *checks: NullCheck | RangeCheck | DuplicateCheck) -> DataFrame:
    """One row per check and column. Null and range checks share one pass; each duplicate
    check is a grouped count (NULL keys form a group). An empty frame passes."""
    total = F.col("_total")
    aggs, rows, frames = [F.count(F.lit(1)).alias("_total")], [], []

    def counted(condition: Column) -> Column:
        name = f"_bad{len(aggs)}"
        aggs.append(F.count_if(condition).alias(name))
        return F.col(name)

    for check in checks:
        if isinstance(check, NullCheck):
            for c in check.columns or df.columns:
                if c in df.columns:
                    bad = counted(F.col(c).isNull())
                    rows.append(_result("nulls", c, bad, total, check.max_ratio))
        elif isinstance(check, RangeCheck):
            for c, (low, high) in check.limits.items():
                if c in df.columns:
                    bad = counted((F.col(c) < low) | (F.col(c) > high))
                    rows.append(_result("range", c, bad, total, 0))
        else:
            keys = present(df, check.keys)
            sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            whole = sizes.agg(
                F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"),
                F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("_bad"),
            )
            row = _result("duplicates", ",".join(keys), F.col("_bad"), total, check.max_ratio)
            frames.append(_unpivot(whole, [row]))
    if rows:
        frames.insert(0, _unpivot(df.agg(*aggs), rows))
    return reduce(DataFrame.unionByName, frames)


def check_schema(df: DataFrame, expected: T.StructType, types: bool = False) -> DataFrame:
    """One row per column that is missing, extra or (with ``types``) of another type.

    Only a missing column, or a wrong type when asked for, fails.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in expected.fields}
    rows = [("missing", c, False) for c in want if c not in have]
    rows += [("extra", c, True) for c in have if c not in want]
    if types:
        rows += [("type", c, False) for c in want if c in have and have[c] != want[c]]
    return df.sparkSession.createDataFrame(
        rows, "problem string, column_name string, passed boolean"
    )


def all_passed(results: DataFrame) -> DataFrame:
    """One row: did every check pass? True for no checks."""
    return results.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"))


# ---- rules ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A named condition for *failing* rows: a predicate (SQL text or Column), or a function
    giving those rows."""

    name: str
    fails: str | Column | Callable[[DataFrame], DataFrame]
    severity: str = "error"

    def __post_init__(self):
        if self.severity not in ("error", "warning", "info"):
            raise ValueError(f"unknown severity {self.severity!r}")

    @property
    def predicate(self) -> Column | None:
        if isinstance(self.fails, str):
            return F.expr(self.fails)
        return self.fails if isinstance(self.fails, Column) else None


def not_null(column: str) -> Rule:
    return Rule(f"not_null_{column}", f"`{column}` IS NULL")


def positive(column: str) -> Rule:
    return Rule(f"positive_{column}", f"`{column}` <= 0")


def in_range(column: str, low: float, high: float) -> Rule:
    return Rule(f"range_{column}", f"`{column}` < {low} OR `{column}` > {high}")


def unique(*columns: str) -> Rule:
    """Fails once per key that occurs more than once, not once per row."""

    def repeated(df: DataFrame) -> DataFrame:
        sizes = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
        return sizes.filter(F.col("_n") > 1)

    return Rule(f"unique_{'_'.join(columns)}", repeated)


def run_rules(df: DataFrame, *rules: Rule) -> DataFrame:
    """One row per rule. All predicate rules share one pass over ``df``."""
    total = F.col("_total")

    def row(rule: Rule, failed: Column) -> Column:
        rate = F.when(total == 0, 1.0).otherwise(F.try_divide(total - failed, total))
        return F.struct(
            F.lit(rule.name).alias("rule"),
            F.lit(rule.severity).alias("severity"),
            failed.alias("failed_count"),
            total.alias("total_count"),
            rate.alias("pass_rate"),
            (failed == 0).alias("passed"),
        )

    if not rules:
        return df.sparkSession.createDataFrame(
            [], "rule string, severity string, failed_count long, total_count long, pass_rate double, passed boolean"
        )
    bad = [F.count_if(r.predicate).alias(f"_bad{i}") for i, r in enumerate(rules) if r.predicate is not None]
    counted = df.agg(F.count(F.lit(1)).alias("_total"), *bad)
    keyed = {
        f"_bad{i}": r.fails(df).agg(F.count(F.lit(1)).alias("_n")).scalar()
        for i, r in enumerate(rules)
        if r.predicate is None
    }
    return _unpivot(counted.withColumns(keyed), [row(r, F.col(f"_bad{i}")) for i, r in enumerate(rules)])


def rules_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.count_if("passed").alias("passed_rules"),
        F.count_if(~F.col("passed")).alias("failed_rules"),
    )


# ---- profiles ------------------------------------------------------------------------------


def profile_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumns(
        {"column_count": F.lit(len(df.columns)), "columns": F.lit(",".join(df.columns))}
    )


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Numeric columns: min, max, mean, deviation (2 decimals); text columns: distinct values.

    One pass for all numeric columns and, in ``approximate`` mode, all text columns. Exact
    distinct counts are one shuffled ``groupBy`` of (column number, value) over all text columns.
    """
    numbers = numeric_columns(df)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    none = F.lit(None)
    aggs, rows = [], []
    for c in numbers:
        aggs.append(
            F.struct(
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
                F.round(F.avg(c), 2).cast("double").alias("avg"),
                F.round(F.stddev(c), 2).alias("stddev"),
            ).alias(f"_{c}")
        )
        part = F.col(f"_{c}")
        rows.append(_profile_row(c, types[c], part["min"], part["max"], part["avg"], part["stddev"], none))
    if approximate:
        for c in texts:
            aggs.append(F.approx_count_distinct(c).alias(f"_{c}"))
            rows.append(_profile_row(c, types[c], none, none, none, none, F.col(f"_{c}")))
    frames = [_unpivot(df.agg(*aggs), rows)] if aggs else []
    if texts and not approximate:
        frames.append(_exact_distinct(df, texts, types))
    if not frames:
        raise ValueError("no numeric or string column to profile")
    return reduce(DataFrame.unionByName, frames)


def _profile_row(name: str, kind: str, *values: Column) -> Column:
    low, high, mean, sd, distinct = values
    return F.struct(
        F.lit(name).alias("column_name"),
        F.lit(kind).alias("dtype"),
        low.cast("double").alias("min"),
        high.cast("double").alias("max"),
        mean.cast("double").alias("avg"),
        sd.cast("double").alias("stddev"),
        distinct.cast("long").alias("distinct_count"),
    )


def _exact_distinct(df: DataFrame, texts: Sequence[str], types: Mapping[str, str]) -> DataFrame:
    """Distinct values, a NULL counting as one, as ``select(c).distinct().count()`` gives."""
    pairs = [F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(texts)]
    values = df.select(F.inline(F.array(*pairs))).distinct()
    one = values.agg(*[F.count_if(F.col("i") == i).alias(f"_{i}") for i in range(len(texts))])
    none = [F.lit(None)] * 4
    return _unpivot(
        one, [_profile_row(c, types[c], *none, F.col(f"_{i}")) for i, c in enumerate(texts)]
    )


def profile_states(df: DataFrame, by: str | None = None, lg_k: int = 12) -> DataFrame:
    """One mergeable state for each column, and for each value of ``by`` (such as a day): a profile to be added to.

    Numeric columns keep rows, NULLs, minimum, maximum, total and squared deviation; text columns a HyperLogLog sketch
    of ``2 ** lg_k`` registers, whose relative standard error is about ``1.04 / sqrt(2 ** lg_k)``. All columns take one pass.
    Returns ``part, column_name, dtype, rows, nulls, min, max, n, total, m2, sketch``; ``part`` is NULL without ``by``.
    """
    numbers = [c for c in numeric_columns(df) if c != by]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != by]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if not numbers and not texts:
        raise ValueError("no numeric or string column to profile")
    aggs = []
    for c in [*numbers, *texts]:
        own = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls")]
        if c in numbers:
            value = F.col(c).cast("double")
            own += [F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n")]
            own += [F.sum(value).alias("total"), (F.var_pop(value) * F.count(value)).alias("m2")]
            own.append(F.lit(None).cast("binary").alias("sketch"))
        else:
            own += [F.lit(None).cast("double").alias(x) for x in ("min", "max")] + [F.count(c).alias("n")]
            own += [F.lit(None).cast("double").alias(x) for x in ("total", "m2")]
            own.append(F.hll_sketch_agg(c, lg_k).alias("sketch"))
        kind = [F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype")]
        aggs.append(F.struct(*kind, *own).alias(f"_{len(aggs)}"))
    part = F.lit(None).cast("string") if by is None else F.col(by).cast("string")
    one = df.groupBy(part.alias("part")).agg(*aggs)
    return one.select("part", F.inline(F.array(*[F.col(f"_{i}") for i in range(len(aggs))])))


def merged_profile(states: DataFrame) -> DataFrame:
    """The profile of all rows behind ``profile_states`` rows of any parts, in the columns of ``profile_columns``.

    Means and deviations are exact; distinct counts are the estimate of the joined sketches, a NULL counting as one.
    """
    whole = Window.partitionBy("column_name")
    centre = F.try_divide(F.sum("total").over(whole), F.sum("n").over(whole))
    mean = F.try_divide(F.col("total"), F.col("n"))
    placed = states.withColumn("_centre", centre)
    apart = F.sum(F.coalesce("m2", F.lit(0.0)) + F.col("n") * F.pow(mean - F.col("_centre"), 2))
    some_null = F.when(F.sum("nulls") > 0, 1).otherwise(0)
    made = placed.groupBy("column_name", "dtype").agg(
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.round(F.max("_centre"), 2).alias("avg"),
        F.round(F.sqrt(F.try_divide(apart, F.nullif(F.sum("n") - 1, F.lit(0)))), 2).alias("stddev"),
        (F.hll_sketch_estimate(F.hll_union_agg("sketch")) + some_null).alias("_distinct"),
    )
    text = F.col("dtype") == "string"
    return made.select(
        "column_name", "dtype", "min", "max", "avg", "stddev", F.when(text, F.col("_distinct")).alias("distinct_count")
    )


def profile_nulls(df: DataFrame) -> DataFrame:
    """NULL count and share (4 decimals) of every column, in one pass."""
    one = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(df.columns)],
    )
    share = lambda n: F.coalesce(F.try_divide(n.cast("double"), F.col("_total")), F.lit(0.0))
    return _unpivot(
        one,
        [
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"_n{i}").alias("null_count"),
                F.round(share(F.col(f"_n{i}")), 4).alias("null_ratio"),
            )
            for i, c in enumerate(df.columns)
        ],
    )


class RequirementError(ValueError):
    """A frame does not meet its stated requirements."""


def require(
    df: DataFrame,
    min_rows: int = 0,
    required_columns: Sequence[str] = (),
    non_nullable: Sequence[str] = (),
) -> DataFrame:
    """``df`` itself, or a RequirementError. Runs one aggregate."""
    absent = [c for c in (*required_columns, *non_nullable) if c not in df.columns]
    if absent:
        raise RequirementError(f"missing columns {absent}")
    found = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(non_nullable)],
    ).first()
    if found["_total"] < min_rows:
        raise RequirementError(f"{found['_total']} rows, at least {min_rows} required")
    nulls = {c: found[f"_n{i}"] for i, c in enumerate(non_nullable) if found[f"_n{i}"]}
    if nulls:
        raise RequirementError(f"NULLs in {nulls}")
    return df
