"""Scalar functions of the transaction vocabulary, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipelake.fixed_values import (
    DAY_PARTS,
    RISK_AMOUNT_POINTS,
    RISK_DEVICE_OTHER,
    RISK_DEVICE_POINTS,
    RISK_KNOWN_FRAUD,
    RISK_TYPE_OTHER,
    RISK_TYPE_POINTS,
)
from swipelake.functions.bands import mapped


def mask(text: Column, visible: int = 4, mask_char: str = "*") -> Column:
    """Hide all but the last ``visible`` characters; short text and NULL stay as they are."""
    hidden = F.char_length(text) - visible
    masked = F.concat(F.repeat(F.lit(mask_char), hidden), F.right(text, F.lit(visible)))
    return F.when(hidden > 0, masked).otherwise(text)


def _day_part(hour: Column) -> Column:
    part = F.when(hour.isNull(), "unknown")
    for first, end, word in DAY_PARTS:
        part = part.when((hour >= first) & (hour < end), word)
    return part.otherwise("night")


def hour_bucket(text: Column) -> Column:
    """Part of day from the two hour digits of an ISO timestamp string."""
    return _day_part(F.substring(text, 12, 2).try_cast("int"))


def hour_bucket_of(ts: Column) -> Column:
    """Part of day of a timestamp."""
    return _day_part(F.hour(ts))


def is_weekend(day_of_week: Column) -> Column:
    """True for 1 (Sunday) and 7 (Saturday), false for NULL."""
    return F.coalesce(day_of_week.isin(1, 7), F.lit(False))


def risk_score(amount: Column, fraud: Column, device: Column, kind: Column) -> Column:
    """0 to 100 points from amount, device, transaction type and a known-fraud flag."""
    by_amount = F
    for above, points in RISK_AMOUNT_POINTS:
        by_amount = by_amount.when(amount > above, points)
    points = (
        by_amount.otherwise(0)
        + mapped(device, RISK_DEVICE_POINTS, RISK_DEVICE_OTHER)
        + mapped(kind, RISK_TYPE_POINTS, RISK_TYPE_OTHER)
        + F.when(fraud != 0, RISK_KNOWN_FRAUD).otherwise(0)
    )
    return F.least(F.lit(100), F.greatest(F.lit(0), points)).cast("double")


def hashed(text: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def parse_currency(text: Column) -> Column:
    """``$1,234.56`` to 1234.56; NULL or unreadable text to 0."""
    number = F.trim(F.regexp_replace(text, "[$,]", "")).try_cast("double")
    return F.coalesce(number, F.lit(0.0))


def normalized(df: DataFrame, column: str, alias: str) -> DataFrame:
    """Min-max scale over the whole frame; all equal gives 0.5, NULL stays NULL.

    The two limits come from one scalar subquery over the frame's own aggregate.
    """
    limits = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    spread = limits["hi"] - limits["lo"]
    scaled = F.when(spread == 0, F.when(F.col(column).isNotNull(), 0.5)).otherwise(
        F.try_divide(F.col(column) - limits["lo"], spread)
    )
    return df.withColumn(alias, scaled)
