"""Distances between customer, home and merchant, and fraud by place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipelake.columns import DEFAULT_COLUMNS, TxnColumns, present
from swipelake.functions.bands import band_distance
from swipelake.functions.geo import haversine_km
from swipelake.skew import group_stats


def geographic_features(
    df: DataFrame,
    cols: TxnColumns = DEFAULT_COLUMNS,
    null_distance_as: str | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Distances, distance band, unusual-location flag and, with a state column, home state.

    The home is the customer's exact median position; the home state is that of the earliest row.
    A NULL distance falls in the farthest band unless ``null_distance_as`` names it.
    """
    present(df, [cols.customer, cols.lat, cols.lon, cols.merch_lat, cols.merch_lon])
    has_state = cols.state in df.columns
    medians = {"customer_median_lat": cols.lat, "customer_median_long": cols.lon}
    stats = {}
    if has_state:
        by = [c for c in (cols.timestamp, cols.transaction_id) if c in df.columns]
        stats["customer_home_state"] = F.min_by(cols.state, F.struct(*(by or [cols.state])))
    df = group_stats(df, [cols.customer], stats, rows_per_task, medians)
    lat, lon = F.col(cols.lat), F.col(cols.lon)
    to_merchant = haversine_km(lat, lon, F.col(cols.merch_lat), F.col(cols.merch_lon))
    from_home = haversine_km(F.col("customer_median_lat"), F.col("customer_median_long"), lat, lon)
    df = df.withColumns(
        {"transaction_distance_km": to_merchant, "distance_from_home_km": from_home}
    )
    made = {
        "distance_bucket": band_distance(F.col("transaction_distance_km"), null_distance_as),
        "is_unusual_location": F.when(F.col("distance_from_home_km") > 200, 1).otherwise(0),
    }
    if has_state:
        away = F.col(cols.state) != F.col("customer_home_state")
        made["is_out_of_state"] = F.when(away, 1).otherwise(0)
    return df.withColumns(made)


def _rate_by(df: DataFrame, key: str, fraud: str) -> DataFrame:
    counted = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(F.col(fraud) == 1).alias("fraud_count"),
        F.avg(fraud).alias("_rate"),
    )
    return counted.withColumn("fraud_rate_percent", F.round(F.col("_rate") * 100, 2))


def fraud_hotspots(
    df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS, min_rows: int = 100, top: int = 10
) -> DataFrame:
    """States with at least ``min_rows`` transactions, highest mean label first."""
    present(df, [cols.state])
    found = _rate_by(df, cols.state, cols.fraud).filter(F.col("total_transactions") >= min_rows)
    return found.orderBy(F.desc("_rate"), cols.state).limit(top).drop("_rate")


def distance_risk(enriched: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Fraud rate per distance band, highest first; needs ``geographic_features`` columns."""
    present(enriched, ["distance_bucket"])
    rate = F.col("fraud_count") / F.col("total_transactions")
    counted = _rate_by(enriched, "distance_bucket", cols.fraud)
    return (
        counted.withColumn("_rate", rate)
        .withColumn("fraud_rate_percent", F.round(rate * 100, 2))
        .orderBy(F.desc("_rate"), "distance_bucket")
        .drop("_rate")
    )


def unusual_locations(enriched: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS) -> DataFrame:
    """One row: transactions far from home and their fraud rate (0 when there are none)."""
    present(enriched, ["is_unusual_location"])
    return enriched.filter(F.col("is_unusual_location") == 1).agg(
        F.count(F.lit(1)).alias("unusual_count"),
        F.round(F.coalesce(F.avg(cols.fraud), F.lit(0.0)) * 100, 2).alias("fraud_rate_percent"),
    )
