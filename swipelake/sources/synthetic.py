"""Synthetic transactions, generated in parallel from ids."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swipelake.columns import TRANSACTION_SCHEMA
from swipelake.fixed_values import (
    CARD_TYPES,
    CATEGORY_AMOUNTS,
    CITIES,
    DEVICE_TYPES,
    TRANSACTION_TYPES,
)
from swipelake.functions.draws import choice, uniform, whole

FRAUD_SHARE = 0.012


def synthetic_transactions(
    ids: DataFrame,
    id_column: str = "id",
    customers: int = 100,
    merchants: int = 50,
    start: datetime = datetime(2023, 1, 1),
    end: datetime = datetime(2024, 12, 31),
    seed: int = 42,
) -> DataFrame:
    """One transaction per id; every value is a function of id and seed.

    Amounts follow the category's range; about 1.2 % are frauds of 2 to 10 times the amount.
    """
    key = F.col(id_column)

    def draw(salt: str) -> Column:
        return uniform(key, seed, salt)

    seconds = int((end - start).total_seconds())
    first = int(start.replace(tzinfo=timezone.utc).timestamp())
    at = F.timestamp_seconds(F.lit(first) + whole(key, seed, "time", seconds + 1))
    rows = ids.select(
        F.concat(F.lit("TXN_"), F.lpad(key.cast("string"), 10, "0")).alias("transaction_id"),
        F.concat(
            F.lit("CUST_"), F.lpad(whole(key, seed, "customer", customers).cast("string"), 6, "0")
        ).alias("customer_id"),
        F.concat(
            F.lit("MERCH_"), F.lpad(whole(key, seed, "merchant", merchants).cast("string"), 5, "0")
        ).alias("merchant_id"),
        choice(key, seed, "category", list(CATEGORY_AMOUNTS)).alias("merchant_category"),
        choice(key, seed, "type", TRANSACTION_TYPES).alias("transaction_type"),
        draw("amount").alias("_amount"),
        F.lit("USD").alias("currency"),
        choice(key, seed, "city", CITIES).alias("city"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("transaction_time"),
        (draw("fraud") < FRAUD_SHARE).cast("int").alias("is_fraud"),
        (draw("factor") * 8 + 2).alias("_factor"),
        choice(key, seed, "card", CARD_TYPES).alias("card_type"),
        choice(key, seed, "device", DEVICE_TYPES).alias("device_type"),
    )
    low, high = F, F
    for category, (a, b) in CATEGORY_AMOUNTS.items():
        low = low.when(F.col("merchant_category") == category, float(a))
        high = high.when(F.col("merchant_category") == category, float(b))
    amount = low + F.col("_amount") * (high - low)
    amount = amount * F.when(F.col("is_fraud") == 1, F.col("_factor")).otherwise(1.0)
    return rows.withColumn("amount", F.round(amount, 2)).select(*TRANSACTION_SCHEMA.names)


def generated(spark: SparkSession, rows: int, partitions: int | None = None, **options) -> DataFrame:
    """``rows`` transactions with ids 1 to ``rows``."""
    return synthetic_transactions(spark.range(1, rows + 1, 1, partitions), "id", **options)
