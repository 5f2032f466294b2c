"""The shared pass behind the fraud reports: additive facts, kept per row or pre-aggregated.

``facts`` gives each row its keys and addable measures. ``cube`` adds them up per category,
merchant, hour and weekday and writes the (much smaller) result once. Every report takes
either: adding measures gives the same numbers from both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipelake.columns import TxnColumns
from swipelake.scratch import written

MEASURES = ("rows", "frauds", "amount", "fraud_amount", "fraud_paid", "legit_amount", "legit_paid")


def facts(df: DataFrame, cols: TxnColumns) -> DataFrame:
    """Keys that exist, and per row: counts and amounts of frauds and of legitimate rows."""
    amount, fraud = F.col(cols.amount), F.col(cols.fraud)
    keys: dict[str, Column] = {}
    for name in (cols.category, cols.merchant):
        if name in df.columns:
            keys[name] = F.col(name)
    if cols.timestamp in df.columns:
        ts = F.col(cols.timestamp).cast("timestamp")
        keys["hour"], keys["day_of_week"] = F.hour(ts), F.dayofweek(ts)

    def paid(label: int) -> Column:
        return F.when((fraud == label) & amount.isNotNull(), 1).otherwise(0).cast("long")

    measures = {
        "rows": F.lit(1).cast("long"),
        "frauds": F.when(fraud == 1, 1).otherwise(0).cast("long"),
        "amount": amount,
        "fraud_amount": F.when(fraud == 1, amount),
        "fraud_paid": paid(1),
        "legit_amount": F.when(fraud == 0, amount),
        "legit_paid": paid(0),
    }
    return df.select(
        *[c.alias(n) for n, c in keys.items()],
        *[c.alias(f"_{n}") for n, c in measures.items()],
    )


def cube(df: DataFrame, cols: TxnColumns) -> DataFrame:
    """Facts added up by all keys, written once: one pass, pre-aggregated in the map tasks."""
    rows = facts(df, cols)
    keys = [c for c in rows.columns if not c.startswith("_")]
    sums = [F.sum(f"_{m}").alias(f"_{m}") for m in MEASURES]
    return written(rows.groupBy(*keys).agg(*sums), "cube")
