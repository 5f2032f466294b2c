"""Customer segments: metrics, K-Means assignment and segment profiles."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipelake.columns import DEFAULT_COLUMNS, TxnColumns, present
from swipelake.fixed_values import SEGMENT_INPUTS
from swipelake.scratch import written


def segment_metrics(df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS) -> DataFrame:
    """One row per customer; night and weekend counts are 0 without their flag columns."""
    present(df, [cols.customer, cols.amount, cols.merchant, cols.fraud])

    def flagged(name: str) -> Column:
        return F.count_if(F.col(name) == 1) if name in df.columns else F.lit(0).cast("long")

    metrics = df.groupBy(cols.customer).agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.sum(cols.amount).alias("total_amount"),
        F.avg(cols.amount).alias("avg_amount"),
        F.max(cols.amount).alias("max_amount"),
        F.min(cols.amount).alias("min_amount"),
        F.stddev(cols.amount).alias("std_amount"),
        F.count_distinct(cols.merchant).alias("unique_merchants"),
        F.count_if(F.col(cols.fraud) == 1).alias("fraud_count"),
        flagged("is_night").alias("night_txn_count"),
        flagged("is_weekend").alias("weekend_txn_count"),
    )
    metrics = metrics.withColumn("fraud_rate", F.col("fraud_count") / F.col("txn_count"))
    numbers = [c for c in metrics.columns if c != cols.customer]
    return metrics.na.fill(0, subset=numbers)


def fit_segments(metrics: DataFrame, k: int = 4, seed: int = 42) -> PipelineModel:
    """Fit on standardised inputs. Runs jobs; give it a written or persisted frame."""
    stages = [
        VectorAssembler(inputCols=list(SEGMENT_INPUTS), outputCol="features_raw"),
        StandardScaler(inputCol="features_raw", outputCol="features", withStd=True, withMean=True),
        KMeans(k=k, seed=seed, featuresCol="features", predictionCol="segment"),
    ]
    return Pipeline(stages=stages).fit(metrics)


def customer_segments(
    df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS, k: int = 4, seed: int = 42
) -> DataFrame:
    """Metrics with each customer's segment. The metrics are aggregated once, for all iterations."""
    metrics = written(segment_metrics(df, cols), "segment-metrics")
    model = fit_segments(metrics, k, seed)
    return model.transform(metrics).drop("features_raw", "features")


def segment_profiles(assigned: DataFrame) -> DataFrame:
    """Size, means, risk level, name and traits of each segment against the global means."""
    whole = assigned.agg(
        F.struct(
            F.coalesce(F.avg("avg_amount"), F.lit(0.0)).alias("amount"),
            F.coalesce(F.avg("txn_count"), F.lit(0.0)).alias("txns"),
            F.coalesce(F.avg("fraud_rate"), F.lit(0.0)).alias("fraud"),
        )
    ).scalar()
    means = assigned.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.avg("avg_amount").alias("_amount"),
        F.avg("txn_count").alias("_txns"),
        F.avg("fraud_rate").alias("_fraud"),
    )
    amount, txns, fraud = F.col("_amount"), F.col("_txns"), F.col("_fraud")
    high_risk = fraud > whole["fraud"] * 2
    spends_more, spends_less = amount > whole["amount"] * 1.5, amount < whole["amount"] * 0.5
    buys_more, buys_less = txns > whole["txns"] * 1.5, txns < whole["txns"] * 0.5
    risk = F.when(high_risk, "HIGH").when(fraud > whole["fraud"], "MEDIUM").otherwise("LOW")
    name = (
        F.when(high_risk, "High-Risk Segment")
        .when(spends_more, "Premium Customers")
        .when(buys_more, "Frequent Buyers")
        .when(spends_less, "Budget Customers")
        .otherwise("Standard Customers")
    )
    traits = F.concat_ws(
        ", ",
        F.when(spends_more, "High spenders")
        .when(spends_less, "Low spenders")
        .otherwise("Average spenders"),
        F.when(buys_more, "High frequency").when(buys_less, "Low frequency"),
        F.when(high_risk, "High fraud exposure"),
    )
    return means.select(
        F.col("segment").alias("segment_id"),
        name.alias("segment_name"),
        "customer_count",
        F.round(amount, 2).alias("avg_transaction_amount"),
        F.round(txns, 2).alias("avg_transaction_count"),
        F.round(fraud * 100, 4).alias("fraud_rate_percent"),
        risk.alias("risk_level"),
        traits.alias("characteristics"),
    ).orderBy("segment_id")
