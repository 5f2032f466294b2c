"""The 24 fraud features: time, amount, velocity and merchant risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swipelake.columns import DEFAULT_COLUMNS, TxnColumns, present
from swipelake.fixed_values import FEATURE_FAMILIES
from swipelake.functions.bands import band_feature
from swipelake.operators.joins import join_group_stats
from swipelake.operators.windows import whole_seconds
from swipelake.skew import HotKeys, Pieces, find_hot_keys


def _flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for NULL)."""
    return F.when(condition, 1).otherwise(0)


def time_features(df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS) -> DataFrame:
    present(df, [cols.timestamp])
    ts = F.col(cols.timestamp).cast("timestamp")
    hour, day = F.hour(ts), F.dayofweek(ts)
    return df.withColumns(
        {
            "hour": hour,
            "day_of_week": day,
            "day_of_month": F.dayofmonth(ts),
            "month": F.month(ts),
            "is_weekend": _flag(day.isin(1, 7)),
            "is_night": _flag((hour >= 22) | (hour <= 5)),
            "is_business_hours": _flag(hour.between(9, 17)),
        }
    )


def _zscore(df: DataFrame, amount: str) -> Column:
    """Distance from the mean in standard deviations; a NULL or zero deviation counts as 1.

    The two numbers are one scalar subquery: no driver round trip and no join.
    """
    whole = df.agg(F.struct(F.avg(amount).alias("mean"), F.stddev(amount).alias("sd"))).scalar()
    mean = F.coalesce(whole["mean"], F.lit(0.0))
    sd = F.coalesce(F.nullif(whole["sd"], F.lit(0.0)), F.lit(1.0))
    return (F.col(amount) - mean) / sd


def _row_amount_features(
    df: DataFrame, cols: TxnColumns, population: DataFrame | None = None
) -> DataFrame:
    """Amount features of single rows; the z-score is against ``population`` (default ``df``)."""
    amount = F.col(cols.amount)
    return df.withColumns(
        {
            "amount_zscore": _zscore(df if population is None else population, cols.amount),
            "amount_bucket": band_feature(amount),
            "log_amount": F.log1p(amount),
            "is_round_amount": _flag(amount % 50 == 0),
        }
    )


def _customer_features(
    df: DataFrame,
    cols: TxnColumns,
    amounts: bool,
    velocity: bool,
    rows_per_task: int | None,
) -> DataFrame:
    """Per-customer columns. Ordinary customers: one shuffle for everything. Hot customers:
    aggregates and order columns carried to their pieces."""
    totals = {}
    if amounts:
        totals["customer_avg_amount"] = F.avg(cols.amount)
        totals["customer_std_amount"] = F.stddev(cols.amount)
    if velocity:
        totals["customer_txn_count"] = F.count(F.lit(1))
        totals["customer_total_amount"] = F.sum(cols.amount)
    tie = [cols.transaction_id] if cols.transaction_id in df.columns else []
    order = [F.asc(c) for c in (cols.timestamp, *tie)]
    hot = find_hot_keys(df, [cols.customer], rows_per_task)

    # Ordered windows first: their sort also serves the whole-customer ones.
    whole = Window.partitionBy(cols.customer)
    plain = df if hot is None else hot.others(df)
    if velocity:
        rows = whole.orderBy(*order)
        plain = plain.withColumns(
            {"txn_number": F.row_number().over(rows), "_prev_ts": F.lag(cols.timestamp).over(rows)}
        )
    plain = plain.withColumns({n: c.over(whole) for n, c in totals.items()})
    if hot is not None:
        plain = plain.unionByName(_hot_customers(df, hot, order, cols, totals, velocity))

    if amounts:
        ratio = F.try_divide(F.col(cols.amount), F.col("customer_avg_amount"))
        plain = plain.withColumn("amount_vs_customer_avg", ratio)
    if velocity:
        gap = whole_seconds(F.col(cols.timestamp)) - whole_seconds(F.col("_prev_ts"))
        plain = plain.withColumn("seconds_since_last_txn", gap)
        plain = plain.withColumn("is_rapid_txn", _flag(F.col("seconds_since_last_txn") < 60))
        plain = plain.drop("_prev_ts")
    return plain


def _hot_customers(
    df: DataFrame,
    hot: HotKeys,
    order: list[Column],
    cols: TxnColumns,
    totals: dict[str, Column],
    velocity: bool,
) -> DataFrame:
    kept = [*df.columns, *totals]
    if not velocity:
        return Pieces(df, hot, order).with_totals(totals).select(*kept)
    rows = Pieces(df, hot, order).numbered({"_prev_ts": cols.timestamp}, totals)
    return rows.withColumn("txn_number", F.col("_global_rn").cast("int")).select(*kept, "txn_number", "_prev_ts")


def amount_features(
    df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS, rows_per_task: int | None = None
) -> DataFrame:
    present(df, [cols.amount, cols.customer])
    df = _row_amount_features(df, cols)
    return _customer_features(df, cols, True, False, rows_per_task)


def velocity_features(
    df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS, rows_per_task: int | None = None
) -> DataFrame:
    present(df, [cols.amount, cols.customer, cols.timestamp])
    return _customer_features(df, cols, False, True, rows_per_task)


def merchant_features(
    df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS, label_rows: DataFrame | None = None
) -> DataFrame:
    """Merchant counts, fraud rate, average and tier.

    The rate counts a row's own label. To train without that leak pass ``label_rows``, the
    (past) rows the statistics may use.
    """
    present(df, [cols.amount, cols.merchant, cols.fraud])
    made = join_group_stats(
        df,
        [cols.merchant],
        {
            "merchant_txn_count": F.count(F.lit(1)),
            "merchant_fraud_rate": F.count_if(F.col(cols.fraud) == 1) / F.count(F.lit(1)),
            "merchant_avg_amount": F.avg(cols.amount),
        },
        label_rows,
    )
    rate = F.col("merchant_fraud_rate")
    tier = F.when(rate > 0.02, "high").when(rate > 0.005, "medium").otherwise("low")
    ratio = F.try_divide(F.col(cols.amount), F.col("merchant_avg_amount"))
    return made.withColumns({"merchant_risk_tier": tier, "amount_vs_merchant_avg": ratio})


def all_features(
    df: DataFrame,
    cols: TxnColumns = DEFAULT_COLUMNS,
    label_rows: DataFrame | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Input columns in their order, then the 24 features.

    Columns of single rows are made last, so the shuffles carry only the input columns.
    """
    present(df, [cols.amount, cols.customer, cols.merchant, cols.timestamp, cols.fraud])
    keep = [c for c in df.columns if c not in feature_names()]
    made = _customer_features(df, cols, True, True, rows_per_task)
    made = merchant_features(made, cols, df if label_rows is None else label_rows)
    made = _row_amount_features(time_features(made, cols), cols, df)
    return made.select(*keep, *feature_names())


def feature_names(family: str | None = None) -> list[str]:
    families = FEATURE_FAMILIES if family is None else {family: FEATURE_FAMILIES[family]}
    return [name for names in families.values() for name in names]
