"""The 24 features."""

from catalog.base import COLS, CUT_ROWS, pick, query, txn
from swipelake.plans import features

_TIME = """
hour(txn_ts) AS hour, dayofweek(txn_ts) + 1 AS day_of_week, day(txn_ts) AS day_of_month, month(txn_ts) AS month,
CASE WHEN dayofweek(txn_ts) IN (0, 6) THEN 1 ELSE 0 END::BIGINT AS is_weekend,
CASE WHEN hour(txn_ts) >= 22 OR hour(txn_ts) <= 5 THEN 1 ELSE 0 END::BIGINT AS is_night,
CASE WHEN hour(txn_ts) BETWEEN 9 AND 17 THEN 1 ELSE 0 END::BIGINT AS is_business_hours"""

_AMOUNT = """
rnd((amount - (SELECT avg(amount) FROM txn)) / (SELECT stddev(amount) FROM txn), 4) AS amount_zscore,
CASE WHEN amount < 10 THEN 'micro' WHEN amount < 50 THEN 'small' WHEN amount < 200 THEN 'medium'
     WHEN amount < 500 THEN 'large' ELSE 'very_large' END AS amount_bucket,
rnd(ln(1 + amount), 4) AS log_amount, CASE WHEN amount % 50 = 0 THEN 1 ELSE 0 END::BIGINT AS is_round_amount,
rnd(avg(amount) OVER (PARTITION BY customer_id), 4) AS customer_avg_amount,
rnd(stddev(amount) OVER (PARTITION BY customer_id), 4) AS customer_std_amount,
rnd(amount / nullif(avg(amount) OVER (PARTITION BY customer_id), 0), 4) AS amount_vs_customer_avg"""

_LAST = "floor(epoch(txn_ts))::BIGINT - lag(floor(epoch(txn_ts))::BIGINT) OVER (PARTITION BY customer_id ORDER BY txn_ts, transaction_id)"
_VELOCITY = f"""
count(*) OVER (PARTITION BY customer_id) AS customer_txn_count,
rnd(sum(amount) OVER (PARTITION BY customer_id), 2) AS customer_total_amount,
row_number() OVER (PARTITION BY customer_id ORDER BY txn_ts, transaction_id) AS txn_number,
{_LAST} AS seconds_since_last_txn,
CASE WHEN {_LAST} < 60 THEN 1 ELSE 0 END::BIGINT AS is_rapid_txn"""

_MERCHANT_JOIN = """(SELECT merchant_id AS m_id, count(*) AS merchant_txn_count,
   count(*) FILTER (is_fraud = 1)::DOUBLE / count(*) AS rate, avg(amount) AS mavg FROM txn GROUP BY merchant_id) m
ON m.m_id = t.merchant_id"""
_MERCHANT = """
merchant_txn_count, rnd(rate, 4) AS merchant_fraud_rate, rnd(mavg, 4) AS merchant_avg_amount,
CASE WHEN rate > 0.02 THEN 'high' WHEN rate > 0.005 THEN 'medium' ELSE 'low' END AS merchant_risk_tier,
rnd(amount / nullif(mavg, 0), 4) AS amount_vs_merchant_avg"""


def _family(df, name):
    return pick(_money(df), "transaction_id", *features.feature_names(name))


def _money(df):
    from catalog.base import rounded

    return rounded(df, 2, "customer_total_amount") if "customer_total_amount" in df.columns else df


@query("features_time", f"SELECT transaction_id, {_TIME} FROM txn")
def features_time(spark, folder):
    return _family(features.time_features(txn(spark, folder), COLS), "time_features")


@query("features_amount", f"SELECT transaction_id, {_AMOUNT} FROM txn")
def features_amount(spark, folder):
    return _family(features.amount_features(txn(spark, folder), COLS), "amount_features")


@query("features_velocity", f"SELECT transaction_id, {_VELOCITY} FROM txn")
def features_velocity(spark, folder):
    return _family(features.velocity_features(txn(spark, folder), COLS), "velocity_features")


@query("features_merchant", f"SELECT transaction_id, {_MERCHANT} FROM txn t LEFT JOIN {_MERCHANT_JOIN}")
def features_merchant(spark, folder):
    return _family(features.merchant_features(txn(spark, folder), COLS), "merchant_features")


_ALL = f"SELECT transaction_id, {_TIME}, {_AMOUNT}, {_VELOCITY}, {_MERCHANT} FROM txn t LEFT JOIN {_MERCHANT_JOIN}"


@query("features_all", _ALL)
def features_all(spark, folder):
    return _family(features.all_features(txn(spark, folder), COLS), None)


@query("features_all_hot_keys", _ALL)
def features_all_hot_keys(spark, folder):
    """The same with busy customers treated as hot keys."""
    df = txn(spark, folder)
    return _family(features.all_features(df, COLS, rows_per_task=CUT_ROWS), None)


@query(
    "features_merchant_past",
    f"""SELECT transaction_id, {_MERCHANT} FROM txn t LEFT JOIN
{_MERCHANT_JOIN.replace('FROM txn GROUP', "FROM txn WHERE transaction_id % 2 = 0 GROUP")}""",
)
def features_merchant_past(spark, folder):
    """Statistics from half of the rows, joined to all."""
    df = txn(spark, folder)
    made = features.merchant_features(df, COLS, label_rows=df.filter("transaction_id % 2 = 0"))
    return _family(made, "merchant_features")
