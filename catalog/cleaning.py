"""Cleaning, projection and filters."""

from pyspark.sql import functions as F

from catalog.base import big, holes, pick, query, rounded, table, txn
from swipelake.operators import clean


@query(
    "clean_columns",
    "SELECT n_nationkey AS nation_key, n_name AS nation_name_, n_regionkey AS region FROM nation",
)
def clean_columns(spark, folder):
    df = table(spark, folder, "nation").toDF("Nation  Key!", "Nation Name_?", " (Region) ")
    return clean.snake_case_columns(df)


@query(
    "audit_columns",
    """
SELECT 'nightly' AS _pipeline_name, count(*) AS stamped, count(*) AS row_ids, true AS numbered_by_partition FROM orders
""",
)
def audit_columns(spark, folder):
    """The columns differ from run to run, so what holds for all runs is reported."""
    df = clean.audit_columns(table(spark, folder, "orders"), "nightly")
    return df.groupBy("_pipeline_name").agg(
        F.count("_processing_timestamp").alias("stamped"),
        F.count_distinct("_row_id").alias("row_ids"),
        F.bool_and(F.shiftright("_row_id", 33) == F.col("_spark_partition_id")).alias(
            "numbered_by_partition"
        ),
    )


@query(
    "standardize_dates",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN strftime(o_orderdate, '%Y/%m/%d') END AS day
FROM orders
""",
)
def standardize_dates(spark, folder):
    text = F.when(F.col("o_orderkey") % 10 != 0, F.date_format("o_orderdate", "dd.MM.yyyy"))
    df = table(spark, folder, "orders").select("o_orderkey", text.alias("day"))
    df = df.na.fill("never", subset=["day"])
    return clean.standardize_dates(df, ["day"], "dd.MM.yyyy", "yyyy/MM/dd")


@query("nulls_drop", "SELECT transaction_id, amount, category FROM holes WHERE amount IS NOT NULL AND category IS NOT NULL")
def nulls_drop(spark, folder):
    df = clean.drop_nulls(holes(spark, folder), ["amount", "category"])
    return df.select("transaction_id", "amount", "category")


@query(
    "nulls_fill",
    "SELECT transaction_id, coalesce(amount, -1) AS amount, coalesce(category, 'none') AS category FROM holes",
)
def nulls_fill(spark, folder):
    df = clean.fill_nulls(holes(spark, folder), {"amount": -1.0, "category": "none"})
    return df.select("transaction_id", "amount", "category")


@query(
    "nulls_fill_default",
    """
SELECT transaction_id, coalesce(amount, 0) AS amount, coalesce(category, '') AS category,
       CAST(coalesce(merchant_id, 0) AS BIGINT) AS merchant_id FROM holes
""",
)
def nulls_fill_default(spark, folder):
    df = clean.fill_nulls(holes(spark, folder))
    return big(df.select("transaction_id", "amount", "category", "merchant_id"))


@query(
    "nulls_mean",
    """
SELECT transaction_id, rnd(coalesce(amount, (SELECT avg(amount) FROM holes)), 4) AS amount,
       CAST(coalesce(merchant_id, (SELECT CAST(trunc(avg(merchant_id)) AS INT) FROM holes)) AS BIGINT) AS merchant_id
FROM holes
""",
)
def nulls_mean(spark, folder):
    df = clean.fill_nulls_mean(holes(spark, folder), ["amount", "merchant_id"])
    return pick(df, "transaction_id", "amount", "merchant_id")


@query(
    "nulls_median",
    """
SELECT transaction_id, rnd(coalesce(amount, (SELECT quantile_disc(amount, 0.5) FROM holes)), 4) AS amount,
       CAST(coalesce(merchant_id, (SELECT quantile_disc(merchant_id, 0.5) FROM holes)) AS BIGINT) AS merchant_id
FROM holes
""",
)
def nulls_median(spark, folder):
    df = clean.fill_nulls_median(holes(spark, folder), ["amount", "merchant_id"])
    return pick(df, "transaction_id", "amount", "merchant_id")


@query(
    "nulls_mode",
    """
WITH c AS (SELECT category, count(*) AS n FROM holes WHERE category IS NOT NULL GROUP BY category),
     m AS (SELECT merchant_id, count(*) AS n FROM holes WHERE merchant_id IS NOT NULL GROUP BY merchant_id)
SELECT transaction_id,
       coalesce(category, (SELECT category FROM c ORDER BY n DESC, category LIMIT 1)) AS category,
       CAST(coalesce(merchant_id, (SELECT merchant_id FROM m ORDER BY n DESC, merchant_id LIMIT 1)) AS BIGINT)
         AS merchant_id
FROM holes
""",
)
def nulls_mode(spark, folder):
    df = clean.fill_nulls_mode(holes(spark, folder), ["category", "merchant_id"])
    return big(df.select("transaction_id", "category", "merchant_id"))


@query(
    "filter_date",
    """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'
""",
)
def filter_date(spark, folder):
    df = clean.filter_dates(table(spark, folder, "orders"), "o_orderdate", "1995-01-01", "1996-12-31")
    return df.select("o_orderkey", "o_totalprice")


@query("filter_amount", "SELECT transaction_id, amount FROM txn WHERE amount >= 10 AND amount <= 100")
def filter_amount(spark, folder):
    df = clean.filter_amounts(txn(spark, folder), "amount", 10, 100)
    return df.select("transaction_id", "amount")


@query(
    "date_parts",
    """
SELECT transaction_id, year(txn_ts) AS year, month(txn_ts) AS month, day(txn_ts) AS day, hour(txn_ts) AS hour,
       dayofweek(txn_ts) + 1 AS day_of_week, dayofweek(txn_ts) IN (0, 6) AS is_weekend FROM txn
""",
)
def date_parts(spark, folder):
    df = clean.date_parts(txn(spark, folder), "txn_ts")
    names = ("year", "month", "day", "hour", "day_of_week")
    return big(df.select("transaction_id", *names, "is_weekend"))


@query(
    "band_basic",
    """
SELECT transaction_id, CASE WHEN amount * 9 < 50 THEN 'small' WHEN amount * 9 < 200 THEN 'medium'
         WHEN amount * 9 < 1000 THEN 'large' ELSE 'high_value' END AS amount_category FROM txn
""",
)
def band_basic(spark, folder):
    df = txn(spark, folder).withColumn("amount", F.col("amount") * 9)
    return clean.amount_bands_basic(df).select("transaction_id", "amount_category")


@query(
    "band_etl",
    """
SELECT transaction_id, CASE WHEN amount * 9 < 50 THEN 'micro' WHEN amount * 9 < 100 THEN 'small'
         WHEN amount * 9 < 500 THEN 'medium' WHEN amount * 9 < 1000 THEN 'large' ELSE 'premium' END AS amount_category,
       rnd(ln(1 + amount * 9), 4) AS amount_log FROM txn
""",
)
def band_etl(spark, folder):
    df = txn(spark, folder).withColumn("amount", F.col("amount") * 9)
    return pick(clean.amount_bands(df), "transaction_id", "amount_category", "amount_log")


@query(
    "fraud_flags",
    """
SELECT transaction_id, amount * 9 > 1000 AS is_high_amount,
       hour(txn_ts) >= 23 OR hour(txn_ts) <= 5 AS is_late_night FROM txn
""",
)
def fraud_flags(spark, folder):
    df = clean.date_parts(txn(spark, folder), "txn_ts").withColumn("amount", F.col("amount") * 9)
    return clean.fraud_flags(df).select("transaction_id", "is_high_amount", "is_late_night")


@query(
    "category_group",
    """
WITH named AS (SELECT transaction_id, CASE transaction_id % 14 WHEN 0 THEN 'grocery' WHEN 1 THEN 'gas_station'
  WHEN 2 THEN 'utilities' WHEN 3 THEN 'healthcare' WHEN 4 THEN 'restaurant' WHEN 5 THEN 'entertainment'
  WHEN 6 THEN 'travel' WHEN 7 THEN 'online_shopping' WHEN 8 THEN 'electronics' WHEN 9 THEN 'clothing'
  WHEN 10 THEN 'subscription' WHEN 11 THEN 'cash_withdrawal' WHEN 12 THEN category END AS c FROM txn)
SELECT transaction_id, CASE WHEN c IN ('grocery', 'gas_station', 'utilities', 'healthcare') THEN 'essentials'
  WHEN c = 'restaurant' THEN 'dining' WHEN c IN ('entertainment', 'travel') THEN 'leisure'
  WHEN c IN ('online_shopping', 'electronics', 'clothing') THEN 'shopping' WHEN c = 'subscription' THEN 'recurring'
  WHEN c = 'cash_withdrawal' THEN 'cash' ELSE 'other' END AS category_group FROM named
""",
)
def category_group(spark, folder):
    names = (
        "grocery gas_station utilities healthcare restaurant entertainment travel"
        " online_shopping electronics clothing subscription cash_withdrawal"
    ).split()
    which = F.col("transaction_id") % 14
    name = F.when(which == 12, F.col("category"))
    for i, word in enumerate(names):
        name = name.when(which == i, word)
    df = txn(spark, folder).withColumn("merchant_category", name)
    return clean.category_groups(df).select("transaction_id", "category_group")


@query(
    "project_cast",
    """
SELECT o_orderkey AS order_key, CAST(o_custkey AS VARCHAR) AS customer,
       CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS maybe, o_orderstatus FROM orders
""",
)
def project_cast(spark, folder):
    maybe = F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.col("o_custkey").cast("string"))
    df = table(spark, folder, "orders").withColumn("maybe", maybe)
    df = df.drop("o_totalprice", "o_orderdate", "o_orderpriority")
    df = clean.rename_columns(df, {"o_orderkey": "order_key", "o_custkey": "customer", "zz": "yy"})
    return big(clean.cast_columns(df, {"customer": "string", "maybe": "int", "zz": "int"}))


@query(
    "chain",
    """
SELECT transaction_id, hour(txn_ts) AS hour, CASE WHEN amount < 50 THEN 'small' WHEN amount < 200 THEN 'medium'
         WHEN amount < 1000 THEN 'large' ELSE 'high_value' END AS amount_category
FROM txn WHERE amount >= 20
""",
)
def chain(spark, folder):
    made = (
        clean.Chain(txn(spark, folder))
        .then(clean.filter_amounts, "amount", 20)
        .then(clean.derived_columns, "txn_ts")
    )
    assert made.log == ["filter_amounts", "derived_columns"]
    return big(made.result().select("transaction_id", "hour", "amount_category"))


@query("dedupe_full", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def dedupe_full(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return big(clean.cleanse(df))


_DEDUPE = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity, rnd(l_extendedprice, 2) AS price
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
               ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem)
WHERE rn = 1
"""


def _deduped(spark, folder, copies=1):
    lines = table(spark, folder, "lineitem")
    df = clean.drop_duplicates(
        lines.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_copy"),
        ["l_orderkey", "l_linenumber"],
        ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"],
    )
    price = F.round("l_extendedprice", 2).alias("price")
    return big(rounded(df.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", price)))


@query("dedupe_key", _DEDUPE)
def dedupe_key(spark, folder):
    return _deduped(spark, folder)


@query("dedupe_key_hot_keys", _DEDUPE)
def dedupe_key_hot_keys(spark, folder):
    """The same with every row three times."""
    return _deduped(spark, folder, copies=3)
