"""Scalar functions."""

from pyspark.sql import functions as F

from catalog.base import big, pick, placed, query, table, txn
from swipelake.functions import bands, geo, scalars, sql_names


@query(
    "udf_amount_category",
    """
WITH v AS (SELECT transaction_id, CASE WHEN transaction_id % 7 <> 0
             THEN amount * CASE transaction_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 20 ELSE 60 END END AS a
           FROM txn)
SELECT transaction_id, CASE WHEN a IS NULL THEN 'unknown' WHEN a < 50 THEN 'micro' WHEN a < 100 THEN 'small'
       WHEN a < 500 THEN 'medium' WHEN a < 1000 THEN 'large' WHEN a < 5000 THEN 'very_large'
       ELSE 'premium' END AS category FROM v
""",
)
def udf_amount_category(spark, folder):
    df = txn(spark, folder)
    factor = F.element_at(F.array(F.lit(1), F.lit(20), F.lit(60)), (F.col("transaction_id") % 3 + 1).cast("int"))
    amount = F.when(F.col("transaction_id") % 7 != 0, F.col("amount") * factor)
    return df.select("transaction_id", bands.amount_category(amount).alias("category"))


@query(
    "udf_mask",
    """
SELECT c_custkey, CASE WHEN length(c_name) > 4
         THEN concat(repeat('*', CAST(length(c_name) - 4 AS INT)), right(c_name, 4)) ELSE c_name END AS masked,
       CASE WHEN length(CAST(c_custkey AS VARCHAR)) > 4
         THEN concat(repeat('*', CAST(length(CAST(c_custkey AS VARCHAR)) - 4 AS INT)),
                     right(CAST(c_custkey AS VARCHAR), 4))
         ELSE CAST(c_custkey AS VARCHAR) END AS masked_key
FROM customer
""",
)
def udf_mask(spark, folder):
    df = table(spark, folder, "customer")
    key = F.col("c_custkey").cast("string")
    return df.select(
        "c_custkey",
        scalars.mask(F.col("c_name")).alias("masked"),
        scalars.mask(key).alias("masked_key"),
    )


@query(
    "udf_hour_bucket",
    """
SELECT transaction_id, CASE WHEN transaction_id % 9 = 0 THEN 'unknown'
         WHEN hour(txn_ts) >= 6 AND hour(txn_ts) < 12 THEN 'morning'
         WHEN hour(txn_ts) >= 12 AND hour(txn_ts) < 17 THEN 'afternoon'
         WHEN hour(txn_ts) >= 17 AND hour(txn_ts) < 21 THEN 'evening' ELSE 'night' END AS from_text,
       CASE WHEN hour(txn_ts) >= 6 AND hour(txn_ts) < 12 THEN 'morning'
         WHEN hour(txn_ts) >= 12 AND hour(txn_ts) < 17 THEN 'afternoon'
         WHEN hour(txn_ts) >= 17 AND hour(txn_ts) < 21 THEN 'evening' ELSE 'night' END AS from_time
FROM txn
""",
)
def udf_hour_bucket(spark, folder):
    iso = F.date_format("txn_ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("transaction_id") % 9 != 0, iso).otherwise("not a time at all")
    return txn(spark, folder).select(
        "transaction_id",
        scalars.hour_bucket(text).alias("from_text"),
        scalars.hour_bucket_of(F.col("txn_ts")).alias("from_time"),
    )


@query(
    "udf_is_weekend",
    """
SELECT transaction_id, CASE WHEN transaction_id % 5 = 0 THEN false
         ELSE dayofweek(txn_ts) IN (0, 6) END AS weekend FROM txn
""",
)
def udf_is_weekend(spark, folder):
    day = F.when(F.col("transaction_id") % 5 != 0, F.dayofweek("txn_ts"))
    return txn(spark, folder).select("transaction_id", scalars.is_weekend(day).alias("weekend"))


_SCORE_SQL = """
  CASE WHEN amount * 60 > 5000 THEN 30 WHEN amount * 60 > 1000 THEN 15 WHEN amount * 60 > 500 THEN 5 ELSE 0 END
  + CASE device_type WHEN 'mobile' THEN 5 WHEN 'desktop' THEN 3 WHEN 'pos_terminal' THEN 1 ELSE 10 END
  + CASE transaction_type WHEN 'purchase' THEN 1 WHEN 'transfer' THEN 10 WHEN 'payment' THEN 3
         WHEN 'refund' THEN 5 ELSE 5 END
  + CASE WHEN is_fraud <> 0 THEN 50 ELSE 0 END"""


@query(
    "udf_risk_score",
    f"SELECT transaction_id, CAST({_SCORE_SQL} AS DOUBLE) AS score FROM txn",
)
def udf_risk_score(spark, folder):
    score = scalars.risk_score(
        F.col("amount") * 60, F.col("is_fraud"), F.col("device_type"), F.col("transaction_type")
    )
    return txn(spark, folder).select("transaction_id", score.alias("score"))


@query("udf_hash", "SELECT c_custkey, substr(sha256(c_name), 1, 16) AS hashed FROM customer")
def udf_hash(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", scalars.hashed(F.col("c_name")).alias("hashed")
    )


@query(
    "udf_parse_currency",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0.0::DOUBLE ELSE round(o_totalprice, 2) END AS parsed
FROM orders
""",
)
def udf_parse_currency(spark, folder):
    written = F.concat(F.lit(" $"), F.format_number("o_totalprice", 2), F.lit(" "))
    text = F.when(F.col("o_orderkey") % 20 == 0, "n/a").when(F.col("o_orderkey") % 10 != 0, written)
    return table(spark, folder, "orders").select(
        "o_orderkey", scalars.parse_currency(text).alias("parsed")
    )


@query(
    "normalize_minmax",
    """
SELECT transaction_id, rnd((amount - min(amount) OVER ()) / (max(amount) OVER () - min(amount) OVER ()), 6)
         AS scaled FROM holes
""",
)
def normalize_minmax(spark, folder):
    from catalog.base import holes, rounded

    df = scalars.normalized(holes(spark, folder), "amount", "scaled")
    return rounded(df.select("transaction_id", "scaled"), 6)


@query("char_len", "SELECT doc_id, length(text) AS chars FROM documents")
def char_len(spark, folder):
    return big(
        table(spark, folder, "documents").select("doc_id", F.char_length("text").alias("chars"))
    )


@query(
    "sql_functions",
    f"""
SELECT transaction_id,
       CASE WHEN amount < 50 THEN 'micro' WHEN amount < 100 THEN 'small' WHEN amount < 500 THEN 'medium'
            WHEN amount < 1000 THEN 'large' WHEN amount < 5000 THEN 'very_large' ELSE 'premium' END AS band,
       CASE WHEN length(state) > 4
            THEN concat(repeat('*', CAST(length(state) - 4 AS INT)), right(state, 4)) ELSE state END AS masked,
       CASE WHEN hour(txn_ts) >= 6 AND hour(txn_ts) < 12 THEN 'morning'
            WHEN hour(txn_ts) >= 12 AND hour(txn_ts) < 17 THEN 'afternoon'
            WHEN hour(txn_ts) >= 17 AND hour(txn_ts) < 21 THEN 'evening' ELSE 'night' END AS part,
       dayofweek(txn_ts) IN (0, 6) AS weekend,
       substr(sha256(state), 1, 16) AS hashed,
       round(amount, 2) AS parsed,
       CAST({_SCORE_SQL} AS DOUBLE) AS score
FROM txn
""",
)
def sql_functions(spark, folder):
    sql_names.register(spark)
    return spark.sql(
        """
SELECT transaction_id, categorize_amount(amount) AS band, mask_sensitive(state) AS masked,
       extract_hour_bucket(date_format(txn_ts, "yyyy-MM-dd'T'HH:mm:ss")) AS part,
       is_weekend(dayofweek(txn_ts)) AS weekend, hash_customer(state) AS hashed,
       parse_currency(concat('$', format_number(amount, 2))) AS parsed,
       calculate_risk_score(amount * 60, is_fraud, device_type, transaction_type) AS score
FROM {t}""",
        t=placed(spark, folder),
    )


@query(
    "haversine",
    """
WITH d AS (SELECT transaction_id, radians(lat) AS p1, radians(merch_lat) AS p2,
                  radians(merch_lon) - radians(lon) AS dl FROM txn)
SELECT transaction_id, CASE WHEN transaction_id % 17 <> 0 THEN
  rnd(2 * 6371 * asin(sqrt(pow(sin((p2 - p1) / 2), 2) + cos(p1) * cos(p2) * pow(sin(dl / 2), 2))), 4)
  END AS km FROM d
""",
)
def haversine(spark, folder):
    lat = F.when(F.col("transaction_id") % 17 != 0, F.col("lat"))
    km = geo.haversine_km(lat, F.col("lon"), F.col("merch_lat"), F.col("merch_lon"))
    return pick(txn(spark, folder).withColumn("km", km), "transaction_id", "km")
