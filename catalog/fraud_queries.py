"""Fraud reports and geography."""

from pyspark.sql import functions as F

from catalog.base import COLS, CUT_ROWS, big, pick, placed, query, rounded, txn
from swipelake.plans import fraud, geography


@query(
    "customer_profile",
    """
SELECT customer_id, count(*) AS transaction_count, rnd(sum(amount), 2) AS total_amount,
       rnd(avg(amount), 4) AS avg_amount, min(amount) AS min_amount, max(amount) AS max_amount,
       rnd(stddev(amount), 4) AS stddev_amount, count(DISTINCT merchant_id) AS unique_merchants
FROM txn GROUP BY customer_id
""",
)
def customer_profile(spark, folder):
    df = fraud.customer_profile(txn(spark, folder), COLS)
    return rounded(rounded(df, 2, "total_amount"), 4, "avg_amount", "stddev_amount")


@query(
    "overall_stats",
    """
SELECT count(*) AS total_transactions, rnd(sum(amount), 2) AS total_amount, rnd(avg(amount), 4) AS avg_amount,
       max(amount) AS max_amount, min(amount) AS min_amount FROM txn
""",
)
def overall_stats(spark, folder):
    df = fraud.overall_stats(txn(spark, folder), COLS)
    return rounded(rounded(df, 2, "total_amount"), 4, "avg_amount")


@query("label_counts", "SELECT CAST(is_fraud AS BIGINT) AS is_fraud, count(*) AS transactions FROM txn GROUP BY is_fraud")
def label_counts(spark, folder):
    return big(fraud.label_counts(txn(spark, folder), COLS))


_SUMMARY = """su AS (SELECT count(*) AS n, count(*) FILTER (is_fraud = 1) AS f, sum(amount) AS a,
             coalesce(sum(amount) FILTER (is_fraud = 1), 0) AS fa,
             coalesce(avg(amount) FILTER (is_fraud = 1), 0) AS avf,
             coalesce(avg(amount) FILTER (is_fraud = 0), 0) AS avl FROM txn)"""
_SUMMARY_ROW = """SELECT n AS total_transactions, f AS fraud_transactions, n - f AS legitimate_transactions,
       round(f * 100.0::DOUBLE / n, 4) AS fraud_rate_percent, round(a, 2) AS total_amount,
       round(fa, 2) AS fraud_amount, round(fa * 100.0::DOUBLE / a, 2) AS amount_at_risk_percent,
       round(avf, 2) AS avg_fraud_transaction, round(avl, 2) AS avg_legitimate_transaction FROM su"""


@query("fraud_summary", f"WITH {_SUMMARY} {_SUMMARY_ROW}")
def fraud_summary(spark, folder):
    return fraud.fraud_summary(txn(spark, folder), COLS)


_RATES = """
r AS (SELECT {key}, count(*) AS total_transactions, count(*) FILTER (is_fraud = 1) AS fraud_count,
       round(count(*) FILTER (is_fraud = 1) * 100.0::DOUBLE / count(*), 4) AS fraud_rate_percent,
       round(sum(amount), 2) AS total_amount,
       round(sum(CASE WHEN is_fraud = 1 THEN amount ELSE 0 END), 2) AS fraud_amount FROM txn GROUP BY {key})
"""


@query("fraud_by_category", f"WITH {_RATES.format(key='category')} SELECT * FROM r")
def fraud_by_category(spark, folder):
    return fraud.fraud_by_category(txn(spark, folder), COLS)


@query(
    "high_risk_categories",
    f"""WITH {_RATES.format(key='category')} SELECT * FROM r
WHERE fraud_rate_percent > (SELECT avg(fraud_rate_percent) FROM r) ORDER BY fraud_rate_percent DESC, category LIMIT 3""",
)
def high_risk_categories(spark, folder):
    return fraud.high_risk_categories(txn(spark, folder), COLS)


@query(
    "dash_categories",
    f"WITH {_RATES.format(key='category')} SELECT * FROM r WHERE total_transactions >= 100",
)
def dash_categories(spark, folder):
    return fraud.fraud_by_category(txn(spark, folder), COLS, min_transactions=100)


def _merchants(top):
    return f"""WITH {_RATES.format(key='merchant_id')}
SELECT CAST(merchant_id AS BIGINT) AS merchant_id, total_transactions, fraud_count, fraud_rate_percent, total_amount FROM r
WHERE total_transactions >= 10 ORDER BY fraud_rate_percent DESC, merchant_id LIMIT {top}"""


@query("top_merchants", _merchants(20))
def top_merchants(spark, folder):
    return big(fraud.risky_merchants(txn(spark, folder), COLS))


@query("dash_top10", _merchants(10))
def dash_top10(spark, folder):
    return big(fraud.risky_merchants(txn(spark, folder), COLS, top=10))


_STATS = "st AS (SELECT avg(amount) AS m, stddev(amount) AS sd FROM txn)"


_PATTERNS = """
SELECT pattern, threshold, occurrences, fraud_count, round(rate, 2)::DOUBLE AS fraud_rate_percent,
       CASE WHEN rate > 5 THEN 'HIGH' WHEN rate > 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM (SELECT *, CASE WHEN occurrences = 0 THEN 0.0 ELSE fraud_count * 100.0::DOUBLE / occurrences END AS rate FROM (
  SELECT 'High-Value Transactions' AS pattern, printf('>$%.2f', (SELECT m + 2 * sd FROM st)) AS threshold,
         count(*) AS occurrences, count(*) FILTER (is_fraud = 1) AS fraud_count
  FROM txn WHERE amount > (SELECT m + 2 * sd FROM st)
  UNION ALL SELECT 'Low-Value Transactions (Card Testing)', '<$5.00', count(*), count(*) FILTER (is_fraud = 1)
  FROM txn WHERE amount < 5
  UNION ALL SELECT 'Round Amount Transactions', 'Divisible by $100', count(*), count(*) FILTER (is_fraud = 1)
  FROM txn WHERE amount % 100 = 0))"""


@query("risk_patterns", f"WITH {_STATS} {_PATTERNS}")
def risk_patterns(spark, folder):
    return fraud.risk_patterns(txn(spark, folder), COLS)


_ODD = f"""{_STATS}, z AS (SELECT *, abs((amount - (SELECT m FROM st)) / (SELECT sd FROM st)) AS z_score FROM txn),
 a AS (SELECT * FROM z WHERE z_score > 3)"""


_ANOMALIES = f"""WITH {_ODD}
SELECT 'Z-Score > 3' AS detection_method, (SELECT round(m, 2) FROM st) AS mean_amount, (SELECT round(sd, 2) FROM st) AS std_amount,
       (SELECT round(m + 3 * sd, 2) FROM st) AS threshold_amount, count(*) AS total_anomalies,
       count(*) FILTER (is_fraud = 1) AS fraudulent_anomalies,
       round(count(*) FILTER (is_fraud = 1) * 100.0::DOUBLE / count(*), 2) AS anomaly_fraud_rate_percent FROM a
"""


@query("anomaly_summary", _ANOMALIES)
def anomaly_summary(spark, folder):
    return fraud.anomaly_summary(txn(spark, folder), COLS)


@query(
    "anomaly_top10",
    f"""WITH {_ODD} SELECT transaction_id, amount, rnd(z_score, 4) AS z_score, CAST(is_fraud AS BIGINT) AS is_fraud, category
FROM a ORDER BY a.z_score DESC, transaction_id LIMIT 10""",
)
def anomaly_top10(spark, folder):
    return pick(fraud.top_anomalies(txn(spark, folder), COLS), "*")


@query(
    "anomaly_split",
    f"""WITH {_ODD} SELECT 'Fraudulent' AS kind, count(*) FILTER (is_fraud = 1) AS n FROM a
UNION ALL SELECT 'Legitimate', count(*) FILTER (is_fraud <> 1) FROM a""",
)
def anomaly_split(spark, folder):
    return fraud.anomaly_split(txn(spark, folder), COLS)


_TIME = """
t AS (SELECT {key} AS {name}, count(*) AS total, count(*) FILTER (is_fraud = 1) AS fraud_count,
       round(count(*) FILTER (is_fraud = 1) * 100.0::DOUBLE / count(*), 2) AS fraud_rate FROM txn GROUP BY 1)"""
_HOUR = _TIME.format(key="hour(txn_ts)", name="hour")
_DAY = _TIME.format(key="dayofweek(txn_ts) + 1", name="day_of_week")
_DAY_NAME = """['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday'][day_of_week] AS day"""


@query("fraud_by_hour", f"WITH {_HOUR} SELECT * FROM t")
def fraud_by_hour(spark, folder):
    return big(fraud.fraud_by_hour(txn(spark, folder), COLS))


@query("fraud_by_weekday", f"WITH {_DAY} SELECT *, {_DAY_NAME} FROM t")
def fraud_by_weekday(spark, folder):
    return big(fraud.fraud_by_weekday(txn(spark, folder), COLS))


@query("peak_hours", f"WITH {_HOUR} SELECT * FROM t ORDER BY fraud_rate DESC, hour LIMIT 3")
def peak_hours(spark, folder):
    return big(fraud.peak_hours(txn(spark, folder), COLS))


@query("peak_days", f"WITH {_DAY} SELECT *, {_DAY_NAME} FROM t ORDER BY fraud_rate DESC, day_of_week LIMIT 2")
def peak_days(spark, folder):
    return big(fraud.peak_days(txn(spark, folder), COLS))


def _renamed(cte: str, old: str, new: str) -> str:
    return cte.strip().replace(f"{old} AS (", f"{new} AS (", 1)


_FINDINGS = f"""
WITH {_SUMMARY}, s AS ({_SUMMARY_ROW}), {_renamed(_RATES.format(key='category'), 'r', 'rc')},
 {_renamed(_RATES.format(key='merchant_id'), 'r', 'rm')}, {_renamed(_HOUR, 't', 'th')}, {_renamed(_DAY, 't', 'td')},
 {_ODD}, pat AS ({_PATTERNS}),
 anomalies AS (SELECT count(*) AS n, count(*) FILTER (is_fraud = 1) AS f,
   round(count(*) FILTER (is_fraud = 1) * 100.0::DOUBLE / count(*), 2) AS rate,
   (SELECT round(m + 3 * sd, 2) FROM st) AS threshold FROM a),
 c3 AS (SELECT *, row_number() OVER (ORDER BY fraud_rate_percent DESC, category) AS i FROM rc
   WHERE fraud_rate_percent > (SELECT avg(fraud_rate_percent) FROM rc)),
 m5 AS (SELECT *, row_number() OVER (ORDER BY fraud_rate_percent DESC, merchant_id) AS i FROM rm WHERE total_transactions >= 10),
 h3 AS (SELECT *, row_number() OVER (ORDER BY fraud_rate DESC, hour) AS i FROM th),
 d2 AS (SELECT *, {_DAY_NAME}, row_number() OVER (ORDER BY fraud_rate DESC, day_of_week) AS i FROM td)
SELECT 'executive_summary' AS section, 1::BIGINT AS rank,
  printf('Fraud rate %.2f%% is above the 1%% threshold', fraud_rate_percent) AS message FROM s WHERE fraud_rate_percent > 1
UNION ALL SELECT 'executive_summary', 2, printf('Average fraud is $%.2f', avg_fraud_transaction)
  || CASE WHEN avg_legitimate_transaction > 0 THEN printf(', %.1fx the legitimate average',
     avg_fraud_transaction / avg_legitimate_transaction) ELSE '' END
  FROM s WHERE avg_fraud_transaction > 2 * avg_legitimate_transaction
UNION ALL SELECT 'fraud_by_category', i, printf('Category %s: %.2f%% fraud, $%.2f at risk', category, fraud_rate_percent, fraud_amount)
  FROM c3 WHERE i <= 3
UNION ALL SELECT 'fraud_by_merchant', i, printf('Merchant %s: %d frauds (%.2f%%)', merchant_id::VARCHAR, fraud_count, fraud_rate_percent)
  FROM m5 WHERE i <= 5 AND fraud_count > 0
UNION ALL SELECT 'high_risk_patterns', CASE WHEN pattern LIKE 'High%' THEN 1 WHEN pattern LIKE 'Low%' THEN 2 ELSE 3 END,
  printf('%s: %.2f%% fraud, %s risk', pattern, fraud_rate_percent, risk_level) FROM pat WHERE risk_level <> 'LOW'
UNION ALL SELECT 'anomalies', 1, printf('%d anomalies are fraud (%.1f%%)', f, rate) FROM anomalies WHERE rate > 10
UNION ALL SELECT 'anomalies', 2, printf('Alert above $%.2f', threshold) FROM anomalies WHERE n > 0
UNION ALL SELECT 'time_trends', 1, printf('Peak hours: %s (%.2f%% fraud)', string_agg(hour::VARCHAR, ', ' ORDER BY i), max(fraud_rate))
  FROM h3 WHERE i <= 3
UNION ALL SELECT 'time_trends', 2, printf('High-risk days: %s', string_agg(day, ', ' ORDER BY i)) FROM d2 WHERE i <= 2
"""


@query("findings", _FINDINGS)
def findings(spark, folder):
    return big(fraud.findings(txn(spark, folder), COLS))


_SUMMARIES = f"""WITH {_ODD}, {_RATES.format(key='category')}, p AS ({_PATTERNS}),
m AS (SELECT merchant_id, count(*) AS n, count(*) FILTER (is_fraud = 1) AS f FROM txn GROUP BY merchant_id),
k AS (SELECT * FROM m WHERE n >= 10 ORDER BY round(f * 100.0::DOUBLE / n, 4) DESC, merchant_id LIMIT 20),
h AS (SELECT hour(txn_ts) AS hr, round(count(*) FILTER (is_fraud = 1) * 100.0::DOUBLE / count(*), 2) AS rate FROM txn GROUP BY 1),
e AS (SELECT count(*) FILTER (is_fraud = 1) AS f, round(count(*) FILTER (is_fraud = 1) * 100.0::DOUBLE / count(*), 4) AS rate,
  round(sum(CASE WHEN is_fraud = 1 THEN amount ELSE 0 END), 2) AS lost FROM txn),
o AS (SELECT count(*) AS n, count(*) FILTER (is_fraud = 1) AS f,
  round(count(*) FILTER (is_fraud = 1) * 100.0::DOUBLE / count(*), 2) AS rate FROM a)
SELECT 'executive_summary' AS section, 'Executive Summary' AS name,
  format('Detected {{:,}} fraudulent transactions ({{:.2f}}%) totaling ${{:,.2f}}', f, rate, lost) AS summary FROM e
UNION ALL SELECT 'fraud_by_category', 'Fraud by Category', format('Analyzed {{}} categories. Highest risk: {{}}',
  count(*), arg_min(category, (-fraud_rate_percent, category))) FROM r
UNION ALL SELECT 'fraud_by_merchant', 'Top 20 High-Risk Merchants', format('Identified {{}} merchants with fraud activity',
  count(*) FILTER (f > 0)) FROM k
UNION ALL SELECT 'high_risk_patterns', 'High-Risk Transaction Patterns', format('Analyzed {{}} transaction patterns', count(*)) FROM p
UNION ALL SELECT 'anomalies', 'Anomaly Detection', format('Detected {{:,}} statistical anomalies, {{}} are fraud ({{:.1f}}%)', n, f, rate) FROM o
UNION ALL SELECT 'fraud_by_hour', 'Time-Based Fraud Trends', format('Peak fraud hour: {{}}:00', arg_min(hr, (-rate, hr))) FROM h
"""


# Key and numbers of each section as published.
_PUBLISHED = {
    "executive_summary": (None, ("total_transactions", "fraud_transactions", "legitimate_transactions", "fraud_rate_percent",
        "total_amount", "fraud_amount", "amount_at_risk_percent", "avg_fraud_transaction", "avg_legitimate_transaction")),
    "fraud_by_category": ("category", ("total_transactions", "fraud_count", "total_amount", "fraud_amount", "fraud_rate_percent")),
    "fraud_by_merchant": ("merchant_id", ("total_transactions", "fraud_count", "total_amount", "fraud_rate_percent")),
    "high_risk_patterns": ("pattern", ("occurrences", "fraud_count", "fraud_rate_percent")),
    "anomalies": ("detection_method", ("mean_amount", "std_amount", "threshold_amount", "total_anomalies",
        "fraudulent_anomalies", "anomaly_fraud_rate_percent")),
    "anomaly_examples": ("transaction_id", ("amount", "z_score", "is_fraud")),
    "fraud_by_hour": ("hour", ("total", "fraud_count", "fraud_rate")),
    "fraud_by_weekday": ("day_of_week", ("total", "fraud_count", "fraud_rate")),
    "findings": ("message", ("rank",)),
    "summaries": ("summary", ()),
}


def _published(section: str, source: str) -> str:
    key, numbers = _PUBLISHED[section]
    item = "''" if key is None else f"CAST({key} AS VARCHAR)"
    names = ", ".join(f"'{n}'" for n in numbers) or "'text'"
    values = ", ".join(f"CAST({n} AS DOUBLE)" for n in numbers) or "CAST(NULL AS DOUBLE)"
    return (
        f"SELECT section, item, measure, rnd(value, 4) AS value FROM (SELECT '{section}' AS section, {item} AS item, "
        f"unnest([{names}]) AS measure, unnest([{values}]) AS value FROM {source})"
    )


def _report_sql() -> str:
    sources = {
        "executive_summary": f"(WITH {_SUMMARY} {_SUMMARY_ROW})",
        "fraud_by_category": f"(WITH {_RATES.format(key='category')} SELECT * FROM r)",
        "fraud_by_merchant": f"({_merchants(20)})",
        "high_risk_patterns": f"(WITH {_STATS} {_PATTERNS})",
        "anomalies": f"({_ANOMALIES})",
        "anomaly_examples": f"(WITH {_ODD} SELECT * FROM a ORDER BY z_score DESC, transaction_id LIMIT 10)",
        "fraud_by_hour": f"(WITH {_HOUR} SELECT * FROM t)",
        "fraud_by_weekday": f"(WITH {_DAY} SELECT * FROM t)",
        "findings": f"({_FINDINGS})",
        "summaries": f"({_SUMMARIES})",
    }
    return " UNION ALL ".join(_published(section, source) for section, source in sources.items())


@query("report_json", _report_sql())
def report_json(spark, folder):
    """All sections written as JSON datasets and read back: their numbers and sentences."""
    from functools import reduce

    from pyspark.sql import DataFrame

    from swipelake.scratch import scratch_path
    from swipelake.sources.files import read_json

    path = scratch_path(spark, "report")
    sections = fraud.report(txn(spark, folder), COLS)
    fraud.write_report(sections, path)
    made = []
    for name, frame in sections.items():
        key, numbers = _PUBLISHED[name]
        item = F.lit("") if key is None else F.col(key).cast("string")
        values = [(n, F.col(n).cast("double")) for n in numbers] or [("text", F.lit(None).cast("double"))]
        pairs = F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), v.alias("value")) for n, v in values]))
        read = read_json(spark, f"{path}/{name}", schema=frame.schema)
        made.append(read.select(F.lit(name).alias("section"), item.alias("item"), pairs))
    return rounded(reduce(DataFrame.unionByName, made), 4)


@query(
    "report_summaries",
    _SUMMARIES,
)
def report_summaries(spark, folder):
    """The sentences as written with the report."""
    from swipelake.scratch import scratch_path
    from swipelake.sources.files import read_json

    path = scratch_path(spark, "report")
    sections = fraud.report(txn(spark, folder), COLS)
    fraud.write_report({"summaries": sections["summaries"]}, path)
    return read_json(spark, f"{path}/summaries", schema=sections["summaries"].schema)


# ---- geography ------------------------------------------------------------------------------


def _hav(lat1, lon1, lat2, lon2):
    return (
        f"2 * 6371 * asin(sqrt(least(1, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) "
        f"+ cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"
    )


_GEO = f"""
h AS (SELECT customer_id, quantile_disc(lat, 0.5) AS mlat, quantile_disc(lon, 0.5) AS mlon,
        arg_min(state, (txn_ts, transaction_id)) AS home FROM txn GROUP BY customer_id),
g AS (SELECT t.*, mlat, mlon, home, {_hav('lat', 'lon', 'merch_lat', 'merch_lon')} AS km,
        {_hav('mlat', 'mlon', 'lat', 'lon')} AS home_km FROM txn t JOIN h ON h.customer_id IS NOT DISTINCT FROM t.customer_id),
b AS (SELECT *, CASE WHEN km < 5 THEN 'local' WHEN km < 25 THEN 'nearby' WHEN km < 100 THEN 'regional'
        WHEN km < 500 THEN 'distant' ELSE 'very_distant' END AS distance_bucket,
        CASE WHEN home_km > 200 THEN 1 ELSE 0 END::BIGINT AS is_unusual_location FROM g)
"""


@query(
    "geo_distance",
    f"""WITH {_GEO} SELECT transaction_id, rnd(km, 4) AS transaction_distance_km, mlat AS customer_median_lat,
 mlon AS customer_median_long, rnd(home_km, 4) AS distance_from_home_km FROM b""",
)
def geo_distance(spark, folder):
    return pick(
        geography.geographic_features(txn(spark, folder), COLS),
        "transaction_id",
        "transaction_distance_km",
        "customer_median_lat",
        "customer_median_long",
        "distance_from_home_km",
    )


@query("geo_bucket", f"WITH {_GEO} SELECT transaction_id, distance_bucket, is_unusual_location FROM b")
def geo_bucket(spark, folder):
    df = geography.geographic_features(txn(spark, folder), COLS)
    return pick(df, "transaction_id", "distance_bucket", "is_unusual_location")


@query(
    "geo_bucket_hot_keys",
    f"WITH {_GEO} SELECT transaction_id, distance_bucket, is_unusual_location FROM b",
)
def geo_bucket_hot_keys(spark, folder):
    base = txn(spark, folder)
    df = geography.geographic_features(base, COLS, rows_per_task=CUT_ROWS)
    return pick(df, "transaction_id", "distance_bucket", "is_unusual_location")


@query(
    "geo_home_state",
    f"""WITH {_GEO} SELECT transaction_id, home AS customer_home_state,
 CASE WHEN state <> home THEN 1 ELSE 0 END::BIGINT AS is_out_of_state FROM b""",
)
def geo_home_state(spark, folder):
    df = geography.geographic_features(placed(spark, folder), COLS)
    return pick(df, "transaction_id", "customer_home_state", "is_out_of_state")


@query(
    "geo_hotspots",
    """
SELECT state, count(*) AS total_transactions, count(*) FILTER (is_fraud = 1) AS fraud_count,
       round(avg(is_fraud) * 100, 2) AS fraud_rate_percent FROM txn GROUP BY state HAVING count(*) >= 100
ORDER BY avg(is_fraud) DESC, state NULLS FIRST LIMIT 10
""",
)
def geo_hotspots(spark, folder):
    return geography.fraud_hotspots(placed(spark, folder), COLS)


@query(
    "geo_distance_risk",
    f"""WITH {_GEO} SELECT distance_bucket, count(*) AS total_transactions, count(*) FILTER (is_fraud = 1) AS fraud_count,
 round(count(*) FILTER (is_fraud = 1)::DOUBLE / count(*) * 100, 2) AS fraud_rate_percent FROM b GROUP BY distance_bucket""",
)
def geo_distance_risk(spark, folder):
    df = geography.geographic_features(txn(spark, folder), COLS)
    return geography.distance_risk(df, COLS)


@query(
    "geo_unusual",
    f"""WITH {_GEO} SELECT count(*) AS unusual_count, round(coalesce(avg(is_fraud), 0) * 100, 2) AS fraud_rate_percent
FROM b WHERE is_unusual_location = 1""",
)
def geo_unusual(spark, folder):
    df = geography.geographic_features(txn(spark, folder), COLS)
    return geography.unusual_locations(df, COLS)


@query(
    "geo_summary",
    f"""WITH {_GEO}, s5 AS (SELECT 'hotspots' AS section, state AS name, count(*) AS total_transactions,
   count(*) FILTER (is_fraud = 1) AS fraud_count, round(avg(is_fraud) * 100, 2) AS fraud_rate_percent
 FROM txn GROUP BY state HAVING count(*) >= 100 ORDER BY avg(is_fraud) DESC, state NULLS FIRST LIMIT 5)
SELECT * FROM s5 UNION ALL SELECT 'distance', distance_bucket, count(*), count(*) FILTER (is_fraud = 1),
 round(count(*) FILTER (is_fraud = 1)::DOUBLE / count(*) * 100, 2) FROM b GROUP BY distance_bucket""",
)
def geo_summary(spark, folder):
    """All three geographic answers as (section, name, rows, frauds, rate) rows."""
    base = placed(spark, folder)
    df = geography.geographic_features(base, COLS)
    five = geography.fraud_hotspots(base, COLS, top=5)
    risk = geography.distance_risk(df, COLS)
    names = ("total_transactions", "fraud_count", "fraud_rate_percent")
    return five.select(F.lit("hotspots").alias("section"), F.col("state").alias("name"), *names).unionByName(
        risk.select(F.lit("distance").alias("section"), F.col("distance_bucket").alias("name"), *names)
    )
