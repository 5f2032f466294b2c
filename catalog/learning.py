"""Segments and the classifier."""

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.base import COLS, big, pick, query, rounded, txn
from swipelake.plans import features, geography, model, segments
from swipelake.scratch import written

_METRICS = """
c AS (SELECT customer_id, count(*) AS txn_count, sum(amount) AS total_amount, avg(amount) AS avg_amount,
  max(amount) AS max_amount, min(amount) AS min_amount, coalesce(stddev(amount), 0) AS std_amount,
  count(DISTINCT merchant_id) AS unique_merchants, count(*) FILTER (is_fraud = 1) AS fraud_count,
  count(*) FILTER (hour(txn_ts) >= 22 OR hour(txn_ts) <= 5) AS night_txn_count,
  count(*) FILTER (dayofweek(txn_ts) IN (0, 6)) AS weekend_txn_count,
  count(*) FILTER (is_fraud = 1)::DOUBLE / count(*) AS fraud_rate FROM txn GROUP BY customer_id)
"""


def _metrics(spark, folder):
    return segments.segment_metrics(features.time_features(txn(spark, folder), COLS), COLS)


@query(
    "segment_metrics",
    f"""WITH {_METRICS} SELECT customer_id, txn_count, rnd(total_amount, 2) AS total_amount, rnd(avg_amount, 4) AS avg_amount,
 max_amount, min_amount, rnd(std_amount, 4) AS std_amount, unique_merchants, fraud_count, night_txn_count,
 weekend_txn_count, rnd(fraud_rate, 4) AS fraud_rate FROM c""",
)
def segment_metrics(spark, folder):
    df = rounded(_metrics(spark, folder), 2, "total_amount")
    return rounded(df, 4, "avg_amount", "std_amount", "fraud_rate")


@query("segments")
def customer_segments(spark, folder):
    df = features.time_features(txn(spark, folder), COLS)
    made = segments.customer_segments(df, COLS)
    return made.select("customer_id", "segment", "txn_count", "avg_amount", "fraud_rate")


@query(
    "segment_profiles",
    f"""
WITH {_METRICS}, a AS (SELECT *, (customer_id % 3 + CASE WHEN fraud_count > txn_count * 0.15 THEN 10 ELSE 0 END
     + CASE WHEN avg_amount > 60 THEN 20 ELSE 0 END)::BIGINT AS segment FROM c),
 w AS (SELECT avg(avg_amount) AS wa, avg(txn_count) AS wt, avg(fraud_rate) AS wf FROM a),
 s AS (SELECT segment, count(*) AS n, avg(avg_amount) AS sa, avg(txn_count) AS st, avg(fraud_rate) AS sf FROM a GROUP BY segment)
SELECT segment AS segment_id, CASE WHEN sf > wf * 2 THEN 'High-Risk Segment' WHEN sa > wa * 1.5 THEN 'Premium Customers'
   WHEN st > wt * 1.5 THEN 'Frequent Buyers' WHEN sa < wa * 0.5 THEN 'Budget Customers' ELSE 'Standard Customers' END AS segment_name,
 n AS customer_count, round(sa, 2) AS avg_transaction_amount, round(st, 2) AS avg_transaction_count,
 round(sf * 100, 4) AS fraud_rate_percent, CASE WHEN sf > wf * 2 THEN 'HIGH' WHEN sf > wf THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 concat_ws(', ', CASE WHEN sa > wa * 1.5 THEN 'High spenders' WHEN sa < wa * 0.5 THEN 'Low spenders' ELSE 'Average spenders' END,
   CASE WHEN st > wt * 1.5 THEN 'High frequency' WHEN st < wt * 0.5 THEN 'Low frequency' END,
   CASE WHEN sf > wf * 2 THEN 'High fraud exposure' END) AS characteristics
FROM s CROSS JOIN w
""",
)
def segment_profiles(spark, folder):
    """Profiles of a fixed assignment."""
    fixed = (
        F.col("customer_id") % 3
        + F.when(F.col("fraud_count") > F.col("txn_count") * 0.15, 10).otherwise(0)
        + F.when(F.col("avg_amount") > 60, 20).otherwise(0)
    )
    return segments.segment_profiles(_metrics(spark, folder).withColumn("segment", fixed))


@query("segment_profiles_fitted")
def segment_profiles_fitted(spark, folder):
    df = features.time_features(txn(spark, folder), COLS)
    return segments.segment_profiles(segments.customer_segments(df, COLS))


@query(
    "kmeans_nearest",
    "SELECT 0::BIGINT AS misplaced, count(DISTINCT user_id) AS customers, 4::BIGINT AS most_segments FROM events",
)
def kmeans_nearest(spark, folder):
    """Customers that do not sit at their nearest centre, and customers over all segments."""
    metrics = written(_metrics(spark, folder), "segment-metrics")
    fitted = segments.fit_segments(metrics)
    assigned = fitted.transform(metrics).withColumn("at", vector_to_array("features"))

    def distance(centre):
        parts = [(F.col("at")[i] - F.lit(float(c))) ** 2 for i, c in enumerate(centre)]
        return reduce(lambda a, b: a + b, parts)

    to = F.array(*[distance(c) for c in fitted.stages[-1].clusterCenters()])
    off = F.count_if(to[F.col("segment")] > F.array_min(to) + 1e-9)
    sizes = assigned.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), off.alias("off"))
    return sizes.agg(
        F.sum("off").alias("misplaced"),
        F.sum("n").alias("customers"),
        F.greatest(F.lit(4), F.count(F.lit(1))).cast("long").alias("most_segments"),
    )


# ---- classifier -------------------------------------------------------------------------------


def _model_rows(spark, folder):
    df = geography.geographic_features(txn(spark, folder), COLS)
    return features.all_features(df, COLS)


@query(
    "ml_prepare",
    """
SELECT transaction_id, coalesce(amount, 0) AS amount, CAST(coalesce(merchant_id, 0) AS BIGINT) AS merchant_id,
       CASE WHEN transaction_id % 50 = 0 THEN 1 ELSE 0 END::BIGINT AS is_fraud FROM holes
""",
)
def ml_prepare(spark, folder):
    from catalog.base import holes

    label = F.when(F.col("transaction_id") % 50 == 0, "1").otherwise("0")
    df = holes(spark, folder).withColumn("is_fraud", label)
    inputs = model.ModelInputs.of(df, COLS, ["amount", "merchant_id", "absent"])
    return pick(model.prepare(df, inputs), "transaction_id", "amount", "merchant_id", "is_fraud")


@query(
    "ml_split",
    """
SELECT transaction_id, is_fraud::BIGINT AS is_fraud,
  ('0x' || substr(md5('42:split:' || is_fraud || ':' || transaction_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 AS is_test
FROM txn
""",
)
def ml_split(spark, folder):
    df = model.with_split(txn(spark, folder), "transaction_id", "is_fraud")
    return big(df.select("transaction_id", "is_fraud", "is_test"))


def _trained(spark, folder):
    df = _model_rows(spark, folder)
    inputs = model.ModelInputs.of(df, COLS)
    train, test = model.split(model.prepare(df, inputs), "transaction_id", "is_fraud")
    return model.train(train, inputs), train, test, inputs


@query("ml_train_score")
def ml_train_score(spark, folder):
    fitted, _, test, inputs = _trained(spark, folder)
    return model.score(fitted, test, inputs).select("transaction_id", "is_fraud", "prediction")


@query("ml_model_summary")
def ml_model_summary(spark, folder):
    fitted, train, test, inputs = _trained(spark, folder)
    return model.model_summary(fitted, train, test, inputs)


@query(
    "ml_metrics",
    """
WITH s AS (SELECT is_fraud AS label, floor(amount / 5) AS score, CASE WHEN amount > 100 THEN 1 ELSE 0 END AS said,
  ('0x' || substr(md5('42:split:' || is_fraud || ':' || transaction_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 AS is_test FROM txn),
g AS (SELECT score, count(*) FILTER (label = 1)::DOUBLE AS p, count(*) FILTER (label = 0)::DOUBLE AS n FROM s WHERE is_test GROUP BY score),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM g WINDOW w AS (ORDER BY score DESC)),
a AS (SELECT sum(n * (tp - p / 2)) / max(ap * an) AS roc, sum(p / ap * (tp / (tp + fp)
  + CASE WHEN tp - p + fp - n > 0 THEN (tp - p) / (tp - p + fp - n) ELSE tp / (tp + fp) END) / 2) AS pr, sum(p / ap * tp / (tp + fp)) AS mean FROM c),
m AS (SELECT count(*) FILTER (label = 1 AND said = 1)::DOUBLE AS tp, count(*) FILTER (label = 0 AND said = 1)::DOUBLE AS fp,
  count(*) FILTER (label = 0 AND said = 0)::DOUBLE AS tn, count(*) FILTER (label = 1 AND said = 0)::DOUBLE AS fn FROM s WHERE is_test),
d AS (SELECT *, tp + fp + tn + fn AS n, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0 FROM m)
SELECT 'metrics' AS section, unnest(['auc_roc', 'auc_pr', 'average_precision', 'true_positive', 'false_positive', 'true_negative',
  'false_negative', 'accuracy', 'precision', 'recall', 'f1_score']) AS name, unnest([rnd(roc, 6), rnd(pr, 6), rnd(mean, 6), tp, fp, tn, fn,
  rnd((tp + tn) / n, 6), rnd(((tp + fn) * p1 + (tn + fp) * p0) / n, 6), rnd(((tp + fn) * r1 + (tn + fp) * r0) / n, 6),
  rnd(((tp + fn) * 2 * p1 * r1 / (p1 + r1) + (tn + fp) * 2 * p0 * r0 / (p0 + r0)) / n, 6)]) AS "value" FROM a, d
UNION ALL SELECT 'rows', 'train_rows', count(*) FILTER (NOT is_test)::DOUBLE FROM s
UNION ALL SELECT 'rows', 'test_rows', count(*) FILTER (is_test)::DOUBLE FROM s
""",
)
def ml_metrics(spark, folder):
    """The summary of a fixed score and rule, so that SQL can tell every figure."""
    train, test = model.split(txn(spark, folder), "transaction_id", "is_fraud")
    said = F.when(F.col("amount") > 100, 1).otherwise(0).alias("prediction")
    predictions = test.select("is_fraud", F.floor(F.col("amount") / 5).alias("score"), said)
    return rounded(model.summary_rows(predictions, None, train), 6)


@query(
    "ml_vocabulary",
    """
WITH v AS (SELECT 'merchant_id' AS feature, merchant_id::VARCHAR AS value FROM txn
  UNION ALL SELECT 'device_type', device_type FROM txn UNION ALL SELECT 'customer_id', customer_id::VARCHAR FROM txn)
SELECT feature, value, count(*) AS rows FROM v WHERE value IS NOT NULL GROUP BY feature, value
QUALIFY row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) <= 31
""",
)
def ml_vocabulary(spark, folder):
    """The category values that a forest of 32 bins keeps."""
    return model.category_vocabulary(txn(spark, folder), ["merchant_id", "device_type", "customer_id"], 31)


@query(
    "ml_scored_ids",
    """
SELECT transaction_id FROM txn
WHERE ('0x' || substr(md5('42:split:' || is_fraud || ':' || transaction_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2
""",
)
def ml_scored_ids(spark, folder):
    """Every row of the test side gets a prediction of 0 or 1."""
    fitted, _, test, inputs = _trained(spark, folder)
    return model.score(fitted, test, inputs).filter("prediction IN (0.0, 1.0)").select("transaction_id")


def _rule_trained(spark, folder):
    """A label that the one feature decides."""
    flag = (F.col("amount") > 100).cast("int")
    df = txn(spark, folder).select("transaction_id", "amount", flag.alias("flag"), flag.alias("is_fraud"))
    inputs = model.ModelInputs(("flag",), ())
    train, test = model.split(model.prepare(df, inputs), "transaction_id", "is_fraud")
    return model.train(train, inputs), test, inputs


_RULE_TEST = """
t AS (SELECT transaction_id, CASE WHEN amount > 100 THEN 1 ELSE 0 END AS label FROM txn),
s AS (SELECT *, ('0x' || substr(md5('42:split:' || label || ':' || transaction_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2
 AS is_test FROM t)"""


@query(
    "ml_rule_predictions",
    f"WITH {_RULE_TEST} SELECT transaction_id, label::DOUBLE AS prediction FROM s WHERE is_test",
)
def ml_rule_predictions(spark, folder):
    fitted, test, inputs = _rule_trained(spark, folder)
    return model.score(fitted, test, inputs).select("transaction_id", "prediction")


@query(
    "ml_rule_metrics",
    f"""WITH {_RULE_TEST}, c AS (SELECT count(*) FILTER (label = 1)::DOUBLE AS p, count(*) FILTER (label = 0)::DOUBLE AS n FROM s WHERE is_test)
SELECT unnest(['auc_roc', 'auc_pr', 'average_precision', 'true_positive', 'false_positive', 'true_negative', 'false_negative', 'accuracy',
  'precision', 'recall', 'f1_score']) AS metric, unnest([1.0, 1.0, 1.0, p, 0.0, n, 0.0, 1.0, 1.0, 1.0, 1.0]::DOUBLE[]) AS "value" FROM c""",
)
def ml_rule_metrics(spark, folder):
    fitted, test, inputs = _rule_trained(spark, folder)
    return rounded(model.evaluate(fitted, test, inputs), 6)


_MATRIX = """
m AS (SELECT count(*) FILTER (is_fraud = 1 AND amount > 100) AS true_positive,
  count(*) FILTER (is_fraud = 0 AND amount > 100) AS false_positive,
  count(*) FILTER (is_fraud = 0 AND NOT amount > 100) AS true_negative,
  count(*) FILTER (is_fraud = 1 AND NOT amount > 100) AS false_negative FROM txn)"""


def _ruled(spark, folder):
    said = (F.col("amount") > 100).cast("double")
    return model.confusion_matrix(txn(spark, folder).withColumn("prediction", said))


@query("confusion_matrix", f"WITH {_MATRIX} SELECT * FROM m")
def confusion_matrix(spark, folder):
    """Of a fixed rule's predictions."""
    return _ruled(spark, folder)


@query(
    "class_metrics",
    f"""WITH {_MATRIX}, d AS (SELECT true_positive::DOUBLE AS tp, false_positive::DOUBLE AS fp, true_negative::DOUBLE AS tn,
   false_negative::DOUBLE AS fn, m.* FROM m),
 s AS (SELECT *, tp + fp + tn + fn AS n, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0 FROM d)
SELECT true_positive, false_positive, true_negative, false_negative, rnd((tp + tn) / n, 6) AS accuracy,
 rnd(((tp + fn) * p1 + (tn + fp) * p0) / n, 6) AS "precision", rnd(((tp + fn) * r1 + (tn + fp) * r0) / n, 6) AS recall,
 rnd(((tp + fn) * 2 * p1 * r1 / (p1 + r1) + (tn + fp) * 2 * p0 * r0 / (p0 + r0)) / n, 6) AS f1_score FROM s""",
)
def class_metrics(spark, folder):
    return rounded(model.class_metrics(_ruled(spark, folder)), 6)
