"""Features, fraud reports, geography, quality, segments and model on small fixtures."""

import math
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swipelake.columns import DEFAULT_COLUMNS, MissingColumnError, TxnColumns
from swipelake.operators import quality as dq
from swipelake.plans import features, fraud, geography, model, segments
from swipelake.plans.cube import cube
from swipelake.skew import ROWS_PER_TASK
from swipelake.sources.synthetic import generated

COLS = DEFAULT_COLUMNS


@pytest.fixture(scope="module")
def made(spark):
    df = generated(spark, 3000, 4, customers=40, merchants=30, seed=7)
    # Half of all rows on one customer and a third on one merchant.
    i = F.substring("transaction_id", 5, 10).cast("int")
    df = df.withColumn("customer_id", F.when(i % 2 == 0, "CUST_000001").otherwise(F.col("customer_id")))
    df = df.withColumn("merchant_id", F.when(i % 3 == 0, "MERCH_00001").otherwise(F.col("merchant_id")))
    return df.cache()


def by_id(df):
    return {r["transaction_id"]: r.asDict() for r in df.collect()}


def test_features_brute_force(made):
    got = by_id(features.all_features(made, COLS))
    rows = sorted(got.values(), key=lambda r: (r["customer_id"], r["transaction_time"], r["transaction_id"]))
    amounts = [r["amount"] for r in rows]
    mean, sd = statistics.mean(amounts), statistics.stdev(amounts)
    per_merchant = {}
    for r in rows:
        per_merchant.setdefault(r["merchant_id"], []).append(r)
    number, before = {}, {}
    import datetime

    for r in rows:
        at = datetime.datetime.fromisoformat(r["transaction_time"])
        number[r["customer_id"]] = number.get(r["customer_id"], 0) + 1
        assert r["txn_number"] == number[r["customer_id"]]
        gap = before.get(r["customer_id"])
        expected = None if gap is None else int((at - gap).total_seconds())
        assert r["seconds_since_last_txn"] == expected
        before[r["customer_id"]] = at
        assert r["hour"] == at.hour and r["day_of_week"] == at.isoweekday() % 7 + 1
        assert r["is_night"] == int(at.hour >= 22 or at.hour <= 5)
        assert r["amount_zscore"] == pytest.approx((r["amount"] - mean) / sd)
        assert r["log_amount"] == pytest.approx(math.log1p(r["amount"]))
        same = per_merchant[r["merchant_id"]]
        assert r["merchant_txn_count"] == len(same)
        rate = sum(s["is_fraud"] for s in same) / len(same)
        assert r["merchant_fraud_rate"] == pytest.approx(rate)
        assert r["merchant_risk_tier"] == ("high" if rate > 0.02 else "medium" if rate > 0.005 else "low")
    assert len(features.feature_names()) == 24
    assert features.all_features(made, COLS).columns == [*made.columns, *features.feature_names()]


def test_features_hot_customer(made):
    plain = by_id(features.all_features(made, COLS, rows_per_task=ROWS_PER_TASK))
    cut = by_id(features.all_features(made, COLS, rows_per_task=100))
    assert plain.keys() == cut.keys()
    for key, row in plain.items():
        for name, value in row.items():
            if isinstance(value, float):
                assert cut[key][name] == pytest.approx(value, rel=1e-9), name
            else:
                assert cut[key][name] == value, name


def test_merchant_join_of_large_input(made, monkeypatch):
    """Statistics beyond the broadcast limit, and salted hot merchants."""
    from swipelake.operators import joins

    plain = by_id(features.merchant_features(made, COLS))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    assert by_id(features.merchant_features(made, COLS)) == plain
    counts = joins.count_hot_keys
    monkeypatch.setattr(joins, "count_hot_keys", lambda s, k, r, _: counts(s, k, r, 200))
    assert by_id(features.merchant_features(made, COLS)) == plain


def test_feature_plan(made):
    """One shuffle per key, one sort per customer pass, no Python, no cross join."""
    plan = features.all_features(made, COLS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(customer_id") == 1
    assert plan.count("Sort [customer_id") == 1
    for word in ("EvalPython", "CartesianProduct", "NestedLoopJoin"):
        assert word not in plan


def test_missing_column(sample):
    with pytest.raises(MissingColumnError, match="cc_num"):
        features.all_features(sample, TxnColumns(customer="cc_num"))


def test_label_rows(made):
    past = made.filter(F.col("is_fraud") == 0)
    got = features.merchant_features(made, COLS, label_rows=past)
    assert got.agg(F.max("merchant_fraud_rate")).first()[0] == 0.0
    assert got.count() == made.count()


# ---- reports ----------------------------------------------------------------------------------


def test_summary_of_sample(sample):
    one = fraud.fraud_summary(sample, COLS).first()
    assert one["total_transactions"] == 5 and one["fraud_transactions"] == 1
    assert one["fraud_rate_percent"] == 20.0
    assert one["total_amount"] == 2305.49 and one["fraud_amount"] == 1500.0
    assert one["amount_at_risk_percent"] == 65.06
    assert one["avg_legitimate_transaction"] == 201.37


def test_category_of_sample(sample):
    rates = {r["merchant_category"]: r["fraud_rate_percent"] for r in fraud.fraud_by_category(sample).collect()}
    assert rates["online_shopping"] == 100.0 and rates["grocery"] == 0.0
    assert [r["merchant_category"] for r in fraud.high_risk_categories(sample).collect()] == ["online_shopping"]


def test_cube_gives_the_same(made):
    counts = cube(made, COLS)
    for ask in (
        fraud.fraud_summary,
        fraud.fraud_by_category,
        fraud.risky_merchants,
        fraud.fraud_by_hour,
        fraud.fraud_by_weekday,
        fraud.peak_hours,
        fraud.peak_days,
        fraud.high_risk_categories,
    ):
        assert ask(made, COLS).collect() == ask(counts, COLS).collect(), ask.__name__


def test_empty_input(sample):
    empty = sample.limit(0)
    for name, frame in fraud.report(empty, COLS).items():
        rows = frame.collect()
        if name == "executive_summary":
            assert rows[0]["total_transactions"] == 0 and rows[0]["fraud_rate_percent"] == 0
    assert features.all_features(empty, COLS).count() == 0
    assert dq.run_checks(empty, dq.NullCheck(), dq.DuplicateCheck(("transaction_id",))).filter("NOT passed").count() == 0
    assert dq.profile_columns(empty).count() == len(empty.columns)


def test_all_fraud(sample):
    everything = sample.withColumn("is_fraud", F.lit(1))
    messages = [r["message"] for r in fraud.findings(everything, COLS).collect()]
    assert any(m.startswith("Average fraud is $") and "x the" not in m for m in messages)
    assert all(messages)


def test_patterns_and_anomalies(made):
    rows = [r.asDict() for r in made.collect()]
    amounts = [r["amount"] for r in rows]
    mean, sd = statistics.mean(amounts), statistics.stdev(amounts)
    got = {r["pattern"]: r for r in fraud.risk_patterns(made, COLS).collect()}
    high = [r for r in rows if r["amount"] > mean + 2 * sd]
    assert got["High-Value Transactions"]["occurrences"] == len(high)
    assert got["High-Value Transactions"]["fraud_count"] == sum(r["is_fraud"] for r in high)
    odd = [r for r in rows if abs(r["amount"] - mean) / sd > 3]
    one = fraud.anomaly_summary(made, COLS).first()
    assert one["total_anomalies"] == len(odd)
    top = fraud.top_anomalies(made, COLS).collect()
    assert [r["amount"] for r in top] == sorted((r["amount"] for r in odd), reverse=True)[:10]


def test_report_reads_the_source_three_times(made, spark, tmp_path, monkeypatch):
    """Cube, mean and deviation, outliers; all ten sections come from these tables."""
    from swipelake.plans import cube as cubes

    made.write.parquet(str(tmp_path / "source"))
    source = spark.read.parquet(str(tmp_path / "source"))
    fields = sorted(source.columns)

    def scans(frame):
        """Leaves of the plan that read the source, told by its files' columns."""
        plan = frame._jdf.queryExecution().analyzed()
        leaves = plan.collectLeaves()
        read = [leaves.apply(i) for i in range(leaves.size())]
        return sum(sorted(a.strip("[]").split("#")[0].strip() for a in str(r.output().mkString(",")).split(",")) == fields for r in read)

    seen = []
    for module in (fraud, cubes):
        real = module.written
        monkeypatch.setattr(module, "written", lambda df, label, real=real: seen.append(scans(df)) or real(df, label))
    sections = fraud.report(source, COLS)
    assert len(sections) == 10 and sum(seen) == 3 and len(seen) == 3
    assert all(scans(frame) == 0 for frame in sections.values())
    assert all(frame.count() > 0 for frame in sections.values())
    seen.clear()
    hours = fraud.analysis("fraud_by_hour", COLS)(source)
    assert sum(seen) == 1 and hours.collect() == sections["fraud_by_hour"].collect()


def test_weekday_names(sample):
    got = {r["day_of_week"]: r["day"] for r in fraud.fraud_by_weekday(sample).collect()}
    assert got == {5: "Thursday", 6: "Friday", 7: "Saturday"}
    late = sample.withColumn("transaction_time", F.lit(None).cast("string"))
    assert [(r["day_of_week"], r["day"]) for r in fraud.fraud_by_weekday(late).collect()] == [(None, None)]


# ---- geography --------------------------------------------------------------------------------


def test_geography(spark):
    rows = [
        ("a", 1, "2024-01-01 00:00:00", 0.0, 0.0, 0.0, 0.01, "X", 0),
        ("b", 1, "2024-01-02 00:00:00", 0.0, 0.0, 0.0, 3.0, "X", 1),
        ("c", 1, "2024-01-03 00:00:00", 5.0, 5.0, 5.0, None, "Y", 1),
    ]
    df = spark.createDataFrame(
        rows,
        "transaction_id string, customer_id int, transaction_time string, lat double, long double,"
        " merch_lat double, merch_long double, state string, is_fraud int",
    )
    got = by_id(geography.geographic_features(df, COLS))
    assert [got[k]["distance_bucket"] for k in "abc"] == ["local", "distant", "very_distant"]
    assert [got[k]["is_unusual_location"] for k in "abc"] == [0, 0, 1]
    assert [got[k]["is_out_of_state"] for k in "abc"] == [0, 0, 1]
    named = by_id(geography.geographic_features(df, COLS, null_distance_as="unknown"))
    assert named["c"]["distance_bucket"] == "unknown"
    unusual = geography.unusual_locations(geography.geographic_features(df, COLS), COLS).first()
    assert tuple(unusual) == (1, 100.0)
    assert geography.fraud_hotspots(df, COLS, min_rows=2).first()["state"] == "X"


# ---- quality ----------------------------------------------------------------------------------


def test_checks(spark):
    names = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "id int, name string")
    got = {r["column_name"]: r for r in dq.run_checks(names, dq.NullCheck(max_ratio=0.5)).collect()}
    assert got["id"]["passed"] and not got["name"]["passed"]
    assert got["name"]["ratio"] == 0.6667
    amounts = spark.createDataFrame([(50,), (500,), (None,)], "amount int")
    check = dq.RangeCheck({"amount": (0, 200)})
    assert dq.run_checks(amounts, check).first()["failed_rows"] == 1
    ids = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    one = dq.run_checks(ids, dq.DuplicateCheck(("id",))).first()
    assert one["failed_rows"] == 1 and not one["passed"]
    assert not dq.all_passed(dq.run_checks(ids, dq.DuplicateCheck(("id",)), dq.NullCheck())).first()[0]


def test_schema_check(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    assert dq.check_schema(df, df.schema).count() == 0
    wanted = T.StructType([*df.schema.fields, T.StructField("email", T.StringType())])
    bad = dq.check_schema(df, wanted).first()
    assert tuple(bad) == ("missing", "email", False)


def test_rules(spark):
    df = spark.createDataFrame([(1, 5.0), (1, -1.0), (1, None), (2, 7.0), (2, 1.0)], "k int, v double")
    rules = (
        dq.not_null("v"),
        dq.positive("v"),
        dq.in_range("v", 0, 6),
        dq.unique("k"),
        dq.Rule("sevens", F.col("v") == 7, "info"),
    )
    got = dq.run_rules(df, *rules)
    failed = {r["rule"]: r["failed_count"] for r in got.collect()}
    assert failed == {"not_null_v": 1, "positive_v": 1, "range_v": 2, "unique_k": 2, "sevens": 1}
    assert tuple(dq.rules_summary(got).first()) == (5, 0, 5)
    with pytest.raises(ValueError):
        dq.Rule("x", "true", "fatal")


def test_profiles(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (3, 0.0, None), (5, 0.0, "a")], "i int, d double, s string")
    got = {r["column_name"]: r for r in dq.profile_columns(df).collect()}
    assert (got["i"]["min"], got["i"]["max"], got["i"]["avg"], got["i"]["stddev"]) == (1, 5, 3, 2)
    assert got["d"]["avg"] == 0.0 and got["s"]["distinct_count"] == 2
    about = {r["column_name"]: r for r in dq.profile_columns(df, approximate=True).collect()}
    assert about["s"]["distinct_count"] == 1
    nulls = {r["column_name"]: r["null_ratio"] for r in dq.profile_nulls(df).collect()}
    assert nulls == {"i": 0.0, "d": 0.0, "s": 0.3333}


def test_require(sample):
    assert dq.require(sample, 5, ["amount"], ["transaction_id"]) is sample
    for bad in ({"min_rows": 6}, {"required_columns": ["zz"]}, {"non_nullable": ["zz"]}):
        with pytest.raises(dq.RequirementError):
            dq.require(sample, **bad)
    with pytest.raises(dq.RequirementError, match="NULLs"):
        dq.require(sample.withColumn("x", F.lit(None)), non_nullable=["x"])


# ---- segments and model -----------------------------------------------------------------------


def test_segments(made):
    got = segments.customer_segments(made, COLS).cache()
    assert got.count() == made.select("customer_id").distinct().count()
    assert {r["segment"] for r in got.collect()} == {0, 1, 2, 3}
    profiles = segments.segment_profiles(got).collect()
    assert sum(r["customer_count"] for r in profiles) == got.count()
    assert all(r["risk_level"] in ("HIGH", "MEDIUM", "LOW") for r in profiles)


def test_segment_names(spark):
    rows = [(0, 100.0, 10, 0.5), (1, 10.0, 10, 0.0), (2, 10.0, 60, 0.0), (3, 300.0, 10, 0.1), (4, 110.0, 12, 0.0)]
    df = spark.createDataFrame(rows, "segment int, avg_amount double, txn_count int, fraud_rate double")
    got = {r["segment_id"]: (r["segment_name"], r["characteristics"]) for r in segments.segment_profiles(df).collect()}
    assert got == {
        0: ("High-Risk Segment", "Average spenders, Low frequency, High fraud exposure"),
        1: ("Budget Customers", "Low spenders, Low frequency"),
        2: ("Frequent Buyers", "Low spenders, High frequency"),
        3: ("Premium Customers", "High spenders, Low frequency"),
        4: ("Standard Customers", "Average spenders"),
    }


def test_model(made):
    df = features.all_features(made, COLS)
    inputs = model.ModelInputs.of(df, COLS)
    assert inputs.categorical == ("merchant_category", "amount_bucket")
    assert "transaction_distance_km" not in inputs.numeric
    train, test = model.split(model.prepare(df, inputs), "transaction_id", "is_fraud")
    assert train.count() + test.count() == made.count()
    assert train.join(test, "transaction_id").count() == 0
    assert 0.15 < test.count() / made.count() < 0.25
    fitted = model.train(train, inputs, trees=5, depth=4)
    summary = {(r["section"], r["name"]): r["value"] for r in model.model_summary(fitted, train, test, inputs).collect()}
    assert 0.5 < summary["metrics", "auc_roc"] <= 1.0
    assert summary["rows", "test_rows"] == test.count()
    assert sum(v for (s, _), v in summary.items() if s == "importance") == pytest.approx(1.0)
    counts = sum(summary["metrics", n] for n in ("true_positive", "false_positive", "true_negative", "false_negative"))
    assert counts == test.count()


def test_models_after_observed_metrics(made):
    """Scoring works in a session that has observed metrics before."""
    from pyspark.sql import Observation

    seen = Observation()
    made.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 3000
    inputs = model.ModelInputs.of(made, COLS)
    fitted = model.train(model.prepare(made, inputs), inputs, trees=2, depth=2)
    assert model.score(fitted, made, inputs).filter("prediction IS NOT NULL").count() == 3000
    assert segments.customer_segments(made, COLS).filter("segment IS NULL").count() == 0


def test_split_is_stable(made):
    """The same rows are drawn whatever the partitioning."""
    draw = lambda d: {r[0] for r in model.with_split(d, "transaction_id", "is_fraud").filter("is_test").select("transaction_id").collect()}
    assert draw(made) == draw(made.repartition(7))


def test_class_metrics_match_mllib(made):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    said = made.withColumn("prediction", (F.col("amount") > 900).cast("double"))
    said = said.withColumn("is_fraud", F.col("is_fraud").cast("double"))
    one = model.class_metrics(model.confusion_matrix(said)).first()
    for ours, theirs in (
        ("accuracy", "accuracy"),
        ("precision", "weightedPrecision"),
        ("recall", "weightedRecall"),
        ("f1_score", "f1"),
    ):
        grader = MulticlassClassificationEvaluator(labelCol="is_fraud", metricName=theirs)
        assert one[ours] == pytest.approx(grader.evaluate(said))
