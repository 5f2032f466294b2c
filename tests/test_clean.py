"""Cleaning, projection, bands and scalar functions on hand-computed rows."""

import hashlib
import inspect

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from swipelake.columns import CARD_COLUMNS, DEFAULT_COLUMNS, MissingColumnError, guess_columns
from swipelake.functions import bands, scalars, sql_names
from swipelake.functions.geo import haversine_km
from swipelake.operators import clean


def values(df, *names):
    df = df.select(*names) if names else df
    rows = [tuple(r) for r in df.collect()]
    return [r[0] for r in rows] if len(df.columns) == 1 else rows


def test_column_names(spark):
    df = spark.createDataFrame([("a", "b")], "`First Name` string, `Amount ($)` string")
    assert clean.snake_case_columns(df).columns == ["first_name", "amount"]
    assert clean.snake_case_columns(df, lowercase=False).columns == ["First_Name", "Amount"]
    twice = spark.createDataFrame([("a", "b")], "`A!` string, a string")
    with pytest.raises(ValueError, match="collide"):
        clean.snake_case_columns(twice)


def test_audit_columns(spark):
    df = clean.audit_columns(spark.range(10), "nightly")
    assert df.columns[1:] == [
        "_processing_timestamp",
        "_pipeline_name",
        "_spark_partition_id",
        "_row_id",
    ]
    assert df.select("_row_id").distinct().count() == 10
    assert "_row_id" not in clean.audit_columns(spark.range(1), row_id=False).columns


def test_dates(spark):
    df = spark.createDataFrame([("2023-06-15",), ("nonsense",), (None,)], "d string")
    got = values(clean.standardize_dates(df, ["d"]))
    assert [str(v) for v in got] == ["2023-06-15 00:00:00", "None", "None"]
    assert values(clean.standardize_dates(df, ["d"], output_pattern="dd/MM/yy"))[0] == "15/06/23"
    with pytest.raises(MissingColumnError):
        clean.standardize_dates(df, ["absent"])
    assert clean.standardize_dates(df, ["absent"], missing="skip").columns == ["d"]


def test_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, value string")
    assert clean.drop_nulls(df).count() == 2
    assert values(clean.fill_nulls(df, {"value": "default"}), "value") == ["a", "default", "c"]
    numbers = spark.createDataFrame(
        [(1, 1.5, "x"), (None, None, None), (2, 4.0, "y"), (3, 4.0, "y")], "i int, d double, s string"
    )
    assert values(clean.fill_nulls(numbers))[1] == (0, 0.0, "")
    assert values(clean.fill_nulls_mean(numbers, ["i", "d"]))[1][:2] == (2, pytest.approx(9.5 / 3))
    assert values(clean.fill_nulls_median(numbers, ["i", "d"]))[1][:2] == (2, 4.0)
    assert values(clean.fill_nulls_mode(numbers))[1] == (1, 4.0, "y")
    assert clean.fill_nulls_mean(numbers.limit(0)).count() == 0


def test_filters(sample):
    assert clean.filter_amounts(sample, "amount", 100).count() == 3
    assert clean.filter_amounts(sample, "amount", 100, 599.99).count() == 2
    days = clean.filter_dates(sample, "transaction_time", "2023-06-16", "2023-06-17 08:00:00")
    assert days.count() == 2


def test_derived(sample):
    got = clean.derived_columns(sample).orderBy("transaction_id").collect()
    assert [r["amount_category"] for r in got] == ["small", "medium", "large", "small", "high_value"]
    assert [r["is_weekend"] for r in got] == [False, False, False, True, False]
    flagged = clean.fraud_flags(clean.date_parts(sample)).orderBy("transaction_id").collect()
    assert [r["is_high_amount"] for r in flagged] == [False] * 4 + [True]
    assert [r["is_late_night"] for r in flagged] == [False] * 4 + [True]


LIMITS = [9.99, 10, 49.99, 50, 99.99, 100, 199.99, 200, 499.99, 500, 999.99, 1000, 4999.99, 5000]


@pytest.mark.parametrize(
    ("band", "expected"),
    [
        (bands.band_basic, ["small"] * 3 + ["medium"] * 4 + ["large"] * 4 + ["high_value"] * 3),
        (
            bands.band_etl,
            ["micro"] * 3 + ["small"] * 2 + ["medium"] * 4 + ["large"] * 2 + ["premium"] * 3,
        ),
        (
            bands.band_feature,
            ["micro"] + ["small"] * 2 + ["medium"] * 4 + ["large"] * 2 + ["very_large"] * 5,
        ),
        (
            bands.amount_category,
            ["micro"] * 3
            + ["small"] * 2
            + ["medium"] * 4
            + ["large"] * 2
            + ["very_large"] * 2
            + ["premium"],
        ),
    ],
)
def test_bands_on_their_limits(spark, band, expected):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(LIMITS)], "i int, a double")
    assert values(df.orderBy("i").select(band(F.col("a")))) == expected


def test_null_bands(spark):
    df = spark.createDataFrame([(None,)], "a double")
    a = F.col("a")
    got = df.select(bands.band_basic(a), bands.amount_category(a), bands.band_distance(a)).first()
    assert tuple(got) == ("high_value", "unknown", "very_distant")


def test_category_groups(sample):
    got = values(clean.category_groups(sample).orderBy("transaction_id"), "category_group")
    assert got == ["essentials", "dining", "shopping", "essentials", "shopping"]


def test_cast_and_rename(spark):
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    got = clean.cast_columns(df, {"a": "int", "b": "int", "c": "int"}).first()
    assert tuple(got) == (1, None)
    assert clean.cast_columns(df, {"a": "blob"}).schema == df.schema
    assert clean.rename_columns(df, {"a": "z", "q": "r"}).columns == ["z", "b"]


def test_duplicates(spark):
    rows = [(1, 5, "b"), (1, 5, "b"), (1, 3, "z"), (None, 1, "n"), (None, 2, None)]
    df = spark.createDataFrame(rows, "k int, t int, v string")
    assert clean.cleanse(df).count() == 4
    assert clean.cleanse(df, nulls=True).count() == 2
    got = set(values(clean.drop_duplicates(df, ["k"], ["t"])))
    assert got == {(1, 3, "z"), (None, 1, "n")}
    plan = clean.drop_duplicates(df, ["k"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange") == 1


def test_modes_of_all_columns(spark, tmp_path):
    rows = [(1, "b", 2.5), (1, "a", None), (2, "a", 2.5), (3, "b", 1.0), (None, None, None)]
    spark.createDataFrame(rows, "i int, s string, d double").write.parquet(f"{tmp_path}/m")
    made = clean.fill_nulls_mode(spark.read.parquet(f"{tmp_path}/m"))
    want = [(1, "a", 2.5), (1, "a", 2.5), (1, "b", 2.5), (2, "a", 2.5), (3, "b", 1.0)]
    assert sorted(values(made)) == want


def test_scalars(spark):
    df = spark.createDataFrame(
        [("CUST_001", "2023-06-15 14:30:00", "$1,234.56"), ("abcd", "bad", "x"), (None, None, None)],
        "s string, t string, c string",
    )
    got = values(
        df.select(
            scalars.mask(F.col("s")),
            scalars.hour_bucket(F.col("t")),
            scalars.parse_currency(F.col("c")),
            scalars.hashed(F.col("s")),
        )
    )
    assert got[0] == ("****_001", "afternoon", 1234.56, hashlib.sha256(b"CUST_001").hexdigest()[:16])
    assert got[1][:3] == ("abcd", "unknown", 0.0)
    assert got[2] == (None, "unknown", 0.0, None)


def test_hour_limits(spark):
    hours = [5, 6, 11, 12, 16, 17, 20, 21]
    df = spark.createDataFrame([(i, f"2024-01-01 {h:02}:00:00") for i, h in enumerate(hours)], "i int, t string")
    got = values(df.orderBy("i").select(scalars.hour_bucket(F.col("t"))))
    assert got == ["night", "morning", "morning", "afternoon", "afternoon", "evening", "evening", "night"]


def test_risk_scores(spark):
    rows = [
        (45.50, 0, "mobile", "purchase"),
        (1250.0, 0, "desktop", "transfer"),
        (75.25, 1, "pos_terminal", "purchase"),
        (5500.0, 0, "mobile", "payment"),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "a double, f int, d string, k string").coalesce(1)
    cols = [F.col(c) for c in "afdk"]
    assert values(df.select(scalars.risk_score(*cols))) == [6, 28, 52, 38, 15]


def test_sql_names(spark):
    names = sql_names.register(spark)
    assert len(names) == 7
    got = spark.sql(
        "SELECT categorize_amount(NULL), mask_sensitive('12345'), is_weekend(NULL), is_weekend(7),"
        " parse_currency('$9'), calculate_risk_score(5500, 0, 'mobile', 'payment'), extract_hour_bucket('x')"
    ).first()
    assert tuple(got) == ("unknown", "*2345", False, True, 9.0, 38.0, "unknown")


def test_normalized(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 3.0), (3.0, 3.0)], "a double, b double").coalesce(1)
    assert values(scalars.normalized(df, "a", "z"), "z") == [0.0, None, 1.0]
    assert values(scalars.normalized(df, "b", "z"), "z") == [0.5, 0.5, 0.5]


def test_haversine(spark):
    df = spark.createDataFrame([(52.52, 13.405, 48.8566, 2.3522), (0.0, 0.0, 0.0, 180.0), (None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double").coalesce(1)
    got = values(df.select(haversine_km(*[F.col(c) for c in "abcd"])))
    assert got[0] == pytest.approx(877.46, abs=0.1)
    assert got[1] == pytest.approx(3.141592653589793 * 6371)
    assert got[2] is None


def test_guess_columns(sample):
    assert guess_columns(sample) == DEFAULT_COLUMNS
    assert guess_columns(sample.withColumnRenamed("customer_id", "cc_num")) == CARD_COLUMNS


def test_no_python_workers():
    for module in (clean, scalars, bands):
        assert "udf(" not in inspect.getsource(module)


def test_bad_path(spark):
    from swipelake.sources.files import read_csv

    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_csv(spark, "/nowhere/at/all")
