"""Exact areas, bounded categories, mergeable profiles, stored layouts and streaming statistics."""

import random

import pytest
from pyspark.sql import functions as F

from catalog import joins_windows
from swipelake.columns import TxnColumns
from swipelake.operators import joins
from swipelake.operators import quality as dq
from swipelake.plans import model
from swipelake.scratch import scratch_path
from swipelake.sources import snapshots
from swipelake.streaming import ingest

# ---- areas under the curves -----------------------------------------------------------------------


def plain_areas(rows):
    """Pair by pair, and step by step over distinct scores."""
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    roc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    points, hit, miss = [], 0, 0
    for score in sorted({s for _, s in rows}, reverse=True):
        hit += sum(p == score for p in pos)
        miss += sum(n == score for n in neg)
        points.append((hit / len(pos), hit / (hit + miss)))
    last, trapezoids, mean = (0.0, points[0][1]), 0.0, 0.0
    for point in points:
        trapezoids += (point[0] - last[0]) * (point[1] + last[1]) / 2
        mean += (point[0] - last[0]) * point[1]
        last = point
    return roc, trapezoids, mean


@pytest.mark.parametrize("rows_per_task", [3, 50, 10_000])
@pytest.mark.parametrize("distinct", [4, 40, 100_000])
def test_areas_equal_all_pairs(spark, rows_per_task, distinct):
    draw = random.Random(distinct)
    rows = [(int(draw.random() < 0.3), float(draw.randrange(distinct))) for _ in range(400)]
    frame = spark.createDataFrame([*rows, (None, 1.0), (1, None), (7, 2.0)], "is_fraud int, score double")
    got = model.score_areas(frame.repartition(6), rows_per_task=rows_per_task).first()
    assert tuple(got) == pytest.approx(plain_areas(rows), rel=1e-9)


def test_areas_of_one_class_are_unknown(spark):
    frame = spark.createDataFrame([(1, 0.5), (1, 0.7)], "is_fraud int, score double")
    one = model.score_areas(frame).first()
    assert one["auc_roc"] is None and one["average_precision"] == 1.0
    assert tuple(model.score_areas(frame.limit(0)).first()) == (None, None, None)


# ---- categories -----------------------------------------------------------------------------------


def test_a_million_values_train(spark):
    """The commonest values keep their bins; the rest, NULL and unseen ones share one."""
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("c"), (F.col("id") % 10).cast("string")))
        .when(F.col("id") % 7 == 0, None)
        .otherwise(F.col("id").cast("string"))
        .alias("category"),
        (F.col("id") % 10 == 4).cast("int").alias("is_fraud"),
    )
    inputs = model.ModelInputs((), ("category",))
    fitted = model.train(rows, inputs, trees=3, depth=4, max_bins=8)
    labels = fitted.stages[0].labels
    assert len(labels) == 7 and {f"c{i}" for i in (0, 2, 4, 6, 8)} <= set(labels)
    asked = spark.createDataFrame([("c4",), ("c2",), ("never seen",), (None,)], "category string")
    said = [r["prediction"] for r in model.score(fitted, asked, inputs).collect()]
    assert said == [1.0, 0.0, 0.0, 0.0]


def test_vocabulary_breaks_ties_by_value(spark):
    rows = [("b", 1), ("a", 1), ("c", 2), ("c", 2), (None, 3), (None, 3), (None, None)]
    frame = spark.createDataFrame(rows, "x string, y int")
    got = [tuple(r) for r in model.category_vocabulary(frame, ["x", "y"], 2).orderBy("feature", F.desc("rows")).collect()]
    assert got == [("x", "c", 2), ("x", "a", 1), ("y", "1", 2), ("y", "2", 2)] or got[:2] == [("x", "c", 2), ("x", "a", 1)]
    kept = model.bound_categories(frame, ["x"], 1)
    assert sorted(map(str, (r["x"] for r in kept.collect()))) == ["None"] * 5 + ["c", "c"] and kept.columns == ["x", "y"]


# ---- profiles -------------------------------------------------------------------------------------


def test_merged_profiles_equal_one_pass(spark):
    frame = spark.range(5000).select(
        (F.col("id") % 5).cast("string").alias("day"),
        F.when(F.col("id") % 9 != 0, F.col("id") * 1.5).alias("amount"),
        F.when(F.col("id") % 11 != 0, (F.col("id") % 1700).cast("string")).alias("merchant"),
        F.lit(None).cast("double").alias("empty"),
    )
    exact = {r["column_name"]: r for r in dq.profile_columns(frame.drop("day")).collect()}
    once = {r["column_name"]: r for r in dq.merged_profile(dq.profile_states(frame.drop("day"))).collect()}
    states = dq.profile_states(frame, "day")
    assert states.count() == 15 and states.filter("nulls > rows").count() == 0
    halves = [states.filter(F.col("part").isin(*days)) for days in (("0", "3"), ("1", "2", "4"))]
    for joined in (states, halves[1].unionByName(halves[0])):
        found = {r["column_name"]: r for r in dq.merged_profile(joined).collect()}
        for name in ("amount", "empty"):
            for part in ("min", "max", "avg", "stddev"):
                assert found[name][part] == exact[name][part] == once[name][part], (name, part)
        real = exact["merchant"]["distinct_count"]
        for row in (found, once):
            assert abs(row["merchant"]["distinct_count"] - real) <= 3 * 1.04 / 64 * real
    assert dq.merged_profile(dq.profile_states(frame.limit(0), "day")).count() == 0


# ---- stored layout --------------------------------------------------------------------------------


def test_bucketed_join_needs_no_exchange(spark):
    """Neither side of the join nor the windows and aggregates by the key."""
    folder = "/root/testdata/sf0.001"
    plan = joins_windows.join_bucketed(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    orders, lines = joins_windows._bucketed(spark, folder, 3)
    joined = joins.bucketed_join(lines, orders, ["o_orderkey"])
    counted = joined.groupBy("o_orderkey").count()
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    plain = spark.read.parquet(f"{folder}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).count()
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, plain.collect()))


def test_bucketed_keeps_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, None)], "k int, v string")
    held = joins.bucketed(rows, ["k"], 2, sort=["v"], name="bucketed_kept")
    assert sorted(map(str, held.collect())) == sorted(map(str, rows.collect()))
    other = joins.bucketed(spark.createDataFrame([(1, 10), (3, 30), (None, 0)], "k int, w int"), ["k"], 3)
    got = joins.bucketed_join(held, other, ["k"], "left").collect()
    assert sorted(map(str, got)) == sorted(map(str, rows.join(other, "k", "left").collect()))
    spark.sql("DROP TABLE bucketed_kept")


# ---- streaming statistics -------------------------------------------------------------------------

COLS = TxnColumns()


def test_a_repeated_batch_changes_nothing(spark):
    """A crash after the output, and one after the statistics: both end with what one run gives."""
    stats, out = scratch_path(spark, "stats"), scratch_path(spark, "out")
    schema = "customer_id string, amount double"
    batches = [
        [("a", 10.0), ("a", 20.0), (None, 5.0), ("b", None)],
        [("a", 30.0), ("b", 4.0), (None, 1.0), ("c", 2.0)],
    ]
    applied = []

    def catch(stream, checkpoint, action):
        applied.append(action)

    real = ingest.for_each_batch
    try:
        ingest.for_each_batch = catch
        ingest.enrich_and_renew(None, stats, out, "progress", COLS)
    finally:
        ingest.for_each_batch = real
    apply, upsert = applied[0], ingest.upsert
    apply(spark.createDataFrame(batches[0], schema), 0)
    second = spark.createDataFrame(batches[1], schema)
    try:
        ingest.upsert = lambda *a, **k: (_ for _ in ()).throw(OSError("lost"))
        with pytest.raises(OSError):
            apply(second, 1)
    finally:
        ingest.upsert = upsert
    for _ in range(2):
        apply(second, 1)
    made = {
        (r["batch"], r["customer_id"], r["amount"]): (r["customer_txn_before"], r["customer_avg_before"], r["amount_vs_before"])
        for r in spark.read.parquet(out).collect()
    }
    assert len(made) == 8 and made[1, "a", 30.0] == (2, 15.0, 2.0)
    assert made[1, "b", 4.0] == (1, None, None) and made[1, "c", 2.0] == (None, None, None) == made[0, "a", 10.0]
    held = {r["customer_id"]: (r["txn_count"], r["total_amount"]) for r in snapshots.read_snapshot(spark, stats).collect()}
    assert held == {"a": (3, 60.0), "b": (2, 4.0), "c": (1, 2.0)}
    assert snapshots.versions(spark, stats).count() == 2
