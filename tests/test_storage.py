"""Files, snapshots, upserts, joins, layout, the job and the streams."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from swipelake.operators import joins, layout
from swipelake.operators.quality import NullCheck, RangeCheck
from swipelake.plans.job import JobConfig, JobError, run_job
from swipelake.skew import find_hot_keys
from swipelake.sources import files, snapshots
from swipelake.sources.synthetic import generated
from swipelake.streaming import ingest as stream


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def orders(spark):
    return spark.createDataFrame(
        [(1, "a", 10.0), (2, "b", 20.0), (3, None, 30.0), (None, "d", 40.0)], "id int, s string, v double"
    )


def test_files(spark, orders, tmp_path):
    files.write_csv(orders, f"{tmp_path}/c", delimiter=";")
    assert rows(files.read_csv(spark, f"{tmp_path}/c", orders.schema, delimiter=";")) == rows(orders)
    files.write_json(orders, f"{tmp_path}/j")
    assert rows(files.read_json(spark, f"{tmp_path}/j", schema=orders.schema)) == rows(orders)
    files.write_parquet(orders, f"{tmp_path}/p", partition_by=["s", "absent"])
    assert rows(files.read_parquet(spark, f"{tmp_path}/p", ["id", "s", "v"])) == rows(orders)
    since = files.read_since(spark, f"{tmp_path}/p", "v", 20)
    assert sorted(r["v"] for r in since.collect()) == [30.0, 40.0]
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,20.0)]" in since._jdf.queryExecution().toString()
    assert files.next_watermark(since, "v").first()[0] == 40.0


def test_snapshots(spark, orders, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(LookupError):
        snapshots.read_snapshot(spark, path)
    assert snapshots.write_snapshot(orders, path, committed_at=datetime(2024, 1, 1)) == 0
    assert snapshots.write_snapshot(orders, path, "append", committed_at=datetime(2024, 1, 2)) == 1
    few = orders.filter("id = 1")
    assert snapshots.write_snapshot(few, path, partition_by=["s"], committed_at=datetime(2024, 1, 3)) == 2
    assert snapshots.write_snapshot(orders.limit(0), path, committed_at=datetime(2024, 1, 4)) == 3
    sizes = [snapshots.read_snapshot(spark, path, v).count() for v in range(4)]
    assert sizes == [4, 8, 1, 0]
    assert snapshots.read_snapshot(spark, path).count() == 0
    assert rows(snapshots.read_snapshot(spark, path, timestamp="2024-01-03 12:00:00")) == rows(few)
    with pytest.raises(LookupError):
        snapshots.read_snapshot(spark, path, timestamp="2023-01-01")
    newest = snapshots.history(spark, path, 2).collect()
    assert [(r["version"], r["total_rows"]) for r in newest] == [(3, 0), (2, 1)]
    with pytest.raises(ValueError, match="columns"):
        snapshots.write_snapshot(orders.drop("v"), path, "append")


def test_failed_write_is_invisible(spark, orders, tmp_path):
    path = f"{tmp_path}/t"
    snapshots.write_snapshot(orders, path)
    broken = orders.withColumn("v", F.raise_error(F.lit("boom")).cast("double"))
    with pytest.raises(Exception, match="boom"):
        snapshots.write_snapshot(broken, path, "append")
    assert rows(snapshots.read_snapshot(spark, path)) == rows(orders)


def test_upsert(spark, orders, tmp_path):
    path = f"{tmp_path}/t"
    snapshots.upsert(orders, path, ["id"])
    new = spark.createDataFrame([(2, None, 99.0), (7, "g", 70.0), (None, "z", 1.0)], orders.schema)
    snapshots.upsert(new, path, ["id"])
    want = [(1, "a", 10.0), (2, None, 99.0), (3, None, 30.0), (7, "g", 70.0), (None, "d", 40.0), (None, "z", 1.0)]
    assert rows(snapshots.read_snapshot(spark, path)) == sorted(want, key=repr)
    keyed = new.dropna(subset=["id"])
    once = snapshots.merged(orders, keyed, ["id"])
    assert rows(snapshots.merged(once, keyed, ["id"])) == rows(once)
    kept = snapshots.merged(orders, keyed, ["id"], update=False)
    assert (2, "b", 20.0) in rows(kept) and (7, "g", 70.0) in rows(kept)
    with pytest.raises(snapshots.DuplicateKeyError):
        snapshots.merged(orders, keyed.unionByName(keyed), ["id"])


@pytest.mark.parametrize("by", [[], ["p"]])
@pytest.mark.parametrize("update", [True, False])
def test_many_upserts(spark, tmp_path, by, update):
    """Partitioned or not: the same table, and old versions stay."""
    path, expected = f"{tmp_path}/t", {}
    states = []
    for step in range(5):
        new = [(k, step) for k in range(step, step + 6)]
        if step == 2:
            new = [(100 + k, step) for k in range(4)]
        frame = spark.createDataFrame(new, "k int, v int").withColumn("p", F.col("k") % 3).coalesce(1)
        if step == 2:
            snapshots.write_snapshot(frame, path, "append")
        else:
            snapshots.upsert(frame, path, ["k"], update, by)
        for k, v in new:
            if update or k not in expected:
                expected[k] = v
        states.append(sorted(expected.items()))
    for version in range(5):
        got = snapshots.read_snapshot(spark, path, version).select("k", "v")
        assert rows(got) == sorted(states[version], key=repr)
    held = snapshots.history(spark, path, 20).orderBy("version").collect()
    assert [r["total_rows"] for r in held] == [len(s) for s in states]


def test_upsert_writes_touched_partitions_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = spark.range(100).select("id", (F.col("id") % 10).alias("p"), F.lit(1).alias("v"))
    assert snapshots.upsert(table, path, ["id"], partition_by=["p"]) == (0, 100, 0)
    new = spark.createDataFrame([(3, 3, 2), (13, 5, 2), (200, 7, 2)], "id long, p long, v int")
    assert snapshots.upsert(new, path, ["id"]) == (1, 1, 2)
    first, second = [set(r["parts"]) for r in snapshots.versions(spark, path).orderBy("version").collect()]
    assert len(first & second) == 9 and {p.rpartition("=")[2] for p in second - first} == {"3", "5", "7"}
    want = {i: (i % 10, 1) for i in range(100)} | {3: (3, 2), 13: (5, 2), 200: (7, 2)}
    assert {r["id"]: (r["p"], r["v"]) for r in snapshots.read_snapshot(spark, path).collect()} == want
    newest = snapshots.history(spark, path).first()
    assert (newest["row_count"], newest["total_rows"], newest["inserted"], newest["updated"]) == (11, 101, 1, 2)


def test_upsert_into_partitions_with_odd_names(spark, tmp_path):
    path, names = f"{tmp_path}/t", ["a b", "c/d", "50%", "é=1", "x+y", None, ""]
    table = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, p string")
    snapshots.upsert(table, path, ["id"], partition_by=["p"])
    held = rows(snapshots.read_snapshot(spark, path))
    assert snapshots.upsert(table.filter("id in (0, 1, 2, 3, 4)"), path, ["id"]) == (1, 0, 5)
    assert rows(snapshots.read_snapshot(spark, path)) == held
    assert len(held) == len(names)


def test_types_are_checked_and_widened(spark, tmp_path):
    path = f"{tmp_path}/t"
    snapshots.write_snapshot(spark.createDataFrame([(1, 1)], "id long, n int"), path)
    snapshots.write_snapshot(spark.createDataFrame([(2, 2)], "n int, id int").select("n", "id"), path, "append")
    snapshots.upsert(spark.createDataFrame([(1, 5)], "id int, n short"), path, ["id"])
    for wrong in ("id string, n int", "id long, n long", "id double, n int"):
        bad = spark.createDataFrame([], wrong)
        with pytest.raises(TypeError, match="do not fit"):
            snapshots.write_snapshot(bad, path, "append")
        with pytest.raises(TypeError, match="do not fit"):
            snapshots.upsert(bad, path, ["id"])
    assert rows(snapshots.read_snapshot(spark, path)) == [(1, 5), (2, 2)]
    assert snapshots.read_snapshot(spark, path).dtypes == [("id", "bigint"), ("n", "int")]


def test_write_modes(spark, orders, tmp_path):
    path = f"{tmp_path}/t"
    assert snapshots.write_snapshot(orders, path, "ignore") == 0
    assert snapshots.write_snapshot(orders.limit(1), path, "ignore") == 0
    with pytest.raises(FileExistsError):
        snapshots.write_snapshot(orders, path, "error")
    with pytest.raises(ValueError, match="partitioned"):
        snapshots.write_snapshot(orders, path, "append", ["s"])
    assert rows(snapshots.read_snapshot(spark, path)) == rows(orders)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    batch = spark.createDataFrame([(1, "a"), (None, "b")], "id int, s string")
    assert [snapshots.upsert(batch, path, ["id"], batch="stream#0") for _ in range(3)] == [(0, 2, 0), (0, 0, 0), (0, 0, 0)]
    assert rows(snapshots.read_snapshot(spark, path)) == [(1, "a"), (None, "b")]


def test_appends_are_one_scan(spark, tmp_path):
    path = f"{tmp_path}/t"
    for i in range(4):
        snapshots.write_snapshot(spark.range(i, i + 1), path, "append")
    df = snapshots.read_snapshot(spark, path)
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert df.count() == 4


def test_upsert_changes_every_matching_row(spark, orders):
    """As MERGE does: each target row of a matched key takes the new values."""
    double = orders.unionByName(orders.filter("id = 1"))
    new = spark.createDataFrame([(1, "n", 5.0)], orders.schema)
    got = rows(snapshots.merged(double, new, ["id"]).filter("id = 1"))
    assert got == [(1, "n", 5.0), (1, "n", 5.0)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, how):
    big = spark.range(2000).select(
        F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50).alias("k"),
        F.col("id").alias("v"),
    )
    small = spark.range(1, 30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    plain = rows(big.join(small, "k", how))
    assert rows(joins.salted_join(big, small, ["k"], 5, how)) == plain
    assert rows(joins.salted_join(big, small, ["k"], 5, how, rows_per_task=20)) == plain
    hot = find_hot_keys(big, ["k"], 500)
    assert hot.count == 1 and hot.total_rows == hot.table.first()["_hot_rows"] > 1000
    assert rows(joins.salted_join(big, small, ["k"], 5, how, hot)) == plain
    assert rows(joins.broadcast_join(big, small, ["k"], how)) == plain
    assert rows(joins.broadcast_join(big, small, ["k"], how, max_bytes=0)) == plain


def test_salted_join_of_unequal_key_types(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    for kind in ("int", "decimal(20,0)", "double"):
        small = spark.range(2).select(F.col("id").cast(kind).alias("k"), F.lit("x").alias("w"))
        got = joins.salted_join(big, small, ["k"], 4, "left", rows_per_task=100)
        assert got.schema["k"].dataType == big.schema["k"].dataType
        assert rows(got) == rows(big.join(small, "k", "left"))


def test_salted_join_rejects_right(spark):
    with pytest.raises(ValueError):
        joins.salted_join(spark.range(1), spark.range(1), ["id"], how="right")


def test_broadcast_is_size_checked(spark):
    small = spark.range(10).withColumn("s", F.lit("x"))
    assert 0 < joins.measured_bytes(small) < 2000
    big = spark.range(10).join(small, "id")
    kept = joins.broadcast_join(spark.range(10), small, ["id"])._jdf.queryExecution().toString()
    assert "strategy=broadcast" in kept
    refused = joins.broadcast_join(spark.range(10), small, ["id"], max_bytes=1)
    assert "strategy=broadcast" not in refused._jdf.queryExecution().toString()
    assert big.count() == 10


def test_layout(spark):
    df = spark.range(1000)
    one = layout.partition_profile(layout.repartition_to(df, 8)).first()
    assert one["num_partitions"] == 8 and one["avg_size"] == 125
    assert layout.coalesce_to(df.repartition(8), 1000, 8).rdd.getNumPartitions() == 1
    assert layout.coalesce_to(df.repartition(8), 10**6, 8).rdd.getNumPartitions() == 8
    assert layout.coalesce_if_needed(df.repartition(8)).rdd.getNumPartitions() == 1
    assert layout.coalesce_if_needed(df.repartition(8), 100).rdd.getNumPartitions() == 8
    assert layout.compact(df).count() == 1000
    seen = layout.map_batches(df, lambda b: b.assign(n=len(b))[["id", "n"]], "id long, n long", 100)
    assert seen.agg(F.max("n"), F.count("id")).first() == (100, 1000)


def test_size_shuffles(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.range(100_000).write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    assert layout.size_shuffles(df) == spark.sparkContext.defaultParallelism
    assert layout.size_shuffles(df, partition_bytes=10_000) > 20
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_synthetic(spark):
    df = generated(spark, 20_000, 8)
    same = generated(spark, 20_000, 3)
    assert df.exceptAll(same).count() == 0
    assert generated(spark, 20_000, 3, seed=1).exceptAll(df).count() > 19_000
    one = df.agg(F.avg("is_fraud"), F.count_distinct("transaction_id"), F.count_distinct("merchant_category"), F.min("transaction_time"), F.max("transaction_time")).first()
    assert 0.008 < one[0] < 0.016 and one[1] == 20_000 and one[2] == 12
    assert one[3] >= "2023-01-01" and one[4] <= "2024-12-31T00:00:00"
    legal = df.filter("merchant_category = 'travel' AND is_fraud = 0").agg(F.min("amount"), F.max("amount")).first()
    assert 100 <= legal[0] and legal[1] <= 5000


# ---- job and streams ----------------------------------------------------------------------------


def test_job(spark, tmp_path):
    df = generated(spark, 500, 2)
    files.write_csv(df.unionByName(df), f"{tmp_path}/raw")
    config = JobConfig(input_path=f"{tmp_path}/raw", output_path=f"{tmp_path}/out", schema=df.schema)
    done = run_job(spark, config)
    assert done.metrics["extract_count"] == 1000 and done.metrics["transform_count"] == 500
    assert done.output.count() == 500
    assert {"year", "month", "amount_category", "amount_log"} <= set(done.output.columns)
    assert (tmp_path / "out" / "year=2023").exists()
    files.write_csv(df.withColumn("city", F.lit(None).cast("string")), f"{tmp_path}/bad")
    bad = JobConfig(input_path=f"{tmp_path}/bad", output_path=f"{tmp_path}/o2", schema=df.schema, max_null_ratio=0.1)
    with pytest.raises(JobError, match="city") as failed:
        run_job(spark, bad)
    assert failed.value.metrics["success"] is False
    assert not (tmp_path / "o2").exists() and not list(tmp_path.glob("o2.staged*"))
    again = JobConfig(input_path=f"{tmp_path}/raw", output_path=f"{tmp_path}/out", schema=df.schema, min_rows=501)
    with pytest.raises(JobError, match="501"):
        run_job(spark, again)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 500
    unchecked = JobConfig(
        input_path=f"{tmp_path}/raw", output_path=f"{tmp_path}/csv", output_format="csv", schema=df.schema,
        min_rows=501, enable_checks=False,
    )
    assert run_job(spark, unchecked).output.count() == 500
    assert (tmp_path / "csv" / "year=2023").exists()
    with pytest.raises(ValueError, match="unsupported"):
        JobConfig(output_format="json")


def wait(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_stream_equals_batch(spark, tmp_path):
    df = generated(spark, 300, 1)
    for i in range(3):
        part = df.filter(F.substring("transaction_id", 5, 10).cast("int") % 3 == i)
        part.coalesce(1).write.mode("append").csv(f"{tmp_path}/in", header=True)
    source = stream.read_stream(spark, f"{tmp_path}/in", df.schema)
    query = stream.ingest(source, f"{tmp_path}/out", f"{tmp_path}/progress", stream.scored)
    wait(query)
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 3
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(stream.scored(df))
    again = stream.ingest(source, f"{tmp_path}/out", f"{tmp_path}/progress", stream.scored)
    wait(again)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 300


def test_stream_archives_files(spark, tmp_path):
    df = generated(spark, 60, 1)
    for _ in range(2):
        df.coalesce(1).write.mode("append").csv(f"{tmp_path}/in", header=True)
    source = stream.read_stream(spark, f"{tmp_path}/in", df.schema, archive=f"{tmp_path}/done")
    for _ in range(2):
        wait(stream.ingest(source, f"{tmp_path}/out", f"{tmp_path}/cp"))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 120
    assert list((tmp_path / "done").rglob("*.csv"))


def test_stream_upsert_and_checks(spark, tmp_path):
    df = generated(spark, 200, 1).select("transaction_id", "amount")
    later = df.limit(50).withColumn("amount", F.lit(1.0))
    df.write.csv(f"{tmp_path}/in/a", header=True)
    later.coalesce(1).write.csv(f"{tmp_path}/in/b", header=True)
    source = stream.read_stream(spark, f"{tmp_path}/in/*", df.schema)
    checks = (NullCheck(("transaction_id",), 0.0), RangeCheck({"amount": (0, 1e6)}))
    wait(stream.checked_upsert(source, f"{tmp_path}/t", f"{tmp_path}/cp", ["transaction_id"], *checks))
    got = snapshots.read_snapshot(spark, f"{tmp_path}/t")
    assert got.count() == 200 and got.filter("amount = 1.0").count() == 50
    held = snapshots.versions(spark, f"{tmp_path}/t").count()
    wait(stream.checked_upsert(source, f"{tmp_path}/t", f"{tmp_path}/cp", ["transaction_id"], *checks))
    assert snapshots.versions(spark, f"{tmp_path}/t").count() == held >= 2
    strict = stream.checked_upsert(
        source, f"{tmp_path}/t2", f"{tmp_path}/cp2", ["transaction_id"], RangeCheck({"amount": (0, 2)})
    )
    with pytest.raises(Exception, match="range"):
        strict.awaitTermination(120)


def test_stream_with_batch_statistics(spark, tmp_path):
    df = generated(spark, 100, 1)
    df.write.csv(f"{tmp_path}/in", header=True)
    stats = df.groupBy("customer_id").agg(F.avg("amount").alias("usual"))
    source = stream.read_stream(spark, f"{tmp_path}/in", df.schema)
    joined = stream.with_customer_stats(source, stats, ["customer_id"])
    wait(stream.ingest(joined, f"{tmp_path}/out", f"{tmp_path}/cp"))
    assert spark.read.parquet(f"{tmp_path}/out").filter("usual IS NOT NULL").count() == 100
