"""What only shows on larger tables, on small ones made for it."""

from datetime import datetime, timedelta

import duckdb

from catalog import source_queries
from catalog.base import REGISTRY
from swipelake.operators import joins
from swipelake.plans import model
from swipelake.streaming import ingest
from tests.compare import differences

SMALL = "/root/testdata/sf0.001"


def test_batches_are_cut_at_the_nearest_second(spark, tmp_path):
    """Two rows lie in one second, on both sides of the first cut."""
    seconds = [0, 1.25, 3.4, 3.5, 3.75, 4.5, 7.25, 7.75, 11.25]
    start = datetime(2024, 1, 1)
    made = [(i, start + timedelta(seconds=s), i % 2, "view", float(i), '{"k": 1}') for i, s in enumerate(seconds)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(made, schema).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("customer", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    found = source_queries.stream_with_stats(spark, str(tmp_path))
    assert differences(found, con, REGISTRY["stream_with_stats"].sql) is None


def test_buckets_grow_with_the_tables(spark):
    """A bucket, which one task sorts, keeps its size; the larger table decides."""
    tables = [spark.range(30), spark.range(95)]
    assert joins.bucket_count(*tables, rows_per_bucket=10) == 10
    assert joins.bucket_count(*tables, least=12, rows_per_bucket=10) == 12
    n = joins.bucket_count(*tables, rows_per_bucket=10)
    held = [joins.bucketed(t, ["id"], n) for t in tables]
    joined = joins.bucketed_join(held[1], held[0], ["id"])
    assert joined.rdd.getNumPartitions() == n and joined.count() == 30


def test_forest_keeps_the_places_of_rows(spark, monkeypatch):
    """No level of a tree starts from the root again, and the trees are those of the plain search."""
    rows = spark.range(400).selectExpr("id % 7 AS a", "id % 11 AS b", "CAST(id % 7 > 3 AND id % 11 > 4 AS INT) AS is_fraud")
    inputs = model.ModelInputs(("a", "b"), ())
    asked, real = [], model.RandomForestClassifier

    def forest(**options):
        asked.append(options)
        return real(**options)

    monkeypatch.setattr(model, "RandomForestClassifier", forest)
    kept = model.train(rows, inputs, trees=5, depth=4).stages[-1]
    assert asked[0]["cacheNodeIds"]
    monkeypatch.setattr(model, "RandomForestClassifier", lambda **o: real(**{**o, "cacheNodeIds": False}))
    plain = model.train(rows, inputs, trees=5, depth=4).stages[-1]
    assert [t.toDebugString.split("\n", 1)[1] for t in kept.trees] == [t.toDebugString.split("\n", 1)[1] for t in plain.trees]


def test_batches_of_changes_do_not_grow_with_their_files(spark, monkeypatch):
    """Each batch of changes meets one batch of rows, however many files and splits there are."""
    merges, real = [], ingest.upsert
    monkeypatch.setattr(ingest, "upsert", lambda *given, **named: merges.append(real(*given, **named)))
    split = "spark.sql.files.maxPartitionBytes"
    held = spark.conf.get(split)
    spark.conf.set(split, "4096")
    try:
        found = source_queries.stream_upsert(spark, SMALL, rows_per_file=100)
    finally:
        spark.conf.set(split, held)
    assert [(m.inserted > 0, m.updated > 0) for m in merges] == 3 * [(True, False)] + 3 * [(False, True)]
    con = duckdb.connect()
    for name in ("events", "customer", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    assert differences(found, con, REGISTRY["stream_upsert"].sql) is None
