"""Scans, sinks, snapshots, upserts, generated rows, the job and the streams."""

from datetime import datetime

from pyspark.sql import functions as F

from catalog.base import COLS, big, query, rounded, table, txn
from swipelake.operators.joins import bucket_count
from swipelake.operators.quality import NullCheck, RangeCheck
from swipelake.plans.job import JobConfig, JobError, run_job
from swipelake.scratch import scratch_path, written
from swipelake.sources import files, snapshots
from swipelake.streaming import ingest as stream

_ORDER_COLUMNS = (
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
)
_ORDER_LIST = ", ".join(_ORDER_COLUMNS)


def _orders(spark, folder):
    return table(spark, folder, "orders").select(*_ORDER_COLUMNS)


@query("scan_csv", f"SELECT {_ORDER_LIST} FROM orders")
def scan_csv(spark, folder):
    df, path = _orders(spark, folder), scratch_path(spark, "csv")
    files.write_csv(df, path, delimiter="|")
    return files.read_csv(spark, path, df.schema, delimiter="|")


@query("scan_csv_inferred", f"SELECT {_ORDER_LIST} FROM orders")
def scan_csv_inferred(spark, folder):
    path = scratch_path(spark, "csv")
    files.write_csv(_orders(spark, folder), path)
    return big(files.read_csv(spark, path))


@query("scan_parquet", "SELECT l_orderkey, l_extendedprice FROM lineitem")
def scan_parquet(spark, folder):
    path = f"{folder}/lineitem.parquet"
    return files.read_parquet(spark, path, ["l_orderkey", "l_extendedprice"])


@query(
    "scan_json",
    "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def scan_json(spark, folder):
    df = big(table(spark, folder, "customer"), "c_nationkey")
    path = scratch_path(spark, "json")
    files.write_json(df, path)
    return files.read_json(spark, path, schema=df.schema)


@query(
    "scan_incremental",
    "SELECT event_id, user_id, value FROM events WHERE ts > TIMESTAMP '2024-01-10 12:00:00'",
)
def scan_incremental(spark, folder):
    table(spark, folder, "events")
    df = files.read_since(spark, f"{folder}/events.parquet", "ts", "2024-01-10 12:00:00")
    return df.select("event_id", "user_id", "value")


@query("scan_incremental_all", "SELECT event_id, value FROM events")
def scan_incremental_all(spark, folder):
    df = files.read_since(spark, f"{folder}/events.parquet", "ts")
    return df.select("event_id", "value")


@query("next_watermark", "SELECT max(event_id) AS watermark FROM events")
def next_watermark(spark, folder):
    return files.next_watermark(table(spark, folder, "events"), "event_id")


@query("sink_parquet", f"SELECT {_ORDER_LIST} FROM orders")
def sink_parquet(spark, folder):
    path = scratch_path(spark, "parquet")
    files.write_parquet(
        _orders(spark, folder), path, partition_by=["o_orderstatus", "absent"], compression="zstd"
    )
    return files.read_parquet(spark, path).select(*_ORDER_COLUMNS)


@query("sink_csv", f"SELECT {_ORDER_LIST} FROM orders UNION ALL SELECT {_ORDER_LIST} FROM orders")
def sink_csv(spark, folder):
    df, path = _orders(spark, folder), scratch_path(spark, "csv")
    files.write_csv(df, path, "append")
    files.write_csv(df, path, "append")
    return files.read_csv(spark, path, df.schema)


@query("sink_json", f"SELECT {_ORDER_LIST} FROM orders")
def sink_json(spark, folder):
    df, path = _orders(spark, folder), scratch_path(spark, "json")
    files.write_json(df, path, "error")
    return files.read_json(spark, path, schema=df.schema)


# ---- snapshots ------------------------------------------------------------------------------


def _three_versions(spark, folder):
    """0: open orders; 1: filled orders appended; 2: everything else, overwritten."""
    df, path = _orders(spark, folder), scratch_path(spark, "table")
    days = [datetime(2024, 1, day) for day in (1, 2, 3)]
    snapshots.write_snapshot(df.filter("o_orderstatus = 'O'"), path, committed_at=days[0])
    snapshots.write_snapshot(df.filter("o_orderstatus = 'F'"), path, "append", committed_at=days[1])
    rest = df.filter("o_orderstatus NOT IN ('O', 'F')")
    snapshots.write_snapshot(rest, path, partition_by=["o_orderpriority"], committed_at=days[2])
    return path


@query("snapshot_write", f"SELECT {_ORDER_LIST} FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def snapshot_write(spark, folder):
    return snapshots.read_snapshot(spark, _three_versions(spark, folder))


@query("snapshot_as_of_version", f"SELECT {_ORDER_LIST} FROM orders WHERE o_orderstatus IN ('O', 'F')")
def snapshot_as_of_version(spark, folder):
    return snapshots.read_snapshot(spark, _three_versions(spark, folder), version=1)


@query("snapshot_as_of_ts", f"SELECT {_ORDER_LIST} FROM orders WHERE o_orderstatus = 'O'")
def snapshot_as_of_ts(spark, folder):
    path = _three_versions(spark, folder)
    return snapshots.read_snapshot(spark, path, timestamp="2024-01-01 18:00:00")


@query(
    "snapshot_history",
    """
WITH c AS (SELECT count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'F') AS f,
                  count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS r FROM orders)
SELECT 0::BIGINT AS version, 'overwrite' AS operation, o AS row_count, o AS total_rows FROM c
UNION ALL SELECT 1, 'append', f, o + f FROM c UNION ALL SELECT 2, 'overwrite', r, r FROM c
""",
)
def snapshot_history(spark, folder):
    made = snapshots.history(spark, _three_versions(spark, folder))
    return made.select("version", "operation", "row_count", "total_rows")


def _changes(df):
    """Every third order at twice the price, and as many new orders."""
    some = df.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return some.unionByName(some.withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000_000))


_NEW_ORDERS = f"""SELECT o_orderkey + 100000000000, o_custkey, o_orderstatus, o_totalprice * 2, o_orderdate,
 o_orderpriority FROM orders WHERE o_orderkey % 3 = 0"""

_UPSERTED = f"""SELECT o_orderkey, o_custkey, o_orderstatus,
 CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
FROM orders UNION ALL {_NEW_ORDERS}"""


def _upserted(spark, folder, update=True, partition_by=()):
    df, path = _orders(spark, folder), scratch_path(spark, "table")
    snapshots.upsert(df, path, ["o_orderkey"], partition_by=partition_by)
    snapshots.upsert(_changes(df), path, ["o_orderkey"], update)
    return path


@query("upsert_update", _UPSERTED)
def upsert_update(spark, folder):
    return snapshots.read_snapshot(spark, _upserted(spark, folder))


@query("upsert_partitioned", _UPSERTED)
def upsert_partitioned(spark, folder):
    path = _upserted(spark, folder, partition_by=["o_orderstatus"])
    return snapshots.read_snapshot(spark, path)


@query("upsert_insert_only", f"SELECT {_ORDER_LIST} FROM orders UNION ALL {_NEW_ORDERS}")
def upsert_insert_only(spark, folder):
    return snapshots.read_snapshot(spark, _upserted(spark, folder, update=False))


@query("upsert_merged", _UPSERTED)
def upsert_merged(spark, folder):
    df = _orders(spark, folder)
    return snapshots.merged(df, _changes(df), ["o_orderkey"])


@query(
    "upsert_statistics",
    """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS m FROM orders)
SELECT 0::BIGINT AS version, 'overwrite' AS operation, n AS row_count, n AS total_rows, n AS inserted, 0::BIGINT AS updated FROM c
UNION ALL SELECT 1, 'upsert', n + m, n + m, m, m FROM c
""",
)
def upsert_statistics(spark, folder):
    """One folder holds all orders, so all are written anew with the new ones."""
    made = snapshots.history(spark, _upserted(spark, folder))
    return made.select("version", "operation", "row_count", "total_rows", "inserted", "updated")


@query("upsert_rewrite", f"SELECT {_ORDER_LIST} FROM orders")
def upsert_rewrite(spark, folder):
    """Every order replaced, then set back."""
    df, path = _orders(spark, folder), scratch_path(spark, "table")
    snapshots.upsert(df.withColumn("o_totalprice", F.lit(0.0)), path, ["o_orderkey"])
    snapshots.upsert(df, path, ["o_orderkey"])
    return snapshots.read_snapshot(spark, path)


@query(
    "append_widened",
    f"SELECT {_ORDER_LIST} FROM orders UNION ALL"
    " SELECT o_orderkey, (o_custkey % 1000)::BIGINT, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
)
def append_widened(spark, folder):
    """An INT column appended to a BIGINT one."""
    df, path = _orders(spark, folder), scratch_path(spark, "table")
    snapshots.write_snapshot(df, path)
    narrow = df.withColumn("o_custkey", (F.col("o_custkey") % 1000).cast("int"))
    snapshots.write_snapshot(narrow, path, "append")
    return snapshots.read_snapshot(spark, path)


# ---- job and streams --------------------------------------------------------------------------


@query(
    "job_batch",
    """
SELECT transaction_id, amount, CASE WHEN amount < 50 THEN 'micro' WHEN amount < 100 THEN 'small'
         WHEN amount < 500 THEN 'medium' WHEN amount < 1000 THEN 'large' ELSE 'premium' END AS amount_category,
       year(txn_ts) AS year, month(txn_ts) AS month FROM txn
""",
)
def job_batch(spark, folder):
    df = txn(spark, folder).select(
        "transaction_id", F.col("amount").alias("amt"), F.col("txn_ts").alias("trans_date_trans_time")
    )
    raw, out = scratch_path(spark, "raw"), scratch_path(spark, "job")
    files.write_csv(df.unionByName(df), raw)
    done = run_job(
        spark,
        JobConfig(
            input_path=raw, output_path=out, schema=df.schema, max_null_ratio=0.0, min_rows=1
        ),
    )
    if done.metrics["extract_count"] != 2 * done.metrics["transform_count"]:
        raise AssertionError(done.metrics)
    names = ("transaction_id", "amount", "amount_category", "year", "month")
    return big(done.output.select(*names))


@query("job_failed_check", "SELECT transaction_id, amount FROM txn")
def job_failed_check(spark, folder):
    """A run that fails its checks leaves the output of the run before."""
    df = txn(spark, folder).select("transaction_id", F.col("amount").alias("amt"))
    raw, fewer, out = (scratch_path(spark, n) for n in ("raw", "fewer", "job"))
    files.write_csv(df, raw)
    files.write_csv(df.filter("transaction_id % 2 = 0"), fewer)
    done = run_job(spark, JobConfig(input_path=raw, output_path=out, schema=df.schema))
    least = done.metrics["transform_count"]
    try:
        run_job(spark, JobConfig(input_path=fewer, output_path=out, schema=df.schema, min_rows=least))
    except JobError as error:
        if error.metrics["transform_count"] >= least:
            raise
    return spark.read.parquet(out).select("transaction_id", "amount")


def _batches(spark, folder, parts=3):
    """Transactions as a folder of CSV files, one for each range of ids, and their schema."""
    df = txn(spark, folder).select(
        "transaction_id",
        "customer_id",
        "amount",
        "txn_ts",
        "is_fraud",
        "device_type",
        "transaction_type",
    )
    path = scratch_path(spark, "incoming")
    files.write_csv(df.repartitionByRange(parts, "transaction_id"), path)
    return path, df.schema


def _arrive(rows, cuts, path, parts):
    """Append rows as CSV: those up to each cut before those above it, in ``parts`` files each."""
    third = sum((F.col("transaction_id") > cut).cast("int") for cut in cuts) + F.lit(0)
    for at in range(len(cuts) + 1):
        files.write_csv(rows.filter(third == at).repartition(parts), path, "append")


def _finish(started):
    started.awaitTermination()
    if started.exception() is not None:
        raise started.exception()


@query(
    "stream_ingest",
    "SELECT transaction_id, customer_id, amount, CAST(is_fraud AS BIGINT) AS is_fraud FROM txn",
)
def stream_ingest(spark, folder):
    path, schema = _batches(spark, folder)
    out = scratch_path(spark, "ingested")
    rows = stream.read_stream(spark, path, schema)
    _finish(stream.ingest(rows, out, scratch_path(spark, "progress")))
    made = spark.read.schema(schema).parquet(out)
    return big(made.select("transaction_id", "customer_id", "amount", "is_fraud"))


@query(
    "stream_scored",
    """
SELECT transaction_id, CASE WHEN amount < 50 THEN 'micro' WHEN amount < 100 THEN 'small' WHEN amount < 500 THEN 'medium'
         WHEN amount < 1000 THEN 'large' WHEN amount < 5000 THEN 'very_large' ELSE 'premium' END AS amount_category,
  CASE WHEN hour(txn_ts) >= 6 AND hour(txn_ts) < 12 THEN 'morning' WHEN hour(txn_ts) >= 12 AND hour(txn_ts) < 17 THEN 'afternoon'
       WHEN hour(txn_ts) >= 17 AND hour(txn_ts) < 21 THEN 'evening' ELSE 'night' END AS time_of_day,
  amount > 1000 AS is_high_amount,
  CAST(CASE WHEN amount > 5000 THEN 30 WHEN amount > 1000 THEN 15 WHEN amount > 500 THEN 5 ELSE 0 END
  + CASE device_type WHEN 'mobile' THEN 5 WHEN 'desktop' THEN 3 WHEN 'pos_terminal' THEN 1 ELSE 10 END
  + CASE transaction_type WHEN 'purchase' THEN 1 WHEN 'transfer' THEN 10 WHEN 'payment' THEN 3 WHEN 'refund' THEN 5 ELSE 5 END
  + CASE WHEN is_fraud <> 0 THEN 50 ELSE 0 END AS DOUBLE) AS risk_score
FROM txn
""",
)
def stream_scored(spark, folder):
    path, schema = _batches(spark, folder)
    out = scratch_path(spark, "scored")
    rows = stream.read_stream(spark, path, schema)
    _finish(stream.ingest(rows, out, scratch_path(spark, "progress"), lambda d: stream.scored(d, COLS)))
    names = ("transaction_id", "amount_category", "time_of_day", "is_high_amount", "risk_score")
    return spark.read.parquet(out).select(*names)


@query(
    "stream_upsert",
    "SELECT transaction_id, customer_id, CASE WHEN transaction_id % 4 = 0 THEN amount + 1 ELSE amount END AS amount"
    " FROM txn",
)
def stream_upsert(spark, folder, rows_per_file=1_000_000):
    """Checked micro-batches upserted into a versioned table; the last ones change rows of the first.

    New rows and changes come in three batches each, whatever the size, and a batch of changes meets one batch of rows.
    """
    rows = txn(spark, folder).select(
        "transaction_id", "customer_id", "amount", "txn_ts", "is_fraud", "device_type", "transaction_type"
    )
    cuts = rows.agg(F.percentile_approx("transaction_id", [1 / 3, 2 / 3]).alias("cuts")).first()["cuts"] or []
    # So many files make a batch.
    parts = bucket_count(rows, rows_per_bucket=3 * rows_per_file)
    path, target, progress = (scratch_path(spark, n) for n in ("incoming", "table", "progress"))
    checks = (NullCheck(("transaction_id",), 0.0), RangeCheck({"amount": (0, 1_000_000)}))
    later = rows.filter("transaction_id % 4 = 0").withColumn("amount", F.col("amount") + 1)
    for arriving in (rows, later):
        _arrive(arriving, cuts, path, parts)
        taken = stream.read_stream(spark, path, rows.schema, files_per_batch=parts)
        _finish(stream.checked_upsert(taken, target, progress, ["transaction_id"], *checks))
    made = snapshots.versions(spark, target).count()
    if made < 3:
        raise AssertionError(f"{made} versions")
    return snapshots.read_snapshot(spark, target).select("transaction_id", "customer_id", "amount")


@query(
    "stream_with_stats",
    """
WITH b AS (SELECT t.*, least(2, (3 * (epoch(txn_ts)::BIGINT - low)) // (high - low + 1)) AS k
  FROM txn t, (SELECT min(epoch(txn_ts)::BIGINT) AS low, max(epoch(txn_ts)::BIGINT) AS high FROM txn)),
g AS (SELECT customer_id, k, count(*) AS n, sum(amount) AS a FROM b GROUP BY customer_id, k),
p AS (SELECT customer_id, k, sum(n) OVER w AS n, sum(a) OVER w AS a FROM g
  WINDOW w AS (PARTITION BY customer_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT transaction_id, p.n::BIGINT AS customer_txn_before, rnd(p.a / p.n, 4) AS customer_avg_before
FROM b LEFT JOIN p ON p.customer_id = b.customer_id AND p.k = b.k
""",
)
def stream_with_stats(spark, folder):
    """Three batches, oldest transactions first: each meets the statistics that the ones before have made."""
    rows = txn(spark, folder).select("transaction_id", "customer_id", "amount", "txn_ts")
    # Batches are cut at the nearest whole second.
    second = F.rint(F.unix_micros(F.col("txn_ts").cast("timestamp")) / 1_000_000).cast("long")
    ends = rows.agg(F.min(second).alias("low"), F.max(second).alias("high")).first()
    third = F.least(F.lit(2), F.floor(3 * (second - ends["low"]) / (ends["high"] - ends["low"] + 1)))
    path, stats, out, progress = (scratch_path(spark, n) for n in ("arrived", "stats", "enriched", "progress"))
    for batch in range(3):
        files.write_csv(rows.filter(third == batch), path, "append")
        arriving = stream.read_stream(spark, path, rows.schema, files_per_batch=1_000_000)
        _finish(stream.enrich_and_renew(arriving, stats, out, progress, COLS))
    if snapshots.versions(spark, stats).count() != 3:
        raise AssertionError("each batch renews the statistics once")
    made = spark.read.parquet(out).select("transaction_id", "customer_txn_before", "customer_avg_before")
    return rounded(made, 4)
