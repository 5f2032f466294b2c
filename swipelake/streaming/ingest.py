"""Micro-batch ingest: every file of a folder once, oldest first, exactly once into the sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from swipelake.columns import DEFAULT_COLUMNS, TxnColumns
from swipelake.functions import bands, scalars
from swipelake.operators.clean import Step, chain
from swipelake.operators.joins import broadcast_join
from swipelake.operators.quality import DuplicateCheck, NullCheck, RangeCheck, run_checks
from swipelake.scratch import written
from swipelake.sources.files import write_parquet
from swipelake.sources.snapshots import has_batch, read_snapshot, table_exists, upsert


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str,
    files_per_batch: int = 1,
    source_format: str = "csv",
    glob: str | None = None,
    archive: str | None = None,
    **options,
) -> DataFrame:
    """Files as they arrive, oldest first. The checkpoint remembers which were taken; with
    ``archive`` they are also moved to that folder once their batch is done."""
    reader = spark.readStream.format(source_format).schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch).options(**options)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if source_format == "csv":
        reader = reader.option("header", True)
    return reader.load(folder)


def ingest(
    stream: DataFrame,
    output: str,
    checkpoint: str,
    *steps: Step,
    continuous: bool = False,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Stateless steps, then Parquet. Stops when the folder is used up unless ``continuous``."""
    writer = chain(stream, *steps).writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start(output)


def scored(
    df: DataFrame,
    cols: TxnColumns = DEFAULT_COLUMNS,
    device: str = "device_type",
    kind: str = "transaction_type",
) -> DataFrame:
    """Row-wise scores that hold on a stream as well as on a table."""
    amount, ts = F.col(cols.amount), F.col(cols.timestamp).cast("timestamp")
    made = {
        "amount_category": bands.amount_category(amount),
        "time_of_day": scalars.hour_bucket_of(ts),
        "is_high_amount": F.coalesce(amount > 1000, F.lit(False)),
        "risk_score": scalars.risk_score(amount, F.col(cols.fraud), F.col(device), F.col(kind)),
    }
    return df.withColumns(made)


def with_customer_stats(stream: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics made by a batch job, joined to the stream: windows over a customer's whole
    history are not possible on a stream."""
    return stream.join(stats, keys, "left")


def renewed_stats(batch: DataFrame, held: DataFrame | None, cols: TxnColumns = DEFAULT_COLUMNS) -> DataFrame:
    """``held`` statistics of the customers in ``batch`` with its rows added: ``customer, txn_count, total_amount``."""
    own = F.col(cols.customer)
    fresh = batch.filter(own.isNotNull()).groupBy(own).agg(
        F.count(F.lit(1)).alias("txn_count"), F.sum(F.col(cols.amount).cast("double")).alias("total_amount")
    )
    if held is None:
        return fresh
    old = held.select(
        cols.customer, F.col("txn_count").alias("_count"), F.col("total_amount").alias("_total")
    )
    total = F.coalesce(F.col("total_amount") + F.col("_total"), "total_amount", "_total")
    return fresh.join(old, cols.customer, "left").select(
        cols.customer, (F.col("txn_count") + F.coalesce("_count", F.lit(0))).alias("txn_count"), total.alias("total_amount")
    )


def enrich_and_renew(
    stream: DataFrame, stats: str, output: str, checkpoint: str, cols: TxnColumns = DEFAULT_COLUMNS
) -> StreamingQuery:
    """Each micro-batch meets its customers' statistics of all batches before it, and then adds to them.

    ``stats`` is a versioned table of ``customer, txn_count, total_amount``. A batch goes to its own folder below
    ``output`` with ``customer_txn_before``, ``customer_avg_before`` and ``amount_vs_before`` (NULL for a customer not seen
    yet or without one); only then its version of the statistics is made. A batch that comes again after a failure
    finds either no version of it, and both steps are done anew from the same statistics, or its
    version, and nothing is left to do.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, f"{checkpoint}#{batch_id}"
        if has_batch(spark, stats, name):
            return
        rows = written(batch, "batch")
        known = read_snapshot(spark, stats) if table_exists(spark, stats) else None
        before = renewed_stats(rows.limit(0), None, cols) if known is None else known
        mean = F.try_divide(F.col("total_amount"), F.col("txn_count"))
        before = before.select(
            cols.customer, F.col("txn_count").alias("customer_txn_before"), mean.alias("customer_avg_before")
        )
        joined = broadcast_join(rows, before, [cols.customer], "left").select(
            *rows.columns,
            "customer_txn_before",
            "customer_avg_before",
            F.try_divide(F.col(cols.amount), F.col("customer_avg_before")).alias("amount_vs_before"),
        )
        write_parquet(joined, f"{output}/batch={batch_id}")
        upsert(renewed_stats(rows, known, cols), stats, [cols.customer], batch=name)

    return for_each_batch(stream, checkpoint, apply)


def for_each_batch(
    stream: DataFrame, checkpoint: str, action: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def checked_upsert(
    stream: DataFrame,
    table: str,
    checkpoint: str,
    keys: list[str],
    *checks: NullCheck | RangeCheck | DuplicateCheck,
) -> StreamingQuery:
    """Each micro-batch: run the checks, stop the stream if one fails, else upsert by key.

    The table remembers which batches of this checkpoint it has, so a batch repeated after a failure is
    skipped, whatever its keys are.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        if checks:
            failed = run_checks(batch, *checks).filter(~F.col("passed"))
            names = [f"{r['check']}({r['column_name']})" for r in failed.collect()]
            if names:
                raise ValueError(f"batch {batch_id} failed {names}")
        upsert(batch, table, keys, batch=f"{checkpoint}#{batch_id}")

    return for_each_batch(stream, checkpoint, apply)
