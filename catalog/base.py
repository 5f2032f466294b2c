"""The registry and the transaction view the queries run on."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swipelake.columns import TxnColumns

COLS = TxnColumns(
    category="category", timestamp="txn_ts", lon="lon", merch_lat="merch_lat", merch_lon="merch_lon"
)


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}

# The transaction view over events, customer and nation, for DuckDB.
_TXN_SQL = """txn AS (
SELECT e.event_id AS transaction_id, e.user_id AS customer_id,
       CAST(json_extract_string(e.props, '$.k') AS INT) AS merchant_id,
       e.event_type AS category, e.value AS amount, e.ts AS txn_ts,
       CASE WHEN (e.value > 120 AND (hour(e.ts) >= 22 OR hour(e.ts) <= 5))
              OR e.event_id % 97 = 0 THEN 1 ELSE 0 END AS is_fraud,
       CASE e.event_id % 4 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop'
            WHEN 2 THEN 'pos_terminal' END AS device_type,
       CASE e.event_id % 5 WHEN 0 THEN 'purchase' WHEN 1 THEN 'transfer' WHEN 2 THEN 'payment'
            WHEN 3 THEN 'refund' END AS transaction_type,
       CAST(25 + (e.user_id * 37 % 24) + CASE WHEN e.event_id % 20 = 0 THEN 3 ELSE 0 END
            AS DOUBLE) AS lat,
       CAST(-120 + (e.user_id * 53 % 50) AS DOUBLE) AS lon,
       CAST(25 + (e.user_id * 37 % 24) AS DOUBLE)
         + CAST(e.event_id % 50 AS DOUBLE) / CAST(10 AS DOUBLE) AS merch_lat,
       CAST(-120 + (e.user_id * 53 % 50) AS DOUBLE)
         + CAST(e.event_id % 7 AS DOUBLE) / CAST(10 AS DOUBLE) AS merch_lon,
       n.n_name AS state
FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id
              LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey)"""

# The same view with NULLs: no amount on every 7th row, no category on every 11th.
_HOLES_SQL = """holes AS (
SELECT transaction_id, customer_id, CAST(txn_ts AS VARCHAR) IS NULL AS no_ts,
       CASE WHEN transaction_id % 7 <> 0 THEN amount END AS amount,
       CASE WHEN transaction_id % 11 <> 0 THEN category END AS category,
       CASE WHEN transaction_id % 13 <> 0 THEN merchant_id END AS merchant_id
FROM txn)"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def placed(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions with the customer's state."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    home = customers.join(nations, F.expr("n_nationkey = c_nationkey"), "left")
    made = txn(spark, folder)
    return made.join(home, F.expr("c_custkey = customer_id"), "left").select(*made.columns, "state")


def txn(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions without the state, which needs two joins: for queries that do not read it."""
    return table(spark, folder, "events").selectExpr(
        "event_id AS transaction_id",
        "user_id AS customer_id",
        "CAST(get_json_object(props, '$.k') AS INT) AS merchant_id",
        "event_type AS category",
        "value AS amount",
        "ts AS txn_ts",
        "CASE WHEN (value > 120 AND (hour(ts) >= 22 OR hour(ts) <= 5)) OR event_id % 97 = 0"
        " THEN 1 ELSE 0 END AS is_fraud",
        "CASE event_id % 4 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop'"
        " WHEN 2 THEN 'pos_terminal' END AS device_type",
        "CASE event_id % 5 WHEN 0 THEN 'purchase' WHEN 1 THEN 'transfer' WHEN 2 THEN 'payment'"
        " WHEN 3 THEN 'refund' END AS transaction_type",
        "CAST(25 + (user_id * 37 % 24) + CASE WHEN event_id % 20 = 0 THEN 3 ELSE 0 END AS DOUBLE)"
        " AS lat",
        "CAST(-120 + (user_id * 53 % 50) AS DOUBLE) AS lon",
        "CAST(25 + (user_id * 37 % 24) AS DOUBLE) + CAST(event_id % 50 AS DOUBLE) / 10D"
        " AS merch_lat",
        "CAST(-120 + (user_id * 53 % 50) AS DOUBLE) + CAST(event_id % 7 AS DOUBLE) / 10D"
        " AS merch_lon",
    )


def holes(spark: SparkSession, folder: str) -> DataFrame:
    return txn(spark, folder).selectExpr(
        "transaction_id",
        "customer_id",
        "txn_ts IS NULL AS no_ts",
        "CASE WHEN transaction_id % 7 <> 0 THEN amount END AS amount",
        "CASE WHEN transaction_id % 11 <> 0 THEN category END AS category",
        "CASE WHEN transaction_id % 13 <> 0 THEN merchant_id END AS merchant_id",
    )


def _nudge(digits: int) -> float:
    return 0.137 * 10**-digits


def _expand_rounding(sql: str) -> str:
    """``rnd(x, d)`` to the SQL for what ``rounded`` does."""
    while (start := sql.rfind("rnd(")) >= 0:
        depth, comma, at = 1, 0, start + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            if sql[at] == "," and depth == 1:
                comma = at
            at += 1
        value, digits = sql[start + 4 : comma], int(sql[comma + 1 : at - 1])
        nudge = f"{_nudge(digits):.12f}"
        sql = f"{sql[:start]}round(({value}) + {nudge}::DOUBLE, {digits}){sql[at:]}"
    return sql


def twin(sql: str) -> str:
    """Put the view definitions a query names before it."""
    sql = _expand_rounding(sql)
    views = []
    if re.search(r"\b(txn|holes)\b", sql):
        views.append(_TXN_SQL)
    if re.search(r"\bholes\b", sql):
        views.append(_HOLES_SQL)
    body = sql.strip()
    if views and body[:5].upper() == "WITH ":
        return f"WITH {', '.join(views)}, {body[5:]}"
    return f"WITH {', '.join(views)} {body}" if views else body


def query(name: str, sql: str | None = None):
    """Register ``f(spark, folder)`` under ``name``, with the SQL that must give the same rows."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Entry(function, None if sql is None else twin(sql))
        return function

    return register


def rounded(df: DataFrame, digits: int = 4, *names: str) -> DataFrame:
    """Round double columns (or the named ones) for comparison with another engine.

    Averages of cents often lie exactly between two rounded values, where the last bit
    decides; a nudge of 0.137 units makes both engines decide alike. It leaves values of at
    most ``digits`` decimals as they are.
    """
    chosen = names or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(F.col(n) + F.lit(_nudge(digits)), digits) for n in chosen})


def big(df: DataFrame, *names: str) -> DataFrame:
    """Integer columns (or the named ones) as bigint."""
    chosen = names or [n for n, t in df.dtypes if t in ("int", "smallint", "tinyint")]
    return df.withColumns({n: F.col(n).cast("bigint") for n in chosen})


# Rows per task that make busy keys of a small table count as hot, so that its SQL twin checks the cut path.
CUT_ROWS = 50


def pick(df: DataFrame, *names: str | Column) -> DataFrame:
    return big(rounded(df.select(*names)))
