"""Joins, windows, set operations and layout."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalog.base import CUT_ROWS, big, pick, query, rounded, table, txn
from swipelake.operators import joins, layout
from swipelake.operators.windows import (
    KeyedWindows,
    lag_periods,
    rank_in_group,
    session_summary,
    sessionize,
)
from swipelake.skew import group_medians, group_stats

def _orders(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"
    )


def _broadcast(spark, folder, how, suppliers=None):
    suppliers = table(spark, folder, "supplier") if suppliers is None else suppliers
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    return joins.broadcast_join(lines, suppliers, ["s_suppkey"], how)


_JOINED = "lineitem l {how} JOIN {side} s ON l.l_suppkey = s.s_suppkey"
_LINES = "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber"


@query(
    "broadcast_join",
    f"{_LINES}, l_suppkey AS s_suppkey, s_name FROM {_JOINED.format(how='INNER', side='supplier')}",
)
def broadcast_join(spark, folder):
    df = _broadcast(spark, folder, "inner")
    return big(df.select("l_orderkey", "l_linenumber", "s_suppkey", "s_name"))


# Suppliers in debt: lines of all others have no partner here.
_IN_DEBT = "(SELECT * FROM supplier WHERE s_acctbal < 0)"


@query(
    "broadcast_join_left",
    f"{_LINES}, l_suppkey AS s_suppkey, s_name FROM {_JOINED.format(how='LEFT', side=_IN_DEBT)}",
)
def broadcast_join_left(spark, folder):
    df = _broadcast(spark, folder, "left", table(spark, folder, "supplier").filter("s_acctbal < 0"))
    return big(df.select("l_orderkey", "l_linenumber", "s_suppkey", "s_name"))


@query("broadcast_join_semi", f"{_LINES} FROM {_JOINED.format(how='SEMI', side='supplier')}")
def broadcast_join_semi(spark, folder):
    return big(_broadcast(spark, folder, "left_semi").select("l_orderkey", "l_linenumber"))


@query("broadcast_join_anti", f"{_LINES} FROM {_JOINED.format(how='ANTI', side=_IN_DEBT)}")
def broadcast_join_anti(spark, folder):
    in_debt = table(spark, folder, "supplier").filter("s_acctbal < 0")
    return big(_broadcast(spark, folder, "left_anti", in_debt).select("l_orderkey", "l_linenumber"))


@query(
    "lookup_map",
    """
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other' END AS status
FROM orders
""",
)
def lookup_map(spark, folder):
    status = joins.lookup(F.col("o_orderstatus"), {"O": "open", "F": "filled"}, "other")
    return table(spark, folder, "orders").select("o_orderkey", status.alias("status"))


_PER_CUSTOMER = """
SELECT o_custkey, count(*) AS lines, rnd(sum(l_extendedprice), 2) AS price
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey
"""


def _per_customer(joined):
    return rounded(
        joined.groupBy("o_custkey").agg(
            F.count(F.lit(1)).alias("lines"), F.sum("l_extendedprice").alias("price")
        ),
        2,
    )


@query("join_colocated", _PER_CUSTOMER)
def join_colocated(spark, folder):
    orders = joins.colocated(_orders(spark, folder), ["o_orderkey"])
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return _per_customer(orders.join(joins.colocated(lines, ["o_orderkey"]), "o_orderkey"))


@query(
    "join_bucketed",
    """
SELECT o_orderkey, l_linenumber::BIGINT AS l_linenumber, o_custkey, rnd(l_extendedprice / o_totalprice, 6) AS part,
       row_number() OVER (PARTITION BY o_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS place,
       count(*) OVER (PARTITION BY o_orderkey) AS lines
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
""",
)
def join_bucketed(spark, folder):
    """Orders and lines stored by order key; the join and the windows find each order in one place."""
    orders, lines = _bucketed(spark, folder)
    by_order = Window.partitionBy("o_orderkey")
    ranked = by_order.orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber")
    made = joins.bucketed_join(lines, orders, ["o_orderkey"]).select(
        "o_orderkey",
        "l_linenumber",
        "o_custkey",
        (F.col("l_extendedprice") / F.col("o_totalprice")).alias("part"),
        F.row_number().over(ranked).cast("long").alias("place"),
        F.count(F.lit(1)).over(by_order).alias("lines"),
    )
    return big(rounded(made, 6))


def _bucketed(spark, folder, buckets=None):
    orders = _orders(spark, folder)
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    buckets = buckets or joins.bucket_count(orders, lines, least=8)
    return joins.bucketed(orders, ["o_orderkey"], buckets), joins.bucketed(lines, ["o_orderkey"], buckets)


@query(
    "salted_join",
    """
SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey, count(*) AS lines, round(sum(l_extendedprice), 2) AS price
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_nationkey
""",
)
def salted_join(spark, folder):
    """Busy suppliers count as hot keys."""
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    cut = CUT_ROWS
    joined = joins.salted_join(lines, suppliers, ["s_suppkey"], 8, rows_per_task=cut)
    made = joined.groupBy("s_suppkey", "s_nationkey").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price")
    )
    return big(made)


@query("union_all", "SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer")
def union_all(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("k"))
    return orders.unionByName(table(spark, folder, "customer").select(F.col("c_custkey").alias("k")))


@query("distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct(spark, folder):
    return table(spark, folder, "lineitem").select("l_suppkey", "l_returnflag").distinct()


# ---- windows --------------------------------------------------------------------------------


def _windows(spark, folder, rows_per_task=None, descending=False):
    return KeyedWindows(
        _orders(spark, folder),
        "o_custkey",
        "o_orderdate",
        tie_break="o_orderkey",
        descending=descending,
        rows_per_task=rows_per_task,
    )


_ROWS = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_RANKS = "(PARTITION BY o_custkey ORDER BY o_orderdate)"


@query(
    "running_total",
    f"SELECT o_orderkey, rnd(sum(o_totalprice) OVER {_ROWS} ROWS UNBOUNDED PRECEDING), 2) AS running_total FROM orders",
)
def running_total(spark, folder):
    df = _windows(spark, folder).running_total("o_totalprice", "running_total").result()
    return rounded(df.select("o_orderkey", "running_total"), 2)


@query(
    "running_avg",
    f"SELECT o_orderkey, rnd(avg(o_totalprice) OVER {_ROWS} ROWS UNBOUNDED PRECEDING), 3) AS running_avg FROM orders",
)
def running_avg(spark, folder):
    df = _windows(spark, folder).running_average("o_totalprice", "running_avg").result()
    return rounded(df.select("o_orderkey", "running_avg"), 3)


@query(
    "rank_dense",
    f"SELECT o_orderkey, rank() OVER {_RANKS} AS rnk, dense_rank() OVER {_RANKS} AS drnk FROM orders",
)
def rank_dense(spark, folder):
    df = _windows(spark, folder).rank("rnk").rank("drnk", dense=True).result()
    return big(df.select("o_orderkey", "rnk", "drnk"))


@query(
    "rank_in_group",
    "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS rnk FROM orders",
)
def rank_in_group_(spark, folder):
    df = rank_in_group(_orders(spark, folder), "o_custkey", "o_orderdate", "rnk")
    return big(df.select("o_orderkey", "rnk"))


@query("row_number", f"SELECT o_orderkey, row_number() OVER {_ROWS}) AS rn FROM orders")
def row_number(spark, folder):
    return big(_windows(spark, folder).row_number("rn").result().select("o_orderkey", "rn"))


@query(
    "lag_multi",
    f"""
SELECT o_orderkey, rnd(lag(o_totalprice, 1) OVER {_ROWS}), 2) AS o_totalprice_lag_1,
       rnd(lag(o_totalprice, 7) OVER {_ROWS}), 2) AS o_totalprice_lag_7,
       rnd(lag(o_totalprice, 30) OVER {_ROWS}), 2) AS o_totalprice_lag_30 FROM orders
""",
)
def lag_multi(spark, folder):
    df = lag_periods(
        _orders(spark, folder), "o_totalprice", "o_custkey", "o_orderdate", tie_break="o_orderkey"
    )
    return rounded(df.select("o_orderkey", *[f"o_totalprice_lag_{p}" for p in (1, 7, 30)]), 2)


@query("lead", f"SELECT o_orderkey, rnd(lead(o_totalprice, 2) OVER {_ROWS}), 2) AS nxt FROM orders")
def lead(spark, folder):
    df = _windows(spark, folder).lead("o_totalprice", 2, "nxt").result()
    return rounded(df.select("o_orderkey", "nxt"), 2)


@query(
    "pct_change",
    f"""
WITH p AS (SELECT o_orderkey, o_totalprice AS x, lag(o_totalprice) OVER {_ROWS}) AS b FROM orders)
SELECT o_orderkey, CASE WHEN b IS NOT NULL AND b <> 0 THEN rnd((x - b) / b * 100, 3) END AS pct FROM p
""",
)
def pct_change(spark, folder):
    df = _windows(spark, folder).percent_change("o_totalprice", "pct").result()
    return rounded(df.select("o_orderkey", "pct"), 3)


@query(
    "moving_avg",
    f"SELECT o_orderkey, rnd(avg(o_totalprice) OVER {_ROWS} ROWS 6 PRECEDING), 3) AS ma FROM orders",
)
def moving_avg(spark, folder):
    df = _windows(spark, folder).moving_average("o_totalprice", 7, "ma").result()
    return rounded(df.select("o_orderkey", "ma"), 3)


@query("ntile", f"SELECT o_orderkey, ntile(4) OVER {_ROWS}) AS quartile FROM orders")
def ntile(spark, folder):
    return big(_windows(spark, folder).ntile(4).result().select("o_orderkey", "quartile"))


_BY_USER = "(PARTITION BY user_id ORDER BY ts, event_id"


@query(
    "windows_hot_keys",
    f"""
SELECT event_id, rnd(sum(value) OVER {_BY_USER} ROWS UNBOUNDED PRECEDING), 2) AS total,
       rnd(avg(value) OVER {_BY_USER} ROWS UNBOUNDED PRECEDING), 3) AS average,
       row_number() OVER {_BY_USER}) AS rn, ntile(5) OVER {_BY_USER}) AS tile,
       rank() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts)) AS rnk,
       dense_rank() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts)) AS drnk,
       rnd(lag(value, 7) OVER {_BY_USER}), 2) AS lag7, rnd(lead(value) OVER {_BY_USER}), 2) AS lead1,
       rnd(avg(value) OVER {_BY_USER} ROWS 6 PRECEDING), 3) AS ma
FROM events
""",
)
def windows_hot_keys(spark, folder):
    """The same windows with every busy user treated as a hot key and cut into pieces."""
    df = table(spark, folder, "events").select(
        "event_id", "user_id", "ts", F.date_trunc("day", "ts").alias("day"), "value"
    )
    made = (
        KeyedWindows(df, "user_id", "day", tie_break=["ts", "event_id"], rows_per_task=CUT_ROWS)
        .running_total("value", "total")
        .running_average("value", "average")
        .row_number("rn")
        .ntile(5, "tile")
        .rank("rnk")
        .rank("drnk", dense=True)
        .lag("value", 7, "lag7")
        .lead("value", 1, "lead1")
        .moving_average("value", 7, "ma")
        .result()
    )
    made = made.drop("user_id", "ts", "day", "value")
    return big(rounded(rounded(made, 2, "total", "lag7", "lead1"), 3, "average", "ma"))


_SESSIONS = """
WITH g AS (SELECT *, epoch(ts)::BIGINT AS sec, lag(epoch(ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev
           FROM (SELECT event_id, user_id, value, date_trunc('second', ts) AS ts FROM events)),
     s AS (SELECT *, sum(CASE WHEN prev IS NULL OR sec - prev > {gap} THEN 1 ELSE 0 END)
             OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_id FROM g)
"""


def _events(spark, folder):
    return table(spark, folder, "events").select("event_id", "user_id", "value", "ts")


@query("sessionize", _SESSIONS.format(gap=1800) + "SELECT event_id, session_id FROM s")
def sessionize_(spark, folder):
    df = sessionize(_events(spark, folder), "user_id", "ts", 30, "event_id")
    return df.select("event_id", "session_id")


@query("sessionize_hot_keys", _SESSIONS.format(gap=43200) + "SELECT event_id, session_id FROM s")
def sessionize_hot_keys(spark, folder):
    events = _events(spark, folder)
    df = sessionize(events, "user_id", "ts", 720, "event_id", rows_per_task=CUT_ROWS)
    return df.select("event_id", "session_id")


@query(
    "session_summary",
    _SESSIONS.format(gap=43200)
    + """SELECT user_id, session_id, count(*) AS events, max(sec) - min(sec) AS seconds,
       rnd(sum(value), 2) AS total_amount FROM s GROUP BY user_id, session_id""",
)
def session_summary_(spark, folder):
    sessions = sessionize(_events(spark, folder), "user_id", "ts", 720, "event_id")
    return rounded(session_summary(sessions, "user_id", "ts", "value"), 2)


# ---- layout ---------------------------------------------------------------------------------


def _by_status(spark, folder):
    """Orders with one partition for each status."""
    orders = table(spark, folder, "orders").filter("o_orderstatus IN ('F', 'O', 'P')")
    return orders.repartitionById(3, F.instr(F.lit("FOP"), F.col("o_orderstatus")) - 1)


@query(
    "partition_profile",
    """
SELECT count(*) AS num_partitions, min(n) AS min_size, max(n) AS max_size, avg(n) AS avg_size
FROM (SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY o_orderstatus)
""",
)
def partition_profile(spark, folder):
    return layout.partition_profile(_by_status(spark, folder))


@query(
    "coalesce_if_needed",
    """
SELECT CASE WHEN n / p >= 10000 THEN p ELSE greatest(1, n // 10000) END::BIGINT AS num_partitions, n AS total
FROM (SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS p FROM orders WHERE o_orderstatus IN ('F', 'O', 'P'))
""",
)
def coalesce_if_needed(spark, folder):
    found = layout.partition_profile(layout.coalesce_if_needed(_by_status(spark, folder)))
    total = (F.col("avg_size") * F.col("num_partitions")).cast("long").alias("total")
    return found.select("num_partitions", total)


@query(
    "compact",
    """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_extendedprice, l_discount,
       l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem
""",
)
def compact(spark, folder):
    return big(layout.compact(table(spark, folder, "lineitem")))


@query(
    "map_batches",
    "SELECT event_id, rnd(value * 2 + 1, 4) AS doubled FROM events",
)
def map_batches(spark, folder):
    def double(batch):
        return batch.assign(doubled=(batch["value"] * 2 + 1).round(4))[["event_id", "doubled"]]

    df = table(spark, folder, "events").select("event_id", "value")
    return rounded(layout.map_batches(df, double, "event_id bigint, doubled double", 1000), 4)


@query(
    "sql_over",
    "SELECT category, count(*) AS n FROM txn WHERE amount > 50 GROUP BY category",
)
def sql_over(spark, folder):
    from swipelake.sources.files import sql_over as over

    text = "SELECT category, count(*) AS n FROM {t} WHERE amount > 50 GROUP BY category"
    return over(text, t=txn(spark, folder))


@query(
    "group_stats",
    """
SELECT event_id, count(*) OVER (PARTITION BY event_type) AS n, rnd(avg(value) OVER (PARTITION BY event_type), 4) AS mean
FROM events
""",
)
def group_stats_(spark, folder):
    df = table(spark, folder, "events").select("event_id", "event_type", "value")
    aggs = {"n": F.count(F.lit(1)), "mean": F.avg("value")}
    return pick(group_stats(df, ["event_type"], aggs, rows_per_task=CUT_ROWS), "event_id", "n", "mean")


@query(
    "group_medians",
    """
SELECT customer_id, quantile_disc(amount, 0.5) AS median_amount,
       quantile_disc(merchant_id, 0.5)::BIGINT AS median_merchant, quantile_disc(lat, 0.5) AS median_lat
FROM txn GROUP BY customer_id
""",
)
def group_medians_(spark, folder):
    """Exact medians, with every busy customer cut into pieces."""
    medians = {"median_amount": "amount", "median_merchant": "merchant_id", "median_lat": "lat"}
    return big(group_medians(txn(spark, folder), ["customer_id"], medians, rows_per_task=CUT_ROWS))
