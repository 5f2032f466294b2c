"""Hot keys cut into pieces must give what plain windows give."""

import re

import pytest
from pyspark.sql import functions as F

from catalog import joins_windows
from swipelake.operators.windows import KeyedWindows, rank_in_group, sessionize
from swipelake import skew
from swipelake.skew import ROWS_PER_TASK, group_medians, group_stats


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows on one key, order values with long ties, some NULLs everywhere."""
    i = F.col("id")
    return spark.range(4000).select(
        i,
        F.when(i % 2 == 0, 7).when(i % 31 == 0, None).otherwise(i % 11).alias("k"),
        F.when(i % 97 == 0, None)
        .when((i > 500) & (i < 1500), 600)
        .otherwise(F.floor(i / 3))
        .cast("int")
        .alias("o"),
        F.when(i % 13 == 0, None).otherwise((i * 37 % 101)).cast("double").alias("v"),
        F.timestamp_seconds(1_700_000_000 + i * 700 + (i % 5) * 600).alias("ts"),
    )


def ordered(df):
    return [tuple(r) for r in df.orderBy("id").collect()]


def same(left, right):
    a, b = ordered(left), ordered(right)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert _close(x, y), (x, y)


def _close(x, y):
    return all(
        p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) < 1e-6)
        for p, q in zip(x, y)
    )


def all_windows(df, rows_per_task, descending=False):
    return (
        KeyedWindows(df, "k", "o", tie_break="id", descending=descending, rows_per_task=rows_per_task)
        .running_total("v")
        .running_average("v")
        .row_number()
        .rank()
        .rank("dense", dense=True)
        .ntile(7)
        .lag("v")
        .lag("v", 30)
        .lead("v", 2)
        .percent_change("v")
        .moving_average("v", 7)
        .result()
    )


@pytest.mark.parametrize("descending", [False, True])
def test_cut_equals_plain(skewed, descending):
    same(all_windows(skewed, ROWS_PER_TASK, descending), all_windows(skewed, 150, descending))


def test_rank_descending_cut(skewed):
    same(
        rank_in_group(skewed, "k", "o", rows_per_task=ROWS_PER_TASK),
        rank_in_group(skewed, "k", "o", rows_per_task=100),
    )


def test_sessions_cut(skewed):
    plain = sessionize(skewed, "k", "ts", tie_break="id", rows_per_task=ROWS_PER_TASK)
    assert plain.agg(F.max("session_id")).first()[0] > 5
    same(plain, sessionize(skewed, "k", "ts", tie_break="id", rows_per_task=90))


def test_group_stats_cut(skewed):
    aggs = {"n": F.count(F.lit(1)), "m": F.avg("v"), "med": F.percentile_approx("v", 0.5)}
    same(
        group_stats(skewed, ["k"], aggs, ROWS_PER_TASK), group_stats(skewed, ["k"], aggs, 100)
    )


def test_session_boundary(spark):
    """A gap of exactly 30 minutes stays in the session; one second more starts a new one."""
    df = spark.sql(
        "SELECT 'a' AS k, CAST(t AS TIMESTAMP) AS ts FROM VALUES ('2024-01-01 00:00:00'),"
        "('2024-01-01 00:30:00'), ('2024-01-01 01:00:01') AS v(t)"
    )
    got = sessionize(df, "k", "ts").orderBy("ts").collect()
    assert [r["session_id"] for r in got] == [1, 1, 2]


def test_hand_computed(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([10.0, 0.0, 5.0, None])], "k string, t int, v double")
    got = (
        KeyedWindows(df, "k", "t")
        .running_total("v")
        .running_average("v")
        .percent_change("v")
        .moving_average("v", 2)
        .result()
        .orderBy("t")
        .collect()
    )
    assert [r["v_running_total"] for r in got] == [10.0, 10.0, 15.0, 15.0]
    assert [r["v_running_avg"] for r in got] == [10.0, 5.0, 5.0, 5.0]
    assert [r["v_pct_change"] for r in got] == [None, -100.0, None, None]
    assert [r["v_ma_2"] for r in got] == [10.0, 5.0, 2.5, 5.0]


def test_plain_windows_share_one_shuffle(skewed):
    plan = all_windows(skewed, ROWS_PER_TASK)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "EvalPython" not in plan


def test_registered_sessions_read_microseconds(spark):
    folder = "/root/testdata/sf0.001"
    given = joins_windows._events(spark, folder).select("event_id", "ts")
    read = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "ts")
    assert read.filter(F.col("ts") != F.date_trunc("second", "ts")).count() > 0
    assert given.exceptAll(read).count() == read.exceptAll(given).count() == 0


def test_cut_windows_join_twice(skewed):
    """Cut keys meet their hot keys and one summary; rows of other keys only the hot keys."""
    plan = all_windows(skewed, 150)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin (LeftAnti|LeftSemi|Inner|LeftOuter)", plan)) == 2


@pytest.mark.parametrize("rows_per_task", [3, 40, ROWS_PER_TASK])
@pytest.mark.parametrize("limit", [500_000, 0])
def test_any_cut_gives_the_same(skewed, monkeypatch, rows_per_task, limit):
    """Many more pieces than tasks, and summaries joined by a shuffle where they are too many to broadcast."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    same(all_windows(skewed, ROWS_PER_TASK), all_windows(skewed, rows_per_task))
    plain = sessionize(skewed, "k", "ts", tie_break="id", rows_per_task=ROWS_PER_TASK)
    same(plain, sessionize(skewed, "k", "ts", tie_break="id", rows_per_task=rows_per_task))
    aggs = {"n": F.count(F.lit(1)), "m": F.avg("v")}
    medians = {"med": "v", "mid": "o"}
    same(
        group_stats(skewed, ["k"], aggs, ROWS_PER_TASK, medians),
        group_stats(skewed, ["k"], aggs, rows_per_task, medians),
    )
    same(
        group_stats(skewed, ["k"], {}, ROWS_PER_TASK, medians),
        group_stats(skewed, ["k"], {}, rows_per_task, medians),
    )


@pytest.mark.parametrize("rows_per_task", [1, 7, 200, ROWS_PER_TASK])
def test_medians_are_exact(skewed, rows_per_task):
    """Against sorting all values: ties, NULLs, a NULL key, a key without values, any cut."""
    rows = [(r["k"], r["v"], r["o"]) for r in skewed.collect()] + [(99, None, None)] * 300
    frame = skewed.sparkSession.createDataFrame(rows, "k long, v double, o int").repartition(5)
    got = {r["k"]: (r["a"], r["b"]) for r in group_medians(frame, ["k"], {"a": "v", "b": "o"}, rows_per_task).collect()}

    def middle(values):
        kept = sorted(v for v in values if v is not None)
        return kept[(len(kept) + 1) // 2 - 1] if kept else None

    want = {
        k: tuple(middle([r[c] for r in rows if r[0] == k]) for c in (1, 2)) for k in {r[0] for r in rows}
    }
    assert got == want
