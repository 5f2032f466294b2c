"""Hard negatives against a plain search."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from swipelake.llm.negatives import hard_negatives, inner_products

SCHEMA = "trans_num string, features array<double>, is_fraud int, score int, id int, slot int, anchor int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)


def plain(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    kept = {
        (i, tuple(v), c)
        for i, v, c in rows
        if i is not None and c is not None and v is not None
        and all(x is not None and math.isfinite(x) for x in v)
    }
    grid = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in kept]
    found = set()
    for a, va, ca in grid:
        if not is_anchor(a):
            continue
        near = sorted(
            (-max(min(sum(x * y for x, y in zip(va, v, strict=True)), 2**63 - 1), -(2**63)), i, c)
            for i, v, c in grid
            if i != a and len(v) == len(va)
        )
        for p, pid, _ in [n for n in near if n[2] == ca][:positives]:
            fits = [n for n in near if n[2] != ca and low * -p <= 100 * -n[0] <= high * -p][:negatives]
            found |= {(a, pid, rank, nid, -p, -n) for rank, (n, nid, _) in enumerate(fits, 1)}
    return found


def mined(rows, is_anchor, **options):
    return sorted(map(tuple, hard_negatives(rows, is_anchor, **options).collect()))


@pytest.mark.parametrize("cells", [{}, {"anchor_rows": 3, "block_rows": 7, "lanes": 2}])
def test_equals_plain_search(spark, cells):
    draw = random.Random(8)
    rows = [
        (f"T{i:03}", [round(draw.gauss(0.3, 0.4), 2) for _ in range(4)], draw.choice([0, 0, 1, 2])) for i in range(160)
    ]
    got = mined(frame(spark, rows), F.col("trans_num").endswith("0"), **cells)
    want = plain(rows, lambda i: i.endswith("0"))
    assert len(want) > 300 and got == sorted(want)


def test_ties_take_the_smaller_id_and_few_are_all(spark):
    rows = [("A", [1.0, 0.0], 1), ("P1", [1.0, 0.0], 1), ("P2", [1.0, 5.0], 1)]
    rows += [(f"N{i}", [0.5, float(i)], 0) for i in range(20)]
    got = mined(frame(spark, rows), F.col("trans_num") == "A", positives=1, negatives=3)
    assert [r[:4] for r in got] == [("A", "P1", rank, name) for rank, name in ((1, "N0"), (2, "N1"), (3, "N10"))]
    few = mined(frame(spark, rows[:5]), F.col("trans_num") == "A")
    assert len(few) == 4 and {r[1] for r in few} == {"P1", "P2"}


def test_negative_positives_have_no_window(spark):
    rows = [("A", [1.0], 1), ("P", [-1.0], 1), ("N", [-0.5], 0), ("Q", [0.0], 1), ("M", [0.0], 0)]
    assert mined(frame(spark, rows), F.col("trans_num") == "A") == [("A", "Q", 1, "M", 0, 0)]


def test_large_components_are_exact(spark):
    rows = [("A", [3e6, 1.0], 1), ("P", [2e6 + 1 / 256, 7.0], 1), ("N", [1e6 + 1 / 256, 3.0], 0), ("B", [1e30, 1.0], 1)]
    got = mined(frame(spark, rows), F.col("trans_num").isin("A", "B"))
    assert got == sorted(plain(rows, lambda i: i in "AB")) and got
    wide = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 5.0], [2.0**80, 1.0]])
    assert inner_products(*wide).tolist() == [[2**60 + 15, 2**63 - 1]]


def test_odd_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("A", [1.0, 1.0], 1), ("A", [1.0, 1.0], 1), ("P", [1.0, 0.5], 1), ("P", [1.0, 0.5], 1), ("N", [0.4, 0.4], 0),
        ("N", [0.4, 0.4], 0), (None, [0.4, 0.4], 0), ("X", None, 0), ("Y", [nan, 0.4], 0), ("Z", [inf, 0.4], 0),
        ("W", [None, 0.4], 0), ("V", [0.4, 0.4], None), ("U", [0.4], 0), ("E", [], 0),
    ]
    made = frame(spark, rows)
    got = mined(made, F.col("trans_num") == "A")
    assert got == sorted(plain(rows, lambda i: i == "A")) and len(got) == 1
    assert mined(made.limit(0), F.lit(True)) == []
    assert mined(made, F.lit(None).cast("boolean")) == []


def test_one_class_and_copies_of_one_vector(spark):
    """A third of the rows are one vector: cells stay even and the result whole."""
    rows = [(f"C{i:03}", [0.5, 0.5], 0) for i in range(100)]
    rows += [(f"D{i:03}", [1.0, i / 100], i % 2) for i in range(100)]
    got = mined(frame(spark, rows), F.col("trans_num").isin("C000", "D001", "D002"))
    assert got == sorted(plain(rows, lambda i: i in ("C000", "D001", "D002"))) and got
