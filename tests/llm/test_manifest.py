"""The hash tree against a plain one built with hashlib."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from swipelake.llm import midstate
from swipelake.llm.manifest import transaction_manifest

FIELDS = ("trans_num", "category", "merchant", "score")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, fan):
    """Top, and for each node its siblings and places level by level."""
    trails, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fan] for i in range(0, len(nodes), fan)]
        for trail, place in zip(trails, at, strict=True):
            trail.append((runs[place // fan], place % fan))
        nodes, at = [digest(*run) for run in runs], [place // fan for place in at]
    return nodes[0], trails


def plain(rows, fan, claim=lambda row: row):
    """``id, leaf, subroot, root, proof, folded`` of rows ``(id, category, merchant, score)``."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or "", leaf(row), row))
    names = sorted(trees, key=lambda c: (c is not None, (c or "").encode()))
    for name in names:
        trees[name].sort(key=lambda t: t[:3])
    climbed = {name: climb([t[2] for t in trees[name]], fan) for name in names}
    root, tops = climb([climbed[name][0] for name in names], fan)
    made = []
    for name, top in zip(names, tops, strict=True):
        for (_, _, own, row), trail in zip(trees[name], climbed[name][1], strict=True):
            folded, told = leaf(claim(row)), []
            for run, slot in trail + top:
                told += run[:slot] + run[slot + 1 :]
                folded = digest(*run[:slot], folded, *run[slot + 1 :])
            made.append((row[0], own, climbed[name][0], root, digest(*told), folded))
    return sorted(made, key=repr)


def built(frame, **options):
    rows = transaction_manifest(frame, fields=FIELDS, **options).collect()
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in rows)
    return sorted((tuple(r)[:6] for r in rows), key=repr)


def test_midstates_equal_hashlib():
    texts = [[hashlib.sha256(f"{i}/{k}".encode()).hexdigest() for k in range(3)] for i in range(7)]
    states = midstate.starts(7)
    for k in range(3):
        kept = midstate.unpacked(midstate.packed(states))
        assert (kept == states).all()
        states = midstate.absorbed(kept, midstate.from_hex("".join(t[k] for t in texts).encode()))
    shown = midstate.to_hex(midstate.finished(states, np.full(7, 3))).decode()
    assert [shown[64 * i : 64 * i + 64] for i in range(7)] == [digest(*t) for t in texts]
    empty = midstate.to_hex(midstate.finished(midstate.starts(2), np.array([0, 0]))).decode()
    assert empty == 2 * digest("")


@pytest.mark.parametrize("fan,levels,rows", [(2, 2, 75), (2, 12, 75), (3, 1, 40), (5, 2, 90)])
def test_equals_plain_tree(spark, fan, levels, rows):
    draw = random.Random(fan * levels)
    made = [
        (f"T{draw.randrange(10_000)}", draw.choice(["a", "a", "a", "é", None, "b c"]), draw.choice(["x", "", None, "é" * 9]), i)
        for i in range(rows)
    ] + [("only", "lone", "text", None)]
    frame = spark.createDataFrame(made, "trans_num string, category string, merchant string, score long").repartition(3)

    def claim(row):
        return (*row[:3], None if row[3] is None else row[3] + (row[3] % 7 == 0))

    tampered = {"score": F.when(F.col("score") % 7 == 0, F.col("score") + 1).otherwise(F.col("score"))}
    got = built(frame, fan=fan, levels=levels, claimed=tampered)
    assert got == plain(made, fan, claim)
    assert sum(r[5] != r[3] for r in got) == sum(r[3] is not None and r[3] % 7 == 0 for r in made)


def test_odd_rows_are_leaves(odd):
    rows = [tuple(r) for r in odd.select(*FIELDS).collect()]
    got = built(odd, levels=1)
    assert got == plain(rows, 2) and all(r[5] == r[3] for r in got)
    assert transaction_manifest(odd.limit(0)).count() == 0
    one = built(odd.filter("trans_num = 'T1'"))
    assert one == plain([r for r in rows if r[0] == "T1"], 2) and one[0][4] == digest("")


def test_default_fields_are_the_transaction(spark, sample):
    from swipelake.columns import DEFAULT_COLUMNS

    changed = sample.withColumn("amount", F.col("amount") + 1)
    first, second, third = (
        {r["transaction_id"]: r for r in transaction_manifest(f, DEFAULT_COLUMNS).collect()}
        for f in (sample, sample.repartition(4), changed)
    )
    assert first == second and len(first) == 5
    assert {r["root"] for r in first.values()} != {r["root"] for r in third.values()}


def test_copies_of_one_row_fill_many_blocks(spark):
    """Equal rows, a hot category and a tree of one leaf; blocks of two leaves."""
    made = [("C", "a", "same", 1)] * 41 + [("D", "b", "other", 2)]
    frame = spark.createDataFrame(made, "trans_num string, category string, merchant string, score long")
    assert built(frame, levels=1) == plain(made, 2)
