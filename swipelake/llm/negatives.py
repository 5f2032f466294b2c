"""Hard negatives of transactions by feature vector: one selection a slot answers all score windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swipelake.columns import CARD_COLUMNS, TxnColumns
from swipelake.llm.shipping import ship
from swipelake.llm.text import columns
from swipelake.scratch import written

# Sums of whole numbers below this are exact in double precision.
_EXACT = 2.0**53
_LONG = 2**63 - 1
# Scores of so many pairs are in memory at once, and so many components of one side of a cell.
_CELLS = 4_000_000
_COMPONENTS = 4_000_000

_TOP = "anchor long, slot int, score long, id {id}"


def _grid(vectors: pa.ChunkedArray, scale: float) -> np.ndarray:
    """Vectors of one length as rows of whole numbers, ``floor(scale * x)`` in double precision."""
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat.reshape(len(vectors), -1)) if len(flat) else np.zeros((len(vectors), 0))


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, held at the ends of 64 bits where they pass them."""
    most = left.shape[1] * np.abs(left).max(initial=0.0) * np.abs(right).max(initial=0.0)
    if most < _EXACT:
        return (left @ right.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = np.dot(whole(left), whole(right).T)
    return np.clip(exact, -_LONG - 1, _LONG).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of ``places`` with the highest score, ties by the smaller id."""
    if len(places) > k:
        own = scores[places]
        floor = np.partition(own, len(own) - k)[len(own) - k]
        places = places[own >= floor]
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def _blocks(anchors: pa.Table, rows: pa.Table, scale: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each anchor's place with its scores to all rows, some anchors at a time."""
    if not len(anchors) or not len(rows):
        return
    left, right = _grid(anchors.column("vector"), scale), _grid(rows.column("vector"), scale)
    step = max(1, _CELLS // max(1, len(right)))
    for at in range(0, len(left), step):
        scores = inner_products(left[at : at + step], right)
        for row in range(len(scores)):
            yield at + row, scores[row]


def _ordered_ids(column: pa.ChunkedArray) -> np.ndarray:
    """Ids as numbers in their order, whatever their type."""
    values = column.combine_chunks()
    if pa.types.is_integer(values.type):
        return values.to_numpy(zero_copy_only=False)
    return np.unique(np.array(values.cast(pa.string()).to_pylist(), dtype=object), return_inverse=True)[1]


def _selection(k: int, scale: float, same_label: bool):
    """A combiner for one cell of anchors and rows: the best ``k`` of each slot of each anchor.

    ``same_label`` takes other rows of the anchor's label, in one slot. Else rows of other labels fall into the
    anchor's slots, whose upper limits are ``uppers`` in rising order; below ``lowest`` or above the last nothing counts.
    """

    def select(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        ids, labels = rows.column("id").combine_chunks(), rows.column("label").to_pylist()
        codes = {label: code for code, label in enumerate(sorted(set(labels), key=repr))}
        coded = np.array([codes[label] for label in labels], dtype=np.int64)
        order = _ordered_ids(rows.column("id")) if len(rows) else np.zeros(0)
        same_id = {id_: place for place, id_ in enumerate(anchors.column("id").to_pylist())}
        own_rows: dict[int, list[int]] = {}
        for place, id_ in enumerate(ids.to_pylist()):
            if id_ in same_id:
                own_rows.setdefault(id_, []).append(place)
        anchor_ids, keys = anchors.column("id").to_pylist(), anchors.column("anchor").to_pylist()
        own_labels = [codes.get(label, -1) for label in anchors.column("label").to_pylist()]
        uppers = None if same_label else anchors.column("uppers").to_pylist()
        lowest = None if same_label else anchors.column("lowest").to_pylist()
        out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for at, scores in _blocks(anchors, rows, scale):
            if same_label:
                fits = coded == own_labels[at]
                fits[own_rows.get(anchor_ids[at], [])] = False
                slots = [(0, np.flatnonzero(fits))]
            else:
                fits = (coded != own_labels[at]) & (scores >= lowest[at]) & (scores <= uppers[at][-1])
                fits[own_rows.get(anchor_ids[at], [])] = False
                places = np.flatnonzero(fits)
                slot = np.searchsorted(np.array(uppers[at], dtype=np.int64), scores[places])
                slots = [(s, places[slot == s]) for s in np.unique(slot).tolist()]
            for s, places in slots:
                kept = _best(scores, order, places, k)
                if len(kept):
                    out.append((keys[at], s, scores[kept], kept))
        sizes = [len(kept) for *_, kept in out]
        taken = np.concatenate([kept for *_, kept in out]) if out else np.zeros(0, np.int64)
        return pa.table(
            {
                "anchor": pa.array(np.repeat(np.array([o[0] for o in out], np.int64), sizes)),
                "slot": pa.array(np.repeat(np.array([o[1] for o in out], np.int32), sizes)),
                "score": pa.array(np.concatenate([o[2] for o in out]) if out else np.zeros(0, np.int64)),
                "id": ids.take(pa.array(taken)),
            }
        )

    return select


def _tops(anchors: DataFrame, rows: DataFrame, k: int, scale: float, same_label: bool) -> DataFrame:
    """``anchor, slot, score, id, place``: the best ``k`` rows of each slot over all cells.

    ``anchors`` and ``rows`` are dealt into blocks; each pair of blocks of one vector length is a cell.
    """
    keys = ["width", "anchor_block", "row_block"]
    id_type = rows.schema["id"].dataType.simpleString()
    # Both sides come from one table; aliases tell their columns apart.
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])
    found = (
        anchors.groupBy(*keys)
        .cogroup(rows.groupBy(*keys))
        .applyInArrow(_selection(k, scale, same_label), _TOP.format(id=id_type))
    )
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def hard_negatives(
    txns: DataFrame,
    anchors: Column,
    cols: TxnColumns = CARD_COLUMNS,
    features: str = "features",
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    scale: float = 256.0,
    anchor_rows: int = 2048,
    block_rows: int = 32_768,
    lanes: int = 12,
) -> DataFrame:
    """For anchor transactions and their nearest ones of the same fraud mark, the hardest others.

    ``anchors`` is a condition on the columns of ``txns``; ``features`` is an array of numbers, such as the model's
    features, and the class of a transaction is its fraud mark (``cols.fraud``, of any type). Components become
    ``floor(scale * x)`` in double precision, and the score of two rows is their exact inner product (held at the
    ends of 64 bits). An anchor's positives are its best ``positives`` other rows of its class; a row of another
    class is a negative of a positive when ``low_percent * positive <= 100 * negative <= high_percent * positive``.

    The windows of one anchor overlap. The positives' upper limits split the scores into disjoint slots; every
    cell of anchors and rows keeps only the best ``negatives`` of each slot, and so does the merge of cells. The best
    rows below a positive's limit are then the first ones of all slots from its own downwards: a suffix of the
    anchor's slots in falling order, cut at the positive's lower limit. All anchors meet all rows, in blocks.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; higher scores first, ties
    by the smaller id; all where there are fewer than asked for, no row for a positive without a negative. Rows with a NULL id, NULL
    class or a vector that is NULL or has a NULL or non-finite component take no part, and vectors of different
    length never meet. Repeated rows count once, and rows with the anchor's id are not other rows. An empty table
    gives an empty result; extra columns do not matter. ``anchor_rows``, ``block_rows`` and ``lanes`` (least
    blocks of rows) size the cells and change no result.
    """
    ship(txns.sparkSession)
    flagged = txns.withColumn("_is_anchor", anchors)
    source = columns(flagged, id=cols.transaction_id, label=cols.fraud, vector=features, is_anchor="_is_anchor")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = source.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    vector = F.col("vector").cast("array<double>")
    once = usable.groupBy("id", F.col("label").cast("string").alias("label"), vector.alias("vector")).agg(
        F.max(F.coalesce("is_anchor", F.lit(False))).alias("is_anchor")
    )
    points = written(
        once.withColumn("width", F.size("vector")).withColumn("anchor", F.monotonically_increasing_id()), "negatives_points"
    )
    total = points.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_anchor").alias("anchors"), F.max("width").alias("width")
    ).first()
    most = max(1, _COMPONENTS // max(1, total["width"] or 0))
    blocks = max(lanes, -(-total["rows"] // min(block_rows, most)))
    anchor_blocks = max(1, -(-total["anchors"] // min(anchor_rows, most)))
    spread = F.xxhash64("id", "label", "vector")
    every = [F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))) for n in (anchor_blocks, blocks)]
    rows = points.select("id", "label", "vector", "width", F.pmod(spread, F.lit(blocks)).alias("row_block"))
    rows = rows.withColumn("anchor_block", every[0])
    chosen = points.filter("is_anchor").withColumn("anchor_block", F.pmod(spread, F.lit(anchor_blocks)))
    dealt = chosen.select("anchor", "id", "label", "vector", "width", "anchor_block").withColumn("row_block", every[1])

    limit = F.struct(
        _bound(low_percent, F.ceil).alias("lower"), _bound(high_percent, F.floor).alias("upper")
    )
    best = _tops(dealt, rows, positives, scale, True)
    windows = written(
        best.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), limit.alias("limit"))
        .select("anchor", "positive_id", "positive_score", "limit.lower", "limit.upper")
        .filter("lower <= upper"),
        "negatives_windows",
    )
    slots = windows.groupBy("anchor").agg(
        F.array_sort(F.collect_set("upper")).alias("uppers"), F.min("lower").alias("lowest")
    )
    asked = dealt.join(slots, "anchor")
    tops = _tops(asked, rows, negatives, scale, False)
    lists = tops.groupBy("anchor").agg(F.collect_list(F.struct("slot", "score", "id")).alias("kept"))
    return (
        windows.join(slots.select("anchor", "uppers"), "anchor")
        .join(lists, "anchor")
        .join(points.select("anchor", F.col("id").alias("anchor_id")), "anchor")
        .withColumn("own_slot", F.array_position("uppers", F.col("upper")).cast("int") - 1)
        .select("anchor_id", "positive_id", "positive_score", "lower", _suffix(negatives).alias("found"))
        .select("anchor_id", "positive_id", "positive_score", "lower", F.posexplode("found").alias("at", "hit"))
        .filter(F.col("hit.score") >= F.col("lower"))
        .select(
            "anchor_id",
            "positive_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("hit.id").alias("negative_id"),
            "positive_score",
            F.col("hit.score").alias("negative_score"),
        )
    )


def _bound(percent: int, towards) -> Column:
    """``percent / 100`` of the score, rounded to a whole number within the window; exact beyond 64 bits."""
    share = F.col("score").cast("decimal(20,0)") * F.lit(percent).cast("decimal(9,0)") / F.lit(100).cast("decimal(3,0)")
    return towards(share).cast("long")


def _suffix(k: int) -> Column:
    """The best ``k`` of the own slot and all below it."""
    below = F.filter("kept", lambda row: row["slot"] <= F.col("own_slot"))
    falling = F.array_sort(
        F.transform(
            below, lambda row: F.struct((-row["score"].cast("decimal(20,0)")).alias("falling"), row["id"].alias("id"), row["score"].alias("score"))
        )
    )
    return F.slice(falling, 1, k)
