"""A manifest of transactions: a tree of SHA-256 digests whose parents keep resumable hash states."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swipelake.columns import CARD_COLUMNS, TxnColumns
from swipelake.llm import midstate
from swipelake.llm.shipping import ship
from swipelake.scratch import written

_STEP = "struct<slot:int,state:binary,siblings:binary>"


def encoded(value: Column) -> Column:
    """A field as text for hashing: ``-`` for NULL, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


# ---- inside one block --------------------------------------------------------------------------------


@dataclass
class _Level:
    """Nodes of one level and, for each parent, the states before each of its child slots."""

    digests: np.ndarray
    before: list[np.ndarray]
    fan: int

    def resumed(self, at: np.ndarray, instead: np.ndarray) -> np.ndarray:
        """Parents' digests with ``instead`` in the place of node ``at``: only it and its right siblings are hashed."""
        parent, slot = at // self.fan, at % self.fan
        states = np.zeros((8, len(at)), np.uint32)
        for s, kept in enumerate(self.before):
            here = slot == s
            states[:, here] = kept[:, parent[here]]
        states = midstate.absorbed(states, instead)
        for s in range(1, self.fan):
            child = parent * self.fan + s
            right = (slot < s) & (child < self.digests.shape[1])
            states = midstate.absorbed(states, self._nodes(child), right)
        return midstate.finished(states, self._sizes(parent))

    def told(self, at: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after the siblings of nodes ``at``, left to right, and how many these are."""
        parent, slot = at // self.fan, at % self.fan
        for s in range(self.fan):
            child = parent * self.fan + s
            states = midstate.absorbed(states, self._nodes(child), (slot != s) & (child < self.digests.shape[1]))
        return states, self._sizes(parent) - 1

    def steps(self) -> list[dict]:
        """Each node's slot, the parent's state before it, and its siblings."""
        states = [midstate.packed(kept) for kept in self.before]
        text = midstate.to_hex(self.digests)
        made = []
        for at in range(self.digests.shape[1]):
            parent, slot = divmod(at, self.fan)
            first, last = 64 * parent * self.fan, 64 * min((parent + 1) * self.fan, self.digests.shape[1])
            siblings = text[first : 64 * at] + text[64 * (at + 1) : last]
            made.append({"slot": slot, "state": states[slot][32 * parent : 32 * parent + 32], "siblings": siblings})
        return made

    def _nodes(self, at: np.ndarray) -> np.ndarray:
        return self.digests[:, np.minimum(at, self.digests.shape[1] - 1)]

    def _sizes(self, parent: np.ndarray) -> np.ndarray:
        return np.minimum(self.fan, self.digests.shape[1] - parent * self.fan)


def grow(digests: np.ndarray, fan: int, levels: int | None) -> tuple[list[_Level], np.ndarray]:
    """Levels over the nodes and the top: exactly ``levels`` of them, or as many as leave one node."""
    made: list[_Level] = []
    while len(made) < levels if levels is not None else digests.shape[1] > 1:
        width = digests.shape[1]
        parents = -(-width // fan)
        states, before = midstate.starts(parents), []
        for s in range(fan):
            before.append(states)
            child = np.arange(parents) * fan + s
            states = midstate.absorbed(states, digests[:, np.minimum(child, width - 1)], child < width)
        made.append(_Level(digests, before, fan))
        digests = midstate.finished(states, np.minimum(fan, width - np.arange(parents) * fan))
    return made, digests


def _texts(digests: np.ndarray) -> pa.Array:
    text = midstate.to_hex(digests)
    return pa.array([text[at : at + 64].decode() for at in range(0, len(text), 64)], pa.string())


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return midstate.from_hex("".join(column.to_pylist()).encode())


def _sealed(fan: int, levels: int):
    """Leaves of one block folded to its top, with the states of their proofs."""

    def seal(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        own, claimed = _digests(block.column("leaf")), _digests(block.column("claimed"))
        tree, top = grow(own, fan, None if block.column("whole")[0].as_py() else levels)
        at = np.arange(len(block))
        proofs, told = midstate.starts(len(block)), np.zeros(len(block), np.int64)
        for level in tree:
            proofs, more = level.told(at, proofs)
            told += more
            claimed = level.resumed(at, claimed)
            at = at // fan
        states = midstate.packed(proofs)
        named = {c: block.column(c) for c in ("tree", "block", "id", "leaf")}
        return pa.table(
            {
                **named,
                "folded": _texts(claimed),
                "proof": pa.array([states[i : i + 32] for i in range(0, len(states), 32)], pa.binary()),
                "told": pa.array(told),
                "first": pa.array(np.arange(len(block)) == 0),
                "top": pa.array([_texts(top)[0].as_py()] * len(block), pa.string()),
            }
        )

    return seal


def _pathed(fan: int, levels: int):
    """Nodes of one block with their steps up to its top."""

    def path(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        tree, top = grow(_digests(block.column("digest")), fan, None if block.column("whole")[0].as_py() else levels)
        steps = [level.steps() for level in tree]
        paths = [[own[at // fan**k] for k, own in enumerate(steps)] for at in range(len(block))]
        kind = pa.list_(pa.struct([("slot", pa.int32()), ("state", pa.binary()), ("siblings", pa.binary())]))
        return pa.table(
            {
                **{c: block.column(c) for c in ("tree", "place", "block")},
                "path": pa.array(paths, kind),
                "top": pa.array([_texts(top)[0].as_py()] * len(block), pa.string()),
            }
        )

    return path


# ---- the whole tree ------------------------------------------------------------------------------------


def _placed(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``place``, their number from 0 within ``tree``, and the ``size`` of each tree.

    Rows are sorted by range, ``tie`` telling equal ones apart, and each range is numbered on its own; counts of
    the ranges, one row for each range and tree, give what comes before.
    """
    by = ["tree", *order, "tie"]
    numbered = written(
        rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("seq", F.monotonically_increasing_id()),
        "manifest_sorted",
    ).withColumn("range", F.shiftright("seq", 33))
    counts = numbered.groupBy("tree", "range").agg(F.min("seq").alias("start"), F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("tree").orderBy("range")
    counts = written(
        counts.select(
            "tree",
            "range",
            "start",
            F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
            F.sum("n").over(Window.partitionBy("tree")).alias("size"),
        ),
        "manifest_counts",
    )
    joined = numbered.join(counts, ["tree", "range"]).withColumn("place", F.col("before") + F.col("seq") - F.col("start"))
    sizes = counts.groupBy("tree").agg(F.max("size").alias("size"))
    return joined.drop("range", "seq", "start", "before", "tie"), sizes


def _blocked(nodes: DataFrame, block_leaves: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / block_leaves)).withColumn(
        "whole", F.col("size") <= block_leaves
    )


def _paths(nodes: DataFrame, most: int, fan: int, levels: int) -> DataFrame:
    """``tree, place, path, top`` of nodes (``tree, place, digest, size``): the steps from each up to its tree's top.

    Each round closes blocks of ``fan ** levels`` nodes and goes on with their tops; ``most`` is the largest ``size``.
    """
    block_leaves = fan**levels
    schema = f"tree string, place long, block long, path array<{_STEP}>, top string"
    rounds: list[DataFrame] = []
    while True:
        sealed = _blocked(nodes, block_leaves).select("tree", "block", "place", "digest", "whole", "size")
        keyed = sealed.groupBy("tree", "block")
        made = written(keyed.applyInArrow(_pathed(fan, levels), schema), "manifest_paths")
        rounds.append(made)
        if most <= block_leaves:
            break
        most = -(-most // block_leaves)
        sizes = made.groupBy("tree").agg((F.max("block") + 1).alias("size"))
        tops = made.filter(F.col("place") % block_leaves == 0).select(
            "tree", F.col("block").alias("place"), F.col("top").alias("digest")
        )
        nodes = written(tops.join(sizes, "tree"), "manifest_nodes")
    whole = rounds.pop().select("tree", "place", "path", "top")
    while rounds:
        above = whole.select("tree", F.col("place").alias("block"), F.col("path").alias("above"), F.col("top").alias("peak"))
        whole = (
            rounds.pop()
            .join(above, ["tree", "block"])
            .select("tree", "place", F.concat("path", "above").alias("path"), F.col("peak").alias("top"))
        )
    return whole


def _finish(batches: Iterable[pa.RecordBatch], kept: Sequence[str], fan: int) -> Iterator[pa.RecordBatch]:
    """Folds and proofs of leaves taken from the tops of their blocks to the root."""
    wide = 64 * (fan - 1)
    for batch in batches:
        folded = midstate.from_hex("".join(batch.column("folded").to_pylist()).encode())
        proofs = midstate.unpacked(b"".join(batch.column("proof").to_pylist()))
        told = batch.column("told").to_numpy().copy()
        paths = batch.column("path")
        ends = np.cumsum(np.concatenate([[0], paths.value_lengths().to_numpy(zero_copy_only=False)])).astype(np.int64)
        steps = paths.flatten()
        slots = steps.field("slot").to_numpy(zero_copy_only=False).astype(np.int64)
        states, siblings = steps.field("state").to_pylist(), steps.field("siblings").to_pylist()
        lengths = np.diff(ends)
        for k in range(int(lengths.max(initial=0))):
            rows = np.flatnonzero(lengths > k)
            at = ends[rows] + k
            others = midstate.from_hex(b"".join(siblings[i].ljust(wide, b"0") for i in at)) if wide else None
            count = np.array([len(siblings[i]) // 64 for i in at])
            own = midstate.absorbed(midstate.unpacked(b"".join(states[i] for i in at)), folded[:, rows])
            proof = proofs[:, rows]
            for t in range(fan - 1):
                sibling = others[:, t :: fan - 1]
                own = midstate.absorbed(own, sibling, (t >= slots[at]) & (t < count))
                proof = midstate.absorbed(proof, sibling, t < count)
            folded[:, rows] = midstate.finished(own, count + 1)
            proofs[:, rows] = proof
            told[rows] += count
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in kept], _texts(midstate.finished(proofs, told)), _texts(folded)],
            [*kept, "proof_sha256", "folded_root"],
        )


def transaction_manifest(
    txns: DataFrame,
    cols: TxnColumns = CARD_COLUMNS,
    fields: Sequence[str] | None = None,
    by: str | None = None,
    claimed: Mapping[str, Column] | None = None,
    fan: int = 2,
    levels: int = 12,
) -> DataFrame:
    """Every transaction as a leaf of a hash tree, and that tree folded again from the leaf as it is claimed to be.

    A leaf is the SHA-256 of the ``fields`` (default: those of ``cols`` from id to fraud mark that exist), each as
    ``-`` if NULL, else UTF-8 byte count, colon and text. Per value of ``by`` (default: the category) leaves ascend by
    id; every ``fan`` consecutive nodes are hashed to one, as hex text, until one is left, the ``subroot``. Subroots, by
    their value, NULL first, are hashed to the ``root`` alike.

    A parent keeps its hash state before each child slot. A fold resumes the state before the changed child and
    hashes that and its right siblings only; states are eight words, so they are kept in tables for parents above the block of
    ``fan ** levels`` leaves, which one task handles. ``claimed`` names fields with a value other than the stored one.

    Returns ``transaction_id, leaf, subroot, root, proof_sha256, folded_root, verified``: the hash of all siblings from leaf
    to root, left to right, the root that the claimed leaf gives with these siblings, and whether that is ``root``. NULL ids
    come first, equal ids by their leaf; repeated rows are leaves each. Empty and long texts are values like any other, an empty
    table gives an empty result, extra columns do not matter.
    """
    ship(txns.sparkSession)
    if fan < 2 or levels < 1:
        raise ValueError("a tree needs a fan of at least 2 and a level")
    usual = (cols.transaction_id, cols.customer, cols.merchant, cols.category, cols.amount, cols.timestamp, cols.fraud)
    fields = [c for c in usual if c in txns.columns] if fields is None else list(fields)
    stated = {**{c: txns[c] for c in fields}, **{c: v for c, v in (claimed or {}).items() if c in fields}}
    value = txns[by or cols.category]
    leaves = written(
        txns.select(
            encoded(value).alias("tree"),
            value.alias("value"),
            txns[cols.transaction_id].alias("id"),
            leaf_digest(txns[c] for c in fields).alias("leaf"),
            leaf_digest(stated[c] for c in fields).alias("claimed"),
            F.monotonically_increasing_id().alias("tie"),
        ),
        "manifest_leaves",
    )
    block_leaves = fan**levels
    placed, sizes = _placed(leaves.drop("value"), ["id", "leaf"])
    kept = ["tree", "block", "id", "leaf"]
    id_type = leaves.schema["id"].dataType.simpleString()
    schema = f"tree string, block long, id {id_type}, leaf string, folded string, proof binary, told long, first boolean, top string"
    blocks = _blocked(placed, block_leaves).select(*kept, "place", "claimed", "whole")
    sealed = written(blocks.groupBy("tree", "block").applyInArrow(_sealed(fan, levels), schema), "manifest_sealed")

    tops = sealed.filter("first").select("tree", F.col("block").alias("place"), F.col("top").alias("digest"))
    sizes = sizes.select("tree", F.ceil(F.col("size") / block_leaves).alias("size"))
    most = sizes.agg(F.max("size")).first()[0] or 0
    above = written(_paths(tops.join(sizes, "tree"), most, fan, levels), "manifest_above")

    values = leaves.groupBy(F.col("tree").alias("of")).agg(F.min("value").alias("value"))
    subroots = above.filter("place = 0").select(F.col("tree").alias("of"), "top").join(values, "of")
    ordered = subroots.select(
        F.lit("").alias("tree"), "of", "value", F.col("top").alias("digest"), F.xxhash64("of").alias("tie")
    )
    ordered, counted = _placed(ordered, ["value"])
    nodes = written(ordered, "manifest_subroots")
    most = counted.agg(F.max("size")).first()[0] or 0
    peak = _paths(nodes.select("tree", "place", "digest", "size"), most, fan, levels).withColumnRenamed("path", "more")
    peak = nodes.select("of", "place").join(peak.select("place", "more", F.col("top").alias("root")), "place")
    upper = above.join(peak.drop("place"), F.col("tree") == F.col("of")).select(
        "tree", F.col("place").alias("block"), F.concat("path", "more").alias("path"), F.col("top").alias("subroot"), "root"
    )
    joined = sealed.select(*kept, "folded", "proof", "told").join(written(upper, "manifest_upper"), ["tree", "block"])
    shown = ["id", "leaf", "subroot", "root"]
    result = joined.select(*shown, "folded", "proof", "told", "path").mapInArrow(
        lambda batches: _finish(batches, shown, fan),
        f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string",
    )
    return result.select(
        F.col("id").alias(cols.transaction_id),
        *shown[1:],
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
