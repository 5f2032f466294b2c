"""Vector bin packing of transactions into shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swipelake.columns import CARD_COLUMNS, TxnColumns
from swipelake.llm.text import byte_count, columns, word_count
from swipelake.scratch import written

ROW_BYTES = 8  # what a row takes besides its text


def place_items(loads: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item: the one whose residual capacity has the highest dot product with its load.

    ``loads`` has a row (bytes, tokens, rows) for each item. Loads and capacities are shares of a
    shard. Large items go first. A shard that an item would overfill in some dimension is taken only when
    all would be. Equal products go to the emptier, then the lower shard.
    """
    total = loads.sum(axis=0)
    share = loads / np.where(total > 0, total, 1) * shards
    residual = np.ones((shards, loads.shape[1]))
    chosen = np.zeros(len(loads), dtype=np.int64)
    for i in np.lexsort((np.arange(len(loads)), -share.sum(axis=1), -share.max(axis=1))):
        fits = (residual >= share[i]).all(axis=1)
        if fits.any():
            score = np.where(fits, residual @ share[i], -np.inf)
            best = int(np.argmax(score))
        else:  # least overfull in bytes
            best = int(np.argmax((residual - share[i]).min(axis=1)))
        chosen[i] = best
        residual[best] -= share[i]
    return chosen


def shard_transactions(
    txns: DataFrame,
    cols: TxnColumns = CARD_COLUMNS,
    shards: int = 24,
    grains: int = 256,
    max_group_share: float = 1.0,
) -> DataFrame:
    """Put transactions into shards that are near equal in bytes, tokens and rows.

    Transactions with equal merchant descriptors form a group and stay together. The items that are
    packed are bounded in number: groups above 1/``grains`` of a shard in some dimension are items of their
    own (at most ``3 * shards * grains``), the many small groups are hashed into ``shards * grains``
    bundles. Only a group above ``max_group_share`` of a shard (a whole one), such as one that holds a third of all rows,
    is cut into pieces by a hash of the id; it fits into no shard. Only the items' sums (bounded as above) reach the driver, which
    places the largest first by the dot product with residual capacity. Slots number the rows of a shard
    without gaps: item offsets plus a row number inside small slices of an item.

    Returns ``transaction_id, bytes, tokens, text_crc32, shard, slot``, one row for each input row.
    ``bytes`` is the UTF-8 size plus 8. A NULL text has no bytes and the checksum of an empty one; empty
    texts form one group with it. Repeated rows get a slot each; ids may be NULL. An empty table gives an
    empty one.
    """
    source = columns(txns, transaction_id=cols.transaction_id, text=cols.merchant)
    text = F.coalesce("text", F.lit(""))
    digest = written(
        source.select(
            "transaction_id",
            (byte_count(F.col("text")) + ROW_BYTES).alias("bytes"),
            word_count(F.col("text")).alias("tokens"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("_group"),
        ),
        "shard_digest",
    )
    loads = ("bytes", "tokens")
    groups = written(
        digest.groupBy("_group").agg(
            *[F.sum(c).alias(c) for c in loads], F.count(F.lit(1)).alias("rows")
        ),
        "shard_groups",
    )
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*loads, "rows")]).first()
    parts = shards * grains

    def share(of: str):
        return F.col(of) / F.lit(max(1, total[of]))

    largest = F.greatest(*[share(c) for c in (*loads, "rows")])
    # A large group is an item of its own, in as many pieces as it fills shards; each item has
    # slices for numbering.
    large = written(
        groups.withColumn("_share", largest)
        .filter(F.col("_share") > 1 / parts)
        .select(
            "_group",
            F.when(
                F.col("_share") * shards > max_group_share,
                F.ceil(F.col("_share") * shards / max_group_share),
            )
            .otherwise(F.lit(1))
            .cast("int")
            .alias("_pieces"),
            F.ceil(F.col("_share") * parts).cast("int").alias("_slices"),
        ),
        "shard_large",
    )
    spread = F.pmod(F.xxhash64(F.lit("shard"), "transaction_id"), F.lit(1 << 30)).cast("int")
    # Bounded: at most three rows for each grain of each shard.
    rows = digest.join(F.broadcast(large), "_group", "left").withColumns(
        {
            "_bundle": F.when(F.col("_pieces").isNull(), F.pmod("_group", F.lit(parts))).otherwise(
                F.col("_group")
            ),
            "_own": F.col("_pieces").isNotNull(),
            "_piece": F.coalesce(spread % F.col("_pieces"), F.lit(0)),
            "_slice": F.coalesce(
                F.floor(spread / F.col("_pieces")).cast("int")
                % F.greatest(F.lit(1), F.ceil(F.col("_slices") / F.col("_pieces")).cast("int")),
                F.lit(0),
            ),
        }
    )
    item = ["_own", "_bundle", "_piece"]
    slices = rows.groupBy(*item, "_slice").agg(
        *[F.sum(c).alias(c) for c in loads], F.count(F.lit(1)).alias("rows")
    )
    found = slices.orderBy(*item, "_slice").collect()
    placed = _slots(found, item, shards)
    spark = txns.sparkSession
    where = spark.createDataFrame(
        placed, "_own boolean, _bundle long, _piece int, _slice int, shard int, _first long"
    )
    inside = Window.partitionBy(*item, "_slice").orderBy("transaction_id", "text_crc32", "bytes")
    return (
        rows.withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(where), [*item, "_slice"])
        .select(
            F.col("transaction_id").alias(cols.transaction_id),
            "bytes",
            "tokens",
            "text_crc32",
            "shard",
            (F.col("_first") + F.col("_row") - 1).alias("slot"),
        )
    )


def _slots(slices: list, item: list[str], shards: int) -> list[tuple]:
    """Shard and first slot of each slice, from the sums of all slices."""
    keys: dict[tuple, int] = {}
    for r in slices:
        keys.setdefault(tuple(r[c] for c in item), len(keys))
    loads = np.zeros((len(keys), 3))
    for r in slices:
        loads[keys[tuple(r[c] for c in item)]] += (r["bytes"], r["tokens"], r["rows"])
    chosen = place_items(loads, shards)
    filled = [0] * shards
    out = []
    for r in slices:
        key = tuple(r[c] for c in item)
        shard = int(chosen[keys[key]])
        out.append((*key, r["_slice"], shard, filled[shard]))
        filled[shard] += r["rows"]
    return out
