"""Keys that hold too many rows for one task: finding them and cutting them up.

A window over a key puts all rows of that key in one task. That is fine for ordinary keys
and fatal for one that holds a third of the table. The operators here therefore work in
two parts: ordinary keys use plain windows, and a *hot* key (more than ``ROWS_PER_TASK``
rows) is cut into consecutive pieces by a range partitioning on its order; each piece is
handled on its own and one small per-piece summary carries totals from one to the next. The
two parts give exactly the same answers.

Hot keys and summaries are written tables, never collected. They are broadcast while they have
at most ``BROADCAST_ROWS`` rows, which their count tells, and joined by a shuffle beyond that.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from swipelake.scratch import written

ROWS_PER_TASK = 10_000_000
# Hot keys and piece summaries up to so many rows of some ten numbers are sent to all executors.
BROADCAST_ROWS = 500_000


def source_bytes(df: DataFrame) -> int:
    """Size of the tables ``df`` reads, as Catalyst knows it (unknown counts as huge)."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def key_hash(keys: Sequence[str]) -> Column:
    """One long per key; NULL keys have a value too. A collision only makes a key hot needlessly."""
    return F.xxhash64(*[F.col(k) for k in keys])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class HotKeys:
    """The hot keys: a written table of hashes and row counts (``_hot_hash, _hot_rows``)."""

    keys: tuple[str, ...]
    table: DataFrame
    count: int
    total_rows: int
    rows_per_task: int

    def _on(self) -> tuple[DataFrame, Column]:
        return _small(self.table, self.count), key_hash(self.keys) == F.col("_hot_hash")

    def rows(self, df: DataFrame) -> DataFrame:
        """Rows of hot keys."""
        return df.join(*self._on(), "left_semi")

    def others(self, df: DataFrame) -> DataFrame:
        return df.join(*self._on(), "left_anti")

    def mark(self, df: DataFrame) -> DataFrame:
        """All rows with ``_hot_rows``: the rows of their key, or NULL where it is not hot."""
        return df.join(*self._on(), "left").drop("_hot_hash")


def count_hot_keys(
    df: DataFrame, keys: Sequence[str], rows: Column, rows_per_task: int = ROWS_PER_TASK
) -> HotKeys | None:
    """Hot keys of ``df``, where each row stands for ``rows`` rows.

    One shuffle of (hash, count) pairs, pre-aggregated in the map tasks.
    """
    counted = df.groupBy(key_hash(keys).alias("_hot_hash")).agg(F.sum(rows).alias("_hot_rows"))
    table = written(counted.filter(F.col("_hot_rows") > rows_per_task), "hot_keys")
    found = table.agg(F.count(F.lit(1)).alias("keys"), F.sum("_hot_rows").alias("rows")).first()
    if not found["keys"]:
        return None
    return HotKeys(tuple(keys), table, found["keys"], found["rows"], rows_per_task)


def find_hot_keys(
    df: DataFrame, keys: Sequence[str], rows_per_task: int | None = None
) -> HotKeys | None:
    """One pass over the key columns. None when no key is hot."""
    return count_hot_keys(df, keys, F.lit(1).cast("long"), rows_per_task or ROWS_PER_TASK)


def hashable(df: DataFrame) -> list[str]:
    """Columns xxhash64 takes."""
    plain = (T.NumericType, T.StringType, T.DatetimeType, T.BooleanType, T.BinaryType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, plain)]


def cut_by_range(df: DataFrame, order: Sequence[Column | str], rows: int, rows_per_task: int) -> DataFrame:
    """``df`` in ``order``, written, with ``_seq`` (rising in that order) and ``_piece`` (consecutive rows).

    The range partitions are as many as the session's shuffle partitions at most; each is sorted and cut into pieces
    of ``rows_per_task`` rows, so pieces may be far more than tasks. The cut is written once, so all
    readers see the same pieces.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    tasks = max(1, min(tasks, math.ceil(rows / rows_per_task)))
    placed = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # The id is the partition in the upper bits and the place in it in the lower 33.
    seq = F.monotonically_increasing_id()
    partition, place = F.shiftright("_seq", 33), F.col("_seq").bitwiseAND(2**33 - 1)
    piece = F.shiftleft(partition, 33) + F.floor(place / rows_per_task)
    return written(placed.withColumn("_seq", seq).withColumn("_piece", piece), "pieces")


class Pieces:
    """Rows of hot keys, cut into consecutive pieces of at most ``rows_per_task`` rows.

    ``rows`` holds the input columns plus ``_piece`` and ``_seq``, both rising along the order within a key;
    rows that tie on the whole order are told apart by a hash of the row.
    """

    def __init__(self, df: DataFrame, hot: HotKeys, order: Sequence[Column]):
        self.keys = list(hot.keys)
        self.columns = df.columns
        spread = hot.rows(df).withColumn("_spread", F.xxhash64(*[F.col(c) for c in hashable(df)]))
        by = [*[F.col(k) for k in self.keys], *order, F.col("_spread")]
        cut = cut_by_range(spread, by, hot.total_rows, hot.rows_per_task)
        self.rows = cut.drop("_spread")
        self.window = Window.partitionBy(*self.keys, "_piece").orderBy(*order, "_seq")
        # Each piece, key and range partition can add one row to a summary.
        self.most = 2 * math.ceil(hot.total_rows / hot.rows_per_task) + 2 * hot.count + 1

    def running(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def along(self) -> WindowSpec:
        """The pieces of a key in order, for windows over a summary."""
        return Window.partitionBy(*self.keys).orderBy("_piece")

    def before(self) -> WindowSpec:
        return self.along().rowsBetween(Window.unboundedPreceding, -1)

    def summary(self, df: DataFrame, aggs: Mapping[str, Column]) -> DataFrame:
        """One row per key and piece."""
        return df.groupBy(*self.keys, "_piece").agg(*[c.alias(n) for n, c in aggs.items()])

    def attach(self, df: DataFrame, summary: DataFrame) -> DataFrame:
        """Give each row the summary of its key and piece."""
        on = [*self.keys, "_piece"]
        small = summary.select(
            *[F.col(k).alias(f"_on{i}") for i, k in enumerate(on)],
            *[c for c in summary.columns if c not in on],
        )
        match = [df[k].eqNullSafe(small[f"_on{i}"]) for i, k in enumerate(self.keys)]
        match.append(df["_piece"] == small[f"_on{len(self.keys)}"])
        joined = df.join(_small(small, self.most), match)
        return joined.drop(*[f"_on{i}" for i in range(len(on))])

    def numbered(
        self, previous: Mapping[str, str] | None = None, totals: Mapping[str, Column] | None = None
    ) -> DataFrame:
        """Rows with ``_global_rn``, the row number within the whole key.

        ``previous`` (``{output: column}``) adds values of the row before, also across a cut, and ``totals``
        aggregates of the whole key. All come with one summary and one join.
        """
        previous, totals = dict(previous or {}), dict(totals or {})
        aggs = {"_n": F.count(F.lit(1)), "_start": F.min("_seq")}
        if previous:
            last = F.struct(*[F.col(c).alias(o) for o, c in previous.items()])
            aggs["_last"] = F.max_by(last, "_seq")
        carried = self.summary(self.rows, aggs).select(
            *self.keys,
            "_piece",
            "_start",
            F.coalesce(F.sum("_n").over(self.before()), F.lit(0)).alias("_rows_before"),
            *([F.lag("_last").over(self.along()).alias("_carried")] if previous else []),
        )
        if totals:
            carried = self._with_totals(carried, totals)
        df = self.rows.select(
            "*", *[F.lag(c).over(self.window).alias(f"_near_{o}") for o, c in previous.items()]
        )
        joined = self.attach(df, carried)
        first = F.col("_seq") == F.col("_start")
        return joined.select(
            *df.columns[: len(self.rows.columns)],
            (F.col("_seq") - F.col("_start") + 1 + F.col("_rows_before")).cast("long").alias("_global_rn"),
            *[F.when(first, F.col("_carried")[o]).otherwise(F.col(f"_near_{o}")).alias(o) for o in previous],
            *totals,
        )

    def _with_totals(self, summary: DataFrame, totals: Mapping[str, Column]) -> DataFrame:
        """Aggregates of the whole key on each of its pieces: no join of the rows themselves."""
        whole = self.rows.groupBy(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(self.keys)]).agg(
            *[c.alias(n) for n, c in totals.items()]
        )
        match = [summary[k].eqNullSafe(whole[f"_of{i}"]) for i, k in enumerate(self.keys)]
        return summary.join(whole, match).drop(*[f"_of{i}" for i in range(len(self.keys))])

    def with_totals(self, totals: Mapping[str, Column]) -> DataFrame:
        """Rows with aggregates of their whole key."""
        pieces = self.rows.select(*self.keys, "_piece").distinct()
        return self.attach(self.rows, self._with_totals(pieces, totals))


# ---- whole groups ------------------------------------------------------------------------------------


def _middle(column: str, keys: Sequence[str]) -> Column:
    """The discrete median as a window: the value whose number is half of the values, rounded up."""
    sorted_ = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(column))
    return F.row_number().over(sorted_) == F.ceil(F.count(column).over(Window.partitionBy(*keys)) / 2)


def _with_medians(df: DataFrame, keys: Sequence[str], medians: Mapping[str, str]) -> DataFrame:
    whole = Window.partitionBy(*keys)
    marked = df.select("*", *[F.when(_middle(c, keys), F.col(c)).alias(f"_mid_{o}") for o, c in medians.items()])
    return marked.select(*df.columns, *[F.max(f"_mid_{o}").over(whole).alias(o) for o in medians])


def select_medians(
    rows: DataFrame, keys: Sequence[str], medians: Mapping[str, str], count: int, rows_per_task: int
) -> DataFrame:
    """``keys`` and exact discrete medians, for keys of any size: a selection in pieces.

    Equal values are counted first. The distinct values of all columns are cut by range into pieces; the counts of a
    key's pieces tell which of them holds the middle rank, and only that one is searched.
    """
    names = list(medians)
    value = "long" if all(isinstance(rows.schema[c].dataType, T.IntegralType) for c in medians.values()) else "double"
    flat = rows.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.inline(
            F.array(*[F.struct(F.lit(i).alias("_which"), F.col(medians[o]).cast(value).alias("_value")) for i, o in enumerate(names)])
        ),
    )
    by = [*[f"_k{i}" for i in range(len(keys))], "_which"]
    counted = flat.filter("_value is not null").groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("_times"))
    cut = cut_by_range(counted, [*by, "_value"], count * len(names), rows_per_task)
    along = Window.partitionBy(*by).orderBy("_piece")
    upto = F.sum("_held").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.ceil(F.sum("_held").over(Window.partitionBy(*by)) / 2)
    pieces = cut.groupBy(*by, "_piece").agg(F.sum("_times").alias("_held"))
    pieces = pieces.select(*by, "_piece", (upto - F.col("_held")).alias("_before"), upto.alias("_upto"), target.alias("_target"))
    middle = pieces.filter((F.col("_before") < F.col("_target")) & (F.col("_target") <= F.col("_upto")))
    middle = middle.select(
        *[F.col(c).alias(f"_of{c}") for c in by],
        F.col("_piece").alias("_in"),
        (F.col("_target") - F.col("_before")).alias("_left"),
    )
    match = [cut[c].eqNullSafe(middle[f"_of{c}"]) for c in by]
    held = cut.join(middle, [cut["_piece"] == middle["_in"], *match]).select(*by, "_value", "_times", "_left")
    seen = F.sum("_times").over(Window.partitionBy(*by).orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = held.withColumn("_seen", seen).filter((F.col("_seen") - F.col("_times") < F.col("_left")) & (F.col("_left") <= F.col("_seen")))
    return hit.groupBy(*by[:-1]).agg(
        *[
            F.max(F.when(F.col("_which") == i, F.col("_value"))).cast(rows.schema[medians[o]].dataType).alias(o)
            for i, o in enumerate(names)
        ]
    ).withColumnsRenamed({f"_k{i}": k for i, k in enumerate(keys)})


def group_medians(
    df: DataFrame, keys: Sequence[str], medians: Mapping[str, str], rows_per_task: int | None = None
) -> DataFrame:
    """One row per key: exact discrete medians of numeric columns (``{output: column}``), NULLs left out.

    Ordinary keys: one shuffle and a sort for each column. Hot keys: ``select_medians``. A key without values has NULL.
    """
    keys = list(keys)
    hot = find_hot_keys(df, keys, rows_per_task)
    plain = df.select(*keys, *set(medians.values()) - set(keys))
    marked = plain if hot is None else hot.others(plain)
    marked = marked.select(*keys, *[F.when(_middle(c, keys), F.col(c)).alias(f"_mid_{o}") for o, c in medians.items()])
    made = marked.groupBy(*keys).agg(*[F.max(f"_mid_{o}").alias(o) for o in medians])
    if hot is None:
        return made
    return made.unionByName(_hot_medians(hot.rows(plain), hot, medians))


def _hot_medians(rows: DataFrame, hot: HotKeys, medians: Mapping[str, str]) -> DataFrame:
    """Medians of all hot keys, also of those that have no value."""
    keys = list(hot.keys)
    found = select_medians(rows, keys, medians, hot.total_rows, hot.rows_per_task)
    found = found.withColumnsRenamed({k: f"_at{i}" for i, k in enumerate(keys)})
    every = rows.select(*keys).distinct()
    match = [every[k].eqNullSafe(found[f"_at{i}"]) for i, k in enumerate(keys)]
    return every.join(found, match, "left").select(*keys, *medians)


def group_stats(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Mapping[str, Column],
    rows_per_task: int | None = None,
    medians: Mapping[str, str] | None = None,
) -> DataFrame:
    """Aggregates of a row's whole group as new columns, for any mergeable aggregate, and exact ``medians``.

    Ordinary groups: windows that share one shuffle. Hot groups: a pre-aggregated groupBy whose rows go back
    by a broadcast, or piece by piece where there are too many hot groups for one.
    """
    keys, medians = list(keys), dict(medians or {})
    hot = find_hot_keys(df, keys, rows_per_task)
    whole = Window.partitionBy(*keys)
    plain = df if hot is None else hot.others(df)
    if medians:
        plain = _with_medians(plain, keys, medians)
    plain = plain.select("*", *[c.over(whole).alias(n) for n, c in aggs.items()])
    if hot is None:
        return plain
    rows = hot.rows(df)
    on = [F.col(k).alias(f"_on{i}") for i, k in enumerate(keys)]
    totals = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_hot_rows"), *[c.alias(n) for n, c in aggs.items()])
    if medians:
        found = _hot_medians(rows, hot, medians).withColumnsRenamed({k: f"_at{i}" for i, k in enumerate(keys)})
        same = [totals[f"_on{i}"].eqNullSafe(found[f"_at{i}"]) for i in range(len(keys))]
        totals = totals.join(found, same)
    made = [*df.columns, *medians, *aggs]
    if hot.count <= BROADCAST_ROWS:
        match = [rows[k].eqNullSafe(totals[f"_on{i}"]) for i, k in enumerate(keys)]
        return plain.unionByName(rows.join(F.broadcast(totals), match, "left").select(*made))
    pieces = Pieces(df, hot, [])
    listed = pieces.rows.select(*keys, "_piece").distinct()
    match = [listed[k].eqNullSafe(totals[f"_on{i}"]) for i, k in enumerate(keys)]
    listed = listed.join(totals, match).drop(*[f"_on{i}" for i in range(len(keys))])
    return plain.unionByName(pieces.attach(pieces.rows, listed).select(*made))
