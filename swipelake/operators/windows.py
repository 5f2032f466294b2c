"""Per-key ordered windows: running values, ranks, lags, moving averages, sessions.

``KeyedWindows`` collects the wanted columns and builds them together: ordinary keys share
one shuffle and one sort, hot keys are cut into pieces (see ``swipelake.skew``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from swipelake.columns import present
from swipelake.skew import HotKeys, Pieces, find_hot_keys


def _names(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


@dataclass(frozen=True)
class _Wanted:
    """One output column: how to build it from a window, or which hot-key recipe makes it."""

    alias: str
    kind: str
    column: str | None = None
    n: int = 0


def _total(local: Column, before: Column) -> Column:
    """Sum of two sums where NULL means "no value yet"."""
    return F.coalesce(local + before, local, before)


class KeyedWindows:
    """Window columns over rows of one key, in ``order_by`` order.

    ``tie_break`` makes row frames deterministic when ``order_by`` ties; ranks ignore it.
    ``rows_per_task`` is the size above which a key counts as hot.
    """

    def __init__(
        self,
        df: DataFrame,
        partition_by: str | Sequence[str],
        order_by: str | Sequence[str],
        tie_break: str | Sequence[str] = (),
        descending: bool = False,
        rows_per_task: int | None = None,
    ):
        self._df = df
        self._keys = _names(partition_by)
        order, ties = _names(order_by), _names(tie_break)
        present(df, [*self._keys, *order, *ties])
        self._descending = descending
        self._order = [F.desc(c) if descending else F.asc(c) for c in order]
        self._order_names = order
        self._full_order = [*self._order, *[F.asc(c) for c in ties]]
        self._rows_per_task = rows_per_task
        self._wanted: list[_Wanted] = []

    def _add(self, kind: str, alias: str, column: str | None = None, n: int = 0) -> KeyedWindows:
        if column is not None:
            present(self._df, [column])
        self._wanted.append(_Wanted(alias, kind, column, n))
        return self

    def running_total(self, column: str, alias: str | None = None) -> KeyedWindows:
        return self._add("running_sum", alias or f"{column}_running_total", column)

    def running_average(self, column: str, alias: str | None = None) -> KeyedWindows:
        return self._add("running_avg", alias or f"{column}_running_avg", column)

    def row_number(self, alias: str = "row_number") -> KeyedWindows:
        return self._add("row_number", alias)

    def rank(self, alias: str = "rank", dense: bool = False) -> KeyedWindows:
        return self._add("dense_rank" if dense else "rank", alias)

    def ntile(self, n: int = 4, alias: str = "quartile") -> KeyedWindows:
        return self._add("ntile", alias, n=n)

    def lag(self, column: str, offset: int = 1, alias: str | None = None) -> KeyedWindows:
        return self._add("lag", alias or f"{column}_lag_{offset}", column, offset)

    def lead(self, column: str, offset: int = 1, alias: str | None = None) -> KeyedWindows:
        return self._add("lead", alias or f"{column}_lead_{offset}", column, offset)

    def percent_change(self, column: str, alias: str | None = None) -> KeyedWindows:
        return self._add("pct_change", alias or f"{column}_pct_change", column, 1)

    def moving_average(self, column: str, size: int = 7, alias: str | None = None) -> KeyedWindows:
        return self._add("moving_avg", alias or f"{column}_ma_{size}", column, size)

    def result(self) -> DataFrame:
        hot = find_hot_keys(self._df, self._keys, self._rows_per_task)
        if hot is None:
            return self._plain(self._df)
        return self._plain(hot.others(self._df)).unionByName(self._cut(hot))

    def _plain(self, df: DataFrame) -> DataFrame:
        """One shuffle; row windows first, as their longer sort also serves the ranks."""
        rows = Window.partitionBy(*self._keys).orderBy(*self._full_order)
        ranks = Window.partitionBy(*self._keys).orderBy(*self._order)
        made = df
        for rank_pass in (False, True):
            chosen = [w for w in self._wanted if (w.kind in ("rank", "dense_rank")) == rank_pass]
            made = made.select("*", *[self._over(w, rows, ranks).alias(w.alias) for w in chosen])
        return made.select(*df.columns, *[w.alias for w in self._wanted])

    def _over(self, w: _Wanted, rows: WindowSpec, ranks: WindowSpec) -> Column:
        to_here = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        build: dict[str, Callable[[], Column]] = {
            "running_sum": lambda: F.sum(w.column).over(to_here),
            "running_avg": lambda: F.avg(w.column).over(to_here),
            "row_number": lambda: F.row_number().over(rows),
            "rank": lambda: F.rank().over(ranks),
            "dense_rank": lambda: F.dense_rank().over(ranks),
            "ntile": lambda: F.ntile(w.n).over(rows),
            "lag": lambda: F.lag(w.column, w.n).over(rows),
            "lead": lambda: F.lead(w.column, w.n).over(rows),
            "pct_change": lambda: _percent_change(F.col(w.column), F.lag(w.column).over(rows)),
            "moving_avg": lambda: F.avg(w.column).over(rows.rowsBetween(1 - w.n, 0)),
        }
        return build[w.kind]()

    # ---- hot keys ---------------------------------------------------------------------

    def _cut(self, hot: HotKeys) -> DataFrame:
        pieces = Pieces(self._df, hot, self._full_order)
        df = self._carried(pieces)
        near = [w for w in self._wanted if w.kind in ("lag", "lead", "pct_change", "moving_avg")]
        if near:
            df = self._near_rows(df, near, hot.rows_per_task)
        return df.select(*self._df.columns, *[w.alias for w in self._wanted])

    def _carried(self, pieces: Pieces) -> DataFrame:
        """Values that need totals of all earlier pieces.

        One summary holds the partial state of every wanted column, one scan over the pieces of a key adds the
        states up, and one join gives each row the state before its piece.
        """
        running = [w for w in self._wanted if w.kind in ("running_sum", "running_avg")]
        sums = list(dict.fromkeys(w.column for w in running))
        ranked = any(w.kind in ("rank", "dense_rank") for w in self._wanted)
        states = self._states(pieces, sums, ranked)

        by_value = Window.partitionBy(*pieces.keys, "_piece").orderBy(*self._order)
        local = {}
        for i, c in enumerate(sums):
            local[f"_sum_{i}"] = F.sum(c).over(pieces.running())
            local[f"_cnt_{i}"] = F.count(c).over(pieces.running())
        if ranked:
            local["_rk"], local["_drk"] = F.rank().over(by_value), F.dense_rank().over(by_value)
        rows = pieces.rows.select("*", *[c.alias(n) for n, c in local.items()])
        df = pieces.attach(rows, states)

        place = F.col("_seq") - F.col("_start") + 1 + F.col("_rows_before")
        made = {"_global_rn": place.cast("long")}
        for w in self._wanted:
            if w.kind == "row_number":
                made[w.alias] = place.cast("int")
            elif w.kind == "ntile":
                made[w.alias] = _tile(place, F.col("_size"), w.n)
            elif w.kind in ("running_sum", "running_avg"):
                i = sums.index(w.column)
                total = _total(F.col(f"_sum_{i}"), F.col(f"_sum_before_{i}"))
                seen = _total(F.col(f"_cnt_{i}"), F.col(f"_cnt_before_{i}"))
                made[w.alias] = total if w.kind == "running_sum" else F.try_divide(total, seen)
            elif w.kind == "rank":
                goes_on = F.col("_split") & (F.col("_rk") == 1)
                rank = F.when(goes_on, F.col("_carried_rank")).otherwise(F.col("_rk") + F.col("_rows_before"))
                made[w.alias] = rank.cast("int")
            elif w.kind == "dense_rank":
                made[w.alias] = (F.col("_drk") + F.col("_distinct_before")).cast("int")
        return df.select(*self._df.columns, *[c.alias(n) for n, c in made.items()])

    def _states(self, pieces: Pieces, sums: Sequence[str], ranked: bool) -> DataFrame:
        """Per key and piece: first row, rows before, key size, sums before, and how ranks go on across the cut.

        With ranks, rows of one order value are added up first, as equal values may lie on both sides of a cut.
        """
        parts = {"_n": F.count(F.lit(1)), "_start": F.min("_seq")}
        for i, c in enumerate(sums):
            parts |= {f"_s{i}": F.sum(c), f"_c{i}": F.count(c)}
        if ranked:
            value = F.struct(*self._order_names).alias("_value")
            rows = pieces.rows.groupBy(*pieces.keys, "_piece", value).agg(*[c.alias(n) for n, c in parts.items()])
            first, last, last_by = F.min, F.max, F.max_by
            if self._descending:
                first, last, last_by = F.max, F.min, F.min_by
            parts = {n: F.min(n) if n == "_start" else F.sum(n) for n in parts} | {
                "_first": first("_value"),
                "_last": last("_value"),
                "_last_n": last_by("_n", "_value"),
                "_distinct": F.count(F.lit(1)),
            }
        else:
            rows = pieces.rows
        states = pieces.summary(rows, parts)
        along, before = pieces.along(), pieces.before()
        upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        kept = [
            *pieces.keys,
            "_piece",
            "_start",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"),
            F.sum("_n").over(Window.partitionBy(*pieces.keys)).alias("_size"),
        ]
        for i in range(len(sums)):
            kept.append(F.sum(f"_s{i}").over(before).alias(f"_sum_before_{i}"))
            kept.append(F.sum(f"_c{i}").over(before).alias(f"_cnt_before_{i}"))
        if not ranked:
            return states.select(*kept)
        split = F.coalesce(F.lag("_last").over(along) == F.col("_first"), F.lit(False))
        states = states.select(*kept, "_n", "_last_n", "_distinct", split.alias("_split"))
        # Rank of the last value of each piece; a piece of one continued value keeps the old rank.
        continued = F.col("_split") & (F.col("_distinct") == 1)
        own = F.col("_rows_before") + F.col("_n") - F.col("_last_n") + 1
        states = states.withColumn("_last_rank", F.last(F.when(~continued, own), ignorenulls=True).over(upto))
        carried = F.lag("_last_rank").over(along).alias("_carried_rank")
        seen = F.coalesce(F.sum("_distinct").over(before), F.lit(0)) - F.sum(F.col("_split").cast("int")).over(upto)
        return states.select("*", carried, seen.alias("_distinct_before")).drop(
            "_n", "_last_n", "_distinct", "_last_rank"
        )

    def _near_rows(self, df: DataFrame, near: Sequence[_Wanted], size: int) -> DataFrame:
        """Values from a fixed number of rows away: blocks of ``size`` rows by row number, each
        with copies of the few neighbour rows it needs."""
        back = max([w.n for w in near if w.kind != "lead"], default=0)
        ahead = max([w.n for w in near if w.kind == "lead"], default=0)
        size = max(size, back, ahead)
        at = F.col("_global_rn") - 1
        df = df.withColumn("_home", F.floor(at / size).cast("long"))
        position = at - F.col("_home") * size
        df = df.withColumn(
            "_block",
            F.explode(
                F.array_compact(
                    F.array(
                        F.col("_home"),
                        F.when(position >= size - back, F.col("_home") + 1),
                        F.when(position < ahead, F.col("_home") - 1),
                    )
                )
            ),
        )
        rows = Window.partitionBy(*self._keys, "_block").orderBy("_global_rn")
        df = df.select("*", *[self._over(w, rows, rows).alias(w.alias) for w in near])
        return df.filter(F.col("_block") == F.col("_home"))


def _percent_change(value: Column, previous: Column) -> Column:
    """NULL when the previous value is NULL or 0."""
    return F.try_divide(value - previous, previous) * 100


def _tile(rn: Column, size: Column, n: int) -> Column:
    """Tile of row ``rn`` of ``size``: the first ``size % n`` tiles take one row more."""
    base = F.floor(size / n)
    extra = size - base * n
    long_rows = extra * (base + 1)
    tile = F.when(rn <= long_rows, F.floor((rn - 1) / (base + 1))).otherwise(
        extra + F.floor(F.try_divide(rn - 1 - long_rows, base))
    )
    return (tile + 1).cast("int")


def rank_in_group(
    df: DataFrame,
    partition_by: str | Sequence[str],
    order_by: str | Sequence[str],
    alias: str = "rank",
    descending: bool = True,
    rows_per_task: int | None = None,
) -> DataFrame:
    windows = KeyedWindows(
        df, partition_by, order_by, descending=descending, rows_per_task=rows_per_task
    )
    return windows.rank(alias).result()


def lag_periods(
    df: DataFrame,
    column: str,
    partition_by: str | Sequence[str],
    order_by: str | Sequence[str],
    periods: Sequence[int] = (1, 7, 30),
    tie_break: str | Sequence[str] = (),
    rows_per_task: int | None = None,
) -> DataFrame:
    windows = KeyedWindows(df, partition_by, order_by, tie_break, rows_per_task=rows_per_task)
    for period in periods:
        windows.lag(column, period)
    return windows.result()


def _starts_session(now: Column, before: Column, gap_minutes: float) -> Column:
    """1 on the first row, or after a gap above the limit; gaps count whole seconds."""
    gap = whole_seconds(now) - whole_seconds(before)
    return F.when(before.isNull() | (gap > gap_minutes * 60), 1).otherwise(0)


def whole_seconds(ts: Column) -> Column:
    """Epoch seconds of a timestamp, date or ISO string."""
    return F.unix_timestamp(ts.cast("timestamp"))


def sessionize(
    df: DataFrame,
    partition_by: str | Sequence[str],
    timestamp: str,
    gap_minutes: float = 30,
    tie_break: str | Sequence[str] = (),
    rows_per_task: int | None = None,
) -> DataFrame:
    """``session_id`` 1, 2, .. per key: a new session after a gap of more than ``gap_minutes``."""
    keys = _names(partition_by)
    order = [F.asc(c) for c in (timestamp, *_names(tie_break))]
    hot = find_hot_keys(df, keys, rows_per_task)
    plain = df if hot is None else hot.others(df)
    rows = Window.partitionBy(*keys).orderBy(*order)
    starts = _starts_session(F.col(timestamp), F.lag(timestamp).over(rows), gap_minutes)
    plain = plain.withColumn("_starts", starts).withColumn(
        "session_id",
        F.sum("_starts").over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    plain = plain.drop("_starts")
    if hot is None:
        return plain
    pieces = Pieces(df, hot, order)
    before = F.lag(timestamp).over(pieces.window)
    at_cut = F.lag("_seq").over(pieces.window).isNull()
    inner = F.when(at_cut, 0).otherwise(_starts_session(F.col(timestamp), before, gap_minutes))
    marked = pieces.rows.withColumn("_starts", inner)
    # A piece adds its inner starts, and one more where its first row begins a session.
    ends = pieces.summary(
        marked,
        {
            "_inner": F.sum("_starts"),
            "_first": F.min_by(timestamp, "_seq"),
            "_last": F.max_by(timestamp, "_seq"),
        },
    ).withColumn("_carried", F.lag("_last").over(pieces.along()))
    begins = _starts_session(F.col("_first"), F.col("_carried"), gap_minutes)
    ends = ends.withColumn("_begins", begins).select(
        *keys,
        "_piece",
        (
            F.coalesce(F.sum(F.col("_inner") + F.col("_begins")).over(pieces.before()), F.lit(0)) + F.col("_begins")
        ).alias("_sessions_before"),
    )
    counted = marked.withColumn("_here", F.sum("_starts").over(pieces.running()))
    cut = pieces.attach(counted, ends).withColumn("session_id", F.col("_here") + F.col("_sessions_before"))
    return plain.unionByName(cut.select(*df.columns, "session_id"))


def session_summary(
    sessions: DataFrame, partition_by: str | Sequence[str], timestamp: str, amount: str
) -> DataFrame:
    """Events, span and amount of each session; pre-aggregated, so a hot key costs nothing extra."""
    return sessions.groupBy(*_names(partition_by), "session_id").agg(
        F.count(F.lit(1)).alias("events"),
        (whole_seconds(F.max(timestamp)) - whole_seconds(F.min(timestamp))).alias("seconds"),
        F.sum(amount).alias("total_amount"),
    )
