"""Mixing categories to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swipelake.columns import CARD_COLUMNS, TxnColumns
from swipelake.llm.text import columns, word_count
from swipelake.scratch import written

_KEY_BITS = 60


# Rows of a bucket, and copies of one row that are listed together.
_BUCKET_ROWS = 100_000


def draw_key(transaction_id: Column, text: Column) -> Column:
    """A hash-random place in [0, 2^60) that depends on id and text alone, so reruns agree.

    Only copies of one text under one id tie, also where ids are NULL or shared by many rows.
    """
    parts = [F.coalesce(transaction_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, _KEY_BITS // 4), 16, 10).cast("long")


def _category(df: DataFrame, name: str) -> DataFrame:
    """The category as two never-NULL columns, so that joins and windows share one shuffle."""
    return df.withColumns(
        {"_name": F.coalesce(F.col(name).cast("string"), F.lit("")), "_none": F.col(name).isNull()}
    )


_BY = ("_name", "_none")


def category_targets(totals: DataFrame, weights: DataFrame, repeats: int = 3) -> DataFrame:
    """Share the words of all categories by weight; nobody gets over ``repeats`` times what it has.

    ``totals`` has ``_name, _none, category_words``; ``weights`` has ``category, weight``. What a full
    category cannot take is shared by weight among the others. Sorted by how soon a category is full,
    the level at which the rest share evenly comes from running sums. Returns ``target`` (double) per
    category. A category without a weight gets nothing.
    """
    given = _category(weights, "category").select(*_BY, F.col("weight").cast("double").alias("weight"))
    full = totals.join(given, list(_BY), "left").withColumns(
        {
            "weight": F.coalesce("weight", F.lit(0.0)),
            "most": F.lit(repeats).cast("long") * F.col("category_words"),
            "all_words": F.sum("category_words").over(Window.partitionBy()),
        }
    )
    ranked = full.withColumn(
        "fills_at", F.when(F.col("weight") > 0, F.col("most") / F.col("weight")).otherwise(F.lit(-1.0))
    )
    ranked = ranked.withColumn("most", F.when(F.col("weight") > 0, F.col("most")).otherwise(F.lit(0)))
    order = Window.partitionBy().orderBy("fills_at", *_BY)
    running = ranked.withColumns(
        {
            "taken_before": F.coalesce(
                F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
            "weight_left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
            "place": F.row_number().over(order),
        }
    ).withColumn(
        "level",
        F.when(
            F.col("weight_left") > 0,
            (F.col("all_words") - F.col("taken_before")) / F.col("weight_left"),
        ),
    )
    # The first category that does not fill sets the level of all that follow.
    open_level = F.min(
        F.when(F.col("fills_at") > F.col("level"), F.struct("place", "level"))
    ).over(Window.partitionBy())["level"]
    return running.withColumn("open_level", open_level).select(
        *_BY,
        "category_words",
        F.least(
            F.col("most").cast("double"),
            F.coalesce(F.col("open_level") * F.col("weight"), F.col("most").cast("double")),
        ).alias("target"),
    )


def _counted(txns: DataFrame, cols: TxnColumns) -> DataFrame:
    """Sizes and keys of all rows; copies of a row are one row with their number ``_n``."""
    source = columns(txns, transaction_id=cols.transaction_id, category=cols.category, text=cols.merchant)
    digest = source.select(
        "transaction_id",
        "category",
        word_count(F.col("text")).alias("words"),
        draw_key(F.col("transaction_id"), F.col("text")).alias("_key"),
    )
    digest = _category(digest, "category")
    return written(
        digest.groupBy(*_BY, "_key", "transaction_id", "words").agg(F.count(F.lit(1)).alias("_n")), "mix"
    )


def _ordered(rows: DataFrame, weights: DataFrame, repeats: int, buckets: int | None) -> DataFrame:
    """Counted rows with their category's budget and the words before them in the category's draw order."""
    if buckets is None:
        largest = rows.groupBy(*_BY).count().agg(F.max("count")).first()[0] or 0
        buckets = -(-largest // _BUCKET_ROWS)
    shift = _KEY_BITS - max(0, buckets - 1).bit_length()
    rows = rows.withColumns({"_bucket": F.shiftright("_key", shift), "_all": F.col("words") * F.col("_n")})
    sums = rows.groupBy(*_BY, "_bucket").agg(F.sum("_all").alias("_sum"))
    whole = Window.partitionBy(*_BY)
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    totals = rows.groupBy(*_BY).agg(F.sum("_all").alias("category_words"))
    budgets = category_targets(totals, weights, repeats).withColumn(
        "_budget", F.floor(F.col("target") + 0.5).cast("long")
    )
    size = F.greatest(F.col("category_words"), F.lit(1))
    budgets = budgets.withColumns(
        {"_epochs": F.floor(F.col("_budget") / size), "_rest": F.col("_budget") % size}
    )
    inside = Window.partitionBy(*_BY, "_bucket").orderBy("_key", "transaction_id", "words")
    running = F.sum("_all").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        rows.withColumn("_in_bucket", running - F.col("_all"))
        .join(before.join(budgets, list(_BY)), [*_BY, "_bucket"])
        .withColumn("_words_before", F.col("_before") + F.col("_in_bucket"))
    )


def _each_copy(counted: DataFrame) -> DataFrame:
    """A row for each copy, with its own words before it; many copies are listed by many tasks."""
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.floor((F.col("_n") - 1) / _BUCKET_ROWS)
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    first = F.col("_chunk") * _BUCKET_ROWS
    ends = F.least(F.col("_n"), first + _BUCKET_ROWS) - 1
    return (
        chunks.repartition(parts, "_key", "_chunk")
        .withColumn("_copy", F.explode(F.sequence(first, ends)))
        .withColumn("_words_before", F.col("_words_before") + F.col("_copy") * F.col("words"))
    )


def mix_categories(
    txns: DataFrame,
    weights: DataFrame,
    cols: TxnColumns = CARD_COLUMNS,
    repeats: int = 3,
    buckets: int | None = None,
) -> DataFrame:
    """How many words of each transaction's merchant descriptor the mix takes.

    Every transaction gets a hash-random key; within a category transactions are sorted by it, cut into
    ``buckets`` key ranges (keys are uniform, so the ranges are even, also in a category that holds most
    rows; by default as many as give the largest category about 100,000 rows a range). Sums of the ranges
    give distributed prefix sums of word counts. Whole epochs of a category are taken while its budget
    lasts, and the last epoch is cut at the exact word. Copies of a row are counted before they are sorted
    and listed again at the end, so any number of them may be equal.

    Returns ``transaction_id, words, category_words, target, taken, epochs, cut_words``, one row for each
    input row: ``taken = epochs * words + cut_words`` and at most ``repeats * words``. A NULL category is a
    category, a NULL or empty text has no words and gives nothing, repeated rows count each and follow each
    other, ids may be NULL or shared, an empty table gives an empty one. Extra columns do not matter.
    ``weights`` is a table ``category, weight``; a category without weight gives nothing.
    """
    found = _each_copy(_ordered(_counted(txns, cols), weights, repeats, buckets))
    cut = F.greatest(F.lit(0), F.least(F.col("words"), F.col("_rest") - F.col("_words_before")))
    return found.select(
        F.col("transaction_id").alias(cols.transaction_id),
        "words",
        "category_words",
        "target",
        (F.col("_epochs") * F.col("words") + cut).cast("long").alias("taken"),
        F.col("_epochs").cast("long").alias("epochs"),
        cut.cast("long").alias("cut_words"),
    )


def _cuts(found: DataFrame) -> DataFrame:
    """The last place of each category's draw order that the last epoch takes, and how many copies there."""
    fits = F.floor((F.col("_rest") - F.col("_words_before")) / F.col("words") + 0.5).cast("long")
    copies = F.when(F.col("words") == 0, F.col("_n")).otherwise(F.least(F.col("_n"), fits))
    starts = F.col("_words_before") + F.col("words") / 2 <= F.col("_rest")
    last = F.struct(
        "_key",
        F.col("transaction_id").alias("_id"),
        F.col("words").alias("_words"),
        copies.alias("_copies"),
        (copies < F.col("_n")).alias("_split"),
    )
    return found.groupBy(*_BY).agg(
        F.max("_epochs").cast("int").alias("_epochs"),
        F.max(F.when(starts & (F.col("_rest") > 0), last)).alias("_last"),
    )


def mixed(
    txns: DataFrame,
    weights: DataFrame,
    cols: TxnColumns = CARD_COLUMNS,
    repeats: int = 3,
    buckets: int | None = None,
) -> DataFrame:
    """The mixed transactions themselves, with all their columns: a row for each time one is taken.

    The cut of each category is one place in its draw order, so only a row per category goes to the
    texts and no text is shuffled for its place. Texts stay whole: the transaction that the cut falls into
    is taken when at least half of its words are. Where the cut falls among copies of one row, those copies alone
    are written apart and numbered by the part of the table that they lie in, and the first ones are taken.
    Nulls and ties as in ``mix_categories``; a transaction without words is kept once where its category
    takes its place in the order.
    """
    found = _ordered(_counted(txns, cols), weights, repeats, buckets)
    cuts = written(_cuts(found), "mix_cuts")
    name, text = txns[cols.transaction_id], txns[cols.merchant]
    rows = txns.select(
        F.struct(*[txns[c] for c in txns.columns]).alias("row"),
        name.alias("_own"),
        word_count(text).alias("_own_words"),
        draw_key(name, text).alias("_key"),
        txns[cols.category].alias("category"),
    )
    rows = _category(rows, "category").join(cuts, list(_BY))
    last, own, size = F.col("_last"), F.col("_own"), F.col("_own_words")
    same_id = own.eqNullSafe(last["_id"])
    id_before = F.coalesce(own < last["_id"], own.isNull() & last["_id"].isNotNull())
    same_key = F.col("_key") == last["_key"]
    before = (F.col("_key") < last["_key"]) | (same_key & (id_before | (same_id & (size < last["_words"]))))
    tied = same_key & same_id & (size == last["_words"])
    cut_among = F.coalesce(tied & last["_split"], F.lit(False))
    whole = F.coalesce(before | (tied & ~last["_split"]), F.lit(False))
    times = F.col("_epochs") + whole.cast("int")
    ties = written(
        rows.filter(cut_among).select(
            "row", *_BY, "_epochs", last["_copies"].alias("_copies"), F.monotonically_increasing_id().alias("_at")
        ),
        "mix_ties",
    )
    return (
        rows.filter(~cut_among)
        .select("row", times.alias("_times"))
        .unionByName(_first_copies(ties))
        .withColumn("_time", F.explode(F.sequence(F.lit(0), "_times")))
        .filter(F.col("_time") > 0)
        .select("row.*")
    )


def _first_copies(ties: DataFrame) -> DataFrame:
    """``row, _times``: the first ``_copies`` rows of each category once more than the others.

    ``_at`` holds the part that wrote a row above its lowest 33 bits; parts are as small as tasks.
    """
    ties = ties.withColumn("_part", F.shiftright("_at", 33))
    sums = ties.groupBy(*_BY, "_part").count()
    parts = Window.partitionBy(*_BY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select(*_BY, "_part", F.coalesce(F.sum("count").over(parts), F.lit(0)).alias("_earlier"))
    inside = F.row_number().over(Window.partitionBy(*_BY, "_part").orderBy("_at"))
    placed = ties.withColumn("_place", inside).join(earlier, [*_BY, "_part"])
    more = (F.col("_earlier") + F.col("_place") <= F.col("_copies")).cast("int")
    return placed.select("row", (F.col("_epochs") + more).alias("_times"))
