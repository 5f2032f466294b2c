"""Nearest transactions by feature vector: a forest proposes, exact cosines decide."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swipelake.columns import CARD_COLUMNS, TxnColumns
from swipelake.llm.forest import Tree, grow_tree, leaf_of, leaves_needed, search
from swipelake.llm.shipping import ship
from swipelake.llm.text import columns
from swipelake.scratch import written


def _usable(vector: Column) -> Column:
    """No NULL, NaN or infinite component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as float64 rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _units(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that very large or small components neither overflow nor vanish.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def fit_forest(
    points: DataFrame, trees: int, sample_rows: int, leaf_rows: int, k: int, recall: float, seed: int
) -> tuple[list[Tree], int]:
    """The forest and the leaves to search, from at most ``sample_rows`` points in hash order."""
    sample = points.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(sample_rows).toArrow()
    vectors = _units(_matrix(sample.column("vector").combine_chunks()))
    rng = np.random.default_rng(seed)
    forest = [grow_tree(vectors, leaf_rows, rng) for _ in range(trees)]
    return forest, leaves_needed(forest, vectors, k, recall)


def _cells(points: DataFrame, forest: list[Tree], leaves: int | None) -> DataFrame:
    """Rows ``tree, leaf, pid, vector``: the home leaf in each tree, or the leaves that a search visits."""
    schema = "tree int, leaf int, pid long, vector array<double>"
    shared = points.sparkSession.sparkContext.broadcast(forest)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _units(_matrix(batch.column("vector")))
            if leaves is None:
                home = [leaf_of(tree, units) for tree in shared.value]
                hits = [(row, t, int(leaf)) for t, own in enumerate(home) for row, leaf in enumerate(own)]
            else:
                hits = [
                    (row, t, leaf)
                    for row, unit in enumerate(units)
                    for t, leaf in search(shared.value, unit, leaves)
                ]
            for at in range(0, len(hits), 20_000):
                rows, tree, leaf = zip(*hits[at : at + 20_000], strict=True)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(tree, pa.int32()),
                        pa.array(leaf, pa.int32()),
                        batch.column("pid").take(take),
                        batch.column("vector").take(take),
                    ],
                    ["tree", "leaf", "pid", "vector"],
                )

    return points.select("pid", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(place, schema)


def _nearest_in_cell(k: int):
    """Each query's best ``k`` points of a cell, by exact cosine in double precision."""

    def best(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(points):
            ids = points["pid"].to_numpy()
            own = _units(np.stack(points["vector"].to_numpy()).astype(np.float64))
            for at in range(0, len(queries), 512):
                part = queries.iloc[at : at + 512]
                near = _units(np.stack(part["vector"].to_numpy()).astype(np.float64)) @ own.T
                width = min(k, len(ids))
                floor = np.partition(near, len(ids) - width, axis=1)[:, len(ids) - width]
                for row, query in enumerate(part["pid"].to_numpy()):
                    hit = np.flatnonzero(near[row] >= floor[row])
                    order = hit[np.lexsort((points["first_id"].to_numpy()[hit], -near[row][hit]))][:width]
                    out.extend((int(query), int(ids[j]), float(near[row][j])) for j in order)
        return pd.DataFrame(out, columns=["query", "point", "score"])

    return best


def nearest_transactions(
    vectors: DataFrame,
    queries: Column,
    cols: TxnColumns = CARD_COLUMNS,
    features: str = "features",
    k: int = 5,
    trees: int = 4,
    sample_rows: int = 20_000,
    leaf_rows: int = 64,
    recall: float = 0.97,
    cell_rows: int = 50_000,
    seed: int = 11,
) -> DataFrame:
    """The ``k`` transactions with the largest cosine to each query's feature vector.

    ``vectors`` has the transaction id and an array of numbers, such as the model's features; ``queries`` is a
    condition on its columns. A forest of random-projection trees is fitted on at most ``sample_rows`` vectors
    (every row is indexed); a query takes leaves from one priority queue over all trees, as many as found
    ``recall`` of the true neighbours of sample points, so the share of rows that it meets depends on how
    clustered the vectors are. All rows of those leaves are ranked by exact cosine in double precision. Equal vectors
    are one point with their ``k + 1`` smallest ids, and equal queries one search, so copies cost
    nothing. A leaf above ``cell_rows`` points is cut into several cells.

    Returns ``query_id, rank, transaction_id, score``, nearest first, ties to the smaller id, the query's own id
    left out; fewer rows where there are fewer candidates. Vectors that are NULL, zero, of another
    length than most, or that hold NULL or non-finite components take no part, nor do NULL ids; a repeated row
    counts once. An empty table gives an empty result; extra columns do not matter.
    """
    ship(vectors.sparkSession)
    flagged = vectors.withColumn("_is_query", queries)
    source = columns(flagged, id=cols.transaction_id, vector=features, is_query="_is_query")
    usable = source.filter(F.col("id").isNotNull() & _usable(F.col("vector")))
    size = usable.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    spark = vectors.sparkSession
    empty = f"query_id long, rank int, {cols.transaction_id} long, score double"
    if size is None:
        return spark.createDataFrame([], empty)
    usable = usable.filter(F.size("vector") == size["size"]).withColumn(
        "is_query", F.coalesce("is_query", F.lit(False))
    )
    # Only the first ids of a vector count; the limit is applied before the shuffle.
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = usable.select("vector", "id").distinct().withColumn("place", place).filter(F.col("place") <= k + 1)
    asked = usable.filter("is_query").select("vector", "id").distinct()
    listed = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    searched = asked.select("vector").distinct().withColumn("is_query", F.lit(True))
    points = written(
        listed.join(searched, "vector", "left").select(
            "vector",
            "ids",
            F.coalesce("is_query", F.lit(False)).alias("is_query"),
            F.monotonically_increasing_id().alias("pid"),
        ),
        "points",
    )
    forest, leaves = fit_forest(points, trees, sample_rows, leaf_rows, k, recall, seed)

    first = points.select("pid", F.col("ids")[0].alias("first_id"))
    index = written(_cells(points, forest, None), "index")
    counts = index.groupBy("tree", "leaf").agg(
        F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("cells")
    )
    # One row for each leaf of the forest, which the sample bounds.
    counts = F.broadcast(written(counts, "leaf_counts"))
    inside = (
        index.join(counts, ["tree", "leaf"])
        .withColumn("cell", F.pmod(F.xxhash64("pid"), F.col("cells")).cast("int"))
        .join(first, "pid")
    )
    visits = (
        _cells(points.filter("is_query"), forest, leaves)
        .join(counts, ["tree", "leaf"])
        .withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    )
    keys = ["tree", "leaf", "cell"]
    met = (
        visits.select(*keys, "pid", "vector")
        .groupBy(*keys)
        .cogroup(inside.select(*keys, "pid", "first_id", "vector").groupBy(*keys))
        .applyInPandas(_nearest_in_cell(k + 1), "query long, point long, score double")
    )
    # A point met in several trees counts once.
    once = met.groupBy("query", "point").agg(F.max("score").alias("score"))
    ids = points.select(F.col("pid").alias("point"), "ids")
    each = once.join(ids, "point").select("query", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = each.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    found = top.groupBy(F.col("query").alias("pid")).agg(
        F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("found")
    )
    answers = points.select("pid", "vector").join(found, "pid").select("vector", "found")
    own = asked.join(answers, "vector").select(
        F.col("id").alias("query_id"),
        F.slice(F.filter("found", lambda f: f["id"] != F.col("id")), 1, k).alias("found"),
    )
    return own.select("query_id", F.posexplode("found").alias("at", "hit")).select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("hit.id").alias(cols.transaction_id),
        F.col("hit.score").alias("score"),
    )
