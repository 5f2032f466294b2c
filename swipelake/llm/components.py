"""Connected components of a graph of links, as joins over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipelake.operators.joins import salted_join
from swipelake.scratch import written
from swipelake.skew import ROWS_PER_TASK


def components(links: DataFrame, label: str = "components", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``node, component`` (the component's smallest node) of all nodes in ``links`` (``a, b``, of one type).

    Each round every node takes the smallest label beside it and then that label's own label, so chains
    shrink by halves. Rounds are tables in the shared folder; they end when no label moves. The links of a hub and the
    nodes of one large component share a join key: above ``rows_per_task`` such keys are salted, and
    below that many links there is none to look for.
    """
    both = written(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))),
        label,
    )
    large = both.count() > rows_per_task

    def join(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
        return salted_join(big, small, [key], rows_per_task=rows_per_task) if large else big.join(small, key)

    labels = written(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")),
        label,
    )
    while True:
        near = labels.select(F.col("node").alias("b"), F.col("component").alias("near"))
        beside = join(both, near, "b").groupBy(F.col("a").alias("at")).agg(F.min("near").alias("near"))
        lowest = labels.join(beside, F.col("node") == F.col("at")).select(
            "node", "component", F.least("component", "near").alias("next")
        )
        parents = labels.select(F.col("node").alias("next"), F.col("component").alias("grand"))
        moved = written(
            join(lowest, parents, "next").select(
                "node",
                F.least("next", "grand").alias("component"),
                (F.least("next", "grand") < F.col("component")).alias("moved"),
            ),
            label,
        )
        labels = moved.drop("moved")
        if moved.filter("moved").limit(1).count() == 0:
            return labels
