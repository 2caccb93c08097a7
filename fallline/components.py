"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallline.runtime import cut, temporary


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label of every node that has an edge; nodes share a label iff a path joins them.

    Each round sends every node to the smallest node among itself and its neighbours and contracts the
    graph along these steps.  A star vanishes in one round; on other graphs the nodes that remain shrink
    by a factor each round when ids are not ordered along paths (hashes are not).  Minima are aggregated
    before the shuffle, and the join that relabels a hub's edges is one that skew handling can split.
    Every round's tables are written to the shared folder, so a lost executor costs one round; all but the
    result go at the end.
    """
    with temporary(edges.sparkSession) as keep:
        return keep(cut(_labels(edges, a, b), "labels"))


def _labels(edges: DataFrame, a: str, b: str) -> DataFrame:
    e = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    current = cut(edges.filter(F.col(a) != F.col(b)).select(*e).distinct(), "edges")
    steps: list[DataFrame] = []
    while not steps or not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up"))
        step = cut(step, "step")
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = step.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = current.join(left, "a").join(right, "b").filter("ua != ub")
        current = cut(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
    labels = steps[-1].select("node", F.col("up").alias("label"))
    for step in reversed(steps[:-1]):
        further = labels.select(F.col("node").alias("up"), F.col("label").alias("further"))
        labels = step.join(further, "up", "left").select("node", F.coalesce("further", "up").alias("label"))
    return labels
