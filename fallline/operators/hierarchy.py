"""Hierarchical splitting of terrain into slope units.

Level by level, every active parent is cut by the half-basins of that level.  A parent whose cells, shared
among its children, fall under the smallest area becomes a unit whole; otherwise each child splits further
or is final, by its area and the circular variance of its aspects.  One level is an aggregation over
(parent, half-basin), decisions on its groups, and a join back to the cells; cells whose fate is decided
leave the loop.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fallline.operators import regions as _regions
from fallline.operators.stencil import circular_variance
from fallline.runtime import cut


@dataclass(frozen=True)
class Rules:
    cell_area: float
    min_area: float = 100_000.0
    cv_min: float = 0.25
    max_area: float | None = None

    def __post_init__(self):
        if self.cell_area <= 0 or self.min_area <= 0 or not 0 <= self.cv_min <= 1:
            raise ValueError("areas must be positive and cv_min between 0 and 1")


def aggregate(active: DataFrame) -> DataFrame:
    """parent, hb, n, n_aspect, sum_sin, sum_cos of every (parent, half-basin), hb 0 included."""
    seen = F.col("aspect_valid").cast("int")
    return active.groupBy("parent", "hb").agg(
        F.count("*").alias("n"), F.sum(seen).alias("n_aspect"),
        F.sum(F.when(F.col("aspect_valid"), F.col("sin_aspect").cast("double")).otherwise(0.0)).alias("sum_sin"),
        F.sum(F.when(F.col("aspect_valid"), F.col("cos_aspect").cast("double")).otherwise(0.0)).alias("sum_cos"))


def decide(children: DataFrame, rules: Rules, last: bool) -> DataFrame:
    """parent, hb and decision: ``reject`` (the parent is a unit), ``split``, ``final``, or null (nothing)."""
    mine = Window.partitionBy("parent")
    out = children.withColumn("n_parent", F.sum("n").over(mine)).withColumn("diversity", F.sum((F.col("hb") > 0).cast("int")).over(mine))
    small = (F.col("diversity") > 0) & (F.col("n_parent") * rules.cell_area / F.col("diversity") < rules.min_area)
    area, cv = F.col("n") * rules.cell_area, circular_variance(F.col("n_aspect"), F.col("sum_sin"), F.col("sum_cos"))
    divide = (area > rules.min_area) & (cv > rules.cv_min)
    if rules.max_area is not None:
        divide = divide | (area > rules.max_area)
    decision = F.when(small, "reject").when(F.col("hb") == 0, None).when(divide & F.lit(not last), "split").otherwise("final")
    return out.select("parent", "hb", decision.alias("decision"))


def units(cells: DataFrame, levels: DataFrame | Callable[[int], DataFrame], rules: Rules, count: int, *, early_exit: bool = True) -> DataFrame:
    """cell_id and category of every valid cell.

    ``cells`` has cell_id, sin_aspect, cos_aspect and aspect_valid of the valid cells, ``levels`` has level, cell_id and hb, or
    gives cell_id and hb of a level when it is called with one.
    Categories are groups (level, decision, parent, hb) numbered densely; cells that no level decides take the last
    level's half-basin, and what is left is one category.  Without ``early_exit`` all levels are aggregated,
    also those that nothing reaches; the result is the same.
    """
    level_of = levels if callable(levels) else lambda k: levels.filter(F.col("level") == k).select("cell_id", "hb")
    active = cells.select("cell_id", "sin_aspect", "cos_aspect", "aspect_valid", F.lit(0).cast("long").alias("parent"))
    done: list[DataFrame] = []
    for level in range(1, count + 1):
        here = level_of(level)
        work = cut(active.join(here, "cell_id", "left").withColumn("hb", F.coalesce("hb", F.lit(0))), f"level{level}")
        verdict = decide(aggregate(work), rules, level == count)
        # A rejected parent is one group; else a child is.  Groups get ids that tell parents of the next level apart.
        group = F.when(F.col("decision") == "reject", F.xxhash64(F.lit(level), "parent")).otherwise(F.xxhash64(F.lit(level), "parent", "hb"))
        ruled = cut(work.join(verdict, ["parent", "hb"]).withColumn("group", group), f"ruled{level}")
        done.append(ruled.filter("decision IN ('reject', 'final')").select("cell_id", "group"))
        active = ruled.filter("decision = 'split'").select("cell_id", "sin_aspect", "cos_aspect", "aspect_valid", F.col("group").alias("parent"))
        if early_exit and active.isEmpty():
            break
    chosen = done[0]
    for one in done[1:]:
        chosen = chosen.unionByName(one)
    rest = level_of(count)
    out = cells.select("cell_id").join(chosen, "cell_id", "left").join(rest, "cell_id", "left")
    gap = F.when(F.col("hb") > 0, F.xxhash64(F.lit(0), "hb")).otherwise(F.xxhash64(F.lit(-1)))
    out = cut(out.select("cell_id", F.coalesce("group", gap).alias("group")), "groups")
    numbered = _regions.number_rows(out.select("group").distinct(), ["group"], "category").select("group", "category")
    return out.join(numbered, "group").select("cell_id", "category")
