"""Connected regions of a grid, their numbering, statistics, cleaning and outlines."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallline.components import connected_components
from fallline.grid import GridSpec
from fallline.operators import stencil
from fallline.runtime import cut, ship

#: Side of the tiles whose regions are found in one task.
TILE = 1024


def _tile_regions(values: np.ndarray, diagonal: bool) -> np.ndarray:
    """Smallest flat index of each cell's region of equal positive values, by sweeps of running minima."""
    rows, cols = values.shape
    label = np.where(values > 0, np.arange(rows * cols).reshape(rows, cols), -1)
    parent = np.arange(rows * cols)
    pairs = [(values[:, :-1], values[:, 1:], label[:, :-1], label[:, 1:]), (values[:-1], values[1:], label[:-1], label[1:])]
    if diagonal:
        pairs += [(values[:-1, :-1], values[1:, 1:], label[:-1, :-1], label[1:, 1:]), (values[:-1, 1:], values[1:, :-1], label[:-1, 1:], label[1:, :-1])]
    a = np.concatenate([x[(u == v) & (u > 0)] for u, v, x, _ in pairs])
    b = np.concatenate([y[(u == v) & (u > 0)] for u, v, _, y in pairs])
    while len(a):
        low = np.minimum(a, b)
        np.minimum.at(parent, a, low)
        np.minimum.at(parent, b, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        a, b = parent[a], parent[b]
        keep = a != b
        a, b = a[keep], b[keep]
    return np.where(values > 0, parent.reshape(rows, cols), -1)


def regions(cells: DataFrame, grid: GridSpec, value: str, *, diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """cell_id and region (smallest cell of the region in its first tile) of cells with a positive ``value``.

    Tiles find their regions by themselves; pairs of regions that touch across tile seams are joined as a graph,
    whose size is that of the seams.
    """
    ship(cells.sparkSession)
    rows, cols = grid.rows, grid.cols

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(frame["r"].iloc[0]) // tile * tile, int(frame["c"].iloc[0]) // tile * tile
        values = np.zeros((min(tile, rows - r0), min(tile, cols - c0)), np.int64)
        r, c = frame["r"].to_numpy() - r0, frame["c"].to_numpy() - c0
        values[r, c] = frame["v"].to_numpy()
        found = _tile_regions(values, diagonal)[r, c]
        width = values.shape[1]
        region = (found // width + r0).astype(np.int64) * cols + found % width + c0
        return pd.DataFrame({"cell_id": frame["cell_id"], "r": frame["r"], "c": frame["c"], "v": frame["v"], "region": region})

    positive = cells.select("cell_id", "r", "c", F.col(value).cast("long").alias("v")).filter("v > 0")
    local = positive.groupBy(F.expr(f"r div {tile}"), F.expr(f"c div {tile}")).applyInPandas(run, "cell_id bigint, r int, c int, v bigint, region bigint")
    if rows <= tile and cols <= tile:
        return local.select("cell_id", "region")
    local = cut(local, "tiles")
    on_seam = F.expr(f"r % {tile} IN (0, {tile - 1}) OR c % {tile} IN (0, {tile - 1})")
    seam = local.filter(on_seam)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    sent = seam.select("v", F.col("region").alias("a"), F.explode(F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in steps])).alias("to"))
    sent = sent.select("a", "v", F.col("to.r").alias("r"), F.col("to.c").alias("c"))
    links = sent.join(seam.select("r", "c", "v", F.col("region").alias("b")), ["r", "c", "v"]).filter("a != b").select("a", "b")
    label = connected_components(links)
    out = local.join(label, local["region"] == label["node"], "left")
    return out.select("cell_id", F.coalesce("label", "region").alias("region"))


def number_rows(df: DataFrame, order: list, name: str) -> DataFrame:
    """Number rows from 1 in a global order without sorting in one task: ranges are sorted apart and counted."""
    spark = df.sparkSession
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftrightunsigned("_at", 33)
    counts = sorted((r[0], r[1]) for r in ranged.groupBy(part.alias("p")).count().collect())  # one row a partition
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    table = spark.createDataFrame(before, "_p bigint, _before bigint")
    out = ranged.withColumn("_p", part).join(F.broadcast(table), "_p")
    return out.withColumn(name, F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1).drop("_p", "_before", "_at")


def clump(cells: DataFrame, grid: GridSpec, value: str, *, tile: int = TILE) -> DataFrame:
    """cell_id and clump: 4-connected regions of equal positive value, numbered in the order of their first cells
    (by tile, and by row and column within a tile)."""
    found = cut(regions(cells, grid, value, tile=tile), "regions")
    r, c = F.expr(f"region div {grid.cols}"), F.expr(f"region % {grid.cols}")
    order = found.select("region").distinct().select("region", F.struct((r / tile).cast("int").alias("tr"), (c / tile).cast("int").alias("tc"), (r % tile).alias("r"), (c % tile).alias("c")).alias("o"))
    # A region that spans tiles begins in the first of them.
    if grid.rows > tile or grid.cols > tile:
        rr, cc = F.expr(f"cell_id div {grid.cols}"), F.expr(f"cell_id % {grid.cols}")
        order = found.groupBy("region").agg(F.min(F.struct((rr / tile).cast("int").alias("tr"), (cc / tile).cast("int").alias("tc"), (rr % tile).alias("r"), (cc % tile).alias("c"))).alias("o"))
    return found.join(number_rows(order, ["o"], "clump").select("region", "clump"), "region").select("cell_id", "clump")


def label_stats(cells: DataFrame, label: str = "label", *, reference_count: bool = True) -> DataFrame:
    """label, n, n_aspect and aspect sums of every positive label, and its bounding box.

    With ``reference_count`` a cell without aspect counts in n_aspect too (its sums are 0).
    """
    counted = F.lit(1) if reference_count else F.col("aspect_valid").cast("int")
    return cells.filter(F.col(label) > 0).groupBy(F.col(label).alias("label")).agg(
        F.count("*").alias("n"), F.sum(counted).alias("n_aspect"),
        F.sum(F.col("sin_aspect").cast("double")).alias("sum_sin"), F.sum(F.col("cos_aspect").cast("double")).alias("sum_cos"),
        F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.min("c").alias("c_min"), F.max("c").alias("c_max"),
    )


def segmentation_metrics(cells: DataFrame, label: str = "label") -> DataFrame:
    """One row: V (area-weighted circular variance), I (mean cosine between neighbours' departures from the mean
    direction), units, adjacency_pairs and valid_cells."""
    stats = label_stats(cells, label)
    total = stats.agg(F.sum("sum_sin").alias("ts"), F.sum("sum_cos").alias("tc"), F.sum("n").alias("valid_cells"), F.count("*").alias("units"),
                      (F.sum(F.col("n") * stencil.circular_variance(F.col("n_aspect"), F.col("sum_sin"), F.col("sum_cos"))) / F.sum("n")).alias("V"))
    mean = total.select(F.atan2("ts", "tc").alias("a_all"))
    unit = stats.select("label", F.atan2("sum_sin", "sum_cos").alias("a")).crossJoin(F.broadcast(mean))
    unit = unit.select("label", F.atan2(F.sin("a") + F.sin("a_all"), F.cos("a") + F.cos("a_all")).alias("beta"))
    pairs = stencil.adjacency(cells, label)
    pairs = pairs.join(unit.select(F.col("label").alias("low"), F.col("beta").alias("b1")), "low").join(unit.select(F.col("label").alias("high"), F.col("beta").alias("b2")), "high")
    contact = pairs.agg(F.avg(F.cos(F.col("b1") - F.col("b2"))).alias("I"), F.count("*").alias("adjacency_pairs"))
    return total.select("V", "units", "valid_cells").crossJoin(F.broadcast(contact)).select("V", "I", "units", "adjacency_pairs", "valid_cells")


def clean(labels: DataFrame, grid: GridSpec, clean_size_m2: float, *, method: str = "basic", label: str = "label") -> DataFrame:
    """cell_id and clump after units of up to ``clean_size_m2`` are given to their nearest larger neighbours.

    ``quick`` also smooths: labels shrink to their interiors and grow back until nothing is left to fill or the
    growth reaches 1000 cells; what is still empty keeps its first label.
    """
    if method not in ("basic", "quick"):
        raise ValueError("method is basic or quick")
    radius = max(1, int(math.sqrt(10.0 * clean_size_m2 / grid.cell_area / math.pi)))
    raw = labels.select("cell_id", "r", "c", F.coalesce(F.col(label), F.lit(0)).cast("long").alias("raw"))
    kept = raw.filter("raw > 0").groupBy("raw").agg(F.count("*").alias("n")).filter(F.col("n") * grid.cell_area > clean_size_m2).select("raw")
    work = raw.join(kept.withColumn("keep", F.lit(True)), "raw", "left").select(
        "cell_id", "r", "c", "raw", F.when(F.col("keep"), F.col("raw")).otherwise(0).alias("label"), (F.col("raw") > 0).alias("target"))
    work = cut(stencil.grow(cut(work, "kept"), radius), "cleaned")
    if method == "quick":
        work = cut(stencil.interior(work), "interior")
        step, done = max(8, min(64, 2 * radius)), 0
        while done < 1000 and not work.filter("target AND label = 0").isEmpty() and not work.filter("label > 0").isEmpty():
            before = work.filter("target AND label = 0").count()
            work = cut(stencil.grow(work, step), "grown")
            done += step
            if work.filter("target AND label = 0").count() == before:
                break
    work = work.withColumn("label", F.when(F.col("target") & (F.col("label") == 0), F.col("raw")).otherwise(F.col("label")))
    return clump(work, grid, "label")


def polygons(labels: DataFrame, grid: GridSpec, label: str = "label") -> DataFrame:
    """su_id, raster_id, area_map and wkt (MULTIPOLYGON of rings, holes after their shells) of every unit.

    The sides on which a unit borders on something else come from windows over lines; a unit's sides are then
    stitched into rings in one task, so a task holds one unit's outline.
    """
    ship(labels.sparkSession)
    me = F.coalesce(F.col(label), F.lit(0))
    out = stencil.cardinal(labels, me, ("_n", "_w", "_e", "_s")).withColumn("_me", me).filter("_me > 0")
    differs = lambda k: F.coalesce(F.col(k), F.lit(0)) != F.col("_me")
    # Sides run clockwise around the cell: (from row, from column, to row, to column) of corners.
    side = lambda k, a, b, c, d: F.when(differs(k), F.array(F.col("r") + a, F.col("c") + b, F.col("r") + c, F.col("c") + d))
    sides = F.array_compact(F.array(side("_n", 0, 0, 0, 1), side("_e", 0, 1, 1, 1), side("_s", 1, 1, 1, 0), side("_w", 1, 0, 0, 0)))
    borders = out.select(F.col("_me").alias("raster_id"), F.explode(sides).alias("s")).select("raster_id", *[F.col("s")[k].cast("int").alias(n) for k, n in enumerate(("r1", "c1", "r2", "c2"))])
    x0, y0, xres, yres = grid.x0, grid.y0, grid.xres, grid.yres

    def stitch(frame: pd.DataFrame) -> pd.DataFrame:
        leave: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for a, b, c, d in frame[["r1", "c1", "r2", "c2"]].sort_values(["r1", "c1", "r2", "c2"]).itertuples(index=False):
            leave.setdefault((a, b), []).append((c, d))
        rings = []
        while leave:
            start = min(leave)
            ring, at, came = [start], start, None
            while True:
                ways = leave[at]
                if came is None or len(ways) == 1:
                    to = ways.pop(0)
                else:  # at a corner where the unit touches itself, turn right: diagonal cells stay apart
                    right = (came[1], -came[0])
                    to = next((w for w in ways if (w[0] - at[0], w[1] - at[1]) == right), ways[0])
                    ways.remove(to)
                if not ways:
                    del leave[at]
                came, at = (to[0] - at[0], to[1] - at[1]), to
                ring.append(at)
                if at == start:
                    break
            rings.append(ring)
        area = [sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(r, r[1:])) / 2 for r in rings]
        corners = [[p for k, p in enumerate(r) if k in (0, len(r) - 1) or (r[k - 1][0] - p[0]) * (r[k + 1][1] - p[1]) != (r[k - 1][1] - p[1]) * (r[k + 1][0] - p[0])] for r in rings]
        text = ["(" + ", ".join(f"{x0 + c * xres:.10g} {y0 - r * yres:.10g}" for r, c in ring) + ")" for ring in corners]
        shells = [i for i, a in enumerate(area) if a > 0]
        holes = [i for i, a in enumerate(area) if a < 0]
        parts = []
        for i in shells:
            mine = [text[i]] + (([text[h] for h in holes]) if len(shells) == 1 else [text[h] for h in holes if _inside(rings[h][0], rings[i])])
            parts.append("(" + ", ".join(mine) + ")")
        return pd.DataFrame({"raster_id": [int(frame["raster_id"].iloc[0])], "area_map": [float(sum(area)) * xres * yres], "wkt": ["MULTIPOLYGON (" + ", ".join(parts) + ")"]})

    shapes = borders.groupBy("raster_id").applyInPandas(stitch, "raster_id bigint, area_map double, wkt string")
    return number_rows(shapes, ["raster_id"], "su_id").select("su_id", "raster_id", "area_map", "wkt")


def _inside(point: tuple[int, int], ring: list[tuple[int, int]]) -> bool:
    """Whether the cell below and right of a corner lies inside a ring (crossings of a ray to the left)."""
    r, c = point[0] + 0.5, point[1] + 0.5
    return sum(a[1] == b[1] and a[1] < c and min(a[0], b[0]) < r < max(a[0], b[0]) for a, b in zip(ring, ring[1:])) % 2 == 1
