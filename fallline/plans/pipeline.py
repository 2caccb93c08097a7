"""From an elevation table to slope units, and the search for the best parameters."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fallline.grid import GridSpec
from fallline.operators import hierarchy, regions, routing, stencil
from fallline.plans.schedule import candidate_storage, threshold_schedule
from fallline.runtime import cut, exists, free_bytes, stage


@dataclass(frozen=True)
class Settings:
    threshold_m2: float = 250_000.0
    min_area_m2: float = 100_000.0
    cv_min: float = 0.25
    reduction_factor: int = 2
    max_iterations: int = 12
    convergence: int = 5
    max_area_m2: float | None = None
    clean_size_m2: float = 25_000.0
    clean_method: str = "basic"
    hydro_scale: float = 1000.0
    nodata: tuple[float, ...] = field(default=())

    def __post_init__(self):
        if not 1 <= self.convergence <= 10:
            raise ValueError("convergence lies between 1 and 10")

    def key(self, grid: GridSpec, source: str) -> str:
        """A hash of all that decides a result; stage tables are kept under it."""
        import hashlib

        return hashlib.sha256(json.dumps([asdict(self), grid.to_json(), source], sort_keys=True).encode()).hexdigest()[:16]


class SlopeUnits:
    """The whole run.

    With a ``work`` folder every stage is a table there, under a key of all that decides it, and a later run with the same
    settings reads what an earlier one finished, also where that was stopped; ``restart`` builds everything anew.  ``storage``
    says whether half-basins of all levels are written at once (``all``) or read level by level from the flow table, which
    holds them (``stream``); ``auto`` is the latter in a lazy run, and else decides by the space that they need and the folder has.
    """

    def __init__(self, settings: Settings | None = None, *, work: str | None = None, source: str = "", restart: bool = False, storage: str = "auto", tile: int = regions.TILE):
        if storage not in ("auto", "all", "stream"):
            raise ValueError("storage is auto, all or stream")
        self.settings, self.work, self.source, self.restart, self.storage, self.tile = settings or Settings(), work, source, restart, storage, tile

    def _stage(self, grid: GridSpec, name: str, build: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
        if self.work is None:
            return cut(build(), name)
        return stage(spark, f"{self.work}/{self.settings.key(grid, self.source)}/{name}", build, restart=self.restart)

    def prepare(self, cells: DataFrame, grid: GridSpec) -> DataFrame:
        return self._stage(grid, "cells", lambda: stencil.aspect(stencil.with_nodata(cells, self.settings.nodata), grid), cells.sparkSession)

    def candidates(self, cells: DataFrame, grid: GridSpec, *, mode: str = "lazy") -> tuple[DataFrame, DataFrame | Callable[[int], DataFrame], int]:
        """(flow table, half-basins of every level, number of levels); streamed half-basins are a function of the level."""
        s, spark = self.settings, cells.sparkSession
        levels = threshold_schedule(s.threshold_m2, grid.cell_area, s.reduction_factor, s.max_iterations)
        flow = self._stage(grid, "flow", lambda: routing.flow(cells, grid, [x.cells for x in levels], power=s.convergence, scale=s.hydro_scale, tile=self.tile), spark)
        storage = "stream" if self.storage == "auto" and mode == "lazy" else self.storage
        if candidate_storage(grid, len(levels), free_bytes(spark), storage, mode == "materialized") == "stream":
            return flow, lambda k: routing.half_basin_levels(flow, k, dense=False).select("cell_id", "hb"), len(levels)
        return flow, self._stage(grid, "half_basins", lambda: routing.half_basin_levels(flow, dense=False), spark), len(levels)

    def segment(self, cells: DataFrame, levels: DataFrame | Callable[[int], DataFrame], count: int, grid: GridSpec, *, mode: str = "lazy") -> DataFrame:
        """cell_id and clump of every valid cell, before cleaning."""
        s = self.settings
        rules = hierarchy.Rules(grid.cell_area, s.min_area_m2, s.cv_min, s.max_area_m2)
        valid = cells.filter("z IS NOT NULL")
        categories = hierarchy.units(valid, levels, rules, count, early_exit=mode == "lazy")
        return regions.clump(cells.select("cell_id", "r", "c").join(categories, "cell_id"), grid, "category", tile=self.tile)

    def run(self, cells: DataFrame, grid: GridSpec, *, mode: str = "lazy", clean: bool = True) -> DataFrame:
        """cell_id, r, c, z, aspect columns, raw_unit and unit of every cell."""
        spark = cells.sparkSession
        cells = self.prepare(cells, grid)

        def build() -> DataFrame:
            _, levels, count = self.candidates(cells, grid, mode=mode)
            return self.segment(cells, levels, count, grid, mode=mode)

        raw = self._stage(grid, "raw", build, spark)
        out = cells.join(raw.withColumnRenamed("clump", "raw_unit"), "cell_id", "left")
        if not clean or self.settings.clean_size_m2 <= 0:
            return out.withColumn("unit", F.col("raw_unit"))
        out = self._stage(grid, "raw_cells", lambda: out, spark)
        neat = regions.clean(out, grid, self.settings.clean_size_m2, method=self.settings.clean_method, label="raw_unit")
        return out.join(neat.withColumnRenamed("clump", "unit"), "cell_id", "left")


def objective(points: list[dict]) -> list[float | None]:
    """F of each point: how far its V and its I lie below the largest, each as a share of its range over all points.
    Low V and low I are good, so the best point has the largest F.  A point without V or I has none."""

    def below(name: str) -> list[float | None]:
        known = [p[name] for p in points if p[name] is not None]
        span = max(known, default=0.0) - min(known, default=0.0)
        return [None if p[name] is None else (max(known) - p[name]) / span if span > 0 else 0.0 for p in points]

    return [None if v is None or i is None else v + i for v, i in zip(below("V"), below("I"))]


def _first_best(points: list[dict]) -> dict:
    """The point of the largest F, the first of equals."""
    return max(points, key=lambda p: -1.0 if p["F"] is None else p["F"])


def five_points(cv: tuple[float, float], area: tuple[float, float]) -> list[tuple[float, float]]:
    """The corners of a box and its centre."""
    return [(c, a) for c in cv for a in area] + [(sum(cv) / 2, sum(area) / 2)]


class Optimizer:
    """Search of (cv_min, min_area): five points a round, then a smaller box around the round's best.

    Candidates are made once, and a point that lies in several rounds is evaluated once.
    """

    def __init__(self, settings: Settings | None = None, *, cv: tuple[float, float] = (0.05, 0.25), area: tuple[float, float] = (50_000.0, 200_000.0),
                 rounds: int = 8, cv_epsilon: float = 0.01, area_epsilon: float = 50_000.0):
        self.settings, self.cv, self.area = settings or Settings(), cv, area
        self.rounds, self.cv_epsilon, self.area_epsilon = rounds, cv_epsilon, area_epsilon

    def evaluate(self, cells: DataFrame, levels: DataFrame, count: int, grid: GridSpec, cv: float, area: float) -> dict:
        settings = Settings(**{**asdict(self.settings), "cv_min": cv, "min_area_m2": area})
        # Invalid cells stay, without a label: neighbours across them do not touch.
        labelled = cells.join(SlopeUnits(settings).segment(cells, levels, count, grid), "cell_id", "left")
        row = regions.segmentation_metrics(labelled, "clump").first()
        return {"cv_min": cv, "min_area_m2": area, "V": row["V"], "I": row["I"], "units": row["units"]}

    def run(self, cells: DataFrame, grid: GridSpec, *, report: str | None = None) -> dict:
        """The best point, all points from the best to the worst, and the number of rounds; with ``report`` they are
        also written there as JSON."""
        base = SlopeUnits(self.settings)
        cells = base.prepare(cells, grid)
        _, levels, count = base.candidates(cells, grid)
        points: dict[tuple[float, float], dict] = {}
        cv, area, done = self.cv, self.area, 0
        for done in range(1, self.rounds + 1):
            wanted = {(round(c, 12), round(a, 6)): (c, a) for c, a in five_points(cv, area)}
            points |= {k: self.evaluate(cells, levels, count, grid, *at) for k, at in wanted.items() if k not in points}
            for p, f in zip(points.values(), objective(list(points.values()))):
                p["F"] = f
            best = _first_best([points[k] for k in wanted])
            if cv[1] - cv[0] <= self.cv_epsilon and area[1] - area[0] <= self.area_epsilon:
                break
            cv, area = (self._around(best[k], box, whole) for k, box, whole in (("cv_min", cv, self.cv), ("min_area_m2", area, self.area)))
        found = sorted(points.values(), key=lambda p: 0.0 if p["F"] is None else -p["F"])
        out = {"best": _first_best(list(points.values())), "points": found, "rounds": done}
        if report is not None:
            cells.sparkSession.createDataFrame([(json.dumps(out),)], "value string").coalesce(1).write.mode("overwrite").text(report)
        return out

    @staticmethod
    def _around(x: float, box: tuple[float, float], whole: tuple[float, float]) -> tuple[float, float]:
        third = (box[1] - box[0]) / 3
        return max(whole[0], x - third), min(whole[1], x + third)


def write_units(units: DataFrame, grid: GridSpec, path: str, *, vector: bool = True, diagnostics: bool = True, skip_existing: bool = False) -> bool:
    """Labels, polygons, display classes and boundaries, metrics and the grid's header below ``path``; whether they were written
    (a finished earlier result stays where ``skip_existing`` is set)."""
    spark: SparkSession = units.sparkSession
    if skip_existing and exists(spark, f"{path}/grid/_SUCCESS"):
        return False
    units.write.mode("overwrite").parquet(f"{path}/units")
    stored = spark.read.parquet(f"{path}/units")
    if vector:
        regions.polygons(stored, grid, "unit").write.mode("overwrite").parquet(f"{path}/polygons")
    if diagnostics:
        shown = stencil.boundary(stored, "unit").select("cell_id", "r", "c", stencil.display_class(F.coalesce("unit", F.lit(0))).alias("display"), "is_boundary")
        shown.write.mode("overwrite").parquet(f"{path}/diagnostics")
    regions.segmentation_metrics(stored, "unit").write.mode("overwrite").json(f"{path}/metrics")
    spark.createDataFrame([(grid.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/grid")
    return True


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    """What a run was asked for, planned and did, as one JSON line."""
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
