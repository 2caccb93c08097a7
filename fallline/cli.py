"""Command line: segment an elevation table, ASCII grid, GeoTIFF or mosaic of GeoTIFFs."""

from __future__ import annotations

import argparse
import json
import time
from dataclasses import asdict

from fallline.plans.pipeline import Settings, SlopeUnits, write_report, write_units
from fallline.plans.resources import detect_system_resources, make_resource_plan, processing_mode
from fallline.plans.schedule import estimate_work_storage

_DEFAULT = Settings()
# Options of the public command line and their defaults.
NUMBERS = {
    "--threshold-m2": _DEFAULT.threshold_m2, "--min-area-m2": _DEFAULT.min_area_m2, "--cv-min": _DEFAULT.cv_min, "--clean-size-m2": _DEFAULT.clean_size_m2,
    "--memory-fraction": 0.65, "--coarse-memory-fraction": 0.18, "--max-area-m2": None, "--memory-limit-gb": None, "--coarse-resolution-m": None, "--fine-resolution-m": None,
}
WHOLE = {"--reduction-factor": _DEFAULT.reduction_factor, "--max-iterations": _DEFAULT.max_iterations, "--convergence": _DEFAULT.convergence, "--workers": 0,
         "--bytes-per-fine-cell": 112, "--coarse-bytes-per-cell": 72}
#: Options whose subject Spark decides itself: threads of a kernel, memory before spilling, blocks of cells, time between checkpoints.
WITHOUT_EFFECT = {"--numba-threads": 0, "--scratch-ram-fraction": 0.5, "--mfd-block-cells": 1_000_000, "--checkpoint-minutes": 15.0}


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fallline", description=__doc__)
    p.add_argument("dem", help="ASCII grid (.asc), GeoTIFF (.tif; a folder or pattern of them is a mosaic), or folder with cells and grid")
    p.add_argument("output_dir")
    for options, kind in ((NUMBERS, float), (WHOLE, int)):
        for name, default in options.items():
            p.add_argument(name, type=kind, default=default)
    for name, default in WITHOUT_EFFECT.items():
        p.add_argument(name, type=type(default), default=default, help="accepted for compatibility; Spark decides this")
    p.add_argument("--target-crs", help="reference system of the result; must be the elevations' own, nothing is reprojected")
    p.add_argument("--hierarchy-mode", choices=("lazy", "materialized"), default="lazy")
    p.add_argument("--candidate-cache-mode", choices=("auto", "all", "stream"), default="auto")
    p.add_argument("--clean-method", choices=("basic", "quick"), default=_DEFAULT.clean_method)
    p.add_argument("--nodata", type=float, nargs="+", action="extend", default=[])
    p.add_argument("--geopackage", help="also write the polygons to this file on the driver")
    for flag, what in (("--plan-only", "write the plan and stop"), ("--no-vector", "no polygons"), ("--no-diagnostics", "no display classes and boundaries"),
                       ("--no-skip-existing", "write again what an earlier run finished"), ("--no-checkpoint", "keep no stages"), ("--restart", "build stages anew"), ("--quiet", "")):
        p.add_argument(flag, action="store_true", help=what)
    return p


def read_elevations(spark, path: str):
    """(cell table, grid) of any of the inputs."""
    from fallline.sources.ascii_grid import read_ascii_grid, read_cells
    from fallline.sources.geotiff import read_geotiff

    if path.endswith(".asc"):
        return read_ascii_grid(spark, path)
    return read_geotiff(spark, path) if path.lower().endswith((".tif", ".tiff")) else read_cells(spark, path)


def main(argv: list[str] | None = None, spark=None) -> int:
    a = build_parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from fallline.operators.stencil import resample
    from fallline.plans.domains import partition, write_domains
    from fallline.runtime import cut
    from fallline.sources.geopackage import write_geopackage

    begun = time.time()
    spark = spark or SparkSession.builder.appName("fallline").getOrCreate()
    cells, grid = read_elevations(spark, a.dem)
    if a.target_crs and a.target_crs != grid.crs:
        raise SystemExit(f"the elevations are in {grid.crs}; reproject them to {a.target_crs} first")
    if not a.fine_resolution_m:
        grid.require_square()
    target = grid.aligned(a.fine_resolution_m) if a.fine_resolution_m else grid
    plan = make_resource_plan(detect_system_resources(spark), target, memory_limit_bytes=int(a.memory_limit_gb * 1024**3) if a.memory_limit_gb else None, memory_fraction=a.memory_fraction,
                              coarse_memory_fraction=a.coarse_memory_fraction, bytes_per_fine_cell=a.bytes_per_fine_cell, coarse_bytes_per_cell=a.coarse_bytes_per_cell,
                              coarse_resolution_m=a.coarse_resolution_m, workers=a.workers)
    settings = Settings(a.threshold_m2, a.min_area_m2, a.cv_min, a.reduction_factor, a.max_iterations, a.convergence, a.max_area_m2, a.clean_size_m2, a.clean_method, nodata=tuple(a.nodata))
    mode = processing_mode(grid, target.xres, grid.rows * grid.cols, plan)
    report = {"settings": asdict(settings), "plan": plan.to_dict(), "mode": mode, "grid": json.loads(target.to_json()),
              "storage": vars(estimate_work_storage(target, threshold_m2=a.threshold_m2, reduction_factor=a.reduction_factor, max_iterations=a.max_iterations))}
    if not a.plan_only:
        if target != grid:
            cells = cut(resample(cells, grid, target), "resampled")
        if mode == "hydrological":  # too much for one task: the domains' products say how the grid would be shared out
            write_domains(*partition(cells, target, plan.coarse_factor, plan.task_cells), f"{a.output_dir}/domains")
        run = SlopeUnits(settings, work=None if a.no_checkpoint else f"{a.output_dir}/stages", source=a.dem, restart=a.restart, storage=a.candidate_cache_mode, tile=max(16, min(1024, plan.tile)))
        units = run.run(cells, target, mode=a.hierarchy_mode, clean=a.clean_size_m2 > 0)
        done = f"{a.output_dir}/{settings.key(target, a.dem)}"
        report |= {"run": done, "written": write_units(units, target, done, vector=not a.no_vector, diagnostics=not a.no_diagnostics, skip_existing=not a.no_skip_existing and not a.restart)}
        if a.geopackage and not a.no_vector:
            report["features"] = write_geopackage(spark.read.parquet(f"{done}/polygons"), target, a.geopackage)
    report["seconds"] = round(time.time() - begun, 3)
    write_report(spark, f"{a.output_dir}/run_report", report)
    if not a.quiet:
        print(json.dumps(report))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
