"""How a run is laid out on the session's executors.

The unit of planning is the task: an executor's memory, less what the plan leaves to the engine, is shared by
the tasks that run on it at once, and what a task may hold decides how many cells a tile or a processing domain
has.  The coarse grid that domains come from is an integer number of cells of the fine one, so that no value
has to be interpolated for it.
"""

from __future__ import annotations

import math
import re
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

from fallline.grid import GridSpec

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
#: Coarse cells are at least so many fine cells wide.
LEAST_FACTOR = 4


def byte_size(setting: str) -> int:
    """Bytes of a Spark size setting such as ``3000m`` or ``2g``."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]?)b?\s*", setting.lower()).groups()
    return int(number) * _UNITS[unit]


@dataclass(frozen=True)
class SystemResources:
    """Executors of a session, tasks that each runs at once, and the memory of each."""

    executors: int
    cores: int
    memory_bytes: int

    def to_dict(self) -> dict:
        return asdict(self)


def detect_system_resources(spark: SparkSession) -> SystemResources:
    """What the session's settings say; in local mode the driver is the one executor."""
    setting = spark.sparkContext.getConf().get
    slots = max(1, spark.sparkContext.defaultParallelism)
    if spark.sparkContext.master.startswith("local"):
        return SystemResources(1, slots, byte_size(setting("spark.driver.memory", "1g")))
    cores = int(setting("spark.executor.cores", "1"))
    executors = int(setting("spark.executor.instances", "0")) or max(1, slots // cores)
    return SystemResources(executors, cores, byte_size(setting("spark.executor.memory", "1g")))


@dataclass(frozen=True)
class ResourcePlan:
    tasks: int  #: tasks that run at once
    task_bytes: int  #: what one of them may hold
    task_cells: int  #: fine cells of that size: the limit of a processing domain
    tile: int  #: side of a square tile of as many cells
    partitions: int  #: shuffle partitions for the whole grid
    coarse_factor: int  #: fine cells along the side of a coarse one
    coarse_resolution_m: float

    def to_dict(self) -> dict:
        return asdict(self)


def make_resource_plan(resources: SystemResources, grid: GridSpec, *, memory_limit_bytes: int | None = None, memory_fraction: float = 0.65,
                       coarse_memory_fraction: float = 0.18, bytes_per_fine_cell: int = 112, coarse_bytes_per_cell: int = 72,
                       coarse_resolution_m: float | None = None, workers: int = 0) -> ResourcePlan:
    """``memory_limit_bytes`` caps an executor's memory and ``workers`` the tasks that run at once."""
    if not 0.1 <= memory_fraction <= 0.95 or not 0.05 <= coarse_memory_fraction <= 0.5:
        raise ValueError("the memory fraction lies between 0.1 and 0.95, the coarse one between 0.05 and 0.5")
    if min(bytes_per_fine_cell, coarse_bytes_per_cell) < 1:
        raise ValueError("a cell has at least one byte")
    share = min(resources.memory_bytes, memory_limit_bytes or resources.memory_bytes) / resources.cores
    slots = resources.executors * resources.cores
    cells = grid.rows * grid.cols
    held = max(1, int(share * memory_fraction) // bytes_per_fine_cell)
    if coarse_resolution_m is None:
        room = max(1, int(share * coarse_memory_fraction) // coarse_bytes_per_cell)
        factor = max(LEAST_FACTOR, math.ceil(math.sqrt(cells / room)))
        while -(-grid.rows // factor) * -(-grid.cols // factor) > room:
            factor += 1
    else:
        factor = max(1, round(coarse_resolution_m / grid.xres))
    return ResourcePlan(min(slots, workers) if workers > 0 else slots, int(share * memory_fraction), held, math.isqrt(held),
                        max(slots, -(-cells // held)), factor, factor * grid.xres)


def processing_mode(grid: GridSpec, resolution: float, valid_cells: int, plan: ResourcePlan) -> str:
    """``direct`` (the grid is the target and one task can hold it), ``single`` (one can hold its valid cells) or
    ``hydrological`` (its drainage is cut into domains)."""
    target, same = grid.estimated_cells(resolution)
    if min(target, valid_cells) > plan.task_cells:
        return "hydrological"
    return "direct" if same and target <= plan.task_cells else "single"
