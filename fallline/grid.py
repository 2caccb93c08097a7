"""The header of an elevation grid and arithmetic on it."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class GridSpec:
    """A north-up grid: ``x0, y0`` is its upper left corner; cell (r, c) has ``cell_id = r * cols + c``."""

    rows: int
    cols: int
    x0: float = 0.0
    y0: float = 0.0
    xres: float = 30.0
    yres: float = 30.0
    crs: str = "EPSG:3035"

    def __post_init__(self):
        if self.rows < 1 or self.cols < 1 or self.xres <= 0 or self.yres <= 0:
            raise ValueError("a grid needs positive size and resolution")

    @property
    def cell_area(self) -> float:
        return self.xres * self.yres

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.x0, self.y0 - self.rows * self.yres, self.x0 + self.cols * self.xres, self.y0

    def require_square(self) -> None:
        if not math.isclose(self.xres, self.yres, rel_tol=1e-9):
            raise ValueError("cells must be square, or a target resolution must be given")

    def aligned(self, resolution: float) -> GridSpec:
        """This grid where it has that resolution, else the grid whose edges are multiples of it and cover this one."""
        if self.xres == self.yres == resolution:
            return self
        left, bottom, right, top = self.bounds
        x0, y0 = math.floor(left / resolution) * resolution, math.ceil(top / resolution) * resolution
        cols, rows = math.ceil((right - x0) / resolution - 1e-9), math.ceil((y0 - bottom) / resolution - 1e-9)
        return GridSpec(rows, cols, x0, y0, resolution, resolution, self.crs)

    def estimated_cells(self, resolution: float) -> tuple[int, bool]:
        """(cells of the aligned grid, whether this grid is that grid already)."""
        grid = self.aligned(resolution)
        return grid.rows * grid.cols, grid == self

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(source: str) -> GridSpec:
        return GridSpec(**json.loads(source))
