"""Processing domains: the coarse grid's drainage cut into bounded, adjacent groups of cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallline.grid import GridSpec
from fallline.operators import regions, routing, stencil
from fallline.runtime import broadcast_if_small, cut


def estimate_valid_cells(coarse: DataFrame, area_ratio: float) -> tuple[int, tuple[int, int, int, int] | None]:
    """(fine cells that valid coarse cells stand for, the valid cells' first and last rows and columns)."""
    row = coarse.filter("z IS NOT NULL").agg(F.count("*").alias("n"), F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    return math.ceil(row["n"] * area_ratio), tuple(row[1:]) if row["n"] else None


def partition(cells: DataFrame, grid: GridSpec, factor: int, max_fine_cells: int) -> tuple[DataFrame, DataFrame]:
    """(r, c and domain of every valid coarse cell; a record of every domain).

    Subtrees of the coarse drainage of at most the limit become domains; small ones join the neighbour of longest
    contact that fits.  What the driver sees is the graph of domains, whose number is bounded by cells over limit
    and by outlets.
    """
    rows, cols = -(-grid.rows // factor), -(-grid.cols // factor)
    coarse_grid = GridSpec(rows, cols, grid.x0, grid.y0, grid.xres * factor, grid.yres * factor, grid.crs)
    ratio = factor * factor
    limit = max(2, max_fine_cells // ratio)
    coarse = stencil.coarse(cells, factor).select((F.col("r") * cols + F.col("c")).alias("cell_id"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "z")
    coarse = cut(coarse, "coarse")
    pieces = routing.domains(routing.flow(coarse, coarse_grid, []), limit)
    numbered = regions.number_rows(pieces.select("island", "piece").distinct(), ["island", "piece"], "domain")
    labelled = cut(coarse.join(pieces.join(numbered, ["island", "piece"]).select("cell_id", "domain"), "cell_id", "left"), "pieces")
    sizes = {r["domain"]: r["count"] for r in labelled.filter("domain IS NOT NULL").groupBy("domain").count().collect()}
    contacts = [tuple(r) for r in stencil.adjacency(labelled.withColumn("label", F.coalesce("domain", F.lit(0)))).collect()]
    merged = routing.merge_domains(sizes, contacts, limit)
    table = cells.sparkSession.createDataFrame(list(merged.items()) or [(0, 0)], "old bigint, domain bigint")
    out = labelled.withColumnRenamed("domain", "old").join(broadcast_if_small(table), "old").select("r", "c", "domain")
    records = out.groupBy("domain").agg(F.count("*").alias("coarse_cells"), F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.min("c").alias("c_min"), F.max("c").alias("c_max"))
    records = records.withColumn("fine_cells", F.col("coarse_cells") * ratio).withColumn("area_m2", F.col("coarse_cells") * coarse_grid.cell_area)
    return out, records


def domain_sizes(records: DataFrame) -> DataFrame:
    """One row: number, median and largest size of the domains, in coarse cells."""
    return records.agg(F.count("*").alias("domains"), F.median("coarse_cells").alias("median_cells"), F.max("coarse_cells").alias("largest_cells"))


def write_domains(cells: DataFrame, records: DataFrame, path: str) -> None:
    """The coarse cells' domains, a record of each domain, and their sizes."""
    for name, table in (("cells", cells), ("records", records), ("sizes", domain_sizes(records))):
        table.write.mode("overwrite").parquet(f"{path}/{name}")
