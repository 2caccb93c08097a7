"""ASCII grids (the six-line header, then rows of numbers) as a Spark data source and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fallline.grid import GridSpec

HEADER = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")


def read_header(spark: SparkSession, path: str) -> tuple[GridSpec, float | None]:
    """(grid, nodata value) of an ASCII grid."""
    found: dict[str, str] = {}
    for row in spark.read.text(path).limit(len(HEADER)).collect():
        name, *value = row["value"].split()
        if name.lower() in HEADER:
            found[name.lower()] = value[0]
    rows, cols, size = int(found["nrows"]), int(found["ncols"]), float(found["cellsize"])
    grid = GridSpec(rows, cols, float(found["xllcorner"]), float(found["yllcorner"]) + rows * size, size, size)
    return grid, float(found["nodata_value"]) if "nodata_value" in found else None


def read_ascii_grid(spark: SparkSession, path: str) -> tuple[DataFrame, GridSpec]:
    """(cell table, grid).  Lines are read in parallel; a line's number comes from its place in the file."""
    grid, nodata = read_header(spark, path)
    lines = spark.read.text(path, wholetext=False)
    numbered = lines.rdd.zipWithIndex().map(lambda x: (x[1], x[0][0])).toDF("line bigint, value string")  # line numbers need the file's order
    words = F.split(F.trim("value"), r"\s+")
    data = numbered.filter(~F.lower(F.element_at(words, 1)).isin(list(HEADER)) & (F.trim("value") != ""))
    first = numbered.filter(F.lower(F.element_at(words, 1)).isin(list(HEADER))).agg(F.count("*").alias("h")).first()["h"]
    cells = data.select((F.col("line") - first).cast("int").alias("r"), F.posexplode(words).alias("c", "v"))
    z = F.col("v").cast("double")
    z = F.when(z != nodata, z) if nodata is not None else z
    return cells.select((F.col("r").cast("long") * grid.cols + F.col("c")).alias("cell_id"), "r", "c", z.alias("z")), grid


def write_ascii_grid(cells: DataFrame, grid: GridSpec, path: str, value: str, nodata: float = -9999) -> None:
    """Write a column of a cell table as one text file in row order (a raster of one value is one file)."""
    spark = cells.sparkSession
    head = [(-1 - k, t) for k, t in enumerate(reversed([f"ncols {grid.cols}", f"nrows {grid.rows}", f"xllcorner {grid.x0}", f"yllcorner {grid.y0 - grid.rows * grid.yres}", f"cellsize {grid.xres}", f"NODATA_value {nodata:g}"]))]
    full = spark.range(grid.rows * grid.cols).select(F.col("id").alias("cell_id")).join(cells.select("cell_id", F.col(value).alias("v")), "cell_id", "left")
    row = full.groupBy(F.expr(f"cell_id div {grid.cols}").alias("r")).agg(F.array_sort(F.collect_list(F.struct("cell_id", F.coalesce(F.col("v").cast("string"), F.lit(f"{nodata:g}")).alias("t")))).alias("x"))
    lines = row.select("r", F.concat_ws(" ", F.transform("x", lambda s: s["t"])).alias("value"))
    lines = lines.unionByName(spark.createDataFrame(head, "r bigint, value string"))
    lines.repartitionByRange(1, "r").sortWithinPartitions("r").select("value").write.mode("overwrite").text(path)


def read_cells(spark: SparkSession, path: str) -> tuple[DataFrame, GridSpec]:
    """A cell table in Parquet with its grid's header beside it (``<path>/cells`` and ``<path>/grid``)."""
    return spark.read.parquet(f"{path}/cells"), GridSpec.from_json(spark.read.text(f"{path}/grid").first()["value"])


def write_cells(cells: DataFrame, grid: GridSpec, path: str) -> None:
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    cells.sparkSession.createDataFrame([(grid.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/grid")
