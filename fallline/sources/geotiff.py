"""GeoTIFF elevation files as cell tables, without any imaging library.

A file is read by one task, and the files of a mosaic by as many; its strips or tiles are opened one after the other.
Read are classic and Big TIFF, integers and floats of one band, stored plainly or deflated, with either predictor; the
place on the ground comes from pixel scale and tie point, the reference system from the GeoKeys.  Anything else is
refused with its name, never read wrongly.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fallline.grid import GridSpec
from fallline.runtime import ship

# Tags of the TIFF and GeoTIFF formats that are read here.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, FORMAT, SCALE, TIE, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
# GeoKeys of a projected and of a geographic reference system, and of its linear unit (9001 is the metre).
PROJECTED, GEOGRAPHIC, LINEAR_UNIT = 3072, 2048, 3076
# Numbers and struct codes of the formats' value types.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


@dataclass
class Header:
    tags: dict[int, tuple]
    order: str

    def one(self, tag: int, default=None):
        got = self.tags.get(tag)
        if got is None:
            if default is None:
                raise ValueError(f"the file lacks TIFF tag {tag}")
            return default
        return got[0]

    @property
    def nodata(self) -> float | None:
        got = self.tags.get(NODATA)
        return float(got[0].split(b"\0")[0].decode().strip() or "nan") if got else None

    def geo_key(self, key: int) -> int | None:
        keys = self.tags.get(GEO_KEYS, ())
        found = [keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] == key and keys[i + 1] == 0]
        return found[0] if found else None

    def grid(self) -> GridSpec:
        """The grid; a reference system that is not projected in metres is refused, since areas would mean nothing."""
        if self.geo_key(PROJECTED) is None:
            raise ValueError("elevations must be in a projected reference system in metres")
        if self.geo_key(LINEAR_UNIT) not in (None, 9001):
            raise ValueError("the reference system's unit must be the metre")
        xres, yres, *_ = self.tags[SCALE]
        i, j, _, x, y, _ = self.tags[TIE][:6]
        return GridSpec(self.one(HEIGHT), self.one(WIDTH), x - i * xres, y + j * yres, xres, yres, f"EPSG:{self.geo_key(PROJECTED)}")


def parse_header(data: bytes) -> Header:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] not in (42, 43):
        raise ValueError("not a TIFF file")
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    count = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
    at += 8 if big else 2
    tags = {}
    for k in range(count):
        entry = at + k * (20 if big else 12)
        tag, kind, n = struct.unpack_from(order + ("HHQ" if big else "HHI"), data, entry)
        if kind not in TYPES:
            continue
        code = f"{n}s" if kind == 2 else TYPES[kind] * n
        size = struct.calcsize(order + code)
        where = entry + (12 if big else 8)
        if size > (8 if big else 4):
            where = struct.unpack_from(order + ("Q" if big else "I"), data, where)[0]
        tags[tag] = struct.unpack_from(order + code, data, where)
    return Header(tags, order)


def pieces(data: bytes, head: Header) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, column, values) of each strip or tile, cut to the raster."""
    if head.one(SAMPLES, 1) != 1:
        raise ValueError("only rasters of one band are read")
    if head.one(COMPRESSION, 1) not in (1, 8, 32946):
        raise ValueError(f"TIFF compression {head.one(COMPRESSION)} is not read: store plainly or deflate")
    kind = {1: "u", 2: "i", 3: "f"}[head.one(FORMAT, 1)] + str(head.one(BITS) // 8)
    rows, cols, predictor = head.one(HEIGHT), head.one(WIDTH), head.one(PREDICTOR, 1)
    if TILE_OFFSETS in head.tags:
        high, wide, offsets, sizes = head.one(TILE_HEIGHT), head.one(TILE_WIDTH), head.tags[TILE_OFFSETS], head.tags[TILE_BYTES]
    else:
        high, wide, offsets, sizes = min(head.one(STRIP_ROWS, rows), rows), cols, head.tags[STRIP_OFFSETS], head.tags[STRIP_BYTES]
    across = -(-cols // wide)
    for k, (offset, size) in enumerate(zip(offsets, sizes)):
        r, c = k // across * high, k % across * wide
        raw = data[offset : offset + size]
        if head.one(COMPRESSION, 1) != 1:
            raw = zlib.decompress(raw)
        here = high if TILE_OFFSETS in head.tags else min(high, rows - r)
        if predictor == 3:  # bytes of equal weight stand together, each as the difference from the one before
            planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(here, -1), axis=1, dtype=np.uint8).reshape(here, -1, wide)
            values = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(">" + kind)[:, :, 0]
        else:
            values = np.frombuffer(raw, head.order + kind)[: here * wide].reshape(here, wide)
            if predictor == 2:
                values = np.cumsum(values, axis=1, dtype=values.dtype.newbyteorder("="))
        yield r, c, values[: rows - r, : cols - c]


def read_geotiff(spark: SparkSession, path: str) -> tuple[DataFrame, GridSpec]:
    """(cell table, grid) of a file, or of the files of a mosaic (a folder or pattern): they must share resolution,
    alignment and reference system; where files overlap the value of the last path counts."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path)

    def heads(batches):
        for frame in batches:
            out = []
            for name, data in zip(frame["path"], frame["content"]):
                head = parse_header(data)
                out.append((name, head.grid().to_json()))
            yield pd.DataFrame(out, columns=["path", "grid"])

    grids = {r["path"]: GridSpec.from_json(r["grid"]) for r in files.select("path", "content").mapInPandas(heads, "path string, grid string").collect()}  # one row a file
    if not grids:
        raise FileNotFoundError(path)
    first = next(iter(grids.values()))
    for g in grids.values():
        offset = (g.x0 - first.x0) / first.xres, (g.y0 - first.y0) / first.yres
        if (g.xres, g.yres, g.crs) != (first.xres, first.yres, first.crs) or any(abs(o - round(o)) > 1e-6 for o in offset):
            raise ValueError("the files of a mosaic must share resolution, alignment and reference system")
    x0, y0 = min(g.x0 for g in grids.values()), max(g.y0 for g in grids.values())
    right, bottom = max(g.bounds[2] for g in grids.values()), min(g.bounds[1] for g in grids.values())
    whole = GridSpec(round((y0 - bottom) / first.yres), round((right - x0) / first.xres), x0, y0, first.xres, first.yres, first.crs)
    cols = whole.cols

    def cells(batches):
        for frame in batches:
            for name, data in zip(frame["path"], frame["content"]):
                head = parse_header(data)
                g, nodata = head.grid(), head.nodata
                top, left = round((y0 - g.y0) / g.yres), round((g.x0 - x0) / g.xres)
                for r0, c0, values in pieces(data, head):
                    r, c = (a.ravel() for a in np.indices(values.shape))
                    r, c, z = r + r0 + top, c + c0 + left, values.ravel().astype(np.float64)
                    bad = ~np.isfinite(z) | (z == nodata if nodata is not None else False)
                    yield pd.DataFrame({"cell_id": r.astype(np.int64) * cols + c, "r": r.astype(np.int32), "c": c.astype(np.int32), "z": pd.array(np.where(bad, np.nan, z)), "path": name})

    out = files.select("path", "content").mapInPandas(cells, "cell_id bigint, r int, c int, z double, path string")
    out = out.withColumn("z", F.when(~F.isnan("z"), F.col("z")))
    if len(grids) > 1:
        out = out.groupBy("cell_id", "r", "c").agg(F.max_by("z", F.when(F.col("z").isNotNull(), F.col("path"))).alias("z"))
    return out.select("cell_id", "r", "c", "z"), whole
