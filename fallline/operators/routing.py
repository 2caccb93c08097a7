"""Flow over an elevation grid: routing, accumulation, streams and half-basins.

Routing pops cells in the order of a priority queue, which no set operation can express; but 8-connected
islands of valid cells never exchange flow, so every island is a group of its own and islands run in
parallel.  One kernel does all that needs the order (or a walk along the flow tree); what only needs ranks
is also given as set operations (:func:`mfd_weights`, :func:`adjusted_receiver`, :func:`stream_tests`).
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fallline.grid import GridSpec
from fallline.operators import regions as _regions
from fallline.operators import stencil
from fallline.runtime import ship

# The order in which routing looks at neighbours (S, N, W, E, NE, SW, SE, NW), and for each of them the
# place of the cardinal neighbour that lies east or west of it, and of the one that lies north or south of it.
LOOK = ((1, 0), (-1, 0), (0, -1), (0, 1), (-1, 1), (1, -1), (1, 1), (-1, -1))
EAST_WEST = (0, 1, 2, 3, 1, 0, 0, 1)
NORTH_SOUTH = (0, 1, 2, 3, 3, 2, 3, 2)
# Direction codes NE 1, N 2, NW 3, W 4, SW 5, S 6, SE 7, E 8, by (dr, dc).
DIRECTION = {(-1, 1): 1, (-1, 0): 2, (-1, -1): 3, (0, -1): 4, (1, -1): 5, (1, 0): 6, (1, 1): 7, (0, 1): 8}

SCALE = 1000.0
#: Cells whose neighbours are looked up, or that are packed, at once; cells that travel as one row; rows that are sent at once.
CHUNK, PACK, UNPACKED = 262_144, 16_384, 65_536
FLOW_SCHEMA = (
    "cell_id bigint, island bigint, rank bigint, astar_receiver bigint, receiver bigint, accumulation double, static_ok boolean, "
    "up_max float, outlet bigint, streams array<boolean>, roots array<bigint>, lefts array<boolean>"
)

# Cells on the way to an island's task, and its results, by block; None is the type of places in the island's box.
PACKED = {"cell_id": np.int64, "hydro_z": np.int32, "is_edge": np.bool_}
PACKED_SCHEMA = "island bigint, " + ", ".join(f"{k} binary" for k in PACKED)
FLOW_BLOCKS = {
    "cell_id": None, "rank": None, "astar_receiver": None, "receiver": None, "accumulation": np.float64, "static_ok": np.bool_, "up_max": np.float32,
    "outlet": None, "streams": np.bool_, "roots": None, "lefts": np.bool_,
}
FLOW_BLOCKS_SCHEMA = "island bigint, box binary, " + ", ".join(f"{k} binary" for k in FLOW_BLOCKS)


class Island:
    """One island in a box padded by invalid cells, so that neighbours are plain index offsets.

    Only :meth:`route` goes cell by cell; what follows takes all cells of a wave, or of the box, at once.
    """

    def __init__(self, cell_id: np.ndarray, z: np.ndarray, edge: np.ndarray, cols: int, xres: float, yres: float):
        r, c = cell_id // cols, cell_id % cols
        self.width = w = int(c.max() - c.min()) + 3
        self.cols, self.r0, self.c0 = cols, int(r.min()) - 1, int(c.min()) - 1
        self.size = size = (int(r.max() - r.min()) + 3) * w
        self.kind = np.dtype(np.int32 if size < 2**31 else np.int64)
        self.at = ((r - self.r0) * w + (c - self.c0)).astype(self.kind)  # row by row, as cell_id is sorted
        self.z, self.valid, self.edge = np.zeros(size, np.int32), np.zeros(size, bool), np.zeros(size, bool)
        self.z[self.at], self.valid[self.at], self.edge[self.at] = z, True, edge
        self.step = [dr * w + dc for dr, dc in LOOK]
        # The neighbours row by row: offsets and direction codes.
        self.offsets = np.array([dr * w + dc for dr, dc in stencil.AROUND], np.int64)
        self.codes = np.array([DIRECTION[d] for d in stencil.AROUND], np.int8)
        diagonal = float(np.hypot(xres, yres)) * SCALE
        self.xd, self.yd = xres * SCALE, yres * SCALE
        self.length = [self.yd, self.yd, self.xd, self.xd] + [diagonal] * 4

    def beside(self, values: np.ndarray, step: int = 0) -> np.ndarray:
        """A view of the values ``step`` places after each cell of the box that has all its neighbours there."""
        return values[self.width + 1 + step : self.size - self.width - 1 + step]

    def named(self, p: np.ndarray) -> np.ndarray:
        """Cells of places in the box."""
        p = p.astype(np.int64)
        return (p // self.width + self.r0) * self.cols + p % self.width + self.c0

    def _plain(self, values: np.ndarray) -> array:
        """Values for loops over cells: plain arrays give Python's numbers faster than numpy's do."""
        return array("i" if self.kind == np.int32 else "q", values.astype(self.kind).tobytes())

    def route(self) -> None:
        """Ranks and receivers: edge cells first in the queue, lowest first, earlier pushed first among equals.

        Edge cells wait sorted beside the heap, and come before equally high cells of it.
        """
        edges = self.at[self.edge[self.at]]
        edges = edges[np.argsort(self.z[edges], kind="stable")]
        heights, first, n_edges = self._plain(self.z[edges]), self._plain(edges), len(edges)
        z, receiver, order = self._plain(self.z), self._plain(np.full(self.size, -1, self.kind)), self._plain(self.at[:0])
        # 0: not there or ranked, 1: not yet reached, 2: in the heap, 3: an edge cell without rank.
        state = bytearray(np.where(self.edge, np.uint8(3), self.valid.view(np.uint8)).tobytes())
        pushed = self._plain(self.at[:0])  # by age
        s, n, w, e = self.step[:4]
        diagonals = [(self.step[k], self.step[EAST_WEST[k]], self.step[NORTH_SOUTH[k]]) for k in range(4, 8)]
        far, xd, yd = self.length[4], self.xd, self.yd
        heap: list[int] = []  # height and age as one number
        push, pop = heapq.heappush, heapq.heappop
        at = 0
        following = heights[0] << 32 if n_edges else None
        while heap or following is not None:
            if heap and (following is None or heap[0] < following):
                key = pop(heap)
                p, height = pushed[key & 0xFFFFFFFF], key >> 32
            else:
                p, height = first[at], heights[at]
                at += 1
                following = heights[at] << 32 if at < n_edges else None
            for q in (p + s, p + n, p + w, p + e):
                k = state[q]
                if k == 1:
                    receiver[q], state[q] = p, 2
                    push(heap, z[q] << 32 | len(pushed))
                    pushed.append(q)
                elif k == 3 and z[q] > height:
                    receiver[q] = p
            for step, ew, ns in diagonals:
                q = p + step
                k = state[q]
                if k != 1 and k != 3:
                    continue
                high = z[q]
                rise = high - height
                if rise > 0:
                    slope = rise / far
                    if state[p + ew] and high > (x := z[p + ew]) and slope < (high - x) / xd:
                        continue
                    if state[p + ns] and high > (x := z[p + ns]) and slope < (high - x) / yd:
                        continue
                if k == 1:
                    receiver[q], state[q] = p, 2
                    push(heap, high << 32 | len(pushed))
                    pushed.append(q)
                elif rise > 0:
                    receiver[q] = p
            state[p] = 0
            order.append(p)
        self.order = np.frombuffer(order, self.kind).copy()
        self.astar = np.frombuffer(receiver, self.kind).copy()
        self.rank = np.full(self.size, -1, self.kind)
        self.rank[self.order] = np.arange(len(order), dtype=self.kind)

    def _weights(self, k: int, power: int) -> tuple[np.ndarray, np.ndarray]:
        """(whether cells pass flow to their k-th neighbour by slope, the weight of that)."""
        step, z, rank = self.step[k], self.z, self.rank
        p, q = self.beside(z), self.beside(z, step)
        passes = self.beside(self.valid) & ~self.beside(self.edge) & self.beside(self.valid, step) & (self.beside(rank, step) < self.beside(rank)) & (p >= q)
        return passes, self._power(p, q, k, power)

    def _power(self, p: np.ndarray, q: np.ndarray, k: int, power: int) -> np.ndarray:
        fall = p.astype(np.float64) - q
        fall[fall == 0] = 0.5
        return (fall / self.length[k]) ** power

    def accumulate(self, power: int) -> None:
        """Multiple-flow-direction accumulation: every cell passes its flow to lower neighbours by slope.

        A wave holds the cells whose givers all have their flow; a cell adds what it is given in the order of falling ranks.
        """
        size, astar, rank = self.size, self.astar, self.rank
        total, most, found = np.zeros(size), np.full(size, -np.inf), np.zeros(size, bool)
        gives = np.zeros(size, np.uint8)  # a bit for each neighbour
        place = self.beside(np.arange(size, dtype=self.kind))
        for k, step in enumerate(self.step):
            passes, weight = self._weights(k, power)
            self.beside(total)[:] += np.where(passes, weight, 0.0)
            np.maximum(self.beside(most), np.where(passes, weight, -np.inf), out=self.beside(most))
            self.beside(found)[:] |= passes & (self.beside(astar) == place + step)
            self.beside(gives)[:] |= passes.view(np.uint8) << np.uint8(k)
        # The routed receiver takes part, also where it is higher.
        lost = np.flatnonzero(self.valid & ~self.edge & ~found & (astar >= 0))
        most[lost] = np.where(gives[lost] > 0, most[lost], 1.0)
        total[lost] += most[lost]
        upward = np.zeros(size, bool)
        upward[lost] = True
        for k, step in enumerate(self.step):
            mine = lost[astar[lost] == lost + step]
            gives[mine] |= np.uint8(1 << k)
        waiting = np.zeros(size, np.int8)
        for k, step in enumerate(self.step):
            self.beside(waiting, step)[:] += ((self.beside(gives) >> np.uint8(k)) & np.uint8(1)).view(np.int8)
        self.flow = flow = np.zeros(size)
        flow[self.order] = 1.0
        wave = self.at[waiting[self.at] == 0].astype(np.int64)
        while len(wave):
            for a in range(0, len(wave), CHUNK):
                some = wave[a : a + CHUNK]
                given, ranks = np.zeros((8, len(some))), np.full((8, len(some)), -1, self.kind)
                for k, step in enumerate(self.step):
                    here = np.flatnonzero((gives[some - step] >> np.uint8(k)) & np.uint8(1))
                    if not len(here):
                        continue
                    q = some[here]
                    p = q - step
                    weight = self._power(self.z[p], self.z[q], k, power)
                    up = upward[p] & (astar[p] == q)
                    weight[up] = most[p[up]]
                    given[k, here] = flow[p] * (weight / total[p])
                    ranks[k, here] = rank[p]
                given = np.take_along_axis(given, np.argsort(-ranks, axis=0, kind="stable"), axis=0)
                got = flow[some]
                for one in given:
                    got += one
                flow[some] = got
            following = []
            for k, step in enumerate(self.step):
                q = wave[(gives[wave] >> np.uint8(k)) & np.uint8(1) > 0] + step
                waiting[q] -= 1
                following.append(q[waiting[q] == 0])
            wave = np.concatenate(following)

    def receive(self) -> None:
        """The receiver of greatest accumulation among lower ranks; stream tests that no threshold changes."""
        z, rank, valid, flow, kind = self.z, self.rank, self.valid, self.flow, self.kind
        size = self.size
        self.receiver, self.ok, up = self.astar.copy(), np.zeros(size, bool), np.zeros(size)
        best = np.where(self.astar >= 0, flow[self.astar], -1.0)
        inner = valid & ~self.edge
        place = self.beside(np.arange(size, dtype=kind))
        for step in self.step:
            there = self.beside(valid) & self.beside(valid, step)
            lower = there & (self.beside(rank, step) < self.beside(rank))
            self.beside(self.ok)[:] |= lower & (self.beside(z, step) != self.beside(z))
            better = lower & self.beside(inner) & (self.beside(flow, step) > self.beside(best))
            self.beside(self.receiver)[better] = (place + kind.type(step))[better]
            self.beside(best)[better] = self.beside(flow, step)[better]
            higher = there & (self.beside(z, step) > self.beside(z))
            np.maximum(self.beside(up), np.where(higher, self.beside(flow, step) + 0.5, 0.0), out=self.beside(up))
        self.ok &= inner
        self.up = up.astype(np.float32)
        # The donor of greatest flow, the first row by row among equals; -1 without donors.
        self.largest, most = np.full(size, -1, kind), np.full(size, -1.0)
        for step in self.offsets.tolist():
            larger = (self.beside(self.receiver, step) == place) & (self.beside(flow, step) > self.beside(most))
            self.beside(self.largest)[larger] = (place + kind.type(step))[larger]
            self.beside(most)[larger] = self.beside(flow, step)[larger]
        down = self.receiver[self.order]
        self.down_way = np.zeros(size, np.int8)
        self.down_way[self.order] = np.where(down >= 0, self._way(down.astype(np.int64) - self.order), 0)
        self.outlet = self._ends(self.receiver < 0)

    def _way(self, offset: np.ndarray) -> np.ndarray:
        return self.codes[np.minimum(np.searchsorted(self.offsets, offset), 7)]

    def _ends(self, end: np.ndarray) -> np.ndarray:
        """For every place the first one down the receivers, itself included, that is an ``end``."""
        out = np.where(end, np.arange(self.size, dtype=self.kind), self.receiver)
        while True:
            further = out[out]
            if np.array_equal(further, out):
                return out
            out = further

    def streams(self, threshold: int) -> np.ndarray:
        """Whether a stream runs through each place.

        Cells are tested from the highest rank down; one may begin a stream where none runs beside it as far as higher ranks
        have made streams.  A stream is followed down at once, so a cell keeps the highest rank that made it one.
        """
        may = self.at[self.ok[self.at] & (self.flow[self.at] >= threshold) & (self.up[self.at].astype(np.float64) < threshold)]
        may = may[np.argsort(-self.rank[may], kind="stable")]
        if not hasattr(self, "_walk"):
            self._walk = self._plain(self.rank), self._plain(self.receiver)
        rank, receiver = self._walk
        made = self._plain(np.full(self.size, -1, self.kind))
        a, b, c, d, e, f, g, h = self.step
        for p in may.tolist():
            if made[p] >= 0:
                continue
            k = rank[p]
            if made[p + a] > k or made[p + b] > k or made[p + c] > k or made[p + d] > k or made[p + e] > k or made[p + f] > k or made[p + g] > k or made[p + h] > k:
                continue
            made[p] = k
            down = receiver[p]
            while down >= 0:
                before = made[down]
                if before < k:
                    made[down] = k
                if before >= 0:
                    break
                k, down = rank[down], receiver[down]
        return np.frombuffer(made, self.kind) >= 0

    def half_basins(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(root cell of the half-basin pair, whether on its left) of every place; -1 without a stream.

        A cell on a main path hands its pair up to its main donor, gives side donors (and all that drains to them) a
        side, and starts a pair at each stream donor of a junction.
        """
        size, receiver, kind = self.size, self.receiver, self.kind
        root, left = np.full(size, -1, kind), np.zeros(size, bool)
        run = np.flatnonzero(stream)
        donors, main = np.zeros(size, np.int8), self.largest.copy()
        for step in self.offsets[::-1].tolist():  # the first stream donor stays
            q = run + step
            up = stream[q] & (receiver[q] == run)
            donors[run] += up
            main[run[up]] = q[up]
        down = receiver[run]
        begins = np.zeros(size, bool)
        begins[run] = (down < 0) | (donors[down] > 1)
        root[run] = np.where(begins[run], run, down)
        while True:
            further = root[root[run]]
            if np.array_equal(further, root[run]):
                break
            root[run] = further
        # Paths go on above the heads of streams, up to the ridge.
        path = stream.copy()
        ends = run[donors[run] == 0]
        while len(ends):
            above = main[ends]
            ends, above = ends[above >= 0], above[above >= 0].astype(np.int64)
            root[above], path[above] = root[ends], True
            ends = above
        p = np.flatnonzero(path)
        p = p[main[p] >= 0]  # the ridge cell of a path is on the right
        main_way, lefts, rights = self._way(main[p].astype(np.int64) - p), np.zeros(len(p), np.int8), np.zeros(len(p), np.int8)
        down_way = np.where(receiver[p] >= 0, self.down_way[p], (main_way + 3) % 8 + 1)
        settled = path | (receiver < 0)
        for step, code in zip(self.offsets.tolist(), self.codes.tolist()):
            q = p + step
            side = (receiver[q] == p) & (q != main[p]) & ~stream[q]
            turn = (code - down_way) % 8 < (main_way - down_way) % 8
            root[q[side]], left[q[side]], settled[q[side]] = root[p[side]], turn[side], True
            lefts += side & turn
            rights += side & ~turn
        left[p] = np.where(donors[p] > 1, lefts >= rights, lefts > rights)
        end = self._ends(settled)
        return root[end], left[end]


def _blocks(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of the values between every two cuts."""
    ends = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells as rows of PACKED_SCHEMA, each up to PACK cells of an island."""
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        island = table["island"].to_numpy()
        order = np.argsort(island, kind="stable")
        island = island[order]
        first = np.flatnonzero(np.diff(island, prepend=island[0] - 1))
        at = np.arange(len(island))
        cuts = np.flatnonzero((at - np.repeat(first, np.diff(first, append=len(at)))) % PACK == 0)
        columns = [_blocks(table[k].to_numpy()[order].astype(kind), np.append(cuts, len(at))) for k, kind in PACKED.items()]
        return pa.RecordBatch.from_arrays([pa.array(island[cuts]), *columns], names=["island", *PACKED])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= CHUNK:
            yield out()
            held.clear()
    if held:
        yield out()


def _island_rows(batches: Iterator[pa.RecordBatch], cols: int, xres: float, yres: float, thresholds: list[int], power: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the flow table of one island (see FLOW_BLOCKS) from the blocks of its cells; cells are places in its box."""
    table = pa.Table.from_batches(batches)
    cell, z, edge = (np.frombuffer(b"".join(table[k].to_pylist()), kind) for k, kind in PACKED.items())
    order = np.argsort(cell, kind="stable")
    island = table["island"][0].as_py()
    one = Island(cell[order], z[order], edge[order], cols, xres, yres)
    del table, cell, z, edge, order
    one.route()
    one.accumulate(power)
    one.receive()
    at, levels = one.at, []
    for threshold in thresholds:
        stream = one.streams(threshold)
        root, left = one.half_basins(stream)
        levels.append((stream[at], root[at], left[at]))
    box = np.array([one.width, one.r0, one.c0, one.kind.itemsize], np.int64).tobytes()
    for a in range(0, len(at), PACK):
        p = at[a : a + PACK]
        columns = [p, one.rank[p], one.astar[p], one.receiver[p], one.flow[p], one.ok[p], one.up[p], one.outlet[p]]
        # Level by level.
        columns += [np.concatenate([x[k][a : a + PACK] for x in levels]) if levels else np.empty(0, bool) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array([island]), pa.array([box]), *[pa.array([x.tobytes()]) for x in columns]], names=["island", "box", *FLOW_BLOCKS])


def _unpack(batches: Iterator[pa.RecordBatch], cols: int, levels: int) -> Iterator[pa.RecordBatch]:
    """Rows of FLOW_SCHEMA from blocks of islands."""
    names = [x.split()[0] for x in FLOW_SCHEMA.split(", ")]

    def rows(block: dict) -> dict[str, np.ndarray]:
        width, r0, c0, size = np.frombuffer(block["box"], np.int64).tolist()
        place = np.dtype(f"i{size}")
        out = {k: np.frombuffer(block[k], kind or place) for k, kind in FLOW_BLOCKS.items()}
        n = len(out["cell_id"])
        for k in ("cell_id", "astar_receiver", "receiver", "outlet", "roots"):
            p = out[k].astype(np.int64)
            out[k] = np.where(p < 0, -1, (p // width + r0) * cols + p % width + c0)
        for k in ("streams", "roots", "lefts"):
            out[k] = out[k].reshape(levels, n).T.ravel()
        return out | {"rank": out["rank"].astype(np.int64), "island": np.full(n, block["island"], np.int64)}

    def batch(some: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        columns = {k: np.concatenate([x[k] for x in some]) for k in names}
        edge = pa.array(np.arange(len(columns["cell_id"]) + 1, dtype=np.int32) * np.int32(levels))
        arrays = [pa.array(x, mask=x < 0) if k in ("astar_receiver", "receiver", "outlet") else pa.array(x) for k, x in columns.items()]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(edge, x) if k in ("streams", "roots", "lefts") else x for k, x in zip(names, arrays)], names=names)

    some, n = [], 0
    for blocks in batches:
        for k in range(blocks.num_rows):
            some.append(rows(blocks.slice(k, 1).to_pylist()[0]))
            n += len(some[-1]["cell_id"])
            if n >= UNPACKED:
                yield batch(some)
                some, n = [], 0
    if some:
        yield batch(some)


def flow(cells: DataFrame, grid: GridSpec, thresholds: list[int], *, power: int = 5, scale: float = SCALE, tile: int = _regions.TILE) -> DataFrame:
    """The flow table: see FLOW_SCHEMA; the arrays have an entry for each threshold.

    An island's task receives and sends blocks of bytes, which all tasks make and open: what it does alone is the kernel.
    """
    spark = cells.sparkSession
    ship(spark)
    marked = stencil.edge(cells).withColumn("hydro_z", stencil.quantize(F.col("z"), scale)).withColumn("valid", F.col("z").isNotNull().cast("int"))
    islands = _regions.regions(marked, grid, "valid", diagonal=True, tile=tile).withColumnRenamed("region", "island")
    rows = marked.filter("valid = 1").select("cell_id", "hydro_z", "is_edge").join(islands, "cell_id")
    cols, xres, yres, levels = grid.cols, grid.xres, grid.yres, len(thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _island_rows(batches, cols, xres, yres, thresholds, power)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _unpack(batches, cols, levels)

    done = rows.mapInArrow(_pack, PACKED_SCHEMA).groupBy("island").applyInArrow(run, FLOW_BLOCKS_SCHEMA)
    return done.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(unpack, FLOW_SCHEMA)


def half_basin_levels(flow_table: DataFrame, level: int | None = None, also: tuple[str, ...] = (), *, dense: bool = True) -> DataFrame:
    """level (from 1), cell_id, stream and hb: pairs are numbered by their root cells, the left half 2k - 1 and the right 2k;
    0 where no stream drains.  All levels, or one of them; columns ``also`` of the flow table stay.

    Where numbers need to tell half-basins apart only, and not be ``dense``, k is the root cell plus 1: nothing is sorted or joined."""
    if level is None:
        zipped = F.arrays_zip("streams", "roots", "lefts")
        cells = flow_table.select("cell_id", *also, F.posexplode(zipped).alias("level", "x")).select((F.col("level") + 1).alias("level"), "cell_id", *also, F.col("x.streams").alias("stream"), F.col("x.roots").alias("root"), F.col("x.lefts").alias("left"))
    else:
        cells = flow_table.select(F.lit(level).alias("level"), "cell_id", *also, *[F.element_at(c, level).alias(c[:-1]) for c in ("streams", "roots", "lefts")])
    if not dense:
        hb = F.when(F.col("root") >= 0, 2 * (F.col("root") + 1) - F.col("left").cast("int")).otherwise(F.lit(0))
        return cells.select("level", "cell_id", "stream", hb.cast("long").alias("hb"), *also)
    roots = cells.filter("root >= 0").select("level", "root").distinct()
    numbered = _regions.number_rows(roots, ["level", "root"], "k")
    first = numbered.groupBy("level").agg((F.min("k") - 1).alias("before"))  # one row a level
    numbered = numbered.join(F.broadcast(first), "level").select("level", "root", (F.col("k") - F.col("before")).alias("k"))
    out = cells.join(numbered, ["level", "root"], "left")
    return out.select("level", "cell_id", "stream", F.coalesce(2 * F.col("k") - F.col("left").cast("int"), F.lit(0)).cast("long").alias("hb"), *also)


def _around(cells: DataFrame, flow_table: DataFrame) -> DataFrame:
    """Every valid cell with its elevation, rank, routed receiver and accumulation, whether it is an edge cell, and ``pairs``: its valid
    neighbours (place in LOOK's order, cell, elevation, rank, accumulation).

    Neighbours come from windows along lines; cells that the table lacks above or below others are put in first, as diagonal
    neighbours are seen past them.
    """
    flow = flow_table.select("cell_id", "rank", "accumulation", "astar_receiver")
    rows = cells.select("cell_id", "r", "c", stencil.quantize(F.col("z")).alias("hz"), F.col("z").isNotNull().alias("valid")).join(flow, "cell_id", "left")
    column = Window.partitionBy("c").orderBy("r")
    above, below = F.lag("r").over(column), F.lead("r").over(column)
    lacks = F.array_compact(F.array(F.when(F.coalesce(above < F.col("r") - 2, F.lit(True)), F.col("r") - 1), F.when(F.coalesce(below > F.col("r") + 1, F.lit(True)), F.col("r") + 1)))
    gaps = cells.select("r", "c").select("c", lacks.alias("lacks")).select(F.explode("lacks").alias("r"), "c")
    rows = rows.unionByName(gaps, allowMissingColumns=True)
    own = F.struct(F.col("cell_id").alias("dst"), F.col("hz").alias("dst_z"), F.col("rank").alias("dst_rank"), F.col("accumulation").alias("dst_acc"), "valid")
    rows = stencil.neighbours(rows, own, "around").filter("rank IS NOT NULL")
    is_edge = ~F.forall("around", lambda x: F.coalesce(x["valid"], F.lit(False)))
    place = F.array(*[F.lit(LOOK.index(d)) for d in stencil.AROUND])
    pairs = F.filter(F.zip_with("around", place, lambda x, k: F.struct(k.alias("k"), *[x[n].alias(n) for n in ("dst", "dst_z", "dst_rank", "dst_acc")])), lambda x: x["dst_rank"].isNotNull())
    return rows.select("cell_id", "hz", "rank", "accumulation", "astar_receiver", is_edge.alias("is_edge"), pairs.alias("pairs"))


def mfd_weights(cells: DataFrame, flow_table: DataFrame, grid: GridSpec, power: int = 5) -> DataFrame:
    """src, dst and w: the shares of a cell's flow, as set operations on ranks."""
    diagonal = float(np.hypot(grid.xres, grid.yres))

    def raw(x: Column) -> Column:
        length = F.when(x["k"] < 2, grid.yres).when(x["k"] < 4, grid.xres).otherwise(diagonal) * SCALE
        fall = F.col("hz") - x["dst_z"]
        return F.when(fall > 0, F.pow(fall / length, F.lit(power))).when(fall == 0, F.pow(0.5 / length, F.lit(power)))

    rows = _around(cells, flow_table).filter("NOT is_edge")
    lower = F.transform(F.filter("pairs", lambda x: x["dst_rank"] < F.col("rank")), lambda x: F.struct(x["dst"].alias("dst"), raw(x).alias("raw")))
    rows = rows.select("cell_id", "astar_receiver", lower.alias("lower"))
    rows = rows.withColumn("best", F.coalesce(F.array_max(F.transform("lower", lambda x: x["raw"])), F.lit(1.0)))
    given = F.transform("lower", lambda x: F.struct(x["dst"].alias("dst"), F.when(x["raw"].isNull() & (x["dst"] == F.col("astar_receiver")), F.col("best")).otherwise(x["raw"]).alias("raw")))
    rows = rows.select("cell_id", F.filter(given, lambda x: x["raw"].isNotNull()).alias("given"))
    rows = rows.withColumn("total", F.aggregate("given", F.lit(0.0), lambda n, x: n + x["raw"]))
    return rows.select(F.col("cell_id").alias("src"), "total", F.explode("given").alias("x")).select("src", F.col("x.dst").alias("dst"), (F.col("x.raw") / F.col("total")).alias("w"))


def adjusted_receiver(cells: DataFrame, flow_table: DataFrame, grid: GridSpec) -> DataFrame:
    """cell_id and receiver: the lower-ranked neighbour of greatest accumulation if that beats the routed receiver's."""
    rows = _around(cells, flow_table)
    lower = F.filter("pairs", lambda x: x["dst_rank"] < F.col("rank"))
    best = F.array_max(F.transform(lower, lambda x: F.struct(x["dst_acc"].alias("acc"), (-x["k"]).alias("k"), x["dst"].alias("dst"))))
    # The routed receiver is a neighbour.
    own = F.get(F.filter("pairs", lambda x: x["dst"] == F.col("astar_receiver")), F.lit(0))["dst_acc"]
    rows = rows.select("cell_id", "astar_receiver", "is_edge", best.alias("b"), own.alias("own_acc"))
    better = ~F.col("is_edge") & (F.col("b.acc") > F.coalesce("own_acc", F.lit(-1.0)))
    return rows.select("cell_id", F.when(better, F.col("b.dst")).otherwise(F.col("astar_receiver")).alias("receiver"))


def stream_tests(cells: DataFrame, flow_table: DataFrame, grid: GridSpec) -> DataFrame:
    """cell_id, static_ok and up_max as set operations."""
    lower = F.exists("pairs", lambda x: (x["dst_rank"] < F.col("rank")) & (x["dst_z"] != F.col("hz")))
    up = F.array_max(F.transform(F.filter("pairs", lambda x: x["dst_z"] > F.col("hz")), lambda x: x["dst_acc"] + 0.5))
    return _around(cells, flow_table).select("cell_id", (~F.col("is_edge") & lower).alias("static_ok"), F.coalesce(up, F.lit(0.0)).cast("float").alias("up_max"))


def domains(flow_table: DataFrame, limit: int) -> DataFrame:
    """cell_id, island and piece: every island's drainage forest cut into subtrees of at most ``limit`` cells."""
    ship(flow_table.sparkSession)
    limit = max(2, int(limit))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        cell, n = frame["cell_id"].to_numpy(), len(frame)
        sorter = np.argsort(cell, kind="stable")
        known = frame["receiver"].notna().to_numpy()
        wanted = frame["receiver"].fillna(-1).to_numpy(np.int64)
        near = sorter[np.minimum(np.searchsorted(cell, wanted, sorter=sorter), n - 1)]
        down = np.where(known & (cell[near] == wanted), near, -1)
        held, apart, below = array("q", bytes(8 * n)), bytearray(n), array("q", down.astype(np.int64).tobytes())
        for i in range(n - 1, -1, -1):  # held counts what a cell's donors have added
            mine, j = held[i] + 1, below[i]
            if j < 0 or mine >= limit or held[j] + mine >= limit:
                apart[i] = 1
            else:
                held[j] += mine
        begins = np.frombuffer(apart, np.uint8) > 0
        head = np.where(begins, np.arange(n), down)
        while not np.array_equal(further := head[head], head):
            head = further
        return pd.DataFrame({"cell_id": cell, "island": frame["island"].to_numpy(), "piece": np.cumsum(begins)[head]})

    rows = flow_table.select("cell_id", "island", "rank", "receiver")
    return rows.groupBy("island").applyInPandas(run, "cell_id bigint, island bigint, piece bigint")


def merge_domains(sizes: dict[int, int], contacts: list[tuple[int, int, int]], limit: int, *, share: float = 0.2, passes: int = 4) -> dict[int, int]:
    """New number of each domain after small ones (under ``share`` of the limit) join the neighbour of longest contact
    that still fits.  Domains are few: this is a plain function of their graph."""
    home = {d: d for d in sizes}
    size, near = dict(sizes), {d: {} for d in sizes}
    for a, b, n in contacts:
        near[a][b] = near[a].get(b, 0) + n
        near[b][a] = near[b].get(a, 0) + n
    for _ in range(passes):
        changed = False
        for d in sorted(size, key=lambda d: (size[d], d)):
            if d not in size or size[d] >= max(1, int(limit * share)):
                continue
            fitting = [(n, -k) for k, n in near[d].items() if size[d] + size[k] <= limit]
            if not fitting:
                continue
            into = -max(fitting)[1]
            gone, stay = (d, into) if size[into] >= size[d] else (into, d)
            size[stay] += size.pop(gone)
            for k, n in near.pop(gone).items():
                near[k].pop(gone, None)
                if k != stay:
                    near[k][stay] = near[stay][k] = near[stay].get(k, 0) + n
            home.update({k: stay for k, v in home.items() if v == gone})
            changed = True
        if not changed:
            break
    number = {d: i for i, d in enumerate(dict.fromkeys(home[k] for k in sorted(home)), 1)}
    return {d: number[home[d]] for d in home}
