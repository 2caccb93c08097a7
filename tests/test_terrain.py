import heapq
import itertools
import json
import os
import random
import sqlite3
import struct
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from fallline import queries as terrain
from fallline.cli import build_parser, main
from fallline.components import connected_components
from fallline.grid import GridSpec
from fallline.operators import hierarchy, regions, routing, stencil
from fallline.plans.domains import domain_sizes, estimate_valid_cells, partition
from fallline.plans.pipeline import Optimizer, Settings, SlopeUnits, five_points, objective
from fallline.plans.resources import SystemResources, byte_size, detect_system_resources, make_resource_plan, processing_mode
from fallline.plans.schedule import candidate_storage, estimate_work_storage, threshold_schedule
from fallline.runtime import broadcast_if_small, cut, drop_table, exists, stage, temporary
from fallline.sources.ascii_grid import read_ascii_grid, read_cells, write_ascii_grid, write_cells
from fallline.sources.geotiff import read_geotiff

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("orders",):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(terrain.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = terrain.queries()[name](spark, SF)
    columns = sorted(got.columns)
    cursor = duck.execute(terrain.ORACLES[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    expected = sorted(tuple(map(repr, (row[theirs.index(c)] for c in columns))) for row in cursor.fetchall())
    assert sorted(tuple(map(repr, (row[c] for c in columns))) for row in got.collect()) == expected


@pytest.mark.parametrize("n", [1_003, 65_536])
def test_storage_of_an_incomplete_last_row(spark, tmp_path, n):
    """Cells are those of the table, not of the grid's whole rows; a half is rounded up, as in SQL."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT range AS o_orderkey, range % 97 AS o_custkey, range::DOUBLE AS o_totalprice, '1' AS o_orderpriority FROM range({n})) TO '{tmp_path}/orders.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    expected = con.execute(terrain.ORACLES["storage_estimate"]).fetchall()
    assert [tuple(r) for r in terrain.storage_estimate(spark, str(tmp_path)).collect()] == expected


def test_schedule():
    assert [x.cells for x in threshold_schedule(250_000, 900)] == [277, 138, 69, 34, 17, 8, 4, 2]
    assert [x.cells for x in threshold_schedule(250_000, 900, 3)] == [277, 184, 122, 81, 54, 36, 24, 16, 10, 6, 4]
    assert [x.cells for x in threshold_schedule(100, 900)] == [1]
    assert threshold_schedule(250_000, 900, 2.9) == threshold_schedule(250_000, 900, 2)
    with pytest.raises(ValueError):
        threshold_schedule(0, 900)


def test_plans():
    grid = GridSpec(1000, 2000)
    e = estimate_work_storage(grid)
    assert (e.cells, e.candidate_levels) == (2_000_000, 8) and e.estimated_total_gb == pytest.approx(2e6 * 80 / 1024**3)
    assert candidate_storage(grid, 8, 10**12) == "all" and candidate_storage(grid, 8, 10**6) == "stream" and candidate_storage(grid, 8, 0, materialized=True) == "all"
    plan = make_resource_plan(SystemResources(3, 2, 2 * 1024**3), grid)
    assert plan.tasks == 6 and plan.task_cells == int(1024**3 * 0.65) // 112 and plan.tile**2 <= plan.task_cells and plan.partitions == 6
    assert plan.coarse_factor == 4 and plan.coarse_resolution_m == 120.0
    assert make_resource_plan(SystemResources(3, 2, 2 * 1024**3), GridSpec(1_000_000, 1_000_000), workers=2).tasks == 2
    far = make_resource_plan(SystemResources(3, 2, 2 * 1024**3), GridSpec(1_000_000, 1_000_000))
    assert (-(-1_000_000 // far.coarse_factor)) ** 2 <= int(1024**3 * 0.18) // 72 and far.partitions == -(-10**12 // far.task_cells)
    assert processing_mode(grid, 30.0, 10, plan) == "direct" and processing_mode(grid, 20.0, 10, plan) == "single"
    assert processing_mode(grid, 20.0, 10**12, far) == "single" and processing_mode(GridSpec(10**6, 10**6), 30.0, 10**12, far) == "hydrological"
    with pytest.raises(ValueError):
        make_resource_plan(SystemResources(1, 1, 10**9), grid, memory_fraction=0.99)
    assert byte_size("3000m") == 3000 << 20 and byte_size("2g") == byte_size("2GB") == 2 << 30 and byte_size("17") == 17


def test_resources_of_a_session(spark):
    got = detect_system_resources(spark)
    assert got.executors == 1 and got.cores == 8 and got.memory_bytes > 0


def test_grid():
    grid = GridSpec(3, 4, 5.0, 100.0, 30, 30)
    assert grid.aligned(30.0) == grid
    other = grid.aligned(50.0)
    assert other.x0 <= grid.x0 and other.y0 >= grid.y0 and other.bounds[2] >= grid.bounds[2] and other.bounds[1] <= grid.bounds[1]
    assert GridSpec.from_json(grid.to_json()) == grid
    with pytest.raises(ValueError):
        GridSpec(0, 1)
    with pytest.raises(ValueError):
        GridSpec(1, 1, xres=10, yres=20).require_square()


def test_command_line_defaults():
    a = build_parser().parse_args(["dem.asc", "run"])
    assert (a.threshold_m2, a.min_area_m2, a.cv_min, a.reduction_factor, a.max_iterations, a.convergence, a.clean_size_m2) == (250_000, 100_000, 0.25, 2, 12, 5, 25_000)
    assert (a.hierarchy_mode, a.candidate_cache_mode) == ("lazy", "auto")
    a = build_parser().parse_args("d o --nodata 1 2 --nodata 3 --restart --no-checkpoint --no-diagnostics --checkpoint-minutes 3 --mfd-block-cells 9 --scratch-ram-fraction 0.4 --numba-threads 2".split())
    assert a.nodata == [1.0, 2.0, 3.0] and a.restart


def test_nodata():
    assert stencil.normalize_nodata([1, 2, 1, float("nan"), float("nan")])[:2] == [1.0, 2.0]
    assert len(stencil.normalize_nodata([1, 2, 1, float("nan"), float("nan")])) == 3


def table(spark, z, xres=30.0, yres=30.0):
    z = np.asarray(z, dtype=object)
    rows = [(int(r * z.shape[1] + c), int(r), int(c), None if z[r, c] is None else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "cell_id bigint, r int, c int, z double"), GridSpec(*z.shape, xres=xres, yres=yres)


def naive_routing(z, xres=30.0, yres=30.0):
    """Priority-flood routing written cell by cell over dictionaries."""
    at = {(r, c): float(np.floor(z[r][c] * 1000 + 0.5)) for r in range(len(z)) for c in range(len(z[0])) if z[r][c] is not None}
    edge = {p for p in at if any((p[0] + a, p[1] + b) not in at for a in (-1, 0, 1) for b in (-1, 0, 1))}
    heap, seen, receiver, popped, age = [], set(), {}, [], itertools.count()
    for p in sorted(edge):
        heapq.heappush(heap, (at[p], next(age), p))
        seen.add(p)
    done = set()
    diagonal = np.hypot(xres, yres) * 1000
    while heap:
        h, _, p = heapq.heappop(heap)
        for a, b in routing.LOOK:
            q = (p[0] + a, p[1] + b)
            if q not in at or q in done or (q in seen and q not in edge):
                continue
            slope = max(0.0, at[q] - h) / (diagonal if a and b else (yres if a else xres) * 1000)
            if a and b and slope > 0:
                # q is reached along its row from the cell above or below p, along its column from the one beside p.
                beside = [((p[0] + a, p[1]), xres * 1000), ((p[0], p[1] + b), yres * 1000)]
                if any(s in at and s not in done and slope < max(0.0, at[q] - at[s]) / d for s, d in beside):
                    continue
            if q not in seen:
                receiver[q] = p
                seen.add(q)
                heapq.heappush(heap, (at[q], next(age), q))
            elif slope > 0:
                receiver[q] = p
        done.add(p)
        popped.append(p)
    return popped, receiver


def naive_flow(z, popped, routed, thresholds, xres=30.0, yres=30.0):
    """Accumulation, receivers, stream tests, streams and sides by their definitions, over dictionaries of cells."""
    at = {(r, c): float(np.floor(z[r][c] * 1000 + 0.5)) for r in range(len(z)) for c in range(len(z[0])) if z[r][c] is not None}
    place = {p: k for k, p in enumerate(popped)}
    around = {p: [(p[0] + a, p[1] + b) for a, b in routing.LOOK] for p in at}
    edge = {p for p in at if any(q not in at for q in around[p])}
    near = {p: [q for q in around[p] if q in at] for p in at}
    apart = lambda p, q: (np.hypot(xres, yres) if p[0] != q[0] and p[1] != q[1] else xres if p[0] == q[0] else yres) * 1000
    share = {}
    for p in at:
        if p in edge:
            continue
        lower = {q: max(at[p] - at[q], 0.5) / apart(p, q) if at[p] == at[q] else (at[p] - at[q]) / apart(p, q) for q in near[p] if place[q] < place[p] and at[q] <= at[p]}
        weight = {q: x**5 for q, x in lower.items()}
        if p in routed and routed[p] not in weight:
            weight[routed[p]] = max(weight.values(), default=1.0)
        share[p] = {q: w / sum(weight.values()) for q, w in weight.items()}
    # Solve flow = 1 + what comes in, from the last popped cell down.
    flow = dict.fromkeys(at, 1.0)
    for p in sorted(at, key=place.get, reverse=True):
        for q, w in share.get(p, {}).items():
            flow[q] += flow[p] * w
    receiver = dict(routed)
    for p in at:
        below = [q for q in near[p] if place[q] < place[p]]
        if p not in edge and below:
            best = max(below, key=lambda q: (flow[q], -around[p].index(q)))
            if p not in routed or flow[best] > flow[routed[p]]:
                receiver[p] = best
    ok = {p: p not in edge and any(place[q] < place[p] and at[q] != at[p] for q in near[p]) for p in at}
    up = {p: max([flow[q] + 0.5 for q in near[p] if at[q] > at[p]], default=0.0) for p in at}
    outlet = {}
    for p in popped:
        outlet[p] = outlet[receiver[p]] if p in receiver else p
    donors = {p: sorted(q for q in receiver if receiver[q] == p) for p in at}
    compass = {d: k for d, k in zip(((-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1)), range(1, 9))}
    way = lambda p, q: compass[q[0] - p[0], q[1] - p[1]]
    levels = []
    for threshold in thresholds:
        stream = set()
        for p in reversed(popped):
            if p not in stream and ok[p] and flow[p] >= threshold and float(np.float32(up[p])) < threshold and not any(q in stream for q in near[p]):
                stream.add(p)
            if p in stream and p in receiver:
                stream.add(receiver[p])
        # Paths are walked upwards from the outlets of streams; each junction ends a path and begins one at each stream donor.
        side, begin = {}, [p for p in popped if p in stream and p not in receiver]
        while begin:
            root = here = begin.pop(0)
            while True:
                mine = donors[here]
                streams = [q for q in mine if q in stream]
                if not mine:
                    side[here] = root, False
                    break
                main = streams[0] if streams else max(mine, key=lambda q: (flow[q], [-q[0], -q[1]]))
                ahead = way(here, main)
                behind = way(here, receiver[here]) if here in receiver else (ahead + 3) % 8 + 1
                turned = {q: (way(here, q) - behind) % 8 < (ahead - behind) % 8 for q in mine if q != main and q not in streams}
                for q, left in turned.items():
                    below = [q]
                    for x in below:
                        side[x] = root, left
                        below += donors[x]
                n_left = sum(turned.values())
                n_right = len(turned) - n_left
                if len(streams) > 1:
                    side[here] = root, n_left >= n_right
                    begin += streams
                    break
                side[here] = root, n_left > n_right
                here = main
        levels.append((stream, side))
    return flow, receiver, ok, up, outlet, levels


@pytest.mark.parametrize("size,values", [((9, 11), 6), ((14, 9), 200), ((12, 16), 40)])
def test_flow_table_equals_its_definitions(spark, size, values):
    rnd = np.random.default_rng(values)
    surface = rnd.integers(0, values, size) + np.add.outer(np.arange(size[0]), np.arange(size[1]))
    z = [[None if rnd.random() < 0.06 else int(v) for v in row] for row in surface]
    cols, thresholds = size[1], [12, 6, 3]
    cells, grid = table(spark, z, 20.0, 30.0)
    rows = routing.flow(cells, grid, thresholds, tile=8).collect()
    popped, routed = naive_routing(z, 20.0, 30.0)
    flow, receiver, ok, up, outlet, levels = naive_flow(z, popped, routed, thresholds, 20.0, 30.0)
    number = lambda p: None if p is None else p[0] * cols + p[1]
    streams = 0
    for r in rows:
        p = divmod(r.cell_id, cols)
        assert r.accumulation == pytest.approx(flow[p], rel=1e-9) and r.receiver == number(receiver.get(p)) and r.outlet == number(outlet[p])
        assert r.static_ok == ok[p] and r.up_max == pytest.approx(up[p], rel=1e-5)
        for k, (stream, side) in enumerate(levels):
            assert r.streams[k] == (p in stream)
            assert (r.roots[k], r.lefts[k]) == ((number(side[p][0]), side[p][1]) if p in side else (-1, False))
            streams += p in stream
    assert streams > 10 and len(rows) == len(popped)


@pytest.mark.parametrize("xres,yres", [(30.0, 30.0), (20.0, 30.0), (50.0, 10.0)])
def test_routing_equals_a_naive_walk(spark, xres, yres):
    rnd = random.Random(5)
    for _ in range(3):
        rows, cols = rnd.randint(1, 14), rnd.randint(1, 14)
        z = [[None if rnd.random() < 0.1 else rnd.randint(0, rnd.choice((3, 50))) for _ in range(cols)] for _ in range(rows)]
        if all(v is None for row in z for v in row):
            continue
        cells, grid = table(spark, z, xres, yres)
        flow = routing.flow(cells, grid, [4, 2], tile=6)
        got = flow.collect()
        popped, receiver = naive_routing(z, xres, yres)
        assert {(x.cell_id // cols, x.cell_id % cols): x.astar_receiver for x in got} == {p: (receiver[p][0] * cols + receiver[p][1]) if p in receiver else None for p in popped}
        by_island = {}
        for x in sorted(got, key=lambda x: x["rank"]):
            by_island.setdefault(x.island, []).append(x.cell_id)
        where = {x.cell_id: x.island for x in got}
        expected = {}
        for r, c in popped:
            expected.setdefault(where[r * cols + c], []).append(r * cols + c)
        assert by_island == expected
        levels = routing.half_basin_levels(flow).collect()
        assert len(levels) == 2 * len(got)


def test_set_forms_send_cells_and_not_pairs(spark):
    """Rows are exchanged a cell, not a pair of neighbours; cells that touch at a corner only are neighbours, also in a table that
    lacks the cells beside them."""
    rnd = np.random.default_rng(6)
    z = [[None if rnd.random() < 0.35 else int(v) for v in row] for row in rnd.integers(0, 30, (14, 17))]
    cells, grid = table(spark, z)
    flow = cut(routing.flow(cells, grid, [3]), "flow")
    for some in (cells, cells.filter("z IS NOT NULL")):
        assert {(r.cell_id, r.receiver) for r in routing.adjusted_receiver(some, flow, grid).collect()} == {(r.cell_id, r.receiver) for r in flow.collect()}
        assert {(r.cell_id, r.static_ok, r.up_max) for r in routing.stream_tests(some, flow, grid).collect()} == {(r.cell_id, r.static_ok, r.up_max) for r in flow.collect()}
        shares = routing.mfd_weights(some, flow, grid).groupBy("src").agg(F.round(F.sum("w"), 9).alias("total")).collect()
        assert shares and {r.total for r in shares} == {1.0}
        assert set(r.src for r in shares) == {r.cell_id for r in stencil.edge(cells).filter("z IS NOT NULL AND NOT is_edge").collect()}
    for build in (routing.adjusted_receiver, routing.stream_tests, routing.mfd_weights):
        plan = build(cells, flow, grid)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1, plan
    plan = routing.half_basin_levels(flow, also=("outlet",))._jdf.queryExecution().optimizedPlan().toString()
    assert "outlet" in plan


def test_one_large_island_takes_bounded_memory():
    """A worker holds arrays of an island's cells, not Python objects: 8.5 million cells that touch are one island."""
    rnd = np.random.default_rng(8)
    rows, cols = 150, 200
    z = (rnd.integers(0, 4_000, (rows, cols)) + 300 * np.add.outer(np.arange(rows), np.arange(cols))).ravel().astype(np.int32)
    cell = np.arange(rows * cols)
    edge = np.isin(cell // cols, (0, rows - 1)) | np.isin(cell % cols, (0, cols - 1))
    tracemalloc.start()
    try:
        one = routing.Island(cell, z, edge, cols, 30.0, 30.0)
        one.route()
        one.accumulate(5)
        one.receive()
        for threshold in (30, 8, 2):
            one.half_basins(one.streams(threshold))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert one.flow[one.at][edge].sum() == pytest.approx(len(cell))
    assert peak < 300 * len(cell), peak / len(cell)


def test_islands_travel_in_blocks(spark, monkeypatch):
    """An island's task gets and gives blocks of cells, not a row a cell; cells come back whole and in their islands, in whatever batches."""
    rnd = np.random.default_rng(10)
    z = [[None if rnd.random() < 0.3 else int(v) for v in row] for row in rnd.integers(0, 40, (12, 19))]
    cells, grid = table(spark, z)
    plan = routing.flow(cells, grid, [3])._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and plan.count("MapInArrow") == 2, plan
    islands = {r.cell_id: r.island for r in routing.flow(cells, grid, [3]).collect()}
    edge = {r.cell_id: r.is_edge for r in stencil.edge(cells).collect()}
    height = {r * grid.cols + c: v * 1000 for r, row in enumerate(z) for c, v in enumerate(row) if v is not None}
    assert set(islands) == set(height)
    order = rnd.permutation(sorted(height)).tolist()
    rows = pa.table({"cell_id": pa.array(order, pa.int64()), "hydro_z": pa.array([height[c] for c in order], pa.int32()),
                     "is_edge": [edge[c] for c in order], "island": pa.array([islands[c] for c in order], pa.int64())})
    found = []
    for chunk, pack, size in ((routing.CHUNK, routing.PACK, 1_000), (40, 7, 16), (1, 1, 5)):
        monkeypatch.setattr(routing, "CHUNK", chunk)
        monkeypatch.setattr(routing, "PACK", pack)
        monkeypatch.setattr(routing, "UNPACKED", chunk)
        packed = pa.Table.from_batches(routing._pack(iter(rows.to_batches(size))))
        assert max(len(x) for x in packed["cell_id"].to_pylist()) <= 8 * pack
        got = []
        for island in sorted(set(islands.values())):
            mine = packed.filter(pa.compute.equal(packed["island"], island))
            blocks = routing._island_rows(iter(mine.to_batches()), grid.cols, 30.0, 30.0, [6, 3], 5)
            got += [r for b in routing._unpack(blocks, grid.cols, 2) for r in b.to_pylist()]
        found.append(sorted(got, key=lambda r: r["cell_id"]))
    assert found[0] == found[1] == found[2]
    assert {r["cell_id"]: r["island"] for r in found[0]} == islands


def test_routing_check_makes_no_half_basins(spark, monkeypatch):
    """It asks for ranks, receivers and accumulation only."""
    asked, real = [], routing.flow
    monkeypatch.setattr(routing, "flow", lambda cells, grid, thresholds, **k: asked.append(thresholds) or real(cells, grid, thresholds, **k))
    row = terrain.routing_check(spark, SF).first()
    assert asked == [[]] and row.bad_receivers == 0 and row.edge_flow == row.visited > 0


def test_regions_across_tiles(spark):
    rnd = np.random.default_rng(3)
    z = rnd.integers(0, 3, (23, 31))
    cells, grid = table(spark, z)
    cells = cells.withColumn("v", F.col("z").cast("int"))
    whole = {r.cell_id: r.region for r in regions.regions(cells, grid, "v").collect()}
    tiled = {r.cell_id: r.region for r in regions.regions(cells, grid, "v", tile=5).collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups(whole) == groups(tiled)
    numbers = [r.clump for r in regions.clump(cells, grid, "v", tile=5).collect()]
    assert sorted(set(numbers)) == list(range(1, len(set(whole.values())) + 1))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_polygons_with_a_hole_and_a_corner(spark):
    cells, grid = table(spark, [[1, 1, 1, 0], [1, 2, 1, 0], [1, 1, 1, 0], [0, 0, 0, 1]])
    rows = {r.raster_id: r for r in regions.polygons(cells.withColumn("label", F.col("z").cast("long")), grid).collect()}
    assert rows[1].area_map == 9 * 900 and rows[2].area_map == 900
    assert rows[2].wkt == "MULTIPOLYGON (((30 -30, 60 -30, 60 -60, 30 -60, 30 -30)))"
    assert rows[1].wkt.count("(") == 1 + 2 + 3  # two shells, one with a hole


def test_lazy_and_materialized_agree(spark):
    rnd = np.random.default_rng(1)
    cells, grid = table(spark, rnd.integers(0, 30, (18, 20)))
    units = SlopeUnits(Settings(threshold_m2=20_000, min_area_m2=9_000, cv_min=0.2))
    cells = units.prepare(cells, grid)
    _, levels, count = units.candidates(cells, grid)
    one = {r.cell_id: r.clump for r in units.segment(cells, levels, count, grid).collect()}
    two = {r.cell_id: r.clump for r in units.segment(cells, levels, count, grid, mode="materialized").collect()}
    assert one == two and len(one) == 360


@pytest.mark.parametrize("radius,tile", [(3, 5), (4.5, 4), (7, 3), (2, 512)])
def test_growth_in_tiles_equals_a_search(spark, radius, tile):
    """Labels come from other tiles too, ties go to the smallest row, then column, and a gap sends one row and not one for every line."""
    rnd = np.random.default_rng(11)
    z = rnd.choice([0, 0, 0, 0, 0, 0, 1, 2, 7], (17, 23)) * (rnd.random((17, 23)) < 0.5)
    z[5:14, 6:20] = 0
    cells, grid = table(spark, z)
    target = rnd.random(z.shape) < 0.9
    flags = spark.createDataFrame([(i, bool(v)) for i, v in enumerate(target.ravel())], "cell_id bigint, target boolean")
    labels = cells.withColumn("label", F.col("z").cast("int")).join(flags, "cell_id")
    out = stencil.grow(labels, radius, tile=tile)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Generate") == 2, plan
    assert out.schema["label"].dataType == labels.schema["label"].dataType
    seeds = [(r, c) for r, c in itertools.product(range(17), range(23)) if z[r, c] > 0]
    for row in out.collect():
        r, c = row.r, row.c
        near = [((a - r) ** 2 + (b - c) ** 2, a, b) for a, b in seeds if (a - r) ** 2 + (b - c) ** 2 <= radius * radius]
        wanted = z[r, c] if z[r, c] > 0 or not target[r, c] or not near else z[min(near)[1:]]
        assert row.label == wanted, (r, c)
    assert out.count() == 17 * 23


def test_a_lazy_run_reads_half_basins_from_the_flow_table(spark, tmp_path):
    """No table of all levels is written for it, and telling half-basins apart takes neither a sort nor a join."""
    rnd = np.random.default_rng(12)
    cells, grid = table(spark, rnd.integers(0, 30, (18, 20)))
    settings = Settings(threshold_m2=20_000, min_area_m2=9_000, cv_min=0.2)
    got = {}
    for storage in ("auto", "all"):
        out = SlopeUnits(settings, work=str(tmp_path / storage), storage=storage).run(cells, grid)
        got[storage] = {r.cell_id: (r.raw_unit, r.unit) for r in out.collect()}
        made = {p.name for p in (tmp_path / storage).glob("*/*")}
        assert ("half_basins" in made) == (storage == "all") and "flow" in made
    assert got["auto"] == got["all"] and len(set(got["auto"].values())) > 1
    flow = spark.read.parquet(str(next((tmp_path / "auto").glob("*/flow"))))
    apart = routing.half_basin_levels(flow, dense=False)
    assert "Join" not in apart._jdf.queryExecution().optimizedPlan().toString()
    sets = [{}, {}]
    for found, one in zip(sets, (apart, routing.half_basin_levels(flow))):
        for r in one.collect():
            found.setdefault((r.level, r.hb), set()).add((r.cell_id, r.stream))
    assert {k[0] for k, v in sets[0].items() if k[1] == 0} == {k[0] for k, v in sets[1].items() if k[1] == 0}
    assert sorted(map(sorted, sets[0].values())) == sorted(map(sorted, sets[1].values()))


def test_clean_and_sinks(spark, tmp_path):
    rnd = np.random.default_rng(2)
    cells, grid = table(spark, rnd.integers(1, 4, (12, 12)))
    cells = cells.withColumn("label", F.when(F.col("c") < 6, 1).when(F.col("r") < 11, 2).otherwise(3).cast("long"))
    for method in ("basic", "quick"):
        got = regions.clean(cells, grid, 6 * 900.0, method=method)
        assert got.select("clump").distinct().count() == 2 and got.count() == 144
    write_cells(cells.drop("label"), grid, str(tmp_path / "t"))
    back, header = read_cells(spark, str(tmp_path / "t"))
    assert header == grid and back.count() == 144
    write_ascii_grid(cells, grid, str(tmp_path / "a"), "z")
    again, header = read_ascii_grid(spark, str(tmp_path / "a"))
    assert (header.rows, header.cols, header.xres) == (12, 12, 30.0)
    assert {(r.cell_id, r.z) for r in again.collect()} == {(r.cell_id, r.z) for r in cells.select("cell_id", "z").collect()}


def test_search(spark, tmp_path):
    assert len(five_points((0, 1), (0, 1))) == 5
    assert objective([{"V": 1, "I": 1}, {"V": 0, "I": 1}, {"V": 0.5, "I": None}]) == [0.0, 1.0, None]
    rnd = np.random.default_rng(4)
    cells, grid = table(spark, rnd.integers(0, 30, (12, 12)))
    search = Optimizer(Settings(threshold_m2=10_000), area=(5_000.0, 30_000.0), rounds=1)
    assert (search.cv, Optimizer().area, Optimizer().rounds, Optimizer().area_epsilon) == ((0.05, 0.25), (50_000.0, 200_000.0), 8, 50_000.0)
    out = search.run(cells, grid, report=str(tmp_path / "report"))
    assert len(out["points"]) == 5 and out["rounds"] == 1
    known = [p["F"] for p in out["points"] if p["F"] is not None]
    assert known == sorted(known, reverse=True) and (not known or out["best"]["F"] == max(known))
    assert json.loads(spark.read.text(str(tmp_path / "report")).first()["value"])["best"] == out["best"]


def test_the_search_looks_around_the_largest_f(monkeypatch, spark):
    """The lowest V and I win; a point of two rounds is evaluated once."""
    asked = []

    def evaluate(self, cells, levels, count, grid, cv, area):
        asked.append((cv, area))
        return {"cv_min": cv, "min_area_m2": area, "V": cv, "I": None if area > 190_000 else 0.0, "units": 1}

    monkeypatch.setattr(Optimizer, "evaluate", evaluate)
    cells, grid = table(spark, [[1]])
    out = Optimizer(rounds=3).run(cells, grid)
    best = out["best"]
    assert best["cv_min"] == 0.05 and best["F"] == max(p["F"] for p in out["points"] if p["F"] is not None)
    assert len(asked) == len(set(asked)) == len(out["points"]) and out["rounds"] == 3


def test_neighbours_across_missing_cells(spark):
    z = np.arange(30).reshape(5, 6) % 7 + 1
    cells, grid = table(spark, z)
    gone = cells.filter("cell_id % 4 != 1")
    dense = cells.withColumn("label", F.when(F.col("cell_id") % 4 != 1, F.col("z")).otherwise(0).cast("long"))
    sparse = gone.withColumn("label", F.col("z").cast("long"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(stencil.adjacency(sparse)) == rows(stencil.adjacency(dense))
    masked = cells.withColumn("z", F.when(F.col("cell_id") % 4 != 1, F.col("z")))
    mine = lambda df, *c: rows(df.filter("z IS NOT NULL").select("cell_id", *c))
    assert mine(stencil.edge(gone), "is_edge") == mine(stencil.edge(masked), "is_edge")
    assert mine(stencil.aspect(gone, grid), "sin_aspect", "aspect_valid") == mine(stencil.aspect(masked, grid), "sin_aspect", "aspect_valid")
    one = gone.withColumn("label", F.lit(1).cast("long"))
    assert one.join(stencil.interior(one).select("cell_id", F.col("label").alias("kept")), "cell_id").filter("kept > 0").count() == 0


def test_tables_of_a_scope_go(spark):
    with temporary(spark) as keep:
        gone, kept = cut(spark.range(3), "gone"), keep(cut(spark.range(4), "kept"))
    assert kept.count() == 4 and not exists(spark, gone._fallline_path)
    drop_table(kept)
    assert not exists(spark, kept._fallline_path)


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    marked = lambda df: "hint" in df._jdf.queryExecution().logical().toString().lower()
    df = spark.createDataFrame([("x" * 1000, [1, 2], [("a", b"bc")])], "a string, b array<int>, c array<struct<d:string,e:binary>>")
    assert marked(broadcast_if_small(df)) and not marked(broadcast_if_small(df, size=900)) and not marked(broadcast_if_small(df.unionAll(df), 1))


def test_stages_are_written_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    path = str(tmp_path / "s")
    assert [stage(spark, path, build).count() for _ in range(2)] == [5, 5] and len(calls) == 1
    assert stage(spark, path, build, restart=True).count() == 5 and len(calls) == 2


def test_merge_domains():

    got = routing.merge_domains({1: 2, 2: 50, 3: 40}, [(1, 2, 3), (1, 3, 9), (2, 3, 5)], 60)
    assert got[1] == got[3] != got[2]


def tiff(z, *, order="<", big=False, tile=None, compress=False, predictor=1, nodata=None, x0=1000.0, y0=2000.0, res=30.0, crs=3035, kind=None):
    """A GeoTIFF written field by field."""
    z = np.asarray(z)
    rows, cols = z.shape
    high, wide = tile or (2, cols)
    chunks = []
    for r in range(0, rows, high):
        for c in range(0, cols, wide):
            part = z[r : r + high, c : c + wide]
            if tile:
                part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1])))
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1).astype(z.dtype)
            raw = part.astype(z.dtype.newbyteorder(order)).tobytes()
            if predictor == 3:
                planes = part.astype(z.dtype.newbyteorder(">")).view(np.uint8).reshape(part.shape[0], part.shape[1], -1).transpose(0, 2, 1).reshape(part.shape[0], -1)
                raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
            chunks.append(zlib.compress(raw) if compress else raw)
    H, I, D, A = "H", "Q" if big else "I", "d", "s"
    tags = [(256, I, [cols]), (257, I, [rows]), (258, H, [z.dtype.itemsize * 8]), (259, H, [8 if compress else 1]), (277, H, [1]), (317, H, [predictor]), (339, H, [{"u": 1, "i": 2, "f": 3}[z.dtype.kind]]),
            (33550, D, [res, res, 0.0]), (33922, D, [0.0, 0.0, 0.0, x0, y0, 0.0]), (34735, H, [1, 1, 0, 1, 3072, 0, 1, crs] if crs else [1, 1, 0, 0])]
    tags += [(42113, A, [str(nodata).encode() + b"\0"])] if nodata is not None else []
    offsets = (324, 325) if tile else (273, 279)
    tags += [(322, I, [wide]), (323, I, [high])] if tile else [(278, I, [high])]
    tags += [(offsets[0], I, [0] * len(chunks)), (offsets[1], I, [len(x) for x in chunks])]
    numbers = {"H": 3, "I": 4, "Q": 16, "d": 12, "s": 2}
    width, inline = (20, 8) if big else (12, 4)
    head = 16 if big else 8
    after = head + (8 if big else 2) + width * len(tags) + (8 if big else 4)
    for _ in range(2):  # the second time the offsets are known
        entries, extra = b"", b""
        for tag, code, values in sorted(tags):
            body = values[0] if code == "s" else struct.pack(order + code * len(values), *values)
            n = len(values[0]) if code == "s" else len(values)
            at = after + len(extra)
            if len(body) > inline:
                extra += body
                body = struct.pack(order + ("Q" if big else "I"), at)
            entries += struct.pack(order + "HH" + ("Q" if big else "I"), tag, numbers[code], n) + body.ljust(inline, b"\0")
        first = after + len(extra)
        places = [first + sum(map(len, chunks[:k])) for k in range(len(chunks))]
        tags = [(t, c, places if t == offsets[0] else v) for t, c, v in tags]
    start = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8))
    return start + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + bytes(8 if big else 4) + extra + b"".join(chunks)


def test_geotiff(spark, tmp_path):
    rnd = np.random.default_rng(8)
    ways = [
        dict(), dict(order=">"), dict(big=True), dict(compress=True), dict(tile=(16, 16)), dict(compress=True, predictor=2), dict(tile=(16, 16), compress=True, predictor=3), dict(order=">", compress=True, predictor=3),
    ]
    for k, how in enumerate(ways):
        kind = np.int16 if how.get("predictor") == 2 else np.float32
        z = (rnd.integers(-50, 900, (7, 19)) if kind == np.int16 else rnd.normal(500, 90, (7, 19))).astype(kind)
        z[2, 3] = -999
        path = tmp_path / f"{k}.tif"
        path.write_bytes(tiff(z, nodata=-999, **how))
        cells, grid = read_geotiff(spark, str(path))
        assert grid == GridSpec(7, 19, 1000.0, 2000.0, 30.0, 30.0, "EPSG:3035")
        got = {(r.r, r.c): r.z for r in cells.collect()}
        assert got == {(r, c): None if (r, c) == (2, 3) else float(z[r, c]) for r in range(7) for c in range(19)}
    mosaic = tmp_path / "mosaic"
    mosaic.mkdir()
    whole = rnd.integers(0, 99, (8, 10)).astype(np.int32)
    for k, (r, c) in enumerate(((0, 0), (0, 5), (4, 0), (4, 5))):
        (mosaic / f"{k}.tif").write_bytes(tiff(whole[r : r + 4, c : c + 5], x0=1000.0 + 30 * c, y0=2000.0 - 30 * r))
    cells, grid = read_geotiff(spark, str(mosaic / "*.tif"))
    assert (grid.rows, grid.cols) == (8, 10) and {(r.r, r.c): r.z for r in cells.collect()} == {(r, c): float(whole[r, c]) for r in range(8) for c in range(10)}
    (mosaic / "9.tif").write_bytes(tiff(whole, x0=1007.0))
    with pytest.raises(ValueError):
        read_geotiff(spark, str(mosaic / "*.tif"))
    (tmp_path / "geo.tif").write_bytes(tiff(whole, crs=None))
    with pytest.raises(Exception, match="projected"):
        read_geotiff(spark, str(tmp_path / "geo.tif"))


def test_command_line_runs_and_resumes(spark, tmp_path):
    rnd = np.random.default_rng(9)
    (tmp_path / "dem.tif").write_bytes(tiff((rnd.random((16, 18)) * 60).astype(np.float32)))
    out, package = str(tmp_path / "out"), str(tmp_path / "units.gpkg")
    args = [str(tmp_path / "dem.tif"), out, "--quiet", "--threshold-m2", "20000", "--min-area-m2", "9000", "--cv-min", "0.2", "--clean-size-m2", "3000", "--nodata", "-1", "-2", "--geopackage", package]
    report = lambda: json.loads(spark.read.text(f"{out}/run_report").first()["value"])
    assert main([*args, "--plan-only"], spark) == 0 and "run" not in report()
    assert main(args, spark) == 0
    first = report()
    units = {r.cell_id: r.unit for r in spark.read.parquet(first["run"] + "/units").collect()}
    assert first["written"] and len(units) == 16 * 18 and first["settings"]["nodata"] == [-1.0, -2.0]
    con = sqlite3.connect(package)
    features = con.execute("SELECT su_id, area_map, geom FROM slope_units ORDER BY su_id").fetchall()
    assert len(features) == first["features"] == len(set(units.values())) and sum(a for _, a, _ in features) == 16 * 18 * 900
    assert all(g[:2] == b"GP" and struct.unpack_from("<i", g, 4)[0] == 3035 and struct.unpack_from("<BI", g, 8) == (1, 6) for _, _, g in features)
    assert con.execute("PRAGMA integrity_check").fetchone() == ("ok",)
    assert main(args, spark) == 0 and not report()["written"]  # all of it was there
    assert main([*args, "--candidate-cache-mode", "stream", "--no-checkpoint", "--no-skip-existing"], spark) == 0
    assert report()["written"] and {r.cell_id: r.unit for r in spark.read.parquet(first["run"] + "/units").collect()} == units
    shown = spark.read.parquet(first["run"] + "/diagnostics")
    assert shown.filter("is_boundary").count() > 0 and shown.filter("display > 0").count() == 16 * 18
    with pytest.raises(SystemExit):
        main([*args, "--target-crs", "EPSG:4326"], spark)


def test_edge_cases(spark):
    for z in ([[5]], [[1, 2, 3]], [[None, None]], [[4, 4], [4, 4]]):
        cells, grid = table(spark, z)
        flow = routing.flow(cells, grid, [1])
        assert flow.count() == sum(v is not None for row in z for v in row)
        assert stencil.aspect(cells, grid).filter("aspect_valid").count() == 0
    with pytest.raises(ValueError):
        hierarchy.Rules(900.0, -1.0)


def test_domains_of_a_coarse_grid(spark):
    rnd = np.random.default_rng(6)
    cells, grid = table(spark, rnd.integers(0, 60, (30, 33)))
    out, records = partition(cells, grid, 3, 9 * 20)
    sizes = [r.coarse_cells for r in records.collect()]
    assert sum(sizes) == 110 == out.count() and max(sizes) <= 20
    assert estimate_valid_cells(out.withColumn("z", F.lit(1.0)), 9.0) == (990, (0, 9, 0, 10))
    row = domain_sizes(records).first()
    assert (row.domains, row.median_cells, row.largest_cells) == (len(sizes), float(np.median(sizes)), max(sizes))
