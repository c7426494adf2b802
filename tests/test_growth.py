"""Steps whose cost must not outgrow their input: what is copied is never broadcast, far points meet the rim of a crowd only."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from wayfold.operators import spatial


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(df, folder):
    """`df` as a table whose size the planner knows."""
    df.write.parquet(str(folder / "table"))
    return df.sparkSession.read.parquet(str(folder / "table"))


def scattered(n, seed, x0=0.0, y0=0.0, extent=20000.0):
    rng = random.Random(seed)
    return [(i, x0 + rng.random() * extent, y0 + rng.random() * extent) for i in range(n)]


def test_copies_for_distance_pairs_are_not_broadcast(spark, tmp_path):
    rows = scattered(300, 1)
    df = spark.createDataFrame([*rows, (300, rows[0][1] + 1000.0, rows[0][2])], "id long, x double, y double")
    rows, df = [tuple(r) for r in df.collect()], stored(df, tmp_path)
    for strict in (False, True):
        pairs = spatial.join_distance(df, spatial.as_right(df), 1000.0, strict)
        assert "Broadcast" not in plan(pairs)
        near = lambda d: d < 1000.0 if strict else d <= 1000.0
        wanted = [(a[0], b[0]) for a in rows for b in rows if near(math.sqrt((b[1] - a[1]) ** 2 + (b[2] - a[2]) ** 2))]
        assert sorted((r.id, r.rid) for r in pairs.collect()) == sorted(wanted)


def test_far_points_meet_the_rim_of_a_crowd(spark):
    crowd = scattered(8000, 2, extent=10000.0)
    # A place shared by many counts as one that cannot be split.
    crowd += [(8000 + i, 100.0, 200.0) for i in range(300)]
    far = [(100 + i, x * 4.0 + 15000.0, y) for i, x, y in scattered(60, 3)] + [(1, -30000.0, -30000.0), (2, 100.0, 50000.0)]
    left = spark.createDataFrame(far, "id long, x double, y double")
    right = spark.createDataFrame(crowd, "rid long, rx double, ry double")
    asked = left.withColumns({"_class": F.lit(0), "_need": F.lit(3).cast("long")})
    one = right.withColumn("_class", F.lit(0))
    met = spatial._candidates_by_cell(asked, one, 131072.0, 200.0).groupBy("id").count().agg(F.sum("count"), F.count("*")).first()
    # About ten each, and 300 for the two that are next to the crowded place.
    assert met[1] == len(far) and met[0] <= 40 * len(far)
    found = {}
    for r in spatial.join_knn(left, right, 3).collect():
        found.setdefault(r.id, {})[r.nth] = r.rid
    for i, x, y in far:
        best = sorted((math.sqrt((rx - x) ** 2 + (ry - y) ** 2), rid) for rid, rx, ry in crowd)[:3]
        assert [found[i][n] for n in (1, 2, 3)] == [rid for _, rid in best]


def test_what_origins_know_that_lack_nothing_is_not_searched(spark, monkeypatch):
    from wayfold.operators import odlines

    zones = spark.createDataFrame(
        [(n, 4 if n < 4 else n % 4, float(n), 0.0, True, True) for n in range(12)], "no long, type_no int, x double, y double, is_from boolean, is_to boolean"
    )
    # Zone 0 has its three suppliers, zone 1 has one, zones 2 and 3 have none.
    edges = spark.createDataFrame([(4, 0, 4), (4, 0, 5), (4, 0, 6), (4, 1, 4), (4, 2, 3)], "level int, o long, d long")
    seen = []

    def search(*args, **named):
        seen.append(named["skip"])
        return spatial.join_knn(*args, **named)

    monkeypatch.setattr(odlines, "join_knn", search)
    found = {(r.o, r.d) for r in odlines.complete_suppliers(edges, zones, 3).collect()}
    assert sorted(r.id.no for r in seen[0].collect()) == [1, 2]
    added = {(1, 5), (1, 6), (2, 4), (2, 5), (2, 6), (3, 4), (3, 5), (3, 6)}
    assert found == {(0, 4), (0, 5), (0, 6), (1, 4), (2, 3)} | added | {(d, o) for o, d in added}


def test_copies_for_nearest_neighbours_are_not_broadcast(spark, tmp_path, monkeypatch):
    rows = scattered(200, 5)
    df = stored(spark.createDataFrame(rows, "id long, x double, y double"), tmp_path)
    written, cut = [], spatial.cut
    monkeypatch.setattr(spatial, "cut", lambda t: (written.append(plan(t)), cut(t))[1])
    found = {r.id: r.rid for r in spatial.join_knn(df, spatial.as_right(df), 1, exclude_same=True).collect()}
    searches = [p for p in written if "WindowGroupLimit" in p or "Window" in p]
    assert searches and not re.search(r"BroadcastHashJoin \[.*Inner", searches[0])
    for i, x, y in rows:
        assert found[i] == min((math.sqrt((b - x) ** 2 + (c - y) ** 2), j) for j, b, c in rows if j != i)[1]


def within_steps(rows, k):
    to = {}
    for a, b in rows:
        if a is not None and b is not None:
            to.setdefault(a, set()).add(b)
    wanted = set()
    for a in to:
        front, seen = {a}, set()
        for _ in range(k):
            front = {c for b in front for c in to.get(b, ())}
            seen |= front
        wanted |= {(a, b) for b in seen if a != b}
    return sorted(wanted)


def test_paths_of_a_dense_relation_are_not_listed(spark, monkeypatch):
    from wayfold.operators import graph

    rng = random.Random(11)
    dense = [(rng.randrange(60) * 10**12, rng.randrange(60) * 10**12) for _ in range(400)] + [(10**12, 10**12), (None, 0), (0, None), (7, 0), (7, 0)]
    sparse = [(i, i + 1) for i in range(400)] + [(400, 0), (5, 5), (None, 3), (3, None)]
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda t: (written.append(plan(t)), cut(t))[1])
    monkeypatch.setattr(graph, "ORIGINS", 17)
    for rows, bitmaps in ((dense, True), (sparse, False)):
        edges = spark.createDataFrame(rows, "a long, b long")
        for k in (1, 2, 3):
            written.clear()
            found = graph.k_step(edges, k, "a", "b")
            assert found.columns == ["a", "b"]
            assert sorted((r.a, r.b) for r in found.collect()) == within_steps(rows, k)
            assert sum("bitmap_or_agg" in p for p in written) == (k - 1 if bitmaps else 0)


def test_dense_relations_between_known_nodes_are_written_as_words(spark, monkeypatch):
    """Nodes with places: neither edges nor paths are written one by one, whatever the ids, their repeats and their gaps."""
    from wayfold.operators import graph

    rng = random.Random(12)
    dense = [(3 * rng.randrange(200), 3 * ((rng.randrange(200) + 90) % 200)) for _ in range(3000)] + [(3, 3), (None, 0), (0, None), (6, 9), (6, 9)]
    sparse = [(3 * i, 3 * i + 3) for i in range(199)] + [(5, 5), (None, 3), (3, None)]
    nodes = spark.createDataFrame([(i, i % 7) for i in range(600)] + [(0, 5), (9, None), (None, 1)], "node long, place long")
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda t: (written.append((t.columns, plan(t))), cut(t))[1])
    monkeypatch.setattr(graph, "ORIGINS", 50)
    monkeypatch.setattr(graph, "LISTED", 1000)
    for rows, bitmaps in ((dense, True), (sparse, False)):
        edges = spark.createDataFrame(rows, "a long, b long")
        for k in (1, 2, 3):
            written.clear()
            found = graph.k_step(edges, k, "a", "b", nodes=nodes)
            assert found.columns == ["a", "b"]
            assert sorted((r.a, r.b) for r in found.collect()) == within_steps(rows, k)
            assert sum("bitmap_or_agg" in p for _, p in written) == (k - 1 if bitmaps else 0)
            assert not bitmaps or not any({"o", "d"} & set(columns) for columns, _ in written)


def test_edges_beside_the_given_nodes_are_refused(spark):
    from wayfold.operators import graph

    edges, nodes = spark.createDataFrame([(1, 2), (2, 3)], "o long, d long"), spark.createDataFrame([(1, 0), (2, 0)], "node long, place long")
    with pytest.raises(Exception, match="ends at none of the nodes"):
        graph.k_step(edges, 2, nodes=nodes)


def test_products_of_bitmaps_take_rows_together():
    """Runs of 64 and 8 neighbours, whole or with gaps, and blocks that are all reached: the same bits as row by row."""
    import numpy as np
    import pyarrow as pa

    from wayfold.operators import graph

    rng = np.random.default_rng(4)

    def bitmaps(rows):
        return pa.array([np.packbits(r, bitorder="little").tobytes() for r in rows], type=pa.binary())

    held = np.concatenate([np.arange(256), np.arange(300, 420, 2), [5000, 32767]])
    reach = np.zeros((len(held), graph.BITS), dtype=bool)
    reach[np.arange(len(held)), rng.integers(0, graph.BITS, len(held))] = True
    asked = np.zeros((6, graph.BITS), dtype=bool)
    asked[0, :256] = True
    asked[1, 3:250] = True
    asked[2] = True
    asked[3] = rng.random(graph.BITS) < 0.5
    asked[4, 421:4000] = True  # nobody there
    asked[5, [7, 5000, 32767]] = True
    mine = pa.table([pa.array(range(1, 7), type=pa.int64()), pa.array([9] * 6, type=pa.int64()), bitmaps(asked)], names=["_a", "_block", "_bits"])
    theirs = pa.table([pa.array(held + graph.BITS + 1, type=pa.int64()), bitmaps(reach)], names=["_row", "_held"])
    found = graph._product(mine, theirs).to_pydict()
    wanted = {i + 1: reach[asked[i][held]].any(axis=0) for i in range(6)}
    assert found["_a"] == [1, 2, 3, 4, 6] and found["_block"] == [9] * 5
    for a, bits in zip(found["_a"], found["_bits"]):
        assert (np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little").astype(bool) == wanted[a]).all()


def test_near_places_have_near_positions(spark):
    from wayfold.functions.geom import z_order

    rows = [(x, y) for x in range(-4, 4) for y in range(-4, 4)]
    points = spark.createDataFrame([(10.0 * x + 3, 10.0 * y + 3) for x, y in rows], "x double, y double")
    found = [r.z for r in points.select(z_order(F.col("x"), F.col("y"), 10.0).alias("z")).collect()]
    plain = [sum(((x & 0x7FFFFFFF) >> i & 1) << 2 * i | ((y & 0x7FFFFFFF) >> i & 1) << 2 * i + 1 for i in range(31)) for x, y in rows]
    assert found == plain and len(set(found)) == 64


def test_bitmaps_of_several_blocks(spark):
    from wayfold.operators import graph

    rows = [(i, i + 1) for at in (0, 16383, 32766, 39990) for i in range(at, at + 4)] + [(39994, 0), (2, 39999), (32768, 16384), (39999, 5)]
    edges, nodes = spark.createDataFrame(rows, "o long, d long"), spark.range(40000).withColumnRenamed("id", "node")
    found = graph._k_step_bitmaps(edges, nodes, 40000, 3).collect()
    assert sorted((r.o, r.d) for r in found) == within_steps(rows, 3)


def test_only_points_with_sparse_surroundings_search_far_cells(spark, monkeypatch):
    crowd, asking = scattered(2000, 6), scattered(100, 7, 3000.0, 3000.0, 14000.0)
    searched, search = [], spatial._candidates_by_cell
    monkeypatch.setattr(spatial, "_candidates_by_cell", lambda left, *args: (searched.append(left.count()), search(left, *args))[1])
    # Half of the points ask for a class that nothing serves.
    left = spark.createDataFrame([(i, x, y, 20, i % 2) for i, x, y in asking], "id long, x double, y double, k int, klass int")
    right = spark.createDataFrame([(i, x, y, 1) for i, x, y in crowd], "rid long, rx double, ry double, serves int")
    found = {}
    for r in spatial.join_knn(left, right, "k", by=("klass", "serves")).collect():
        found.setdefault(r.id, {})[r.nth] = r.rid
    assert searched == []
    assert sorted(found) == [i for i, _, _ in asking if i % 2]
    for i, x, y in asking:
        if i % 2:
            best = sorted((math.sqrt((rx - x) ** 2 + (ry - y) ** 2), rid) for rid, rx, ry in crowd)[:20]
            assert [found[i][n] for n in range(1, 21)] == [rid for _, rid in best]


def test_rows_that_share_an_id_are_searched_apart(spark, monkeypatch):
    asking = scattered(20, 8)
    asking += [(i, x + 10.0, y) for i, x, y in asking[:3]]
    calls, search = [], spatial.join_knn
    monkeypatch.setattr(spatial, "join_knn", lambda *args: (calls.append((args[-1], args[0].count())), search(*args))[1])
    left = spark.createDataFrame([(i if i != 19 else None, x, y, 2) for i, x, y in [*asking, asking[19]]], "id long, x double, y double, k int")
    right = spark.createDataFrame(scattered(300, 9), "rid long, rx double, ry double")
    found = search(left, right, "k").collect()
    assert calls == [(False, 18), (True, 6)]  # rows without an id find nothing
    assert sorted({r.id for r in found}) == list(range(19))


def test_rings_are_cut_where_they_lie(spark, monkeypatch):
    """Rings are not shuffled to the few buckets of the windows (F12)."""
    from wayfold.operators import shapes

    schema = "id int, ring array<struct<x: double, y: double>>"
    round_ring = [(50 + 40 * math.cos(t), 50 + 40 * math.sin(t)) for t in (2 * math.pi * k / 700 for k in range(700))]
    rows = [(1, [(1.0, 1.0), (9.0, 1.0), (9.0, 3.0)]), (2, []), (3, None), (4, [(0.0, 0.0), (200.0, 0.0), (200.0, 200.0), (0.0, 200.0)]), (5, round_ring), (1, [(1.0, 1.0), (9.0, 1.0), (9.0, 3.0)])]
    rings = spark.createDataFrame(rows, schema)
    window = spark.createDataFrame([(0.0, 80.0, 2.0, 90.0)], "wxmin double, wxmax double, wymin double, wymax double")
    cells = shapes.covered_cells(shapes.clip_rings(rings.repartition(3), window), 10.0)
    assert "SortMergeJoin" not in plan(cells) and "hashpartitioning" not in plan(cells)
    assert cells.columns == ["id", "col", "row_no", "area"] and [k for _, k in cells.dtypes] == ["int", "bigint", "bigint", "double"]
    sums = {r.id: (r.n, r.area) for r in cells.groupBy("id").agg(F.count("*").alias("n"), F.sum("area").alias("area")).collect()}
    assert sums.keys() == {1, 4, 5}
    assert sums[1] == (2, pytest.approx(4.0)) and sums[4] == (8 * 9, pytest.approx(80.0 * 88.0))
    assert sums[5][1] == pytest.approx(area_left_of(round_ring, 80.0), rel=1e-9)
    monkeypatch.setattr(shapes, "CORNERS", 5)
    few = shapes.covered_cells(shapes.clip_rings(rings, window), 10.0)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, cells.collect()))


def area_left_of(ring, x):
    """Area of a convex ring left of a vertical line."""
    left = []
    for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
        if p[0] <= x:
            left.append(p)
        if (p[0] - x) * (q[0] - x) < 0:
            left.append((x, p[1] + (x - p[0]) / (q[0] - p[0]) * (q[1] - p[1])))
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(left, left[1:] + left[:1], strict=True))) / 2


def square(g, x, y, w, turned=False):
    ring = [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    ring = ring[::-1] if turned else ring
    return [(g, *p, *q) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]


def test_rings_of_few_edges_need_no_rounds(spark, monkeypatch):
    """Small groups are walked in their task; large ones and those whose rings touch go on by joins, with the same rows (F15)."""
    from wayfold.operators import overlay, shapes

    edges = [e for g in range(40) for e in square(g, 3.0 * g, 1.0, 2.0) + square(g, 3.0 * g + 0.5, 1.5, 1.0, True)]
    edges += edges[:8] + square(50, 0.0, 0.0, 1.0) + square(50, 1.0, 1.0, 1.0) + square(None, 0.0, 0.0, 1.0)
    wide = [(math.cos(2 * math.pi * k / 300), math.sin(2 * math.pi * k / 300)) for k in range(300)]
    edges += [(60, *p, *q) for p, q in zip(wide, wide[1:] + wide[:1], strict=True)]
    df = spark.createDataFrame(edges, "g int, x1 double, y1 double, x2 double, y2 double")
    rows = lambda found: sorted((r.g, tuple(r.head), [tuple(p) for p in r.ring]) for r in found.collect())
    walked = rows(shapes.outline_rings(df, ["g"], 2.0))
    assert walked == rows(shapes._rings_by_joins(df, ["g"], 2.0))
    assert len(walked) == 40 * 2 + 2 + 1
    monkeypatch.delattr(shapes, "_rings_by_joins")
    boxes = [(i, [(9.0 * i, 0.0), (9.0 * i + 4, 0.0), (9.0 * i + 4, 4.0), (9.0 * i, 4.0)]) for i in range(30)]
    layer = spark.createDataFrame(boxes, "id long, ring array<struct<x: double, y: double>>")
    mask = spark.createDataFrame([(1, [(2.0, -1.0), (500.0, -1.0), (500.0, 3.0), (2.0, 3.0)])], "mask long, ring array<struct<x: double, y: double>>")
    assert overlay.clip_polygons(layer, mask, 16.0).count() == 30


def test_no_table_that_grows_is_broadcast_for_nearest_points(spark, monkeypatch):
    """Groups with their cells, answers and crowded buckets are shuffled, whatever their size is on disk (F16)."""
    from wayfold.operators import network

    written, real = [], spatial.cut
    monkeypatch.setattr(spatial, "cut", lambda df: written.append(plan(df)) or real(df))
    rng = random.Random(3)
    nodes = [(i, 50.0 * rng.random(), 50.0 * rng.random(), i % 5, True, 1) for i in range(2000)] + [(5000, 4e4, 4e4, 1, True, 2)]
    zones = [(i, x, y, 1) for i, x, y in scattered(60, 5)] + [(0, 9.0, 9.0, 1), (None, 5.0, 5.0, 1)]
    nodes = spark.createDataFrame(nodes, "node_id long, x double, y double, zk_type int, reachable boolean, island int")
    zones = spark.createDataFrame(zones, "id long, x double, y double, island int")
    found = network.zone_category(zones.repartition(2), nodes.repartition(2))
    assert len(written) > 5 and not [p for p in [*written, plan(found)] if "Broadcast" in p]
    assert found.filter("distance < 99999").count() > 40


@pytest.mark.parametrize("wanted", [0, 3, 70])
def test_edges_pass_the_completion_of_suppliers_without_a_shuffle(spark, tmp_path, wanted):
    """Origins with many, few and no suppliers, one-way edges, two levels: as counted by hand, with and without word that no edge is there twice."""
    from wayfold.operators import odlines

    rng = random.Random(wanted)
    zones = [(i, i % 5, rng.uniform(0, 100), rng.uniform(0, 100), i % 7 != 3, True) for i in range(120)] + [(None, 4, 1.0, 1.0, True, True), (500, 4, 2.0, 3.0, True, True)]
    edges = {(level, a, b) for level in (2, 4) for a in range(100) for b in rng.sample(range(120), (0, 1, 2, 3, 5, 40)[a % 6]) if a != b}
    tier, where = {z[0]: z[1] for z in zones}, {z[0]: (z[2], z[3]) for z in zones}
    told = {z[0] for z in zones if z[4] and z[0] is not None}
    wanted_rows = set(edges)
    for level in (2, 4):
        for o in (i for i in told if tier[i] == level):
            mine = {d for n, a, d in edges if n == level and a == o}
            lacks = wanted - sum(d in told and tier[d] < level for d in mine)
            offers = sorted((math.dist(where[o], where[s]), s) for s in told if tier[s] < level and s not in mine)
            for _, d in offers[: max(lacks, 0)]:
                wanted_rows |= {(level, o, d), (level, d, o)}
    frame = spark.createDataFrame(zones, "no long, type_no int, x double, y double, is_from boolean, is_to boolean")
    once, twice = (spark.createDataFrame(sorted(edges) * n, "level int, o long, d long") for n in (1, 2))
    for rows, distinct in ((once, True), (twice, False)):
        found = odlines.complete_suppliers(stored(rows, tmp_path / str(distinct)), frame, wanted, distinct)
        assert sorted((r.level, r.o, r.d) for r in found.collect()) == sorted(wanted_rows)
        assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate") != distinct


def test_completed_suppliers_of_repeated_zones_are_told_once(spark, tmp_path):
    from wayfold.plans import catalog

    catalog.load()
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").collect()]
    for name, some in (("once", rows), ("twice", rows + rows[:4])):
        (tmp_path / name).mkdir()
        spark.createDataFrame(some, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / name / "supplier.parquet"))
    once, twice = (sorted(map(tuple, catalog.QUERIES["O04_supplier_completion"](spark, str(tmp_path / n)).collect())) for n in ("once", "twice"))
    assert len(twice) == len(set(twice)) and len(once) == len(set(once)) > 0
