"""Hand-made cases and brute-force comparisons for operators whose result is more than one SQL statement."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import names
from wayfold.operators import common, graph, grid, network, odlines, places, pois, raster, spatial, zones


def points(spark, rows, schema="id long, x double, y double"):
    return spark.createDataFrame(rows, schema)


def crowd(n, seed, extent=20000.0):
    """Points of which a third lie in one place-sized spot."""
    rng = random.Random(seed)
    spot = [(i, 5000.0 + rng.random() * 40, 5000.0 + rng.random() * 40) for i in range(n // 3)]
    return spot + [(i, rng.random() * extent, rng.random() * extent) for i in range(n // 3, n)]


def dist(a, b):
    return math.hypot(a[1] - b[1], a[2] - b[2])


def components(pts, linked):
    parent = {p[0]: p[0] for p in pts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(pts):
        for b in pts[:i]:
            if linked(a, b):
                ra, rb = find(a[0]), find(b[0])
                parent[max(ra, rb)] = min(ra, rb)
    return {p[0]: find(p[0]) for p in pts}


def test_chain_is_one_component_and_five_km_is_not_near(spark):
    rows = [(i, 4000.0 * i, 0.0) for i in range(5)] + [(9, 16000.0 + 5000.0, 0.0)]
    got = {r.id: r.component for r in graph.proximity_components(points(spark, rows), 5000.0).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: 9}
    got = {r.id: r.component for r in graph.proximity_components(points(spark, rows), 5000.0, strict=False).collect()}
    assert got[9] == 0


@pytest.mark.parametrize("radius", [30.0, 400.0, 900.0])
def test_components_of_a_crowd(spark, radius):
    pts = crowd(300, 1)
    got = {r.id: r.component for r in graph.proximity_components(points(spark, pts), radius).collect()}
    assert got == components(pts, lambda a, b: dist(a, b) < radius)


def test_components_between_two_arcs_need_refinement(spark):
    """Two crowded rims face each other and come near in a single spot."""
    left = [(i, -120.0 + math.cos(t) * 40, math.sin(t) * 40) for i, t in enumerate([k * 0.05 for k in range(126)])]
    right = [(500 + i, 61.0 + math.cos(t) * 40, math.sin(t) * 40) for i, t in enumerate([k * 0.05 for k in range(126)])]
    pts = left + right
    for radius in (100.9, 101.1):
        got = {r.id: r.component for r in graph.proximity_components(points(spark, pts), radius).collect()}
        assert got == components(pts, lambda a, b: dist(a, b) < radius)


def test_long_chain_of_edges(spark):
    edges = spark.range(400).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = graph.connected_components(edges).select("component").distinct().collect()
    assert [r.component for r in got] == [0]


@pytest.mark.parametrize("few", [4, 10**9])
def test_existence_and_dominance_in_a_crowd(spark, few, monkeypatch):
    monkeypatch.setattr(spatial, "FEW", few)
    rng = random.Random(3)
    pts = [(*p, rng.randrange(20)) for p in crowd(400, 2)]
    df = points(spark, pts, "id long, x double, y double, s long")
    for radius in (25.0, 900.0):
        got = {r.id for r in spatial.not_dominated(df, radius, "s").collect()}
        assert got == {p[0] for p in pts if not any(q[3] > p[3] and dist(p, q) <= radius for q in pts)}
        left, right = pts[::2], pts[1::2]
        got = {r.id for r in spatial.exists_within(points(spark, left, df.schema), points(spark, right, df.schema), radius).collect()}
        assert got == {p[0] for p in left if any(dist(p, q) <= radius for q in right)}


def test_nearest_neighbours_of_a_crowd(spark):
    pts = crowd(240, 4)
    far = [(1000 + i, -90000.0 + 17.0 * i, 3.0 * i) for i in range(12)]
    right = points(spark, pts, "rid long, rx double, ry double")
    left = points(spark, pts + far)
    got = {}
    for r in spatial.join_knn(left, right, 4, exclude_same=True).collect():
        got.setdefault(r.id, {})[r.nth] = r.rid
    for p in pts + far:
        want = sorted((dist(p, q), q[0]) for q in pts if q[0] != p[0])[:4]
        assert [got[p[0]][i] for i in range(1, 5)] == [i for _, i in want]


def test_ranks_and_quantiles(spark):
    values = [(i, float(v)) for i, v in enumerate([5, 5, 5, 5, 1, 9, 2, 8, 8])]
    df = spark.createDataFrame(values, "id long, v double").repartition(4)
    ranked = {r.id: r["rank"] for r in common.with_rank(df, [F.col("v"), F.col("id")]).collect()}
    assert ranked == {i: n for n, (i, _) in enumerate(sorted(values, key=lambda t: (t[1], t[0])), 1)}
    row = common.exact_quantiles(df, "v", {"low": 0.0, "mid": 0.5, "q": 0.8, "high": 1.0}).first()
    assert (row.low, row.mid, row.high) == (1.0, 5.0, 9.0)
    assert row.q == pytest.approx(8.0)


def test_focal_maximum_with_missing_values(spark):
    px = spark.createDataFrame(
        [(0, 0, 3.0), (1, 0, 3.0), (2, 0, None), (1, 1, 1.0), (9, 9, None), (20, 20, 7.0)], "col long, row_no long, value double"
    )
    got = {(r.col, r.row_no): r.focal for r in raster.focal_max(px, 3).collect()}
    assert got == {(0, 0): 3.0, (1, 0): 3.0, (2, 0): 3.0, (1, 1): 3.0, (9, 9): None, (20, 20): 7.0}
    with pytest.raises(ValueError):
        raster.focal_max(px, 4)


def test_name_keys(spark):
    rows = ["Foo Annex II", "foo", "Main Library 12", "A B C D", "campus"]
    got = [r.b for r in spark.createDataFrame([(r,) for r in rows], "n string").select(names.name_base(F.col("n")).alias("b")).collect()]
    assert got == ["foo", "foo", "library", "a b c", ""]


def greedy_tiers(rows, base_km, params):
    """The allocation one place after another."""
    gen, dual = 1 - params.pop_tolerance / 100, 1 - params.dual_tolerance / 100
    taken, out = [], {}
    for p in sorted(rows, key=lambda r: (-r["cmi"], r["id"])):
        if p["role"] == "Secondary":
            out[p["id"]] = (4, "-", -1)
            continue
        f = dual if p["role"] == "Primary" else gen
        cut_ = min(float(params.distance_tolerance), (p["rel_density"] - 1) * 5) if p["rel_density"] > 1 else 0.0
        r = [base_km * k * 1000 * (1 - cut_ / 100) for k in places.RADIUS_FACTORS]
        d = lambda q: math.hypot(p["x"] - q["x"], p["y"] - q["y"])
        near = lambda tiers, radius: [q for q, t in taken if t in tiers and d(q) < radius]
        blocker = next(((q["name"], t) for t, rad in ((0, r[0]), (1, r[1]), (2, r[2])) for q in near((t,), rad)), None)
        if p["eff_pop"] >= params.min_pop[0] * f and not near((0,), r[0]):
            tier = 0
        elif p["eff_pop"] >= params.min_pop[1] * f and not near((0, 1), r[1]):
            tier = 1
        elif p["eff_pop"] >= params.min_pop[2] * f and not near((0, 1, 2), r[2]):
            tier = 2
        else:
            inside = near((0, 1, 2, 3), r[3])
            tier = 4 if inside else 3
            if inside and blocker is None:
                third = near((3,), r[3])
                blocker = (third[0]["name"], 3)
        if tier < 4:
            taken.append((p, tier))
        out[p["id"]] = (tier, *(blocker or ("-", -1)))
    return out


@pytest.mark.parametrize("seed,extent,base", [(1, 120000.0, 30.0), (2, 60000.0, 60.0)])
def test_tier_allocation_equals_the_sequential_order(spark, seed, extent, base):
    rng = random.Random(seed)
    rows = []
    for i in range(220):
        pop = int(10 ** rng.uniform(3.5, 6.1))
        role = rng.choices(["None", "Primary", "Secondary"], [8, 1, 1])[0]
        rel = rng.uniform(0.2, 4.0)
        rows.append(
            dict(id=i, name=f"P{i}", x=rng.random() * extent, y=rng.random() * extent, pop=pop, zone_no=2000001, role=role, primary_name="P0",
                 eff_pop=float(pop), density=rel * 100, rel_density=rel, cmi=float(pop) * rel, base_km=base)
        )
    schema = "id long, name string, x double, y double, pop long, zone_no long, role string, primary_name string, eff_pop double, density double, rel_density double, cmi double, base_km double"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    params = places.TierParams()
    got = {r.id: (r.type_no, r.in_catchment_of, r.catchment_level) for r in places.allocate_tiers(df, params).collect()}
    assert got == greedy_tiers(rows, base, params)


def test_duplicates_in_one_spot(spark):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        spot = i % 3 == 0
        x, y = (rng.random() * 60, rng.random() * 60) if spot else (rng.random() * 900, rng.random() * 900)
        name = rng.choice(["city hall", "city halls", "citi hall", "town house", "abc", "abd"])
        rows.append((i, rng.choice([i, 7]), x, y, "GOVERNMENT", "townhall", name, rng.choice("AB")))
    schema = "fid long, osm_id long, x double, y double, sector string, main_tag string, name_base string, classification string"
    got = {r.fid for r in pois.duplicate_pois(spark.createDataFrame(rows, schema)).collect()}

    def lev(a, b):
        last = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            now = [i]
            for j, cb in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (ca != cb)))
            last = now
        return last[-1]

    def beaten(a, b):
        alike = a[6] == b[6] if min(len(a[6]), len(b[6])) <= 5 else lev(a[6], b[6]) < 3
        rank = lambda p: (p[7], len(p[6]), p[1], p[0])
        return a[1] != b[1] and alike and math.hypot(a[2] - b[2], a[3] - b[3]) <= 250 and rank(b) > rank(a)

    assert got == {a[0] for a in rows if any(beaten(a, b) for b in rows)}


def test_imputation_cases(spark):
    ways = spark.createDataFrame(
        [(1, "primary", "80", "2"), (2, "primary", None, None), (3, "primary", "signals", "12"), (4, "primary", "999", "x"), (5, "primary", None, "1"),
         (6, "service", None, None), (7, "primary", "70 km/h", None)],
        "way_id long, highway string, maxspeed string, lanes string",
    )
    nodes = spark.createDataFrame(
        [(1, 1, 10), (1, 2, 11), (2, 1, 11), (2, 2, 12), (3, 1, 12), (3, 2, 13), (4, 1, 13), (4, 2, 14), (5, 1, 14), (5, 2, 15), (6, 1, 10), (6, 2, 11), (7, 1, 30), (7, 2, 31)],
        "way_id long, seq int, node_id long",
    )
    got = {r.way_id: r for r in network.impute_from_neighbours(ways, nodes).collect()}
    mean = (80 + 999 + 70) / 3
    assert got[1].speed_now == 80 and got[7].speed_now == 70
    # The neighbour's 80 is far from the mean that the 999 pulls up, so the mean is taken, cut to whole.
    assert got[2].speed_now == int(mean) and got[2].speed_text.startswith("[Neighbor-No-Match] Neighbor ID 1 (80 km/h)")
    assert got[3].speed_now == int(mean) and "Invalid (signals)" in got[3].speed_text
    assert got[4].speed_now == int(mean) and "Unplausible" in got[4].speed_text
    assert got[2].lanes_now == 5 and got[2].lanes_text.startswith("[Neighbor-No-Match]")  # mean of 2, 12 and 1
    assert got[6].speed_now == 130 and got[6].lanes_now == 2


def test_blocked_oneway_and_uturn(spark):
    links = spark.createDataFrame(
        [(1, 1, 2, 30, "BUS"), (1, 2, 1, 30, "CAR,BUS"), (2, 2, 3, 30, "CAR"), (2, 3, 2, 30, "CAR"), (3, 3, 4, 94, ""), (3, 4, 3, 94, "CAR")],
        "no long, from_node long, to_node long, type_no int, tsys string",
    )
    got = {(r.no, r.from_node): r.type_no for r in network.mark_blocked_oneway(links).collect()}
    assert got == {(1, 1): 0, (1, 2): 30, (2, 2): 30, (2, 3): 30, (3, 3): 94, (3, 4): 94}


def test_ramp_between_two_classes_is_six(spark):
    rows = [(1, 1, 2, -1), (2, 9, 1, 1), (3, 8, 2, 3), (4, 20, 21, -1), (5, 19, 20, 2), (6, 18, 20, 3), (7, 17, 21, 4)]
    links = spark.createDataFrame(rows, "no long, from_node long, to_node long, uclass int")
    got = {r.no: r.classes for r in network.ramp_components(links).collect()}
    assert got == {1: "6", 4: "2,3,4"}


def plain_final_classes(links):
    """(no, from_node): final class of each directed link (no, from_node, to_node, gtype, uclass, length, name), by loops."""

    def parts(edges):
        root = {n: n for e in edges for n in e}
        for _ in root:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    ramps = {(r[0], r[1], r[2]) for r in links if r[4] == -1}
    at, several = parts([r[1:] for r in ramps]), set()
    for component in set(at.values()):
        mine = {r for r in ramps if at[r[1]] == component}
        met = [c for a, b in {r[1:] for r in mine} for n in (a, b) for c in {x[4] for x in links if x[2] == n and 0 <= x[4] <= 5}]
        several |= mine if len(met) != 2 and len(set(met)) > 1 else set()
    loops = [r for r in links if r[3] == network.RAMP_CLASS and r[:3] not in several]
    at, turns = parts([r[1:3] for r in loops]), set()
    for component in set(at.values()):
        mine = [r for r in loops if at[r[1]] == component]
        edges = {}
        for r in mine:
            edges[frozenset(r[1:3])] = max(edges.get(frozenset(r[1:3]), 0.0), r[5])
        names = {x[6] for x in links for r in mine if x[6] and x[2] in r[1:3]}
        turns |= {r[0] for r in mine} if len(names) == 1 and sum(edges.values()) <= 0.05 + 1e-12 else set()
    return {(r[0], r[1]): 88 if r[0] in turns and r[3] != 99 else r[3] for r in links}


def test_final_classes_of_all_roads(spark):
    """Ramps beside roads of every class; the data decide over names, lengths and classes met."""
    rng, rows, no = random.Random(5), [], 0
    for spot in range(150):
        node = [10 * spot + k for k in range(4)]
        for a, b in [(0, 1), (1, 2)][: rng.choice([1, 1, 2])]:
            no += 1
            rows += [(no, node[x], node[y], 77, -1, rng.choice([0.01, 0.025, 0.04]), "") for x, y in ((a, b), (b, a))]
        for _ in range(rng.choice([1, 1, 2])):
            no, gtype, name, to = no + 1, rng.choice([1, 2, 3, 5, 99]), rng.choice(["", "A", "A", "B"]), rng.choice(node[:3])
            rows += [(no, x, y, gtype, gtype, 0.03, name) for x, y in ((node[3], to), (to, node[3]))]
    links = spark.createDataFrame(rows, "no long, from_node long, to_node long, gtype int, uclass int, length double, name string")
    turns = network.uturn_links(links, network.ramp_components(links))
    want = plain_final_classes(rows)
    assert {(r.no, r.from_node): r["class"] for r in network.link_class(links, turns).collect()} == want
    assert 0 < sum(c == 88 for c in want.values()) < sum(r[3] == 77 for r in rows)


def test_final_classes_are_registered_for_all_roads(spark):
    from tests.check import compare, connect
    from wayfold.plans import catalog

    catalog.load()
    folder = "/root/testdata/sf0.001"
    for name in ("N11_uturn_links_all_roads", "N09_final_link_classes_all_roads"):
        frame, cursor = catalog.QUERIES[name](spark, folder), connect(folder).execute(catalog.CHECKS[name])
        rows = [tuple(r) for r in frame.collect()]
        assert compare(frame.columns, rows, [d[0] for d in cursor.description], cursor.fetchall()) is None
    assert len(rows) == catalog.QUERIES["N07_blocked_oneway_reverse"](spark, folder).count()  # each direction of each link


def test_mutually_reachable_nodes_by_brute_force(spark):
    rng = random.Random(8)
    edges = [(a, rng.randrange(a // 20 * 20, a // 20 * 20 + 20)) for a in range(120) for _ in range(2)] + [(20 * k, 20 * k + 25) for k in range(5)]

    def reached(start, steps):
        seen, open_ = {start}, [start]
        while open_:
            node = open_.pop()
            new = {b for a, b in steps if a == node} - seen
            seen, open_ = seen | new, [*open_, *new]
        return seen

    degree = {n: sum(b == n for _, b in edges) for _, n in edges}
    want = set()
    for seed in sorted(degree, key=lambda n: (-degree[n], n))[:5]:
        want |= reached(seed, edges) & reached(seed, [(b, a) for a, b in edges])
    links = spark.createDataFrame(edges, "from_node long, to_node long")
    got = [r.node for r in network.reachable_nodes(links).collect()]
    assert sorted(got) == sorted(want) and 5 < len(want) < 120


def test_mutually_reachable_nodes_are_registered_for_all_roads(spark):
    from tests.check import compare, connect
    from wayfold.plans import catalog

    catalog.load()
    folder, name = "/root/testdata/sf0.001", "N13_mutually_reachable_nodes_all_roads"
    frame, cursor = catalog.QUERIES[name](spark, folder), connect(folder).execute(catalog.CHECKS[name])
    rows = [tuple(r) for r in frame.collect()]
    assert rows and compare(frame.columns, rows, [d[0] for d in cursor.description], cursor.fetchall()) is None


def test_four_passes_of_tier_competition(spark):
    rows = [
        (1, 0.0, 0.0, "Grid", 0, 9, 20.0, 1), (2, 1500.0, 0.0, "ADM", 0, 0, 0.0, None), (3, 10000.0, 0.0, "Grid", 0, 9, 10.0, 2),
        (4, 200000.0, 0.0, "ADM", 0, 0, 0.0, None), (5, 300000.0, 0.0, "Grid", 3, 9, 5.0, 7), (6, 300900.0, 0.0, "Grid", 3, 9, 6.0, 7),
        (7, 301200.0, 0.0, "ADM", 3, 3, 0.0, 7),
    ]
    schema = "id long, x double, y double, src string, target_tier int, type_no int, total_intensity double, no_e0 long"
    got = {r.id: r.type_no for r in zones.tier_competition(spark.createDataFrame(rows, schema)).collect()}
    # The centre beside the winner falls tier by tier; the weaker of two cells in one E0 cell becomes tier 4.
    assert got == {1: 0, 2: 4, 3: 9, 4: 0, 5: 4, 6: 3, 7: 4}


def delaunay(pts):
    """Pairs with an empty circle among all triples."""
    out = set()
    for a in pts:
        for b in pts:
            if a[0] >= b[0]:
                continue
            low, high, between = -math.inf, math.inf, False
            ux, uy = b[1] - a[1], b[2] - a[2]
            for c in pts:
                if c[0] in (a[0], b[0]):
                    continue
                side = ux * (c[2] - a[2]) - uy * (c[1] - a[1])
                num = (c[1] - a[1]) * (c[1] - b[1]) + (c[2] - a[2]) * (c[2] - b[2])
                if side < 0:
                    low = max(low, num / side)
                elif side > 0:
                    high = min(high, num / side)
                elif num < 0:
                    between = True
            if not between and low < high:
                out |= {(a[0], b[0]), (b[0], a[0])}
    return out


@pytest.mark.parametrize("n", [9, 60])
def test_natural_neighbours(spark, n, monkeypatch):
    monkeypatch.setattr(odlines, "FILLED", 2)
    monkeypatch.setattr(odlines, "CROWDED", 4)
    rng = random.Random(n)
    if n == 9:
        pts = [(i, 100.0 * (i % 3) + rng.random() * 9, 100.0 * (i // 3) + rng.random() * 9) for i in range(9)]
    else:
        pts = [(i, rng.random() * 30, rng.random() * 30) for i in range(20)] + [(i, rng.random() * 5000, rng.random() * 5000) for i in range(20, n)]
    df = spark.createDataFrame([(0, *p) for p in pts], "level int, no long, x double, y double")
    assert {(r.o, r.d) for r in odlines.neighbour_edges(df).collect()} == delaunay(pts)


def test_identical_coordinates_are_rejected(spark):
    rows = [(i, 0, float(i % 2), 0.0, True, True) for i in range(4)]
    with pytest.raises(ValueError):
        odlines.level_zones(spark.createDataFrame(rows, "no long, type_no int, x double, y double, is_from boolean, is_to boolean"))


def test_selection_rules(spark):
    actions = spark.createDataFrame([(1, 7, "PA"), (2, 7, "PA"), (3, 8, "PA"), (4, 8, "IA1"), (5, 9, "IA2"), (6, 9, "IA2"), (7, 9, "IA2")], "seq long, cell_id long, mode string")
    assert {(r.cell_id, r.mode) for r in grid.apply_selection(actions).collect()} == {(7, "PA"), (8, "IA1"), (9, "IA2")}
    assert {(r.cell_id, r.mode) for r in grid.apply_selection(actions, toggle=True).collect()} == {(8, "IA1"), (9, "IA2")}
    assert not grid.selection_is_exclusive(actions) and grid.selection_is_exclusive(grid.apply_selection(actions))
    cell = spark.createDataFrame([(7, "PA", 0.0, 9.0, 0.0, 9.0)], "id long, area_type string, xmin double, xmax double, ymin double, ymax double")
    assert [grid.subdivide(cell.withColumn("area_type", F.lit(m))).count() for m in ("PA", "IA1", "IA2", "XX")] == [81, 9, 1, 0]
    with pytest.raises(ValueError):
        grid.cells_per_side(300.0, 4500.0)
    assert grid.cells_per_side(30.0, 4500.0) == 15


def test_outline_of_cells_touching_at_a_corner(spark):
    from wayfold.operators import shapes

    cells = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("b", 5, 5), ("b", 6, 5), ("b", 5, 6), ("b", 7, 5)], "mode string, ix long, iy long")
    rings = shapes.outline_rings(grid.dissolve_edges(cells, ["mode"]), ["mode"], 10.0).collect()
    sizes = sorted((r.mode, len(r.ring)) for r in rings)
    assert sizes == [("a", 4), ("a", 4), ("b", 10)]


def test_clip_to_several_windows(spark):
    boxes = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 10.0), (2, 50.0, 60.0, 50.0, 60.0), (3, 90.0, 91.0, 0.0, 1.0)], "id long, xmin double, xmax double, ymin double, ymax double")
    windows = spark.createDataFrame([(5.0, 55.0, 5.0, 55.0), (58.0, 70.0, 40.0, 70.0)], "wxmin double, wxmax double, wymin double, wymax double")
    found = sorted(tuple(r) for r in spatial.clip_boxes(boxes, windows).collect())
    assert found == [(1, 5.0, 10.0, 5.0, 10.0), (2, 50.0, 55.0, 50.0, 55.0), (2, 58.0, 60.0, 50.0, 60.0)]


def test_nearest_of_a_class_far_from_a_crowd(spark):
    import math
    import random

    rng = random.Random(2)
    rights = [(k, rng.gauss(0, 5), rng.gauss(0, 5), k % 40 == 0) for k in range(3000)] + [(5000, 900.0, 900.0, True)]
    lefts = [(k, rng.uniform(-300, 900), rng.uniform(-300, 900), k % 2 == 0) for k in range(60)]
    left = spark.createDataFrame([(a, x, y, c) for a, x, y, c in lefts], "id long, x double, y double, c boolean")
    right = spark.createDataFrame([(a, x, y, c) for a, x, y, c in rights], "rid long, rx double, ry double, rc boolean")
    passed = {(a, min((math.dist((x, y), (u, w)), b) for b, u, w, d in rights if d == c)[1]) for a, x, y, c in lefts}
    skip = spark.createDataFrame(sorted(passed), "id long, rid long")
    found = {(r.id, r.nth): r.rid for r in spatial.join_knn(left, right, 3, skip=skip, by=("c", "rc")).collect()}
    for a, x, y, c in lefts:
        order = sorted((math.dist((x, y), (u, w)), b) for b, u, w, d in rights if d == c and (a, b) not in passed)
        assert [found[a, n] for n in (1, 2, 3)] == [b for _, b in order[:3]]


def test_existence_in_a_crowded_cell(spark):
    import math
    import random

    rng = random.Random(5)
    points = [(k, rng.gauss(0, 0.4), rng.gauss(0, 0.4), float(rng.randrange(40))) for k in range(1500)] + [(2000 + k, 0.25, 0.25, 7.0) for k in range(600)]
    asking = [(k, 0.999 * math.cos(k), 0.999 * math.sin(k), float(k % 50)) for k in range(120)]
    left = spark.createDataFrame(asking, "id long, x double, y double, v double")
    right = spark.createDataFrame(points, "id long, x double, y double, v double")
    for radius in (0.05, 0.3, 1.0):
        found = {r.id for r in spatial.exists_within(left, right, radius, margin="v").collect()}
        assert found == {a for a, x, y, v in asking if any(math.dist((x, y), (u, w)) <= radius and z > v for _, u, w, z in points)}


def test_directions_pair_with_the_other_one(spark):
    rows = [(1, 10, 20, "a"), (1, 10, 20, "b"), (1, 20, 10, "c"), (2, 5, 6, "d"), (2, 5, 6, "e")]
    links = spark.createDataFrame(rows, "no long, from_node long, to_node long, tsys string")
    found = sorted((r.no, r.tsys, r.rev_tsys) for r in network.with_reverse(links, ["tsys"]).collect())
    assert found == [(1, "a", "c"), (1, "b", "c"), (1, "c", "a"), (2, "d", None), (2, "e", None)]


def test_type_names_and_title_case(spark):
    from wayfold.functions import names

    rows = [("Motorway, 2 lanes",), ("Motorway",), ("Motorway, 9 lanes",), ("UnknownByImporter(Default)",), ("Mo 2",), ("Link Tr 1",), ("Other",)]
    df = spark.createDataFrame(rows, "name string").select(network.type_category(F.col("name")).alias("t"), network.old_type_category(F.col("name")).alias("o"))
    assert [tuple(r) for r in df.collect()] == [
        ("Motorway", "Motorway"), ("Motorway", "Unknown"), ("Motorway, 9 lanes", "Unknown"), ("UnknownByImporter", "UnknownByImporter"),
        ("Motorway", "Unknown"), ("Trunk_link", "Unknown"), ("Other", "Unknown"),
    ]
    titles = spark.createDataFrame([("a_b 3rd",), ("de/bad-würt<br/>TEMBERG o'neil",), (None,)], "n string").select(names.clean_region_name(F.col("n")).alias("n"))
    assert [r.n for r in titles.collect()] == ["A_B 3Rd", "Bad Würt Temberg O Neil", "unbekannter_name"]


def test_busy_tile_is_split(spark):
    """With low thresholds the join of very many points of one tile is split at run time."""
    keys = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "40",
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        at = spark.range(20000).selectExpr("id", "rand(1) * 100 AS x", "rand(2) * 90 AS y")
        pixels = spark.range(100).selectExpr("id % 10 AS col", "id div 10 AS row_no", "1.0D AS value")
        sums = raster.buffer_sum(at, pixels, 100.0, 500.0)
        sums.collect()
        assert "skew=true" in sums._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_components_of_a_hub(spark):
    edges = spark.range(3000).selectExpr("5000 AS u", "id AS v")
    found = graph.connected_components(edges, "u", "v").collect()
    assert len(found) == 3001 and {r.component for r in found} == {0}


def test_outlines_with_holes(spark):
    from wayfold.operators import osm

    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    rings = spark.createDataFrame([(square(0.0, 100.0), False), (square(20.0, 80.0), True)], "ring array<struct<x: double, y: double>>, hole boolean")
    pts = points(spark, [(1, 10.0, 10.0), (2, 50.0, 50.0), (3, 25.0, 50.0), (4, 104.0, 50.0), (5, 200.0, 50.0)])
    assert sorted(r.id for r in osm.extract_within(pts, rings, 30.0).collect()) == [1]
    assert sorted(r.id for r in spatial.clip_to_buffered_outline(pts, rings, 6.0, 30.0).collect()) == [1, 3, 4]


def test_finished_rounds_are_deleted(spark):
    import os

    from wayfold.session import cut, ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    edges = cut(spark.range(200).selectExpr("id AS u", "id + 1 AS v"))
    before = len(os.listdir(folder))
    assert graph.connected_components(edges, "u", "v").filter("component = 0").count() == 201
    assert len(os.listdir(folder)) <= before + 1


def plain_strong_components(edges):
    out = {n: {b for a, b in edges if a == n} for n in {x for e in edges for x in e}}
    reach = {}
    for start in out:
        seen, open_ = {start}, [start]
        while open_:
            new = out[open_.pop()] - seen
            seen |= new
            open_ += new
        reach[start] = seen
    return {n: min(m for m in reach[n] if n in reach[m]) for n in out}


def strong_components(spark, edges, **how):
    from wayfold.operators.graph import strong_components

    found = strong_components(spark.createDataFrame(edges, "src long, dst long"), **how).collect()
    assert len(found) == len({r.node for r in found})
    return {r.node: r.component for r in found}


def test_strong_components_by_brute_force(spark):
    """Many graphs beside each other in one table: sparse, dense, with loops, repeated edges, two-cycles, hubs and rings joined one way."""
    rng = random.Random(12)
    edges, base = [], 0
    for nodes, n in [(2, 2), (5, 7), (12, 14), (30, 36), (40, 55), (25, 120)] * 3:
        edges += [(base + rng.randrange(nodes), base + rng.randrange(nodes)) for _ in range(n)]
        base += 100
    rings = [(base + 10 * k + i, base + 10 * k + (i + 1) % 10) for k in range(6) for i in range(10)]
    edges += rings + [(base + 10 * k, base + 10 * k + 13) for k in range(5)] + [(base + 40, base + 3)]
    hub = base + 100
    edges += [(hub, hub + k) for k in range(1, 300)] + [(hub + k, hub) for k in range(1, 300, 2)]
    edges += [(base + 500, base + 500), (base + 501, base + 502), (base + 502, base + 501), (base + 501, base + 502)]
    assert strong_components(spark, edges) == plain_strong_components(edges)


def test_strong_components_of_long_paths_take_few_rounds(spark):
    """A path and a ring of 100,000 nodes: a round per node would never end; these rounds are a few times the logarithm."""
    n = 100_000
    steps = spark.range(n).selectExpr("id AS src", "id + 1 AS dst")
    ring = spark.range(n).selectExpr(f"id + {2 * n} AS src", f"(id + 1) % {n} + {2 * n} AS dst")
    from wayfold.operators import graph

    found = graph.strong_components(steps.unionByName(ring), rounds=60)
    got = found.selectExpr(f"CASE WHEN component = node THEN 0 WHEN component = {2 * n} THEN 1 ELSE 2 END AS kind", f"node >= {2 * n} AS in_ring")
    assert {(r.kind, r.in_ring, r["count"]) for r in got.groupBy("kind", "in_ring").count().collect()} == {(0, False, n + 1), (0, True, 1), (1, True, n - 1)}


def test_strong_components_stop_at_the_round_limit(spark):
    with pytest.raises(RuntimeError):
        strong_components(spark, [(k, k + 1) for k in range(500)], rounds=3)
    assert strong_components(spark, []) == {}


def test_natural_neighbours_of_odd_layouts(spark, monkeypatch):
    """Lines, lattices, slivers on the rim, a ring, far clusters and tiny sets, each a level of its own, against exact arithmetic."""
    from fractions import Fraction

    monkeypatch.setattr(odlines, "CROWDED", 8)
    rng = random.Random(21)
    spread = lambda n, w: {(rng.randrange(w), rng.randrange(w)) for _ in range(n)}
    layouts = [
        {(3 * k, 7 * k) for k in range(12)},  # one line
        {(10 * i, 10 * j) for i in range(5) for j in range(4)},  # cocircular fours
        {(k * 1000, k * (40 - k) // 40) for k in range(41)} | {(20_000, 5_000)},  # nearly straight rim, very far circle centres
        {(round(9000 * math.cos(k)), round(9000 * math.sin(k))) for k in range(30)} | {(0, 1)},
        spread(15, 20) | {(x + 900_000, y + 5) for x, y in spread(15, 20)},
        spread(60, 100_000),
        {(0, 0), (5, 0)}, {(4, 4)}, {(0, 0), (5, 0), (2, 9)},
    ]
    rows = [(level, no, float(x), float(y)) for level, pts in enumerate(layouts) for no, (x, y) in enumerate(sorted(pts))]
    found = odlines.neighbour_edges(spark.createDataFrame(rows, "level int, no long, x double, y double")).collect()
    for level, pts in enumerate(layouts):
        exact = [(no, Fraction(x), Fraction(y)) for no, (x, y) in enumerate(sorted(pts))]
        assert {(r.o, r.d) for r in found if r.level == level} == delaunay(exact), level


def plain_inside(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
            odd = not odd
    return odd


def plain_edge_distance(x, y, ring):
    def one(a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        length2 = dx * dx + dy * dy
        t = max(0.0, min(1.0, ((x - a[0]) * dx + (y - a[1]) * dy) / length2)) if length2 else 0.0
        return math.hypot(x - a[0] - t * dx, y - a[1] - t * dy)

    return min(one(a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


@pytest.mark.parametrize("size", [3.0, 10.0, 500.0])
def test_points_meet_the_edges_of_their_cell(spark, size):
    """Concave, crossing and flat rings, vertices and points on round coordinates, against every edge of every ring."""
    from wayfold.operators import outlines

    rng = random.Random(11)
    star = [(50 + r * math.cos(k), 50 + r * math.sin(k)) for k, r in ((2 * math.pi * i / 40, 45 if i % 2 else 12) for i in range(40))]
    rings = {
        0: star,
        1: [(0.0, 0.0), (90.0, 0.0), (90.0, 10.0), (20.0, 10.0), (20.0, 60.0), (90.0, 60.0), (90.0, 70.0), (0.0, 70.0)],
        2: [(0.0, 0.0), (100.0, 100.0), (100.0, 0.0), (0.0, 100.0)],
        3: [(float(rng.randint(0, 100)), float(rng.randint(0, 100))) for _ in range(30)],
        4: [(-40.0, -35.0), (-10.0, -35.0), (-25.0, -20.0), (-25.0, -20.0)],
    }
    spots = [(float(rng.randint(-50, 110)), float(rng.randint(-50, 110))) for _ in range(250)] + [(rng.uniform(-50, 110), rng.uniform(-50, 110)) for _ in range(250)]
    pts = points(spark, [(i, *p) for i, p in enumerate(spots)])
    shapes = spark.createDataFrame(list(rings.items()), "region int, ring array<struct<x: double, y: double>>")
    found = {(r.id, r.region): r.d for r in outlines.regions_within(pts, shapes, 7.0, size, ["region"]).collect()}
    # A point on an edge may fall to either side in rounding, but then its distance is 0 all the same.
    for i, (x, y) in enumerate(spots):
        for no, ring in rings.items():
            near = plain_edge_distance(x, y, ring)
            d = 0.0 if plain_inside(x, y, ring) else near
            if abs(near - 7.0) > 1e-9:
                assert ((i, no) in found) == (d <= 7.0), (i, no)
            if d <= 7.0 and near > 1e-9:
                assert found[i, no] == pytest.approx(d, abs=1e-9), (i, no)


def test_a_ring_of_many_vertices_is_not_copied(spark):
    from wayfold.operators import outlines

    n = 100_000
    wave = [(1000 + r * math.cos(a), 1000 + r * math.sin(a)) for a, r in ((2 * math.pi * i / n, 800 + 20 * math.sin(2 * math.pi * i / 97)) for i in range(n))]
    shape = spark.createDataFrame([(wave,)], "ring array<struct<x: double, y: double>>")
    cells = outlines.outline_cells(shape, 20.0).selectExpr("size(edges) AS n").agg(F.max("n").alias("most"), F.sum("n").alias("all"), F.count("*").alias("cells")).first()
    assert cells.most < n / 50 and cells["all"] < 2 * n and cells.cells < 101 * 101
    rng = random.Random(3)
    spots = [(i, rng.uniform(0, 2000), rng.uniform(0, 2000)) for i in range(300)]
    inside = spatial.points_in_rings(points(spark, spots), shape.withColumn("name", F.lit("wave")), 20.0)
    assert inside.columns == ["id", "x", "y", "name"]
    assert {r.id for r in inside.collect()} == {i for i, x, y in spots if plain_inside(x, y, wave)}


def test_countries_of_chains_that_go_in_circles(spark):
    from wayfold.operators import catalogue

    chain = [(f"r{i}", f"r{i + 1}" if i < 40 else "land", None) for i in range(41)]
    rows = [("land", "world", "LL"), ("world", None, None), *chain, ("a", "b", None), ("b", "c", "BB"), ("c", "a", None), ("land/d", "a", None), ("e", "gone", "EE"), ("f", "e", None)]
    found = {r.id: r.country for r in catalogue.region_countries(spark.createDataFrame(rows, "id string, parent string, alpha2 string")).collect()}
    assert found == {"land": "land", **{f"r{i}": "land" for i in range(41)}, "land/d": "land", "e": "e", "f": "e"}


def plain_clip(ring, keep):
    """The part of a convex ring on the side where keep(point) >= 0."""
    out = []
    for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
        a, b = keep(p), keep(q)
        if a >= 0:
            out.append(p)
        if a * b < 0:
            u = a / (a - b)
            out.append((p[0] + u * (q[0] - p[0]), p[1] + u * (q[1] - p[1])))
    return out


def plain_area(ring):
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))) / 2 if ring else 0.0


def test_strips_cover_their_line_only(spark):
    from wayfold.operators import osm, shapes

    rng = random.Random(21)
    paths = {i: [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(rng.randint(1, 4))] for i in range(25)}
    paths |= {30: [(10.0, 10.0), (10.0, 40.0), (30.0, 40.0), (30.0, 40.0), (20.0, 30.0)], 31: [(0.0, 0.0), (100.0, 100.0)], 32: []}
    lines = spark.createDataFrame(list(paths.items()), "id int, path array<struct<x: double, y: double>>")
    half, size, window = 0.5, 10.0, (5.0, 72.0, 8.0, 90.0)
    strips = osm.line_strips(lines, half)
    rings = {(r.id, r.part): [(v.x, v.y) for v in r.ring] for r in strips.collect()}
    segments = {(i, k): (p, q) for i, path in paths.items() for k, (p, q) in enumerate(zip(path, path[1:])) if p != q}  # noqa: B905
    assert rings.keys() == segments.keys()
    for key, (p, q) in segments.items():
        length = math.dist(p, q)
        assert plain_area(rings[key]) == pytest.approx((length + 2 * half) * 2 * half)
        u = ((q[0] - p[0]) / length, (q[1] - p[1]) / length)
        for x, y in rings[key]:
            along, across = (x - p[0]) * u[0] + (y - p[1]) * u[1], (x - p[0]) * u[1] - (y - p[1]) * u[0]
            assert min(abs(along + half), abs(along - length - half)) < 1e-9 and abs(abs(across) - half) < 1e-9
    box = spark.createDataFrame([window], "wxmin double, wxmax double, wymin double, wymax double")
    found = {(r.id, r.part, r.col, r.row_no): r.area for r in shapes.covered_cells(shapes.clip_rings(strips.select("id", "part", "ring"), box), size).collect()}
    expected = {}
    for (i, k), ring in rings.items():
        for col in range(10):
            for row in range(10):
                x0, x1 = max(col * size, window[0]), min((col + 1) * size, window[1])
                y0, y1 = max(row * size, window[2]), min((row + 1) * size, window[3])
                piece = ring if x0 < x1 and y0 < y1 else []
                for keep in (lambda p: p[0] - x0, lambda p: x1 - p[0], lambda p: p[1] - y0, lambda p: y1 - p[1]):  # noqa: B023
                    piece = plain_clip(piece, keep)
                if plain_area(piece) > 1e-9:
                    expected[i, k, col, row] = plain_area(piece)
    assert {k for k, a in found.items() if a > 1e-9} == expected.keys()
    assert all(found[k] == pytest.approx(a, abs=1e-9) for k, a in expected.items())
    # The slanted line meets the cells along it: one of each row and its neighbours at the corners.
    assert len([k for k in found if k[0] == 31]) < 30


def test_areas_are_polygons_with_holes(spark):
    """Islands in holes, holes that touch their ring, corners that touch: every cell's centre against the rings drawn."""
    import json

    from wayfold.operators import shapes

    pictures = {
        "PA": ["#########", "#.......#", "#.#####.#", "#.#...#.#", "#.#.#.#.#", "#.#...#.#", "#.#####.#", "#.......#", "#########", ".........", "##.......", "##......."],
        "IA1": ["####", "#.##", "##.#", "####"],
        "IA2": ["#.#", ".#.", "###"],
    }
    size, marks = 100.0, {m: {(x, y) for y, line in enumerate(p) for x, c in enumerate(line) if c == "#"} for m, p in pictures.items()}
    rows = [(m, x * size, (x + 1) * size, y * size, (y + 1) * size) for m, cells in marks.items() for x, y in cells]
    cells = spark.createDataFrame(rows, "mode string, xmin double, xmax double, ymin double, ymax double")
    features = {r.Bereich: r for r in shapes.area_features(cells, size).collect()}
    assert [features[m].id for m in ("PA", "IA1", "IA2")] == [1, 2, 3]
    assert {m: (f.n_polygons, f.n_holes) for m, f in features.items()} == {"PA": (4, 2), "IA1": (1, 1), "IA2": (3, 0)}
    for mode, feature in features.items():
        shape = json.loads(feature.geometry)
        assert shape["type"] == ("Polygon" if feature.n_polygons == 1 else "MultiPolygon")
        parts = [shape["coordinates"]] if shape["type"] == "Polygon" else shape["coordinates"]
        assert all(ring[0] == ring[-1] for part in parts for ring in part)
        drawn = [[[tuple(p) for p in ring[:-1]] for ring in part] for part in parts]
        for x in range(-1, 10):
            for y in range(-1, 13):
                at = ((x + 0.5) * size, (y + 0.5) * size)
                n = sum(plain_inside(*at, part[0]) and not any(plain_inside(*at, hole) for hole in part[1:]) for part in drawn)
                assert n == ((x, y) in marks[mode]), (mode, x, y)


def test_regions_near_in_kilometres(spark):
    """Slanted and concave outlines far north, against every edge of every ring: the nearest spot in degrees, measured on the globe."""
    from wayfold.operators import catalogue

    rng = random.Random(5)
    rings = {
        "a": [(10.0, 66.0), (12.5, 66.2), (11.0, 67.0), (12.0, 68.1), (9.5, 67.4)],
        "b": [(12.6, 66.0), (14.0, 66.4), (13.1, 67.9)],
        "a/x": [(10.5, 66.3), (11.5, 66.4), (10.9, 66.8)],
        "far": [(-30.0, -40.0), (-29.0, -40.0), (-29.5, -39.0)],
    }
    code = {"a": "AA", "b": "BB", "far": "FF"}
    regions = spark.createDataFrame([(i, None, code.get(i), ring) for i, ring in rings.items()], "id string, parent string, alpha2 string, ring array<struct<x: double, y: double>>")
    pts = [(i, rng.uniform(8.5, 15.5), rng.uniform(65.5, 68.6), "bb") for i in range(150)]
    found = catalogue.regions_near(spark.createDataFrame(pts, "id long, x double, y double, code string"), regions, 40.0, 0.3, degrees=True).collect()

    def km(p, q):
        half = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[0] - p[0]) / 2) ** 2
        return 6371.009 * 2 * math.asin(math.sqrt(half))

    def spot(x, y, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0.0, min(1.0, ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy)))
        return a[0] + t * dx, a[1] + t * dy

    def plain(x, y, ring):
        if plain_inside(x, y, ring):
            return 0.0
        spots = [spot(x, y, a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
        return km((x, y), min(spots, key=lambda s: math.hypot(s[0] - x, s[1] - y)))

    want = {}
    for i, x, y, _ in pts:
        d = {name: plain(x, y, ring) for name, ring in rings.items()}
        for country in ("a", "b"):
            near = [d[r] for r in d if r.split("/")[0] == country and d[r] <= 40.0]
            if near:
                want[i, country] = (min(near), d["a/x"] if country == "a" and d["a/x"] <= 40.0 else None)
    got = {(r.id, r.country): r for r in found}
    assert set(got) == set(want) and any(v[1] for v in want.values()) and {r.country for r in found} == {"a", "b"}
    for key, (nearest, sub) in want.items():
        assert got[key].country_distance == pytest.approx(nearest, abs=1e-6), key
        assert got[key].region_distance == (None if sub is None else pytest.approx(sub, abs=1e-6)), key
        assert got[key].country_rank == (1 if key[1] == "b" or (key[0], "b") not in want else 2), key


def test_wide_direct_lines(spark):
    """Two steps on the upper levels and five below, against plain walks over the natural neighbours."""
    rng = random.Random(9)
    rows = [(i, i % 5, rng.uniform(0, 1000), rng.uniform(0, 1000), i % 7 != 3, i % 11 != 5) for i in range(40)]
    zones = spark.createDataFrame(rows, "no long, type_no int, x double, y double, is_from boolean, is_to boolean")
    found = {(r.level, r.o, r.d) for r in odlines.direct_lines(zones, odlines.STEPS_WIDE).collect()}
    want, by_no = set(), {r[0]: r for r in rows}
    for level, steps in ((0, 2), (1, 2), (2, 2), (3, 5), (4, 5)):
        pairs = delaunay([(r[0], r[2], r[3]) for r in rows if r[1] <= level and (r[4] or r[5])])
        near = {}
        for o, d in pairs:
            near.setdefault(o, set()).add(d)
        for o in near:
            reached = {o}
            for _ in range(steps):
                reached |= {d for n in reached for d in near[n]}
            want |= {(level, o, d) for d in reached - {o} if (by_no[o][4] and by_no[d][5]) or (by_no[d][4] and by_no[o][5])}
    assert found == want and want


def test_city_names_without_an_address(spark):
    rows = [("Göttingen, Land",), (None,), ("",)]
    got = [r.c for r in spark.createDataFrame(rows, "a string").select(names.clean_city(F.col("a")).alias("c")).collect()]
    assert got == ["Goettingen", "unknown_place", ""]
