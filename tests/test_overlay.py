"""Polygons clipped to polygons, against areas added up between vertical lines and hand-made cases."""

import math
import random

import pytest

from pyspark.sql import functions as F

SCHEMA = "id long, ring array<struct<x: double, y: double>>, hole boolean"
MASKS = SCHEMA.replace("id long", "mask long")


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def edges_of(rings):
    return [(a, b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]


def shared_area(one, other):
    """Area inside both sets of rings: between neighbouring vertices and crossings the width inside both is linear in x."""
    sides = edges_of(one), edges_of(other)
    xs = {p[0] for side in sides for e in side for p in e}
    for (ax, ay), (bx, by) in sides[0]:
        for (cx, cy), (dx, dy) in sides[1]:
            den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if den:
                t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den
                u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
                if 0 <= t <= 1 and 0 <= u <= 1:
                    xs.add(ax + t * (bx - ax))
    xs, total = sorted(xs), 0.0

    def spans(side, x):
        ys = sorted(ay + (x - ax) / (bx - ax) * (by - ay) for (ax, ay), (bx, by) in side if (ax > x) != (bx > x))
        return list(zip(ys[::2], ys[1::2], strict=True))

    for low, high in zip(xs, xs[1:], strict=False):
        x = (low + high) / 2
        total += (high - low) * sum(max(0.0, min(b, d) - max(a, c)) for a, b in spans(sides[0], x) for c, d in spans(sides[1], x))
    return total


def signed(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in edges_of([ring])) / 2


def clip(spark, shapes, masks, size):
    from wayfold.operators.overlay import clip_polygons

    flat = lambda layer: [(i, [(float(x), float(y)) for x, y in ring], k > 0) for i, rings in layer.items() for k, ring in enumerate(rings)]
    rows, theirs = flat(shapes), flat(masks)
    found = {}
    for r in clip_polygons(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(theirs, MASKS), size).collect():
        plain = [[(p.x, p.y) for p in ring] for ring in (r.outer, *r.holes)]
        assert signed(plain[0]) > 0 and all(signed(h) < 0 for h in plain[1:])
        found.setdefault((r.id, r.mask), []).append(plain)
    return found


def area(parts):
    return sum(signed(ring) for part in parts for ring in part)


def star(cx, cy, wide, narrow, n, turn=0.0):
    return [(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in ((turn + math.pi * i / n, wide if i % 2 else narrow) for i in range(2 * n))]


@pytest.mark.parametrize("size", [7.0, 60.0])
def test_concave_polygons_with_holes(spark, size):
    rng = random.Random(4)
    shapes = {}
    for i in range(25):
        x, y = rng.uniform(0, 200), rng.uniform(0, 200)
        wide, turn = rng.uniform(10, 60), rng.uniform(0, 3)
        shapes[i] = [star(x, y, wide, wide * 0.4, rng.randint(3, 9), turn)]
        if i % 3 == 0:
            shapes[i].append(star(x, y, wide * 0.3, wide * 0.1, 4, turn)[:: (-1) ** i])
    masks = {
        100: [star(100, 100, 95, 40, 11, 0.1), star(100, 100, 30, 12, 5, 0.3)],
        200: [[(0.3, 0.7), (190.2, 3.1), (180.9, 40.4), (40.1, 50.6), (60.7, 190.3), (5.5, 150.2)]],
        300: [star(500, 500, 20, 10, 5)],
        400: [star(100, 100, 2000, 900, 6, 0.2)],
    }
    found = clip(spark, shapes, masks, size)
    for i, rings in shapes.items():
        for m, mask in masks.items():
            assert area(found.get((i, m), [])) == pytest.approx(shared_area(rings, mask), abs=1e-6), (i, m)
    assert not [k for k in found if k[1] == 300] and any(len(parts) > 1 for parts in found.values())


def test_parts_holes_and_shared_edges(spark):
    shapes = {
        1: [box(0, 0, 10, 10)],  # the mask itself
        2: [box(10, 0, 20, 10)],  # shares an edge from outside
        3: [box(10, 10, 20, 20)],  # touches a corner
        4: [box(-5, 2, 15, 4)],  # crosses the mask and its hole
        5: [box(-5, -5, 15, 15), box(-1, -1, 11, 11)],  # the mask lies in its hole
        6: [box(-5, -5, 15, 15)],  # holds the mask and its hole
        7: [box(2, 0, 5, 3)],  # edges on the rim and on the hole
        8: [box(3, 3, 7, 7)],  # the hole itself
        9: [box(4, 4, 6, 6)],  # inside the hole
        10: [box(0, 0, 10, 10), box(1, 1, 2, 2)],  # another hole
        11: [[(0, 0), (0, 10), (10, 10), (10, 0)]],  # the mask, the other way round
        12: [[(0, 0), (5, 0), (5, 0), (10, 0), (10, 10)]],  # a vertex twice
    }
    mask = {1: [box(0, 0, 10, 10), box(3, 3, 7, 7)]}
    found = {i: parts for (i, _), parts in clip(spark, shapes, mask, 4.0).items()}
    assert sorted(found) == [1, 4, 6, 7, 10, 11, 12]
    for i, parts in found.items():
        assert area(parts) == pytest.approx(shared_area(shapes[i], mask[1])), i
    assert {i: sorted(len(part) - 1 for part in parts) for i, parts in found.items()} == {1: [1], 4: [0], 6: [1], 7: [0], 10: [2], 11: [1], 12: [0]}
    split = clip(spark, {1: [box(-5, 4, 15, 6)]}, mask, 4.0)
    assert len(split[1, 1]) == 2 and area(split[1, 1]) == pytest.approx(12)


def test_empty_layers(spark):
    assert clip(spark, {1: [box(0, 0, 1, 1)]}, {2: [box(5, 5, 6, 6)]}, 2.0) == {}
    from wayfold.operators.overlay import clip_polygons

    shapes = spark.createDataFrame([(1, box(0.0, 0.0, 1.0, 1.0), False)], SCHEMA)
    assert clip_polygons(shapes, spark.createDataFrame([], MASKS), 2.0).isEmpty()
    assert clip_polygons(shapes.filter(F.lit(False)), shapes.withColumnRenamed("id", "mask"), 2.0).isEmpty()
