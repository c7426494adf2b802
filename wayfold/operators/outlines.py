"""Outlines by their edges: a point meets only the edges of its own cell, and no ring is copied.

A cell knows the edges that touch it and, for the corner with the least coordinates, whether that lies inside. From
there to a point of the cell the walk is up the cell's left side and then along the row; every edge crossed turns the
answer, and only edges of the cell can be crossed. Corners are judged row by row from the places where edges cross the row's line.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geom import MEAN_EARTH_KM, bound, dist_haversine, dist_point_edges, nearest_on_edges, ring_edges
from ..functions.maths import round_half_up
from ..session import cut

#: Lines of cells stand off round coordinates by these parts of a cell, of which no multiples add up to a round one:
#: no vertex lies on a line and no edge between round coordinates meets a corner.
SHIFT_X = math.sqrt(2.0) - 1.0
SHIFT_Y = (3.0 - math.sqrt(5.0)) / 2.0


def _column(x: Column, size: float) -> Column:
    return F.floor(x / size - SHIFT_X)


def _row(y: Column, size: float) -> Column:
    return F.floor(y / size - SHIFT_Y)


def _left(column: Column, size: float) -> Column:
    return (column + SHIFT_X) * size


def _bottom(row: Column, size: float) -> Column:
    return (row + SHIFT_Y) * size


def edges_of(outlines: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Written table of all edges of the column `ring`: the ring's number `part`, the columns `keep`, and the ends a and b."""
    numbered = outlines.select(F.monotonically_increasing_id().alias("part"), *keep, "ring")
    return cut(numbered.select("part", *keep, F.explode(ring_edges(F.col("ring"))).alias("e")).select("part", *keep, "e.a", "e.b"))


def _rows(edges: DataFrame, size: float, reach: float) -> DataFrame:
    """One row per edge and row of cells that it comes within `reach` of."""
    low, high = F.least("a.y", "b.y") - reach, F.greatest("a.y", "b.y") + reach
    return edges.withColumn("_cy", F.explode(F.sequence(_row(low, size), _row(high, size))))


def _at_row(y: Column) -> Column:
    """x of an edge at height y, its ends beyond them."""
    dy = F.col("b.y") - F.col("a.y")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(y - F.col("a.y"), dy)))
    return F.col("a.x") + t * (F.col("b.x") - F.col("a.x"))


def edge_cells(edges: DataFrame, size: float, reach: float) -> DataFrame:
    """One row per edge and cell that it comes within `reach` of; a margin for rounding may add neighbours."""
    near = reach + size * 1e-9
    rows = _rows(edges, size, near)
    from_x, to_x = _at_row(_bottom(F.col("_cy"), size) - near), _at_row(_bottom(F.col("_cy") + 1, size) + near)
    level = F.col("a.y") == F.col("b.y")
    low = F.when(level, F.least("a.x", "b.x")).otherwise(F.least(from_x, to_x)) - near
    high = F.when(level, F.greatest("a.x", "b.x")).otherwise(F.greatest(from_x, to_x)) + near
    return rows.withColumn("_cx", F.explode(F.sequence(_column(low, size), _column(high, size))))


def _inner_corners(edges: DataFrame, size: float, keep: Iterable[str]) -> DataFrame:
    """Cells whose corner lies inside, from the crossings of each row's line counted from its far end.

    The window runs over the cells of one ring in one row that an edge crosses, not over edges.
    """
    y = _bottom(F.col("_cy"), size)
    crossing = _rows(edges, size, 0.0).filter((F.col("a.y") > y) != (F.col("b.y") > y))
    counted = crossing.groupBy("part", *keep, "_cy", _column(_at_row(y), size).alias("_cx")).agg(F.count("*").alias("n"))
    row = Window.partitionBy("part", "_cy").orderBy(F.col("_cx").desc())
    judged = counted.withColumns({"odd": F.sum("n").over(row) % 2 == 1, "_next": F.lead("_cx").over(row)}).filter("odd AND _next IS NOT NULL")
    return judged.select("part", *keep, "_cy", F.explode(F.sequence(F.col("_next") + 1, F.col("_cx"))).alias("_cx"))


def outline_cells(outlines: DataFrame, size: float, reach: float = 0.0, keep: Iterable[str] = ()) -> DataFrame:
    """The index: part, `keep`, the cell _cx and _cy, the `edges` within `reach` of it, and `inner`, whether its corner is inside the ring.

    Cells far from all edges and outside are left out. A row holds the edges of one cell, never a ring.
    """
    keep = list(keep)
    return index_edges(edges_of(outlines, keep), size, reach, keep)


def index_edges(edges: DataFrame, size: float, reach: float = 0.0, keep: Iterable[str] = ()) -> DataFrame:
    """The index of edges (part, `keep`, a and b); a part may have several rings, of which a point's crossings are counted together."""
    keep = list(keep)
    touched = edge_cells(edges, size, reach).select("part", *keep, "_cx", "_cy", F.struct("a", "b").alias("e"), F.lit(False).alias("inner"))
    inner = _inner_corners(edges, size, keep).select("part", *keep, "_cx", "_cy", F.lit(None).cast(touched.schema["e"].dataType).alias("e"), F.lit(True).alias("inner"))
    cells = touched.unionByName(inner).groupBy("part", *keep, "_cx", "_cy")
    return cells.agg(F.collect_list("e").alias("edges"), F.max("inner").alias("inner"))


def with_cell(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({"_cx": _column(F.col("x"), size), "_cy": _row(F.col("y"), size)})


def is_inside(x: Column, y: Column, cells: DataFrame, size: float) -> Column:
    """Whether a point of the cell lies inside the ring, by the same half-open rule as `geom.point_in_ring`."""
    x0, y0 = _left(cells["_cx"], size), _bottom(cells["_cy"], size)

    def turns(e: Column) -> Column:
        up = e.a.y + (x0 - e.a.x) / (e.b.x - e.a.x) * (e.b.y - e.a.y)
        along = e.a.x + (y - e.a.y) / (e.b.y - e.a.y) * (e.b.x - e.a.x)
        return F.when(((e.a.x > x0) != (e.b.x > x0)) & (up > y0) & (up <= y), 1).otherwise(0) + F.when(
            ((e.a.y > y) != (e.b.y > y)) & (along > x0) & (along <= x), 1
        ).otherwise(0)

    return F.aggregate(cells["edges"], cells["inner"].cast("int"), lambda s, e: s + turns(e)) % 2 == 1


def join_outlines(points: DataFrame, cells: DataFrame, size: float, meant: Callable[[Column, Column], Column], how: str = "left_semi") -> DataFrame:
    """Points (x, y) with the cells' rows where `meant(inside, d)` holds; d is the distance to the ring's edge, endless beyond the index's reach."""
    keyed = with_cell(points, size)
    x, y = keyed["x"], keyed["y"]
    d = F.coalesce(dist_point_edges(x, y, cells["edges"]), F.lit(float("inf")))
    cond = (keyed["_cx"] == cells["_cx"]) & (keyed["_cy"] == cells["_cy"]) & meant(is_inside(x, y, cells, size), d)
    return keyed.join(cells, cond, how).drop(keyed["_cx"], keyed["_cy"])


def _near_pairs(points: DataFrame, regions: DataFrame, reach: float, size: float, keep: list[str]) -> tuple[DataFrame, Column, Column]:
    """Points with the regions of their cell, whether they are inside, and the nearest spot of the region's edge within reach."""
    cells = outline_cells(regions, size, reach, keep)
    keyed = with_cell(points, size)
    pairs = keyed.join(cells, (keyed["_cx"] == cells["_cx"]) & (keyed["_cy"] == cells["_cy"]))
    x, y = keyed["x"], keyed["y"]
    return pairs, is_inside(x, y, cells, size), nearest_on_edges(x, y, cells["edges"])


def regions_within(points: DataFrame, regions: DataFrame, reach: float, size: float, keep: Iterable[str]) -> DataFrame:
    """Pairs of points and regions at a distance `d` of at most `reach`, 0 inside. The regions' columns `keep` must not clash with the points'."""
    pairs, inside, near = _near_pairs(points, regions, reach, size, list(keep))
    return pairs.withColumn("d", F.when(inside, 0.0).otherwise(near.d)).filter(F.col("d") <= reach).select(*points.columns, *keep, "d")


def regions_within_km(points: DataFrame, regions: DataFrame, radius_km: float, size: float, keep: Iterable[str]) -> DataFrame:
    """As `regions_within` for longitudes x and latitudes y in degrees, with `d` the great-circle kilometres, to a micrometre.

    The spot of the edge is the nearest one in degrees. Edges are indexed as far as the radius can reach, in degrees, at the latitude farthest
    from the equator that a point or its circle has; `size` is in degrees. Outlines across the 180th meridian need to be split there.
    """
    high = points.agg(F.max(F.abs("y")).alias("y")).first().y or 0.0
    wide = math.degrees(radius_km / MEAN_EARTH_KM) * (1 + 1e-9)
    if high + wide >= 90.0:
        raise ValueError("circles around the poles are not covered")
    # A circle's east and west ends lie at asin(sin(r) / cos(lat)) from its centre.
    reach = math.hypot(wide, math.degrees(math.asin(math.sin(math.radians(wide)) / math.cos(math.radians(high)))))
    pairs, inside, near = _near_pairs(points, regions, reach, size, list(keep))
    km = bound(near, lambda p: dist_haversine(F.col("x"), F.col("y"), p.x, p.y, MEAN_EARTH_KM))
    d = F.when(inside, 0.0).otherwise(round_half_up(km, 9))
    return pairs.withColumn("d", d).filter(F.col("d") <= radius_km).select(*points.columns, *keep, "d")
