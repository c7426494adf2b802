"""Rings: validity, single parts, boundary files and area features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.geom import ring_is_valid, shoelace
from ..functions.rings import clip_half_plane, extents, flat_rings, nested_rings, picked, signed_areas, walked
from ..session import cut

_RING = "array<struct<x:double,y:double>>"
#: Corners that a task cuts at a time.
CORNERS = 1 << 18


def valid_rings(df: DataFrame) -> DataFrame:
    """One row per part (`parts` is an array of rings) that is a proper ring, numbered within its shape."""
    split = df.select(*[c for c in df.columns if c != "parts"], F.posexplode("parts").alias("part", "ring"))
    return split.filter(ring_is_valid(F.col("ring")))


def _extent(ring: str = "ring") -> dict[str, Column]:
    """Columns xmin to ymax of a ring."""
    side = lambda fn, axis: fn(F.transform(ring, lambda v: v[axis]))
    return {f"{axis}{end}": side(fn, axis) for axis in "xy" for end, fn in (("min", F.array_min), ("max", F.array_max))}


def _with_area(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rings have an area, and all areas."""
    area = signed_areas(x, y, at)
    return np.flatnonzero((np.diff(at) >= 3) & ~(np.abs(area) <= 0)), area


def _copies(counts: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows `owner`, each as often as it counts, and the copy's number, some at a time, so that about `CORNERS` corners are held."""
    ends = np.cumsum(counts)
    step = max(1, CORNERS // max(int(np.diff(at).max(initial=1)), 1))
    for low in range(0, int(ends[-1]) if len(ends) else 0, step):
        copy = np.arange(low, min(low + step, int(ends[-1])))
        owner = np.searchsorted(ends, copy, side="right")
        yield owner, copy - (ends[owner] - counts[owner])


def _cells_between(low: np.ndarray, high: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """First cell of each span and their number; spans without coordinates have none."""
    if np.isinf(low).any() or np.isinf(high).any():
        raise ValueError("a ring has no end")
    first, last = np.floor(low / size), np.floor(high / size)
    return first, np.where(np.isnan(first), 0.0, last - first + 1).astype("int64")


def clip_rings(parts: DataFrame, windows: DataFrame) -> DataFrame:
    """Convex rings cut to each window (wxmin, wxmax, wymin, wymax) they overlap; what shares no area with any is dropped.

    Pairs are found by the rings' extents in buckets as wide as the mean side of the windows.
    """
    from .spatial import join_intersects

    side = windows.agg(F.avg((F.col("wxmax") - F.col("wxmin") + F.col("wymax") - F.col("wymin")) / 2).alias("s")).first().s
    # Written, so that the planner sees how few they are: rings shuffled by bucket would all meet in the buckets of one window.
    named = cut(windows.select(*[F.col(f"w{c}").alias(c) for c in ("xmin", "xmax", "ymin", "ymax")]))
    columns = parts.columns
    pairs = join_intersects(parts.withColumn("ring", F.col("ring").cast(_RING)).withColumns(_extent()), named, float(side or 1.0))

    def cut_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, at = flat_rings(batch.column("ring"))
            for a, b, c in ((-1.0, 0.0, "rxmin"), (1.0, 0.0, "rxmax"), (0.0, -1.0, "rymin"), (0.0, 1.0, "rymax")):
                bound = batch.column(c).to_numpy(zero_copy_only=False)
                x, y, at = clip_half_plane(x, y, at, a, b, bound if a + b > 0 else -bound)
            kept, _ = _with_area(x, y, at)
            rest = batch.take(pa.array(kept))
            ring = nested_rings(*picked(x, y, at, kept))
            yield pa.RecordBatch.from_arrays([ring if c == "ring" else rest.column(c) for c in columns], names=columns)

    found = pairs.select(*columns, *[F.col(c).cast("double").alias(c) for c in ("rxmin", "rxmax", "rymin", "rymax")])
    return found.mapInArrow(cut_rings, found.select(*columns).schema)


def covered_cells(parts: DataFrame, size: float) -> DataFrame:
    """Square cells (`col`, `row_no`) that share area with a convex ring, with that `area`; the other columns stay.

    The ring is cut into rows of cells first, so that a slanted strip meets the cells along it, not those of its extent.
    """
    others = [c for c in parts.columns if c != "ring"]
    given = parts.select(*others, F.col("ring").cast(_RING).alias("_ring"))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, at = flat_rings(batch.column("_ring"))
            low, high = extents(y, at)
            first, rows = _cells_between(low, high, size)
            for ring, step in _copies(rows, at):
                row = first[ring] + step
                band = clip_half_plane(*picked(x, y, at, ring), 0.0, -1.0, -(row * size))
                band = clip_half_plane(*band, 0.0, 1.0, row * size + size)
                kept, _ = _with_area(*band)
                ring, row, band = ring[kept], row[kept], picked(*band, kept)
                start, columns = _cells_between(*extents(band[0], band[2]), size)
                for piece, step in _copies(columns, band[2]):
                    col = start[piece] + step
                    cell = clip_half_plane(*picked(*band, piece), -1.0, 0.0, -(col * size))
                    kept, area = _with_area(*clip_half_plane(*cell, 1.0, 0.0, col * size + size))
                    of = piece[kept]
                    rest = batch.take(pa.array(ring[of]))
                    facts = [pa.array(col[kept].astype("int64")), pa.array(row[of].astype("int64")), pa.array(np.abs(area[kept]))]
                    yield pa.RecordBatch.from_arrays([*[rest.column(c) for c in others], *facts], names=[*others, "col", "row_no", "area"])

    facts = [StructField("col", LongType()), StructField("row_no", LongType()), StructField("area", DoubleType())]
    return given.mapInArrow(cells, StructType([*[parts.schema[c] for c in others], *facts]))


def with_point(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows with both coordinates as points x, y."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"x": F.col(x), "y": F.col(y)})


def with_xy(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Centroid coordinates of rings."""
    from ..functions.geom import ring_centroid

    cx, cy = ring_centroid(F.col(ring))
    return df.withColumns({"x": cx, "y": cy})


#: Edges of a group whose rings one task walks without joins.
FEW = 256


def outline_rings(edges: DataFrame, by: list[str], size: float) -> DataFrame:
    """Rings of an outline given as directed edges (x1, y1, x2, y2) in units of `size`: one row per group and ring, in metres.

    Groups of few edges that meet nowhere but end to end are walked in their task (`_walked`), all others by joins (`_rings_by_joins`).
    """
    sizes = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= FEW).select(*by)
    ends = F.struct("x1", "y1", "x2", "y2")
    # Both sides come shuffled by group, and the lists need no other shuffle.
    lists = edges.select(*by, "x1", "y1", "x2", "y2").join(sizes.hint("merge"), by).groupBy(*by).agg(F.collect_set(ends).alias("edges"))
    tried = cut(lists.mapInArrow(_walked(by), StructType([*lists.schema.fields, StructField("walked", LongType())])))
    point = lambda e: F.struct((e.x1 * size).alias("x"), (e.y1 * size).alias("y"))
    near = tried.filter("walked = 1").select(*by, F.col("edges")[0].alias("head"), F.transform("edges", point).alias("ring"))
    solved = tried.filter("walked = 1").select(*by).distinct()
    rest = cut(edges.join(solved.hint("merge"), by, "left_anti"))
    return near if rest.isEmpty() else near.unionByName(_rings_by_joins(rest, by, size))


def _walked(by: list[str]):
    """Groups' lists of edges to one row per ring with its edges in order from the least, or, where not every corner has one edge in and one out, the group as it is."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("edges")
            edges = lists.flatten()
            owner = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            order, at, simple = walked(owner, *[edges.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")], len(batch))
            whole = np.flatnonzero(~simple)
            rings = pa.ListArray.from_arrays(pa.array(at, pa.int32()), edges.take(pa.array(order)))
            left = lists.take(pa.array(whole))
            for rows, made, flag in ((owner[order[at[:-1]]], rings, 1), (whole, left, 0)):
                of = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*[of.column(c) for c in by], made.cast(lists.type), pa.array(np.full(len(rows), flag))], names=[*by, "edges", "walked"])

    return walk


def _rings_by_joins(edges: DataFrame, by: list[str], size: float) -> DataFrame:
    """`outline_rings` for edges of any number.

    The area lies on the left of an edge, so where more than two edges meet the walk turns left: that keeps cells that touch
    only at a corner apart. Every edge thus has one successor, and the ring's first edge is found by following
    successors with doubled strides, a logarithmic number of joins for any ring length.
    """
    # An edge's successor starts where it ends; the turn decides between candidates.
    e = edges.withColumn("edge", F.struct("x1", "y1", "x2", "y2"))
    nxt = e.select(
        *by, F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("edge").alias("next"),
        (F.col("x2") - F.col("x1")).alias("nx"), (F.col("y2") - F.col("y1")).alias("ny"),
    )
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    turn = F.atan2(dx * F.col("ny") - dy * F.col("nx"), dx * F.col("nx") + dy * F.col("ny"))
    step = e.join(nxt, [*by, "x2", "y2"]).withColumn("turn", turn)
    step = step.groupBy(*by, "edge").agg(F.max_by("next", "turn").alias("next"))
    now = cut(step.select(*by, "edge", "next", F.least("edge", "next").alias("head")))
    hops = step
    while True:
        ahead = now.select(*by, F.col("edge").alias("next"), F.col("next").alias("_far"), F.col("head").alias("_head"))
        after = cut(
            now.join(ahead, [*by, "next"]).select(*by, "edge", F.col("_far").alias("next"), F.least("head", "_head").alias("head"))
        )
        moved = after.join(now.select(*by, "edge", F.col("head").alias("_old")), [*by, "edge"]).filter("head <> _old")
        done = moved.isEmpty()
        now = after
        if done:
            break
    # Position along the ring: distance walked from the head, again by doubling.
    links = step.join(now.select(*by, "edge", "head"), [*by, "edge"])
    walk = cut(
        links.select(
            *by, "edge", "head", F.when(F.col("next") == F.col("head"), F.lit(None)).otherwise(F.col("next")).alias("next"),
            F.lit(1).alias("left"),
        )
    )
    while not walk.filter("next IS NOT NULL").isEmpty():
        ahead = walk.select(*by, F.col("edge").alias("next"), F.col("next").alias("_far"), F.col("left").alias("_more"))
        walk = cut(
            walk.join(ahead, [*by, "next"], "left").select(
                *by, "edge", "head", F.col("_far").alias("next"), (F.col("left") + F.coalesce("_more", F.lit(0))).alias("left")
            )
        )
    point = F.struct((F.col("edge.x1") * size).alias("x"), (F.col("edge.y1") * size).alias("y"))
    return walk.groupBy(*by, "head").agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("left")).alias("at"), point.alias("p")))), lambda s: s["p"]).alias("ring")
    )


def polygons(rings: DataFrame, by: list[str], size: float, beside: float = 0.5) -> DataFrame:
    """One row per polygon of `outline_rings`: by, `outer` (its ring) and `holes` (an array of rings in the order of their first edges).

    The area lies on the left of every ring, so holes are those that run clockwise. A hole belongs to the narrowest ring of its
    group around it, found by a spot `beside` the middle of its first edge, in lengths of that edge: half of one lies inside a cell and hence on no
    ring; 0 is the middle itself, for rings that share no edges.
    """
    from .outlines import regions_within

    turned = cut(rings.withColumn("_a", shoelace(F.col("ring"))))
    outer = turned.filter("_a > 0")
    step = lambda axis: F.col("ring")[1][axis] - F.col("ring")[0][axis]
    spot = {"x": F.col("ring")[0]["x"] + step("x") / 2 + step("y") * beside, "y": F.col("ring")[0]["y"] + step("y") / 2 - step("x") * beside}
    holes = turned.filter("_a < 0").withColumns(spot).select(*by, F.col("head").alias("hole"), "x", "y")
    around = outer.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("head").alias("_outer"), "_a", "ring")
    pairs = regions_within(holes, around, 0.0, 8 * size, [*[f"_{c}" for c in by], "_outer", "_a"])
    for c in by:
        pairs = pairs.filter(F.col(c).eqNullSafe(F.col(f"_{c}")))
    owner = pairs.groupBy(*by, "hole").agg(F.min_by("_outer", "_a").alias("_of"))
    owned = turned.withColumnRenamed("head", "hole").join(owner, [*by, "hole"])
    lists = owned.groupBy(*by, F.col("_of").alias("head")).agg(F.sort_array(F.collect_list(F.struct("hole", "ring"))).alias("_h"))
    found = outer.join(lists, [*by, "head"], "left")
    rings_of = F.transform(F.coalesce("_h", F.array()), lambda h: h.ring)
    return found.select(*by, "head", F.col("ring").alias("outer"), rings_of.alias("holes"))


def _closed(ring: Column) -> Column:
    """A ring as GeoJSON coordinates, its first point repeated at the end."""
    line = F.transform(ring, lambda p: F.array(p.x, p.y))
    return F.concat(line, F.slice(line, 1, 1))


def area_features(cells: DataFrame, size: float) -> DataFrame:
    """One feature per area mode with cells: number, mode, cell count, area and the polygons with their holes as GeoJSON geometry.

    Cells of a regular grid (mode, xmin..ymax); modes without cells give no feature and take no number.
    """
    from .grid import AREA_MODES, dissolve_edges

    indexed = cells.withColumns(
        {
            "ix": F.round(F.col("xmin") / size).cast("long"), "iy": F.round(F.col("ymin") / size).cast("long"),
            "area": (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")),
        }
    )
    facts = indexed.groupBy("mode").agg(F.count(F.lit(1)).alias("cells"), F.sum("area").alias("area"))
    order = F.array_position(F.array(*[F.lit(m) for m in AREA_MODES]), F.col("mode"))
    facts = facts.withColumn("id", F.row_number().over(Window.orderBy(order)))  # at most three rows
    rings = outline_rings(dissolve_edges(indexed, ["mode"]), ["mode"], size)
    parts = polygons(rings, ["mode"], size)
    coordinates = F.concat(F.array(_closed(F.col("outer"))), F.transform("holes", _closed))
    shapes = parts.select("mode", "head", coordinates.alias("rings")).groupBy("mode").agg(F.sort_array(F.collect_list(F.struct("head", "rings"))).alias("parts"))
    many = F.transform("parts", lambda p: p.rings)
    geometry = F.when(
        F.size("parts") == 1, F.to_json(F.struct(F.lit("Polygon").alias("type"), many[0].alias("coordinates")))
    ).otherwise(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), many.alias("coordinates"))))
    n_holes = F.aggregate("parts", F.lit(0), lambda s, p: s + F.size(p.rings) - 1)
    return facts.join(shapes, "mode").select(
        "id", F.col("mode").alias("Bereich"), "cells", "area", F.size("parts").alias("n_polygons"), n_holes.alias("n_holes"), geometry.alias("geometry")
    )
