"""Polygons clipped to polygons: edges of both layers are cut where they meet, and what bounds the shared area is walked into rings.

Pairs of edges meet in cells, so the work grows with the edges near each other. A piece of an edge bounds the result if its middle lies inside
the other polygon; a piece that both have counts once if both areas lie on the same side of it, and not at all otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geom import bound, ring_edges, shoelace
from ..session import cut, discard
from .outlines import edge_cells, index_edges, is_inside, with_cell
from .shapes import outline_rings, polygons

_POINT = "struct<x:double,y:double>"


def polygon_edges(rings: DataFrame, name: str) -> DataFrame:
    """Written table of edges (part, edge, a, b) with the area on their left.

    `rings` has the polygon's `name` (not NULL), `ring` and, if there are any, a flag `hole`; several rings may belong to one polygon.
    Edges without length are left out.
    """
    hole = F.coalesce(F.col("hole"), F.lit(False)) if "hole" in rings.columns else F.lit(False)
    turned = F.when((shoelace(F.col("ring")) < 0) != hole, F.reverse("ring")).otherwise(F.col("ring"))
    plain = F.transform(turned, lambda p: F.struct((p.x + 0.0).cast("double").alias("x"), (p.y + 0.0).cast("double").alias("y")))
    edges = rings.select(F.col(name).alias("part"), F.explode(ring_edges(plain)).alias("e")).select("part", "e.a", "e.b")
    return cut(edges.filter("a <> b").withColumn("edge", F.monotonically_increasing_id()))


def _cross(o: str, p: str, q: str) -> Column:
    """Twice the area of the triangle o, p, q: 0 if q lies on the line from o to p."""
    c = F.col
    return (c(f"{p}.x") - c(f"{o}.x")) * (c(f"{q}.y") - c(f"{o}.y")) - (c(f"{p}.y") - c(f"{o}.y")) * (c(f"{q}.x") - c(f"{o}.x"))


def _between(p: str, a: str, b: str) -> Column:
    """Whether a point of the line through a and b lies between them."""
    spans = [F.col(f"{p}.{axis}").between(F.least(f"{a}.{axis}", f"{b}.{axis}"), F.greatest(f"{a}.{axis}", f"{b}.{axis}")) for axis in "xy"]
    return spans[0] & spans[1]


def _meetings(ours: DataFrame, masks: DataFrame, size: float) -> DataFrame:
    """Pairs of edges (part, edge, a, b / mask, m_edge, c, d) that touch, with the points where each is cut; ends are kept exactly."""
    left = edge_cells(ours, size, 0.0)
    right = edge_cells(masks, size, 0.0).select(
        "_cx", "_cy", F.col("part").alias("mask"), F.col("edge").alias("m_edge"), F.col("a").alias("c"), F.col("b").alias("d")
    )
    sides = {"sa": _cross("c", "d", "a"), "sb": _cross("c", "d", "b"), "sc": _cross("a", "b", "c"), "sd": _cross("a", "b", "d")}
    pairs = left.join(right, ["_cx", "_cy"]).withColumns(sides)
    along = F.expr("sa = 0 AND sb = 0 AND sc = 0 AND sd = 0")
    shared = F.array_compact(
        F.array(
            F.when(_between("a", "c", "d"), F.col("a")), F.when(_between("b", "c", "d"), F.col("b")),
            F.when(_between("c", "a", "b"), F.col("c")), F.when(_between("d", "a", "b"), F.col("d")),
        )
    )
    t = F.try_divide(F.col("sa"), F.col("sa") - F.col("sb"))
    met = F.struct(
        (F.col("a.x") + t * (F.col("b.x") - F.col("a.x"))).alias("x"), (F.col("a.y") + t * (F.col("b.y") - F.col("a.y"))).alias("y")
    ).cast(_POINT)
    one = F.when(F.expr("sa = 0"), F.col("a")).when(F.expr("sb = 0"), F.col("b")).when(F.expr("sc = 0"), F.col("c")).when(F.expr("sd = 0"), F.col("d")).otherwise(met)
    crossing = F.expr("sign(sa) * sign(sb) <= 0 AND sign(sc) * sign(sd) <= 0")
    # Both edges reach the same cell more than once where they run along each other.
    points = F.when(along, shared).when(crossing, F.array(one))
    kept = pairs.withColumn("points", points).filter(F.size("points") > 0)
    return cut(kept.select("part", "edge", "a", "b", "mask", "m_edge", "c", "d", "points").dropDuplicates(["edge", "m_edge"]))


def _pieces(met: DataFrame, edge: str, a: str, b: str, side: str) -> DataFrame:
    """Cut edges as pieces (part, mask, side, p, q) between neighbouring cuts, in the direction of the edge."""
    cuts = met.groupBy("part", "mask", edge, a, b).agg(F.flatten(F.collect_list("points")).alias("_at"))
    along = lambda p: (p.x - F.col(f"{a}.x")) * (F.col(f"{b}.x") - F.col(f"{a}.x")) + (p.y - F.col(f"{a}.y")) * (F.col(f"{b}.y") - F.col(f"{a}.y"))
    ordered = F.array_sort(F.array_distinct(F.transform(F.concat(F.array(a, b), "_at"), lambda p: F.struct(along(p).alias("t"), p.alias("p")))))
    chain = bound(ordered, lambda s: F.transform(F.slice(s, 1, F.size(s) - 1), lambda v, i: F.struct(v.p.alias("p"), F.element_at(s, i + 2).p.alias("q"))))
    pieces = cuts.select("part", "mask", F.explode(chain).alias("e"))
    return pieces.select("part", "mask", F.lit(side).alias("side"), "e.p", "e.q").filter("p <> q")


def _with_middle(edges: DataFrame, p: str, q: str) -> DataFrame:
    return edges.withColumns({axis: (F.col(f"{p}.{axis}") + F.col(f"{q}.{axis}")) / 2 for axis in "xy"})


def _inside(spots: DataFrame, cells: DataFrame, size: float, whole: str, name: str) -> DataFrame:
    """Spots inside a polygon of the index, with its `part` as `name`; where the column `whole` is given, inside that polygon only."""
    index = cells.withColumnRenamed("part", "_within")
    keyed = with_cell(spots, size)
    here = (keyed["_cx"] == index["_cx"]) & (keyed["_cy"] == index["_cy"]) & is_inside(keyed["x"], keyed["y"], index, size)
    if whole:
        here = here & (keyed[whole] == index["_within"])
    found = keyed.join(index, here)
    return found.select(*[keyed[c] for c in spots.columns if c not in ("x", "y")], *([] if whole else [index["_within"].alias(name)]))


def shared_edges(ours: DataFrame, masks: DataFrame, size: float) -> DataFrame:
    """Directed edges (part, mask, x1, y1, x2, y2) that bound what a polygon shares with a mask; both given by `polygon_edges`."""
    our_cells, mask_cells = cut(index_edges(ours, size)), cut(index_edges(masks, size))
    met = _meetings(ours, masks, size)
    pieces = _pieces(met, "edge", "a", "b", "ours").unionByName(_pieces(met, "m_edge", "c", "d", "mask"))
    ends = pieces.withColumns({"_low": F.least("p", "q"), "_high": F.greatest("p", "q"), "_on": F.col("p") < F.col("q")})
    ours_on, mask_on = (F.max(F.when(F.col("side") == s, F.col("_on"))) for s in ("ours", "mask"))
    named = ends.groupBy("part", "mask", "_low", "_high").agg(ours_on.alias("_ours"), mask_on.alias("_mask"))
    forward = F.coalesce("_ours", "_mask")
    cut_edges = cut(
        named.select(
            "part", "mask", F.when(forward, F.col("_low")).otherwise(F.col("_high")).alias("p"), F.when(forward, F.col("_high")).otherwise(F.col("_low")).alias("q"),
            (F.col("_ours") == F.col("_mask")).alias("same"), F.col("_ours").isNotNull().alias("is_ours"),
        )
    )
    kept = [cut_edges.filter("same").select("part", "mask", "p", "q")]
    for is_ours, cells, edges, edge, part, other in ((True, mask_cells, ours, "edge", "part", "mask"), (False, our_cells, masks, "m_edge", "mask", "part")):
        alone = cut_edges.filter((F.col("is_ours") == is_ours) & F.col("same").isNull())
        kept.append(_inside(_with_middle(alone, "p", "q"), cells, size, other, other).select("part", "mask", "p", "q"))
        # Edges that a polygon of the other layer does not touch are inside it whole or not at all.
        whole = edges.select(F.col("part").alias(part), F.col("edge").alias(edge), F.col("a").alias("p"), F.col("b").alias("q"))
        untouched = _inside(_with_middle(whole, "p", "q"), cells, size, "", other).join(met.select(edge, other), [edge, other], "left_anti")
        kept.append(untouched.select("part", "mask", "p", "q"))
    result = kept[0]
    for more in kept[1:]:
        result = result.unionByName(more)
    written = cut(result.select("part", "mask", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2")))
    discard(our_cells, mask_cells, met, cut_edges)
    return written


def clip_polygons(shapes: DataFrame, masks: DataFrame, size: float, shape: str = "id", mask: str = "mask") -> DataFrame:
    """What polygons share with mask polygons: one row per polygon, mask and part, with its `outer` ring and `holes`.

    Both are given ring by ring (see `polygon_edges`); rings of one polygon must not cross. Polygons that share no area with a mask, or only a
    boundary, give no row. `size` is the width of the cells in which edges meet. Edges that do not close, as rings that cross
    themselves can leave them, raise an error.
    """
    ours, theirs = polygon_edges(shapes, shape), polygon_edges(masks, mask)
    edges = shared_edges(ours, theirs, size)
    ends = edges.select("part", "mask", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(1).alias("n")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), F.lit(-1).alias("n")))).alias("e"))
    loose = ends.select("part", "mask", "e.*").groupBy("part", "mask", "x", "y").agg(F.sum("n").alias("n")).filter("n <> 0").limit(1).collect()
    if loose:
        raise ValueError(f"the boundary of polygon {loose[0].part} in mask {loose[0].mask} does not close at {loose[0].x}, {loose[0].y}")
    by = ["_shape", "_mask"]
    rings = outline_rings(edges.withColumnsRenamed({"part": "_shape", "mask": "_mask"}), by, 1.0)
    found = polygons(rings, by, size / 8, beside=0.0)
    first = F.struct("head.x1", "head.y1")
    result = cut(found.select(F.col("_shape").alias(shape), F.col("_mask").alias(mask), first.alias("at"), "outer", "holes"))
    discard(ours, theirs, edges)
    return result
