"""Grid generation and layers (J) and grid-based sources (A15, A17)."""

from pyspark.sql import functions as F

from ...functions import geom
from ...functions.maths import round_half_up
from ...operators import grid, raster, shapes, spatial
from . import register, rnd

CELL, RADIUS_KM = 4500.0, 30.0
CENTER = "SELECT avg(x) AS ax, avg(y) AS ay FROM {nodes}"
# The centre of the study is a whole number of metres.
CENTERS = "SELECT floor(ax) + 0.0 AS cx, floor(ay) + 0.0 AS cy FROM (SELECT avg(x) AS ax, avg(y) AS ay FROM {nodes}) c"


def centers(v):
    return v.sql(CENTERS).select(F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"))


N = grid.cells_per_side(RADIUS_KM, CELL)
E2 = f"""SELECT 1000000 + (r // 9 + 1) * 10000 + (c // 9 + 1) * 100 + 10 * ((c // 3 % 3) * 3 + r // 3 % 3 + 1) + (c % 3) * 3 + r % 3 + 1 AS NO,
    concat('RC_Z', lpad(CAST(r // 9 + 1 AS VARCHAR), 2, '0'), '_S', lpad(CAST(c // 9 + 1 AS VARCHAR), 2, '0'), '_',
      CAST((c // 3 % 3) * 3 + r // 3 % 3 + 1 AS VARCHAR), '_', CAST((c % 3) * 3 + r % 3 + 1 AS VARCHAR)) AS NAME,
    1000000 + (r // 9 + 1) * 10000 + (c // 9 + 1) * 100 + 10 * ((c // 3 % 3) * 3 + r // 3 % 3 + 1) AS NO_E1,
    1000000 + (r // 9 + 1) * 10000 + (c // 9 + 1) * 100 AS NO_E0, cx - {N * CELL / 2} + c * 500.0 AS xmin, cx - {N * CELL / 2} + (c + 1) * 500.0 AS xmax,
    cy + {N * CELL / 2} - (r + 1) * 500.0 AS ymin, cy + {N * CELL / 2} - r * 500.0 AS ymax
    FROM (SELECT CAST(floor(avg(x)) AS DOUBLE) AS cx, CAST(floor(avg(y)) AS DOUBLE) AS cy FROM {{nodes}}) o,
      (SELECT unnest(range(0, {9 * N})) AS c) i, (SELECT unnest(range(0, {9 * N})) AS r) j"""


@register(
    "J01_nested_grid",
    f"SELECT NO AS zone_no, NAME AS label, NO_E1, NO_E0, CAST(xmin AS DOUBLE) AS xmin, CAST(ymax AS DOUBLE) AS ymax FROM ({E2}) t",
)
def nested(v):
    e2 = grid.nested_grid(centers(v), RADIUS_KM, CELL)
    return e2.select(
        F.col("NO").cast("long").alias("zone_no"), F.col("NAME").alias("label"), F.col("NO_E1").cast("long").alias("NO_E1"),
        F.col("NO_E0").cast("long").alias("NO_E0"), "xmin", "ymax",
    )


def populated(v):
    """E2 cells with the population of the places inside."""
    e2 = grid.nested_grid(centers(v), RADIUS_KM, CELL)
    c = centers(v)
    at = v.places.join(F.broadcast(c))  # an aggregate without groups: one row
    located = grid.locate_cells(at, CELL, RADIUS_KM, F.col("cx"), F.col("cy"))
    sums = located.groupBy("NO").agg(F.sum("pop").alias("POP"))
    return e2.join(sums, "NO", "left").withColumn("POP", F.coalesce("POP", F.lit(0)))


LEVELS = f"""WITH e AS ({E2}), p AS (SELECT e.*, coalesce(s.pop, 0) AS pop FROM e LEFT JOIN (SELECT e.NO AS no, sum(q.pop) AS pop FROM e JOIN {{places}} q
      ON q.x >= e.xmin AND q.x < e.xmax AND q.y > e.ymin AND q.y <= e.ymax GROUP BY 1) s ON s.no = e.NO)
    SELECT 0 AS level, NO_E0 AS zone_no, CAST(min(xmin) AS DOUBLE) AS xmin, CAST(max(ymax) AS DOUBLE) AS ymax, CAST(sum(pop) AS BIGINT) AS pop FROM p GROUP BY NO_E0
    UNION ALL SELECT 1, NO_E1, CAST(min(xmin) AS DOUBLE), CAST(max(ymax) AS DOUBLE), CAST(sum(pop) AS BIGINT) FROM p GROUP BY NO_E1
    UNION ALL SELECT 2, NO, CAST(xmin AS DOUBLE), CAST(ymax AS DOUBLE), CAST(pop AS BIGINT) FROM p"""


@register("J01_grid_levels_with_population", LEVELS)
def levels(v):
    e2 = populated(v)
    out = None
    for level in (0, 1, 2):
        layer = grid.grid_level(e2, level)
        layer = layer.select(F.lit(level).alias("level"), F.col("NO").cast("long").alias("zone_no"), "xmin", "ymax", F.col("POP").alias("pop"))
        out = layer if out is None else out.unionByName(layer)
    return out


CIRCLES = "SELECT CAST(no AS VARCHAR(10)) AS grid, x AS cx, y AS cy FROM {tier_zones}"


@register(
    "J02_circular_grids",
    f"""SELECT grid, row_number() OVER (PARTITION BY grid ORDER BY rel_x, rel_y) - 1 AS id, CAST(rel_x AS INTEGER) AS rel_x, CAST(rel_y AS INTEGER) AS rel_y,
        CAST(cx + (rel_x - 0.5) * 1000 AS DOUBLE) AS xmin, CAST(cy + (rel_y + 0.5) * 1000 AS DOUBLE) AS ymax
        FROM ({CIRCLES}) g, (SELECT unnest(range(-3, 4)) AS rel_x) i, (SELECT unnest(range(-3, 4)) AS rel_y) j WHERE sqrt(rel_x * rel_x + rel_y * rel_y) * 1000 <= 2500""",
)
def circular(v):
    cells = grid.circular_grid(v.sql(CIRCLES), 1000.0, 2500.0)
    return cells.select("grid", F.col("id").cast("long").alias("id"), "rel_x", "rel_y", "xmin", "ymax")


MODES = """SELECT c.*, m.mode AS area_type FROM (SELECT *, row_number() OVER (ORDER BY cell_id) AS n FROM {cells}) c
    LEFT JOIN (SELECT cell_id AS n, arg_max(mode, seq) AS mode FROM {cell_actions} GROUP BY cell_id) m ON m.n = c.n"""


def selected_cells(v):
    """The cells with the area type the actions leave on the cell of the same ordinal."""
    from ...operators.common import with_rank

    chosen = grid.apply_selection(v.cell_actions).select(F.col("cell_id").alias("n"), F.col("mode").alias("area_type"))
    return with_rank(v.cells, [F.col("cell_id")], "n").join(chosen, "n", "left")


@register(
    "J03_subdivided_cells",
    f"""WITH c AS ({MODES}), d AS (SELECT *, CASE area_type WHEN 'PA' THEN 9 WHEN 'IA1' THEN 3 ELSE 1 END AS k FROM c WHERE area_type IS NOT NULL)
        SELECT cell_id, area_type, CAST(i AS INTEGER) AS sub_x, CAST(j AS INTEGER) AS sub_y, xmin + i * ((xmax - xmin) / k) AS xmin, ymin + (j + 1) * ((ymax - ymin) / k) AS ymax
        FROM d, (SELECT unnest(range(0, 9)) AS i) a, (SELECT unnest(range(0, 9)) AS j) b WHERE i < k AND j < k""",
)
def subdivided(v):
    return grid.subdivide(selected_cells(v)).select("cell_id", "area_type", "sub_x", "sub_y", "xmin", "ymax")


@register(
    "J04_area_type_of_cells",
    f"""WITH e AS ({E2}), g AS (SELECT NO_E0, min(xmin) AS xmin, max(xmax) AS xmax, min(ymin) AS ymin, max(ymax) AS ymax FROM e GROUP BY 1),
        s AS (SELECT cell_id, area_type, (xmin + xmax) / 2 AS x, (ymin + ymax) / 2 AS y FROM ({MODES}) m WHERE area_type IS NOT NULL)
        SELECT g.NO_E0 AS zone_no, coalesce(arg_min(s.area_type, s.cell_id), '-') AS area_type FROM g LEFT JOIN s
        ON s.x >= g.xmin AND s.x < g.xmax AND s.y >= g.ymin AND s.y < g.ymax GROUP BY g.NO_E0""",
)
def area_types(v):
    e0 = grid.grid_level(grid.nested_grid(centers(v), RADIUS_KM, CELL), 0)
    chosen = selected_cells(v).filter("area_type IS NOT NULL").withColumnRenamed("cell_id", "id")
    typed = grid.assign_area_type(e0, chosen, CELL)
    return typed.select(F.col("NO").cast("long").alias("zone_no"), F.coalesce("area_type", F.lit("-")).alias("area_type"))


@register(
    "J04_tier_layer",
    f"""WITH e AS ({E2}), g AS (SELECT NO_E0, min(xmin) AS xmin, max(xmax) AS xmax, min(ymin) AS ymin, max(ymax) AS ymax FROM e GROUP BY 1),
        s AS (SELECT cell_id, area_type, (xmin + xmax) / 2 AS x, (ymin + ymax) / 2 AS y FROM ({MODES}) m WHERE area_type IS NOT NULL),
        t AS (SELECT g.NO_E0, arg_min(s.area_type, s.cell_id) AS area_type FROM g JOIN s ON s.x >= g.xmin AND s.x < g.xmax AND s.y >= g.ymin AND s.y < g.ymax GROUP BY 1)
        SELECT DISTINCT CASE t.area_type WHEN 'PA' THEN e.NO WHEN 'IA1' THEN e.NO_E1 ELSE e.NO_E0 END AS zone_no, t.area_type FROM e JOIN t ON t.NO_E0 = e.NO_E0""",
)
def tier_layer(v):
    e2 = grid.nested_grid(centers(v), RADIUS_KM, CELL)
    chosen = selected_cells(v).filter("area_type IS NOT NULL").withColumnRenamed("cell_id", "id")
    typed = grid.assign_area_type(grid.grid_level(e2, 0), chosen, CELL).select(F.col("NO").alias("NO_E0"), "area_type").filter("area_type IS NOT NULL")
    return grid.tier_layer(e2, typed).select(F.col("NO").cast("long").alias("zone_no"), "area_type")


@register(
    "J04_main_zones",
    f"""WITH e AS ({E2}), g AS (SELECT NO_E0, min(xmin) AS xmin, max(xmax) AS xmax, min(ymin) AS ymin, max(ymax) AS ymax FROM e GROUP BY 1),
        s AS (SELECT cell_id, area_type, (xmin + xmax) / 2 AS x, (ymin + ymax) / 2 AS y FROM ({MODES}) m WHERE area_type IS NOT NULL)
        SELECT g.NO_E0 AS zone_no, arg_min(s.area_type, s.cell_id) AS area_type, g.xmin, g.xmax, g.ymin, g.ymax FROM g JOIN s
        ON s.x >= g.xmin AND s.x < g.xmax AND s.y >= g.ymin AND s.y < g.ymax GROUP BY ALL""",
)
def main_zones(v):
    e2 = grid.nested_grid(centers(v), RADIUS_KM, CELL)
    chosen = selected_cells(v).filter("area_type IS NOT NULL").withColumnRenamed("cell_id", "id")
    typed = grid.assign_area_type(grid.grid_level(e2, 0), chosen, CELL).select(F.col("NO").alias("NO_E0"), "area_type")
    return grid.main_zones(e2, typed).select(F.col("NO").cast("long").alias("zone_no"), "area_type", "xmin", "xmax", "ymin", "ymax")


@register(
    "J05_circle_outlines",
    f"""WITH p AS (SELECT no, radians(y / 99991 * 120 - 60) AS phi, radians(x / 100003 * 360 - 180) AS lam, 25 / 6371.009 AS a FROM {{tier_zones}}),
        s AS (SELECT no, i, phi, lam, a, radians(i * (360.0::DOUBLE / 36)) AS b FROM p, (SELECT unnest(range(0, 37)) AS i) t),
        q AS (SELECT *, asin(sin(phi) * cos(a) + cos(phi) * sin(a) * cos(b)) AS lat2 FROM s)
        SELECT no, CAST(i AS INTEGER) AS i, {rnd('degrees(lat2)', 6)} AS lat, {rnd('degrees(lam + atan2(sin(b) * sin(a) * cos(phi), cos(a) - sin(phi) * sin(lat2)))', 6)} AS lon FROM q""",
)
def circles(v):
    at = v.tier_zones.select("no", (F.col("y") / 99991 * 120 - 60).alias("lat"), (F.col("x") / 100003 * 360 - 180).alias("lon"))
    ring = at.select("no", F.posexplode(geom.circle_ring(F.col("lat"), F.col("lon"), F.lit(25.0))).alias("i", "p"))
    return ring.select("no", "i", round_half_up(F.col("p.lat"), 6).alias("lat"), round_half_up(F.col("p.lon"), 6).alias("lon"))


@register(
    "A15_area_features",
    f"""WITH s AS (SELECT * FROM ({MODES}) m WHERE area_type IS NOT NULL), k AS (SELECT area_type, count(*) AS cells, CAST(sum((xmax - xmin) * (ymax - ymin)) AS DOUBLE) AS area FROM s GROUP BY 1),
        i AS (SELECT area_type AS t, CAST(round(xmin / 4500) AS BIGINT) AS ix, CAST(round(ymin / 4500) AS BIGINT) AS iy FROM s),
        e AS (SELECT a.t, count(*) AS cells, count(r.t) + count(u.t) AS pairs, count(CASE WHEN r.t IS NOT NULL AND u.t IS NOT NULL AND d.t IS NOT NULL THEN 1 END) AS blocks
          FROM i a LEFT JOIN i r ON r.t = a.t AND r.ix = a.ix + 1 AND r.iy = a.iy LEFT JOIN i u ON u.t = a.t AND u.ix = a.ix AND u.iy = a.iy + 1
          LEFT JOIN i d ON d.t = a.t AND d.ix = a.ix + 1 AND d.iy = a.iy + 1 GROUP BY a.t)
        SELECT row_number() OVER (ORDER BY CASE area_type WHEN 'PA' THEN 0 WHEN 'IA1' THEN 1 ELSE 2 END) AS id, area_type AS Bereich, k.cells, area,
          e.cells - pairs + blocks AS polygons_less_holes, CAST(4 * e.cells - 2 * pairs AS BIGINT) AS sides, area AS drawn_area FROM k JOIN e ON e.t = area_type""",
)
def area_features(v):
    cells = selected_cells(v).filter("area_type IS NOT NULL")
    features = shapes.area_features(cells.withColumnRenamed("area_type", "mode"), 4500.0)
    parts = F.from_json("geometry", "coordinates array<array<array<array<double>>>>").coordinates
    whole = F.when(F.get_json_object("geometry", "$.type") == "Polygon", F.array(F.from_json("geometry", "coordinates array<array<array<double>>>").coordinates)).otherwise(parts)
    sides = lambda line: F.size(line) - 1
    turn = lambda line: F.aggregate(
        F.sequence(F.lit(1), F.size(line) - 1), F.lit(0.0), lambda s, i: s + (line[i - 1][0] * line[i][1] - line[i][0] * line[i - 1][1]) / 2
    )
    lines = F.flatten("_parts")
    return features.withColumn("_parts", whole).select(
        F.col("id").cast("long").alias("id"), "Bereich", "cells", "area", (F.col("n_polygons") - F.col("n_holes")).cast("long").alias("polygons_less_holes"),
        F.aggregate(lines, F.lit(0), lambda s, line: s + sides(line)).cast("long").alias("sides"),
        F.aggregate(lines, F.lit(0.0), lambda s, line: s + turn(line)).alias("drawn_area"),
    )


@register(
    "A17_points_from_table",
    "SELECT id, x, y FROM (SELECT id, CASE WHEN id % 5 <> 0 THEN x END AS x, y FROM {places}) t WHERE x IS NOT NULL AND y IS NOT NULL",
)
def points_from_table(v):
    table = v.places.select("id", F.expr("CASE WHEN id % 5 <> 0 THEN x END").alias("XCOORD"), F.col("y").alias("YCOORD"))
    return shapes.with_point(table, "XCOORD", "YCOORD").select("id", "x", "y")
