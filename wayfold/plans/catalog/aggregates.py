"""Aggregations (E) and grouped facts."""

from pyspark.sql import functions as F

from ...functions.maths import round_half_up
from ...operators import common, grid, network, odlines, spatial, zones
from . import register, rnd

PARTS = """SELECT p.id, z.zone_no, concat('Zone ', CAST(z.zone_no AS VARCHAR(12))) AS label, p.name, p.pop AS POP FROM {places} p JOIN {admin_zones} z
    ON p.x >= z.xmin AND p.x < z.xmax AND p.y >= z.ymin AND p.y < z.ymax"""


@register(
    "E03_aggregate_by_zone",
    f"SELECT zone_no, arg_min(id, id) AS id, arg_min(label, id) AS label, arg_min(name, id) AS name, CAST(sum(POP) AS BIGINT) AS POP FROM ({PARTS}) t GROUP BY zone_no",
)
def aggregate_zone(v):
    placed = spatial.join_within(v.places, v.admin_zones, 15001.0, "zone_no")
    parts = placed.select("id", "zone_no", F.concat(F.lit("Zone "), F.col("zone_no").cast("string")).alias("label"), "name", F.col("pop").alias("POP"))
    return zones.aggregate_zones(parts, "zone_no", F.col("id"))


CELL_INDEX = "SELECT DISTINCT CAST(floor(x / 3000) AS BIGINT) AS ix, CAST(floor(y / 3000) AS BIGINT) AS iy, CAST(floor(x / 15000) AS BIGINT) AS part FROM {nodes}"


@register(
    "E05_dissolve_outline_edges",
    f"""WITH c AS ({CELL_INDEX}), e AS (
        SELECT part, ix AS x1, iy AS y1, ix + 1 AS x2, iy AS y2 FROM c UNION ALL SELECT part, ix + 1, iy, ix + 1, iy + 1 FROM c
        UNION ALL SELECT part, ix + 1, iy + 1, ix, iy + 1 FROM c UNION ALL SELECT part, ix, iy + 1, ix, iy FROM c)
        SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.part = e.part AND f.x1 = e.x2 AND f.y1 = e.y2 AND f.x2 = e.x1 AND f.y2 = e.y1)""",
)
def dissolve(v):
    return grid.dissolve_edges(v.sql(CELL_INDEX), ["part"])


FIRST = r"TRY_CAST(regexp_extract({0}, '(\d+)', 1) AS INTEGER)"
SPEED, LANES = FIRST.format("maxspeed"), FIRST.format("lanes")


@register(
    "E06_class_means_with_defaults",
    f"""WITH d(highway, s, l) AS (VALUES ('motorway', 130, 2), ('trunk', 100, 2), ('primary', 100, 2), ('secondary', 80, 2), ('tertiary', 70, 1),
          ('unclassified', 50, 1), ('residential', 30, 1)), m AS (SELECT highway, avg({SPEED}) AS s, avg({LANES}) AS l FROM {{ways}} GROUP BY highway)
        SELECT coalesce(m.highway, d.highway) AS highway, {rnd('coalesce(m.s, d.s, 130)', 6)} AS speed,
          {rnd('greatest(1.0, coalesce(m.l, d.l, 2))', 6)} AS lanes FROM m FULL JOIN d ON d.highway = m.highway""",
)
def class_means(v):
    means = network.regional_means(v.ways)
    return means.select("highway", round_half_up(F.col("mean_speed"), 6).alias("speed"), round_half_up(F.col("mean_lanes"), 6).alias("lanes"))


@register(
    "E07_field_statistics_and_extent",
    """SELECT count(*) AS n, min(id) AS min_id, max(id) AS max_id, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax,
       CAST(sum(pop) AS BIGINT) AS total FROM {places}""",
)
def statistics(v):
    return v.places.agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.min("x").alias("xmin"), F.max("x").alias("xmax"),
        F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.sum("pop").alias("total"),
    )


NEIGHBOUR = """SELECT a.id, min(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))) / 1000 AS km FROM {places} a JOIN {places} b ON a.id <> b.id GROUP BY a.id"""


@register(
    "E08_nearest_neighbour_statistics",
    f"SELECT {rnd('min(km)')} AS low, {rnd('median(km)')} AS middle, {rnd('avg(km)')} AS mean, {rnd('max(km)')} AS high FROM ({NEIGHBOUR}) n",
)
def robust_statistics(v):
    places = v.places.select("id", "x", "y")
    near = spatial.join_knn(places, spatial.as_right(places), 1, exclude_same=True).withColumn("km", F.col("d") / 1000)
    stats = common.robust_stats(near, "km")
    return stats.select(*[round_half_up(F.col(c), 4).alias(c) for c in ("low", "middle", "mean", "high")])


@register(
    "E09_focus_window",
    f"""WITH q AS (SELECT quantile_cont(x, 0.005) AS x0, quantile_cont(x, 0.995) AS x1, quantile_cont(y, 0.005) AS y0, quantile_cont(y, 0.995) AS y1 FROM {{places}})
        SELECT {rnd('x0 - (x1 - x0) * 0.05', 6)} AS xmin, {rnd('x1 + (x1 - x0) * 0.05', 6)} AS xmax, {rnd('y0 - (y1 - y0) * 0.05', 6)} AS ymin,
          {rnd('y1 + (y1 - y0) * 0.05', 6)} AS ymax FROM q""",
)
def focus_window(v):
    window = common.focus_extent(v.places)
    return window.select(*[round_half_up(F.col(c), 6).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])


EDGES = "SELECT DISTINCT from_node AS o, to_node AS d FROM {links}"


@register(
    "E10_neighbour_lists",
    f"SELECT o, string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) AS neighbours, count(*) AS n FROM ({EDGES}) e GROUP BY o",
)
def neighbour_lists(v):
    return odlines.neighbour_sets(v.links.select(F.col("from_node").alias("o"), F.col("to_node").alias("d")))


LAST = "SELECT cell_id, arg_max(mode, seq) AS mode FROM {cell_actions} GROUP BY cell_id"


@register("E11_selection_counts", f"SELECT mode, count(*) AS n FROM ({LAST}) t GROUP BY mode")
def selection_counts(v):
    return grid.selection_counts(grid.apply_selection(v.cell_actions))


@register(
    "E11_overlapping_selections",
    "SELECT cell_id, count(DISTINCT mode) AS modes FROM {cell_actions} GROUP BY cell_id HAVING count(DISTINCT mode) > 1",
)
def overlapping(v):
    return grid.overlapping_selection(v.cell_actions)
