"""Spatial and attribute joins (D)."""

from pyspark.sql import functions as F

from ...functions.geom import box_ring
from ...functions.maths import round_half_up
from ...operators import catalogue, common, grid, spatial
from . import register, rnd

WITHIN = "p.x >= z.xmin AND p.x < z.xmax AND p.y >= z.ymin AND p.y < z.ymax"


@register("D01_point_within_box", f"SELECT p.id, p.pop, z.zone_no FROM {{places}} p JOIN {{admin_zones}} z ON {WITHIN}")
def point_within(v):
    return spatial.join_within(v.places, v.admin_zones, 15001.0, "zone_no").select("id", "pop", "zone_no")


TOUCH = "a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax"


@register("D02_intersects_one_to_many", f"SELECT a.block_id, b.cell_id FROM {{blocks}} a JOIN {{cells}} b ON {TOUCH}")
def intersects(v):
    return spatial.join_intersects(v.blocks, v.cells, 4500.0).select("block_id", F.col("rcell_id").alias("cell_id"))


@register(
    "D03_contains",
    "SELECT b.cell_id, a.block_id FROM {cells} b JOIN {blocks} a ON b.xmin <= a.xmin AND a.xmax <= b.xmax AND b.ymin <= a.ymin AND a.ymax <= b.ymax",
)
def contains(v):
    return spatial.join_contains(v.cells, v.blocks, 4500.0).select("cell_id", F.col("rblock_id").alias("block_id"))


QUARTERS = """SELECT cell_id * 10 + CAST(xmin AS BIGINT) % 7 AS shape_id, xmin, xmax, ymin, ymax FROM {cells}
    UNION ALL SELECT cell_id * 10 + 8, xmin, (xmin + xmax) / 2, ymin, (ymin + ymax) / 2 FROM {cells}"""


@register(
    "D03_equals",
    f"SELECT a.cell_id, b.shape_id FROM {{cells}} a JOIN ({QUARTERS}) b ON a.xmin = b.xmin AND a.xmax = b.xmax AND a.ymin = b.ymin AND a.ymax = b.ymax",
)
def equals(v):
    return spatial.join_equals(v.cells, v.sql(QUARTERS)).select("cell_id", F.col("rshape_id").alias("shape_id"))


AREA = "greatest(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin), 0.0) * greatest(least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin), 0.0)"


@register(
    "D04_largest_overlap",
    f"""SELECT block_id, cell_id, overlap FROM (SELECT a.block_id, b.cell_id, {AREA} AS overlap,
        row_number() OVER (PARTITION BY a.block_id ORDER BY {AREA} DESC, b.cell_id) AS rn FROM {{blocks}} a JOIN {{cells}} b ON {TOUCH}) t
        WHERE rn = 1 AND overlap > 0""",
)
def largest_overlap(v):
    best = spatial.join_largest_overlap(v.blocks, v.cells, 4500.0, "block_id", "cell_id")
    return best.select("block_id", F.col("rcell_id").alias("cell_id"), "overlap")


@register(
    "D05_sum_within",
    f"""SELECT z.zone_no, CAST(coalesce(sum(p.pop), 0) AS DOUBLE) AS pop_sum FROM {{admin_zones}} z LEFT JOIN {{places}} p ON {WITHIN} GROUP BY z.zone_no""",
)
def sum_within(v):
    places = v.places.select("x", "y", F.col("pop").cast("double").alias("pop"))
    return spatial.join_sum_within(places, v.admin_zones, 15001.0, "zone_no", "pop").select("zone_no", "pop_sum")


D = "sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))"
BOX = "b.x BETWEEN a.x - {r} AND a.x + {r} AND b.y BETWEEN a.y - {r} AND a.y + {r}"


@register(
    "D06_distance_pairs_5_km",
    f"SELECT a.id, b.id AS other, {rnd(D, 3)} AS d FROM {{places}} a JOIN {{places}} b ON a.id < b.id AND {BOX.format(r=5000)} AND {D} < 5000",
)
def distance_pairs(v):
    places = v.places.select("id", "x", "y")
    pairs = spatial.join_distance(places, spatial.as_right(places), 5000.0, strict=True).filter("id < rid")
    return pairs.select("id", F.col("rid").alias("other"), round_half_up(F.col("d"), 3).alias("d"))


@register(
    "D06_poi_pairs_250_m",
    f"SELECT a.fid, b.fid AS other FROM {{pois}} a JOIN {{pois}} b ON a.fid < b.fid AND {BOX.format(r=250)} AND {D} <= 250",
)
def poi_pairs(v):
    pois = v.pois.select("fid", "x", "y")
    pairs = spatial.join_distance(pois, spatial.as_right(pois), 250.0).filter("fid < rfid")
    return pairs.select("fid", F.col("rfid").alias("other"))


KNN = f"""SELECT id, rid, d, nth FROM (SELECT a.id, b.no AS rid, {D} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {D}, b.no) AS nth
    FROM {{places}} a CROSS JOIN {{tier_zones}} b) t WHERE nth <= 3"""


@register("D07_three_nearest", f"SELECT id, rid, {rnd('d', 3)} AS d, CAST(nth AS INTEGER) AS nth FROM ({KNN}) k")
def three_nearest(v):
    zones = v.tier_zones.select(F.col("no").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = spatial.join_knn(v.places.select("id", "x", "y"), zones, 3)
    return near.select("id", "rid", round_half_up(F.col("d"), 3).alias("d"), "nth")


@register(
    "D07_nearest_other_place",
    f"""SELECT id, {rnd('min(d)', 3)} AS d FROM (SELECT a.id, {D} AS d FROM {{places}} a JOIN {{places}} b ON a.id <> b.id) t GROUP BY id""",
)
def nearest_other(v):
    places = v.places.select("id", "x", "y")
    near = spatial.join_knn(places, spatial.as_right(places), 1, exclude_same=True)
    return near.select("id", round_half_up(F.col("d"), 3).alias("d"))


@register(
    "D08_not_dominated_10_km",
    f"""SELECT a.id, a.pop FROM {{places}} a WHERE NOT EXISTS (SELECT 1 FROM {{places}} b WHERE b.pop > a.pop AND {BOX.format(r=10000)} AND {D} <= 10000)""",
)
def not_dominated(v):
    return spatial.not_dominated(v.places, 10000.0, "pop").select("id", "pop")


@register(
    "D08_exists_within_2_km",
    f"""SELECT a.id FROM {{places}} a WHERE EXISTS (SELECT 1 FROM {{tier_zones}} b WHERE {BOX.format(r=2000)} AND {D} <= 2000)""",
)
def exists_near(v):
    return spatial.exists_within(v.places, v.tier_zones, 2000.0)


@register(
    "D09_attribute_join_first",
    """SELECT c.c_custkey, coalesce(o.o_orderkey, -1) AS first_order, coalesce(o.o_totalprice, 0.0) AS price FROM {customer} c
       LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM {orders}) o
       ON o.o_custkey = c.c_custkey AND o.rn = 1""",
)
def attribute_join(v):
    orders = v.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate", "o_totalprice")
    joined = common.join_first(v.customer.select("c_custkey"), orders, ["c_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return joined.select(
        "c_custkey", F.coalesce("o_orderkey", F.lit(-1)).alias("first_order"), F.coalesce("o_totalprice", F.lit(0.0)).alias("price")
    )


@register(
    "D10_zone_fallback_for_places",
    f"""SELECT p.id, coalesce(z.zone_no, 0) AS zone_no, coalesce(z.zone_pop, 0.0) AS zone_pop FROM {{places}} p LEFT JOIN (
        SELECT z.*, CAST(s.total AS DOUBLE) AS zone_pop FROM {{admin_zones}} z JOIN (SELECT z.zone_no AS zn, sum(p.pop) AS total FROM {{admin_zones}} z
        JOIN {{places}} p ON {WITHIN} GROUP BY 1) s ON s.zn = z.zone_no) z ON {WITHIN}""",
)
def zone_fallback(v):
    zones = spatial.join_sum_within(v.places.select("x", "y", F.col("pop").cast("double").alias("pop")), v.admin_zones, 15001.0, "zone_no", "pop")
    placed = spatial.join_within(v.places.select("id", "x", "y"), zones.withColumnRenamed("pop_sum", "zone_pop"), 15001.0, "zone_no")
    joined = v.places.select("id").join(placed.select("id", "zone_no", "zone_pop"), "id", "left")
    return joined.select("id", F.coalesce("zone_no", F.lit(0)).alias("zone_no"), F.coalesce("zone_pop", F.lit(0.0)).alias("zone_pop"))


@register(
    "C04_points_intersecting_layer",
    "SELECT n.node_id FROM {nodes} n WHERE EXISTS (SELECT 1 FROM {blocks} b WHERE n.x >= b.xmin AND n.x < b.xmax AND n.y >= b.ymin AND n.y < b.ymax)",
)
def semi_join(v):
    return spatial.semi_join_spatial(v.nodes, v.blocks, 4500.0).select("node_id")


REGION_TABLE = """SELECT CASE WHEN n_regionkey = 4 THEN concat('r4/n', CAST(n_nationkey AS VARCHAR(5))) ELSE concat('n', CAST(n_nationkey AS VARCHAR(5))) END AS id,
    CASE WHEN n_regionkey <> 4 THEN concat('r', CAST(n_regionkey AS VARCHAR(5))) END AS parent, CAST(NULL AS VARCHAR(2)) AS alpha2,
    r.xmin, r.xmax, r.ymin, r.ymax FROM {nation} JOIN {regions} r ON r.id = n_nationkey
    UNION ALL SELECT concat('r', CAST(r_regionkey AS VARCHAR(5))), NULL, concat('A', CAST(r_regionkey AS VARCHAR(5))),
    x.xmin, x.xmax, x.ymin, x.ymax FROM {region} JOIN (SELECT parent, min(xmin) AS xmin, max(xmax) AS xmax, min(ymin) AS ymin, max(ymax) AS ymax
      FROM {regions} GROUP BY parent) x ON x.parent = r_regionkey"""
SEEKERS = "SELECT no AS id, x * 3 AS x, y * 3 AS y, concat('a', CAST(no % 5 AS VARCHAR(5))) AS code FROM {tier_zones}"


def region_table(v):
    df = v.sql(REGION_TABLE)
    return df.withColumn("ring", box_ring(F.col("xmin"), F.col("xmax"), F.col("ymin"), F.col("ymax")))


BOX_D = "sqrt(pow(greatest(r.xmin - p.x, 0.0, p.x - r.xmax), 2) + pow(greatest(r.ymin - p.y, 0.0, p.y - r.ymax), 2))"


def near_sql(region_sql, seekers, distance, radius):
    return f"""WITH r AS ({region_sql}), p AS ({seekers}), near AS (SELECT p.id, p.code, r.id AS region, r.parent, {distance} AS d,
          coalesce(CASE WHEN r.alpha2 IS NOT NULL THEN r.id END, r.parent, split_part(r.id, '/', 1)) AS country
          FROM p JOIN r ON {distance} <= {radius}),
        c AS (SELECT id, country, min(d) AS cd, max(CASE WHEN concat('a', substr(country, 2)) = code THEN 1 ELSE 0 END) AS own FROM near GROUP BY id, country),
        cr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY own DESC, cd, country) AS country_rank FROM c),
        s AS (SELECT id, country, region, d, row_number() OVER (PARTITION BY id, country ORDER BY d, region) AS region_rank FROM near WHERE region <> country)
        SELECT cr.id, cr.country, CAST(cr.country_rank AS INTEGER) AS country_rank, cr.own AS is_primary, {rnd('cr.cd', 3)} AS country_distance,
          coalesce(s.region, '-') AS region, CAST(coalesce(s.region_rank, 0) AS INTEGER) AS region_rank
        FROM cr LEFT JOIN s ON s.id = cr.id AND s.country = cr.country"""


def near_rows(near):
    return near.select(
        "id", "country", "country_rank", F.col("is_primary").cast("int").alias("is_primary"),
        round_half_up(F.col("country_distance"), 3).alias("country_distance"), F.coalesce("region", F.lit("-")).alias("region"),
        F.coalesce("region_rank", F.lit(0)).alias("region_rank"),
    )


@register("D11_regions_near_points", near_sql(REGION_TABLE, SEEKERS, BOX_D, 20000))
def regions_near(v):
    return near_rows(catalogue.regions_near(v.sql(SEEKERS), region_table(v), 20000.0, 60000.0))


# The same regions and points on the globe: 60 km of the plane are a degree.
GLOBE_SEEKERS = f"SELECT id, 6 + x / 60000.0 AS x, 47 + y / 60000.0 AS y, code FROM ({SEEKERS}) s"
GLOBE_REGIONS = f"""SELECT id, parent, alpha2, 6 + xmin / 60000.0 AS xmin, 6 + xmax / 60000.0 AS xmax, 47 + ymin / 60000.0 AS ymin, 47 + ymax / 60000.0 AS ymax
    FROM ({REGION_TABLE}) g"""
SPOT_X, SPOT_Y = "least(greatest(p.x, r.xmin), r.xmax)", "least(greatest(p.y, r.ymin), r.ymax)"
GLOBE_D = rnd(
    f"""2 * 6371.009 * asin(sqrt(pow(sin(radians({SPOT_Y} - p.y) / 2), 2) + cos(radians(p.y)) * cos(radians({SPOT_Y})) * pow(sin(radians({SPOT_X} - p.x) / 2), 2)))""", 9
)


@register("D11_regions_near_points_km", near_sql(GLOBE_REGIONS, GLOBE_SEEKERS, GLOBE_D, 20))
def regions_near_km(v):
    regions = v.sql(GLOBE_REGIONS).withColumn("ring", box_ring(F.col("xmin"), F.col("xmax"), F.col("ymin"), F.col("ymax")))
    return near_rows(catalogue.regions_near(v.sql(GLOBE_SEEKERS), regions, 20.0, 1.0, degrees=True))


REFS = """SELECT o_custkey AS study, o_orderkey AS seq,
    CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN c_nationkey % 5 = 4 THEN 'none' ELSE concat('n', CAST(c_nationkey AS VARCHAR(5))) END END AS region,
    CASE WHEN o_orderkey % 3 = 1 THEN concat('2024-01-02_n', CAST(o_orderkey % 25 AS VARCHAR(5)), '-latest.osm.pbf') END AS filename,
    CASE o_orderkey % 7 WHEN 0 THEN 'a2' WHEN 1 THEN 'xyz' WHEN 2 THEN 'zz' END AS country_code
    FROM {orders} JOIN {customer} ON c_custkey = o_custkey"""
ISO = """SELECT concat('A', CAST(r_regionkey AS VARCHAR(5))) AS alpha2, concat('AA', CAST(r_regionkey AS VARCHAR(5))) AS alpha3 FROM {region}"""


@register(
    "D12_country_codes_of_studies",
    f"""WITH refs AS ({REFS}), r AS ({REGION_TABLE}), h AS (SELECT id, upper(concat('A', substr(coalesce(parent, split_part(id, '/', 1)), 2))) AS a2 FROM r),
        f AS (SELECT *, regexp_replace(regexp_replace(replace(filename, '.osm.pbf', ''), '^[0-9]+-[0-9]+-[0-9]+_', ''), '-latest$', '') AS key FROM refs),
        m AS (SELECT study, seq, 0 AS pos, upper(country_code) AS code FROM f WHERE country_code IS NOT NULL
          UNION ALL SELECT f.study, f.seq, 1, h.a2 FROM f JOIN h ON h.id = f.region
          UNION ALL SELECT f.study, f.seq, 1, h.a2 FROM f JOIN h ON h.id = f.key WHERE f.region IS NULL),
        t AS (SELECT study, seq, pos, CASE WHEN length(code) = 3 THEN code ELSE i.alpha3 END AS code FROM m LEFT JOIN ({ISO}) i ON i.alpha2 = m.code),
        u AS (SELECT study, code, min(seq * 2 + pos) AS first_at FROM t WHERE code IS NOT NULL GROUP BY study, code),
        l AS (SELECT study, string_agg(code, ', ' ORDER BY first_at) AS codes FROM u GROUP BY study)
        SELECT s.study, coalesce(l.codes, 'DEU') AS codes FROM (SELECT DISTINCT study FROM refs) s LEFT JOIN l ON l.study = s.study""",
)
def country_codes(v):
    regions = region_table(v).select("id", "parent", "alpha2")
    return catalogue.resolve_countries(v.sql(REFS), regions, v.sql(ISO))


@register(
    "D13_clip_to_buffered_outline",
    """SELECT p.id FROM {places} p WHERE EXISTS (SELECT 1 FROM {regions} r WHERE r.parent = 1
       AND sqrt(pow(greatest(r.xmin - p.x, 0.0, p.x - r.xmax), 2) + pow(greatest(r.ymin - p.y, 0.0, p.y - r.ymax), 2)) <= 50000)""",
)
def clip_outline(v):
    outlines = v.regions.filter("parent = 1").select(box_ring(F.col("xmin"), F.col("xmax"), F.col("ymin"), F.col("ymax")).alias("ring"))
    return spatial.clip_to_buffered_outline(v.places, outlines, 50000.0, 60000.0).select("id")


SEGMENTS = """SELECT l.way_id, l.seq, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM {links} l JOIN {nodes} a ON a.node_id = l.from_node
    JOIN {nodes} b ON b.node_id = l.to_node"""


def _slab(p, q, low, high):
    inside = f"({p} >= {low} AND {p} <= {high})"
    enter = f"CASE WHEN {q} = {p} THEN CASE WHEN {inside} THEN 0.0 ELSE 2.0 END ELSE least(({low} - {p}) / ({q} - {p}), ({high} - {p}) / ({q} - {p})) END"
    leave = f"CASE WHEN {q} = {p} THEN CASE WHEN {inside} THEN 1.0 ELSE -1.0 END ELSE greatest(({low} - {p}) / ({q} - {p}), ({high} - {p}) / ({q} - {p})) END"
    return enter, leave


_EX, _LX = _slab("s.x1", "s.x2", "c.xmin", "c.xmax")
_EY, _LY = _slab("s.y1", "s.y2", "c.ymin", "c.ymax")


@register(
    "D14_cells_along_ways",
    f"""SELECT s.way_id, count(DISTINCT c.cell_id) AS cells, CAST(sum(c.cell_id) AS BIGINT) AS total FROM ({SEGMENTS}) s JOIN {{cells}} c
        ON c.xmax >= least(s.x1, s.x2) AND c.xmin <= greatest(s.x1, s.x2) AND c.ymax >= least(s.y1, s.y2) AND c.ymin <= greatest(s.y1, s.y2)
        AND greatest({_EX}, {_EY}, 0.0) <= least({_LX}, {_LY}, 1.0) GROUP BY s.way_id""",
)
def along_ways(v):
    return grid.count_cells_along(v.cells, v.sql(SEGMENTS), 4500.0, "way_id")




GRIDS = """SELECT 'old' AS grid, min(x) + 20000 AS cx, min(y) + 20000 AS cy FROM {nodes}
    UNION ALL SELECT 'new', min(x) + 21300, min(y) + 19100 FROM {nodes}"""


def grids(v):
    return grid.circular_grid(v.sql(GRIDS), 2000.0, 15000.0)


GRID_SQL = f"""SELECT grid, row_number() OVER (PARTITION BY grid ORDER BY rel_x, rel_y) - 1 AS id, rel_x, rel_y,
    cx + (rel_x - 0.5) * 2000 AS xmin, cx + (rel_x + 0.5) * 2000 AS xmax, cy + (rel_y - 0.5) * 2000 AS ymin, cy + (rel_y + 0.5) * 2000 AS ymax
    FROM ({GRIDS}) g, (SELECT unnest(range(-8, 9)) AS rel_x) i, (SELECT unnest(range(-8, 9)) AS rel_y) j
    WHERE sqrt(rel_x * rel_x + rel_y * rel_y) * 2000 <= 15000"""
CHOSEN = "SELECT cell_id, arg_max(mode, seq) AS area_type FROM {cell_actions} GROUP BY cell_id"
OLD = f"SELECT g.*, c.area_type FROM ({GRID_SQL}) g JOIN ({CHOSEN}) c ON c.cell_id = g.id WHERE g.grid = 'old'"


def old_and_new(v, keep_rel=True):
    both = grids(v)
    chosen = grid.apply_selection(v.cell_actions).select(F.col("cell_id").alias("id"), F.col("mode").alias("area_type"))
    old = both.filter("grid = 'old'").join(chosen, "id", "left")
    if not keep_rel:
        old = old.withColumns({"rel_x": F.lit(None).cast("int"), "rel_y": F.lit(None).cast("int")})
    return old, both.filter("grid = 'new'").withColumn("area_type", F.lit(None).cast("string"))


@register(
    "D15_transfer_selection_by_position",
    f"SELECT n.id, o.area_type FROM ({GRID_SQL}) n JOIN ({OLD}) o ON o.rel_x = n.rel_x AND o.rel_y = n.rel_y WHERE n.grid = 'new'",
)
def transfer_by_position(v):
    return grid.transfer_selection(*old_and_new(v), 2000.0)


@register(
    "D15_transfer_selection_by_overlap",
    f"""WITH o AS ({OLD}), n AS (SELECT * FROM ({GRID_SQL}) g WHERE grid = 'new'), p AS (SELECT n.id, o.id AS oid, o.area_type,
          (least(n.xmax, o.xmax) - greatest(n.xmin, o.xmin)) * (least(n.ymax, o.ymax) - greatest(n.ymin, o.ymin)) AS area,
          CASE WHEN (n.xmin + n.xmax) / 2 > o.xmin AND (n.xmin + n.xmax) / 2 < o.xmax AND (n.ymin + n.ymax) / 2 > o.ymin AND (n.ymin + n.ymax) / 2 < o.ymax THEN 0 ELSE 1 END AS outside
          FROM n JOIN o ON n.xmin < o.xmax AND o.xmin < n.xmax AND n.ymin < o.ymax AND o.ymin < n.ymax)
        SELECT id, area_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY outside, CASE WHEN outside = 1 THEN -area END, oid) AS rn FROM p) t WHERE rn = 1""",
)
def transfer_by_overlap(v):
    return grid.transfer_selection(*old_and_new(v, keep_rel=False), 2000.0)
