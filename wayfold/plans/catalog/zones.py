"""Zone assembly (Z)."""

from pyspark.sql import functions as F

from ...functions.maths import round_half_up
from ...operators import zones as ops
from . import register, rnd

SIZE = 15001.0
# The study area: the cells that hold most nodes around the origin.
STUDY = "SELECT cell_id, xmin, xmax, ymin, ymax FROM {cells} WHERE xmin < 27000 AND ymin < 31500"
CROPPED = f"""SELECT z.zone_no, (z.xmax - z.xmin) * (z.ymax - z.ymin) - coalesce((SELECT sum(greatest(least(z.xmax, c.xmax) - greatest(z.xmin, c.xmin), 0.0)
      * greatest(least(z.ymax, c.ymax) - greatest(z.ymin, c.ymin), 0.0)) FROM ({STUDY}) c), 0) AS area, coalesce((SELECT sum(p.value) FROM {{pixels}} p WHERE (p.col + 0.5) * 500 >= z.xmin
      AND (p.col + 0.5) * 500 < z.xmax AND (p.row_no + 0.5) * 500 >= z.ymin AND (p.row_no + 0.5) * 500 < z.ymax AND NOT EXISTS (SELECT 1 FROM ({STUDY}) c
        WHERE (p.col + 0.5) * 500 >= c.xmin AND (p.col + 0.5) * 500 < c.xmax AND (p.row_no + 0.5) * 500 >= c.ymin AND (p.row_no + 0.5) * 500 < c.ymax)), 0) AS pop,
      z.xmin, z.xmax, z.ymin, z.ymax FROM {{admin_zones}} z"""


def study(v):
    return v.sql(STUDY)


def cropped(v):
    return ops.crop_zones(v.admin_zones, study(v), v.pixels, 500.0, SIZE)


@register("G02_zones_without_study_area", f"SELECT zone_no, {rnd('area', 3)} AS area, {rnd('pop', 6)} AS pop FROM ({CROPPED}) c WHERE area > 0")
def crop(v):
    return cropped(v).select("zone_no", round_half_up(F.col("area"), 3).alias("area"), round_half_up(F.col("pop"), 6).alias("pop"))


DENSITY = """SELECT col, row_no, sum(w * (1 - q) * (1 - q)) AS value FROM (SELECT col, row_no, w, (((col + 0.5) * 500 - x) * ((col + 0.5) * 500 - x) + ((row_no + 0.5) * 500 - y) * ((row_no + 0.5) * 500 - y))::DOUBLE / 4000000 AS q
    FROM (SELECT (p.col + 0.5) * 500 AS x, (p.row_no + 0.5) * 500 AS y, p.value AS w, p.col + dc AS col, p.row_no + dr AS row_no FROM {pixels} p, (SELECT unnest(range(-4, 5)) AS dc) i, (SELECT unnest(range(-4, 5)) AS dr) j) k) z WHERE q <= 1 GROUP BY 1, 2"""
PLACED = "SELECT id, x, y FROM {places}"


@register(
    "Z01_admin_points",
    f"""WITH z AS ({CROPPED}), pl AS ({PLACED}), a AS (SELECT z.zone_no, p.id, p.x, p.y, {rnd('''(SELECT coalesce(sum(q.value), 0) FROM {pixels} q WHERE
          sqrt(((q.col + 0.5) * 500 - p.x) * ((q.col + 0.5) * 500 - p.x) + ((q.row_no + 0.5) * 500 - p.y) * ((q.row_no + 0.5) * 500 - p.y)) <= 4000)''', 6)} AS buf
          FROM z JOIN pl p ON p.x >= z.xmin AND p.x < z.xmax AND p.y >= z.ymin AND p.y < z.ymax WHERE z.area > 0),
        a1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone_no ORDER BY buf DESC, id) AS rn FROM a) t WHERE rn = 1),
        d AS ({DENSITY}), b AS (SELECT z.zone_no, (d.col + 0.5) * 500 AS x, (d.row_no + 0.5) * 500 AS y, row_number() OVER (PARTITION BY z.zone_no ORDER BY {rnd('d.value', 6)} DESC, d.col * 1000000 + d.row_no) AS rn
          FROM z JOIN d ON (d.col + 0.5) * 500 >= z.xmin AND (d.col + 0.5) * 500 < z.xmax AND (d.row_no + 0.5) * 500 >= z.ymin AND (d.row_no + 0.5) * 500 < z.ymax WHERE z.area > 0)
        SELECT zone_no, x, y, 1 AS src_priority FROM a1 UNION ALL SELECT zone_no, CAST(x AS DOUBLE), CAST(y AS DOUBLE), 2 FROM b WHERE rn = 1 AND zone_no NOT IN (SELECT zone_no FROM a1)""",
)
def admin_points(v):
    return ops.admin_points(cropped(v), v.sql(PLACED), v.pixels, 500.0, SIZE).select("zone_no", "x", "y", "src_priority")


CENTRES = "SELECT no AS zone_no, x / 2.5 AS x, y / 2.5 AS y FROM {tier_zones}"
INTENSE = "SELECT cell_id AS NO, CAST(cell_id * 7919 % 2501 AS DOUBLE) / 100 AS total_intensity, xmin, xmax, ymin, ymax FROM {cells}"


@register(
    "Z02_grid_cell_of_admin_centre",
    f"""SELECT zone_no, cell_no FROM (SELECT p.zone_no, c.NO AS cell_no, row_number() OVER (PARTITION BY p.zone_no ORDER BY c.total_intensity DESC, c.NO) AS rn
        FROM ({CENTRES}) p JOIN ({INTENSE}) c ON sqrt(pow(greatest(c.xmin - p.x, 0.0, p.x - c.xmax), 2) + pow(greatest(c.ymin - p.y, 0.0, p.y - c.ymax), 2)) <= 1500) t WHERE rn = 1""",
)
def match_grid(v):
    return ops.match_grid_to_admin(v.sql(CENTRES), v.sql(INTENSE))


POINTS = """SELECT fid AS id, x * 5 AS x, y * 5 AS y, CASE WHEN fid % 3 = 0 THEN 'ADM' ELSE 'Grid' END AS src,
    CASE WHEN fid % 97 = 1 THEN 0 WHEN fid % 23 = 1 THEN 1 WHEN fid % 11 = 1 THEN 2 WHEN fid % 5 = 1 THEN 3 WHEN fid % 7 = 0 THEN 9 ELSE 4 END AS target_tier,
    CASE WHEN fid % 3 = 0 THEN CASE WHEN fid % 97 = 1 THEN 0 WHEN fid % 23 = 1 THEN 1 WHEN fid % 11 = 1 THEN 2 WHEN fid % 5 = 1 THEN 3 ELSE 4 END ELSE 9 END AS type_no,
    CAST(fid * 7919 % 2503 AS DOUBLE) / 100 AS total_intensity, CASE WHEN fid % 3 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(floor(x / 4500) AS BIGINT) * 100 + CAST(floor(y / 4500) AS BIGINT) END AS no_e0
    FROM {pois}"""


def _near(cond, radius, table):
    return f"""EXISTS (SELECT 1 FROM {table} b WHERE {cond} AND b.x BETWEEN a.x - {radius} AND a.x + {radius} AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {radius})"""


STRONGER = "b.total_intensity > a.total_intensity"
G = "b.src = 'Grid'"
REST = "id, x, y, src, target_tier, total_intensity, no_e0"


def _pass(n, table, claims, rivals, above, same):
    return f"""p{n} AS (SELECT {REST}, CASE WHEN {claims} AND NOT {_near(f'b.type_no = {n - 1}', above, table)} AND NOT {_near(f'{G} AND b.target_tier IN ({rivals}) AND {STRONGER}', same, table)} THEN {n}
        WHEN src = 'ADM' AND type_no = {n} AND ({_near(f'b.type_no = {n - 1}', above, table)} OR {_near(f'{G} AND b.target_tier IN ({rivals})', same, table)} OR {_near(G, 1500, table)}) THEN {n + 1}
        ELSE type_no END AS type_no FROM {table} a)"""


CLAIM3 = "{0}src = 'Grid' AND ({0}target_tier = 3 OR ({0}target_tier IN (1, 2) AND {0}type_no > 2))"


@register(
    "Z03_tier_competition",
    f"""WITH s AS ({POINTS}), p0 AS (SELECT {REST}, CASE WHEN src = 'Grid' AND target_tier = 0 AND NOT {_near(f'{G} AND b.target_tier = 0 AND {STRONGER}', 50000, 's')} THEN 0
          WHEN src = 'ADM' AND target_tier = 0 AND {_near(f'{G} AND b.target_tier = 0', 50000, 's')} THEN 1 WHEN src = 'ADM' AND target_tier = 0 THEN 0 ELSE type_no END AS type_no FROM s a),
        {_pass(1, 'p0', "src = 'Grid' AND target_tier = 1", '1', 50000, 30000)},
        {_pass(2, 'p1', "src = 'Grid' AND (target_tier = 2 OR (target_tier = 1 AND type_no > 1))", '1, 2', 30000, 10000)},
        p3 AS (SELECT id, CASE WHEN {CLAIM3.format('')} AND NOT {_near('b.type_no = 2', 10000, 'p2')} AND NOT {_near(f'{G} AND b.target_tier IN (1, 2, 3) AND {STRONGER}', 2000, 'p2')}
            AND NOT EXISTS (SELECT 1 FROM p2 b WHERE b.no_e0 = a.no_e0 AND b.type_no IN (0, 1, 2))
            AND NOT EXISTS (SELECT 1 FROM p2 b WHERE b.no_e0 = a.no_e0 AND {STRONGER} AND {CLAIM3.format('b.')}) THEN 3
          WHEN {CLAIM3.format('')} THEN 4
          WHEN src = 'ADM' AND type_no = 3 AND ({_near('b.type_no = 2', 10000, 'p2')} OR {_near(f'{G} AND b.target_tier IN (1, 2, 3)', 2000, 'p2')} OR {_near(G, 1500, 'p2')}
            OR EXISTS (SELECT 1 FROM p2 b WHERE {G} AND b.no_e0 = a.no_e0 AND (b.type_no IN (0, 1, 2) OR {CLAIM3.format('b.')}))) THEN 4
          ELSE type_no END AS type_no FROM p2 a)
        SELECT id, type_no FROM p3""",
)
def tier_competition(v):
    return ops.tier_competition(v.sql(POINTS)).select("id", "type_no")


def zone_inputs(v):
    """Study cells, cropped administrative zones and all administrative zones with labels."""
    cells = study(v).select(
        F.col("cell_id").alias("zone_no"), F.lit(1).cast("long").alias("main_zone"), F.lit(9).alias("type_no"), F.lit(10.0).alias("pop"),
        ((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y"),
        F.expr("CASE WHEN cell_id % 2 = 0 THEN 'PA' END").alias("zone_type"), "xmin", "xmax", "ymin", "ymax",
    )
    admin = cropped(v).select(
        "zone_no", F.floor(F.col("zone_no") / 100).alias("main_zone"), F.lit(4).alias("type_no"), round_half_up(F.col("pop"), 6).alias("pop"),
        ((F.col("xmin") + F.col("xmax")) / 2).alias("x"), F.expr("CASE WHEN zone_no % 5 <> 0 THEN (ymin + ymax) / 2 END").alias("y"),
    )
    labelled = v.admin_zones.withColumn("label", F.concat(F.lit("Zone "), F.col("zone_no").cast("string")))
    return cells, admin, labelled


ZONES = f"""SELECT s.src, s.zone_no, s.main_zone, s.label, s.type_no, s.pop, s.x, s.y, s.zone_type, row_number() OVER (ORDER BY s.zone_no, s.src) AS code FROM (
    SELECT 'Grid' AS src, c.cell_id AS zone_no, 1 AS main_zone, 'Zone ' || CAST(b.zone_no AS VARCHAR) AS label, 9 AS type_no, 10.0::DOUBLE AS pop, (c.xmin + c.xmax) / 2 AS x, (c.ymin + c.ymax) / 2 AS y,
      CASE WHEN cell_id % 2 = 0 THEN 'PA' ELSE 'OA' END AS zone_type
    FROM ({STUDY}) c LEFT JOIN (SELECT cell_id AS ci, zone_no, row_number() OVER (PARTITION BY cell_id ORDER BY o DESC, zone_no) AS rn FROM (SELECT c.cell_id, z.zone_no,
      greatest(least(z.xmax, c.xmax) - greatest(z.xmin, c.xmin), 0.0) * greatest(least(z.ymax, c.ymax) - greatest(z.ymin, c.ymin), 0.0) AS o FROM ({STUDY}) c, {{admin_zones}} z) q WHERE o > 0) b ON b.ci = c.cell_id AND b.rn = 1
    UNION ALL SELECT 'ADM', zone_no, CAST(floor(zone_no / 100) AS BIGINT), concat('Zone ', CAST(zone_no AS VARCHAR)), 4, {rnd('pop', 6)}, (xmin + xmax) / 2, CASE WHEN zone_no % 5 <> 0 THEN (ymin + ymax) / 2 END, 'OA' FROM ({CROPPED}) k WHERE area > 0) s"""


@register("Z04_final_zone_table", f"SELECT code, src, zone_no, main_zone, coalesce(label, '-') AS label, type_no, pop, x, coalesce(y, -1.0) AS y, zone_type FROM ({ZONES}) z")
def assemble(v):
    out = ops.assemble_zones(*zone_inputs(v), SIZE)
    return out.select("code", "src", "zone_no", "main_zone", F.coalesce("label", F.lit("-")).alias("label"), "type_no", "pop", "x", F.coalesce("y", F.lit(-1.0)).alias("y"), "zone_type")


@register(
    "Z04_main_zones",
    f"SELECT row_number() OVER (ORDER BY main_zone) AS code, main_zone, parts, {rnd('pop', 5)} AS pop, x FROM (SELECT main_zone, count(*) AS parts, sum(pop) AS pop, arg_min(x, zone_no) AS x FROM ({ZONES}) z GROUP BY main_zone) m",
)
def mains(v):
    out = ops.main_zones(ops.assemble_zones(*zone_inputs(v), SIZE))
    return out.select("code", "main_zone", "parts", round_half_up(F.col("pop"), 5).alias("pop"), "x")


@register("Z04_centroid_points", f"SELECT zone_no, x, y FROM ({ZONES}) z WHERE y IS NOT NULL")
def centroids(v):
    return ops.centroid_points(ops.assemble_zones(*zone_inputs(v), SIZE)).select("zone_no", "x", "y")
