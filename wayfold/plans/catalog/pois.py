"""Urban centralities (L), counts per cell (E4) and the flagship mix query (U2)."""

from pyspark.sql import functions as F

from ...functions import mix, poi_rules
from ...functions.maths import round_half_up
from ...operators import grid, pois as ops
from . import register, rnd
from .expressions import CLASSIFIED, NAME_BASE, RADIUS, WEIGHT
from .expressions import pois as tagged_pois
from .grids import CELL, E2, N, RADIUS_KM, centers

FULL = f"""SELECT fid, osm_id, x, y, sector, classification, {WEIGHT} AS weight, {NAME_BASE} AS name_base,
    coalesce(shop, amenity, leisure, tourism, office, healthcare, 'unknown') AS main_tag, amenity FROM ({CLASSIFIED}) c WHERE classification IS NOT NULL"""
CELL_NO = f"""CAST(1000000 + (floor(r / 9) + 1) * 10000 + (floor(c / 9) + 1) * 100 + 10 * (floor(c / 3) % 3 * 3 + floor(r / 3) % 3 + 1) + (c % 3) * 3 + r % 3 + 1 AS BIGINT)"""
LOCATED = f"""SELECT *, {CELL_NO} AS no FROM (SELECT p.*, floor((x - (cx - {N * CELL / 2})) / 500) AS c, floor((cy + {N * CELL / 2} - y) / 500) AS r
    FROM ({FULL}) p, (SELECT CAST(floor(avg(x)) AS DOUBLE) AS cx, CAST(floor(avg(y)) AS DOUBLE) AS cy FROM {{nodes}}) o) q
    WHERE c BETWEEN 0 AND {9 * N - 1} AND r BETWEEN 0 AND {9 * N - 1}"""


def classified(v):
    return ops.classify(tagged_pois(v))


def located(v, points):
    """Points with the numbers of the study grid's cells."""
    at = points.join(F.broadcast(centers(v)))  # an aggregate without groups: one row
    return grid.locate_cells(at, CELL, RADIUS_KM, F.col("cx"), F.col("cy")).drop("cx", "cy")


COUNTS = ", ".join(
    f"CAST(count(CASE WHEN sector = '{s.upper()}' THEN 1 END) AS BIGINT) AS Num_{s}, "
    + ", ".join(f"CAST(count(CASE WHEN sector = '{s.upper()}' AND classification = '{c}' THEN 1 END) AS BIGINT) AS Num_{s}_{c}" for c in letters)
    for s, letters in ops.SECTOR_CLASSES.items()
)
NAMES = [n for s, letters in ops.SECTOR_CLASSES.items() for n in (f"Num_{s}", *[f"Num_{s}_{c}" for c in letters])]


@register(
    "E04_poi_counts_per_cell",
    f"""WITH l AS ({LOCATED}), k AS (SELECT no, {COUNTS} FROM l GROUP BY no) SELECT e.NO AS zone_no, {', '.join(f'coalesce({n}, 0) AS {n}' for n in NAMES)}
        FROM ({E2}) e LEFT JOIN k ON k.no = e.NO""",
)
def counts(v):
    cells = grid.nested_grid(centers(v), RADIUS_KM, CELL).select("NO")
    out = ops.with_poi_counts(cells, located(v, classified(v)), "NO")
    return out.select(F.col("NO").cast("long").alias("zone_no"), *NAMES)


ENT = " + ".join(f"CASE WHEN p_{s} > 0 THEN p_{s} * ln(p_{s}) ELSE 0 END" for s in mix.MIX_SECTORS)


@register(
    "U2_poi_mix_per_cell",
    f"""WITH k AS (SELECT no, {', '.join(f"CAST(sum(CASE WHEN sector = '{s.upper()}' THEN weight ELSE 0 END) AS DOUBLE) AS {s}" for s in mix.MIX_SECTORS)}, CAST(sum(weight) AS DOUBLE) AS total_intensity,
          count(*) AS n FROM ({LOCATED}) l WHERE weight > 0 GROUP BY no),
        p AS (SELECT *, {', '.join(rnd(f'{s} / total_intensity', 2) + f' AS p_{s}' for s in mix.MIX_SECTORS)} FROM k), e AS (SELECT *, {rnd(f'-({ENT})', 3)} AS entropy FROM p)
        SELECT no AS zone_no, n, total_intensity, {', '.join(f'p_{s}' for s in mix.MIX_SECTORS)}, entropy, {rnd('entropy / ln(5)', 3)} AS entropy_index FROM e""",
)
def poi_mix(v):
    points = located(v, classified(v)).filter("weight > 0")
    sums = points.groupBy("NO").agg(
        *[F.sum(F.when(F.col("sector") == s.upper(), F.col("weight")).otherwise(0)).cast("double").alias(s) for s in mix.MIX_SECTORS],
        F.sum("weight").cast("double").alias("total_intensity"), F.count(F.lit(1)).alias("n"),
    )
    out = mix.mix_index(sums)
    return out.select(F.col("NO").cast("long").alias("zone_no"), "n", "total_intensity", *[f"p_{s}" for s in mix.MIX_SECTORS], "entropy", "entropy_index")


SHAPES = """SELECT fid + 1000000 AS fid, fid AS osm_id, concat(name, ' annex') AS name, amenity, shop, tourism, x, y FROM {pois}"""


@register(
    "L01_build_pois",
    f"""WITH t AS ({FULL}), s AS (SELECT fid, x + CASE WHEN fid % 2 = 0 THEN 5.0 ELSE (5.0 * 100 + 26.0 * 24) / 124 END AS x, y + CASE WHEN fid % 2 = 0 THEN 5.0 ELSE (5.0 * 100 + 2.0 * 24) / 124 END AS y,
          CASE WHEN amenity IN ('townhall', 'bank') THEN 'GOVERNMENT' WHEN amenity IN ('university', 'school') THEN 'EDUCATION' WHEN shop IS NOT NULL THEN 'RETAIL'
            WHEN tourism = 'museum' OR amenity = 'library' THEN 'LEISURE' ELSE 'HEALTHCARE' END AS sector FROM {{pois}} WHERE coalesce(amenity, '') <> 'bench')
        SELECT 'points' AS layer, fid, {rnd('x', 6)} AS x, {rnd('y', 6)} AS y, sector FROM t UNION ALL SELECT 'polygons', fid + 1000000, {rnd('x', 6)}, {rnd('y', 6)}, sector FROM s""",
)
def build(v):
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    square = F.array(at(0.0, 0.0), at(10.0, 0.0), at(10.0, 10.0), at(0.0, 10.0))
    # A second part of 24 square metres, centred at (26, 2).
    second = F.array(at(20.0, 1.0), at(32.0, 1.0), at(32.0, 3.0), at(20.0, 3.0))
    polygons = v.sql(SHAPES).withColumn("parts", F.when(F.col("fid") % 2 == 0, F.array(square)).otherwise(F.array(square, second))).drop("x", "y")
    out = ops.build_pois(tagged_pois(v), polygons)
    return out.select("layer", "fid", round_half_up(F.col("x"), 6).alias("x"), round_half_up(F.col("y"), 6).alias("y"), "sector")


# Copies of every point a little to the side with a slightly different name make the duplicates.
COPIES = f"""SELECT * FROM ({FULL}) f UNION ALL SELECT fid + 500000, osm_id + 700000, x + 100 + fid % 7 * 30, y, sector, CASE WHEN fid % 3 = 0 THEN 'A' ELSE classification END, weight,
    CASE fid % 4 WHEN 0 THEN name_base WHEN 1 THEN concat(name_base, 's') WHEN 2 THEN concat(name_base, ' xyz') ELSE substr(name_base, 2) END, main_tag, amenity FROM ({FULL}) g"""


def doubled(v):
    """The classified points and a shifted, renamed copy of each."""
    base = classified(v).select("fid", "osm_id", "x", "y", "sector", "classification", "weight", "name_base", "main_tag", "amenity")
    name = (
        F.when(F.col("fid") % 4 == 0, F.col("name_base")).when(F.col("fid") % 4 == 1, F.concat("name_base", F.lit("s")))
        .when(F.col("fid") % 4 == 2, F.concat("name_base", F.lit(" xyz"))).otherwise(F.expr("substr(name_base, 2)"))
    )
    copy = base.select(
        (F.col("fid") + 500000).alias("fid"), (F.col("osm_id") + 700000).alias("osm_id"), (F.col("x") + 100 + F.col("fid") % 7 * 30).alias("x"), "y",
        "sector", F.when(F.col("fid") % 3 == 0, "A").otherwise(F.col("classification")).alias("classification"), "weight", name.alias("name_base"), "main_tag", "amenity",
    )
    return base.unionByName(copy)


@register(
    "L02_duplicate_pois",
    f"""WITH p AS ({COPIES}) SELECT DISTINCT a.fid FROM p a JOIN p b ON a.osm_id <> b.osm_id AND a.sector = b.sector AND a.main_tag = b.main_tag
        AND b.x BETWEEN a.x - 250 AND a.x + 250 AND b.y BETWEEN a.y - 250 AND a.y + 250 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 250
        AND a.name_base <> '' AND b.name_base <> ''
        AND CASE WHEN length(a.name_base) <= 5 OR length(b.name_base) <= 5 THEN a.name_base = b.name_base ELSE levenshtein(a.name_base, b.name_base) < 3 END
        AND (b.classification > a.classification OR (b.classification = a.classification AND (length(b.name_base) > length(a.name_base)
          OR (length(b.name_base) = length(a.name_base) AND b.osm_id > a.osm_id))))""",
)
def duplicates(v):
    return ops.duplicate_pois(doubled(v))


KERNEL = """SELECT col, row_no, sector, CAST(sum(CAST(w * (1 - q) * (1 - q) AS DECIMAL(28, 10))) AS DOUBLE) AS value FROM (SELECT col, row_no, sector, w,
      (((col + 0.5) * 25 - x) * ((col + 0.5) * 25 - x) + ((row_no + 0.5) * 25 - y) * ((row_no + 0.5) * 25 - y))::DOUBLE / (r * r) AS q
    FROM (SELECT x, y, w, r, sector, unnest(generate_series(CAST(floor((x - r) / 25) AS BIGINT), CAST(floor((x + r) / 25) AS BIGINT))) AS col FROM src) a,
    LATERAL (SELECT unnest(generate_series(CAST(floor((y - r) / 25) AS BIGINT), CAST(floor((y + r) / 25) AS BIGINT))) AS row_no) b) k WHERE q <= 1 GROUP BY 1, 2, 3"""
SAT = lambda s: f"5 * (1 - exp(-0.2773 * coalesce(sum(CASE WHEN sector = '{s.upper()}' THEN value END), 0)))"
SURFACE = f"""src AS MATERIALIZED (SELECT x, y, sector, CAST(weight AS DOUBLE) AS w, CAST({RADIUS} AS DOUBLE) AS r FROM ({FULL}) f WHERE weight > 0),
    kern AS MATERIALIZED ({KERNEL}), surf AS MATERIALIZED (SELECT *, {' + '.join(mix.MIX_SECTORS)} AS total FROM (SELECT col, row_no, {', '.join(f'{SAT(s)} AS {s}' for s in mix.MIX_SECTORS)} FROM kern GROUP BY 1, 2) z),
    hi AS MATERIALIZED (SELECT * FROM surf WHERE total >= 7),
    foc AS (SELECT col, row_no, max(total) AS f FROM (SELECT col + dc AS col, row_no + dr AS row_no, total FROM hi, (SELECT unnest(range(-1, 2)) AS dc) i,
      (SELECT unnest(range(-1, 2)) AS dr) j) s GROUP BY 1, 2),
    tops AS (SELECT h.* FROM hi h JOIN foc ON foc.col = h.col AND foc.row_no = h.row_no WHERE h.total = foc.f)"""
@register(
    "L03_intensity_surface",
    f"WITH {SURFACE} SELECT CAST(floor(col / 20.0) AS BIGINT) AS bc, CAST(floor(row_no / 20.0) AS BIGINT) AS br, count(*) AS n, {rnd('CAST(sum(CAST(total AS DECIMAL(28, 10))) AS DOUBLE)', 3)} AS total FROM surf GROUP BY 1, 2",
)
def surface(v):
    px = ops.sector_surfaces(classified(v))
    return px.groupBy(F.floor(F.col("col") / 20).alias("bc"), F.floor(F.col("row_no") / 20).alias("br")).agg(
        F.count(F.lit(1)).alias("n"), round_half_up(F.sum(F.col("total_intensity").cast("decimal(28,10)")).cast("double"), 3).alias("total")
    )


@register(
    "L03_intensity_peaks",
    f"""WITH {SURFACE.replace('total >= 7', 'total >= 4')}, p AS (SELECT col, row_no, total, {', '.join(mix.MIX_SECTORS)}, {', '.join(rnd(f'{s} / total', 2) + f' AS p_{s}' for s in mix.MIX_SECTORS)} FROM tops)
        SELECT col, row_no, {rnd('total', 3)} AS total_intensity, {', '.join(rnd(s, 3) + f' AS {s}' for s in mix.MIX_SECTORS)}, {rnd(f'-({ENT})', 3)} AS entropy FROM p""",
)
def peaks(v):
    # Few points are this close together in the small tables, so the threshold is below the default.
    out = ops.intensity_peaks(classified(v), ops.CentralityParams(min_level4=4.0))
    return out.select("col", "row_no", *[round_half_up(F.col(s), 3).alias(s) for s in ("total_intensity", *mix.MIX_SECTORS)], "entropy")


PEAKS = """SELECT fid AS id, x, y, CAST((fid * 7919) % 2501 AS DOUBLE) / 100 AS total_intensity FROM {pois}"""
CELLS_OF = f"""SELECT id, x, y, total_intensity, no - no % 10 AS no_e1, no - no % 100 AS no_e0, no FROM (SELECT *, {CELL_NO} AS no FROM (SELECT p.*,
    floor((x - (cx - {N * CELL / 2})) / 500) AS c, floor((cy + {N * CELL / 2} - y) / 500) AS r FROM ({PEAKS}) p,
    (SELECT CAST(floor(avg(x)) AS DOUBLE) AS cx, CAST(floor(avg(y)) AS DOUBLE) AS cy FROM {{nodes}}) o) q WHERE c BETWEEN 0 AND {9 * N - 1} AND r BETWEEN 0 AND {9 * N - 1}) w"""
NEAR = lambda r: f"b.x BETWEEN a.x - {r} AND a.x + {r} AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {r}"
LEVELS = f"""p AS ({CELLS_OF}), s AS (SELECT * FROM p WHERE total_intensity >= 10),
    q3 AS (SELECT a.* FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.total_intensity > a.total_intensity AND {NEAR(1500)})),
    l3 AS (SELECT id, no_e1, x, y FROM q3 WHERE total_intensity = (SELECT max(total_intensity) FROM q3 m WHERE m.no_e0 = q3.no_e0)),
    o AS (SELECT * FROM p WHERE id NOT IN (SELECT id FROM l3)),
    q4 AS (SELECT a.* FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.total_intensity > a.total_intensity AND {NEAR(700)})
      AND NOT EXISTS (SELECT 1 FROM l3 b WHERE {NEAR(500)})),
    l4 AS (SELECT id FROM q4 WHERE total_intensity = (SELECT max(total_intensity) FROM q4 m WHERE m.no_e1 = q4.no_e1) AND no_e1 NOT IN (SELECT no_e1 FROM l3))"""


def scored(v):
    """Points with an intensity from a hash, in the cells of the study grid."""
    return located(v, v.sql(PEAKS))


@register("L04_level_3_centralities", f"WITH {LEVELS} SELECT id, CASE WHEN id IN (SELECT id FROM l3) THEN 1 ELSE 0 END AS is_l3 FROM p")
def level3(v):
    return ops.level3(scored(v)).select("id", "is_l3")


@register(
    "L05_level_4_centralities",
    f"WITH {LEVELS} SELECT id, CASE WHEN id IN (SELECT id FROM l3) THEN 1 ELSE 0 END AS is_l3, CASE WHEN id IN (SELECT id FROM l4) THEN 1 ELSE 0 END AS is_l4 FROM p",
)
def level4(v):
    from ...session import cut

    return ops.level4(cut(ops.level3(scored(v)))).select("id", "is_l3", "is_l4")


@register(
    "L06_cells_with_centrality",
    f"""WITH {LEVELS}, c AS (SELECT p.*, CASE WHEN p.id IN (SELECT id FROM l3) THEN 3 ELSE 4 END AS t FROM p WHERE p.id IN (SELECT id FROM l3) OR p.id IN (SELECT id FROM l4)),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY no ORDER BY t, total_intensity DESC, id) AS rn FROM c) z WHERE rn = 1)
        SELECT e.NO AS zone_no, coalesce(b.t, 9) AS type_no, CAST(coalesce(b.x, (e.xmin + e.xmax) / 2) AS DOUBLE) AS x, CAST(coalesce(b.y, (e.ymin + e.ymax) / 2) AS DOUBLE) AS y,
          coalesce(b.total_intensity, 0.0) AS total_intensity FROM ({E2}) e LEFT JOIN b ON b.no = e.NO""",
)
def cells(v):
    from ...session import cut

    points = cut(ops.level3(scored(v)))
    points = mix.mix_index(ops.level4(points).withColumns({s: F.col("total_intensity") / 5 for s in mix.MIX_SECTORS}))
    e2 = grid.nested_grid(centers(v), RADIUS_KM, CELL).select("NO", "xmin", "xmax", "ymin", "ymax")
    out = ops.cells_with_centrality(e2, points)
    return out.select(F.col("NO").cast("long").alias("zone_no"), "type_no", "x", "y", "total_intensity")
