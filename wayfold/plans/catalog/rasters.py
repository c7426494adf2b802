"""Raster operators (I), zonal sums (E1, E2) and the calibration chain."""

from pyspark.sql import functions as F

from ...functions.maths import round_half_up
from ...operators import raster
from . import register, rnd

CELL = 500.0


@register(
    "I01_clip_by_extent",
    """SELECT col, row_no, value FROM {pixels} WHERE (col + 0.5) * 500 >= 60000 AND (col + 0.5) * 500 < 200000
       AND (row_no + 0.5) * 500 >= 30000 AND (row_no + 0.5) * 500 < 250250""",
)
def clip_extent(v):
    return raster.clip_box(v.pixels, CELL, 60000.0, 200000.0, 30000.0, 250250.0)


MASK = """SELECT DISTINCT CAST(floor(x / 500) AS BIGINT) AS col, CAST(floor(y / 500) AS BIGINT) AS row_no FROM {places}"""


@register("I01_clip_by_mask", f"SELECT p.* FROM {{pixels}} p JOIN ({MASK}) m ON m.col = p.col AND m.row_no = p.row_no")
def clip_mask(v):
    return raster.clip_mask(v.pixels, v.sql(MASK))


@register(
    "G02_area_difference_on_cells",
    f"""SELECT p.* FROM {{pixels}} p WHERE NOT EXISTS (SELECT 1 FROM ({MASK}) m WHERE m.col = p.col AND m.row_no = p.row_no)""",
)
def difference(v):
    return raster.drop_mask(v.pixels, v.sql(MASK))


CENTRE = """SELECT col, row_no, arg_max(block_id, block_id) AS value FROM (SELECT block_id,
      unnest(generate_series(CAST(ceil(xmin / {c} - 0.5) AS BIGINT), CAST(ceil(xmax / {c} - 0.5) AS BIGINT) - 1)) AS col, ymin, ymax FROM {{blocks}}) a,
      LATERAL (SELECT unnest(generate_series(CAST(ceil(ymin / {c} - 0.5) AS BIGINT), CAST(ceil(ymax / {c} - 0.5) AS BIGINT) - 1)) AS row_no) b
      GROUP BY 1, 2"""


@register("I02_rasterize_attribute", CENTRE.format(c="250.0"))
def rasterize_attribute(v):
    return raster.rasterize(v.blocks, 250.0, F.col("block_id"), F.col("block_id"))


@register(
    "I02_rasterize_all_touched",
    """SELECT col, row_no, 1.0::DOUBLE AS value FROM (SELECT block_id, ymin, ymax,
       unnest(generate_series(CAST(floor(xmin / 500) AS BIGINT), CAST(ceil(xmax / 500) AS BIGINT) - 1)) AS col FROM {blocks}) a,
       LATERAL (SELECT unnest(generate_series(CAST(floor(ymin / 500) AS BIGINT), CAST(ceil(ymax / 500) AS BIGINT) - 1)) AS row_no) b
       GROUP BY 1, 2""",
)
def rasterize_touched(v):
    return raster.rasterize(v.blocks, CELL, F.lit(1.0), F.lit(0), touched=True)


FINE = CENTRE.format(c="50.0").replace("arg_max(block_id, block_id) AS value", "1.0::DOUBLE AS value")
SHARE = f"""SELECT CAST(floor(col / 10.0) AS BIGINT) AS col, CAST(floor(row_no / 10.0) AS BIGINT) AS row_no, sum(value) / 100 AS value
    FROM ({FINE}) f GROUP BY 1, 2"""


def covered_share(v):
    """Share of each 500 m pixel covered by blocks, from a tenfold finer burn."""
    fine = raster.rasterize(v.blocks, CELL / 10, F.lit(1.0), F.lit(0))
    return raster.resample_avg(fine, 10)


@register("I03_average_resample", SHARE)
def resample(v):
    return covered_share(v)


MASKED = f"""SELECT p.col, p.row_no, p.value * (1 - coalesce(s.value, 0)) AS value FROM {{pixels}} p LEFT JOIN ({SHARE}) s
    ON s.col = p.col AND s.row_no = p.row_no"""


@register("I04_mask_population", f"SELECT col, row_no, {rnd('value', 6)} AS value FROM ({MASKED}) m")
def masked(v):
    px = raster.mask_population(v.pixels, covered_share(v))
    return px.withColumn("value", round_half_up(F.col("value"), 6))


@register(
    "I05_rescale_mass",
    f"""WITH m AS ({MASKED}) SELECT col, row_no, {rnd('value * (SELECT sum(value) FROM {pixels}) / (SELECT sum(value) FROM m)', 6)} AS value FROM m""",
)
def rescaled(v):
    px = raster.mask_population(v.pixels, covered_share(v))
    return raster.rescale_mass(v.pixels, px).withColumn("value", round_half_up(F.col("value"), 6))


ZONED = """SELECT z.zone_no, sum(p.value) AS s FROM {admin_zones} z JOIN {pixels} p ON (p.col + 0.5) * 500 >= z.xmin
    AND (p.col + 0.5) * 500 < z.xmax AND (p.row_no + 0.5) * 500 >= z.ymin AND (p.row_no + 0.5) * 500 < z.ymax GROUP BY z.zone_no"""


@register(
    "E01_zonal_sum",
    f"SELECT z.zone_no, {rnd('coalesce(s.s, 0)', 6)} AS pop_sum FROM {{admin_zones}} z LEFT JOIN ({ZONED}) s ON s.zone_no = z.zone_no",
)
def zonal_sum(v):
    sums = raster.zonal_sum(v.pixels, v.admin_zones, CELL, "zone_no", 15001.0)
    return sums.select("zone_no", round_half_up(F.col("value_sum"), 6).alias("pop_sum"))


IN_ZONE = """(p.col + 0.5) * 500 >= d.xmin AND (p.col + 0.5) * 500 < d.xmax AND (p.row_no + 0.5) * 500 >= d.ymin
    AND (p.row_no + 0.5) * 500 < d.ymax"""


@register(
    "I06_calibrate_to_reference",
    f"""WITH d AS (SELECT z.*, CAST(5000 + z.zone_no % 97 * 10 AS DOUBLE) AS reference FROM {{admin_zones}} z),
        s AS ({ZONED}) SELECT p.col, p.row_no, {rnd('p.value * CASE WHEN d.zone_no IS NULL THEN 1 WHEN s.s > 0 THEN d.reference / s.s ELSE 0 END', 6)} AS value
        FROM {{pixels}} p LEFT JOIN d ON {IN_ZONE} LEFT JOIN s ON s.zone_no = d.zone_no""",
)
def calibrated(v):
    districts = v.admin_zones.withColumn("reference", (5000 + F.col("zone_no") % 97 * 10).cast("double"))
    px = raster.calibrate(v.pixels, districts, CELL, "zone_no", "reference", 15001.0)
    return px.withColumn("value", round_half_up(F.col("value"), 6))


@register(
    "I07_mosaic",
    """SELECT coalesce(b.col, a.col) AS col, coalesce(b.row_no, a.row_no) AS row_no, coalesce(b.value, a.value) AS value
       FROM (SELECT * FROM {pixels}) a FULL JOIN (SELECT CAST(floor(x / 500) AS BIGINT) AS col, CAST(floor(y / 500) AS BIGINT) AS row_no,
         CAST(sum(pop) AS DOUBLE) AS value FROM {places} GROUP BY 1, 2) b ON a.col = b.col AND a.row_no = b.row_no""",
)
def mosaic(v):
    other = v.sql(
        """SELECT CAST(floor(x / 500) AS BIGINT) AS col, CAST(floor(y / 500) AS BIGINT) AS row_no, CAST(sum(pop) AS DOUBLE) AS value
           FROM {places} GROUP BY 1, 2"""
    )
    return raster.mosaic(v.pixels, other)


def focal_sql(size, table="{pixels}"):
    r = size // 2
    return f"""SELECT a.col, a.row_no, a.value, max(b.value) AS focal FROM {table} a JOIN {table} b
        ON b.col BETWEEN a.col - {r} AND a.col + {r} AND b.row_no BETWEEN a.row_no - {r} AND a.row_no + {r} GROUP BY 1, 2, 3"""


FOCAL = """SELECT a.col, a.row_no, a.value, max(b.value) AS focal FROM {pixels} a, LATERAL (SELECT unnest(range(-3, 4)) AS dc) i,
    LATERAL (SELECT unnest(range(-3, 4)) AS dr) j JOIN {pixels} b ON b.col = a.col + dc AND b.row_no = a.row_no + dr GROUP BY 1, 2, 3"""


@register("I08_focal_maximum", FOCAL)
def focal(v):
    return raster.focal_max(v.pixels, 7)


@register("I09_local_maxima", f"SELECT col, row_no, CASE WHEN value = focal THEN value ELSE 0.0 END AS value FROM ({FOCAL}) f")
def local_maxima(v):
    return raster.local_maxima(v.pixels, 7)


KDE = """SELECT col, row_no, CAST(sum(CAST(w * (1 - d2 / (r * r)) * (1 - d2 / (r * r)) AS DECIMAL(28, 10))) AS DOUBLE) AS value FROM (
    SELECT col, row_no, w, r, ((col + 0.5) * {c} - x) * ((col + 0.5) * {c} - x) + ((row_no + 0.5) * {c} - y) * ((row_no + 0.5) * {c} - y) AS d2
    FROM (SELECT x, y, w, r, unnest(generate_series(CAST(floor((x - r) / {c}) AS BIGINT), CAST(floor((x + r) / {c}) AS BIGINT))) AS col FROM ({src}) p) a,
    LATERAL (SELECT unnest(generate_series(CAST(floor((y - r) / {c}) AS BIGINT), CAST(floor((y + r) / {c}) AS BIGINT))) AS row_no) b) k
    WHERE d2 / (r * r) <= 1 GROUP BY 1, 2"""


def per_block(px, pixels, digits):
    """A raster summed up per block of pixels, for a compact result; the sum is one of decimals."""
    total = F.sum(F.col("value").cast("decimal(28,10)")).cast("double")
    return px.groupBy(F.floor(F.col("col") / pixels).alias("bc"), F.floor(F.col("row_no") / pixels).alias("br")).agg(
        F.count(F.lit(1)).alias("n"), round_half_up(total, digits).alias("total"), round_half_up(F.max("value"), digits).alias("top")
    )


def per_block_sql(sql, pixels, digits):
    return f"""SELECT CAST(floor(col / {pixels}.0) AS BIGINT) AS bc, CAST(floor(row_no / {pixels}.0) AS BIGINT) AS br, count(*) AS n,
        {rnd('CAST(sum(CAST(value AS DECIMAL(28, 10))) AS DOUBLE)', digits)} AS total, {rnd('max(value)', digits)} AS top FROM ({sql}) t GROUP BY 1, 2"""


@register(
    "I10_kernel_density_of_pois",
    per_block_sql(KDE.format(c="25.0", src="SELECT x, y, CAST(1 + fid % 4 AS DOUBLE) AS w, CAST(100 + fid % 4 * 100 AS DOUBLE) AS r FROM {pois}"), 20, 4),
)
def poi_density(v):
    return per_block(raster.kde(v.pois, 25.0, 100 + F.col("fid") % 4 * 100, 1 + F.col("fid") % 4), 20, 4)


@register(
    "I10_kernel_density_of_population",
    per_block_sql(KDE.format(c="400.0", src="SELECT (col + 0.5) * 500 AS x, (row_no + 0.5) * 500 AS y, value AS w, 2000.0::DOUBLE AS r FROM {pixels}"), 10, 4),
)
def population_density(v):
    return per_block(raster.kde(raster.pixels_to_points(v.pixels, CELL), 400.0, F.lit(2000.0), F.col("value")), 10, 4)


@register(
    "I11_fill_zero",
    per_block_sql(
        """SELECT c.col, r.row_no, coalesce(p.value, 0.0) AS value FROM (SELECT unnest(generate_series(min(col), max(col))) AS col FROM {pixels}) c
           CROSS JOIN (SELECT unnest(generate_series(min(row_no), max(row_no))) AS row_no FROM {pixels}) r
           LEFT JOIN {pixels} p ON p.col = c.col AND p.row_no = r.row_no""", 10, 6),
)
def fill_zero(v):
    return per_block(raster.fill_zero(v.pixels, raster.frame_of(v.pixels)), 10, 6)


@register(
    "I12_sample_rasters",
    """SELECT s.id, coalesce(a.value, 0.0) AS population, coalesce(b.value, 0.0) AS people FROM {places} s
       LEFT JOIN {pixels} a ON a.col = CAST(floor(s.x / 500) AS BIGINT) AND a.row_no = CAST(floor(s.y / 500) AS BIGINT)
       LEFT JOIN (SELECT CAST(floor(x / 500) AS BIGINT) AS col, CAST(floor(y / 500) AS BIGINT) AS row_no, CAST(sum(pop) AS DOUBLE) AS value
         FROM {places} GROUP BY 1, 2) b ON b.col = CAST(floor(s.x / 500) AS BIGINT) AND b.row_no = CAST(floor(s.y / 500) AS BIGINT)""",
)
def sample(v):
    people = v.sql(
        """SELECT CAST(floor(x / 500) AS BIGINT) AS col, CAST(floor(y / 500) AS BIGINT) AS row_no, CAST(sum(pop) AS DOUBLE) AS value
           FROM {places} GROUP BY 1, 2"""
    )
    stacked = raster.stack({"population": v.pixels, "people": people})
    return raster.sample(v.places, stacked, CELL, ["population", "people"]).select("id", "population", "people")


@register(
    "A16_pixels_to_points_and_boxes",
    """SELECT col, row_no, CAST((col + 0.5) * 500 AS DOUBLE) AS x, CAST((row_no + 0.5) * 500 AS DOUBLE) AS y, CAST(col * 500 AS DOUBLE) AS xmin, CAST((col + 1) * 500 AS DOUBLE) AS xmax,
       CAST(row_no * 500 AS DOUBLE) AS ymin, CAST((row_no + 1) * 500 AS DOUBLE) AS ymax FROM {pixels}""",
)
def to_vectors(v):
    return raster.pixels_to_boxes(raster.pixels_to_points(v.pixels, CELL), CELL).drop("value")


BUFFER = """SELECT s.id, sum(p.value) AS buf FROM {places} s JOIN {pixels} p
    ON p.col BETWEEN CAST(floor((s.x - 4000) / 500) AS BIGINT) AND CAST(floor((s.x + 4000) / 500) AS BIGINT)
    AND p.row_no BETWEEN CAST(floor((s.y - 4000) / 500) AS BIGINT) AND CAST(floor((s.y + 4000) / 500) AS BIGINT)
    WHERE sqrt(((p.col + 0.5) * 500 - s.x) * ((p.col + 0.5) * 500 - s.x) + ((p.row_no + 0.5) * 500 - s.y) * ((p.row_no + 0.5) * 500 - s.y)) <= 4000
    GROUP BY s.id"""


@register(
    "E02_population_within_4_km",
    f"SELECT s.id, {rnd('coalesce(b.buf, 0)', 6)} AS buf_sum FROM {{places}} s LEFT JOIN ({BUFFER}) b ON b.id = s.id",
)
def buffer_sum(v):
    sums = raster.buffer_sum(v.places, v.pixels, CELL, 4000.0)
    return sums.select("id", round_half_up(F.col("buf_sum"), 6).alias("buf_sum"))


@register(
    "I02_to_I06_population_chain",
    f"""WITH m AS ({MASKED}), f AS (SELECT (SELECT sum(value) FROM {{pixels}}) / (SELECT sum(value) FROM m) AS f),
        p AS (SELECT col, row_no, value * f AS value FROM m, f), d AS (SELECT z.*, CAST(5000 + z.zone_no % 97 * 10 AS DOUBLE) AS reference FROM {{admin_zones}} z),
        s AS (SELECT d.zone_no, sum(p.value) AS s FROM d JOIN p ON {IN_ZONE} GROUP BY 1),
        c AS (SELECT p.col, p.row_no, p.value * CASE WHEN d.zone_no IS NULL THEN 1 WHEN s.s > 0 THEN d.reference / s.s ELSE 0 END AS value
          FROM p LEFT JOIN d ON {IN_ZONE} LEFT JOIN s ON s.zone_no = d.zone_no)
        SELECT col, row_no, {rnd('value', 5)} AS value FROM c""",
)
def population_chain(v):
    from ..pipelines import prepare_population

    districts = v.admin_zones.withColumn("reference", (5000 + F.col("zone_no") % 97 * 10).cast("double"))
    px = prepare_population(v.pixels, v.blocks, districts, CELL)
    return px.withColumn("value", round_half_up(F.col("value"), 5))
