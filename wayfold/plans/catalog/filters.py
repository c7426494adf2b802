"""Attribute, expression, validity and plausibility filters (C)."""

from pyspark.sql import functions as F

from ...functions import geom
from ...functions.maths import first_int, round_half_up
from ...operators import zones
from . import register, rnd
from .expressions import CLASSIFIED, pois
from ...functions import poi_rules


@register(
    "C01_attribute_filters",
    f"SELECT fid, sector FROM ({CLASSIFIED}) t WHERE sector = 'EDUCATION' AND classification IS NOT NULL AND fid >= 100 AND classification <> 'D'",
)
def attribute_filters(v):
    df = pois(v)
    df = df.filter(poi_rules.is_relevant(df)).withColumn("sector", poi_rules.poi_sector(df))
    df = df.withColumn("classification", poi_rules.poi_class(df, F.col("sector")))
    return df.filter((F.col("sector") == "EDUCATION") & F.col("classification").isNotNull() & (F.col("fid") >= 100) & (F.col("classification") != "D")).select("fid", "sector")


ISO10 = "AA0, AA1,AA9,AA8,AA7,AA6,AA5,AA4,AA2,AA3"
COUNTRY = "SELECT c_custkey AS id, concat('AA', CAST(c_nationkey % 10 AS VARCHAR(4))) AS GID_0 FROM {customer}"


@register(
    "C02_first_eight_countries",
    f"SELECT id, GID_0 FROM ({COUNTRY}) t WHERE GID_0 IN ('AA0', 'AA1', 'AA9', 'AA8', 'AA7', 'AA6', 'AA5', 'AA4')",
)
def first_eight(v):
    return zones.in_countries(v.sql(COUNTRY), ISO10)


SPELLINGS = """SELECT id, CASE WHEN id % 4 = 0 THEN 'PA' END AS ZoneType, CASE id % 4 WHEN 1 THEN 'IA1' WHEN 0 THEN 'IA2' END AS zone_type,
    CASE id % 5 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 9 END AS level FROM {places}"""


@register(
    "C02_zone_type_and_level",
    f"SELECT id, coalesce(ZoneType, zone_type) AS area_type, level FROM ({SPELLINGS}) t WHERE coalesce(ZoneType, zone_type) IN ('PA', 'IA1') AND level IN (3, 4)",
)
def type_and_level(v):
    df = v.sql(SPELLINGS).withColumnRenamed("zone_type", "Zone Type")
    kind = zones.zone_type(df)
    return df.withColumn("area_type", kind).filter(F.col("area_type").isin("PA", "IA1") & F.col("level").isin(3, 4)).select("id", "area_type", "level")


RINGS = """SELECT node_id AS id, node_id % 3 AS shape, x, y FROM {nodes}"""


def rings(v):
    """Multi-part shapes: a square, and per shape kind a triangle, a sliver without area or a repeated point."""
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    square = F.array(at(0.0, 0.0), at(10.0, 0.0), at(10.0, 10.0), at(0.0, 10.0))
    second = (
        F.when(F.col("shape") == 0, F.array(at(20.0, 0.0), at(26.0, 0.0), at(20.0, 8.0)))
        .when(F.col("shape") == 1, F.array(at(20.0, 0.0), at(30.0, 0.0), at(25.0, 0.0)))
        .otherwise(F.array(at(20.0, 0.0), at(20.0, 0.0), at(21.0, 1.0)))
    )
    return v.sql(RINGS).withColumn("parts", F.array(square, second))


@register(
    "C05_valid_single_parts",
    f"""SELECT id, 0 AS part, 100.0::DOUBLE AS area FROM ({RINGS}) t UNION ALL SELECT id, 1, 24.0 FROM ({RINGS}) t WHERE shape = 0""",
)
def valid_parts(v):
    from ...operators.shapes import valid_rings

    df = valid_rings(rings(v))
    return df.select("id", "part", round_half_up(F.abs(geom.shoelace(F.col("ring"))), 3).alias("area"))


@register(
    "C06_plausible_speed_and_lanes",
    r"""SELECT way_id, CASE WHEN s > 250 OR s IS NULL THEN -1 ELSE s END AS speed, CASE WHEN l > 8 OR l IS NULL THEN -1 ELSE l END AS lanes FROM (
        SELECT way_id, TRY_CAST(regexp_extract(maxspeed, '(\d+)', 1) AS INTEGER) AS s, TRY_CAST(regexp_extract(lanes, '(\d+)', 1) AS INTEGER) AS l FROM {ways}) t""",
)
def plausible(v):
    from ...operators.network import plausible as keep

    return v.ways.select(
        "way_id", F.coalesce(keep(first_int(F.col("maxspeed")), 250), F.lit(-1)).alias("speed"),
        F.coalesce(keep(first_int(F.col("lanes")), 8), F.lit(-1)).alias("lanes"),
    )
