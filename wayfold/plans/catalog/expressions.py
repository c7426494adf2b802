"""Scalar expressions: projections, identifiers, POI rules, mix indices, names (B)."""

from pyspark.sql import functions as F

from ...functions import geom, mix, names, poi_rules
from ...functions.maths import first_int, round_half_up, saturate
from ...functions.tags import tag_map
from ...operators import zones as zone_ops
from . import register, rnd

LONLAT = """SELECT id, x / 300007 * 360 - 180 AS lon, y / 299993 * 180 - 90 AS lat FROM {places}"""


@register(
    "B01_utm_epsg",
    f"""SELECT id, CAST(coalesce(CASE WHEN lat BETWEEN -80 AND 84 THEN floor((lon + 180) / 6) + 1
          + CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END END, 0) AS INTEGER) AS epsg FROM ({LONLAT}) t""",
)
def utm_epsg(v):
    df = v.sql(LONLAT)
    return df.select("id", F.coalesce(geom.utm_epsg(F.col("lat"), F.col("lon")), F.lit(0)).alias("epsg"))


def _utm_sql():
    a, n, k = geom._ALPHA, geom._N, geom.UTM_SCALE * geom._RECTIFYING
    e = 2.0 * n**0.5 / (1.0 + n)
    series = lambda fn1, fn2: " + ".join(
        f"{c!r} * {fn1}({2 * j} * xi) * {fn2}({2 * j} * eta)" for j, c in enumerate(a, 1)
    )
    return f"""WITH g AS (SELECT id, lon, lat, floor((lon + 180) / 6) + 1 AS zone FROM ({LONLAT}) t WHERE lat BETWEEN -80 AND 84),
        c AS (SELECT *, radians(lat) AS phi, radians(lon - (zone * 6 - 183)) AS lam FROM g),
        t AS (SELECT *, sinh(atanh(sin(phi)) - {e!r} * atanh({e!r} * sin(phi))) AS t FROM c),
        p AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
        SELECT id, CAST(zone AS INTEGER) AS zone, {rnd(f"500000 + {k!r} * (eta + {series('cos', 'sinh')})", 3)} AS easting,
          {rnd(f"CASE WHEN lat >= 0 THEN 0 ELSE 10000000 END + {k!r} * (xi + {series('sin', 'cosh')})", 3)} AS northing,
          {rnd('lon', 4)} AS lon_back, {rnd('lat', 4)} AS lat_back FROM p"""


@register("B02_reproject_there_and_back", _utm_sql())
def reproject(v):
    df = v.sql(LONLAT).filter("lat BETWEEN -80 AND 84").withColumn("zone", geom.utm_zone(F.col("lat"), F.col("lon")))
    east, north = geom.to_utm(F.col("lon"), F.col("lat"), F.col("zone"))
    df = df.withColumns({"e": east, "n": north})
    lon, lat = geom.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("lat") < 0)
    return df.select(
        "id", "zone", round_half_up(F.col("e"), 3).alias("easting"), round_half_up(F.col("n"), 3).alias("northing"),
        round_half_up(lon, 4).alias("lon_back"), round_half_up(lat, 4).alias("lat_back"),
    )


ISO = "DEU, DNK,POL,CZE,AUT,CHE,FRA,LUX,BEL,NLD"
GIDS = """SELECT p_partkey AS id, concat(CASE p_partkey % 4 WHEN 0 THEN 'DEU' WHEN 1 THEN 'DNK' WHEN 2 THEN 'POL' ELSE 'ITA' END,
    '.', CAST(p_size AS VARCHAR(10)), '.', CAST(p_partkey % 401 AS VARCHAR(10)), '.', CAST(p_partkey % 1000 AS VARCHAR(10)), '_1') AS gid,
    concat(CASE p_partkey % 4 WHEN 0 THEN 'DEU' WHEN 1 THEN 'DNK' WHEN 2 THEN 'POL' ELSE 'ITA' END,
    '.', CAST(p_size AS VARCHAR(10)), '_', CAST(1 + p_partkey % 2 AS VARCHAR(10))) AS gid1 FROM {part}"""
PART = lambda i, col="gid": f"lpad(regexp_replace(split_part({col}, '.', {i}), '_.*', ''), 3, '0')"


@register(
    "B03_normalize_gid",
    f"""SELECT id, concat(split_part(gid, '.', 1), {PART(2)}, {PART(3)}, {PART(4)}) AS gid_3,
          concat(left(gid1, 3), {PART(2, 'gid1')}) AS gid_1 FROM ({GIDS}) t""",
)
def normalize_gid(v):
    df = v.sql(GIDS)
    return df.select("id", names.normalize_gid(F.col("gid"), 3).alias("gid_3"), names.normalize_gid(F.col("gid1"), 1).alias("gid_1"))


POSITION = "CASE left(gid, 3) WHEN 'DEU' THEN '2' WHEN 'DNK' THEN '3' WHEN 'POL' THEN '4' ELSE '1' END"


@register(
    "B04_zone_numbers",
    f"""SELECT id, CAST(concat({POSITION}, {PART(2)}, {PART(3)}, {PART(4)}) AS BIGINT) AS zoneno,
          CAST(concat({POSITION}, {PART(2)}, {PART(3)}) AS BIGINT) AS mainzoneno FROM ({GIDS}) t""",
)
def zone_numbers(v):
    df = v.sql(GIDS)
    return df.select(
        "id", names.zone_no(F.col("gid"), ISO, 3).cast("long").alias("zoneno"), names.zone_no(F.col("gid"), ISO, 2).cast("long").alias("mainzoneno")
    )


@register(
    "B05_field_mapping_sequential_ids",
    """SELECT id AS OSM_ID, upper(name) AS NAME, CAST(pop AS DOUBLE) AS POP, 9 AS TYPENO,
         row_number() OVER (ORDER BY pop DESC, id) AS FID FROM {places}""",
)
def field_mapping(v):
    from ...operators.common import with_rank

    ranked = with_rank(v.places, [F.col("pop").desc(), F.col("id")], "FID")
    return ranked.select(
        F.col("id").alias("OSM_ID"), F.upper("name").alias("NAME"), F.col("pop").cast("double").alias("POP"), F.lit(9).alias("TYPENO"), "FID"
    )


REPAIR = """SELECT id, CASE WHEN id % 4 <> 0 THEN pop / 7.0 END AS pop_sum, name,
    CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN concat(name, ' EN') END AS name_en,
    CASE WHEN id % 5 <> 0 THEN x END AS xcoord, CASE WHEN id % 5 <> 0 THEN y END AS ycoord, x - 10 AS xmin, x + 30 AS xmax,
    y - 10 AS ymin, y + 50 AS ymax, CASE id % 6 WHEN 0 THEN 'PA' WHEN 1 THEN 'IA1' END AS zone_type FROM {places}"""


@register(
    "B06_null_repair",
    f"""SELECT id, CAST(coalesce(ceil(pop_sum), 0) AS BIGINT) AS pop, coalesce(nullif(name_en, ''), name) AS name,
          coalesce(xcoord, (xmin + xmax) / 2) AS xcoord, coalesce(ycoord, (ymin + ymax) / 2) AS ycoord,
          coalesce(CASE WHEN id % 2 = 0 THEN name END, 'Fallback_Geometric_Center') AS label,
          coalesce(zone_type, 'OA') AS zone_type FROM ({REPAIR}) t""",
)
def null_repair(v):
    df = v.sql(REPAIR).withColumn("label", F.expr("CASE WHEN id % 2 = 0 THEN name END"))
    return zone_ops.repair_places(df).select("id", "pop", "name", "xcoord", "ycoord", "label", "zone_type")


POIS_TAGGED = """SELECT fid, osm_id, concat(name, CASE fid % 9 WHEN 0 THEN ' Annex II' WHEN 1 THEN ' main entrance' WHEN 2 THEN ' 12'
      WHEN 3 THEN ' Gymnasium' WHEN 4 THEN ' Universitätsklinik iii' WHEN 5 THEN ' Amt' WHEN 6 THEN ' Grundschule campus' ELSE '' END) AS name,
    amenity, shop, tourism, x, y,
    CASE fid % 13 WHEN 0 THEN 'government' WHEN 1 THEN 'notary' END AS office,
    CASE fid % 11 WHEN 0 THEN 'stadium' WHEN 1 THEN 'sports_hall' WHEN 2 THEN 'pitch' END AS leisure,
    CASE fid % 17 WHEN 0 THEN 'clinic' WHEN 1 THEN 'pharmacy' END AS healthcare,
    CASE fid % 10 WHEN 0 THEN '0;1' WHEN 1 THEN '2' WHEN 2 THEN '3;6' END AS isced FROM {pois}"""
POI_KEYS = ("name", "amenity", "shop", "tourism", "office", "leisure", "healthcare", "isced:level")


def pois(v):
    """Points of interest with all their tags."""
    df = v.sql(POIS_TAGGED).withColumnRenamed("isced", "isced:level")
    return df.select("fid", "osm_id", "x", "y", *[F.col(f"`{k}`") for k in POI_KEYS])


RELEVANT = """(coalesce(amenity, '') IN ('school', 'hospital', 'bank', 'library', 'university', 'pharmacy', 'townhall')
    OR coalesce(office, '') = 'government' OR coalesce(shop, '') IN ('supermarket', 'mall', 'bakery') OR tourism = 'museum'
    OR coalesce(leisure, '') IN ('stadium', 'sports_hall') OR coalesce(healthcare, '') IN ('clinic', 'pharmacy'))"""
SECTOR = """CASE WHEN amenity IN ('townhall', 'bank') OR office = 'government' THEN 'GOVERNMENT'
    WHEN amenity IN ('university', 'school') THEN 'EDUCATION' WHEN shop IN ('mall', 'supermarket', 'bakery') THEN 'RETAIL'
    WHEN tourism = 'museum' OR leisure IN ('stadium', 'sports_hall') OR amenity = 'library' THEN 'LEISURE'
    WHEN amenity IN ('hospital', 'pharmacy') OR healthcare IN ('clinic', 'pharmacy') THEN 'HEALTHCARE' ELSE 'OTHER' END"""


def _class_sql():
    """The class letters as text, with the whole name patterns, for the tags that occur."""
    rules = poi_rules.CLASSES
    out = []
    for sector, (first, second, default) in rules.items():
        tests = []
        for letter, level, wanted, pattern in (first, second):
            terms = [f"regexp_matches(names, '{pattern.replace(chr(39), chr(39) * 2)}')"]
            if level:
                terms.append(f"coalesce(regexp_matches(isced, '{level}'), false)")
            for key, values in wanted.items():
                terms.append(f"coalesce({key} IN ({', '.join(repr(x) for x in values)}), false)")
            tests.append(f"WHEN {' OR '.join(terms)} THEN '{letter}'")
        out.append(f"WHEN sector = '{sector}' THEN CASE {' '.join(tests)} ELSE '{default[0]}' END")
    return f"CASE {' '.join(out)} END"


CLASSIFIED = f"""SELECT *, {_class_sql()} AS classification FROM (
    SELECT *, {SECTOR} AS sector, lower(name) AS names FROM ({POIS_TAGGED}) t WHERE {RELEVANT}) s"""


@register("B07_poi_whitelist", f"SELECT fid, name FROM ({POIS_TAGGED}) t WHERE {RELEVANT}")
def poi_whitelist(v):
    df = pois(v)
    return df.filter(poi_rules.is_relevant(df)).select("fid", "name")


@register("B08_poi_sector", f"SELECT fid, {SECTOR} AS sector FROM ({POIS_TAGGED}) t")
def poi_sector(v):
    df = pois(v)
    return df.select("fid", poi_rules.poi_sector(df).alias("sector"))


@register("B09_poi_class", f"SELECT fid, sector, coalesce(classification, '-') AS classification FROM ({CLASSIFIED}) t")
def poi_class(v):
    df = pois(v)
    df = df.filter(poi_rules.is_relevant(df)).withColumn("sector", poi_rules.poi_sector(df))
    return df.select("fid", "sector", F.coalesce(poi_rules.poi_class(df, F.col("sector")), F.lit("-")).alias("classification"))


def _first_match_sql(rules, default):
    return "CASE " + " ".join(
        f"WHEN {k} = '{x}' THEN {r if isinstance(r, int) else repr(r)}" for k, x, r in rules
    ) + f" ELSE {default} END"


WEIGHT = _first_match_sql(poi_rules.WEIGHTS, -1)
RADIUS = "CASE weight WHEN 4 THEN 500 WHEN 3 THEN 250 WHEN 2 THEN 175 WHEN 1 THEN 100 ELSE 0 END"


@register(
    "B10_poi_weight_radius_description",
    f"""SELECT fid, weight, {RADIUS} AS radius, description FROM (SELECT fid, {WEIGHT} AS weight,
        {_first_match_sql(poi_rules.DESCRIPTIONS, "'Other'")} AS description FROM ({POIS_TAGGED}) t) w""",
)
def poi_weight(v):
    df = pois(v)
    df = df.withColumns({"weight": poi_rules.poi_weight(df), "description": poi_rules.poi_description(df)})
    return df.select("fid", "weight", poi_rules.poi_radius(F.col("weight")).alias("radius"), "description")


NAME_BASE = r"""array_to_string(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(name, '')),
    '\b(entrance|extention|extension|annex|main|campus)\b', '', 'g'), '\s(i{1,3}|iv|v|[0-9]+)$', '')), ' ')[1:3], ' ')"""


@register("B11_name_base", f"SELECT fid, name, {NAME_BASE} AS name_base FROM ({POIS_TAGGED}) t")
def name_base(v):
    return pois(v).select("fid", "name", names.name_base(F.col("name")).alias("name_base"))


MIX = """SELECT id, government, education, retail, leisure, healthcare, government + education + retail + leisure + healthcare AS total_intensity
    FROM (SELECT id, CAST(id % 5 AS DOUBLE) AS government, CAST(pop % 7 AS DOUBLE) / 2 AS education, CAST(pop % 11 AS DOUBLE) / 4 AS retail,
    CAST(id % 3 AS DOUBLE) AS leisure, CAST(pop % 4 AS DOUBLE) AS healthcare FROM {places}) s"""
ENT = " + ".join(f"CASE WHEN p_{s} > 0 THEN p_{s} * ln(p_{s}) ELSE 0 END" for s in mix.MIX_SECTORS)


@register(
    "B12_mix_index",
    f"""WITH m AS ({MIX}), p AS (SELECT id, {', '.join(rnd(f'CASE WHEN total_intensity <> 0 THEN {s} / total_intensity END', 2) + f' AS p_{s}' for s in mix.MIX_SECTORS)} FROM m),
        e AS (SELECT *, {rnd(f'-({ENT})', 3)} AS entropy FROM p)
        SELECT id, {', '.join(f'coalesce(p_{s}, -1.0) AS p_{s}' for s in mix.MIX_SECTORS)}, entropy, {rnd('entropy / ln(5)', 3)} AS entropy_index FROM e""",
)
def mix_index(v):
    df = mix.mix_index(v.sql(MIX))
    return df.select("id", *[F.coalesce(f"p_{s}", F.lit(-1.0)).alias(f"p_{s}") for s in mix.MIX_SECTORS], "entropy", "entropy_index")


@register(
    "B13_saturated_intensity",
    f"""WITH m AS ({MIX}) SELECT id, {', '.join(rnd(f'5 * (1 - exp(-0.2773 * {s}))', 6) + f' AS {s}' for s in mix.MIX_SECTORS)},
        {rnd(' + '.join(f'5 * (1 - exp(-0.2773 * {s}))' for s in mix.MIX_SECTORS), 6)} AS total_intensity FROM m""",
)
def saturated(v):
    df = v.sql(MIX).select("id", *[saturate(F.col(s)).alias(s) for s in mix.MIX_SECTORS])
    total = sum((F.col(s) for s in mix.MIX_SECTORS[1:]), F.col(mix.MIX_SECTORS[0]))
    return df.select("id", *[round_half_up(F.col(s), 6).alias(s) for s in mix.MIX_SECTORS], round_half_up(total, 6).alias("total_intensity"))


@register(
    "B14_distances",
    f"""WITH p AS (SELECT id, x, y, x / 300007 * 360 - 180 AS lon, y / 299993 * 160 - 80 AS lat FROM {{places}})
        SELECT id, {rnd('sqrt((x - 150000) * (x - 150000) + (y - 150000) * (y - 150000))', 4)} AS euclid_m,
        {rnd('6373 * 2 * asin(sqrt(pow(sin(radians(48.78 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.78)) * pow(sin(radians(9.18 - lon) / 2), 2)))', 4)} AS haversine_km FROM p""",
)
def distances(v):
    df = v.sql("SELECT id, x, y, x / 300007 * 360 - 180 AS lon, y / 299993 * 160 - 80 AS lat FROM {places}")
    e = geom.dist_euclid(F.lit(150000.0), F.lit(150000.0), F.col("x"), F.col("y"))
    h = geom.dist_haversine(F.col("lon"), F.col("lat"), F.lit(9.18), F.lit(48.78))
    return df.select("id", round_half_up(e, 4).alias("euclid_m"), round_half_up(h, 4).alias("haversine_km"))


@register(
    "B21_zone_schema_coercion",
    """SELECT id AS "NO", concat('z', CAST(id AS VARCHAR)) AS "NAME", CAST(id % 10 AS BIGINT) AS "TYPENO",
         CAST(coalesce(CASE WHEN id % 3 = 0 THEN pop END, -1) AS BIGINT) AS "POP", x AS "XCOORD",
         CAST(id % 4 AS BIGINT) AS "NUM_RETAIL", CAST(id % 8 AS DOUBLE) / 8 AS "P_RETAIL" FROM {places}""",
)
def coerce_schema(v):
    raw = v.sql(
        """SELECT CAST(id AS STRING) AS ZoneNo, concat('z', CAST(id AS STRING)) AS Name, CAST(id % 10 AS STRING) AS TypeNo,
           CASE WHEN id % 3 = 0 THEN CAST(pop AS STRING) ELSE 'n/a' END AS pop, CAST(x AS STRING) AS XCoord,
           CAST(id % 4 AS STRING) AS Num_Retail, CAST(CAST(id % 8 AS DOUBLE) / 8 AS STRING) AS P_Retail FROM {places}"""
    )
    return zone_ops.coerce_zone_schema(raw).withColumn("POP", F.coalesce("POP", F.lit(-1).cast("long")))


REGION_NAMES = """SELECT p_partkey AS id, concat(CASE p_partkey % 3 WHEN 0 THEN 'us/' WHEN 1 THEN '' ELSE 'de/' END, replace(p_name, ' ', '-'),
    CASE p_partkey % 4 WHEN 0 THEN '<br />(state)' WHEN 1 THEN ' & co' ELSE '' END) AS name,
    CASE WHEN p_partkey % 17 > 0 THEN concat(CASE p_partkey % 4 WHEN 0 THEN 'Göttingen' WHEN 1 THEN 'Saint-Étienne' WHEN 2 THEN 'São Paulo' ELSE 'Århus' END,
      ' ', p_name, ', ', p_brand) END AS address,
    concat(CASE p_partkey % 3 WHEN 0 THEN '2024-05-06_' ELSE '' END, replace(p_name, ' ', '-'), CASE p_partkey % 4 WHEN 0 THEN '-latest'
      WHEN 1 THEN '-240506' WHEN 2 THEN '-20240506-latest' ELSE '' END, '.osm.pbf') AS filename FROM {part}"""


def _wide(sql):
    for a, b in names.TRANSLITERATE_WIDE:
        sql = f"replace({sql}, '{a}', '{b}')"
    return sql


# The checking side has no title-case function: words are capitalised one by one.
TITLE = "array_to_string(list_transform(string_split({0}, ' '), lambda w: concat(upper(left(w, 1)), lower(substr(w, 2)))), ' ')"


@register(
    "B22_name_keys",
    f"""SELECT id, trim(regexp_replace({TITLE.format(r"regexp_replace(replace(regexp_replace(regexp_replace(name, '(?i)<br\s*/?>', ' ', 'g'), '^[a-z]{2,3}/', ''), '-', ' '), '[^\w\s]', ' ', 'g')")}, '\\s+', ' ', 'g')) AS region,
        coalesce(regexp_replace(trim(regexp_replace(translate({_wide("split_part(address, ',', 1)")}, '{names.TRANSLITERATE_FROM}', '{names.TRANSLITERATE_TO}'), '[^\\p{{L}}\\w\\s-]', '', 'g')), '[-\\s]+', '_', 'g'), '{names.NO_PLACE_NAME}') AS city,
        regexp_replace(regexp_replace(replace(lower(filename), '.osm.pbf', ''), '^\\d{{4}}-\\d{{2}}-\\d{{2}}_', ''), '(-(latest|\\d{{6}}|\\d{{8}}))+$', '') AS extract_key,
        replace(regexp_replace(replace(regexp_replace(regexp_replace(lower(filename), '^\\d{{4}}-\\d{{2}}-\\d{{2}}_', ''), '-(latest|\\d{{6}})\\.osm\\.pbf$', ''), '.osm.pbf', ''), '-', '', 'g'), '_', '') AS loose_key
        FROM ({REGION_NAMES}) t""".replace("'-', '', 'g'), '_', '')", "'-', '', 'g'), '_', '')"),
)
def name_keys(v):
    df = v.sql(REGION_NAMES)
    return df.select(
        "id", names.clean_region_name(F.col("name")).alias("region"), names.clean_city(F.col("address")).alias("city"),
        names.extract_key(F.col("filename")).alias("extract_key"), names.compact_key(F.col("filename")).alias("loose_key"),
    )


@register(
    "B23_first_int",
    r"""SELECT way_id, coalesce(TRY_CAST(regexp_extract(maxspeed, '(\d+)', 1) AS INTEGER), -1) AS speed,
         coalesce(TRY_CAST(regexp_extract(lanes, '(\d+)', 1) AS INTEGER), -1) AS lanes FROM {ways}""",
)
def parse_first_int(v):
    return v.ways.select(
        "way_id", F.coalesce(first_int(F.col("maxspeed")), F.lit(-1)).alias("speed"), F.coalesce(first_int(F.col("lanes")), F.lit(-1)).alias("lanes")
    )
