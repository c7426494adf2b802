"""Rules for road and rail ways, nodes, stops and feature categories (B15-B20, C7)."""

from pyspark.sql import functions as F

from ...functions import link_rules as lr
from ...operators import network as net
from . import register

ROADS = """SELECT * FROM {tagged_ways} WHERE (highway IS NOT NULL OR route = 'ferry') AND coalesce(access, '') <> 'private'
    AND coalesce(area, '') <> 'yes'"""


@register("C07_usable_road_ways", f"SELECT way_id, highway FROM ({ROADS}) t")
def usable_roads(v):
    ways = v.tagged_ways.filter("highway IS NOT NULL OR route = 'ferry'")
    return lr.usable_road_ways(ways).select("way_id", "highway")


@register(
    "C07_usable_rail_ways",
    """SELECT way_id, railway FROM {tagged_ways} WHERE railway IS NOT NULL
       AND (service IS NULL OR (service NOT IN ('yard', 'spur', 'siding') AND coalesce(disused, '') <> 'yes'))
       AND (highway IS NULL OR highway = 'service')""",
)
def usable_rails(v):
    return lr.usable_rail_ways(v.tagged_ways.filter("railway IS NOT NULL")).select("way_id", "railway")


def _defaults_sql(rules):
    rows = []
    for (key, value), (lanes, lanes_one, oneway, speed, modes, walk) in rules.defaults.items():
        rows.append(f"('{key}', '{value}', '{lanes}', '{lanes_one}', '{oneway}', '{speed}', '{','.join(modes)}', {walk})")
    lanes, lanes_one, oneway, speed, modes, walk = rules.fallback
    return f"""WITH rules(k, val, d_lanes, d_lanes_one, d_oneway, d_speed, d_modes, d_walk) AS (VALUES {', '.join(rows)}),
      w AS (SELECT t.*, coalesce(h.d_lanes, c.d_lanes, r.d_lanes, f.d_lanes, '{lanes}') AS d_lanes,
          coalesce(h.d_lanes_one, c.d_lanes_one, r.d_lanes_one, f.d_lanes_one, '{lanes_one}') AS d_lanes_one,
          coalesce(h.d_oneway, c.d_oneway, r.d_oneway, f.d_oneway, '{oneway}') AS d_oneway,
          coalesce(h.d_speed, c.d_speed, r.d_speed, f.d_speed, '{speed}') AS d_speed,
          coalesce(h.d_modes, c.d_modes, r.d_modes, f.d_modes, '{','.join(modes)}') AS d_modes
        FROM ({ROADS}) t LEFT JOIN rules h ON h.k = 'highway' AND h.val = t.highway
        LEFT JOIN rules c ON c.k = 'construction' AND c.val = t.construction
        LEFT JOIN rules r ON r.k = 'railway' AND r.val = t.railway LEFT JOIN rules f ON f.k = 'route' AND f.val = t.route),
      o AS (SELECT *, coalesce(oneway, CASE WHEN junction = 'roundabout' THEN 'yes' END, d_oneway) AS w_oneway FROM w),
      x AS (SELECT *, coalesce(lanes, CASE WHEN w_oneway = 'yes' THEN d_lanes_one
          ELSE coalesce(CASE WHEN railway = 'tram' THEN tracks END, d_lanes) END) AS w_lanes,
          coalesce(maxspeed, d_speed) AS w_maxspeed, coalesce(layer, level, '0') AS w_level,
          CASE WHEN highway = 'construction' THEN construction ELSE highway END AS w_highway,
          coalesce(route, '') = 'ferry' AS ferry, concat(',', d_modes, ',') AS ms FROM o),
      y AS (SELECT *, contains(ms, ',CAR,') AND NOT (ferry AND coalesce(car, '') = 'no') AS car_ok,
          contains(ms, ',HGV,') AND NOT (ferry AND coalesce(hgv, '') = 'no') AS hgv_ok,
          contains(ms, ',BUS,') AND NOT (ferry AND coalesce(hgv, '') = 'no') AS bus_ok, contains(ms, ',BIKE,') AS bike_ok,
          contains(ms, ',PED,') AND NOT (ferry AND coalesce(foot, '') = 'no') AS ped_ok, contains(ms, ',RAIL,') AS rail_ok,
          contains(ms, ',LR,') AS lr_ok, contains(ms, ',SUB,') AS sub_ok,
          contains(ms, ',TRAM,') OR coalesce(railway, '') = 'tram' AS tram_ok FROM x)"""


YN = lambda c: f"CASE WHEN {c}_ok THEN 'yes' ELSE 'no' END AS w_{c}"
DEFAULT_OUT = f"""SELECT way_id, coalesce(w_highway, '-') AS w_highway, w_oneway, w_lanes, w_maxspeed, w_level,
    {', '.join(YN(c) for c in ('car', 'hgv', 'bike', 'ped', 'bus', 'rail', 'lr', 'sub', 'tram'))} FROM y"""
DEFAULT_COLUMNS = ["w_oneway", "w_lanes", "w_maxspeed", "w_level"] + [f"w_{m.lower()}" for m in lr.MODES]


def roads(v):
    return lr.usable_road_ways(v.tagged_ways.filter("highway IS NOT NULL OR route = 'ferry'"))


@register("B15_link_defaults", f"{_defaults_sql(lr.STANDARD_RULES)} {DEFAULT_OUT}")
def link_defaults(v):
    df = lr.apply_link_defaults(roads(v))
    return df.select("way_id", F.coalesce("w_highway", F.lit("-")).alias("w_highway"), *DEFAULT_COLUMNS)


@register("B15_link_defaults_urban_rules", f"{_defaults_sql(lr.URBAN_RULES)} {DEFAULT_OUT}")
def link_defaults_urban(v):
    df = lr.apply_link_defaults(roads(v), lr.URBAN_RULES)
    return df.select("way_id", F.coalesce("w_highway", F.lit("-")).alias("w_highway"), *DEFAULT_COLUMNS)


def _types_sql(rules):
    text = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    rows = ", ".join(f"({no}, {text(h)}, {text(r)}, {text(f)}, {text(lo)}, {text(hi)})" for no, _, h, r, f, lo, hi in rules.types)
    return f"""{_defaults_sql(rules)}, types(no, h, r, f, lo, hi) AS (VALUES {rows}),
      m AS (SELECT y.way_id, t.no, (CASE WHEN t.h IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN t.r <> '*' THEN 1 ELSE 0 END
          + CASE WHEN t.f IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN t.lo IS NOT NULL THEN 1 ELSE 0 END) AS conditions
        FROM y JOIN types t ON (t.h IS NULL OR t.h = y.w_highway) AND (t.r IS NULL OR t.r = y.railway OR (t.r = '*' AND y.railway IS NOT NULL))
          AND (t.f IS NULL OR t.f = y.route) AND (t.lo IS NULL OR CAST(y.w_lanes AS INTEGER) >= t.lo)
          AND (t.hi IS NULL OR CAST(y.w_lanes AS INTEGER) <= t.hi)),
      b AS (SELECT way_id, no, row_number() OVER (PARTITION BY way_id ORDER BY conditions DESC, no) AS rn FROM m)
      SELECT y.way_id, CAST(coalesce(b.no, {rules.default_type}) AS INTEGER) AS link_type FROM y LEFT JOIN b ON b.way_id = y.way_id AND b.rn = 1"""


@register("B16_link_type_rules", _types_sql(lr.STANDARD_RULES))
def link_types(v):
    df = lr.apply_link_defaults(roads(v))
    return df.select("way_id", lr.link_type(df).alias("link_type"))


@register("B16_link_type_rules_urban", _types_sql(lr.URBAN_RULES))
def link_types_urban(v):
    df = lr.apply_link_defaults(roads(v), lr.URBAN_RULES)
    return df.select("way_id", lr.link_type(df, lr.URBAN_RULES).alias("link_type"))


@register(
    "B17_link_attributes",
    f"""{_defaults_sql(lr.STANDARD_RULES)} SELECT way_id, coalesce(name, ref) AS link_name, CAST(w_maxspeed AS INTEGER) AS v0,
        coalesce(CASE WHEN bridge = 'viaduct' THEN 'Viaduct' WHEN bridge = 'yes' THEN 'Bridge' WHEN tunnel = 'yes' THEN 'Tunnel' END, '-') AS structure,
        CASE WHEN construction IS NOT NULL THEN 1 ELSE 0 END AS under_construction,
        CASE WHEN junction = 'roundabout' THEN 1 ELSE 0 END AS roundabout,
        CASE surface WHEN 'asphalt' THEN 'smoothly paved' WHEN 'gravel' THEN 'roughly paved' WHEN 'dirt' THEN 'unpaved' ELSE 'unknown' END AS surface_class,
        coalesce(CASE WHEN highway = 'footway' THEN 'highway==footway' WHEN foot = 'designated' THEN 'foot==designated'
          WHEN foot = 'yes' THEN 'foot==yes' WHEN sidewalk = 'both' THEN 'sidewalk==both' END, '-') AS foot_infra_text,
        CASE WHEN highway = 'footway' OR foot IN ('designated', 'yes') OR sidewalk = 'both' THEN 1 ELSE 0 END AS foot_infra,
        coalesce(CASE WHEN highway = 'cycleway' THEN 'highway==cycleway' WHEN bicycle = 'yes' THEN 'bicycle==yes'
          WHEN cycleway = 'lane' THEN 'cycleway==lane' WHEN cycleway = 'opposite' THEN 'cycleway==opposite' END, '-') AS cycle_infra_text,
        CASE WHEN highway = 'cycleway' OR bicycle = 'yes' OR cycleway IN ('lane', 'opposite') THEN 1 ELSE 0 END AS cycle_infra FROM y""",
)
def link_attributes(v):
    df = lr.link_attributes(lr.apply_link_defaults(roads(v)))
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    flag = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return df.select(
        "way_id", "link_name", "v0", dash("structure"), flag("under_construction"), flag("roundabout"), "surface_class",
        dash("foot_infra_text"), "foot_infra", dash("cycle_infra_text"), "cycle_infra",
    )


NODE_TAGS = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'traffic_signals' WHEN 1 THEN 'motorway_junction' WHEN 2 THEN 'stop' END AS highway,
    CASE p_partkey % 3 WHEN 0 THEN 'traffic_signals' WHEN 1 THEN 'zebra' END AS crossing, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS name,
    p_brand AS ref, CASE p_partkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS wheelchair, p_type AS operator,
    CASE WHEN p_partkey % 8 = 0 THEN CAST(p_partkey AS VARCHAR(12)) END AS uic_ref, CASE WHEN p_partkey % 7 = 0 THEN p_brand END AS brand FROM {part}"""


@register(
    "B18_node_attributes",
    f"""SELECT id, CASE WHEN highway = 'traffic_signals' AND coalesce(crossing, '') <> 'traffic_signals' THEN 3 ELSE 0 END AS control_type,
        CASE WHEN highway = 'motorway_junction' THEN 1 ELSE 0 END AS junction,
        coalesce(CASE WHEN highway = 'motorway_junction' THEN name END, '-') AS junction_name,
        coalesce(CASE WHEN highway = 'motorway_junction' THEN ref END, '-') AS junction_code FROM ({NODE_TAGS}) t""",
)
def node_attributes(v):
    df = lr.node_attributes(v.sql(NODE_TAGS))
    return df.select(
        "id", "control_type", F.coalesce("junction", F.lit(0)).alias("junction"),
        F.coalesce("junction_name", F.lit("-")).alias("junction_name"), F.coalesce("junction_code", F.lit("-")).alias("junction_code"),
    )


@register(
    "B18_turn_attributes",
    """SELECT a.from_node, a.to_node AS via_node, b.to_node, CAST(a.way_id AS VARCHAR) AS relation_id FROM {links} a JOIN {links} b ON b.way_id = a.way_id
       AND b.seq = a.seq + 1""",
)
def turn_attributes(v):
    """Turns from each link of a way to its next; the way stands for the relation."""
    after = v.links.select(F.col("way_id").alias("id"), (F.col("seq") - 1).alias("seq"), "to_node")
    turns = v.links.select(F.col("way_id").alias("id"), "seq", "from_node", F.col("to_node").alias("via_node")).join(after, ["id", "seq"])
    return lr.turn_attributes(turns).select("from_node", "via_node", "to_node", "relation_id")


@register(
    "B18_stop_attributes",
    f"""SELECT id, coalesce(name, ref) AS stop_name, ref AS stop_code, CASE WHEN wheelchair = 'yes' THEN 1 ELSE 0 END AS wheelchair_flag,
        coalesce(uic_ref, '-') AS uic_code, operator AS operator_name, coalesce(brand, '-') AS brand_name FROM ({NODE_TAGS}) t""",
)
def stop_attributes(v):
    df = lr.stop_attributes(v.sql(NODE_TAGS))
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return df.select("id", "stop_name", "stop_code", "wheelchair_flag", dash("uic_code"), "operator_name", dash("brand_name"))


CATEGORY_TAGS = """SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'traffic_signals' WHEN 1 THEN 'pedestrian' END AS highway,
    CASE p_partkey % 8 WHEN 1 THEN 'parking' END AS amenity, CASE p_partkey % 6 WHEN 1 THEN 'private' WHEN 2 THEN 'customers' END AS access,
    CASE p_partkey % 7 WHEN 1 THEN 'residential' WHEN 2 THEN 'industrial' WHEN 3 THEN 'water' END AS landuse,
    CASE p_partkey % 10 WHEN 1 THEN 'water' END AS nat, CASE p_partkey % 11 WHEN 1 THEN 'park' END AS leisure,
    CASE p_partkey % 4 WHEN 2 THEN 'administrative' WHEN 3 THEN 'postal_code' END AS boundary,
    CASE p_partkey % 5 WHEN 0 THEN '8' WHEN 1 THEN '9' WHEN 2 THEN '10' WHEN 3 THEN '6' END AS admin_level,
    CASE p_partkey % 3 WHEN 0 THEN 'traffic_signals' END AS crossing, CAST(p_size AS VARCHAR(10)) AS capacity,
    CASE p_partkey % 2 WHEN 0 THEN 'yes' END AS park_ride, p_brand AS postal_code FROM {part}"""


@register(
    "B19_poi_category",
    f"""WITH c AS (SELECT *, CASE WHEN highway = 'traffic_signals' THEN 11
          WHEN amenity = 'parking' AND coalesce(access, '') NOT IN ('private', 'customers') THEN 12 WHEN landuse = 'residential' THEN 21
          WHEN landuse = 'industrial' THEN 22 WHEN landuse = 'water' OR nat = 'water' THEN 23 WHEN leisure = 'park' THEN 24
          WHEN highway = 'pedestrian' THEN 25 WHEN boundary = 'postal_code' THEN 31 WHEN boundary = 'administrative' AND admin_level = '8' THEN 34
          WHEN boundary = 'administrative' AND admin_level = '9' THEN 35 WHEN boundary = 'administrative' AND admin_level = '10' THEN 36 ELSE 0 END AS category
        FROM ({CATEGORY_TAGS}) t),
        names(no, label, up) AS (VALUES (11, 'Signals', 10), (12, 'Public Parking', 10), (21, 'Residential', 20), (22, 'Industrial', 20),
          (23, 'Water', 20), (24, 'Park', 20), (25, 'PedestrianZones', 20), (31, 'Postal zones', 30), (34, 'Municipality', 30),
          (35, 'Quarter', 30), (36, 'Neighbourhood', 30))
        SELECT id, category, coalesce(label, '') AS category_name, coalesce(up, 0) AS parent_category,
          CASE WHEN category = 11 AND crossing = 'traffic_signals' THEN 1 ELSE 0 END AS pedestrian_signal,
          CASE WHEN category = 12 THEN capacity ELSE '-' END AS capacity_text,
          CASE WHEN category = 12 AND coalesce(park_ride, 'no') <> 'no' THEN 1 ELSE 0 END AS park_and_ride,
          CASE WHEN category = 31 THEN postal_code ELSE '-' END AS postal_code_text
        FROM c LEFT JOIN names ON no = category""",
)
def poi_category(v):
    df = v.sql(CATEGORY_TAGS).withColumnRenamed("nat", "natural")
    df = lr.category_attributes(lr.poi_category(df))
    return df.select(
        "id", "category", "category_name", "parent_category", F.coalesce("pedestrian_signal", F.lit(0)).alias("pedestrian_signal"),
        F.coalesce("capacity_text", F.lit("-")).alias("capacity_text"), F.coalesce("park_and_ride", F.lit(0)).alias("park_and_ride"),
        F.coalesce("postal_code_text", F.lit("-")).alias("postal_code_text"),
    )


@register(
    "B20_transport_system_sets",
    f"""{_defaults_sql(lr.STANDARD_RULES)} SELECT way_id, array_to_string(list_sort(list_filter([CASE WHEN bike_ok THEN 'BIKE' END,
        CASE WHEN bus_ok THEN 'BUS' END, CASE WHEN car_ok THEN 'CAR' END, CASE WHEN hgv_ok THEN 'HGV' END, CASE WHEN lr_ok THEN 'LRT' END,
        CASE WHEN rail_ok THEN 'RAIL' END, CASE WHEN sub_ok THEN 'SUBWAY' END, CASE WHEN tram_ok THEN 'TRAM' END,
        CASE WHEN ped_ok THEN 'WALK' END], lambda c: c IS NOT NULL)), ',') AS tsys FROM y""",
)
def tsys_sets(v):
    df = lr.apply_link_defaults(roads(v))
    return df.select("way_id", lr.tsys_set(df).alias("tsys"))


@register(
    "B20_rail_systems_and_types",
    """SELECT way_id, coalesce(tracks, '2') AS lanes, CASE railway WHEN 'rail' THEN 'RAIL' WHEN 'light_rail' THEN 'LRT' WHEN 'subway' THEN 'SUBWAY' ELSE 'TRAM' END AS tsys,
         CASE railway WHEN 'rail' THEN 81 WHEN 'light_rail' THEN 82 WHEN 'subway' THEN 83 ELSE 84 END AS link_type
       FROM {tagged_ways} WHERE railway IS NOT NULL
         AND (service IS NULL OR (service NOT IN ('yard', 'spur', 'siding') AND coalesce(disused, '') <> 'yes'))
         AND (highway IS NULL OR highway = 'service')""",
)
def rail_systems(v):
    df = lr.apply_rail_defaults(lr.usable_rail_ways(v.tagged_ways.filter("railway IS NOT NULL")))
    return df.select("way_id", F.col("w_lanes").alias("lanes"), lr.tsys_set(df).alias("tsys"), lr.link_type(df).alias("link_type"))


TYPE_SETS = """SELECT p_partkey AS type_no, CASE p_partkey % 4 WHEN 0 THEN 'BUS,MINIBUS' WHEN 1 THEN 'CAR, MINIBUS' WHEN 2 THEN 'CAR,TAXI,MINIBUS'
    ELSE 'CAR' END AS tsys FROM {part}"""


@register(
    "N20_extend_transport_systems",
    f"""SELECT type_no, CASE type_no % 4 WHEN 0 THEN 'BUS,MINIBUS,TAXI' WHEN 1 THEN 'CAR,MINIBUS,TAXI' WHEN 2 THEN 'CAR,TAXI,MINIBUS' ELSE 'CAR' END AS tsys
        FROM ({TYPE_SETS}) t""",
)
def extend_tsys(v):
    return net.extend_tsys(v.sql(TYPE_SETS), "MINIBUS", "TAXI")
