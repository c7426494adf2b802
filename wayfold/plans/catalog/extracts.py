"""Sources, merging of extracts and feature extraction (A)."""

from pyspark.sql import functions as F

from ...functions.geom import box_ring, ring_centroid, shoelace
from ...functions.maths import round_half_up
from ...functions.tags import tag_map
from ...operators import common, osm, overlay
from . import register, rnd


@register(
    "A01_merge_extracts_newest_version",
    """SELECT kind, id, arg_max(version, version) AS version, arg_max(payload, version) AS payload
       FROM (SELECT * FROM {extract_a} UNION ALL SELECT * FROM {extract_b}) u GROUP BY kind, id""",
)
def merge_newest(v):
    return common.merge_extracts([v.extract_a, v.extract_b], ["kind", "id"], "version")


@register(
    "A02_merge_extracts_first_seen",
    """SELECT * FROM {extract_a} UNION ALL
       SELECT * FROM {extract_b} b WHERE NOT EXISTS (SELECT 1 FROM {extract_a} a WHERE a.kind = b.kind AND a.id = b.id)""",
)
def merge_first(v):
    return common.merge_first_seen([v.extract_a, v.extract_b], ["kind", "id"])


WAY_TAGS = ("highway", "construction", "railway", "route", "oneway", "junction", "lanes", "maxspeed", "access", "area", "name")


def tagged(v):
    return v.tagged_ways.select("way_id", tag_map(*WAY_TAGS).alias("tags"))


@register(
    "A03_tag_filter",
    """SELECT way_id, highway FROM {tagged_ways}
       WHERE highway IN ('motorway', 'trunk') OR route = 'ferry' OR junction = 'roundabout'""",
)
def tag_filter(v):
    clauses = {"highway": ("motorway", "trunk"), "route": ("ferry",), "junction": ("roundabout",)}
    kept = osm.tag_filter(tagged(v), clauses)
    return kept.select("way_id", F.col("tags")["highway"].alias("highway"))


@register(
    "A03_referenced_nodes",
    """SELECT DISTINCT n.node_id, n.x, n.y FROM {nodes} n JOIN {way_nodes} w ON w.node_id = n.node_id
       JOIN {tagged_ways} t ON t.way_id = w.way_id WHERE t.route = 'ferry'""",
)
def referenced(v):
    return osm.referenced_nodes(v.nodes, v.way_nodes, osm.tag_filter(tagged(v), {"route": ("ferry",)}))


def slanted_outline(v):
    """A diamond-shaped boundary from the extent of the nodes."""
    return v.nodes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).select(
        F.array(
            F.struct(((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y0").alias("y")),
            F.struct(F.col("x1").alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")),
            F.struct(((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y1").alias("y")),
            F.struct(F.col("x0").alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")),
        ).alias("ring")
    )


DIAMOND = """ext AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM {nodes}),
       inside AS (SELECT n.* FROM {nodes} n, ext
                  WHERE abs(x - (x0 + x1) / 2) / ((x1 - x0) / 2) + abs(y - (y0 + y1) / 2) / ((y1 - y0) / 2) < 1)"""


@register("A04_extract_nodes_within_outline", f"WITH {DIAMOND} SELECT node_id, x, y FROM inside")
def extract_nodes(v):
    return osm.extract_within(v.nodes, slanted_outline(v), 5000.0)


@register(
    "A04_extract_ways_within_outline",
    f"""WITH {DIAMOND},
        kept AS (SELECT DISTINCT w.way_id FROM {{way_nodes}} w JOIN inside i ON i.node_id = w.node_id),
        used AS (SELECT DISTINCT w.node_id FROM {{way_nodes}} w JOIN kept k ON k.way_id = w.way_id)
        SELECT 'way' AS kind, way_id AS id FROM kept UNION ALL SELECT 'node', node_id FROM used""",
)
def extract_ways(v):
    ways = v.way_nodes.select("way_id").distinct()
    kept, used = osm.extract_ways_within(ways, v.way_nodes, v.nodes, slanted_outline(v), 5000.0)
    return kept.select(F.lit("way").alias("kind"), F.col("way_id").alias("id")).unionByName(
        used.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"))
    )


PLACE_TAGS = """SELECT c_custkey AS id,
    CASE WHEN c_custkey % 7 <> 0 THEN concat(' ', c_name, ' ') END AS name,
    CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, ' EN') END AS name_en,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'city' WHEN 'MACHINERY' THEN 'town' WHEN 'FURNITURE' THEN 'village' END AS place
    FROM {customer}"""


@register(
    "A05_extract_places",
    f"""SELECT CAST(id AS VARCHAR) AS osm_id, coalesce(trim(name), '') AS name, coalesce(trim(name_en), '') AS name_en,
        place AS place_type FROM ({PLACE_TAGS}) t WHERE place IN ('city', 'town')""",
)
def extract_places(v):
    nodes = v.sql(PLACE_TAGS).withColumnRenamed("name_en", "name:en")
    return osm.extract_places(nodes.select("id", tag_map("name", "name:en", "place").alias("tags")))


FEATURES = """SELECT p_partkey AS id, x, y, p_partkey % 4 = 0 AS is_line,
    CAST(20 + p_partkey % 50 AS DOUBLE) AS w, CAST(20 + p_partkey % 70 AS DOUBLE) AS h,
    CASE p_partkey % 10 WHEN 0 THEN 'motorway' WHEN 4 THEN 'tertiary' WHEN 8 THEN 'footway' END AS highway,
    CASE p_partkey % 9 WHEN 1 THEN 'retail' WHEN 2 THEN 'house' END AS building,
    CASE p_partkey % 7 WHEN 1 THEN 'forest' WHEN 2 THEN 'cemetery' WHEN 3 THEN 'village_green' WHEN 4 THEN 'industrial' END AS landuse,
    CASE p_partkey % 6 WHEN 1 THEN 'water' WHEN 2 THEN 'wood' WHEN 3 THEN 'beach' END AS natural,
    CASE p_partkey % 11 WHEN 1 THEN 'park' WHEN 2 THEN 'stadium' END AS leisure,
    CASE p_partkey % 8 WHEN 1 THEN 'parking' WHEN 3 THEN 'hospital' END AS amenity,
    CASE WHEN p_partkey % 16 = 1 THEN 'underground' END AS parking,
    CASE WHEN p_partkey % 13 = 1 THEN 'underground' END AS location,
    CASE p_partkey % 5 WHEN 1 THEN 'mall' WHEN 2 THEN 'bakery' END AS shop
    FROM {part} JOIN {nodes} ON node_id = p_partkey"""
FEATURE_TAGS = ("highway", "building", "landuse", "natural", "leisure", "amenity", "parking", "location", "shop")


def features(v):
    df = v.sql(FEATURES)
    return df.select("id", "x", "y", "is_line", "w", "h", tag_map(*FEATURE_TAGS).alias("tags"))


LADDER = """CASE WHEN highway IS NOT NULL THEN 'street' WHEN building IS NOT NULL THEN 'building'
    WHEN landuse = 'forest' OR natural = 'wood' THEN 'forest'
    WHEN leisure = 'park' OR landuse = 'village_green' THEN 'park_recreation' WHEN natural = 'water' THEN 'water'
    WHEN natural IS NOT NULL OR landuse = 'cemetery' OR leisure IS NOT NULL THEN 'green_area'
    WHEN amenity IS NOT NULL OR shop IS NOT NULL THEN 'amenity_shop' ELSE 'other' END"""


@register(
    "A06_extract_uninhabited",
    f"""WITH f AS ({FEATURES.replace(' natural,', ' nat,')}),
        g AS (SELECT id, {LADDER.replace('natural', 'nat')} AS category, x - CASE WHEN is_line THEN 0.5 ELSE 0 END AS xmin,
          x + w + CASE WHEN is_line THEN 0.5 ELSE 0 END AS xmax, y - CASE WHEN is_line THEN 0.5 ELSE 0 END AS ymin,
          y + h + CASE WHEN is_line THEN 0.5 ELSE 0 END AS ymax
          FROM f WHERE (highway IN ('motorway', 'tertiary') OR shop = 'mall' OR building = 'retail' OR amenity IN ('hospital', 'parking')
            OR landuse IN ('cemetery', 'forest', 'village_green') OR leisure = 'park' OR nat IN ('wood', 'water'))
          AND NOT (coalesce(amenity, '') = 'parking' AND (coalesce(parking, '') = 'underground' OR coalesce(location, '') = 'underground')))
        SELECT id, category, greatest(xmin, 5000.0) AS xmin, least(xmax, 40000.0) AS xmax, greatest(ymin, 5000.0) AS ymin,
          least(ymax, 40000.0) AS ymax FROM g
        WHERE greatest(xmin, 5000.0) < least(xmax, 40000.0) AND greatest(ymin, 5000.0) < least(ymax, 40000.0)""",
)
def uninhabited(v):
    from ...operators.spatial import clip_boxes

    boxed = features(v).withColumns({"xmin": F.col("x"), "xmax": F.col("x") + F.col("w"), "ymin": F.col("y"), "ymax": F.col("y") + F.col("h")})
    window = v.spark.createDataFrame([(5000.0, 40000.0, 5000.0, 40000.0)], "wxmin double, wxmax double, wymin double, wymax double")
    kept = clip_boxes(osm.extract_uninhabited(boxed), window)
    return kept.select("id", "category", "xmin", "xmax", "ymin", "ymax")


def way_lines(v):
    """Uninhabited ways with their course; a way has at most 2000 nodes by format."""
    ways = osm.uninhabited_features(tagged(v))
    course = v.way_nodes.join(ways.select("way_id"), "way_id", "left_semi").join(v.nodes, "node_id")
    course = course.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("_c"))
    path = F.transform("_c", lambda c: F.struct(c.x.alias("x"), c.y.alias("y")))
    return course.select("way_id", path.alias("path")).join(ways.drop("category"), "way_id")


def corner(no, axis):
    return round_half_up(F.col("ring")[no][axis], 4).alias(f"{axis}{no + 1}")


STRIP = """SELECT l.way_id, CAST(l.seq - 1 AS INTEGER) AS part, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS len
    FROM {links} l JOIN {nodes} a ON a.node_id = l.from_node JOIN {nodes} b ON b.node_id = l.to_node JOIN {tagged_ways} t ON t.way_id = l.way_id
    WHERE t.highway IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary') AND (a.x <> b.x OR a.y <> b.y)"""
STRIP_CORNERS = ", ".join(
    f"{rnd(f'{end}x {lon} ux {lat_x} uy')} AS x{no}, {rnd(f'{y} {lon} uy {lat_y} ux')} AS y{no}"
    for no, (end, y, lon, lat_x, lat_y) in enumerate((("a", "ay", "-", "+", "-"), ("b", "by_", "+", "+", "-"), ("b", "by_", "+", "-", "+"), ("a", "ay", "-", "-", "+")), 1)
)


@register(
    "A06_line_strips",
    f"""WITH s AS (SELECT *, (bx - ax) / len * 0.5 AS ux, (by_ - ay) / len * 0.5 AS uy FROM ({STRIP}) g)
        SELECT way_id, part, 'street' AS category, {STRIP_CORNERS} FROM s""",
)
def line_strips(v):
    strips = osm.uninhabited_strips(way_lines(v))
    return strips.select("way_id", "part", "category", *[corner(no, axis) for no in range(4) for axis in "xy"])


@register("A06_strip_cells")
def strip_cells(v):
    """What the strips take from cells of 5 km inside a window; tested by brute force on a fixture."""
    from ...operators import shapes

    window = v.spark.createDataFrame([(5000.0, 40000.0, 5000.0, 40000.0)], "wxmin double, wxmax double, wymin double, wymax double")
    strips = osm.uninhabited_strips(way_lines(v)).select("way_id", "part", "category", "ring")
    return shapes.covered_cells(shapes.clip_rings(strips, window), 5000.0)


@register(
    "A07_extract_study_area_pois",
    f"""WITH f AS ({FEATURES.replace(' natural,', ' nat,')})
        SELECT CAST(id AS VARCHAR) AS osm_id, x, y, coalesce(amenity, '') AS amenity, coalesce(shop, '') AS shop,
          coalesce(leisure, '') AS leisure, coalesce(building, '') AS building, coalesce(landuse, '') AS landuse,
          coalesce(nat, '') AS nat
        FROM f WHERE amenity IS NOT NULL OR shop IS NOT NULL OR leisure IS NOT NULL OR building IS NOT NULL
          OR landuse IS NOT NULL OR nat IS NOT NULL""",
)
def study_area_pois(v):
    kept = osm.extract_pois(features(v))
    return kept.select("osm_id", "x", "y", "amenity", "shop", "leisure", "building", "landuse", F.col("natural").alias("nat"))


def _catalogue_sql():
    wanted = {k: vals for k, vals in osm.NON_RESIDENTIAL.items() if k in ("shop", "building", "amenity", "landuse", "leisure", "natural")}
    names = {"natural": "nat"}
    return " OR ".join(f"{names.get(k, k)} IN ({', '.join(repr(x) for x in vals)})" for k, vals in wanted.items())


@register(
    "A08_extract_nonresidential_parts",
    f"""WITH f AS ({FEATURES.replace(' natural,', ' nat,')}), hit AS (SELECT * FROM f WHERE {_catalogue_sql()}),
        parts AS (SELECT id, 0 AS part, x AS xmin, x + w AS xmax, y AS ymin, y + h AS ymax FROM hit
          UNION ALL SELECT id, 1, x + 2 * w, x + 3 * w, y, y + h FROM hit WHERE NOT is_line)
        SELECT id, part, greatest(xmin, 3000.0) AS xmin, least(xmax, 42000.0) AS xmax, greatest(ymin, 3000.0) AS ymin,
          least(ymax, 42000.0) AS ymax FROM parts
        WHERE greatest(xmin, 3000.0) < least(xmax, 42000.0) AND greatest(ymin, 3000.0) < least(ymax, 42000.0)""",
)
def nonresidential(v):
    box = lambda off: F.struct(
        (F.col("x") + off * F.col("w")).alias("xmin"), (F.col("x") + (off + 1) * F.col("w")).alias("xmax"),
        F.col("y").alias("ymin"), (F.col("y") + F.col("h")).alias("ymax"),
    )
    areas = features(v).withColumn("parts", F.when(F.col("is_line"), F.array(box(0))).otherwise(F.array(box(0), box(2))))
    window = v.spark.createDataFrame([(3000.0, 42000.0, 3000.0, 42000.0)], "wxmin double, wxmax double, wymin double, wymax double")
    return osm.extract_nonresidential(areas, window)


# An outline for every administrative square: without its upper right quarter, and with a hole in the lower left one.
def notched(boxes, name, columns):
    """(name, ring, hole): outlines made of the boxes."""
    x0, x1, y0, y1 = (F.col(c) for c in ("xmin", "xmax", "ymin", "ymax"))
    mx, my, w, h = (x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    outer = F.array(at(x0, y0), at(x1, y0), at(x1, my), at(mx, my), at(mx, y1), at(x0, y1))
    hole = box_ring(x0 + w / 8, x0 + w / 4, y0 + h / 8, y0 + h / 4)
    rings = F.inline(F.array(F.struct(outer.alias("ring"), F.lit(False).alias("hole")), F.struct(hole.alias("ring"), F.lit(True).alias("hole"))))
    return boxes.select(F.col(name).alias(columns), rings)


def notched_sql(boxes, name):
    """(mask, sign, box): the same outlines as boxes that are added, and the hole, which is subtracted."""
    parts = (
        ("1.0", "xmin", "(xmin + xmax) / 2", "ymin", "ymax"), ("1.0", "(xmin + xmax) / 2", "xmax", "ymin", "(ymin + ymax) / 2"),
        ("-1.0", "xmin + (xmax - xmin) / 8", "xmin + (xmax - xmin) / 4", "ymin + (ymax - ymin) / 8", "ymin + (ymax - ymin) / 4"),
    )
    return " UNION ALL ".join(f"SELECT {name} AS mask, {s} AS sign, {a} AS xmin, {b} AS xmax, {c} AS ymin, {d} AS ymax FROM {boxes}" for s, a, b, c, d in parts)


def shared_sql(shapes, masks):
    """Area and centroid, in hundredths, of what boxes (id, xmin..ymax) share with outlines of boxes."""
    return f"""WITH s AS ({shapes}), m AS ({masks}), o AS (SELECT s.id, m.mask, sign, greatest(s.xmin, m.xmin) AS xl, least(s.xmax, m.xmax) AS xh,
          greatest(s.ymin, m.ymin) AS yl, least(s.ymax, m.ymax) AS yh FROM s JOIN m ON s.xmin < m.xmax AND s.xmax > m.xmin AND s.ymin < m.ymax AND s.ymax > m.ymin),
        a AS (SELECT *, sign * (xh - xl) * (yh - yl) AS area FROM o), t AS (SELECT id, mask, sum(area) AS area, sum(area * (xl + xh) / 2) AS mx, sum(area * (yl + yh) / 2) AS my FROM a GROUP BY 1, 2)
        SELECT id, mask, CAST(floor(area * 100 + 0.37) AS BIGINT) AS area_100, CAST(floor(mx / area * 100 + 0.37) AS BIGINT) AS cx_100,
          CAST(floor(my / area * 100 + 0.37) AS BIGINT) AS cy_100 FROM t WHERE area > 0"""


def shared_rows(parts):
    """Area and centroid of all parts and holes together; rings are moved to their first point, so that digits are kept."""
    ring = F.explode(F.concat(F.array("outer"), "holes")).alias("ring")
    at = lambda axis: F.col("ring")[0][axis]
    near = parts.select("id", "mask", ring).withColumns({"x0": at("x"), "y0": at("y")})
    near = near.withColumn("ring", F.transform("ring", lambda p: F.struct((p.x - F.col("x0")).alias("x"), (p.y - F.col("y0")).alias("y"))))
    cx, cy = ring_centroid(F.col("ring"))
    facts = near.select("id", "mask", shoelace(F.col("ring")).alias("area"), (cx + F.col("x0")).alias("cx"), (cy + F.col("y0")).alias("cy"))
    total = facts.groupBy("id", "mask").agg(F.sum("area").alias("area"), F.sum(F.expr("area * cx")).alias("mx"), F.sum(F.expr("area * cy")).alias("my"))
    whole = lambda c, name: F.floor(c * 100 + 0.37).cast("long").alias(name)
    return total.select("id", "mask", whole(F.col("area"), "area_100"), whole(F.col("mx") / F.col("area"), "cx_100"), whole(F.col("my") / F.col("area"), "cy_100"))


@register(
    "A08_nonresidential_within_outlines",
    shared_sql(
        f"""WITH f AS ({FEATURES.replace(' natural,', ' nat,')}), hit AS (SELECT * FROM f WHERE {_catalogue_sql()})
            SELECT id, x AS xmin, x + w * 20 AS xmax, y AS ymin, y + h * 20 AS ymax FROM hit
            UNION ALL SELECT id, x + w * 40, x + w * 60, y, y + h * 20 FROM hit WHERE NOT is_line""",
        notched_sql("{admin_zones}", "zone_no"),
    ),
)
def nonresidential_within(v):
    """Areas of one or two parts, blown up so that many cross an outline."""
    df, x, y, w, h = features(v), *(F.col(c) for c in "xywh")
    box = lambda off: box_ring(x + off * w * 20, x + (off + 1) * w * 20, y, y + h * 20)
    rings = F.when(F.col("is_line"), F.array(box(0))).otherwise(F.array(box(0), box(2)))
    areas = df.withColumn("ring", F.explode(rings))
    return shared_rows(osm.nonresidential_within(areas, notched(v.admin_zones, "zone_no", "mask"), 5000.0))


@register("A08_nonresidential_parts_within_outlines")
def nonresidential_parts(v):
    """The rings themselves; tested by brute force on a fixture."""
    df, x, y, w, h = features(v), *(F.col(c) for c in "xywh")
    areas = df.withColumn("ring", box_ring(x, x + w * 20, y, y + h * 20))
    return osm.nonresidential_within(areas, notched(v.admin_zones, "zone_no", "mask"), 5000.0)


@register(
    "D13_boundaries_within_outlines",
    shared_sql("SELECT zone_no AS id, xmin, xmax, ymin, ymax FROM {admin_zones}", notched_sql("{regions}", "id")),
)
def boundaries_within(v):
    """Administrative squares clipped to the outlines of regions."""
    squares = v.admin_zones.select(F.col("zone_no").alias("id"), box_ring(*[F.col(c) for c in ("xmin", "xmax", "ymin", "ymax")]).alias("ring"))
    return shared_rows(overlay.clip_polygons(squares, notched(v.regions, "id", "mask"), 15000.0))


AREA_FLAGS = """SELECT t.way_id, t.highway, t.route, t.junction, max(CASE WHEN abs(n.x - 22500) + abs(n.y - 22500) < 4000 THEN 1 ELSE 0 END) AS core,
    max(CASE WHEN abs(n.x - 22500) + abs(n.y - 22500) < 9000 THEN 1 ELSE 0 END) AS study
    FROM {tagged_ways} t JOIN {way_nodes} w ON w.way_id = t.way_id JOIN {nodes} n ON n.node_id = w.node_id
    GROUP BY t.way_id, t.highway, t.route, t.junction"""


def _quoted(values):
    return ", ".join(f"'{x}'" for x in values)


@register(
    "A09_hierarchical_network",
    f"""SELECT way_id, highway FROM ({AREA_FLAGS}) a WHERE (core = 1 AND highway IN ({_quoted(osm.CORE_ROADS)}))
        OR (study = 1 AND highway IN ({_quoted(osm.STUDY_ROADS)})) OR highway IN ({_quoted(osm.OUTER_ROADS)}) OR route = 'ferry'""",
)
def network(v):
    ways = v.sql(AREA_FLAGS)
    return osm.hierarchical_network(ways, F.col("core") == 1, F.col("study") == 1).select("way_id", "highway")


@register(
    "A09_street_network_special_tags",
    f"""SELECT way_id, highway FROM ({AREA_FLAGS}) a WHERE (core = 1 AND highway IN ({_quoted(osm.CORE_ROADS_WIDE)}))
        OR (study = 1 AND highway IN ({_quoted(osm.STUDY_ROADS_WIDE)})) OR highway IN ({_quoted(osm.OUTER_ROADS)})
        OR route = 'ferry' OR junction = 'roundabout'""",
)
def network_special(v):
    ways = v.sql(AREA_FLAGS)
    special = (("route", "ferry"), ("junction", "roundabout"))
    kept = osm.hierarchical_network(
        ways, F.col("core") == 1, F.col("study") == 1, osm.CORE_ROADS_WIDE, osm.STUDY_ROADS_WIDE, osm.OUTER_ROADS, special
    )
    return kept.select("way_id", "highway")


@register(
    "A09_merge_network_layers",
    f"""SELECT way_id, highway FROM {{tagged_ways}} WHERE highway IN ({_quoted(osm.OUTER_ROADS)}) OR route = 'ferry'
        OR junction = 'roundabout'""",
)
def merge_layers(v):
    ways = v.tagged_ways.select("way_id", "highway", "route", "junction")
    layers = [ways.filter(F.col("highway").isin(*osm.OUTER_ROADS)), ways.filter("route = 'ferry'"), ways.filter("junction = 'roundabout'")]
    return osm.merge_layers(*layers).select("way_id", "highway")
