"""Road network: harmonised speeds and lanes, links, main classes, node types, access nodes, connectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import first_int
from ..session import cut
from .common import keep_first, with_rank
from .graph import connected_components, proximity_components, strong_components
from .spatial import join_knn


def extend_tsys(types: DataFrame, has: str, add: str) -> DataFrame:
    """Add one system to the sets that hold another."""
    systems = F.filter(F.transform(F.split("tsys", ","), lambda s: F.trim(s)), lambda s: s != "")
    extended = F.when(F.array_contains(systems, has), F.array_union(systems, F.array(F.lit(add)))).otherwise(systems)
    return types.withColumn("tsys", F.array_join(extended, ","))


# ---- fixed values: speed and lanes of a class without any observation ----------------------------------------------
CLASS_DEFAULTS = (
    ("motorway", 130, 2), ("trunk", 100, 2), ("primary", 100, 2), ("secondary", 80, 2), ("tertiary", 70, 1),
    ("unclassified", 50, 1), ("residential", 30, 1),
)
UNKNOWN_SPEED, UNKNOWN_LANES = 130, 2

# ---- fixed values: abbreviations in the names of target link types, and classes of ways -------------------------------
TYPE_ABBREVIATIONS = {
    "Mo": "Motorway", "Tr": "Trunk", "Pr": "Primary", "Se": "Secondary", "Te": "Tertiary", "Un": "Unclassified",
    "Re": "Residential", "Link Mo": "Motorway_link", "Link Tr": "Trunk_link", "Link Pr": "Primary_link",
    "Link Se": "Secondary_link", "Link Te": "Tertiary_link",
}
# Full link type names and their categories.
TYPE_NAMES = {
    "Motorway, 4 lanes": "Motorway", "Motorway, 3 lanes": "Motorway", "Motorway, 2 lanes": "Motorway", "Motorway, 1 lane": "Motorway",
    "Motorway_link, 2 lanes": "Motorway_link", "Motorway_link, 1 lane": "Motorway_link", "Motorway_link": "Motorway_link",
    "Trunk, 3 lanes": "Trunk", "Trunk, 2 lanes": "Trunk", "Trunk, 1 lane": "Trunk",
    "Trunk_link, 2 lanes": "Trunk_link", "Trunk_link, 1 lane": "Trunk_link", "Trunk_link": "Trunk_link",
    "Primary, 3 lanes": "Primary", "Primary, 2 lanes": "Primary", "Primary, 1 lane": "Primary", "Primary_link": "Primary_link",
    "Secondary, 2 lanes": "Secondary", "Secondary, 1 lane": "Secondary", "Secondary_link": "Secondary_link",
    "Tertiary, 2 lanes": "Tertiary", "Tertiary, 1 lane": "Tertiary", "Tertiary_link": "Tertiary_link",
    "Unclassified, 1 lane": "Unclassified", "Blocked Oneway": "Blocked Oneway", "Construction": "Construction",
    "Residential": "Residential", "Road": "Road", "Living_Street": "Living_Street", "Service": "Service",
    "Footway/Pedestrian": "Footway/Pedestrian", "Steps": "Steps", "Path": "Path", "Cycleway": "Cycleway", "Track": "Track",
    "General rail": "General rail", "Rail": "Rail", "Light rail": "Light rail", "Subway": "Subway", "Tram": "Tram",
    "Ferry": "Ferry", "Ferry_Access": "Ferry_Access", "UnknownByImporter(Default)": "UnknownByImporter",
    "ZK_Hilfsstrecken": "ZK_Hilfsstrecken",
}
STRUCTURED = (
    "Motorway", "Trunk", "Primary", "Secondary", "Tertiary", "Unclassified", "Motorway_link", "Trunk_link",
    "Primary_link", "Secondary_link", "Tertiary_link",
)
WAY_CATEGORIES = STRUCTURED + ("Residential",)


def regional_means(ways: DataFrame) -> DataFrame:
    """Mean speed and lanes per class; classes without observations get the fixed defaults, lanes are at least 1."""
    spark = ways.sparkSession
    defaults = spark.createDataFrame(list(CLASS_DEFAULTS), "highway string, _s int, _l int")
    means = ways.groupBy("highway").agg(
        F.avg(first_int(F.col("maxspeed"))).alias("_ms"), F.avg(first_int(F.col("lanes"))).alias("_ml")
    )
    both = means.join(defaults, "highway", "full")
    return both.select(
        "highway",
        F.coalesce("_ms", F.col("_s").cast("double"), F.lit(float(UNKNOWN_SPEED))).alias("mean_speed"),
        F.greatest(F.lit(1.0), F.coalesce("_ml", F.col("_l").cast("double"), F.lit(float(UNKNOWN_LANES)))).alias("mean_lanes"),
    )


def _full_name(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])[name]


def type_category(name: Column) -> Column:
    """Category of a target link type: by its full name, else the abbreviation it starts with, else the name itself."""
    words = F.split(name, " ")
    table = F.create_map(*[F.lit(x) for pair in TYPE_ABBREVIATIONS.items() for x in pair])
    two = F.when(F.size(words) > 1, F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))))
    return F.coalesce(_full_name(name), table[F.coalesce(two, F.lit(""))], table[F.get(words, F.lit(0))], name)


def old_type_category(name: Column) -> Column:
    """Category of an importer link type by its full name."""
    return F.coalesce(_full_name(name), F.lit("Unknown"))


def target_types(types: DataFrame) -> DataFrame:
    """The usable target types (number from 100, no bus lanes) with their category."""
    kept = types.filter((F.col("type_no") >= 100) & ~F.lower("name").contains("bus"))
    return kept.withColumn("category", type_category(F.col("name")))


def speed_brackets(types: DataFrame) -> DataFrame:
    """Half-open speed ranges per (category, lanes): bounds midway between neighbouring speeds, 0 and infinity at the ends.

    The window runs over a rule table (a few dozen types per category).
    """
    order = Window.partitionBy("category", "lanes").orderBy(F.col("v0").desc(), "type_no")
    return types.withColumns(
        {
            "lower_bound": F.coalesce((F.col("v0") + F.lead("v0").over(order)) / 2, F.lit(0.0)),
            "upper_bound": F.coalesce((F.col("v0") + F.lag("v0").over(order)) / 2, F.lit(float("inf"))),
        }
    )


def top_degree(links: DataFrame, n: int, node: str) -> DataFrame:
    """The n nodes with most links (smaller number on ties)."""
    counts = links.groupBy(F.col(node).alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return counts.orderBy(F.col("degree").desc(), "node").limit(n)


def plausible(value: Column, most: int) -> Column:
    """The value, or NULL when it is too large to believe."""
    return F.when(value <= most, value)


# ---- topology and imputation --------------------------------------------------------------------------------------------


def way_topology(way_nodes: DataFrame) -> DataFrame:
    """First and last node and length (in nodes) of every way."""
    return way_nodes.groupBy("way_id").agg(
        F.min_by("node_id", "seq").alias("first_node"), F.max_by("node_id", "seq").alias("last_node"), F.count(F.lit(1)).alias("n_nodes")
    )


def _neighbour_values(ways: DataFrame, way_nodes: DataFrame, ends: DataFrame, column: str) -> DataFrame:
    """(way_id, nid, nval): the value of the neighbour with the smallest id, for ways without one of their own.

    A neighbour touches an endpoint, has the same class and a readable value. One row per node and class (its smallest
    neighbour) is all a way needs, so a crossing of any size costs one row per class. These rows are written, so that a
    node with very many ways can be split.
    """
    known = ways.select("way_id", "highway", first_int(F.col(column)).alias("_v")).filter(
        F.col("_v").isNotNull() & F.col("highway").isin(*[c.lower() for c in WAY_CATEGORIES])
    )
    offers = cut(
        way_nodes.select("way_id", "node_id").join(known, "way_id").groupBy("node_id", "highway").agg(F.min(F.struct("way_id", "_v")).alias("_offer"))
    )
    asking = ways.filter(F.col(column).isNull()).select("way_id", "highway").join(ends, "way_id")
    asking = asking.select("way_id", "highway", F.explode(F.array_distinct(F.array("first_node", "last_node"))).alias("node_id"))
    return asking.join(offers, ["node_id", "highway"]).groupBy("way_id").agg(F.min("_offer").alias("_best")).select(
        "way_id", F.col("_best.way_id").alias("nid"), F.col("_best._v").alias("nval")
    )


def _one_digit(value: Column) -> Column:
    return F.replace(F.format_number(value, 1), F.lit(","), F.lit(""))


def impute_from_neighbours(ways: DataFrame, way_nodes: DataFrame) -> DataFrame:
    """Harmonised speed and lanes of every way, with the text that says where each came from.

    `ways` has way_id, highway, maxspeed and lanes. Own plausible values stay; missing ones come from a neighbour
    within 30 km/h or 2 lanes of the class mean, else from the mean (speed cut to whole, lanes rounded half to even).
    """
    means = regional_means(ways)  # one row per class
    ends = way_topology(way_nodes).select("way_id", "first_node", "last_node")
    speed = _neighbour_values(ways, way_nodes, ends, "maxspeed").withColumnsRenamed({"nid": "speed_nid", "nval": "speed_nval"})
    lanes = _neighbour_values(ways, way_nodes, ends, "lanes").withColumnsRenamed({"nid": "lanes_nid", "nval": "lanes_nval"})
    df = ways.join(F.broadcast(means), "highway").join(speed, "way_id", "left").join(lanes, "way_id", "left")

    def source(raw, own, most, nid, nval, mean, band, fallback, unit, average) -> tuple[Column, Column]:
        missing, unread = raw.isNull(), own.isNull()
        near = F.abs(nval - mean) <= band
        value = (
            F.when(~missing & unread, fallback).when(~missing & (own > most), fallback).when(~missing, own)
            .when(near, nval).otherwise(fallback)
        )
        avg = F.concat(_one_digit(mean), F.lit(f" {unit}"))
        known = F.concat(F.lit("Neighbor ID "), nid.cast("string"), F.lit(" ("), nval.cast("string"), F.lit(f" {unit})"))
        text = (
            F.when(~missing & unread, F.concat(F.lit("[OSM-Original] Invalid ("), raw, F.lit(") -> Fallback to Regional Avg ("), avg, F.lit(") -> Template-Matched:")))
            .when(~missing & (own > most), F.concat(F.lit("[OSM-Unplausible] Raw: "), raw, F.lit(f" {unit} -> Capped to Template-Max:")))
            .when(~missing, F.concat(F.lit("[OSM-Original] "), raw, F.lit(f"{' lanes' if unit == 'lanes' else ''} -> Template-Matched:")))
            .when(nval.isNotNull() & near, F.concat(F.lit("[Neighbor-Match] From "), known, F.lit(" -> Template-Matched:")))
            .when(
                nval.isNotNull(),
                F.concat(F.lit("[Neighbor-No-Match] "), known, F.lit(" rejected vs. Regional Avg ("), avg, F.lit(") -> Regional Fallback applied -> Template-Matched:")),
            )
            .otherwise(F.concat(F.lit("[Regional-Average] Type '"), F.col("highway"), F.lit("' regional mean = "), avg, average, F.lit(" -> Template-Matched:")))
        )
        return value, text

    whole = F.bround("mean_lanes", 0).cast("int")
    v_speed, t_speed = source(
        F.col("maxspeed"), first_int(F.col("maxspeed")), 250, F.col("speed_nid"), F.col("speed_nval"), F.col("mean_speed"), 30,
        F.col("mean_speed").cast("int"), "km/h", F.lit(""),
    )
    v_lanes, t_lanes = source(
        F.col("lanes"), first_int(F.col("lanes")), 8, F.col("lanes_nid"), F.col("lanes_nval"), F.col("mean_lanes"), 2, whole, "lanes",
        F.concat(F.lit(" (rounded: "), whole.cast("string"), F.lit(")")),
    )
    out = df.withColumns(
        {"speed_now": v_speed, "lanes_now": v_lanes, "speed_text": t_speed, "lanes_text": t_lanes}
    )
    return out.drop("speed_nid", "speed_nval", "lanes_nid", "lanes_nval", "mean_speed", "mean_lanes")


def match_brackets(ways: DataFrame, brackets: DataFrame) -> DataFrame:
    """Snap `speed_now` and `lanes_now` to the target types of the way's class.

    `brackets` (category, lanes, v0, bounds) is a rule table read from one text file, small by nature.
    The lanes stay if the class has a type with that many, else the largest available number is taken.
    """
    stock = brackets.groupBy("category").agg(F.collect_set("lanes").alias("_lanes"), F.max("lanes").alias("_most"))
    category = F.when(
        F.col("highway").isin(*[c.lower() for c in WAY_CATEGORIES]), F.concat(F.upper(F.substring("highway", 1, 1)), F.substring("highway", 2, 99))
    ).otherwise(F.concat(F.upper(F.substring("highway", 1, 1)), F.lower(F.substring("highway", 2, 99))))
    keyed = ways.withColumn("category", category).join(F.broadcast(stock), "category", "left")
    keyed = keyed.withColumn(
        "_pick", F.when(F.array_contains("_lanes", F.col("lanes_now")), F.col("lanes_now")).otherwise(F.col("_most"))
    )
    rule = brackets.select(
        F.col("category").alias("_c"), F.col("lanes").alias("_l"), F.col("v0").alias("_v0"), F.col("lower_bound").alias("_lo"), F.col("upper_bound").alias("_hi")
    )
    hit = (
        (F.col("category") == F.col("_c")) & (F.col("_pick") == F.col("_l"))
        & (F.col("speed_now") >= F.col("_lo")) & (F.col("speed_now") < F.col("_hi"))
    )
    joined = keyed.join(F.broadcast(rule), hit, "left")
    out = joined.withColumns(
        {"target_speed": F.coalesce(F.col("_v0").cast("int"), F.col("speed_now")), "target_lanes": F.coalesce("_l", "lanes_now")}
    )
    return out.drop("_lanes", "_most", "_pick", "_c", "_l", "_v0", "_lo", "_hi")


def provenance(ways: DataFrame) -> DataFrame:
    """Original values and the full source texts next to the target values."""
    return ways.withColumns(
        {
            "maxspeed_original": F.coalesce("maxspeed", F.lit("missing")),
            "lanes_original": F.coalesce("lanes", F.lit("missing")),
            "maxspeed_source": F.concat("speed_text", F.lit(" "), F.col("target_speed").cast("string"), F.lit(" km/h")),
            "lanes_source": F.concat("lanes_text", F.lit(" "), F.col("target_lanes").cast("string"), F.lit(" lanes")),
        }
    )


def split_ways(way_nodes: DataFrame) -> DataFrame:
    """Links (way_id, part, from_node, to_node, hops): ways cut at their ends and at nodes they share or revisit.

    The windows run inside one way, whose node list the map format bounds at 2000. The counts are written, so that a
    node with very many ways can be split.
    """
    uses = cut(way_nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("_uses")))
    inside = Window.partitionBy("way_id").orderBy("seq")
    marked = way_nodes.join(uses, "node_id").withColumns(
        {"_first": F.lag("seq").over(inside).isNull(), "_last": F.lead("seq").over(inside).isNull(), "_pos": F.row_number().over(inside)}
    )
    cuts = marked.filter((F.col("_uses") > 1) | F.col("_first") | F.col("_last"))
    ordered = Window.partitionBy("way_id").orderBy("seq")
    ends = cuts.withColumns(
        {"to_node": F.lead("node_id").over(ordered), "_to": F.lead("_pos").over(ordered), "part": F.row_number().over(ordered)}
    )
    return ends.filter("to_node IS NOT NULL").select(
        "way_id", "part", F.col("node_id").alias("from_node"), "to_node", (F.col("_to") - F.col("_pos")).alias("hops")
    )


# Vehicle type of a restriction, its supertype and the system it concerns.
TURN_VEHICLES = (("motorcar", "motor_vehicle", "CAR"), ("hgv", "motor_vehicle", "HGV"), ("psv", "motor_vehicle", "BUS"))


def turn_bans(relations: DataFrame, links: DataFrame) -> DataFrame:
    """Forbidden movements (via_node, from_way, to_way, system) from turn relations.

    `relations` has rel_id, kind ('no_...' or 'only_...'), vehicle (NULL for all, a type or a supertype), except_types
    (semicolon list), from_way, via_node, to_way. A 'no' relation forbids its movement; an 'only' relation forbids
    all other ways leaving the node.
    """
    systems = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s).alias("s"), F.lit(c).alias("c")) for t, s, c in TURN_VEHICLES])
    excepted = F.split(F.coalesce("except_types", F.lit("")), ";")
    meant = F.filter(
        systems,
        lambda v: (F.col("vehicle").isNull() | (F.col("vehicle") == v["t"]) | (F.col("vehicle") == v["s"]))
        & ~F.array_contains(excepted, v["t"]) & ~F.array_contains(excepted, v["s"]),
    )
    each = relations.withColumn("_v", F.explode(meant)).withColumn("system", F.col("_v.c")).drop("_v")
    no = each.filter(F.col("kind").startswith("no_")).select("via_node", "from_way", "to_way", "system")
    only = each.filter(F.col("kind").startswith("only_")).select("via_node", "from_way", F.col("to_way").alias("_kept"), "system")
    leaving = links.select(F.col("from_node").alias("via_node"), F.col("way_id").alias("to_way")).union(
        links.select(F.col("to_node").alias("via_node"), F.col("way_id").alias("to_way"))
    ).distinct()
    others = only.join(leaving, "via_node").filter("to_way <> _kept AND to_way <> from_way").drop("_kept")
    return no.unionByName(others).distinct()


# ---- links, classes and ramps --------------------------------------------------------------------------------------------


def _has_car(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column), F.lit(""))).contains("car")


def with_reverse(links: DataFrame, columns: list[str]) -> DataFrame:
    """Directed links with the given columns of their opposite direction (prefix `rev_`, NULL without one).

    The rows of a link, a few, are one group, so one shuffle does and no join. Of parallel rows of the other direction the
    one with the smallest values counts.
    """
    pair = Window.partitionBy("no", F.least("from_node", "to_node"), F.greatest("from_node", "to_node"))
    value = F.struct(*columns)
    up, down = F.col("from_node") < F.col("to_node"), F.col("from_node") > F.col("to_node")
    ends = links.withColumns({"_up": F.min(F.when(up, value)).over(pair), "_down": F.min(F.when(down, value)).over(pair)})
    other = ends.withColumn("_other", F.when(up, F.col("_down")).when(down, F.col("_up"))).drop("_up", "_down")
    return other.withColumns({f"rev_{c}": F.col("_other")[c] for c in columns}).drop("_other")


def mark_blocked_oneway(links: DataFrame) -> DataFrame:
    """Type 0 for road links closed to cars whose opposite direction is open to them."""
    both = with_reverse(links, ["tsys"])
    blocked = F.col("type_no").between(10, 73) & ~_has_car("tsys") & _has_car("rev_tsys")
    return both.withColumn("type_no", F.when(blocked, 0).otherwise(F.col("type_no"))).drop("rev_tsys")


FERRY_TYPE, FERRY_ACCESS_TYPE = 94, 96


def ferry_access(links: DataFrame, nodes: DataFrame, reach: float = 5000.0, k: int = 1) -> DataFrame:
    """Access links (type 96, both directions) from every ferry node to its nearest other road nodes within reach."""
    piers = links.filter(F.col("type_no") == FERRY_TYPE).select(F.col("to_node").alias("node_id")).distinct()
    at = nodes.join(piers, "node_id", "left_semi").select(F.col("node_id").alias("id"), "x", "y")
    land = nodes.join(piers, "node_id", "left_anti").select(F.col("node_id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = join_knn(at, land, k, max_distance=reach).select("id", "rid", "d")
    out = near.select(F.col("id").alias("from_node"), F.col("rid").alias("to_node"), F.col("d").alias("length"))
    back = near.select(F.col("rid").alias("from_node"), F.col("id").alias("to_node"), F.col("d").alias("length"))
    return out.unionByName(back).withColumn("type_no", F.lit(FERRY_ACCESS_TYPE))


# Main class by a word in the link type's name; a later match replaces an earlier one.
MAIN_CLASSES = (
    ("motorway", 1), ("trunk", 2), ("primary", 2), ("secondary", 3), ("tertiary", 4), ("unclassified", 5), ("residential", 5),
    ("road", 5), ("living_street", 5), ("service", 6),
)
RAMP_CLASS, OTHER_CLASS, UTURN_CLASS = 77, 99, 88


def main_class(name: Column) -> Column:
    """Main class of a link type: ramps 77, unknown 99."""
    lowered = F.lower(name)
    chain = F.when(lowered.contains("_link"), RAMP_CLASS)
    for word, number in reversed(MAIN_CLASSES):
        chain = chain.when(lowered.contains(word), number)
    return chain.otherwise(OTHER_CLASS)


def classify_links(links: DataFrame, types: DataFrame) -> DataFrame:
    """Add `gtype` and the undirected `uclass` (-1 for ramps and roundabouts).

    `links` has no, from_node, to_node, type_no, tsys and roundabout; links without systems become type 0. `types`
    (type_no, name) is the link type table, a rule table of at most some hundred rows.
    """
    typed = links.withColumn("type_no", F.when(F.coalesce("tsys", F.lit("")) == "", 0).otherwise(F.col("type_no")))
    named = typed.join(F.broadcast(types.select("type_no", main_class(F.col("name")).alias("gtype"))), "type_no", "left")
    named = with_reverse(named.withColumn("gtype", F.coalesce("gtype", F.lit(OTHER_CLASS))), ["gtype"])
    both = F.least("gtype", F.coalesce("rev_gtype", "gtype"))
    ramp = (both == RAMP_CLASS) | (F.coalesce("roundabout", F.lit(0)) == 1)
    return named.withColumn("uclass", F.when(ramp, -1).otherwise(both)).drop("rev_gtype")


def ramp_components(links: DataFrame) -> DataFrame:
    """(no, from_node, to_node, component, classes) of every ramp link: the main classes 0..5 its component touches.

    Exactly two touches in all give '6'; a component that touches none is left out. Node facts are aggregated before
    they meet the links, so a crossing of any size adds one row per class.
    """
    ramps = links.filter("uclass = -1").select("no", "from_node", "to_node")
    parts = connected_components(ramps, "from_node", "to_node").withColumnsRenamed({"node": "from_node"})
    member = cut(ramps.join(parts, "from_node"))
    touching = links.filter(F.col("uclass").between(0, 5)).select(F.col("to_node").alias("node"), F.col("uclass").alias("c")).distinct()
    ends = member.select("component", "from_node", "to_node").distinct().select("component", F.explode(F.array("from_node", "to_node")).alias("node"))
    seen = ends.join(touching, "node").select("component", "c")
    facts = seen.groupBy("component").agg(F.sort_array(F.collect_set("c")).alias("_c"), F.count(F.lit(1)).alias("_n"))
    text = F.when(F.col("_n") == 2, "6").otherwise(F.array_join(F.transform("_c", lambda c: c.cast("string")), ","))
    return member.join(facts.select("component", text.alias("classes")), "component")


def uturn_links(links: DataFrame, ramps: DataFrame, longest: float = 0.05) -> DataFrame:
    """Link numbers of U-turn loops: ramp components that touch one street name only and are at most 50 m long.

    `links` has gtype, name and length (km); ramps whose component touches several classes do not count.
    """
    single = ramps.filter(~F.col("classes").contains(",")).select("no", "from_node", "to_node")
    plain = links.join(ramps.select("no", "from_node", "to_node"), ["no", "from_node", "to_node"], "left_anti").select("no", "from_node", "to_node")
    open_ = single.unionByName(plain)
    mine = links.filter(F.col("gtype") == RAMP_CLASS).join(open_, ["no", "from_node", "to_node"], "left_semi")
    mine = cut(mine.select("no", "from_node", "to_node", "length"))
    parts = connected_components(mine, "from_node", "to_node").withColumnsRenamed({"node": "from_node"})
    member = cut(mine.join(parts, "from_node"))
    # An undirected edge counts once: both directions of a link have the same ends.
    once = member.groupBy("component", F.least("from_node", "to_node").alias("a"), F.greatest("from_node", "to_node").alias("b")).agg(F.max("length").alias("length"))
    lengths = once.groupBy("component").agg(F.sum("length").alias("_length"))
    names = links.filter(F.coalesce("name", F.lit("")) != "").select(F.col("to_node").alias("node"), "name").distinct()
    ends = member.select("component", F.explode(F.array("from_node", "to_node")).alias("node")).distinct()
    named = ends.join(names, "node").groupBy("component").agg(F.count_distinct("name").alias("_names"))
    short = lengths.join(named, "component").filter((F.col("_names") == 1) & (F.col("_length") <= longest + 1e-12))
    return member.join(short.select("component"), "component", "left_semi").select("no").distinct()


def link_class(links: DataFrame, uturns: DataFrame) -> DataFrame:
    """Add the final `class` per direction: 88 on U-turns unless the class is unknown."""
    marked = links.join(uturns.withColumn("_u", F.lit(1)), "no", "left")
    return marked.withColumn("class", F.when(F.col("_u").isNotNull() & (F.col("gtype") != OTHER_CLASS), UTURN_CLASS).otherwise(F.col("gtype"))).drop("_u")


def node_types(links: DataFrame) -> DataFrame:
    """(node, detail, type_no): 'a-b' from the two lowest classes meeting, 99 and 'N-N' where nothing crosses.

    `links` has uclass, class and `various`: the classes of a ramp's component ('1,3'; NULL elsewhere). Only links of
    undirected class <= 5 take part. Classes are counted per node and class first, so a node of any degree is a few rows.
    """
    active = links.filter("uclass <= 5").withColumn(
        "_v", F.split(F.when(F.col("uclass") > -1, F.col("uclass").cast("string")).otherwise(F.coalesce("various", F.lit(""))), ",")
    )
    incoming = active.select(F.col("to_node").alias("node"), F.explode("_v").alias("v"))
    undirected = incoming.groupBy("node").agg(
        F.sort_array(F.collect_set(F.when(F.col("v") != "", F.col("v").cast("int")))).alias("_u"), F.max(F.when(F.col("v") == "", 1).otherwise(0)).alias("_blank")
    )
    either = active.select(F.col("to_node").alias("node"), "class").unionByName(active.select(F.col("from_node").alias("node"), "class"))
    per_class = either.groupBy("node", "class").agg(F.count(F.lit(1)).alias("n"))
    degrees = per_class.groupBy("node").agg(
        F.sum("n").alias("_io"), F.sum(F.when(F.col("class") < UTURN_CLASS, F.col("n")).otherwise(0)).alias("_deg"),
        F.max(F.when(F.col("class") == RAMP_CLASS, 1).otherwise(0)).alias("_ramp"),
        F.count(F.when(F.col("class") < RAMP_CLASS, 1)).alias("_kinds"),
        F.min_by("n", F.when(F.col("class") < RAMP_CLASS, F.col("class"))).alias("_nbest"), F.min(F.when(F.col("class") < RAMP_CLASS, F.col("class"))).alias("_best"),
    )
    joined = undirected.join(degrees, "node").filter("size(_u) > 0 AND _blank = 0")
    a, b = F.get("_u", F.lit(0)), F.coalesce(F.get("_u", F.lit(1)), F.get("_u", F.lit(0)))
    many = (F.size("_u") > 1) & (F.coalesce("_nbest", F.lit(0)) > 4)
    first, second = F.when(many, F.col("_best")).otherwise(a), F.when(many, F.col("_best")).otherwise(b)
    crossing = (F.col("_deg") >= 5) | (F.col("_io") >= 8) | ((F.col("_io") == 6) & (F.col("_ramp") == 1)) | (F.col("_kinds") > 1)
    return joined.select(
        "node",
        F.when(crossing & (second < 99), F.concat(first.cast("string"), F.lit("-"), second.cast("string"))).otherwise("N-N").alias("detail"),
        F.when(crossing, second).otherwise(99).alias("type_no"),
    )


def reachable_nodes(links: DataFrame, seeds: int = 5) -> DataFrame:
    """Nodes that can reach, and be reached from, one of the best connected nodes: the strong components of these."""
    links = cut(links.select("from_node", "to_node"))  # read three times; what it is made from may be far larger
    start = top_degree(links, seeds, "to_node").select("node")
    parts = cut(strong_components(links, "from_node", "to_node"))
    chosen = parts.join(start, "node").select("component").distinct()  # at most `seeds` rows
    return parts.join(F.broadcast(chosen), "component", "left_semi").select("node")


def keep_reachable(types: DataFrame, reached: DataFrame) -> DataFrame:
    """Node types with unreachable nodes reset to 99 and 'N-N'."""
    marked = types.join(reached.withColumn("_r", F.lit(1)), "node", "left")
    ok = F.col("_r").isNotNull()
    return marked.withColumns(
        {"detail": F.when(ok, F.col("detail")).otherwise("N-N"), "type_no": F.when(ok, F.col("type_no")).otherwise(99), "reachable": ok}
    ).drop("_r")


# ---- access nodes ----------------------------------------------------------------------------------------------------------

# Buffer (metres) around a node of each type; nodes whose buffers overlap belong together.
BUFFERS = {
    "1-1": 1000.0, "1-2": 500.0, "1-3": 250.0, "1-4": 250.0, "1-5": 250.0, "2-2": 250.0, "2-3": 125.0, "2-4": 125.0,
    "2-5": 12.5, "3-3": 150.0, "3-4": 50.0, "3-5": 12.5, "4-4": 50.0, "4-5": 12.5, "5-5": 0.0,
}


def cluster_access_nodes(nodes: DataFrame, buffers: dict[str, float] = BUFFERS) -> DataFrame:
    """(id, detail, cluster): nodes of one type whose buffers overlap, directly or through others.

    `nodes` has id, x, y and detail. Buffers lie on both sides, so two nodes are linked within twice the buffer; all
    types are treated in one pass, apart from each other. Without a buffer every node is its own cluster. The cluster
    is its smallest node.
    """
    reach = F.create_map(*[F.lit(x) for kind, size in buffers.items() for x in (kind, 2.0 * size)])[F.col("detail")]
    known = nodes.filter(F.col("detail").isin(*buffers))
    buffered = known.filter(reach > 0).select("id", "x", "y", "detail")
    joined = proximity_components(buffered, reach, strict=False, by=["detail"]).withColumnRenamed("component", "cluster")
    alone = known.filter(reach == 0).select("id", "detail", F.col("id").alias("cluster"))
    return joined.select("id", "detail", "cluster").unionByName(alone)


def access_nodes(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per cluster of two or more: mean position, best type, class and member count."""
    member = nodes.select("id", "x", "y").join(clusters, "id")
    rank = F.regexp_replace("detail", "-", "").cast("int")
    grouped = member.groupBy("cluster", "detail").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.min(F.split("detail", "-")[1].cast("int")).alias("zk_type"), F.min(rank).alias("rank"),
        F.count(F.lit(1)).alias("members"),
    )
    return grouped.filter("members > 1")


def helper_links(clusters: DataFrame) -> DataFrame:
    """Helper links (type 777) both ways between a cluster's centre and each member; centres are numbered -cluster - 1."""
    sizes = clusters.groupBy("cluster", "detail").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    member = clusters.join(sizes, ["cluster", "detail"], "left_semi")
    centre = (-F.col("cluster") - 1).alias("centre")
    both = member.select(
        "detail", F.explode(F.array(F.struct(centre.alias("a"), F.col("id").alias("b")), F.struct(F.col("id").alias("a"), centre.alias("b")))).alias("l")
    )
    return both.select("detail", F.col("l.a").alias("from_node"), F.col("l.b").alias("to_node"), F.lit(777).alias("type_no"))


def centre_zones(access: DataFrame, zones: DataFrame) -> DataFrame:
    """Zone rows of the clusters' centres: numbered on from the largest `no` of `zones` in the order of cluster and type, of type 99, each with its node."""
    top = zones.agg(F.coalesce(F.max("no"), F.lit(0)).alias("_top"))
    ranked = with_rank(access.select("cluster", "detail", "x", "y"), [F.col("cluster"), F.col("detail")], "number")
    # One row, so the broadcast is bounded.
    return ranked.join(F.broadcast(top)).select(
        (F.col("_top") + F.col("number")).alias("zone_no"), (-F.col("cluster") - 1).alias("node_no"), "detail", "x", "y", F.lit(99).alias("type_no")
    )


def centre_connectors(access: DataFrame, systems: str) -> DataFrame:
    """Connector rows of the new zones: one per direction."""
    return access.select("cluster", "detail", F.explode(F.array(F.lit("O"), F.lit("D"))).alias("direction"), F.lit(systems).alias("tsys"))


# ---- link types -------------------------------------------------------------------------------------------------------------


def drop_links_of_type(links: DataFrame, types: DataFrame, name: str) -> DataFrame:
    """Links without those of the named type."""
    gone = types.filter(F.col("name") == name).select("type_no")
    return links.join(F.broadcast(gone), "type_no", "left_anti")


def restructure_types(links: DataFrame, types: DataFrame) -> DataFrame:
    """New type numbers for links of old types, by category, lanes and speed.

    `types` (type_no, name, lanes, v0) holds old types below 100 and target types from 100; a rule table. Structured
    categories are matched by lanes (the largest count stands for itself and more) and speed bracket, others one to one;
    links without lanes go to the blocked type. Links without a match keep their number.
    """
    old = types.filter("type_no < 100").select("type_no", old_type_category(F.col("name")).alias("category"))
    new = target_types(types)
    structured = speed_brackets(new.filter(F.col("category").isin(*STRUCTURED)))
    top = structured.groupBy("category").agg(F.max("lanes").alias("_top"))
    rule = structured.join(top, "category").select(
        "category", F.col("lanes").alias("_l"), "_top", F.col("type_no").alias("_new"), "lower_bound", "upper_bound"
    )
    simple = new.filter(~F.col("category").isin(*STRUCTURED)).groupBy("category").agg(F.min("type_no").alias("_simple"))
    blocked = new.filter("category = 'Blocked Oneway'").agg(F.min("type_no").alias("_blocked"))
    typed = links.join(F.broadcast(old), "type_no", "left")
    # The largest lane count also takes links with more lanes; brackets of a category and count do not overlap.
    fit = (
        (typed.category == rule.category)
        & ((F.col("_l") == F.col("numlanes")) | ((F.col("_l") == F.col("_top")) & (F.col("numlanes") >= F.col("_l"))))
        & (F.col("v0") >= F.col("lower_bound")) & (F.col("v0") < F.col("upper_bound"))
    )
    matched = typed.join(F.broadcast(rule), fit, "left").drop(rule.category).drop("_l", "_top", "lower_bound", "upper_bound")
    matched = matched.join(F.broadcast(simple), "category", "left").join(F.broadcast(blocked))
    by_rule = F.coalesce("_new", "_simple")
    verdict = F.when(by_rule.isNotNull(), by_rule).when((F.col("numlanes") == 0) & F.col("category").isNotNull(), F.col("_blocked"))
    return matched.withColumn("new_type", F.coalesce(verdict, F.col("type_no"))).drop("_new", "_simple", "_blocked")


def unmatched_types(links: DataFrame) -> DataFrame:
    """Remaining links of old types, per type (empty when all were matched)."""
    return links.filter("new_type < 100").groupBy("new_type").agg(F.count(F.lit(1)).alias("n"))


# ---- connectors --------------------------------------------------------------------------------------------------------------

# Level, tiers connected, weakest node class, farthest distance, number of nodes.
NEAR_LEVELS = (
    (0, (0,), 0, 15000.0, 20), (1, (0, 1), 1, 15000.0, 20), (2, (0, 1, 2), 2, 6000.0, 10), (3, (0, 1, 2, 3), 3, 3000.0, 5),
    (4, (0, 1, 2, 3, 4), 4, 2000.0, 5), (5, (0, 1, 2, 3, 4, 9), 5, 1000.0, 2),
)
FAR_LEVELS = ((9, (0, 1, 2, 3, 4, 5, 9), 99, 500000.0, 3),)
LAST_RESORT = 500000.0
WEAKEST, ANY_CLASS = 5, 99


def zone_category(zones: DataFrame, nodes: DataFrame, limit: float = 5000.0, farthest: float = LAST_RESORT) -> DataFrame:
    """Add `distance` to the nearest usable node of class <= 4 and `category`: Near below 5 km on the same island, else Far.

    `zones` has id, x, y and optionally island; `nodes` node_id, x, y, zk_type, reachable and optionally island.
    """
    usable = nodes.filter((F.col("zk_type") <= 4) & F.col("reachable"))
    island = "island" in nodes.columns and "island" in zones.columns
    right = usable.select(
        F.col("node_id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), *([F.col("island").alias("risland")] if island else [])
    )
    near = join_knn(zones.select("id", "x", "y"), right, 1, max_distance=farthest).select("id", "d", *(["risland"] if island else []))
    joined = zones.join(near.hint("merge"), "id", "left").withColumn("distance", F.coalesce("d", F.lit(99999.9)))
    same = (F.col("island") == F.col("risland")) & (F.col("island") != -1) if island else F.lit(True)
    category = F.when((F.col("distance") < limit) & F.coalesce(same, F.lit(False)), "Near").otherwise("Far")
    return joined.withColumn("category", category).drop("d", "risland")


def make_connectors(zones: DataFrame, nodes: DataFrame) -> DataFrame:
    """Connectors (level, zone_no, node_id, d): near zones by level 0..5, far zones by level 9.

    A zone takes part in the levels of its category that name its tier, and gets the nearest usable nodes of each. If
    there are none it retries with every weaker node class, then within the last-resort distance; a zone that no node
    can serve raises an error. All zones and levels climb this ladder together, one search per rung. `zones` has id, x,
    y, type_no and category.
    """
    classes = [level[2] for level in NEAR_LEVELS]
    wanted = F
    for category, levels in (("Near", NEAR_LEVELS), ("Far", FAR_LEVELS)):
        offers = []
        for number, tiers, weakest, reach, count in levels:
            ladder = [(weakest, reach)] + [(c, reach) for c in classes if c > weakest] + [(WEAKEST, LAST_RESORT)]
            rungs = F.array(*[F.struct(F.lit(c).alias("klass"), F.lit(float(r)).alias("reach")) for c, r in ladder])
            offer = F.struct(F.lit(number).alias("level"), F.lit(count).alias("k"), rungs.alias("rungs"))
            offers.append(F.when(F.col("type_no").isin(*tiers), offer))
        wanted = wanted.when(F.col("category") == category, F.array(*offers))
    tasks = zones.select("id", "x", "y", F.explode(F.filter(wanted, lambda o: o.isNotNull())).alias("_o"))
    waiting = cut(tasks.select(F.struct(F.col("_o.level").alias("level"), "id").alias("id"), "x", "y", "_o.k", "_o.rungs"))
    # A node serves its own class, all weaker ones and the open class, seven at most: a row for each.
    asked = F.array(*[F.lit(c) for c in range(WEAKEST + 1)], F.lit(ANY_CLASS))
    serves = F.explode(F.filter(asked, lambda c: c >= F.col("zk_type"))).alias("serves")
    usable = cut(nodes.filter("reachable").select(F.col("node_id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), serves))
    done, rung = None, 0
    most = 2 + len(classes)
    while rung < most and not waiting.isEmpty():
        here = waiting.filter(F.size("rungs") > rung).withColumns(
            {"klass": F.get("rungs", F.lit(rung)).klass, "reach": F.get("rungs", F.lit(rung)).reach}
        ).drop("rungs")
        found = join_knn(here, usable, "k", reach="reach", by=("klass", "serves"))
        found = cut(found.select("id", F.col("rid").alias("node_id"), "d"))
        done = found if done is None else done.unionByName(found)
        waiting = cut(waiting.join(found.select("id").distinct(), "id", "left_anti"))
        rung += 1
    if not waiting.isEmpty():
        raise ValueError(f"{waiting.count()} zone levels cannot be connected")
    if done is None:
        done = waiting.select("id", F.lit(0).cast("long").alias("node_id"), F.lit(0.0).alias("d"))
    return done.select("id.level", F.col("id.id").alias("zone_no"), "node_id", "d")


def connector_rows(connectors: DataFrame, systems: str) -> DataFrame:
    """One row per zone, node and direction with a flag per level."""
    levels = [level[0] for level in NEAR_LEVELS + FAR_LEVELS]
    flags = [F.max(F.when(F.col("level") == n, 1).otherwise(0)).alias(f"level_{n}") for n in levels]
    wide = connectors.groupBy("zone_no", "node_id").agg(*flags)
    return wide.select("zone_no", "node_id", F.explode(F.array(F.lit("O"), F.lit("D"))).alias("direction"), F.lit(systems).alias("tsys"), *[f"level_{n}" for n in levels])
