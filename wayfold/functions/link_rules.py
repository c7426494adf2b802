"""Road and rail way attributes: defaults by class, link types, names, infrastructure classes.

The rules are data (small tuples turned into literal lookups), so another rule set is another argument.
Frames carry tags either as a `tags` map or as one column per key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tags import tag

MODES = ("CAR", "HGV", "BIKE", "PED", "BUS", "RAIL", "LR", "SUB", "TRAM")

# Code of each mode in a transport-system set.
MODE_CODES = {
    "CAR": "CAR", "HGV": "HGV", "BUS": "BUS", "RAIL": "RAIL", "LR": "LRT", "SUB": "SUBWAY", "TRAM": "TRAM",
    "PED": "WALK", "BIKE": "BIKE",
}
MOTOR = ("CAR", "HGV", "BUS")
ALL_ROAD = ("CAR", "HGV", "BIKE", "PED", "BUS")
ACTIVE = ("BIKE", "PED")


@dataclass(frozen=True)
class LinkRules:
    """Defaults per (key, value): lanes, lanes when one-way, one-way, speed, allowed modes, walking speed."""

    defaults: dict[tuple[str, str], tuple]
    fallback: tuple
    types: tuple = field(default=())
    default_type: int = 99


# ---- fixed values: class, lanes, lanes one-way, one-way, speed, speed under construction, modes, walking speed ------
ROAD_DEFAULTS = (
    ("motorway", 2, 2, "yes", 130, 200, MOTOR, 0),
    ("motorway_link", 1, 1, "yes", 70, 100, MOTOR, 0),
    ("trunk", 2, 2, "no", 100, 100, MOTOR, 0),
    ("trunk_link", 1, 1, "no", 70, 100, MOTOR, 0),
    ("primary", 2, 1, "no", 100, 100, ALL_ROAD, 0),
    ("primary_link", 2, 1, "no", 50, 100, ALL_ROAD, 0),
    ("secondary", 2, 1, "no", 80, 100, ALL_ROAD, 7),
    ("secondary_link", 2, 1, "no", 30, 100, ALL_ROAD, 7),
    ("tertiary", 2, 1, "no", 70, 100, ALL_ROAD, 7),
    ("tertiary_link", 2, 1, "no", 30, 100, ALL_ROAD, 7),
    ("unclassified", 2, 1, "no", 70, 100, ALL_ROAD, 7),
    ("residential", 2, 1, "no", 30, 50, ALL_ROAD, 7),
    ("road", 2, 1, "no", 30, 50, ALL_ROAD, 7),
    ("living_street", 2, 1, "no", 20, 30, ALL_ROAD, 7),
    ("service", 2, 1, "no", 20, None, ALL_ROAD, 7),
    ("path", 2, 1, "no", 5, 5, ACTIVE, 7),
    ("footway", 2, 1, "no", 5, 5, ACTIVE, 7),
    ("pedestrian", 2, 1, "no", 5, 5, ACTIVE, 7),
    ("steps", 2, 1, "no", 5, 5, ACTIVE, 7),
    ("cycleway", 2, 1, "no", 5, 5, ACTIVE, 7),
    ("track", 2, 1, "no", 5, 5, ACTIVE, 7),
)
RAIL_DEFAULTS = (
    ("rail", 2, 1, "no", 20, ("RAIL", "LR"), 0),
    ("light_rail", 2, 1, "no", 0, ("LR",), 0),
    ("subway", 2, 1, "no", 0, ("SUB",), 0),
    ("tram", 2, 1, "no", 0, ("TRAM",), 0),
)
FERRY_DEFAULT = (2, 1, "no", 20, ALL_ROAD, 7)
ANY_DEFAULT = (1, 1, "no", 50, MOTOR, 7)

# ---- fixed values: link type, priority, highway, railway, route, least lanes, most lanes ----------------------------
LINK_TYPES = (
    (10, 2, "motorway", None, None, 1, 1), (11, 1, "motorway", None, None, 2, 2),
    (12, 1, "motorway", None, None, 3, 3), (13, 1, "motorway", None, None, 4, None),
    (18, 1, "motorway_link", None, None, 1, 1), (19, 1, "motorway_link", None, None, 2, None),
    (20, 2, "trunk", None, None, 1, 1), (21, 1, "trunk", None, None, 2, 2), (22, 1, "trunk", None, None, 3, None),
    (28, 1, "trunk_link", None, None, 1, 1), (29, 1, "trunk_link", None, None, 2, None),
    (30, 2, "primary", None, None, 1, 2), (31, 1, "primary", None, None, 3, 4), (32, 1, "primary", None, None, 5, None),
    (39, 1, "primary_link", None, None, None, None),
    (40, 2, "secondary", None, None, 1, 2), (41, 1, "secondary", None, None, 3, None),
    (49, 1, "secondary_link", None, None, None, None),
    (50, 2, "tertiary", None, None, 1, 2), (51, 1, "tertiary", None, None, 3, None),
    (59, 1, "tertiary_link", None, None, None, None), (60, 2, "unclassified", None, None, None, None),
    (70, 2, "residential", None, None, None, None), (71, 2, "road", None, None, None, None),
    (72, 2, "living_street", None, None, None, None), (73, 2, "service", None, None, None, None),
    (75, 2, "footway", None, None, None, None), (75, 2, "pedestrian", None, None, None, None),
    (76, 2, "steps", None, None, None, None), (77, 2, "path", None, None, None, None),
    (78, 2, "cycleway", None, None, None, None), (79, 2, "track", None, None, None, None),
    (81, 1, None, "rail", None, None, None), (81, 2, None, "*", None, None, None),
    (82, 1, None, "light_rail", None, None, None), (83, 1, None, "subway", None, None, None),
    (84, 3, None, "tram", None, None, None), (94, 1, None, None, "ferry", None, None),
)


def _standard() -> LinkRules:
    table: dict[tuple[str, str], tuple] = {}
    for name, lanes, lanes_one, oneway, speed, building, modes, walk in ROAD_DEFAULTS:
        table["highway", name] = (lanes, lanes_one, oneway, speed, modes, walk)
        if building is not None:
            table["construction", name] = (lanes, lanes_one, oneway, building, modes, walk)
    for name, lanes, lanes_one, oneway, speed, modes, walk in RAIL_DEFAULTS:
        table["railway", name] = table["construction", name] = (lanes, lanes_one, oneway, speed, modes, walk)
    table["route", "ferry"] = FERRY_DEFAULT
    return LinkRules(table, ANY_DEFAULT, LINK_TYPES, 99)


STANDARD_RULES = _standard()

# ---- fixed values: where the older urban rule set departs from the standard one -------------------------------------
# class, one-way, speed, modes, walking speed (lanes as above)
URBAN_ROADS = (
    ("motorway", "yes", 200, MOTOR, 0), ("motorway_link", "yes", 100, MOTOR, 0), ("trunk", "yes", 100, MOTOR, 0),
    ("trunk_link", "yes", 100, MOTOR, 0), ("primary", "no", 100, MOTOR, 0), ("primary_link", "no", 100, MOTOR, 0),
    ("secondary", "no", 100, ALL_ROAD, 7), ("secondary_link", "no", 100, ALL_ROAD, 7),
    ("tertiary", "no", 100, ALL_ROAD, 7), ("tertiary_link", "no", 100, ALL_ROAD, 7),
    ("unclassified", "no", 100, ALL_ROAD, 7), ("residential", "no", 50, ALL_ROAD, 7),
    ("living_street", "no", 30, ALL_ROAD, 7), ("path", "no", 5, ACTIVE, 7), ("footway", "no", 5, ACTIVE, 7),
    ("pedestrian", "no", 5, ACTIVE, 7), ("steps", "no", 5, ACTIVE, 7), ("cycleway", "no", 5, ACTIVE, 7),
)
URBAN_ANY = (2, 1, "no", 100, MOTOR, 7)
URBAN_FERRY = (2, 1, "no", 15, ALL_ROAD, 7)


def _urban() -> LinkRules:
    lanes = {name: (a, b) for name, a, b, *_ in ROAD_DEFAULTS}
    table = {("highway", n): (*lanes[n], oneway, speed, modes, walk) for n, oneway, speed, modes, walk in URBAN_ROADS}
    for name, a, b, oneway, speed, modes, walk in RAIL_DEFAULTS:
        table["railway", name] = (a, b, oneway, speed, modes, walk)
    table["route", "ferry"] = URBAN_FERRY
    kept = tuple(t for t in LINK_TYPES if t[0] <= 70 or 82 <= t[0] or (t[0] == 81 and t[3] == "rail"))
    own = (
        (71, 2, "living_street", None, None, None, None), (75, 2, "path", None, None, None, None),
        (75, 2, "footway", None, None, None, None), (75, 2, "steps", None, None, None, None),
        (75, 2, "pedestrian", None, None, None, None), (76, 2, "cycleway", None, None, None, None),
        (80, 2, None, "*", None, None, None),
    )
    return LinkRules(table, URBAN_ANY, kept + own, 1)


URBAN_RULES = _urban()


def _lookup(rules: LinkRules, pick) -> Column:
    """A literal map `key=value` -> picked default."""
    items: list[Column] = []
    for (key, value), row in rules.defaults.items():
        items += [F.lit(f"{key}={value}"), F.lit(pick(row))]
    return F.create_map(*items)


def usable_road_ways(df: DataFrame) -> DataFrame:
    """Drop private roads and areas."""
    return df.filter((F.coalesce(tag(df, "access"), F.lit("")) != "private") & (F.coalesce(tag(df, "area"), F.lit("")) != "yes"))


def usable_rail_ways(df: DataFrame) -> DataFrame:
    """Drop yards, spurs, sidings and disused service tracks, and rails on roads other than service roads."""
    service, disused, highway = tag(df, "service"), tag(df, "disused"), tag(df, "highway")
    open_track = service.isNull() | (
        ~service.isin("yard", "spur", "siding") & (F.coalesce(disused, F.lit("")) != "yes")
    )
    return df.filter(open_track & (highway.isNull() | (highway == "service")))


def apply_link_defaults(df: DataFrame, rules: LinkRules = STANDARD_RULES) -> DataFrame:
    """Add the working attributes `w_*`: class defaults, overridden by explicit tags.

    Road: highway, oneway, lanes, maxspeed, level and the yes/no columns of all modes.
    """
    known = {k: [v for (key, v) in rules.defaults if key == k] for k in ("highway", "construction", "railway", "route")}
    rule_key = F.coalesce(
        *[
            F.when(tag(df, k).isin(*values), F.concat(F.lit(f"{k}="), tag(df, k)))
            for k, values in known.items()
            if values
        ]
    )
    default = lambda i: F.coalesce(_lookup(rules, lambda row: row[i])[F.col("_rule")], F.lit(rules.fallback[i]))
    lanes_tag, oneway_tag = tag(df, "lanes"), tag(df, "oneway")
    tracks = F.when(tag(df, "railway") == "tram", tag(df, "tracks"))
    ferry = lambda key: (F.coalesce(tag(df, "route"), F.lit("")) == "ferry") & (F.coalesce(tag(df, key), F.lit("")) == "no")

    out = df.withColumn("_rule", rule_key)
    out = out.withColumn(
        "w_oneway",
        F.coalesce(oneway_tag, F.when(tag(df, "junction") == "roundabout", F.lit("yes")), default(2)),
    )
    base_lanes = F.coalesce(tracks, default(0).cast("string"))
    modes = F.coalesce(
        _lookup(rules, lambda row: ",".join(row[4]))[F.col("_rule")], F.lit(",".join(rules.fallback[4]))
    )
    mode_on = {m: F.array_contains(F.split(modes, ","), m) for m in MODES}
    mode_on["CAR"] = mode_on["CAR"] & ~ferry("car")
    mode_on["PED"] = mode_on["PED"] & ~ferry("foot")
    mode_on["HGV"] = mode_on["HGV"] & ~ferry("hgv")
    mode_on["BUS"] = mode_on["BUS"] & ~ferry("hgv")
    mode_on["TRAM"] = mode_on["TRAM"] | (F.coalesce(tag(df, "railway"), F.lit("")) == "tram")
    out = out.withColumns(
        {
            "w_highway": F.when(tag(df, "highway") == "construction", tag(df, "construction")).otherwise(tag(df, "highway")),
            "w_lanes": F.coalesce(
                lanes_tag,
                F.when(F.col("w_oneway") == "yes", default(1).cast("string")).otherwise(base_lanes),
            ),
            "w_maxspeed": F.coalesce(tag(df, "maxspeed"), default(3).cast("string")),
            "w_walkspeed": default(5),
            "w_level": F.coalesce(tag(df, "layer"), tag(df, "level"), F.lit("0")),
            **{f"w_{m.lower()}": F.when(on, "yes").otherwise("no") for m, on in mode_on.items()},
        }
    )
    return out.drop("_rule")


def apply_rail_defaults(df: DataFrame) -> DataFrame:
    """Working attributes of rail ways: tracks as lanes, one yes/no column per rail mode."""
    yes = lambda kind, key: F.when(
        (F.coalesce(tag(df, "railway"), F.lit("")) == kind) | (F.coalesce(tag(df, key), F.lit("")) == "yes"), "yes"
    ).otherwise("no")
    return df.withColumns(
        {
            "w_railway": F.when(tag(df, "railway") == "construction", tag(df, "construction")).otherwise(tag(df, "railway")),
            "w_lanes": F.coalesce(tag(df, "tracks"), F.lit("2")),
            "w_level": F.coalesce(tag(df, "layer"), tag(df, "level"), F.lit("0")),
            "w_tram": yes("tram", "tram"),
            "w_lr": yes("light_rail", "light_rail"),
            "w_rail": yes("rail", "rail"),
            "w_sub": yes("subway", "subway"),
        }
    )


def tsys_set(df: DataFrame) -> Column:
    """Comma-separated codes of the modes whose working column says yes, sorted by code."""
    present = [m for m in MODES if f"w_{m.lower()}" in df.columns]
    codes = F.array(*[F.when(F.col(f"w_{m.lower()}") == "yes", F.lit(MODE_CODES[m])) for m in present])
    return F.array_join(F.sort_array(F.filter(codes, lambda c: c.isNotNull())), ",")


def link_type(df: DataFrame, rules: LinkRules = STANDARD_RULES) -> Column:
    """Link type number. Among matching rules the one with most conditions wins, then the smaller number."""
    lanes = F.regexp_extract(F.col("w_lanes"), r"(\d+)", 1).try_cast("int")
    highway = F.col("w_highway") if "w_highway" in df.columns else tag(df, "highway")
    railway = F.col("w_railway") if "w_railway" in df.columns else tag(df, "railway")

    def specificity(rule) -> int:
        return sum(c not in (None, "*") for c in rule[2:5]) + (rule[5] is not None)

    chain = F
    for number, _, road, rail, route, low, high in sorted(rules.types, key=lambda r: (-specificity(r), r[0])):
        hit = F.lit(True)
        if road:
            hit = hit & (highway == road)
        if rail:
            hit = hit & (railway.isNotNull() if rail == "*" else railway == rail)
        if route:
            hit = hit & (tag(df, "route") == route)
        if low is not None:
            hit = hit & (lanes >= low)
        if high is not None:
            hit = hit & (lanes <= high)
        chain = chain.when(hit, F.lit(number))
    return chain.otherwise(F.lit(rules.default_type))


# ---- fixed values: surface, foot and cycle infrastructure classes ---------------------------------------------------
SMOOTH = ("asphalt", "paved", "concrete", "paving_stones", "metal")
ROUGH = ("unpaved", "compacted", "fine_gravel", "gravel", "sett", "wood", "concrete:lanes", "concrete:plates")
FOOT_INFRA = (
    ("highway", ("footway", "path", "track", "pedestrian")),
    ("foot", ("designated", "yes", "destination", "permissive")),
    ("sidewalk", ("right", "left", "both")),
    ("footway", ("sidewalk", "crossing")),
)
CYCLE_INFRA = (
    ("highway", ("cycleway",)),
    ("bicycle_road", ("yes",)),
    ("bicycle", ("yes", "designated", "permissive")),
    ("cycleway", ("lane", "track", "crossing", "shared_lane", "opposite", "share_busway")),
    ("cycleway:left", ("lane", "track", "crossing", "shared_lane", "share_busway")),
    ("cycleway:right", ("lane", "track", "crossing", "shared_lane", "share_busway")),
    ("cycleway:both", ("lane", "track", "crossing", "shared_lane", "share_busway")),
)


def _infra(df: DataFrame, table) -> tuple[Column, Column]:
    """(first matching `key==value` text or NULL, 1 when any matches else 0)."""
    texts = [
        F.when(tag(df, key) == value, F.lit(f"{key}=={value}")) for key, values in table for value in values
    ]
    first = F.coalesce(*texts)
    return first, F.when(first.isNotNull(), 1).otherwise(0)


def link_attributes(df: DataFrame) -> DataFrame:
    """Descriptive link attributes (expects the working columns of `apply_link_defaults`)."""
    t = lambda key: tag(df, key)
    structure = (
        F.when(t("bridge") == "viaduct", "Viaduct").when(t("bridge") == "yes", "Bridge").when(t("tunnel") == "yes", "Tunnel")
        .when(t("embankment") == "yes", "Embankment").when(t("cutting") == "yes", "Cutting")
    )
    surface = (
        F.when(t("surface").isNull(), "unknown").when(t("surface").isin(*SMOOTH), "smoothly paved")
        .when(t("surface").isin(*ROUGH), "roughly paved").otherwise("unpaved")
    )
    foot_text, foot_class = _infra(df, FOOT_INFRA)
    cycle_text, cycle_class = _infra(df, CYCLE_INFRA)
    speed = F.when(F.col("w_maxspeed") == "walk", F.col("w_walkspeed").cast("string")).otherwise(F.col("w_maxspeed"))
    return df.withColumns(
        {
            "link_name": F.coalesce(t("name"), t("ref")),
            "v0": F.regexp_extract(speed, r"(\d+)", 1).try_cast("int"),
            "structure": structure,
            "under_construction": F.when(t("construction").isNotNull(), 1),
            "roundabout": F.when(t("junction") == "roundabout", 1),
            "surface_class": surface,
            "foot_infra_text": foot_text,
            "foot_infra": foot_class,
            "cycle_infra_text": cycle_text,
            "cycle_infra": cycle_class,
        }
    )


def node_attributes(df: DataFrame) -> DataFrame:
    """Control type of signals, and number and name of motorway junctions."""
    highway, crossing = tag(df, "highway"), F.coalesce(tag(df, "crossing"), F.lit(""))
    junction = highway == "motorway_junction"
    return df.withColumns(
        {
            "control_type": F.when((highway == "traffic_signals") & (crossing != "traffic_signals"), 3).otherwise(0),
            "junction": F.when(junction, 1),
            "junction_name": F.when(junction, tag(df, "name")),
            "junction_code": F.when(junction, tag(df, "ref")),
        }
    )


def turn_attributes(df: DataFrame) -> DataFrame:
    """The relation a turn comes from."""
    return df.withColumn("relation_id", F.col("id").cast("string"))


def stop_attributes(df: DataFrame) -> DataFrame:
    """Names, codes and the wheelchair flag of stops, stop points and stop areas; brand of sharing stations."""
    return df.withColumns(
        {
            "stop_name": F.coalesce(tag(df, "name"), tag(df, "ref")),
            "stop_code": tag(df, "ref"),
            "wheelchair_flag": F.when(tag(df, "wheelchair") == "yes", 1).otherwise(0),
            "uic_code": tag(df, "uic_ref"),
            "operator_name": tag(df, "operator"),
            "brand_name": tag(df, "brand"),
        }
    )


# ---- fixed values: number, name, parent, wanted tags (all groups must match), unwanted tags ---------------------------
POI_CATEGORIES = (
    (10, "Traffic Infrastructure", 0, None, ()),
    (11, "Signals", 10, (("highway", "traffic_signals"),), ()),
    (12, "Public Parking", 10, (("amenity", "parking"),), (("access", "private"), ("access", "customers"))),
    (20, "Landuse", 0, None, ()),
    (21, "Residential", 20, (("landuse", "residential"),), ()),
    (22, "Industrial", 20, (("landuse", "industrial"),), ()),
    (23, "Water", 20, (("landuse", "water"), ("natural", "water")), ()),
    (24, "Park", 20, (("leisure", "park"),), ()),
    (25, "PedestrianZones", 20, (("highway", "pedestrian"),), ()),
    (30, "Adminstrative", 0, None, ()),
    (31, "Postal zones", 30, (("boundary", "postal_code"),), ()),
    (34, "Municipality", 30, (("boundary", "administrative"),), ("admin_level", "8")),
    (35, "Quarter", 30, (("boundary", "administrative"),), ("admin_level", "9")),
    (36, "Neighbourhood", 30, (("boundary", "administrative"),), ("admin_level", "10")),
)


def poi_category(df: DataFrame) -> DataFrame:
    """Add `category`, `category_name` and `parent_category` of the first matching category (0 and '' without one)."""
    number, name, parent = F, F, F
    for no, label, up, wanted, extra in POI_CATEGORIES:
        if wanted is None:
            continue
        hit = F.lit(False)
        for key, value in wanted:
            hit = hit | (F.coalesce(tag(df, key), F.lit("")) == value)
        if up == 30 and extra:
            hit = hit & (F.coalesce(tag(df, extra[0]), F.lit("")) == extra[1])
        elif extra:
            for key, value in extra:
                hit = hit & (F.coalesce(tag(df, key), F.lit("")) != value)
        number, name, parent = number.when(hit, F.lit(no)), name.when(hit, F.lit(label)), parent.when(hit, F.lit(up))
    return df.withColumns(
        {
            "category": number.otherwise(F.lit(0)),
            "category_name": name.otherwise(F.lit("")),
            "parent_category": parent.otherwise(F.lit(0)),
        }
    )


def category_attributes(df: DataFrame) -> DataFrame:
    """Attributes that only some categories carry."""
    return df.withColumns(
        {
            "pedestrian_signal": F.when(
                F.col("category") == 11, F.when(F.coalesce(tag(df, "crossing"), F.lit("")) == "traffic_signals", 1).otherwise(0)
            ),
            "capacity_text": F.when(F.col("category") == 12, tag(df, "capacity")),
            "park_and_ride": F.when(
                F.col("category") == 12, F.when(F.coalesce(tag(df, "park_ride"), F.lit("no")) != "no", 1).otherwise(0)
            ),
            "postal_code_text": F.when(F.col("category") == 31, tag(df, "postal_code")),
        }
    )
