"""Extracting features from map data: tag filters, areas, places, points of interest and the road network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geom import strip_ring
from ..functions.tags import any_of, clean, tag
from .common import keep_first
from .outlines import join_outlines, outline_cells

# ---- fixed values: areas without inhabitants -----------------------------------------------------------------------
UNINHABITED = {
    "highway": ("motorway", "trunk", "primary", "secondary", "tertiary"),
    "shop": ("mall",),
    "building": ("commercial", "retail", "school", "construction", "university"),
    "amenity": ("hospital", "bus_station", "school", "police", "parking"),
    "landuse": ("cemetery", "forest", "military", "allotments", "recreation_ground", "plant_nursery", "village_green"),
    "leisure": ("golf_course", "park", "garden", "playground", "pitch"),
    "boundary": ("protected_area",),
    "aeroway": ("aerodrome",),
    "natural": ("wood", "scrub", "grassland", "wetland", "water"),
}
# ---- fixed values: the larger catalogue of non-residential areas ----------------------------------------------------
NON_RESIDENTIAL = {
    "shop": ("mall",),
    "building": (
        "commercial", "retail", "industrial", "warehouse", "office", "kiosk", "school", "university", "hospital",
        "public", "construction", "service",
    ),
    "amenity": (
        "hospital", "clinic", "doctors", "dentist", "pharmacy", "school", "kindergarten", "university", "college",
        "library", "bus_station", "parking", "marketplace", "police", "fire_station", "post_office", "townhall",
        "courthouse", "community_centre", "place_of_worship",
    ),
    "landuse": (
        "commercial", "retail", "industrial", "institutional", "military", "railway", "quarry", "landfill",
        "brownfield", "greenfield", "construction", "cemetery", "religious",
    ),
    "leisure": (
        "golf_course", "stadium", "sports_centre", "track", "pitch", "playground", "park", "garden",
        "nature_reserve", "marina",
    ),
    "boundary": ("protected_area",),
    "aeroway": ("aerodrome", "terminal", "hangar", "helipad"),
    "power": ("plant", "substation", "generator"),
    "man_made": ("works", "wastewater_plant", "storage_tank"),
    "natural": ("wood", "scrub", "grassland", "wetland", "water", "beach", "bare_rock", "scree"),
}
# ---- fixed values: tags kept for points of interest -----------------------------------------------------------------
POI_TAGS = (
    "amenity", "building", "isced:level", "name", "name:en", "name:de", "name:es", "name:fr", "name:pt", "name:ru",
    "name:ar", "name:zh", "name:ja", "name:hi", "alt_name", "official_name", "ref", "shop", "leisure", "tourism",
    "office", "healthcare", "healthcare:speciality", "sport", "railway", "waterway", "aerialway", "type",
    "admin_level", "barrier", "boundary", "craft", "geological", "historic", "land_area", "landuse", "man_made",
    "military", "natural", "place", "addr:street", "addr:housenumber", "addr:postcode", "addr:city", "addr:country",
)
# ---- fixed values: road classes by area -----------------------------------------------------------------------------
OUTER_ROADS = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link",
)
STUDY_ROADS = OUTER_ROADS + ("tertiary", "tertiary_link", "unclassified")
CORE_ROADS = STUDY_ROADS + ("residential",)
# The variant of the first tool generation keeps minor roads as well.
STUDY_ROADS_WIDE = STUDY_ROADS + ("road",)
CORE_ROADS_WIDE = CORE_ROADS + ("living_street", "service", "road")


def tag_filter(df: DataFrame, clauses: dict[str, tuple[str, ...]]) -> DataFrame:
    """Objects for which some clause (key in values) holds."""
    return df.filter(any_of(df, clauses))


def referenced_nodes(nodes: DataFrame, way_nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Nodes used by the given ways."""
    used = way_nodes.join(ways.select("way_id"), "way_id", "left_semi").select("node_id").distinct()
    return nodes.join(used, "node_id", "left_semi")


def extract_within(points: DataFrame, outline: DataFrame, size: float) -> DataFrame:
    """Points inside some ring of `outline` (column `ring`) and, if it has a column `hole`, inside no ring marked so."""
    if "hole" in outline.columns:
        outer = extract_within(points, outline.filter("NOT hole").select("ring"), size)
        return _in_rings(outer, outline.filter("hole"), size, "left_anti")
    return _in_rings(points, outline, size, "left_semi")


def _in_rings(points: DataFrame, outline: DataFrame, size: float, how: str) -> DataFrame:
    return join_outlines(points, outline_cells(outline, size), size, lambda inside, d: inside, how)


def extract_ways_within(ways: DataFrame, way_nodes: DataFrame, nodes: DataFrame, outline: DataFrame, size: float):
    """Ways with a node inside the outline, and all their nodes (also those outside)."""
    inside = extract_within(nodes, outline, size).select("node_id")
    hit = way_nodes.join(inside, "node_id", "left_semi").select("way_id").distinct()
    kept = ways.join(hit, "way_id", "left_semi")
    return kept, referenced_nodes(nodes, way_nodes, kept)


def extract_places(nodes: DataFrame) -> DataFrame:
    """Cities and towns with their names; missing texts are empty, a missing id is 'unknown'."""
    place = tag(nodes, "place")
    return nodes.filter(place.isin("city", "town")).select(
        F.coalesce(F.nullif(F.split(clean(F.col("id").cast("string")), r"\.")[0], F.lit("")), F.lit("unknown")).alias("osm_id"),
        clean(tag(nodes, "name")).alias("name"),
        clean(tag(nodes, "name:en")).alias("name_en"),
        clean(place).alias("place_type"),
    )


def uninhabited_category(df: DataFrame) -> Column:
    """Category ladder, first match wins."""
    t = lambda key: clean(tag(df, key))
    return (
        F.when(t("highway") != "", "street")
        .when(t("building") != "", "building")
        .when((t("landuse") == "forest") | (t("natural") == "wood"), "forest")
        .when(
            t("leisure").isin("park", "playground", "pitch", "garden", "golf_course")
            | t("landuse").isin("recreation_ground", "village_green"),
            "park_recreation",
        )
        .when(t("natural") == "water", "water")
        .when(
            (t("natural") != "") | t("landuse").isin("cemetery", "military", "allotments", "plant_nursery")
            | (t("leisure") != "") | (t("boundary") == "protected_area"),
            "green_area",
        )
        .when((t("amenity") != "") | (t("shop") != "") | (t("aeroway") != ""), "amenity_shop")
        .otherwise("other")
    )


def uninhabited_features(features: DataFrame) -> DataFrame:
    """Features without inhabitants with their category; underground parking is none of them."""
    t = lambda key: clean(tag(features, key))
    underground = (t("amenity") == "parking") & ((t("parking") == "underground") | (t("location") == "underground"))
    return tag_filter(features, UNINHABITED).filter(~underground).withColumn("category", uninhabited_category(features))


def extract_uninhabited(features: DataFrame, half_width: float = 0.5) -> DataFrame:
    """Uninhabited features as boxes: filtered, categorised, without underground parking.

    `features` has xmin..ymax and `is_line`; boxes of lines are widened by half a metre on each side. Where the course of
    a line is known, `uninhabited_strips` covers no more than the line itself.
    """
    grow = F.when(F.col("is_line"), F.lit(half_width)).otherwise(0.0)
    return uninhabited_features(features).withColumns(
        {
            "xmin": F.col("xmin") - grow, "xmax": F.col("xmax") + grow,
            "ymin": F.col("ymin") - grow, "ymax": F.col("ymax") + grow,
        }
    )


def line_strips(lines: DataFrame, half_width: float = 0.5) -> DataFrame:
    """One row per segment of each line's `path` (an array of x, y): its number `part` and the `ring` of the strip along it.

    Strips end in square caps, so that those of neighbouring segments overlap at a bend. Segments without length are left out.
    """
    ends = F.transform(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), lambda p, i: F.struct(p.alias("p"), F.get(F.col("path"), i + 1).alias("q")))
    segments = lines.select(*[c for c in lines.columns if c != "path"], F.posexplode(ends).alias("part", "_s")).filter("_s.p != _s.q")
    ring = strip_ring(F.col("_s.p.x"), F.col("_s.p.y"), F.col("_s.q.x"), F.col("_s.q.y"), half_width)
    # A generator, as an expression would be worked out again for every use of the ring.
    return segments.withColumn("ring", F.explode(F.array(ring))).drop("_s")


def uninhabited_strips(lines: DataFrame, half_width: float = 0.5) -> DataFrame:
    """Uninhabited lines (with `path`) as strips along their segments, with their category."""
    return line_strips(uninhabited_features(lines), half_width)


def extract_pois(features: DataFrame, wanted: tuple[str, ...] = POI_TAGS) -> DataFrame:
    """Wanted tags as text columns ('' when missing); features with none of them are dropped."""
    columns = [clean(tag(features, key)).alias(key) for key in wanted]
    flat = features.select(F.coalesce(F.col("id").cast("string"), F.lit("unknown")).alias("osm_id"), "x", "y", *columns)
    return flat.filter(F.concat(*[F.col(f"`{key}`") for key in wanted]) != "")


def extract_nonresidential(areas: DataFrame, window: DataFrame) -> DataFrame:
    """Areas of the catalogue clipped to the windows, one row per part and window.

    `areas` has id, tags and `parts`, an array of boxes.
    """
    from .spatial import clip_boxes

    hit = any_of(areas, NON_RESIDENTIAL)
    parts = areas.filter(hit).select("id", F.posexplode("parts").alias("part", "_p")).select("id", "part", "_p.*")
    return clip_boxes(parts, window)


def nonresidential_within(areas: DataFrame, outlines: DataFrame, size: float, mask: str = "mask") -> DataFrame:
    """Areas of the catalogue clipped to outlines, one row per area, outline and part with its `outer` ring and `holes`.

    `areas` has id, tags, `ring` and, if there are holes, `hole`: a row per ring. `outlines` has `mask`, `ring` and `hole` likewise.
    """
    from .overlay import clip_polygons

    return clip_polygons(areas.filter(any_of(areas, NON_RESIDENTIAL)), outlines, size, mask=mask)


def hierarchical_network(
    ways: DataFrame,
    in_core: Column,
    in_study: Column,
    core: tuple[str, ...] = CORE_ROADS,
    study: tuple[str, ...] = STUDY_ROADS,
    outer: tuple[str, ...] = OUTER_ROADS,
    special: tuple[tuple[str, str], ...] = (("route", "ferry"),),
) -> DataFrame:
    """Ways by area: everything to residential in the core, fewer classes in the study area, main roads elsewhere.

    `in_core` and `in_study` say whether a way touches the area. The layers overlap, but each way is one row of the
    input, so their union without duplicates is one filter and needs no shuffle.
    """
    highway = tag(ways, "highway")
    keep = (in_core & highway.isin(*core)) | (in_study & highway.isin(*study)) | highway.isin(*outer)
    for key, value in special:
        keep = keep | (tag(ways, key) == value)
    return ways.filter(F.coalesce(keep, F.lit(False)))


def merge_layers(*layers: DataFrame) -> DataFrame:
    """Union of network layers read from separate files, each way once."""
    merged = layers[0]
    for layer in layers[1:]:
        merged = merged.unionByName(layer)
    rest = [c for c in merged.columns if c != "way_id"]
    return keep_first(merged, ["way_id"], [F.to_json(F.struct(*rest))])
