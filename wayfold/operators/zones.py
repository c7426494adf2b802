"""Zone tables: repair of missing values, name-driven typing, aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geom import dist_euclid
from .common import join_first, keep_first, keep_group_max, union_layers, with_rank
from .spatial import exists_within, join_circle_boxes, join_largest_overlap

# Canonical column names and the columns typed by name.
RENAMES = {"ZONENO": "NO", "ZONE_NO": "NO", "TYPE_NO": "TYPENO", "FID": "CODE", "ZONE_TYPE": "ZONETYPE"}
WHOLE = ("POP", "MAINZONENO", "TYPENO", "NO")
REAL = (
    "ENTROPY_INDEX", "ENTROPY", "TOTAL_INTENSITY", "HEALTHCARE", "LEISURE", "RETAIL", "EDUCATION", "GOVERNMENT", "XCOORD",
    "YCOORD",
)
DROPPED = ("FID_OLD", "WKTSURFACE", "WKTLOC")


def kind_of(name: str, dtype: str | None = None) -> str:
    """'whole', 'real', 'boolean' or 'text' from a canonical column name and, failing that, its Spark type."""
    if name in WHOLE or name.startswith(("NUM_", "NO_E")):
        return "whole"
    if name in REAL or name.startswith("P_"):
        return "real"
    if dtype in ("double", "float"):
        return "real"
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return "whole"
    return "boolean" if dtype == "boolean" else "text"


def coerce_zone_schema(df: DataFrame) -> DataFrame:
    """Canonical upper-case names; numeric types by name, unreadable values becoming NULL."""
    columns = []
    for name in df.columns:
        upper = name.upper()
        if upper in DROPPED:
            continue
        target = RENAMES.get(upper, upper)
        column = F.col(f"`{name}`")
        if target in WHOLE or target.startswith(("NUM_", "NO_E")):
            column = column.cast("string").try_cast("double").try_cast("long")
        elif target in REAL or target.startswith("P_"):
            column = column.cast("string").try_cast("double")
        columns.append(column.alias(target))
    return df.select(*columns)


def repair_places(df: DataFrame) -> DataFrame:
    """Missing population, name, coordinate, label and zone type replaced by their defaults.

    Boxes stand for the shapes, so the point on the surface is the middle of the box.
    """
    return df.withColumns(
        {
            "pop": F.coalesce(F.ceil("pop_sum"), F.lit(0)).cast("long"),
            "name": F.coalesce(F.nullif(F.col("name_en"), F.lit("")), F.col("name")),
            "xcoord": F.coalesce(F.col("xcoord"), (F.col("xmin") + F.col("xmax")) / 2),
            "ycoord": F.coalesce(F.col("ycoord"), (F.col("ymin") + F.col("ymax")) / 2),
            "label": F.coalesce(F.col("label"), F.lit("Fallback_Geometric_Center")),
            "zone_type": F.coalesce(F.col("zone_type"), F.lit("OA")),
        }
    )


def aggregate_zones(df: DataFrame, key: str, order: Column, sums: tuple[str, ...] = ("POP",)) -> DataFrame:
    """One row per zone: the attributes of its first part, the sum of the additive columns."""
    rest = [c for c in df.columns if c != key and c not in sums]
    first = F.min_by(F.struct(*rest), order)
    out = df.groupBy(key).agg(first.alias("_first"), *[F.sum(c).alias(c) for c in sums])
    return out.select(key, "_first.*", *sums)


def in_countries(df: DataFrame, iso_list: str, column: str = "GID_0") -> DataFrame:
    """Rows whose country is among the first eight requested codes."""
    from ..functions.names import requested_countries

    return df.filter(F.col(column).isin(*requested_countries(iso_list)))


def place_sort_key() -> Column:
    """Orders the places of a zone: with a coordinate first, then by population."""
    return (
        F.col("zoneno") * 100000000 + F.when(F.col("xcoord").isNotNull(), 0).otherwise(1) * 100000 + F.col("pop") * -1
    ).cast("long")


def tier_sort_key(tier: str, intensity: str) -> Column:
    """Orders candidates by tier of their administrative centre (none counts as 9), then by intensity."""
    return (10 - F.coalesce(F.col(tier), F.lit(9))) * 1000 + F.col(intensity)


def zone_type(df: DataFrame) -> Column:
    """The area type under any of its three spellings."""
    spellings = [c for c in ("ZoneType", "Zone Type", "zone_type") if c in df.columns]
    return F.coalesce(*[F.col(f"`{c}`") for c in spellings])


# ---- zone assembly ---------------------------------------------------------------------------------------------------


def crop_zones(zones: DataFrame, mask: DataFrame, pixels: DataFrame, cell: float, size: float) -> DataFrame:
    """Administrative zones without the study area: the area and population left; zones wholly inside are dropped.

    `mask` holds the study area's disjoint cells, `pixels` the population. Exact for shapes made of boxes.
    """
    from .raster import zonal_sum
    from .spatial import join_intersects, pair_overlap, with_bucket, _box_cells, _spread
    from .raster import pixels_to_points

    covered = join_intersects(zones.select("zone_no", "xmin", "xmax", "ymin", "ymax"), mask.select("xmin", "xmax", "ymin", "ymax"), size)
    lost = covered.withColumn("_o", pair_overlap()).groupBy("zone_no").agg(F.sum("_o").alias("_lost"))
    points = with_bucket(pixels_to_points(pixels, cell), size)
    spread = _spread(mask.select("xmin", "xmax", "ymin", "ymax"), _box_cells(size))
    inside = (
        (points.bx == spread.bx) & (points.by == spread.by) & (F.col("x") >= F.col("xmin")) & (F.col("x") < F.col("xmax"))
        & (F.col("y") >= F.col("ymin")) & (F.col("y") < F.col("ymax"))
    )
    outside = points.join(spread, inside, "left_anti").select("col", "row_no", "value")
    left = zonal_sum(outside, zones, cell, "zone_no", size)
    full = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    return (
        left.join(lost, "zone_no", "left")
        .withColumns({"area": full - F.coalesce("_lost", F.lit(0.0)), "pop": F.col("value_sum")})
        .filter("area > 0")
        .drop("_lost", "value_sum")
    )


def admin_points(zones: DataFrame, places: DataFrame, pixels: DataFrame, cell: float, size: float, radius: float = 4000.0, kernel: float = 2000.0) -> DataFrame:
    """One point per zone: its place with most people within 4 km (priority 1), else its densest pixel (priority 2)."""
    from .raster import buffer_sum, kde, pixels_to_points
    from .spatial import join_within

    boxes = zones.select("zone_no", "xmin", "xmax", "ymin", "ymax")
    inside = join_within(places.select("id", "x", "y"), boxes, size, "zone_no").select("id", "x", "y", "zone_no")
    counted = buffer_sum(inside, pixels, cell, radius)
    first = keep_first(counted, ["zone_no"], [-F.col("buf_sum"), F.col("id")]).select("zone_no", "x", "y", F.lit(1).alias("src_priority"))
    surface = pixels_to_points(kde(pixels_to_points(pixels, cell), cell, F.lit(kernel), F.col("value")), cell)
    surface = surface.withColumn("id", F.col("col") * 1000000 + F.col("row_no"))
    densest = join_within(surface.select("id", "x", "y", "value"), boxes, size, "zone_no")
    second = keep_first(densest.select("zone_no", "id", "x", "y", "value"), ["zone_no"], [-F.col("value"), F.col("id")]).select(
        "zone_no", "x", "y", F.lit(2).alias("src_priority")
    )
    return keep_first(first.unionByName(second), ["zone_no"], [F.col("src_priority")])


def match_grid_to_admin(points: DataFrame, cells: DataFrame, radius: float = 1500.0, size: float = 4500.0) -> DataFrame:
    """(zone_no, cell_no): the most intense grid cell that a circle around the zone's point touches.

    `cells` has NO, total_intensity and a box.
    """
    touching = join_circle_boxes(points.select("zone_no", "x", "y"), cells.select("NO", "total_intensity", "xmin", "xmax", "ymin", "ymax"), radius, size)
    best = keep_first(
        touching.select("zone_no", F.col("rNO").alias("cell_no"), "rtotal_intensity"), ["zone_no"], [-F.col("rtotal_intensity"), F.col("cell_no")]
    )
    return best.select("zone_no", "cell_no")


def _flag(points: DataFrame, hits: DataFrame, name: str) -> DataFrame:
    return points.join(hits.withColumn(name, F.lit(True)), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def tier_competition(points: DataFrame) -> DataFrame:
    """Final tiers of grid cells and administrative centres, in four passes.

    `points` has id, x, y, src ('Grid' or 'ADM'), target_tier, type_no, total_intensity and no_e0. Every pass reads
    the whole result of the pass before. All questions are of the form "is there a point of some kind within r", so
    no pairs are listed.
    """
    from ..session import cut

    grid_, adm = F.col("src") == "Grid", F.col("src") == "ADM"
    tier, now = F.col("target_tier"), F.col("type_no")
    wants = lambda *tiers: grid_ & tier.isin(*tiers)

    def near(state: DataFrame, who: Column, whom: Column, radius: float, stronger: bool = False) -> DataFrame:
        margin = "total_intensity" if stronger else None
        return exists_within(state.filter(who), state.filter(whom), radius, margin=margin).select("id")

    # Pass 0: grid cells within 50 km of a stronger one lose, administrative centres yield to any grid cell.
    state = points
    flagged = _flag(state, near(state, wants(0), wants(0), 50000.0, True), "beaten")
    flagged = _flag(flagged, near(state, adm & (tier == 0), wants(0), 50000.0), "shadowed")
    result = (
        F.when(wants(0) & ~F.col("beaten"), 0).when(adm & (tier == 0) & F.col("shadowed"), 1).when(adm & (tier == 0), 0).otherwise(now)
    )
    state = cut(flagged.withColumn("type_no", result).drop("beaten", "shadowed"))

    # Passes 1 and 2: a settled centre of the tier above blocks, as do stronger grid cells of this tier or better.
    steps = ((1, wants(1), (1,), 50000.0, 30000.0), (2, grid_ & ((tier == 2) | ((tier == 1) & (now > 1))), (1, 2), 30000.0, 10000.0))
    for level, claims, rivals, above, same in steps:
        claims = F.coalesce(claims, F.lit(False))
        holds = adm & (now == level)
        flagged = _flag(state, near(state, claims | holds, now == level - 1, above), "blocked")
        flagged = _flag(flagged, near(state, claims, wants(*rivals), same, True), "beaten")
        flagged = _flag(flagged, near(state, holds, wants(*rivals), same), "shadowed")
        flagged = _flag(flagged, near(state, holds, grid_, 1500.0), "crowded")
        result = (
            F.when(claims & ~F.col("blocked") & ~F.col("beaten"), level)
            .when(holds & (F.col("blocked") | F.col("shadowed") | F.col("crowded")), level + 1)
            .when(holds, level)
            .otherwise(now)
        )
        state = cut(flagged.withColumn("type_no", result).drop("blocked", "beaten", "shadowed", "crowded"))

    # Pass 3: also one winner per E0 cell.
    claims = F.coalesce(grid_ & ((tier == 3) | (tier.isin(1, 2) & (now > 2))), F.lit(False))
    holds = adm & (now == 3)
    per_cell = state.groupBy("no_e0").agg(
        F.max(F.when(now.isin(0, 1, 2), 1).otherwise(0)).alias("settled"),
        F.max(F.when(claims, F.col("total_intensity"))).alias("top"),
        F.max(F.when(grid_ & (now.isin(0, 1, 2) | claims), 1).otherwise(0)).alias("urban"),
    )
    flagged = state.join(per_cell, state.no_e0.eqNullSafe(per_cell.no_e0), "left").drop(per_cell.no_e0)
    flagged = _flag(flagged, near(state, claims | holds, now == 2, 10000.0), "blocked")
    flagged = _flag(flagged, near(state, claims, wants(1, 2, 3), 2000.0, True), "beaten")
    flagged = _flag(flagged, near(state, holds, wants(1, 2, 3), 2000.0), "shadowed")
    flagged = _flag(flagged, near(state, holds, grid_, 1500.0), "crowded")
    known = F.col("no_e0").isNotNull()
    loses = (known & (F.col("settled") == 1)) | (known & F.coalesce(F.col("top") > F.col("total_intensity"), F.lit(False)))
    result = (
        F.when(claims & ~F.col("blocked") & ~F.col("beaten") & ~loses, 3)
        .when(claims, 4)
        .when(holds & (F.col("blocked") | F.col("shadowed") | F.col("crowded") | (known & (F.col("urban") == 1))), 4)
        .when(holds, 3)
        .otherwise(now)
    )
    return flagged.withColumn("type_no", result).drop("settled", "top", "urban", "blocked", "beaten", "shadowed", "crowded")


def assemble_zones(cells: DataFrame, admin: DataFrame, all_admin: DataFrame, size: float) -> DataFrame:
    """The final zone table: study cells and cropped administrative zones under one schema, numbered in zone order.

    `cells` has zone_no, main_zone, type_no, pop, x, y, zone_type and a box; `admin` the same without zone_type.
    Names of cells come from the administrative zone (`all_admin`: zone_no, label, box) they share most area with.
    """
    boxes = cells.select("zone_no", "xmin", "xmax", "ymin", "ymax")
    named = join_largest_overlap(boxes, all_admin.select(F.col("zone_no").alias("adm_no"), "label", "xmin", "xmax", "ymin", "ymax"), size, "zone_no", "adm_no")
    inner = cells.join(named.select("zone_no", F.col("rlabel").alias("label")), "zone_no", "left")
    outer = admin.join(all_admin.select("zone_no", "label"), "zone_no", "left")
    columns = ["zone_no", "main_zone", "label", "type_no", "pop", "x", "y", "zone_type"]
    merged = union_layers({"Grid": inner, "ADM": outer}, "src").withColumn("zone_type", F.coalesce("zone_type", F.lit("OA")))
    return with_rank(merged.select("src", *columns), [F.col("zone_no"), F.col("src")], "code")


def main_zones(zones: DataFrame) -> DataFrame:
    """Main zones of a zone table: number, parts, population and the first part's point, numbered in order."""
    grouped = zones.groupBy("main_zone").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("pop").alias("pop"), F.min_by(F.struct("x", "y"), "zone_no").alias("_at")
    )
    return with_rank(grouped.select("main_zone", "parts", "pop", "_at.*"), [F.col("main_zone")], "code")


def centroid_points(zones: DataFrame) -> DataFrame:
    """Zones with a coordinate, as points."""
    from .shapes import with_point

    return with_point(zones, "x", "y")
