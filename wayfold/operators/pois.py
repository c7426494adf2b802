"""Urban centralities: points of interest, duplicates, intensity peaks, centrality levels, cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import poi_rules
from ..functions.geom import dist_euclid, dist_point_box, ring_centroid, shoelace
from ..functions.maths import bucket, saturate
from ..functions.mix import MIX_SECTORS, mix_index
from ..functions.names import name_base
from ..session import cut
from .common import keep_group_max, union_layers
from .raster import KEY, kde, local_maxima, pixels_to_points, stack
from .spatial import _spread, exists_within, not_dominated, with_bucket

# Sectors with their three class letters, as counted per cell.
SECTOR_CLASSES = {
    "Healthcare": ("O", "N", "M"),
    "Government": ("C", "B", "A"),
    "Education": ("F", "E", "D"),
    "Retail": ("T", "S", "R"),
    "Leisure": ("L", "K", "J"),
}


@dataclass(frozen=True)
class CentralityParams:
    """Intensity thresholds (0..25) and distances (metres) of the two centrality levels."""

    min_level3: float = 10.0
    min_level4: float = 7.0
    between_level3: float = 1500.0
    between_level4: float = 700.0
    between_3_and_4: float = 500.0


def classify(df: DataFrame) -> DataFrame:
    """Relevant points with sector, classification, weight, radius, description and name base; unclassified ones are dropped."""
    kept = df.filter(poi_rules.is_relevant(df))
    out = kept.withColumn("sector", poi_rules.poi_sector(kept))
    out = out.withColumns(
        {
            "classification": poi_rules.poi_class(out, F.col("sector")),
            "weight": poi_rules.poi_weight(kept),
            "description": poi_rules.poi_description(kept),
            "main_tag": poi_rules.main_tag(kept),
            "name_base": name_base(F.col("name")),
        }
    )
    out = out.withColumn("radius", poi_rules.poi_radius(F.col("weight")))
    return out.filter(F.col("classification").isNotNull())


def polygon_points(polygons: DataFrame) -> DataFrame:
    """Polygons (`parts`, an array of rings) as points at their area centroid over all parts."""
    areas = F.transform("parts", lambda r: F.abs(shoelace(r)))
    total = F.aggregate(areas, F.lit(0.0), lambda s, a: s + a)
    weighted = lambda i: F.aggregate(
        F.transform("parts", lambda r: F.abs(shoelace(r)) * ring_centroid(r)[i]), F.lit(0.0), lambda s, a: s + a
    )
    return polygons.withColumns({"x": weighted(0) / total, "y": weighted(1) / total}).drop("parts")


def build_pois(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Point and polygon features as one classified table of points."""
    merged = union_layers({"points": points, "polygons": polygon_points(polygons)}, "layer")
    return classify(merged)


def _same_name(a: Column, b: Column) -> Column:
    """Short names must be equal, longer ones may differ in two edits."""
    short = (F.length(a) <= 5) | (F.length(b) <= 5)
    return F.when(short, a == b).otherwise(F.levenshtein(a, b, 2) >= 0)


def duplicate_pois(pois: DataFrame, reach: float = 250.0) -> DataFrame:
    """fid of every point that a better point within `reach` makes redundant.

    The other point has another osm_id, the same sector and main tag and a similar name base; better means higher
    class, then longer name base, then higher osm_id, then higher fid. Within a fine cell (narrower than the reach)
    all points of one name but the best are redundant at once. What is left is compared with one summary row per name
    and neighbouring cell, and only unclear cases with single points.
    """
    size = reach / 1.5
    rank = F.struct(
        F.col("classification").alias("a"), F.length("name_base").alias("b"), F.coalesce(F.col("osm_id").cast("string").try_cast("double"), F.lit(0.0)).alias("c"),
        F.col("fid").alias("d"),
    )
    named = pois.filter("name_base IS NOT NULL AND name_base <> ''").select(
        "fid", "osm_id", "x", "y", "sector", "main_tag", "name_base", rank.alias("rank")
    )
    named = cut(with_bucket(named, size))
    group = ["bx", "by", "sector", "main_tag", "name_base"]
    # Only the columns the comparison needs are kept per name and cell.
    cells = cut(
        named.groupBy(*group).agg(
            F.max("rank").alias("top"), F.max_by(F.struct("osm_id", "x", "y"), "rank").alias("best"),
            F.min("osm_id").alias("id0"), F.max("osm_id").alias("id1"),
            F.min("x").alias("cx0"), F.max("x").alias("cx1"), F.min("y").alias("cy0"), F.max("y").alias("cy1"),
        )
    )
    seen = named.join(cells.select(*group, F.col("best.osm_id").alias("_o"), F.col("top").alias("_t")), group)
    at_once = seen.filter((F.col("rank") < F.col("_t")) & (F.col("osm_id") != F.col("_o"))).select("fid")
    rest = seen.filter((F.col("rank") == F.col("_t")) | (F.col("osm_id") == F.col("_o"))).drop("_t", "_o")

    steps = F.sequence(F.lit(-2), F.lit(2))
    around = F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct((F.col("ox") + i).alias("bx"), (F.col("oy") + j).alias("by")))))
    offers = cells.select(
        F.col("bx").alias("ox"), F.col("by").alias("oy"), "sector", "main_tag", F.col("name_base").alias("other_base"), "top", "best", "id0", "id1",
        "cx0", "cx1", "cy0", "cy1",
    )
    offers = _spread(offers, around)
    nearest = dist_point_box(F.col("x"), F.col("y"), F.col("cx0"), F.col("cx1"), F.col("cy0"), F.col("cy1"))
    tried = rest.join(offers, ["bx", "by", "sector", "main_tag"]).filter(
        (F.col("top") > F.col("rank")) & (nearest <= reach) & ((F.col("id0") != F.col("osm_id")) | (F.col("id1") != F.col("osm_id")))
        & _same_name(F.col("name_base"), F.col("other_base"))
    )
    sure = (F.col("best.osm_id") != F.col("osm_id")) & (
        dist_euclid(F.col("x"), F.col("y"), F.col("best.x"), F.col("best.y")) <= reach
    )
    tried = cut(
        tried.select("fid", "osm_id", "x", "y", "rank", "sector", "main_tag", F.col("other_base").alias("name_base"), F.col("ox").alias("bx"), F.col("oy").alias("by"), sure.alias("sure"))
    )
    judged = tried.filter("sure").select("fid").distinct()
    unclear = tried.join(judged, "fid", "left_anti").drop("sure")
    single = named.select(*group, F.col("osm_id").alias("jid"), F.col("x").alias("jx"), F.col("y").alias("jy"), F.col("rank").alias("jrank"))
    found = unclear.join(single, group).filter(
        (F.col("jid") != F.col("osm_id")) & (F.col("jrank") > F.col("rank"))
        & (dist_euclid(F.col("x"), F.col("y"), F.col("jx"), F.col("jy")) <= reach)
    )
    return at_once.unionByName(judged).unionByName(found.select("fid")).distinct()


def dedupe_pois(pois: DataFrame, reach: float = 250.0) -> DataFrame:
    return pois.join(duplicate_pois(pois, reach), "fid", "left_anti")


def sector_surfaces(pois: DataFrame, cell: float = 25.0) -> DataFrame:
    """Saturated intensity per sector and their sum per pixel, from points with a positive weight."""
    weighted = pois.filter("weight > 0")
    densities = {
        s: kde(weighted.filter(F.col("sector") == s.upper()), cell, F.col("radius"), F.col("weight")) for s in MIX_SECTORS
    }
    stacked = stack(densities)
    stacked = stacked.select(*KEY, *[saturate(F.col(s)).alias(s) for s in MIX_SECTORS])
    total = sum((F.col(s) for s in MIX_SECTORS[1:]), F.col(MIX_SECTORS[0]))
    return stacked.withColumn("total_intensity", total)


def intensity_peaks(pois: DataFrame, params: CentralityParams = CentralityParams(), cell: float = 25.0, window: int = 3) -> DataFrame:
    """Local maxima of the total intensity from the lower threshold, as points with sector values and mix indices."""
    surface = cut(sector_surfaces(pois, cell))
    tops = local_maxima(surface.select(*KEY, F.col("total_intensity").alias("value")), window)
    tops = tops.filter(F.col("value") >= params.min_level4).select(*KEY)
    peaks = surface.join(tops, KEY)
    peaks = pixels_to_points(peaks, cell).withColumn("id", F.col("col") * 1000000 + F.col("row_no"))
    return mix_index(peaks)


def level3(peaks: DataFrame, params: CentralityParams = CentralityParams()) -> DataFrame:
    """Add `is_l3`: strong enough, no stronger candidate within the distance, and the strongest of its E0 cell."""
    strong = peaks.filter(F.col("total_intensity") >= params.min_level3)
    potential = not_dominated(strong.select("id", "x", "y", "total_intensity", "NO_E0"), params.between_level3, "total_intensity")
    winners = keep_group_max(potential, ["NO_E0"], "total_intensity").select("id").withColumn("is_l3", F.lit(1))
    return peaks.join(winners, "id", "left").withColumn("is_l3", F.coalesce("is_l3", F.lit(0)))


def level4(peaks: DataFrame, params: CentralityParams = CentralityParams()) -> DataFrame:
    """Add `is_l4` to peaks with `is_l3`.

    A peak qualifies without a level-3 centre or a stronger other peak nearby; in an E1 cell without a level-3 centre
    the strongest qualifying peak wins.
    """
    centres = peaks.filter("is_l3 = 1")
    others = peaks.filter("is_l3 = 0").select("id", "x", "y", "total_intensity", "NO_E1")
    near = exists_within(others, centres, params.between_3_and_4)
    potential = not_dominated(others, params.between_level4, "total_intensity").join(near, "id", "left_anti")
    free = potential.join(centres.select("NO_E1").distinct(), "NO_E1", "left_anti")
    winners = keep_group_max(free, ["NO_E1"], "total_intensity").select("id").withColumn("is_l4", F.lit(1))
    return peaks.join(winners, "id", "left").withColumn("is_l4", F.coalesce("is_l4", F.lit(0)))


def poi_counts(pois: DataFrame, key: str) -> DataFrame:
    """Five sector counts and fifteen class counts per cell, in one aggregate."""
    counts = []
    for sector, letters in SECTOR_CLASSES.items():
        hit = F.col("sector") == sector.upper()
        counts.append(F.count(F.when(hit, 1)).alias(f"Num_{sector}"))
        counts += [F.count(F.when(hit & (F.col("classification") == c), 1)).alias(f"Num_{sector}_{c}") for c in letters]
    return pois.groupBy(key).agg(*counts)


def with_poi_counts(cells: DataFrame, pois: DataFrame, key: str) -> DataFrame:
    """Cells with their counts, 0 where there are none."""
    counts = poi_counts(pois, key)
    names = [c for c in counts.columns if c != key]
    return cells.join(counts, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})


def cells_with_centrality(cells: DataFrame, peaks: DataFrame, key: str = "NO") -> DataFrame:
    """Every grid cell with its centre of level 3 or 4 (type 9 and the cell's middle without one).

    `peaks` carry the number of the cell they lie in; with several, level 3 and then the strongest counts.
    """
    chosen = peaks.filter("is_l3 = 1 OR is_l4 = 1").withColumn("type_no", F.when(F.col("is_l3") == 1, 3).otherwise(4))
    person = F.struct("x", "y", "type_no", "total_intensity", *MIX_SECTORS, *[f"p_{s}" for s in MIX_SECTORS], "entropy", "entropy_index")
    best = chosen.groupBy(key).agg(F.min_by(person, F.struct("type_no", (-F.col("total_intensity")).alias("i"), "id")).alias("_best"))
    joined = cells.join(best, key, "left")
    zero = lambda c: F.coalesce(F.col(f"_best.{c}"), F.lit(0.0)).alias(c)
    return joined.select(
        *cells.columns, F.coalesce("_best.type_no", F.lit(9)).alias("type_no"),
        F.coalesce("_best.x", (F.col("xmin") + F.col("xmax")) / 2).alias("x"),
        F.coalesce("_best.y", (F.col("ymin") + F.col("ymax")) / 2).alias("y"),
        zero("total_intensity"), *[zero(s) for s in MIX_SECTORS], *[zero(f"p_{s}") for s in MIX_SECTORS], zero("entropy"), zero("entropy_index"),
    )
