"""Region catalogues: regions near points, their countries, and the country codes a study refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import extract_key
from ..session import cut, discard
from .common import keep_first
from .outlines import regions_within, regions_within_km


def region_countries(regions: DataFrame) -> DataFrame:
    """(id, country): the topmost ancestor with a country code, else the region named by the id's first part.

    `regions` has id (unique), parent and alpha2 (NULL unless the region is a country). Every round doubles the stretch of
    the chain that a region has seen, for all regions at once. A chain that runs into a circle has no topmost
    ancestor, so its regions take the country of their id's first part.
    """
    walk = cut(regions.select("id", F.col("parent").alias("up"), F.when(F.col("alpha2").isNotNull(), F.col("id")).alias("country")))
    seen, known = 1, walk.count()
    # A stretch longer than there are regions goes round in a circle.
    while seen <= known and not walk.filter("up IS NOT NULL").isEmpty():
        ahead = walk.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("country").alias("_country"))
        further = walk.join(ahead, "up", "left").select("id", F.col("_up").alias("up"), F.coalesce("_country", "country").alias("country"))
        written = cut(further)
        discard(walk)
        walk, seen = written, seen * 2
    by_chain = walk.select("id", F.when(F.col("up").isNull(), F.col("country")).alias("country"))
    countries = regions.filter("alpha2 IS NOT NULL").select(F.col("id").alias("_prefix"))
    prefixed = by_chain.withColumn("_prefix", F.when(F.col("id").contains("/"), F.split("id", "/")[0]))
    prefixed = prefixed.join(countries.withColumn("_hit", F.col("_prefix")), "_prefix", "left")
    return prefixed.select("id", F.coalesce("country", "_hit").alias("country")).filter("country IS NOT NULL")


def regions_near(points: DataFrame, regions: DataFrame, radius: float, size: float, degrees: bool = False) -> DataFrame:
    """Regions within `radius` of each point with their country, ordered as a reader would want them.

    `points` has id, x, y and code (the point's own country code); `regions` has id, parent, alpha2 and `ring`.
    The result has one row per point, country and sub-region (sub-region NULL when a country has none): the point's
    own country first, then by distance; sub-regions by distance. With `degrees`, coordinates are longitudes and
    latitudes, `size` is in degrees, and the radius and all distances are great-circle kilometres.
    """
    named = regions.select(F.col("id").alias("region"), F.col("parent").alias("_parent"), "ring")
    within = regions_within_km if degrees else regions_within
    near = within(points.select("id", "x", "y", "code"), named, radius, size, ["region", "_parent"]).drop("x", "y")
    home = region_countries(regions).select(F.col("id").alias("region"), "country")
    codes = regions.filter("alpha2 IS NOT NULL").select(F.col("id").alias("country"), "alpha2")
    found = near.join(home, "region").join(codes, "country")
    country = found.groupBy("id", "country").agg(
        F.min("d").alias("country_distance"), F.max(F.lower("alpha2") == F.lower("code")).alias("is_primary")
    )
    order = Window.partitionBy("id").orderBy(F.col("is_primary").desc(), "country_distance", "country")
    country = country.withColumn("country_rank", F.row_number().over(order))
    belongs = (F.col("region") != F.col("country")) & (
        F.coalesce(F.col("_parent") == F.col("country"), F.lit(False)) | F.col("region").startswith(F.concat("country", F.lit("/")))
    )
    subs = found.filter(belongs).select("id", "country", "region", "d").distinct()
    sub_order = Window.partitionBy("id", "country").orderBy("d", "region")
    subs = subs.withColumn("region_rank", F.row_number().over(sub_order)).withColumnRenamed("d", "region_distance")
    return country.join(subs, ["id", "country"], "left")


def resolve_countries(refs: DataFrame, regions: DataFrame, iso: DataFrame, default: str = "DEU") -> DataFrame:
    """(study, codes): the alpha-3 codes a study's extracts refer to, in order of first mention.

    `refs` has study, seq, region, filename and country_code (two or three letters); `iso` has alpha2 and alpha3.
    A reference contributes its own code, then the country of its region, found by id or by its file name's key.
    """
    home = region_countries(regions).join(regions.select(F.col("id").alias("country"), "alpha2"), "country").select(
        F.col("id").alias("_key"), F.col("alpha2").alias("_home")
    )
    keyed = refs.withColumn("_file", extract_key(F.col("filename")))
    by_id = keyed.join(home.withColumnsRenamed({"_key": "region", "_home": "_a"}), "region", "left")
    by_file = by_id.join(home.withColumnsRenamed({"_key": "_file", "_home": "_b"}), "_file", "left")
    mentions = by_file.select(
        "study", "seq",
        F.posexplode(F.array(F.upper(F.trim("country_code")), F.upper(F.coalesce("_a", "_b")))).alias("pos", "code"),
    ).filter("code IS NOT NULL")
    two = mentions.filter(F.length("code") == 2).join(iso, F.col("code") == F.col("alpha2")).select("study", "seq", "pos", F.col("alpha3").alias("code"))
    three = mentions.filter(F.length("code") == 3).select("study", "seq", "pos", "code")
    # At most one row per country and study is left before the ordered list is collected.
    first = two.unionByName(three).groupBy("study", "code").agg(F.min(F.struct("seq", "pos")).alias("_at"))
    lists = first.groupBy("study").agg(F.sort_array(F.collect_list(F.struct("_at", "code"))).alias("_codes"))
    named = lists.select("study", F.array_join(F.transform("_codes", lambda c: c.code), ", ").alias("codes"))
    return refs.select("study").distinct().join(named, "study", "left").select("study", F.coalesce("codes", F.lit(default)).alias("codes"))
