"""Central places: choice per zone, functional clusters, mass index and greedy tier allocation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geom import dist_euclid
from ..session import cut
from .common import exact_quantiles, keep_first, keep_group_max, top_share
from .graph import proximity_components
from .raster import buffer_sum
from .spatial import as_right, join_distance, join_knn, join_within

# Protection radii as shares of the base distance, reference share, dominance factor, index exponent.
RADIUS_FACTORS = (1.5, 0.8, 0.4, 0.15)
REFERENCE_SHARE = 0.05
DOMINANCE = 3.0
INDEX_EXPONENT = 1.0
DEFAULT_BASE_KM = 50.0


@dataclass(frozen=True)
class TierParams:
    """Thresholds and tolerances (percent) of the categorisation."""

    min_pop: tuple[int, int, int] = (500000, 200000, 100000)
    pop_tolerance: int = 10
    distance_tolerance: int = 10
    dual_km: float = 5.0
    dual_tolerance: int = 20
    dual_min_share: int = 15


def place_per_zone(places: DataFrame, zones: DataFrame, pixels: DataFrame, cell: float, radius: float, size: float) -> DataFrame:
    """Every zone with its main place: the one with most people within `radius`; zones without a place get a fallback.

    `places` has id, name, x, y; `zones` zone_no, pop and a box.
    """
    inside = join_within(places.select("id", "name", "x", "y"), zones.select("zone_no", "xmin", "xmax", "ymin", "ymax"), size, "zone_no")
    counted = buffer_sum(inside.select("id", "name", "x", "y", "zone_no"), pixels, cell, radius)
    top = keep_group_max(counted, ["zone_no"], "buf_sum")
    chosen = keep_first(top, ["zone_no"], [F.col("id")]).select("zone_no", "name", "x", "y", "buf_sum")
    joined = zones.join(chosen, "zone_no", "left")
    return joined.select(
        "zone_no", "pop",
        F.coalesce("name", F.lit("Fallback_Geometric_Center")).alias("name"),
        F.coalesce("x", (F.col("xmin") + F.col("xmax")) / 2).alias("x"),
        F.coalesce("y", (F.col("ymin") + F.col("ymax")) / 2).alias("y"),
        F.coalesce("buf_sum", F.lit(0.0)).alias("buf_sum"),
    )


def place_density(places: DataFrame, zones: DataFrame) -> DataFrame:
    """Add `density`: people per square kilometre of the zone, 0 when the zone is unknown."""
    area = zones.select("zone_no", F.greatest((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")) / 1e6, F.lit(0.001)).alias("_km2"))
    joined = places.join(area, "zone_no", "left")
    return joined.withColumn("density", F.when(F.col("_km2").isNotNull(), F.col("pop") / F.col("_km2")).otherwise(0.0)).drop("_km2")


def place_clusters(places: DataFrame, km: float) -> DataFrame:
    """Add `component`: places closer than `km` (strictly), directly or through others."""
    return places.join(proximity_components(places, km * 1000.0, strict=True).select("id", "component"), "id")


def _own_pop() -> Column:
    return F.coalesce(F.col("pop").cast("double"), F.lit(0.0))


def cluster_summary(places: DataFrame, params: TierParams = TierParams()) -> DataFrame:
    """One row per cluster of two or more: primary, densest member, members, population.

    The primary is the densest (then most populous, then first) member holding the minimum share of the cluster's
    population, or of all members if none does. Members meet only in per-cluster aggregates.
    """
    total = places.groupBy("component").agg(F.sum(_own_pop()).alias("cluster_pop"), F.count(F.lit(1)).alias("members"))
    total = cut(total.filter("members > 1"))  # written, so that a large cluster can be split
    member = places.join(total, "component")
    member = member.withColumn("_enough", _own_pop() >= F.col("cluster_pop") * (params.dual_min_share / 100.0))
    person = F.struct("id", "name", F.col("pop").alias("pop"))
    best = F.struct(F.col("_enough"), F.col("density"), _own_pop().alias("p"), (-F.col("id")).alias("i"))
    dense = F.struct(F.col("density"), _own_pop().alias("p"), (-F.col("id")).alias("i"))
    return member.groupBy("component").agg(
        F.max_by(person, best).alias("primary"), F.max_by(person, dense).alias("densest"),
        F.first("cluster_pop").alias("cluster_pop"), F.first("members").alias("members"),
    )


def cluster_primary(places: DataFrame, params: TierParams = TierParams()) -> DataFrame:
    """Add `role` (Primary, Secondary, None), `primary_name`, `partners` (their number) and `eff_pop`.

    Partner names are a relation of their own (`cluster_partners`), as a cluster may have any number of members.
    """
    summary = cluster_summary(places, params).select(
        "component", F.col("primary.id").alias("_pid"), F.col("primary.name").alias("primary_name"), "cluster_pop", "members"
    )
    summary = cut(summary)
    joined = places.join(summary, "component", "left")
    is_primary = F.col("id") == F.col("_pid")
    return joined.withColumns(
        {
            "role": F.when(F.col("_pid").isNull(), "None").when(is_primary, "Primary").otherwise("Secondary"),
            "partners": F.when(F.col("_pid").isNull(), 0).when(is_primary, F.col("members") - 1).otherwise(1),
            "eff_pop": F.when(F.col("_pid").isNotNull() & is_primary, F.col("cluster_pop")).otherwise(_own_pop()),
        }
    ).drop("_pid", "cluster_pop", "members")


def cluster_partners(places: DataFrame, params: TierParams = TierParams()) -> DataFrame:
    """(id, partner, partner_name): the primary with each of its secondaries, and each secondary with its primary."""
    summary = cut(cluster_summary(places, params).select("component", F.col("primary.id").alias("pid"), F.col("primary.name").alias("pname")))
    member = places.select("component", "id", "name").join(summary, "component").filter("id <> pid")
    return member.select(F.col("pid").alias("id"), F.col("id").alias("partner"), F.col("name").alias("partner_name")).unionByName(
        member.select("id", F.col("pid").alias("partner"), F.col("pname").alias("partner_name"))
    )


def replaced_primaries(places: DataFrame, params: TierParams = TierParams()) -> DataFrame:
    """Clusters whose densest member is not the primary because its population share is too small."""
    return cluster_summary(places, params).filter("primary.id <> densest.id").select(
        "component", F.col("densest.name").alias("rejected"), F.col("densest.pop").alias("pop"), "cluster_pop",
        F.when(F.col("cluster_pop") > 0, F.col("densest.pop") / F.col("cluster_pop") * 100.0).otherwise(0.0).alias("share"),
        F.col("primary.name").alias("replaced_by"),
    )


def reference_places(places: DataFrame) -> DataFrame:
    """Places the baselines are taken from: no secondaries, zone numbers of the home country (all if there are none)."""
    candidates = places.filter("role <> 'Secondary'")
    home = candidates.filter("zone_no > 2000000 AND zone_no < 3000000")
    return candidates if home.isEmpty() else home


def base_distance(places: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """One row `base_km`: the median distance to the nearest neighbour among the most populous reference places."""
    reference = reference_places(places) if reference is None else reference
    top = cut(top_share(reference.select("id", "x", "y", "eff_pop"), [F.col("eff_pop").desc(), F.col("id")], REFERENCE_SHARE, 2))
    near = join_knn(top.select("id", "x", "y"), as_right(top.select("id", "x", "y")), 1, exclude_same=True)
    median = exact_quantiles(near.withColumn("km", F.col("d") / 1000.0), "km", {"base_km": 0.5})
    return median.select(F.coalesce("base_km", F.lit(DEFAULT_BASE_KM)).alias("base_km"))


def median_density(reference: DataFrame) -> DataFrame:
    return exact_quantiles(reference, "density", {"median_density": 0.5}).select(
        F.coalesce("median_density", F.lit(1.0)).alias("median_density")
    )


def _factor(params: TierParams) -> Column:
    general, dual = 1.0 - params.pop_tolerance / 100.0, 1.0 - params.dual_tolerance / 100.0
    return F.when(F.col("role") == "Primary", dual).otherwise(general)


def eligible_tier(params: TierParams = TierParams()) -> Column:
    """Tier by effective population alone."""
    tier = F.when(F.col("role") == "Secondary", 4)
    for level, threshold in enumerate(params.min_pop):
        tier = tier.when(F.col("eff_pop") >= F.lit(float(threshold)) * _factor(params), level)
    return tier.otherwise(3)


def mass_index(places: DataFrame, median: DataFrame) -> DataFrame:
    """Add `rel_density` and `cmi` = effective population times relative density to a fixed power."""
    joined = places.join(F.broadcast(median))  # one row
    joined = joined.withColumn(
        "rel_density", F.when(F.col("median_density") > 0, F.col("density") / F.col("median_density")).otherwise(1.0)
    )
    return joined.withColumn("cmi", F.col("eff_pop") * F.pow(F.col("rel_density"), F.lit(INDEX_EXPONENT))).drop("median_density")


def rank_places(places: DataFrame, name: str = "position") -> DataFrame:
    """Position by descending mass index, input order (id) on ties."""
    from .common import with_rank

    return with_rank(places, [F.col("cmi").desc(), F.col("id")], name)


def allocate_tiers(places: DataFrame, params: TierParams = TierParams()) -> DataFrame:
    """Tier of every place, as if places were taken one by one in order of their mass index.

    `places` is the output of `mass_index` plus a `base_km` column. A place depends only on earlier places inside its
    own largest radius, so all places whose earlier neighbours are decided can be decided together, round by round.
    Secondaries are out beforehand and the others are at least the cluster distance apart, so the number of
    neighbours of a place is bounded by geometry however many places there are.
    """
    shrink = F.when(
        F.col("rel_density") > 1.0, F.least(F.lit(float(params.distance_tolerance)), (F.col("rel_density") - 1.0) * 5.0)
    ).otherwise(0.0)
    modifier = 1.0 - shrink / 100.0
    thresholds = {f"t{i}": F.lit(float(t)) * _factor(params) for i, t in enumerate(params.min_pop)}
    radii = {f"r{i}": F.col("base_km") * f * 1000.0 * modifier for i, f in enumerate(RADIUS_FACTORS)}
    ranked = places.withColumns({"elig": eligible_tier(params), **thresholds, **radii})
    main = cut(ranked.filter("role <> 'Secondary'"))
    base = main.agg(F.max("base_km")).first()[0]
    if base is None:
        return _finish(ranked.filter("role = 'Secondary'"))

    centres = _decide_upper(main, base)
    blocked = _blockers(main, centres, base)
    lower = _decide_lower(main, centres, base)
    typed = main.join(centres.select("id", "type_no").unionByName(lower.select("id", "type_no")), "id")
    typed = typed.join(blocked, "id", "left").join(lower.select("id", F.col("blocker").alias("_low")), "id", "left")
    found = F.coalesce("_upper", "_low")
    typed = typed.withColumns(
        {
            "in_catchment_of": F.coalesce(found.getField("name"), F.lit("-")),
            "catchment_level": F.coalesce(found.getField("cat"), F.lit(-1)),
            "blocker_pop": F.coalesce(found.getField("pop").cast("double"), F.lit(0.0)),
        }
    ).drop("_upper", "_low")
    return _finish(typed).unionByName(_finish(ranked.filter("role = 'Secondary'")))


def _earlier(left: str = "", right: str = "r") -> Column:
    """The right place comes before the left one."""
    return (F.col(f"{right}cmi") > F.col(f"{left}cmi")) | (
        (F.col(f"{right}cmi") == F.col(f"{left}cmi")) & (F.col(f"{right}id") < F.col(f"{left}id"))
    )


def _neighbours(left: DataFrame, right: DataFrame, radius: float, extra: list[str] = ()) -> DataFrame:
    """Earlier right places around each left place."""
    pairs = join_distance(left, as_right(right.select("id", "x", "y", "cmi", *extra), "r"), radius, strict=True)
    return pairs.filter(_earlier() & (F.col("id") != F.col("rid")))


def _decide_upper(main: DataFrame, base: float) -> DataFrame:
    """(id, name, x, y, cmi, pop, type_no) of the places that become tier 0, 1 or 2.

    Only places populous enough for tier 2 take part: no other place can block them. Every round narrows what an
    undecided place can still become (`can0`..`can2`) from what its earlier neighbours are or can become, so a place
    need not wait for neighbours that cannot matter; few rounds are needed.
    """
    able = cut(main.filter("elig <= 2").select("id", "name", "x", "y", "cmi", "pop", "eff_pop", "t0", "t1", "t2", "r0", "r1", "r2"))
    pairs = _neighbours(able.select("id", "x", "y", "cmi", "r0", "r1", "r2"), able, base * RADIUS_FACTORS[0] * 1000.0)
    pairs = cut(
        pairs.filter("d < r0").select("id", "rid", (F.col("d") < F.col("r1")).alias("in1"), (F.col("d") < F.col("r2")).alias("in2"))
    )
    enough = lambda i: F.col("eff_pop") >= F.col(f"t{i}")
    state = able.select(
        "id", F.lit(None).cast("int").alias("type_no"), enough(0).alias("can0"), enough(1).alias("can1"), enough(2).alias("can2"),
        enough(0).alias("e0"), enough(1).alias("e1"), enough(2).alias("e2"),
    )
    within = {0: F.lit(True), 1: F.col("in1"), 2: F.col("in2")}
    while True:
        # Settled neighbours of tier -1 never matter again.
        other = state.filter("type_no IS NULL OR type_no >= 0").select(
            F.col("id").alias("rid"), F.col("type_no").alias("rt"), *[F.col(f"can{i}").alias(f"rc{i}") for i in range(3)]
        )
        seen = pairs.join(other, "rid")
        may = {
            i: F.when(F.col("rt").isNull(), F.greatest(*[F.col(f"rc{k}") for k in range(i + 1)]) if i else F.col("rc0")).otherwise(F.col("rt") <= i)
            for i in range(3)
        }
        flags = seen.groupBy("id").agg(
            *[F.max(within[i] & F.coalesce(F.col("rt") <= i, F.lit(False))).alias(f"sure{i}") for i in range(3)],
            *[F.max(within[i] & may[i]).alias(f"may{i}") for i in range(3)],
        )
        told = state.join(flags, "id", "left")
        yes = lambda c: F.coalesce(F.col(c), F.lit(False))
        told = told.withColumns(
            {
                "must0": F.col("e0") & ~yes("may0"), "n0": F.col("can0") & ~yes("sure0"),
            }
        )
        told = told.withColumns(
            {
                "must1": ~F.col("n0") & F.col("e1") & ~yes("may1"), "n1": F.col("can1") & ~F.col("must0") & ~yes("sure1"),
            }
        )
        told = told.withColumns(
            {
                "must2": ~F.col("n0") & ~F.col("n1") & F.col("e2") & ~yes("may2"),
                "n2": F.col("can2") & ~F.col("must0") & ~F.col("must1") & ~yes("sure2"),
            }
        )
        verdict = (
            F.when(F.col("type_no").isNotNull(), F.col("type_no")).when(F.col("must0"), 0).when(F.col("must1"), 1)
            .when(F.col("must2"), 2).when(~F.col("n0") & ~F.col("n1") & ~F.col("n2"), -1)
        )
        state = cut(
            told.select(
                "id", verdict.cast("int").alias("type_no"), F.col("n0").alias("can0"), F.col("n1").alias("can1"), F.col("n2").alias("can2"),
                "e0", "e1", "e2",
            )
        )
        if state.filter("type_no IS NULL").isEmpty():
            break
    return able.join(state.filter("type_no >= 0").select("id", "type_no"), "id").select("id", "name", "x", "y", "cmi", "pop", "type_no")


def _blockers(main: DataFrame, centres: DataFrame, base: float) -> DataFrame:
    """(id, _upper): the first earlier centre whose tier's radius covers the place, lowest tier first."""
    left = main.select("id", "x", "y", "cmi", "r0", "r1", "r2")
    pairs = _neighbours(left, centres, base * RADIUS_FACTORS[0] * 1000.0, ["name", "pop", "type_no"])
    reach = F.when(F.col("rtype_no") == 0, F.col("r0")).when(F.col("rtype_no") == 1, F.col("r1")).otherwise(F.col("r2"))
    person = F.struct(F.col("rname").alias("name"), F.col("rpop").alias("pop"), F.col("rtype_no").alias("cat"))
    return pairs.filter(F.col("d") < reach).groupBy("id").agg(
        F.min_by(person, F.struct("rtype_no", (-F.col("rcmi")).alias("c"), "rid")).alias("_upper")
    )


def _decide_lower(main: DataFrame, centres: DataFrame, base: float) -> DataFrame:
    """(id, type_no, blocker): tier 4 for places with an earlier centre of any tier inside their smallest radius, else 3."""
    rest = main.join(centres.select("id"), "id", "left_anti").select("id", "name", "x", "y", "cmi", "pop", "r3")
    rest = cut(rest)
    reach = base * RADIUS_FACTORS[3] * 1000.0
    covered = _neighbours(rest, centres, reach).filter("d < r3").select("id").distinct()
    pairs = cut(
        _neighbours(rest.select("id", "x", "y", "cmi", "r3"), rest, reach, ["name", "pop"]).filter("d < r3")
        .select("id", "rid", "rcmi", "rname", "rpop")
    )
    state = cut(
        rest.select("id").join(covered.withColumn("_c", F.lit(4)), "id", "left").select("id", F.col("_c").alias("type_no"))
    )
    while True:
        seen = pairs.join(state.withColumnsRenamed({"id": "rid", "type_no": "rt"}), "rid")
        flags = seen.groupBy("id").agg(
            F.max(F.when(F.col("rt") == 3, 1).otherwise(0)).alias("three"),
            F.max(F.when(F.col("rt").isNull(), 1).otherwise(0)).alias("open"),
        )
        verdict = (
            F.when(F.col("type_no").isNotNull(), F.col("type_no")).when(F.col("three") == 1, 4)
            .when(F.coalesce("open", F.lit(0)) == 1, F.lit(None)).otherwise(3)
        )
        state = cut(state.join(flags, "id", "left").select("id", verdict.cast("int").alias("type_no")))
        if state.filter("type_no IS NULL").isEmpty():
            break
    third = state.filter("type_no = 3").select(F.col("id").alias("rid"))
    person = F.struct(F.col("rname").alias("name"), F.col("rpop").alias("pop"), F.lit(3).alias("cat"))
    blocker = pairs.join(third, "rid", "left_semi").groupBy("id").agg(
        F.min_by(person, F.struct((-F.col("rcmi")).alias("c"), "rid")).alias("blocker")
    )
    return state.join(blocker, "id", "left")


def _finish(typed: DataFrame) -> DataFrame:
    """Output columns with the reason texts."""
    if "type_no" not in typed.columns:
        return typed.select(
            "id", "name", "x", "y", "pop", "zone_no", F.lit(4).alias("type_no"), "role", "primary_name",
            _own_pop().alias("eff_pop"), "density", F.lit(0.0).alias("rel_density"), F.lit(4).alias("init_level"),
            F.lit("-").alias("in_catchment_of"), F.lit(-1).alias("catchment_level"), F.lit(0.0).alias("blocker_pop"),
            F.concat(
                F.lit("Dual Centre Subordination: Integrated with primary partner "), F.col("primary_name"), F.lit(".")
            ).alias("reason"),
            "base_km", F.lit(0.0).alias("cmi"),
        )
    small = F.col("eff_pop") < F.col("t2")
    inside = lambda verb: F.concat(
        F.lit(f"{verb} inside TypeNo "), F.col("catchment_level").cast("string"), F.lit(" radius ("), F.col("in_catchment_of"), F.lit(")")
    )
    reason = (
        F.when(F.col("type_no") == 0, "TypeNo 0 (MR): Independent")
        .when(F.col("type_no") == 1, "TypeNo 1 (HOC): Independent")
        .when(F.col("type_no") == 2, "TypeNo 2 (MOC): Independent")
        .when(F.col("type_no") == 4, F.when(small, F.lit("TypeNo 4 (Mun): Insufficient population")).otherwise(inside("Subsumed")))
        .otherwise(F.when(small, F.lit("TypeNo 3 (LOC): Local spatial independence")).otherwise(inside("Constrained")))
    )
    return typed.select(
        "id", "name", "x", "y", "pop", "zone_no", "type_no", "role", "primary_name", "eff_pop", "density", "rel_density",
        F.col("elig").alias("init_level"), "in_catchment_of", "catchment_level", "blocker_pop", reason.alias("reason"), "base_km", "cmi",
    )


def categorise(places: DataFrame, zones: DataFrame, params: TierParams = TierParams()) -> DataFrame:
    """All steps: density, clusters, baselines, index and tiers. `places` has id, name, pop, x, y, zone_no."""
    dense = cut(place_density(places, zones))
    grouped = cut(cluster_primary(place_clusters(dense, params.dual_km), params))
    reference = reference_places(grouped)
    indexed = mass_index(grouped, median_density(reference))
    indexed = indexed.join(F.broadcast(base_distance(grouped, reference)))  # one row
    return allocate_tiers(indexed, params)


def eligibility_conflicts(tiers: DataFrame) -> DataFrame:
    """Places that got a lower tier than their population allows."""
    return tiers.filter((F.col("role") != "Secondary") & (F.col("init_level") < F.col("type_no")))


def dominated_by_smaller(tiers: DataFrame) -> DataFrame:
    """Places at least three times as populous as the place that blocked them."""
    return tiers.filter(
        (F.col("in_catchment_of") != "-") & (F.col("blocker_pop") > 0) & (F.col("pop") >= F.col("blocker_pop") * DOMINANCE)
    )


def zones_with_tier(zones: DataFrame, tiers: DataFrame, size: float) -> DataFrame:
    """Every zone with name, coordinate and tier of its first place, and the summed population of its parts.

    `zones` has part_id, zone_no, pop and a box; several parts may share a number. The part order prefers parts
    with a coordinate, then population.
    """
    boxes = zones.select("part_id", "xmin", "xmax", "ymin", "ymax")
    hit = join_within(tiers.select("id", "name", "x", "y", "type_no"), boxes, size, "part_id")
    first = keep_first(hit.select("part_id", "id", "name", "x", "y", "type_no"), ["part_id"], [F.col("id")])
    joined = zones.join(first.drop("id"), "part_id", "left")
    order = F.struct(F.when(F.col("x").isNotNull(), 0).otherwise(1).alias("a"), (-F.col("pop")).alias("b"), F.col("part_id").alias("c"))
    return joined.groupBy("zone_no").agg(
        F.min_by(F.struct("name", "x", "y", "type_no"), order).alias("_first"), F.sum("pop").alias("pop")
    ).select("zone_no", "_first.*", "pop")
