"""Central places (K)."""

from pyspark.sql import functions as F

from ...functions.maths import round_half_up
from ...operators import places as ops
from ...operators import spatial
from . import register, rnd

IN_ZONE = "p.x >= z.xmin AND p.x < z.xmax AND p.y >= z.ymin AND p.y < z.ymax"
# Populations of the size the tiers are made for.
BIG = f"SELECT p.id, p.name, p.pop * 3 AS pop, p.x, p.y, z.zone_no FROM {{places}} p JOIN {{admin_zones}} z ON {IN_ZONE}"


def big_places(v):
    placed = spatial.join_within(v.places, v.admin_zones, 15001.0, "zone_no")
    return placed.select("id", "name", (F.col("pop") * 3).alias("pop"), "x", "y", "zone_no")


DENSE = f"""SELECT b.*, b.pop / greatest((z.xmax - z.xmin) * (z.ymax - z.ymin) / 1e6, 0.001) AS density FROM ({BIG}) b
    JOIN {{admin_zones}} z ON z.zone_no = b.zone_no"""


@register("K02_place_density", f"SELECT id, {rnd('density', 6)} AS density FROM ({DENSE}) d")
def density(v):
    return ops.place_density(big_places(v), v.admin_zones).select("id", round_half_up(F.col("density"), 6).alias("density"))


# Transitive closure over the 5 km pairs, then the smallest reached id.
COMP = """pairs AS (SELECT a.id AS a, b.id AS b FROM {places} a JOIN {places} b ON a.id <> b.id AND b.x BETWEEN a.x - 5000 AND a.x + 5000
        AND b.y BETWEEN a.y - 5000 AND a.y + 5000 AND sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) < 5000),
      reach(id, other) AS (SELECT id, id FROM {places} UNION SELECT r.id, p.b FROM reach r JOIN pairs p ON p.a = r.other),
      comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""


@register("K03_place_clusters", f"WITH RECURSIVE {COMP} SELECT id, component FROM comp")
def clusters(v):
    return ops.place_clusters(v.places.select("id", "x", "y"), 5.0).select("id", "component")


CLUSTERED = f"""{COMP}, d AS (SELECT d.*, c.component FROM ({DENSE}) d JOIN comp c ON c.id = d.id),
      t AS (SELECT component, sum(pop) AS cluster_pop, count(*) AS members FROM d GROUP BY component HAVING count(*) > 1),
      m AS (SELECT d.*, t.cluster_pop, t.members, d.pop >= t.cluster_pop * 0.15 AS enough FROM d JOIN t ON t.component = d.component),
      pr AS (SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY component ORDER BY CASE WHEN enough THEN 0 ELSE 1 END, density DESC, pop DESC, id) AS rn FROM m) x WHERE rn = 1),
      de AS (SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY component ORDER BY density DESC, pop DESC, id) AS rn FROM m) x WHERE rn = 1),
      g AS (SELECT d.*, CASE WHEN pr.id IS NULL THEN 'None' WHEN pr.id = d.id THEN 'Primary' ELSE 'Secondary' END AS role, pr.name AS primary_name,
        CASE WHEN pr.id IS NULL THEN 0 WHEN pr.id = d.id THEN pr.members - 1 ELSE 1 END AS partners,
        CASE WHEN pr.id = d.id THEN CAST(pr.cluster_pop AS DOUBLE) ELSE CAST(d.pop AS DOUBLE) END AS eff_pop FROM d LEFT JOIN pr ON pr.component = d.component)"""


def grouped(v):
    dense = ops.place_density(big_places(v), v.admin_zones)
    return ops.cluster_primary(ops.place_clusters(dense, 5.0))


@register(
    "K04_cluster_primary",
    f"WITH RECURSIVE {CLUSTERED} SELECT id, role, coalesce(primary_name, '-') AS primary_name, CAST(partners AS BIGINT) AS partners, eff_pop FROM g",
)
def cluster_primary(v):
    return grouped(v).select("id", "role", F.coalesce("primary_name", F.lit("-")).alias("primary_name"), F.col("partners").cast("long").alias("partners"), "eff_pop")


@register(
    "K04_cluster_partners",
    f"""WITH RECURSIVE {CLUSTERED} SELECT pr.id, g.id AS partner, g.name AS partner_name FROM g JOIN pr ON pr.component = g.component AND pr.id <> g.id
        UNION ALL SELECT g.id, pr.id, pr.name FROM g JOIN pr ON pr.component = g.component AND pr.id <> g.id""",
)
def cluster_partners(v):
    dense = ops.place_density(big_places(v), v.admin_zones)
    return ops.cluster_partners(ops.place_clusters(dense, 5.0))


@register(
    "K04_replaced_primaries",
    f"""WITH RECURSIVE {CLUSTERED.replace('* 0.15', '* 0.45').replace('(z.xmax - z.xmin)', '(z.xmax - z.xmin) * (1 + z.zone_no % 7)')} SELECT de.component, de.name AS rejected, de.pop, CAST(de.cluster_pop AS DOUBLE) AS cluster_pop,
        {rnd('CASE WHEN de.cluster_pop > 0 THEN de.pop / de.cluster_pop * 100.0 ELSE 0 END', 6)} AS share, pr.name AS replaced_by
        FROM de JOIN pr ON pr.component = de.component WHERE pr.id <> de.id""",
)
def replaced(v):
    uneven = v.admin_zones.withColumn("xmax", F.col("xmin") + (F.col("xmax") - F.col("xmin")) * (1 + F.col("zone_no") % 7))
    dense = ops.place_density(big_places(v), uneven)
    out = ops.replaced_primaries(ops.place_clusters(dense, 5.0), ops.TierParams(dual_min_share=45))
    return out.withColumn("share", round_half_up(F.col("share"), 6))


BASED = f"""{CLUSTERED}, ref AS (SELECT * FROM g WHERE role <> 'Secondary' AND zone_no > 2000000 AND zone_no < 3000000),
      top AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY eff_pop DESC, id) AS rn, count(*) OVER () AS n FROM ref) x WHERE rn <= greatest(2, floor(n * 0.05))),
      base AS (SELECT coalesce(median(km), 50.0) AS base_km FROM (SELECT a.id, min(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))) / 1000.0 AS km
        FROM top a JOIN top b ON a.id <> b.id GROUP BY a.id) k),
      med AS (SELECT coalesce(median(density), 1.0) AS median_density FROM ref)"""


@register("K05_base_distance", f"WITH RECURSIVE {BASED} SELECT {rnd('base_km', 6)} AS base_km FROM base")
def base_distance(v):
    from ...session import cut

    return ops.base_distance(cut(grouped(v))).select(round_half_up(F.col("base_km"), 6).alias("base_km"))


TIER = """CASE WHEN role = 'Secondary' THEN 4 WHEN eff_pop >= 500000 * f THEN 0 WHEN eff_pop >= 200000 * f THEN 1 WHEN eff_pop >= 100000 * f THEN 2 ELSE 3 END"""


@register(
    "K06_eligible_tier",
    f"""WITH RECURSIVE {CLUSTERED} SELECT id, {TIER} AS tier FROM (SELECT *, CASE WHEN role = 'Primary' THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END AS f FROM g) x""",
)
def eligible(v):
    return grouped(v).select("id", ops.eligible_tier().alias("tier"))


@register(
    "K07_centrality_mass_index",
    f"""WITH RECURSIVE {BASED}, c AS (SELECT g.id, density / median_density AS rel, eff_pop * (density / median_density) AS cmi FROM g, med)
        SELECT id, {rnd('rel', 6)} AS rel_density, {rnd('cmi', 3)} AS cmi, row_number() OVER (ORDER BY cmi DESC, id) AS position FROM c""",
)
def mass_index(v):
    from ...session import cut

    places = cut(grouped(v))
    indexed = ops.mass_index(places, ops.median_density(ops.reference_places(places)))
    ranked = ops.rank_places(indexed.select("id", "rel_density", "cmi"))
    return ranked.select("id", round_half_up(F.col("rel_density"), 6).alias("rel_density"), round_half_up(F.col("cmi"), 3).alias("cmi"), "position")


@register("K08_tier_allocation")
def tiers(v):
    out = ops.categorise(big_places(v), v.admin_zones)
    return out.select(
        "id", "type_no", "role", "init_level", "in_catchment_of", "catchment_level", "reason", round_half_up(F.col("base_km"), 6).alias("base_km"),
        round_half_up(F.col("cmi"), 3).alias("cmi"),
    )


@register("K09_tier_audit")
def audit(v):
    tiers = ops.categorise(big_places(v), v.admin_zones)
    conflicts = ops.eligibility_conflicts(tiers).select("id", F.lit("downgraded").alias("finding"), "init_level", "type_no", "in_catchment_of")
    dominance = ops.dominated_by_smaller(tiers).select("id", F.lit("larger than its blocker").alias("finding"), "init_level", "type_no", "in_catchment_of")
    return conflicts.unionByName(dominance)


@register(
    "K09_cluster_report",
    f"""WITH RECURSIVE {CLUSTERED} SELECT pr.component, pr.name AS primary_name, pr.members, CAST(pr.cluster_pop AS BIGINT) AS cluster_pop FROM pr""",
)
def cluster_report(v):
    dense = ops.place_density(big_places(v), v.admin_zones)
    summary = ops.cluster_summary(ops.place_clusters(dense, 5.0))
    return summary.select("component", F.col("primary.name").alias("primary_name"), "members", F.col("cluster_pop").cast("long").alias("cluster_pop"))


@register(
    "K01_place_per_zone",
    f"""WITH b AS (SELECT p.id, p.name, p.x, p.y, z.zone_no, (SELECT coalesce(sum(q.value), 0) FROM {{pixels}} q
          WHERE sqrt(((q.col + 0.5) * 500 - p.x) * ((q.col + 0.5) * 500 - p.x) + ((q.row_no + 0.5) * 500 - p.y) * ((q.row_no + 0.5) * 500 - p.y)) <= 4000) AS buf
          FROM {{places}} p JOIN {{admin_zones}} z ON {IN_ZONE}),
        c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone_no ORDER BY {rnd('buf', 6)} DESC, id) AS rn FROM b) t WHERE rn = 1)
        SELECT z.zone_no, coalesce(c.name, 'Fallback_Geometric_Center') AS name, coalesce(c.x, (z.xmin + z.xmax) / 2) AS x, coalesce(c.y, (z.ymin + z.ymax) / 2) AS y,
          {rnd('coalesce(c.buf, 0)', 6)} AS buf_sum FROM {{admin_zones}} z LEFT JOIN c ON c.zone_no = z.zone_no""",
)
def place_per_zone(v):
    zones = v.admin_zones.withColumn("pop", F.lit(0))
    out = ops.place_per_zone(v.places, zones, v.pixels, 500.0, 4000.0, 15001.0)
    return out.select("zone_no", "name", "x", "y", round_half_up(F.col("buf_sum"), 6).alias("buf_sum"))


ZONE_PARTS = """SELECT cell_id AS part_id, CAST(floor(cell_id / 2000) AS BIGINT) AS zone_no, cell_id % 977 AS pop, xmin * 6 AS xmin, xmax * 6 AS xmax, ymin * 6 AS ymin, ymax * 6 AS ymax FROM {cells}"""


@register(
    "K10_zones_with_tier",
    f"""WITH z AS ({ZONE_PARTS}), t AS (SELECT id, name, x, y, CAST(id % 5 AS INTEGER) AS type_no FROM {{places}}),
        h AS (SELECT * FROM (SELECT z.part_id, t.*, row_number() OVER (PARTITION BY z.part_id ORDER BY t.id) AS rn FROM z JOIN t
          ON t.x >= z.xmin AND t.x < z.xmax AND t.y >= z.ymin AND t.y < z.ymax) q WHERE rn = 1),
        j AS (SELECT z.part_id, z.zone_no, z.pop, h.name, h.x, h.y, h.type_no, row_number() OVER (PARTITION BY z.zone_no ORDER BY CASE WHEN h.x IS NULL THEN 1 ELSE 0 END, z.pop DESC, z.part_id) AS o
          FROM z LEFT JOIN h ON h.part_id = z.part_id)
        SELECT zone_no, coalesce(max(CASE WHEN o = 1 THEN name END), '-') AS name, coalesce(max(CASE WHEN o = 1 THEN x END), -1.0) AS x,
          coalesce(max(CASE WHEN o = 1 THEN y END), -1.0) AS y, coalesce(max(CASE WHEN o = 1 THEN type_no END), 9) AS type_no, CAST(sum(pop) AS BIGINT) AS pop FROM j GROUP BY zone_no""",
)
def zones_with_tier(v):
    tiers = v.places.select("id", "name", "x", "y", (F.col("id") % 5).cast("int").alias("type_no"))
    out = ops.zones_with_tier(v.sql(ZONE_PARTS), tiers, 27000.0)
    return out.select(
        "zone_no", F.coalesce("name", F.lit("-")).alias("name"), F.coalesce("x", F.lit(-1.0)).alias("x"), F.coalesce("y", F.lit(-1.0)).alias("y"),
        F.coalesce("type_no", F.lit(9)).alias("type_no"), "pop",
    )
