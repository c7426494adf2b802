"""Ordinals, keep-first, brackets and top shares (F)."""

from pyspark.sql import functions as F

from ...functions.maths import round_half_up
from ...operators import common, grid, network
from . import register, rnd

CHILDREN = "SELECT cell_id, CAST(xmin / 4500 AS BIGINT) % 1000 AS col, CAST(floor(cell_id / 3000) AS BIGINT) * 1000 + CAST(floor(cell_id % 1000 / 3) AS BIGINT) AS parent FROM {cells}"


@register(
    "F01_ordinal_in_group",
    f"SELECT cell_id, parent, CAST(row_number() OVER (PARTITION BY parent ORDER BY cell_id) AS INTEGER) AS k FROM ({CHILDREN}) t",
)
def ordinal(v):
    return grid.ordinal_in_group(v.sql(CHILDREN), "parent", "cell_id").select("cell_id", "parent", "k")


@register(
    "F02_keep_first_by_order",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) t WHERE rn = 1",
)
def keep_first(v):
    df = v.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return common.keep_first(df, ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")])


@register(
    "F03_composite_sort_keys",
    """SELECT id, (2000000 + id % 400) * 100000000 + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END * 100000 - pop AS place_key,
       (10 - coalesce(CASE WHEN id % 3 = 0 THEN id % 5 END, 9)) * 1000 + pop % 25 AS tier_key FROM {places}""",
)
def sort_keys(v):
    from ...operators.zones import place_sort_key, tier_sort_key

    df = v.places.select(
        "id", "pop", (2000000 + F.col("id") % 400).alias("zoneno"), F.expr("CASE WHEN id % 5 <> 0 THEN x END").alias("xcoord"),
        F.expr("CASE WHEN id % 3 = 0 THEN id % 5 END").alias("adm_type"), (F.col("pop") % 25).alias("intensity"),
    )
    return df.select("id", place_sort_key().alias("place_key"), tier_sort_key("adm_type", "intensity").alias("tier_key"))


TYPES = """SELECT DISTINCT p_size AS type_no, p_type AS category, CAST(1 + p_size % 3 AS INTEGER) AS lanes, CAST(20 + p_size * 2 AS DOUBLE) AS v0 FROM {part}"""


@register(
    "F04_speed_brackets",
    f"""SELECT type_no, category, lanes, v0, coalesce((v0 + lead(v0) OVER w) / 2, 0.0) AS lower_bound, coalesce((v0 + lag(v0) OVER w) / 2, 1e18::DOUBLE) AS upper_bound
        FROM ({TYPES}) t WINDOW w AS (PARTITION BY category, lanes ORDER BY v0 DESC, type_no)""",
)
def brackets(v):
    df = network.speed_brackets(v.sql(TYPES))
    return df.select(
        "type_no", "category", "lanes", "v0", "lower_bound",
        F.when(F.col("upper_bound") == float("inf"), 1e18).otherwise(F.col("upper_bound")).alias("upper_bound"),
    )


@register(
    "F05_top_share",
    """SELECT id, pop FROM (SELECT *, row_number() OVER (ORDER BY pop DESC, id) AS rn, count(*) OVER () AS n FROM {places}) t
       WHERE rn <= greatest(2, floor(n * 0.05))""",
)
def top_share(v):
    return common.top_share(v.places.select("id", "pop"), [F.col("pop").desc(), F.col("id")], 0.05, 2)


@register(
    "F06_best_connected_nodes",
    "SELECT to_node AS node, count(*) AS degree FROM {links} GROUP BY to_node ORDER BY degree DESC, node LIMIT 5",
)
def top_degree(v):
    return network.top_degree(v.links, 5, "to_node")


@register(
    "F07_stable_ranking",
    "SELECT id, CAST(row_number() OVER (ORDER BY pop % 100 DESC, id) AS BIGINT) AS position FROM {places}",
)
def ranking(v):
    ranked = common.with_rank(v.places.select("id", (F.col("pop") % 100).alias("score")), [F.col("score").desc(), F.col("id")], "position")
    return ranked.select("id", "position")


@register(
    "C03_keep_group_maximum",
    "SELECT o_orderkey, o_custkey FROM (SELECT *, max(floor(o_totalprice / 1000)) OVER (PARTITION BY o_custkey) AS top FROM {orders}) t WHERE floor(o_totalprice / 1000) = top",
)
def group_max(v):
    df = v.orders.select("o_orderkey", "o_custkey", F.floor(F.col("o_totalprice") / 1000).alias("level"))
    return common.keep_group_max(df, ["o_custkey"], "level").select("o_orderkey", "o_custkey")
