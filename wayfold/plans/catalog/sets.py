"""Unions and exclusive selections (G)."""

from pyspark.sql import functions as F

from ...operators import common, grid
from . import register


@register(
    "G01_union_layers",
    """SELECT 'grid' AS src, CAST(cell_id AS BIGINT) AS zone_no, xmin, ymin, '-' AS name FROM {cells}
       UNION ALL SELECT 'adm', zone_no, xmin, ymin, '-' FROM {admin_zones} UNION ALL SELECT 'points', id, -1.0, -1.0, name FROM {places}""",
)
def union_layers(v):
    layers = {
        "grid": v.cells.select(F.col("cell_id").alias("zone_no"), "xmin", "ymin"),
        "adm": v.admin_zones.select("zone_no", "xmin", "ymin"),
        "points": v.places.select(F.col("id").alias("zone_no"), "name"),
    }
    merged = common.union_layers(layers)
    return merged.select(
        "src", "zone_no", F.coalesce("xmin", F.lit(-1.0)).alias("xmin"), F.coalesce("ymin", F.lit(-1.0)).alias("ymin"), F.coalesce("name", F.lit("-")).alias("name")
    )


@register("G03_exclusive_selection", "SELECT cell_id, arg_max(mode, seq) AS mode FROM {cell_actions} GROUP BY cell_id")
def exclusive(v):
    return grid.apply_selection(v.cell_actions)


@register(
    "G03_toggled_selection",
    """WITH m AS (SELECT *, CASE WHEN lag(mode) OVER (PARTITION BY cell_id ORDER BY seq) = mode THEN 0 ELSE 1 END AS fresh FROM {cell_actions}),
       r AS (SELECT *, sum(fresh) OVER (PARTITION BY cell_id ORDER BY seq) AS run FROM m),
       c AS (SELECT cell_id, run, min(mode) AS mode, count(*) AS n FROM r GROUP BY cell_id, run)
       SELECT cell_id, mode FROM c WHERE run = (SELECT max(run) FROM c d WHERE d.cell_id = c.cell_id) AND n % 2 = 1""",
)
def toggled(v):
    return grid.apply_selection(v.cell_actions, toggle=True)


@register(
    "G03_selection_of_known_cells",
    """SELECT cell_id, arg_max(mode, seq) AS mode FROM {cell_actions} WHERE cell_id IN (SELECT DISTINCT o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT') GROUP BY cell_id""",
)
def known_cells(v):
    valid = v.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("cell_id")).distinct()
    return grid.apply_selection(v.cell_actions, valid)
