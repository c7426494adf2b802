"""Zone grids: nested and circular generation, selections, subdivision, outlines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geom import box_overlap, segment_hits_box
from ..functions.maths import bucket
from ..session import cut
from .common import keep_first

# Area modes and how finely a cell of each is divided.
AREA_MODES = ("PA", "IA1", "IA2")
DIVISIONS = {"PA": 9, "IA1": 3, "IA2": 1}


def cells_along_path(cells: DataFrame, segments: DataFrame, size: float) -> DataFrame:
    """Pairs of segments (x1, y1, x2, y2) and the cells of a regular grid they touch.

    A segment's columns and, inside each, the rows it passes follow by arithmetic, so only cells near the segment
    meet it, not its whole extent.
    """
    lo, hi = F.least("x1", "x2"), F.greatest("x1", "x2")
    first = lambda c: F.ceil(c / size) - 1
    last = lambda c: F.floor(c / size)
    columns = segments.withColumn("bx", F.explode(F.sequence(first(lo), last(hi))))
    dx = F.col("x2") - F.col("x1")
    at = lambda edge: F.col("y1") + (F.col("y2") - F.col("y1")) * F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), F.try_divide(edge - F.col("x1"), dx))
    )
    ya = F.when(dx == 0, F.col("y1")).otherwise(at(F.col("bx") * size))
    yb = F.when(dx == 0, F.col("y2")).otherwise(at((F.col("bx") + 1) * size))
    # A hair of slack absorbs rounding; the exact test follows.
    slack = size * 1e-9
    rows = F.sequence(first(F.least(ya, yb) - slack), last(F.greatest(ya, yb) + slack))
    touched = columns.withColumn("by", F.explode(rows))
    keyed = cells.withColumns(
        {"bx": bucket((F.col("xmin") + F.col("xmax")) / 2, size), "by": bucket((F.col("ymin") + F.col("ymax")) / 2, size)}
    )
    # Written, so that a grid of few cells goes to the segments, however many rows it was made from.
    pairs = touched.join(cut(keyed), ["bx", "by"])
    hit = segment_hits_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "xmin", "xmax", "ymin", "ymax")])
    return pairs.filter(hit).drop("bx", "by")


#: Segments whose distinct cells one task counts.
COUNTED = 200_000


def count_cells_along(cells: DataFrame, segments: DataFrame, size: float, by: str, counted: int = COUNTED) -> DataFrame:
    """Per path (`by`) of segments the number of distinct cells it touches, `cells`, and the `total` of the cell numbers over its segments.

    A segment becomes a row per cell only in the task that counts its path's cells, and there are tasks enough that none counts many more than `counted` segments'.
    """
    known = cut(segments.select(by, "x1", "y1", "x2", "y2"))
    tasks = max(math.ceil(known.count() / counted), 1)
    touched = cells_along_path(cells, known.repartition(tasks, by), size)
    return touched.groupBy(by).agg(F.count_distinct("cell_id").alias("cells"), F.sum("cell_id").alias("total"))


def dissolve_edges(cells: DataFrame, by: list[str]) -> DataFrame:
    """Outline of a union of grid cells (ix, iy) as directed unit edges, counter-clockwise around the area.

    An edge whose reverse belongs to another cell of the same group is inside; only the rest is outline.
    """
    ring = F.array(
        *[
            F.struct((F.col("ix") + a).alias("x1"), (F.col("iy") + b).alias("y1"), (F.col("ix") + c).alias("x2"), (F.col("iy") + d).alias("y2"))
            for a, b, c, d in ((0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0))
        ]
    )
    edges = cells.select(*by, "ix", "iy").distinct().select(*by, F.explode(ring).alias("e")).select(*by, "e.*")
    # Both directions of a shared edge fall on one key; a count of one means outline.
    p = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    q = F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    keyed = edges.withColumns(
        {"_a": F.least(p, q), "_b": F.greatest(p, q)}
    )
    alone = keyed.groupBy(*by, "_a", "_b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("x1", "y1", "x2", "y2")).alias("e"))
    return alone.filter("n = 1").select(*by, "e.*")


def apply_selection(actions: DataFrame, valid: DataFrame | None = None, toggle: bool = False) -> DataFrame:
    """(cell_id, mode): the selection left by a sequence of actions (seq, cell_id, mode), at most one mode per cell.

    Assigning replaces the mode, so the last action counts. Toggling the mode a cell already has clears it: within
    the last run of equal modes the parity of the run decides. Both are aggregates per cell (the run starts after the
    last action with another mode) and written, so that the actions of one busy cell can be split. Cells not in `valid`
    are dropped.
    """
    if valid is not None:
        actions = actions.join(valid.select("cell_id"), "cell_id", "left_semi")
    last = actions.groupBy("cell_id").agg(F.max_by("mode", "seq").alias("mode"))
    if not toggle:
        return last
    last = cut(last)
    per_mode = actions.groupBy("cell_id", "mode").agg(F.max("seq").alias("_last"))
    other = per_mode.join(last.withColumnRenamed("mode", "_final"), "cell_id").filter("mode <> _final")
    start = cut(other.groupBy("cell_id").agg(F.max("_last").alias("_start")))
    run = actions.join(last, ["cell_id", "mode"], "left_semi").join(start, "cell_id", "left")
    counted = run.filter(F.col("_start").isNull() | (F.col("seq") > F.col("_start"))).groupBy("cell_id", "mode").agg(F.count(F.lit(1)).alias("_n"))
    return counted.filter(F.col("_n") % 2 == 1).select("cell_id", "mode")


def selection_counts(selection: DataFrame) -> DataFrame:
    return selection.groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def overlapping_selection(selection: DataFrame) -> DataFrame:
    """Cells selected in more than one mode (empty when the selection is exclusive)."""
    return selection.groupBy("cell_id").agg(F.count_distinct("mode").alias("modes")).filter("modes > 1")


def selection_is_exclusive(selection: DataFrame) -> bool:
    return overlapping_selection(selection).isEmpty()


def transfer_selection(old: DataFrame, new: DataFrame, size: float) -> DataFrame:
    """(id, area_type) on a new grid from an old one with id, rel_x, rel_y, box and area_type.

    Cells with the same position relative to their grid's centre correspond. Only if no cell corresponds does the
    position in space decide: the old cell around the new cell's centre, else the one sharing the largest area.
    """
    chosen = old.filter("area_type IS NOT NULL")
    keyed = chosen.filter("rel_x IS NOT NULL AND rel_y IS NOT NULL").select("rel_x", "rel_y", "area_type", F.col("id").alias("_o"))
    keyed = keep_first(keyed, ["rel_x", "rel_y"], [F.col("_o")]).drop("_o")
    matched = new.drop("area_type").join(keyed, ["rel_x", "rel_y"]).select("id", "area_type")
    if not matched.isEmpty():
        return matched
    from .spatial import join_intersects, pair_overlap

    left = new.select("id", "xmin", "xmax", "ymin", "ymax")
    pairs = join_intersects(left, chosen.select("id", "area_type", "xmin", "xmax", "ymin", "ymax"), size)
    cx, cy = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    holds = (cx > F.col("rxmin")) & (cx < F.col("rxmax")) & (cy > F.col("rymin")) & (cy < F.col("rymax"))
    scored = pairs.withColumns({"_area": pair_overlap(), "_in": F.when(holds, 0).otherwise(1)}).filter("_area > 0")
    best = scored.groupBy("id").agg(F.min_by("rarea_type", F.struct("_in", F.when(F.col("_in") == 1, -F.col("_area")), "rid")).alias("area_type"))
    return best


def circular_grid(centers: DataFrame, cell: float, radius: float) -> DataFrame:
    """Cells whose centre lies within `radius` of a grid centre (cx, cy per `grid`), numbered column by column from 0."""
    half = math.ceil(radius / cell)
    steps = F.sequence(F.lit(-half), F.lit(half))
    cells = centers.withColumn("rel_x", F.explode(steps)).withColumn("rel_y", F.explode(steps))
    reach = F.hypot(F.col("rel_x") * F.lit(float(cell)), F.col("rel_y") * F.lit(float(cell)))
    inside = cells.filter(reach <= radius)
    order = Window.partitionBy("grid").orderBy("rel_x", "rel_y")  # at most (2 * half + 1)^2 cells per grid
    return inside.select(
        "grid", (F.row_number().over(order) - 1).alias("id"), "rel_x", "rel_y",
        (F.col("cx") + (F.col("rel_x") - 0.5) * cell).alias("xmin"), (F.col("cx") + (F.col("rel_x") + 0.5) * cell).alias("xmax"),
        (F.col("cy") + (F.col("rel_y") - 0.5) * cell).alias("ymin"), (F.col("cy") + (F.col("rel_y") + 0.5) * cell).alias("ymax"),
    )


def estimate_cell_count(cell: float, radius_km: float) -> float:
    return math.pi * (float(radius_km) * 1000 / int(cell)) ** 2


def subdivide(cells: DataFrame, mode: str = "area_type") -> DataFrame:
    """Sub-cells of selected cells: 9 x 9, 3 x 3 or the cell itself, by mode; unselected cells give none."""
    n = F
    for name, parts in DIVISIONS.items():
        n = n.when(F.col(mode) == name, F.lit(parts))
    parts = cells.withColumn("_n", n.otherwise(F.lit(0))).filter("_n > 0")
    steps = F.sequence(F.lit(0), F.col("_n") - 1)
    parts = parts.withColumn("sub_x", F.explode(steps)).withColumn("sub_y", F.explode(steps))
    w = (F.col("xmax") - F.col("xmin")) / F.col("_n")
    h = (F.col("ymax") - F.col("ymin")) / F.col("_n")
    rest = [c for c in cells.columns if c not in ("xmin", "xmax", "ymin", "ymax")]
    return parts.select(
        *rest, "sub_x", "sub_y",
        (F.col("xmin") + F.col("sub_x") * w).alias("xmin"), (F.col("xmin") + (F.col("sub_x") + 1) * w).alias("xmax"),
        (F.col("ymin") + F.col("sub_y") * h).alias("ymin"), (F.col("ymin") + (F.col("sub_y") + 1) * h).alias("ymax"),
    )


def cells_per_side(radius_km: float, cell: float) -> int:
    """Cells per side of the nested grid: enough for the diameter, made odd."""
    count = math.ceil(radius_km * 1000 * 2 / cell)
    count += 1 if count % 2 == 0 else 0
    if count > 99:
        raise ValueError("more than 99 cells per side do not fit the two-digit numbering")
    return count


def nested_grid(centers: DataFrame, radius_km: float, cell: float) -> DataFrame:
    """The finest cells (E2) of a nested grid with the numbers and names of all three levels.

    Rows and columns count from the top left corner. The child number inside a parent runs column by column from the
    top left, 1 to 9. `centers` has cx and cy (one row per grid).
    """
    n = cells_per_side(radius_km, cell)
    fine = F.sequence(F.lit(0), F.lit(9 * n - 1))
    half = n * cell / 2
    e2 = centers.withColumn("c", F.explode(fine)).withColumn("r", F.explode(fine))
    e2 = e2.withColumns(
        {
            "row0": F.floor(F.col("r") / 9) + 1, "col0": F.floor(F.col("c") / 9) + 1,
            "k1": (F.floor(F.col("c") / 3) % 3) * 3 + F.floor(F.col("r") / 3) % 3 + 1,
            "k2": (F.col("c") % 3) * 3 + F.col("r") % 3 + 1,
        }
    )
    e0 = F.lit(1000000) + F.col("row0") * 10000 + F.col("col0") * 100
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    stem = F.concat(F.lit("RC_Z"), two("row0"), F.lit("_S"), two("col0"), F.lit("_"))
    k1, k2 = F.col("k1").cast("string"), F.col("k2").cast("string")
    step = cell / 9
    return e2.select(
        *[c for c in centers.columns if c not in ("cx", "cy")],
        (e0 + 10 * F.col("k1") + F.col("k2")).alias("NO"), F.concat(stem, k1, F.lit("_"), k2).alias("NAME"),
        (e0 + 10 * F.col("k1")).alias("NO_E1"), F.concat(stem, k1, F.lit("_0")).alias("NAME_E1"),
        e0.alias("NO_E0"), F.concat(stem, F.lit("0_0")).alias("NAME_E0"), e0.alias("MAINZONENO"), F.lit(9).alias("TYPENO"),
        (F.col("cx") - half + F.col("c") * step).alias("xmin"), (F.col("cx") - half + (F.col("c") + 1) * step).alias("xmax"),
        (F.col("cy") + half - (F.col("r") + 1) * step).alias("ymin"), (F.col("cy") + half - F.col("r") * step).alias("ymax"),
    )


def grid_level(e2: DataFrame, level: int) -> DataFrame:
    """One level of the grid rolled up from its finest cells, with extents and population sums if there is a POP."""
    keys = {0: ["NO_E0", "NAME_E0"], 1: ["NO_E1", "NAME_E1"], 2: ["NO", "NAME"]}[level]
    sums = [F.sum("POP").alias("POP")] if "POP" in e2.columns else []
    out = e2.groupBy(*keys).agg(
        F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"),
        F.first("MAINZONENO").alias("MAINZONENO"), F.first("TYPENO").alias("TYPENO"), *sums,
    )
    return out.withColumnsRenamed({keys[0]: "NO", keys[1]: "NAME"})


def ordinal_in_group(df: DataFrame, group: str, order: str, name: str = "k") -> DataFrame:
    """1-based position inside a bounded group (the children of a cell)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order)))


def locate_cells(points: DataFrame, centers_cell: float, radius_km: float, cx: Column, cy: Column) -> DataFrame:
    """Numbers NO, NO_E1 and NO_E0 of the nested grid around (cx, cy) for points, by arithmetic; points outside are dropped."""
    n = cells_per_side(radius_km, centers_cell)
    step = centers_cell / 9
    c = F.floor((F.col("x") - (cx - n * centers_cell / 2)) / step)
    r = F.floor(((cy + n * centers_cell / 2) - F.col("y")) / step)
    located = points.withColumns({"_c": c, "_r": r}).filter(F.col("_c").between(0, 9 * n - 1) & F.col("_r").between(0, 9 * n - 1))
    e0 = F.lit(1000000) + (F.floor(F.col("_r") / 9) + 1) * 10000 + (F.floor(F.col("_c") / 9) + 1) * 100
    k1 = (F.floor(F.col("_c") / 3) % 3) * 3 + F.floor(F.col("_r") / 3) % 3 + 1
    k2 = (F.col("_c") % 3) * 3 + F.col("_r") % 3 + 1
    return located.withColumns({"NO": e0 + 10 * k1 + k2, "NO_E1": e0 + 10 * k1, "NO_E0": e0}).drop("_c", "_r")


def assign_area_type(cells: DataFrame, selected: DataFrame, size: float) -> DataFrame:
    """Area type of each cell: that of the selected cell whose centre lies in it (smallest id when several do)."""
    from .spatial import join_within

    centres = selected.select(
        "id", "area_type", ((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y")
    )
    placed = join_within(centres, cells.select("NO", "xmin", "xmax", "ymin", "ymax"), size, "NO")
    first = keep_first(placed.select("NO", "id", "area_type"), ["NO"], [F.col("id")]).drop("id")
    return cells.join(first, "NO", "left")


def tier_layer(e2: DataFrame, types: DataFrame) -> DataFrame:
    """The zone layer of a study: E2 cells in PA, E1 in IA1, E0 in IA2, by the area type of their E0 cell.

    `types` has NO_E0 and area_type. At least one PA cell must be selected.
    """
    if types.filter("area_type = 'PA'").isEmpty():
        raise ValueError("a study needs at least one PA cell")
    typed = e2.join(types.select("NO_E0", "area_type"), "NO_E0")
    layers = []
    for mode, level in (("PA", 2), ("IA1", 1), ("IA2", 0)):
        layers.append(grid_level(typed.filter(F.col("area_type") == mode), level).withColumn("area_type", F.lit(mode)))
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out


def main_zones(e2: DataFrame, types: DataFrame) -> DataFrame:
    """The main zones of a study: all selected E0 cells, whatever their area type. `types` has NO_E0 and area_type."""
    chosen = types.filter("area_type IS NOT NULL").select("NO_E0", "area_type")
    return grid_level(e2.join(chosen.select("NO_E0"), "NO_E0", "left_semi"), 0).join(chosen.withColumnRenamed("NO_E0", "NO"), "NO")
