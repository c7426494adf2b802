"""Raster operations on sparse pixel tables (col, row_no, value); an absent row is a pixel without data.

Pixel (col, row_no) covers [col, col + 1) x [row_no, row_no + 1) times the cell size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geom import dist_euclid
from ..functions.maths import bucket
from ..session import cut

KEY = ["col", "row_no"]


def pixels_to_points(px: DataFrame, cell: float) -> DataFrame:
    return px.withColumns({"x": (F.col("col") + 0.5) * cell, "y": (F.col("row_no") + 0.5) * cell})


def pixels_to_boxes(px: DataFrame, cell: float) -> DataFrame:
    return px.withColumns(
        {
            "xmin": F.col("col") * cell, "xmax": (F.col("col") + 1) * cell,
            "ymin": F.col("row_no") * cell, "ymax": (F.col("row_no") + 1) * cell,
        }
    )


def clip_box(px: DataFrame, cell: float, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Pixels whose centre lies in the window: a range of columns and rows, which file statistics can prune."""
    first = lambda low: math.ceil(low / cell - 0.5)
    last = lambda high: math.ceil(high / cell - 0.5) - 1
    return px.filter(F.col("col").between(first(x0), last(x1)) & F.col("row_no").between(first(y0), last(y1)))


def clip_mask(px: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels present in the mask."""
    return px.join(mask.select(*KEY), KEY, "left_semi")


def drop_mask(px: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels absent from the mask (area difference on cells)."""
    return px.join(mask.select(*KEY), KEY, "left_anti")


def rasterize(boxes: DataFrame, cell: float, value: Column, order: Column, touched: bool = False) -> DataFrame:
    """Burn boxes into pixels: those whose centre is inside, or every touched one. The last box in `order` wins."""
    if touched:
        first = lambda c: F.floor(F.col(c) / cell)
        last = lambda c: F.ceil(F.col(c) / cell) - 1
    else:
        first = lambda c: F.ceil(F.col(c) / cell - 0.5)
        last = lambda c: F.ceil(F.col(c) / cell - 0.5) - 1
    span = lambda low, high: F.when(last(high) >= first(low), F.sequence(first(low), last(high)))
    burnt = boxes.select(value.alias("value"), order.alias("_order"), span("xmin", "xmax").alias("_cols"), span("ymin", "ymax").alias("_rows"))
    # A huge box is dealt out by its columns before they are filled.
    burnt = burnt.select("value", "_order", "_rows", F.explode("_cols").alias("col")).repartition("col")
    burnt = burnt.select("value", "_order", "col", F.explode("_rows").alias("row_no"))
    return burnt.groupBy(*KEY).agg(F.max_by("value", "_order").alias("value"))


def resample_avg(px: DataFrame, factor: int) -> DataFrame:
    """Average over factor x factor fine pixels, absent ones counting as 0 (the covered share for a burn of 1)."""
    return px.groupBy(F.floor(F.col("col") / factor).alias("col"), F.floor(F.col("row_no") / factor).alias("row_no")).agg(
        (F.sum("value") / float(factor * factor)).alias("value")
    )


def mask_population(population: DataFrame, share: DataFrame) -> DataFrame:
    """Population times the uncovered share of each pixel."""
    covered = share.select(*KEY, F.col("value").alias("_share"))
    return population.join(covered, KEY, "left").withColumn(
        "value", F.col("value") * (1.0 - F.coalesce("_share", F.lit(0.0)))
    ).drop("_share")


def rescale_mass(before: DataFrame, after: DataFrame) -> DataFrame:
    """`after` scaled so that its total is that of `before`."""
    total = before.agg(F.sum("value").alias("_before")).join(after.agg(F.sum("value").alias("_after")))
    factor = total.select(F.try_divide(F.col("_before"), F.col("_after")).alias("_factor"))  # one row
    return after.join(F.broadcast(factor)).withColumn("value", F.col("value") * F.col("_factor")).drop("_factor")


def zonal_sum(px: DataFrame, zones: DataFrame, cell: float, key: str, size: float) -> DataFrame:
    """Sum of the pixels whose centre lies in each zone box (0 for zones without pixels).

    Pixels are summed per zone and bucket before the shuffle on the zone.
    """
    from .spatial import join_sum_within

    return join_sum_within(pixels_to_points(px, cell), zones, size, key, "value")


def calibrate(px: DataFrame, districts: DataFrame, cell: float, key: str, reference: str, size: float) -> DataFrame:
    """Scale the pixels of each district to its reference total; 0 where the raster has nothing. Others are unchanged."""
    from .spatial import _box_cells, _spread, with_bucket

    sums = zonal_sum(px, districts, cell, key, size)
    factor = F.when(F.col("value_sum") > 0, F.col(reference) / F.col("value_sum")).otherwise(0.0)
    factors = sums.select("xmin", "xmax", "ymin", "ymax", factor.alias("_factor"))
    points = with_bucket(pixels_to_points(px, cell), size)
    spread = _spread(factors, _box_cells(size))
    hit = (
        (points.bx == spread.bx) & (points.by == spread.by)
        & (F.col("x") >= F.col("xmin")) & (F.col("x") < F.col("xmax")) & (F.col("y") >= F.col("ymin")) & (F.col("y") < F.col("ymax"))
    )
    scaled = points.join(spread, hit, "left")
    return scaled.select("col", "row_no", (F.col("value") * F.coalesce("_factor", F.lit(1.0))).alias("value"))


def mosaic(*rasters: DataFrame) -> DataFrame:
    """Rasters laid over each other; a later one wins where it has data."""
    layers = [r.filter(F.col("value").isNotNull()).withColumn("_order", F.lit(i)) for i, r in enumerate(rasters)]
    merged = layers[0]
    for layer in layers[1:]:
        merged = merged.unionByName(layer)
    return merged.groupBy(*KEY).agg(F.max_by("value", "_order").alias("value"))


def focal_max(px: DataFrame, size: int) -> DataFrame:
    """Maximum over a size x size window for every pixel of the table; NULL values count as no data.

    The window is separable: a pass along the rows and one along the columns touch 2 * size instead of size squared
    copies of a pixel. A pixel with only empty pixels around it stays NULL.
    """
    if size < 1 or size % 2 == 0:
        raise ValueError("the window size must be a positive odd number")
    reach = size // 2
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    data = px.filter(F.col("value").isNotNull())
    along = (
        data.withColumn("_d", F.explode(steps))
        .groupBy((F.col("col") + F.col("_d")).alias("col"), "row_no")
        .agg(F.max("value").alias("value"))
    )
    both = (
        along.withColumn("_d", F.explode(steps))
        .groupBy("col", (F.col("row_no") + F.col("_d")).alias("row_no"))
        .agg(F.max("value").alias("focal"))
    )
    return px.join(both, KEY, "left")


def local_maxima(px: DataFrame, size: int) -> DataFrame:
    """Each value where it is the maximum of its window, else 0."""
    focal = focal_max(px, size)
    return focal.withColumn("value", F.when(F.col("value") == F.col("focal"), F.col("value")).otherwise(0.0)).drop("focal")


def kde(points: DataFrame, cell: float, radius: Column, weight: Column) -> DataFrame:
    """Quartic kernel sums, not normalised: weight * (1 - (d / radius)^2)^2 over the points within their radius.

    Points in the same place with the same radius are added up first; the sums per pixel start before the shuffle. Contributions
    are rounded to ten decimals before they are added, so that a sum does not depend on the order of its parts.
    """
    merged = points.select("x", "y", radius.cast("double").alias("_r"), weight.cast("double").alias("_w")).filter("_r > 0")
    merged = merged.groupBy("x", "y", "_r").agg(F.sum("_w").alias("_w")).filter("_w <> 0")
    span = lambda c: F.sequence(
        F.floor((F.col(c) - F.col("_r")) / cell), F.floor((F.col(c) + F.col("_r")) / cell)
    )
    hit = merged.withColumn("col", F.explode(span("x"))).withColumn("_dx", (F.col("col") + 0.5) * cell - F.col("x"))
    hit = hit.withColumn("row_no", F.explode(span("y"))).withColumn("_dy", (F.col("row_no") + 0.5) * cell - F.col("y"))
    ratio = (F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")) / (F.col("_r") * F.col("_r"))
    hit = hit.withColumn("_q", ratio).filter("_q <= 1")
    part = (F.col("_w") * (1.0 - F.col("_q")) * (1.0 - F.col("_q"))).cast("decimal(28,10)")
    return hit.groupBy(*KEY).agg(F.sum(part).cast("double").alias("value"))


def fill_zero(px: DataFrame, frame: DataFrame) -> DataFrame:
    """All pixels of `frame`, 0 where the raster has no data."""
    return frame.select(*KEY).join(px, KEY, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def frame_of(px: DataFrame) -> DataFrame:
    """Every pixel of the raster's extent: the columns are dealt to the tasks before each makes its rows."""
    ext = px.agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row_no").alias("r0"), F.max("row_no").alias("r1"))
    columns = ext.select(F.explode(F.sequence("c0", "c1")).alias("col"), "r0", "r1").repartition("col")
    return columns.select("col", F.explode(F.sequence("r0", "r1")).alias("row_no"))


def stack(rasters: dict[str, DataFrame]) -> DataFrame:
    """Several rasters as one table with a value column each, 0 where one has no data. One shuffle for all of them."""
    merged = None
    for name, px in rasters.items():
        layer = px.select(*KEY, *[(F.col("value") if n == name else F.lit(None).cast("double")).alias(n) for n in rasters])
        merged = layer if merged is None else merged.unionByName(layer)
    return merged.groupBy(*KEY).agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in rasters])


def sample(points: DataFrame, rasters: DataFrame, cell: float, names: list[str]) -> DataFrame:
    """Values of the stacked rasters at each point, 0 outside their data."""
    at = points.withColumns({"col": bucket(F.col("x"), cell), "row_no": bucket(F.col("y"), cell)})
    found = at.join(rasters.select(*KEY, *names), KEY, "left").drop(*KEY)
    return found.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})


def buffer_sum(points: DataFrame, px: DataFrame, cell: float, radius: float) -> DataFrame:
    """(id, buf_sum): sum of the pixels whose centre is within `radius` of each point.

    Pixels are packed into square tiles about one radius wide (an array per tile, bounded by its area), so a point
    meets nine tile rows instead of every pixel around it. The tiles are written, so that a tile with very many points
    can be split.
    """
    side = max(1, math.ceil(radius / cell))
    tiles = cut(
        px.groupBy(F.floor(F.col("col") / side).alias("tc"), F.floor(F.col("row_no") / side).alias("tr")).agg(
            F.collect_list(F.struct("col", "row_no", "value")).alias("_px")
        )
    )
    width = side * cell
    axis = lambda c: F.sequence(bucket(F.col(c), width) - 1, bucket(F.col(c), width) + 1)
    spread = points.select("id", "x", "y").withColumn("tc", F.explode(axis("x"))).withColumn("tr", F.explode(axis("y")))

    def add(total, p):
        d = dist_euclid(F.col("x"), F.col("y"), (p.col + 0.5) * cell, (p["row_no"] + 0.5) * cell)
        return total + F.when(d <= radius, p.value).otherwise(0.0)

    part = spread.join(tiles, ["tc", "tr"]).select("id", F.aggregate("_px", F.lit(0.0), add).alias("_part"))
    sums = part.groupBy("id").agg(F.sum("_part").alias("buf_sum"))
    return points.join(sums, "id", "left").withColumn("buf_sum", F.coalesce("buf_sum", F.lit(0.0)))
