"""Keep-first, ranks, quantiles and other table shapes, written so that no group or table passes through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def keep_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row per group: the smallest by `order` (negate a number for descending).

    An aggregate rather than a window: rows are reduced before the shuffle, so a hot group costs nothing extra.
    """
    rest = [c for c in df.columns if c not in by]
    picked = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*by).agg(picked.alias("_row")).select(*by, "_row.*").select(*df.columns)


def keep_group_max(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows whose value equals their group's maximum (ties kept)."""
    top = df.groupBy(*by).agg(F.max(value).alias(value))
    return df.join(top, [*by, value], "left_semi")


def join_first(left: DataFrame, right: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Left join to the first right row per key."""
    return left.join(keep_first(right, key, order), key, "left")


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in a total order.

    The rows are range-partitioned and sorted once and written with their place in their partition; a position is then the row's
    place in its partition plus the sizes of the partitions before it (one small row per partition).
    """
    at = F.monotonically_increasing_id()
    placed = cut(
        df.orderBy(*order).withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))})
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row per partition of the sorted data, so the broadcast is bounded by the partition count.
    joined = placed.join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")


def exact_quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row with exact linear-interpolated quantiles; `shares` maps output names to shares in 0..1.

    Equal values are counted first and the distinct values ranked by a distributed sort, so that no task has to
    hold the whole column.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = cut(counts.orderBy("v").withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.sum("n").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    starts = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(everything).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy("v")
    ranked = placed.join(F.broadcast(starts), "_part").withColumn("_end", F.col("_start") + F.sum("n").over(inside))
    low = F.col("_end") - F.col("n")
    picks = []
    for name, share in shares.items():
        at = (F.col("_total") - 1) * F.lit(float(share))
        covers = lambda pos: (low <= pos) & (pos < F.col("_end"))
        lower = F.max(F.when(covers(F.floor(at)), F.col("v")))
        upper = F.max(F.when(covers(F.ceil(at)), F.col("v")))
        weight = F.max(at - F.floor(at))
        picks.append((lower + (upper - lower) * weight).alias(name))
    return ranked.agg(*picks)


def top_share(df: DataFrame, order: list[Column], share: float, at_least: int) -> DataFrame:
    """The leading share of a total order, but at least a few rows."""
    ranked = with_rank(df, order, "_rank")
    total = ranked.agg(F.max("_rank").alias("_total"))
    limit = F.greatest(F.lit(at_least), F.floor(F.col("_total") * F.lit(share)))
    return ranked.join(F.broadcast(total)).filter(F.col("_rank") <= limit).drop("_rank", "_total")


def union_layers(layers: dict[str, DataFrame], tag: str = "src") -> DataFrame:
    """Union by column name with missing columns as NULL and the layer's name in `tag`."""
    out = None
    for name, layer in layers.items():
        layer = layer.withColumn(tag, F.lit(name))
        out = layer if out is None else out.unionByName(layer, allowMissingColumns=True)
    return out


def merge_extracts(extracts: list[DataFrame], key: list[str], version: str) -> DataFrame:
    """Newest version of every object over overlapping extracts; a single extract is passed through."""
    if len(extracts) == 1:
        return extracts[0]
    merged = extracts[0]
    for extract in extracts[1:]:
        merged = merged.unionByName(extract)
    return keep_first(merged, key, [-F.col(version), F.to_json(F.struct(*[c for c in merged.columns if c not in key]))])


def merge_first_seen(extracts: list[DataFrame], key: list[str]) -> DataFrame:
    """First occurrence of every object in the order of the extracts."""
    parts = [e.withColumn("_src", F.lit(i)) for i, e in enumerate(extracts)]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    rest = [c for c in merged.columns if c not in key and c != "_src"]
    return keep_first(merged, key, [F.col("_src"), F.to_json(F.struct(*rest))]).drop("_src")


def robust_stats(df: DataFrame, value: str) -> DataFrame:
    """One row: low, middle (exact median), mean and high."""
    simple = df.agg(F.min(value).alias("low"), F.avg(value).alias("mean"), F.max(value).alias("high"))
    return simple.join(F.broadcast(exact_quantiles(df, value, {"middle": 0.5})))  # two one-row tables


def focus_extent(points: DataFrame, low: float = 0.005, high: float = 0.995, margin: float = 0.05) -> DataFrame:
    """One row: the window that holds all but the outermost coordinates, widened by a margin."""
    x = exact_quantiles(points, "x", {"x0": low, "x1": high})
    y = exact_quantiles(points, "y", {"y0": low, "y1": high})
    grow = lambda a, b, sign: F.col(a if sign < 0 else b) + sign * (F.col(b) - F.col(a)) * margin
    return x.join(F.broadcast(y)).select(
        grow("x0", "x1", -1).alias("xmin"), grow("x0", "x1", 1).alias("xmax"), grow("y0", "y1", -1).alias("ymin"), grow("y0", "y1", 1).alias("ymax")
    )
