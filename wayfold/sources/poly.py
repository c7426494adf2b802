"""Boundary files: a name line, then rings (number, `!` for holes, coordinates, END), then END."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geom import shoelace


def file_name(df: DataFrame, naming: str, layer: str, field: str | None = None, template: str | None = None) -> Column:
    """Name of a shape's file by one of three rules: layer and id, a field's value, or a template; unsafe characters become `_`.

    A template may hold {id}, {layername} and the names of columns in braces.
    """
    plain = layer.replace(" ", "")
    ident = F.col("id").cast("string")
    if naming == "layer":
        name = F.concat(F.lit(f"{plain}_fid_"), ident)
    elif naming == "field":
        if not field:
            raise ValueError("naming by field needs a field")
        value = F.col(field).cast("string")
        name = F.when(F.coalesce(value, F.lit("")).isin("", "NULL"), F.concat(F.lit("feature_"), ident)).otherwise(value)
    elif naming == "template":
        if not template:
            raise ValueError("naming by template needs a template")
        name = F.replace(F.lit(template), F.lit("{id}"), ident)
        name = F.replace(name, F.lit("{layername}"), F.lit(plain))
        for column in df.columns:
            if "{" + column + "}" in template:
                value = F.coalesce(F.col(column).cast("string"), F.lit(""))
                name = F.replace(name, F.lit("{" + column + "}"), F.when(value == "NULL", "").otherwise(value))
    else:
        raise ValueError(f"unknown naming rule {naming}")
    return F.regexp_replace(name, r'[\\/*?:"<>|]', "_")


def poly_text(df: DataFrame, name: Column) -> DataFrame:
    """(name, text) per shape; `parts` is an array of polygons, each an array of rings of (x, y), the first one outer.

    Rings of fewer than three vertices are skipped, and shapes without any ring are left out.
    """
    number = lambda v: F.format_string("%.6f", v)

    def ring_lines(i: Column, ring: Column, j: Column) -> Column:
        head = F.concat(F.when(j > 0, "!").otherwise(""), (i + 1).cast("string"))
        body = F.transform(ring, lambda p: F.concat(F.lit("   "), number(p.x), F.lit("   "), number(p.y)))
        return F.when(F.size(ring) >= 3, F.array_join(F.concat(F.array(head), body, F.array(F.lit("END"))), "\n"))

    rings = F.flatten(F.transform("parts", lambda polygon, i: F.transform(polygon, lambda ring, j: ring_lines(i, ring, j))))
    kept = df.select(name.alias("name"), F.filter(rings, lambda r: r.isNotNull()).alias("_rings")).filter(F.size("_rings") > 0)
    return kept.select("name", F.concat_ws("\n", F.col("name"), F.array_join("_rings", "\n"), F.lit("END")).alias("text"))


def write_poly(df: DataFrame, name: Column, path: str) -> None:
    """One folder per shape with its boundary text."""
    poly_text(df, name).select("name", F.col("text").alias("value")).write.partitionBy("name").text(path)


def parse_poly(texts: DataFrame) -> DataFrame:
    """(name, ring_no, part, hole, ring) from (name, text); rings of fewer than three vertices are dropped."""
    body = F.regexp_replace("text", r"^[^\n]*\n", "")
    chunks = F.filter(F.split(body, r"(?m)^\s*END\s*$"), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")) != "")
    exploded = texts.select("name", F.posexplode(chunks).alias("ring_no", "chunk"))
    lines = F.filter(F.split("chunk", r"\n"), lambda s: F.trim(s) != "")
    exploded = exploded.withColumn("_lines", lines).withColumn("_head", F.trim(F.get("_lines", F.lit(0))))
    words = lambda s: F.split(F.trim(s), r"\s+")
    point = lambda s: F.struct(
        F.get(words(s), F.lit(0)).try_cast("double").alias("x"), F.get(words(s), F.lit(1)).try_cast("double").alias("y")
    )
    ring = F.filter(F.transform(F.slice("_lines", F.lit(2), F.size("_lines")), point), lambda p: p.x.isNotNull() & p.y.isNotNull())
    out = exploded.select(
        "name", "ring_no", F.regexp_replace("_head", "!", "").alias("part"), F.col("_head").startswith("!").alias("hole"), ring.alias("ring")
    )
    return out.filter(F.size("ring") >= 3)


def read_poly(spark: SparkSession, path: str) -> DataFrame:
    """Rings of all boundary files below a folder written by `write_poly`."""
    texts = spark.read.text(path, wholetext=True).select("name", F.col("value").alias("text"))
    return parse_poly(texts)


def poly_area(rings: DataFrame) -> DataFrame:
    """(name, area): outer rings minus holes."""
    signed = F.abs(shoelace(F.col("ring"))) * F.when(F.col("hole"), -1.0).otherwise(1.0)
    return rings.groupBy("name").agg(F.sum(signed).alias("area"))


def matches_selection(saved: DataFrame, selected: DataFrame) -> DataFrame:
    """(name, valid): the saved outline covers the selected area within a hundred-thousandth (at least 1e-7)."""
    both = selected.select("name", F.col("area").alias("_want")).join(poly_area(saved), "name", "left")
    near = F.abs(F.coalesce("area", F.lit(0.0)) - F.col("_want")) <= F.greatest(F.lit(1e-7), F.col("_want") * 1e-5)
    return both.select("name", near.alias("valid"))


def outline_or_fallback(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """The inner outline's rings, or the outer one's when the inner has none; an error when neither has any."""
    if not inner.isEmpty():
        return inner
    if outer.isEmpty():
        raise ValueError("the boundary files hold no rings")
    return outer
