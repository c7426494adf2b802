"""Sectioned text tables (`$NAME:col;col`), zone tables and origin-destination lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.zones import kind_of

# Columns every zone table has; other columns are declared as user attributes.
ZONE_COLUMNS = ("NO", "NAME", "CODE", "TYPENO", "MAINZONENO", "XCOORD", "YCOORD", "WKTSURFACE", "WKTLOC")
MAIN_ZONE_COLUMNS = ("NO", "NAME", "CODE", "XCOORD", "YCOORD", "WKTSURFACE", "WKTLOC")
# Declared type, decimals and text length by kind.
DECLARED = {"whole": ("Int", "0", "0"), "real": ("Double", "0", "4"), "boolean": ("Boolean", "0", "0"), "text": ("Text", "255", "0")}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their position in the file, without passing the file through one task."""
    raw = spark.read.text(path)
    at = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
    )
    return raw.select(at.alias("at"), F.trim(F.regexp_replace("value", "\r$", "")).alias("line"))


def read_section(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One `$TABLE:` block of a semicolon text file, all columns as text.

    The block ends at the first line after its rows that is blank or starts with `$` or `*`.
    """
    head = f"${table}:"
    lines = _lines(spark, path)
    begin = lines.filter(F.col("line").startswith(head)).agg(F.min(F.struct("at", "line")).alias("h")).first().h
    if begin is None:
        raise ValueError(f"no section {table} in {path}")
    ends = F.col("line").rlike(r"^([$*].*)?$")
    place = lambda at: F.struct(F.lit(at.file).alias("file"), F.lit(at.block).alias("block"), F.lit(at.id).alias("id"))
    after = lines.filter((F.col("at") > place(begin["at"])) & (F.col("at.file") == begin["at"].file))
    first = after.filter(~ends).agg(F.min("at").alias("a")).first().a
    names = [n.strip() for n in begin.line[len(head):].split(";")]
    if first is None:
        return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))
    stop = after.filter((F.col("at") > place(first)) & ends).agg(F.min("at").alias("a")).first().a
    rows = after.filter(F.col("at") >= place(first))
    if stop is not None:
        rows = rows.filter(F.col("at") < place(stop))
    cells = F.split("line", ";")
    return rows.select(*[F.trim(F.get(cells, F.lit(i))).alias(n) for i, n in enumerate(names)])


def read_link_types(spark: SparkSession, path: str) -> DataFrame:
    """Link types: number (0 when unreadable), name, lanes (1) and speed (30)."""
    rows = read_section(spark, path, "LINKTYPE")
    number = lambda c: F.col(c).try_cast("double")
    return rows.select(
        F.coalesce(number("NO"), F.lit(0.0)).cast("int").alias("type_no"), F.col("NAME").alias("name"),
        F.coalesce(number("NUMLANES"), F.lit(1.0)).cast("int").alias("lanes"), F.coalesce(number("V0PRT"), F.lit(30.0)).alias("v0"),
    )


def attribute_definitions(df: DataFrame, table: str, standard: tuple[str, ...] = ZONE_COLUMNS) -> DataFrame:
    """Declarations of the columns that are not standard: table, attribute, type, text length, decimals, comment."""
    rows = []
    for name, dtype in df.dtypes:
        if name not in standard:
            declared, length, digits = DECLARED[kind_of(name, dtype)]
            rows.append((table, name, declared, length, digits, f"Custom attribute: {name}"))
    return df.sparkSession.createDataFrame(rows, "objid string, attid string, valuetype string, maxlength string, decimals string, comment string")


def write_zone_tables(zones: DataFrame, path: str, main_zones: DataFrame | None = None) -> None:
    """Zones (and main zones) as semicolon files with a file of attribute declarations; shapes are left out."""
    definitions = attribute_definitions(zones, "ZONE")
    if main_zones is not None:
        definitions = attribute_definitions(main_zones, "MAINZONE", MAIN_ZONE_COLUMNS).unionByName(definitions)
        main_zones.drop("WKTSURFACE").write.csv(f"{path}/mainzone", sep=";", header=True, emptyValue="")
    definitions.write.csv(f"{path}/attributes", sep=";", header=True)
    zones.drop("WKTSURFACE").write.csv(f"{path}/zone", sep=";", header=True, emptyValue="")


def write_od_matrix(edges: DataFrame, path: str) -> None:
    """Non-zero cells as `origin destination value` lines, one folder per level."""
    cells = edges.filter("value <> 0").select("level", F.concat_ws(" ", "o", "d", "value").alias("line"))
    cells.write.partitionBy("level").text(path)


def read_od_matrix(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", " ")
    return spark.read.text(path).select(
        F.col("level").cast("int").alias("level"), parts[0].cast("long").alias("o"), parts[1].cast("long").alias("d"), parts[2].cast("double").alias("value")
    )
