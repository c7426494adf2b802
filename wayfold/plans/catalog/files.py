"""Text sources and sinks, written below the checkpoint folder and read back (A10-A14)."""

from pyspark.sql import functions as F

from ...functions.geom import box_ring
from ...functions.maths import round_half_up
from ...operators.zones import coerce_zone_schema
from ...session import scratch
from ...sources import poly, tables
from . import register, rnd

TYPE_LINES = """SELECT p_partkey AS k, concat_ws(';', CAST(100 + p_partkey AS VARCHAR(12)), concat(p_type, ' ', CAST(p_size AS VARCHAR(10))),
    CASE WHEN p_partkey % 5 <> 0 THEN CAST(1 + p_size % 4 AS VARCHAR(10)) ELSE '' END, CASE WHEN p_partkey % 7 <> 0 THEN CAST(20 + p_size AS VARCHAR(10)) ELSE 'n/a' END) AS line FROM {part}"""


@register(
    "A10_read_sectioned_table",
    """SELECT CAST(100 + p_partkey AS INTEGER) AS type_no, concat(p_type, ' ', CAST(p_size AS VARCHAR)) AS name, CASE WHEN p_partkey % 5 <> 0 THEN 1 + p_size % 4 ELSE 1 END AS lanes,
         CAST(CASE WHEN p_partkey % 7 <> 0 THEN 20 + p_size ELSE 30 END AS DOUBLE) AS v0 FROM {part}""",
)
def sectioned(v):
    path = scratch(v.spark)
    body = v.sql(TYPE_LINES)
    fixed = lambda k, text: v.spark.createDataFrame([(k, text)], "k long, line string")
    lines = body.unionByName(fixed(-3, "$VERSION:NR;LANGUAGE")).unionByName(fixed(-2, "15;ENG")).unionByName(fixed(-1, "$LINKTYPE:NO;NAME;NUMLANES;V0PRT"))
    lines = lines.unionByName(fixed(2**40, "* end")).unionByName(fixed(2**40 + 1, "$NODE:NO")).unionByName(fixed(2**40 + 2, "1;x;1;1"))
    # A sectioned file is one file.
    lines.coalesce(1).sortWithinPartitions("k").select("line").write.text(path)
    return tables.read_link_types(v.spark, path)


ZONE_SQL = """SELECT zone_no AS "NO", concat('Zone ', CAST(zone_no AS VARCHAR)) AS "NAME", CAST(zone_no % 5 AS BIGINT) AS "TYPENO", xmin AS "XCOORD", ymin AS "YCOORD", CAST(zone_no % 9 AS BIGINT) AS "NUM_RETAIL",
    CAST(zone_no % 8 AS DOUBLE) / 8 AS "P_RETAIL" FROM {admin_zones}"""


def zone_frame(v):
    return v.admin_zones.select(
        F.col("zone_no").alias("NO"), F.concat(F.lit("Zone "), F.col("zone_no").cast("string")).alias("NAME"), (F.col("zone_no") % 5).alias("TYPENO"),
        F.col("xmin").alias("XCOORD"), F.col("ymin").alias("YCOORD"), (F.col("zone_no") % 9).alias("NUM_RETAIL"),
        ((F.col("zone_no") % 8).cast("double") / 8).alias("P_RETAIL"), F.lit("POLYGON").alias("WKTSURFACE"),
    )


@register("A11_zone_table_round_trip", ZONE_SQL)
def zone_table(v):
    path = scratch(v.spark)
    tables.write_zone_tables(zone_frame(v), path)
    return coerce_zone_schema(v.spark.read.csv(f"{path}/zone", sep=";", header=True))


@register(
    "A11_zone_attribute_declarations",
    """SELECT 'ZONE' AS objid, attid, valuetype, maxlength, decimals, concat('Custom attribute: ', attid) AS comment
       FROM (VALUES ('NUM_RETAIL', 'Int', '0', '0'), ('P_RETAIL', 'Double', '0', '4')) t(attid, valuetype, maxlength, decimals) WHERE EXISTS (SELECT 1 FROM {admin_zones})""",
)
def attributes(v):
    path = scratch(v.spark)
    tables.write_zone_tables(zone_frame(v), path)
    return v.spark.read.csv(f"{path}/attributes", sep=";", header=True)


OD = "SELECT CAST(way_id % 5 AS INTEGER) AS level, from_node AS o, to_node AS d, CAST(sum(seq % 3) AS DOUBLE) AS value FROM {links} GROUP BY 1, 2, 3"


@register("A12_od_matrix_round_trip", f"SELECT level, o, d, value FROM ({OD}) t WHERE value <> 0")
def od_matrix(v):
    path = scratch(v.spark)
    tables.write_od_matrix(v.sql(OD), path)
    return tables.read_od_matrix(v.spark, path)


NAMES = """CASE WHEN cell_id % 4 = 0 THEN concat('feature_', CAST(cell_id AS VARCHAR)) ELSE concat('cell_', CAST(cell_id AS VARCHAR)) END"""


def polygons(v):
    """Cells as polygons in degrees: an outer ring, for even ids a hole, and for some a second part of two vertices only."""
    deg = lambda c: F.col(c) / 100000
    inner = lambda a, b, t: deg(a) + (deg(b) - deg(a)) * t
    outer = box_ring(deg("xmin"), deg("xmax"), deg("ymin"), deg("ymax"))
    hole = box_ring(inner("xmin", "xmax", 0.25), inner("xmin", "xmax", 0.75), inner("ymin", "ymax", 0.25), inner("ymin", "ymax", 0.75))
    part = F.when(F.col("cell_id") % 2 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    scrap = F.array(F.slice(outer, 1, 2))
    df = v.cells.withColumn("parts", F.when(F.col("cell_id") % 3 == 0, F.array(part, scrap)).otherwise(F.array(part)))
    label = F.when(F.col("cell_id") % 4 == 0, "").otherwise(F.concat(F.lit("cell:"), F.col("cell_id").cast("string")))
    return df.select(F.col("cell_id").alias("id"), label.alias("label"), "parts")


def _line(x, y):
    return f"concat('   ', printf('%.6f', {x}), '   ', printf('%.6f', {y}))"


LINES = f"""WITH c AS (SELECT cell_id, {NAMES} AS name, xmin / 100000 AS x0, xmax / 100000 AS x1, ymin / 100000 AS y0, ymax / 100000 AS y1 FROM {{cells}}),
    h AS (SELECT *, x0 + (x1 - x0) * 0.25::DOUBLE AS a0, x0 + (x1 - x0) * 0.75::DOUBLE AS a1, y0 + (y1 - y0) * 0.25::DOUBLE AS b0, y0 + (y1 - y0) * 0.75::DOUBLE AS b1 FROM c)
    SELECT name, unnest(l) AS line, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no FROM (SELECT name, list_concat([name, '1', {_line('x0', 'y0')}, {_line('x1', 'y0')}, {_line('x1', 'y1')}, {_line('x0', 'y1')}, 'END'],
      CASE WHEN cell_id % 2 = 0 THEN ['!1', {_line('a0', 'b0')}, {_line('a1', 'b0')}, {_line('a1', 'b1')}, {_line('a0', 'b1')}, 'END'] ELSE [] END, ['END']) AS l FROM h) t"""


@register("A13_boundary_file_lines", LINES)
def poly_lines(v):
    df = polygons(v)
    texts = poly.poly_text(df, poly.file_name(df, "field", "cells", field="label"))
    return texts.select("name", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@register(
    "A13_boundary_file_names",
    """SELECT cell_id AS id, concat('cells_fid_', CAST(cell_id AS VARCHAR)) AS by_layer, concat('zone_', CASE WHEN cell_id % 4 = 0 THEN '' ELSE concat('cell_', CAST(cell_id AS VARCHAR)) END, '_', CAST(cell_id AS VARCHAR), '_cells') AS by_template FROM {cells}""",
)
def poly_names(v):
    df = polygons(v)
    return df.select("id", poly.file_name(df, "layer", "ce lls").alias("by_layer"), poly.file_name(df, "template", "cells", template="zone_{label}_{id}_{layername}").alias("by_template"))


@register(
    "A14_boundary_file_round_trip",
    f"""SELECT {NAMES} AS name, CASE WHEN cell_id % 2 = 0 THEN 2 ELSE 1 END AS rings, {rnd("(xmax - xmin) * (ymax - ymin) / 1e10 * CASE WHEN cell_id % 2 = 0 THEN 0.75 ELSE 1 END", 8)} AS area, 1 AS valid FROM {{cells}}""",
)
def poly_round_trip(v):
    df = polygons(v)
    path = scratch(v.spark)
    poly.write_poly(df, poly.file_name(df, "field", "cells", field="label"), path)
    rings = poly.read_poly(v.spark, path)
    want = v.cells.select(
        F.when(F.col("cell_id") % 4 == 0, F.concat(F.lit("feature_"), F.col("cell_id").cast("string"))).otherwise(F.concat(F.lit("cell_"), F.col("cell_id").cast("string"))).alias("name"),
        ((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")) / 1e10 * F.when(F.col("cell_id") % 2 == 0, 0.75).otherwise(1.0)).alias("area"),
    )
    counts = rings.groupBy("name").agg(F.count(F.lit(1)).cast("int").alias("rings"))
    out = counts.join(poly.poly_area(rings), "name").join(poly.matches_selection(rings, want), "name")
    return out.select("name", "rings", round_half_up(F.col("area"), 8).alias("area"), F.col("valid").cast("int").alias("valid"))
