"""Road network (N)."""

from pyspark.sql import functions as F

from ...functions.maths import round_half_up
from ...operators import network as net
from . import register, rnd

RULES = [
    (101, "Mo 3x130", 3, 130.0), (102, "Mo 2x120", 2, 120.0), (103, "Mo 2x90", 2, 90.0), (104, "Tr 2x100", 2, 100.0), (105, "Tr 2x70", 2, 70.0),
    (106, "Pr 2x80", 2, 80.0), (107, "Pr 1x60", 1, 60.0), (108, "Pr 1x100", 1, 100.0), (109, "Se 2x70", 2, 70.0), (110, "Se 1x50", 1, 50.0),
    (111, "Te 1x50", 1, 50.0), (112, "Te 1x30", 1, 30.0), (113, "Un 1x50", 1, 50.0), (114, "Re 1x30", 1, 30.0), (115, "Link Mo 1x60", 1, 60.0),
    (116, "Bus lane", 1, 50.0), (117, "Blocked Oneway", 1, 10.0), (118, "Ferry", 1, 20.0), (119, "Residential", 1, 30.0),
    (10, "Motorway, 2 lanes", 2, 120.0), (19, "Motorway_link, 2 lanes", 2, 60.0), (20, "Trunk, 1 lane", 1, 100.0), (30, "Primary, 1 lane", 1, 80.0),
    (40, "Secondary, 1 lane", 1, 70.0), (50, "Tertiary, 1 lane", 1, 50.0), (60, "Unclassified, 1 lane", 1, 50.0), (70, "Residential", 1, 30.0),
    (94, "Ferry", 1, 20.0), (95, "ZK_Hilfsstrecken_Überflüssig", 1, 20.0), (99, "UnknownByImporter(Default)", 1, 50.0),
]
RULE_SQL = "rules(type_no, name, lanes, v0) AS (VALUES " + ", ".join(f"({a}, '{b}', {c}, {d}::DOUBLE)" for a, b, c, d in RULES) + ")"
CATS = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in net.TYPE_ABBREVIATIONS.items()) + " END"


def types(v):
    return v.spark.createDataFrame(RULES, "type_no int, name string, lanes int, v0 double")


# Target categories and their speed brackets.
TARGET_SQL = f"""{RULE_SQL}, target AS (SELECT type_no, lanes, v0, coalesce({CATS.format("concat(split_part(name, ' ', 1), ' ', split_part(name, ' ', 2))")}, {CATS.format("split_part(name, ' ', 1)")}, name) AS category
      FROM rules WHERE type_no >= 100 AND lower(name) NOT LIKE '%bus%'),
    brk AS (SELECT *, coalesce((v0 + lead(v0) OVER w) / 2, 0.0) AS lo, coalesce((v0 + lag(v0) OVER w) / 2, 1e18::DOUBLE) AS hi FROM target WINDOW w AS (PARTITION BY category, lanes ORDER BY v0 DESC))"""

NUM = r"TRY_CAST(regexp_extract({0}, '(\d+)', 1) AS INTEGER)"
MEANS = f"""ends AS (SELECT way_id, arg_min(node_id, seq) AS first_node, arg_max(node_id, seq) AS last_node FROM {{way_nodes}} GROUP BY way_id),
    means AS (SELECT highway, avg({NUM.format('maxspeed')}) AS ms, greatest(1.0, avg({NUM.format('lanes')})) AS ml FROM {{ways}} GROUP BY highway)"""


def _offers(column):
    return f"""off_{column} AS (SELECT n.node_id, b.highway, min(b.way_id) AS nid, arg_min({NUM.format('b.' + column)}, b.way_id) AS nval FROM {{way_nodes}} n JOIN {{ways}} b ON b.way_id = n.way_id
        WHERE {NUM.format('b.' + column)} IS NOT NULL GROUP BY 1, 2)"""


def _union_best(column):
    """Smallest neighbour over both ends, as two equality joins."""
    return f"""SELECT way_id, min(nid) AS nid, arg_min(nval, nid) AS nval FROM (
        SELECT a.way_id, o.nid, o.nval FROM {{ways}} a JOIN ends e ON e.way_id = a.way_id JOIN off_{column} o ON o.highway = a.highway AND o.node_id = e.first_node WHERE a.{column} IS NULL
        UNION ALL SELECT a.way_id, o.nid, o.nval FROM {{ways}} a JOIN ends e ON e.way_id = a.way_id JOIN off_{column} o ON o.highway = a.highway AND o.node_id = e.last_node WHERE a.{column} IS NULL) q GROUP BY way_id"""


IMPUTED = f"""{MEANS}, {_offers('maxspeed')}, {_offers('lanes')}, bs AS ({_union_best('maxspeed')}), bl AS ({_union_best('lanes')}),
    raw AS (SELECT w.*, {NUM.format('w.maxspeed')} AS s, {NUM.format('w.lanes')} AS l, ms, ml, bs.nid AS snid, bs.nval AS sval, bl.nid AS lnid, bl.nval AS lval,
      CAST(floor(ms) AS INTEGER) AS fs, CAST(round_even(ml, 0) AS INTEGER) AS fl FROM {{ways}} w JOIN means USING (highway) LEFT JOIN bs ON bs.way_id = w.way_id LEFT JOIN bl ON bl.way_id = w.way_id),
    imp AS (SELECT *, CASE WHEN maxspeed IS NOT NULL THEN CASE WHEN s IS NULL OR s > 250 THEN fs ELSE s END WHEN abs(sval - ms) <= 30 THEN sval ELSE fs END AS speed_now,
      CASE WHEN lanes IS NOT NULL THEN CASE WHEN l IS NULL OR l > 8 THEN fl ELSE l END WHEN abs(lval - ml) <= 2 THEN lval ELSE fl END AS lanes_now,
      CASE WHEN maxspeed IS NOT NULL AND s IS NULL THEN concat('[OSM-Original] Invalid (', maxspeed, ') -> Fallback to Regional Avg (', format('{{:.1f}}', ms), ' km/h) -> Template-Matched:')
        WHEN maxspeed IS NOT NULL AND s > 250 THEN concat('[OSM-Unplausible] Raw: ', maxspeed, ' km/h -> Capped to Template-Max:')
        WHEN maxspeed IS NOT NULL THEN concat('[OSM-Original] ', maxspeed, ' -> Template-Matched:')
        WHEN sval IS NOT NULL AND abs(sval - ms) <= 30 THEN concat('[Neighbor-Match] From Neighbor ID ', CAST(snid AS VARCHAR), ' (', CAST(sval AS VARCHAR), ' km/h) -> Template-Matched:')
        WHEN sval IS NOT NULL THEN concat('[Neighbor-No-Match] Neighbor ID ', CAST(snid AS VARCHAR), ' (', CAST(sval AS VARCHAR), ' km/h) rejected vs. Regional Avg (', format('{{:.1f}}', ms), ' km/h) -> Regional Fallback applied -> Template-Matched:')
        ELSE concat('[Regional-Average] Type ''', highway, ''' regional mean = ', format('{{:.1f}}', ms), ' km/h -> Template-Matched:') END AS speed_text,
      CASE WHEN lanes IS NOT NULL AND l IS NULL THEN concat('[OSM-Original] Invalid (', lanes, ') -> Fallback to Regional Avg (', format('{{:.1f}}', ml), ' lanes) -> Template-Matched:')
        WHEN lanes IS NOT NULL AND l > 8 THEN concat('[OSM-Unplausible] Raw: ', lanes, ' lanes -> Capped to Template-Max:')
        WHEN lanes IS NOT NULL THEN concat('[OSM-Original] ', lanes, ' lanes -> Template-Matched:')
        WHEN lval IS NOT NULL AND abs(lval - ml) <= 2 THEN concat('[Neighbor-Match] From Neighbor ID ', CAST(lnid AS VARCHAR), ' (', CAST(lval AS VARCHAR), ' lanes) -> Template-Matched:')
        WHEN lval IS NOT NULL THEN concat('[Neighbor-No-Match] Neighbor ID ', CAST(lnid AS VARCHAR), ' (', CAST(lval AS VARCHAR), ' lanes) rejected vs. Regional Avg (', format('{{:.1f}}', ml), ' lanes) -> Regional Fallback applied -> Template-Matched:')
        ELSE concat('[Regional-Average] Type ''', highway, ''' regional mean = ', format('{{:.1f}}', ml), ' lanes (rounded: ', CAST(fl AS VARCHAR), ') -> Template-Matched:') END AS lanes_text FROM raw)"""


@register("N01_way_topology", "SELECT way_id, arg_min(node_id, seq) AS first_node, arg_max(node_id, seq) AS last_node, count(*) AS n_nodes FROM {way_nodes} GROUP BY way_id")
def topology(v):
    return net.way_topology(v.way_nodes)


@register("N02_impute_speed_and_lanes", f"WITH {IMPUTED} SELECT way_id, speed_now, lanes_now FROM imp")
def impute(v):
    return net.impute_from_neighbours(v.ways, v.way_nodes).select("way_id", "speed_now", "lanes_now")


MATCHED = f"""WITH {TARGET_SQL}, {IMPUTED}, stock AS (SELECT category, max(lanes) AS most FROM brk GROUP BY category),
    pick AS (SELECT imp.*, concat(upper(left(highway, 1)), substr(highway, 2)) AS cat, CASE WHEN EXISTS (SELECT 1 FROM brk b WHERE b.category = concat(upper(left(imp.highway, 1)), substr(imp.highway, 2)) AND b.lanes = imp.lanes_now)
      THEN lanes_now ELSE (SELECT most FROM stock s WHERE s.category = concat(upper(left(imp.highway, 1)), substr(imp.highway, 2))) END AS p FROM imp),
    fin AS (SELECT k.*, coalesce(CAST(b.v0 AS INTEGER), speed_now) AS target_speed, coalesce(b.lanes, lanes_now) AS target_lanes FROM pick k LEFT JOIN brk b
      ON b.category = k.cat AND b.lanes = k.p AND k.speed_now >= b.lo AND k.speed_now < b.hi)"""


def matched(v):
    brackets = net.speed_brackets(net.target_types(types(v)))
    return net.match_brackets(net.impute_from_neighbours(v.ways, v.way_nodes), brackets)


@register("N03_match_brackets", f"{MATCHED} SELECT way_id, target_speed, target_lanes FROM fin")
def brackets(v):
    return matched(v).select("way_id", "target_speed", "target_lanes")


@register(
    "N04_provenance",
    f"""{MATCHED} SELECT way_id, coalesce(maxspeed, 'missing') AS maxspeed_original, coalesce(lanes, 'missing') AS lanes_original,
        concat(speed_text, ' ', CAST(target_speed AS VARCHAR), ' km/h') AS maxspeed_source,
        concat(lanes_text, ' ', CAST(target_lanes AS VARCHAR), ' lanes') AS lanes_source FROM fin""",
)
def provenance(v):
    return net.provenance(matched(v)).select("way_id", "maxspeed_original", "lanes_original", "maxspeed_source", "lanes_source")


@register(
    "N05_split_ways",
    """WITH u AS (SELECT node_id, count(*) AS uses FROM {way_nodes} GROUP BY node_id), m AS (SELECT w.*, u.uses, max(seq) OVER (PARTITION BY way_id) AS last FROM {way_nodes} w JOIN u ON u.node_id = w.node_id),
       c AS (SELECT * FROM m WHERE uses > 1 OR seq = 1 OR seq = last), e AS (SELECT way_id, node_id AS from_node, lead(node_id) OVER w AS to_node, lead(seq) OVER w - seq AS hops, row_number() OVER w AS part FROM c WINDOW w AS (PARTITION BY way_id ORDER BY seq))
       SELECT way_id, CAST(part AS INTEGER) AS part, from_node, to_node, CAST(hops AS INTEGER) AS hops FROM e WHERE to_node IS NOT NULL""",
)
def split(v):
    return net.split_ways(v.way_nodes)


TURNS = """SELECT w.way_id AS rel_id, CASE w.way_id % 4 WHEN 0 THEN 'no_left_turn' WHEN 1 THEN 'only_straight_on' WHEN 2 THEN 'no_u_turn' ELSE 'only_right_turn' END AS kind,
    CASE w.way_id % 5 WHEN 0 THEN 'hgv' WHEN 1 THEN 'motor_vehicle' WHEN 2 THEN 'bicycle' END AS vehicle, CASE w.way_id % 6 WHEN 0 THEN 'psv' WHEN 1 THEN 'psv;hgv' END AS except_types,
    w.way_id AS from_way, w.last_node AS via_node, t.to_way
    FROM (SELECT l.way_id, l.to_node AS last_node FROM {links} l JOIN (SELECT way_id, max(seq) AS s FROM {links} GROUP BY way_id) m ON m.way_id = l.way_id AND m.s = l.seq) w
    JOIN (SELECT from_node, max(way_id) AS to_way FROM {links} GROUP BY from_node) t ON t.from_node = w.last_node WHERE t.to_way <> w.way_id"""


@register(
    "N06_turn_bans",
    f"""WITH r AS ({TURNS}), s(t, s, c) AS (VALUES ('motorcar', 'motor_vehicle', 'CAR'), ('hgv', 'motor_vehicle', 'HGV'), ('psv', 'motor_vehicle', 'BUS')),
        e AS (SELECT r.*, s.c AS system FROM r JOIN s ON (r.vehicle IS NULL OR r.vehicle = s.t OR r.vehicle = s.s) AND NOT contains(concat(';', coalesce(except_types, ''), ';'), concat(';', s.t, ';'))),
        o AS (SELECT DISTINCT from_node AS node, way_id FROM {{links}} UNION SELECT DISTINCT to_node, way_id FROM {{links}}),
        b AS (SELECT via_node, from_way, to_way, system FROM e WHERE kind LIKE 'no%' UNION SELECT e.via_node, e.from_way, o.way_id, e.system FROM e JOIN o ON o.node = e.via_node
          WHERE e.kind LIKE 'only%' AND o.way_id <> e.to_way AND o.way_id <> e.from_way)
        SELECT via_node, from_way, system, count(*) AS banned, CAST(sum(to_way) AS BIGINT) AS total FROM b GROUP BY 1, 2, 3""",
)
def turns(v):
    bans = net.turn_bans(v.sql(TURNS), v.links)
    return bans.groupBy("via_node", "from_way", "system").agg(F.count(F.lit(1)).alias("banned"), F.sum("to_way").alias("total"))


TYPE_NO = """CASE WHEN way_id % 64 = 5 THEN 19 WHEN way_id % 32 = 6 THEN 94 WHEN way_id % 7 = 0 THEN 10 WHEN way_id % 7 = 1 THEN 20 WHEN way_id % 7 = 2 THEN 30 WHEN way_id % 7 = 3 THEN 40
    WHEN way_id % 7 = 4 THEN 50 WHEN way_id % 7 = 5 THEN 60 ELSE 70 END"""
REST = "CASE WHEN way_id % 3 = 0 THEN concat('Street ', CAST(way_id % 50 AS VARCHAR(10))) ELSE '' END AS name, CAST(way_id % 61 AS DOUBLE) / 1000 AS length, CASE WHEN way_id % 128 = 7 THEN 1 ELSE 0 END AS roundabout"
DIRECTED = f"""SELECT way_id * 100 + seq AS no, from_node, to_node, {TYPE_NO} AS type_no, CASE WHEN (way_id + seq) % 4 = 0 THEN 'BUS' WHEN way_id % 50 = 0 THEN '' ELSE 'CAR,BUS' END AS tsys, {REST} FROM {{links}}
    UNION ALL SELECT way_id * 100 + seq, to_node, from_node, {TYPE_NO}, CASE WHEN way_id % 5 = 0 THEN '' ELSE 'CAR' END, {REST} FROM {{links}}"""


# One number for a link's direction, and that of its other direction: the ends of a link differ.
WAY, BACK = (f"no * 2 + CASE WHEN from_node {sign} to_node THEN 1 ELSE 0 END" for sign in "<>")


def directed(v):
    """Both directions of every link, from one pass over the links."""
    base = v.sql(
        f"""SELECT way_id * 100 + seq AS no, from_node AS a, to_node AS b, {TYPE_NO} AS type_no, {REST},
            CASE WHEN (way_id + seq) % 4 = 0 THEN 'BUS' WHEN way_id % 50 = 0 THEN '' ELSE 'CAR,BUS' END AS there,
            CASE WHEN way_id % 5 = 0 THEN '' ELSE 'CAR' END AS back FROM {{links}}"""
    )
    row = lambda f, t, tsys: F.struct(F.col(f).alias("from_node"), F.col(t).alias("to_node"), F.col(tsys).alias("tsys"))
    both = base.withColumn("_d", F.explode(F.array(row("a", "b", "there"), row("b", "a", "back"))))
    return both.select("no", "_d.from_node", "_d.to_node", "type_no", "_d.tsys", "name", "length", "roundabout")


@register(
    "N07_blocked_oneway_reverse",
    f"""WITH d AS MATERIALIZED (SELECT *, {WAY} AS way, {BACK} AS reverse FROM ({DIRECTED}) q), c AS MATERIALIZED (SELECT way, max(CASE WHEN contains(tsys, 'CAR') THEN 1 ELSE 0 END) AS car FROM d GROUP BY way)
        SELECT no, from_node, to_node, CASE WHEN type_no BETWEEN 10 AND 73 AND NOT contains(tsys, 'CAR') AND coalesce(car, 0) = 1 THEN 0 ELSE type_no END AS type_no
        FROM d LEFT JOIN c ON c.way = d.reverse""",
)
def blocked(v):
    return net.mark_blocked_oneway(directed(v)).select("no", "from_node", "to_node", "type_no")


@register(
    "N08_ferry_access_links",
    f"""WITH f AS (SELECT DISTINCT to_node AS node_id FROM ({DIRECTED}) d WHERE type_no = 94), a AS (SELECT n.* FROM {{nodes}} n JOIN f ON f.node_id = n.node_id),
        l AS (SELECT n.* FROM {{nodes}} n WHERE n.node_id NOT IN (SELECT node_id FROM f)),
        k AS (SELECT * FROM (SELECT a.node_id AS f, l.node_id AS t, sqrt((a.x - l.x) * (a.x - l.x) + (a.y - l.y) * (a.y - l.y)) AS len,
          row_number() OVER (PARTITION BY a.node_id ORDER BY sqrt((a.x - l.x) * (a.x - l.x) + (a.y - l.y) * (a.y - l.y)), l.node_id) AS rn FROM a, l) q WHERE rn = 1 AND len <= 5000)
        SELECT f AS from_node, t AS to_node, {rnd('len', 3)} AS length, 96 AS type_no FROM k UNION ALL SELECT t, f, {rnd('len', 3)}, 96 FROM k""",
)
def ferries(v):
    out = net.ferry_access(directed(v), v.nodes)
    return out.withColumn("length", round_half_up(F.col("length"), 3))


GTYPE = """CASE WHEN lower(name) LIKE '%\\_link%' ESCAPE '\\' THEN 77 WHEN lower(name) LIKE '%residential%' OR lower(name) LIKE '%unclassified%' THEN 5 WHEN lower(name) LIKE '%tertiary%' THEN 4
    WHEN lower(name) LIKE '%secondary%' THEN 3 WHEN lower(name) LIKE '%primary%' OR lower(name) LIKE '%trunk%' THEN 2 WHEN lower(name) LIKE '%motorway%' THEN 1 ELSE 99 END"""
CLASSED = f"""{RULE_SQL}, gt AS (SELECT type_no, {GTYPE} AS gtype FROM rules), d0 AS ({DIRECTED}), d1 AS (SELECT d0.* REPLACE (CASE WHEN tsys = '' THEN 0 ELSE d0.type_no END AS type_no) FROM d0),
    d2 AS MATERIALIZED (SELECT d1.*, coalesce(gt.gtype, 99) AS gtype, {WAY} AS way, {BACK} AS reverse FROM d1 LEFT JOIN gt ON gt.type_no = d1.type_no),
    cls AS (SELECT a.* EXCLUDE (way, reverse), CASE WHEN least(a.gtype, coalesce(b.gtype, a.gtype)) = 77 OR a.roundabout = 1 THEN -1 ELSE least(a.gtype, coalesce(b.gtype, a.gtype)) END AS uclass
      FROM d2 a LEFT JOIN d2 b ON b.way = a.reverse)"""


def classed(v):
    return net.classify_links(directed(v), types(v))


@register("N09_main_classes", f"WITH {CLASSED} SELECT no, from_node, to_node, type_no, gtype, uclass FROM cls")
def classes(v):
    return classed(v).select("no", "from_node", "to_node", "type_no", "gtype", "uclass")


def closure(name, edges):
    """Components of an undirected edge list (a, b) by transitive closure."""
    return f"""{name}_r(id, other) AS (SELECT a, a FROM ({edges}) e0 UNION SELECT b, b FROM ({edges}) e1 UNION SELECT r.id, e.b FROM {name}_r r JOIN (SELECT a, b FROM ({edges}) e2 UNION SELECT b, a FROM ({edges}) e3) e ON e.a = r.other),
    {name} AS (SELECT id, min(other) AS component FROM {name}_r GROUP BY id)"""


RAMPS = f"""{CLASSED}, {closure('rc', 'SELECT from_node AS a, to_node AS b FROM cls WHERE uclass = -1')},
    rm AS (SELECT DISTINCT c.no, c.from_node, c.to_node, rc.component FROM cls c JOIN rc ON rc.id = c.from_node WHERE c.uclass = -1),
    touch AS (SELECT DISTINCT to_node AS node, uclass FROM cls WHERE uclass BETWEEN 0 AND 5),
    seen AS (SELECT component, uclass FROM (SELECT DISTINCT component, from_node, to_node, from_node AS node FROM rm) a JOIN touch USING (node)
      UNION ALL SELECT component, uclass FROM (SELECT DISTINCT component, from_node, to_node, to_node AS node FROM rm) a JOIN touch USING (node)),
    rf AS (SELECT component, CASE WHEN count(*) = 2 THEN '6' ELSE string_agg(DISTINCT CAST(uclass AS VARCHAR), ',' ORDER BY CAST(uclass AS VARCHAR)) END AS classes FROM seen GROUP BY component),
    ramps AS (SELECT rm.*, rf.classes FROM rm JOIN rf ON rf.component = rm.component)"""


@register("N10_ramp_components", f"WITH RECURSIVE {RAMPS} SELECT no, from_node, to_node, component, classes FROM ramps")
def ramps(v):
    from ...session import cut

    return net.ramp_components(cut(classed(v)))


UTURNS = f"""{RAMPS}, um AS (SELECT c.no, c.from_node, c.to_node, c.length FROM cls c WHERE c.gtype = 77 AND NOT EXISTS (SELECT 1 FROM ramps r WHERE r.no = c.no AND r.from_node = c.from_node AND r.to_node = c.to_node AND contains(r.classes, ','))),
    {closure('uc', 'SELECT from_node AS a, to_node AS b FROM um')}, uu AS (SELECT um.*, uc.component FROM um JOIN uc ON uc.id = um.from_node),
    ul AS (SELECT component, sum(length) AS total FROM (SELECT component, least(from_node, to_node) AS a, greatest(from_node, to_node) AS b, max(length) AS length FROM uu GROUP BY 1, 2, 3) q GROUP BY 1),
    un AS (SELECT component, count(DISTINCT name) AS names FROM (SELECT component, from_node AS node FROM uu UNION SELECT component, to_node FROM uu) e JOIN (SELECT DISTINCT to_node AS node, name FROM cls WHERE name <> '') n USING (node) GROUP BY 1),
    ut AS (SELECT DISTINCT no FROM uu JOIN ul USING (component) JOIN un USING (component) WHERE names = 1 AND total <= 0.05 + 1e-12)"""


def all_roads(v):
    """Links of every road under their own names, and the U-turns among them."""
    from ...session import cut

    links = cut(classed(v))
    return links, net.uturn_links(links, cut(net.ramp_components(links)))


@register("N11_uturn_links_all_roads", f"WITH RECURSIVE {UTURNS} SELECT no FROM ut")
def uturns_all_roads(v):
    return all_roads(v)[1]


@register(
    "N09_final_link_classes_all_roads",
    f"""WITH RECURSIVE {UTURNS} SELECT cls.no, cls.from_node, CAST(CASE WHEN ut.no IS NOT NULL AND gtype <> 99 THEN 88 ELSE gtype END AS INTEGER) AS class
        FROM cls LEFT JOIN ut ON ut.no = cls.no""",
)
def final_classes_all_roads(v):
    return net.link_class(*all_roads(v)).select("no", "from_node", F.col("class").cast("int").alias("class"))


@register("N12_node_types", f"""WITH RECURSIVE {RAMPS}, lk AS (SELECT c.*, r.classes FROM cls c LEFT JOIN ramps r ON r.no = c.no AND r.from_node = c.from_node AND r.to_node = c.to_node WHERE c.uclass <= 5),
    iv AS (SELECT to_node AS node, unnest(string_split(CASE WHEN uclass > -1 THEN CAST(uclass AS VARCHAR) ELSE coalesce(classes, '') END, ',')) AS t FROM lk),
    ud AS (SELECT node, list_sort(list(DISTINCT CAST(t AS INTEGER))) AS u FROM iv WHERE node NOT IN (SELECT node FROM iv WHERE t = '') GROUP BY node),
    io AS (SELECT to_node AS node, gtype AS c FROM lk UNION ALL SELECT from_node, gtype FROM lk),
    dg AS (SELECT node, count(*) AS io, count(CASE WHEN c < 88 THEN 1 END) AS deg, max(CASE WHEN c = 77 THEN 1 ELSE 0 END) AS ramp, count(DISTINCT CASE WHEN c < 77 THEN c END) AS kinds, min(CASE WHEN c < 77 THEN c END) AS best FROM io GROUP BY node),
    nb AS (SELECT dg.*, (SELECT count(*) FROM io WHERE io.node = dg.node AND io.c = dg.best) AS nbest FROM dg),
    t AS (SELECT ud.node, CASE WHEN len(u) > 1 AND nbest > 4 THEN best ELSE u[1] END AS a, CASE WHEN len(u) > 1 AND nbest > 4 THEN best WHEN len(u) > 1 THEN u[2] ELSE u[1] END AS b,
      deg >= 5 OR io >= 8 OR (io = 6 AND ramp = 1) OR kinds > 1 AS crossing FROM ud JOIN nb ON nb.node = ud.node)
    SELECT node, CASE WHEN crossing THEN concat(CAST(a AS VARCHAR), '-', CAST(b AS VARCHAR)) ELSE 'N-N' END AS detail, CAST(CASE WHEN crossing THEN b ELSE 99 END AS INTEGER) AS type_no FROM t""")
def node_types(v):
    from ...session import cut

    # What the types do not need is not shuffled, and only ramps meet the components.
    links = cut(classed(v).select("no", "from_node", "to_node", "uclass", F.col("gtype").alias("class")).filter("uclass <= 5"))
    ramps = net.ramp_components(links).select("no", "from_node", "to_node", F.col("classes").alias("various"))
    on_ramps = links.filter("uclass = -1").join(ramps, ["no", "from_node", "to_node"], "left")
    others = links.filter("uclass <> -1").withColumn("various", F.lit(None).cast("string"))
    return net.node_types(on_ramps.unionByName(others)).select("node", "detail", F.col("type_no").cast("int").alias("type_no"))


@register(
    "N13_mutually_reachable_nodes_all_roads",
    """WITH RECURSIVE e AS (SELECT DISTINCT from_node AS a, to_node AS b FROM {links}), seeds AS (SELECT to_node AS s FROM {links} GROUP BY to_node ORDER BY count(*) DESC, to_node LIMIT 5),
        fwd(s, n) AS (SELECT s, s FROM seeds UNION SELECT f.s, e.b FROM fwd f JOIN e ON e.a = f.n), bwd(s, n) AS (SELECT s, s FROM seeds UNION SELECT f.s, e.a FROM bwd f JOIN e ON e.b = f.n)
        SELECT DISTINCT fwd.n AS node FROM fwd JOIN bwd ON bwd.s = fwd.s AND bwd.n = fwd.n""",
)
def mutually_reachable_all_roads(v):
    return net.reachable_nodes(v.links.select("from_node", "to_node"))


DETAILS = "CASE node_id % 15 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(net.BUFFERS)) + " END"
TYPED = f"SELECT node_id AS id, x, y, {DETAILS} AS detail FROM {{nodes}}"
BUFFER_SQL = "buf(detail, size) AS (VALUES " + ", ".join(f"('{k}', {s}::DOUBLE)" for k, s in net.BUFFERS.items()) + ")"
CLUSTERED = f"""{BUFFER_SQL}, t AS (SELECT t.*, buf.size FROM ({TYPED}) t JOIN buf ON buf.detail = t.detail),
    pr AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.detail = b.detail AND a.id <> b.id AND a.size > 0 AND b.x BETWEEN a.x - 2 * a.size AND a.x + 2 * a.size
      AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 2 * a.size),
    rr(id, other) AS (SELECT id, id FROM t UNION SELECT r.id, p.b FROM rr r JOIN pr p ON p.a = r.other), cl AS (SELECT id, min(other) AS cluster FROM rr GROUP BY id)"""


@register("N14_access_node_clusters", f"WITH RECURSIVE {CLUSTERED} SELECT t.id, t.detail, cl.cluster FROM t JOIN cl ON cl.id = t.id")
def access_clusters(v):
    return net.cluster_access_nodes(v.sql(TYPED))


@register(
    "N15_access_nodes",
    f"""WITH RECURSIVE {CLUSTERED} SELECT cl.cluster, t.detail, {rnd('avg(t.x)', 4)} AS x, {rnd('avg(t.y)', 4)} AS y, CAST(split_part(t.detail, '-', 2) AS INTEGER) AS zk_type,
        CAST(replace(t.detail, '-', '') AS INTEGER) AS rank, count(*) AS members FROM t JOIN cl ON cl.id = t.id GROUP BY cl.cluster, t.detail HAVING count(*) > 1""",
)
def access(v):
    nodes = v.sql(TYPED)
    out = net.access_nodes(nodes, net.cluster_access_nodes(nodes))
    return out.select("cluster", "detail", round_half_up(F.col("x"), 4).alias("x"), round_half_up(F.col("y"), 4).alias("y"), "zk_type", "rank", "members")


@register(
    "N15_helper_links",
    f"""WITH RECURSIVE {CLUSTERED}, m AS (SELECT t.id, t.detail, cl.cluster FROM t JOIN cl ON cl.id = t.id WHERE cl.cluster IN (SELECT cluster FROM cl GROUP BY cluster HAVING count(*) > 1))
        SELECT detail, -cluster - 1 AS from_node, id AS to_node, 777 AS type_no FROM m UNION ALL SELECT detail, id, -cluster - 1, 777 FROM m""",
)
def helpers(v):
    return net.helper_links(net.cluster_access_nodes(v.sql(TYPED)))


CENTRES = f"c AS (SELECT cl.cluster, t.detail, {rnd('avg(t.x)', 4)} AS x, {rnd('avg(t.y)', 4)} AS y FROM t JOIN cl ON cl.id = t.id GROUP BY cl.cluster, t.detail HAVING count(*) > 1)"


def centres(v):
    nodes = v.sql(TYPED)
    return net.access_nodes(nodes, net.cluster_access_nodes(nodes))


@register(
    "N15_centre_zones",
    f"""WITH RECURSIVE {CLUSTERED}, {CENTRES} SELECT CAST((SELECT max(no) FROM {{tier_zones}}) + row_number() OVER (ORDER BY cluster, detail) AS BIGINT) AS zone_no,
        -cluster - 1 AS node_no, detail, x, y, 99 AS type_no FROM c""",
)
def centre_zones(v):
    found = net.centre_zones(centres(v), v.tier_zones)
    return found.withColumns({c: round_half_up(F.col(c), 4) for c in ("x", "y")})


@register(
    "N15_centre_connectors",
    f"""WITH RECURSIVE {CLUSTERED}, {CENTRES} SELECT cluster, detail, direction, 'CAR,BUS' AS tsys FROM c, (SELECT unnest(['O', 'D']) AS direction) d""",
)
def centre_connectors(v):
    return net.centre_connectors(centres(v), "CAR,BUS")


OLD_LINKS = f"""SELECT way_id * 100 + seq AS no, CASE WHEN way_id % 40 = 3 THEN 95 WHEN way_id % 40 = 4 THEN 99 ELSE {TYPE_NO} END AS type_no, CAST(way_id % 5 AS INTEGER) AS numlanes,
    CAST(20 + way_id % 12 * 10 AS DOUBLE) AS v0 FROM {{links}}"""
RESTRUCTURED = f"""WITH {TARGET_SQL}, li AS (SELECT * FROM ({OLD_LINKS}) o WHERE type_no <> 95),
    old AS (SELECT type_no, CASE WHEN name = 'UnknownByImporter(Default)' THEN 'UnknownByImporter' ELSE regexp_replace(name, ', \\d+ lanes?$', '') END AS category FROM rules WHERE type_no < 100),
    st AS (SELECT b.*, max(lanes) OVER (PARTITION BY category) AS top FROM brk b WHERE category IN ({', '.join(repr(c) for c in net.STRUCTURED)})),
    si AS (SELECT category, min(type_no) AS t FROM target WHERE category NOT IN ({', '.join(repr(c) for c in net.STRUCTURED)}) GROUP BY category),
    res AS (SELECT li.no, CAST(coalesce(st.type_no, si.t, CASE WHEN li.numlanes = 0 THEN 117 END, li.type_no) AS INTEGER) AS new_type FROM li JOIN old ON old.type_no = li.type_no
      LEFT JOIN st ON st.category = old.category AND (st.lanes = li.numlanes OR (st.lanes = st.top AND li.numlanes >= st.lanes)) AND li.v0 >= st.lo AND li.v0 < st.hi
      LEFT JOIN si ON si.category = old.category)"""


def restructured(v):
    links = net.drop_links_of_type(v.sql(OLD_LINKS), types(v), "ZK_Hilfsstrecken_Überflüssig")
    return net.restructure_types(links, types(v))


@register("N16_restructure_link_types", f"{RESTRUCTURED} SELECT no, new_type FROM res")
def restructure(v):
    return restructured(v).select("no", F.col("new_type").cast("int").alias("new_type"))


@register("N16_unmatched_link_types", f"{RESTRUCTURED} SELECT new_type, count(*) AS n FROM res WHERE new_type < 100 GROUP BY new_type")
def unmatched(v):
    return net.unmatched_types(restructured(v)).select(F.col("new_type").cast("int").alias("new_type"), "n")


ACCESS = "SELECT node_id, x, y, CAST(1 + node_id % 5 AS INTEGER) AS zk_type, node_id % 10 <> 0 AS reachable, CAST(floor(x / 22000) AS INTEGER) AS island FROM {nodes}"
SEATS = "SELECT no AS id, x / 2 AS x, y / 2 AS y, CASE WHEN type_no = 4 AND no % 2 = 0 THEN 9 ELSE type_no END AS type_no, CAST(floor(x / 44000) AS INTEGER) AS island FROM {tier_zones}"
DIST = "sqrt((z.x - n.x) * (z.x - n.x) + (z.y - n.y) * (z.y - n.y))"


def _category(island):
    same = "n.island = z.island AND z.island <> -1" if island else "TRUE"
    return f"""SELECT z.*, n.d AS distance, CASE WHEN n.d < 5000 AND ({same}) THEN 'Near' ELSE 'Far' END AS category FROM ({SEATS}) z JOIN (
        SELECT * FROM (SELECT z.id AS zid, n.island, {DIST} AS d, row_number() OVER (PARTITION BY z.id ORDER BY {DIST}, n.node_id) AS rn FROM ({SEATS}) z, ({ACCESS}) n
          WHERE n.zk_type <= 4 AND n.reachable) q WHERE rn = 1) n ON n.zid = z.id"""


@register("N17_zone_distance_class", f"SELECT id, {rnd('distance', 3)} AS distance, category FROM ({_category(True)}) c")
def distance_class(v):
    out = net.zone_category(v.sql(SEATS), v.sql(ACCESS))
    return out.select("id", round_half_up(F.col("distance"), 3).alias("distance"), "category")


def _steps():
    rows = []
    for category, levels in (("Near", net.NEAR_LEVELS), ("Far", net.FAR_LEVELS)):
        for level, tiers, weakest, reach, count in levels:
            ladder = [(weakest, reach)] + [(c[2], reach) for c in net.NEAR_LEVELS if c[2] > weakest] + [(5, net.LAST_RESORT)]
            for i, (klass, radius) in enumerate(ladder):
                for tier in tiers:
                    rows.append(f"('{category}', {level}, {tier}, {i}, {klass}, {radius}, {count})")
    return ", ".join(rows)


CONNECTED = f"""WITH z AS ({_category(False)}), st(category, level, tier, step, klass, radius, k) AS (VALUES {_steps()}),
    c AS (SELECT z.id, st.level, st.step, st.k, n.node_id, {DIST} AS d FROM z JOIN st ON st.category = z.category AND st.tier = z.type_no JOIN ({ACCESS}) n ON n.zk_type <= st.klass AND n.reachable AND {DIST} <= st.radius),
    f AS (SELECT id, level, min(step) AS step FROM c GROUP BY 1, 2),
    con AS (SELECT level, id AS zone_no, node_id, d FROM (SELECT c.*, row_number() OVER (PARTITION BY c.id, c.level ORDER BY c.d, c.node_id) AS rn FROM c JOIN f ON f.id = c.id AND f.level = c.level AND f.step = c.step) q WHERE rn <= k)"""


def connected(v):
    zones = v.sql(SEATS).drop("island")
    nodes = v.sql(ACCESS).drop("island")
    return net.make_connectors(net.zone_category(zones, nodes), nodes)


@register("N18_connectors", f"{CONNECTED} SELECT level, zone_no, node_id, {rnd('d', 3)} AS d FROM con")
def connectors(v):
    return connected(v).select("level", "zone_no", "node_id", round_half_up(F.col("d"), 3).alias("d"))


@register(
    "N19_connector_rows",
    f"""{CONNECTED} SELECT zone_no, node_id, direction, 'CAR,BUS' AS tsys, {', '.join(f'max(CASE WHEN level = {n} THEN 1 ELSE 0 END) AS level_{n}' for n in (0, 1, 2, 3, 4, 5, 9))}
        FROM con, (VALUES ('O'), ('D')) t(direction) GROUP BY zone_no, node_id, direction""",
)
def connector_rows(v):
    return net.connector_rows(connected(v), "CAR,BUS")
