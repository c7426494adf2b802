"""Geodata-like views over the given tables.

The same SQL text defines a view for Spark and, with the table names filled in, for the checking side.
Coordinates are metres from quadratic hashes of the key, reduced before squaring so that no key overflows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def _hash_xy(key: str, mx: int, my: int, table: str) -> str:
    return (
        f"CAST(((({key} % {mx}) * ({key} % {mx}) * 31 + ({key} % {mx}) * 7919) % {mx}) AS DOUBLE) AS x, "
        f"CAST(((({key} % {my}) * ({key} % {my}) * 17 + ({key} % {my}) * 104729 + 53) % {my}) AS DOUBLE) AS y"
    )


VIEWS = {
    "places": f"""
        SELECT c_custkey AS id, c_name AS name, CAST(floor(abs(c_acctbal) * 37) AS BIGINT) AS pop,
               {_hash_xy('c_custkey', 300007, 299993, 'customer')}
        FROM {{customer}}""",
    "admin_zones": """
        SELECT CAST(2000000 + ry * 20 + cx AS BIGINT) AS zone_no,
               CAST(cx * 15001 AS DOUBLE) AS xmin, CAST((cx + 1) * 15001 AS DOUBLE) AS xmax,
               CAST(ry * 15001 AS DOUBLE) AS ymin, CAST((ry + 1) * 15001 AS DOUBLE) AS ymax
        FROM (SELECT DISTINCT CAST(floor(x / 15001) AS BIGINT) AS cx, CAST(floor(y / 15001) AS BIGINT) AS ry
              FROM {places}) g""",
    "pixels": """
        SELECT ((o_orderkey % 601) * (o_orderkey % 601) * 31 + (o_orderkey % 601) * 7919) % 601 AS col,
               ((o_orderkey % 599) * (o_orderkey % 599) * 17 + (o_orderkey % 599) * 104729 + 53) % 599 AS row_no,
               CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100000 AS value
        FROM {orders} GROUP BY 1, 2""",
    "pois": f"""
        SELECT p_partkey AS fid, p_partkey AS osm_id, p_name AS name,
               CASE p_partkey % 12 WHEN 0 THEN 'school' WHEN 1 THEN 'hospital' WHEN 2 THEN 'bank' WHEN 3 THEN 'library'
                    WHEN 4 THEN 'university' WHEN 5 THEN 'pharmacy' WHEN 6 THEN 'townhall' WHEN 7 THEN 'bench' END AS amenity,
               CASE p_partkey % 12 WHEN 8 THEN 'supermarket' WHEN 9 THEN 'mall' WHEN 10 THEN 'bakery' END AS shop,
               CASE WHEN p_partkey % 12 = 11 THEN 'museum' END AS tourism,
               {_hash_xy('p_partkey', 45007, 44987, 'part')}
        FROM {{part}}""",
    "ways": """
        SELECT o_orderkey AS way_id,
               CASE o_orderkey % 7 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary'
                    WHEN 4 THEN 'tertiary' WHEN 5 THEN 'unclassified' ELSE 'residential' END AS highway,
               CASE WHEN o_orderkey % 5 < 2 THEN NULL WHEN o_orderkey % 97 = 0 THEN '999'
                    WHEN o_orderkey % 89 = 0 THEN 'signals'
                    ELSE concat(CAST(30 + 10 * (o_orderkey % 11) AS VARCHAR(10)), ' km/h') END AS maxspeed,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN '12'
                    ELSE CAST(1 + o_orderkey % 4 AS VARCHAR(10)) END AS lanes
        FROM {orders}""",
    # The renaming comes first, so that windows on way_id further up find the rows already in place.
    "way_nodes": """
        SELECT way_id,
               row_number() OVER (PARTITION BY way_id ORDER BY l_linenumber, node_id, l_suppkey, l_extendedprice, l_quantity) AS seq,
               node_id
        FROM (SELECT l_orderkey AS way_id, l_partkey AS node_id, l_linenumber, l_suppkey, l_extendedprice, l_quantity FROM {lineitem}) l""",
    "nodes": f"""
        SELECT p_partkey AS node_id, {_hash_xy('p_partkey', 45007, 44987, 'part')} FROM {{part}}""",
    "links": """
        SELECT way_id, seq, node_id AS from_node, next_node AS to_node
        FROM (SELECT way_id, seq, node_id, lead(node_id) OVER (PARTITION BY way_id ORDER BY seq) AS next_node
              FROM {way_nodes}) t
        WHERE next_node IS NOT NULL AND next_node <> node_id""",
    "tagged_ways": """
        SELECT o_orderkey AS way_id,
               CASE o_orderkey % 16 WHEN 0 THEN 'motorway' WHEN 1 THEN 'motorway_link' WHEN 2 THEN 'trunk' WHEN 3 THEN 'primary'
                    WHEN 4 THEN 'primary_link' WHEN 5 THEN 'secondary' WHEN 6 THEN 'tertiary' WHEN 7 THEN 'unclassified'
                    WHEN 8 THEN 'residential' WHEN 9 THEN 'service' WHEN 10 THEN 'living_street' WHEN 11 THEN 'footway'
                    WHEN 12 THEN 'construction' WHEN 13 THEN 'cycleway' END AS highway,
               CASE WHEN o_orderkey % 16 = 12 THEN CASE o_orderkey % 3 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary'
                    ELSE 'residential' END END AS construction,
               CASE WHEN o_orderkey % 16 = 14 THEN CASE o_orderkey % 3 WHEN 0 THEN 'rail' WHEN 1 THEN 'light_rail' ELSE 'subway' END
                    WHEN o_orderkey % 16 = 8 AND o_orderkey % 5 = 0 THEN 'tram' END AS railway,
               CASE WHEN o_orderkey % 16 = 15 THEN 'ferry' END AS route,
               CASE o_orderkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS oneway,
               CASE WHEN o_orderkey % 11 = 0 THEN 'roundabout' END AS junction,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 5 AS VARCHAR(10)) END AS lanes,
               CASE WHEN o_orderkey % 5 < 2 THEN NULL ELSE CAST(30 + 10 * (o_orderkey % 11) AS VARCHAR(10)) END AS maxspeed,
               CASE o_orderkey % 23 WHEN 0 THEN 'private' WHEN 1 THEN 'yes' END AS access,
               CASE WHEN o_orderkey % 29 = 0 THEN 'yes' END AS area,
               CASE o_orderkey % 17 WHEN 0 THEN 'yard' WHEN 1 THEN 'main' END AS service,
               CASE WHEN o_orderkey % 19 = 0 THEN 'yes' END AS disused,
               CASE o_orderkey % 7 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'designated' END AS foot,
               CASE o_orderkey % 9 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END AS bicycle,
               CASE WHEN o_orderkey % 6 = 0 THEN 'no' END AS hgv,
               CASE WHEN o_orderkey % 10 = 5 THEN 'no' END AS car,
               CASE o_orderkey % 6 WHEN 0 THEN 'asphalt' WHEN 1 THEN 'gravel' WHEN 2 THEN 'dirt' END AS surface,
               CASE o_orderkey % 21 WHEN 0 THEN 'yes' WHEN 1 THEN 'viaduct' END AS bridge,
               CASE WHEN o_orderkey % 22 = 0 THEN 'yes' END AS tunnel,
               CASE WHEN o_orderkey % 4 <> 0 THEN concat('Street ', CAST(o_orderkey % 97 AS VARCHAR(10))) END AS name,
               concat('R', CAST(o_orderkey % 31 AS VARCHAR(10))) AS ref,
               CASE WHEN o_orderkey % 14 = 0 THEN '1' END AS layer,
               CASE WHEN o_orderkey % 15 = 0 THEN '2' END AS level,
               CASE o_orderkey % 12 WHEN 0 THEN 'lane' WHEN 1 THEN 'opposite' END AS cycleway,
               CASE WHEN o_orderkey % 13 = 0 THEN 'both' END AS sidewalk,
               CASE WHEN o_orderkey % 18 = 0 THEN '2' END AS tracks
        FROM {orders}""",
    "extract_a": """
        SELECT 'way' AS kind, o_orderkey AS id, 1 AS version, o_orderstatus AS payload
        FROM {orders} WHERE o_orderpriority <> '5-LOW'""",
    "extract_b": """
        SELECT 'way' AS kind, o_orderkey AS id, 2 AS version, o_orderpriority AS payload
        FROM {orders} WHERE o_orderpriority <> '1-URGENT'""",
    "tier_zones": f"""
        SELECT s_suppkey AS no, s_name AS name, CAST(s_suppkey % 5 AS INT) AS type_no,
               {_hash_xy('s_suppkey', 100003, 99991, 'supplier')}
        FROM {{supplier}}""",
    "cells": """
        SELECT CAST(cx * 1000 + cy AS BIGINT) AS cell_id, CAST(cx * 4500 AS DOUBLE) AS xmin, CAST((cx + 1) * 4500 AS DOUBLE) AS xmax,
               CAST(cy * 4500 AS DOUBLE) AS ymin, CAST((cy + 1) * 4500 AS DOUBLE) AS ymax
        FROM (SELECT DISTINCT CAST(floor(x / 4500) AS BIGINT) AS cx, CAST(floor(y / 4500) AS BIGINT) AS cy FROM {nodes}) g""",
    "blocks": """
        SELECT node_id AS block_id, x AS xmin, x + 200 + 40 * (node_id % 50) AS xmax, y AS ymin, y + 300 + 30 * (node_id % 70) AS ymax
        FROM {nodes}""",
    "regions": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS parent,
               CAST((n_nationkey % 5) * 60000 AS DOUBLE) AS xmin, CAST((n_nationkey % 5 + 1) * 60000 AS DOUBLE) AS xmax,
               CAST(floor(n_nationkey / 5) * 60000 AS DOUBLE) AS ymin,
               CAST((floor(n_nationkey / 5) + 1) * 60000 AS DOUBLE) AS ymax
        FROM {nation}""",
    "cell_actions": """
        SELECT event_id AS seq, user_id AS cell_id,
               CASE event_type WHEN 'click' THEN 'PA' WHEN 'view' THEN 'IA1' ELSE 'IA2' END AS mode
        FROM {events}""",
}

_NAME = re.compile(r"\{([a-z]\w*)\}")


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(text)))


class Views:
    """The views of one data folder as lazily built DataFrames: `Views(spark, folder).places`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in TABLES):
            raise AttributeError(name)
        if name not in self._frames:
            if name in TABLES:
                self._frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                self._frames[name] = self.sql(VIEWS[name])
        return self._frames[name]

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Run Spark SQL where `{name}` stands for a view, a table or one of `frames`."""
        return self.spark.sql(text, **{n: frames[n] if n in frames else getattr(self, n) for n in _needs(text)})


def check_sql(body: str) -> str:
    """The checking side's text: `body` with each `{view}` defined as a common table expression."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _needs(text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(body)
    plain = lambda text: _NAME.sub(r"\1", text)
    head = ", ".join(f"{name} AS ({plain(VIEWS[name])})" for name in order)
    body = plain(body).strip()
    if not head:
        return body
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {head}, " + re.sub(r"(?i)^with\s+recursive\s+", "", body)
    if re.match(r"(?i)with\b", body):
        return f"WITH {head}, " + re.sub(r"(?i)^with\s+", "", body)
    return f"WITH {head} {body}"
