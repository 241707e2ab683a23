"""Deterministic geographic views over the driver's tables, which have no geometry of their own.

Each view is one SQL text that Spark and DuckDB read alike, so that a query and its oracle start from equal rows. Only
the row generator differs (`{n}` rows numbered i)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SIDE, PITCH, X0, Y0, HEIGHT = 81, 25, 200000, 545000, 250
SPIKE = SIDE * SIDE  # one more node, steep enough to be clipped

_height = f"30 + {HEIGHT} * exp(-(({{x}} - {X0 + 1300}) * ({{x}} - {X0 + 1300}) + ({{y}} - {Y0 + 1200}) * ({{y}} - {Y0 + 1200})) / 320000.0)"


def _div(a: str, b: int) -> str:
    return f"CAST(floor({a} / {b}) AS BIGINT)"


def _grown(least: int, wide: int) -> str:
    """Numbers 0 to least, and on to a tenth of the orders, in whole rows of so many."""
    return f"SELECT CAST(i AS BIGINT) AS i FROM {{rows:{least}}} r UNION ALL SELECT o_orderkey AS i FROM orders WHERE o_orderkey >= {least} AND o_orderkey < (SELECT CAST(floor(count(*) / {10 * wide}) AS BIGINT) * {wide} FROM orders)"


def _id(i: str) -> str:
    """The node at a place of the grid; one number is the spike's."""
    return f"CAST({i} + CASE WHEN {i} >= {SPIKE} THEN 1 ELSE 0 END AS BIGINT)"


_node = f"SELECT {_id('i')} AS node_id, CAST({X0} + {PITCH} * {_div('i', SIDE)} AS DOUBLE) AS x, CAST({Y0} + {PITCH} * (i % {SIDE}) AS DOUBLE) AS y FROM grid"
_links = f"""SELECT {_id('i')} AS u, {_id(f'(i + {SIDE})')} AS v FROM grid WHERE i + {SIDE} < (SELECT count(*) FROM grid)
 UNION ALL SELECT {_id('i')} AS u, {_id('(i + 1)')} AS v FROM grid WHERE i % {SIDE} < {SIDE - 1}
 UNION ALL SELECT CAST(0 AS BIGINT) AS u, CAST({SPIKE} AS BIGINT) AS v"""
_columns = f"(SELECT count(*) FROM grid WHERE i >= {SPIKE} AND i % {SIDE} = 0)"


def _spread(key: str, p: int, q: int, dx: int, dy: int, mx: int, my: int) -> str:
    return f"CAST({X0 + dx} + ({key} * {p}) % {mx} AS DOUBLE) AS x, CAST({Y0 + dy} + ({key} * {q}) % {my} AS DOUBLE) AS y"


_use = "CASE c_mktsegment WHEN 'BUILDING' THEN 'BDU001' WHEN 'HOUSEHOLD' THEN 'BDU002' WHEN 'AUTOMOBILE' THEN 'BDU003' WHEN 'MACHINERY' THEN 'BDU009' ELSE 'BDU011' END"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    # name: (views or tables below it, SQL)
    # streets of 81 nodes, at least as many as nodes in them, more with the tables; pixels of a hill likewise
    "grid": (("orders",), _grown(SPIKE, SIDE)),
    "hill": (("orders",), _grown(1600, 40)),
    "nodes": (("grid",), f"SELECT node_id, x, y, {_height.format(x='x', y='y')} AS z FROM ({_node}) n UNION ALL SELECT CAST({SPIKE} AS BIGINT), CAST({X0 - PITCH} AS DOUBLE), CAST({Y0} AS DOUBLE), CAST(50 AS DOUBLE)"),
    "links": (("grid",), f"SELECT u, v, CAST({PITCH} AS DOUBLE) AS length, (u * 7 + v * 3) % 23 = 0 AS is_stair, (u * 5 + v) % 29 = 0 AS flat FROM ({_links}) l"),
    "buildings": (("customer",), f"SELECT c_custkey AS id, {_spread('c_custkey', 7919, 104729, 500, 500, 997, 991)}, {_use} AS use_code, CAST(1 + c_custkey % 5 AS DOUBLE) AS floors, CAST(144 AS DOUBLE) AS area FROM customer"),
    "homes": (("buildings",), "SELECT id, x, y, floors, area, floors * area AS weight FROM buildings WHERE use_code IN ('BDU001', 'BDU002')"),
    # homes with a made-up index, for roll-ups that need no shortest paths
    "scored": (("homes",), """SELECT id, x, y, weight, CASE WHEN id % 17 = 0 THEN NULL ELSE t_flat * (1 + CAST((id * 37) % 101 AS DOUBLE) / 90) END AS t_elder, t_flat,
 CASE WHEN id % 17 = 0 THEN NULL ELSE 1 + CAST((id * 37) % 101 AS DOUBLE) / 90 END AS hbi, CASE WHEN id % 13 = 0 THEN NULL ELSE t_flat * 2 END AS t_wheel, 'medical' AS target FROM (SELECT *, CAST(300 + (id * 53) % 907 AS DOUBLE) AS t_flat FROM homes) h"""),
    "lines": (("grid",), f"""SELECT CAST(i AS BIGINT) AS line_id, CAST({X0 - 50} AS DOUBLE) AS ax, CAST({Y0} + 200 * i AS DOUBLE) AS ay, CAST({X0 + 2050} + 250 * {_columns} AS DOUBLE) AS bx, CAST({Y0} + 200 * i AS DOUBLE) AS by_ FROM {{rows:9}} a
 UNION ALL SELECT CAST(100 + k AS BIGINT), CAST({X0} + 250 * k AS DOUBLE), CAST({Y0 - 50} AS DOUBLE), CAST({X0} + 250 * k AS DOUBLE), CAST({Y0 + 1650} AS DOUBLE) FROM (SELECT i AS k FROM {{rows:7}} b UNION ALL SELECT 7 + {_div(f'(i - {SPIKE})', SIDE)} AS k FROM grid WHERE i >= {SPIKE} AND i % {SIDE} = 0) c"""),
    "torn": (("links",), "SELECT u, v, length, is_stair, flat FROM links WHERE (u * 3 + v) % 7 > 2"),
    "homes_wide": (("customer",), f"SELECT c_custkey AS id, {_spread('c_custkey', 7919, 104729, 0, 0, 1979, 1973)} FROM customer"),
    "dests": (("supplier",), f"SELECT s_suppkey AS id, {_spread('s_suppkey', 6151, 3079, 0, 0, 1993, 1987)}, CASE s_nationkey % 4 WHEN 0 THEN 'medical' WHEN 1 THEN 'bus' WHEN 2 THEN 'elderly' ELSE 'station' END AS target FROM supplier"),
    # a few far destinations on one side, so that trips cross the hill
    "hubs": (("region",), f"SELECT CAST(r_regionkey AS BIGINT) AS id, CAST({X0 + 20} AS DOUBLE) AS x, CAST({Y0 + 200} + 350 * r_regionkey AS DOUBLE) AS y, 'hub' AS target FROM region"),
    # a street grid of as many nodes as there are orders, over hills: it grows with the tables
    "town": (("orders",), "SELECT o_orderkey AS node_id, CAST(floor(sqrt(CAST((SELECT count(*) FROM orders) AS DOUBLE))) AS BIGINT) AS side FROM orders"),
    "town_nodes": (("town",), f"SELECT node_id, x, y, 120 + 70 * sin((x - {X0}) / 300) + 45 * cos((y - {Y0}) / 230) AS z FROM (SELECT node_id, CAST({X0} + {PITCH} * CAST(floor(node_id / side) AS BIGINT) AS DOUBLE) AS x, CAST({Y0} + {PITCH} * (node_id % side) AS DOUBLE) AS y FROM town WHERE node_id < side * side) t"),
    "town_links": (("town",), f"""SELECT u, v, CAST({PITCH} AS DOUBLE) AS length, (u * 7 + v * 3) % 23 = 0 AS is_stair, (u * 5 + v) % 29 = 0 AS flat FROM (
 SELECT node_id AS u, node_id + side AS v FROM town WHERE node_id < side * (side - 1) UNION ALL SELECT node_id AS u, node_id + 1 AS v FROM town WHERE node_id < side * side AND node_id % side < side - 1) l"""),
    "town_homes": (("customer", "town"), f"SELECT c_custkey AS id, CAST({X0} + (c_custkey * 7919) % ({PITCH} * side) AS DOUBLE) AS x, CAST({Y0} + (c_custkey * 104729) % ({PITCH} * side) AS DOUBLE) AS y, CAST(144 * (1 + c_custkey % 5) AS DOUBLE) AS weight FROM customer CROSS JOIN (SELECT DISTINCT side FROM town) t"),
    "town_dests": (("supplier", "town"), f"SELECT s_suppkey AS id, CAST({X0} + (s_suppkey * 6151) % ({PITCH} * side) AS DOUBLE) AS x, CAST({Y0} + (s_suppkey * 3079) % ({PITCH} * side) AS DOUBLE) AS y, CASE s_nationkey % 8 WHEN 0 THEN 'medical' ELSE 'shop' END AS target FROM supplier CROSS JOIN (SELECT DISTINCT side FROM town) t"),
    "points": (("events",), f"SELECT event_id AS id, {_spread('(user_id * 31 + event_id)', 613, 1103, 300, 300, 1409, 1423)}, value, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS period, event_type, props FROM events"),
    "zones": (("nation", "region"), f"""SELECT '11110' || lpad(CAST(n_nationkey AS VARCHAR(8)), 5, '0') AS adm_cd, '1101' || lpad(CAST(n_nationkey AS VARCHAR(8)), 4, '0') AS adm_cd_stat, n_name AS adm_nm, r_name AS gu,
 CAST({X0} + 400 * (n_nationkey % 5) AS DOUBLE) AS x0, CAST({Y0} + 400 * {_div('n_nationkey', 5)} AS DOUBLE) AS y0, CAST({X0} + 400 * (n_nationkey % 5 + 1) AS DOUBLE) AS x1, CAST({Y0} + 400 * ({_div('n_nationkey', 5)} + 1) AS DOUBLE) AS y1
 FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "parcels": (("part",), f"""SELECT 'P' || CAST(p_partkey AS VARCHAR(20)) AS pnu, CAST({X0} + 50 * (p_partkey % 40) AS DOUBLE) AS x0, CAST({Y0} + 50 * ({_div('p_partkey', 40)} % 40) AS DOUBLE) AS y0,
 CASE p_size % 7 WHEN 0 THEN '도' WHEN 1 THEN '공원' WHEN 2 THEN '임' WHEN 3 THEN '기' ELSE '대' END AS jimok, p_brand AS emd_cd, 'GU ' || substring(p_brand, 7, 1) AS sgg_nm, '제' || substring(p_brand, 7, 2) || ' dong' AS emd_nm FROM part"""),
    "codetab": (("lineitem",), "SELECT '11110' || lpad(CAST(l_suppkey % 25 AS VARCHAR(8)), 5, '0') || '-x' AS code, l_quantity, l_tax, l_extendedprice, l_returnflag, CAST(l_shipdate AS DATE) AS day FROM lineitem"),
}


def _rows(sql: str, spark: bool) -> str:
    return re.sub(r"\{rows:(\d+)\}", r"(SELECT id AS i FROM range(\1))" if spark else r"(SELECT range AS i FROM range(\1))", sql)


def _below(names: tuple[str, ...]) -> list[str]:
    found: list[str] = []
    for n in names:
        if n in VIEWS:
            found += [x for x in _below(VIEWS[n][0]) if x not in found]
            found += [] if n in found else [n]
    return found


def ctes(*names: str) -> str:
    """The views and what they need, as the inside of DuckDB's WITH."""
    return ",\n".join(f"{n} AS ({_rows(VIEWS[n][1], False)})" for n in _below(names))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables in sf_dir."""
    frames: dict[str, DataFrame] = {}
    for n in _below((name,)):
        below, sql = VIEWS[n]
        sql = _rows(sql, True)
        for b in below:
            if b not in frames:
                frames[b] = spark.read.parquet(f"{sf_dir}/{b}.parquet")
            sql = re.sub(rf"\b{b}\b(?=\s|$|\))(?<!\.)", f"{{{b}}}", sql)
        frames[n] = spark.sql(sql, **{b: frames[b] for b in below}) if below else spark.sql(sql)
    return frames[name]
