"""Queries over layers made from the driver's tables: predicates, shapes, lookups, reports, and files written and read back."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.config import CODES
from gradewalk.functions import cost, geo, text
from gradewalk.operators import hbi, joins, network, paths, preview, report, shapes, spatial, stats, union, whatif
from gradewalk.operators.tables import save, shared_dir
from gradewalk.plans.oracles import COSTS, EDGES, FULL, NET, ZONE_HOMES, both_ways, edge_rows, elder, gridded, interventions, q, rank, search
from gradewalk.plans.queries import _reached, _scored, zoned
from gradewalk.plans.registry import query, table
from gradewalk.plans.synth import SIDE, X0, Y0, ctes, view
from gradewalk.sources import files, sinks, stores, tables, vector

# predicates and filters


@query("""SELECT c_custkey, use IN ('BDU001', 'BDU002') OR (NOT starts_with(use, 'BDU') AND kind IN ('BDC001', 'BDC002', 'BDC003')) AS is_home, use = 'BDU009' AS is_medical, use = 'BDU011' AS is_elderly
 FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'BDU001' WHEN 1 THEN 'BDU002' WHEN 2 THEN 'BDU009' WHEN 3 THEN 'BDU011' WHEN 4 THEN '' ELSE 'X' END AS use, CASE c_nationkey % 4 WHEN 0 THEN '' ELSE 'BDC00' || CAST(c_nationkey % 5 AS VARCHAR) END AS kind FROM customer)""")
def building_predicates(spark, d):
    """Homes, clinics and homes for the elderly among buildings, by codes in any case."""
    k, n = F.col("c_custkey") % 6, F.col("c_nationkey")
    use = F.when(k == 0, "bdu001").when(k == 1, "BDU002").when(k == 2, "bdu009").when(k == 3, "BDU011").when(k == 5, "x")
    kind = F.when(n % 4 != 0, F.concat(F.lit("bdc00"), (n % 5).cast("string")))
    code = F.upper(F.coalesce(use, F.lit("")))
    return table(spark, d, "customer").select("c_custkey", text.is_home(use, kind, CODES.residential_use, CODES.residential_kind).alias("is_home"), code.isin(*CODES.medical_use).alias("is_medical"), code.isin(*CODES.elderly_use).alias("is_elderly"))


@query("""SELECT s_suppkey FROM supplier WHERE s_nationkey % 3 < 2 AND s_suppkey % 6 NOT IN (1, 2, 3, 4)""")
def city_places_open(spark, d):
    """Places of the city that are not closed, paused, cancelled or struck off."""
    k, n = F.col("s_suppkey") % 6, F.col("s_nationkey") % 3
    address = F.when(n == 0, "서울특별시 중구 1").when(n == 1, "서울 종로구 2").otherwise("부산광역시 3")
    status = F.when(k == 0, "영업/정상").when(k == 1, "폐업").when(k == 2, "휴업").when(k == 3, "취소/말소").when(k == 4, "말소")
    return tables.open_places(table(spark, d, "supplier").withColumn("a", address).withColumn("s", status), "a", "s").select("s_suppkey")


_NODES = "n AS (SELECT 'S' || CAST(s_nationkey AS VARCHAR) AS name, CAST(s_suppkey // 25 % 3 AS VARCHAR) AS code, CAST(126 + s_suppkey / CAST(1000 AS DOUBLE) AS DOUBLE) AS lon, CAST(37 + s_nationkey / CAST(100 AS DOUBLE) AS DOUBLE) AS lat FROM supplier)"


@query(f"WITH {_NODES}, o AS (SELECT *, max(CAST(code = '1' AS INT)) OVER (PARTITION BY name) AS one FROM n) SELECT name, round(lon, 6) AS lon, round(lat, 6) AS lat FROM o WHERE code = '1' OR (code = '0' AND one = 0)")
def station_nodes(spark, d):
    """A station's chosen nodes, and their coordinates from WKT points."""
    s = table(spark, d, "supplier")
    wkt = F.format_string("POINT (%s %s)", (126 + F.col("s_suppkey") / 1000).cast("string"), (37 + F.col("s_nationkey") / 100).cast("string"))
    rows = s.select(F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("name"), F.expr("s_suppkey div 25 % 3").alias("kind"), wkt.alias("wkt"))
    return tables.station_nodes(rows, "name", "kind", "wkt")


_PAIRS = "p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(200000 + o_custkey % 2000 AS DOUBLE) END AS ox, CAST(545000 + o_orderkey % 2000 AS DOUBLE) AS oy, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(200000 + o_orderkey * 7 % 2000 AS DOUBLE) END AS dx, CAST(545000 + o_custkey * 3 % 2000 AS DOUBLE) AS dy FROM orders)"


def _pairs(spark, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    at = lambda base, v: (base + v % 2000).cast("double")
    return table(spark, d, "orders").select(k.alias("id"), F.when(k % 7 != 0, at(200000, c)).alias("ox"), at(545000, k).alias("oy"), F.when(k % 11 != 0, at(200000, k * 7)).alias("dx"), at(545000, c * 3).alias("dy"))


@query(f"WITH {_PAIRS} SELECT id FROM p WHERE ox IS NOT NULL AND dx IS NOT NULL")
def complete_pairs(spark, d):
    return joins.complete_rows(_pairs(spark, d), ["ox", "oy", "dx", "dy"]).select("id")


@query(f"WITH {_PAIRS} SELECT id FROM p WHERE least(ox, dx) >= 200500 AND greatest(ox, dx) <= 201500 AND least(oy, dy) >= 545500 AND greatest(oy, dy) <= 546500 AND ox IS NOT NULL AND dx IS NOT NULL")
def inner_pairs(spark, d):
    """Routes whose both ends lie well inside the zone."""
    return joins.inner_routes(_pairs(spark, d), (200000.0, 545000.0, 202000.0, 547000.0)).select("id")


@query("SELECT p_partkey, p_size % 5 <> 4 AS is_stair FROM part")
def stair_kinds(spark, d):
    k = F.col("p_size") % 5
    kind = F.when(k == 0, "pgs001").when(k == 1, "None").when(k == 2, "").when(k == 4, "PGS002")
    return table(spark, d, "part").select("p_partkey", network.is_stair_kind(kind).alias("is_stair"))


# shapes


def _ring(*corners: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])


def _ell(x: Column, y: Column, s: Column) -> Column:
    """An L with arms of 6 and a width of 2, times s."""
    return _ring(*[(x + a * s, y + b * s) for a, b in ((0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6), (0, 0))])


@query("SELECT c_custkey, round(20 * s * s - CASE WHEN c_custkey % 2 = 0 THEN s * s ELSE 0 END, 6) AS area, round(x + s, 6) AS px, round(y + 3 * s, 6) AS py FROM (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) * 100 AS x, CAST(c_custkey % 977 AS DOUBLE) AS y, 1 + c_custkey % 9 / CAST(4 AS DOUBLE) AS s FROM customer)")
def concave_shapes(spark, d):
    """Areas of L-shaped polygons, half of them with a hole, and a point inside each."""
    x, y, s = F.col("c_nationkey").cast("double") * 100, (F.col("c_custkey") % 977).cast("double"), 1 + F.col("c_custkey") % 9 / 4
    hole = _ring((x + s * 0.5, y + s * 0.5), (x + s * 1.5, y + s * 0.5), (x + s * 1.5, y + s * 1.5), (x + s * 0.5, y + s * 1.5))
    outer = _ell(x, y, s)
    rings = F.when(F.col("c_custkey") % 2 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    p = geo.interior_point(outer)
    return table(spark, d, "customer").select("c_custkey", geo.polygon_area(rings).alias("area"), p["x"].alias("px"), p["y"].alias("py"))


_INSIDE = "(px BETWEEN 0 AND 6 AND py BETWEEN 0 AND 2) OR (px BETWEEN 0 AND 2 AND py BETWEEN 0 AND 6)"


@query(f"SELECT o_orderkey, ({_INSIDE}) AND NOT (px BETWEEN 0.5 AND 1.5 AND py BETWEEN 0.5 AND 1.5) AS inside FROM (SELECT o_orderkey, o_orderkey % 83 / CAST(10 AS DOUBLE) - 1.03 AS px, o_custkey % 79 / CAST(10 AS DOUBLE) - 1.07 AS py FROM orders)")
def points_in_concave(spark, d):
    """Points in an L-shaped polygon with a hole, by the even-odd rule."""
    zero, one = F.lit(0.0), F.lit(1.0)
    hole = _ring(*[(F.lit(a), F.lit(b)) for a, b in ((0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5))])
    px, py = F.col("o_orderkey") % 83 / 10 - 1.03, F.col("o_custkey") % 79 / 10 - 1.07
    return table(spark, d, "orders").select("o_orderkey", geo.in_rings(px, py, F.array(_ell(zero, zero, one), hole)).alias("inside"))


_TURNED = "(SELECT c_custkey, CAST(c_custkey % 991 AS DOUBLE) AS x, CAST(c_nationkey * 40 AS DOUBLE) AS y, 12 + c_custkey % 8 AS len, 2 + c_custkey % 3 AS wide, (c_custkey % 17 - 8) * pi() / 18 AS t FROM customer)"


def _turned(spark, d) -> DataFrame:
    """Rectangles in all directions: ring, centre x, y, len, wide, t."""
    k = F.col("c_custkey")
    base = table(spark, d, "customer").select("c_custkey", (k % 991).cast("double").alias("x"), (F.col("c_nationkey") * 40).cast("double").alias("y"), (12 + k % 8).cast("double").alias("len"), (2 + k % 3).cast("double").alias("wide"), ((k % 17 - 8) * F.pi() / 18).alias("t"))
    corner = lambda a, b: (F.col("x") + a * F.col("len") / 2 * F.cos("t") - b * F.col("wide") / 2 * F.sin("t"), F.col("y") + a * F.col("len") / 2 * F.sin("t") + b * F.col("wide") / 2 * F.cos("t"))
    return base.withColumn("ring", _ring(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)))


_ENDS = "round(least(x - len / 2.0 * cos(t), x + len / 2.0 * cos(t)), 4) AS ax, round(greatest(x - len / 2.0 * cos(t), x + len / 2.0 * cos(t)), 4) AS bx, round(least(y - len / 2.0 * sin(t), y + len / 2.0 * sin(t)), 4) AS ay, round(greatest(y - len / 2.0 * sin(t), y + len / 2.0 * sin(t)), 4) AS by_"


def _ends(rows: DataFrame, axis: Column) -> DataFrame:
    both = lambda f, c: F.round(f(F.col(f"a.a{c}"), F.col(f"a.b{c}")), 4)
    return rows.select("c_custkey", axis.alias("a")).select("c_custkey", both(F.least, "x").alias("ax"), both(F.greatest, "x").alias("bx"), both(F.least, "y").alias("ay"), both(F.greatest, "y").alias("by_"))


@query(f"SELECT c_custkey, {_ENDS} FROM {_TURNED}")
def stair_axes(spark, d):
    """Ends of the main axis of stairs' outlines."""
    return _ends(_turned(spark, d), geo.principal_axis(F.col("ring")))


@query(f"SELECT c_custkey, {_ENDS} FROM {_TURNED}")
def stair_boxes(spark, d):
    """Middles of the short sides of the least rectangle around stairs' outlines."""
    return _ends(_turned(spark, d), geo.box_axis(F.col("ring")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '0/20' ELSE '0/10/20' END AS kept FROM customer")
def simplified_lines(spark, d):
    """Zigzag lines, flat or with one bend, of which only ends and bends stay."""
    k = F.col("c_custkey")
    line = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct((i * 10).cast("double").alias("x"), (F.least(i, 20 - i) * 10 * (k % 3) + F.when(i % 2 == 1, 0.5).otherwise(0.0)).cast("double").alias("y")))
    rows = table(spark, d, "customer").select("c_custkey", F.array(line).alias("rings")).select("c_custkey", shapes.simplify(F.col("rings"), 12.0).alias("r"))
    return rows.select("c_custkey", F.array_join(F.transform(F.col("r")[0], lambda p: (p["x"] / 10).cast("int").cast("string")), "/").alias("kept"))


@query("SELECT o_orderkey, CASE WHEN a < 22.5 OR a >= 337.5 THEN 'N' WHEN a < 67.5 THEN 'NE' WHEN a < 112.5 THEN 'E' WHEN a < 157.5 THEN 'SE' WHEN a < 202.5 THEN 'S' WHEN a < 247.5 THEN 'SW' WHEN a < 292.5 THEN 'W' ELSE 'NW' END AS way FROM (SELECT o_orderkey, (degrees(atan2(o_custkey % 37 - 18.2, o_orderkey % 41 - 20.1)) + 360) - 360 * floor((degrees(atan2(o_custkey % 37 - 18.2, o_orderkey % 41 - 20.1)) + 360) / 360) AS a FROM orders)")
def compass_labels(spark, d):
    return table(spark, d, "orders").select("o_orderkey", geo.compass(F.col("o_custkey") % 37 - 18.2, F.col("o_orderkey") % 41 - 20.1).alias("way"))


@query("SELECT c_custkey, part, n, CAST(c_nationkey + part * 10 + n AS DOUBLE) AS x, c_custkey / CAST(8 AS DOUBLE) - n AS y FROM customer, (SELECT unnest([0, 1]) AS part), (SELECT unnest([0, 1, 2]) AS n)")
def wkt_points(spark, d):
    """Vertices of multi-line WKT texts, part by part."""
    point = lambda p, n: F.concat_ws(" ", (F.col("c_nationkey") + p * 10 + n).cast("string"), (F.col("c_custkey") / 8 - n).cast("string"))
    line = lambda p: F.concat(F.lit("("), F.concat_ws(", ", *[point(p, n) for n in range(3)]), F.lit(")"))
    wkt = F.concat(F.lit("MULTILINESTRING ("), line(0), F.lit(","), line(1), F.lit(")"))
    rows = table(spark, d, "customer").select("c_custkey", geo.parse_points(wkt).alias("parts"))
    each = rows.select("c_custkey", F.posexplode("parts").alias("part", "points")).select("c_custkey", "part", F.posexplode("points").alias("n", "p"))
    return each.select("c_custkey", "part", "n", "p.x", "p.y")


@query("""WITH g AS (SELECT c_custkey, 126.9 + c_custkey % 997 / CAST(5000 AS DOUBLE) AS lon, 37.4 + c_nationkey / CAST(100 AS DOUBLE) AS lat, 6378137.0::DOUBLE AS a, 1 / 298.257222101::DOUBLE AS f FROM customer),
e AS (SELECT *, 2 * f - f * f AS e2, radians(lat) AS p, radians(lon - 127) AS l FROM g),
m AS (SELECT *, e2 / (1 - e2) AS ep2, a / sqrt(1 - e2 * sin(p) * sin(p)) AS n, tan(p) * tan(p) AS t, e2 / (1 - e2) * cos(p) * cos(p) AS c, l * cos(p) AS w FROM e),
s AS (SELECT *, a * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 * e2 * e2 / 256) * p - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * e2 * e2 * e2 / 1024) * sin(2 * p) + (15 * e2 * e2 / 256 + 45 * e2 * e2 * e2 / 1024) * sin(4 * p) - (35 * e2 * e2 * e2 / 3072) * sin(6 * p)) AS arc,
 a * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 * e2 * e2 / 256) * radians(38) - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * e2 * e2 * e2 / 1024) * sin(2 * radians(38)) + (15 * e2 * e2 / 256 + 45 * e2 * e2 * e2 / 1024) * sin(4 * radians(38)) - (35 * e2 * e2 * e2 / 3072) * sin(6 * radians(38))) AS arc0 FROM m)
SELECT c_custkey, round(200000 + n * (w + (1 - t + c) * pow(w, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * pow(w, 5) / 120), 3) AS x,
 round(600000 + arc - arc0 + n * tan(p) * (w * w / 2 + (5 - t + 9 * c + 4 * c * c) * pow(w, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * pow(w, 6) / 720), 3) AS y FROM s""")
def projected_points(spark, d):
    """Degrees to the working projection, against the published series written out in SQL."""
    lon, lat = 126.9 + F.col("c_custkey") % 997 / 5000, 37.4 + F.col("c_nationkey") / 100
    x, y = geo.project(lon, lat, 4326, 5186)
    return table(spark, d, "customer").select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("""WITH p AS (SELECT event_id AS id, CAST(user_id * 7 % 400 AS DOUBLE) * 5 + CAST(event_id % 7 AS DOUBLE) * 0.3 AS x, CAST(event_id % 97 AS DOUBLE) * 5 AS y FROM events),
g AS (SELECT *, x - l_x > 1 OR l_x IS NULL AS new FROM (SELECT id, x, y, lag(x) OVER (PARTITION BY y ORDER BY x, id) AS l_x FROM p)),
c AS (SELECT id, y, sum(CAST(new AS INT)) OVER (PARTITION BY y ORDER BY x, id) AS chain FROM g)
SELECT id, min(id) OVER (PARTITION BY y, chain) AS node FROM c""")
def nodes_within(spark, d):
    """Points joined by chains of at most a metre (rows of points on lines 5 m apart)."""
    k = F.col("event_id")
    rows = table(spark, d, "events").select(k.alias("id"), ((F.col("user_id") * 7 % 400).cast("double") * 5 + (k % 7).cast("double") * 0.3).alias("x"), ((k % 97).cast("double") * 5).alias("y"))
    return network.merge_within(rows, "id", 1.0 + 1e-9)


_STAIRS = f"st AS (SELECT s_suppkey AS id, CAST({X0} + s_suppkey * 37 % 1900 + 40 AS DOUBLE) AS cx, CAST({Y0} + s_suppkey * 53 % 1900 + 40 AS DOUBLE) AS cy FROM supplier)"


@query(q(("nodes",), """SELECT u, v, round(40 + du + dv, 6) AS length, cx AS xm, cy AS ym FROM (SELECT id, cx, cy, arg_min(a.node_id, (round(da, 9), a.node_id)) AS u, min(da) AS du FROM (SELECT st.*, n.node_id, sqrt((n.x - cx + 20) * (n.x - cx + 20) + (n.y - cy) * (n.y - cy)) AS da FROM st JOIN nodes n ON n.x BETWEEN cx - 36 AND cx - 4 AND n.y BETWEEN cy - 16 AND cy + 16) a WHERE da <= 15 GROUP BY ALL)
 JOIN (SELECT id, arg_min(b.node_id, (round(db, 9), b.node_id)) AS v, min(db) AS dv FROM (SELECT st.*, n.node_id, sqrt((n.x - cx - 20) * (n.x - cx - 20) + (n.y - cy) * (n.y - cy)) AS db FROM st JOIN nodes n ON n.x BETWEEN cx + 4 AND cx + 36 AND n.y BETWEEN cy - 16 AND cy + 16) b WHERE db <= 15 GROUP BY ALL) USING (id) WHERE u <> v""", _STAIRS))
def stair_connectors(spark, d):
    """Links through stairs of 40 m that no street crosses, between nodes near both their ends."""
    k = F.col("s_suppkey")
    cx, cy = (X0 + k * 37 % 1900 + 40).cast("double"), (Y0 + k * 53 % 1900 + 40).cast("double")
    ring = _ring((cx - 20, cy - 2), (cx + 20, cy - 2), (cx + 20, cy + 2), (cx - 20, cy + 2))
    return network.stair_connectors(table(spark, d, "supplier").select(k.alias("ordinal"), ring.alias("ring")), view(spark, d, "nodes")).select("u", "v", "length", F.round("xm", 3).alias("xm"), F.round("ym", 3).alias("ym"))


_CROSS = "a AS (SELECT n_nationkey AS line_id, CAST(10 * n_nationkey AS DOUBLE) AS c FROM nation), b AS (SELECT 100 + r_regionkey AS line_id, CAST(903 + 47 * r_regionkey AS DOUBLE) AS e FROM region), k AS (SELECT a.line_id AS la, b.line_id AS lb, (e - c) / 3 AS x FROM a, b), cut AS (SELECT line_id, unnest([0, 600])::DOUBLE AS x FROM (SELECT line_id FROM a UNION ALL SELECT line_id FROM b) UNION SELECT la, x FROM k UNION SELECT lb, x FROM k), pc AS (SELECT line_id, x AS x0, lead(x) OVER (PARTITION BY line_id ORDER BY x) AS x1 FROM cut)"


@query(f"WITH {_CROSS} SELECT line_id, round({X0} + x0, 4) AS x0, round({X0} + x1, 4) AS x1, round({Y0} + coalesce(x0 + c, e - 2 * x0), 4) AS y0, round({Y0} + coalesce(x1 + c, e - 2 * x1), 4) AS y1 FROM pc LEFT JOIN a USING (line_id) LEFT JOIN b USING (line_id) WHERE x1 IS NOT NULL")
def noding_oblique(spark, d):
    """Two families of slanted lines, cut where they cross."""
    point = lambda x, y: F.struct((F.lit(X0) + x).cast("double").alias("x"), (F.lit(Y0) + y).cast("double").alias("y"))
    c, e = F.col("n_nationkey") * 10, 903 + F.col("r_regionkey") * 47
    up = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("line_id"), F.array(point(F.lit(0), c), point(F.lit(600), c + 600)).alias("points"))
    down = table(spark, d, "region").select((100 + F.col("r_regionkey")).cast("long").alias("line_id"), F.array(point(F.lit(0), e), point(F.lit(600), e - 1200)).alias("points"))
    parts = network.node_lines(up.unionAll(down))
    end = lambda k, v: F.round(F.element_at("points", k)[v], 4)
    forward = end(1, "x") <= end(-1, "x")
    pick = lambda k, v: F.when(forward, end(k, v)).otherwise(end(-k, v))
    return parts.select(F.col("line_id").cast("int").alias("line_id"), pick(1, "x").alias("x0"), pick(-1, "x").alias("x1"), pick(1, "y").alias("y0"), pick(-1, "y").alias("y1"))


@query(q(("homes", "zones"), "SELECT id, min(adm_cd) AS adm_cd FROM homes h LEFT JOIN zones z ON (h.x >= z.x0 AND h.x < z.x0 + 399 AND h.y >= z.y0 AND h.y < z.y0 + 133) OR (h.x >= z.x0 AND h.x < z.x0 + 133 AND h.y >= z.y0 AND h.y < z.y0 + 399) GROUP BY id"))
def concave_zones(spark, d):
    """Homes in L-shaped zones, through cells and the even-odd rule."""
    z = view(spark, d, "zones").select("adm_cd", F.array(_ell(F.col("x0"), F.col("y0"), F.lit(66.5))).alias("rings"), "x0", "y0", "x1", "y1")
    found = spatial.in_polygons(view(spark, d, "homes").withColumn("x", F.col("x") + 1e-7).withColumn("y", F.col("y") + 1e-7), "id", z, "adm_cd", spatial.inside_rings(), 100.0)
    return found.select("id", "adm_cd")


# lookups and roll-ups


@query(q(("scored", "zones"), f"""SELECT h.adm_cd, n_bld, round(round_even(CAST(pop AS DOUBLE) * wh / wa, 0), 6) AS elderly_in_high_est FROM (SELECT adm_cd, count(hbi) AS n_bld, sum(weight) AS wa, coalesce(sum(weight) FILTER (hbi >= 1.8), 0) AS wh FROM {ZONE_HOMES.format('scored')} WHERE adm_cd IS NOT NULL GROUP BY ALL HAVING count(hbi) >= 5) h
 LEFT JOIN (SELECT '11110' || lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS adm_cd, 1000 + n_nationkey * 37 AS pop FROM nation WHERE n_nationkey % 4 <> 1) p ON p.adm_cd = h.adm_cd"""))
def district_population(spark, d):
    """Older residents of districts, by the share of homes over the high band."""
    n = F.col("n_nationkey")
    pop = table(spark, d, "nation").filter(n % 4 != 1).select(F.concat(F.lit("11110"), F.lpad(n.cast("string"), 5, "0")).alias("adm_cd"), (1000 + n * 37).cast("long").alias("pop65"))
    return hbi.district(zoned(_scored(spark, d), spark, d), pop).select("adm_cd", "n_bld", "elderly_in_high_est")


@query("SELECT key, arg_min(p_name, p_partkey) AS p_name FROM (SELECT DISTINCT substring(p_name, 2, 1 + p_partkey % 5) AS key FROM part) LEFT JOIN part ON contains(p_name, key) GROUP BY key")
def name_part_match(spark, d):
    """The first part whose name contains a text, for texts of several lengths."""
    p = table(spark, d, "part")
    keys = p.select(F.substr("p_name", F.lit(2), (1 + F.col("p_partkey") % 5).cast("int")).alias("key")).distinct()
    return joins.first_match(keys, p.select("p_name", "p_partkey"), "key", "p_name", "p_partkey")


_STATIONS = "a AS (SELECT 'N' || CAST(s_nationkey AS VARCHAR) || CASE s_suppkey % 3 WHEN 0 THEN '역' WHEN 1 THEN ' (x)' ELSE '' END AS name, 'N' || CAST(s_nationkey AS VARCHAR) AS k, 127 + s_suppkey / CAST(5000 AS DOUBLE) AS lon, 37.5 + s_nationkey / CAST(3000 AS DOUBLE) AS lat FROM supplier), b AS (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS k, 127 + n_nationkey % 9 / CAST(400 AS DOUBLE) AS lon, 37.5 + n_nationkey / CAST(2900 AS DOUBLE) AS lat FROM nation)"


def _met(spark, d) -> DataFrame:
    s, c = table(spark, d, "supplier"), table(spark, d, "nation")
    k = F.col("s_suppkey") % 3
    name = F.concat(F.lit("N"), F.col("s_nationkey").cast("string"), F.when(k == 0, "역").when(k == 1, " (x)").otherwise(""))
    a = s.select(name.alias("name"), (127 + F.col("s_suppkey") / 5000).alias("lon"), (37.5 + F.col("s_nationkey") / 3000).alias("lat"))
    return joins.nearest_named(a, c.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string"), F.lit("역")).alias("name"), (127 + F.col("n_nationkey") % 9 / 400).alias("lon"), (37.5 + F.col("n_nationkey") / 2900).alias("lat")))


_HAV = "2 * 6371000.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"


@query(f"WITH {_STATIONS} SELECT name, round(a.lon, 6) AS lon, round(a.lat, 6) AS lat, round(min({_HAV}), 3) AS d_m FROM a LEFT JOIN b ON a.k = b.k GROUP BY name, a.lon, a.lat")
def namesake_distances(spark, d):
    return _met(spark, d).select("name", "lon", "lat", F.round("d_m", 3).alias("d_m"))


@query(f"WITH {_STATIONS} SELECT name, round(a.lon, 6) AS lon, round(a.lat, 6) AS lat, round(min({_HAV}), 3) AS d_m FROM a JOIN b ON a.k = b.k GROUP BY name, a.lon, a.lat HAVING min({_HAV}) > 500")
def far_namesakes(spark, d):
    return joins.far_namesakes(_met(spark, d)).select("name", "lon", "lat", F.round("d_m", 3).alias("d_m"))


_CELLS = "cl AS (SELECT (gx + 0.5) * CAST(250 AS DOUBLE) AS cell_x, (gy + 0.5) * CAST(250 AS DOUBLE) AS cell_y FROM (SELECT CAST(floor(x / 250) AS BIGINT) AS gx, CAST(floor(y / 250) AS BIGINT) AS gy, count(*) AS n FROM scored WHERE hbi IS NOT NULL GROUP BY ALL) WHERE n >= 5)"


@query(q(("scored", "homes_wide"), """SELECT id, coalesce(c.cell_x, m.cell_x) AS cell_x, coalesce(c.cell_y, m.cell_y) AS cell_y, CASE WHEN c.cell_x IS NOT NULL THEN 'cell' WHEN m.cell_x IS NOT NULL THEN 'nearest' END AS how FROM homes_wide h
 LEFT JOIN cl c ON c.cell_x = (floor(h.x / 250) + 0.5) * 250 AND c.cell_y = (floor(h.y / 250) + 0.5) * 250
 LEFT JOIN (SELECT h.id AS i, arg_min(cl.cell_x, (round(sqrt((h.x - cl.cell_x) * (h.x - cl.cell_x) + (h.y - cl.cell_y) * (h.y - cl.cell_y)), 9), cl.cell_x, cl.cell_y)) AS cell_x, arg_min(cl.cell_y, (round(sqrt((h.x - cl.cell_x) * (h.x - cl.cell_x) + (h.y - cl.cell_y) * (h.y - cl.cell_y)), 9), cl.cell_x, cl.cell_y)) AS cell_y FROM homes_wide h JOIN cl ON (h.x - cl.cell_x) * (h.x - cl.cell_x) + (h.y - cl.cell_y) * (h.y - cl.cell_y) <= 160000 GROUP BY h.id) m ON m.i = h.id""", _CELLS))
def viewer_lookup(spark, d):
    """The viewer's cell at each address, or the nearest one."""
    cells = hbi.grid(_scored(spark, d)).select("cell_x", "cell_y")
    return joins.cell_or_nearest(view(spark, d, "homes_wide"), "id", cells).select("id", "cell_x", "cell_y", "how")


@query("SELECT c_custkey, round(CASE n WHEN 3 THEN 2 / pi() * acos(abs(r)) WHEN 4 THEN 1 - abs(r) WHEN 6 THEN (1 - abs(r)) * (1 - abs(r)) * (2 + abs(r)) / 2 END, 6) AS p FROM (SELECT c_custkey, (c_custkey % 199 - 99) / CAST(101.7 AS DOUBLE) AS r, CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 6 END AS n FROM customer)")
def p_values(spark, d):
    """p of correlations of few pairs, which have closed forms."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", ((k % 199 - 99) / 101.7).alias("r"), F.when(k % 4 == 0, 2).when(k % 4 == 1, 3).when(k % 4 == 2, 4).otherwise(6).alias("n"))
    return rows.select("c_custkey", stats.p_value("r", "n").alias("p"))


@query(q(("scored", "zones", "points"), f"""SELECT n, round(corr(ra, rb), 6) AS rho FROM (SELECT count(*) OVER () AS n, {rank('h')} AS ra, {rank('o')} AS rb FROM (SELECT a.adm_cd, h, v / CAST(500 + n_nationkey * 61 AS DOUBLE) AS o FROM (SELECT adm_cd, avg(hbi) AS h FROM {ZONE_HOMES.format('scored')} WHERE adm_cd IS NOT NULL AND hbi IS NOT NULL GROUP BY ALL HAVING count(*) >= 5) a
 JOIN (SELECT z.adm_cd, sum(value) AS v FROM points p JOIN zones z ON p.x >= z.x0 AND p.x < z.x1 AND p.y >= z.y0 AND p.y < z.y1 GROUP BY ALL) s ON s.adm_cd = a.adm_cd JOIN nation ON a.adm_cd = '11110' || lpad(CAST(n_nationkey AS VARCHAR), 5, '0'))) GROUP BY n"""))
def outing_index(spark, d):
    """Points a resident against the index, by district (p_values has the p)."""
    n = F.col("n_nationkey")
    pop = table(spark, d, "nation").select(F.concat(F.lit("11110"), F.lpad(n.cast("string"), 5, "0")).alias("adm_cd"), (500 + n * 61).cast("double").alias("pop60"))
    homes = zoned(_scored(spark, d), spark, d).filter("hbi IS NOT NULL")
    events = zoned(view(spark, d, "points").select("id", "x", "y", "value"), spark, d).filter("adm_cd IS NOT NULL")
    own = homes.filter("adm_cd IS NOT NULL").groupBy("adm_cd").agg(F.avg("hbi").alias("hbi_mean"), F.count("*").alias("_n")).filter("_n >= 5")
    points = own.join(events.groupBy("adm_cd").agg(F.sum("value").alias("n_points")), "adm_cd")
    return report.outing_index(points, pop).select("n", "rho")


@query("SELECT '1111' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS adm_cd, CAST(c_nationkey + c_custkey % 11 + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1000 + c_custkey END AS BIGINT) AS pop FROM customer WHERE c_custkey % 100000 <> 0")
def age_columns(spark, d):
    """Older residents from a table with a column for each age and sex."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    code = F.concat(F.lit("1111"), F.lpad(k.cast("string"), 6, "0"))
    wide = table(spark, d, "customer").select(code.alias(tables.CODE_COLUMN), F.lit("202504").alias(tables.MONTH_COLUMN), F.lit("9,999").alias("64세 남자"), n.cast("string").alias("65세남자"), (k % 11).cast("string").alias("66세 여자"), F.when(k % 3 != 0, F.format_number(1000 + k, 0)).alias("100세이상 여자"), F.lit("7").alias("계"))
    return tables.population(wide)


@query("SELECT '1111' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS adm_cd, CAST(1000 + c_nationkey AS BIGINT) AS pop FROM customer WHERE c_custkey % 100000 <> 0 AND c_custkey % 5 <> 0")
def age_totals(spark, d):
    """Older residents from a table with a 65+ total and the code in the district's name."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    name = F.concat(F.lit("서울 갑동("), F.lpad(F.concat(F.lit("1111"), F.lpad(k.cast("string"), 6, "0")), 10, "0"), F.lit(")"))
    wide = table(spark, d, "customer").select(name.alias("행정구역"), F.lit("5").alias("2025년04월_남_65세이상전체"), F.when(k % 5 != 0, F.format_number(1000 + n, 0)).alias("2025년04월_65세 이상전체"))
    return tables.population(wide)


@query("SELECT count(*) AS n, round(corr(a, b), 6) AS r_adult_pred_vs_measured FROM (SELECT o_totalprice / 60 AS a, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS DOUBLE) + o_totalprice / 90 END AS b FROM orders) WHERE b IS NOT NULL")
def measured_routes(spark, d):
    """Measured minutes against predicted ones."""
    o, name = table(spark, d, "orders"), F.col("o_orderkey").cast("string").alias("name")
    predicted = o.select(name, F.lit("adult").alias("mode"), F.col("o_totalprice").alias("seconds")).unionAll(o.select(name, F.lit("flat"), F.lit(1.0)))
    return whatif.measured(predicted, o.select(name, F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey").cast("double") + F.col("o_totalprice") / 90).alias("measured_min")))


@query("SELECT count(*) AS n, count(*) FILTER (o_orderkey % 13 = 0) AS n_differ FROM orders WHERE o_orderkey % 3 <> 0")
def reconciled(spark, d):
    """Values that two stages report for the same keys."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    other = o.filter("o_orderkey % 3 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 13 == 0, 0.02).otherwise(0.01))
    return joins.reconcile(o, other, "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, target, hbi, t FROM (SELECT c_custkey, 'bus' AS target, CASE WHEN c_custkey % 4 <> 0 THEN round(CAST(c_custkey % 50 AS DOUBLE) / 8, 6) END AS hbi, CAST(c_nationkey AS DOUBLE) AS t FROM customer UNION ALL SELECT c_custkey, 'medical', round(CAST(c_nationkey AS DOUBLE) / 4, 6), NULL FROM customer)")
def wide_buildings(spark, d):
    """A building table of one column group a destination, as text, in the long form."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    wide = table(spark, d, "customer").select("c_custkey", F.when(k % 4 != 0, (k % 50 / 8).cast("string")).otherwise("").alias("bus_hbi"), n.cast("string").alias("bus_t"), (n / 4).cast("string").alias("medical_hbi"))
    return stores.long_table(wide, ["hbi", "t"])


@query("SELECT c_nationkey AS k, d.v AS people, CASE WHEN d.v IS NOT NULL THEN round(d.v * 0.25, 1) END AS people_in_high FROM (SELECT DISTINCT c_nationkey FROM customer) LEFT JOIN (SELECT n_nationkey, CAST(100 + n_nationkey * 3 AS DOUBLE) AS v FROM nation WHERE n_nationkey % 5 <> 2) d ON n_nationkey = c_nationkey")
def statistics_by_name(spark, d):
    """Published statistics joined to districts by their written-out names."""
    n = F.col("c_nationkey").cast("string")
    districts = table(spark, d, "customer").select("c_nationkey").distinct().select(F.col("c_nationkey").alias("k"), F.lit("가 구").alias("gu"), F.concat(F.lit("서울 가구 제"), n, F.lit("·동")).alias("adm_nm"), F.lit(8.0).alias("weight_all"), F.lit(2.0).alias("weight_high"))
    m = F.col("n_nationkey")
    published = table(spark, d, "nation").filter(m % 5 != 2).select(F.lit("가구").alias("gu"), F.concat(m.cast("string"), F.lit(". 동")).alias("dong"), (100 + m * 3).cast("double").alias("people"))
    return joins.statistic_join(districts, published, ["people"]).select("k", "people", "people_in_high")


@query("SELECT s_nationkey AS target, CASE WHEN s_nationkey % 3 = 0 THEN CAST(max(s_suppkey) AS DOUBLE) ELSE CAST(min(s_suppkey) AS DOUBLE) END AS value FROM supplier GROUP BY s_nationkey")
def metric_versions(spark, d):
    """The newer name of a metric where a report has it, else the older."""
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("target")).agg(F.max("s_suppkey").cast("double").alias("new"), F.min("s_suppkey").cast("double").alias("old"))
    new = s.filter("target % 3 = 0").select("target", F.lit("hbi_median").alias("metric"), F.col("new").alias("value"))
    return report.metric(new.unionAll(s.select("target", F.lit("hbi_median_v4"), "old")), report.VERSIONS["hbi_median"])


@query("SELECT DISTINCT metric FROM (SELECT p_brand AS metric FROM part UNION ALL SELECT p_type FROM part)")
def metric_union(spark, d):
    p = table(spark, d, "part")
    return report.metric_names([p.select(F.col("p_brand").alias("metric")), p.select(F.col("p_type").alias("metric"))])


@query(q(("grid",), "SELECT count(*) FILTER (h >= 1.3) AS n, round(count(*) FILTER (h >= 1.3 AND m < 1.32) / CAST(count(*) FILTER (h >= 1.3) AS DOUBLE), 6) AS hidden FROM (SELECT h, avg(h) OVER (PARTITION BY r // 5, c // 5) AS m FROM p)", f"p AS (SELECT i // {SIDE} AS r, i % {SIDE} AS c, 1 + (i * 29 % 101) / CAST(150 AS DOUBLE) AS h FROM grid)"))
def hidden_by_blocks(spark, d):
    """Burdened pixels whose block of five by five looks fine."""
    i = F.col("i")
    index = view(spark, d, "grid").select(F.expr(f"i div {SIDE}").cast("int").alias("row"), (i % SIDE).cast("int").alias("col"), (1 + (i * 29 % 101) / 150).alias("hbi"))
    return preview.hidden_by_blocks(index, 5, 1.32)


@query("SELECT path, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, any_value(code) AS code FROM (SELECT 'f' || CAST(c_nationkey % 4 AS VARCHAR) AS path, CASE c_nationkey % 4 WHEN 0 THEN 126.5 + c_custkey % 100 / CAST(1000 AS DOUBLE) WHEN 1 THEN 950000 + CAST(c_custkey % 100 AS DOUBLE) ELSE 200000 + CAST(c_custkey % 100 AS DOUBLE) END AS x, CAST(c_custkey AS DOUBLE) AS y, CASE c_nationkey % 4 WHEN 0 THEN 4326 WHEN 1 THEN 5179 ELSE 5186 END AS code FROM customer) GROUP BY path")
def layer_coverage(spark, d):
    """Envelopes of a layer's files, and the projection their coordinates look like."""
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 4
    x = F.when(n == 0, 126.5 + k % 100 / 1000).when(n == 1, 950000 + (k % 100).cast("double")).otherwise(200000 + (k % 100).cast("double"))
    layer = table(spark, d, "customer").select(F.concat(F.lit("f"), n.cast("string")).alias("path"), x.alias("x0"), x.alias("x1"), k.cast("double").alias("y0"), k.cast("double").alias("y1"))
    codes = layer.groupBy("path").agg(geo.guess_code(F.min("x0")).alias("code"))
    return vector.coverage(layer).join(codes, "path")


@query(q(("zones",), "SELECT adm_cd FROM zones WHERE 201010 >= x0 AND 201010 < x1 AND 545910 >= y0 AND 545910 < y1"))
def zone_at_centre(spark, d):
    corner = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    rings = F.array(F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")))
    return stores.zone_at(view(spark, d, "zones").withColumn("rings", rings), 201010.0, 545910.0).select("adm_cd")


# searches with another oracle each

#: Facilities over the hill; a ramp is as fast as level ground.
_DECKS = [("deck", "ramp", "planned", 200030.0, 545600.0, 201300.0, 546200.0), ("bridge", "ramp", "existing", 200040.0, 545210.0, 201160.0, 545700.0)]


def _hub_sql(body: str, *more: str) -> str:
    values = ", ".join(f"('{n}', '{t}', '{s}', {', '.join(f'{v}::DOUBLE' for v in at)})" for n, t, s, *at in _DECKS)
    sql = re.sub(r"\(VALUES \('lift'.*?\) t\(facility", f"(VALUES {values}) t(facility", interventions(body, (*NET, "hubs", *more)), flags=re.DOTALL)
    return sql.replace("FROM dests t", "FROM hubs t").replace("target = 'station'", "target = 'hub'")


def _hub_times(spark, d) -> DataFrame:
    facilities = spark.createDataFrame([(*f, None, None) for f in _DECKS], "facility string, type string, status string, ax double, ay double, bx double, by double, wait_s double, speed double")
    nodes = view(spark, d, "nodes")
    return whatif.intervention_times(nodes, view(spark, d, "links"), view(spark, d, "homes"), view(spark, d, "hubs"), whatif.facility_edges(facilities, nodes))


@query(_hub_sql(f"SELECT facility, target, (gx + 0.5) * CAST(250 AS DOUBLE) AS cell_x, (gy + 0.5) * CAST(250 AS DOUBLE) AS cell_y, n_benefit, mean_saved_min FROM (SELECT facility, target, {gridded('ef')}, count(*) AS n_benefit, round(avg(saved) / 60, 6) AS mean_saved_min FROM ef WHERE ben GROUP BY ALL) g WHERE n_benefit >= 5"))
def hub_intervention_grid(spark, d):
    """Cells in which decks over the hill help at least five homes."""
    return whatif.intervention_grid(_hub_times(spark, d))


@query(_hub_sql("""SELECT facility, target, g.adm_cd, n_benefit, weight_benefit, weight_x_saved_min, weight_exit_high, weight_all FROM (
 SELECT facility, target, adm_cd, count(*) FILTER (ben) AS n_benefit, round(sum(weight) FILTER (ben), 6) AS weight_benefit, round(sum(weight * saved / 60) FILTER (ben), 6) AS weight_x_saved_min, CASE WHEN count(*) FILTER (xh) >= 5 THEN round(sum(weight) FILTER (xh), 6) END AS weight_exit_high
 FROM ef JOIN zones z ON ef.x >= z.x0 AND ef.x < z.x1 AND ef.y >= z.y0 AND ef.y < z.y1 GROUP BY ALL) g
 JOIN (SELECT adm_cd, sum(weight) AS weight_all FROM homes h JOIN zones z ON h.x >= z.x0 AND h.x < z.x1 AND h.y >= z.y0 AND h.y < z.y1 GROUP BY adm_cd) a ON a.adm_cd = g.adm_cd WHERE n_benefit >= 5""", "zones"))
def hub_intervention_district(spark, d):
    own = zoned(view(spark, d, "homes"), spark, d).select("id", "adm_cd", "weight")
    times = _hub_times(spark, d).join(own.select("id", "adm_cd"), "id")
    return whatif.intervention_district(times, own.filter("adm_cd IS NOT NULL").groupBy("adm_cd").agg(F.sum("weight").alias("weight_all")))


_TOWN = ("nodes", "links", "homes", "dests")


def _town_sql(body: str) -> str:
    """The full search, asked of the growing town's views."""
    return "WITH RECURSIVE " + ctes(*(f"town_{n}" for n in _TOWN)) + ",\n" + ",\n".join(f"{n} AS (SELECT * FROM town_{n})" for n in _TOWN) + ",\n" + FULL + "\n" + body


@query(_town_sql("SELECT id, target, round(t_elder, 6) AS t_elder, round(t_flat, 6) AS t_flat, round(t_wheel, 6) AS t_wheel, round(hbi, 6) AS hbi FROM hh"))
def town_index(spark, d):
    """The index of homes in a town that grows with the tables."""
    layer = lambda n: view(spark, d, f"town_{n}")
    return hbi.run(layer("nodes"), layer("links"), layer("homes"), layer("dests")).select("id", "target", "t_elder", "t_flat", "t_wheel", "hbi")


@query(_town_sql("SELECT node, round(d, 6) AS seconds FROM best WHERE run = 'medical|elder|back'"))
def town_times(spark, d):
    """Times from clinics to every node of the growing town, the network cut into blocks."""
    nodes = view(spark, d, "town_nodes")
    edges = cost.weights(hbi.sloped(nodes, view(spark, d, "town_links")), names=("elder",))
    dests = hbi.destination_nodes(view(spark, d, "town_dests").filter("target = 'medical'"), nodes)
    sources = dests.select(F.lit("x").alias("run"), F.lit("elder").alias("graph"), F.lit(False).alias("reverse"), "node")
    return paths.search(edges, sources, block_edges=400_000, places=nodes).select("node", F.col("d").alias("seconds"))


#: Decks of the growing town, in parts of its side of 25 m streets.
_TOWN_DECKS = [("deck", "ramp", "planned", 0.1, 0.15, 0.62, 0.55), ("bridge", "monorail", "existing", 0.2, 0.8, 0.75, 0.7), ("lane", "ramp", "planned", 0.5, 0.3, 0.9, 0.35)]
_TOWN_FACILITIES = "(SELECT facility, type, status, " + ", ".join(f"{o} + CAST(floor({c} * side) * 25 AS DOUBLE) AS {c}" for c, o in (("ax", X0), ("ay", Y0), ("bx", X0), ("by_", Y0))) + " FROM (VALUES " + ", ".join(f"('{n}', '{t}', '{s}', {', '.join(f'{v}::DOUBLE' for v in at)})" for n, t, s, *at in _TOWN_DECKS) + ") f(facility, type, status, ax, ay, bx, by_), (SELECT DISTINCT side FROM town))"


def _town_decks_sql(body: str) -> str:
    """Interventions, asked of the growing town's views."""
    sql = interventions(body, ()).removeprefix("WITH RECURSIVE ")
    sql = re.sub(r"SELECT \* FROM \(VALUES \('lift'.*?\) t\(facility, type, status, ax, ay, bx, by_\)", f"SELECT * FROM {_TOWN_FACILITIES}", sql, flags=re.DOTALL)
    return "WITH RECURSIVE " + ctes(*(f"town_{n}" for n in _TOWN)) + ",\n" + ",\n".join(f"{n} AS (SELECT * FROM town_{n})" for n in _TOWN) + ",\n" + sql.replace("target = 'station'", "target = 'medical'")


@query(_town_decks_sql("SELECT facility, target, count(*) AS n, count(*) FILTER (ben) AS n_benefit, round(coalesce(sum(saved) FILTER (ben), 0) / 60, 4) AS sum_saved_min, round(avg(h0) FILTER (ben), 6) AS hbi_before, round(avg(h1) FILTER (ben), 6) AS hbi_after, count(*) FILTER (newly) AS newly, count(*) FILTER (wben) AS wheel_benefit FROM ef GROUP BY ALL"))
def town_facilities(spark, d):
    """What new decks save in the growing town."""
    nodes = view(spark, d, "town_nodes")
    side = view(spark, d, "town").select("side").distinct()
    decks = spark.createDataFrame(_TOWN_DECKS, "facility string, type string, status string, a double, b double, c double, e double").join(F.broadcast(side), how="cross")  # one row
    at = lambda c, origin: (origin + F.floor(F.col(c) * F.col("side")) * 25).cast("double")
    decks = decks.select("facility", "type", "status", at("a", X0).alias("ax"), at("b", Y0).alias("ay"), at("c", X0).alias("bx"), at("e", Y0).alias("by"), F.lit(None).cast("double").alias("wait_s"), F.lit(None).cast("double").alias("speed"))
    dests = view(spark, d, "town_dests").filter("target = 'medical'")
    times = whatif.intervention_times(nodes, view(spark, d, "town_links"), view(spark, d, "town_homes"), dests, whatif.facility_edges(decks, nodes))
    e = whatif.effects(times)
    return e.groupBy("facility", "target").agg(F.count("*").alias("n"), F.count_if("benefit").alias("n_benefit"), F.round(F.coalesce(F.sum(F.when(F.col("benefit"), F.col("saved"))), F.lit(0.0)) / 60, 4).alias("sum_saved_min"), F.avg(F.when(F.col("benefit"), F.col("h0"))).alias("hbi_before"), F.avg(F.when(F.col("benefit"), F.col("h1"))).alias("hbi_after"), F.count_if("newly").alias("newly"), F.count_if("wheel_benefit").alias("wheel_benefit"))


_ENDS_OF_ORDERS = "ro AS (SELECT o_orderkey AS run, (o_custkey * 7919) % (side * side) AS o, (o_orderkey * 104729 + 31) % (side * side) AS d FROM orders, (SELECT DISTINCT side FROM town) WHERE o_orderkey % 5000 = 7)"


@query("WITH RECURSIVE " + ctes("town_nodes", "town_links") + ",\nnodes AS (SELECT * FROM town_nodes), links AS (SELECT * FROM town_links),\n" + EDGES + f",\n{_ENDS_OF_ORDERS},\n" + search(f"SELECT 'elder' AS g, src, dst, {elder()} AS w FROM dl", "SELECT CAST(run AS VARCHAR) AS run, 'elder' AS g, o AS node FROM ro") + "\nSELECT ro.run AS o_orderkey, round(CASE WHEN o = ro.d THEN 0 ELSE best.d END, 6) AS seconds, round(CASE WHEN o = ro.d THEN 0 ELSE best.d END, 6) AS walked FROM ro LEFT JOIN best ON best.run = CAST(ro.run AS VARCHAR) AND best.node = ro.d")
def town_routes(spark, d):
    """Ways between the ends of one order in 5,000 across blocks of the growing town: their costs, and those of the steps they take."""
    nodes = view(spark, d, "town_nodes")
    edges = save(cost.weights(hbi.sloped(nodes, view(spark, d, "town_links")), names=("elder",)), "town-weights")
    side = view(spark, d, "town").select("side").distinct()
    ends = table(spark, d, "orders").filter("o_orderkey % 5000 = 7").join(F.broadcast(side), how="cross")  # one row
    size = F.col("side") * F.col("side")
    pairs = ends.select(F.col("o_orderkey").cast("string").alias("run"), F.lit("elder").alias("graph"), (F.col("o_custkey") * 7919 % size).alias("o"), ((F.col("o_orderkey") * 104729 + 31) % size).alias("d"))
    found = save(paths.single_paths(edges, pairs, 4, 50_000, nodes), "town-routes")
    step = F.transform(F.sequence(F.lit(0), F.size("nodes") - 2), lambda i: F.struct(F.get("nodes", i).alias("src"), F.get("nodes", i + 1).alias("dst")))
    taken = found.filter(F.size("nodes") > 1).select("run", F.explode(step).alias("s")).select("run", "s.*").join(edges.groupBy("src", "dst").agg(F.min("w").alias("w")), ["src", "dst"]).groupBy("run").agg(F.sum("w").alias("walked"))
    return found.join(taken, "run", "left").select(F.col("run").cast("long").alias("o_orderkey"), F.col("cost").alias("seconds"), F.when(F.col("cost").isNotNull(), F.coalesce("walked", F.lit(0.0))).alias("walked"))


_ROUTES = [("up", 0, 4000), ("over", 500, 6000), ("here", 77, 77), ("down", 4000, 0), ("none", 3, 900_000)]
_ROUTE_COSTS = {"elder": COSTS["elder"], "adult": f"({COSTS['elder']}) * 0.8 / 1.1", "wheel": COSTS["wheel"], "flat": COSTS["flat"]}
_ROUTE_ROWS = "pr AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in _ROUTES) + ") p(name, o, d)), md AS (SELECT unnest(['elder', 'adult', 'wheel', 'flat']) AS mode)"


@query(q(("nodes", "links"), "SELECT pr.name, md.mode, round(CASE WHEN pr.o = pr.d THEN 0 ELSE best.d END, 6) AS seconds, CASE WHEN mode = 'flat' THEN round(CASE WHEN pr.o = pr.d THEN 0 ELSE best.d END * 0.8, 6) END AS flat_m FROM pr CROSS JOIN md LEFT JOIN best ON best.run = pr.name || '|' || md.mode AND best.node = pr.d", ",\n".join([EDGES, _ROUTE_ROWS, search(edge_rows(_ROUTE_COSTS), "SELECT name || '|' || mode AS run, mode AS g, o AS node FROM pr, md")]), True))
def route_seconds(spark, d):
    """Times of the cheapest ways in four modes, and the length of the level one."""
    pairs = spark.createDataFrame(_ROUTES, "name string, o long, d long")
    found = whatif.routes(view(spark, d, "nodes"), view(spark, d, "links"), pairs)
    return found.select("name", "mode", "seconds", F.when(F.col("mode") == "flat", F.col("length_m")).alias("flat_m"))


@query(f"""WITH RECURSIVE {ctes("hill")}, px AS (SELECT i // 40 AS row, i % 40 AS col, 30 + 250 * exp(-(pow(200000 + (i % 40 + 0.5) * 50 - 201300, 2) + pow(547000 - (i // 40 + 0.5) * 50 - 546200, 2)) / CAST(320000 AS DOUBLE)) AS z FROM hill),
sl AS (SELECT a.row * 40 + a.col AS u, b.row * 40 + b.col AS v, 50 * sqrt(i * i + j * j) AS length, greatest(-0.4, least(0.4, (b.z - a.z) / (50 * sqrt(i * i + j * j)))) AS s, false AS is_stair FROM px a, (SELECT * FROM (VALUES (0, 1), (1, 0), (1, 1), (1, -1)) o(i, j)) o JOIN px b ON b.row = a.row + i AND b.col = a.col + j),
{both_ways()},
{search(edge_rows({"elder": elder(), "flat": "length / 0.8"}), "SELECT run, g, node FROM (SELECT unnest([5 * 40 + 5, 30 * 40 + 20]) AS node), (SELECT * FROM (VALUES ('go', 'elder~'), ('back', 'elder'), ('flat', 'flat~')) r(run, g))")}
SELECT CAST(node // 40 AS INT) AS row, CAST(node % 40 AS INT) AS col, round(CASE WHEN 2 * f < 1 THEN 1 ELSE (g + b) / (2 * f) END, 6) AS hbi FROM (SELECT node, max(d) FILTER (run = 'go') AS g, max(d) FILTER (run = 'back') AS b, max(d) FILTER (run = 'flat') AS f FROM best GROUP BY node)""")
def raster_index(spark, d):
    """The index on a raster of the hill, over eight neighbours of each pixel."""
    row, col = F.expr("i div 40").cast("int"), (F.col("i") % 40).cast("int")
    off = lambda v, at: (v - at) * (v - at)
    z = 30 + 250 * F.exp(-(off(200000 + (col + 0.5) * 50, 201300) + off(547000 - (row + 0.5) * 50, 546200)) / 320000)
    pixels = view(spark, d, "hill").select(row.alias("row"), col.alias("col"), z.alias("z"))
    return preview.raster_index(pixels, 50.0, spark.createDataFrame([(5, 5), (30, 20)], "row int, col int"))


@query(q(("scored",), f"SELECT count(*) AS n_cells, round(sum(hbi_mean), 4) AS hbi_sum, greatest(10, ceil((list_sort(list(elder_min)))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1] / 5) * 5)::DOUBLE AS cap FROM (SELECT {gridded('scored')}, count(*) AS n, avg(hbi) AS hbi_mean, median(t_elder) / 60 AS elder_min FROM scored WHERE hbi IS NOT NULL GROUP BY ALL HAVING count(*) >= 5)"))
def viewer_scale(spark, d):
    """The viewer's cells and its colour cap, parsed back from its JSON text."""
    back = report.viewer_cells(hbi.grid(_scored(spark, d))).select(F.from_json("json", "cells array<array<double>>, cap double").alias("j"))
    return back.select(F.size("j.cells").cast("long").alias("n_cells"), F.round(F.aggregate("j.cells", F.lit(0.0), lambda a, c: a + c[3]), 4).alias("hbi_sum"), "j.cap")


def _spaced_sql(k: int) -> str:
    """The k-th choice: the highest cell far enough from all earlier ones."""
    earlier = " UNION ALL ".join(f"SELECT * FROM k{j}" for j in range(1, k))
    free = f" WHERE NOT EXISTS (SELECT 1 FROM ({earlier}) e WHERE sqrt((e.cell_x - c.cell_x) * (e.cell_x - c.cell_x) + (e.cell_y - c.cell_y) * (e.cell_y - c.cell_y)) < 400)" if k > 1 else ""
    return f"k{k} AS (SELECT {k} AS rank, cell_x, cell_y, hbi_mean FROM c{free} ORDER BY hbi_mean DESC, cell_x, cell_y LIMIT 1)"


@query(q(("scored",), " UNION ALL ".join(f"SELECT rank, cell_x, cell_y, round(hbi_mean, 6) AS hbi_mean FROM k{k}" for k in range(1, 6)), f"c AS (SELECT (gx + 0.5) * CAST(250 AS DOUBLE) AS cell_x, (gy + 0.5) * CAST(250 AS DOUBLE) AS cell_y, hbi_mean FROM (SELECT {gridded('scored')}, round(avg(hbi), 9) AS hbi_mean FROM scored WHERE hbi IS NOT NULL GROUP BY ALL HAVING count(*) >= 5)),\n" + ",\n".join(_spaced_sql(k) for k in range(1, 6))))
def spaced_cells(spark, d):
    """The five highest cells that keep 400 m from each other."""
    cells = hbi.grid(_scored(spark, d)).select("cell_x", "cell_y", F.round("hbi_mean", 9).alias("hbi_mean"))
    chosen = [(k + 1, r["cell_x"], r["cell_y"], r["hbi_mean"]) for k, r in enumerate(whatif.spaced_top(cells, 400.0, 5))]  # a report of five rows
    return spark.createDataFrame(chosen, "rank int, cell_x double, cell_y double, hbi_mean double")


_PLACES = "pl AS (SELECT c_custkey AS k, 126.90003 + c_custkey * 7 % 1000 / CAST(5000 AS DOUBLE) AS lon, 37.40003 + c_custkey * 13 % 1000 / CAST(5000 AS DOUBLE) AS lat FROM customer)"


def _degree_zones(spark, d) -> DataFrame:
    """Boxes of 0.03 degrees with gaps between them, one for each nation."""
    n = F.col("n_nationkey")
    z = table(spark, d, "nation").select(F.concat(F.lit("g"), n.cast("string"), F.lit("구")).alias("gu"), (126.9 + 0.04 * (n % 5)).alias("x0"), (37.4 + 0.04 * F.expr("n_nationkey div 5")).alias("y0"))
    z = z.withColumn("x1", F.col("x0") + 0.03).withColumn("y1", F.col("y0") + 0.03)
    return z.withColumn("rings", F.array(_ring((F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y0")), (F.col("x1"), F.col("y1")), (F.col("x0"), F.col("y1")), (F.col("x0"), F.col("y0")))))


@query(f"WITH {_PLACES} SELECT 'P' || CAST(k AS VARCHAR) AS name, round(lon, 6) AS lon, round(lat, 6) AS lat FROM pl JOIN nation ON lon > 126.9 + 0.04 * (n_nationkey % 5) AND lon < 126.93 + 0.04 * (n_nationkey % 5) AND lat > 37.4 + 0.04 * (n_nationkey // 5) AND lat < 37.43 + 0.04 * (n_nationkey // 5) WHERE k % 9 <> 0")
def named_places(spark, d):
    """Named points of a table inside a city's zones; those without coordinates fall out."""
    k = F.col("c_custkey")
    lon, lat = 126.90003 + k * 7 % 1000 / 5000, 37.40003 + k * 13 % 1000 / 5000
    rows = table(spark, d, "customer").select(F.concat(F.lit(" P"), k.cast("string"), F.lit(" ")).alias("name"), F.when(k % 9 != 0, lon.cast("string")).alias("lon"), lat.cast("string").alias("lat"))
    return tables.named_points(rows, "name", "lon", "lat", zones=_degree_zones(spark, d))


@query("SELECT CAST(5174 AS INTEGER) AS code, false AS shifted, count(*) AS agree, count(*) AS n FROM customer")
def voted_projection(spark, d):
    """The projection in which all facilities, some of them 20 m from the border, lie in the boroughs of their addresses."""
    k, z = F.col("c_custkey"), _degree_zones(spark, d)
    own = z.join(table(spark, d, "customer").select("c_custkey", F.concat(F.lit("g"), F.col("c_nationkey").cast("string"), F.lit("구")).alias("gu")), "gu").select("gu", "c_custkey", "x0", "y0").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = own.select("gu", geo.projected(F.col("x0") + 0.0002 + k % 297 / 10_000, F.col("y0") + 0.0002 + k % 293 / 10_000, 4326, 5174).alias("at"))
    rows = at.select(F.col("at.x").cast("string").alias("px"), F.col("at.y").cast("string").alias("py"), F.concat(F.lit("서울특별시 "), "gu", F.lit(" 1")).alias("address"))
    return tables.vote_code(rows, "px", "py", "address", z).limit(1).select("code", "shifted", "agree", "n")


# files written and read back


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def _lines(rows: DataFrame, file: Column, encoding: str, sep: str, *cells: Column, at: Column, heads: tuple[str, ...] = ()) -> DataFrame:
    """Lines of text files: heads first in each, then the rows' cells in the order of `at` (from 0)."""
    body = rows.select(file.alias("file"), at.cast("long").alias("at"), F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]).alias("line"))
    tops = body.select("file").distinct().select("file", F.posexplode(F.array(*[F.lit(h) for h in heads])).alias("k", "line")).select("file", (F.col("k") - len(heads)).cast("long").alias("at"), "line") if heads else None
    return (body.unionByName(tops) if heads else body).withColumn("encoding", F.lit(encoding))


_TEXT = "SELECT '{0}' AS encoding, o_orderkey AS id, '가' || o_orderpriority AS name, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS region FROM orders"


@query(_TEXT.format("cp949") + " UNION ALL " + _TEXT.format("utf-8-sig"))
def text_tables(spark, d):
    """Orders written to files in two encodings with two delimiters, the Korean text far behind the head, and read back."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    found = []
    for encoding, sep in (("cp949", "|"), ("utf-8-sig", "\t")):
        folder = _folder(spark, "text")
        padding = [sep.join(["-1", "x" * 99, ""])] * 1000  # ASCII only
        cells = (k, F.concat(F.lit("가"), "o_orderpriority"), F.when(k % 4 != 0, F.col("o_custkey")))
        sinks.write_lines(_lines(o, F.format_string("t%d.csv", k % 8), encoding, sep, *cells, at=k, heads=(sep.join(["id", "이름", "region"]), *padding)), folder)
        back = files.read_any(spark, f"{folder}/*.csv").filter("id <> '-1'")
        found.append(back.select(F.lit(encoding).alias("encoding"), F.col("id").cast("long").alias("id"), F.col("이름").alias("name"), F.nullif("region", F.lit("")).alias("region")))
    return found[0].unionAll(found[1])


@query("SELECT o_orderkey AS id, o_orderpriority AS name, round(CAST(o_orderkey AS DOUBLE) / 7, 4) AS v FROM orders")
def csv_round_trip(spark, d):
    """The spreadsheet sink, a file for each task with its byte order mark and rounded numbers, read back."""
    folder = _folder(spark, "csv")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), (F.col("o_orderkey").cast("double") / 7).alias("v"))
    sinks.write_csv_parts(sinks.rounded(o).repartition(4), folder)
    return files.read_any(spark, f"{folder}/*.csv").select(F.col("id").cast("long").alias("id"), "name", F.col("v").cast("double").alias("v"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0")
def csv_points(spark, d):
    """Rows with coordinates of text tables, in the working projection's area; and no rows of a file that isn't there."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    folder = _folder(spark, "points")
    sinks.write_lines(_lines(c, F.format_string("p%d.csv", k % 4), "utf-8-sig", ",", k, F.when(k % 3 != 0, 126.9 + k % 97 / 500), F.lit("37.5"), at=k, heads=("id,lon,lat",)), folder)
    found = files.read_points(spark, f"{folder}/*.csv").filter("x BETWEEN 180000 AND 230000 AND y BETWEEN 500000 AND 600000")
    return found.select(F.col("id").cast("long").alias("id")).unionAll(files.read_points(spark, f"{folder}/none.csv").select(F.col("lon").cast("long")))


_STATS = "SELECT layout, 'gu' || CAST(c_nationkey AS VARCHAR) || '구' AS gu, 'd' || CAST(c_custkey AS VARCHAR) || '동' AS dong, CASE WHEN c_custkey % 6 <> 0 THEN CAST(1000 + c_custkey AS DOUBLE) END AS people FROM customer, (SELECT unnest(['plain', 'stacked', 'long']) AS layout)"


@query(_STATS)
def statistics_tables(spark, d):
    """A statistic of as many districts as customers in its three header layouts, each written in another encoding and read back."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    c = table(spark, d, "customer")
    firsts = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("first"))
    c = c.join(F.broadcast(firsts), "c_nationkey")  # a row a nation
    gu, dong = F.concat(F.lit("gu"), nation.cast("string"), F.lit("구")), F.concat(F.lit("d"), k.cast("string"), F.lit("동"))
    value = F.when(k % 6 == 0, "X").otherwise(F.concat(F.lit('"'), F.format_number(1000 + k, 0), F.lit('"')))
    place, own, first = (nation.cast("long") * 100_000_000 + k) * 4, F.lit(""), k == F.col("first")
    heads = {"plain": ("자치구,동,기준,인구", ",,명,명"), "stacked": ("동별(1),동별(2),동별(3),2024,2024", "동별(1),동별(2),동별(3),인구,인구", "동별(1),동별(2),동별(3),소계,남자"), "long": ("동별,항목,구분,단위,2024",)}
    totals = {"plain": (gu, F.lit("합계"), 1, 9), "stacked": (F.lit("합계"), gu, F.lit("소계"), 9, 9), "long": (gu, F.lit("수"), F.lit("계"), F.lit("명"), 9)}
    lines = {"plain": [(own, dong, 1, value)], "stacked": [(own, F.when(first, gu), dong, value, 1)], "long": [(dong, F.lit("수"), F.lit("계"), F.lit("명"), value), (dong, F.lit("수"), F.lit("남"), F.lit("명"), 3)]}
    found = None
    for layout, encoding, column in (("plain", "utf-8-sig", "인구"), ("stacked", "cp949", "인구"), ("long", "euc-kr", "계")):
        folder, file = _folder(spark, "statistics"), F.lit(f"{layout}.csv")
        as_column = lambda cells: [x if isinstance(x, Column) else F.lit(x) for x in cells]
        rows = _lines(c.filter(first), file, encoding, ",", *as_column(totals[layout]), at=place, heads=heads[layout])
        for j, cells in enumerate(lines[layout]):
            rows = rows.unionByName(_lines(c, file, encoding, ",", *as_column(cells), at=place + j + 1))
        sinks.write_lines(rows, folder)
        one = tables.statistics(spark, f"{folder}/{layout}.csv", [column]).select(F.lit(layout).alias("layout"), "gu", "dong", F.col(column).alias("people"))
        found = one if found is None else found.unionAll(one)
    return found


@query(f"""SELECT '11110' || lpad(CAST(k AS VARCHAR), 5, '0') AS adm_cd, '1101' || lpad(CAST(k AS VARCHAR), 4, '0') AS adm_cd_stat, 'n' || CAST(k AS VARCHAR) AS adm_nm, 'g' || CAST(c_nationkey AS VARCHAR) AS gu, 1 + CAST(k % 3 = 0 AS INT) AS n_rings,
 CAST({X0} + 400 * (k % 50) + x AS DOUBLE) AS x, CAST({Y0} + 4 * (k // 50) + y AS DOUBLE) AS y FROM (SELECT c_custkey AS k, c_nationkey, unnest([0, 400, 400, 0]) AS x, unnest([0, 0, 400, 400]) AS y FROM customer)""")
def geojson_zones(spark, d):
    """As many districts as customers, written as GeoJSON files in degrees and read back: corners of their first rings, and the number of rings."""
    k = F.col("c_custkey")
    x, y = (X0 + 400 * (k % 50)).cast("double"), (Y0 + 4 * F.expr("c_custkey div 50")).cast("double")
    corner = lambda a, b: F.array(*geo.project(x + a, y + b, 5186, 4326))
    corners = save(table(spark, d, "customer").select("c_custkey", "c_nationkey", F.array(corner(0, 0), corner(400, 0), corner(400, 400), corner(0, 400)).alias("ring")), "corners")
    ring = F.col("ring")
    text_of = lambda c, n: F.lpad(c.cast("string"), n, "0")
    properties = F.struct(F.concat(F.lit("11110"), text_of(k, 5)).alias("ADM_CD"), F.concat(F.lit("1101"), text_of(k, 4)).alias("ADM_CD_STAT"), F.concat(F.lit("n"), k.cast("string")).alias("adm_nm"), F.concat(F.lit("g"), F.col("c_nationkey").cast("string")).alias("sggnm"))
    feature = lambda kind, shape: F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit(kind).alias("type"), shape.alias("coordinates")).alias("geometry")))
    line = F.when(k % 3 == 0, feature("MultiPolygon", F.array(F.array(ring), F.array(ring)))).otherwise(feature("Polygon", F.array(ring)))
    folder, file = _folder(spark, "zones"), F.format_string("dong_boundary_%d.geojson", k % 4)
    rows = _lines(corners, file, "utf-8", "", line, at=2 * k, heads=('{"type": "FeatureCollection", "features": [',))
    last = rows.groupBy("file", "encoding").agg(F.max("at").alias("last"))
    between = rows.join(last, ["file", "encoding"]).filter("at >= 0 AND at < last").select("file", (F.col("at") + 1).alias("at"), F.lit(",").alias("line"), "encoding")
    sinks.write_lines(rows.unionByName(between).unionByName(last.select("file", (F.col("last") + 1).alias("at"), F.lit("]}").alias("line"), "encoding")), folder)
    zones = vector.read_zones(spark, f"{folder}/*.geojson")
    return zones.select("adm_cd", "adm_cd_stat", "adm_nm", "gu", F.size("rings").alias("n_rings"), F.explode(F.col("rings")[0]).alias("p")).select("adm_cd", "adm_cd_stat", "adm_nm", "gu", "n_rings", F.round("p.x", 2).alias("x"), F.round("p.y", 2).alias("y"))


@query("SELECT round(x, 6) AS x, round(y, 6) AS y, count(*) AS n FROM (SELECT 127 + s_suppkey / CAST(1000 AS DOUBLE) AS x, unnest([37.5::DOUBLE, 37.6::DOUBLE]) AS y FROM supplier WHERE s_suppkey % 4 <> 0 AND s_nationkey % 5 <> 3) GROUP BY ALL")
def wkt_network(spark, d):
    """Walkers' lines of a network table: no nodes, no other link types, only some boroughs."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey") % 5
    at = (127 + k / 1000).cast("string")
    link = F.concat(F.lit("LINESTRING("), at, F.lit(" 37.5, "), at, F.lit(" 37.6)"))
    rows = table(spark, d, "supplier").select(F.when(k % 4 != 0, link).otherwise(F.concat(F.lit("POINT("), at, F.lit(" 37.5)"))).alias("wkt"), F.lit("1000").alias("code"), F.lit("LINK").alias("kind"), F.concat(F.lit("gu"), n.cast("string")).alias("gu"))
    other = rows.filter("wkt LIKE 'LINE%'").withColumn("code", F.lit("10"))  # 0010: not for walkers
    lines = vector.wkt_lines(rows.unionAll(other), vector.wkt_column(rows), "code", "kind", "gu", ["gu0", "gu1", "gu2", "gu4"])
    return lines.select(F.explode("points").alias("p")).groupBy("p.x", "p.y").agg(F.count("*").alias("n"))


@query(q(("nodes", "links"), "SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT round(sum(z), 3) FROM nodes) AS z, (SELECT count(*) FROM links) AS n_links, (SELECT count(*) FROM links WHERE is_stair) AS n_stairs"))
def network_store(spark, d):
    """The network written between stages and read back."""
    folder = _folder(spark, "network")
    stores.write_network(view(spark, d, "nodes"), view(spark, d, "links"), folder)
    nodes, links = stores.read_network(spark, folder)
    return nodes.agg(F.count("*").alias("n_nodes"), F.round(F.sum("z"), 3).alias("z")).join(links.agg(F.count("*").alias("n_links"), F.count_if("is_stair").alias("n_stairs")), how="cross")


_BUFFERS = "b AS (SELECT c_custkey AS id, c_custkey % 5 AS kind, 60.0 + c_custkey % 50 AS len, 16 * 625 * sin(pi() / 16) AS p FROM customer)"


@query(f"WITH {_BUFFERS} SELECT id, round(CASE kind WHEN 0 THEN p + 50 * len WHEN 1 THEN 2 * (p + 50 * len) - 2500 WHEN 2 THEN 2 * (p + 50 * len) - 625 - 3 * p / 4 WHEN 3 THEN p + 75 * len ELSE len * len + 100 * len + p - (len - 50) * (len - 50) END, 0) AS area_m2 FROM b")
def buffer_unions(spark, d):
    """Areas of united buffers of links that lie alone, cross, meet at a corner, overlap along a line, or go round a yard."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("id"), (k % 5).alias("kind"), (60.0 + k % 50).alias("len"), (X0 + 400.0 * (k % 200)).alias("x"), (Y0 + 400.0 * F.expr("c_custkey div 200")).alias("y"))
    x, y, n = F.col("x"), F.col("y"), F.col("len")
    way = lambda *v: F.struct(*[a.cast("double").alias(name) for a, name in zip(v, ("x0", "y0", "x1", "y1"), strict=True)])
    one, up = way(x, y, x + n, y), way(x, y, x, y + n)
    kinds = {0: [one], 1: [way(x - n / 2, y, x + n / 2, y), way(x, y - n / 2, x, y + n / 2)], 2: [one, up], 3: [one, way(x + n / 2, y, x + n * 1.5, y)], 4: [one, up, way(x + n, y, x + n, y + n), way(x, y + n, x + n, y + n)]}
    ways = F.coalesce(*[F.when(F.col("kind") == kind, F.array(*parts)) for kind, parts in kinds.items()])
    links = c.select("id", F.explode(ways).alias("w")).select("id", "w.*")
    return union.union_areas(union.outline_pieces(links, ["id"], 25.0, cell_m=200.0), ["id"]).select("id", F.round("area_m2", 0).alias("area_m2"))


@query(None)
def isochrone_unions(spark, d):
    """Isochrones as united buffers: area, and MultiPolygons without points that matter less, the longest first (tests hold unions against closed forms)."""
    nodes = view(spark, d, "nodes")
    layer = whatif.isochrone_layer(_reached(spark, d), nodes)
    return layer.select("name", "mode", "minutes", F.round("area_m2", 0).alias("area_m2"), F.size("rings").alias("rings"), F.length("geom").alias("bytes"))


@query(q(("homes_wide",), "SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(x - 25, 6) AS x0, round(y + 25, 6) AS y1, id * 3 AS label FROM homes_wide"))
def gpkg_round_trip(spark, d):
    """Cells around homes, written as GeoPackages by several tasks and read back: centres from the polygons, envelopes from their heads."""
    folder = _folder(spark, "gpkg")
    homes = view(spark, d, "homes_wide")
    cells = homes.select("id", (F.col("id") * 3).alias("label"), sinks.cell_wkb(F.col("x") - 25, F.col("y") - 25, F.lit(50.0)).alias("wkb"), F.col("x").alias("_x"))
    sinks.write_gpkg_parts(cells.repartitionByRange(4, "_x").drop("_x"), folder, "cells", "wkb", "POLYGON")
    back = vector.read_gpkg(spark, folder, "cells")

    @F.pandas_udf("x double, y double")
    def centre(wkb: pd.Series) -> pd.DataFrame:
        corners = [np.frombuffer(w, "<f8", 8, 13).reshape(4, 2).mean(axis=0) for w in wkb]
        return pd.DataFrame(np.array(corners).reshape(-1, 2), columns=["x", "y"])

    at = lambda c: F.col("attributes")[c].cast("long").alias(c)
    return back.select(at("id"), at("label"), centre("wkb").alias("c"), "x0", "y1").select("id", "c.x", "c.y", "x0", "y1", "label")


@query("SELECT count(*) AS n FROM supplier WHERE s_suppkey % 2 = 0")
def found_files(spark, d):
    """Files by ending, in any case, and part of the name, in nested folders; none where there is no folder."""
    root, k = _folder(spark, "files"), F.col("s_suppkey")
    shape = F.format_string("sub%d/%s_%d.%s", k % 3, F.when(k % 2 == 0, "road").otherwise("house"), k, F.when(k % 4 != 0, "SHP").otherwise("shp"))
    s = table(spark, d, "supplier")
    sinks.write_lines(_lines(s, shape, "utf-8", "", F.lit("x"), at=F.lit(0)).unionByName(_lines(s, F.format_string("road_%d.dbf", k), "utf-8", "", F.lit("x"), at=F.lit(0))), root)
    found = files.find(spark, root, ["road", "street"], ".shp").unionAll(files.find(spark, root + "-none", ["road"], ".shp"))
    return found.agg(F.count("*").alias("n"))
