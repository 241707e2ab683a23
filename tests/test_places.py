"""Points of one place, and polygons of one outline, are tried once."""

import time

from pyspark.sql import functions as F

from gradewalk.functions import geo
from gradewalk.operators import hbi, network, spatial


def test_merge_within_makes_no_pairs_of_copies(spark, monkeypatch):
    rows = spark.range(900).select("id", (F.col("id") % 3 * 0.4).alias("x"), F.when(F.col("id") < 897, 0.0).otherwise(9.0).alias("y"))
    odd = spark.createDataFrame([(900, None, 0.0), (901, None, 0.0), (902, float("nan"), 0.0), (903, float("nan"), 0.0)], "id long, x double, y double")
    pairs = []
    monkeypatch.setattr(network, "labelled", lambda e, own=network.labelled: pairs.append(e.count()) or own(e))
    got = {r["id"]: r["node"] for r in network.merge_within(rows.unionAll(odd), "id", 1.0).collect()}
    assert pairs[0] <= 6 and got == {k: 0 if k < 897 else 897 if k < 900 else k for k in range(904)}


def test_nearest_joins_places_not_copies(spark, monkeypatch):
    left = spark.range(60).select("id", F.when(F.col("id") < 58, F.col("id") % 2 * 1.0).alias("x"), F.lit(0.0).alias("y"))
    right = spark.range(80).select((1000 - F.col("id")).alias("to"), (F.col("id") % 2 * 1.0).alias("rx"), F.lit(0.5).alias("ry"))
    sides = []
    monkeypatch.setattr(spatial, "within", lambda a, b, *c, own=spatial.within: sides.append((a.count(), b.count())) or own(a, b, *c))
    got = {r["id"]: (r["to"], r["d"]) for r in spatial.nearest(left, "id", right, 0.9, "to").collect()}
    assert sides == [(2, 2)] and got == {k: (None, None) if k >= 58 else (922 if k % 2 == 0 else 921, 0.5) for k in range(60)}


def test_polygons_of_one_outline_are_tried_once(spark, monkeypatch):
    points = spark.range(30).select("id", (F.col("id") + 0.5).alias("x"), F.lit(0.5).alias("y"))
    boxes = spark.range(400).select(F.format_string("p%03d", 399 - F.col("id")).alias("pnu"), (F.col("id") % 4 * 5.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") % 4 * 5.0 + 5).alias("x1"), F.lit(1.0).alias("y1"))
    tried = []
    monkeypatch.setattr(spatial, "_covered", lambda p, *a, own=spatial._covered: tried.append(p.count()) or own(p, *a))
    box = ("x0", "y0", "x1", "y1")
    got = {r["id"]: (r["pnu"], r["x0"]) for r in spatial.in_polygons(points, "id", boxes, "pnu", spatial.inside_box(), 5.0, alike=box).collect()}
    want = {r["id"]: (r["pnu"], r["x0"]) for r in spatial.in_polygons(points, "id", boxes, "pnu", spatial.inside_box(), 5.0).collect()}
    assert tried == [4, 400] and got == want and got[0][0] == "p003" and got[29] == (None, None)


def test_principal_axis_of_many_points_in_good_time(spark):
    """Its time grows with the points, not with a power of them."""
    n = 200
    ring = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 3.0).alias("x"), (i * 4.0 + 7).alias("y")))
    start = time.time()
    a = spark.range(3).select(ring.alias("r")).select(geo.principal_axis(F.col("r")).alias("a")).first()["a"]
    assert time.time() - start < 20 and [round(a[c], 6) for c in ("ax", "ay", "bx", "by", "cx", "cy")] == [0.0, 7.0, 597.0, 803.0, 298.5, 405.0]


def test_interior_points_and_areas_of_many_corners_in_good_time(spark):
    """A ring that is an expression of its own is worked out once for all of its sides."""
    n = 300
    corner = lambda i: F.struct((1000 + 500 * F.cos(i * 2 * 3.141592653589793 / n)).alias("x"), (1000 + 500 * F.sin(i * 2 * 3.141592653589793 / n)).alias("y"))
    ring = F.transform(F.sequence(F.lit(0), F.col("last")), corner)
    start = time.time()
    got = spark.range(200).withColumn("last", F.lit(n - 1) + F.col("id").cast("int") * 0).select(geo.interior_point(ring).alias("p"), geo.ring_area(ring).alias("a")).collect()
    assert time.time() - start < 20 and all(abs(r["p"]["x"] - 1000) < 5 and abs(r["p"]["y"] - 1000) < 1e-6 and abs(r["a"] - 785_340) < 100 for r in got)


def test_nearest_copies_the_places_asked_for(spark, monkeypatch):
    copied = []
    monkeypatch.setattr(spatial, "_neighbours", lambda df, *a, own=spatial._neighbours: copied.append(df.columns) or own(df, *a))
    left = spark.createDataFrame([(1, 9.9, 0.0), (2, 50.0, 0.0)], "id long, x double, y double")
    right = spark.createDataFrame([(k, float(k), 0.0) for k in range(12)], "to long, rx double, ry double")
    got = {r["id"]: r["to"] for r in spatial.nearest(left, "id", right, 3.0, "to").collect()}
    assert got == {1: 10, 2: None} and copied == [["_lx", "_ly"]]


def test_legs_read_their_edges_from_a_table(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(hbi, "search", lambda edges, sources, *a, own=hbi.search, **k: seen.append((k["stored"], bool(edges.inputFiles()))) or own(edges, sources, *a, **k))
    edges = spark.createDataFrame([("flat", 1, 2, 4.0), ("flat", 2, 1, 5.0)], "graph string, src long, dst long, w double")
    got = hbi.round_trips(edges, spark.createDataFrame([("shop", 1)], "target string, node long"))
    assert {(r["node"], r["go"], r["back"]) for r in got.collect()} == {(1, 0.0, 0.0), (2, 5.0, 4.0)} and seen == [(True, True)]
