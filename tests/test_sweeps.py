"""Summed areas, voids by tiles, cuts of long lines, fill-down by ranges, missing folders, and folders of one machine."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewalk.operators import network, ordered, raster, spatial, tables
from gradewalk.sources import rasters, vector
from gradewalk.sources import tables as texts


def test_summed_areas(spark):
    rnd = random.Random(3)
    cells = {(rnd.randrange(40), rnd.randrange(25)) for _ in range(300)}
    got = {(r["gx"], r["gy"]): r["n"] for r in spatial.summed_areas(spark.createDataFrame(sorted(cells), "gx long, gy long")).collect()}
    width, height = max(x for x, _ in cells) + 1, max(y for _, y in cells) + 1
    assert got == {(x, y): sum(a <= x and b <= y for a, b in cells) for x in range(width) for y in range(height)}
    assert spatial.summed_areas(spark.createDataFrame([], "gx long, gy long")).count() == 0


def test_edge_flag_against_counting(spark):
    rnd = random.Random(7)
    covers = [(50.0 * x, 50.0 * y, 50.0 * x + rnd.choice([50.0, 49.0, 130.0]), 50.0 * y + 50.0) for x in range(60) for y in range(40) if rnd.random() < 0.97]
    points = [(k, rnd.uniform(-300, 3400), rnd.uniform(-300, 2400)) for k in range(500)]
    cells = {(x, y) for a, b, c, d in covers for x in range(int(a // 50), int(-(-c // 50))) for y in range(int(b // 50), int(-(-d // 50)))}
    wanted = {k: any((int(x // 50) + i, int(y // 50) + j) not in cells for i in range(-3, 4) for j in range(-3, 4)) for k, x, y in points}
    got = spatial.edge_flag(spark.createDataFrame(points, "id long, x double, y double"), "id", spark.createDataFrame(covers, "x0 double, y0 double, x1 double, y1 double"), 150.0, 50.0)
    assert {r["id"]: r["edge"] for r in got.collect()} == wanted and len(set(wanted.values())) == 2


def by_rings(z, low, rounds):
    z = {k: (v if v >= low else None) for k, v in z.items()}
    for _ in range(rounds):
        news = {}
        for (r, c), v in z.items():
            if v is None:
                near = [z[p] for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and z.get(p := (r + i, c + j)) is not None]
                if near:
                    news[r, c] = sum(near) / len(near)
        if not news:
            break
        z |= news
    return z


def test_voids_by_tiles_as_by_rings(spark):
    """Voids across tiles, deeper than the rounds, at the rim, and beside pixels that don't exist."""
    rnd = random.Random(5)
    z = {(r, c): rnd.uniform(0, 90) for r in range(60) for c in range(50) if not (20 <= r < 24 and c > 30)}
    for r0, c0, h, w in ((5, 5, 3, 30), (12, 12, 25, 9), (50, 0, 10, 10), (30, 40, 2, 2)):
        z |= {(r, c): -999.0 for r in range(r0, r0 + h) for c in range(c0, c0 + w) if (r, c) in z}
    frame = spark.createDataFrame([(*k, v) for k, v in z.items()], "row int, col int, z double")
    for rounds, tile in ((64, 16), (3, 16), (3, 7), (64, 256)):
        got = {(r["row"], r["col"]): r["z"] for r in raster.fill_voids(frame, rounds=rounds, tile=tile).collect()}
        wanted = by_rings(z, -20.0, rounds)
        assert len(got) == len(z) and {k for k, v in got.items() if v is None} == {k for k, v in wanted.items() if v is None}
        assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in wanted.items() if v is not None})
    assert any(v is None for v in by_rings(z, -20.0, 3).values())


def test_cuts_of_a_long_line(spark):
    """A line of 10^5 points is cut in one pass; short and broken ones beside it."""
    n = 100_000
    t = np.arange(n) / 50.0
    long = [{"x": float(100 * a), "y": float(20 * np.sin(a))} for a in t]
    rows = [(1, long), (2, [{"x": 0.0, "y": 0.0}, {"x": 70.0, "y": 0.0}, {"x": 70.0, "y": 0.0}, {"x": 70.0, "y": 20.0}]), (3, [{"x": 1.0, "y": 1.0}, {"x": 1.01, "y": 1.0}]), (4, None), (5, [])]
    got = network.segmentize(spark.createDataFrame(rows, "line_id long, points array<struct<x:double,y:double>>"))
    assert got.columns == ["line_id", "k", "x0", "y0", "x1", "y1", "xm", "ym", "length"]
    short = [tuple(r) for r in got.filter("line_id <> 1").orderBy("k").collect()]
    assert short == [(2, 0, 0.0, 0.0, 30.0, 0.0, 15.0, 0.0, 30.0), (2, 1, 30.0, 0.0, 60.0, 0.0, 45.0, 0.0, 30.0), (2, 2, 60.0, 0.0, 70.0, 20.0, 70.0, 5.0, 30.0)]
    x, y = 100 * t, 20 * np.sin(t)
    total = np.hypot(np.diff(x), np.diff(y)).sum()
    one = got.filter("line_id = 1").agg(F.count("*").alias("n"), F.sum("length").alias("total"), F.max("k").alias("k"), F.max("length").alias("most")).first()
    assert one["n"] == one["k"] + 1 == -(-int(np.ceil(total)) // 30) and one["total"] == pytest.approx(total) and one["most"] <= 30


def test_fill_down_over_ranges(spark):
    rnd = random.Random(9)
    rows = [(k, f"v{k}" if rnd.random() < 0.02 else None, "x") for k in range(5_000)]
    rnd.shuffle(rows)
    got = texts.fill_down(spark.createDataFrame(rows, "line long, c string, _other string").repartition(7), "c")
    last, wanted = None, {}
    for k, v, _ in sorted(rows, key=lambda r: r[0]):
        last = v or last
        wanted[k] = last
    assert {r["line"]: r["c"] for r in got.collect()} == wanted and got.columns == ["line", "c", "_other"]
    plan = got._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("ordered")[0] and ordered.filled(got.limit(0), "c", "line").count() == 0


def test_missing_folders_give_no_rows(spark, tmp_path):
    gone = str(tmp_path / "nothing here")
    assert vector.read_shapefiles(spark, gone, ["N3L"]).count() == 0
    assert rasters.read_rasters(spark, gone).count() == 0 and rasters.read_terrain_tiles(spark, gone).count() == 0


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    rnd = np.random.default_rng(kind)
    h, w, ch = 9, 11, 3
    pixels = rnd.integers(0, 256, (h, w * ch))
    lines = []
    for r in range(h):
        out = []
        for i in range(w * ch):
            a = pixels[r, i - ch] if i >= ch else 0
            b = pixels[r - 1, i] if r else 0
            c = pixels[r - 1, i - ch] if r and i >= ch else 0
            p = int(a) + int(b) - int(c)
            guess = [0, a, b, (int(a) + int(b)) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][kind]
            out.append((int(pixels[r, i]) - int(guess)) & 255)
        lines.append(bytes([kind, *out]))
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(lines))) + part(b"IEND", b"")
    assert (rasters.png_rgb(png) == pixels.reshape(h, w, ch)).all()


def test_a_warehouse_of_one_machine_is_refused_on_a_cluster(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables._warehouse(spark)  # the tests' warehouse is a local folder


def test_ranks_of_values_that_differ_between_computations(spark):
    """Sums of doubles come in any order, so a column computed twice may differ in its last bits; ranks must meet their rows still."""
    from gradewalk.operators import report, stats

    def wobbling(batches):
        for b in batches:
            yield b.assign(x=b["x"] * (1 + 1e-12 * np.random.default_rng().random(len(b))))

    rows = spark.range(40).selectExpr("id", "CAST(id + 1 AS DOUBLE) AS x").mapInPandas(wobbling, "id long, x double")
    assert stats.spearman(rows, [], "x", "id").first()["rho"] == pytest.approx(1)
    assert stats.average_ranks(rows, [], {"x": "r"}).filter("r IS NULL").count() == 0
    of = rows.selectExpr("CAST(id AS STRING) AS adm_cd", "x AS hbi_mean", "id + 1 AS n_points")
    got = report.outing_index(of, spark.range(40).selectExpr("CAST(id AS STRING) AS adm_cd", "1.0D AS pop60")).first()
    assert (got["n"], round(got["rho"], 9)) == (40, 1)


def test_first_match_sends_no_runs_through_the_driver(spark):
    """Runs of many equal names: Spark took them for as small as their file, and broadcast them."""
    from gradewalk.operators import joins

    path = f"{tables.shared_dir(spark)}/equal-names"
    spark.range(20_000).selectExpr("id", "concat('ring ', id % 3) AS name").write.mode("overwrite").parquet(path)
    sites = spark.read.parquet(path)
    keys = spark.createDataFrame([("ring",), ("g 2",), ("",), ("none",), (None,)], "key string")
    found = joins.first_match(keys, sites, "key", "name", "id")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["key"]: r["name"] for r in found.collect()} == {"ring": "ring 0", "g 2": "ring 2", "": "ring 0", "none": None, None: None}


def test_a_projection_names_each_value_once(spark):
    """Written out, the formula repeated its parts thousands of times, and the vote computed all of them for each row."""
    from gradewalk.functions import geo

    for source, target in ((5174, 4326), (4326, 5174)):
        assert str(geo.project(F.col("x"), F.col("y"), source, target)[0]).count("sin(") < 30


@pytest.mark.parametrize("kind", ["whole", "spread", "odd"])
def test_means_within_a_radius_make_no_pairs(spark, kind):
    rnd = random.Random(5)
    at = (lambda: rnd.randrange(300) * 1.0) if kind == "whole" else (lambda: rnd.random() * 300 - 100)
    points = [(at(), at(), None if k % 7 == 0 else float("inf") if kind == "odd" and k % 90 == 1 else rnd.random()) for k in range(1500)]
    left = [(k, at(), at()) for k in range(120)] + [(500, None, 1.0), (501, float("nan"), 1.0), (502, 9e6, 1.0), (503, points[0][0], points[0][1]), (504, points[0][0] + 50, points[0][1])]
    right = spark.createDataFrame(points, "rx double, ry double, v double")
    found = spatial.mean_within(spark.createDataFrame(left, "id long, x double, y double"), right, 50.0, "v", "mean")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroups")[-1]  # no join of points
    got, want = {r["id"]: (r["n"], r["mean"]) for r in found.collect()}, {}
    for i, x, y in left:
        near = [v for a, b, v in points if x is not None and (x - a) ** 2 + (y - b) ** 2 <= 2500]
        if near:
            known = [v for v in near if v is not None]
            want[i] = (len(near), pytest.approx(sum(known) / len(known), rel=1e-12) if known else None)
    assert got == want


def test_having_any_point_near_makes_no_pairs(spark):
    """A thousand points at one place, and as many asked beside it: pairs of them would be a million."""
    left = spark.range(1000).selectExpr("id", "id % 3 AS x", "0 AS y")
    right = spark.range(1000).selectExpr("CAST(4 AS INT) AS rx", "CAST(0 AS INT) AS ry")
    near, lone = (spatial.with_any(left, right, 2.0, "id", how=how) for how in ("left_semi", "left_anti"))
    assert "FlatMapCoGroupsInArrow" in near._jdf.queryExecution().executedPlan().toString()
    assert {r["x"] for r in near.collect()} == {2} and {r["x"] for r in lone.collect()} == {0, 1}
    assert near.count() + lone.count() == 1000


def test_pairs_within_a_radius_are_merged(spark):
    """Copies of points in their neighbouring cells came from a small file and went through the driver."""
    points = spark.range(5).selectExpr("id", "id * 1.0D AS x", "0.0D AS y")
    near = spatial.within(points, points.selectExpr("id AS other", "x AS rx", "y AS ry"), 1.0)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    assert near.count() == 13
