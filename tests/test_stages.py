"""A full run over the made-up quarter, and the shape and preview operators."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from gradewalk.operators import preview, raster, shapes
from gradewalk.plans import fixture, stages


@pytest.fixture(scope="module")
def layers(spark):
    covers = spark.createDataFrame([(fixture.X0, fixture.Y0, fixture.X0 + 1000, fixture.Y0 + 2000), (fixture.X0 + 1000, fixture.Y0, fixture.X0 + 2000, fixture.Y0 + 2000)], "x0 double, y0 double, x1 double, y1 double")
    return stages.Layers(fixture.lines(spark), fixture.stairs(spark), fixture.level(spark), fixture.buildings(spark), fixture.stops(spark), fixture.dem(spark), (fixture.X0, fixture.Y0 + 2000), 5.0, covers, fine_pixels=fixture.dem(spark, 10), fine_pixel_m=10.0)


def test_full_run(spark, layers, tmp_path):
    nodes, links = stages.network_stage(layers)
    rows = stages.index_stage(layers, nodes, links)
    kinds = {r["kind"]: r["n"] for r in links.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds[0] > 2500 and kinds[1] >= 8
    assert links.filter("flat").count() > 0 and links.filter("is_stair AND kind = 0").count() > 0
    check = stages.checks(nodes.count(), nodes, rows).first()
    assert check["kept_share"] >= 0.9 and check["height_missing"] <= 0.05 and check["snapped_share"] >= 0.95 and 1.0 <= check["hbi_median"] <= 1.5
    assert rows.filter("hbi < 1 - 1e-9").count() == 0
    assert {r[0] for r in rows.select("target").distinct().collect()} == {"medical", "elderly", "bus", "station"}
    assert 0 < rows.filter("edge").count() < rows.count()
    assert rows.filter("t_wheel_stairok > t_wheel + 1e-6").count() == 0
    assert rows.filter("abs(hbi - hbi_dem1) > 0.2").count() == 0
    tables = stages.export_stage(rows, fixture.parcels(spark))
    assert tables["grid"].filter("n_bld < 5").count() == 0 and tables["grid"].count() > 0
    assert tables["summary"].count() == 44
    assert tables["parcel_by_legal_district"].count() == 2
    wide = stages.wide_table(rows)
    assert wide.count() == rows.select("id").distinct().count() and "bus_hbi" in wide.columns
    stages.write({"grid": tables["grid"]}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/grid").count() == tables["grid"].count()


def test_simplify_keeps_the_outline(spark):
    rnd = random.Random(2)
    ring = [(100 * math.cos(k / 50 * math.pi) + rnd.uniform(-1, 1), 100 * math.sin(k / 50 * math.pi)) for k in range(100)]
    pts = [{"x": x, "y": y} for x, y in ring + ring[:1]]
    kept = shapes.simplified(pts, 5.0)
    assert 6 < len(kept) < 40 and kept[0] == kept[-1] == pts[0]

    def off(p):
        return min(abs((b["x"] - a["x"]) * (a["y"] - p["y"]) - (a["x"] - p["x"]) * (b["y"] - a["y"])) / max(math.hypot(b["x"] - a["x"], b["y"] - a["y"]), 1e-9) for a, b in zip(kept, kept[1:], strict=False))

    assert max(map(off, pts)) <= 5.0
    frame = spark.createDataFrame([([pts],)], f"rings array<{shapes.RING}>")
    assert len(frame.select(shapes.simplify(F.col("rings"), 5.0).alias("r")).first()["r"][0]) == len(kept)


def test_strips_cover_the_cells(spark):
    rnd = random.Random(3)
    cells = {(rnd.randrange(8), rnd.randrange(8)) for _ in range(30)}
    frame = spark.createDataFrame([("a", x, y) for x, y in cells], "name string, gx long, gy long")
    strips = shapes.strips(frame, ["name"], 5.0)
    rows = strips.collect()
    assert sum((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) for r in rows) == 25 * len(cells)
    geom = shapes.multipolygons(strips, ["name"]).first()["geom"]
    assert struct.unpack("<BII", bytes(geom[:9])) == (1, 6, len(rows))


def test_raster_index(spark):
    pixels = fixture.dem(spark, 100, 250.0)
    index = preview.raster_index(pixels, 100.0, spark.createDataFrame([(0, 0)], "row int, col int"))
    got = {(r["row"], r["col"]): r["hbi"] for r in index.collect()}
    assert len(got) == 400 and got[0, 0] == 1.0 and min(got.values()) >= 1 - 1e-9 and max(got.values()) > 1.2
    hidden = preview.hidden_by_blocks(index, 5).first()
    assert hidden["n"] == sum(v >= 1.3 for v in got.values())
    assert raster.block_mean(pixels, 4).count() == 25


def test_control_run(spark):
    from gradewalk.functions.geo import mercator_pixel, project
    from gradewalk.plans import control

    x, y = [fixture.X0 + 50.0 * k for k in range(41)], [fixture.Y0 + 100.0 * k for k in range(11)]
    rows = [(k, [(a, b) for a in x]) for k, b in enumerate(y)] + [(100 + k, [(a, b) for b in y]) for k, a in enumerate(x[::4])]
    flat = spark.createDataFrame([(k, n, float(a), float(b)) for k, pts in rows for n, (a, b) in enumerate(pts)], "line_id long, n int, x double, y double")
    lon, lat = project(F.col("x"), F.col("y"), 5186, 4326)
    lines = flat.select("line_id", "n", lon.alias("x"), lat.alias("y")).groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("n", "x", "y"))).alias("p")).select("line_id", F.transform("p", lambda q: F.struct(q["x"], q["y"])).alias("points"))
    px, py = mercator_pixel(lon, lat)
    box = flat.select(F.floor(F.min(px)).alias("a"), F.floor(F.max(px)).alias("b"), F.floor(F.min(py)).alias("c"), F.floor(F.max(py)).alias("d")).first()
    pixels = spark.createDataFrame([(r, c, 50.0 + 3.0 * (c - box["a"]) if (r, c) != (box["c"] + 5, box["a"] + 9) else -500.0) for r in range(box["c"] - 3, box["d"] + 4) for c in range(box["a"] - 3, box["b"] + 4)], "row long, col long, z double")
    stations = spark.createDataFrame([(1, fixture.X0 + 10.0, fixture.Y0 + 10.0, "station")], "id long, x double, y double, target string")
    grid, _ = control.run(lines, stations, pixels)
    got = grid.collect()
    assert len(got) >= 20 and all(r["hbi_mean"] > 1.1 for r in got if r["cell_x"] > fixture.X0 + 250)
    _, same = control.run(lines, stations, pixels, grid)
    r = same.first()
    assert r["n_common"] == len(got) and r["mean_abs_diff"] == 0 and r["rank_corr"] == pytest.approx(1) and r["top10_agree"] == 1


def test_stored_tables(spark, tmp_path):
    from gradewalk.sources import stores

    wide = spark.createDataFrame([("1", "2.0", "1.5", ""), ("2", "3.0", "", "1.25")], "id string, x string, bus_hbi string, medical_hbi string")
    assert stores.targets(wide) == ["bus", "medical"]
    got = {(r["id"], r["target"]): r["hbi"] for r in stores.long_table(wide, ["hbi"]).collect()}
    assert got == {("1", "bus"): 1.5, ("1", "medical"): None, ("2", "bus"): None, ("2", "medical"): 1.25}
    stores.write_network(wide, wide, str(tmp_path))
    assert [f.count() for f in stores.read_network(spark, str(tmp_path))] == [2, 2]
    wide.withColumn("edge", F.col("id") == "1").withColumn("target", F.lit("bus")).write.parquet(f"{tmp_path}/b")
    assert stores.read_buildings(spark, f"{tmp_path}/b", "bus").count() == 1
    assert stores.prefer(["b", "a60", "a"]) == "a60" and stores.prefer([]) is None
