"""GeoPackages read back by a parser of this test's own: layout, bounds, index, projection text."""

import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from gradewalk.sources import sinks, vector


def parsed(path):
    db = sqlite3.connect(path)
    assert db.execute("PRAGMA application_id").fetchone()[0] == 0x47504B47
    table, x0, y0, x1, y1, srs = db.execute("SELECT table_name, min_x, min_y, max_x, max_y, srs_id FROM gpkg_contents").fetchone()
    text = db.execute("SELECT definition FROM gpkg_spatial_ref_sys WHERE srs_id = ?", (srs,)).fetchone()[0]
    rows = []
    for fid, blob, *values in db.execute(f"SELECT * FROM {table}"):
        magic, flags, own = blob[:2], blob[3], struct.unpack("<i", blob[4:8])[0]
        assert magic == b"GP" and flags == 3 and own == srs
        box = struct.unpack("<4d", blob[8:40])
        order, kind = struct.unpack("<BI", blob[40:45])
        assert order == 1
        if kind == 1:
            points = [struct.unpack("<2d", blob[45:61])]
        else:
            rings, n = struct.unpack("<II", blob[45:53])
            points = [struct.unpack("<2d", blob[53 + 16 * k : 69 + 16 * k]) for k in range(n)]
            assert points[0] == points[-1] and rings == 1
        assert box == (min(p[0] for p in points), max(p[0] for p in points), min(p[1] for p in points), max(p[1] for p in points))
        rows.append((fid, points, values))
    index = {r[0]: r[1:] for r in db.execute(f"SELECT * FROM rtree_{table}_geom")}
    assert set(index) == {fid for fid, _, _ in rows} and db.execute("SELECT extension_name FROM gpkg_extensions").fetchone()[0] == "gpkg_rtree_index"
    every = [p for _, points, _ in rows for p in points]
    assert (x0, y0, x1, y1) == (min(p[0] for p in every), min(p[1] for p in every), max(p[0] for p in every), max(p[1] for p in every))
    inside = db.execute(f"SELECT count(*) FROM rtree_{table}_geom WHERE minx <= ? AND maxx >= ?", (x0 + 1, x0)).fetchone()[0]
    assert inside >= 1
    return rows, text


def test_parts_written_by_tasks(spark, tmp_path):
    rows = spark.range(200).select("id", (F.col("id") / 3).alias("v"), F.concat(F.lit("집"), "id").alias("name"), sinks.cell_wkb(F.col("id") * 100.0, F.col("id") * 50.0, F.lit(250.0)).alias("g"))
    told = sinks.write_gpkg_parts(rows.repartition(3), f"file://{tmp_path}/out", "cells", "g", "POLYGON")
    assert told.count() == 3 and told.agg(F.sum("rows")).first()[0] == 200
    found = [r for p in sorted((tmp_path / "out").glob("*.gpkg")) for r in parsed(p)[0]]
    assert {v[0]: (round(v[1] * 3), v[2], p[0]) for _, p, v in found} == {k: (k, f"집{k}", (100.0 * k, 50.0 * k)) for k in range(200)}
    back = vector.read_gpkg(spark, f"file://{tmp_path}/out", "cells")
    assert {(r["attributes"]["name"], r["x0"], r["y1"]) for r in back.collect()} == {(f"집{k}", 100.0 * k, 50.0 * k + 250) for k in range(200)}
    assert vector.read_gpkg(spark, f"file://{tmp_path}/none", "cells").count() == 0
    assert sinks.write_gpkg_parts(rows.limit(0), f"file://{tmp_path}/nothing", "cells", "g", "POLYGON").count() == 0


@pytest.mark.parametrize("srs", [5186, 5179, 4326])
def test_one_file_of_points(spark, tmp_path, srs):
    rows = spark.createDataFrame([(1, 5.0, 7.0), (2, -3.0, 9.0), (3, None, None)], "id int, x double, y double")
    layer = rows.select("id", F.when(F.col("x").isNotNull(), sinks.point_wkb(F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0)))).alias("g"))
    sinks.write_gpkg(layer, f"{tmp_path}/p.gpkg", "points", "g", "POINT", srs)
    found, text = parsed(f"{tmp_path}/p.gpkg")
    assert [(p[0], v) for _, p, v in found] == [((5.0, 7.0), [1]), ((-3.0, 9.0), [2])]
    assert f'AUTHORITY["EPSG","{srs}"]' in text and text.count("[") == text.count("]") and ("PROJCS" in text) == (srs != 4326)


def test_bounds_of_multipolygons():
    square = lambda x, y: [[(x, y), (x + 2, y), (x + 2, y + 3), (x, y)]]
    assert sinks.wkb_bounds(sinks.wkb_multipolygon([square(0, 0), square(10, -4), square(5, 5)])) == (0.0, 12.0, -4.0, 8.0)
    assert sinks.wkb_bounds(sinks.wkb_multipolygon([])) is None and sinks.gpkg_blob(sinks.wkb_multipolygon([]), 5186)[3] == 0x11
