"""Readers and sinks on small files written here."""

import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewalk.sources import files, rasters, sinks, tables, vector


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_files_are_found(spark, tmp_path):
    for name in ("a/N3L_A0020000.SHP", "b/c/도로중심선.shp", "b/other.shp", "a/N3L_A0020000.dbf"):
        write(tmp_path / name, b"x")
    found = [r["path"].rsplit("/", 1)[-1] for r in files.find(spark, f"file://{tmp_path}", ["N3L_A0020000", "도로중심선"], ".shp").collect()]
    assert sorted(found) == ["N3L_A0020000.SHP", "도로중심선.shp"]
    codes = files.layer_codes(files.find(spark, f"file://{tmp_path}", [""], ".shp")).collect()
    assert [(r["code"], r["n"]) for r in codes] == [("N3L_A0020000", 1)]


@pytest.mark.parametrize("encoding", ["utf-8-sig", "cp949"])
@pytest.mark.parametrize("delimiter", [",", "|", "\t"])
def test_any_text_table(spark, tmp_path, encoding, delimiter):
    text = delimiter.join(["이름", "lon", "lat"]) + "\n" + delimiter.join(["강남", "127.0", "37.5"]) + "\n" + delimiter.join(["없음", "", ""]) + "\n"
    path = write(tmp_path / "t.csv", text.encode(encoding))
    rows = files.read_any(spark, f"file://{path}")
    assert rows.columns == ["이름", "lon", "lat"] and rows.first()["이름"] == "강남"
    placed = files.read_points(spark, f"file://{path}").collect()
    assert len(placed) == 1 and 190000 < placed[0]["x"] < 210000


def test_encoding_is_that_of_the_whole_file(spark, tmp_path):
    text = "code,name\n" + "".join(f"{k},plain{k}\n" for k in range(9000)) + "9000,강남역\n"
    assert text.index("강") > files.SAMPLE
    for encoding in ("cp949", "utf-8-sig"):
        path = write(tmp_path / f"{encoding}.csv", text.encode(encoding))
        rows = files.read_any(spark, f"file://{path}")
        assert rows.count() == 9001 and rows.filter("code = '9000'").first()["name"] == "강남역"
    with pytest.raises(ValueError, match="unknown encoding"):
        files.read_any(spark, f"file://{write(tmp_path / 'none.csv', text.encode('utf-8') + bytes([0xFF, 0xFF]))}")


def shapefile(kind, shapes, rows, encoding="cp949"):
    """(shp, dbf) bytes of lines or polygons, or points."""
    body = b""
    for k, parts in enumerate(shapes):
        if parts is None:
            content = struct.pack("<i", 0)
        elif kind == 1:
            content = struct.pack("<i2d", 1, *parts[0][0])
        else:
            flat = [p for part in parts for p in part]
            xs, ys = zip(*flat, strict=True)
            starts = np.cumsum([0] + [len(p) for p in parts])[:-1].tolist()
            content = struct.pack("<i4d2i", kind, min(xs), min(ys), max(xs), max(ys), len(parts), len(flat)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in flat)
        body += struct.pack(">2i", k + 1, len(content) // 2) + content
    shp = struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8) + body
    names = list(rows[0])
    fields = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([20]) + b"\0" * 15 for n in names) + b"\r"
    dbf = struct.pack("<4BIHH20x", 3, 26, 1, 1, len(rows), 32 + len(fields), 1 + 20 * len(names)) + fields
    for r in rows:
        dbf += b" " + b"".join((r[n] or "").encode(encoding).ljust(20) for n in names)
    return shp, dbf


def test_shapefiles(spark, tmp_path):
    shp, dbf = shapefile(3, [[[(200000.0, 545000.0), (200100.0, 545000.0)]], None, [[(200000.0, 545100.0), (200050.0, 545100.0)], [(1.0, 2.0), (3.0, 4.0)]]], [{"NAME": "가"}, {"NAME": "나"}, {"NAME": None}])
    write(tmp_path / "one/N3L_A0020000.shp", shp)
    write(tmp_path / "one/N3L_A0020000.dbf", dbf)
    shp, dbf = shapefile(1, [[[(950000.0, 1950000.0)]]], [{"OTHER": "é"}], "utf-8")
    write(tmp_path / "two/N3L_A0020000b.shp", shp)
    write(tmp_path / "two/N3L_A0020000b.dbf", dbf)
    write(tmp_path / "two/N3L_A0020000b.cpg", b"UTF-8")
    layer = vector.read_shapefiles(spark, f"file://{tmp_path}", ["N3L_A0020000"])
    rows = {(r["kind"], r["n"]): r for r in layer.collect()}
    assert set(rows) == {("line", 0), ("line", 2), ("point", 0)}
    assert rows["line", 0]["attributes"] == {"NAME": "가"} and rows["point", 0]["attributes"] == {"OTHER": "é"} and rows["line", 2]["attributes"] == {"NAME": None}
    assert vector.lines_of(layer).count() == 3 and vector.coverage(layer).count() == 2
    assert vector.in_bbox(layer, (200060.0, 544000.0, 200200.0, 545050.0)).count() == 1
    moved = {r["kind"]: r for r in vector.to_working(layer.filter("n = 0")).collect()}
    assert moved["line"]["x0"] == 200000.0 and 100000 < moved["point"]["x0"] < 300000


def test_zones(spark, tmp_path):
    import json

    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    collection = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"ADM_CD": "1", "ADM_CD_STAT": "2", "adm_nm": "서울 중구 갑동", "sggnm": "중구"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(127.0, 37.5, 0.1), square(127.04, 37.54, 0.02)], [square(127.2, 37.5, 0.1)]]}},
        {"type": "Feature", "properties": {"ADM_CD": "3", "adm_nm": "을동"}, "geometry": {"type": "Polygon", "coordinates": [square(128.0, 37.5, 0.1)]}},
    ]}
    path = write(tmp_path / "z.geojson", json.dumps(collection))
    rows = {r["adm_cd"]: r for r in vector.read_zones(spark, f"file://{path}").collect()}
    assert [len(rows[k]["rings"]) for k in "13"] == [3, 1] and rows["1"]["gu"] == "중구" and rows["3"]["gu"] is None
    assert 190000 < rows["1"]["x0"] < rows["1"]["x1"] < 250000


def test_geojson_in_ranges(spark, tmp_path):
    """A collection on one line, with brackets, quotes and backslashes in texts, and arrays before and after that aren't its features."""
    import json

    square = [[[127.0, 37.5], [127.1, 37.5], [127.1, 37.6], [127.0, 37.5]]]
    names = ["a{", 'b"]}', "c\\", 'd\\"[', '"features": [{', "각동", "x" * 300, "", "\\\\\\"]
    feature = lambda k, name: {"type": "Feature", "properties": {"ADM_CD": str(k), "adm_nm": name, "features": [{"ADM_CD": "no"}]}, "geometry": {"type": "Polygon", "coordinates": square * (1 + k % 2)}}
    rows = [feature(k, name) for k, name in enumerate(names)]
    collection = {"other": [feature(90, "no")], "crs": {"features": [feature(91, "no")]}, "name": '{"features": [', "features": rows, "more": [feature(92, "no")], "last": {"a": {"b": [1]}}}
    for text in (json.dumps(collection, ensure_ascii=False), "\ufeff" + json.dumps(collection, indent=2)):
        path = write(tmp_path / "ranges.geojson", text)
        for at_once in (37, 401, 1 << 20):
            zones = vector.read_zones(spark, f"file://{path}", at_once)
            got = [(r["adm_cd"], r["adm_nm"], len(r["rings"])) for r in zones.orderBy("ordinal").collect()]
            assert got == [(str(k), name, 1 + k % 2) for k, name in enumerate(names)]
    assert vector.read_zones(spark, f"file://{write(tmp_path / 'none.geojson', '{}')}", 1).count() == 0


def test_wkt_network(spark):
    rows = spark.createDataFrame([("LINK", "1000", "중구", "LINESTRING (127 37, 127.1 37)"), ("LINK", "100", "중구", "LINESTRING (127 37, 127.1 37.1)"), ("NODE", "1", "중구", "POINT (127 37)"), ("LINK", "1100", "남구", "MULTILINESTRING ((0 0, 1 1),(2 2, 3 3))")], "kind string, code string, gu string, w string")
    assert vector.wkt_column(rows) == "w"
    assert vector.wkt_lines(rows, "w", "code", "kind").count() == 3
    assert vector.wkt_lines(rows, "w", "code", "kind", "gu", ["중구"]).count() == 1
    assert vector.wkt_lines(rows, "w", box=(1.5, 1.5, 4.0, 4.0)).count() == 1


def tiff(z, left, top, size, deflate=False):
    raw = z.astype("<f4").tobytes()
    raw = zlib.compress(raw) if deflate else raw
    entries = [(256, 3, 1, z.shape[1]), (257, 3, 1, z.shape[0]), (258, 3, 1, 32), (259, 3, 1, 8 if deflate else 1), (273, 4, 1, 8), (278, 3, 1, z.shape[0]), (279, 4, 1, len(raw)), (339, 3, 1, 3)]
    doubles = [(33550, [size, size, 0.0]), (33922, [0.0, 0.0, 0.0, left, top, 0.0])]
    at = 8 + len(raw)
    tail_at, tail, body = at + 2 + 12 * (len(entries) + 2) + 4, b"", b""
    for t, kind, n, v in entries:
        body += struct.pack("<HHI", t, kind, n) + (struct.pack("<HH", v, 0) if kind == 3 else struct.pack("<I", v))
    for t, vs in doubles:
        body += struct.pack("<HHII", t, 12, len(vs), tail_at + len(tail))
        tail += struct.pack(f"<{len(vs)}d", *vs)
    return struct.pack("<2sHI", b"II", 42, at) + raw + struct.pack("<H", len(entries) + 2) + body + b"\0" * 4 + tail


def test_rasters(spark, tmp_path):
    z = np.arange(12, dtype=float).reshape(3, 4)
    asc = "ncols 4\nnrows 3\nxllcorner 100\nyllcorner 200\ncellsize 5\nNODATA_value -9999\n" + "\n".join(" ".join(str(v if v != 5 else -9999) for v in r) for r in z)
    write(tmp_path / "a.asc", asc)
    write(tmp_path / "b.tif", tiff(z + 100, 120.0, 215.0, 5.0))
    write(tmp_path / "c.tif", tiff(np.full((3, 4), 5000.0), 140.0, 215.0, 5.0, True))
    pixels = rasters.read_rasters(spark, f"file://{tmp_path}")
    assert pixels.count() == 23
    m = {(r["row"], r["col"]): r["z"] for r in rasters.mosaic(pixels, 5.0, (100.0, 215.0)).collect()}
    assert m[0, 0] == 0 and m[2, 3] == 11 and (1, 1) not in m and m[0, 4] == 100 and m[2, 7] == 111
    assert rasters.read_rasters(spark, f"file://{tmp_path}", (100.0, 200.0, 101.0, 201.0)).count() < 15


def png(rgb):
    h, w, _ = rgb.shape
    lines, above = b"", np.zeros(w * 3, np.int64)
    for r in range(h):
        line = rgb[r].reshape(-1).astype(np.int64)
        left = np.concatenate([[0, 0, 0], line[:-3]])
        kind = r % 4
        corner = np.concatenate([[0, 0, 0], above[:-3]])
        if kind == 3:
            guess = (left + above) // 2
        else:
            guess = [np.zeros_like(line), left, above][kind] if r != 5 else np.zeros_like(line)
        if r == 4:
            kind, p = 4, left + above - corner
            pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
            guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
        lines += bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        above = line
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_terrain_tiles(spark, tmp_path):
    rgb = np.random.RandomState(1).randint(0, 256, (5, 4, 3)).astype(np.uint8)
    assert (rasters.png_rgb(png(rgb)) == rgb).all()
    write(tmp_path / "15_2_3.png", png(rgb))
    got = {(r["row"], r["col"]): r["z"] for r in rasters.read_terrain_tiles(spark, f"file://{tmp_path}").collect()}
    p = rgb.astype(float)
    assert got[3 * 256 + 4, 2 * 256 + 1] == p[4, 1, 0] * 256 + p[4, 1, 1] + p[4, 1, 2] / 256 - 32768


def test_population_layouts(spark):
    a = spark.createDataFrame([("1111051500", "202504", "1,000", "5", "7"), ("1111000000", "202504", "9", "9", "9"), ("x", "1", "1", "1", "1")], ["행정기관코드", "기준연월", "64세 남자", "65세남자", "100세이상 여자"])
    assert [tuple(r) for r in tables.population(a).collect()] == [("1111051500", 12)]
    assert [tuple(r) for r in tables.population(a, 60).collect()] == [("1111051500", 1012)]
    b = spark.createDataFrame([("서울 종로구 갑동(1111051500)", "1,234"), ("서울 종로구(1111000000)", "9"), ("없음", "1")], ["행정구역", "2025년_65세이상전체"])
    assert [tuple(r) for r in tables.population(b).collect()] == [("1111051500", 1234)]
    with pytest.raises(ValueError):
        tables.population(b.filter("`행정구역` LIKE '%00000)'"))
    with pytest.raises(ValueError):
        tables.population(b, 60)


def test_statistics_layouts(spark, tmp_path):
    read = lambda name, text, cols: sorted(tuple(r) for r in tables.statistics(spark, "file://" + write(tmp_path / name, text), cols).collect())
    plain = "자치구,동,기준,인구\n,,명,명\n종로구,합계,1,9\n,갑동,1,\"1,200\"\n,을동,1,-\n중구,병동,1,5\n"
    assert read("a.csv", plain, ["인구"]) == [("종로구", "갑동", 1200.0), ("종로구", "을동", None), ("중구", "병동", 5.0)]
    compound = "동별(1),동별(2),동별(3),2024,2024\n동별(1),동별(2),동별(3),수급자,수급자\n동별(1),동별(2),동별(3),소계,남자\n합계,소계,소계,99,9\n합계,종로구,소계,50,5\n합계,종로구,갑동,20,2\n,,을동,30,3\n"
    assert read("b.csv", compound, ["수급자"]) == [("종로구", "갑동", 20.0), ("종로구", "을동", 30.0)]
    long = "동별,항목,구분,단위,2024\n합계,수,계,명,99\n종로구,수,계,명,50\n갑동,수,계,명,20\n갑동,수,남,명,8\n을동,수,계,명,X\n중구,수,계,명,5\n병동,수,계,명,5\n"
    assert read("c.csv", long, ["계"]) == [("종로구", "갑동", 20.0), ("종로구", "을동", None), ("중구", "병동", 5.0)]


def test_point_tables(spark):
    rows = spark.createDataFrame([(" 갑 ", "127.05", "37.55", "서울특별시 중구 1", "영업"), ("을", "127.5", "37.55", "서울 중구 2", "폐업"), ("병", None, "1", "부산 중구", None)], ["name", "lon", "lat", "addr", "state"])
    square = [[{"x": a, "y": b} for a, b in ((127.0, 37.5), (127.1, 37.5), (127.1, 37.6), (127.0, 37.6))]]
    zones = spark.createDataFrame([("중구", square, 127.0, 37.5, 127.1, 37.6)], "gu string, rings array<array<struct<x:double,y:double>>>, x0 double, y0 double, x1 double, y1 double")
    assert [r["name"] for r in tables.named_points(rows, "name", "lon", "lat", zones=zones).collect()] == ["갑"]
    assert tables.named_points(rows, "name", "lon", "lat").count() == 2
    assert [r["name"] for r in tables.open_places(rows, "addr", "state").collect()] == [" 갑 "]
    from gradewalk.functions.geo import project

    x, y = project(F.col("lon").cast("double"), F.col("lat").cast("double"), 4326, 5181)
    votes = tables.vote_code(rows.limit(1).withColumn("px", x.cast("string")).withColumn("py", y.cast("string")), "px", "py", "addr", zones.withColumn("x0", F.lit(127.0)))
    best = votes.first()
    assert (best["code"], best["agree"], best["n"]) in ((5181, 1, 1), (2097, 1, 1), (5174, 1, 1))
    nodes = spark.createDataFrame([("a", "0", "POINT(1 2)"), ("a", "1", "POINT (3 4)"), ("b", "0", "POINT(5 6)"), ("b", "2", "POINT(7 8)")], ["name", "kind", "wkt"])
    assert sorted(tuple(r) for r in tables.station_nodes(nodes, "name", "kind", "wkt").collect()) == [("a", 3.0, 4.0), ("b", 5.0, 6.0)]


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("가", 1.23456, 1), ("나", None, 2)], "name string, v double, k long")
    sinks.write_csv(sinks.rounded(frame), f"{tmp_path}/out/x.csv")
    data = (tmp_path / "out/x.csv").read_bytes()
    assert data.startswith(b"\xef\xbb\xbf") and data.decode("utf-8-sig").splitlines() == ["name,v,k", "가,1.2346,1", "나,,2"]
    cells = frame.withColumn("geom", sinks.cell_wkb(F.lit(0.0), F.lit(0.0), F.lit(250.0)))
    sinks.write_gpkg(cells, f"{tmp_path}/out/x.gpkg", "cells", "geom", "POLYGON")
    db = sqlite3.connect(f"{tmp_path}/out/x.gpkg")
    rows = db.execute("select name, v, k, geom from cells order by k").fetchall()
    assert [r[:3] for r in rows] == [("가", 1.23456, 1), ("나", None, 2)] and rows[0][3][:2] == b"GP" and struct.unpack("<I", rows[0][3][41:45])[0] == 3
    assert db.execute("pragma application_id").fetchone()[0] == sinks.APPLICATION_ID


def test_profile(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), (None, 2)], "c string, d long")
    got = {(r["column"], r["value"]): r["n"] for r in files.profile(frame, ["c", "d"], 2).collect()}
    assert got == {("c", "a"): 2, ("c", "b"): 1, ("d", "2"): 3, ("d", "1"): 1}


def test_streamed_points_meet_cells(spark, tmp_path):
    from gradewalk.streaming.points import cell_counts

    cells = spark.createDataFrame([(125.0, 125.0, 10)], "cell_x double, cell_y double, n_bld long")
    rows = spark.createDataFrame([("2024-01-01 05:00:00", 10.0, 20.0, 2.0), ("2024-01-01 23:00:00", 30.0, 20.0, 3.0), ("2024-01-02 01:00:00", 30.0, 20.0, 1.0), ("2024-01-01 05:00:00", 900.0, 20.0, 9.0)], "ts string, x double, y double, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = cell_counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), cells)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("cells_now").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {r["day"].day: (r["n_points"], r["value"], r["per100_bld"]) for r in spark.table("cells_now").collect()}
    assert got == {1: (2, 5.0, 20.0), 2: (1, 1.0, 10.0)}
