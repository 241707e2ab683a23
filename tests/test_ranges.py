"""Rasters and shapefiles read in ranges: by many tasks, no more than a box needs, and from stores that only Spark reads."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewalk.sources import ranges, rasters, vector


def tiled_tiff(z, left, top, size, tile, nodata=None, order="<"):
    """A deflated GeoTIFF of float tiles."""
    h, w = z.shape
    blocks = []
    for r in range(0, h, tile):
        for c in range(0, w, tile):
            block = np.zeros((tile, tile), np.dtype(order + "f4"))
            part = z[r : r + tile, c : c + tile]
            block[: part.shape[0], : part.shape[1]] = part
            blocks.append(zlib.compress(block.tobytes()))
    n, at = len(blocks), 8
    offsets = []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    extra, entries = b"", []
    tags = [(256, 3, [w]), (257, 3, [h]), (258, 3, [32]), (259, 3, [8]), (322, 3, [tile]), (323, 3, [tile]), (324, 4, offsets), (325, 4, [len(b) for b in blocks]), (339, 3, [3]), (33550, 12, [size, size, 0.0]), (33922, 12, [0.0, 0.0, 0.0, left, top, 0.0])]
    ifd = at
    place = ifd + 2 + 12 * (len(tags) + (nodata is not None)) + 4
    if nodata is not None:
        tags.append((42113, 2, nodata.encode() + b"\0"))
    for tag, kind, values in tags:
        raw = values if kind == 2 else struct.pack(f"{order}{len(values)}{ {3: 'H', 4: 'I', 12: 'd'}[kind] }", *values)
        if len(raw) <= 4:
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        else:
            entries.append(struct.pack(order + "HHII", tag, kind, len(values), place + len(extra)))
            extra += raw
    assert n == len(offsets)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, ifd) + b"".join(blocks) + struct.pack(order + "H", len(tags)) + b"".join(entries) + struct.pack(order + "I", 0) + extra


@pytest.mark.parametrize("order", ["<", ">"])
def test_a_box_of_a_large_raster_reads_its_tiles_only(spark, tmp_path, order, monkeypatch):
    rnd = np.random.default_rng(3)
    z = rnd.uniform(0, 500, (1500, 1300)).astype(np.float32)
    z[700:720, 600:650] = -9999
    data = tiled_tiff(z, 1000.0, 9000.0, 2.0, 64, "-9999", order)
    (tmp_path / "높이 map.tif").write_bytes(data)
    root = f"file://{tmp_path}"
    box = (1000 + 2 * 590.0, 9000 - 2 * 790.0, 1000 + 2 * 720.0, 9000 - 2 * 640.0)  # one pixel in a hundred
    read = rasters.raster_splits(spark, root, box).agg(F.sum(F.element_at("ends", -1) - F.col("at"))).first()[0]
    assert read < 0.05 * len(data)
    got = {(r["x"], r["y"]): r["z"] for r in rasters.read_rasters(spark, root, box).collect()}
    wanted = {}
    for r in range(1500):
        for c in range(1300) if 600 <= r <= 830 else ():
            x, y = 1000 + 2 * (c + 0.5), 9000 - 2 * (r + 0.5)
            if box[0] - 4 <= x <= box[2] + 4 and box[1] - 4 <= y <= box[3] + 4 and z[r, c] > -100:
                wanted[x, y] = float(z[r, c])
    assert got == wanted and len(got) < 135 * 155
    splits = rasters.raster_splits(spark, root)
    assert splits.count() > 4 and splits.agg(F.max(F.element_at("ends", -1) - F.col("at"))).first()[0] <= rasters.READ_AT_ONCE
    assert rasters.read_rasters(spark, root).count() == 1500 * 1300 - 20 * 50
    monkeypatch.setattr(ranges, "by_range", lambda root: False)  # as where Spark alone reads the store
    assert {(r["x"], r["y"]): r["z"] for r in rasters.read_rasters(spark, root, box).collect()} == wanted


def shapefile(folder, name, n, index=True):
    """n lines of 40 points with two fields; returns the envelopes."""
    body, at, index_rows, boxes = b"", 100, b"", []
    for k in range(n):
        xs, ys = 10.0 * k + np.arange(40) / 10, 5.0 * (k % 7) + np.arange(40) / 10
        points = b"".join(struct.pack("<2d", x, y) for x, y in zip(xs, ys, strict=True))
        rec = struct.pack("<i4d2ii", 3, xs.min(), ys.min(), xs.max(), ys.max(), 1, 40, 0) + points if k % 11 else struct.pack("<i", 0)
        boxes.append((xs.min(), ys.min(), xs.max(), ys.max()))
        body += struct.pack(">2i", k + 1, len(rec) // 2) + rec
        index_rows += struct.pack(">2i", at // 2, len(rec) // 2)
        at += 8 + len(rec)
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, at // 2) + struct.pack("<2i8d", 1000, 3, *[0.0] * 8)
    (folder / f"{name}.shp").write_bytes(head + body)
    if index:
        (folder / f"{name}.shx").write_bytes(head + index_rows)
    fields = b"".join(f.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([size]) + bytes(15) for f, size in (("NAME", 12), ("KIND", 6)))
    rows = b"".join(b" " + f"길{k}".encode("cp949").ljust(12) + f"k{k % 5}".encode().ljust(6) for k in range(n))
    (folder / f"{name}.dbf").write_bytes(bytes(4) + struct.pack("<IHH", n, 32 + len(fields) + 1, 19) + bytes(20) + fields + b"\r" + rows)
    return boxes


@pytest.mark.parametrize("whole", [False, True])
def test_a_shapefile_is_read_by_several_tasks(spark, tmp_path, monkeypatch, whole):
    n = 3_000
    boxes = shapefile(tmp_path, "N3L_길", n)
    shapefile(tmp_path, "N3L_other", 50, index=False)
    shapefile(tmp_path, "unasked", 5)
    monkeypatch.setattr(vector, "READ_AT_ONCE", 200_000)
    if whole:
        monkeypatch.setattr(ranges, "by_range", lambda root: False)
    root = f"file://{tmp_path}"
    splits = vector.shape_splits(spark, root, ["N3L"])
    assert splits.filter("path LIKE '%길'").count() >= 9 and splits.agg(F.sum("records")).first()[0] == n + 50
    layer = vector.read_shapefiles(spark, root, ["N3L"])
    one = {r["n"]: r for r in layer.filter("path LIKE '%길'").collect()}
    assert set(one) == {k for k in range(n) if k % 11}
    assert all(tuple(r[c] for c in ("x0", "y0", "x1", "y1")) == pytest.approx(boxes[k]) and dict(r["attributes"]) == {"NAME": f"길{k}", "KIND": f"k{k % 5}"} for k, r in one.items())
    assert layer.filter("path LIKE '%other'").count() == 45
    box = (5_000.0, 0.0, 5_300.0, 12.0)
    few = {r["n"]: r for r in vector.read_shapefiles(spark, root, ["길"], box=box, fields=["KIND"]).collect()}
    meets = lambda b: b[2] >= box[0] and b[3] >= box[1] and b[0] <= box[2] and b[1] <= box[3]
    assert set(few) == {k for k, b in enumerate(boxes) if k % 11 and meets(b)} and all(set(dict(r["attributes"])) == {"KIND"} for r in few.values())
    looked = []
    body = struct.pack("<i4d", 3, *boxes[1])
    assert vector.shape(body, (-9.0, -9.0, -8.0, -8.0)) == (None, looked)  # told by the envelope: there are no points to decode
