"""Elevation rasters (ASCII grids, simple GeoTIFFs, terrain tiles) as pixel tables."""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.operators.raster import HIGHEST, LOWEST
from gradewalk.sources.files import contents
from gradewalk.sources.ranges import Ranges, listed

PIXELS = "path string, x double, y double, z float"


def ascii_grid(data: bytes) -> tuple[np.ndarray, float, float, float]:
    """(heights with nan for missing, x of the left edge, y of the top edge, pixel size)."""
    lines, head = data.decode("ascii").split("\n"), {}
    while lines and lines[0].split() and lines[0].split()[0][0].isalpha():
        k, v = lines.pop(0).split()[:2]
        head[k.lower()] = float(v)
    rows, cols, size = int(head["nrows"]), int(head["ncols"]), head["cellsize"]
    z = np.array(" ".join(lines).split(), np.float64)[: rows * cols].reshape(rows, cols)
    z[z == head.get("nodata_value", -9999)] = np.nan
    half = size / 2
    left = head["xllcorner"] if "xllcorner" in head else head["xllcenter"] - half
    bottom = head["yllcorner"] if "yllcorner" in head else head["yllcenter"] - half
    return z, left, bottom + rows * size, size


# Fixed values of the TIFF format: tags and the sizes of field types.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _ROWS, _COUNTS, _PREDICTOR, _TILE_W, _TILE_H, _TILE_OFFSETS, _TILE_COUNTS, _FORMAT, _SCALE, _TIE, _NODATA = 256, 257, 258, 259, 273, 278, 279, 317, 322, 323, 324, 325, 339, 33550, 33922, 42113
_SIZES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}


#: Bytes of neighbouring tiles or strips that are read at once.
READ_AT_ONCE = 1 << 20
_SPLIT = "path string, content binary, kind string, ks array<int>, at long, ends array<long>, shape array<int>, dtype string, packed boolean, nodata double, place array<double>"


@dataclass
class Layout:
    """What a one-band GeoTIFF's directory says: size, tiles or strips and where they lie, and the place on the map."""

    width: int
    height: int
    across: int  # tiles beside each other
    tile: tuple[int, int]  # height, width
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    dtype: str
    packed: bool
    nodata: float | None
    left: float
    top: float
    size: float

    def touched(self, box: tuple[float, float, float, float] | None) -> list[int]:
        """Tiles with pixels in a box, or up to two pixels outside it."""
        rows, cols = -(-self.height // self.tile[0]), self.across
        if box is None:
            return list(range(rows * cols))
        row = lambda y: math.floor((self.top - y) / self.size)
        col = lambda x: math.floor((x - self.left) / self.size)
        r = range(max(0, (row(box[3]) - 2) // self.tile[0]), min(rows - 1, (row(box[1]) + 2) // self.tile[0]) + 1)
        c = range(max(0, (col(box[0]) - 2) // self.tile[1]), min(cols - 1, (col(box[2]) + 2) // self.tile[1]) + 1)
        return [i * cols + j for i in r for j in c]


def layout(f: Ranges) -> Layout:
    """Of one-band strips or tiles, plain or deflated, without a predictor; reads the directory only."""
    head = f.read(0, 8)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    at = struct.unpack(order + "I", head[4:8])[0]
    n = struct.unpack(order + "H", f.read(at, 2))[0]
    entries, tags = f.read(at + 2, 12 * n), {}
    for k in range(n):
        entry = entries[12 * k : 12 * k + 12]
        tag, kind, many = struct.unpack(order + "HHI", entry[:8])
        if kind in _SIZES:
            size, letter = _SIZES[kind]
            raw = entry[8 : 8 + many * size] if many * size <= 4 else f.read(struct.unpack(order + "I", entry[8:12])[0], many * size)
            tags[tag] = raw if letter == "c" else struct.unpack(f"{order}{many}{letter}", raw)
    one = lambda t, default=None: tags.get(t, (default,))[0]
    if one(_COMPRESSION, 1) not in (1, 8, 32946) or one(_PREDICTOR, 1) != 1:
        raise ValueError("a TIFF compression that is not read here")
    w, h = one(_WIDTH), one(_HEIGHT)
    tile = (one(_TILE_H), one(_TILE_W)) if _TILE_W in tags else (one(_ROWS, h), w)
    scale, tie = tags[_SCALE], tags[_TIE]
    nodata = float(tags[_NODATA].split(b"\0")[0]) if _NODATA in tags else None
    dtype = order + {1: "u", 2: "i", 3: "f"}[one(_FORMAT, 1)] + str(one(_BITS) // 8)
    return Layout(w, h, -(-w // tile[1]), tile, tags.get(_TILE_OFFSETS) or tags[_OFFSETS], tags.get(_TILE_COUNTS) or tags[_COUNTS], dtype, one(_COMPRESSION, 1) != 1, nodata, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0])


def raster_splits(spark: SparkSession, root: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """What read_rasters reads of each raster under root: ranges of neighbouring tiles or strips that a box touches; ASCII grids whole.

    at and ends are the range's bounds: ends[k] is where the k-th tile ends, and the last one where reading does. Where Spark
    brought the file, content is that range of it."""

    def plan(batches):
        part = lambda f, at, end: None if f.content is None else f.read(at, end - at)
        for b in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                f = Ranges(path, content)
                if path.lower().endswith(".asc"):
                    rows.append((path, content, "text", [], 0, [f.size], [], "", False, None, []))
                    continue
                y = layout(f)
                shape, place = [y.height, y.width, y.across, *y.tile], [y.left, y.top, y.size]
                ks: list[int] = []
                for k in sorted(y.touched(box), key=lambda k: y.offsets[k]):
                    if ks and (y.offsets[k] != ends[-1] or y.offsets[k] + y.counts[k] - y.offsets[ks[0]] > READ_AT_ONCE):
                        rows.append((path, part(f, y.offsets[ks[0]], ends[-1]), "tiff", ks, y.offsets[ks[0]], ends, shape, y.dtype, y.packed, y.nodata, place))
                        ks = []
                    ends = [*(ends if ks else []), y.offsets[k] + y.counts[k]]
                    ks = [*ks, k]
                if ks:
                    rows.append((path, part(f, y.offsets[ks[0]], ends[-1]), "tiff", ks, y.offsets[ks[0]], ends, shape, y.dtype, y.packed, y.nodata, place))
                f.close()
            types = [pa.string(), pa.binary(), pa.string(), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.string(), pa.bool_(), pa.float64(), pa.list_(pa.float64())]
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _SPLIT.split(", ")])

    return listed(spark, root, ("asc", "tif", "tiff")).mapInArrow(plan, _SPLIT)


def read_rasters(spark: SparkSession, root: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """path, x, y (pixel centres) and z of all rasters under root; no-data and impossible heights are left out.

    With a box, pixels farther than two pixels outside it are too, and their tiles aren't read. Many tasks share a file."""

    def pixels(path: str, z: np.ndarray, left: float, top: float, size: float) -> pa.RecordBatch:
        rows, cols = np.nonzero(np.isfinite(z) & (z >= LOWEST) & (z <= HIGHEST))
        x, y = left + (cols + 0.5) * size, top - (rows + 0.5) * size
        if box is not None:
            inside = (x >= box[0] - 2 * size) & (x <= box[2] + 2 * size) & (y >= box[1] - 2 * size) & (y <= box[3] + 2 * size)
            x, y, rows, cols = x[inside], y[inside], rows[inside], cols[inside]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(x), pa.string()), pa.array(x), pa.array(y), pa.array(z[rows, cols].astype(np.float32))], names=["path", "x", "y", "z"])

    def decode(batches):
        for b in batches:
            for path, content, kind, ks, at, ends, shape, dtype, packed, nodata, place in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = content
                if data is None:
                    with Ranges(path) as f:
                        data = f.read(at, ends[-1] - at)
                if kind == "text":
                    yield pixels(path, *ascii_grid(data))
                    continue
                (height, width, across, th, tw), (left, top, size), start = shape, place, 0
                for k, end in zip(ks, ends, strict=True):
                    raw, start = data[start : end - at], end - at
                    block = np.frombuffer(zlib.decompress(raw) if packed else raw, np.dtype(dtype))
                    y, x = k // across * th, k % across * tw
                    block = block[: len(block) // tw * tw].reshape(-1, tw)[: height - y, : width - x].astype(np.float64)
                    if nodata is not None:
                        block[block == nodata] = np.nan
                    yield pixels(path, block, left + x * size, top - y * size, size)

    splits = raster_splits(spark, root, box)
    return splits.repartition(F.col("path"), F.col("at")).mapInArrow(decode, PIXELS)


def mosaic(pixels: DataFrame, size: float, origin: tuple[float, float]) -> DataFrame:
    """row, col, z on one raster with this top left corner; overlapping files give the mean."""
    row, col = F.floor((origin[1] - F.col("y")) / size).cast("int"), F.floor((F.col("x") - origin[0]) / size).cast("int")
    return pixels.groupBy(row.alias("row"), col.alias("col")).agg(F.avg("z").alias("z"))


def png_rgb(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit RGB or RGBA PNG without interlacing."""
    at, body, width, height, channels = 8, b"", 0, 0, 3
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", part[:10])
            if depth != 8 or colour not in (2, 6) or part[12]:
                raise ValueError("a PNG kind that is not read here")
            channels = 3 if colour == 2 else 4
        elif name == b"IDAT":
            body += part
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    out, above = np.zeros((height, width * channels), np.int64), np.zeros(width * channels, np.int64)
    for r in range(height):
        kind, line = raw[r, 0], raw[r, 1:].astype(np.int64)
        if kind == 1:
            line = np.cumsum(line.reshape(width, channels), axis=0).ravel() & 255
        elif kind == 2:
            line = (line + above) & 255
        elif kind:  # each byte needs the one before it
            got, up = [0] * channels, [0] * channels + above.tolist()
            for i, v in enumerate(line.tolist()):
                a, b, c = got[i], up[i + channels], up[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                got.append((v + guess) & 255)
            line = np.array(got[channels:], np.int64)
        out[r] = above = line
    return out.reshape(height, width, channels)[:, :, :3].astype(np.uint8)


def read_terrain_tiles(spark: SparkSession, root: str) -> DataFrame:
    """row, col (global pixels) and z of terrain tiles named ..._<tile x>_<tile y>.png."""
    import re

    def decode(frames):
        for f in frames:
            for path, data in zip(f["path"], f["content"], strict=True):
                m = re.search(r"_(\d+)_(\d+)\.png$", path)
                if not m:
                    continue
                p = png_rgb(data).astype(float)
                z = p[:, :, 0] * 256 + p[:, :, 1] + p[:, :, 2] / 256 - 32768
                r, c = np.indices(z.shape)
                yield pd.DataFrame({"row": (int(m[2]) * 256 + r).ravel(), "col": (int(m[1]) * 256 + c).ravel(), "z": z.ravel()})

    files = contents(spark, root)
    return files.filter("lower(path) LIKE '%.png'").select("path", "content").mapInPandas(decode, "row long, col long, z double")
