"""Vector layers: shapefiles, GeoJSON zones and WKT line networks.

Shapefiles are read in ranges of their records (see ranges) and GeoJSON in ranges of its bytes (see objects), by several
tasks each."""

from __future__ import annotations

import sqlite3
import struct
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.functions.geo import guess_code, parse_points, project
from gradewalk.sources import objects
from gradewalk.sources.files import contents
from gradewalk.sources.ranges import Ranges, listed

# Fixed values of the shapefile format: shape types and their dimensions.
POINT, LINE, POLYGON, MULTIPOINT = 1, 3, 5, 8
RING = "array<struct<x:double,y:double>>"
SHAPES = f"path string, n long, kind string, parts array<{RING}>, x0 double, y0 double, x1 double, y1 double, attributes map<string,string>"


#: Bytes of records that a task reads at once.
READ_AT_ONCE = 4 << 20
_SPLIT = "path string, first long, records long, at long, end long, shp_path string, shp binary, dbf_path string, dbf binary, code string"


def shape(body: bytes, box: tuple[float, float, float, float] | None = None):
    """(kind, parts) of a record; measures and heights are left out, null shapes are (None, []).

    With a box, shapes whose envelope, as the record states it, doesn't meet it are null shapes: their points aren't looked at."""
    kind = struct.unpack("<i", body[:4])[0] if len(body) >= 4 else 0
    base = kind % 10
    if base not in (POINT, LINE, POLYGON, MULTIPOINT):
        return None, []
    x0, y0, x1, y1 = struct.unpack("<2d", body[4:20]) * 2 if base == POINT else struct.unpack("<4d", body[4:36])
    if box is not None and not (x1 >= box[0] and y1 >= box[1] and x0 <= box[2] and y0 <= box[3]):
        return None, []
    if base == POINT:
        return "point", [[(x0, y0)]]
    if base == MULTIPOINT:
        flat = struct.unpack(f"<{2 * struct.unpack('<i', body[36:40])[0]}d", body[40 : 40 + 16 * struct.unpack("<i", body[36:40])[0]])
        return "multipoint", [list(zip(flat[::2], flat[1::2], strict=True))]
    n_parts, n_points = struct.unpack("<2i", body[36:44])
    starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
    flat = struct.unpack(f"<{2 * n_points}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
    points = list(zip(flat[::2], flat[1::2], strict=True))
    return "line" if base == LINE else "polygon", [points[s:e] for s, e in zip(starts, starts[1:], strict=False)]


def offsets(shp: Ranges, shx: Ranges | None) -> list[int]:
    """Where each record begins, and where the last one ends: from the index beside the file, or from the records' heads."""
    if shx is not None:
        flat = np.frombuffer(shx.read(100, (shx.size - 100) // 8 * 8), ">i4").reshape(-1, 2).astype(np.int64) * 2
        return [*flat[:, 0].tolist(), int(flat[-1].sum()) + 8] if len(flat) else [100]
    found, window, start = [100], b"", 100
    while True:
        at = found[-1]
        if at + 8 > start + len(window):
            start, window = at, shp.read(at, READ_AT_ONCE)
        if len(window) - (at - start) < 8:
            return found
        found.append(at + 8 + struct.unpack(">i", window[at - start + 4 : at - start + 8])[0] * 2)


def attributes(dbf: Ranges, first: int, n: int, encoding: str, fields: list[str] | None = None) -> list[dict[str, str | None]]:
    """A dict of texts for each of n records of a dBASE table; deleted ones too, as shapes keep their place. Only asked fields are decoded."""
    rows, head, width = struct.unpack("<IHH", dbf.read(4, 8))
    names, at, pos, wanted = dbf.read(32, head - 32), 0, 1, []
    while at + 32 <= len(names) and names[at] != 0x0D:
        name, size = names[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), names[at + 16]
        if fields is None or name in fields:
            wanted.append((name, pos, pos + size))
        at, pos = at + 32, pos + size
    data = dbf.read(head + first * width, max(0, min(n, rows - first)) * width)
    text = lambda k, s, e: data[k * width + s : k * width + e].decode(encoding, "replace").strip(" \0") or None
    return [{name: text(k, s, e) for name, s, e in wanted} for k in range(len(data) // width)]


def shape_splits(spark: SparkSession, root: str, keys: list[str], encoding: str = "cp949") -> DataFrame:
    """Runs of records of all shapefiles under root with any key in their name: first, records, and their bytes at to end.

    Where Spark brought the files, shp is that range of bytes, and dbf the table's head with its part of the rows."""
    files = listed(spark, root, ("shp", "shx", "dbf", "cpg"))
    stem, ext = F.regexp_extract("path", r"^(.*)\.[^./]+$", 1), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    wanted = F.lit(False)
    for k in keys:
        wanted = wanted | F.element_at(F.split("path", "/"), -1).contains(k)
    of = [F.max(F.when(F.col("ext") == e, F.struct("path", "content"))).alias(e) for e in ("shp", "shx", "dbf", "cpg")]
    sets = files.filter(wanted).select(stem.alias("stem"), ext.alias("ext"), "path", "content").groupBy("stem").agg(*of).filter("shp IS NOT NULL")

    def plan(batches):
        opened = lambda f: f and Ranges(f["path"], f["content"])

        def rows_of(f: Ranges | None, first: int, n: int) -> bytes | None:
            if f is None or f.content is None:
                return None
            head, width = struct.unpack("<HH", f.read(8, 4))
            return f.read(0, head) + f.read(head + first * width, n * width)

        for b in batches:
            rows = []
            for stem, shp, shx, dbf, cpg in zip(*(c.to_pylist() for c in b.columns), strict=True):
                code = encoding
                if cpg:
                    with opened(cpg) as f:
                        code = f.read(0, f.size).decode("ascii", "replace").strip()
                code = "cp949" if code.lower() in ("949", "ks_c_5601-1987") else code
                f, table, index, first = opened(shp), opened(dbf), opened(shx), 0
                at = offsets(f, index)
                for k in range(1, len(at)):
                    if k == len(at) - 1 or at[k + 1] - at[first] > READ_AT_ONCE:
                        own = None if f.content is None else f.read(at[first], at[k] - at[first])
                        rows.append((stem, first, k - first, at[first], at[k], shp["path"], own, dbf and dbf["path"], rows_of(table, first, k - first), code))
                        first = k
                for x in (f, table, index):
                    if x:
                        x.close()
            types = [pa.string(), *[pa.int64()] * 4, *[pa.string(), pa.binary()] * 2, pa.string()]
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _SPLIT.split(", ")])

    return sets.mapInArrow(plan, _SPLIT)


def read_shapefiles(spark: SparkSession, root: str, keys: list[str], encoding: str = "cp949", box: tuple[float, float, float, float] | None = None, fields: list[str] | None = None) -> DataFrame:
    """Shapes of all shapefiles under root with any key in their name, in their own coordinates.

    The encoding is used where no .cpg names one. Columns of different files meet in one map of texts, of all fields or of
    those asked for. With a box (in the files' coordinates) shapes are told by the envelopes in their records, before their
    points are decoded. A file is read by as many tasks as its records need."""

    def decode(frames):
        for f in frames:
            for path, first, n, at, end, shp_path, shp, dbf_path, dbf, code in f.itertuples(index=False):
                data = shp
                if data is None:
                    with Ranges(shp_path) as file:
                        data = file.read(at, end - at)
                table: list[dict] = []
                if isinstance(dbf_path, str):
                    with Ranges(dbf_path, dbf) as file:
                        table = attributes(file, first if dbf is None else 0, n, code, fields)
                rows, pos = [], 0
                for k in range(n):
                    size = struct.unpack(">i", data[pos + 4 : pos + 8])[0] * 2
                    kind, parts = shape(data[pos + 8 : pos + 8 + size], box)
                    pos += 8 + size
                    if kind is None or not any(parts):
                        continue
                    xs, ys = zip(*[p for part in parts for p in part], strict=True)
                    rows.append((path, first + k, kind, [[{"x": x, "y": y} for x, y in part] for part in parts], min(xs), min(ys), max(xs), max(ys), table[k] if k < len(table) else {}))
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "n", "kind", "parts", "x0", "y0", "x1", "y1", "attributes"])

    return shape_splits(spark, root, keys, encoding).repartition(F.col("path"), F.col("first")).mapInPandas(decode, SHAPES)


def read_gpkg(spark: SparkSession, root: str, table: str) -> DataFrame:
    """path, fid, wkb, x0, y0, x1, y1 (the stored envelope) and attributes (texts) of a layer in all GeoPackages under root; a task a file."""

    def decode(batches):
        names = ["path", "fid", "wkb", "x0", "y0", "x1", "y1", "attributes"]
        types = [pa.string(), pa.int64(), pa.binary(), *[pa.float64()] * 4, pa.map_(pa.string(), pa.string())]
        for b in batches:
            for path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with tempfile.TemporaryDirectory() as scratch:
                    with open(f"{scratch}/layer.gpkg", "wb") as f:
                        f.write(content)
                    db = sqlite3.connect(f"{scratch}/layer.gpkg")
                    found = db.execute('SELECT * FROM "' + table.replace('"', '""') + '"')
                    keys = [c[0] for c in found.description]
                    while rows := found.fetchmany(10_000):
                        out = []
                        for r in rows:
                            own = dict(zip(keys, r, strict=True))
                            fid, blob = own.pop("fid"), own.pop("geom")
                            size = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
                            x0, x1, y0, y1 = struct.unpack("<4d", blob[8:40]) if size else (None,) * 4
                            out.append((path, fid, blob[8 + size :], x0, y0, x1, y1, [(k, None if v is None else str(v)) for k, v in own.items()]))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    db.close()

    files = contents(spark, root).filter("lower(path) LIKE '%.gpkg'").select("path", "content")
    return files.mapInArrow(decode, "path string, fid long, wkb binary, x0 double, y0 double, x1 double, y1 double, attributes map<string,string>")


def to_working(layer: DataFrame, code: int | None = None) -> DataFrame:
    """A layer's parts in the working projection; a missing code is guessed from each file's coordinates."""
    if code is not None:
        codes = layer.withColumn("_code", F.lit(code))
    else:
        guess = layer.groupBy("path").agg(guess_code(F.min("x0")).alias("_code"))
        codes = layer.join(guess, "path")

    def moved(p):
        out = F.struct(p["x"].alias("x"), p["y"].alias("y"))
        for c in (4326, 5179) if code is None else (code,):
            x, y = project(p["x"], p["y"], c)
            out = F.when(F.col("_code") == c, F.struct(x.alias("x"), y.alias("y"))).otherwise(out)
        return out

    parts = F.transform("parts", lambda part: F.transform(part, moved))
    flat = F.flatten("parts")
    low, high = (lambda c: F.array_min(F.transform(flat, lambda p: p[c]))), (lambda c: F.array_max(F.transform(flat, lambda p: p[c])))
    return codes.withColumn("parts", parts).withColumns({"x0": low("x"), "y0": low("y"), "x1": high("x"), "y1": high("y")}).drop("_code")


def in_bbox(layer: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Shapes whose envelope meets a box; on a stored layer the four comparisons reach the scan."""
    return layer.filter((F.col("x1") >= box[0]) & (F.col("y1") >= box[1]) & (F.col("x0") <= box[2]) & (F.col("y0") <= box[3]))


def coverage(layer: DataFrame) -> DataFrame:
    """One envelope for each file."""
    return layer.groupBy("path").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def lines_of(layer: DataFrame) -> DataFrame:
    """line_id and points of every part of two or more points of line shapes."""
    each = layer.filter("kind = 'line'").select("path", "n", F.posexplode("parts").alias("part", "points")).filter(F.size("points") >= 2)
    return each.select(F.xxhash64("path", "n", "part").alias("line_id"), "points")


def read_zones(spark: SparkSession, path: str, at_once: int = objects.READ_AT_ONCE) -> DataFrame:
    """adm_cd, adm_cd_stat, adm_nm, gu, rings (working projection) and envelope of a GeoJSON collection's features.

    All rings of a MultiPolygon stand side by side; the even-odd rule sorts holes out. A file is read by a task for each
    at_once bytes; ordinal is where in it a feature begins."""
    ring = "array<array<array<double>>>"
    schema = "properties struct<ADM_CD:string,ADM_CD_STAT:string,adm_nm:string,sggnm:string>, geometry struct<type:string,coordinates:string>"
    rows = objects.read_objects(spark, path, "features", at_once).select(F.col("at").alias("ordinal"), F.from_json("text", schema).alias("f"))
    many, one = F.from_json("f.geometry.coordinates", f"array<{ring}>"), F.from_json("f.geometry.coordinates", ring)
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", F.flatten(many)).otherwise(one)

    def moved(p):
        x, y = project(p[0], p[1], 4326)
        return F.struct(x.alias("x"), y.alias("y"))

    zones = rows.select("ordinal", F.col("f.properties.ADM_CD").alias("adm_cd"), F.col("f.properties.ADM_CD_STAT").alias("adm_cd_stat"), F.col("f.properties.adm_nm").alias("adm_nm"), F.col("f.properties.sggnm").alias("gu"), F.transform(rings, lambda r: F.transform(r, moved)).alias("rings"))
    low = lambda c: F.array_min(F.transform(F.flatten("rings"), lambda p: p[c]))
    high = lambda c: F.array_max(F.transform(F.flatten("rings"), lambda p: p[c]))
    return zones.withColumns({"x0": low("x"), "y0": low("y"), "x1": high("x"), "y1": high("y")})


def wkt_lines(rows: DataFrame, wkt: str, code: str | None = None, kind: str | None = None, gu: str | None = None, boroughs: list[str] | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """line_id and points of the pedestrian lines of a network table; points of nodes are left out.

    code is the link type column (its four-digit form begins with 1 for walkers); a box keeps lines with a vertex in it."""
    found = rows if boroughs is None else rows.filter(F.trim(gu).isin(boroughs))
    text = F.trim(F.col(wkt).cast("string"))
    found = found.filter(F.upper(text).rlike(r"^(MULTI)?LINESTRING"))
    if code is not None:
        walkers = F.substring(F.lpad(F.trim(code), 4, "0"), 1, 1) == "1"
        found = found.filter(walkers if kind is None else walkers | (F.upper(F.trim(kind)) != "LINK"))
    parts = found.select(text.alias("t")).select(F.xxhash64("t").alias("h"), F.posexplode(parse_points(F.col("t"))).alias("part", "points")).filter(F.size("points") >= 2)
    if box is not None:
        parts = parts.filter(F.exists("points", lambda p: p["x"].between(box[0], box[2]) & p["y"].between(box[1], box[3])))
    return parts.select(F.xxhash64("h", "part").alias("line_id"), "points")


def wkt_column(rows: DataFrame, look: int = 200) -> str | None:
    """The first column with a line's WKT among the first rows."""
    sample = rows.limit(look).collect()
    return next((c for c in rows.columns if any(str(r[c] or "").lstrip().upper().startswith(("LINESTRING", "MULTILINESTRING")) for r in sample)), None)
