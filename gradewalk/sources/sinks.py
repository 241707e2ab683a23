"""Sinks: text tables for spreadsheets, GeoPackages, and well-known binary."""

from __future__ import annotations

import csv
import io
import os
import sqlite3
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewalk.operators.tables import save

# Fixed values of the GeoPackage format.
APPLICATION_ID, USER_VERSION = 0x47504B47, 10300
_TABLES = """
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER NOT NULL PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT '2024-01-01T00:00:00Z', min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL, UNIQUE (table_name, column_name, extension_name));
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
"""

#: Transverse Mercator belts by EPSG code: name, central meridian, scale, false easting and northing.
BELTS = {5179: ("Korea 2000 / Unified CS", 127.5, 0.9996, 1_000_000, 2_000_000), 5186: ("Korea 2000 / Central Belt 2010", 127, 1.0, 200_000, 600_000)}


def write_csv(df: DataFrame, path: str) -> None:
    """One text file with a header and a byte order mark, for spreadsheets. For results of report size only."""
    store, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    store.create_dir(os.path.dirname(place), recursive=True)
    with store.open_output_stream(place, compression=None) as out:
        with io.TextIOWrapper(out, "utf-8-sig", newline="") as text:  # rows go out as they come
            writer = csv.writer(text)
            writer.writerow(df.columns)
            writer.writerows(["" if v is None else v for v in r] for r in df.toLocalIterator())


def write_lines(rows: DataFrame, folder: str) -> DataFrame:
    """Text files from rows (file, encoding, at, line), each by one task line after line in the order of `at`; returns file and lines, stored."""

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        out, name, n, done = None, None, 0, []
        for b in batches:
            for file, encoding, line in zip(*(b.column(c).to_pylist() for c in ("file", "encoding", "line")), strict=True):
                if file != name:
                    if out is not None:
                        out.close()
                        done.append((name, n))
                    store.create_dir(os.path.dirname(f"{base}/{file}"), recursive=True)
                    out, name, n = io.TextIOWrapper(store.open_output_stream(f"{base}/{file}", compression=None), encoding, newline=""), file, 0
                out.write(line + "\n")
                n += 1
        if out is not None:
            out.close()
            done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["file", "lines"])

    return save(rows.select("file", "encoding", "at", "line").repartition("file").sortWithinPartitions("file", "at").mapInArrow(run, "file string, lines long"), "text-files")


def write_csv_parts(df: DataFrame, folder: str) -> DataFrame:
    """A table as spreadsheets' text files, one for each task, each with a header and a byte order mark; returns file and rows, stored."""
    names = df.columns

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        file, n = f"part-{uuid.uuid4().hex}.csv", 0
        with store.open_output_stream(f"{base}/{file}", compression=None) as out, io.TextIOWrapper(out, "utf-8-sig", newline="") as text:
            writer = csv.writer(text)
            writer.writerow(names)
            for b in batches:
                writer.writerows(["" if v is None else v for v in r] for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([file], pa.string()), pa.array([n], pa.int64())], names=["file", "rows"])

    return save(df.mapInArrow(run, "file string, rows long"), "text-parts")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """df with doubles rounded; for the text sink only."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def wkb_point(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, x, y)


def wkb_polygon(rings: list[list[tuple[float, float]]]) -> bytes:
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in rings)


def wkb_multipolygon(polygons: list[list[list[tuple[float, float]]]]) -> bytes:
    return struct.pack("<BII", 1, 6, len(polygons)) + b"".join(wkb_polygon(p) for p in polygons)


def wkb_bounds(wkb: bytes) -> tuple[float, float, float, float] | None:
    """Least and largest x, then y, of a little-endian point, polygon or multipolygon; none if it has no points."""
    kind = struct.unpack("<I", wkb[1:5])[0]
    if kind == 1:
        x, y = struct.unpack("<2d", wkb[5:21])
        return x, x, y, y
    spans, at, polygons = [], 5, 1
    if kind == 6:
        polygons, at = struct.unpack("<I", wkb[5:9])[0], 14
    for _ in range(polygons):
        rings, at = struct.unpack("<I", wkb[at : at + 4])[0], at + 4
        for _ in range(rings):
            n, at = struct.unpack("<I", wkb[at : at + 4])[0], at + 4
            spans.append(np.frombuffer(wkb, "<f8", 2 * n, at).reshape(-1, 2))
            at += 16 * n
        at += 5  # the next polygon's own head
    points = np.concatenate(spans) if spans else np.zeros((0, 2))
    (x0, y0), (x1, y1) = (points.min(axis=0), points.max(axis=0)) if len(points) else ((0, 0), (0, 0))
    return (float(x0), float(x1), float(y0), float(y1)) if len(points) else None


def gpkg_blob(wkb: bytes, srs: int) -> bytes:
    """A geometry as a GeoPackage stores it, with its envelope; without one if it is empty."""
    box = wkb_bounds(wkb)
    return b"GP\x00" + (b"\x11" if box is None else b"\x03") + struct.pack("<i", srs) + (b"" if box is None else struct.pack("<4d", *box)) + wkb


def square(x: float, y: float, size: float) -> list[list[tuple[float, float]]]:
    return [[(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]]


def crs_text(srs: int) -> str:
    """The projection in well-known text, made from its parameters."""
    spheroid, inverse = ("WGS 84", 298.257223563) if srs == 4326 else ("GRS 1980", 298.257222101)
    name, code = ("WGS 84", 4326) if srs == 4326 else ("Korea 2000", 4737)
    base = f'GEOGCS["{name}",DATUM["{name}",SPHEROID["{spheroid}",6378137,{inverse}]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","{code}"]]'
    if srs not in BELTS:
        return base if srs == 4326 else "undefined"
    title, meridian, scale, east, north = BELTS[srs]
    fields = {"latitude_of_origin": 38, "central_meridian": meridian, "scale_factor": scale, "false_easting": east, "false_northing": north}
    return f'PROJCS["{title}",{base},PROJECTION["Transverse_Mercator"],' + ",".join(f'PARAMETER["{k}",{v:g}]' if k == "scale_factor" else f'PARAMETER["{k}",{v}]' for k, v in fields.items()) + f',UNIT["metre",1],AUTHORITY["EPSG","{srs}"]]'


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _layer(file: str, rows: Iterator[tuple[bytes, tuple]], table: str, kind: str, columns: dict[str, str], srs: int) -> int:
    """A GeoPackage of one layer in a local file, with bounds and a spatial index; the number of its rows."""
    db = sqlite3.connect(file)
    db.execute(f"PRAGMA application_id = {APPLICATION_ID}")
    db.execute(f"PRAGMA user_version = {USER_VERSION}")
    db.executescript(_TABLES)
    for n, s in (("undefined cartesian", -1), ("undefined geographic", 0)):
        db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'NONE', ?, 'undefined', '')", (n, s, s))
    db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, ?, '')", (f"EPSG:{srs}", srs, srs, crs_text(srs)))
    own, index = _quoted(table), _quoted(f"rtree_{table}_geom")
    db.execute(f"CREATE TABLE {own} (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB, {', '.join(f'{_quoted(c)} {t}' for c, t in columns.items())})")
    db.execute(f"CREATE VIRTUAL TABLE {index} USING rtree(id, minx, maxx, miny, maxy)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", (table, kind, srs))
    db.execute("INSERT INTO gpkg_extensions VALUES (?, 'geom', 'gpkg_rtree_index', 'http://www.geopackage.org/spec120/#extension_rtree', 'write-only')", (table,))
    insert, whole, n = f"INSERT INTO {own} (geom, {', '.join(map(_quoted, columns))}) VALUES ({', '.join('?' * (len(columns) + 1))})", [], 0
    for wkb, values in rows:
        n += 1
        fid, box = db.execute(insert, (gpkg_blob(wkb, srs), *values)).lastrowid, wkb_bounds(wkb)
        if box:
            db.execute(f"INSERT INTO {index} VALUES (?, ?, ?, ?, ?)", (fid, *box))
            whole = [min(whole[0], box[0]), max(whole[1], box[1]), min(whole[2], box[2]), max(whole[3], box[3])] if whole else list(box)
    x0, x1, y0, y1 = whole or [None] * 4
    db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", (table, table, x0, y0, x1, y1, srs))
    db.commit()
    db.close()
    return n


def _columns(df: DataFrame, geometry: str) -> dict[str, str]:
    kinds = {"double": "REAL", "float": "REAL", "bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "boolean": "BOOLEAN"}
    return {c: kinds.get(t, "TEXT") for c, t in df.dtypes if c != geometry}


def _stored(local: str, path: str) -> None:
    store, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    store.create_dir(os.path.dirname(place), recursive=True)
    with open(local, "rb") as src, store.open_output_stream(place, compression=None) as out:
        while block := src.read(1 << 20):
            out.write(block)


def _value(v):
    return None if isinstance(v, float) and v != v else v


def write_gpkg(df: DataFrame, path: str, table: str, geometry: str, kind: str, srs: int = 5186) -> None:
    """A GeoPackage with one layer. geometry names the WKB column; rows stream through the driver into the file.

    For exports of suppressed roll-ups, which are small; write_gpkg_parts is for layers of any size."""
    columns = _columns(df, geometry)
    with tempfile.TemporaryDirectory() as folder:
        rows = ((bytes(r[geometry]), tuple(_value(r[c]) for c in columns)) for r in df.toLocalIterator() if r[geometry] is not None)
        _layer(f"{folder}/layer.gpkg", rows, table, kind, columns, srs)
        _stored(f"{folder}/layer.gpkg", path)


def write_gpkg_parts(df: DataFrame, folder: str, table: str, geometry: str, kind: str, srs: int = 5186) -> DataFrame:
    """A layer as GeoPackages that tasks write, one each, whole in themselves; returns file and rows, stored.

    A task makes its file in a scratch folder of its own, which goes with it, and copies it into the shared one. Dealt by
    place beforehand (repartitionByRange), files are parts of the map."""
    columns, names = _columns(df, geometry), df.columns

    def run(batches):
        count = 0

        def rows():
            for b in batches:
                own = {c: b.column(k).to_pylist() for k, c in enumerate(names)}
                for k, wkb in enumerate(own[geometry]):
                    if wkb is not None:
                        yield bytes(wkb), tuple(_value(own[c][k]) for c in columns)

        file = f"{table}-{uuid.uuid4().hex}.gpkg"
        with tempfile.TemporaryDirectory() as scratch:
            count = _layer(f"{scratch}/layer.gpkg", rows(), table, kind, columns, srs)
            if count:
                _stored(f"{scratch}/layer.gpkg", f"{folder}/{file}")
        yield pa.RecordBatch.from_arrays([pa.array([file] * (count > 0), pa.string()), pa.array([count] * (count > 0), pa.int64())], names=["file", "rows"])

    return save(df.mapInArrow(run, "file string, rows long"), "gpkg-parts")


def cell_wkb(x: Column, y: Column, size: Column) -> Column:
    """The polygon of a grid cell, in batches of rows."""

    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([wkb_polygon(square(*v)) for v in zip(a, b, c, strict=True)], dtype=object)

    return F.pandas_udf(run, "binary")(x, y, size)


def point_wkb(x: Column, y: Column) -> Column:
    """A point, in batches of rows."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([wkb_point(*v) for v in zip(a, b, strict=True)], dtype=object)

    return F.pandas_udf(run, "binary")(x, y)
