"""Shape operators that need whole point lists: simplification, outlines of raster covers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def kept_points(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of an open line stay: a stack of spans, each split at its farthest point while that is too far."""
    keep, todo = np.zeros(len(p), bool), [(0, len(p) - 1)]
    keep[[0, -1]] = True
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, inner = p[b] - p[a], p[a + 1 : b] - p[a]
        length = np.hypot(*d)
        off = np.abs(d[0] * inner[:, 1] - d[1] * inner[:, 0]) / length if length else np.hypot(*inner.T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplified(points: list, tolerance: float) -> list:
    """A line, or a closed ring cut at the point farthest from its start, without points that matter less than this."""
    p = np.array([(q["x"], q["y"]) for q in points], float).reshape(-1, 2)
    if len(p) < 4:
        return points
    if (p[0] == p[-1]).all():
        far = int(np.hypot(*(p - p[0]).T).argmax())
        keep = np.concatenate([kept_points(p[: far + 1], tolerance)[:-1], kept_points(p[far:], tolerance)]) if 0 < far < len(p) - 1 else np.ones(len(p), bool)
    else:
        keep = kept_points(p, tolerance)
    return [q for q, k in zip(points, keep.tolist(), strict=True) if k]


def simplify(rings: Column, tolerance: float = 12.0) -> Column:
    """Rings with fewer points, in Arrow batches."""

    @F.pandas_udf(f"array<{RING}>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda rs: [[{"x": q["x"], "y": q["y"]} for q in simplified(list(r), tolerance)] for r in rs])

    return run(rings)


def strips(cells: DataFrame, by: list[str], size: float) -> DataFrame:
    """by, x0, y0, x1, y1: cells (gx, gy) joined to strips along x; together they cover what the cells cover."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by, "gy").orderBy("gx")
    runs = cells.withColumn("_run", F.col("gx") - F.row_number().over(order)).groupBy(*by, "gy", "_run").agg(F.min("gx").alias("a"), F.max("gx").alias("b"))
    return runs.select(*by, (F.col("a") * size).alias("x0"), (F.col("gy") * size).alias("y0"), ((F.col("b") + 1) * size).alias("x1"), ((F.col("gy") + 1) * size).alias("y1"))


def cell_outlines(gx: np.ndarray, gy: np.ndarray) -> list[np.ndarray]:
    """Closed rings around cells, corners in cell units: outer ones counter-clockwise, holes clockwise, cells to the left.

    Each cell brings its four sides in turn; sides that two cells share, once in each direction, fall out. Where cells touch
    at a corner only, a ring turns left, so that it keeps to its own cells."""
    here = np.column_stack([gx, gy]).astype(np.int64)
    corners = [here, here + [1, 0], here + [1, 1], here + [0, 1]]
    sides = np.vstack([np.hstack([corners[k], corners[(k + 1) % 4]]) for k in range(4)])
    both, n = np.unique(np.vstack([sides, sides[:, [2, 3, 0, 1]]]), axis=0, return_counts=True)
    shared = {tuple(x) for x in both[n > 1].tolist()}
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x in map(tuple, sides.tolist()):
        if x not in shared:
            out.setdefault(x[:2], []).append(x[2:])
    rings = []
    while out:
        at = first = min(out)
        before, ring = None, [first]
        while True:
            ways = out[at]
            turn = lambda w, at=at, before=before: 0 if before is None else (at[0] - before[0]) * (w[1] - at[1]) - (at[1] - before[1]) * (w[0] - at[0])
            way = max(ways, key=turn)
            ways.remove(way)
            if not ways:
                del out[at]
            before, at = at, way
            if at == first:
                break
            ring.append(at)
        p = np.array([*ring, first], np.int64)
        step = np.diff(p, axis=0)
        bend = np.concatenate([[True], (step[1:] != step[:-1]).any(axis=1), [True]])  # corners only
        rings.append(p[bend])
    return rings


def outlines(cells: DataFrame, by: list[str], size: float, tolerance: float = 10.0) -> DataFrame:
    """by, area_m2 (of the cells) and rings: the outlines of each group's cells (gx, gy), without points that matter less.

    A group is one task: an isochrone's, whose cells are bounded by its minutes."""
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*by).schema)
    schema = f"{keys}, area_m2 double, rings array<{RING}>"

    def run(group: pa.Table) -> pa.Table:
        rings = [r * size for r in cell_outlines(group.column("gx").to_numpy(), group.column("gy").to_numpy())]
        kept = [simplified([{"x": float(x), "y": float(y)} for x, y in r], tolerance) for r in rings]
        columns = {c: group.column(c).slice(0, 1) for c in by}
        ring = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        return pa.table(columns | {"area_m2": pa.array([group.num_rows * size * size]), "rings": pa.array([kept], pa.list_(ring))})

    return cells.select(*by, "gx", "gy").distinct().groupBy(*by).applyInArrow(run, schema)


def multipolygons(strip_rows: DataFrame, by: list[str]) -> DataFrame:
    """by and geom (WKB MultiPolygon) of strips; for exports of a few areas."""
    from gradewalk.sources.sinks import wkb_multipolygon

    def run(s: pd.Series) -> pd.Series:
        box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d), (a, b)]
        return pd.Series([wkb_multipolygon([[box(*r)] for r in rs]) for rs in s], dtype=object)

    pack = F.pandas_udf(run, "binary")
    return strip_rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.array("x0", "y0", "x1", "y1"))).alias("r")).select(*by, pack("r").alias("geom"))
