"""Elevation rasters as tables of pixels (row, col, z)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewalk.operators.tables import save

LOWEST, HIGHEST = -100.0, 3000.0


def valid(z: Column, nodata: float | None = None) -> Column:
    """z, or null where it is no height."""
    fine = z.between(LOWEST, HIGHEST) & ~F.isnan(z)
    return F.when(fine if nodata is None else fine & (z != nodata), z.cast("double"))


def bilinear(points: DataFrame, key: str, pixels: DataFrame, origin: tuple[float, float], step: tuple[float, float], x: str = "x", y: str = "y") -> DataFrame:
    """points with z by bilinear interpolation between pixel centres; the nearest pixel where one of the four is missing.

    origin is the raster's top left corner, step the pixel's width and (negative) height. Each point meets its four
    pixels by an equi-join; nothing but the points' pixels is looked at."""
    px, py = (F.col(x) - origin[0]) / step[0] - 0.5, (F.col(y) - origin[1]) / step[1] - 0.5
    bounds = pixels.agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    at = points.select(key, px.alias("px"), py.alias("py")).join(F.broadcast(bounds), how="cross")
    inside = lambda v, most: F.greatest(F.lit(0), F.least(v.cast("int"), most))
    near = F.struct(inside(F.rint("py"), F.col("rows")).alias("row"), inside(F.rint("px"), F.col("cols")).alias("col"), F.lit(None).cast("double").alias("w"))
    fx, fy = F.col("px") - F.floor("px"), F.col("py") - F.floor("py")
    corner = lambda i, j: F.struct((F.floor("py") + i).cast("int").alias("row"), (F.floor("px") + j).cast("int").alias("col"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w"))
    wanted = at.select(key, F.explode(F.array(near, *[corner(i, j) for i in (0, 1) for j in (0, 1)])).alias("p")).select(key, "p.*")
    met = wanted.join(pixels.select("row", "col", "z"), ["row", "col"], "left")
    four = F.count(F.when(F.col("w").isNotNull(), F.col("z"))) == 4
    z = met.groupBy(key).agg(F.when(four, F.sum(F.col("w") * F.col("z"))).otherwise(F.max(F.when(F.col("w").isNull(), F.col("z")))).alias("z"))
    return points.join(z, key, "left")


def _filled(rows: np.ndarray, cols: np.ndarray, z: np.ndarray, void: np.ndarray, rounds: int) -> np.ndarray:
    """Heights of pixels, with voids replaced ring by ring by the mean of their valid neighbours."""
    r, c = rows - rows.min() + 1, cols - cols.min() + 1
    shape = (r.max() + 2, c.max() + 2)
    height, valid, gap = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, bool)
    height[r[~void], c[~void]], valid[r[~void], c[~void]], gap[r[void], c[void]] = z[~void], True, True
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    for _ in range(rounds):
        y, x = np.nonzero(gap)
        n = sum(valid[y + i, x + j].astype(np.int64) for i, j in around) if len(y) else np.zeros(0)
        met = n > 0
        if not met.any():
            break
        y, x = y[met], x[met]
        height[y, x] = sum(np.where(valid[y + i, x + j], height[y + i, x + j], 0.0) for i, j in around) / n[met]
        valid[y, x], gap[y, x] = True, False
    return np.where(valid[r, c], height[r, c], np.nan)


def fill_voids(pixels: DataFrame, low: float = -20.0, rounds: int = 64, tile: int = 256) -> DataFrame:
    """pixels with heights under `low` replaced by the mean of their valid neighbours, ring by ring from outside in.

    A tile with voids gets the pixels up to `rounds` away, as far as anything can reach it, and fills all its rings in one
    task; other tiles stay as they are. Voids deeper than `rounds`, or without any valid pixel near, keep a null."""
    known = save(pixels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.when(F.col("z") >= low, F.col("z").cast("double")).alias("z")), "pixels")
    own = lambda c: F.floor(F.col(c) / tile).cast("long")
    torn = known.filter("z IS NULL").select(own("row").alias("ty"), own("col").alias("tx")).distinct()
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - rounds) / tile).cast("long"), F.floor((F.col(c) + rounds) / tile).cast("long")))
    dealt = known.select("*", reach("row").alias("ty")).select("*", reach("col").alias("tx")).join(save(torn, "torn-tiles"), ["ty", "tx"], "left_semi")

    def fill(key, part):
        row, col, z = (part.column(c).to_numpy() for c in ("row", "col", "z"))
        void = np.isnan(z)
        found = _filled(row, col, z, void, rounds)
        mine = void & (row // tile == key[0].as_py()) & (col // tile == key[1].as_py())
        return pa.table({"row": row[mine], "col": col[mine], "z": pa.array(found[mine], pa.float64(), from_pandas=True)})

    filled = dealt.groupBy("ty", "tx").applyInArrow(fill, "row long, col long, z double")
    return known.filter("z IS NOT NULL").unionByName(filled)


def block_mean(pixels: DataFrame, k: int) -> DataFrame:
    """Mean of whole k x k blocks."""
    return pixels.groupBy(F.floor(F.col("row") / k).cast("long").alias("row"), F.floor(F.col("col") / k).cast("long").alias("col")).agg(F.avg("z").alias("z"), F.count("*").alias("n")).filter(F.col("n") == k * k).drop("n")


def grid_links(pixels: DataFrame, size: float) -> DataFrame:
    """u, v, length, dz between 8-neighbouring pixels, each pair once; node ids are row * 2^31 + col."""
    node = lambda r, c: F.col(r).cast("long") * F.lit(1 << 31) + F.col(c)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (1, 1), (1, -1))])
    ahead = pixels.select("row", "col", "z", F.explode(steps).alias("o")).select(node("row", "col").alias("u"), F.col("z").alias("zu"), (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), (F.hypot("o.i", "o.j") * size).alias("length"))
    return ahead.join(pixels, ["row", "col"]).select("u", node("row", "col").alias("v"), "length", (F.col("z") - F.col("zu")).alias("dz"))


def terrarium(r: Column, g: Column, b: Column) -> Column:
    """Height from the three channels of a terrain tile."""
    return r * 256 + g + b / 256 - 32768
