"""Spatial joins as bucketed equi-joins.

Catalyst plans a distance or containment predicate as a nested loop; here both sides get grid cells at least as large as
the reach, one side is copied to its neighbouring cells, and the exact test follows an equi-join on the cell. A cell as
full as a city block stays small; skewed cells are left to adaptive execution, which splits this join."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewalk.functions.geo import cell, distance, in_rings
from gradewalk.operators.tables import save


def _celled(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumn("_gx", cell(F.col(x), size)).withColumn("_gy", cell(F.col(y), size))


def _neighbours(df: DataFrame, size: float, x: str, y: str) -> DataFrame:
    around = F.array(*[F.struct((cell(F.col(x), size) + i).alias("gx"), (cell(F.col(y), size) + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.withColumn("_c", F.explode(around)).withColumn("_gx", F.col("_c.gx")).withColumn("_gy", F.col("_c.gy")).drop("_c")


def placed(x: str, y: str) -> Column:
    """Whether a point lies somewhere: both coordinates are finite numbers."""
    return ~(F.isnan(x) | F.isnan(y)) & (F.abs(x) < math.inf) & (F.abs(y) < math.inf)


def within(left: DataFrame, right: DataFrame, radius: float, lx: str = "x", ly: str = "y", rx: str = "rx", ry: str = "ry") -> DataFrame:
    """Pairs at most radius apart, with their distance `d`. Column names of both sides must differ.

    A merge: Spark judges the copies by the size of the file they come from, and would send them all through the driver."""
    a, b = _celled(left, radius, lx, ly), _neighbours(right, radius, rx, ry)
    joined = a.join(b.hint("merge"), ["_gx", "_gy"]).withColumn("d", distance(F.col(lx), F.col(ly), F.col(rx), F.col(ry)))
    return joined.filter(F.col("d") <= radius).drop("_gx", "_gy")


#: Pairs of points that are tested one by one at a time.
TESTED = 4_000_000


def _strips(x: np.ndarray) -> np.ndarray:
    """Where strips of points begin that are sorted by x: a strip for each x, or for equally many points where nearly every x differs."""
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    most = int(math.sqrt(len(x)))
    return first if len(first) <= 4 * most + 64 else np.unique(first[np.searchsorted(first, np.linspace(0, len(x) - 1, most).astype(int), "right") - 1])


def _sums_within(points: np.ndarray, values: np.ndarray, asked: np.ndarray, radius: float) -> np.ndarray:
    """Sums of the points' values around each asked place.

    In a strip the points surely inside a circle follow each other along y, so running sums give them; those near its edge are tested."""
    order = np.lexsort((points[:, 1], points[:, 0]))
    points, values, by_x = points[order], values[order], np.argsort(asked[:, 0], kind="stable")
    qx, found, edge = asked[by_x, 0], np.zeros((len(asked), values.shape[1])), 8 * np.spacing(max(np.abs(points).max(), np.abs(asked).max()) + radius)
    starts = _strips(points[:, 0])
    for a, b in zip(starts, np.r_[starts[1:], len(points)], strict=True):
        strip, x0, x1 = np.arange(a, b)[np.argsort(points[a:b, 1], kind="stable")], points[a, 0], points[b - 1, 0]
        y, upto = points[strip, 1], np.vstack([np.zeros(values.shape[1]), np.cumsum(values[strip], axis=0)])
        low, high = np.searchsorted(qx, [x0 - radius - edge, x1 + radius + edge])
        many = max(1, TESTED // len(y))
        for at in range(low, high, many):
            mine = by_x[at : min(at + many, high)]
            px, py = asked[mine, 0], asked[mine, 1]
            near, far = np.maximum(0, np.maximum(x0 - px, px - x1)), np.maximum(np.abs(px - x0), np.abs(px - x1))
            outer, inner = (np.sqrt(np.maximum(0, (radius - d + s * edge) * (radius + d + s * edge))) + s * edge for d, s in ((near, 1), (far, -1)))
            o0, o1 = np.searchsorted(y, py - outer), np.searchsorted(y, py + outer, "right")
            sure = (far < radius) & (inner > 0)
            i0, i1 = (np.where(sure, np.searchsorted(y, py + s * inner, side), o1) for s, side in ((-1, "left"), (1, "right")))
            found[mine] += upto[i1] - upto[i0]
            for c0, c1 in ((o0, i0), (i1, o1)):
                n = c1 - c0
                which = np.repeat(np.arange(len(mine)), n)
                if len(which):
                    one = strip[np.repeat(c0 - (np.cumsum(n) - n), n) + np.arange(len(which))]
                    hit = (px[which] - points[one, 0]) ** 2 + (py[which] - points[one, 1]) ** 2 <= radius * radius
                    np.add.at(found, mine[which[hit]], values[one[hit]])
    return found


def sums_within(left: DataFrame, right: DataFrame, radius: float, sums: dict[str, Column], lx: str = "x", ly: str = "y", rx: str = "rx", ry: str = "ry") -> DataFrame:
    """left's rows that have right rows within radius, with how many (n) and the sums over them (doubles; values must be finite).

    No pairs are made: equal places are one, and each square of two radii with its surroundings, a task's group, goes by
    strips (_sums_within): for p places about p times the root of p in a square, however many rows lie there."""
    size, reach = 2 * radius, radius * (1 + 1e-9)
    left = save(left, "circles")
    asked = left.filter(placed(lx, ly)).select(F.col(lx).cast("double").alias("ax"), F.col(ly).cast("double").alias("ay")).distinct().withColumn("_gx", cell(F.col("ax"), size)).withColumn("_gy", cell(F.col("ay"), size))
    held = right.filter(placed(rx, ry)).groupBy(F.col(rx).cast("double").alias("px"), F.col(ry).cast("double").alias("py")).agg(F.count("*").cast("double").alias("n"), *[F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(k) for k, c in sums.items()])
    tiles = lambda c: F.explode(F.sequence(cell(F.col(c) - reach, size), cell(F.col(c) + reach, size)))
    held = held.withColumn("_gx", tiles("px")).withColumn("_gy", tiles("py"))
    names = ["n", *sums]

    def solve(places: pa.Table, points: pa.Table) -> pa.Table:
        block = lambda t, of: np.column_stack([t.column(c).to_numpy() for c in of])
        if not (places.num_rows and points.num_rows):
            return pa.table({c: pa.array([], pa.float64()) for c in ("ax", "ay", *names)})
        got = _sums_within(block(points, ("px", "py")), block(points, names), block(places, ("ax", "ay")), radius)
        some = got[:, 0] > 0
        return pa.table({"ax": places.column("ax").filter(pa.array(some)), "ay": places.column("ay").filter(pa.array(some)), **{c: got[some, k] for k, c in enumerate(names)}})

    found = asked.groupBy("_gx", "_gy").cogroup(held.groupBy("_gx", "_gy")).applyInArrow(solve, ", ".join(f"`{c}` double" for c in ("ax", "ay", *names)))
    found = found.select(F.col("ax").alias("_ax"), F.col("ay").alias("_ay"), F.col("n").cast("long").alias("n"), *sums)
    return left.join(found, (F.col(lx) == F.col("_ax")) & (F.col(ly) == F.col("_ay"))).drop("_ax", "_ay")


def mean_within(left: DataFrame, right: DataFrame, radius: float, value: str, name: str, lx: str = "x", ly: str = "y", rx: str = "rx", ry: str = "ry") -> DataFrame:
    """left's rows that have right rows within radius, with their number n and the mean of their values; null if all are null."""
    v = F.col(value).cast("double")
    odd = {"_nan": F.isnan(v), "_up": v == math.inf, "_down": v == -math.inf}
    finite = ~(F.isnan(v) | (F.abs(v) == math.inf))
    sums = {"_m": F.when(v.isNotNull(), 1.0), "_s": F.when(finite, v), **{k: F.when(c, 1.0) for k, c in odd.items()}}
    found = sums_within(left, right, radius, sums, lx, ly, rx, ry)
    mean = F.when((F.col("_nan") > 0) | ((F.col("_up") > 0) & (F.col("_down") > 0)), math.nan).when(F.col("_up") > 0, math.inf).when(F.col("_down") > 0, -math.inf).otherwise(F.try_divide("_s", "_m"))
    return found.withColumn(name, mean).drop(*sums)


def nearest(left: DataFrame, key: str, right: DataFrame, radius: float, right_id: str, lx: str = "x", ly: str = "y", rx: str = "rx", ry: str = "ry") -> DataFrame:
    """left with right_id and d of its nearest right point within radius (inclusive; ties by id), null if none."""
    # points of one place are one, on either side
    asked = left.select(F.col(lx).alias("_lx"), F.col(ly).alias("_ly")).filter(placed("_lx", "_ly")).distinct()
    held = right.filter(placed(rx, ry)).groupBy(rx, ry).agg(F.min(right_id).alias(right_id))
    # the places asked for are copied to the cells around, not the network's nodes
    best = within(held, asked, radius, rx, ry, "_lx", "_ly").groupBy("_lx", "_ly").agg(F.min(F.struct("d", right_id)).alias("_b")).select("_lx", "_ly", f"_b.{right_id}", "_b.d")
    return left.join(best.hint("merge"), (F.col(lx) == F.col("_lx")) & (F.col(ly) == F.col("_ly")), "left").drop("_lx", "_ly")


def nearest_any(left: DataFrame, key: str, right: DataFrame, start: float, right_id: str, lx: str = "x", ly: str = "y", rx: str = "rx", ry: str = "ry") -> DataFrame:
    """Nearest right point without a limit: the radius grows fourfold until every left row with coordinates has its point.

    It ends when the radius spans both sides; rows are left without a point only if there are no right points."""
    right = save(right.select(right_id, rx, ry).filter(F.col(rx).isNotNull() & F.col(ry).isNotNull()), "nearest-to")
    open_ = save(left.select(key, lx, ly).filter(F.col(lx).isNotNull() & F.col(ly).isNotNull()), "nearest-of")
    corners = open_.select(F.col(lx).alias("x"), F.col(ly).alias("y")).unionAll(right.select(rx, ry))
    span = corners.agg(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()[0] or 0.0
    hits = []
    while True:
        found = save(nearest(open_, key, right, start, right_id, lx, ly, rx, ry), "nearest")
        hits.append(found.filter("d IS NOT NULL").select(key, right_id, "d"))
        open_ = found.filter("d IS NULL").select(key, lx, ly)
        if start >= span or not open_.take(1):
            return left.join(reduce(DataFrame.unionAll, hits), key, "left")
        start *= 4


def with_any(left: DataFrame, right: DataFrame, radius: float, key: str, lx: str = "x", ly: str = "y", rx: str = "rx", ry: str = "ry", how: str = "left_semi") -> DataFrame:
    """Rows of left that have (left_semi) or lack (left_anti) a right point within radius; the points are counted, not paired."""
    hits = sums_within(left.select(key, lx, ly), right.select(rx, ry), radius, {}, lx, ly, rx, ry).select(key).distinct()
    return left.join(hits, key, how)


def _covered(df: DataFrame, size: float, box: tuple[str, str, str, str]) -> DataFrame:
    x0, y0, x1, y1 = (F.col(c) for c in box)
    xs, ys = F.sequence(cell(x0, size), cell(x1, size)), F.sequence(cell(y0, size), cell(y1, size))
    return df.withColumn("_gx", F.explode(xs)).withColumn("_gy", F.explode(ys))


def in_polygons(points: DataFrame, key: str, polygons: DataFrame, ordinal: str, test: Column, size: float, box: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1"), x: str = "x", y: str = "y", alike: tuple[str, ...] | None = None) -> DataFrame:
    """points with all columns of the first polygon (by ordinal) that contains them; null if none does.

    box names the polygon's envelope columns; test is the exact predicate over both sides' columns. alike names all polygon
    columns that test and box read: of polygons that are equal in them only the first is tried."""
    kept = [c for c in polygons.columns if c not in points.columns]
    if alike:
        polygons = polygons.groupBy(*[F.col(c).alias(f"_{c}") for c in alike]).agg(F.min_by(F.struct(*polygons.columns), F.col(ordinal)).alias("_first")).select("_first.*")
    pairs = _celled(points.select(key, x, y), size, x, y).join(_covered(polygons, size, box), ["_gx", "_gy"])
    hits = pairs.filter(F.col(x).between(F.col(box[0]), F.col(box[2])) & F.col(y).between(F.col(box[1]), F.col(box[3])) & test)
    first = hits.groupBy(key).agg(F.min_by(F.struct(*kept), F.col(ordinal)).alias("_p")).select(key, "_p.*")
    return points.join(first, key, "left")


def inside_rings(x: str = "x", y: str = "y", rings: str = "rings") -> Column:
    return in_rings(F.col(x), F.col(y), F.col(rings))


def inside_box(x: str = "x", y: str = "y", box: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1")) -> Column:
    """Half-open box: a shared side belongs to the box above or to the right."""
    return (F.col(x) >= F.col(box[0])) & (F.col(x) < F.col(box[2])) & (F.col(y) >= F.col(box[1])) & (F.col(y) < F.col(box[3]))


def summed_areas(cells: DataFrame) -> DataFrame:
    """gx, gy, n: how many of some distinct cells (gx, gy from 0) are at most as far along both axes, for every cell of their box.

    Sums along rows, then along columns; a row or column is as long as the box is wide, and each goes its own way."""
    ends = cells.agg(F.max("gx").alias("mx"), F.max("gy").alias("my"))
    axis = lambda c, most: F.explode(F.sequence(F.lit(0).cast("long"), F.col(most))).alias(c)
    lattice = ends.filter("mx IS NOT NULL").select("my", axis("gx", "mx")).repartition("gx").select("gx", axis("gy", "my"))
    each = lattice.join(cells.select("gx", "gy", F.lit(1).alias("own")), ["gx", "gy"], "left")
    upto = lambda by, order: Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = each.withColumn("row", F.sum(F.coalesce("own", F.lit(0))).over(upto("gy", "gx")))
    return rows.select("gx", "gy", F.sum("row").over(upto("gx", "gy")).alias("n"))


def edge_flag(points: DataFrame, key: str, covers: DataFrame, buffer_m: float, cell_m: float) -> DataFrame:
    """points with `edge`: whether any cell within the buffer's box of cells is uncovered.

    covers has x0, y0, x1, y1. Cells start at the covers' corner less the buffer and two cells, and a cell is covered
    if a cover reaches into it. As covered cells are distinct, counting them in the box decides: four lookups of sums."""
    r = math.ceil(buffer_m / cell_m)
    corner = covers.agg((F.min("x0") - (r + 2) * cell_m).alias("ox"), (F.min("y0") - (r + 2) * cell_m).alias("oy"))
    spans = covers.join(F.broadcast(corner))  # one row
    part = lambda low, high, o: F.sequence(F.floor((F.col(low) - F.col(o)) / cell_m).cast("long"), F.ceil((F.col(high) - F.col(o)) / cell_m).cast("long") - 1)
    cells = spans.select(F.explode(part("x0", "x1", "ox")).alias("gx"), "y0", "y1", "oy").select("gx", F.explode(part("y0", "y1", "oy")).alias("gy")).distinct()
    cells = save(cells, "covered")
    sums = summed_areas(cells)
    ends = cells.agg(F.max("gx").alias("mx"), F.max("gy").alias("my"))
    placed = points.join(F.broadcast(corner)).withColumn("_cx", F.floor((F.col("x") - F.col("ox")) / cell_m).cast("long")).withColumn("_cy", F.floor((F.col("y") - F.col("oy")) / cell_m).cast("long"))
    corners = F.array(*[F.struct(F.least(F.col("_cx") + i, F.col("mx")).alias("gx"), F.least(F.col("_cy") + j, F.col("my")).alias("gy"), F.lit(s).alias("sign")) for i, j, s in ((r, r, 1), (-r - 1, r, -1), (r, -r - 1, -1), (-r - 1, -r - 1, 1))])
    asked = placed.select("_cx", "_cy").distinct().join(F.broadcast(ends)).select("_cx", "_cy", F.explode(corners).alias("c")).select("_cx", "_cy", "c.*")
    full = asked.join(sums, ["gx", "gy"]).groupBy("_cx", "_cy").agg(F.sum(F.col("sign") * F.col("n")).alias("n"))  # no sum before the first cell
    found = placed.join(full, ["_cx", "_cy"], "left").withColumn("edge", F.coalesce(F.col("n"), F.lit(0)) < (2 * r + 1) ** 2)
    return found.select(*points.columns, "edge")
