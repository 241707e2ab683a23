"""Building the walking network from lines, polygons and points."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewalk.config import CODES, DEFAULT, Model
from gradewalk.functions.geo import cell, distance, principal_axis
from gradewalk.operators.components import labelled
from gradewalk.operators.spatial import in_polygons, inside_rings, nearest, placed, within
from gradewalk.operators.tables import save

NODING_CELL_M = 100.0
SNAP_DIGITS = 2
SHORTEST_M = 0.05


def segments_of(lines: DataFrame) -> DataFrame:
    """line_id, seg, x0, y0, x1, y1 of each vertex pair of lines (line_id, points)."""
    pair = F.transform(F.sequence(F.lit(0), F.size("points") - 2), lambda i: F.struct(i.alias("seg"), F.get("points", i).alias("a"), F.get("points", i + 1).alias("b")))
    return lines.filter(F.size("points") >= 2).select("line_id", F.explode(pair).alias("s")).select("line_id", "s.seg", F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1"))


def node_lines(lines: DataFrame, cell_m: float = NODING_CELL_M) -> DataFrame:
    """line_id, part, points: lines cut wherever they meet another line.

    Segment pairs meet in grid cells; every segment gets the places along it where another crosses or touches it or
    ends on it, snapped to centimetres. Parts end at those cuts that lie on another line; vertices that no other line
    touches stay inside a part. Sub-segments that several lines share are kept once."""
    seg = segments_of(lines).withColumn("id", F.struct("line_id", "seg"))
    covered = lambda a, b: F.sequence(F.least(cell(F.col(a), cell_m), cell(F.col(b), cell_m)), F.greatest(cell(F.col(a), cell_m), cell(F.col(b), cell_m)))
    placed = seg.withColumn("gx", F.explode(covered("x0", "x1"))).withColumn("gy", F.explode(covered("y0", "y1")))
    # a long diagonal would fill its whole box: keep the cells that the segment's line comes near
    middle = lambda g: (F.col(g) + 0.5) * cell_m
    off = F.abs((F.col("x1") - F.col("x0")) * (middle("gy") - F.col("y0")) - (F.col("y1") - F.col("y0")) * (middle("gx") - F.col("x0")))
    placed = placed.filter(off <= distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) * cell_m * 0.7072)
    other = placed.select(F.col("id").alias("oid"), "gx", "gy", *[F.col(c).alias("o" + c) for c in ("x0", "y0", "x1", "y1")])
    pairs = placed.join(other, ["gx", "gy"]).filter(F.col("id") != F.col("oid")).dropDuplicates(["id", "oid"])
    dx, dy, ex, ey = (F.col(a) - F.col(b) for a, b in (("x1", "x0"), ("y1", "y0"), ("ox1", "ox0"), ("oy1", "oy0")))
    det, fx, fy = dx * ey - dy * ex, F.col("ox0") - F.col("x0"), F.col("oy0") - F.col("y0")
    length = F.greatest(F.hypot(dx, dy), F.lit(1e-9))
    eps = 0.5 * 10.0**-SNAP_DIGITS
    t, u = F.try_divide(fx * ey - fy * ex, det), F.try_divide(fx * dy - fy * dx, det)
    reach, oreach = eps / length, eps / F.greatest(F.hypot(ex, ey), F.lit(1e-9))
    crossing = F.when((F.abs(det) > 1e-9 * length) & t.between(-reach, 1 + reach) & u.between(-oreach, 1 + oreach), t)
    on = lambda px, py: F.when(F.abs(dx * (F.col(py) - F.col("y0")) - dy * (F.col(px) - F.col("x0"))) <= eps * length, ((F.col(px) - F.col("x0")) * dx + (F.col(py) - F.col("y0")) * dy) / (length * length))
    touching = F.filter(F.array(crossing, on("ox0", "oy0"), on("ox1", "oy1")), lambda v: v.isNotNull() & (v >= -reach) & (v <= 1 + reach))
    other_line = F.col("id.line_id") != F.col("oid.line_id")
    skipped = ~other_line & (F.abs(F.col("id.seg") - F.col("oid.seg")) <= 1)  # neighbours of a line share a vertex
    at = pairs.filter(~skipped).select("id", F.explode(touching).alias("t")).groupBy("id").agg(F.collect_set(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "t"))).alias("cuts"))
    cut = seg.join(at, "id", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>")))
    stops = F.array_sort(F.array_union(F.array(F.lit(0.0), F.lit(1.0)), F.col("cuts")))
    r = lambda c: F.round(c, SNAP_DIGITS)
    point = lambda v: F.struct(r(F.col("x0") + v * (F.col("x1") - F.col("x0"))).alias("x"), r(F.col("y0") + v * (F.col("y1") - F.col("y0"))).alias("y"))
    bits = F.transform(F.sequence(F.lit(0), F.size("stops") - 2), lambda i: F.struct(i.alias("i"), point(F.get("stops", i)).alias("a"), point(F.get("stops", i + 1)).alias("b"), (F.array_contains("cuts", F.get("stops", i)) | ((i == 0) & (F.col("seg") == 0))).alias("begins")))
    small = cut.withColumn("stops", stops).select("line_id", "seg", F.explode(bits).alias("b")).select("line_id", "seg", "b.*").filter("a <> b")
    small = small.withColumn("_k", F.struct(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")))
    once = small.groupBy("_k").agg(F.min(F.struct("line_id", "seg", "i", "a", "b", "begins")).alias("s")).select("s.*")
    order = Window.partitionBy("line_id").orderBy("seg", "i")
    gap = F.lag("b").over(order) != F.col("a")  # a piece left out because another line has it
    parts = once.withColumn("part", F.sum((F.col("begins") | F.coalesce(gap, F.lit(True))).cast("int")).over(order))
    joined = parts.groupBy("line_id", "part").agg(F.array_sort(F.collect_list(F.struct("seg", "i", "a", "b"))).alias("p"))
    return joined.select("line_id", "part", F.concat(F.array(F.col("p")[0]["a"]), F.transform("p", lambda s: s["b"])).alias("points"))


def _arcs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))])


def running_lengths(points: DataFrame, by: list[str], order: str) -> DataFrame:
    """points (x, y) with n, their place in their group from 1, and arc, the running length at each; groups of any size."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    placed = points.withColumn("n", F.row_number().over(w).cast("long")).withColumn("_step", step)
    return placed.withColumn("arc", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_step")


def segmentize(parts: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """Links of at most segment_m: keys of parts, k, x0, y0, x1, y1, xm, ym, length. Equal cuts of each polyline's length.

    A polyline's running lengths are made once, and its cuts are looked up in them."""
    keys, ends = [c for c in parts.columns if c != "points"], ["x0", "y0", "x1", "y1", "xm", "ym", "length"]

    def cut(batches):
        for b in batches:
            rows, out = [], []
            for row, points in enumerate(b.column(b.num_columns - 1)):
                flat = points.values
                x, y = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")) if flat is not None and len(flat) else (np.zeros(1), np.zeros(1))
                arcs = _arcs(x, y)
                total = arcs[-1]
                if total < SHORTEST_M:
                    continue
                n = max(1, math.ceil(total / m.segment_m))
                at = np.arange(2 * n + 1) / (2 * n) * total
                px, py = np.interp(at, arcs, x), np.interp(at, arcs, y)
                rows += [row] * n
                out.append(np.stack([np.arange(n), px[:-1:2], py[:-1:2], px[2::2], py[2::2], px[1::2], py[1::2], np.full(n, total / n)]))
            found = np.concatenate(out, axis=1) if out else np.zeros((8, 0))
            taken = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns[:-1], pa.array(found[0].astype(np.int32)), *[pa.array(c) for c in found[1:]]], names=[*keys, "k", *ends])

    schema = parts.select(*keys).schema.add("k", "integer")
    for c in ends:
        schema = schema.add(c, "double")
    return parts.select(*keys, "points").mapInArrow(cut, schema)


def merge_nodes(links: DataFrame, m: Model = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): ends rounded half to even to snap_m become nodes, numbered in order of x then y; loops go.

    Numbers come from ranges: distinct ends are sorted by range and numbered by partition, with no global window."""
    key = lambda c: F.rint(F.col(c) / m.snap_m).cast("long")
    keyed = links.withColumn("_u", F.struct(key("x0").alias("kx"), key("y0").alias("ky"))).withColumn("_v", F.struct(key("x1").alias("kx"), key("y1").alias("ky")))
    ends = keyed.select(F.explode(F.array("_u", "_v")).alias("e")).distinct()
    nodes = numbered(ends.select("e.kx", "e.ky"), ["kx", "ky"], "node_id")
    number = nodes.select(F.struct("kx", "ky").alias("e"), "node_id")
    keyed = keyed.join(number.select(F.col("e").alias("_u"), F.col("node_id").alias("u")), "_u").join(number.select(F.col("e").alias("_v"), F.col("node_id").alias("v")), "_v")
    return nodes.select("node_id", (F.col("kx") * m.snap_m).alias("x"), (F.col("ky") * m.snap_m).alias("y")), keyed.filter("u <> v").drop("_u", "_v")


def merge_within(points: DataFrame, key: str, tolerance: float = 1.0) -> DataFrame:
    """key and node: points (key, x, y) whose distances chain within a tolerance share the least key of the chain.

    Rounding (merge_nodes) parts points on two sides of a grid line; this does not, and depends on no order of rows."""
    places = save(points.filter(placed("x", "y")).groupBy("x", "y").agg(F.min(key).alias(key)), "places")  # points of one place are one
    other = places.select(F.col(key).alias("_o"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    pairs = within(places, other, tolerance).filter(F.col(key) < F.col("_o"))
    chains = labelled(pairs.select(F.col(key).alias("a"), F.col("_o").alias("b"))).withColumnRenamed("v", key)
    named = places.join(chains.hint("merge"), key, "left").select("x", "y", F.coalesce("component", key).alias("node"))
    return points.select(key, "x", "y").join(named.hint("merge"), ["x", "y"], "left").select(key, F.coalesce("node", key).alias("node"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows, distinct in `order`, with their rank from 0: counts by bucket of the first column, then ranks in buckets."""
    bucket = F.floor(F.col(order[0]) / 64)
    cells = rows.groupBy(bucket.alias("_b")).agg(F.count("*").alias("_n"))
    before = cells.withColumn("_before", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).drop("_n")
    ranked = rows.withColumn("_b", bucket).withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    return ranked.join(before, "_b").withColumn(name, F.col("_before") + F.col("_r") - 1).drop("_b", "_r", "_before")


def tag(links: DataFrame, key: str, polygons: DataFrame, flag: str, cell_m: float = NODING_CELL_M) -> DataFrame:
    """links with `flag`: whether their middle (xm, ym) lies in a polygon (ordinal, rings and envelope columns)."""
    found = in_polygons(links, key, polygons.select(F.col("ordinal").alias("_ord"), F.col("rings").alias("_rings"), *[F.col(c).alias("_" + c) for c in ("x0", "y0", "x1", "y1")]), "_ord", inside_rings("xm", "ym", "_rings"), cell_m, ("_x0", "_y0", "_x1", "_y1"), "xm", "ym")
    return found.withColumn(flag, F.col("_ord").isNotNull()).drop("_ord", "_rings", "_x0", "_y0", "_x1", "_y1")


def is_stair_kind(kind: Column) -> Column:
    return F.upper(F.coalesce(kind.cast("string"), F.lit(CODES.stair_kind))).isin(CODES.stair_kind, "NONE", "")


def stair_connectors(stairs: DataFrame, nodes: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """Links through stairs (ordinal, ring) that no link crosses: both ends of the main axis near distinct nodes."""
    axis = save(stairs.select("ordinal", principal_axis(F.col("ring")).alias("a")), "axes")
    near = nodes.select("node_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    ends = lambda p, q, n: nearest(axis.select("ordinal", F.col(f"a.{p}").alias("x"), F.col(f"a.{q}").alias("y")), "ordinal", near, m.stair_connect_m, "node_id").select("ordinal", F.col("node_id").alias(n), F.col("d").alias(f"d{n}"))
    both = axis.join(ends("ax", "ay", "u"), "ordinal").join(ends("bx", "by", "v"), "ordinal").filter("u <> v")
    length = distance(F.col("a.ax"), F.col("a.ay"), F.col("a.bx"), F.col("a.by")) + F.col("du") + F.col("dv")
    return both.select("u", "v", length.alias("length"), F.lit(True).alias("is_stair"), F.lit(False).alias("flat"), F.col("a.cx").alias("xm"), F.col("a.cy").alias("ym"), F.lit(1).cast("byte").alias("kind"))


def degrees(links: DataFrame) -> DataFrame:
    """node_id and degree of the ends of links."""
    return links.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))


def graph_components(links: DataFrame) -> DataFrame:
    """node_id and comp, the component's least node."""
    return labelled(links.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("v").alias("node_id"), F.col("component").alias("comp"))


def bridges(nodes: DataFrame, links: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """Links from each dead end to the nearest node (ties by id) of another component within bridge_m."""
    known = nodes.join(graph_components(links), "node_id", "left").withColumn("comp", F.coalesce("comp", "node_id"))
    ends = known.join(degrees(links).filter("degree = 1"), "node_id").select("node_id", "x", "y", "comp")
    others = known.select(F.col("node_id").alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("comp").alias("rcomp"))
    found = within(ends, others, m.bridge_m).filter("comp <> rcomp")
    best = found.groupBy("node_id").agg(F.min(F.struct("d", "other", "x", "y", "rx", "ry")).alias("b"))
    return best.select(F.col("node_id").alias("u"), F.col("b.other").alias("v"), F.greatest("b.d", F.lit(0.5)).alias("length"), F.lit(False).alias("is_stair"), F.lit(False).alias("flat"), ((F.col("b.x") + F.col("b.rx")) / 2).alias("xm"), ((F.col("b.y") + F.col("b.ry")) / 2).alias("ym"), F.lit(2).cast("byte").alias("kind"))


def keep_large(nodes: DataFrame, links: DataFrame, m: Model = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(nodes with comp and kept, links of kept components); kept are those of at least keep_share of the largest."""
    comp = nodes.join(graph_components(links), "node_id", "left").withColumn("comp", F.coalesce("comp", "node_id"))
    sizes = comp.groupBy("comp").agg(F.count("*").alias("n"))
    large = sizes.join(F.broadcast(sizes.agg(F.max("n").alias("most"))), how="cross").select("comp", (F.col("n") >= m.keep_share * F.col("most")).alias("kept"))
    marked = comp.join(large, "comp").select(*nodes.columns, "comp", "kept")
    return marked, links.join(marked.filter("kept").select(F.col("node_id").alias("u")), "u").select(*links.columns)


def build(lines: DataFrame, stairs: DataFrame, level: DataFrame, m: Model = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a network from lines (line_id, points), stairs and level polygons (bridges, tunnels).

    Polygons have ordinal, rings and envelope columns x0, y0, x1, y1; stairs a kind as well."""
    pieces = save(segmentize(node_lines(lines), m).withColumn("_id", F.struct("line_id", "part", "k")), "pieces")
    used = stairs.filter(is_stair_kind(F.col("kind"))).drop("kind")
    pieces = tag(tag(pieces, "_id", used, "is_stair"), "_id", level, "flat")
    nodes, links = merge_nodes(pieces.drop("_id", "line_id", "part", "k"), m)
    columns = ["u", "v", "length", "is_stair", "flat", "xm", "ym", "kind"]
    nodes, links = save(nodes, "nodes"), save(links.withColumn("kind", F.lit(0).cast("byte")).select(*columns), "links")
    met = in_polygons(pieces, "_id", used.select("ordinal", F.col("rings").alias("_r"), *[F.col(c).alias("_" + c) for c in ("x0", "y0", "x1", "y1")]), "ordinal", inside_rings("xm", "ym", "_r"), NODING_CELL_M, ("_x0", "_y0", "_x1", "_y1"), "xm", "ym")
    crossed = met.filter("ordinal IS NOT NULL").select("ordinal").distinct()
    idle = used.join(crossed, "ordinal", "left_anti").select("ordinal", F.col("rings")[0].alias("ring"))
    links = save(links.unionByName(stair_connectors(idle, nodes, m)), "links")
    links = save(links.unionByName(bridges(nodes, links, m)), "links")
    return keep_large(nodes, links, m)
