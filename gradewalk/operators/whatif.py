"""What-if queries: parameter scenarios, new facilities, isochrones and siting. All runs of a query are one job."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewalk.config import CODES, DEFAULT, FACILITY, SENSITIVITY, Model
from gradewalk.functions.cost import cheapest_edges, weights
from gradewalk.functions.geo import cell, cell_centre, distance
from gradewalk.operators.hbi import destination_nodes, legs, ratio, round_trips, sloped, snap
from gradewalk.operators.paths import lowered, search, single_paths
from gradewalk.operators.spatial import nearest_any
from gradewalk.operators.stats import quantiles, share_below, spearman
from gradewalk.operators.tables import save
from gradewalk.operators.union import outline_pieces, union_areas, union_layer

ALL = "ALL"


def _named_graphs(nodes: DataFrame, links: DataFrame, models: dict[str, Model], graphs: tuple[str, ...]) -> DataFrame:
    """Edges of all models' graphs, each graph named `model/graph`."""
    parts = [weights(sloped(nodes, links, m), m, graphs).withColumn("graph", F.concat(F.lit(f"{name}/"), "graph")) for name, m in models.items()]
    return reduce(DataFrame.unionAll, parts)


def scenario_indices(nodes: DataFrame, links: DataFrame, homes: DataFrame, dests: DataFrame, target: str, m: Model = DEFAULT, scenarios: dict[str, dict] = SENSITIVITY) -> DataFrame:
    """scenario, id, hbi of every home for the base model and each scenario. Heights are sloped anew for each model."""
    models = {"base": m} | {name: m.but(**changes) for name, changes in scenarios.items()}
    snapped = save(snap(homes.select("id", "x", "y"), "id", nodes, m.origin_snap_m), "snapped")
    at = save(snapped.filter("node_id IS NOT NULL").select(F.col("node_id").alias("node")).distinct(), "at")
    trips = round_trips(_named_graphs(nodes, links, models, ("elder", "flat")), destination_nodes(dests.filter(F.col("target") == target), nodes, m), 4, at=at)
    part, total = F.split("graph", "/"), F.col("go") + F.col("back")
    wide = trips.groupBy(part[0].alias("scenario"), "node").agg(F.max(F.when(part[1] == "elder", total)).alias("e"), F.max(F.when(part[1] == "flat", total)).alias("f"))
    return snapped.join(wide, F.col("node_id") == F.col("node")).select("scenario", "id", ratio(F.col("e"), F.col("f")).alias("hbi"))


def sensitivity(indices: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """scenario, hbi_median, share_high, rank_corr_vs_base, top10_overlap (share of the base's top tenth also on top)."""
    base = indices.filter("scenario = 'base'").select("id", F.col("hbi").alias("base"))
    rows = indices.join(base, "id")
    cuts = quantiles(indices, ["scenario"], {"cut": ("hbi", 0.9), "hbi_median": ("hbi", 0.5)})
    base_cut = cuts.filter("scenario = 'base'").select(F.col("cut").alias("base_cut"))
    marked = rows.join(F.broadcast(cuts), "scenario").join(F.broadcast(base_cut), how="cross")  # one row a scenario, one row
    top, both = F.col("base") >= F.col("base_cut"), (F.col("base") >= F.col("base_cut")) & (F.col("hbi") >= F.col("cut"))
    found = marked.groupBy("scenario").agg(F.max("hbi_median").alias("hbi_median"), F.avg((F.col("hbi") >= m.band_high).cast("double")).alias("share_high"), (F.count_if(both) / F.greatest(F.count_if(top), F.lit(1))).alias("top10_overlap"))
    return found.join(spearman(rows, ["scenario"], "base", "hbi").withColumnRenamed("rho", "rank_corr_vs_base"), "scenario", "left")


def facility_edges(facilities: DataFrame, nodes: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """facility, status, u, v, seconds of facilities (facility, type, status, ax, ay, bx, by, wait_s, speed)."""
    near = nodes.select("node_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    end = lambda x, y, n: nearest_any(facilities.select("facility", F.col(x).alias("x"), F.col(y).alias("y")), "facility", near, 100.0, "node_id").select("facility", F.col("node_id").alias(n), F.col("d").alias(f"d{n}"))
    known = F.coalesce(*[F.when(F.lower(F.trim("type")) == t, F.struct(F.lit(w).alias("wait"), F.lit(s).alias("speed"))) for t, (w, s) in FACILITY.items()], F.struct(F.lit(FACILITY["elevator"][0]).alias("wait"), F.lit(FACILITY["elevator"][1]).alias("speed")))
    ends = facilities.join(end("ax", "ay", "u"), "facility").join(end("bx", "by", "v"), "facility")
    straight = distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    seconds = F.coalesce("wait_s", known["wait"]) + straight / F.coalesce(F.col("speed"), known["speed"]) + (F.col("du") + F.col("dv")) / m.elder_speed
    return ends.select("facility", F.lower(F.trim(F.coalesce("status", F.lit("planned")))).alias("status"), "u", "v", seconds.alias("seconds"))


def intervention_times(nodes: DataFrame, links: DataFrame, homes: DataFrame, dests: DataFrame, facility: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """One row for each facility (and ALL: those not yet there), target and home: times before and after.

    facility is what facility_edges gives; its edges go both ways at the same time in the elder and the wheelchair graph. New
    edges only lower times, so each facility visits just what it brings nearer, from one copy of the network."""
    edges = save(cheapest_edges(weights(sloped(nodes, links, m), m, ("elder", "flat", "wheel"))), "weights")
    before = save(legs(edges, destination_nodes(dests, nodes, m), 1, places=nodes), "before")
    each = facility.select(F.col("facility").alias("scenario"), "u", "v", "seconds").unionAll(facility.filter("status <> 'existing'").select(F.lit(ALL).alias("scenario"), "u", "v", "seconds"))
    each = save(each, "facilities")
    names = each.select("scenario").distinct()
    run = F.concat_ws("|", "target", "leg", "graph")
    searched = before.filter("graph <> 'flat'").select("target", "leg", "graph").distinct()
    way = F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))).alias("way")
    extra = each.join(F.broadcast(searched), how="cross").select(F.concat_ws("|", "scenario", run).alias("run"), run.alias("of"), "graph", (F.col("leg") == "go").alias("reverse"), way, F.col("seconds").alias("w"))  # a few targets, legs and graphs
    base = before.filter("graph <> 'flat'").select(run.alias("of"), "graph", (F.col("leg") == "go").alias("reverse"), "node", "d")
    low = lowered(edges, base, extra.select("run", "of", "graph", "reverse", "way.*", "w"), places=nodes)
    tail = F.substring_index("run", "|", -3)  # what a facility is called may hold anything
    part = F.split(tail, r"\|")
    legs_of = [(g, leg, f"{g}_{leg}") for g in ("elder", "flat", "wheel") for leg in ("go", "back")]
    pick = lambda g, leg, name: F.max(F.when((F.col("graph") == g) & (F.col("leg") == leg), F.col("d"))).alias(name)
    was = before.groupBy(F.col("target").alias("_t"), F.col("node").alias("_n")).agg(*[pick(*x) for x in legs_of])
    now = low.select(F.substring("run", F.lit(1), F.length("run") - F.length(tail) - 1).alias("facility"), part[0].alias("target"), part[1].alias("leg"), part[2].alias("graph"), "node", "d")
    now = now.groupBy("facility", F.col("target").alias("_t"), F.col("node").alias("_n")).agg(*[pick(g, leg, f"new_{name}") for g, leg, name in legs_of if g != "flat"])
    snapped = snap(homes, "id", nodes, m.origin_snap_m).filter("node_id IS NOT NULL")
    every = snapped.join(F.broadcast(names.withColumnRenamed("scenario", "facility")), how="cross").join(F.broadcast(before.select("target").distinct()), how="cross")  # a row for each home, facility and target is what is asked for
    on = (F.col("node_id") == F.col("_n")) & (F.col("target") == F.col("_t"))
    met = every.join(was, on, "left").drop("_t", "_n").join(now.withColumnRenamed("facility", "_f"), on & (F.col("facility") == F.col("_f")), "left").drop("_t", "_n", "_f")
    met = met.filter(F.coalesce(*[F.col(c) for c in met.columns if c.startswith(("elder_", "wheel_", "new_"))]).isNotNull())
    total = lambda g, new: (F.coalesce(F.col(f"new_{g}_go"), F.col(f"{g}_go")) if new else F.col(f"{g}_go")) + (F.coalesce(F.col(f"new_{g}_back"), F.col(f"{g}_back")) if new else F.col(f"{g}_back"))
    return met.select(*snapped.columns, "facility", "target", total("elder", True).alias("elder1"), total("wheel", True).alias("wheel1"), total("elder", False).alias("elder0"), total("flat", False).alias("flat0"), total("wheel", False).alias("wheel0"))


def effects(times: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """times with saved, benefit, newly, wheel_benefit, the index before and after, and whether a band was left."""
    ok = F.col("elder0").isNotNull() & F.col("elder1").isNotNull()
    saved = F.when(ok, F.col("elder0") - F.col("elder1")).otherwise(0.0)
    newly = F.col("wheel0").isNull() & F.col("wheel1").isNotNull()
    h0, h1 = F.try_divide("elder0", "flat0"), F.try_divide("elder1", "flat0")
    out = lambda level: F.coalesce(ok & (h0 >= level) & (h1 < level), F.lit(False))
    return times.withColumns({"saved": saved, "benefit": ok & (saved >= m.benefit_s), "newly": newly, "wheel_benefit": F.coalesce(newly | (F.col("wheel0") - F.col("wheel1") >= m.benefit_s), F.lit(False)), "h0": h0, "h1": h1, "exit_high": out(m.band_high), "exit_mid": out(m.band_mid)})


def intervention_summary(times: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """Fourteen columns for each facility and target."""
    ben = lambda c: F.when(F.col("benefit"), c)
    n_high = F.count_if("exit_high")
    return effects(times, m).groupBy("facility", "target").agg(
        F.count_if("benefit").alias("n_benefit"), F.coalesce(F.sum(ben(F.col("weight"))), F.lit(0.0)).alias("weight_benefit"), (F.avg(ben(F.col("saved"))) / 60).alias("mean_saved_min"), (F.max(ben(F.col("saved"))) / 60).alias("max_saved_min"),
        (F.coalesce(F.sum(ben(F.col("saved"))), F.lit(0.0)) / 60).alias("sum_saved_bld_min"), F.avg(ben(F.col("h0"))).alias("hbi_before"), F.avg(ben(F.col("h1"))).alias("hbi_after"), F.count_if("newly").alias("wheel_newly_reachable"), F.count_if("wheel_benefit").alias("wheel_benefit"),
        n_high.alias("n_exit_high"), F.when(n_high >= m.min_count, F.sum(F.when(F.col("exit_high"), F.col("weight")))).alias("weight_exit_high"), F.count_if("exit_mid").alias("n_exit_mid"),
    )


def intervention_grid(times: DataFrame, m: Model = DEFAULT) -> DataFrame:
    size = m.grid_m
    found = effects(times, m).filter("benefit").groupBy("facility", "target", cell(F.col("x"), size).alias("gx"), cell(F.col("y"), size).alias("gy")).agg(F.count("*").alias("n_benefit"), (F.avg("saved") / 60).alias("mean_saved_min"))
    return found.filter(F.col("n_benefit") >= m.min_count).select("facility", "target", cell_centre(F.col("gx"), size).alias("cell_x"), cell_centre(F.col("gy"), size).alias("cell_y"), "n_benefit", "mean_saved_min")


def intervention_district(times: DataFrame, weight_all: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """Roll-up of times with adm_cd; weight_all has adm_cd and weight_all of every usable home."""
    n_high = F.count_if("exit_high")
    ben = lambda c: F.when(F.col("benefit"), c)
    found = effects(times, m).filter("adm_cd IS NOT NULL").groupBy("facility", "target", "adm_cd").agg(F.count_if("benefit").alias("n_benefit"), F.sum(ben(F.col("weight"))).alias("weight_benefit"), F.sum(ben(F.col("weight") * F.col("saved") / 60)).alias("weight_x_saved_min"), F.when(n_high >= m.min_count, F.sum(F.when(F.col("exit_high"), F.col("weight")))).alias("weight_exit_high"))
    return found.filter(F.col("n_benefit") >= m.min_count).join(weight_all, "adm_cd", "left")


def isochrone_times(nodes: DataFrame, links: DataFrame, points: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """name, mode, node, t: time from every node to points (name, x, y)."""
    near = nodes.select("node_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    starts = nearest_any(points.select("name", "x", "y"), "name", near, 100.0, "node_id").select("name", F.col("node_id").alias("node"))
    edges = cheapest_edges(weights(sloped(nodes, links, m), m, ("flat", "elder", "wheel")))
    runs = starts.withColumn("graph", F.explode(F.array(F.lit("flat"), F.lit("elder"), F.lit("wheel")))).select(F.concat_ws("|", "name", "graph").alias("run"), "graph", F.lit(True).alias("reverse"), "node")
    found, part = search(edges, runs, places=nodes), F.split("run", r"\|")
    return found.select(part[0].alias("name"), part[1].alias("mode"), "node", F.col("d").alias("t"))


def reached_links(times: DataFrame, links: DataFrame, minutes: DataFrame) -> DataFrame:
    """name, mode, minutes, u, v, length of links whose both ends are reached in time. minutes: name, minutes."""
    end = lambda c: times.select("name", "mode", F.col("node").alias(c), F.col("t").alias(f"t{c}"))
    longest = minutes.groupBy("name").agg((F.max("minutes") * 60).alias("_most"))
    times = save(times.join(F.broadcast(longest), "name").filter(F.col("t") <= F.col("_most")).drop("_most"), "reached")  # both ends of links ask for it
    both = links.select("u", "v", "length").join(end("u"), "u").join(end("v"), ["name", "mode", "v"])
    return both.join(F.broadcast(minutes), "name").filter(F.greatest("tu", "tv") <= F.col("minutes") * 60).select("name", "mode", "minutes", "u", "v", "length")


def cover_cells(reached: DataFrame, nodes: DataFrame, cell_m: float = 5.0, m: Model = DEFAULT) -> DataFrame:
    """name, mode, minutes, gx, gy of raster cells whose centre lies within the buffer of a reached link.

    Stands in for a buffer, union and simplification of polygons: the area is cells times cell_m^2, and it is exact to
    about a cell along the outline."""
    n = lambda c: nodes.select(F.col("node_id").alias(c), F.col("x").alias(f"x{c}"), F.col("y").alias(f"y{c}"))
    r = m.isochrone_buffer_m
    # a link's cells are listed once, however many runs reach it
    shape = reached.select("u", "v").distinct().join(n("u"), "u").join(n("v"), "v")
    span = lambda a, b: F.sequence(cell(F.least(a, b) - r, cell_m), cell(F.greatest(a, b) + r, cell_m))
    cells = shape.withColumn("gx", F.explode(span("xu", "xv"))).withColumn("gy", F.explode(span("yu", "yv")))
    dx, dy = F.col("xv") - F.col("xu"), F.col("yv") - F.col("yu")
    px, py = cell_centre(F.col("gx"), cell_m) - F.col("xu"), cell_centre(F.col("gy"), cell_m) - F.col("yu")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(px * dx + py * dy, dx * dx + dy * dy), F.lit(0.0))))
    near = cells.filter(F.hypot(px - t * dx, py - t * dy) <= r).select("u", "v", "gx", "gy")
    return reached.select("name", "mode", "minutes", "u", "v").join(near, ["u", "v"]).select("name", "mode", "minutes", "gx", "gy").distinct()


def isochrone_layer(reached: DataFrame, nodes: DataFrame, tolerance: float = 10.0, m: Model = DEFAULT) -> DataFrame:
    """name, mode, minutes, area_m2, rings and geom (WKB MultiPolygon) of the land within the buffer of reached links, longest minutes first.

    Areas are those of the whole outlines; rings and geom leave out points that matter less."""
    n = lambda c, k: nodes.select(F.col("node_id").alias(c), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    by = ["name", "mode", "minutes"]
    links = reached.select(*by, "u", "v").join(n("u", 0), "u").join(n("v", 1), "v")
    pieces = save(outline_pieces(links, by, m.isochrone_buffer_m), "outlines")
    return union_areas(pieces, by).join(union_layer(pieces, by, tolerance), by).orderBy("name", "mode", F.desc("minutes"))


def isochrone_summary(cells: DataFrame, homes: DataFrame, cell_m: float = 5.0, m: Model = DEFAULT) -> DataFrame:
    """name, mode, minutes, area_km2, ratio_to_flat, n_res_bld (null under min_count)."""
    area = cells.groupBy("name", "mode", "minutes").agg((F.count("*") * cell_m * cell_m / 1e6).alias("area_km2"))
    inside = homes.select(cell(F.col("x"), cell_m).alias("gx"), cell(F.col("y"), cell_m).alias("gy")).join(cells, ["gx", "gy"]).groupBy("name", "mode", "minutes").agg(F.count("*").alias("n"))
    flat = area.filter("mode = 'flat'").select("name", "minutes", F.col("area_km2").alias("flat"))
    found = area.join(flat, ["name", "minutes"], "left").join(inside, ["name", "mode", "minutes"], "left")
    return found.select("name", "mode", "minutes", "area_km2", F.try_divide("area_km2", "flat").alias("ratio_to_flat"), F.when(F.col("n") >= m.min_count, F.col("n")).alias("n_res_bld"))


def monotone_failures(summary: DataFrame) -> DataFrame:
    """Rows whose slope-aware area is over the flat one."""
    return summary.filter((F.col("mode") == "elder") & (F.col("ratio_to_flat") > 1.001))


def clip_convex(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """The part of a polygon inside a convex one (both counter-clockwise, n x 2), side by side of the latter."""
    for k in range(len(clip)):
        if len(subject) == 0:
            break
        a, b = clip[k], clip[(k + 1) % len(clip)]
        side = (b[0] - a[0]) * (subject[:, 1] - a[1]) - (b[1] - a[1]) * (subject[:, 0] - a[0])
        kept = []
        for p, q, sp, sq in zip(subject, np.roll(subject, -1, axis=0), side, np.roll(side, -1), strict=True):
            if sp >= 0:
                kept.append(p)
            if (sp > 0 > sq) or (sp < 0 < sq):
                kept.append(p + (q - p) * sp / (sp - sq))
        subject = np.array(kept).reshape(-1, 2)
    return subject


def shoelace(p: np.ndarray) -> float:
    return 0.0 if len(p) < 3 else float(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1))) / 2


def capsule(ax: float, ay: float, bx: float, by: float, r: float, steps: int = 8) -> np.ndarray:
    """A segment's buffer with so many steps a quarter circle, counter-clockwise."""
    angle = math.atan2(by - ay, bx - ax)
    turn = np.linspace(-math.pi / 2, math.pi / 2, 2 * steps + 1)
    end = lambda x, y, a: np.column_stack([x + r * np.cos(a + turn), y + r * np.sin(a + turn)])
    return np.vstack([end(bx, by, angle), end(ax, ay, angle + math.pi)])


def siting(facilities: DataFrame, parcels: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """facility, status, buffer_m, n_parcels, area_m2 and a share for each parcel class (null under min_count).

    facilities: facility, status, ax, ay, bx, by. parcels: x0, y0, x1, y1, ring (points), jimok. Envelopes meet in
    100 m cells; the exact overlap of a parcel with the convex buffer is clipped in Arrow batches."""
    r, size = m.siting_buffer_m, 100.0
    low, high = (lambda a, b: F.least(a, b) - r), (lambda a, b: F.greatest(a, b) + r)
    boxes = facilities.withColumns({"fx0": low("ax", "bx"), "fx1": high("ax", "bx"), "fy0": low("ay", "by"), "fy1": high("ay", "by")})
    span = lambda a, b: F.explode(F.sequence(cell(F.col(a), size), cell(F.col(b), size)))
    left = boxes.withColumn("gx", span("fx0", "fx1")).withColumn("gy", span("fy0", "fy1"))
    right = parcels.withColumn("pid", F.xxhash64("x0", "y0", "x1", "y1", "jimok", "pnu")).withColumn("gx", span("x0", "x1")).withColumn("gy", span("y0", "y1"))
    pairs = left.join(right, ["gx", "gy"]).filter("fx0 <= x1 AND fx1 >= x0 AND fy0 <= y1 AND fy1 >= y0").dropDuplicates(["facility", "pid"])

    @F.pandas_udf("double")
    def overlap(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, ring: pd.Series) -> pd.Series:
        areas = []
        for a, b, c, d, points in zip(ax, ay, bx, by, ring, strict=True):
            p = np.array([(q["x"], q["y"]) for q in points], float)
            p = p if shoelace(p) >= 0 else p[::-1]
            areas.append(shoelace(clip_convex(p, capsule(a, b, c, d, r))))
        return pd.Series(areas)

    cut = pairs.withColumn("area", overlap("ax", "ay", "bx", "by", "ring")).filter("area > 0")
    cls = F.coalesce(*[F.when(F.trim("jimok").isin(*codes), F.lit(name)) for name, codes in CODES.parcel_classes.items()], F.lit("other"))
    total, n = F.sum("area"), F.count("*")
    shares = [F.when(n >= m.min_count, F.coalesce(F.sum(F.when(F.col("cls") == c, F.col("area"))), F.lit(0.0)) / total).alias(f"share_{c}") for c in [*CODES.parcel_classes, "other"]]
    return cut.withColumn("cls", cls).groupBy("facility", "status").agg(F.lit(r).alias("buffer_m"), n.alias("n_parcels"), total.alias("area_m2"), *shares)


def routes(nodes: DataFrame, links: DataFrame, pairs: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """name, mode, seconds, length_m of the cheapest way for pairs (name, o, d) of nodes, in four modes.

    Adults take the older walker's way at their own speed. A way's length is that of the edges it takes."""
    every = save(weights(sloped(nodes, links, m), m, ("elder", "wheel", "flat", "length")), "route-weights")
    edges = every.filter("graph <> 'length'")
    edges = edges.unionAll(edges.filter("graph = 'elder'").select(F.lit("adult").alias("graph"), "src", "dst", (F.col("w") * (m.elder_speed / m.adult_speed)).alias("w")))
    modes = F.array(*[F.lit(x) for x in ("elder", "adult", "wheel", "flat")])
    wanted = pairs.withColumn("graph", F.explode(modes)).select(F.concat_ws("|", "name", "graph").alias("run"), "graph", "o", "d")
    found = save(single_paths(edges, wanted, places=nodes), "routes")
    step = F.transform(F.sequence(F.lit(0), F.size("nodes") - 2), lambda i: F.struct(F.get("nodes", i).alias("src"), F.get("nodes", i + 1).alias("dst")))
    part = F.split("run", r"\|")
    steps = save(found.filter(F.size("nodes") > 1).select("run", part[1].alias("graph"), F.explode(step).alias("s")).select("run", "graph", "s.src", "s.dst"), "route-steps")
    on = steps.select("src", "dst").distinct()  # of the network's edges those that a way takes are looked at
    lengths = every.filter("graph = 'length'").join(on, ["src", "dst"], "left_semi").select("src", "dst", F.col("w").alias("length"))
    chosen = edges.join(on, ["src", "dst"], "left_semi").join(lengths, ["src", "dst"]).groupBy("graph", "src", "dst").agg(F.min(F.struct("w", "length"))["length"].alias("length"))
    total = steps.join(chosen, ["graph", "src", "dst"]).groupBy("run").agg(F.sum("length").alias("length_m"))
    joined = found.join(total, "run", "left")
    return joined.select(part[0].alias("name"), part[1].alias("mode"), F.col("cost").alias("seconds"), F.when(F.col("cost").isNotNull(), F.coalesce("length_m", F.lit(0.0))).alias("length_m"))


def measured(route_rows: DataFrame, measured_rows: DataFrame) -> DataFrame:
    """n and r of measured minutes against the adult prediction; three pairs at least."""
    from gradewalk.operators.stats import pearson

    pairs = route_rows.filter("mode = 'adult'").join(measured_rows, "name").select((F.col("seconds") / 60).alias("p"), F.col("measured_min").alias("q")).filter("p IS NOT NULL AND q IS NOT NULL")
    return pairs.agg(F.count("*").alias("n"), pearson("p", "q").alias("r_adult_pred_vs_measured")).filter("n >= 3")


def site_rank(sites: DataFrame, homes: DataFrame, cells: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """Sites (name, x, y, radius) with the index around them and their percentile among grid cells and among circles.

    Circles of the first site's radius stand around the centre of every occupied cell. cells is hbi.grid of one target."""
    from gradewalk.operators.spatial import within

    h = homes.select("id", F.col("x").alias("rx"), F.col("y").alias("ry"), "hbi")
    reach = sites.agg(F.max("radius")).first()[0]
    near = within(sites.select("name", "x", "y", "radius"), h, reach).filter("d <= radius")
    own = near.groupBy("name").agg(F.count("*").alias("n_bld"), F.avg("hbi").alias("hbi_mean"), F.avg((F.col("hbi") >= m.band_high).cast("double")).alias("share_high"))
    radius = sites.agg(F.min_by("radius", "name")).first()[0]
    centres = homes.select(cell_centre(cell(F.col("x"), m.grid_m), m.grid_m).alias("x"), cell_centre(cell(F.col("y"), m.grid_m), m.grid_m).alias("y")).distinct()
    circles = within(centres, h, radius).groupBy("x", "y").agg(F.count("*").alias("n"), F.avg("hbi").alias("mean")).filter(F.col("n") >= m.min_count)
    below = lambda frame, c, name: share_below(own, "name", "hbi_mean", frame, c, name)
    ranked = sites.select("name").join(own, "name", "left").join(below(cells, "hbi_mean", "percentile"), "name", "left").join(below(circles, "mean", "percentile_circle"), "name", "left")
    return ranked.select("name", F.coalesce("n_bld", F.lit(0)).alias("n_bld"), "hbi_mean", "share_high", "percentile", (F.col("percentile") >= 0.9).alias("top10"), "percentile_circle", (F.col("percentile_circle") >= 0.9).alias("top10_circle"))


def new_candidates(cells: DataFrame, sites: DataFrame, threshold: Column, far_m: float = 500.0, most: int = 30) -> DataFrame:
    """The highest cells over a threshold that lie farther than far_m from every site."""
    from gradewalk.operators.spatial import with_any

    keyed = cells.withColumn("_c", F.struct("cell_x", "cell_y"))
    far = with_any(keyed, sites.select(F.col("x").alias("rx"), F.col("y").alias("ry")), far_m, "_c", "cell_x", "cell_y", how="left_anti").drop("_c")
    return far.filter(F.col("hbi_mean") > threshold).orderBy(F.desc("hbi_mean"), "cell_x", "cell_y").limit(most)


def spaced_top(cells: DataFrame, apart_m: float, most: int = 5) -> list:
    """Greedy choice of the highest cells at least apart_m from each other; a short report.

    Each choice takes the highest of all cells that are far enough from the earlier ones."""
    from gradewalk.operators.tables import save

    chosen: list = []
    left = save(cells, "cells")
    while len(chosen) < most and (r := left.orderBy(F.desc("hbi_mean"), "cell_x", "cell_y").first()):
        chosen.append(r)
        x, y = F.lit(r["cell_x"]), F.lit(r["cell_y"])
        left = left.filter((F.hypot(F.col("cell_x") - x, F.col("cell_y") - y) >= apart_m) & ~((F.col("cell_x") == x) & (F.col("cell_y") == y)))
    return chosen


def ablation(rows: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """metric, value: what is missed without slopes, without stairs, or on coarse cells. rows of one target.

    t_wheel_stairok (wheelchair times if stairs could be passed) and hbi_dem1 (another height model) are optional."""
    v = rows.filter("hbi IS NOT NULL AND t_flat IS NOT NULL")
    cuts = quantiles(v, [], {"e90": ("t_elder", 0.9), "f90": ("t_flat", 0.9), "f50": ("t_flat", 0.5)})
    size = m.coarse_grid_m
    coarse = v.groupBy(cell(F.col("x"), size).alias("gx"), cell(F.col("y"), size).alias("gy")).agg(F.avg("hbi").alias("coarse"))
    full = v.withColumn("gx", cell(F.col("x"), size)).withColumn("gy", cell(F.col("y"), size)).join(coarse, ["gx", "gy"]).join(F.broadcast(cuts), how="cross")
    top, ftop, high = F.col("t_elder") >= F.col("e90"), F.col("t_flat") >= F.col("f90"), F.col("hbi") >= m.band_high
    share = lambda a, b: F.count_if(a & b) / F.greatest(F.count_if(b), F.lit(1))
    metrics = {"top_tenth_missed_flat": share(~ftop, top), "high_but_fine_flat": share(F.col("t_flat") <= F.col("f50"), high), "high_hidden_coarse": F.try_divide(F.count_if(high & (F.col("coarse") < m.band_mid)), F.count_if(high))}
    found = full.agg(*[c.alias(n) for n, c in metrics.items()])
    found = found.join(F.broadcast(spearman(v, [], "t_elder", "t_flat").withColumnRenamed("rho", "rank_corr_flat")), how="cross")
    if "t_wheel_stairok" in rows.columns:
        w, w2 = F.col("t_wheel"), F.col("t_wheel_stairok")
        wheel = rows.agg((1 - 1 / F.avg(F.when(w2 > 0, w / w2))).alias("wheel_underestimate"), F.avg(w.isNull().cast("double")).alias("wheel_unreachable"))
        found = found.join(F.broadcast(wheel), how="cross")
    if "hbi_dem1" in rows.columns:
        two = v.filter("hbi_dem1 IS NOT NULL")
        found = found.join(F.broadcast(spearman(two, [], "hbi", "hbi_dem1").withColumnRenamed("rho", "dem_rank_corr")), how="cross").join(F.broadcast(two.agg(F.avg(F.abs(F.col("hbi") - F.col("hbi_dem1"))).alias("dem_mean_abs_diff"))), how="cross")
    return found.unpivot([], found.columns, "metric", "value")
