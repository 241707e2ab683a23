"""The Hill Burden Index: slope-aware over flat round-trip time from homes to the nearest destination, and its roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewalk.config import DEFAULT, Model
from gradewalk.functions.cost import cheapest_edges, slope, weights
from gradewalk.functions.geo import cell, cell_centre
from gradewalk.operators.paths import by_component, search
from gradewalk.operators.spatial import nearest
from gradewalk.operators.stats import quantiles
from gradewalk.operators.tables import save

GRAPHS = ("elder", "flat", "wheel", "wheel_flat")


def sloped(nodes: DataFrame, links: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """links with s and clipped, from the heights of their ends."""
    z = lambda end: nodes.select(F.col("node_id").alias(end), F.col("z").alias(f"z{end}")).hint("merge")  # grows with the network, however small its file
    both = links.join(z("u"), "u", "left").join(z("v"), "v", "left")
    s, clipped = slope(F.col("zu"), F.col("zv"), F.col("length"), F.col("flat"), m)
    return both.withColumn("s", s).withColumn("clipped", clipped).drop("zu", "zv")


def snap(points: DataFrame, key: str, nodes: DataFrame, radius: float) -> DataFrame:
    """points with node_id and snap_d of the nearest node within radius."""
    near = nodes.select("node_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    return nearest(points, key, near, radius, "node_id").withColumnRenamed("d", "snap_d")


def destination_nodes(dests: DataFrame, nodes: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """target and node of destinations (id, x, y, target) that reach a node."""
    return snap(dests, "id", nodes, m.dest_snap_m).filter("node_id IS NOT NULL").select("target", F.col("node_id").alias("node")).distinct()


def legs(edges: DataFrame, dests: DataFrame, shards: int = 2, components: DataFrame | None = None, places: DataFrame | None = None, at: DataFrame | None = None) -> DataFrame:
    """target, graph, leg (go: to a destination, back: from one), node, d. Edges are the cheapest ones.

    With components (node_id, comp) of the network every component is searched in a task of its own. With at (node) only those nodes are asked for."""
    edges = save(edges.select("graph", "src", "dst", "w"), "graphs")  # read for their names, too
    graphs = edges.select("graph").distinct()
    run = lambda back: F.concat_ws("|", "target", F.lit("back" if back else "go"), "graph")
    starts = dests.join(F.broadcast(graphs), how="cross")  # a few graphs
    sources = starts.select(run(False).alias("run"), "graph", F.lit(True).alias("reverse"), "node").unionAll(starts.select(run(True).alias("run"), "graph", F.lit(False).alias("reverse"), "node"))
    if components is not None:
        edges, sources = by_component(edges, sources, components)
    part = F.split("run", r"\|")
    return search(edges, sources, shards, places=places, at=at, stored=components is None).select(part[0].alias("target"), part[2].alias("graph"), part[1].alias("leg"), "node", "d")


def round_trips(edges: DataFrame, dests: DataFrame, shards: int = 2, components: DataFrame | None = None, places: DataFrame | None = None, at: DataFrame | None = None) -> DataFrame:
    """target, graph, node, go, back: least times to a destination and from one, each minimised on its own; of the nodes of at (node), if given."""
    leg = lambda name: F.max(F.when(F.col("leg") == name, F.col("d"))).alias(name)
    return legs(cheapest_edges(edges), dests, shards, components, places, at).groupBy("target", "graph", "node").agg(leg("go"), leg("back"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 1 where b is 0, null where either is missing."""
    return F.when(b == 0, F.when(a.isNotNull(), 1.0)).otherwise(a / b)


def home_times(homes: DataFrame, trips: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """One row for each home and target: times (s), distance and ratios; null where a trip can't be made.

    homes: id, node_id and what else they carry."""
    total = F.col("go") + F.col("back")
    pick = lambda g, what, name: F.max(F.when(F.col("graph") == g, what)).alias(name)
    wide = trips.groupBy("target", "node").agg(pick("elder", total, "t_elder"), pick("elder", F.col("back"), "t_elder_back"), pick("flat", total, "t_flat"), pick("flat", F.col("back"), "t_flat_back"), pick("wheel", total, "t_wheel"), pick("wheel_flat", total, "t_wheel_flat"))
    names = [c for c in wide.columns if c.startswith("t_")]
    targets = trips.select("target").distinct()
    every = homes.join(F.broadcast(targets), how="cross").join(wide.withColumnRenamed("node", "node_id").hint("merge"), ["node_id", "target"], "left")
    ratios = {"dist_net": F.col("t_flat") / 2 * m.elder_speed, "hbi": ratio(F.col("t_elder"), F.col("t_flat")), "home_ratio": ratio(F.col("t_elder_back"), F.col("t_flat_back")), "wheel_ratio": ratio(F.col("t_wheel"), F.col("t_wheel_flat"))}
    return every.select(*homes.columns, "target", *names).withColumns(ratios)


def run(nodes: DataFrame, links: DataFrame, homes: DataFrame, dests: DataFrame, m: Model = DEFAULT, graphs: tuple[str, ...] = GRAPHS, components: DataFrame | None = None) -> DataFrame:
    """home_times of homes (id, x, y, ...) over a network with heights."""
    edges = weights(sloped(nodes, links, m), m, graphs)
    snapped, ends = save(snap(homes, "id", nodes, m.origin_snap_m), "snapped"), save(destination_nodes(dests, nodes, m), "destinations")
    at = save(snapped.filter("node_id IS NOT NULL").select(F.col("node_id").alias("node")).unionAll(ends.select("node")).distinct(), "at")  # a target is known by trips at its destinations
    return home_times(snapped, save(round_trips(edges, ends, components=components, places=nodes, at=at), "trips"), m)


def usable(rows: DataFrame) -> DataFrame:
    """Rows with an index, away from the data's edge if that was marked."""
    return rows.filter(F.col("hbi").isNotNull() & ~F.col("edge")) if "edge" in rows.columns else rows.filter(F.col("hbi").isNotNull())


def band(h: Column, m: Model = DEFAULT) -> Column:
    return F.when(h >= m.band_high, "high").when(h >= m.band_mid, "mid").when(h.isNotNull(), "level")


def grid(rows: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """Cells with at least min_count homes by target."""
    size, high = m.grid_m, (F.col("hbi") >= m.band_high).cast("double")
    cells = usable(rows).groupBy("target", cell(F.col("x"), size).alias("gx"), cell(F.col("y"), size).alias("gy")).agg(
        F.count("*").alias("n_bld"), F.sum("weight").alias("weight"), F.avg("hbi").alias("hbi_mean"), F.percentile("hbi", F.lit(0.5)).alias("hbi_median"), F.avg(high).alias("share_high"),
        (F.percentile("t_elder", F.lit(0.5)) / 60).alias("elder_min"), (F.percentile("t_flat", F.lit(0.5)) / 60).alias("flat_min"),
    ).filter(F.col("n_bld") >= m.min_count)
    return cells.select("target", cell_centre(F.col("gx"), size).alias("cell_x"), cell_centre(F.col("gy"), size).alias("cell_y"), "n_bld", "weight", "hbi_mean", "hbi_median", "share_high", "elder_min", "flat_min")


def summary(rows: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """target, metric, value: eleven metrics a target in long form. Empty input gives no rows."""
    inner = ~F.col("edge") if "edge" in rows.columns else F.lit(True)
    v = inner & F.col("hbi").isNotNull()
    h, over = F.col("hbi"), v & (F.col("hbi") >= m.band_high)
    share = lambda cond, base: F.try_divide(F.count_if(cond), F.count_if(base))
    metrics = {
        "n_buildings": F.count_if(v).cast("double"), "n_excluded_edge": F.count_if(~inner).cast("double"), "hbi_median": F.max("_hbi"),
        "share_mid": share(v & (h >= m.band_mid) & (h < m.band_high), v), "share_high": share(over, v), "n_high": F.count_if(over).cast("double"),
        "home_ratio_median": F.max("_home"), "elder_minutes_median": F.max("_elder") / 60, "wheel_unreachable_share": share(inner & F.col("t_wheel").isNull(), inner),
        "weight_high": F.sum(F.when(over, F.col("weight"))), "weight_all": F.sum(F.when(v, F.col("weight"))),
    }
    rows = save(rows, "index")  # read for the medians and for the rest
    middle = quantiles(rows.filter(v), ["target"], {"_hbi": ("hbi", 0.5), "_home": ("home_ratio", 0.5), "_elder": ("t_elder", 0.5)})
    wide = rows.join(F.broadcast(middle), "target", "left").groupBy("target").agg(*[c.alias(n) for n, c in metrics.items()])  # a row a target
    return wide.unpivot("target", list(metrics), "metric", "value")


def district(rows: DataFrame, population: DataFrame | None = None, m: Model = DEFAULT) -> DataFrame:
    """Roll-up by district (adm_cd, adm_nm on rows) of one target: n_bld counts homes with an index, weight_all all."""
    has, over = F.col("hbi").isNotNull(), F.col("hbi") >= m.band_high
    inner = rows.filter(~F.col("edge")) if "edge" in rows.columns else rows
    found = inner.filter("adm_cd IS NOT NULL").groupBy("adm_cd", "adm_nm").agg(F.count_if(has).alias("n_bld"), F.avg("hbi").alias("hbi_mean"), F.avg(F.when(has, over.cast("double"))).alias("share_high"), F.sum("weight").alias("weight_all"), F.coalesce(F.sum(F.when(over, F.col("weight"))), F.lit(0.0)).alias("weight_high"))
    found = found.filter(F.col("n_bld") >= m.min_count)
    if population is None:
        return found
    return found.join(population, "adm_cd", "left").withColumn("elderly_in_high_est", F.rint(F.col("pop65") * F.try_divide("weight_high", "weight_all"))).drop("pop65")


def parcels(homes_in_parcels: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """pnu, emd_cd, jimok and hbi: the highest index of a parcel's homes."""
    return usable(homes_in_parcels).filter("pnu IS NOT NULL").groupBy("pnu").agg(F.max("emd_cd").alias("emd_cd"), F.max("jimok").alias("jimok"), F.max("sgg_nm").alias("sgg_nm"), F.max("emd_nm").alias("emd_nm"), F.max("hbi").alias("hbi"))


def parcels_by_district(parcel_rows: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """Legal districts' building plots: count, mean index and share over the high band; min_count at least."""
    plots = parcel_rows.filter(F.col("jimok").contains("대"))
    found = plots.groupBy("emd_cd").agg(F.count("*").alias("n"), F.avg("hbi").alias("hbi_mean"), F.avg((F.col("hbi") >= m.band_high).cast("double")).alias("share_high"), F.min("sgg_nm").alias("sgg_nm"), F.min("emd_nm").alias("emd_nm"))
    return found.filter(F.col("n") >= m.min_count)
