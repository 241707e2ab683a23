"""Joins of outside tables to cells, districts and names, and merging of zone exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewalk.config import CODES, DEFAULT, Model
from gradewalk.functions.geo import cell, cell_centre, haversine
from gradewalk.functions.text import digits, number, place_name, station_key
from gradewalk.operators.spatial import with_any
from gradewalk.operators.stats import best, pearson, quantiles, quartile_groups, share_below, spearman, tail_means
from gradewalk.operators.tables import save

LATEST = "__LATEST__"


def filtered(rows: DataFrame, equals: dict[str, str | list[str]] | None = None, contains: dict[str, str] | None = None) -> DataFrame:
    """Rows whose trimmed column is one of the values, in order; LATEST is the greatest text left by earlier filters."""
    for c, wanted in (equals or {}).items():
        value = F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
        if wanted == LATEST:
            rows = rows.join(F.broadcast(rows.agg(F.max(value).alias("_latest"))), value == F.col("_latest")).drop("_latest")
        else:
            rows = rows.filter(value.isin([str(w) for w in (wanted if isinstance(wanted, (list, tuple)) else [wanted])]))
    for c, part in (contains or {}).items():
        rows = rows.filter(F.coalesce(F.col(c).cast("string"), F.lit("")).contains(part))
    return rows


def _total(columns: list[str]) -> Column:
    return sum((F.coalesce(number(F.col(c)), F.lit(0.0)) for c in columns[1:]), F.coalesce(number(F.col(columns[0])), F.lit(0.0)))


def code_values(rows: DataFrame, code: str, values: list[str], bases: list[str] | None = None) -> DataFrame:
    """code (digits only) and value: the sum of values, over the sum of bases if there are any (null if that is 0)."""
    keyed = rows.select(digits(F.col(code).cast("string")).alias("code"), _total(values).alias("v"), (_total(bases) if bases else F.lit(1.0)).alias("b")).filter("code <> ''")
    found = keyed.groupBy("code").agg(F.sum("v").alias("v"), F.sum("b").alias("b"))
    return found.select("code", (F.try_divide("v", F.when(F.col("b") != 0, F.col("b"))) if bases else F.col("v")).alias("value"))


def code_keys() -> dict[str, Column]:
    """Ways to derive a district's code."""
    stat = F.coalesce("adm_cd_stat", F.lit(""))
    return {"full": F.col("adm_cd"), "first_8": F.substring("adm_cd", 1, 8), "stat": stat, "stat_7": F.substring(stat, 1, 7)}


def code_join(districts: DataFrame, values: DataFrame, least: int = 5) -> DataFrame:
    """districts with `key_kind` and `value`, by the code derivation that matches most districts (the first of equals).

    One pass counts the matches of all derivations; fewer than `least` matches give no rows."""
    keys = code_keys()
    each = districts.withColumn("_k", F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), c.alias("code")) for n, c in keys.items()])))
    met = each.select("*", F.col("_k.kind").alias("key_kind"), F.col("_k.code").alias("code")).drop("_k").join(values, "code")
    winner = met.agg(best(met, {n: F.col("key_kind") == n for n in keys}).alias("_best"), F.count("*").alias("_n"))
    chosen = met.join(F.broadcast(winner), F.col("key_kind") == F.col("_best")).drop("_best", "_n", "code")
    enough = chosen.agg((F.count("*") >= least).alias("_ok"))
    return chosen.join(F.broadcast(enough), F.col("_ok")).drop("_ok")


def join_summary(joined: DataFrame) -> DataFrame:
    """metric, value: count, correlations of hbi_mean and share_high with value, and mean values by quarter of hbi_mean."""
    full = joined.filter("value IS NOT NULL")
    one = full.agg(F.count("*").cast("double").alias("n"), pearson("hbi_mean", "value").alias("pearson_hbi"))
    ranks = spearman(full, [], "hbi_mean", "value").withColumnRenamed("rho", "spearman_hbi")
    high = spearman(full, [], "share_high", "value").withColumnRenamed("rho", "spearman_share_high")
    wide = one.join(F.broadcast(ranks), how="cross").join(F.broadcast(high), how="cross")  # single rows
    quarters = quartile_groups(full, "hbi_mean", "value").select(F.concat(F.lit("quarter_"), F.col("quarter").cast("string")).alias("metric"), F.col("mean_value").alias("value"))
    return wide.unpivot([], wide.columns, "metric", "value").unionAll(quarters)


def point_values(rows: DataFrame, values: list[str] | None = None, period: str | None = None) -> DataFrame:
    """rows with `value`: 1, or the sum of values over the number of distinct periods (null periods count as one)."""
    if not values:
        return rows.withColumn("value", F.lit(1.0))
    if period is None:
        return rows.withColumn("value", _total(values))
    periods = rows.agg((F.count_distinct(period) + F.max(F.col(period).isNull().cast("int"))).alias("_periods"))
    return rows.withColumn("value", _total(values)).join(F.broadcast(periods), how="cross").withColumn("value", F.col("value") / F.greatest("_periods", F.lit(1))).drop("_periods")


def extent(homes: DataFrame) -> DataFrame:
    """One row with the homes' envelope."""
    return homes.agg(F.min("x").alias("ex0"), F.max("x").alias("ex1"), F.min("y").alias("ey0"), F.max("y").alias("ey1"))


def inside_extent(points: DataFrame, homes: DataFrame) -> DataFrame:
    box = F.broadcast(extent(homes))
    return points.join(box, F.col("x").between(F.col("ex0"), F.col("ex1")) & F.col("y").between(F.col("ey0"), F.col("ey1"))).drop("ex0", "ex1", "ey0", "ey1")


def points_grid(homes: DataFrame, points: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """Cells of homes (x, y, hbi; min_count at least) with the sum of points' values there and its rate per 100 homes."""
    at = lambda d: d.withColumn("gx", cell(F.col("x"), m.grid_m)).withColumn("gy", cell(F.col("y"), m.grid_m))
    cells = at(homes).groupBy("gx", "gy").agg(F.count("*").alias("n_bld"), F.avg("hbi").alias("hbi_mean")).filter(F.col("n_bld") >= m.min_count)
    sums = at(points).groupBy("gx", "gy").agg(F.sum("value").alias("n_points"))
    joined = cells.join(sums, ["gx", "gy"], "left").withColumn("n_points", F.coalesce("n_points", F.lit(0.0)))
    return joined.select(cell_centre(F.col("gx"), m.grid_m).alias("cell_x"), cell_centre(F.col("gy"), m.grid_m).alias("cell_y"), "n_bld", "hbi_mean", "n_points", (F.col("n_points") / F.col("n_bld") * 100).alias("per100_bld"))


def points_district(homes: DataFrame, points: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """The same by district; both sides carry adm_cd."""
    own = homes.filter("adm_cd IS NOT NULL").groupBy("adm_cd").agg(F.count("*").alias("n_bld"), F.avg("hbi").alias("hbi_mean")).filter(F.col("n_bld") >= m.min_count)
    sums = points.groupBy("adm_cd").agg(F.sum("value").alias("n_points"))
    joined = own.join(sums, "adm_cd", "left").withColumn("n_points", F.coalesce("n_points", F.lit(0.0)))
    return joined.withColumn("per100_bld", F.col("n_points") / F.col("n_bld") * 100)


def row_flow(rows: DataFrame, passes: Column, homes: DataFrame, cells: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """One row of counters: all, passing, with coordinates, in the homes' extent, in a kept cell."""
    ok = F.coalesce(passes, F.lit(False))
    placed = ok & F.col("x").isNotNull() & F.col("y").isNotNull()
    box = F.broadcast(extent(homes))
    kept = cells.select(F.floor(F.col("cell_x") / m.grid_m).cast("long").alias("gx"), F.floor(F.col("cell_y") / m.grid_m).cast("long").alias("gy"), F.lit(True).alias("kept"))
    seen = rows.join(box, how="cross").withColumn("inside", placed & F.col("x").between(F.col("ex0"), F.col("ex1")) & F.col("y").between(F.col("ey0"), F.col("ey1")))
    seen = seen.withColumn("gx", cell(F.col("x"), m.grid_m)).withColumn("gy", cell(F.col("y"), m.grid_m)).join(kept, ["gx", "gy"], "left")
    return seen.agg(F.count("*").alias("n_all"), F.count_if(ok).alias("n_passed"), F.count_if(placed).alias("n_placed"), F.count_if("inside").alias("n_inside"), F.count_if(F.col("inside") & F.col("kept")).alias("n_in_cells"))


def legal_names(parcels: DataFrame, events: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """Legal districts of parcels (emd_cd, sgg_nm, emd_nm, n, hbi_mean) with events (gu, dong) of the same normalised name."""
    key = lambda a, b: [place_name(F.col(a)).alias("_g"), place_name(F.col(b)).alias("_d")]
    counts = events.select(*key("gu", "dong")).filter("_g <> '' AND _d <> ''").groupBy("_g", "_d").agg(F.count("*").alias("n_events"))
    named = parcels.filter(F.trim("emd_nm") != "").filter(F.col("n") >= m.min_count).select("*", *key("sgg_nm", "emd_nm"))
    one = named.groupBy("_g", "_d").agg(F.max_by(F.struct(*parcels.columns), F.col("emd_cd")).alias("r")).select("_g", "_d", "r.*")
    joined = one.join(counts, ["_g", "_d"], "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    return joined.select("emd_cd", "sgg_nm", "emd_nm", F.col("n").alias("n_parcel"), "hbi_mean", "n_events", (F.col("n_events") / F.col("n") * 100).alias("per100_parcel"))


def rate_report(rows: DataFrame, rate: str) -> DataFrame:
    """rho, low_mean and high_mean of a rate against hbi_mean."""
    return spearman(rows, [], "hbi_mean", rate).join(F.broadcast(tail_means(rows, "hbi_mean", rate)), how="cross")


def statistic_join(districts: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """districts (gu, adm_nm, weight_all, weight_high) with columns of stats (gu, dong, ...) by normalised name.

    Each column gets `_in_high`: its share by the weight over the high band, to one decimal."""
    s = stats.select(place_name(F.col("gu")).alias("_g"), place_name(F.col("dong")).alias("_d"), *columns)
    s = s.groupBy("_g", "_d").agg(*[F.max(c).alias(c) for c in columns])
    keyed = districts.withColumn("_g", place_name(F.col("gu"))).withColumn("_d", place_name(F.element_at(F.split("adm_nm", " "), -1)))
    high = lambda c: F.round(F.try_divide(F.col(c) * F.col("weight_high"), F.when(F.col("weight_all") != 0, F.col("weight_all"))), 1)
    return keyed.join(s, ["_g", "_d"], "left").drop("_g", "_d").withColumns({f"{c}_in_high": high(c) for c in columns})


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key and side of keys that only one table has."""
    only = lambda a, b, side: a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("side", F.lit(side))
    return only(left, right, "left").unionAll(only(right, left, "right"))


def district_context(buildings: DataFrame, zones: DataFrame, stations: DataFrame, stops: DataFrame, links: DataFrame, cells: DataFrame | None = None, m: Model = DEFAULT) -> DataFrame:
    """One row for each district (adm_cd on every input; zones with area_m2) of at least min_count buildings.

    buildings: cls, floors, weight. links: length. cells: value and residential, an outside 50 m table."""
    classes = [*CODES.use_classes, "other"]
    own = buildings.filter("adm_cd IS NOT NULL").groupBy("adm_cd").agg(
        F.count("*").alias("n_bld_all"), F.avg("floors").alias("mean_floors"),
        *[(F.count_if(F.col("cls") == c) / F.count("*")).alias(f"n_share_{c}") for c in classes],
        *[F.try_divide(F.coalesce(F.sum(F.when(F.col("cls") == c, F.col("weight"))), F.lit(0.0)), F.sum("weight")).alias(f"w_share_{c}") for c in classes],
    ).filter(F.col("n_bld_all") >= m.min_count)
    count = lambda d, name: d.groupBy("adm_cd").agg(F.count("*").alias(name))
    roads = links.groupBy("adm_cd").agg((F.sum("length") / 1000).alias("_km"))
    found = own.join(zones.select("adm_cd", "area_m2"), "adm_cd").join(count(stations, "n_station"), "adm_cd", "left").join(count(stops, "n_bus_stop"), "adm_cd", "left").join(roads, "adm_cd", "left")
    found = found.na.fill(0, ["n_station", "n_bus_stop", "_km"]).withColumn("link_km_per_km2", F.try_divide("_km", F.col("area_m2") / 1e6)).drop("_km", "area_m2")
    if cells is None:
        return found
    home = lambda c: F.coalesce(F.sum(F.when(F.col("residential"), c)), F.lit(0.0))
    sums = cells.groupBy("adm_cd").agg(home(F.col("value")).alias("res_sum"), F.sum("value").alias("all_sum"), F.count_if("residential").alias("n_cells_res"), F.count("*").alias("n_cells_all"))
    return found.join(sums, "adm_cd", "left").na.fill(0, ["res_sum", "all_sum", "n_cells_res", "n_cells_all"])


def residential_cells(cells: DataFrame, key: str, buildings: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """cells with `residential`: a home within residential_cell_m and no shop."""
    side = lambda c: buildings.filter(F.col("cls") == c).select(F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = with_any(cells, side("home"), m.residential_cell_m, key)
    lonely = with_any(near, side("shop"), m.residential_cell_m, key, how="left_anti").select(key, F.lit(True).alias("_r"))
    return cells.join(lonely, key, "left").withColumn("residential", F.col("_r").isNotNull()).drop("_r")


def reconcile(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 0.011) -> DataFrame:
    """One row: how many keys both sides have, and how many of them differ by more than the tolerance."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    return both.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("_a") - F.col("_b")) > tolerance).alias("n_differ"))


def merge_zones(grids: list[DataFrame]) -> DataFrame:
    """Zone exports of grids under each other; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), grids)


def merged_summary(cells: DataFrame) -> DataFrame:
    """target, metric, value of merged grids: means are weighted by the homes of a cell."""
    n, high = F.sum("n_bld"), F.sum(F.col("n_bld") * F.col("share_high"))
    wide = cells.groupBy("target").agg(n.cast("double").alias("n_buildings"), high.alias("n_high"), F.try_divide(high, n).alias("share_high"), F.sum("weight").alias("weight"), F.try_divide(F.sum(F.col("n_bld") * F.col("hbi_mean")), n).alias("hbi_mean"))
    return wide.unpivot("target", wide.columns[1:], "metric", "value")


def ranked_sites(sites: DataFrame, cells: DataFrame) -> DataFrame:
    """sites (name, hbi_mean) with their percentile among merged cells."""
    found = share_below(sites, "name", "hbi_mean", cells, "hbi_mean", "percentile")
    return sites.join(found, "name", "left").withColumn("top10", F.col("percentile") >= 0.9)


def inner_routes(pairs: DataFrame, box: tuple[float, float, float, float], edge_m: float = 500.0) -> DataFrame:
    """Pairs whose both ends lie at least edge_m inside a zone's box (x0, y0, x1, y1)."""
    inside = lambda x, y: F.col(x).between(box[0] + edge_m, box[2] - edge_m) & F.col(y).between(box[1] + edge_m, box[3] - edge_m)
    return pairs.filter(inside("ox", "oy") & inside("dx", "dy"))


def allocate(districts: DataFrame, population: str = "pop65") -> DataFrame:
    """One row: people and minutes of an intervention, by each district's share of weight."""
    share = lambda c: F.sum(F.col(population) * F.col(c) / F.when(F.col("weight_all") != 0, F.col("weight_all")))
    return districts.agg(share("weight_benefit").alias("people"), share("weight_x_saved_min").alias("minutes"))


def compare_grids(a: DataFrame, b: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """One row comparing hbi_mean of cells that both grids have."""
    size = m.grid_m
    at = lambda d, name: d.select(cell(F.col("cell_x"), size).alias("gx"), cell(F.col("cell_y"), size).alias("gy"), F.col("hbi_mean").alias(name))
    both = at(a, "a").join(at(b, "b"), ["gx", "gy"])
    cuts = quantiles(both, [], {"a90": ("a", 0.9), "b90": ("b", 0.9), "a50": ("a", 0.5), "b50": ("b", 0.5)})
    top, high = F.col("a") >= F.col("a90"), F.col("a") >= m.band_mid
    found = both.join(F.broadcast(cuts), how="cross").agg(F.count("*").alias("n_common"), (F.count_if(top & (F.col("b") >= F.col("b90"))) / F.greatest(F.count_if(top), F.lit(1))).alias("top10_agree"), F.count_if(high).alias("n_mid_or_high"), F.try_divide(F.count_if(high & (F.col("b") < m.band_mid)), F.count_if(high)).alias("missed"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_diff"), F.max("a50").alias("median_a"), F.max("b50").alias("median_b"))
    return found.join(F.broadcast(spearman(both, [], "a", "b").withColumnRenamed("rho", "rank_corr")), how="cross")


def nearest_named(stations: DataFrame, others: DataFrame) -> DataFrame:
    """stations (name, lon, lat) with the least distance to one of the same name's key; null if there is none."""
    keyed = stations.withColumn("_k", station_key(F.col("name")))
    o = others.select(station_key(F.col("name")).alias("_k"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    met = keyed.join(o, "_k", "left").groupBy("name", "lon", "lat").agg(F.min(haversine(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))).alias("d_m"))
    return met


def far_namesakes(met: DataFrame, limit: float = 500.0) -> DataFrame:
    """Rows of nearest_named whose namesake lies farther away than the limit: their coordinates want a look."""
    return met.filter(F.col("d_m") > limit)


def complete_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value in each of the columns, such as both ends of a route or a facility."""
    return rows.dropna("any", subset=columns)


def first_match(names: DataFrame, sites: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """names with the first site (by order) whose name contains key.

    A name that contains the key contains all of its runs of three characters (or all of a shorter one): both sides meet by
    the one of them that fewest names have. Of sites of one name the first stands for all. Spark would judge the runs by the
    size of the file they come from and send them through the driver, so these joins are merges."""
    k, n = F.col(key), F.col(name)
    runs = lambda c, w: F.when(F.length(c) >= w, F.transform(F.sequence(F.lit(1), F.length(c) - w + 1), lambda i: F.substr(c, i, F.lit(w)))).otherwise(F.array().cast("array<string>"))
    least = save(sites.filter(n.isNotNull()).groupBy(name).agg(F.min(order).alias(order)), "first-sites")
    pieces = least.select(name, order, F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *[runs(n, w) for w in (1, 2, 3)]))).alias("_g"))
    keys = save(names.select(key).distinct(), "keys")
    own = keys.select(key, F.explode(F.when(F.length(k) <= 3, F.array(k)).otherwise(F.array_distinct(runs(k, 3)))).alias("_g"))
    often = pieces.groupBy("_g").agg(F.count("*").alias("_n"))
    rarest = own.hint("merge").join(often.hint("merge"), "_g", "left").groupBy(key).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_g")).alias("_r"))
    met = rarest.filter("_r._n > 0").select(key, "_r._g").hint("merge").join(pieces.hint("merge"), "_g").filter(n.contains(k))
    return names.hint("merge").join(met.groupBy(key).agg(F.min_by(name, order).alias(name)).hint("merge"), key, "left")


def cell_or_nearest(points: DataFrame, key: str, cells: DataFrame, far_m: float = 400.0, m: Model = DEFAULT) -> DataFrame:
    """points with the cell they are in, else the nearest cell centre within far_m: cell_x, cell_y, how."""
    from gradewalk.operators.spatial import nearest

    size = m.grid_m
    own = points.withColumn("_gx", cell(F.col("x"), size)).withColumn("_gy", cell(F.col("y"), size))
    centres = cells.select(F.struct("cell_x", "cell_y").alias("centre"), F.col("cell_x").alias("rx"), F.col("cell_y").alias("ry"), cell(F.col("cell_x"), size).alias("_gx"), cell(F.col("cell_y"), size).alias("_gy")).distinct()
    hit = own.join(centres.select("_gx", "_gy", F.col("centre").alias("same")), ["_gx", "_gy"], "left").drop("_gx", "_gy")
    near = nearest(hit, key, centres.select("centre", "rx", "ry"), far_m, "centre")
    at = F.coalesce("same", "centre")
    return near.select(*points.columns, at["cell_x"].alias("cell_x"), at["cell_y"].alias("cell_y"), F.when(F.col("same").isNotNull(), "cell").when(F.col("centre").isNotNull(), "nearest").alias("how"))
