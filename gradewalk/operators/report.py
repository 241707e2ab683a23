"""The reporting layer: metric bundles with what they need, and viewer payloads."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewalk.config import DEFAULT, Model
from gradewalk.operators.stats import index_quantile
from gradewalk.operators.tables import save

#: Newer and older names of the same metric, the preferred first.
VERSIONS = {"hbi_median": ("hbi_median", "hbi_median_v4")}


def metric(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """target and value of the first of several metric names that a target has."""
    found = rows.filter(F.col("metric").isin(*names)).withColumn("_k", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("metric")))
    return found.groupBy("target").agg(F.min_by("value", "_k").alias("value"))


def metric_names(tables: list[DataFrame]) -> DataFrame:
    """metric: the sorted distinct metric names of several reports."""
    return reduce(DataFrame.unionAll, [t.select("metric") for t in tables]).distinct().orderBy("metric")


def bundle(fields: DataFrame) -> DataFrame:
    """One row `json` from fields (key, value, label, need array, optional): fields and the list of missing ones."""
    missing = F.col("value").isNull() & ~F.col("optional")
    entry = F.struct("value", "label", "need", "optional")
    both = fields.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", entry.alias("entry"))))).alias("fields"), F.array_sort(F.collect_list(F.when(missing, F.struct("key", "label", "need")))).alias("missing"))
    return both.select(F.to_json(F.struct("fields", "missing"), {"ignoreNullFields": "false"}).alias("json"))


def viewer_cells(cells: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """One row `json`: cells as positional arrays, and the colour scale's cap (95th percentile of minutes up to a 5, 10 at least)."""
    cap = index_quantile(cells, "elder_min", 0.95).select(F.greatest(F.lit(10.0), F.ceil(F.col("q") / 5) * 5).alias("cap"))
    packed = cells.agg(F.array_sort(F.collect_list(F.array(*[F.col(c).cast("double") for c in ("cell_x", "cell_y", "n_bld", "hbi_mean", "share_high", "elder_min")]))).alias("cells"))
    return packed.join(F.broadcast(cap), how="cross").select(F.to_json(F.struct("cells", "cap")).alias("json"))


def viewer_stats(cells: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """gu, homes, share over the high band weighted by homes, and the median cell (the upper one of an even number)."""
    ranked = F.array_sort(F.collect_list("hbi_mean"))  # cells of a borough, not homes
    return cells.groupBy("gu").agg(F.sum("n_bld").alias("n_bld"), F.try_divide(F.sum(F.col("n_bld") * F.col("share_high")), F.sum("n_bld")).alias("share_high"), F.element_at(ranked, (F.floor(F.count("*") / 2) + 1).cast("int")).alias("hbi_median"))


def outing_index(points: DataFrame, population: DataFrame) -> DataFrame:
    """rho, n and p of points' sums over residents against hbi_mean, by district."""
    from gradewalk.operators.stats import p_value, spearman

    joined = points.join(population, "adm_cd").filter("pop60 > 0").withColumn("outing", F.col("n_points") / F.col("pop60"))
    joined = save(joined, "outings")
    counted = spearman(joined, [], "hbi_mean", "outing").join(F.broadcast(joined.agg(F.count("*").alias("n"))), how="cross")
    return counted.filter("n >= 5").withColumn("p", p_value("rho", "n"))


def overlap_of_quarters(rows: DataFrame, value: str, high_is_poor: bool = True) -> DataFrame:
    """One row n: districts in the top quarter of hbi_mean and in the poor quarter of value; null under 8 districts."""
    rows = save(rows, "quarters")  # quantiles are held against the same bits
    h, v = index_quantile(rows, "hbi_mean", 0.75, 8).withColumnRenamed("q", "_h"), index_quantile(rows, value, 0.75 if high_is_poor else 0.25, 8).withColumnRenamed("q", "_v")
    poor = F.col(value) >= F.col("_v") if high_is_poor else F.col(value) <= F.col("_v")
    both = rows.join(F.broadcast(h), how="cross").join(F.broadcast(v), how="cross")  # two single rows
    return both.agg(F.when(F.max("_h").isNotNull(), F.count_if((F.col("hbi_mean") >= F.col("_h")) & poor)).alias("n"))


def html(template: str, payload: str) -> str:
    """A page with its data: the mark /*DATA*/ replaced by the payload, which must be JSON."""
    json.loads(payload)
    return template.replace("/*DATA*/", payload.replace("</", "<\\/"))


def leading_facility(rows: DataFrame) -> DataFrame:
    """One row: the planned facility that saves most, of an intervention summary of one target."""
    planned = rows.filter(~F.col("facility").startswith("ALL"))
    return planned.agg(F.max_by(F.struct(*rows.columns), F.struct("sum_saved_bld_min", "facility")).alias("r")).select("r.*")
