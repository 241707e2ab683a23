"""The preview model: the index on a raster of heights instead of a network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewalk.config import DEFAULT, Model
from gradewalk.functions.cost import cheapest_edges, weights
from gradewalk.operators.hbi import ratio
from gradewalk.operators.paths import search
from gradewalk.operators.raster import grid_links


def raster_index(pixels: DataFrame, size: float, targets: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """row, col and hbi of every pixel: round trips to the nearest target pixel (row, col) over eight neighbours.

    Flat time is twice one way; where that is under a second the index is 1."""
    links = grid_links(pixels, size).select("u", "v", "length", F.greatest(F.lit(-m.slope_clip), F.least(F.lit(m.slope_clip), F.col("dz") / F.col("length"))).alias("s"), F.lit(False).alias("is_stair"))
    edges = cheapest_edges(weights(links, m, ("elder", "flat")))
    start = targets.select((F.col("row").cast("long") * F.lit(1 << 31) + F.col("col")).alias("node"))
    runs = F.array(*[F.struct(F.lit(n).alias("run"), F.lit(g).alias("graph"), F.lit(b).alias("reverse")) for n, g, b in (("go", "elder", True), ("back", "elder", False), ("flat", "flat", True))])
    at = pixels.select((F.col("row").cast("long") * F.lit(1 << 31) + F.col("col")).alias("node_id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    found = search(edges, start.select(F.explode(runs).alias("r"), "node").select("r.*", "node"), places=at)
    pick = lambda n: F.max(F.when(F.col("run") == n, F.col("d")))
    wide = found.groupBy("node").agg((pick("go") + pick("back")).alias("e"), (2 * pick("flat")).alias("f"))
    h = F.when(F.col("f") < 1, 1.0).otherwise(ratio(F.col("e"), F.col("f")))
    return wide.select(F.shiftright("node", 31).cast("int").alias("row"), (F.col("node") % F.lit(1 << 31)).cast("int").alias("col"), h.alias("hbi"))


def hidden_by_blocks(index: DataFrame, k: int, limit: float = 1.15, m: Model = DEFAULT) -> DataFrame:
    """One row: burdened pixels, and the share of them in k x k blocks whose mean stays under the limit."""
    at = index.withColumn("_r", F.floor(F.col("row") / k)).withColumn("_c", F.floor(F.col("col") / k))
    means = at.groupBy("_r", "_c").agg(F.avg("hbi").alias("_mean"))
    high = F.col("hbi") >= m.band_mid
    return at.join(means, ["_r", "_c"]).agg(F.count_if(high).alias("n"), F.try_divide(F.count_if(high & (F.col("_mean") < limit)), F.count_if(high)).alias("hidden"))
