"""Travel costs of links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewalk.config import DEFAULT, Model


def tobler(slope: Column) -> Column:
    """Walking speed (km/h) on a slope."""
    return 6.0 * F.exp(-3.5 * F.abs(slope + 0.05))


def slow_down(slope: Column) -> Column:
    """How many times slower than on the flat; exp(3.5 s) uphill."""
    return F.exp(3.5 * (F.abs(slope + 0.05) - 0.05))


def slope(z_from: Column, z_to: Column, length: Column, flat: Column, m: Model = DEFAULT) -> tuple[Column, Column]:
    """Clipped slope of a link, and whether it was clipped. Missing heights and bridges or tunnels count as level."""
    raw = F.when(flat, 0.0).otherwise(F.coalesce(z_to - z_from, F.lit(0.0)) / F.greatest(length, F.lit(0.5)))
    return F.greatest(F.lit(-m.slope_clip), F.least(F.lit(m.slope_clip), raw)), F.abs(raw) > m.slope_clip


def elder_seconds(length: Column, s: Column, stair: Column, m: Model = DEFAULT) -> Column:
    """An older walker's time: full burden uphill, a share of it downhill, stairs as at least 25 % steep.

    Level stairs count as uphill in both directions."""
    steep = F.when(stair, F.when(s >= 0, F.greatest(s, F.lit(0.25))).otherwise(F.least(s, F.lit(-0.25)))).otherwise(s)
    down = slow_down(steep) if m.downhill_weight == 0 else 1 + m.downhill_weight * (slow_down(F.abs(steep)) - 1)
    factor = F.when(steep >= 0, slow_down(steep)).otherwise(down) * F.when(stair, m.stair_factor).otherwise(1.0)
    return length / m.elder_speed * factor


def wheel_seconds(length: Column, s: Column, stair: Column, m: Model = DEFAULT, stairs_passable: bool = False) -> Column:
    """A manual wheelchair's time; null where stairs can't be passed."""
    base = length / (m.wheel_speed * F.greatest(F.lit(0.4), 1 - 5 * F.greatest(s, F.lit(0.0))))
    t = base * F.when(F.abs(s) > m.wheel_limit, m.wheel_steep_penalty).otherwise(1.0)
    return t if stairs_passable else F.when(~stair, t)


def flat_seconds(length: Column, m: Model = DEFAULT) -> Column:
    return length / m.elder_speed


def wheel_flat_seconds(length: Column, m: Model = DEFAULT) -> Column:
    return length / m.wheel_speed


def directed(links: DataFrame) -> DataFrame:
    """src, dst, length, s, is_stair of both directions of links (u, v, length, s, is_stair)."""
    ahead = links.select(F.col("u").alias("src"), F.col("v").alias("dst"), "length", "s", "is_stair")
    return ahead.unionAll(links.select(F.col("v").alias("src"), F.col("u").alias("dst"), "length", (-F.col("s")).alias("s"), "is_stair"))


def weights(links: DataFrame, m: Model = DEFAULT, names: tuple[str, ...] = ("elder", "flat", "wheel", "wheel_flat"), stairs_passable: bool = False) -> DataFrame:
    """graph, src, dst, w: one directed graph for each named weight; impassable edges are left out."""
    length, s, stair = F.col("length"), F.col("s"), F.col("is_stair")
    known = {"elder": elder_seconds(length, s, stair, m), "flat": flat_seconds(length, m), "wheel": wheel_seconds(length, s, stair, m, stairs_passable), "wheel_flat": wheel_flat_seconds(length, m), "length": length}
    each = F.array(*[F.struct(F.lit(n).alias("graph"), known[n].alias("w")) for n in names])
    return directed(links).select("src", "dst", F.explode(each).alias("e")).filter("e.w IS NOT NULL").select("e.graph", "src", "dst", "e.w")


def cheapest_edges(edges: DataFrame) -> DataFrame:
    """Parallel edges reduced to the cheapest; no weight under a microsecond."""
    return edges.groupBy("graph", "src", "dst").agg(F.min(F.greatest("w", F.lit(1e-6))).alias("w"))
