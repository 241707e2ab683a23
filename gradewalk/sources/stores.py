"""Networks and building tables as stored between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.functions.geo import in_rings


def write_network(nodes: DataFrame, links: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    links.write.mode("overwrite").parquet(f"{folder}/links")


def read_network(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/links")


def read_buildings(spark: SparkSession, folder: str, target: str | None = None) -> DataFrame:
    """The long building table away from the data's edge; one target of it, whose filter reaches the scan."""
    rows = spark.read.parquet(folder).filter(~F.col("edge"))
    return rows if target is None else rows.filter(F.col("target") == target)


def targets(wide: DataFrame) -> list[str]:
    """Targets of a wide building table, by the columns that hold an index."""
    return sorted(c.removesuffix("_hbi") for c in wide.columns if c.endswith("_hbi"))


def long_table(wide: DataFrame, values: list[str]) -> DataFrame:
    """A wide building table, as text files hold it, in the long form; blanks are missing."""
    known, keys = targets(wide), [c for c in wide.columns if not any(c.startswith(f"{t}_") for t in targets(wide))]
    each = F.array(*[F.struct(F.lit(t).alias("target"), *[(F.col(f"{t}_{v}").try_cast("double") if f"{t}_{v}" in wide.columns else F.lit(None).cast("double")).alias(v) for v in values]) for t in known])
    return wide.select(*keys, F.explode(each).alias("_r")).select(*keys, "_r.*")


def prefer(names: list[str], mark: str = "60") -> str | None:
    """The input whose name has the mark, else the first in order."""
    return min(names, key=lambda n: (mark not in n, n), default=None)


def in_boroughs(rows: DataFrame, code: str, boroughs: list[str]) -> DataFrame:
    """Rows whose code begins with one of the boroughs' five digits."""
    return rows.filter(F.substring(code, 1, 5).isin(boroughs))


def zone_at(zones: DataFrame, x: float, y: float) -> DataFrame:
    """Zones (rings and envelope) that a point, such as a study's centre, lies in."""
    inside = F.lit(x).between(F.col("x0"), F.col("x1")) & F.lit(y).between(F.col("y0"), F.col("y1"))
    return zones.filter(inside & in_rings(F.lit(x), F.lit(y), F.col("rings")))
