"""An incremental form of the points join, as an extension: points stream in, cells and their homes stay.

Structured Streaming keeps one counter for each cell and day; late points count until the watermark has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewalk.config import DEFAULT, Model
from gradewalk.functions.geo import cell, cell_centre


def cell_counts(points: DataFrame, cells: DataFrame, delay: str = "1 hour", m: Model = DEFAULT) -> DataFrame:
    """day, cell_x, cell_y, n_points and value of streamed points (ts, x, y, value) in known cells (cell_x, cell_y, n_bld)."""
    size = m.grid_m
    known = cells.select(cell(F.col("cell_x"), size).alias("gx"), cell(F.col("cell_y"), size).alias("gy"), "n_bld")
    placed = points.withWatermark("ts", delay).withColumn("gx", cell(F.col("x"), size)).withColumn("gy", cell(F.col("y"), size)).join(known, ["gx", "gy"])
    counted = placed.groupBy(F.window("ts", "1 day").alias("w"), "gx", "gy", "n_bld").agg(F.count("*").alias("n_points"), F.sum("value").alias("value"))
    return counted.select(F.col("w.start").alias("day"), cell_centre(F.col("gx"), size).alias("cell_x"), cell_centre(F.col("gy"), size).alias("cell_y"), "n_points", "value", (F.col("n_points") / F.col("n_bld") * 100).alias("per100_bld"))
