"""A made-up quarter of 2 km x 2 km with one hill, by fixed rules: the layers of a full run, without files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

X0, Y0, SIDE = 200_000.0, 545_000.0, 2000
RINGS = "array<array<struct<x:double,y:double>>>"


def _height(x, y, height: float = 70.0):
    return 30 + height * F.exp(-(F.pow(x - X0 - 1300, 2) + F.pow(y - Y0 - 1200, 2)) / (2 * 400.0**2))


def dem(spark: SparkSession, size: int = 5, height: float = 70.0, ids: DataFrame | None = None) -> DataFrame:
    """row, col, z of pixels from the top left corner; their numbers may come from a table (id)."""
    n = SIDE // size
    row, col = F.floor(F.col("id") / n).cast("int"), (F.col("id") % n).cast("int")
    at = (spark.range(n * n) if ids is None else ids).select(row.alias("row"), col.alias("col"))
    return at.withColumn("z", _height(X0 + (F.col("col") + 0.5) * size, Y0 + SIDE - (F.col("row") + 0.5) * size, height))


def _lines(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in pts]) for k, pts in enumerate(rows)], "line_id long, points array<struct<x:double,y:double>>")


def lines(spark: SparkSession) -> DataFrame:
    """Roads every 100 m in y and 200 m in x, cut at the sheet border, and sidewalks 3 m beside every fifth road."""
    rows = []
    for sheet in (0, 1000):
        rows += [[(X0 + sheet, Y0 + y), (X0 + sheet + 1000, Y0 + y)] for y in range(0, SIDE + 1, 100)]
        rows += [[(X0 + sheet + x, Y0), (X0 + sheet + x, Y0 + SIDE)] for x in range(0, 1000 if sheet == 0 else 1001, 200)]
        rows += [[(X0 + sheet, Y0 + y + 3), (X0 + sheet + 1000, Y0 + y + 3)] for y in range(0, SIDE, 500)]
    return _lines(spark, rows)


def boxes(spark: SparkSession, rows: list, extra: str) -> DataFrame:
    """ordinal, extra columns, rings and envelope of boxes (x0, y0, x1, y1, *extra)."""
    full = [(k, *r[4:], [[{"x": a, "y": b} for a, b in ((r[0], r[1]), (r[2], r[1]), (r[2], r[3]), (r[0], r[3]), (r[0], r[1]))]], *map(float, r[:4])) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, f"ordinal int, {extra}rings {RINGS}, x0 double, y0 double, x1 double, y1 double")


def stairs(spark: SparkSession) -> DataFrame:
    """Narrow stairs between two roads, and some that a road crosses."""
    rows = [(X0 + s + x - 2, Y0 + 1005, X0 + s + x + 2, Y0 + 1095, "PGS001") for s in (0, 1000) for x in range(100, 1000, 200)]
    rows += [(X0 + s + 197, Y0 + 410, X0 + s + 203, Y0 + 490, None) for s in (0, 1000)]
    return boxes(spark, [tuple(map(lambda v: float(v) if isinstance(v, (int, float)) else v, r)) for r in rows], "kind string, ")


def level(spark: SparkSession) -> DataFrame:
    return boxes(spark, [(X0 + 50.0, Y0 + 1990.0, X0 + 350.0, Y0 + 2010.0)], "")


def buildings(spark: SparkSession, n: int = 500, ids: DataFrame | None = None) -> DataFrame:
    """id, x, y, use_code, kind, floor_text, area of 12 m boxes spread by a fixed rule; their numbers may come from a table (id)."""
    use = F.element_at(F.array(*[F.lit(u) for u in ["BDU001"] * 10 + ["BDU002"] * 6 + ["BDU003"] * 2 + ["BDU009"] + ["BDU011"]]), (F.col("id") * 7 % 20 + 1).cast("int"))
    x, y = X0 + 30 + (F.col("id") * 911) % 1939, Y0 + 30 + (F.col("id") * 577) % 1933
    return (spark.range(n) if ids is None else ids).select("id", x.cast("double").alias("x"), y.cast("double").alias("y"), use.alias("use_code"), F.lit("").alias("kind"), (F.col("id") % 5 + 1).cast("string").alias("floor_text"), F.lit(144.0).alias("area"))


def stops(spark: SparkSession) -> DataFrame:
    """id, x, y, target of bus stops and the station."""
    rows = [(k, X0 + s + x, Y0 + 50.0, "bus") for k, (s, x) in enumerate((s, x) for s in (0, 1000) for x in range(100, 1000, 400))]
    return spark.createDataFrame([*rows, (99, X0 + 1500.0, Y0 + 300.0, "station")], "id long, x double, y double, target string")


def parcels(spark: SparkSession) -> DataFrame:
    """50 m parcels of two legal districts; some are roads."""
    rows = [(X0 + 50.0 * i, Y0 + 50.0 * j, X0 + 50.0 * (i + 1), Y0 + 50.0 * (j + 1), f"P{i:02}{j:02}", "11A" if i < 20 else "11B", "도" if (i + j) % 7 == 0 else "대", "GU", "East" if i >= 20 else "West") for i in range(40) for j in range(40)]
    return boxes(spark, rows, "pnu string, emd_cd string, jimok string, sgg_nm string, emd_nm string, ")
