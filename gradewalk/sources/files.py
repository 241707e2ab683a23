"""Finding files and reading text tables of unknown encoding and delimiter."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewalk.functions.geo import project
from gradewalk.functions.text import number

ENCODINGS = ("utf-8-sig", "cp949", "euc-kr")
DELIMITERS = (",", "|", "\t")
SAMPLE = 1 << 16


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything lies at a path or glob, in whatever store Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def contents(spark: SparkSession, root: str) -> DataFrame:
    """path, modificationTime, length and content of all files under root; none if there is no root."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)


def find(spark: SparkSession, root: str, keys: list[str], ext: str) -> DataFrame:
    """path and length of files under root with this ending, in any case, and any of the keys in their name; none if there is no root."""
    every = contents(spark, root).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    hit = F.lit(False)
    for k in keys:
        hit = hit | name.contains(k)
    return every.filter(F.lower(name).endswith(ext.lower()) & hit).distinct().orderBy("path")


def sniff(head: bytes, encodings: tuple[str, ...] = ENCODINGS) -> tuple[str, str]:
    """(encoding, delimiter) from a file's first bytes: the first encoding that fits, the commonest delimiter of line one."""
    for encoding in encodings:
        for cut in range(4):  # the sample may end inside a character
            try:
                line = head[: len(head) - cut].decode(encoding).split("\n", 1)[0]
                return encoding, max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))
            except UnicodeDecodeError:
                continue
    raise ValueError("unknown encoding")


def head(spark: SparkSession, path: str, n: int = SAMPLE) -> bytes:
    """A file's first bytes, read by Spark."""
    row = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, n).alias("c")).first()
    return bytes(row["c"]) if row else b""


def fitting(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The encodings in which every line of a file decodes; no character of any of them holds a line feed's byte."""

    def run(batches):
        bad = set()
        for b in batches:
            for v in b.column(0).to_pylist():
                for encoding in ENCODINGS:
                    if encoding not in bad:
                        try:
                            v.decode(encoding)
                        except UnicodeDecodeError:
                            bad.add(encoding)
        yield pa.RecordBatch.from_pydict({"bad": pa.array(sorted(bad), pa.string())})

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"))
    bad = {r["bad"] for r in lines.mapInArrow(run, "bad string").distinct().collect()}
    return tuple(e for e in ENCODINGS if e not in bad)


def records(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """line (from 0, blank ones not counted) and cells (trimmed, null if empty) of a text table in any of ENCODINGS.

    A file is decoded by one task, as quoted cells may hold line ends: meant for published tables, up to Spark's 2 GB a
    cell. Bytes that don't decode raise an error."""
    encoding, found = sniff(head(spark, path), fitting(spark, path))
    sep = delimiter or found

    def run(batches):
        for b in batches:
            for content in b.column(0):
                text = io.TextIOWrapper(io.BytesIO(content.as_py()), encoding, newline="")
                held = []
                for k, row in enumerate(r for r in csv.reader(text, delimiter=sep) if r):
                    held.append((k, [c.strip() or None for c in row]))
                    if len(held) == 10_000:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "line long, cells array<string>")


def _batch(rows: list[tuple[int, list[str | None]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.list_(pa.string()))], names=["line", "cells"])


def read_any(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A text table, all columns as text, with its encoding found from all of it and its delimiter from its head.

    UTF-8 tables are read by Spark itself, others through `records`. No file: no rows and no columns."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([]))
    encoding, found = sniff(head(spark, path), fitting(spark, path))
    if encoding != "utf-8-sig":
        rows = records(spark, path, delimiter)
        names = rows.filter("line = 0").first()["cells"]
        return rows.filter("line > 0").select(*[F.get("cells", F.lit(k)).alias(c or f"_c{k}") for k, c in enumerate(names)])
    rows = spark.read.option("header", "true").option("inferSchema", "false").option("sep", delimiter or found).option("multiLine", "true").csv(path)
    return rows.toDF(*[c.lstrip("\ufeff").strip() for c in rows.columns])


def read_points(spark: SparkSession, path: str, lon: str = "lon", lat: str = "lat", code: int = 4326) -> DataFrame:
    """A table's rows with coordinates, and x, y in the working projection. No file: no rows."""
    rows = read_any(spark, path)
    if not rows.columns:
        return spark.createDataFrame([], f"`{lon}` string, `{lat}` string, x double, y double")
    x, y = project(number(F.col(lon)), number(F.col(lat)), code)
    return rows.withColumn("x", x).withColumn("y", y).filter("x IS NOT NULL AND y IS NOT NULL")


def profile(df: DataFrame, columns: list[str], most: int = 8) -> DataFrame:
    """column, value, n: the commonest values of each column (ties by value)."""
    from pyspark.sql import Window

    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("e")).select("e.*")
    counts = each.groupBy("column", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return counts.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


def layer_codes(paths: DataFrame) -> DataFrame:
    """code and n of map layer codes in file names."""
    code = F.regexp_extract("path", r"N3[APLT]_[A-Z]\d{7}", 0)
    return paths.select(code.alias("code")).filter("code <> ''").groupBy("code").agg(F.count("*").alias("n"))
