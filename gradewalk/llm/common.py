"""What the operators of this folder share: let-bindings, row structs, and tables cut from lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.operators.tables import save, shared_dir

#: ASCII white space of the contracts, as the inside of a regular expression's class.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row; a plain reference inside a lambda would be computed at each call."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that helper columns can't clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["SPACE_CHARS", "SPACE_CLASS", "let", "save", "shared_dir", "table", "text_or_empty", "whole_row"]
