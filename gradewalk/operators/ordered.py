"""Positions and running sums in one global order, without a window that holds the whole table.

Rows are dealt by range of the order's keys; each part sums itself, and the sums of the parts before it (one row a part,
as many as there are shuffle partitions) are added. Equal keys are always in one part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewalk.operators.tables import save


def filled(df: DataFrame, c: str, order: str) -> DataFrame:
    """df with nulls of c replaced by the last value above in the order of a column that tells rows apart.

    Each part, dealt by range, fills itself; rows above its first value take the last value of the parts before it."""
    dealt = save(save(df, "to-order").repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ordered")
    last = dealt.groupBy("_part").agg(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias("_last"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part only
    bases = last.select("_part", F.last("_last", ignorenulls=True).over(earlier).alias("_base"))
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(bases), "_part").withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(within), F.col("_base"))).select(*df.columns)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], upto: bool = False, stored: bool = False) -> DataFrame:
    """df with a column for each name in sums: its sum over the rows before (with upto: and including) each row.

    order must tell all rows apart, or the places of equal rows are arbitrary. Sums of no rows are 0. Dealing by range reads
    df twice, so it is saved first, unless it is stored already or a small sum over what is."""
    df = df if stored else save(df, "to-order")
    dealt = save(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_t{k}") for k, c in enumerate(sums.values())])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part only
    bases = totals.select("_part", *[F.coalesce(F.sum(f"_t{k}").over(earlier), F.lit(0)).alias(f"_b{k}") for k in range(len(sums))])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if upto else -1)
    placed = dealt.join(F.broadcast(bases), "_part")
    found = [(F.col(f"_b{k}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(name) for k, (name, c) in enumerate(sums.items())]
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], *found)
