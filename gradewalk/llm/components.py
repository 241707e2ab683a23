"""Connected components of a graph given as a table of edges, by contraction.

Every vertex takes its smallest neighbour (or itself) as parent; two jumps over parents follow; edges are rewritten to
parents, made distinct, and loops fall out. With ids that are hashes the graph shrinks geometrically, so a few rounds
do. All of it is joins and pre-aggregated group-bys over saved tables; nothing about the graph reaches the driver but
whether edges are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewalk.llm.common import save


def _jump(parents: DataFrame, over: DataFrame) -> DataFrame:
    up = over.select(F.col("v").alias("p"), F.col("p").alias("up"))
    return parents.join(up, "p", "left").select("v", F.coalesce("up", "p").alias("p"))


def components(edges: DataFrame) -> DataFrame:
    """v and component for every vertex of edges (a, b); a component's id is one of its vertices."""
    left = save(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    found = left.select(F.col("a").alias("v"), F.col("a").alias("p")).filter("false")
    first = True
    while left.take(1):
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = save(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p")), "parents")
        parents = save(_jump(_jump(parents, parents), parents), "parents")
        found, first = (parents, False) if first else (save(_jump(found, parents), "components"), False)
        a, b = parents.select(F.col("v").alias("a"), F.col("p").alias("pa")), parents.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        left = save(left.join(a, "a").join(b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).filter("a <> b").distinct(), "edges")
    return found.select("v", F.col("p").alias("component"))
