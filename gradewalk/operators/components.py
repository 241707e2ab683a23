"""Connected components of a graph given as a table of edges.

Graphs up to TASK_EDGES go through one task (a street network of a city has fewer). Larger ones are contracted: every
vertex takes its smallest neighbour (or itself) as parent; two jumps over parents follow; edges are rewritten to parents,
made distinct, and loops fall out. All of that is joins and pre-aggregated group-bys over saved tables; nothing about the
graph reaches the driver but whether edges are left."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewalk.operators.tables import save

#: Edges that one task takes; 16 bytes each, and about as much again three times while it works.
TASK_EDGES = 5_000_000


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n numbers the least number of its component, over edges a - b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _in_one_task(batches):
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    a = np.concatenate([np.zeros(0, np.int64), *[p[0] for p in parts]])
    b = np.concatenate([np.zeros(0, np.int64), *[p[1] for p in parts]])
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = least_labels(place[: len(a)], place[len(a) :], len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["v", "component"])


def _jump(parents: DataFrame, over: DataFrame) -> DataFrame:
    up = over.select(F.col("v").alias("p"), F.col("p").alias("up"))
    return parents.join(up, "p", "left").select("v", F.coalesce("up", "p").alias("p"))


def components(edges: DataFrame) -> DataFrame:
    """v and component for every vertex of edges (a, b) that are no loops; a component's id is one of its vertices."""
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


def labelled(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """components of long ids, each with its least vertex as its id; isolated loops count as their own."""
    edges = save(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "graph")
    if edges.count() <= task_edges:
        return edges.repartition(1).mapInArrow(_in_one_task, "v long, component long")
    hashed = edges.select(F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v")).alias("a"), F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v")).alias("b"))
    found = components(hashed)  # hashes first: chains of neighbouring ids contract as fast as any
    least = found.groupBy("component").agg(F.min("v.v").alias("least"))
    named = found.join(least, "component").select("v.v", F.col("least").alias("component"))
    loops = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(named, "v", "left_anti")
    return named.unionAll(loops.select("v", F.col("v").alias("component")))
