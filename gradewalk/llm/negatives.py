"""Hard-negative mining with vantage-point trees over norm-augmented vectors.

A row x gets one more component, sqrt(M - |x|^2), where M is the largest squared norm of all rows; an anchor q gets 0
there. The squared distance of q and x is then |q|^2 + M - 2 q.x, so the highest scores are the nearest rows, and the
scores between two bounds are the rows in an annulus around q.

1. Rows of equal vector and label are one point that keeps its smallest ids, as many as a list may ask for: rows beyond
   those can't be among the first of any list, so hot vectors cost no more than others.
2. A tree of at most TOP_LEAVES leaves, over a bounded sample of points, deals all points to leaves; a leaf of more than
   PART_POINTS points is cut into shards by digest. Each shard's task builds a tree of its own over its points.
3. Anchors look for their positives, then for the negatives of each positive's annulus. First each asks its nearest leaf;
   the score of the last row it found there tells which other leaves can hold better rows, and only those are asked.
   Within a shard, leaves are visited nearest first until none can improve an anchor's lists. Anchors of one vector and
   label ask once.

Bounds by distance get a slack above rounding errors; scores are exact, because sums of products stay below 2^53. All
rows are indexed and the search is exact. Nothing but the sample, the number of points of each top leaf and two numbers
reaches the driver.

Defined results: rows with a null id, label, vector or component, or a component that is not finite, take no part; vectors
of different lengths are filled up with zeros, so an empty vector scores 0; repeated rows are one row; rows that share
nothing but an id are rows of their own and never each other's positives; ties go to the smaller id; other columns, of
any name, are not looked at; an empty table, or one without anchors, gives no rows. Raises OverflowError where scores may
reach 2^53 (components of about 10^7 at 64 dimensions)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewalk.llm.common import save, table

POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Points that one task's tree holds, points of a leaf of it, and requests that a task takes at once.
PART_POINTS, LEAF_POINTS, REQUESTS = 4096, 256, 16_384  # of a leaf: a power of two, up to 512
#: Points that the top tree is made from, and its leaves at most.
SAMPLE, TOP_LEAVES = 16_384, 1024
EXACT = float(1 << 53)
_SALTS = 32


@dataclass
class Tree:
    """Vantage points and, for each leaf, the path to it: (vantage point, least and largest distance of what lies below)."""

    vantage: np.ndarray  # one row each
    height: np.ndarray  # their augmented components
    paths: list[list[tuple[int, float, float]]]
    members: list[np.ndarray]

    def bounds(self, q: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance that rows of each leaf can have from each of some anchors."""
        low, high = np.zeros((len(q), len(self.paths))), np.full((len(q), len(self.paths)), np.inf)
        if len(self.vantage):
            d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + most - 2 * (q @ self.vantage.T), 0))
            for leaf, path in enumerate(self.paths):
                for v, nearest, farthest in path:
                    low[:, leaf] = np.maximum(low[:, leaf], np.maximum(d[:, v] - farthest, nearest - d[:, v]))
                    high[:, leaf] = np.minimum(high[:, leaf], d[:, v] + farthest)
        slack = 1e-6 * math.sqrt(most)
        return np.maximum(low - slack, 0), high + slack


def heights(x: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(most - (x * x).sum(1), 0))


def from_point(x: np.ndarray, h: np.ndarray, v: np.ndarray, hv: float, most: float) -> np.ndarray:
    """Distances of rows from a vantage point that is itself a row."""
    return np.sqrt(np.maximum(2 * most - 2 * (x @ v + h * hv), 0))


def grow(x: np.ndarray, most: float, leaf: int) -> Tree:
    """A tree whose leaves hold at most so many rows.

    The vantage point of a part is the row farthest from its first one; the nearer half of its rows lies inside. Paths keep
    the distances at which rows were cut, so rows that are not in x can be dealt by them too."""
    h, vantage, height, paths, members = heights(x, most), [], [], [], []

    def part(rows: np.ndarray, path: list[tuple[int, float, float]]) -> None:
        if len(rows) > leaf:
            first = rows[0]
            at = rows[np.argmax(from_point(x[rows], h[rows], x[first], h[first], most))]
            d = from_point(x[rows], h[rows], x[at], h[at], most)
            order, half, v = np.argsort(d, kind="stable"), (len(rows) + 1) // 2, len(vantage)  # by rank: ties don't unbalance it
            cut = float(d[order[half - 1]])
            vantage.append(x[at])
            height.append(h[at])
            part(rows[order[:half]], [*path, (v, 0.0, cut)])
            part(rows[order[half:]], [*path, (v, cut, math.inf)])
            return
        paths.append(path)
        members.append(rows)

    part(np.arange(len(x)), [])
    return Tree(np.array(vantage).reshape(-1, x.shape[1]), np.array(height), paths, members)


def deal(tree: Tree, x: np.ndarray, most: float) -> np.ndarray:
    """The leaf of each row."""
    h, found = heights(x, most), np.zeros(len(x), np.int32)
    d = [from_point(x, h, v, hv, most) for v, hv in zip(tree.vantage, tree.height, strict=True)]
    for leaf, path in enumerate(tree.paths):
        held = np.ones(len(x), bool)
        for v, nearest, farthest in path:
            held &= d[v] <= farthest if farthest < math.inf else d[v] > nearest
        found[held] = leaf
    return found


def _matrix(lists: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _reach(norms: np.ndarray, scores: np.ndarray, most: float) -> np.ndarray:
    """The distance at which rows have these scores."""
    return np.sqrt(np.maximum(norms[:, None] + most - 2 * np.clip(scores, -most, most), 0))


def best_in(x: np.ndarray, labels: np.ndarray, q: np.ndarray, own: np.ndarray, lows: np.ndarray, highs: np.ndarray, same: bool, k: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The k first points of each list: scores (-inf where there are fewer) and point numbers, shaped (requests, lists, k).

    Points are numbered by their least id, so that of equal scores the smaller number comes first. lows and highs bound each
    list's scores; lists of the same request share the distances. Points of the request's label count if same, else others."""
    tree = grow(x, most, LEAF_POINTS)
    near, far = tree.bounds(q, most)
    order = np.argsort(near, axis=1, kind="stable")
    norms = (q * q).sum(1)
    inner = _reach(norms, highs, most)
    score, point = np.full((*lows.shape, k), -np.inf), np.full((*lows.shape, k), len(x), np.int64)
    lows = lows.copy()
    for step in range(len(tree.paths)):
        leaf_of = order[:, step]
        rows = np.arange(len(q))
        low, high = near[rows, leaf_of][:, None], far[rows, leaf_of][:, None]
        wanted = ((low <= _reach(norms, lows, most)) & (high >= inner) & (lows <= highs)).any(axis=1)
        for leaf in np.unique(leaf_of[wanted]):
            asks = np.flatnonzero(wanted & (leaf_of == leaf))
            held = np.sort(tree.members[leaf])
            found = q[asks] @ x[held].T
            fits = (labels[held][None] == own[asks][:, None]) == same
            for w in range(lows.shape[1]):
                ok = fits & (found <= highs[asks, w][:, None]) & (found >= lows[asks, w][:, None])
                some = np.flatnonzero(ok.any(axis=1))
                if not len(some):
                    continue
                # equal scores: the one that stands earlier; a score times a power of two stays exact in 64 bits
                rank = np.where(ok[some], found[some], -EXACT).astype(np.int64) * LEAF_POINTS - np.arange(len(held))
                top = np.argpartition(-rank, min(k, len(held)) - 1, axis=1)[:, :k]
                a = asks[some]
                s = np.concatenate([score[a, w], np.where(np.take_along_axis(ok[some], top, 1), np.take_along_axis(found[some], top, 1), -np.inf)], axis=1)
                p = np.concatenate([point[a, w], held[top]], axis=1)
                p[np.isneginf(s)] = len(x)
                first = np.lexsort((p, -s), axis=1)[:, :k]
                score[a, w], point[a, w] = np.take_along_axis(s, first, 1), np.take_along_axis(p, first, 1)
                lows[a, w] = np.maximum(lows[a, w], score[a, w, k - 1])
    return score, point


def _answers(points: pa.Table, asks: pa.Table, dims: int, same: bool, k: int, most: float) -> pa.Table:
    """key, p, score, id: at most k rows of this shard for each list of each request."""
    out: dict[str, list] = {"key": [], "p": [], "score": [], "id": []}
    if points.num_rows and asks.num_rows:
        ids = points.column("ids").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: ids[i][0])
        ids = [ids[i] for i in order]
        x, labels = _matrix(points.column("v"), dims)[order], points.column("label").to_numpy()[order]
        ps = asks.column("ps").to_pylist()
        wide = max(map(len, ps))
        lists = lambda c, fill: np.array([[*v, *[fill] * (wide - len(v))] for v in asks.column(c).to_pylist()], np.float64)
        score, point = best_in(x, labels, _matrix(asks.column("v"), dims), asks.column("label").to_numpy(), lists("lows", 1.0), lists("highs", 0.0), same, k, most)
        for r, (key, own) in enumerate(zip(asks.column("key").to_pylist(), ps, strict=True)):
            for w, p in enumerate(own):
                found = sorted((-s, i) for s, n in zip(score[r, w].tolist(), point[r, w].tolist(), strict=True) if s > -np.inf for i in ids[n][:k])[:k]
                for s, i in found:
                    for c, value in zip(out, (key, p, int(-s), i), strict=True):
                        out[c].append(value)
    return pa.table({"key": pa.array(out["key"], pa.string()), **{c: pa.array(out[c], pa.int64()) for c in ("p", "score", "id")}})


def quantized(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str | Column = "label", scale: int = 256) -> DataFrame:
    """id, label, v (floor of scale times each component) and key (a digest of vector and label) of the rows that take part."""
    kept = rows.select(F.col(id_column).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    whole = kept.filter(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    cut = whole.select("id", "label", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    return cut.withColumn("key", F.md5(F.concat_ws("|", F.col("v").cast("string"), F.col("label").cast("string"))))


def points_of(rows: DataFrame, keep: int) -> DataFrame:
    """key, label, v and the `keep` smallest ids (ascending) of each point. Hot points are cut by salt before they meet."""
    salted, whole = Window.partitionBy("key", "salt").orderBy("id"), Window.partitionBy("key").orderBy("id")
    each = rows.dropDuplicates(["key", "id"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)))
    few = each.withColumn("at", F.row_number().over(salted)).filter(F.col("at") <= keep).drop("at")
    first = few.withColumn("at", F.row_number().over(whole)).filter(F.col("at") <= keep)
    return first.groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))  # `keep` ids


class Index:
    """Points dealt to the leaves of a top tree and to shards, stored."""

    def __init__(self, points: DataFrame, dims: int, most: float, part: int, sample: int, leaves: int):
        self.dims, self.most = dims, most
        n = points.count()
        some = points.orderBy("key").limit(sample).select("v").toArrow() if n > part else None  # keys are digests
        x = _matrix(some.column(0), dims) if some else np.zeros((0, dims))
        self.tree = tree = grow(x, most, max(1, -(-len(x) // min(leaves, -(-n // part))))) if n else grow(x, most, 1)
        placed = pa.schema([("leaf", pa.int32()), ("key", pa.string()), ("label", pa.int64()), ("v", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))])

        def place(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(deal(tree, _matrix(b.column(2), dims), most)), *b.columns], schema=placed)

        dealt = save(points.select("key", "label", "v", "ids").mapInArrow(place, "leaf int, key string, label long, v array<long>, ids array<long>"), "negatives-points")
        self.shards = [1] * len(tree.paths)
        for leaf, n in dealt.groupBy("leaf").count().collect():  # a row for each top leaf
            self.shards[leaf] = -(-n // part)
        count = F.element_at(F.array(*[F.lit(s) for s in self.shards]), F.col("leaf") + 1)
        self.points = dealt.withColumn("shard", F.pmod(F.xxhash64("key"), count).cast("int"))

    def routed(self, asks: DataFrame, home: bool) -> DataFrame:
        """asks with the leaf and shard of each shard that they have to visit: their nearest leaf, or all others that can matter."""
        tree, most, dims, shards = self.tree, self.most, self.dims, self.shards
        fields = "leaf int, shard int, key string, label long, v array<long>, ps array<long>, lows array<long>, highs array<long>"

        def route(batches):
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    q = _matrix(part.column(2), dims)
                    near, far = tree.bounds(q, most)
                    nearest, norms = near.argmin(axis=1), (q * q).sum(1)
                    if home:
                        row, leaf = np.arange(len(q)), nearest
                    else:
                        # the widest of a request's annuli decides whether it has to visit a leaf
                        widest = np.array([min(v, default=0) for v in part.column(4).to_pylist()], np.float64)
                        hole = np.array([max(v, default=0) for v in part.column(5).to_pylist()], np.float64)
                        visit = (near <= _reach(norms, widest[:, None], most)) & (far >= _reach(norms, hole[:, None], most))
                        visit[np.arange(len(q)), nearest] = False
                        row, leaf = np.nonzero(visit)
                    many = np.array([shards[k] for k in leaf.tolist()], np.int64)
                    row, leaf = np.repeat(row, many), np.repeat(leaf, many)
                    shard = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    taken = part.take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(shard.astype(np.int32)), *taken.columns], names=["leaf", "shard", "key", "label", "v", "ps", "lows", "highs"])

        return asks.select("key", "label", "v", "ps", "lows", "highs").mapInArrow(route, fields)

    def search(self, asks: DataFrame, blocks: int, home: bool, same: bool, k: int) -> DataFrame:
        """key, p, score, id: from each visited shard its k first rows for each list. asks: key, label, v, and arrays ps, lows, highs."""
        most, dims = self.most, self.dims

        def answer(points: pa.Table, requests: pa.Table) -> pa.Table:
            return _answers(points, requests, dims, same, k, most)

        block = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
        held = self.points.select(F.col("leaf").alias("l"), F.col("shard").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "label", "v", "ids")
        dealt = self.routed(asks, home).select("leaf", "shard", block, "key", "label", "v", "ps", "lows", "highs")
        return held.groupBy("l", "s", "b").cogroup(dealt.groupBy("leaf", "shard", "block")).applyInArrow(answer, "key string, p long, score long, id long")

    def nearest(self, asks: DataFrame, blocks: int, same: bool, k: int) -> DataFrame:
        """The k first rows of each list, in two rounds: the nearest leaf, then the others within what it left open."""
        asks = save(asks, "negatives-asks")
        first = save(self.search(asks, blocks, True, same, k), "negatives-home")
        full = _first(first, ["key", "p"], k).groupBy("key", "p").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= k)
        known = full.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("p", "least"))).alias("known"))  # a request's few lists
        better = F.zip_with("ps", "lows", lambda p, low: F.greatest(low, F.coalesce(F.try_element_at("known", p), low)))
        left = asks.join(known, "key", "left").withColumn("lows", better)
        return _first(first.unionByName(self.search(left, blocks, False, same, k)), ["key", "p"], k)


def _first(rows: DataFrame, of: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*of).orderBy(F.desc("score"), "id")
    return rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).drop("at")


def _percent(p: Column, share: int, up: bool) -> Column:
    """share percent of p, rounded up or down to a whole number."""
    x = p * share
    return F.call_function("div", x + F.pmod(-x, F.lit(100)) if up else x - F.pmod(x, F.lit(100)), F.lit(100))


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, part: int = PART_POINTS, sample: int = SAMPLE, leaves: int = TOP_LEAVES, requests: int = REQUESTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: as quantized gives them; anchor: which are anchors.

    The first `negatives` rows of another label whose score is between low and high percent of the positive's, for each of the
    anchor's first `positives` other rows of its label."""
    rows = save(rows, "negatives-rows")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most, dims = rows.agg(F.max(squares), F.max(F.size("v"))).first()
    most, dims = most or 0.0, max(dims or 0, 1)
    if most >= EXACT:
        raise OverflowError(f"scores up to {most:.3g} can't be told apart exactly")
    filled = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v"))))
    points = save(points_of(filled, max(positives + 1, negatives)), "negatives-distinct")
    anchors = save(rows.filter(anchor).select("id", "key").distinct(), "negatives-anchors")
    index = Index(points, dims, most, part, sample, leaves)
    asked = points.join(anchors.select("key").distinct(), "key", "left_semi").select("key", "label", "v")
    blocks = -(-max(anchors.count(), 1) // requests)
    one = lambda x: F.array(F.lit(x).cast("long"))
    wide = int(most) + 1
    liked = save(index.nearest(asked.select("*", one(0).alias("ps"), one(-wide).alias("lows"), one(wide).alias("highs")), blocks, True, positives + 1), "negatives-positives")
    scores = liked.select("key", F.col("score").alias("p")).filter(_percent(F.col("p"), low, True) <= _percent(F.col("p"), high, False)).distinct()
    lists = scores.groupBy("key").agg(F.sort_array(F.collect_list("p")).alias("ps"))  # at most positives + 1
    windows = asked.join(lists, "key").select("*", F.transform("ps", lambda p: _percent(p, low, True)).alias("lows"), F.transform("ps", lambda p: _percent(p, high, False)).alias("highs"))
    disliked = index.nearest(windows, blocks, False, negatives)
    ranked = disliked.groupBy("key", "p").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("found"))
    pairs = liked.select("key", F.col("score").alias("p"), "id").join(ranked, ["key", "p"], "left")
    whole = pairs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("s"), "id", "found"))).alias("liked"))
    others = anchors.join(whole, "key").select(F.col("id").alias("anchor_id"), F.explode(F.slice(F.filter("liked", lambda x: x["id"] != F.col("id")), 1, positives)).alias("pos"))
    each = others.select("anchor_id", "pos", F.posexplode("pos.found").alias("at", "neg"))
    return each.select("anchor_id", F.col("pos.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("neg.id").alias("negative_id"), (-F.col("pos.s")).alias("positive_score"), (-F.col("neg.s")).alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(quantized(rows, label=label), F.col("id") % 50 == 0)


ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b AS p, s AS ps FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.a, p, ps, b, s, row_number() OVER (PARTITION BY p.a, p ORDER BY s DESC, b) AS k FROM p JOIN s ON p.a = s.a AND NOT same AND 50 * ps <= 100 * s AND 100 * s <= 95 * ps)
SELECT a AS anchor_id, p AS positive_id, CAST(k AS INTEGER) AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM n WHERE k <= 3
"""
