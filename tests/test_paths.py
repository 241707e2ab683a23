"""The search over graphs of many blocks, its overlay, repairs by new edges, and ways across blocks."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewalk.operators import paths


def dijkstra(edges, sources):
    out, dist, queue = {}, {}, [(0.0, s) for s in sources]
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    while queue:
        d, v = heapq.heappop(queue)
        if v not in dist:
            dist[v] = d
            for b, w in out.get(v, []):
                heapq.heappush(queue, (d + w, b))
    return dist


def streets(side, seed, hashed=False):
    """A grid of both-way streets with uneven costs, some missing: edges and places by id."""
    rnd = random.Random(seed)
    name = (lambda k: (k * 2_654_435_761) % (1 << 40)) if hashed else (lambda k: k)
    edges = []
    for k in range(side * side):
        for n in ([k + 1] if k % side < side - 1 else []) + ([k + side] if k < side * (side - 1) else []):
            if rnd.random() < 0.93:
                edges += [(name(k), name(n), rnd.choice([0.0, 1.0, rnd.uniform(1, 40)])), (name(n), name(k), rnd.uniform(1, 40))]
    return edges, [(name(k), float(k // side), float(k % side)) for k in range(side * side)]


def frame(spark, graphs):
    return spark.createDataFrame([(g, *e) for g, es in graphs.items() for e in es], "graph string, src long, dst long, w double")


@pytest.mark.parametrize("hashed", [False, True])
def test_overlay_gives_the_distances_of_one_task(spark, hashed, monkeypatch):
    es, at = streets(30, 3, hashed)
    small = [(1, 2, 5.0), (2, 3, 1.0)]
    far = at[700][0]
    sources = spark.createDataFrame([("r1", "g", False, at[0][0]), ("r2", "g", True, at[450][0]), ("r2", "g", True, far), ("r3", "s", False, 1), ("r4", "g", False, 10**15)], "run string, graph string, reverse boolean, node long")
    wanted = {("r1", k): v for k, v in dijkstra(es, [at[0][0]]).items()} | {("r2", k): v for k, v in dijkstra([(b, a, w) for a, b, w in es], [at[450][0], far]).items()} | {("r3", 1): 0.0, ("r3", 2): 5.0, ("r3", 3): 6.0}
    places = spark.createDataFrame(at, "node_id long, x double, y double")
    used = []
    monkeypatch.setattr(paths, "_over", lambda *a, own=paths._over: used.append(1) or own(*a))
    monkeypatch.setattr(paths, "_by_rounds", lambda *a: pytest.fail("rounds on a map"))
    got = paths.search(frame(spark, {"g": es, "s": small}), sources, 2, 3_000, places=places, cell_edges=900).collect()
    assert used and {(r["run"], r["node"]): r["d"] for r in got} == pytest.approx(wanted) and len(got) == len(wanted)


def test_a_long_strip_of_small_cells_takes_levels_not_rounds(spark, monkeypatch):
    rnd, wide, long = random.Random(6), 9, 300
    es = [(a, b, rnd.uniform(1, 40)) for k in range(wide * long) for n in ([k + 1] if k % wide < wide - 1 else []) + ([k + wide] if k < wide * (long - 1) else []) for a, b in ((k, n), (n, k))]
    sources = spark.createDataFrame([("r", "g", False, 4)], "run string, graph string, reverse boolean, node long")
    monkeypatch.setattr(paths, "_by_rounds", lambda *a: pytest.fail("a round for each cell of the strip"))
    got = paths.search(frame(spark, {"g": es}), sources, 1, 500).collect()
    assert {r["node"]: r["d"] for r in got} == pytest.approx(dijkstra(es, [4])) and len(got) == wide * long


def test_overlay_of_an_overlay(spark):
    es, at = streets(40, 8)
    sources = spark.createDataFrame([("r", "g", False, 5)], "run string, graph string, reverse boolean, node long")
    places = spark.createDataFrame(at, "node_id long, x double, y double")
    got = paths.search(frame(spark, {"g": es}), sources, 1, 900, places=places, cell_edges=500).collect()
    assert {r["node"]: r["d"] for r in got} == pytest.approx(dijkstra(es, [5]))


@pytest.mark.parametrize(("roomy", "patience", "most", "cells"), [(16, 64, 3_000, 900), (3, 64, 3_000, 900), (3, 1, 3_000, 900), (16, 64, 900, 500), (16, 64, 10**6, 900)])
def test_only_asked_nodes_are_found(spark, monkeypatch, roomy, patience, most, cells):
    """By overlays, by borders, by both, by rounds, and in one task; some asked nodes are no nodes."""
    es, at = streets(30, 5)
    monkeypatch.setattr(paths, "ROOMY", roomy)
    monkeypatch.setattr(paths, "PATIENCE", patience)
    sources = spark.createDataFrame([("r1", "g", False, at[0][0]), ("r2", "g", True, at[450][0])], "run string, graph string, reverse boolean, node long")
    asked = [at[0][0], at[31][0], at[899][0], 10**15]
    places = spark.createDataFrame(at, "node_id long, x double, y double")
    visited = []
    monkeypatch.setattr(paths, "_asked", lambda *a, own=paths._asked: visited.append((own(*a), a[0])) or visited[-1][0])
    got = paths.search(frame(spark, {"g": es}), sources, 2, most, places=places, cell_edges=cells, at=spark.createDataFrame([(k,) for k in asked], "node long")).collect()
    one, other = dijkstra(es, [at[0][0]]), dijkstra([(b, a, w) for a, b, w in es], [at[450][0]])
    wanted = {("r1", k): one[k] for k in asked if k in one} | {("r2", k): other[k] for k in asked if k in other}
    assert {(r["run"], r["node"]): r["d"] for r in got} == pytest.approx(wanted) and len(got) == len(wanted)
    assert bool(visited) == (most == 3_000) and all(blocks.count() < cells.select("block").distinct().count() for blocks, cells in visited[:1])


@pytest.mark.parametrize("patience", [64, 1])
def test_large_blocks_hand_on_what_is_at_their_borders(spark, patience, monkeypatch):
    """No small cells where a block holds many of them; they go on where these rounds do not end."""
    es, at = streets(30, 4)
    es += [(5_000, 5_001, 2.0), (5_001, 7, 1.0), (9, 5_002, 3.0)]
    monkeypatch.setattr(paths, "ROOMY", 3)
    monkeypatch.setattr(paths, "PATIENCE", patience)
    used = []
    monkeypatch.setattr(paths, "_over", lambda *a, own=paths._over: used.append(1) or own(*a))
    monkeypatch.setattr(paths, "_by_rounds", lambda *a: pytest.fail("all nodes are kept between rounds"))
    starts = {"r1": (False, [at[0][0]]), "r2": (True, [at[450][0], at[899][0]]), "r3": (False, [5_000]), "r4": (True, [5_002])}
    sources = spark.createDataFrame([(r, "g", back, n) for r, (back, nodes) in starts.items() for n in nodes] + [("r5", "g", False, 10**15)], "run string, graph string, reverse boolean, node long")
    places = spark.createDataFrame([*at, (5_000, -1.0, 0.0), (5_001, -1.0, 1.0), (5_002, 35.0, 35.0)], "node_id long, x double, y double")
    got = paths.search(frame(spark, {"g": es}), sources, 1, 3_000, places=places, cell_edges=900).collect()
    wanted = {(r, k): v for r, (back, nodes) in starts.items() for k, v in dijkstra([(b, a, w) for a, b, w in es] if back else es, nodes).items()}
    assert {(r["run"], r["node"]): r["d"] for r in got} == pytest.approx(wanted) and len(got) == len(wanted)
    assert bool(used) == (patience == 1)


def test_blocks_hold_no_more_edges_than_they_may(spark):
    """Whether ids are far apart, hashed, or of two kinds."""
    rnd = random.Random(2)
    near = [(rnd.randrange(2_000), rnd.randrange(2_000), 1.0) for _ in range(6_000)]
    for name in (lambda k: k, lambda k: (k * 2_654_435_761) % (1 << 40), lambda k: k if k % 2 else 10**12 + k, lambda k: 10**15 if k == 7 else k):
        es = [(name(a), name(b), w) for a, b, w in near]
        edges = frame(spark, {"g": es})
        marked = paths.with_blocks(edges, paths.numbered(edges, 1_000))
        degree = max(np.unique([x for e in es for x in e[:2]], return_counts=True)[1])
        for block in ("sb", "db"):
            assert marked.groupBy(block).count().agg(F.max("count")).first()[0] <= 1_000 + degree
        sources = spark.createDataFrame([("r", "g", False, name(0))], "run string, graph string, reverse boolean, node long")
        assert {r["node"]: r["d"] for r in paths.search(edges, sources, 1, 4_000).collect()} == pytest.approx(dijkstra(es, [name(0)]))


def test_thinned_pairs_still_give_all_distances():
    rnd = np.random.default_rng(1)
    d = rnd.uniform(1, 9, (30, 30)) * (rnd.random((30, 30)) < 0.4)
    d[d == 0] = np.inf
    d[3, 4] = d[4, 3] = d[4, 5] = 0.0  # costs of nothing are no legs
    np.fill_diagonal(d, 0)

    def closed(m):
        m = m.copy()
        for k in range(len(m)):
            m = np.minimum(m, m[:, k : k + 1] + m[k : k + 1])
        return m

    whole = closed(d)
    keep = paths._thinned(whole)
    kept = np.where(keep | np.eye(len(d), dtype=bool), whole, np.inf)
    assert keep.sum() < np.isfinite(whole).sum() / 2 and np.allclose(closed(kept), whole)


@pytest.mark.parametrize("block_edges", [10**6, 1_200])
def test_lowered_agrees_with_a_new_search(spark, block_edges):
    """Several facilities at once, each in both directions, and one of two edges that need each other."""
    es, at = streets(24, 5)
    n = len(at)
    extra = {"f1": [(3, n - 5, 2.0)], "f2": [(40, 41, 900.0)], "both": [(10, n // 2, 1.0), (n // 2 + 1, n - 1, 1.0)], "new": [(0, 10**9, 4.0)]}
    edges, runs = frame(spark, {"g": es}), {"go": (True, [n - 1, 77]), "back": (False, [n - 1, 77])}
    turned = lambda e, back: [(b, a, w) for a, b, w in e] if back else e
    base = spark.createDataFrame([(of, "g", back, k, v) for of, (back, s) in runs.items() for k, v in dijkstra(turned(es, back), s).items()], "of string, graph string, reverse boolean, node long, d double")
    rows = [(f"{f}|{of}", of, "g", back, *e) for f, ws in extra.items() for of, (back, _) in runs.items() for a, b, w in ws for e in ((a, b, w), (b, a, w))]
    new = spark.createDataFrame(rows, "run string, of string, graph string, reverse boolean, src long, dst long, w double")
    places = spark.createDataFrame(at, "node_id long, x double, y double")
    got = {(r["run"], r["node"]): r["d"] for r in paths.lowered(edges, base, new, block_edges, places=places).collect()}
    wanted = {}
    for f, ws in extra.items():
        for of, (back, s) in runs.items():
            before = dijkstra(turned(es, back), s)
            after = dijkstra(turned(es + [x for a, b, w in ws for x in ((a, b, w), (b, a, w))], back), s)
            wanted |= {(f"{f}|{of}", k): v for k, v in after.items() if v < before.get(k, float("inf"))}
    assert {k: v for k, v in got.items() if k[1] != 10**9} == pytest.approx({k: v for k, v in wanted.items() if k[1] != 10**9})
    assert any(k[0].startswith("both") for k in got) and not any(k[0].startswith("f2") for k in got)


def test_ways_across_blocks(spark):
    es, at = streets(24, 6)
    es += [(1_000_001, 1_000_002, 1.0)]
    n = len(at)
    pairs = spark.createDataFrame([("p1", "g", 0, n - 1), ("p2", "g", n - 2, 13), ("here", "g", 9, 9), ("none", "g", 3, 1_000_001), ("no", "g", 10**9, 4)], "run string, graph string, o long, d long")
    places = spark.createDataFrame(at, "node_id long, x double, y double")
    edges = frame(spark, {"g": es})
    whole = {r["run"]: r for r in paths.single_paths(edges, pairs).collect()}
    cheapest = {}
    for a, b, w in es:
        cheapest[a, b] = min(w, cheapest.get((a, b), 1e9))
    for got in (whole, {r["run"]: r for r in paths.single_paths(edges, pairs, 1, 700, places).collect()}):
        assert set(got) == {"p1", "p2", "here", "none", "no"} and got["here"]["nodes"] == [9] and got["none"]["nodes"] is got["no"]["cost"] is None
        for run, o, d in (("p1", 0, n - 1), ("p2", n - 2, 13)):
            way = got[run]["nodes"]
            assert way[0] == o and way[-1] == d and sum(cheapest[p] for p in zip(way, way[1:])) == pytest.approx(got[run]["cost"]) == pytest.approx(dijkstra(es, [o])[d])


@pytest.mark.parametrize("task_edges", [10**6, 2_000])
def test_ways_search_only_cells_they_pass(spark, task_edges, monkeypatch):
    """No whole search for a pair: one overlay, or overlays of overlays."""
    es, at = streets(36, 9)
    monkeypatch.setattr(paths, "BLOCK_EDGES", task_edges)
    monkeypatch.setattr(paths, "_search", lambda *a, **k: pytest.fail("a whole search"))
    monkeypatch.setattr(paths, "_from_both_ends", lambda *a: pytest.fail("a whole search"))
    monkeypatch.setattr(paths, "OVERLAY_SHARE", 1)
    ends = {"far": (0, 36 * 36 - 1), "near": (40, 41), "back": (1_200, 30)}
    pairs = spark.createDataFrame([(r, "g", *p) for r, p in ends.items()], "run string, graph string, o long, d long")
    got = {r["run"]: r for r in paths.single_paths(frame(spark, {"g": es}), pairs, 2, 1_500, spark.createDataFrame(at, "node_id long, x double, y double")).collect()}
    cheapest = {}
    for a, b, w in es:
        cheapest[a, b] = min(w, cheapest.get((a, b), 1e9))
    for run, (o, d) in ends.items():
        way = got[run]["nodes"]
        assert way[0] == o and way[-1] == d and sum(cheapest[p] for p in zip(way, way[1:])) == pytest.approx(got[run]["cost"]) == pytest.approx(dijkstra(es, [o])[d])
