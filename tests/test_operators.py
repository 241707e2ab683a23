"""Engine operators against brute force and on small made-up networks."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewalk.config import DEFAULT
from gradewalk.operators import components, hbi, joins, network, paths, raster, report, shapes, spatial, stats, tables, whatif

RING = "array<struct<x:double,y:double>>"


def dijkstra(edges, sources):
    out = {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    dist, heap = {}, [(0.0, s) for s in sources]
    while heap:
        d, u = heapq.heappop(heap)
        if u in dist:
            continue
        dist[u] = d
        for v, w in out.get(u, []):
            heapq.heappush(heap, (d + w, v))
    return dist


def random_edges(seed, n=60, m=200):
    rnd = random.Random(seed)
    return [(rnd.randrange(n), rnd.randrange(n), rnd.uniform(0.5, 9)) for _ in range(m)]


@pytest.mark.parametrize("shards", [1, 3])
def test_multi_source(spark, shards):
    edges = {g: random_edges(k) for k, g in enumerate("ab")}
    frame = spark.createDataFrame([(g, *e) for g, es in edges.items() for e in es], "graph string, src long, dst long, w double")
    runs = {("r1", "a", False): [1, 2], ("r2", "a", True): [3], ("r3", "b", True): [5, 6], ("r4", "b", False): [999]}
    sources = spark.createDataFrame([(r, g, b, n) for (r, g, b), ns in runs.items() for n in ns], "run string, graph string, reverse boolean, node long")
    wanted = {(r, k): v for (r, g, b), ns in runs.items() for k, v in dijkstra([(y, x, w) if b else (x, y, w) for x, y, w in edges[g]], ns).items() if k != 999}
    got = {(r["run"], r["node"]): r["d"] for r in paths.multi_source(frame, sources, shards).collect()}
    assert got == pytest.approx(wanted)
    for most in (10**6, 150, 17):  # in one block, and in several
        assert {(r["run"], r["node"]): r["d"] for r in paths.search(frame, sources.filter("node <> 999"), shards, most).collect()} == pytest.approx(wanted)
    parts = components.labelled(frame.filter("graph = 'a'").select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.col("v").alias("node_id"), F.col("component").alias("comp"))
    split = paths.by_component(frame.filter("graph = 'a'"), sources.filter("graph = 'a'"), parts)
    assert {(r["run"], r["node"]): r["d"] for r in paths.multi_source(*split).collect()} == pytest.approx({k: v for k, v in wanted.items() if k[0] in ("r1", "r2")})


def test_outlines_hold_their_cells(spark):
    rnd = random.Random(5)
    ring_area = lambda r: sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(r, r[1:], strict=False)) / 2
    sets = {"box": [(x, y) for x in range(4) for y in range(3)], "hole": [(x, y) for x in range(5) for y in range(5) if (x, y) != (2, 2)], "touch": [(0, 0), (1, 1), (2, 0)], "noise": [(x, y) for x in range(30) for y in range(30) if rnd.random() < 0.6]}
    rows = [(n, x - 7, y + 3) for n, c in sets.items() for x, y in c]
    got = {r["n"]: r for r in shapes.outlines(spark.createDataFrame(rows, "n string, gx long, gy long"), ["n"], 5.0, 0.0).collect()}
    for n, c in sets.items():
        assert got[n]["area_m2"] == 25.0 * len(c) == sum(ring_area(r) for r in got[n]["rings"])  # holes count below zero
        assert all(r[0] == r[-1] for r in got[n]["rings"])
    assert len(got["box"]["rings"]) == 1 and len(got["box"]["rings"][0]) == 5
    assert len(got["hole"]["rings"]) == 2 and len(got["touch"]["rings"]) == 3
    smooth = shapes.outlines(spark.createDataFrame([("d", x, y) for x in range(-40, 40) for y in range(-40, 40) if x * x + y * y < 1500], "n string, gx long, gy long"), ["n"], 5.0, 10.0).first()
    assert len(smooth["rings"][0]) < 40 and sum(ring_area(r) for r in smooth["rings"]) == pytest.approx(smooth["area_m2"], rel=0.03)


def test_contraction_agrees_with_one_task(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(20_000), rnd.randrange(20_000)) for _ in range(15_000)] + [(30_000 + k, 30_001 + k) for k in range(3_000)]
    frame = spark.createDataFrame(edges, "a long, b long")
    one = {r["v"]: r["component"] for r in components.labelled(frame).collect()}
    assert {r["v"]: r["component"] for r in components.labelled(frame, 10).collect()} == one


def test_blocks_end_whole_or_raise(spark):
    chain = spark.createDataFrame([("g", k, k + 1, 1.0) for k in range(6)], "graph string, src long, dst long, w double")
    source = spark.createDataFrame([("r", "g", False, 0)], "run string, graph string, reverse boolean, node long")
    assert {r["node"]: r["d"] for r in paths.search(chain, source, 1, 2).collect()} == {k: float(k) for k in range(7)}
    with pytest.raises(RuntimeError, match="still changed"):
        paths.search(chain, source, 1, 2, 2)


def test_blocks_of_a_street_grid(spark):
    """Ways that leave a block and come back, and many blocks between source and target."""
    rnd, side = random.Random(12), 14
    es = [(a, b, rnd.uniform(1, 40)) for k in range(side * side) for n in ([k + 1] if k % side < side - 1 else []) + ([k + side] if k < side * (side - 1) else []) for a, b in ((k, n), (n, k))]
    frame = spark.createDataFrame([("g", *e) for e in es], "graph string, src long, dst long, w double")
    sources = spark.createDataFrame([("r1", "g", False, 0), ("r2", "g", True, 100), ("r2", "g", True, 7)], "run string, graph string, reverse boolean, node long")
    wanted = {("r1", k): v for k, v in dijkstra(es, [0]).items()} | {("r2", k): v for k, v in dijkstra([(b, a, w) for a, b, w in es], [100, 7]).items()}
    for most in (10**6, 120):
        got = {(r["run"], r["node"]): r["d"] for r in paths.search(frame, sources, 1, most).collect()}
        assert got == pytest.approx(wanted) and len(got) == 2 * side * side


def test_many_runs_are_carried_in_parts(monkeypatch):
    import pyarrow as pa

    es = random_edges(21, 40, 160)
    edges = pa.table({"src": [e[0] for e in es], "dst": [e[1] for e in es], "w": [e[2] for e in es]})
    entries = pa.table({"run": [f"r{k}" for k in range(30)], "reverse": [False] * 30, "node": list(range(30)), "d": [float(k % 3) for k in range(30)], "fresh": [True] * 30})
    whole = paths._solve(edges, entries).to_pydict()
    monkeypatch.setattr(paths, "STATES", 100)
    parts = paths._solve(edges, entries).to_pydict()
    key = lambda t: {(r, n): d for r, n, d in zip(t["run"], t["node"], t["d"], strict=True)}
    assert key(whole) == key(parts)
    has = {x for e in es for x in e[:2]}
    assert key(whole) == pytest.approx({(f"r{s}", k): v + s % 3 for s in range(30) if s in has for k, v in dijkstra(es, [s]).items()})


def test_single_paths(spark):
    es = random_edges(7)
    frame = spark.createDataFrame([("g", *e) for e in es], "graph string, src long, dst long, w double")
    pairs = spark.createDataFrame([("p1", "g", 1, 9), ("same", "g", 4, 4), ("none", "g", 1, 999)], "run string, graph string, o long, d long")
    got = {r["run"]: r for r in paths.single_paths(frame, pairs).collect()}
    assert got["same"]["nodes"] == [4] and got["none"]["cost"] is None
    way, cheapest = got["p1"]["nodes"], {}
    for a, b, w in es:
        cheapest[a, b] = min(w, cheapest.get((a, b), 1e9))
    assert way[0] == 1 and way[-1] == 9 and sum(cheapest[p] for p in zip(way, way[1:], strict=False)) == pytest.approx(got["p1"]["cost"]) == pytest.approx(dijkstra(es, [1])[9])


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(140)] + [(300 + k, 301 + k) for k in range(50)] + [(900, 900)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    for task_edges in (10**6, 0):  # in one task, and by contraction
        got = {r["v"]: r["component"] for r in components.labelled(spark.createDataFrame(edges, "a long, b long"), task_edges).collect()}
        assert got == {v: find(v) for e in edges for v in e}
    assert components.labelled(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spatial_joins(spark):
    rnd = random.Random(5)
    a = [(k, rnd.uniform(-300, 300), rnd.uniform(-300, 300)) for k in range(80)]
    b = [(k, rnd.uniform(-300, 300), rnd.uniform(-300, 300)) for k in range(60)]
    left, right = spark.createDataFrame(a, "id long, x double, y double"), spark.createDataFrame(b, "rid long, rx double, ry double")
    dist = {(i, j): math.hypot(x - u, y - v) for i, x, y in a for j, u, v in b}
    assert {(r["id"], r["rid"]) for r in spatial.within(left, right, 40.0).collect()} == {p for p, d in dist.items() if d <= 40}
    best = {i: min((dist[i, j], j) for j, _, _ in b) for i, _, _ in a}
    assert {r["id"]: r["rid"] for r in spatial.nearest(left, "id", right, 40.0, "rid").collect()} == {i: j if d <= 40 else None for i, (d, j) in best.items()}
    assert {r["id"]: r["rid"] for r in spatial.nearest_any(left, "id", right, 5.0, "rid").collect()} == {i: j for i, (_, j) in best.items()}
    near = {i for i, (d, _) in best.items() if d <= 40}
    assert {r["id"] for r in spatial.with_any(left, right, 40.0, "id").collect()} == near
    assert {r["id"] for r in spatial.with_any(left, right, 40.0, "id", how="left_anti").collect()} == {i for i, _, _ in a} - near


def test_first_polygon_wins(spark):
    square = lambda x, y, s: [{"x": a, "y": b} for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s))]
    rows = [(k, f"p{k}", [square(x, 0.0, 100.0)], x, 0.0, x + 100, 100.0) for k, x in enumerate((50.0, 0.0))]
    polygons = spark.createDataFrame(rows, f"ordinal int, name string, rings array<{RING}>, x0 double, y0 double, x1 double, y1 double")
    pts = spark.createDataFrame([(1, 75.0, 50.0), (2, 25.0, 50.0), (3, 500.0, 50.0)], "id long, x double, y double")
    got = {r["id"]: r["name"] for r in spatial.in_polygons(pts, "id", polygons, "ordinal", spatial.inside_rings(), 30.0).collect()}
    assert got == {1: "p0", 2: "p1", 3: None}


def test_edge_flag_with_an_inner_gap(spark):
    covers = spark.createDataFrame([(0.0, 0.0, 1000.0, 1000.0), (1000.0, 0.0, 2000.0, 450.0)], "x0 double, y0 double, x1 double, y1 double")
    pts = [(1, 500.0, 500.0), (2, 900.0, 800.0), (3, 50.0, 500.0), (4, 1500.0, 220.0), (5, 5000.0, 5000.0)]
    got = {r["id"]: r["edge"] for r in spatial.edge_flag(spark.createDataFrame(pts, "id long, x double, y double"), "id", covers, 200.0, 50.0).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: True}


# network


def line(k, *pts):
    return (k, [{"x": float(x), "y": float(y)} for x, y in pts])


LINES = f"line_id long, points {RING}"


def test_noding(spark):
    rows = [line(1, (0, 0), (100, 0)), line(2, (50, -50), (50, 50)), line(3, (100, 0), (150, 30), (200, 0)), line(4, (20, 0), (20, 40)), line(5, (0, 0), (100, 0))]
    parts = [[(p["x"], p["y"]) for p in r["points"]] for r in network.node_lines(spark.createDataFrame(rows, LINES)).collect()]
    wanted = [[(0, 0), (20, 0)], [(20, 0), (50, 0)], [(50, 0), (100, 0)], [(50, -50), (50, 0)], [(50, 0), (50, 50)], [(100, 0), (150, 30), (200, 0)], [(20, 0), (20, 40)]]
    assert sorted(parts) == sorted([(float(x), float(y)) for x, y in p] for p in wanted)


def test_segments_have_equal_lengths(spark):
    parts = spark.createDataFrame([line(1, (0, 0), (40, 0), (40, 35)), line(2, (0, 0), (0, 0.01))], LINES)
    got = network.segmentize(parts).orderBy("k").collect()
    assert len(got) == 3 and all(r["length"] == pytest.approx(25) for r in got)
    assert (got[1]["x0"], got[1]["y0"], got[1]["xm"], got[1]["ym"], got[1]["x1"], got[1]["y1"]) == pytest.approx((25, 0, 37.5, 0, 40, 10))


def polygons_frame(spark, rows, kind=False):
    full = [(k, *([None] if kind else []), [[{"x": float(x), "y": float(y)} for x, y in ring]], float(min(x for x, _ in ring)), float(min(y for _, y in ring)), float(max(x for x, _ in ring)), float(max(y for _, y in ring))) for k, ring in rows]
    return spark.createDataFrame(full, f"ordinal int, {'kind string, ' if kind else ''}rings array<{RING}>, x0 double, y0 double, x1 double, y1 double")


def test_network_is_built(spark):
    lines = [line(1, (0, 0), (90, 0)), line(2, (0, 100), (90, 100)), line(3, (95, 0), (180, 0)), line(4, (1000, 1000), (1020, 1000))]
    crossed = (1, [(30, -2), (60, -2), (60, 2), (30, 2)])
    idle = (2, [(58, 5), (62, 5), (62, 95), (58, 95)])
    nodes, links = network.build(spark.createDataFrame(lines, LINES), polygons_frame(spark, [crossed, idle], True), polygons_frame(spark, [(1, [(60, 98), (91, 98), (91, 102), (60, 102)])]), DEFAULT.but(keep_share=0.3))
    rows = links.collect()
    assert sum(r["kind"] == 1 for r in rows) == 1 and sum(r["kind"] == 2 for r in rows) >= 1
    assert [r["length"] for r in rows if r["kind"] == 1][0] == pytest.approx(100, abs=2)
    assert sum(r["is_stair"] and r["kind"] == 0 for r in rows) == 1 and sum(r["flat"] for r in rows) == 1
    kept = {r["node_id"] for r in nodes.collect() if r["kept"]}
    assert len(kept) == nodes.count() - 2 and all(r["u"] in kept and r["v"] in kept for r in rows)


# rasters


def test_bilinear_and_voids(spark):
    z = {(r, c): 10.0 * r + c for r in range(6) for c in range(6)}
    del z[2, 2]
    pixels = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row int, col int, z double")
    pts = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.6, 3.4), (3, -9.0, 99.0)], "id long, x double, y double")
    got = {r["id"]: r["z"] for r in raster.bilinear(pts, "id", pixels, (0.0, 6.0), (1.0, -1.0)).collect()}
    assert got[1] == pytest.approx(5.5) and got[2] is None and got[3] == 0.0
    filled = {(r["row"], r["col"]): r["z"] for r in raster.fill_voids(spark.createDataFrame([(r, c, -999.0 if 1 <= r <= 3 and 1 <= c <= 3 else 5.0) for r in range(5) for c in range(5)], "row int, col int, z double")).collect()}
    assert set(filled.values()) == {5.0} and len(filled) == 25
    assert raster.valid(F.lit(5000.0)) is not None


# index and roll-ups


def hill(spark, n=12, slope=0.1):
    nodes = spark.createDataFrame([(k, 25.0 * k, 0.0, 25.0 * slope * k) for k in range(n)], "node_id long, x double, y double, z double")
    links = spark.createDataFrame([(k, k + 1, 25.0, False, False) for k in range(n - 1)], "u long, v long, length double, is_stair boolean, flat boolean")
    homes = spark.createDataFrame([(k, 25.0 * k, 1.0, 10.0) for k in range(n)], "id long, x double, y double, weight double")
    return nodes, links, homes, spark.createDataFrame([(1, 0.0, 0.0, "medical")], "id long, x double, y double, target string")


def test_index_on_a_straight_hill(spark):
    rows = hbi.run(*hill(spark)).orderBy("id").collect()
    up, down = math.exp(0.35), 1 + 0.5 * (math.exp(0.35) - 1)
    assert rows[0]["hbi"] == 1.0 and rows[0]["t_flat"] == 0
    for r in rows[1:]:
        assert r["hbi"] == pytest.approx((up + down) / 2) and r["home_ratio"] == pytest.approx(up)
        assert r["t_wheel"] == pytest.approx(25 * r["id"] * 10 * (1 / 0.5 + 1))
        assert r["dist_net"] == pytest.approx(25 * r["id"])


def test_reversed_graph_swaps_the_legs(spark):
    nodes, links, _, dests = hill(spark)
    trips = lambda n: {r["node"]: (r["go"], r["back"]) for r in hbi.round_trips(__import__("gradewalk.functions.cost", fromlist=["x"]).weights(hbi.sloped(n, links), names=("elder",)), hbi.destination_nodes(dests, n)).collect()}
    ahead, behind = trips(nodes), trips(nodes.withColumn("z", -F.col("z")))
    assert all(ahead[k] == pytest.approx(behind[k][::-1]) for k in ahead)


def test_a_new_edge_never_costs_time(spark):
    nodes, links, homes, dests = hill(spark)
    fac = spark.createDataFrame([("lift", "elevator", "planned", 0.0, 0.0, 250.0, 0.0, 10.0, 5.0), ("old", "ramp", "existing", 0.0, 0.0, 50.0, 0.0, None, None)], "facility string, type string, status string, ax double, ay double, bx double, by double, wait_s double, speed double")
    edges = {r["facility"]: r for r in whatif.facility_edges(fac, nodes).collect()}
    assert (edges["lift"]["u"], edges["lift"]["v"], edges["lift"]["seconds"]) == (0, 10, pytest.approx(60.0))
    assert edges["old"]["seconds"] == pytest.approx(50 / 0.8)
    times = whatif.intervention_times(nodes, links, homes, dests, whatif.facility_edges(fac, nodes))
    rows = times.collect()
    assert {r["facility"] for r in rows} == {"lift", "old", "ALL"} and all(r["elder1"] <= r["elder0"] + 1e-9 for r in rows)
    s = {r["facility"]: r for r in whatif.intervention_summary(times).collect()}
    assert s["lift"]["n_benefit"] == s["ALL"]["n_benefit"] > 0 and s["old"]["n_benefit"] <= s["lift"]["n_benefit"]
    assert s["lift"]["hbi_after"] < s["lift"]["hbi_before"]


def test_isochrones_nest_and_flat_is_widest(spark):
    nodes, links, homes, _ = hill(spark)
    pts = spark.createDataFrame([("p", 0.0, 0.0)], "name string, x double, y double")
    minutes = spark.createDataFrame([("p", 1), ("p", 3), ("p", 9)], "name string, minutes int")
    reached = whatif.reached_links(whatif.isochrone_times(nodes, links, pts), links, minutes)
    s = whatif.isochrone_summary(whatif.cover_cells(reached, nodes), homes).collect()
    area = {(r["mode"], r["minutes"]): r["area_km2"] for r in s}
    assert area["flat", 1] < area["flat", 3] < area["flat", 9] == area["elder", 9]
    assert all(area[m, k] <= area["flat", k] for m, k in area)
    assert area["flat", 9] == pytest.approx((275 * 50 + math.pi * 625) / 1e6, rel=0.01)
    assert whatif.monotone_failures(spark.createDataFrame(s)).count() == 0


def test_siting_shares_sum_to_one(spark):
    fac = spark.createDataFrame([("f", "planned", 0.0, 0.0, 100.0, 0.0)], "facility string, status string, ax double, ay double, bx double, by double")
    rows = [(f"p{i}{j}", -200.0 + 50 * i, -200.0 + 50 * j, ["도", "대", "공원", "기"][(i + j) % 4]) for i in range(10) for j in range(8)]
    ring = F.array(*[F.struct((F.col("x0") + a).alias("x"), (F.col("y0") + b).alias("y")) for a, b in ((0, 0), (50, 0), (50, 50), (0, 50))])
    parcels = spark.createDataFrame(rows, "pnu string, x0 double, y0 double, jimok string").withColumn("x1", F.col("x0") + 50).withColumn("y1", F.col("y0") + 50).withColumn("ring", ring)
    r = whatif.siting(fac, parcels).first()
    assert r["area_m2"] == pytest.approx(100 * 60 + math.pi * 900, rel=0.01)
    assert sum(r[c] for c in r.asDict() if c.startswith("share_")) == pytest.approx(1)
    assert whatif.shoelace(whatif.clip_convex(np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float), np.array([(2, 2), (9, 2), (9, 9), (2, 9)], float))) == 4


def test_routes(spark):
    nodes, links, _, _ = hill(spark)
    pairs = spark.createDataFrame([("r", 0, 4)], "name string, o long, d long")
    got = {r["mode"]: r for r in whatif.routes(nodes, links, pairs).collect()}
    assert all(r["length_m"] == 100 for r in got.values())
    assert got["adult"]["seconds"] == pytest.approx(got["elder"]["seconds"] * 0.8 / 1.1)
    m = whatif.measured(whatif.routes(nodes, links, spark.createDataFrame([(f"r{k}", 0, k) for k in (2, 5, 9)], "name string, o long, d long")), spark.createDataFrame([(f"r{k}", float(k)) for k in (2, 5, 9)], "name string, measured_min double")).first()
    assert m["n"] == 3 and m["r_adult_pred_vs_measured"] == pytest.approx(1)


def test_routes_search_once_and_measure_the_steps_they_take(spark):
    nodes, links, _, _ = hill(spark)
    pairs = spark.createDataFrame([("r", 0, 4), ("here", 3, 3), ("none", 0, 987_654)], "name string, o long, d long")
    longer = links.filter("u = 0 OR v = 0").withColumn("length", F.col("length") * 3)  # beside the links that ways take
    found = whatif.routes(nodes, links.unionByName(longer), pairs)
    assert "CoGroup" not in found._jdf.queryExecution().optimizedPlan().toString()  # ways are stored, not searched for each use
    got = {(r["name"], r["mode"]): r["length_m"] for r in found.collect()}
    assert {got["r", m] for m in ("elder", "adult", "wheel", "flat")} == {100.0} and got["here", "flat"] == 0 and got["none", "flat"] is None


def test_searches_are_stored_where_they_are_asked_twice(spark):
    nodes, links, homes, dests = hill(spark)
    points = spark.createDataFrame([("a", 0.0, 0.0)], "name string, x double, y double")
    reached = whatif.reached_links(whatif.isochrone_times(nodes, links, points), links, spark.createDataFrame([("a", 5)], "name string, minutes int"))
    for found in (hbi.run(nodes, links, homes, dests), reached):
        assert "CoGroup" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_empty_inputs_give_empty_tables(spark):
    nodes, links, homes, dests = hill(spark)
    none = hbi.run(nodes, links, homes.limit(0), dests)
    assert hbi.grid(none).count() == 0 and hbi.summary(none).count() == 0
    assert hbi.run(nodes, links, homes, dests.limit(0)).count() == 0


# statistics


def test_ranks_and_correlations(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice("ab"), float(rnd.randrange(6)), rnd.choice([None, float(rnd.randrange(5))])) for _ in range(120)]
    frame = spark.createDataFrame(rows, "g string, x double, y double")

    def average(vs):
        return [sum(w < v for w in vs) + (sum(w == v for w in vs) + 1) / 2 for v in vs]

    for g in "ab":
        xs = [x for h, x, _ in rows if h == g]
        got = sorted(r["r"] for r in stats.average_rank(frame, ["g"], "x", "r").filter(F.col("g") == g).collect())
        assert got == sorted(average(xs))
        pairs = [(x, y) for h, x, y in rows if h == g and y is not None]
        rho = np.corrcoef(average([p[0] for p in pairs]), average([p[1] for p in pairs]))[0, 1]
        assert {r["g"]: r["rho"] for r in stats.spearman(frame, ["g"], "x", "y").collect()}[g] == pytest.approx(rho)
    assert stats.spearman(frame.limit(2).withColumn("y", F.lit(1.0)), [], "x", "y").first()["rho"] is None


def test_p_values():
    # two-sided t tests of r = t / sqrt(t^2 + n - 2) at tabulated 5 % points
    for df, t in ((1, 12.7062), (5, 2.5706), (10, 2.2281), (30, 2.0423), (120, 1.9799)):
        assert stats.p_of_correlation(t / math.sqrt(t * t + df), df + 2) == pytest.approx(0.05, abs=1e-5)
    assert stats.p_of_correlation(0.0, 10) == pytest.approx(1) and stats.p_of_correlation(1.0, 10) is None and stats.p_of_correlation(0.5, 2) is None


def test_small_p_values_keep_their_digits():
    # closed forms: f = 1: 1 - 2/pi atan t; f = 2: 1 - t / sqrt(t^2 + 2); f = 4 from the integral of the density
    for r in (1e-6, 0.1, 0.5, 0.99, 1 - 1e-9):
        assert stats.p_of_correlation(r, 3) == pytest.approx(2 / math.pi * math.acos(r), rel=1e-9)
        assert stats.p_of_correlation(r, 4) == pytest.approx(1 - r, rel=1e-6)
        assert stats.p_of_correlation(-r, 6) == pytest.approx((1 - r) ** 2 * (2 + r) / 2, rel=1e-6, abs=1e-17)
    assert stats.p_of_correlation(0.9, 202) == pytest.approx(6.0e-74, rel=0.9)  # log10 p = -73.3 or so
    for n in (40, 41, 400, 401, 5000):  # both sums give the same where they meet
        r = (30 / (n - 2)) ** 0.5
        a, b = stats.p_of_correlation(r * (1 - 1e-9), n), stats.p_of_correlation(r * (1 + 1e-9), n)
        assert a == pytest.approx(b, rel=1e-4)


def test_quantiles_and_shares_over_many_parts(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), rnd.choice([None, 0.5, rnd.random()]), rnd.random()) for _ in range(500)]
    frame = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: (r["m"], r["t"]) for r in stats.quantiles(frame, ["g"], {"m": ("x", 0.5), "t": ("y", 0.9)}).collect()}
    for g in "ab":
        xs, ys = [x for h, x, _ in rows if h == g and x is not None], [y for h, _, y in rows if h == g]
        assert got[g] == pytest.approx((np.quantile(xs, 0.5), np.quantile(ys, 0.9)))
    assert tuple(stats.quantiles(frame.limit(0), [], {"m": ("x", 0.5)}).first()) == (None,)
    sites = spark.createDataFrame([("s", 0.5), ("t", 2.0), ("u", None)], "name string, v double")
    below = {r["name"]: r["share"] for r in stats.share_below(sites, "name", "v", frame, "x", "share").collect()}
    xs = [x for _, x, _ in rows if x is not None]
    assert below == {"s": sum(x < 0.5 for x in xs) / len(xs), "t": 1.0}


def test_first_match_is_exact(spark):
    names = spark.createDataFrame([("",), ("b",), ("bc",), ("cde",), ("cdef",), ("zz",)], "k string")
    sites = spark.createDataFrame([("abcde", 1), ("xbc", 2), ("cdefg", 3), ("b", 0), (None, 4)], "n string, o int")
    got = {r["k"]: r["n"] for r in joins.first_match(names, sites, "k", "n", "o").collect()}
    assert got == {"": "b", "b": "b", "bc": "abcde", "cde": "abcde", "cdef": "cdefg", "zz": None}


def test_quantile_rules_differ(spark):
    frame = spark.createDataFrame([(float(k), float(k)) for k in range(1, 9)], "hbi double, v double")
    quarters = {r["quarter"]: r["n"] for r in stats.quartile_groups(frame, "hbi", "v").collect()}
    assert quarters == {0: 2, 1: 2, 2: 2, 3: 2}
    assert tuple(stats.tail_means(frame, "hbi", "v").first()) == (1.5, 7.5)
    assert stats.index_quantile(frame, "hbi", 0.75, 8).first()["q"] == 7.0 and stats.index_quantile(frame, "hbi", 0.75, 9).first()["q"] is None


# joins and report


def test_filters_run_in_order(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "2 "), ("b", "9"), (None, "3")], "k string, t string")
    assert [r["t"] for r in joins.filtered(rows, {"k": "a", "t": joins.LATEST}).collect()] == ["2 "]
    assert joins.filtered(rows, {"t": joins.LATEST, "k": "a"}).count() == 0
    assert joins.filtered(rows, {"k": ["a", "b"]}, {"t": "9"}).count() == 1


def test_code_join_picks_the_best_key(spark):
    d = spark.createDataFrame([(f"11{k:08}", f"22{k:06}", f"d{k}", 1.0, 0.5) for k in range(8)], "adm_cd string, adm_cd_stat string, adm_nm string, hbi_mean double, share_high double")
    values = spark.createDataFrame([(f"22{k:06}", float(k)) for k in range(6)] + [("1100000001", 5.0)], "code string, value double")
    got = joins.code_join(d, values)
    assert got.count() == 6 and {r["key_kind"] for r in got.collect()} == {"stat"}
    assert joins.code_join(d, values.limit(3)).count() == 0
    s = {r["metric"]: r["value"] for r in joins.join_summary(got.withColumn("hbi_mean", F.col("value") * 2)).collect()}
    assert s["n"] == 6 and s["pearson_hbi"] == pytest.approx(1) and s["spearman_hbi"] == pytest.approx(1) and s["quarter_0"] == 0.5


def test_periods_are_counted_before_places(spark):
    rows = spark.createDataFrame([("1,5", "p1"), ("3", "p2"), ("x", None)], "v string, p string")
    assert [r["value"] for r in joins.point_values(rows, ["v"], "p").collect()] == [5.0, 1.0, 0.0]
    assert [r["value"] for r in joins.point_values(rows).collect()] == [1.0, 1.0, 1.0]


def test_statistics_by_name(spark):
    d = spark.createDataFrame([("종로구", "서울 종로구 종로1·2가", 10.0, 4.0), ("중구", "서울 중구 제1동", 0.0, 0.0)], "gu string, adm_nm string, weight_all double, weight_high double")
    s = spark.createDataFrame([("종로 구", "종로1.2가", 25.0), ("중구", "1동", 7.0)], "gu string, dong string, people double")
    got = {r["gu"]: (r["people"], r["people_in_high"]) for r in joins.statistic_join(d, s, ["people"]).collect()}
    assert got == {"종로구": (25.0, 10.0), "중구": (7.0, None)}


def test_small_reports(spark):
    fields = spark.createDataFrame([("A.x", "1", "x", ["f.csv"], False), ("A.y", None, "y", ["g.csv"], False), ("A.z", None, "z", ["h.csv"], True)], "key string, value string, label string, need array<string>, optional boolean")
    import json

    got = json.loads(report.bundle(fields).first()["json"])
    assert got["fields"]["A.x"]["value"] == "1" and got["fields"]["A.y"]["value"] is None and [m["key"] for m in got["missing"]] == ["A.y"]
    rows = spark.createDataFrame([("t", "new", 1.0), ("t", "old", 2.0), ("u", "old", 3.0)], "target string, metric string, value double")
    assert {r["target"]: r["value"] for r in report.metric(rows, ("new", "old")).collect()} == {"t": 1.0, "u": 3.0}
    assert report.html("<script>/*DATA*/</script>", '{"a": "</script>"}') == '<script>{"a": "<\\/script>"}</script>'
    d = spark.createDataFrame([(float(k), float(k % 4)) for k in range(12)], "hbi_mean double, v double")
    assert report.overlap_of_quarters(d, "v").first()["n"] == sum(h >= 9 and v >= 3 for h, v in ((k, k % 4) for k in range(12)))


def test_lookup_by_cell_or_nearest(spark):
    cells = spark.createDataFrame([(125.0, 125.0), (1125.0, 125.0)], "cell_x double, cell_y double")
    pts = spark.createDataFrame([(1, 10.0, 10.0), (2, 400.0, 125.0), (3, 3000.0, 125.0)], "id long, x double, y double")
    got = {r["id"]: (r["cell_x"], r["how"]) for r in joins.cell_or_nearest(pts, "id", cells).collect()}
    assert got == {1: (125.0, "cell"), 2: (125.0, "nearest"), 3: (None, None)}


def test_spaced_choice(spark):
    cells = spark.createDataFrame([(100.0 * k, 0.0, float(k)) for k in range(12)], "cell_x double, cell_y double, hbi_mean double")
    assert [r["hbi_mean"] for r in whatif.spaced_top(cells, 400.0, 5)] == [11, 7, 3]


def test_spaced_choice_beyond_a_large_hill(spark):
    hill = [(25.0 * a, 25.0 * b, 100.0 - (a + b) / 100) for a in range(40) for b in range(40)]
    far = [(50_000.0 + 1000 * k, 0.0, float(k)) for k in range(4)]
    cells = spark.createDataFrame(hill + far, "cell_x double, cell_y double, hbi_mean double")
    wanted = []
    for c in sorted(hill + far, key=lambda c: (-c[2], c[0], c[1])):
        if all(math.hypot(c[0] - w[0], c[1] - w[1]) >= 2000.0 for w in wanted) and len(wanted) < 3:
            wanted.append(c)
    got = [tuple(r) for r in whatif.spaced_top(cells, 2000.0, 3)]
    assert got == wanted and [c[2] for c in got] == [100.0, 3.0, 1.0]


def test_named_neighbours_and_reconciliation(spark):
    a = spark.createDataFrame([("서울역", 127.0, 37.5), ("종각", 127.0, 37.5)], "name string, lon double, lat double")
    b = spark.createDataFrame([("서울역(1호선)", 127.001, 37.5), ("서울", 127.1, 37.5)], "name string, lon double, lat double")
    got = {r["name"]: r["d_m"] for r in joins.nearest_named(a, b).collect()}
    assert got["서울역"] == pytest.approx(88.2, abs=0.5) and got["종각"] is None
    x, y = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double"), spark.createDataFrame([("a", 1.005), ("b", 2.5)], "k string, v double")
    assert tuple(joins.reconcile(x, y, "k", "v").first()) == (2, 1)


def test_running_lengths_of_all_points(spark):
    rnd = random.Random(5)
    rows = [(k % 3, k, rnd.uniform(0, 9), rnd.uniform(0, 9)) for k in range(2400)]
    got = {(r["g"], r["id"]): (r["n"], r["arc"]) for r in network.running_lengths(spark.createDataFrame(rows, "g long, id long, x double, y double"), ["g"], "id").collect()}
    wanted, last = {}, {}
    for g, i, x, y in rows:
        n, arc, px, py = last.get(g, (0, 0.0, x, y))
        last[g] = (n + 1, arc + math.hypot(x - px, y - py), x, y)
        wanted[g, i] = last[g][:2]
    assert len(got) == 2400 and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in wanted.items()}
    assert [got[k][1] for k in wanted] == pytest.approx([v[1] for v in wanted.values()])


def test_arc_length_query_reaches_every_event(spark, tmp_path):
    from gradewalk.plans.queries import QUERIES

    rows = spark.range(2600).selectExpr("id AS event_id", "id % 7 AS user_id", "cast(id AS double) AS value", "timestamp '2024-01-01 00:00:00' AS ts", "'a' AS event_type", "'{}' AS props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["arc_length"](spark, f"{tmp_path}").collect()
    assert {r["id"] for r in got} == set(range(2600)) and max(r["n"] for r in got) == 372


def test_set_except_query_compares_every_key(spark, tmp_path):
    from gradewalk.plans.queries import QUERIES

    spark.range(40).selectExpr("id AS c_custkey", "id % 25 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(22, 45).selectExpr("id AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["k"], r["side"]) for r in QUERIES["set_except"](spark, f"{tmp_path}").collect()}
    assert got == {(k, "left") for k in range(22)} | {(k, "right") for k in range(40, 45)}
