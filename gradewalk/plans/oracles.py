"""SQL for DuckDB: the same questions as the queries, asked of the same views in another way."""

from __future__ import annotations

from gradewalk.plans.synth import ctes


def q(views: tuple[str, ...], body: str, more: str = "", recursive: bool = False) -> str:
    parts = [p for p in (ctes(*views) if views else "", more.strip().rstrip(",")) if p]
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def slow(s: str) -> str:
    return f"exp(3.5 * (abs({s} + 0.05) - 0.05))"


def sloped(clip: str = "0.4", source: str = "links", name: str = "sl") -> str:
    """Links with clipped slopes."""
    return f"""{name} AS (SELECT u, v, length, is_stair, CASE WHEN flat THEN CAST(0 AS DOUBLE) ELSE greatest(-{clip}, least({clip}, (b.z - a.z) / greatest(length, 0.5))) END AS s
 FROM {source} JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v)"""


def both_ways(name: str = "dl", source: str = "sl") -> str:
    return f"{name} AS (SELECT u AS src, v AS dst, length, s, is_stair FROM {source} UNION ALL SELECT v, u, length, -s, is_stair FROM {source})"


def elder(speed: str = "0.8", down: str = "0.5", stair: str = "1.2") -> str:
    st = "(CASE WHEN is_stair THEN CASE WHEN s >= 0 THEN greatest(s, 0.25) ELSE least(s, -0.25) END ELSE s END)"
    falling = slow(st) if down == "0" else f"(1 + {down} * ({slow(f'abs({st})')} - 1))"
    return f"length / {speed} * CASE WHEN {st} >= 0 THEN {slow(st)} ELSE {falling} END * CASE WHEN is_stair THEN {stair} ELSE 1 END"


WHEEL = "length / greatest(0.4, 1 - 5 * greatest(s, 0)) * CASE WHEN abs(s) > CAST(1 AS DOUBLE) / 12 THEN 10 ELSE 1 END"
EDGES = ",\n".join([sloped(), both_ways()])


def search(edges: str, sources: str, name: str = "best") -> str:
    """Least costs by keyed recursion: edges (g, src, dst, w), sources (run, g, node); gives name (run, node, d)."""
    return f"""edges AS MATERIALIZED ({edges}), sources AS MATERIALIZED ({sources}),
{name}(run, g, node, d) USING KEY (run, node) AS (SELECT run, g, node, CAST(0 AS DOUBLE) FROM sources UNION
 SELECT n.run, n.g, n.node, n.d FROM (SELECT {name}.run, {name}.g, e.dst AS node, min({name}.d + e.w) AS d FROM {name} JOIN edges e ON e.g = {name}.g AND e.src = {name}.node GROUP BY ALL) n
 LEFT JOIN recurring.{name} r ON r.run = n.run AND r.node = n.node WHERE r.d IS NULL OR n.d < r.d - 1e-9)"""


def edge_rows(costs: dict[str, str], source: str = "dl", tag: str = "") -> str:
    """Rows of edges for forward (g) and backward (g with ~) searches of each named cost."""
    parts = []
    for g, (w, ok) in ((k, v if isinstance(v, tuple) else (v, "true")) for k, v in costs.items()):
        parts.append(f"SELECT '{tag}{g}' AS g, src, dst, {w} AS w FROM {source} WHERE {ok}")
        parts.append(f"SELECT '{tag}{g}~' AS g, dst AS src, src AS dst, {w} AS w FROM {source} WHERE {ok}")
    return " UNION ALL ".join(parts)


DEST_NODES = """dn AS (SELECT DISTINCT target, arg_min(node_id, (d, node_id)) AS node FROM (
 SELECT t.id, t.target, n.node_id, sqrt((t.x - n.x) * (t.x - n.x) + (t.y - n.y) * (t.y - n.y)) AS d FROM dests t JOIN nodes n ON n.x BETWEEN t.x - 100 AND t.x + 100 AND n.y BETWEEN t.y - 100 AND t.y + 100) p WHERE d <= 100 GROUP BY id, target)"""
HOME_NODES = """hn AS (SELECT id, arg_min(node_id, (d, node_id)) AS node, min(d) AS snap_d FROM (
 SELECT t.id, n.node_id, sqrt((t.x - n.x) * (t.x - n.x) + (t.y - n.y) * (t.y - n.y)) AS d FROM homes t JOIN nodes n ON n.x BETWEEN t.x - 60 AND t.x + 60 AND n.y BETWEEN t.y - 60 AND t.y + 60) p WHERE d <= 60 GROUP BY id)"""
COSTS = {"elder": elder(), "flat": "length / 0.8", "wheel": (WHEEL, "NOT is_stair"), "wheel_flat": "length / 1.0"}


def starts(graphs: str, source: str = "dn", where: str = "true") -> str:
    """Searches to (go) and from (back) each target on each graph."""
    return f"SELECT target || '|' || g.g || '|' || b.b AS run, g.g || CASE WHEN b.b = 'go' THEN '~' ELSE '' END AS g, node FROM {source}, (SELECT unnest([{graphs}]) AS g) g, (SELECT unnest(['go', 'back']) AS b) b WHERE {where}"


TRIPS = "tr AS (SELECT split_part(run, '|', 1) AS target, split_part(run, '|', 2) AS g, node, max(d) FILTER (split_part(run, '|', 3) = 'go') AS go, max(d) FILTER (split_part(run, '|', 3) = 'back') AS back FROM best GROUP BY ALL)"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN CASE WHEN {a} IS NOT NULL THEN 1 END ELSE {a} / {b} END"


HOMES_HBI = f"""w AS (SELECT target, node, max(go + back) FILTER (g = 'elder') AS t_elder, max(back) FILTER (g = 'elder') AS t_elder_back, max(go + back) FILTER (g = 'flat') AS t_flat, max(back) FILTER (g = 'flat') AS t_flat_back,
 max(go + back) FILTER (g = 'wheel') AS t_wheel, max(go + back) FILTER (g = 'wheel_flat') AS t_wheel_flat FROM tr GROUP BY ALL),
hh AS (SELECT h.*, t.target, t_elder, t_elder_back, t_flat, t_flat_back, t_wheel, t_wheel_flat, t_flat / 2 * 0.8 AS dist_net, {ratio('t_elder', 't_flat')} AS hbi, {ratio('t_elder_back', 't_flat_back')} AS home_ratio, {ratio('t_wheel', 't_wheel_flat')} AS wheel_ratio
 FROM homes h CROSS JOIN (SELECT DISTINCT target FROM dn) t LEFT JOIN hn ON hn.id = h.id LEFT JOIN w ON w.node = hn.node AND w.target = t.target)"""
FULL = ",\n".join([EDGES, DEST_NODES, HOME_NODES, search(edge_rows(COSTS), starts("'elder', 'flat', 'wheel', 'wheel_flat'")), TRIPS, HOMES_HBI])
NET = ("nodes", "links", "homes", "dests")


def full(body: str, views: tuple[str, ...] = NET, more: str = "") -> str:
    return q(views, body, FULL + (",\n" + more if more else ""), True)


def gridded(source: str, size: int = 250) -> str:
    return f"CAST(floor(x / {size}) AS BIGINT) AS gx, CAST(floor(y / {size}) AS BIGINT) AS gy"


CENTRE = "(gx + 0.5) * 250.0::DOUBLE AS cell_x, (gy + 0.5) * 250.0::DOUBLE AS cell_y"
ZONE_HOMES = "(SELECT h.*, z.adm_cd, z.adm_nm, z.gu FROM {0} h LEFT JOIN zones z ON h.x >= z.x0 AND h.x < z.x1 AND h.y >= z.y0 AND h.y < z.y1)"


def rank(c: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"(rank() OVER ({part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{c}) - 1) / CAST(2 AS DOUBLE))"


FACILITIES = """fac AS (SELECT * FROM (VALUES ('lift', 'elevator', 'planned', 201010.0::DOUBLE, 545910.0::DOUBLE, 201310.0::DOUBLE, 546210.0::DOUBLE), ('rail', 'monorail', 'existing', 200700.0::DOUBLE, 545700.0::DOUBLE, 201200.0::DOUBLE, 546100.0::DOUBLE), ('ramp', 'ramp', 'planned', 201500.0::DOUBLE, 546400.0::DOUBLE, 201300.0::DOUBLE, 546200.0::DOUBLE)) t(facility, type, status, ax, ay, bx, by_)),
fe AS (SELECT facility, status, arg_min(a.node_id, (sqrt((a.x - ax) * (a.x - ax) + (a.y - ay) * (a.y - ay)), a.node_id)) AS u, min(sqrt((a.x - ax) * (a.x - ax) + (a.y - ay) * (a.y - ay))) AS du, any_value(type) AS type, any_value(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))) AS len, any_value(bx) AS bx, any_value(by_) AS by_ FROM fac, nodes a GROUP BY ALL),
fv AS (SELECT facility, any_value(status) AS status, any_value(u) AS u, arg_min(b.node_id, (sqrt((b.x - bx) * (b.x - bx) + (b.y - by_) * (b.y - by_)), b.node_id)) AS v,
 any_value(CASE type WHEN 'ramp' THEN 0 WHEN 'vertical' THEN 45 ELSE 60 END + len / CASE type WHEN 'monorail' THEN 0.6 WHEN 'ramp' THEN 0.8 ELSE 1.0 END) + (any_value(du) + min(sqrt((b.x - bx) * (b.x - bx) + (b.y - by_) * (b.y - by_)))) / 0.8 AS seconds FROM fe, nodes b GROUP BY facility),
sc AS (SELECT facility AS scenario, u, v, seconds FROM fv UNION ALL SELECT 'ALL', u, v, seconds FROM fv WHERE status <> 'existing')"""


def interventions(body: str, views: tuple[str, ...] = NET) -> str:
    old = edge_rows({k: COSTS[k] for k in ("elder", "flat", "wheel")}, tag="before/")
    new = " UNION ALL ".join(f"SELECT n.scenario || '/{g}{t}' AS g, {a} AS src, {b} AS dst, {w} AS w FROM dl, (SELECT DISTINCT scenario FROM sc) n WHERE {ok}" for g, w, ok in (("elder", elder(), "true"), ("wheel", WHEEL, "NOT is_stair")) for t, a, b in (("", "src", "dst"), ("~", "dst", "src")))
    extra = "SELECT scenario || '/' || g AS g, src, dst, seconds AS w FROM (SELECT scenario, u AS src, v AS dst, seconds FROM sc UNION ALL SELECT scenario, v, u, seconds FROM sc), (SELECT unnest(['elder', 'elder~', 'wheel', 'wheel~']) AS g)"
    graphs = "(SELECT unnest(['before/elder', 'before/flat', 'before/wheel']) AS g UNION ALL SELECT DISTINCT scenario || '/' || k FROM sc, (SELECT unnest(['elder', 'wheel']) AS k))"
    src = f"SELECT target || '|' || g.g || '|' || b.b AS run, g.g || CASE WHEN b.b = 'go' THEN '~' ELSE '' END AS g, node FROM dn, {graphs} g, (SELECT unnest(['go', 'back']) AS b) b WHERE target = 'station'"
    tail = """bef AS (SELECT node, max(go + back) FILTER (g = 'before/elder') AS e0, max(go + back) FILTER (g = 'before/flat') AS f0, max(go + back) FILTER (g = 'before/wheel') AS w0 FROM tr GROUP BY node),
aft AS (SELECT split_part(g, '/', 1) AS facility, target, node, max(go + back) FILTER (split_part(g, '/', 2) = 'elder') AS e1, max(go + back) FILTER (split_part(g, '/', 2) = 'wheel') AS w1 FROM tr WHERE split_part(g, '/', 1) <> 'before' GROUP BY ALL),
ef AS (SELECT facility, aft.target, h.*, e0 - e1 AS saved, coalesce(e0 - e1 >= 60, false) AS ben, w0 IS NULL AND w1 IS NOT NULL AS newly, (w0 IS NULL AND w1 IS NOT NULL) OR coalesce(w0 - w1 >= 60, false) AS wben, e0 / f0 AS h0, e1 / f0 AS h1,
 coalesce(e0 / f0 >= 1.8 AND e1 / f0 < 1.8, false) AS xh, coalesce(e0 / f0 >= 1.3 AND e1 / f0 < 1.3, false) AS xm FROM homes h JOIN hn ON hn.id = h.id JOIN aft ON aft.node = hn.node LEFT JOIN bef ON bef.node = hn.node)"""
    return q(views, body, ",\n".join([EDGES, DEST_NODES, HOME_NODES, FACILITIES, search(f"{old} UNION ALL {new} UNION ALL {extra}", src), TRIPS, tail]), True)


_SENS = {"base": ("0.4", "0.8", "0.5", "1.2"), "speed_0.7": ("0.4", "0.7", "0.5", "1.2"), "speed_1.0": ("0.4", "1.0", "0.5", "1.2"), "downhill_0": ("0.4", "0.8", "0", "1.2"), "downhill_1": ("0.4", "0.8", "1", "1.2"), "stairs_1.5": ("0.4", "0.8", "0.5", "1.5"), "clip_0.3": ("0.3", "0.8", "0.5", "1.2")}


def sensitivity() -> str:
    tables = ",\n".join([sloped("0.4"), both_ways(), sloped("0.3", name="sl3"), both_ways("dl3", "sl3")])
    edges = " UNION ALL ".join(edge_rows({f"{n}/elder": elder(sp, dn, st), f"{n}/flat": f"length / {sp}"}, "dl3" if c == "0.3" else "dl") for n, (c, sp, dn, st) in _SENS.items())
    graphs = ", ".join(f"'{n}/{g}'" for n in _SENS for g in ("elder", "flat"))
    tail = f"""ix AS (SELECT scenario, id, round({ratio('e', 'f')}, 9) AS h FROM hn JOIN (SELECT split_part(g, '/', 1) AS scenario, node, max(go + back) FILTER (split_part(g, '/', 2) = 'elder') AS e, max(go + back) FILTER (split_part(g, '/', 2) = 'flat') AS f FROM tr GROUP BY ALL) t USING (node)),
b AS (SELECT ix.*, o.h AS h0 FROM ix JOIN ix o ON o.id = ix.id AND o.scenario = 'base'),
c AS (SELECT scenario, quantile_cont(h, 0.9) AS cut FROM ix GROUP BY scenario),
r AS (SELECT b.*, {rank('h', 'scenario')} AS r1, {rank('h0', 'scenario')} AS r0 FROM b)"""
    body = """SELECT r.scenario, round(median(h), 6) AS hbi_median, round(avg(CAST(h >= 1.8 AS INT)), 6) AS share_high,
 round(count(*) FILTER (h0 >= c0.cut AND h >= c.cut) / CAST(greatest(count(*) FILTER (h0 >= c0.cut), 1) AS DOUBLE), 6) AS top10_overlap, round(corr(r0, r1), 6) AS rank_corr_vs_base
 FROM r JOIN c ON c.scenario = r.scenario JOIN c c0 ON c0.scenario = 'base' GROUP BY r.scenario"""
    return q(NET, body, ",\n".join([tables, DEST_NODES, HOME_NODES, search(edges, starts(graphs, where="target = 'medical'")), TRIPS, tail]), True)
