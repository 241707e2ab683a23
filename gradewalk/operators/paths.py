"""Shortest paths.

A graph of up to BLOCK_EDGES edges, such as a city's streets, is one task: its edges are flat arrays, and the distances of
all of its runs are carried at once from the nodes that became nearer to every node they reach (`Block.spread`).

A larger graph is cut into cells of equally many edges. Nodes are numbered along a space-filling curve through their
places, or by id where no places are given (ids are numbered by place, see network.merge_nodes), and a cell ends where its
edges are counted, so neither far nor hashed ids fill one. Then:

1. Each cell finds the distances between its border nodes inside it, and from the sources in it to them.
2. These distances and the edges between cells are a smaller graph, the overlay, of border nodes only. Pairs that a third
   border node lies between are left out. It is searched like any other graph, in one task or through its own overlay, whose
   cells are larger.
3. Each cell carries the distances of its border nodes and sources to the rest of it.

That takes the same few steps however far paths go. It pays where few nodes are border nodes, as on maps. Where a block holds
many cells, a map has few blocks and ways cross few of them: then whole blocks hand on what gets nearer at their borders, and
only that is kept between the rounds (`_by_borders`); each block is searched whole once, at the end. Ways that are still on
after PATIENCE rounds go on through the overlay. Graphs whose nodes are nearly all border nodes (hashed ids without places, graphs without places at all) are searched by rounds
instead: blocks that got something nearer from another block carry it on, until nothing changes; few steps cross such a
graph. Both give the distances of the one task.

Extra edges only lower distances: `lowered` starts from their ends and visits what gets nearer, for any number of runs.

Components of a graph are independent, so with known components each is a graph of its own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewalk.operators.ordered import running
from gradewalk.operators.tables import save

#: Edges of a block: 24 bytes each as they come, about 200 while they are sorted into arrays.
BLOCK_EDGES = 2_000_000
#: Ends of edges in a cell of the overlay; a cell's work grows with the square root of it for each node.
CELL_EDGES = 8_000
#: The overlay is used where there are so many times more nodes than border nodes; border nodes of a cell up to which pairs are thinned out.
OVERLAY_SHARE, THINNED = 3, 1_024
#: An overlay's cells hold so many times the edges, as a cell's border grows slower than the cell; its blocks do, up to BLOCK_EDGES.
LEVEL = 8
#: Blocks of so many cells hand on distances at their borders, for so many rounds before the overlay goes on.
ROOMY, PATIENCE = 16, 64
#: By how much, of the whole way, sums of the same costs in another order may differ.
ROUNDING = 1e-9
#: Distances (runs x nodes) that are carried at once; 8 bytes each.
STATES = 16_000_000
#: More than any path crosses blocks.
ROUNDS = 1_000_000


def _dense(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids in order, and src and dst as places among them. Ids that lie close together are counted, others searched."""
    if not len(src):
        return np.zeros(0, np.int64), src, dst
    low, high = min(src.min(), dst.min()), max(src.max(), dst.max())
    if int(high) - int(low) >= 16 * len(src):
        ids = np.unique(np.concatenate([src, dst]))
        return ids, np.searchsorted(ids, src), np.searchsorted(ids, dst)
    met = np.zeros(int(high - low) + 1, bool)
    met[src - low] = met[dst - low] = True
    number = np.cumsum(met) - 1
    return np.flatnonzero(met) + low, number[src - low], number[dst - low]


class Block:
    """Out-edges of dense node numbers; parallel edges keep the cheapest."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray):
        self.ids, a, b = _dense(src, dst)
        way = a * len(self.ids) + b
        order = np.argsort(way)
        way, w = way[order], w[order]
        first = np.flatnonzero(np.diff(way, prepend=-1))
        order = order[first]
        self.tail, self.head, self.w = a[order], b[order], np.minimum.reduceat(w, first) if len(first) else w
        self.start = np.searchsorted(self.tail, np.arange(len(self.ids) + 1))
        costly = self.w[self.w > 0]
        self.step = 2 * float(costly.mean()) if len(costly) else 1.0

    def number(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of ids, -1 for those that the block has no edge at."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        k = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[k] == ids, k, -1)

    def spread(self, dist: np.ndarray, states: np.ndarray, until: int | None = None) -> np.ndarray:
        """Carries distances from states on; dist is changed in place. Returns the states that got nearer.

        A state is run * nodes + node. States nearer than a limit go first, and the limit grows by the mean cost of two edges,
        so few states are carried on before their distance is final. Stops when state `until` is final."""
        n, limit, far = len(self.ids), -np.inf, [states]
        nearer, tag = np.zeros(len(dist), bool), np.empty(len(dist), np.int32 if len(dist) < 1 << 31 else np.int64)

        def once(some: np.ndarray) -> np.ndarray:  # each state one time, without sorting
            k = np.arange(len(some), dtype=tag.dtype)
            tag[some] = k
            return some[tag[some] == k]

        while True:
            waiting = once(np.concatenate(far))
            waiting = waiting[dist[waiting] >= limit]
            if not len(waiting) or until is not None and dist[waiting].min() >= dist[until]:
                break
            limit = dist[waiting].min() + self.step
            now = dist[waiting] < limit
            near, far = waiting[now], [waiting[~now]]
            while len(near):
                node, d = near % n, dist[near]
                begin = self.start[node]
                many = self.start[node + 1] - begin
                edge = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                to, cost = np.repeat(near - node, many) + self.head[edge], np.repeat(d, many) + self.w[edge]
                better = cost < dist[to]
                to, cost = to[better], cost[better]
                np.minimum.at(dist, to, cost)
                to = once(to)
                nearer[to] = True
                soon = dist[to] < limit
                near = to[soon]
                far.append(to[~soon])
        return np.flatnonzero(nearer)


def _solve(edges: pa.Table, entries: pa.Table) -> pa.Table:
    """run, reverse, node, d of the fresh entries and of all that got nearer from them. Entries: run, reverse, node, d, fresh."""
    found = [(np.zeros(0, object), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0))]
    back, run, node, d, fresh = (entries.column(c).to_numpy() for c in ("reverse", "run", "node", "d", "fresh"))
    for reverse in (False, True):
        mine = np.flatnonzero(back == reverse)
        if not len(mine):
            continue
        block = Block(*(edges.column(c).to_numpy() for c in (("dst", "src") if reverse else ("src", "dst"))), edges.column("w").to_numpy())
        place = block.number(node[mine])
        mine, place = mine[place >= 0], place[place >= 0]  # the others have no edge here
        runs, number = np.unique(run[mine], return_inverse=True)
        n, most = len(block.ids), max(1, STATES // max(len(block.ids), 1))
        for low in range(0, len(runs), most):
            part = (number >= low) & (number < low + most)
            state = (number[part] - low) * n + place[part]
            dist = np.full(min(most, len(runs) - low) * n, np.inf)
            np.minimum.at(dist, state, d[mine[part]])
            start = np.unique(state[fresh[mine[part]]])
            got = np.union1d(start, block.spread(dist, start))
            found.append((runs[low + got // n], np.full(len(got), reverse), block.ids[got % n], dist[got]))
    return _table(found)


def _table(found: list[tuple]) -> pa.Table:
    r, b, v, x = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.table({"run": pa.array(r, pa.string()), "reverse": pa.array(b, pa.bool_()), "node": pa.array(v, pa.int64()), "d": pa.array(x, pa.float64())})


def _of(graph: pa.Scalar, found: pa.Table) -> pa.Table:
    return found.add_column(0, "graph", pa.array([graph.as_py()] * found.num_rows, pa.string()))


_FOUND = "graph string, run string, reverse boolean, node long, d double"


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("run"), F.lit(shards)).cast("int").alias("shard")


def _parts(shards: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("part")


def _entries(sources: DataFrame) -> DataFrame:
    return sources.select("run", "graph", "reverse", "node", F.lit(0.0).alias("d"))


def _one_block(edges: DataFrame, entries: DataFrame, shards: int) -> DataFrame:
    """A task for each graph and shard, both directions from one copy of the edges."""
    dealt = edges.select(F.col("graph").alias("g"), "src", "dst", "w", _parts(shards))
    starts = entries.select("run", "graph", "reverse", "node", "d", F.lit(True).alias("fresh"), _shard(shards))
    return dealt.groupBy("g", "part").cogroup(starts.groupBy("graph", "shard")).applyInArrow(lambda key, e, x: _of(key[0], _solve(e, x)), _FOUND)


def multi_source(edges: DataFrame, sources: DataFrame, shards: int = 1) -> DataFrame:
    """search for graphs of one block each."""
    return _one_block(edges, _entries(sources), shards).select("run", "node", "d")


def search(edges: DataFrame, sources: DataFrame, shards: int = 1, block_edges: int = BLOCK_EDGES, rounds: int = ROUNDS, places: DataFrame | None = None, cell_edges: int = CELL_EDGES, at: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """run, node, d: the least cost between each node and the run's sources.

    edges: graph, src, dst, w. sources: run, graph, reverse (cost of going to a source rather than from it), node. places
    (node_id, x, y) make good cells of graphs that are too large for a task. Runs are dealt over so many shards. Unreachable
    nodes have no row, and neither have sources at which no edge of their graph begins or ends. With at (node) only those
    nodes have rows, and only blocks and cells that hold some are searched whole. Edges are stored first, unless they are. Raises if distances of graphs that are
    searched by rounds still change after so many."""
    edges = edges.select("graph", "src", "dst", "w")
    edges = edges if stored else save(edges, "graphs")
    found = _search(edges, _entries(sources), shards, block_edges, rounds, places, cell_edges, at=at).select("run", "node", "d")
    return found if at is None else found.join(at.select("node"), "node", "left_semi").select("run", "node", "d")


def _large(edges: DataFrame, block_edges: int) -> DataFrame | None:
    """The graphs that are too large for a task, stored."""
    large = edges.groupBy("graph").count().filter(F.col("count") > block_edges).select("graph")
    return save(large, "large-graphs") if large.take(1) else None


def _search(edges: DataFrame, entries: DataFrame, shards: int, block_edges: int, rounds: int, places: DataFrame | None, cell_edges: int, overlays: bool = True, at: DataFrame | None = None) -> DataFrame:
    """search from stored edges and from entries that may have come some way already: graph, run, reverse, node, d.

    Other nodes than those of `at` may have rows, too."""
    large = _large(edges, block_edges)
    if large is None:
        return _one_block(edges, entries, shards)
    small = _one_block(edges.join(large, "graph", "left_anti"), entries.join(large, "graph", "left_anti"), shards)
    edges, entries = edges.join(large, "graph", "left_semi"), save(entries.join(large, "graph", "left_semi"), "entries")
    if block_edges >= ROOMY * cell_edges:
        marked, borders, cells = _cells(edges, block_edges, places)
        if borders.count() * OVERLAY_SHARE > cells.count():  # smaller cells have more border nodes
            return small.unionByName(_by_rounds(marked, cells, entries, shards, rounds))
        state, done = _border_rounds(marked, borders, cells, entries, shards, min(rounds, PATIENCE))
        if done:
            return small.unionByName(_by_borders(marked, borders, state, shards, _asked(cells, at)))
        entries = state.select("run", "graph", "reverse", "node", "d")
    if overlays:
        marked, borders, cells = _cells(edges, min(block_edges, cell_edges), places)
        if borders.count() * OVERLAY_SHARE <= cells.count():
            return small.unionByName(_over(marked, borders, entries, cells, shards, block_edges, rounds, places, cell_edges, _asked(cells, at)))
    blocks = numbered(edges, block_edges, places)
    return small.unionByName(_by_rounds(with_blocks(edges, blocks), blocks, entries, shards, rounds))


def _curve(places: DataFrame) -> DataFrame:
    """node and z, its place along a curve that visits squares of a 65,536 x 65,536 grid quarter by quarter."""
    x0, y0, x1, y1 = places.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    side = max((x1 or 0.0) - (x0 or 0.0), (y1 or 0.0) - (y0 or 0.0), 1e-9)
    at = lambda c, low: F.floor((F.col(c) - F.lit(low)) / F.lit(side) * 65_535).cast("long")

    def apart(v: Column) -> Column:  # its bits, each followed by a zero
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return places.select(F.col("node_id").alias("node"), apart(at("x", x0)).bitwiseOR(F.shiftleft(apart(at("y", y0)), 1)).alias("z"))


def numbered(edges: DataFrame, most: int, places: DataFrame | None = None) -> DataFrame:
    """graph, node and block, stored: the ends of edges at the nodes of a block are at most `most`, or those of its last node more."""
    ends = edges.select("graph", F.explode(F.array("src", "dst")).alias("node")).groupBy("graph", "node").agg(F.count("*").alias("n"))
    if places is not None:
        ends = ends.join(_curve(places).groupBy("node").agg(F.min("z").alias("z")).hint("merge"), "node", "left")
    order = ["graph", *(["z"] if places is not None else []), "node"]
    placed = running(ends, [F.col(c) for c in order], {"before": F.col("n")}, stored=True)  # a sum over stored edges
    return save(placed.select("graph", "node", F.floor(F.col("before") / most).alias("block")), "numbered")


def with_blocks(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """edges with sb and db, the blocks of their ends."""
    of = lambda node, block: blocks.select("graph", F.col("node").alias(node), F.col("block").alias(block)).hint("merge")
    return edges.join(of("src", "sb"), ["graph", "src"]).join(of("dst", "db"), ["graph", "dst"]).select("graph", "src", "dst", "w", "sb", "db")


def _cells(edges: DataFrame, most: int, places: DataFrame | None, ends: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges with the cells of their ends, the cells' border nodes and all nodes' cells, stored. ends (graph, node) are border nodes, too."""
    cells = numbered(edges, most, places)
    marked = save(with_blocks(edges, cells), "cells")
    both = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("sb").alias("block")), F.struct(F.col("dst").alias("node"), F.col("db").alias("block")))).alias("end")
    borders = marked.filter("sb <> db").select("graph", both).select("graph", "end.*")
    if ends is not None:
        borders = borders.unionByName(cells.join(ends, ["graph", "node"], "left_semi"))
    return marked, save(borders.distinct(), "borders"), cells


def _inner(marked: DataFrame, borders: DataFrame) -> DataFrame:
    """graph, block, src, dst, w, border: the edges inside cells, and a loop for each border node."""
    inner = marked.filter("sb = db").select("graph", F.col("sb").alias("block"), "src", "dst", "w", F.lit(False).alias("border"))
    return inner.unionByName(borders.select("graph", "block", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("w"), F.lit(True).alias("border")))


def _between(block: Block, at: np.ndarray) -> np.ndarray:
    """Distances between some nodes of a block."""
    n, found = len(block.ids), np.empty((len(at), len(at)))
    most = max(1, STATES // max(n, 1))
    for low in range(0, len(at), most):
        part = at[low : low + most]
        start = np.arange(len(part)) * n + part
        dist = np.full(len(part) * n, np.inf)
        dist[start] = 0.0
        block.spread(dist, start)
        found[low : low + most] = dist.reshape(-1, n)[:, at]
    return found


def _thinned(d: np.ndarray) -> np.ndarray:
    """Which pairs have to be kept, so that sums over kept pairs give all distances.

    A pair goes if both legs over a third node are shorter than it and add up to it."""
    keep = np.isfinite(d) & ~np.eye(len(d), dtype=bool)
    if len(d) <= THINNED:
        most = d * (1 + 1e-12)
        for c in range(len(d)):
            to, on = d[:, c : c + 1], d[c : c + 1]
            keep &= ~((to + on <= most) & (to < d) & (on < d))
    return keep


def _bridges(cell: pa.Table) -> tuple[np.ndarray, ...]:
    """src, dst and w of the edges between its border nodes that stand for a cell."""
    src, dst, w = (cell.column(c).to_numpy() for c in ("src", "dst", "w"))
    borders = np.unique(src[cell.column("border").to_numpy(zero_copy_only=False)])
    block = Block(src, dst, w)
    d = _between(block, block.number(borders))
    a, b = np.nonzero(_thinned(d))
    return borders[a], borders[b], d[a, b]


def _across(key: tuple, cell: pa.Table, entries: pa.Table) -> pa.Table:
    """What the overlay needs of a cell: edges between its border nodes (run is null, src to node), and entries at them."""
    borders = np.unique(cell.column("src").to_numpy()[cell.column("border").to_numpy(zero_copy_only=False)])
    found = _solve(cell, entries)
    found = found.filter(pa.array(np.isin(found.column("node").to_numpy(), borders)))
    a, b, d = _bridges(cell)
    pairs = _table([(np.full(len(a), None, object), np.zeros(len(a), bool), b, d)])
    ends = pa.concat_arrays([pa.array(a), pa.nulls(found.num_rows, pa.int64())])
    return _of(key[0], pa.concat_tables([pairs, found])).append_column("src", ends)


def _asked(cells: DataFrame, at: DataFrame | None) -> DataFrame | None:
    """graph and block of the cells that hold nodes of `at`, stored."""
    return None if at is None else save(cells.join(at.select("node"), "node", "left_semi").select("graph", "block").distinct(), "asked")


def _over(marked: DataFrame, borders: DataFrame, entries: DataFrame, cells: DataFrame, shards: int, block_edges: int, rounds: int, places: DataFrame | None, cell_edges: int, asked: DataFrame | None = None) -> DataFrame:
    """The search through the overlay of border nodes; on the way down only cells of `asked`, if given."""
    of_asked = lambda rows: rows if asked is None else rows.join(asked, ["graph", "block"], "left_semi")
    inner = _inner(marked, borders)
    placed = save(entries.join(cells.hint("merge"), ["graph", "node"]).select("run", "graph", "reverse", "node", "d", F.lit(True).alias("fresh"), "block"), "placed")
    left = inner.select(F.col("graph").alias("g"), F.col("block").alias("b"), "src", "dst", "w", "border").groupBy("g", "b")
    found = save(left.cogroup(placed.groupBy("graph", "block")).applyInArrow(_across, f"{_FOUND}, src long"), "across")
    between = found.filter("run IS NULL").select("graph", "src", F.col("node").alias("dst"), F.col("d").alias("w"))
    overlay = between.unionByName(marked.filter("sb <> db").select("graph", "src", "dst", "w"))
    smaller = overlay.count() * 2 <= marked.count()
    to = None if asked is None else save(of_asked(borders).select("node").distinct(), "asked-borders")
    at = _search(overlay, found.filter("run IS NOT NULL").drop("src"), shards, max(block_edges, min(block_edges * LEVEL, BLOCK_EDGES)), rounds, places, cell_edges * LEVEL, smaller, to)
    met = at.join(of_asked(borders).hint("merge"), ["graph", "node"]).select("run", "graph", "reverse", "node", "d", F.lit(True).alias("fresh"), "block").unionByName(of_asked(placed)).withColumn("shard", _shard(shards))
    dealt = of_asked(inner).select(F.col("graph").alias("g"), F.col("block").alias("b"), "src", "dst", "w", _parts(shards)).groupBy("g", "b", "part")
    return dealt.cogroup(met.groupBy("graph", "block", "shard")).applyInArrow(lambda key, e, x: _of(key[0], _solve(e, x)), _FOUND)


def _blocks_of(edges: pa.Table, nodes: np.ndarray) -> np.ndarray:
    """The blocks of nodes at edges with sb and db."""
    ids, first = np.unique(np.concatenate([edges.column("src").to_numpy(), edges.column("dst").to_numpy()]), return_index=True)
    blocks = np.concatenate([edges.column("sb").to_numpy(), edges.column("db").to_numpy()])[first]
    return blocks[np.searchsorted(ids, nodes)] if len(nodes) else np.zeros(0, np.int64)


def _merged(state: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The least distance of each node, and whether it is news: found in another block, and nearer than what is known.

    What a block found for its own nodes has been carried on; what another found for them has not."""
    both = state.select(*keys, "d", F.lit(True).alias("known")).unionByName(found.select(*keys, "d", (F.col("by") == F.col("block")).alias("known")))
    least = both.groupBy(*keys).agg(F.min(F.when(F.col("known"), F.col("d"))).alias("own"), F.min(F.when(~F.col("known"), F.col("d"))).alias("other"))
    fresh = F.col("other").isNotNull() & (F.col("own").isNull() | (F.col("other") < F.col("own")))
    return least.select(*keys, F.least("own", "other").alias("d"), fresh.alias("fresh"))


def _held(marked: DataFrame, shards: int) -> DataFrame:
    """Edges by block: an edge belongs to its source's block; in searches towards the sources, to its target's."""
    way = F.explode(F.array(F.struct(F.lit(False).alias("reverse"), F.col("sb").alias("block")), F.struct(F.lit(True).alias("reverse"), F.col("db").alias("block")))).alias("way")
    return marked.select("graph", way, "src", "dst", "w", "sb", "db").select("graph", "way.*", _parts(shards), "src", "dst", "w", "sb", "db")


def _by_rounds(marked: DataFrame, blocks: DataFrame, entries: DataFrame, shards: int, rounds: int) -> DataFrame:
    """search over graphs of several blocks that hand distances on."""
    keys = ["graph", "reverse", "block", "shard"]
    held = _held(marked, shards).withColumnRenamed("part", "shard")
    held = save(held.join(entries.select("graph", "reverse").distinct(), ["graph", "reverse"], "left_semi"), "blocks")
    state = save(entries.join(blocks.hint("merge"), ["graph", "node"]).select("run", *keys[:3], _shard(shards), "node", "d", F.lit(True).alias("fresh")).distinct(), "distances")

    def solve(key, block: pa.Table, rows: pa.Table) -> pa.Table:
        found = _of(key[0], _solve(block, rows))
        own = pa.array(np.full(found.num_rows, key[2].as_py()), pa.int64())
        return found.append_column("block", pa.array(_blocks_of(block, found.column("node").to_numpy()), pa.int64())).append_column("by", own)

    for _ in range(rounds):
        active = state.filter("fresh").select(*keys).distinct()
        needed = held.join(active, keys, "left_semi").select(*[F.col(k).alias(f"{k}_") for k in keys], "src", "dst", "w", "sb", "db")
        found = needed.groupBy(*[f"{k}_" for k in keys]).cogroup(state.join(active, keys, "left_semi").groupBy(*keys)).applyInArrow(solve, f"{_FOUND}, block long, by long")
        state = save(_merged(state, found.withColumn("shard", _shard(shards)), ["run", *keys, "node"]), "distances")
        if not state.filter("fresh").take(1):
            return state.select("graph", "run", "reverse", "node", "d")
    raise RuntimeError(f"distances still changed after {rounds} rounds")


def _past_borders(key: tuple, edges: pa.Table, rows: pa.Table) -> pa.Table:
    """What fresh rows bring nearer at a block's borders, on both sides of them."""
    leaves, enters = (edges.column(c).to_numpy(zero_copy_only=False) for c in ("leaves", "enters"))
    back = rows.column("reverse").to_numpy(zero_copy_only=False)
    found = pa.concat_tables([_solve(edges.filter(pa.array(own)), rows.filter(pa.array(back == reverse))) for reverse, own in ((False, leaves), (True, enters))])
    over = ~(leaves & enters)
    at = np.unique(np.concatenate([edges.column(c).to_numpy()[over] for c in ("src", "dst")]))
    found = _of(key[0], found.filter(pa.array(np.isin(found.column("node").to_numpy(), at))))
    return found.append_column("by", pa.array(np.full(found.num_rows, key[1].as_py()), pa.int64()))


def _border_rounds(marked: DataFrame, borders: DataFrame, cells: DataFrame, entries: DataFrame, shards: int, rounds: int) -> tuple[DataFrame, bool]:
    """Distances of entries and border nodes, stored, after rounds of blocks that hand on what got nearer, and whether all is final.

    Blocks that got nothing nearer from another one are not visited."""
    keys = ["graph", "block", "shard"]
    own = ["run", *keys[:2], "reverse", "shard", "node"]
    held = marked.select("graph", F.explode(F.array_distinct(F.array("sb", "db"))).alias("block"), "src", "dst", "w", "sb", "db")
    held = held.select(*[F.col(k).alias(f"{k}_") for k in keys[:2]], "src", "dst", "w", (F.col("sb") == F.col("block")).alias("leaves"), (F.col("db") == F.col("block")).alias("enters"), _parts(shards).alias("shard_"))
    placed = entries.join(cells.hint("merge"), ["graph", "node"]).withColumn("shard", _shard(shards))
    state = save(placed.groupBy(*own).agg(F.min("d").alias("d")).withColumn("fresh", F.lit(True)), "at-borders")
    for _ in range(rounds):
        active = state.filter("fresh").select(*keys).distinct()
        needed = held.join(active.select(*[F.col(k).alias(f"{k}_") for k in keys]), [f"{k}_" for k in keys], "left_semi")
        found = needed.groupBy(*[f"{k}_" for k in keys]).cogroup(state.join(active, keys, "left_semi").groupBy(*keys)).applyInArrow(_past_borders, f"{_FOUND}, by long")
        state = save(_merged(state, found.join(borders.hint("merge"), ["graph", "node"]).withColumn("shard", _shard(shards)), own), "at-borders")
        if not state.filter("fresh").take(1):
            return state, True
    return state, False


def _by_borders(marked: DataFrame, borders: DataFrame, state: DataFrame, shards: int, asked: DataFrame | None = None) -> DataFrame:
    """All distances, or those in blocks of `asked`, from the final ones of entries and border nodes: each block is searched once."""
    of_asked = lambda rows: rows if asked is None else rows.join(asked, ["graph", "block"], "left_semi")
    known = of_asked(state).join(borders.select("graph", "node", F.lit(True).alias("border")).hint("merge"), ["graph", "node"], "left")
    known = save(known.select("run", "graph", "block", "shard", "reverse", "node", "d", F.lit(True).alias("fresh"), F.col("border").isNotNull().alias("border")), "known")
    inner = of_asked(marked.filter("sb = db").withColumnRenamed("sb", "block")).select(F.col("graph").alias("g"), F.col("block").alias("b"), "src", "dst", "w", _parts(shards))

    def inside(key: tuple, edges: pa.Table, rows: pa.Table) -> pa.Table:
        found, at = _solve(edges, rows), rows.column("node").to_numpy()[rows.column("border").to_numpy(zero_copy_only=False)]
        return _of(key[0], found.filter(pa.array(~np.isin(found.column("node").to_numpy(), at))))

    rest = inner.groupBy("g", "b", "part").cogroup(known.groupBy("graph", "block", "shard")).applyInArrow(inside, _FOUND)
    return rest.unionByName(known.filter("border").select("graph", "run", "reverse", "node", "d"))


def _lower(edges: pa.Table, rows: pa.Table) -> pa.Table:
    """run, reverse, node, d of what fresh rows lower. Rows without a run are the base's; all rows go one way."""
    reverse = bool(rows.column("reverse")[0].as_py())
    block = Block(*(edges.column(c).to_numpy() for c in (("dst", "src") if reverse else ("src", "dst"))), edges.column("w").to_numpy())
    run, of, node, d, fresh = (rows.column(c).to_numpy() for c in ("run", "of", "node", "d", "fresh"))
    place, base, n = block.number(node), np.array([r is None for r in run], bool), len(block.ids)
    found = [(np.zeros(0, object), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0))]
    for name in np.unique(of[~base]):
        ground = np.full(n, np.inf)
        mine = base & (of == name) & (place >= 0)
        ground[place[mine]] = d[mine]
        mine = np.flatnonzero(~base & (of == name) & (place >= 0))
        runs, number = np.unique(run[mine], return_inverse=True)
        most = max(1, STATES // max(n, 1))
        for low in range(0, len(runs), most):
            part = (number >= low) & (number < low + most)
            state, value, news = (number[part] - low) * n + place[mine[part]], d[mine[part]], fresh[mine[part]].astype(bool)
            dist = np.tile(ground, min(most, len(runs) - low))
            np.minimum.at(dist, state[~news], value[~news])
            nearer = news.copy()
            nearer[news] = value[news] < dist[state[news]]
            np.minimum.at(dist, state[nearer], value[nearer])
            start = np.unique(state[nearer])
            got = np.union1d(start, block.spread(dist, start))
            found.append((runs[low + got // n], np.full(len(got), reverse), block.ids[got % n], dist[got]))
    return _table(found)


def lowered(edges: DataFrame, base: DataFrame, extra: DataFrame, block_edges: int = BLOCK_EDGES, rounds: int = ROUNDS, places: DataFrame | None = None) -> DataFrame:
    """run, node, d of the nodes that extra edges bring nearer than they are in the base run.

    base: of, graph, reverse, node, d, as a search found them (of is its run). extra: run, of, graph, reverse, src, dst, w; a
    run may have several edges, and its ways may take any of them in turn. Only blocks in which something gets nearer are
    visited, with one copy of their edges for all runs."""
    edges, base = save(edges.select("graph", "src", "dst", "w"), "graphs"), base.select("of", "graph", "reverse", "node", "d")
    to, fro = (F.when(F.col("reverse"), F.col(a)).otherwise(F.col(b)) for a, b in (("src", "dst"), ("dst", "src")))
    ways = save(extra.select("run", "of", "graph", "reverse", fro.alias("fro"), to.alias("to"), "w"), "extra")
    large = _large(edges, block_edges)
    if large is None:
        place = lambda rows: rows.withColumn("block", F.lit(0).cast("long"))
        marked = edges.select("*", F.lit(0).cast("long").alias("sb"), F.lit(0).cast("long").alias("db"))
    else:
        blocks = numbered(edges, block_edges, places)
        place = lambda rows: rows.join(blocks.hint("merge"), ["graph", "node"])
        marked = with_blocks(edges, blocks)
    keys = ["graph", "reverse", "block"]
    held, ground = save(_held(marked, 1).drop("part"), "blocks"), save(place(base), "base")
    ends = ways.select("of", "graph", F.explode(F.array("fro", "to")).alias("node")).distinct()
    ends = save(ground.join(ends, ["of", "graph", "node"], "left_semi").select("of", "graph", "node", F.col("d").alias("known")), "ends")
    own = ["run", "of", *keys, "node"]

    def steps(at: DataFrame) -> DataFrame:
        """The extra edges' next entries from known distances (run, of, graph, node, d) of their ends, where they lower the base."""
        met = ways.join(at.select("run", F.col("node").alias("fro"), "d"), ["run", "fro"]).select("run", "of", "graph", "reverse", F.col("to").alias("node"), (F.col("d") + F.col("w")).alias("d"))
        better = met.join(ends, ["of", "graph", "node"], "left").filter(F.col("known").isNull() | (F.col("d") < F.col("known")))
        return place(better.drop("known")).select(*own, "d", F.lit(None).cast("long").alias("by"))

    first = ways.select("run", "of", "graph", F.col("fro").alias("node")).distinct().join(ends, ["of", "graph", "node"]).withColumnRenamed("known", "d")
    state = save(steps(first).groupBy(*own).agg(F.min("d").alias("d")).withColumn("fresh", F.lit(True)), "lowered")

    def solve(key, block: pa.Table, rows: pa.Table) -> pa.Table:
        found = _of(key[0], _lower(block, rows)) if rows.num_rows else _of(key[0], _table([(np.zeros(0, object), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0))]))
        by = pa.array(np.full(found.num_rows, key[2].as_py()), pa.int64())
        return found.append_column("block", pa.array(_blocks_of(block, found.column("node").to_numpy()), pa.int64())).append_column("by", by)

    of_run = ways.select("run", "of").distinct()
    for _ in range(rounds):
        if not state.filter("fresh").take(1):
            low = state.join(base.select("of", "graph", "node", F.col("d").alias("was")), ["of", "graph", "node"], "left")
            return low.filter(F.col("was").isNull() | (F.col("d") < F.col("was"))).select("run", "node", "d")
        active = state.filter("fresh").select(*keys).distinct()
        needed = held.join(active, keys, "left_semi").select(*[F.col(k).alias(f"{k}_") for k in keys], "src", "dst", "w", "sb", "db")
        rows = state.select("run", "of", *keys, "node", "d", "fresh").unionByName(ground.select(F.lit(None).cast("string").alias("run"), "of", *keys, "node", "d", F.lit(False).alias("fresh"))).join(active, keys, "left_semi")
        found = needed.groupBy(*[f"{k}_" for k in keys]).cogroup(rows.groupBy(*keys)).applyInArrow(solve, f"{_FOUND}, block long, by long")
        found = save(found.join(of_run, "run").select(*own, "d", "by"), "lower")
        news = found.unionByName(steps(found)).withColumn("by", F.coalesce("by", F.lit(-1)))
        state = save(_merged(state, news, own), "lowered")
    raise RuntimeError(f"distances still changed after {rounds} rounds")


def single_paths(edges: DataFrame, pairs: DataFrame, shards: int = 1, block_edges: int = BLOCK_EDGES, places: DataFrame | None = None) -> DataFrame:
    """run, nodes (array, origin first) and cost for pairs (run, graph, o, d); null where there is no way.

    Of equally cheap ways the one whose last differing step leaves the smaller node. A graph of up to block_edges edges is
    one task; in larger ones the ways are walked over stored distances (_walked)."""
    edges, pairs = save(edges.select("graph", "src", "dst", "w"), "graphs"), pairs.select("run", "graph", "o", "d")
    large = _large(edges, block_edges)
    if large is None:
        return _within(edges, pairs)
    small = _within(edges.join(large, "graph", "left_anti"), pairs.join(large, "graph", "left_anti"))
    edges, pairs = edges.join(large, "graph", "left_semi"), save(pairs.join(large, "graph", "left_semi"), "pairs")
    return small.unionByName(_walked(edges, pairs, shards, block_edges, places))


def _on_way(back: Block, dist: np.ndarray, ends: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """States on cheapest ways to some states: steps back that use up the distance. back has the edges turned; slack by run."""
    n, seen, near = len(back.ids), np.zeros(len(dist), bool), np.unique(ends)
    while len(near):
        seen[near] = True
        node = near % n
        begin = back.start[node]
        many = back.start[node + 1] - begin
        edge = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        to, here = np.repeat(near - node, many) + back.head[edge], np.repeat(dist[near], many)
        with np.errstate(invalid="ignore"):
            tight = np.abs(dist[to] + back.w[edge] - here) <= slack[to // n]
        near = np.unique(to[tight & ~seen[to]])
    return np.flatnonzero(seen)


_ON_WAYS = "run string, graph string, node long, gone double, cost double"


def _way_rows(graph: pa.Scalar, found: list[tuple]) -> pa.Table:
    run, node, gone, cost = (np.concatenate(c) for c in zip((np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)), *found, strict=True))
    return pa.table({"run": pa.array(run, pa.string()), "graph": pa.array([graph.as_py()] * len(run), pa.string()), "node": node, "gone": gone, "cost": cost})


def _ways_of_pairs(key: tuple, edges: pa.Table, pairs: pa.Table) -> pa.Table:
    """The nodes on cheapest ways of pairs in one graph; each pair's search ends at its target."""
    src, dst, w = (edges.column(c).to_numpy() for c in ("src", "dst", "w"))
    block, back, found = Block(src, dst, w), Block(dst, src, w), []
    ends = zip(pairs.column("run").to_pylist(), block.number(pairs.column("o").to_numpy()), block.number(pairs.column("d").to_numpy()), strict=True)
    for run, a, b in ends:
        if a < 0 or b < 0:
            continue
        dist = np.full(len(block.ids), np.inf)
        dist[a] = 0.0
        block.spread(dist, np.array([a]), int(b))
        if np.isfinite(dist[b]):
            on = _on_way(back, dist, np.array([b]), np.array([(dist[b] + 1) * ROUNDING]))
            found.append((np.full(len(on), run, object), block.ids[on], dist[on], np.full(len(on), dist[b])))
    return _way_rows(key[0], found)


def _ways_in_cell(key: tuple, cell: pa.Table, rows: pa.Table) -> pa.Table:
    """The nodes inside a cell on cheapest ways between border nodes that lie on them (run, node, gone, cost)."""
    if not rows.num_rows:
        return _way_rows(key[0], [])
    src, dst, w = (cell.column(c).to_numpy() for c in ("src", "dst", "w"))
    block, back, found = Block(src, dst, w), Block(dst, src, w), []
    run, node, gone, cost = (rows.column(c).to_numpy() for c in ("run", "node", "gone", "cost"))
    runs, first, number = np.unique(run, return_index=True, return_inverse=True)
    n, place, whole = len(block.ids), block.number(node), cost[first]
    most = max(1, STATES // n)
    for low in range(0, len(runs), most):
        part = (number >= low) & (number < low + most)
        state, costs = (number[part] - low) * n + place[part], whole[low : low + most]
        dist = np.full(len(costs) * n, np.inf)
        np.minimum.at(dist, state, gone[part])
        block.spread(dist, np.unique(state))
        on = _on_way(back, dist, state, (costs + 1) * ROUNDING)
        found.append((runs[low + on // n], block.ids[on % n], dist[on], costs[on // n]))
    return _way_rows(key[0], found)


def _from_both_ends(edges: DataFrame, pairs: DataFrame, shards: int, block_edges: int, places: DataFrame | None) -> DataFrame:
    """_on_ways in graphs that are nearly all border: searched whole from both ends, a node is on a cheapest way where both
    distances add up to the whole cost."""
    away = F.concat(F.lit("o"), "run").alias("run"), "graph", F.lit(False).alias("reverse"), F.col("o").alias("node")
    back = F.concat(F.lit("d"), "run").alias("run"), "graph", F.lit(True).alias("reverse"), F.col("d").alias("node")
    found = save(_search(edges, _entries(pairs.select(*away).unionAll(pairs.select(*back))), shards, block_edges, ROUNDS, places, CELL_EDGES), "both-ends")
    side = lambda letter, name: found.filter(F.substring("run", 1, 1) == letter).select(F.expr("substring(run, 2)").alias("run"), "graph", "node", F.col("d").alias(name))
    gone, left = side("o", "gone"), side("d", "left")
    costs = save(gone.withColumnRenamed("node", "d").join(pairs, ["run", "graph", "d"]).select("run", F.col("gone").alias("cost")), "costs")
    near = gone.join(left, ["run", "graph", "node"]).join(costs, "run").filter(F.col("gone") + F.col("left") <= F.col("cost") + (F.col("cost") + 1) * ROUNDING)
    return near.select("run", "graph", "node", "gone", "cost")


def _on_ways(edges: DataFrame, pairs: DataFrame, shards: int, block_edges: int, places: DataFrame | None, task_edges: int, cell_edges: int) -> DataFrame:
    """run, graph, node, gone, cost, stored: the nodes on cheapest ways of pairs (run, graph, o, d), and how far they are from o.

    Graphs of up to task_edges are searched pair by pair. Others get an overlay of their cells' border nodes and of the pairs'
    ends; where the overlay's nodes on a way are known, only the cells they lie in are searched, from them. So what is visited
    below the last overlay grows with the length of ways, not with nodes times pairs."""
    large = _large(edges, task_edges)
    few = max(shards, -(-pairs.count() // 200))  # at most so many pairs a task, as hashes deal them

    def one_task(edges: DataFrame, pairs: DataFrame) -> DataFrame:
        dealt = edges.select(F.col("graph").alias("g"), "src", "dst", "w", _parts(few)).groupBy("g", "part")
        return dealt.cogroup(pairs.select("run", "graph", "o", "d", _shard(few)).groupBy("graph", "shard")).applyInArrow(lambda key, e, p: _ways_of_pairs(key, e, p), _ON_WAYS)

    if large is None:
        return save(one_task(edges, pairs), "on-ways")
    small = one_task(edges.join(large, "graph", "left_anti"), pairs.join(large, "graph", "left_anti"))
    edges, pairs = edges.join(large, "graph", "left_semi"), pairs.join(large, "graph", "left_semi")
    marked, borders, cells = _cells(edges, cell_edges, places, pairs.select("graph", F.explode(F.array("o", "d")).alias("node")).distinct())
    if borders.count() * OVERLAY_SHARE > cells.count():
        return save(small.unionByName(_from_both_ends(edges, pairs, shards, block_edges, places)), "on-ways")
    inner = _inner(marked, borders)
    bridges = lambda key, cell: pa.table({"graph": pa.array([key[0].as_py()] * len((b := _bridges(cell))[0]), pa.string()), "src": b[0], "dst": b[1], "w": b[2]})
    between = save(inner.groupBy("graph", "block").applyInArrow(bridges, "graph string, src long, dst long, w double"), "bridges")
    overlay = between.unionByName(marked.filter("sb <> db").select("graph", "src", "dst", "w"))
    at = _on_ways(overlay, pairs, shards, block_edges, places, BLOCK_EDGES, cell_edges * LEVEL)
    held = at.join(cells.hint("merge"), ["graph", "node"]).select("run", "graph", "node", "gone", "cost", "block")
    left = inner.select(F.col("graph").alias("g"), F.col("block").alias("b"), "src", "dst", "w").groupBy("g", "b")
    return save(small.unionByName(left.cogroup(held.groupBy("graph", "block")).applyInArrow(lambda key, e, x: _ways_in_cell(key, e, x), _ON_WAYS)), "on-ways")


def _walked(edges: DataFrame, pairs: DataFrame, shards: int, block_edges: int, places: DataFrame | None) -> DataFrame:
    """single_paths in graphs of many blocks: the edges between nodes on a pair's cheapest ways that use up their distance are
    walked back from the target."""
    near = _on_ways(edges, save(pairs.filter("o <> d"), "apart"), shards, block_edges, places, block_edges, min(block_edges, CELL_EDGES))
    costs = near.groupBy("run").agg(F.max("cost").alias("cost"))
    slack = (F.col("cost") + 1) * ROUNDING
    tail, head = near.select("run", "graph", F.col("node").alias("src"), F.col("gone").alias("a"), "cost"), near.select("run", "graph", F.col("node").alias("dst"), F.col("gone").alias("b"))
    tight = edges.join(tail.hint("merge"), ["graph", "src"]).join(head.hint("merge"), ["run", "graph", "dst"]).filter(F.abs(F.col("a") + F.col("w") - F.col("b")) <= slack)
    steps = tight.select("run", "src", "dst", (F.col("a") >= F.col("b")).alias("level")).distinct().join(pairs.select("run", "o", "d"), "run")

    def walk(rows: pa.Table) -> pa.Table:
        into: dict[int, list[tuple[bool, int]]] = {}
        for src, dst, level in zip(*(rows.column(c).to_pylist() for c in ("src", "dst", "level")), strict=True):
            into.setdefault(dst, []).append((level, src))
        o, way, seen = rows.column("o")[0].as_py(), [rows.column("d")[0].as_py()], set()
        while way and way[-1] != o:  # steps that cost nothing may lead round; they come last, and dead ends are left
            seen.add(way[-1])
            on = [(level, v) for level, v in into.get(way[-1], []) if v not in seen]
            way = [*way, min(on)[1]] if on else way[:-1]
        return pa.table({"run": rows.column("run").slice(0, 1), "nodes": pa.array([way[::-1]], pa.list_(pa.int64()))})

    ways = steps.groupBy("run").applyInArrow(walk, "run string, nodes array<long>")  # a group is what lies on one pair's cheapest ways
    here = pairs.filter("o = d").select("run", F.array("o").alias("nodes"), F.lit(0.0).alias("cost"))
    return here.unionByName(pairs.filter("o <> d").select("run").join(ways, "run", "left").join(costs, "run", "left").select("run", "nodes", "cost"))


def _within(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """single_paths in graphs of one block each."""

    def way(block: Block, back: Block, o: int, d: int) -> tuple[list[int], float] | None:
        a, b = block.number(np.array([o, d]))
        if a < 0 or b < 0:
            return None
        dist = np.full(len(block.ids), np.inf)
        dist[a] = 0.0
        block.spread(dist, np.array([a]), int(b))
        if not np.isfinite(dist[b]):
            return None
        found = [b]
        while found[-1] != a:  # the edge into a node that gave it its distance
            v = found[-1]
            into = slice(back.start[v], back.start[v + 1])
            found.append(int(back.head[into][np.flatnonzero(dist[back.head[into]] + back.w[into] == dist[v])[0]]))
        return [int(block.ids[k]) for k in reversed(found)], float(dist[b])

    def solve(e: pa.Table, p: pa.Table) -> pa.Table:
        src, dst, w = (e.column(c).to_numpy() for c in ("src", "dst", "w"))
        block, back = Block(src, dst, w), Block(dst, src, w)
        ways = [([o], 0.0) if o == d else way(block, back, o, d) for o, d in zip(p.column("o").to_pylist(), p.column("d").to_pylist(), strict=True)]
        return pa.table({"run": p.column("run"), "nodes": pa.array([x and x[0] for x in ways], pa.list_(pa.int64())), "cost": pa.array([x and x[1] for x in ways], pa.float64())})

    own = edges.select(F.col("graph").alias("g"), "src", "dst", "w")
    return own.groupBy("g").cogroup(pairs.select("run", "graph", "o", "d").groupBy("graph")).applyInArrow(solve, "run string, nodes array<long>, cost double")


def by_component(edges: DataFrame, sources: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, sources) with each component (node_id, comp) of a graph as a graph of its own; results are the same."""
    named = F.concat_ws("#", "graph", F.col("comp").cast("string"))
    of = lambda c: components.select(F.col("node_id").alias(c), "comp")
    parts = edges.join(of("src"), "src").select(named.alias("graph"), "src", "dst", "w")
    return parts, sources.join(of("node"), "node").select("run", named.alias("graph"), "reverse", "node")
