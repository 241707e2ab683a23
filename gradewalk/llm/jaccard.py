"""N-gram Jaccard join by a MinHash LSH forest.

1. Each text becomes its set of five-word shingles (lower case, 64-bit hashes). Documents with equal sets form one class
   and go on as one member with a weight, so exact copies are never paired with each other.
2. Each class has TREES labels of DEPTH min-hash values. A tree is a trie over one label: its members sorted by label,
   where members below one node stand side by side. Members that share the shortest prefix any of them needs are dealt
   to a task, which holds a whole subtrie.
3. The search begins at whole labels and shortens the matched prefix value by value. At each length only those are
   compared that meet there for the first time and that no chain of links ties yet. How far a member's prefix is
   shortened depends on the least similarity at or over the threshold that its size allows (`hardest`): it stops once a
   pair as unlike as that meets in some tree with at least the target recall (`prefix_depth`). Sets of up to three
   shingles have no partner but their equals and don't enter; sets of seven, whose nearest partner shares six sevenths, stop
   at a longer prefix than large sets. The rule looks at sizes only: were the length chosen by how full a node is, pairs would be
   missed just where they meet.
4. Members that meet and whose sketches (all VALUES, a byte of each) are not far below the threshold are linked; links
   form a spanning forest, so a node emits less rows than it has members. Components of links are clusters. A pair that
   met in a tree is in one cluster unless its sketch is off by more than SLACK, 5 standard deviations (under 1e-6).
5. Each cluster's texts are fetched once, and all its pairs are verified exactly on their shingle sets. What leaves a
   task is one row a member: its links and its component, not its pairs.

Nodes and clusters over a size are cut into blocks, and each pair of blocks is a task of bounded memory; no candidate is
dropped. Links of a member are counted over documents: all others with a Jaccard similarity of at least the threshold.

Defined results: texts of one to four words are one shingle; texts without words (null, empty) have equal, empty sets
and form one class without further links; a class without any id has class_id null; rows with null or repeated ids are
documents of their own; columns of any name are carried in a struct and can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.llm.bloom import may_be_in
from gradewalk.llm.common import SPACE_CHARS, save, table, text_or_empty, whole_row
from gradewalk.llm.components import components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
TREES, DEPTH = 16, 8
VALUES = TREES * DEPTH
#: How far a sketch's estimate may lie below the threshold: 5 standard deviations.
SLACK = 5 * (THRESHOLD * (1 - THRESHOLD) / VALUES) ** 0.5
#: Members of a block of a trie node, shingles of a block of a cluster, members of such a block.
NODE_BLOCK, SET_BLOCK, MEMBER_BLOCK = 1024, 2_000_000, 2048
SMALL = 48
#: Larger sets can have a partner at the threshold itself, or so near to it that the prefix is the same.
HARDEST_UPTO = 64
_SPACES = str.maketrans({c: " " for c in SPACE_CHARS})
_NO_ID = (1 << 63) - 1

_random = np.random.RandomState(20240229)
_MULTIPLY = _random.randint(0, 1 << 62, VALUES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.randint(0, 1 << 62, VALUES).astype(np.uint64)


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of this similarity meets in some tree with at least this probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def hardest(n: int, threshold: float = THRESHOLD) -> float | None:
    """The least similarity, at or over the threshold, of a set of n with another set of any size; None if there is none."""
    found = []
    for m in range(math.ceil(threshold * n - 1e-9), math.floor(n / threshold + 1e-9) + 1):
        both = math.ceil(threshold * (n + m) / (1 + threshold) - 1e-9)
        if both <= min(n, m) and n + m > 2 * both:
            found.append(both / (n + m - both))
    return min(found, default=None)


def depths(recall: float = RECALL) -> np.ndarray:
    """By size (the last for all larger ones) the prefix that a member's search ends at; DEPTH + 1 for those without partners."""
    found = [DEPTH + 1 if (s := hardest(n)) is None else prefix_depth(s, recall=recall) for n in range(HARDEST_UPTO)]
    return np.array([*found, prefix_depth(recall=recall)])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of a text; hashes of words are remembered."""

    def __init__(self, most: int = 150_000):
        self.known, self.most = {}, most

    def __call__(self, text: str) -> np.ndarray:
        known, words = self.known, [w for w in text.lower().translate(_SPACES).split(" ") if w]
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(len(h) - SHINGLE + 1, min(len(h), 1))
        found = np.full(n, len(h) if len(h) < SHINGLE else SHINGLE, np.uint64)
        for k in range(min(len(h), SHINGLE)):
            found = _mix(found * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        return np.unique(found)


def labels(shingles: np.ndarray) -> np.ndarray:
    """VALUES min-hash values, 16 bits each; a tree's label is DEPTH of them in order."""
    least = np.full(VALUES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        np.minimum(least, (part[None] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1), out=least)
    return (_mix(least) >> np.uint64(48)).astype(np.uint16)


def signatures(docs: DataFrame) -> DataFrame:
    """did, tkey (the text's digest), cls (the shingle set's digest), n_shingles and tries (the labels) of every row."""
    schema = pa.schema([("did", pa.int64()), ("tkey", pa.binary()), ("cls", pa.binary()), ("n_shingles", pa.int64()), ("tries", pa.binary())])

    def run(batches):
        shingle = Shingler()
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part, cls, n, tries = b.slice(at, 1024), [], [], []
                for t in part.column(2):
                    s = shingle(t.as_py())
                    cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                    n.append(len(s))
                    tries.append(labels(s).astype(">u2").tobytes() if len(s) else b"")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(tries, pa.binary())], schema=schema)

    return _keyed(docs).select("did", "tkey", "text").mapInArrow(run, "did long, tkey binary, cls binary, n_shingles long, tries binary")


def _keyed(docs: DataFrame, *more) -> DataFrame:
    """did (null ids last), tkey and text."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"), text_or_empty().alias("text"), *more)
    return base.withColumn("tkey", F.unhex(F.md5("text")))


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by keys; several small groups at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        new = bool(held) and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in keys)
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if held and (new or last):
            first = 0 if new else int(np.flatnonzero(change)[0])
            yield pa.Table.from_batches([*held, b.slice(0, first)])
            held = []
            if last > first:
                yield pa.Table.from_batches([b.slice(first, last - first)])
        elif last:
            yield pa.Table.from_batches([b.slice(0, last)])
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while (root[root] != root).any():
            root = root[root]
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where groups begin, and the end."""
    change = np.zeros(len(keys[0]), bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(change), [len(change)]])


def near(label: np.ndarray, sketch: np.ndarray, sizes: np.ndarray, last: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A root for each member: roots tie together all pairs whose sketches and sizes allow the threshold and that meet.

    starts delimits subtries, label is sorted within each; two members meet where a prefix of both, no shorter than
    either's last, agrees. From long prefixes to short ones, pairs are compared where they first meet, unless tied."""
    least, n = int(np.ceil((THRESHOLD - SLACK) * VALUES)), len(sizes)
    root, found_a, found_b = np.arange(n), [], []
    change = np.zeros((n, label.shape[1] + 1), bool)  # by prefix length: a member's prefix is not that of the one before
    change[starts[:-1]] = True
    change[1:, 1:] |= np.logical_or.accumulate(label[1:] != label[:-1], axis=1)
    change[1:, 1:] |= change[1:, :1]
    longer = np.arange(n)  # nodes of the prefix one value longer

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fits = np.flatnonzero(np.minimum(sizes[a], sizes[b]) >= THRESHOLD * np.maximum(sizes[a], sizes[b]))
        return fits[(sketch[a[fits]] == sketch[b[fits]]).sum(axis=1) >= least]

    for depth in range(label.shape[1], int(last.min(initial=label.shape[1])) - 1, -1):
        every = np.cumsum(change[:, depth]) - 1
        m = np.flatnonzero(last <= depth)
        bounds = _runs([every[m]]) if len(m) else np.zeros(1, np.int64)
        lengths = np.diff(bounds)
        node, before = every[m], longer[m]
        small = np.repeat(lengths <= SMALL, lengths)
        for shift in range(1, int(lengths[lengths <= SMALL].max(initial=1))):
            k = np.flatnonzero(small[:-shift] & (node[shift:] == node[:-shift]) & (before[shift:] != before[:-shift]) & (root[m[shift:]] != root[m[:-shift]]))
            a, b = m[k], m[k + shift]
            ok = alike(a, b)
            found_a.append(a[ok])
            found_b.append(b[ok])
        for k in np.flatnonzero(lengths > SMALL):
            part, child = m[bounds[k] : bounds[k + 1]], before[bounds[k] : bounds[k + 1]]
            tied = root[part].copy()
            for i in range(len(part) - 1):
                rest = np.flatnonzero((tied[i + 1 :] != tied[i]) & (child[i + 1 :] != child[i])) + i + 1
                j = rest[alike(np.full(len(rest), part[i]), part[rest])]
                if len(j):
                    met, first = np.unique(tied[j], return_index=True)
                    found_a.append(np.full(len(met), part[i]))
                    found_b.append(part[j[first]])
                    tied[np.isin(tied, met)] = tied[i]
        if found_a:
            root = _roots(n, np.concatenate(found_a), np.concatenate(found_b))
            tied = np.flatnonzero(root != np.arange(n))
            found_a, found_b = [tied], [root[tied]]
        longer = every
    return root


def candidate_links(classes: DataFrame, last: np.ndarray) -> DataFrame:
    """Edges (a, b) between members' ids that tie together all pairs that meet in some tree.

    last: by size, the prefix that a member's search ends at (see depths)."""
    shortest = int(last.min())
    label = lambda t: F.substring("tries", t * 2 * DEPTH + 1, 2 * DEPTH)
    alone = [n for n in range(len(last)) if last[n] > DEPTH]
    members = classes.filter(~F.col("n_shingles").isin(*alone)).select("v", "n_shingles", "tries")
    prefix = lambda t: F.substring("tries", t * 2 * DEPTH + 1, 2 * shortest)
    nodes = members.select("v", F.posexplode(F.array(*[F.xxhash64(F.lit(t), prefix(t)) for t in range(TREES)])).alias("tree", "node"))
    shared = save(nodes.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "shared-nodes")  # saved: a hot node's partition can be split in the join
    blocks = F.ceil(F.col("n") / NODE_BLOCK).cast("int")
    rows = nodes.join(shared, "node").withColumn("blocks", blocks)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("v", "tree", "node", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    met = rows.join(members, "v").withColumn("label", F.element_at(F.array(*[label(t) for t in range(TREES)]), F.col("tree") + 1)).drop("tree")

    def run(batches):
        for t in _grouped(batches, ["node", "lo", "hi"]):
            starts = _runs([t.column(c).to_numpy() for c in ("node", "lo", "hi")])
            v, sizes = t.column("v").to_numpy(), t.column("n_shingles").to_numpy()
            sketch = np.frombuffer(b"".join(t.column("tries").to_pylist()), np.uint8).reshape(len(v), VALUES, 2)[:, :, 1]
            sorted_label = np.frombuffer(b"".join(t.column("label").to_pylist()), ">u2").reshape(len(v), DEPTH)
            root = near(sorted_label, np.ascontiguousarray(sketch), sizes, last[np.minimum(sizes, len(last) - 1)], starts)
            tied = np.flatnonzero(root != np.arange(len(v)))
            yield pa.RecordBatch.from_arrays([pa.array(v[tied]), pa.array(v[root[tied]])], names=["a", "b"])

    return met.repartition("node", "lo", "hi").sortWithinPartitions("node", "lo", "hi", "label").mapInArrow(run, "a long, b long")


def linked(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (row, col) of sets with at least this Jaccard similarity, exactly; a block of rows at a time.

    Shingles that many sets hold are counted by a matrix product, the others over their postings."""
    sizes = np.array([len(s) for s in sets])
    whole = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, shingle, often = np.unique(whole, return_inverse=True, return_counts=True)
    several = often[shingle] > 1
    shingle, owner = shingle[several], owner[several]
    place = np.full(len(sets), -1)
    place[cols] = np.arange(len(cols))
    dense = often > max(64, len(sets) // 16)
    number = np.cumsum(dense) - 1
    m = np.zeros((len(sets), int(dense.sum())), np.float32)
    d = dense[shingle]
    m[owner[d], number[shingle[d]]] = 1
    shingle, owner = shingle[~d], owner[~d]
    in_cols = place[owner] >= 0
    order = np.argsort(shingle[in_cols], kind="stable")
    posting = place[owner[in_cols][order]]
    ends = np.searchsorted(shingle[in_cols][order], np.arange(len(often) + 1))
    first = np.searchsorted(owner, np.arange(len(sets) + 1))
    step = max(1, 4_000_000 // max(len(cols), 1))
    for at in range(0, len(rows), step):
        block = rows[at : at + step]
        both = m[block] @ m[cols].T if m.shape[1] else np.zeros((len(block), len(cols)), np.float32)
        for k, r in enumerate(block.tolist()):
            own = shingle[first[r] : first[r + 1]]
            n = ends[own + 1] - ends[own]
            if total := int(n.sum()):
                inside = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                both[k] += np.bincount(posting[np.repeat(ends[own], n) + inside], minlength=len(cols))
        union = sizes[block][:, None] + sizes[cols][None] - both
        i, j = np.nonzero((both >= threshold * union - 1e-9) & (both > 0))
        yield block[i], cols[j]


def verify(sets: list[np.ndarray], weights: np.ndarray, block: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the sets linked to each, and the root index of each: within one block, or between two."""
    links, a, b = np.zeros(len(sets), np.int64), [], []
    rows, cols = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    root = np.arange(len(sets))
    for i, j in linked(sets, rows, cols):
        i, j = i[i != j], j[i != j]
        np.add.at(links, i, weights[j])
        if lo != hi:
            np.add.at(links, j, weights[i])
        new = root[i] != root[j]
        if new.any():
            a.append(i[new])
            b.append(j[new])
            root = _roots(len(sets), np.concatenate(a), np.concatenate(b))
            here = np.flatnonzero(root != np.arange(len(sets)))
            a, b = [here], [root[here]]
    return links, root


def verified(docs: DataFrame, classes: DataFrame, clusters: DataFrame) -> DataFrame:
    """cls, links and root (cls) of every class in a cluster; a class in a cut cluster has a row for each task."""
    members = clusters.withColumnRenamed("component", "cluster").join(classes.select("v", "cls", "did", "tkey", "n_docs", "n_shingles"), "v")
    members = save(members, "cluster-members")
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n_shingles") / SET_BLOCK), F.ceil(F.count("*") / MEMBER_BLOCK)).cast("int").alias("blocks"))
    sizes = save(sizes, "cluster-sizes")
    cut = members.join(sizes, "cluster").select("cluster", "cls", "did", "tkey", "n_docs", "blocks", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"))
    wanted = _keyed(docs).filter(may_be_in(members, ["did", "tkey"]))  # else every text would be shuffled for a few
    texts = cut.join(wanted, ["did", "tkey"])
    tasks = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "blocks", "cls", "n_docs", "text")
    schema = pa.schema([("cls", pa.binary()), ("links", pa.int64()), ("root", pa.binary()), ("whole", pa.bool_())])

    def run(batches):
        shingle = Shingler()
        for t in _grouped(batches, ["cluster", "lo", "hi"]):
            keys = [t.column(c).to_numpy() for c in ("cluster", "lo", "hi")]
            starts = _runs(keys)
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                part = t.slice(s, e - s)
                cls = part.column("cls").to_pylist()
                one = sorted({c: k for k, c in enumerate(cls)}.values())  # a repeated row brings its class again
                part, cls = part.take(one), [cls[k] for k in one]
                sets = [shingle(x.as_py()) for x in part.column("text")]
                links, root = verify(sets, part.column("n_docs").to_numpy(), part.column("block").to_numpy(), int(keys[1][s]), int(keys[2][s]))
                whole = pa.array(part.column("blocks").to_numpy() == 1)
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(links), pa.array([cls[r] for r in root.tolist()], pa.binary()), whole], schema=schema)

    return tasks.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi").mapInArrow(run, "cls binary, links long, root binary, whole boolean")


def classify(docs: DataFrame, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows of signatures; classes with cls, did, tkey, n_docs, links, label (the class it belongs to)."""
    rows = save(signatures(docs), "signatures")
    classes = rows.groupBy("cls").agg(F.min(F.struct("did", "tkey")).alias("first"), F.count("*").alias("n_docs"), F.first("n_shingles").alias("n_shingles"), F.first("tries").alias("tries"))
    classes = save(classes.select("cls", F.xxhash64("cls").alias("v"), "first.did", "first.tkey", "n_docs", "n_shingles", "tries"), "classes")
    clusters = components(candidate_links(classes, depths(recall)))
    found = save(verified(docs, classes, clusters), "verified")
    parts = components(found.filter("NOT whole").select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("v", "cls")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"), F.min(F.when(F.col("whole"), F.col("root"))).alias("root"))
    links = links.join(parts, "cls", "left").select("cls", "links", F.coalesce("root", "component").alias("root"))
    own = classes.drop("v", "tries").join(links, "cls", "left")
    return rows, save(own.select("cls", "did", "tkey", "n_docs", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cls").alias("label")), "labelled-classes")


def join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (the least id of the documents that chains of links connect), n_links and n_copies of every row."""
    rows, classes = classify(docs, recall)
    ids = classes.groupBy("label").agg(F.min("did").alias("class_id"))
    known = classes.join(ids, "label").select("cls", "class_id", (F.col("links") + F.col("n_docs") - 1).alias("n_links"), (F.col("n_docs") - 1).alias("n_copies"))
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    found = rows.select("did", "cls").join(known, "cls")
    return found.select(real("did").alias("doc_id"), real("class_id"), "n_links", "n_copies")


def keep_one(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """docs without near copies: of each class the document of least id (then least text digest) stays, once."""
    rows, classes = classify(docs, recall)
    kept = classes.groupBy("label").agg(F.min(F.struct("did", "tkey")).alias("first")).select("first.*", F.lit(True).alias("kept"))
    seen = rows.groupBy("did", "tkey").agg(F.count("*").alias("n")).join(kept, ["did", "tkey"], "left")
    doubtful = save(seen.filter("kept IS NULL OR n > 1").select("did", "tkey", "kept"), "doubtful")
    # most rows are neither dropped nor repeated: only those that may be are shuffled
    texts = _keyed(docs, whole_row(docs).alias("row"))
    doubted = may_be_in(doubtful, ["did", "tkey"])
    some = texts.filter(doubted).join(doubtful.withColumn("doubted", F.lit(True)), ["did", "tkey"], "left")
    fine = some.filter("doubted IS NULL").select("row.*")
    once = some.filter("kept").groupBy("did", "tkey").agg(F.first("row").alias("row")).select("row.*")
    return texts.filter(~doubted).select("row.*").unionAll(fine).unionAll(once)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))
