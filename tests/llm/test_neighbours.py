"""Nearest-neighbour votes against brute force, and on held-out labels."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewalk.llm import neighbours

SCHEMA = "doc_id long, text string, _0 string, ids string, score string"
SF = "/root/testdata/sf0.01"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def scored(spark, rows, labels):
    docs = spark.createDataFrame(rows, SCHEMA)
    bags, space = neighbours.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, text string"), [F.col("doc_id"), neighbours.held_out()])
    return neighbours.vote(bags, space).select("_0", "_1", "score").collect(), space


def awkward():
    good = [(i, f"Plain words of entry {'one two three four'.split()[i % 4]} stand here, line {i}.\nAnd more of them.", "x", "y", "z") for i in range(60)]
    bad = [(100 + i, f"BUY!! NOW!! {i} | | $$$ ### menu | home | {'top ' * (i % 7)}", "x", "y", "z") for i in range(40)]
    odd = [(200, None, None, None, None), (201, "", None, None, None), (None, good[0][1], None, None, None), (None, None, None, None, None), (202, "long " * 30_000, None, None, None), bad[3], bad[3], good[1]]
    labels = [(i, 1, None) for i in range(60)] + [(100 + i, 0, None) for i in range(40)] + [(3, 0, None), (None, 1, None), (5, None, None), (999, 1, None)]
    return good + bad + odd, labels


def test_votes_of_awkward_rows(spark):
    rows, labels = awkward()
    got, _ = scored(spark, rows, labels)
    assert sorted((r[0] is None, r[0]) for r in got if r[0] is not None) == sorted((False, r[0]) for r in rows if r[0] is not None) and len(got) == len(rows)
    assert all(0 <= r[2] <= 1 and r[1] == held(r[0]) for r in got)
    of = {r[0]: r[2] for r in got}
    assert all(of[i] >= 0.3 for i in range(60) if i not in (3,)) and all(of[100 + i] < 0.3 for i in range(40))
    assert scored(spark, [], labels)[0] == []
    assert {r[2] for r in scored(spark, rows, [])[0]} == {0.5}
    assert all(r[2] > 0.99 for r in scored(spark, rows, [(i, 1, None) for i in range(60)])[0])


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = awkward()
    flipped = [(i, 1 - q if held(i) and q is not None else q, t) for i, q, t in labels]
    one, other = (sorted(map(repr, scored(spark, rows, x)[0])) for x in (labels, flipped))
    assert one == other


def test_scores_match_one_by_one_voting():
    rnd = np.random.default_rng(3)
    bags = [([int(k) for k in np.flatnonzero(rnd.random(40) < 0.2)], None) for _ in range(120)]
    bags = [(ids, [float(np.float32(rnd.random())) for _ in ids]) for ids, _ in bags]
    marks = [int(m) for m in rnd.integers(0, 2, 90)]
    space = neighbours.fit(bags[:90], marks, np.arange(1, 41), 200, 12)
    order = sorted(range(90), key=lambda r: (bags[r], marks[r]))
    place = [np.array(space.place([b])[0], float) for b in bags]
    for r, got in enumerate(space.scores(bags, 7)):
        near = sorted(((max(float(place[r] @ place[k]), 0), marks[k]) for k in order), reverse=True)
        votes = [(s**neighbours.POWER, m) for s, m in near if s >= near[6][0] - 1e-5]
        want = (sum(v * m for v, m in votes) + 1e-3 * space.prior) / (sum(v for v, _ in votes) + 1e-3)
        assert math.isclose(got, want, abs_tol=2e-3)


def test_shapes_and_steps():
    assert [neighbours.shape(t) for t in ("word", "Word", "WORD!!", "a1b2", "x###", "|", "Été,")] == ["a", "Aa", "A!", "a0a0", "a#", "|", "Aa,"]
    bag = neighbours.Terms().bag("Rech.\nRech.\nRech.\nx")
    assert bag["length:3"] == bag["top:8"] == bag["lines:5"] == bag["beside:5"] == 1.0 and bag["s:Aa."] == math.sqrt(3 / 4)


def test_quality_on_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = neighbours.op13_quality_neighbours(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    own = [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for y, s, _ in own if y], [s for y, s, _ in own if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97 and np.mean([p for y, _, p in own if y]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


@pytest.mark.parametrize("share", [0.0, 0.05, 0.1, 0.55, 1.0])
def test_steps_are_tenths(share):
    assert neighbours._step("n", share) == f"n:{min(10, math.ceil(10 * share))}"
