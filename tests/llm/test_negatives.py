"""Hard negatives against brute force, on small awkward tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewalk.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, key string, leaf int"


def brute(rows, anchor, positives=5, negative=3, low=50, high=95):
    kept = {(i, c, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v, c, *_ in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out, score = [], lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))  # noqa: E731  shorter vectors end in zeros
    for a in kept:
        if not anchor(a[0]):
            continue
        ranked = sorted((-score(a, b), b[0], b[1]) for b in kept)
        for s, p, _ in [x for x in ranked if x[2] == a[1] and x[1] != a[0]][:positives]:
            fit = [x for x in ranked if x[2] != a[1] and low * -s <= 100 * -x[0] <= high * -s][:negative]
            out += [(a[0], p, k + 1, n, -s, -x) for k, (x, n, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, every, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    found = negatives.hard_negatives(negatives.quantized(df), F.col("id") % every == 0, **more)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(n, seed=1, dims=6, centres=12):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(centres, dims))
    return [(i, (middle[i % centres] + rnd.normal(size=dims) * 0.4).astype(np.float32).tolist(), int(rnd.integers(4)), "k", 3) for i in range(n)]


@pytest.mark.parametrize("part", [4096, 64])
def test_hard_negatives_match_brute_force(spark, part):
    rows = vectors(600)
    assert mined(spark, rows, 10, part=part, sample=200, leaves=8, requests=40) == brute(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_copies_and_ties(spark):
    """A third of all rows is one vector, under several labels; small whole components tie often."""
    rnd = random.Random(5)
    hot = [(i, [0.5, 0.5, -0.25], i % 3, None, 1) for i in range(150)]
    tied = [(200 + i, [rnd.choice([0.0, 0.25, 0.5]) for _ in range(3)], rnd.randrange(3), None, 1) for i in range(300)]
    rows = hot + tied
    assert mined(spark, rows, 7, part=8, sample=64, leaves=4) == brute(rows, lambda i: i % 7 == 0)


def test_hard_negatives_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(60, 2, 3) + [(100, None, 1, "k", 1), (101, [1.0, None, 2.0], 1, "k", 1), (102, [nan, 1.0, 1.0], 2, "k", 1), (103, [inf, 1.0, 1.0], 2, "k", 1), (104, [1.0, 1.0, 1.0], None, "k", 1), (None, [1.0, 1.0, 1.0], 1, "k", 1), (110, [], 1, "k", 1), (105, [0.5, 0.5], 0, "k", 1)]
    rows += [rows[10]] * 5
    assert mined(spark, rows, 5) == brute(rows, lambda i: i % 5 == 0)
    assert mined(spark, [], 5) == []
    assert mined(spark, rows[1:5], 1000) == []
    with pytest.raises(OverflowError):
        mined(spark, [(0, [1e9], 1, "k", 1), (1, [1e9], 2, "k", 1)], 1)


def test_vantage_tree_bounds_hold(spark):
    rnd = np.random.default_rng(4)
    x = np.floor(rnd.normal(size=(500, 5)) * 100)
    most = float((x * x).sum(1).max())
    tree = negatives.grow(x, most, 32)
    assert sorted(np.concatenate(tree.members).tolist()) == list(range(500)) and max(map(len, tree.members)) <= 32
    low, high = tree.bounds(x[:40], most)
    for leaf, held in enumerate(tree.members):
        d = np.sqrt((x[:40] ** 2).sum(1)[:, None] + most - 2 * x[:40] @ x[held].T)
        assert (low[:, leaf][:, None] <= d).all() and (d <= high[:, leaf][:, None]).all()
    same = negatives.grow(np.ones((100, 3)), 3.0, 16)  # no distance tells them apart: leaves are bounded all the same
    assert max(map(len, same.members)) <= 16 and (negatives.deal(same, np.ones((7, 3)), 3.0) < len(same.paths)).all()
