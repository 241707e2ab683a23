"""Toxicity by a classifier chain.

Categories are predicted one after another; each is a linear (logistic) model over the text's traits, and each later
model also gets the probabilities of the earlier ones. In training those come from out-of-fold predictions, so that a
later model sees earlier probabilities as good, or as poor, as it will meet them in use. The last category is the verdict.

The labels hold one flag, so the finer categories are derived from it on the training sample, with the traits that stand
nearly only in toxic documents (`telling`): `dense`, toxic documents whose share of telling words is above the median of
toxic ones; `varied`, toxic documents with at least as many different telling traits as the median toxic one; `toxic`,
the flag itself. Their targets differ (a long text may be varied and not dense), and both earlier ones tell something
about the last.

Traits are words, and stems of STEMS letters of which at least two different words begin: abusive words of languages
that inflect and compound are met in forms that no labelled document had. Of them the VOCABULARY ones are taken that tell
the two kinds of documents apart best, of nested stems in the same documents the longest only. Their counts are made by
Spark over the sample; what reaches the driver is at most 8 x VOCABULARY counts, and a row of trait numbers for each
labelled document, never texts. Training takes a bounded sample of labelled documents: the LABELLED_MOST smallest by a
digest of the id. Every document is judged by its whole text.

Defined results: null and empty texts have the probabilities of a text without words; rows are judged one by one, so
null ids and repeated rows keep theirs; without labelled documents of both kinds all probabilities are 0; an empty table
gives an empty result; labels of a document that disagree count as toxic; of a labelled id's repeated rows the smallest
text is learned from; other columns, of any name, are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.llm.common import save, table, text_or_empty

CATEGORIES = ("dense", "varied", "toxic")
LABELLED_MOST = 12_000
VOCABULARY = 256
STEMS = (5, 6, 7, 8, 9)
#: A trait's least number of labelled documents.
TRAIT_DOCS = 3
FOLDS = 3
THRESHOLD = 0.3
RIDGE = 0.4
#: Words whose traits a worker remembers.
CACHE_MOST = 300_000
WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def traits(held: set[str]) -> set[str]:
    """The traits of a text with these words: =word, and ^stem of at least two of them."""
    stems = Counter(w[:k] for w in held for k in STEMS if len(w) >= k)
    return {"=" + w for w in held} | {"^" + s for s, n in stems.items() if n > 1}


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights, the bias last, of a ridge-penalised logistic model; Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], RIDGE)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(a @ w)
        g = a.T @ (p - y) + penalty * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


@dataclass
class Chain:
    """A fitted chain: its traits, and one weight vector for each category over the features and the earlier categories."""

    vocabulary: dict[str, int]
    telling: frozenset[int] = frozenset()
    weights: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self.known: dict[str, tuple[int, ...]] = {}  # a word's own trait and, below zero, its stems

    def _of(self, w: str) -> tuple[int, ...]:
        found = self.known.get(w)
        if found is None:
            v = self.vocabulary
            own, stems = v.get("=" + w), [v[t] for k in STEMS if len(w) >= k and (t := "^" + w[:k]) in v]
            found = (*([own] if own is not None else []), *(-1 - k for k in stems))
            if len(self.known) > CACHE_MOST:
                self.known.clear()
            self.known[w] = found
        return found

    def row(self, text: str) -> tuple[list[int], int, int]:
        """(numbers of the text's traits, words with a telling trait, words)."""
        count = Counter(words(text))
        met = {w: own for w in count if (own := self._of(w))}
        stems = Counter(k for own in met.values() for k in own if k < 0)
        held = {k for own in met.values() for k in own if k >= 0} | {-1 - k for k, n in stems.items() if n > 1}
        tells = held & self.telling
        hits = sum(count[w] for w, own in met.items() if any((k if k >= 0 else -1 - k) in tells for k in own))
        return sorted(held), hits, sum(count.values())

    def features(self, rows: list[tuple[list[int], int, int]]) -> np.ndarray:
        """Presence of each trait, and how many telling words and words there are (logarithms)."""
        x = np.zeros((len(rows), len(self.vocabulary) + 2), np.float32)
        for r, (held, hits, n) in enumerate(rows):
            x[r, held] = 1
            x[r, -2:] = np.log1p(hits), np.log1p(n) / 4
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One column for each category."""
        found = np.zeros((len(x), 0))
        for w in self.weights:
            found = np.hstack([found, predict(w, np.hstack([x, found]))[:, None]])
        return found


def deviations(c0, c1, n0, n1):
    """By how many deviations a trait's shares of both kinds of documents differ; numbers or columns."""
    p = (c0 + c1 + 1) / (n0 + n1 + 2)
    return (c1 / n1 - c0 / n0) / (p * (1 - p) * (1 / n0 + 1 / n1)) ** 0.5


def choose(counts: list[tuple[str, int, int]], tested: dict[str, int], n0: int, n1: int, most: int = VOCABULARY) -> Chain:
    """A chain without weights over the traits (trait, clean, toxic documents) that tell most.

    tested: how many traits there are of each mark; the least deviations are such that
    of as many that tell nothing one is expected to pass."""
    least = {mark: NormalDist().inv_cdf(1 - 0.5 / max(n, 1)) for mark, n in tested.items()}
    ranked = sorted((-abs(deviations(c0, c1, n0, n1)), -len(t), t, c0, c1) for t, c0, c1 in counts)
    taken: list[tuple[str, int, int]] = []
    for z, _, t, c0, c1 in ranked:
        nested = t[0] == "^" and any(u.startswith(t) and (a, b) == (c0, c1) for u, a, b in taken)
        if -z >= least[t[0]] and not nested and len(taken) < most:
            taken.append((t, c0, c1))
    telling = frozenset(k for k, (_, c0, c1) in enumerate(taken) if c1 / n1 >= 9 * c0 / n0 and c1)
    return Chain({t: k for k, (t, _, _) in enumerate(taken)}, telling)


def fit_rows(chain: Chain, rows: list[tuple[list[int], int, int]], toxic: list[int]) -> Chain:
    """The chain with weights from its rows of labelled texts, in any order of rows alike: rows are sorted first."""
    order = sorted(zip(rows, toxic, strict=True))
    x, y = chain.features([r for r, _ in order]), np.array([t for _, t in order], np.int64)
    share = np.array([hits / max(n, 1) for (_, hits, n), _ in order])
    kinds = np.array([len(chain.telling.intersection(held)) for (held, _, _), _ in order])
    middle = lambda v: float(np.median(v[y == 1]))
    targets = [y * (share > middle(share)), y * (kinds >= max(middle(kinds), 1)), y]
    fold, held = np.arange(len(y)) % FOLDS, np.zeros((len(y), 0))
    for target in targets:
        inputs = np.hstack([x, held])
        chain.weights.append(fit_logistic(inputs, target))
        own = np.zeros(len(y))
        for k in range(FOLDS):
            own[fold == k] = predict(fit_logistic(inputs[fold != k], target[fold != k]), inputs[fold == k])
        held = np.hstack([held, own[:, None]])
    return chain


def fit(texts: list[str], toxic: list[int]) -> Chain:
    """A chain from labelled texts in memory; see train for tables."""
    counts: dict[str, list[int]] = {}
    for text, t in zip(texts, toxic, strict=True):
        for c in traits(set(words(text))):
            counts.setdefault(c, [0, 0])[t] += 1
    n1 = sum(toxic)
    if not n1 or n1 == len(toxic):
        return Chain({})
    often = [(t, *c) for t, c in counts.items() if sum(c) >= TRAIT_DOCS]
    chain = choose(often, Counter(t[0] for t, _, _ in often), len(toxic) - n1, n1)
    return fit_rows(chain, [chain.row(t) for t in texts], toxic)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = LABELLED_MOST) -> DataFrame:
    """text and toxic of at most so many labelled documents."""
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(most)
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(marks), "doc_id")  # `most` rows at most
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED_MOST) -> Chain:
    """A chain from a bounded sample of labelled documents; texts stay on the executors."""
    sample = save(labelled_sample(docs, labels, most), "toxicity-sample")
    n0, n1 = (sample.filter(F.col("toxic") == k).count() for k in (0, 1))
    if not n0 or not n1:
        return Chain({})

    def tell(batches):
        for b in batches:
            for text, toxic in zip(*b.columns, strict=True):
                found = sorted(traits(set(words(text.as_py()))))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic.as_py()] * len(found), pa.int32())], names=["trait", "toxic"])

    each = sample.select("text", "toxic").mapInArrow(tell, "trait string, toxic int")
    counts = each.groupBy("trait").agg(F.count_if(F.col("toxic") == 0).alias("c0"), F.count_if(F.col("toxic") == 1).alias("c1"))
    often = save(counts.filter(F.col("c0") + F.col("c1") >= TRAIT_DOCS), "toxicity-traits")
    tested = {r["mark"]: r["n"] for r in often.groupBy(F.substring("trait", 1, 1).alias("mark")).agg(F.count("*").alias("n")).collect()}  # two marks
    best = often.orderBy(F.desc(F.abs(deviations(F.col("c0"), F.col("c1"), n0, n1))), F.desc(F.length("trait")), "trait").limit(8 * VOCABULARY)
    chain = choose([tuple(r) for r in best.select("trait", "c0", "c1").collect()], tested, n0, n1)

    def rows(batches):
        for b in batches:
            held, hits, n = zip(*[chain.row(t.as_py()) for t in b.column(0)], strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32())), pa.array(hits, pa.int64()), pa.array(n, pa.int64()), b.column(1)], names=["held", "hits", "n", "toxic"])

    found = sample.select("text", "toxic").mapInArrow(rows, "held array<int>, hits long, n long, toxic int").collect()  # `most` rows of at most VOCABULARY numbers
    return fit_rows(chain, [(list(r["held"]), r["hits"], r["n"]) for r in found], [r["toxic"] for r in found])


def judge(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, a probability for each category, and the verdict, for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((chain.vocabulary, chain.telling, chain.weights))  # VOCABULARY traits and their weights
    names = [f"p_{c}" for c in CATEGORIES]

    def run(batches):
        model = Chain(*shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                p = model.probabilities(model.features([model.row(t.as_py()) for t in part.column(1)])) if model.weights else np.zeros((part.num_rows, len(names)))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(p[:, k]) for k in range(len(names))], pa.array(p[:, -1] >= threshold)], names=["doc_id", *names, "toxic"])

    fields = "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean"
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, fields)


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
