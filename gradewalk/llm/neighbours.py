"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of terms: its frequent words, the shapes of its tokens (runs of capitals, letters, digits and other signs),
its signs, and steps of what it is like as a whole (how long, how varied, how many lines and neighbours repeat). Terms are
weighted by the documents of the whole corpus that have them; a truncated singular value decomposition of the labelled
bags gives the space. A document's score is the share of label 1 among its NEIGHBOURS nearest labelled documents (and all
that are as near as the last of them), each weighted by a power of its cosine.

1. At most LABELLED_MOST labelled documents are learned from, those of smallest digest of the id; their texts stay on
   executors. The VOCABULARY terms that most of them have are counted by Spark.
2. Every document's bag is made once, from its whole text, and stored; document frequencies are counted over all of them.
3. The labelled bags (numbers, no texts) are decomposed on the driver; LABELLED_MOST vectors of DIMENSIONS numbers and the
   projection are broadcast, both of bounded size.
4. Blocks of documents are projected and multiplied with all labelled vectors: cosines are exact.

Labels are learned only from ids whose crc32 modulo 5 is not 0; labels, language, source and id are no inputs of a score.

Defined results: null and empty texts are bags without words and get the votes of such; a null id is not held out and has
no label; rows are scored one by one, so repeated rows and null ids keep theirs; a document that is a bag of nothing known
gets the labelled documents' share of label 1, or 0.5 where nothing is labelled; labels of an id that disagree count as 0;
of a labelled id's repeated rows the smallest text is learned from; very long texts are read whole; other columns, of any
name, are not looked at; an empty table gives no rows."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, ShortType

from gradewalk.llm.common import save, table, text_or_empty

LABELLED_MOST, VOCABULARY, DIMENSIONS, NEIGHBOURS = 8_000, 1_024, 64, 9
#: A term's least number of labelled documents; the power of a cosine that a vote weighs.
TERM_DOCS, POWER = 3, 8
THRESHOLD = 0.3
#: Documents multiplied with the labelled vectors at once; tokens whose terms a worker remembers.
BLOCK, CACHE_MOST = 256, 300_000
_RUN = re.compile(r"[^\W\d_]+|\d+|[\W_]")


def shape(token: str) -> str:
    """The kinds of a token's runs: A capitals, Aa capitalised, a other letters, 0 digits, other signs themselves."""
    kinds = []
    for run in _RUN.findall(token):
        kind = "0" if run.isdigit() else run if not run[0].isalpha() else "A" if run.isupper() and len(run) > 1 else "Aa" if run[0].isupper() else "a"
        if not kinds or kinds[-1] != kind:
            kinds.append(kind)
    return "".join(kinds[:6])


def _step(name: str, share: float) -> str:
    return f"{name}:{min(10, math.ceil(10 * share))}"


class Terms:
    """Terms of texts; those of tokens are remembered."""

    def __init__(self):
        self.known: dict[str, tuple[str, ...]] = {}

    def of_token(self, token: str) -> tuple[str, ...]:
        found = self.known.get(token)
        if found is None:
            if len(self.known) > CACHE_MOST:
                self.known.clear()
            own = shape(token)
            found = self.known[token] = (f"s:{own}", *[f"c:{k}" for k in {k for k in token if not k.isalnum()}], *([f"w:{token.lower()}"] if len(token) <= 16 and token.isalpha() else []))
        return found

    def bag(self, text: str) -> dict[str, float]:
        """Each term's weight before document frequencies: the square root of its share of tokens; 1 for steps."""
        tokens = text.split()
        count, n = Counter(tokens), max(len(tokens), 1)
        found: Counter[str] = Counter()
        for token, many in count.items():
            for term in self.of_token(token):
                found[term] += many
        bag = {t: math.sqrt(c / n) for t, c in found.items()}
        lines = [x for x in text.split("\n") if x.strip()]
        bag[f"length:{len(tokens).bit_length()}"] = 1.0
        if tokens:
            bag[_step("varied", len(count) / n)] = 1.0
            bag[_step("top", max(count.values()) / n)] = 1.0
            bag[_step("beside", sum(a == b for a, b in zip(tokens, tokens[1:])) / n)] = 1.0
            bag[_step("lines", 1 - len(set(lines)) / len(lines))] = 1.0
            bag[_step("capitals", sum(map(str.isupper, text)) / len(text))] = 1.0
            bag[_step("signs", sum(c for t, c in count.items() if not t.isalnum()) / n)] = 1.0
        return bag


@dataclass
class Space:
    """A projection of bags and the labelled documents in it."""

    project: np.ndarray  # terms x dimensions, with the terms' weights
    vectors: np.ndarray  # labelled documents x dimensions, of length 1
    marks: np.ndarray
    prior: float

    def place(self, bags: list[tuple[list[int], list[float]]]) -> np.ndarray:
        x = np.zeros((len(bags), len(self.project)), np.float32)
        for r, (ids, weights) in enumerate(bags):
            x[r, ids] = weights
        found = x @ self.project
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)

    def scores(self, bags: list[tuple[list[int], list[float]]], neighbours: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(bags), self.prior)
        near = np.maximum(self.place(bags) @ self.vectors.T, 0)
        k = min(neighbours, len(self.vectors))
        last = np.partition(near, len(self.vectors) - k, axis=1)[:, -k] if k else 0
        votes = np.where(near >= last[:, None] - 1e-5, near.astype(np.float64) ** POWER, 0)
        return (votes @ self.marks + 1e-3 * self.prior) / (votes.sum(axis=1) + 1e-3)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = LABELLED_MOST) -> DataFrame:
    """doc_id, text and mark of at most so many labelled documents that are not held out."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("mark"))
    marks = marks.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(most)
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(marks), "doc_id")  # `most` rows at most
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("mark").alias("mark"))


def vocabulary(sample: DataFrame, most: int = VOCABULARY) -> list[str]:
    """The terms that most labelled documents have."""

    def tell(batches):
        terms = Terms()
        for b in batches:
            found = [t for text in b.column(0) for t in terms.bag(text.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["term"])

    counts = sample.select("text").mapInArrow(tell, "term string").groupBy("term").count().filter(F.col("count") >= TERM_DOCS)
    return [r["term"] for r in counts.orderBy(F.desc("count"), "term").limit(most).collect()]


def bags(docs: DataFrame, terms: list[str], keep: list[Column]) -> DataFrame:
    """The columns `keep`, and the numbers and weights of each text's known terms. docs: any table with a text."""
    number, names = {t: k for k, t in enumerate(terms)}, [f"_{k}" for k in range(len(keep))]

    def run(batches):
        own = Terms()
        for b in batches:
            ids, weights = [], []
            for text in b.column(b.num_columns - 1):
                known = {number[t]: w for t, w in own.bag(text.as_py()).items() if t in number}
                ids.append(list(known))
                weights.append(list(known.values()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.list_(pa.int16())), pa.array(weights, pa.list_(pa.float32()))], names=[*names, "ids", "weights"])

    chosen = docs.select(*[c.alias(n) for c, n in zip(keep, names, strict=True)], text_or_empty().alias("_text"))
    return chosen.mapInArrow(run, chosen.drop("_text").schema.add("ids", ArrayType(ShortType())).add("weights", ArrayType(FloatType())))


def document_counts(held: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """How many documents have each term, and how many there are; a task sends one number a term."""

    def count(batches):
        found, n = np.zeros(terms, np.int64), 0
        for b in batches:
            found += np.bincount(b.column(0).flatten().to_numpy(), minlength=terms)
            n += b.num_rows
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], n))], names=["term", "n"])

    found, n = np.zeros(terms, np.int64), 0
    for r in held.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # VOCABULARY + 1 rows
        if r["term"] < 0:
            n = r["n"]
        else:
            found[r["term"]] = r["n"]
    return found, n


def fit(labelled: list[tuple[list[int], list[float]]], marks: list[int], docs: np.ndarray, n: int, dimensions: int = DIMENSIONS) -> Space:
    """The space of labelled bags, in any order of them alike; docs: how many of all n documents have each term."""
    order = sorted(range(len(marks)), key=lambda r: (labelled[r], marks[r]))
    weight = np.log((1 + n) / (1 + docs)).astype(np.float32)
    x = np.zeros((len(marks), len(docs)), np.float32)
    for row, r in enumerate(order):
        x[row, labelled[r][0]] = labelled[r][1]
    x *= weight
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    _, basis = np.linalg.eigh((x.T @ x).astype(np.float64))
    own = np.array([marks[r] for r in order], np.float64)
    space = Space((basis[:, ::-1][:, :dimensions] * weight[:, None]).astype(np.float32), np.zeros((0, dimensions), np.float32), own, float(own.mean()) if len(own) else 0.5)
    if len(own):
        space.vectors = space.place([labelled[r] for r in order])
    return space


def train(docs: DataFrame, labels: DataFrame, keep: list[Column]) -> tuple[DataFrame, Space]:
    """The stored bags of all documents with the columns `keep` (as _0, _1, ...), and the space that scores them."""
    sample = save(labelled_sample(docs, labels), "quality-sample")
    terms = vocabulary(sample)
    held = save(bags(docs, terms, keep), "quality-bags")
    counts, n = document_counts(held, len(terms))
    rows = bags(sample, terms, [F.col("mark")]).collect()  # LABELLED_MOST rows of at most VOCABULARY numbers
    return held, fit([(list(r["ids"]), list(r["weights"])) for r in rows], [r["_0"] for r in rows], counts, n)


def vote(held: DataFrame, space: Space, neighbours: int = NEIGHBOURS) -> DataFrame:
    """The columns _0, _1, ... of stored bags, and a score."""
    shared = held.sparkSession.sparkContext.broadcast(space)  # LABELLED_MOST x DIMENSIONS and VOCABULARY x DIMENSIONS floats
    kept = [c for c in held.columns if c not in ("ids", "weights")]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                found = shared.value.scores(list(zip(part.column(len(kept)).to_pylist(), part.column(len(kept) + 1).to_pylist(), strict=True)), neighbours)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(found, pa.float64())], names=[*kept, "score"])

    return held.mapInArrow(run, held.select(*kept).schema.add("score", "double"))


def op13_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held, space = train(docs, table(spark, sf_dir, "labels"), [F.col("doc_id"), held_out()])
    return vote(held, space).select(F.col("_0").alias("doc_id"), F.col("_1").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
