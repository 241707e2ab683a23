"""Secret scans with a random forest that removes false positives.

Candidates are runs of 16 or more token characters with a digit, and quoted values of 8 or more after names such as
`password =`, of any length.
The forest looks at length, character transitions (changes of class, bigrams unlike words'), dictionary coverage, the
path and the neighbouring words (four before, two after, however long they are). It is trained from labelled findings: a
table of (value, before, after, path, label); `labelled_findings` makes one by rule where none is given, with
placeholders and digests rather in tests and documentation, and credentials rather in code and settings. Where a corpus
has no paths, a document's source stands for it; names without a known ending or folder tell nothing either way.
Candidates are found and described in Arrow batches; the forest is trained and applied by Spark.

Defined results: null and empty texts have no candidates; values that end at the text's end have no word after; rows
are scanned one by one, so null ids and repeated rows report their own findings; a null path is an empty one; an empty
table gives no findings; of overlapping candidates the one that begins first counts, of those that begin together the
shorter; where all labelled findings are secrets every candidate is one, where none is there are no findings; other
columns, of any name, are not looked at. Spans are in code points.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import public_tokenizers
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.llm.common import table, text_or_empty

CANDIDATE = re.compile(r"""(?<![\w\-+/=.])(?=[A-Za-z_\-+/=.]*[0-9])[A-Za-z0-9_\-+/=.]{16,}(?![\w\-+/=])""")
ASSIGNED = re.compile(r"""(?i)(?:password|passwd|secret|api_?key|token)["']?\s{0,3}[:=]\s{0,3}["']([^\s"']{8,}+)["']""")
#: Neighbouring words before and after; the text at hand grows from NEAR characters until it holds them.
BEFORE, AFTER, NEAR = 4, 2, 48
WORD = re.compile(r"[^\W\d_]{2,}")
NAMES = frozenset("token secret password passwd pwd key apikey api auth bearer credential credentials private access client login".split())
INNOCENT = frozenset("commit sha md5 checksum digest uuid guid id order invoice card phone number version example sample placeholder test hash ref isbn".split())
THRESHOLD, TREES, DEPTH, LABELLED_MOST = 0.5, 30, 8, 5_000
FEATURES = ("length", "entropy", "digits", "upper", "lower", "marks", "transitions", "unlike_words", "coverage", "hex", "named", "innocent", "quoted", "assigned", "path_code", "path_test")


class Dictionary:
    """Whole words of a public vocabulary, and how likely a letter follows another in them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.words = {w[:-4] for w in vocabulary if w.endswith("</w>") and w[:-4].isalpha() and len(w) >= 8}
        pairs = Counter(p for w in self.words for p in zip(w, w[1:]))
        firsts = Counter(a for w in self.words for a in w[:-1])
        self.cost = {p: -math.log2(n / firsts[p[0]]) for p, n in pairs.items()}

    def coverage(self, value: str) -> float:
        parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", value)
        return sum(len(p) for p in parts if p.lower() in self.words) / len(value)

    def unlike(self, value: str) -> float:
        v = value.lower()
        return sum(self.cost.get(p, 12.0) for p in zip(v, v[1:])) / max(len(v) - 1, 1)


def describe(value: str, before: str, after: str, path: str, words: Dictionary) -> list[float]:
    """The FEATURES of a candidate."""
    n, kinds = len(value), [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in value]
    counts, share = Counter(value), Counter(kinds)
    near = [w.lower() for w in WORD.findall(before)[-BEFORE:] + WORD.findall(after)[:AFTER]]
    parts = [p for w in near for p in re.split(r"_", w)]
    return [
        float(n),
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        *[share[k] / n for k in range(4)],
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(n - 1, 1),
        words.unlike(value),
        words.coverage(value),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", value)) and not value.isdigit()),
        float(any(p in NAMES for p in parts)),
        float(any(p in INNOCENT for p in parts)),
        float(before[-1:] in "\"'" and before != ""),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(bool(re.search(r"\.(py|js|ts|java|go|rb|sh|env|ya?ml|json|conf|ini|properties)$", path))),
        float(bool(re.search(r"test|example|fixture|sample|doc", path))),
    ]


def around(text: str, s: int, e: int) -> tuple[str, str]:
    """So much of the text before and after a span that it holds whole neighbouring words."""
    n = m = NEAR
    while n < s and len(WORD.findall(text, s - n, s)) <= BEFORE:  # one more, as the first may be cut
        n *= 4
    while e + m < len(text) and len(WORD.findall(text, e, e + m)) <= AFTER:
        m *= 4
    return text[max(0, s - n) : s], text[e : e + m]


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of candidates, without overlaps."""
    spans, end = [], 0
    for s, e in sorted({m.span() for m in CANDIDATE.finditer(text)} | {m.span(1) for m in ASSIGNED.finditer(text)}):
        if s >= end:
            spans.append((s, e))
            end = e
    return spans


def labelled_findings(n: int = LABELLED_MOST, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """n labelled findings by rule: credentials in places where they leak, and the usual false positives."""
    rnd, rows = random.Random(seed), []
    fill = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    hexa, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    plain = "the of and report value see with from page for this was line entry".split()
    code, trial, plain_paths = ["src/app.py", "conf/settings.yaml", "deploy/.env", "lib/index.js"], ["tests/data.json", "doc/example.txt", "fixtures/sample.yml"], ["src7", "notes", "src0", ""]
    talk = lambda: " ".join(rnd.choice(plain) for _ in range(rnd.randint(0, 5)))
    case = lambda s: s.upper() if rnd.random() < 0.15 else s
    for _ in range(n):
        label = rnd.random() < 0.5
        path = rnd.choice(rnd.choices([code, trial, plain_paths], [5, 1, 6] if label else [2, 4, 6])[0])
        if label:
            value = rnd.choice([lambda: fill(hexa, rnd.choice([32, 40, 64])), lambda: fill(b64, rnd.randint(20, 48)), lambda: "AKIA" + fill(b64[:26] + "0123456789", 16), lambda: fill(b64 + "+/", 40)])()
            name, mark = rnd.choice(["token", "api_key", "secret", "password", "auth_token", "access key", "client_secret"]), rnd.choice([' = "', ': "', "=", " = '", ": "])
            before, after = f"{talk()} {name}{mark}", (mark[-1] if mark[-1] in "\"'" else "") + " " + talk()
            rows.append((case(value), case(before), after, path, 1))
        else:
            kind = rnd.randrange(6)
            if kind == 0:
                value, before = fill("0123456789", rnd.choice([16, 18, 20])), f"{talk()} "
            elif kind == 1:
                value, before = fill(hexa, rnd.choice([32, 40, 64])), f"{talk()} {rnd.choice(['commit', 'sha', 'md5', 'checksum', 'digest', 'ref'])}{rnd.choice([' ', ': ', ' = '])}"
            elif kind == 2:
                value, before = "-".join(fill(hexa, k) for k in (8, 4, 4, 4, 12)), f"{talk()} {rnd.choice(['id', 'uuid', 'order', 'request'])} "
            elif kind == 3:
                value, before = "_".join(rnd.choice("user account number total client server default config value list".split()) for _ in range(3)) + str(rnd.randint(1, 99)), f"{talk()} {rnd.choice(['', 'token = '])}"
            elif kind == 4:
                value, before = rnd.choice(["your_token_here_123", "xxxxxxxxxxxxxxxx1234", "example-password-00", "0000000000000000", "changeme12345678"]), f'{rnd.choice(["token", "password", "secret"])} = "'
            else:
                value, before = "/".join(rnd.choice(["static", "images", "archive", "2024", "page12", "files"]) for _ in range(4)) + "/a1.html", f"{talk()} "
            rows.append((case(value), case(before), " " + talk(), path, 0))
    return rows


@dataclass(frozen=True)
class OneKind:
    """What stands for a forest where all labelled findings have one label: its probability for every candidate."""

    probability: float


def sample(findings: list[tuple[str, str, str, str, int]], most: int = LABELLED_MOST) -> list[tuple[str, str, str, str, int]]:
    """At most so many findings, of each label half or all it has, by a digest of the finding: their order decides nothing."""
    if len(findings) <= most:
        return findings
    dealt = sorted(findings, key=lambda f: hashlib.md5(repr(f).encode()).digest())
    secret, other = ([f for f in dealt if bool(f[4]) == label] for label in (True, False))
    few = min(len(secret), len(other), most // 2)
    n = few if len(secret) <= len(other) else most - few
    return secret[:n] + other[: most - n]


def train(spark: SparkSession, dictionary: str, findings: list[tuple[str, str, str, str, int]] | None = None) -> RandomForestClassificationModel | OneKind:
    """A forest from labelled findings (a sample of LABELLED_MOST at most is used)."""
    words, chosen = Dictionary(dictionary), sample(findings or labelled_findings())
    if len({bool(f[4]) for f in chosen}) == 1:
        return OneKind(float(bool(chosen[0][4])))
    rows = [(describe(v, b, a, p, words), float(y)) for v, b, a, p, y in chosen]
    frame = spark.createDataFrame(rows, "f array<double>, label double").select(array_to_vector("f").alias("features"), "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11).fit(frame)


def described(docs: DataFrame, dictionary: str, path_column: str | None = None) -> DataFrame:
    """doc_id, begin, end, value and f (FEATURES) of every candidate in every text."""
    fields = "doc_id long, begin long, end long, value string, f array<double>"
    schema = pa.schema([("doc_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("f", pa.list_(pa.float64()))])

    def run(batches):
        words = Dictionary(dictionary)
        for b in batches:
            rows = []
            for doc, t, p in zip(*b.columns, strict=True):
                text = t.as_py()
                for s, e in candidates(text):
                    value = text[s:e]
                    rows.append((doc.as_py(), s, e, value, describe(value, *around(text, s, e), p.as_py(), words)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    path = F.coalesce(F.col(path_column).cast("string"), F.lit("")) if path_column else F.lit("")
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), path.alias("path")).mapInArrow(run, fields)


def scan(docs: DataFrame, model: RandomForestClassificationModel | OneKind, dictionary: str, path_column: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, begin, end, value and probability of every finding that the forest keeps."""
    found = described(docs, dictionary, path_column).withColumn("features", array_to_vector("f"))
    known = isinstance(model, OneKind)
    judged = found.withColumn("probability", F.lit(model.probability)) if known else model.transform(found).withColumn("probability", vector_to_array("probability")[1])
    return judged.filter(F.col("probability") >= threshold).select("doc_id", "begin", "end", "value", "probability")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = scan(docs, train(spark, dictionary), dictionary, "source")
    return found.select("doc_id", "begin", "end", F.sha2("value", 256).alias("value_sha256"), F.round("probability", 6).alias("probability"))
