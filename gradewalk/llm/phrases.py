"""Phrase collocation mining: which words stand together more often than their parts would.

Texts are lower-cased (A-Z), cut into pieces at [.,;:!?\\x0A-\\x0D], and pieces into words at blanks and tabs. For each
language, phrases of 2 to 5 words with at least `least` occurrences are scored at their weakest cut.

1. Identical pieces of a language become one row with a multiplicity, so copies and boilerplate are taken apart once.
2. Weighted n-grams are counted in three passes over the pieces: words; pairs of frequent words; phrases of 3 to 5 words
   all of whose pairs are frequent. Every part of a frequent phrase is frequent, so nothing is lost. Tasks add up runs of
   FLUSH_WORDS words first; the sums are dealt by hash of language and phrase, and each hash bucket is added up in a
   DuckDB table that spills to the task's own scratch folder, which goes when the task ends.
3. Parts of a candidate are counted in other buckets: each cut sends a lookup request for both of its parts to their
   buckets by a shuffle, and the replies meet again at the candidate. Hot words get many requests; that join can be split.
4. Longer candidates tell the phrases inside them how often they occur; phrases that never stand alone are dropped.
5. Ranks are positions in one order over all languages, dealt by ranges.

Whether a word or pair is frequent is asked of a Bloom filter of bounded size (see bloom): a false positive costs a count
that falls out in its bucket, and a full filter more of them. Arithmetic is in decimals of 38 digits.

Defined results: null and empty texts have no pieces; null languages are `und`, together with those named so; doc_id isn't
looked at, so repeated rows and null ids count as rows of their own; a text of any length is cut and counted whole; ties
go to the smaller cut, then to the larger a, then to the phrase by bytes; other columns, of any name, are not looked at;
an empty table gives no rows."""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.llm import bloom
from gradewalk.llm.common import save, table, text_or_empty
from gradewalk.operators.ordered import running

LEAST, LONGEST, COVER, TOP = 100, 5, 100, 2000
#: Words that a task adds up before it sends counts on; memory of a bucket's DuckDB.
FLUSH_WORDS, BUCKET_MEMORY = 1_000_000, "256MB"
_CUTS = b".,;:!?\x0a\x0b\x0c\x0d"
#: A-Z to lower case, cuts to line ends, tabs to blanks.
_TABLE = bytes(10 if c in _CUTS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def pieces_of(text: str) -> list[bytes]:
    """The pieces of a text that have words, words joined by single blanks."""
    found = (b" ".join(p.split()) for p in text.encode().translate(_TABLE).split(b"\n"))
    return [p for p in found if p]


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece and n, how often the piece occurs."""

    def cut(batches):
        for b in batches:
            count: Counter[tuple[str, bytes]] = Counter()
            for lang, text in zip(*b.columns, strict=True):
                own = lang.as_py()
                count.update((own, p) for p in pieces_of(text.as_py()))
            langs, found = zip(*count, strict=True) if count else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(list(count.values()), pa.int64())], names=["lang", "piece", "n"])

    each = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text")).mapInArrow(cut, "lang string, piece string, n long")
    return each.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{lang}\0{w}") for w in words], np.uint64)


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


class Filter:
    """Frequent words or pairs as a Bloom filter."""

    def __init__(self, packed: bytes, bits: int):
        self.packed, self.bits = packed, bits

    def has(self, h: np.ndarray) -> np.ndarray:
        return bloom.contains(np.frombuffer(self.packed, np.uint8), self.bits, h)


def frequent_filter(counts: DataFrame) -> Filter:
    """Of saved counts (lang, gram): words, or pairs."""

    def hashed(batches):
        for b in batches:
            h = np.zeros(b.num_rows, np.uint64)
            for k, (lang, gram) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                own = word_hashes(lang, gram.split(" "))
                h[k] = pair_hashes(own[:1], own[1:])[0] if len(own) > 1 else own[0]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return Filter(*bloom.packed(counts.select("lang", "gram").mapInArrow(hashed, "h long"), counts.count()))


class Run:
    """Pieces of one language as flat arrays of word numbers."""

    def __init__(self, lang: str, held: list[str], n: list[int]):
        lists = pc.split_pattern(pa.array(held, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        many = pc.list_value_length(lists).to_numpy()
        self.lang, self.words, self.codes = lang, coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.weight = np.repeat(np.array(n, np.int64), many)
        self.inner = np.ones(len(self.codes), bool)  # whether the next word is of the same piece
        self.inner[np.cumsum(many) - 1] = False

    def rows(self, ids: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, pa.RecordBatch]:
        """The numbers of the distinct ids, and a row for each with the weight of all its places `at`."""
        _, first, number = np.unique(ids, return_index=True, return_inverse=True)
        weight = np.zeros(len(first), np.int64)
        np.add.at(weight, number, self.weight[at])
        where = at[first]
        parts = [self.words.take(pa.array(self.codes[where + j])) for j in range(order)]
        gram = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if order > 1 else parts[0]
        return number, pa.RecordBatch.from_arrays([pa.array([self.lang] * len(first), pa.string()), pa.array(np.full(len(first), order, np.int32)), gram.cast(pa.string()), pa.array(weight)], names=["lang", "words", "gram", "f"])

    def grams(self, words: Filter | None, pairs: Filter | None, longest: int) -> Iterator[pa.RecordBatch]:
        """Counts of words (no filter), of pairs of frequent words (one), or of longer phrases of frequent pairs (both)."""
        if words is None:
            yield self.rows(self.codes, np.arange(len(self.codes)), 1)[1]
            return
        h = word_hashes(self.lang, self.words.to_pylist())
        often = words.has(h)[self.codes] if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(self.inner[:-1] & often[:-1] & often[1:])
        ids = self.codes[at] * len(self.words) + self.codes[at + 1]
        if pairs is None:
            yield self.rows(ids, at, 2)[1]
            return
        found, number = np.unique(ids, return_inverse=True)
        held = pairs.has(pair_hashes(h[found // len(self.words)], h[found % len(self.words)]))[number] if len(found) else np.zeros(0, bool)
        at, number = at[held], number[held]
        for order in range(3, longest + 1):
            of = np.full(len(self.codes) + 1, -1)
            of[at] = number
            held = of[at + 1] >= 0
            at = at[held]
            ids = of[at] * (len(self.codes) + 1) + of[at + 1]
            number, rows = self.rows(ids, at, order)
            yield rows


def partial_counts(held: DataFrame, words: Filter | None = None, pairs: Filter | None = None, longest: int = LONGEST) -> DataFrame:
    """lang, words, gram, f: weighted n-grams of pieces, added up over runs of FLUSH_WORDS words."""
    spark = held.sparkSession
    shared = spark.sparkContext.broadcast([f and (f.packed, f.bits) for f in (words, pairs)])  # bounded: see bloom

    def run(batches):
        filters = [f and Filter(*f) for f in shared.value]
        waiting: dict[str, tuple[list[str], list[int]]] = {}
        size = 0
        for b in batches:
            for lang, piece, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = waiting.setdefault(lang, ([], []))
                own[0].append(piece)
                own[1].append(n)
                size += piece.count(" ") + 1
                if size >= FLUSH_WORDS:
                    for k, v in waiting.items():
                        yield from Run(k, *v).grams(*filters, longest)
                    waiting, size = {}, 0
        for k, v in waiting.items():
            yield from Run(k, *v).grams(*filters, longest)

    return held.select("lang", "piece", "n").mapInArrow(run, "lang string, words int, gram string, f long")


def bucket_counts(partial: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, words, gram, f of the n-grams that occur often enough; every hash bucket is added up out-of-core."""

    def add(batches):
        with tempfile.TemporaryDirectory() as scratch:  # this task's own, gone with it
            con = duckdb.connect(f"{scratch}/grams.duckdb", config={"memory_limit": BUCKET_MEMORY, "threads": "1", "temp_directory": scratch})
            con.execute("CREATE TABLE grams (lang VARCHAR, words INTEGER, gram VARCHAR, f BIGINT)")
            for b in batches:
                con.register("batch", pa.Table.from_batches([b]))
                con.execute("INSERT INTO grams SELECT lang, words, gram, f FROM batch")
                con.unregister("batch")
            found = con.sql(f"SELECT lang, words, gram, CAST(sum(f) AS BIGINT) AS f FROM grams GROUP BY lang, words, gram HAVING sum(f) >= {least}")
            for b in found.to_arrow_reader(10_000):
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.int32()), b.column(2).cast(pa.string()), b.column(3).cast(pa.int64())], names=["lang", "words", "gram", "f"])
            con.close()

    return partial.repartition("lang", "gram").mapInArrow(add, "lang string, words int, gram string, f long")


def frequent_grams(held: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, words, gram, f of all frequent n-grams of saved pieces, saved."""
    words = save(bucket_counts(partial_counts(held), least), "phrase-words")
    often = frequent_filter(words)
    pairs = save(bucket_counts(partial_counts(held, often), least), "phrase-pairs")
    found = words.unionByName(pairs)
    if longest < 3:
        return found
    longer = save(bucket_counts(partial_counts(held, often, frequent_filter(pairs), longest), least), "phrase-longer")
    return found.unionByName(longer)


def weakest_cuts(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every candidate at its lowest-scoring cut."""
    split, m = F.split("gram", " "), F.col("words")
    join = lambda first, many: F.array_join(F.slice("split", first, many), " ")
    cuts = counts.filter("words > 1").select("lang", "gram", "words", F.col("f").alias("a"), split.alias("split"), F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("left"), join(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("left"), join(F.col("k") + 1, m - F.col("k")).alias("part")))).alias("side")
    requests = cuts.select("lang", "gram", "a", "k", sides).select("lang", "gram", "a", "k", "side.*")
    replies = requests.join(counts.select("lang", F.col("gram").alias("part"), "f"), ["lang", "part"])
    met = replies.groupBy("lang", "gram", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", whole("a") * whole("n") * F.lit(1000).cast("decimal(4,0)"), whole("l") * whole("r"))
    scored = met.join(totals, "lang").select("lang", "gram", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    least = scored.groupBy("lang", "gram", "a", "n").agg(F.min("cut").alias("cut"))
    return least.select("lang", F.col("gram").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")


def standing_alone(counts: DataFrame, found: DataFrame, cover: int = COVER) -> DataFrame:
    """found without the phrases inside a longer candidate with at least `cover` percent of their occurrences."""
    inside = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split, i, m), ' '))))")
    told = counts.filter("words > 2").select("lang", "f", "words", F.split("gram", " ").alias("split")).select("lang", "f", F.explode(inside).alias("phrase"))
    most = told.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = found.join(most, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover))
    return kept.drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases."""
    held = save(pieces(docs), "phrase-pieces")
    blanks = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit("")))
    totals = held.groupBy("lang").agg(F.sum(F.col("n") * (blanks + 1)).alias("n"))
    counts = frequent_grams(held, least, longest)
    kept = save(standing_alone(counts, weakest_cuts(counts, totals), cover), "phrases-scored")
    placed = running(kept, [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")], {"before": F.lit(1)}, stored=True)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"))
    bases = running(sizes, [F.col("lang")], {"base": F.col("size")}).select("lang", "base")
    ranked = placed.join(bases, "lang").withColumn("rank", (F.col("before") - F.col("base") + 1).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = r"""
WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k),
c AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS gram, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
b AS (SELECT lang, k, gram, f AS a, string_split(gram, ' ') AS ws, unnest(range(1, k)) AS j FROM c WHERE k > 1),
s AS (SELECT b.lang, b.k, b.gram, a, j, l.f AS l, r.f AS r, n, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM b JOIN t ON b.lang = t.lang JOIN c l ON b.lang = l.lang AND l.gram = array_to_string(ws[1:j], ' ') JOIN c r ON b.lang = r.lang AND r.gram = array_to_string(ws[j + 1:b.k], ' ')),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, j) AS z FROM s) WHERE z = 1),
x AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.lang = m.lang AND o.k > m.k AND contains(' ' || o.gram || ' ', ' ' || m.gram || ' ') AND 100 * o.f >= 100 * m.a))
SELECT lang, rank, gram AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank FROM x) WHERE rank <= 2000
"""
