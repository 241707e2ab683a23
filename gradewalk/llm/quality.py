"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit for each failed rule.
Policies are versioned masks over those bits, so that another policy, or a policy less one rule, needs no second
look at the texts: ablations are bit operations and counts over the ledger.

Defined results: a null or empty text has no words, fails rule 0 and is rejected; rows are judged one by one, so
repeated rows and null ids keep their own ledger rows; other columns are carried in a struct, so names like n_words
can't clash; very long texts are measured whole, in one row's memory; an empty table gives an empty ledger, and no ablations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.llm.common import SPACE_CHARS, SPACE_CLASS, let, table, text_or_empty, whole_row

WINDOW = 8

#: Bit number, name and failure condition over the measurements, in integers only.
RULES = [
    (0, "few_words", "n_words < 20"),
    (1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
    (2, "short_words", "word_chars < 2 * n_words"),
    (3, "long_words", "word_chars > 20 * n_words"),
    (4, "symbols", "10 * n_symbols > 2 * n_words"),
    (5, "duplicate_lines", "10 * n_dup_lines > 5 * n_lines"),
    (6, "shouting", "2 * n_exclaim > n_words"),
]
BASE_BITS = 0b11
#: A policy is the mask of the rules that reject.
POLICIES = {"base": BASE_BITS, "v1": 0b1111111}


def _repeated(windows: Column) -> Column:
    """Words in the windows whose hash occurs more than once: the length of the union of [p, p + 8)."""

    def starts(s: Column) -> Column:
        same = lambda e, j: F.get(s, j - 1)["h"].eqNullSafe(e["h"]) | F.get(s, j + 1)["h"].eqNullSafe(e["h"])
        return F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))

    def covered(p: Column) -> Column:
        step = lambda v, j: F.coalesce(F.least(F.lit(WINDOW), F.get(p, j + 1) - v), F.lit(WINDOW))
        gaps = F.transform(p, lambda v, j: F.when(j == F.size(p) - 1, F.lit(WINDOW)).otherwise(step(v, j)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(ordered, lambda s: let(starts(s), covered))


def _word_measures(words: Column) -> Column:
    """Word count and repeated words, from an array of words."""

    def windows(hashes: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def repeated(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_repeated(h))

    def measure(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        again = F.when(n <= WINDOW, F.lit(0).cast("long")).otherwise(let(let(hashes, windows), repeated))
        return F.struct(n.cast("long").alias("n_words"), again.alias("n_repeat_words"))

    return let(words, measure)


def measurements(text: Column) -> Column:
    """A struct of all measurements of a text."""
    chars = F.length(text)
    without = lambda marks: F.length(F.translate(text, marks, ""))
    words = F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.ltrim(F.translate(x, SPACE_CHARS, " "))) > 0)
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(
        _word_measures(words).alias("w"),
        line_counts.alias("l"),
        without(SPACE_CHARS).cast("long").alias("word_chars"),
        (chars - without("#*$%&|<>")).cast("long").alias("n_symbols"),
        (chars - without("!")).cast("long").alias("n_exclaim"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """docs' rows (as struct `row`) with measurements and fail_bits."""
    seen = docs.select(whole_row(docs).alias("row"), measurements(text_or_empty()).alias("m"))
    flat = seen.select("row", "m.w.*", "m.l.*", "m.word_chars", "m.n_symbols", "m.n_exclaim")
    bits = [F.when(F.expr(fails), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long") for bit, _, fails in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return flat.withColumn("fail_bits", total)


def passes(policy: str | int) -> Column:
    """Whether a ledger row passes a policy, by name or mask."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == 0


def ablations(rows: DataFrame, policy: str | int) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that pass once it is left out.

    The ledger is summed to at most 2^rules counts first; each of these meets every rule once. No rows: no result."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    masked = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).count()
    rules = [F.struct(F.lit(b).alias("bit"), F.lit(name).alias("rule"), F.lit(1 << b).cast("long").alias("one")) for b, name, _ in RULES if mask >> b & 1]
    met = masked.select("bits", "count", F.explode(F.array(*rules)).alias("r")).select("bits", "count", "r.*")
    fails = F.col("bits").bitwiseAND(F.col("one")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not("one")) == 0
    return met.groupBy("bit", "rule").agg(
        F.coalesce(F.sum(F.when(fails, F.col("count"))), F.lit(0)).alias("n_fail"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("one"), F.col("count"))), F.lit(0)).alias("n_fail_alone"),
        F.coalesce(F.sum(F.when(rest, F.col("count"))), F.lit(0)).alias("n_kept_without"),
        F.bit_or("bits").alias("bits_seen"),
    )


def keep_good(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of docs that pass a policy, with docs' own columns."""
    return ledger(docs).filter(passes(policy)).select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), passes("v1").alias("kept"), "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the production policy rejects, alone and together with others."""
    return ablations(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "v1")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, ws[i:i+7] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclaim,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
f AS (SELECT *, CAST(""" + " + ".join(f"(CASE WHEN {fails} THEN {1 << bit} ELSE 0 END)" for bit, _, fails in RULES) + r""" AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits & 127 = 0 AS kept, fail_bits FROM f
"""

_RULES = ", ".join(f"({b}, '{name}', CAST({1 << b} AS BIGINT))" for b, name, _ in RULES if POLICIES["v1"] >> b & 1)
ABLATIONS = ORACLE[: ORACLE.rindex("SELECT doc_id, n_words")].rstrip() + f""",
b AS (SELECT fail_bits & {POLICIES["v1"]} AS bits FROM f)
SELECT bit, rule, count(*) FILTER (bits & one <> 0) AS n_fail, count(*) FILTER (bits = one) AS n_fail_alone,
  count(*) FILTER (bits = bits & one) AS n_kept_without, CAST(bit_or(bits) AS BIGINT) AS bits_seen
FROM b, (VALUES {_RULES}) r(bit, rule, one) GROUP BY bit, rule
"""
