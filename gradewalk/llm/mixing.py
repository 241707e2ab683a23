"""Mixing sources to target weights by systematic sampling.

A source's target is a water level: min(cap x size, level x weight), where the level makes the targets sum to the
whole. Every document of a source has target / source_size expected copies. Their prefix sum over the source's
documents, plus one random offset, crosses integers; a document is taken once per integer crossed. Documents stand in
order of size, every second one on the way up and the others on the way down: neighbours are alike, and both ends are
small, so any offset takes about as many words as the target asks for (to less than the largest document's share).

Positions in a source come from counts: by (source, size), by (source, size, salt), and a row number within
(source, size, salt) only, so a source with a third of all rows is never in one task. Sources are ranked and summed by
ranges, so their number is not bounded by a task either.

Defined results: null texts have size 0; a null source is a source of its own, last in order; a source without words
has target 0 and none of its documents are taken; null ids and repeated rows count as documents of their own (equal
rows may swap their copies, which no result shows); columns of any name are carried in a struct and can't clash; very
long texts count with all their words, and one larger than its target is taken as often as its places fall; an empty table
gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewalk.llm.common import SPACE_CLASS, save, table, text_or_empty, whole_row
from gradewalk.operators.ordered import running

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda x: x != "")).cast("long")


def _keyed(docs: DataFrame, row: Column) -> DataFrame:
    """row, source, size and k, a digest of id and text that orders documents of one size.

    src stands for source and is never null: joins on it can use the partitioning of the windows over it."""
    text = text_or_empty()
    k = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    return docs.select(row.alias("row"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), k.alias("k")).withColumn("salt", F.substring("k", 1, 2)).withColumn("src", _never_null("source"))


def _never_null(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, n_docs, target; one row per source."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = running(totals, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long")}, stored=True)
    weighted = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    # in order of the level at which a source is full: the capped ones come first
    by_level = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    filled = running(weighted, by_level, {"size_before": F.col("source_size"), "weight_before": F.col("weight")}, stored=True)
    whole = filled.agg(F.sum("source_size"), F.sum("weight")).first()  # two numbers
    number = lambda v: F.lit(v).cast("long")
    filled = filled.withColumn("left_over", number(whole[0]) - cap * F.col("size_before")).withColumn("weight_left", number(whole[1]) - F.col("weight_before"))
    filled = filled.withColumn("capped", F.col("left_over") * F.col("weight") >= cap * F.col("source_size") * F.col("weight_left"))
    least = F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "left_over", "weight_left")
    level = filled.agg(F.min(F.when(~F.col("capped"), least))).first()[0]  # the first source that is not full, if any
    share = number(level and level["left_over"]) * F.col("weight") / number(level and level["weight_left"])
    target = F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(share)
    return filled.select("source", "source_size", "n_docs", target.alias("target"))


def _offsets(keyed: DataFrame) -> DataFrame:
    """How many documents of the source stand before each (src, size, salt)."""
    cells = keyed.groupBy("src", "size", "salt").agg(F.count("*").alias("n"))
    sizes = cells.groupBy("src", "size").agg(F.sum("n").alias("n_size"))
    sizes = sizes.withColumn("before_size", F.sum("n_size").over(Window.partitionBy("src").orderBy("size")) - F.col("n_size")).drop("n_size")
    cells = cells.withColumn("before_salt", F.sum("n").over(Window.partitionBy("src", "size").orderBy("salt")) - F.col("n"))
    return cells.join(sizes, ["src", "size"]).select("src", "size", "salt", (F.col("before_size") + F.col("before_salt")).alias("before"))


def _placed(keyed: DataFrame, offsets: DataFrame) -> DataFrame:
    """row, src, size and pos, a document's place by size in its source, from 0. Window and join share one shuffle of the rows."""
    within = Window.partitionBy("src", "size", "salt").orderBy("k")
    ranked = keyed.withColumn("rn", F.row_number().over(within)).join(offsets, ["src", "size", "salt"])
    return ranked.select("row", "src", "size", (F.col("before") + F.col("rn") - 1).alias("pos"))


def _copies(cap: int) -> Column:
    """Integers crossed between a document's prefix sum and the next one."""
    at = F.when(F.col("pos") % 2 == 0, F.expr("pos div 2")).otherwise(F.col("n_docs") - 1 - F.expr("pos div 2"))  # up, then down
    upto = lambda n: F.floor(F.col("rate") * n + F.col("u"))
    return F.when(F.col("rate") >= cap, F.lit(cap).cast("long")).otherwise(upto(at + 1) - upto(at)).cast("long")


def plan(keyed: DataFrame, seed: str = SEED, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(offsets, rates) of a keyed table; rates has src, source_size, n_docs, target, rate, u."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("source"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    rated = source_targets(keyed, weights, cap).withColumn("rate", rate).withColumn("u", u).withColumn("src", _never_null("source"))
    return save(_offsets(keyed), "mix-offsets"), save(rated.drop("source"), "mix-rates")


def mix(docs: DataFrame, seed: str = SEED, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs' rows, each as often as the mix takes it."""
    offsets, rates = plan(save(_keyed(docs, F.lit(0)), "mix-sizes"), seed, cap, weights)
    copies = _placed(_keyed(docs, whole_row(docs)), offsets).join(rates, "src").select("row", _copies(cap).alias("copies")).filter("copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    keyed = save(_keyed(docs, F.struct(F.col("doc_id"))), "mix-sizes")
    offsets, rates = plan(keyed)
    rows = _placed(keyed, offsets).join(rates, "src")
    return rows.select("row.doc_id", "size", "source_size", F.round("target", 6).alias("target"), (_copies(CAP) * F.col("size")).alias("taken"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER w AS rn, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_over,
  CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS weight_left
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)),
c AS (SELECT *, left_over * weight >= 3 * source_size * weight_left AS capped FROM o),
l AS (SELECT left_over AS lo, weight_left AS wl FROM c WHERE NOT capped ORDER BY rn LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(lo * weight AS DOUBLE) / wl END AS target FROM c LEFT JOIN l ON true),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE CAST(0 AS DOUBLE) END AS rate,
  CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, k) - 1 AS by_size, count(*) OVER (PARTITION BY source) AS n_docs FROM d),
p AS (SELECT *, CASE WHEN by_size % 2 = 0 THEN by_size // 2 ELSE n_docs - 1 - by_size // 2 END AS pos FROM n)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(size * CASE WHEN rate >= 3 THEN 3 ELSE floor(rate * (pos + 1) + u) - floor(rate * pos + u) END AS BIGINT) AS taken
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source
"""
