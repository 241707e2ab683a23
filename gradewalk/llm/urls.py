"""URL filters: a list of domain and path rules first, association rules for what the list leaves open.

The list's own decisions are the labels. FP-growth mines combinations of URL tokens that go with `block` or `allow`;
rules below a support or a confidence, and rules that a part of them already gives with as much confidence, are pruned.
The rest are held in an inverted index from each rule's rarest token: a URL meets only the rules filed under one of its
tokens, and a rule fits if all of its tokens are in the URL. The most confident fitting rule decides, then the one of
higher support, then block; without one the verdict is allow.

Defined results: a null url, or one without `://`, has empty host and path, no list rule and the verdict allow; each
row is judged alone, so repeated rows and null ids keep theirs; an empty table, or one with fewer than
MIN_COUNT listed URLs, mines nothing; very long URLs bring all their tokens; columns other than page_id and url, of any name
(host, path or rule too), are not looked at and can't clash.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.llm.common import save, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: host, path, verdict
LIST = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.9
#: Labelled URLs that a token combination needs at least, however few there are.
MIN_COUNT = 20
#: The rule list is written into the plan as literals; longer lists are refused.
LIST_MOST = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def list_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct<size, rule, verdict>; null if none does."""
    if len(rules) > LIST_MOST:
        raise ValueError(f"more than {LIST_MOST} list rules")
    fits = [F.when((F.concat(F.lit("."), host).endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.array(*fits))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens: top level, site (the last two labels), other labels, all path parts (digits as #), query keys, scheme."""
    tag = lambda mark, c: F.transform(c, lambda x: F.concat(F.lit(mark), x))
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "#"), "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"\A([^=]*)", 1)), lambda x: x != "")
    found = F.concat(tag("top:", F.slice(labels, -1, 1)), tag("site:", F.array(F.substring_index(host, ".", -2))), tag("sub:", F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0)))), tag("path:", parts), tag("key:", keys), tag("scheme:", F.array(F.regexp_extract(url, r"\A([^:]*)", 1))))
    return F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, hit (the list rule or null), items."""
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    return base.select("page_id", "host", "path", list_rule(F.col("host"), F.col("path"), rules).alias("hit"), F.when(F.col("host") != "", tokens(F.col("url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>")).alias("items"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Pruned rules (antecedent, block, confidence, support) from items and verdict of labelled URLs."""
    baskets = labelled.select(F.concat("items", F.array(F.concat(F.lit("!"), F.col("verdict")))).alias("items"))
    empty = labelled.sparkSession.createDataFrame([], "antecedent array<string>, block boolean, confidence double, support double")
    n = baskets.count()
    if n < MIN_COUNT:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, MIN_COUNT / n), minConfidence=min_confidence).fit(baskets)
    said = F.element_at("consequent", 1)
    rules = model.associationRules.filter(said.isin("!block", "!allow")).select(F.array_sort("antecedent").alias("antecedent"), (said == "!block").alias("block"), "confidence", "support")
    rules = save(rules, "url-rules")
    # a rule falls to one with a part of its tokens, the same verdict and as much confidence; both share that part's first token
    r, s = rules.select("*", F.explode("antecedent").alias("token")).alias("r"), rules.select("*", F.element_at("antecedent", 1).alias("token")).alias("s")
    part = (F.size("s.antecedent") < F.size("r.antecedent")) & (F.size(F.array_except("s.antecedent", "r.antecedent")) == 0)
    fallen = r.join(s, (F.col("r.token") == F.col("s.token")) & (F.col("r.block") == F.col("s.block")) & part & (F.col("s.confidence") >= F.col("r.confidence")))
    fallen = fallen.select("r.antecedent", "r.block").distinct()
    return rules.join(fallen, ["antecedent", "block"], "left_anti")


def indexed(rules: DataFrame) -> DataFrame:
    """The inverted index: each rule under its rarest token among rules' tokens."""
    exploded = rules.withColumn("token", F.explode("antecedent"))
    often = exploded.groupBy("token").count()
    rare = F.min(F.struct("count", "token"))["token"].alias("token")
    return exploded.join(often, "token").groupBy("antecedent", "block", "confidence", "support").agg(rare)


def decide(seen: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct token sets with the verdict of the rules, where a rule fits: (items, blocked)."""
    sets = seen.select("items").distinct()
    met = sets.select("items", F.explode("items").alias("token")).join(indexed(rules), "token")
    met = met.filter(F.size(F.array_except("antecedent", "items")) == 0)
    return met.groupBy("items").agg(F.max(F.struct("confidence", "support", "block"))["block"].alias("blocked"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = LIST, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages."""
    seen = judged(pages, rules)
    mined = mine(seen.filter("hit IS NOT NULL").select("items", "hit.verdict"), min_support, min_confidence)
    verdicts = decide(seen.filter("hit IS NULL AND host <> ''"), save(mined, "url-rules"))
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    joined = seen.join(save(verdicts, "url-verdicts"), "items", "left")  # saved: a common token set's partition can be split
    return joined.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.when(F.col("hit").isNotNull(), F.col("hit.verdict")).otherwise(own).alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
