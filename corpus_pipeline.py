"""The corpus pipeline: quality rules, line dedup, near-copy join, source mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradewalk.llm import jaccard, lines, mixing, packing, quality
from gradewalk.llm.common import save

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the production policy of the rule ledger.

    Null and empty texts have no words and are rejected; very long texts are measured whole; rows are judged one by one, so
    repeated rows and null ids stay or go alike; all columns, of any name, are kept; an empty table stays empty."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a document of smaller id has.

    Null texts become empty; very long texts are split whole; rows of one id are one document, and all null ids are one,
    after the others, so their common lines stay in all of their rows; other columns, of any name, are kept as they were
    (n_chars too); an empty table stays empty."""
    return lines.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least id, null last; of equal ids the least digest of the text.

    Null and empty texts are copies of each other, and one of them stays; very long texts are compared by all their
    shingles; of a repeated row one stays; all columns, of any name, are kept; an empty table stays empty."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, up to three times, as rows of their own.

    Null sources are one source, last in order; very long texts count with all their words; null and empty texts have no
    words and follow the places they get; equal rows count as documents of their own; all columns, of any name, are kept; an
    empty table stays empty."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end-of-text id alone; texts over a sequence's length are cut into pieces of it; each copy
    of a repeated row is packed, under its own place, and so are null ids; columns other than doc_id and text are not looked
    at; an empty table gives no pieces."""
    return packing.packed_digests(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_copies", near_copies), ("mix_sources", mix_sources), ("best_fit_packing", pack)]

#: The near-copy stage can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each reads what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
