"""Line dedup with two Bloom filters.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Keys of at least 10 code
points that two documents hold lose all their lines but those in the document of smallest id.

1. Each document's distinct keys go to the filters as 64-bit hashes. The filters are cut into segments by hash; in each
   segment a hash that the once-seen filter already has is put into the twice-seen filter.
2. Documents are read again; only keys that the twice-seen filter has are shuffled, and grouped by the key itself. That
   is exact: a false positive of the filter has one document only and falls out here.
3. Each text gets those of its own keys that its document has to drop, and loses those lines. Texts are told apart by a
   hash beside the id, so rows of one id, or all rows without one, don't share a list that grows with their number.

The twice-seen filter is broadcast at a bounded size (see bloom); when full it lets more keys through to the exact step,
which changes the cost, not the result.

Defined results: a null or empty text is one empty line; rows of equal doc_id are one document; null ids together are
one document, after all others, so that of their common keys all rows keep the lines; very long texts are split whole, in one
row's memory; other columns are carried in a
struct, so names like did can't clash; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.llm.bloom import SEGMENTS, by_segment, collected, contains, segment, segment_bits, slots
from gradewalk.llm.common import SPACE_CHARS, save, table, text_or_empty

KEY_LEAST = 10
_ENDS = SPACE_CHARS.encode()
_NO_ID = (1 << 63) - 1


def key(line: bytes) -> bytes:
    return line.strip(_ENDS).lower()  # of bytes: A-Z only


def _long(k: bytes, least: int) -> bool:
    return len(k) >= least and (len(k) >= 4 * least or len(k.decode()) >= least)


def doc_keys(text: str, least: int = KEY_LEAST) -> set[bytes]:
    return {k for k in map(key, set(text.encode().split(b"\n"))) if _long(k, least)}


class Segment:
    """The once-seen and twice-seen filters of one segment."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits, bool), np.zeros(bits, bool)

    def add(self, h: np.ndarray) -> None:
        h, n = np.unique(h, return_counts=True)
        places = slots(h, self.bits)
        again = (n > 1) | self.once[places].all(axis=0)
        self.twice[places[:, again].ravel()] = True
        self.once[places.ravel()] = True


def _identified(docs: DataFrame) -> DataFrame:
    """did, tid (a hash of the text; texts of one hash only share their lists of keys) and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64(text_or_empty()).alias("tid"), text_or_empty().alias("text"))


def twice_seen(docs: DataFrame, least: int = KEY_LEAST) -> tuple[bytes, int]:
    """The twice-seen filter, segment by segment, and the bits of a segment."""

    def hashes(batches):
        for b in batches:
            found = [xxhash.xxh3_64_intdigest(k) for t in b.column(0) for k in doc_keys(t.as_py(), least)]
            h, n = np.unique(np.array(found, np.uint64), return_counts=True)
            h = np.repeat(h, np.minimum(n, 2))  # twice says as much as a thousand times
            yield pa.RecordBatch.from_arrays([pa.array(segment(h)), pa.array(h.view(np.int64))], names=["seg", "h"])

    rows = save(_identified(docs).select("text").mapInArrow(hashes, "seg long, h long"), "line-hashes")
    bits = segment_bits(rows.count())

    def fill(batches):
        held: dict[int, Segment] = {}
        for b in batches:
            for s, part in by_segment(b.column(1).to_numpy().view(np.uint64)):
                held.setdefault(s, Segment(bits)).add(part)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x.twice).tobytes() for x in held.values()], pa.binary())], names=["seg", "bits"])

    return collected(rows.repartition(SEGMENTS // 4, "seg").mapInArrow(fill, "seg long, bits binary"), bits), bits


def suspects(docs: DataFrame, least: int = KEY_LEAST) -> DataFrame:
    """did, tid and key of all keys that the twice-seen filter has, each once a row of docs."""
    twice, bits = twice_seen(docs, least)
    shared = docs.sparkSession.sparkContext.broadcast(twice)

    def run(batches):
        packed = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            keys, many = [], []
            for t in b.column(2):
                own = doc_keys(t.as_py(), least)
                keys += own
                many.append(len(own))
            h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
            seen = np.flatnonzero(contains(packed, bits, h))
            rows = pa.array(np.repeat(np.arange(b.num_rows), many)[seen])
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array([keys[k].decode() for k in seen.tolist()], pa.string())], names=["did", "tid", "key"])

    return _identified(docs).mapInArrow(run, "did long, tid long, key string")


def drops(docs: DataFrame, least: int = KEY_LEAST) -> DataFrame:
    """did, tid and the array of keys that this text loses: keys of its own."""
    suspected = save(suspects(docs, least), "line-suspects")
    held = suspected.groupBy("key").agg(F.min("did").alias("first"), F.max("did").alias("last")).filter("first < last")
    held = save(held, "line-first")  # joined by an exchange of its own, a common line's partition can be split
    lost = suspected.join(held, "key").filter("did > first")
    return lost.groupBy("did", "tid").agg(F.collect_set("key").alias("keys"))


def without(text: str, keys: list[str] | None) -> tuple[int, int, str]:
    """Lines, dropped lines and the kept text."""
    lines = text.split("\n")
    if not keys:
        return len(lines), 0, text
    lost = {k.encode() for k in keys}
    kept = [x for x in lines if key(x.encode()) not in lost]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def _cleaned(docs: DataFrame, least: int) -> DataFrame:
    """docs with their columns packed in `row`, and n_lines, n_dropped, kept (the text left)."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), text_or_empty().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64(text_or_empty()).alias("tid"))
    joined = packed.join(drops(docs, least), ["did", "tid"], "left").select("row", "text", "keys")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                out = [without(t, k) for t, k in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                n, d, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_lines", "n_dropped", "kept"])

    schema = joined.select("row").schema.add("n_lines", "long").add("n_dropped", "long").add("kept", "string")
    return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, least: int = KEY_LEAST) -> DataFrame:
    """docs with repeated lines taken out of text; all other columns as they were."""
    cleaned = _cleaned(docs, least)
    return cleaned.select(*[F.col("kept").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _cleaned(docs, KEY_LEAST).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, i, ls[i] AS line, lower_ascii AS k, len(ls) AS n FROM (
  SELECT doc_id, ls, i, translate(regexp_replace(regexp_replace(ls[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))),
f AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, f.k IS NOT NULL AND l.doc_id > f.first AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
