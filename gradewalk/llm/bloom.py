"""Bloom filters built in segments by Spark and broadcast at a bounded size.

A filter has BITS_A_KEY bits for each key up to MOST bytes in all. Beyond that it lets more rows through; whoever uses
one follows it with an exact step, so its size changes costs, never results."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBES, BITS_A_KEY, MOST = 4, 10, 64 << 20
SEGMENTS = 256  # by the upper 8 bits of a hash


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES places in a segment of so many bits (a power of two) for each hash."""
    step = (h >> np.uint64(20)) | np.uint64(1)
    return ((h[None] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(13)) + np.arange(PROBES, dtype=np.uint64)[:, None] * step) & np.uint64(bits - 1)


def segment(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(56)).astype(np.int64)


def segment_bits(n: int) -> int:
    """Bits of a segment for so many keys in all."""
    bits, most = 1 << 12, MOST * 8 // SEGMENTS
    while bits < most and bits * SEGMENTS < BITS_A_KEY * n:
        bits <<= 1
    return bits


def by_segment(h: np.ndarray):
    """(segment, hashes) of each segment among some hashes."""
    s = segment(h)
    order = np.argsort(s, kind="stable")
    s, h = s[order], h[order]
    cuts = np.flatnonzero(np.diff(s)) + 1
    firsts = s[np.concatenate([[0], cuts])].tolist() if len(s) else []
    return zip(firsts, np.split(h, cuts), strict=False)


def contains(packed: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Whether the filter (all segments' packed bits one after another) may have each hash."""
    place = slots(h, bits).astype(np.int64) + segment(h)[None] * bits
    return (packed[place >> 3] >> (7 - (place & 7)) & 1).all(axis=0)


def collected(rows: DataFrame, bits: int) -> bytes:
    """All segments in order from rows (seg, bits); MOST bytes at most reach the driver."""
    empty = bytes(bits // 8)
    found = {r["seg"]: bytes(r["bits"]) for r in rows.collect()}
    return b"".join(found.get(s, empty) for s in range(SEGMENTS))


def packed(hashes: DataFrame, n: int) -> tuple[bytes, int]:
    """A filter of about n hashes (a column h), and the bits of a segment."""
    bits = segment_bits(n)

    def fill(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for s, part in by_segment(b.column(0).to_numpy().view(np.uint64)):
                held.setdefault(s, np.zeros(bits, bool))[slots(part, bits).ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], names=["seg", "bits"])

    dealt = hashes.repartition(SEGMENTS // 4, F.shiftrightunsigned("h", 56))
    return collected(dealt.mapInArrow(fill, "seg long, bits binary"), bits), bits


def may_be_in(keys: DataFrame, columns: list[str]) -> Column:
    """A predicate over `columns` of another table: true for all rows of keys, and for few others.

    keys is a saved table; it is read twice."""
    bits = segment_bits(keys.count())

    def fill(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for s, part in by_segment(b.column(1).to_numpy().view(np.uint64)):
                held.setdefault(s, np.zeros(bits, bool))[slots(part, bits).ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], names=["seg", "bits"])

    h = F.xxhash64(*columns)
    dealt = keys.select(F.shiftrightunsigned(h, 56).alias("seg"), h.alias("h")).repartition(SEGMENTS // 4, "seg")
    shared = keys.sparkSession.sparkContext.broadcast(collected(dealt.mapInArrow(fill, "seg long, bits binary"), bits))

    @F.pandas_udf("boolean")
    def test(v: pd.Series) -> pd.Series:
        return pd.Series(contains(np.frombuffer(shared.value, np.uint8), bits, v.to_numpy().astype(np.int64).view(np.uint64)))

    return test(h)
