"""The objects of an array at the top of JSON texts, read in ranges of their bytes.

Whether a byte stands in a string, and how deep, follows from all bytes before it. Each range says what it does to that, for
each state it may begin in; a row a range is put together for each file; then each range finds the objects that begin in it,
and reads on to the end of the last. Texts are UTF-8, as the format asks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.sources.ranges import Ranges, by_range

#: Bytes that a task reads at once, and how far an array's name may stand before it.
READ_AT_ONCE, LOOK_BACK = 16 << 20, 1 << 16
#: What a range may begin in: (in a string, after a backslash).
_BEGINNINGS = ((False, False), (True, False), (True, True))


def _marks(data: bytes, quoted: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """Places of brackets outside strings, how much each changes the depth, and whether the end is quoted, and after a backslash."""
    a = np.frombuffer(data, np.uint8)
    slash = np.flatnonzero(a == ord("\\"))
    if escaped and len(slash) and slash[0] == 0:
        slash = slash[1:]
    first = np.diff(slash, prepend=-2) > 1
    escapes = slash[(slash - slash[first][np.cumsum(first) - 1]) % 2 == 0] if len(slash) else slash
    quotes = np.flatnonzero(a == ord('"'))
    quotes = quotes[~np.isin(quotes, escapes + 1) & ~((quotes == 0) & escaped)]
    at = np.flatnonzero((a == ord("{")) | (a == ord("}")) | (a == ord("[")) | (a == ord("]")))
    at = at[(np.searchsorted(quotes, at) + quoted) % 2 == 0]
    step = np.where((a[at] == ord("{")) | (a[at] == ord("[")), 1, -1)
    last = bool(len(escapes) and escapes[-1] == len(a) - 1) if len(a) else escaped
    return at, step, bool((len(quotes) + quoted) % 2), last


def _whole(text: Ranges, at: int, end: int) -> tuple[bytes, bytes]:
    """The bytes before a range, and its own."""
    low = max(0, at - LOOK_BACK)
    both = text.read(low, end - low)
    return both[: at - low], both[at - low :]


def _opens(before: bytes, data: bytes, name: str) -> np.ndarray:
    """Places in data of brackets that open an array of this name, in strings or not."""
    opens = re.compile(rb'"' + re.escape(name.encode()) + rb'"\s*:\s*\[')
    return np.array([k.end() - 1 - len(before) for k in opens.finditer(before + data) if k.end() > len(before)], np.int64)


def _told(text: Ranges, at: int, end: int, name: str) -> list[dict]:
    """For each beginning: the state at the end, the change of depth and its lowest, and the named arrays that may be at the top."""
    before, data = _whole(text, at, end)
    heard = _opens(before, data, name)
    found = []
    for quoted, escaped in _BEGINNINGS:
        places, step, q, e = _marks(data, quoted, escaped)
        depth = np.cumsum(step)
        lowest = np.minimum.accumulate(depth[::-1])[::-1]
        near = np.flatnonzero(np.isin(places, heard))
        tops = [{"before": int(depth[k] - 1), "lowest": int(lowest[k])} for k in near.tolist()]
        found.append({"quoted": q, "escaped": e, "net": int(depth[-1]) if len(depth) else 0, "lowest": int(min(0, lowest[0])) if len(depth) else 0, "tops": tops})
    return found


_TOLD = "array<struct<quoted:boolean,escaped:boolean,net:long,lowest:long,tops:array<struct<before:long,lowest:long>>>>"
_STATE = "path string, at long, end long, depth long, quoted boolean, escaped boolean, open boolean"


def _states(rows: pa.Table) -> pa.Table:
    """What each range of a file begins in."""
    quoted = escaped = inside = False
    depth, found = 0, []
    for r in sorted(rows.to_pylist(), key=lambda r: r["at"]):
        found.append((r["path"], r["at"], r["end"], depth, quoted, escaped, inside))
        t = r["told"][_BEGINNINGS.index((quoted, escaped))]
        inside = inside and depth + t["lowest"] >= 2 or any(depth + x["before"] == 1 and depth + x["lowest"] >= 2 for x in t["tops"])
        depth, quoted, escaped = depth + t["net"], t["quoted"], t["escaped"]
    names, types = [c.split()[0] for c in _STATE.split(", ")], [pa.string(), *[pa.int64()] * 3, *[pa.bool_()] * 3]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*found, strict=True), types, strict=True)})


def _objects(text: Ranges, at: int, end: int, depth: int, quoted: bool, escaped: bool, inside: bool, name: str, at_once: int):
    """Place and bytes of the named array's objects that begin in a range."""
    before, data = _whole(text, at, end)
    places, step, quoted, escaped = _marks(data, quoted, escaped)
    after = depth + np.cumsum(step)
    top = np.flatnonzero((step > 0) & (after == 2))
    named = np.append(np.isin(places[top], _opens(before, data, name)), inside)  # the last is the array that was open before
    opened = np.flatnonzero((step > 0) & (after == 3))
    closed = np.flatnonzero((step < 0) & (after == 2))
    mine = named[np.searchsorted(top, opened) - 1] if len(top) else np.full(len(opened), inside)
    mine &= np.frombuffer(data, np.uint8)[places[opened]] == ord("{")
    ends = np.searchsorted(closed, opened)
    for k, e, own in zip(places[opened].tolist(), ends.tolist(), mine.tolist(), strict=True):
        if own and e < len(closed):
            yield at + k, data[k : int(places[closed[e]]) + 1]
        elif own:  # it ends in another range
            parts, deep, here = [data[k:]], int(after[-1]), end
            while deep >= 3:
                more = text.read(here, at_once)
                if not more:
                    return
                found, change, quoted, escaped = _marks(more, quoted, escaped)
                done = np.flatnonzero(deep + np.cumsum(change) < 3)
                parts.append(more[: int(found[done[0]]) + 1] if len(done) else more)
                deep, here = 0 if len(done) else deep + int(change.sum()), here + len(more)
            yield at + k, b"".join(parts)


def read_objects(spark: SparkSession, path: str, name: str, at_once: int = READ_AT_ONCE) -> DataFrame:
    """path, at (the byte where it begins) and text of each object in the array of this name at the top of JSON files.

    A file is read by as many tasks as it has ranges; of a store that Arrow can't open, by one."""
    ranged = by_range(path)
    files = spark.read.format("binaryFile").load(path)
    step = F.greatest(F.lit(0), F.expr(f"(length - 1) div {at_once}")) if ranged else F.lit(0)
    size = at_once if ranged else 1 << 62
    begin = files.select("path", "length", F.lit(None).cast("binary").alias("content") if ranged else "content", F.explode(F.sequence(F.lit(0), step)).alias("k"))
    parts = begin.select("path", (F.col("k").cast("long") * size).alias("at"), F.least(F.col("length"), (F.col("k").cast("long") + 1) * size).alias("end"), "content").filter("end > at")
    tasks = max(1, parts.count())  # rows of a few bytes stand for much work: their number is given, so that they aren't put together
    parts = parts.repartition(tasks)

    def tell(batches):
        types = [pa.string(), pa.int64(), pa.int64()]
        told = pa.list_(pa.struct([("quoted", pa.bool_()), ("escaped", pa.bool_()), ("net", pa.int64()), ("lowest", pa.int64()), ("tops", pa.list_(pa.struct([("before", pa.int64()), ("lowest", pa.int64())])))]))
        for b in batches:
            for f, at, end, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with Ranges(f, content) as text:
                    own = _told(text, at, end, name)
                yield pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip((f, at, end), types, strict=True)), pa.array([own], told)], names=["path", "at", "end", "told"])

    states = parts.mapInArrow(tell, f"path string, at long, end long, told {_TOLD}").groupBy("path").applyInArrow(_states, _STATE)
    known = (states if ranged else states.join(files.select("path", "content"), "path")).repartition(tasks)

    def cut(batches):
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for row in zip(*columns, strict=True):
                f, at, end, depth, quoted, escaped, inside = row[:7]
                with Ranges(f, *row[7:]) as text:
                    held, n = [], 0
                    for place, body in _objects(text, at, end, depth, quoted, escaped, inside, name, at_once):
                        held.append((f, place, body.decode("utf-8", "replace")))
                        n += len(body)
                        if n > 4 << 20:
                            yield batch(held)
                            held, n = [], 0
                    yield batch(held)

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["path", "at", "text"])

    return known.mapInArrow(cut, "path string, at long, text string")
