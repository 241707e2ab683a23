"""Media columns as MPEG transport streams.

`mux` stores a payload of 8-bit samples in 188-byte transport packets: a program association table, a program map
table whose private descriptor keeps the unpadded length, and elementary packets with a time stamp and a random-access
point each. `demux` reads any such stream back: it parses the program tables, checks continuity counters, reassembles
elementary packets, and lists time stamps with their random-access points.

Defined results: null or empty text is 192 spaces of payload; the stored bytes depend on the text alone, so repeated
rows have equal values; null ids keep their rows; texts of any length are split over elementary packets; other columns, of
any name, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.llm.common import save, table, text_or_empty

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, PAT_PID, NULL_PID = 188, 0x47, 0x0000, 0x1FFF
TICKS = 90_000
# Our program's own choices.
PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID, LENGTH_TAG = 0x0100, 0x0101, 0x06, 0xBD, 0x80
SAMPLE_RATE, ALIGN = 8_000, 192
UNIT = ALIGN * 170
EMPTY_STUFFING = 0xFF


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint64) << np.uint64(24)
    for _ in range(8):
        c = np.where(c & np.uint64(0x80000000), (c << np.uint64(1)) ^ np.uint64(0x04C11DB7), c << np.uint64(1)) & np.uint64(0xFFFFFFFF)
    return c.astype(np.int64)


_CRC = _crc_table().tolist()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    packet = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section
    return packet + bytes([EMPTY_STUFFING]) * (PACKET - len(packet))


_PAT = _table_packet(PAT_PID, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))


def _pmt(n_bytes: int) -> bytes:
    info = bytes([LENGTH_TAG, 8]) + n_bytes.to_bytes(8, "big")
    stream = bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info
    return _table_packet(PMT_PID, _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + stream))


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def mux(text: bytes, unit: int = UNIT) -> bytes:
    """The stream of a text, padded with spaces to a positive multiple of 192 bytes."""
    payload = text + b" " * (-len(text) % ALIGN if text else ALIGN)
    out, counter = [_PAT, _pmt(len(text))], 0
    for at in range(0, len(payload), unit):
        part = payload[at : at + unit]
        pts = at * TICKS // SAMPLE_RATE & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + part
        clock = pts.to_bytes(5, "big")  # 33 bits of base, then 6 reserved and 9 of extension
        field = bytes([7, 0x50]) + (int.from_bytes(clock, "big") << 15 | 0x7E00).to_bytes(6, "big")
        first = PACKET - 4 - len(field)
        out.append(bytes([SYNC]) + (0x4000 | ES_PID).to_bytes(2, "big") + bytes([0x30 | counter]) + field + pes[:first])
        whole, rest = divmod(len(pes) - first, PACKET - 4)
        if whole:
            packets = np.empty((whole, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
            packets[:, 3] = 0x10 | (counter + 1 + np.arange(whole) & 15)
            packets[:, 4:] = np.frombuffer(pes, np.uint8, whole * (PACKET - 4), first).reshape(whole, -1)
            out.append(packets.tobytes())
        if rest:
            room = PACKET - 5 - rest
            stuffing = bytes([room]) + (b"\x00" + bytes([EMPTY_STUFFING]) * (room - 1) if room else b"")
            out.append(bytes([SYNC]) + ES_PID.to_bytes(2, "big") + bytes([0x30 | counter + whole + 1 & 15]) + stuffing + pes[len(pes) - rest :])
        counter = counter + whole + 1 + bool(rest) & 15
    return b"".join(out)


def _sections(packets: np.ndarray, at: np.ndarray, table_id: int) -> bytes:
    """The first whole section of a table that starts in one of these packets."""
    for packet, start in zip(packets, at, strict=True):
        data = packet[start:].tobytes()
        data = data[1 + data[0] :]
        if len(data) > 3 and data[0] == table_id:
            size = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)
            if size <= len(data) and section_crc(data[:size]) == 0:
                return data[:size]
    raise ValueError(f"no whole table {table_id}")


def demux(stream: bytes) -> dict:
    """payload, n_bytes, pts (ticks), raps ((pts, packet) of each random-access point), continuity_errors."""
    if not stream or len(stream) % PACKET:
        raise ValueError("not whole packets")
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("sync byte lost")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    starts, has_field, has_load, counter = (p[:, 1] & 0x40) > 0, (p[:, 3] & 0x20) > 0, (p[:, 3] & 0x10) > 0, p[:, 3] & 15
    at = np.where(has_field, 5 + p[:, 4].astype(np.int32), 4)
    tables = lambda n: starts & has_load & (pid == n)
    pat = _sections(p[tables(PAT_PID)], at[tables(PAT_PID)], 0)
    program = next(int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, len(pat) - 4, 4) if pat[i : i + 2] != b"\x00\x00")
    pmt = _sections(p[tables(program)], at[tables(program)], 2)
    i = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
    es, n_bytes = int.from_bytes(pmt[i + 1 : i + 3], "big") & 0x1FFF, None
    info = pmt[i + 5 : i + 5 + (int.from_bytes(pmt[i + 3 : i + 5], "big") & 0xFFF)]
    while info:
        if info[0] == LENGTH_TAG:
            n_bytes = int.from_bytes(info[2 : 2 + info[1]], "big")
        info = info[2 + info[1] :]
    own = np.flatnonzero((pid == es) & has_load)
    steps = np.diff(counter[own].astype(np.int16)) & 15
    repeated = np.concatenate([[False], steps == 0])  # a packet may be sent twice
    errors, own = int((steps > 1).sum()), own[~repeated]
    load, lengths = p[own][np.arange(PACKET) >= at[own, None]].tobytes(), PACKET - at[own]
    begins, ends = np.flatnonzero(starts[own]), np.concatenate([[0], np.cumsum(lengths)])
    payload, pts, raps = [], [], []
    for k, b in enumerate(begins):
        pes = load[ends[b] : ends[begins[k + 1]] if k + 1 < len(begins) else ends[-1]]
        if pes[:3] != b"\x00\x00\x01" or len(pes) != 6 + int.from_bytes(pes[4:6], "big"):
            errors += 1
            continue
        if pes[7] & 0x80:
            t = (pes[9] & 0x0E) << 29 | pes[10] << 22 | (pes[11] & 0xFE) << 14 | pes[12] << 7 | pes[13] >> 1
            pts.append(t)
            packet = own[b]
            if has_field[packet] and p[packet, 4] and p[packet, 5] & 0x40:
                raps.append((t, int(packet)))
        payload.append(pes[9 + pes[8] :])
    return {"payload": b"".join(payload), "n_bytes": n_bytes, "pts": pts, "raps": raps, "continuity_errors": errors}


def _slices(rows: Iterator[tuple], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about so many bytes of the rows' byte columns."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def store(docs: DataFrame) -> DataFrame:
    """doc_id and media, the stored stream of each text."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])
        yield from _slices(((i.as_py(), mux((t.as_py() or "").encode())) for b in batches for i, t in zip(*b.columns, strict=True)), schema)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, media binary")


def features(payload: bytes, pts: list[int], raps: list[tuple[int, int]]) -> str:
    """Units, random-access points, last time stamp, mean, mean square and sign changes about 64 of the samples."""
    s = np.frombuffer(payload, np.uint8).astype(np.int64)
    crossings = int(np.count_nonzero(np.diff(s >= 64)))
    return f"units={len(pts)};raps={len(raps)};last={pts[-1]};mean={int(s.sum()) * 1000 // len(s)};square={int((s * s).sum()) // len(s)};crossings={crossings}"


def read(media: DataFrame) -> DataFrame:
    """What is found in each stored stream, digests and features included; continuity errors fail the task."""
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, rap_packets array<long>"

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pts", pa.list_(pa.int64())), ("rap_packets", pa.list_(pa.int64()))])

        def rows():
            for b in batches:
                for i, m in zip(*b.columns, strict=True):
                    stream = m.as_py()
                    x = demux(stream)
                    if x["continuity_errors"]:
                        raise ValueError(f"continuity lost in the stream of document {i}")
                    load = x["payload"]
                    yield i.as_py(), x["n_bytes"], len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), features(load, x["pts"], x["raps"]), x["pts"], [k for _, k in x["raps"]]

        yield from _slices(rows(), schema)

    return media.select("doc_id", "media").mapInArrow(run, fields)


def op4_media_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(save(store(table(spark, sf_dir, "documents")), "media-streams"))
    return found.drop("pts", "rap_packets")
