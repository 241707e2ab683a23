"""Best-fit packing of token sequences.

Best-fit decreasing over all pieces of the corpus at once: a piece goes into the open sequence with the least room that
still holds it, found in a segment tree over the possible remainders (0 to the capacity). Which lengths go where depends
only on how many pieces have each length, so the plan is made from that histogram (at most `capacity` counts): sequences
of equal remainder are filled as one run, and the plan's size depends on the capacity, not on the corpus. Pieces find
their place in the plan by their length and their rank among pieces of that length.

Ranks are counted by (length, salt), so no task meets all pieces of one length. The plan is broadcast; it has at most a
few rows for each pair of a length and a remainder, and its size is checked.

Defined results: a null or empty text is the end-of-text id alone; only documents longer than the capacity are cut; rows
with null or repeated ids are packed as documents of their own (equal pieces may swap their places, which no result
shows); pieces of equal length go in order of id and piece; other columns, of any name, are not looked at; an empty table
gives no sequences.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradewalk.llm.common import save, table, text_or_empty

CAPACITY, END_ID = 4096, 1
SALTS = 1024
#: Rows of a plan; 48 bytes each.
PLAN_MOST = 2_000_000
#: Words kept with their ids by each worker, and the longest word that is encoded together with others.
CACHE_MOST, WORD_MOST = 400_000, 64
#: Marks that form one token, apart from the word of letters before them.
MARKS = ".,;:!?#$%&*()[]{}|/+=~-"
#: Letters that NFC takes apart into a letter and a mark (none is beyond the second plane), and those whose lower case
#: depends on their neighbours or on who lowers them.
APART = "".join(c for c in map(chr, range(0x20000)) if c.isalpha() and not unicodedata.normalize("NFC", c).isalpha())
UNLIKE = f"[\u03a3\u0130{APART}]"
TAIL = "(?P<t>[" + re.escape(MARKS) + "]+)$"


class WordEncoder:
    """Token ids of whole texts as little-endian 32-bit bytes, with the ids of frequent words remembered.

    The vocabulary's pre-tokenizer never joins across white space, and its normalizer works within
    words, so a text's ids are those of its words between ASCII white space in order. Unknown words of letters only are encoded
    together: a word's last id, and no other, is one whose token has the end-of-word suffix, so its ids can be cut
    out. All others are encoded one by one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix, self.ends = model["end_of_word_suffix"], np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[k for w, k in model["vocab"].items() if w.endswith(suffix)]] = True
        # for normalized words of letters between spaces: the same merges without the normalizer and the word pattern
        bytes_only = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytes_only]}}
        self.plain = Tokenizer.from_str(json.dumps(spec))
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids, self.size = pa.array([""], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _one(self, word: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4")

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each) of some words of letters only."""
        text = unicodedata.normalize("NFC", " ".join(words)).lower()
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or len(cuts) and cuts[-1] != len(ids):
            return _joined([self._one(w) for w in words])
        return ids, np.diff(cuts, prepend=0)

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each) of some words: letters and the marks after them apart, all others one by one."""
        stems = pc.utf8_rtrim(words, characters=MARKS)
        plain = pc.and_(pc.utf8_is_alpha(stems), pc.less_equal(pc.utf8_length(stems), WORD_MOST))
        plain = pc.and_(plain, pc.invert(pc.match_substring_regex(stems, UNLIKE))).to_numpy(zero_copy_only=False)
        easy, hard = np.flatnonzero(plain), np.flatnonzero(~plain)
        coded = stems.take(pa.array(easy)).dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(known < 0)
        new, found = coded.dictionary.take(pa.array(fresh)).to_pylist(), []
        for at in range(0, len(new), 20_000):
            found.append(self._together(new[at : at + 20_000]))
        tails = pc.struct_field(pc.extract_regex(words.take(pa.array(easy)), TAIL), "t").dictionary_encode()
        marks = _joined([self._one(t) for t in tails.dictionary.to_pylist()])
        rest = _joined([self._one(w) for w in words.take(pa.array(hard)).to_pylist()])
        # one pool of entries: known words, new stems, tails, an empty entry, hard words; a word is two of them in order
        parts = [(self.ids, self.size), *found, marks, (np.zeros(0, "<u4"), np.zeros(1, np.int64)), rest]
        ids, size = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        first_mark = len(self.size) + len(new)
        nothing = first_mark + len(marks[1])
        known[fresh] = len(self.size) + np.arange(len(fresh))
        entries = np.full((len(words), 2), nothing)
        entries[easy, 0] = known[coded.indices.to_numpy()]
        tail = pc.fill_null(tails.indices, -1).to_numpy()
        entries[easy, 1] = np.where(tail < 0, nothing, first_mark + tail)
        entries[hard, 0] = nothing + 1 + np.arange(len(hard))
        return _gathered(ids, size, entries.ravel()), size[entries].sum(axis=1)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text begins, and the end)."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy()
        entry = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(entry < 0)
        unknown = words.take(pa.array(missing))
        more, more_size = self._learn(unknown)
        ids, size = np.concatenate([self.ids, more]), np.concatenate([self.size, more_size])
        entry[missing] = len(self.size) + np.arange(len(missing))
        if len(self.words) < CACHE_MOST:
            self.words, self.ids, self.size = pa.concat_arrays([self.words, unknown]), ids, size
        elif 2 * len(missing) > len(words):  # other texts than before
            self._forget()
        used = entry[code]
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        return _gathered(ids, size, used), np.concatenate([[0], np.cumsum(size[used])])[bounds]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, bounds = self.encode_all(pa.array(texts, pa.string()))
        return [ids[s:e].tobytes() for s, e in zip(bounds, bounds[1:], strict=False)]


def _joined(entries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, "<u4"), *entries]), np.array([len(e) for e in entries], np.int64)


def _gathered(ids: np.ndarray, size: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The ids of the used entries one after another; entry k holds size[k] ids, in order."""
    n = size[used]
    place = np.repeat((np.cumsum(size) - size)[used] - (np.cumsum(n) - n), n)
    place += np.arange(len(place))
    return ids[place]


def _parts(batch: pa.RecordBatch, most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """A batch (id, text) in slices of about so many bytes of text, of a row at least."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's pieces, and their ids unless left out.

    ids are little-endian unsigned 32-bit numbers, and the checksum is theirs."""
    end = np.array([end_id], "<u4").tobytes()
    fields = [("doc_id", pa.int64(), "long"), ("piece", pa.int32(), "int"), ("start", pa.int64(), "long"), ("length", pa.int64(), "long"), ("ids_crc32", pa.int64(), "long"), ("ids", pa.binary(), "binary")]
    fields = fields if with_ids else fields[:-1]
    schema = pa.schema([(n, t) for n, t, _ in fields])

    def run(batches):
        encoder = WordEncoder(tokenizer)
        for batch in batches:
            for part in _parts(batch):
                all_ids, bounds = encoder.encode_all(part.column(1))
                rows = []
                for doc, s, e in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = all_ids[s:e].tobytes() + end
                    for k, b in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[b : b + 4 * capacity]
                        rows.append((doc, k, b // 4, len(cut) // 4, zlib.crc32(cut), cut))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=False)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, ", ".join(f"{n} {t}" for n, _, t in fields))


class RoomTree:
    """Which remainders have open sequences; finds the least one of at least a given length in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, room: int, open_: bool) -> None:
        node = room + self.leaves
        self.any[node] = open_
        while node > 1:
            node >>= 1
            self.any[node] = self.any[2 * node] | self.any[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        node = length + self.leaves
        while not self.any[node]:
            while node & 1:  # a right child: everything right of it is above
                node >>= 1
            if node == 0:
                return None
            node += 1
            if node & (node - 1) == 0:  # past the right edge of its level
                return None
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (by length and first rank: length, first rank, first sequence, pieces in each sequence, offset of the first), and the sequences used.

    Ranks from a row's first rank up to the next row's are its; the piece of rank r goes to sequence
    first + (r - first rank) // each, at offset + (r - first rank) % each * length."""
    tree, runs, rows, used = RoomTree(capacity), {}, [], 0

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            runs.setdefault(room, []).append((first, count))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:  # open as many sequences as the rest needs
                room, first, count = capacity, used, -(-left // (capacity // length))
                used += count
            else:
                first, count = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
            each = room // length
            rows.append((length, rank, first, each, capacity - room))
            taken = min(left, each * count)
            full, part = divmod(taken, each)
            put(room - each * length, first, full)
            if part:
                put(room - part * length, first + full, 1)
            put(room, first + full + bool(part), count - full - bool(part))
            rank, left = rank + taken, left - taken
    found = np.array(rows, np.int64).reshape(-1, 5)
    return found[np.lexsort((found[:, 1], found[:, 0]))], used


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found, a saved table with doc_id, piece and length, with sequence_id and offset."""
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    cells = save(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "pack-cells")
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = best_fit_plan(histogram, capacity)
    if len(plan) > PLAN_MOST:
        raise ValueError(f"a plan of {len(plan)} rows")
    before = cells.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("salt", "length").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rn", F.row_number().over(order)).join(before, ["salt", "length"])
    ranked = ranked.select(*[F.col(f"`{c}`") for c in found.columns], (F.col("before") + F.col("rn") - 1).alias("rank"))
    shared = found.sparkSession.sparkContext.broadcast(plan)

    def run(batches):
        p = shared.value
        keys = p[:, 0] << 44 | p[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = p[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            k = rank - row[:, 1]
            kept = [b.column(c) for c in b.schema.names if c != "rank"]
            names = [c for c in b.schema.names if c != "rank"] + ["sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(row[:, 2] + k // row[:, 3]), pa.array(row[:, 4] + k % row[:, 3] * length)], names=names)

    schema = found.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All pieces of docs with their ids, sequence and offset."""
    return place(save(pieces(docs, tokenizer, capacity, end_id), "pack-pieces"), capacity)


def packed_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """pack without the ids themselves, of which a checksum stays."""
    return place(save(pieces(docs, tokenizer, with_ids=False), "pack-pieces"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
