"""Token ids in binary files: each shard is a wavelet matrix over the ids of some whole documents, in order of their identifiers.

Documents are range-partitioned by identifier, encoded where they land, and cut into shards. A shard is one row of a Parquet table, which Spark's
committer writes, so a lost task leaves nothing behind; its columns hold the shard's place, its documents and the wavelet matrix file itself.
"""

from __future__ import annotations

import json
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mix, partitions, ragged, shared_dir, steps, text_of, tidy, utf8
from .wavelet import WaveletMatrix

#: Ids after which a shard is closed; a document is never cut, so one of more ids is a shard by itself.
SHARD_IDS = 1 << 20
END_ID = 2
SCHEMA = "part int, shard int, first_id long, n_ids long, doc_ids array<long>, lengths array<long>, matrix binary"
#: Bytes of text that are encoded at once (what that takes is some thirty times as much), and pieces that a Python worker remembers the ids of, so few that its
#: arrays stay at 1 << 20 entries with what a step adds; longer pieces than so many bytes are not remembered, so that a byte holds a piece's size and its ids' number.
ENCODE_BYTES, REMEMBERED, LONGEST = 1 << 18, 7 << 17, 128

_BYTE = np.arange(256)
_LETTER = (_BYTE >= 65) & (_BYTE <= 90) | (_BYTE >= 97) & (_BYTE <= 122)
_PRINTED = (_BYTE > 32) & (_BYTE < 127)
_MARK = _PRINTED & ~_LETTER & (_BYTE != 39)
_LINE = (_BYTE >= 9) & (_BYTE <= 13)
#: The characters by which byte-level vocabularies write bytes: printed ones as they are, the others from 256 on.
_SHOWN = _PRINTED | (_BYTE > 160) & (_BYTE != 173)
_WRITTEN = np.where(_SHOWN, _BYTE, 255 + np.cumsum(~_SHOWN)).astype("<u4")
_LANE = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece of the texts begins, and of each byte whether it belongs to a letter of Latin-1.

    A byte-level tokenizer with the usual split pattern cuts a text at all of these places, whatever else is in it: before a space between two characters
    that are not white space; between a letter and an ASCII character that is none; before a letter that follows a mark or digit (an apostrophe may
    open a contraction, so it does not count) or a single line end after one. So the ids of a text are those of its pieces on end.
    """
    b = np.concatenate([np.zeros(3, np.uint8), raw, np.zeros(2, np.uint8)])
    at, before, second, third, after = b[3:-2], b[2:-3], b[1:-4], b[:-5], b[4:-1]
    tail = (at >= 0x80) & (at < 0xC0) & (before == 0xC3) & (at != 0x97) & (at != 0xB7)
    ends = _LETTER[at] | tail
    starts = _LETTER[at] | (at == 0xC3) & (after != 0x97) & (after != 0xB7)
    ended = np.concatenate([[False], ends[:-1]])
    closed = np.concatenate([[False], (ends | _PRINTED[at])[:-1]])
    # white space beyond ASCII is written with these leads; what may be such is not cut at
    wide = (before >= 0x80) & (second != 0xC2) & (third < 0xE1) | (before >= 0x80) & (third > 0xE3) & (second != 0xC2)
    cut = (at == 32) & (closed | wide) & (_PRINTED[after] | (after >= 0xC3) & ((after < 0xE1) | (after > 0xE3)))
    cut |= ended & (at < 0x80) & ~_LETTER[at]
    cut |= starts & (_MARK[before] | _LINE[before] & np.concatenate([[False], closed[:-1]]))
    first = offsets[:-1][np.diff(offsets) > 0]
    cut[first] = True
    return np.flatnonzero(cut), ends | (starts & (at == 0xC3))


class Encoder:
    """Encodes texts to exactly the ids that the tokenizers library gives, and asks it once for each distinct piece.

    Known pieces are found by a hash and compared byte for byte. Texts with a special token's string, and all texts for another kind of tokenizer, go to the
    library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        told = json.loads(self.library.to_str())
        split, model = told["pre_tokenizer"] or {}, told["model"]
        byte_level = split.get("type") == "ByteLevel" and split.get("use_regex") is True and split.get("add_prefix_space") is False
        plain = not told["normalizer"] and not told["truncation"] and not told["padding"] and not told.get("post_processor")
        self.by_piece = byte_level and plain and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.n, self.used, self.filled = 0, 0, 0
        self.slots = np.full(1 << 16, -1, np.int32)
        self.hashes, self.sizes, self.lane_at = np.zeros(1 << 15, np.uint64), np.zeros(1 << 15, np.uint8), np.zeros(1 << 15, np.uint32)
        self.starts, self.lengths = np.zeros(1 << 15, np.uint32), np.zeros(1 << 15, np.uint8)
        self.ids, self.lanes = np.zeros(1 << 17, self.dtype), np.zeros(1 << 16, np.uint64)

    # ---- the memory: open addressing by hash, one slot a piece

    def _grow(self, **least: int) -> None:
        for name, n in least.items():
            array = getattr(self, name)
            if n > len(array):
                grown = np.zeros(max(2 * len(array), n), array.dtype)  # not concatenated: what is not written yet takes no memory
                grown[: len(array)] = array
                setattr(self, name, grown)

    def _place(self, numbers: np.ndarray) -> None:
        mask = len(self.slots) - 1
        at = (self.hashes[numbers] & np.uint64(mask)).astype(np.int64)
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            lost = self.slots[at] != numbers
            numbers, at = numbers[lost], (at[lost] + 1) & mask

    def _same(self, number: np.ndarray, eight: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether pieces have the bytes of these known ones, which have their hashes."""
        same = self.sizes[number] == sizes
        i, lane = np.flatnonzero(same), 0
        while len(i):
            equal = self.lanes[self.lane_at[number[i]] + lane] == eight[starts[i] + 8 * lane] & _LANE[np.minimum(sizes[i] - 8 * lane, 8)]
            same[i[~equal]] = False
            lane += 1
            i = i[equal & (sizes[i] > 8 * lane)]
        return same

    def _find(self, eight: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 where it is not known."""
        mask = len(self.slots) - 1
        out, i = np.full(len(starts), -1, np.int64), np.arange(len(starts))
        at = (hashes & np.uint64(mask)).astype(np.int64)
        while len(i):
            number = self.slots[at].astype(np.int64)
            hit = (number >= 0) & (self.hashes[number] == hashes[i])
            h = np.flatnonzero(hit)
            hit[h] = self._same(number[h], eight, starts[i[h]], sizes[i[h]])
            out[i[hit]] = number[hit]
            on = ~hit & (number >= 0)
            i, at = i[on], (at[on] + 1) & mask
        return out

    def _learn(self, raw: np.ndarray, eight: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, letters: np.ndarray) -> None:
        """Asks the library for the ids of new pieces. A piece of letters alone is one word for its model; others go through all of its steps."""
        n = len(starts)
        at = np.repeat(starts, sizes) + ragged(sizes)
        ends = np.cumsum(sizes)
        other = np.append(0, np.cumsum(~letters[at]))
        word = other[ends] - other[ends - sizes] == (raw[starts] == 32)
        word &= sizes > (raw[starts] == 32)
        written = _WRITTEN[raw[at]].tobytes().decode("utf-32-le")
        got: list = [None] * n
        for k, a, z in zip(np.flatnonzero(word).tolist(), (ends - sizes)[word].tolist(), ends[word].tolist()):
            got[k] = [t.id for t in self.model.tokenize(written[a:z])]
        rest = np.flatnonzero(~word).tolist()
        for k, e in zip(rest, self.library.encode_batch_fast([raw[starts[k] : starts[k] + sizes[k]].tobytes().decode() for k in rest], add_special_tokens=False)):
            got[k] = e.ids
        lengths = np.array([len(g) for g in got], np.int32)
        ids = np.fromiter((i for g in got for i in g), self.dtype, int(lengths.sum()))
        per = (sizes + 7) // 8
        end, used, filled = self.n + n, self.used + len(ids), self.filled + int(per.sum())
        self._grow(hashes=end, sizes=end, lane_at=end, starts=end, lengths=end, ids=used, lanes=filled)
        step = ragged(per)
        self.lanes[self.filled : filled] = eight[np.repeat(starts, per) + 8 * step] & _LANE[np.minimum(np.repeat(sizes, per) - 8 * step, 8)]
        self.ids[self.used : used] = ids
        self.hashes[self.n : end], self.sizes[self.n : end], self.lengths[self.n : end] = hashes, sizes, lengths
        self.lane_at[self.n : end] = self.filled + np.cumsum(per) - per
        self.starts[self.n : end] = self.used + np.cumsum(lengths, dtype=np.int64) - lengths
        before, self.n, self.used, self.filled = self.n, end, used, filled
        if 2 * end > len(self.slots):
            self.slots = np.full(1 << (2 * end).bit_length(), -1, np.int32)
            before = 0
        self._place(np.arange(before, end))

    def _numbers(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        buffer = np.concatenate([raw, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(raw) + 1,), "<u8", buffer, strides=(1,))
        hashes, i, lane = np.zeros(len(starts), np.uint64), np.arange(len(starts)), 0
        while len(i):
            hashes[i] = mix(hashes[i] + sizes[i].astype(np.uint64) ^ eight[starts[i] + 8 * lane] & _LANE[np.minimum(sizes[i] - 8 * lane, 8)])
            lane += 1
            i = i[sizes[i] > 8 * lane]
        number = self._find(eight, starts, sizes, hashes)
        while len(new := np.flatnonzero(number < 0)):
            one = new[np.unique(hashes[new], return_index=True)[1]]
            self._learn(raw, eight, starts[one], sizes[one], hashes[one], letters)
            number[new] = self._find(eight, starts[new], sizes[new], hashes[new])
        return number

    def _by_piece(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, letters = pieces(raw, offsets)
        sizes = np.diff(np.append(starts, len(raw)))
        if self.n > REMEMBERED:
            self.forget()
        short = sizes <= LONGEST
        number = self._numbers(raw, starts[short], sizes[short], letters)
        length = np.zeros(len(starts), np.int64)
        length[short] = self.lengths[number]
        far = np.flatnonzero(~short)
        got = [np.array(self.library.encode(raw[starts[k] : starts[k] + sizes[k]].tobytes().decode(), add_special_tokens=False).ids, self.dtype) for k in far]
        length[far] = [len(g) for g in got]
        ends = np.cumsum(length)
        size = length[short]
        held = self.ids[np.repeat(self.starts[number], size) + ragged(size)]
        if len(far):
            ids = np.empty(int(ends[-1]), self.dtype)
            ids[np.repeat(short, length)] = held
            for k, g in zip(far, got):
                ids[ends[k] - len(g) : ends[k]] = g
        else:
            ids = held
        cut = np.append(0, ends)[np.searchsorted(starts, offsets)]
        return ids, np.diff(cut)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and how many each has."""
        raw, offsets = utf8(column)
        body = raw.tobytes()
        if self.by_piece and not any(s in body for s in self.special):
            return self._by_piece(raw, offsets)
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if self.by_piece and not any(s in body[a:b] for s in self.special):
                out.append(self._by_piece(raw[a:b], np.array([0, b - a]))[0])
            else:
                out.append(np.array(self.library.encode(body[a:b].decode(), add_special_tokens=False).ids, self.dtype))
        return np.concatenate([*out, np.zeros(0, self.dtype)]), np.array([len(p) for p in out], np.int64)


def _encoder(path: str) -> Encoder:
    """One encoder a Python worker: what it has learnt serves all tasks that the worker runs."""
    held = sys.modules.setdefault("_token_store_encoders", types.ModuleType("_token_store_encoders"))
    if path not in vars(held):
        setattr(held, path, Encoder(path))
    return getattr(held, path)


def _writer(path: str, end_id: int, shard_ids: int) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, base = _encoder(path), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        part, size = 0, 0

        def closed() -> pa.RecordBatch:
            nonlocal shard, base, held, size
            ids, lengths = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            docs = pa.concat_arrays([h[2] for h in held])
            cut = pa.array([0, len(lengths)], pa.int32())
            out = [[part], [shard], [base], [len(ids)], pa.ListArray.from_arrays(cut, docs), pa.ListArray.from_arrays(cut, pa.array(lengths)), [WaveletMatrix.build(ids).to_bytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), None, None, pa.binary()]
            shard, base, held, size = shard + 1, base + len(ids), [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, k) if k else x for x, k in zip(out, kinds)], ["part", "shard", "first_id", "n_ids", "doc_ids", "lengths", "matrix"])

        for batch in batches:
            part = batch.column("part")[0].as_py()
            texts = batch.column("text")
            for lo, hi in steps(utf8(texts)[1], ENCODE_BYTES):
                ids, n = encoder.encode(texts.slice(lo, hi - lo))
                n += 1
                ends = np.cumsum(n)
                full = np.full(int(ends[-1]), end_id, encoder.dtype)
                body = np.ones(len(full), bool)
                body[ends - 1] = False
                full[body] = ids
                doc, at = 0, 0
                while doc < hi - lo:
                    stop = min(max(doc + 1, int(np.searchsorted(ends, at + shard_ids - size, "right"))), hi - lo)
                    held.append((full[at : ends[stop - 1]], n[doc:stop], batch.column("doc_id").slice(lo + doc, stop - doc)))
                    size += int(ends[stop - 1]) - at
                    doc, at = stop, int(ends[stop - 1])
                    if size >= shard_ids or doc < hi - lo:
                        yield closed()
        if held:
            yield closed()

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes all texts and writes their ids, each document's with end_id after them, to the Parquet folder out, in ascending order of identifiers.

    Null identifiers come last; rows of one identifier are ordered by a hash of their texts. A null text is empty and has the end id alone. An empty table
    writes an empty folder. Other columns are not read. tokenizer: the path of a tokenizers file, the same on all executors.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("tie"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    rows = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).drop("tie")
    rows.mapInArrow(_writer(tokenizer, end_id, shard_ids), SCHEMA).write.option("compression", "uncompressed").parquet(out)


@tidy
def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            lengths = batch.column("lengths")[k].values.to_numpy()
            ids = WaveletMatrix.from_bytes(batch.column("matrix")[k].as_py()).tokens().astype("<u4")
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
            start = batch.column("first_id")[k].as_py() + ends - lengths
            part = pa.array(np.full(len(lengths), batch.column("part")[k].as_py(), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[k].values, part, pa.array(start), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "part", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """Of each document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as 32-bit little-endian numbers)."""
    shards = spark.read.schema(SCHEMA).parquet(out)
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition of the writer
    docs = shards.mapInArrow(_reader, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    import uuid

    out = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, out, tokenizer)
    return read_tokens(docs.sparkSession, out)
