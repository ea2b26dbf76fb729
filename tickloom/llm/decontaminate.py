"""Benchmark decontamination by pigeonhole edit matching over words.

An item of m words with an error budget of k is cut into k + 1 pieces. A passage within k edits holds one piece unchanged at least, so
only documents with an exact piece hit are looked at; the words around a hit are then verified with Myers' bit-parallel distance.
Documents are read once and never shuffled. The benchmark is sent in blocks of bounded size, one pass over the documents each.
"""

from __future__ import annotations

import math
import pickle
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Hasher, ragged, steps, text_of, tidy, utf8, words

#: Words that may differ, as a share of the item's; a piece is looked up by the hash of its first PROBE words, or of all if it has fewer.
ERROR_RATE, PROBE = 0.15, 4
#: Items of fewer words are not looked for, unless shortest says otherwise: the registered query and the pipeline look for all that have a word.
MIN_WORDS = 5
#: Bytes of benchmark text that one pass holds in memory.
BLOCK_BYTES = 32 << 20
_SEED = 11
#: Bytes of text that are searched at once; what that takes is some sixty times as much.
FIND_BYTES = 1 << 18
#: Entries of a filter of probes: so many for each probe, and in all at most.
_SPARSE, _FILTER = 16, 1 << 22

_APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Scripts that put no spaces between words; each character of theirs is a word.
_UNSPACED = (
    (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x31FF), (0x3400, 0x4DBF),
    (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF),
)
_PARTS, _JOINS, _ALONE = 0, 1, 2


@cache
def _kinds() -> np.ndarray:
    """Of each code point, whether it parts words, belongs to one or is one: punctuation, spaces and controls part, symbols beyond ASCII stand alone."""
    kinds = np.full(sys.maxunicode + 1, _JOINS, np.uint8)
    for c in range(0x20000):
        category = unicodedata.category(chr(c))
        if category[0] in "PZ" or category in ("Cc", "Cf"):
            kinds[c] = _PARTS
        elif category[0] == "S":
            kinds[c] = _ALONE
    kinds[0xE0000:0xE0080] = _PARTS
    kinds[:128] = np.where(_APART[:128], _PARTS, _JOINS)
    for lo, hi in _UNSPACED:
        kinds[lo : hi + 1][kinds[lo : hi + 1] == _JOINS] = _ALONE
    return kinds


def item_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in bytes of all words, and of each text the number of the first one."""
    if not len(raw) or raw.max() < 128:
        return words(raw, offsets, _APART)
    at = np.flatnonzero(raw & 0xC0 != 0x80)
    kind = _kinds()[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)]
    apart = (kind[1:] != _JOINS) | (kind[:-1] != _JOINS)
    cut = np.searchsorted(at, offsets[1:-1])
    apart[cut[(cut > 0) & (cut < len(at))] - 1] = True
    starts = at[(kind != _PARTS) & np.append(True, apart)]
    ends = np.append(at[1:], len(raw))[(kind != _PARTS) & np.append(apart, True)]
    return starts, ends, np.searchsorted(starts, offsets)


def folded(column: pa.Array) -> pa.Array:
    """Texts in lower case, character by character, so that positions stay."""
    out = []
    for text in column.to_pylist():
        low = (text or "").lower()
        out.append(low if len(low) == len(text or "") else "".join(c if len(c.lower()) > 1 else c.lower() for c in text))
    return pa.array(out, pa.large_string())


def budget(m: int, rate: float = ERROR_RATE) -> int:
    """Edits allowed in an item of m words: no more than leave each piece a word."""
    return max(0, min(int(m * rate), m - 1))


def myers(pattern: list, text: list) -> tuple[int, int]:
    """The least number of edits that turn the pattern into some run of the text, and the end of the first such run."""
    m, eq = len(pattern), {}
    for i, w in enumerate(pattern):
        eq[w] = eq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text):
        e = eq.get(w, 0)
        d = (((e & pv) + pv) ^ pv) | e | mv
        ph, mh = mv | ~(d | pv) & full, pv & d
        score += ((ph & top) != 0) - ((mh & top) != 0)
        ph <<= 1
        pv, mv = (mh << 1 | ~(d | ph)) & full, ph & d
        if score < best:
            best, end = score, j + 1
    return best, end


class Block:
    """The pieces of some items, ready to be looked up; it travels to the tasks."""

    def __init__(self, items: pa.Table, rate: float, shortest: int = MIN_WORDS) -> None:
        hasher = Hasher(_SEED)
        raw, offsets = utf8(folded(items["text"]))
        starts, ends, first = item_words(raw, offsets)
        self.words, self.first, self.ids = hasher.word(raw, starts, ends), first, items["item_id"].to_pylist()
        at, length, item = [], [], []
        self.budgets = np.zeros(len(self.ids), np.int64)
        for i in range(len(self.ids)):
            m = int(first[i + 1] - first[i])
            if m < max(1, shortest):
                continue
            k = self.budgets[i] = budget(m, rate)
            cuts = [j * m // (k + 1) for j in range(k + 2)]
            at += [int(first[i]) + c for c in cuts[:-1]]
            length += [b - a for a, b in zip(cuts, cuts[1:])]
            item += [i] * (k + 1)
        at, length, item = (np.array(x, np.int64) for x in (at, length, item))
        probes = hasher.window(self.words, at, np.minimum(length, PROBE))
        self.tables = []
        for width in np.unique(np.minimum(length, PROBE)).tolist():  # a piece under PROBE words is its own probe
            mine = np.flatnonzero(np.minimum(length, PROBE) == width)
            mine = mine[np.argsort(probes[mine], kind="stable")]
            maybe = np.zeros(min(_FILTER, 1 << (_SPARSE * len(mine)).bit_length()), bool)
            maybe[probes[mine] & np.uint64(len(maybe) - 1)] = True
            self.tables.append((width, maybe, probes[mine], at[mine], length[mine], item[mine], hasher.window(self.words, at[mine], length[mine])))

    def find(self, column: pa.Array, hasher: Hasher) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, distance, start, end in code points) of the best place of each item in each text."""
        for lo, hi in steps(utf8(column)[1], FIND_BYTES):
            raw, offsets = utf8(folded(column.slice(lo, hi - lo)))
            starts, ends, first = item_words(raw, offsets)
            if not len(starts):
                continue
            hashes = hasher.word(raw, starts, ends)
            sums = hasher.words.sums(hashes)
            places = [self._places(hasher, sums, first, *t) for t in self.tables]
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for r, i, b in sorted({p for row, item, begin in places for p in zip(row.tolist(), item.tolist(), begin.tolist())}):
                if best.get((r, i), (1,))[0] == 0:
                    continue
                found = self._verify(i, hashes, max(int(first[r]), b - int(self.budgets[i])), min(int(first[r + 1]), b + int(self.first[i + 1] - self.first[i] + self.budgets[i])))
                if found and found < best.get((r, i), (math.inf,)):
                    best[r, i] = found
            for (r, i), (distance, a, z) in best.items():
                chars = lambda upto, r=r: len(raw[offsets[r] : upto].tobytes().decode())
                yield lo + r, i, distance, chars(starts[a]), chars(ends[z - 1])

    def _places(self, hasher: Hasher, sums: np.ndarray, first: np.ndarray, width: int, maybe: np.ndarray, probes: np.ndarray, starts: np.ndarray, length: np.ndarray, item: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and the word where the item would begin, of all exact hits of its pieces."""
        at = np.arange(max(0, len(sums) - width))
        probe = hasher.words.hashes(sums, at, at + width)
        at = np.flatnonzero(maybe[probe & np.uint64(len(maybe) - 1)])
        left = np.searchsorted(probes, probe[at], "left")
        n = np.searchsorted(probes, probe[at], "right") - left
        piece = np.repeat(left, n) + ragged(n)
        at = np.repeat(at, n)
        row = np.searchsorted(first, at, "right") - 1
        inside = at + length[piece] <= first[row + 1]
        at, piece, row = at[inside], piece[inside], row[inside]
        exact = hasher.words.hashes(sums, at, at + length[piece]) == pieces[piece]
        at, piece, row = at[exact], piece[exact], row[exact]
        return row, item[piece], at - (starts[piece] - self.first[item[piece]])

    def _verify(self, i: int, hashes: np.ndarray, lo: int, hi: int) -> tuple[int, int, int] | None:
        pattern, text = self.words[self.first[i] : self.first[i + 1]].tolist(), hashes[lo:hi].tolist()
        distance, end = myers(pattern, text)
        if distance > self.budgets[i] or not end:
            return None
        back, length = myers(pattern[::-1], text[:end][::-1])
        return (distance, lo + end - length, lo + end) if back == distance and length else (distance, lo, lo + end)


def blocks(benchmark: DataFrame, rate: float, block_bytes: int, shortest: int = MIN_WORDS) -> Iterator[Block]:
    """The benchmark's distinct texts (the smallest identifier stands for equal ones), in blocks of about so many bytes."""
    items = benchmark.select(F.col("item_id"), text_of("text").alias("text")).groupBy("text").agg(F.min("item_id").alias("item_id"))
    n = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    for b in range(n):
        yield Block(items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == b).orderBy("item_id", "text").toArrow(), rate, shortest)


def _sent(spark: SparkSession, block: Block) -> Broadcast:
    return spark.sparkContext.broadcast(cloudpickle.dumps(block))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES, shortest: int = MIN_WORDS) -> DataFrame:
    """One row per document and benchmark text found in it: doc_id, item_id, distance (words), budget, start, end (code points).

    Words are runs of letters, marks and digits, in lower case; a character of a script without spaces, or a symbol beyond ASCII, is a word by itself.
    Only an item's best place in a document is told. Null and empty texts hold nothing and are found nowhere; items under shortest words are not looked
    for, and those too short for an edit are found as they are. Repeated rows of documents each
    give their rows; equal items give one row under the smallest identifier. Empty tables give an empty result. Other columns are not read.
    """
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, distance int, budget int, start long, end long"
    rows, out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), None
    for block in blocks(benchmark, rate, block_bytes, shortest):
        part = rows.mapInArrow(_finder(_sent(docs.sparkSession, block)), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _finder(sent: Broadcast) -> Callable:
    @tidy
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, b = Hasher(_SEED), pickle.loads(sent.value)
        for batch in batches:
            if found := list(b.find(batch.column("text"), hasher)):
                rows, items, distance, start, end = (np.array(x, np.int64) for x in zip(*found))
                item_ids = pa.array([b.ids[i] for i in items])
                arrays = [batch.column("doc_id").take(pa.array(rows)), item_ids, pa.array(distance.astype(np.int32)), pa.array(b.budgets[items].astype(np.int32)), pa.array(start), pa.array(end)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "distance", "budget", "start", "end"])

    return find


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES, shortest: int = MIN_WORDS) -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark item; what leaks() tells of nulls, ties and short items holds here too."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    out = docs.toDF(*names)
    for block in blocks(benchmark, rate, block_bytes, shortest):
        out = out.mapInArrow(_keeper(_sent(docs.sparkSession, block), at), out.schema)
    return out.toDF(*docs.columns)


def _keeper(sent: Broadcast, at: int) -> Callable:
    @tidy
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, block = Hasher(_SEED), pickle.loads(sent.value)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[r for r, *_ in block.find(batch.column(at), hasher)]] = False
            yield batch.filter(pa.array(clean))

    return keep
