"""Helpers that the corpus operators share: staged tables, Arrow text access, word hashes."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step looks at; a longer document is one step by itself.
STEP_BYTES = 1 << 20
#: Rows of a per-source, per-host or per-partition table up to which it may be broadcast.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only where none is set and there is no cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="spark-stage-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut in the lineage that a lost executor can't undo."""
    path = f"{shared_dir(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is staged and has few rows by count; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


# ---------------------------------------------------------------- Arrow and numpy, inside tasks

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_M64 = (1 << 64) - 1
#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def release() -> None:
    """Gives freed memory back to the system, where its library can: workers live on, and keep the peak of each batch otherwise."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """run, a function of Arrow batches, with release() after each batch that it gives, and once more when it has ended and let go of all that it held."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            release()
        out = None
        release()

    return tidied


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def slices(batches: Iterator[pa.RecordBatch], text: str | int = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of one step each, so that little is in memory at once."""
    for batch in batches:
        for lo, hi in steps(utf8(batch.column(text))[1], most):
            yield batch.slice(lo, hi - lo)


def words(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in bytes of all words, and of each document the number of the first one. apart: of each byte, whether it parts words."""
    solid = ~apart[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotate(acc + lane * P2, 31) * P1


def xxh64(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of slices of a buffer that has 8 bytes to spare, for all slices at once: longer ones first, so that each step takes a prefix."""
    order = np.argsort(-lengths, kind="stable")
    at, length = starts[order], lengths[order]
    eight = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    four = np.ndarray((len(buffer) - 3,), "<u4", buffer, strides=(1,))
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(at), s + P5, np.uint64)
        big = int(np.searchsorted(-length, -32, "right"))
        if big:
            acc = [np.full(big, x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            for stripe in range(int(length[0]) // 32):
                m = int(np.searchsorted(-length[:big], -32 * (stripe + 1), "right"))
                for lane in range(4):
                    acc[lane][:m] = _round(acc[lane][:m], eight[at[:m] + 32 * stripe + 8 * lane])
            h[:big] = _rotate(acc[0], 1) + _rotate(acc[1], 7) + _rotate(acc[2], 12) + _rotate(acc[3], 18)
            for a in acc:
                h[:big] = (h[:big] ^ _round(np.zeros(big, np.uint64), a)) * P1 + P4
        h += length.astype(np.uint64)
        at = at + length // 32 * 32
        rest = length % 32
        for _ in range(3):
            i = np.flatnonzero(rest >= 8)
            if not len(i):
                break
            h[i] = _rotate(h[i] ^ _round(np.zeros(len(i), np.uint64), eight[at[i]]), 27) * P1 + P4
            at[i] += 8
            rest[i] -= 8
        i = np.flatnonzero(rest >= 4)
        h[i] = _rotate(h[i] ^ four[at[i]].astype(np.uint64) * P1, 23) * P2 + P3
        at[i] += 4
        rest[i] -= 4
        for _ in range(3):
            i = np.flatnonzero(rest > 0)
            if not len(i):
                break
            h[i] = _rotate(h[i] ^ buffer[at[i]].astype(np.uint64) * P5, 11) * P1
            at[i] += 1
            rest[i] -= 1
        h = (h ^ h >> np.uint64(33)) * P2
        h = (h ^ h >> np.uint64(29)) * P3
        h ^= h >> np.uint64(32)
    out = np.empty_like(h)
    out[order] = h
    return out


class Rolling:
    """Polynomial hashes modulo 2**64 of any slice of 64-bit hashes, from one running sum. The base is odd, so its powers can be divided out.

    Only for values that are sound hashes themselves, and slices of some hundred at most: modulo a power of two, long sequences of two values can be made to collide.
    """

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            for name, b in (("powers", self.base), ("inverses", self.inverse)):
                out = np.full(n, b, np.uint64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers[: len(values)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))


class Hasher:
    """64-bit hashes of words (XXH64) and of windows of words; seeds give independent ones."""

    def __init__(self, seed: int) -> None:
        self.seed = seed
        self.words = Rolling(int(np.random.default_rng(seed).integers(1 << 40, _M64, dtype=np.uint64)) | 1)

    def word(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return xxh64(np.concatenate([raw, np.zeros(8, np.uint8)]), starts, ends - starts, self.seed)

    def window(self, word_hashes: np.ndarray, at: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        return self.words.hashes(self.words.sums(word_hashes), at, at + width)


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs that have these lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values: so many numbers of the array in each."""
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths * values.itemsize, out=at[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all binary values on end, and how many each has."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind), np.diff(at) // np.dtype(kind).itemsize
