"""SimHash near-dedup: fingerprints, links within a Hamming distance, groups.

Links are found by the generalised pigeonhole principle: correlated bits are grouped into partitions, each with a threshold of its own
(-1 leaves a partition out) so that thresholds plus one add up to the distance plus one; any two fingerprints within the distance
then agree up to the threshold in one partition. The number of partitions and the thresholds come from dynamic programming over
candidate counts that are estimated from the bit statistics of all fingerprints. Copies share a fingerprint, so only distinct ones are probed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, partitions, ragged, stage, steps, text_of, tidy, utf8, words, xxh64
from .components import components

BITS = 64
#: Distinct fingerprints that are compared in one task at once; larger buckets are cut into blocks, and every pair of blocks is compared.
BLOCK = 512
#: Keys of a partition that one fingerprint may have, and the cost of a key against that of a compared pair.
MAX_KEYS, KEY_COST = 2100, 20.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_SPACED = np.where(_SPACE, np.uint8(32), _LOWER).astype(np.uint8)


def joined_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A buffer in which one space parts the lower-cased words of a document, and their starts, ends and first of each document."""
    starts, ends, first = words(raw, offsets)
    gaps = starts[1:] - ends[:-1]
    inner = np.ones(len(gaps), bool)
    edge = first[1:-1]
    inner[edge[(edge > 0) & (edge <= len(gaps))] - 1] = False
    if (gaps[inner] == 1).all():
        buffer = np.concatenate([_LOWER_SPACED[raw], np.zeros(8, np.uint8)])
    else:
        length = ends - starts
        new = np.cumsum(length + 1) - length - 1
        buffer = np.full(int(length.sum()) + len(length) + 8, 32, np.uint8)
        step = ragged(length)
        buffer[np.repeat(new, length) + step] = _LOWER[raw[np.repeat(starts, length) + step]]
        starts, ends = new, new + length
    return buffer, starts, ends, first


def fingerprint_batch(raw: np.ndarray, offsets: np.ndarray, width: int, seed: int = 42) -> np.ndarray:
    """Fingerprints of the documents as unsigned numbers."""
    buffer, starts, ends, first = joined_words(raw, offsets)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    lead = np.repeat(first[:-1], count) + ragged(count)
    last = np.repeat(np.minimum(n, width), count) + lead - 1
    at, length = starts[lead], ends[last] - starts[lead]
    h = np.empty(len(at), np.uint64)
    for k in range(0, len(at), 1 << 16):
        h[k : k + (1 << 16)] = xxh64(buffer, at[k : k + (1 << 16)], length[k : k + (1 << 16)], seed)
    out = np.zeros(len(n), np.uint64)
    if not len(h):
        return out
    # eight counters of eight bits in each number, added up over runs of 255 hashes at most
    runs = -(-count // 255)
    run_start = np.repeat(np.cumsum(count) - count, runs) + 255 * ragged(runs)
    some = np.flatnonzero(count)
    doc_start = (np.cumsum(runs) - runs)[some]
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & np.uint64(0x0101010101010101), run_start)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), doc_start, axis=0)
        for b in range(8):
            out[some] |= (2 * counts[:, b] > count[some]).astype(np.uint64) << np.uint64(8 * b + j)
    return out


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of each row."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            fps = [fingerprint_batch(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width) for lo, hi in steps(offsets)]
            fp = np.concatenate([*fps, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long")


# ---------------------------------------------------------------- the plan of partitions and thresholds


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many each two bits are both set; summed up on the executors."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            x = np.unpackbits(batch.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(x), both + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), n).astype(np.int64))], ["at", "n"])

    cells = fps.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # BITS * BITS + 1 rows
    flat = np.zeros(BITS * BITS + 1)
    for at, n in cells:
        flat[at] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlated_order(n: int, both: np.ndarray) -> list[int]:
    """The bits in a chain in which each follows the one that it is most correlated with."""
    p = np.diag(both) / max(n, 1)
    cov = np.abs(both / max(n, 1) - np.outer(p, p))
    scale = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = cov / np.outer(scale, scale)
    chain, left = [0], set(range(1, BITS))
    while left:
        chain.append(max(sorted(left), key=lambda b: corr[chain[-1], b]))
        left.remove(chain[-1])
    return chain


def allocate(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use: the cheapest by estimated keys and candidate pairs."""
    p, chain, best = np.diag(both) / max(n, 1), correlated_order(n, both), None
    differ = 2 * p * (1 - p)
    for m in range(1, distance + 2):
        parts = [chain[k * BITS // m : (k + 1) * BITS // m] for k in range(m)]
        costs = []
        for bits in parts:
            apart = np.zeros(distance + 1)  # chance that so many of the bits differ
            apart[0] = 1.0
            for b in bits:
                apart = apart * (1 - differ[b]) + np.append(0, apart[:-1]) * differ[b]
            within = np.cumsum(apart)
            costs.append([0.0] + [KEY_COST * n * comb(len(bits), t) + n * n / 2 * within[t] if 0 < comb(len(bits), t) <= MAX_KEYS else np.inf for t in range(distance + 1)])
        table = {0: (0.0, ())}  # thresholds plus one so far -> cost, thresholds
        for cost in costs:
            new: dict = {}
            for spent, (c, ts) in table.items():
                for give in range(min(distance + 1, distance + 1 - spent) + 1):
                    option = (c + cost[give], (*ts, give - 1))
                    if option < new.get(spent + give, (np.inf,)):
                        new[spent + give] = option
            table = new
        if distance + 1 in table and (best is None or table[distance + 1][0] < best[0]):
            best = (table[distance + 1][0], parts, table[distance + 1][1])
    return [(bits, t) for bits, t in zip(best[1], best[2]) if t >= 0]


def _keys(fp: Column, plan: list[tuple[list[int], int]]) -> Column:
    """The keys of a fingerprint: of each partition, its bits without any t of them."""
    keys = []
    for k, (bits, t) in enumerate(plan):
        for j, out in enumerate(combinations(bits, t)):
            mask = sum(1 << b for b in bits if b not in out)
            keys.append(F.struct(F.lit(k << 16 | j).alias("p"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")).alias("v")))
    return F.explode(F.array(*keys))


# ---------------------------------------------------------------- probing


def _stars(unit: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within the distance in each unit (rows sorted by unit): each fingerprint to the least it is joined with."""
    label = np.arange(len(fp))
    i, lag, found = np.arange(len(fp)), 0, []
    while len(i):
        lag += 1
        i = i[i + lag < len(fp)]
        i = i[unit[i] == unit[i + lag]]
        near = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= distance]
        if len(near):
            found.append((near, near + lag))
        if found and (sum(len(a) for a, _ in found) > 1 << 20 or not len(i)):
            a, b = (np.concatenate(x) for x in zip(*found))
            while True:
                low = np.minimum(label[a], label[b])
                before = label.copy()
                for side in (a, b, before[a], before[b]):
                    np.minimum.at(label, side, low)
                label = label[label]
                if (label == before).all():
                    break
            found = []
    joined = np.flatnonzero(label != np.arange(len(fp)))
    return fp[joined], fp[label[joined]]


def _prober(distance: int) -> Callable:
    @tidy
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in _and_none(batches):
            if batch is None:
                cols, cut = rest, len(rest[0]) if rest else 0
            else:
                cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
                if rest:
                    cols = [np.concatenate(x) for x in zip(rest, cols)]
                new = _starts(cols)
                cut = new[-1] if len(new) else 0
            if cut:
                part = [c[:cut] for c in cols]
                unit = np.zeros(cut, np.int64)
                unit[_starts(part)[1:]] = 1
                a, b = _stars(np.cumsum(unit), part[4].astype(np.int64).view(np.uint64), distance)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
            rest = [c[cut:] for c in cols] if cols else None

    return probe


def _and_none(items: Iterator) -> Iterator:
    yield from items
    yield None


def _starts(cols: list[np.ndarray]) -> np.ndarray:
    """Where a new unit begins: the first four columns tell units apart."""
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols[:4]:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def links(fps: DataFrame, distance: int) -> DataFrame:
    """(a, b): links that join all fingerprints within the distance; fps: staged, distinct fp. Pairs are joined by chains of links, not listed."""
    spark = fps.sparkSession
    n, both = bit_statistics(fps.select("fp"))
    plan = allocate(n, both, distance)
    keyed = fps.select("fp", _keys(F.col("fp"), plan).alias("key")).select("key.p", "key.v", "fp")
    counts = stage(keyed.groupBy("p", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-buckets")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda c: F.struct(F.least(F.col("mine"), c).alias("i"), F.greatest(F.col("mine"), c).alias("j")))
    units = keyed.join(counts, ["p", "v"]).withColumn("nb", blocks).withColumn("mine", mine).select("p", "v", "fp", F.explode(others).alias("u")).select("p", "v", "u.i", "u.j", "fp")
    units = units.repartition(partitions(spark), "p", "v", "i", "j").sortWithinPartitions("p", "v", "i", "j", "fp")
    return units.mapInArrow(_prober(distance), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach, itself included).

    A text of fewer words than width is one shingle; one without words (null, empty) has fingerprint zero, which links like any other.
    Null identifiers are passed over in component_id, which is null where a group has no other. Rows that repeat are told alike.
    An empty table gives an empty result. Other columns are not read.
    """
    rows = stage(fingerprints(docs, width, id_col, text_col), "simhash-fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct, distance)).withColumnRenamed("node", "fp")
    members = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    members = stage(members, "simhash-members")
    named = members.join(members.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
