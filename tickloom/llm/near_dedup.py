"""Near-duplicate removal: SimHash and shared prefixes find which documents may be alike, their five-word shingles decide, and one of each group stays.

Fingerprints of two-word shingles within DISTANCE bits make groups of suspects, linearly many links whatever a group's size. The shingle set of each
suspect is compared with that of its group's least text.

SimHash is a first probe only. Whatever it misses is found by prefixes: in one order of all shingles, two sets of n and m with a similarity of SIMILAR share
one of their first n - ceil(SIMILAR n) + 1 shingles at least; the first that they share leaves room, in both, for all that they must share. Texts that meet at
such a shingle are compared with the most central text there, the one with the fewest shingles before it, which joins groups of copies by linearly many
pairs; then all pairs that meet and are still of different groups. Pairs are judged by small parity bitmaps first, which rule out most that are not similar
and none that is, then by their whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Hasher, packed, partitions, ragged, slices, stage, steps, text_of, tidy, utf8
from .components import components
from .exact_dedup import passing
from .simhash import fingerprint_batch, joined_words, links

#: Words of the shingles that decide, and the Jaccard similarity from which two texts are near duplicates.
SHINGLE, SIMILAR = 5, 0.8
#: Words of the shingles in fingerprints, and the bits in which fingerprints of near duplicates may differ: a changed word touches two of
#: its shingles, so texts that share 0.8 of their five-word shingles mostly stay within 8 of 64 bits.
FINGERPRINT, DISTANCE = 2, 8
#: Shingles in COMMON or more of one text in SAMPLE come last in the order (a bitmap of COMMON_BITS, by hash). The order decides the cost only: any is complete.
SAMPLE, COMMON, COMMON_BITS = 8, 2, 1 << 26
#: Bits of a set's parity bitmap for each shingle; the next power of two is taken.
PARITY = 2


@tidy
def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = utf8(batch.column("text"))
        fps = [fingerprint_batch(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], FINGERPRINT) for lo, hi in steps(offsets)]
        fp = np.concatenate([*fps, np.zeros(0, np.uint64)]).view(np.int64)
        body = raw.tobytes()
        digest = [hashlib.md5(body[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digest, pa.binary()), pa.array(fp)], ["doc_id", "digest", "fp"])


def shingle_sets(column: pa.Array, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's shingles, lower-cased, in order and on end, and how many each text has; a text of fewer words is one shingle."""
    raw_all, offsets_all = utf8(column)
    out, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in steps(offsets_all):
        buffer, starts, ends, first = joined_words(raw_all[offsets_all[lo] : offsets_all[hi]], offsets_all[lo : hi + 1] - offsets_all[lo])
        n = np.diff(first)
        count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(n.dtype))
        at = np.repeat(first[:-1], count) + ragged(count)
        h = hasher.window(hasher.word(buffer, starts, ends), at, np.repeat(np.minimum(n, SHINGLE), count))
        row = np.repeat(np.arange(hi - lo), count)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
        out.append(h[new])
        sizes.append(np.bincount(row[new], minlength=hi - lo))
    return np.concatenate(out), np.concatenate(sizes)


def parity(h: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap in bytes: each bit is whether an odd number of the hashes fall on it. So two bitmaps differ in no more bits than the sets do in elements."""
    return np.packbits(np.bincount((h >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1)


@tidy
def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, digest and the text's set."""
    hasher = Hasher(51)
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), packed(*shingle_sets(batch.column("text"), hasher))], ["id", "digest", "shingles"])


@tidy
def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, the size of the text's set and its parity bitmap."""
    hasher = Hasher(51)
    for batch in slices(batches):
        h, size = shingle_sets(batch.column("text"), hasher)
        ends = np.cumsum(size)
        bits = [parity(h[z - n : z], max(64, 1 << (PARITY * n - 1).bit_length())).tobytes() for z, n in zip(ends.tolist(), size.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size.astype(np.int32)), pa.array(bits, pa.binary())], ["id", "size", "bits"])


@tidy
def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose bitmaps do not rule them out; the longer one is folded to the shorter one's length."""
    for batch in batches:
        yes = []
        for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ba", "bb"))):
            x, y = (np.bitwise_xor.reduce(np.frombuffer(v, np.uint8).reshape(-1, min(len(x), len(y))), axis=0) for v in (x, y))
            yes.append(np.bitwise_count(x ^ y).sum() <= m + n - 2 * int(np.ceil((m + n) * SIMILAR / (1 + SIMILAR) - 1e-6)))
        yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))


@tidy
def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(51)
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(batch.column("text"), hasher)[0].view(np.int64))], ["h"])


def _prefixes(common: Broadcast) -> Callable:
    """(h, id, size, pos): the first shingles of each text, those that are common coming last; pos: how many come before it; size: how many there are in all."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = Hasher(51), np.frombuffer(common.value, np.uint8)
        for batch in slices(batches):
            h, size = shingle_sets(batch.column("text"), hasher)
            bit = h & np.uint64(COMMON_BITS - 1)
            late = bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((h, late, row))
            taken = np.where(size > 0, size - least_shared(size, size) + 1, 0)
            h = h[order][ragged(size) < np.repeat(taken, size)]
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.repeat(ids, taken)), pa.array(np.repeat(size, taken).astype(np.int32)), pa.array(ragged(taken).astype(np.int32))], ["h", "id", "size", "pos"])

    return run


def least_shared(size: np.ndarray, union: np.ndarray) -> np.ndarray:
    """Shingles that a set of this size shares at least with one whose union with it has so many."""
    return np.minimum(size, np.ceil(SIMILAR * union - 1e-6).astype(np.int64))


@tidy
def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h, pos and id: those whose h several texts have, each once, with the most central text there (its hub). A run may go on in the next batch."""
    names = ["h", "id", "size", "pos"]
    held = np.zeros((0, 4), np.int64)  # the first row of the open run, and its latest if it has several: these were given already
    for batch in batches:
        rows = np.concatenate([held, np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])])
        new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))[: len(rows)]
        given = np.arange(len(rows)) < (2 if len(held) == 2 else 0)
        rows, given = rows[new], given[new]
        if not len(rows):
            continue
        first = np.append(True, rows[1:, 0] != rows[:-1, 0])
        run = np.cumsum(first) - 1
        several = np.bincount(run)[run] > 1
        hub = rows[np.flatnonzero(first)[run]]
        out = several & ~given
        last = np.flatnonzero(run == run[-1])
        held = rows[[last[0], last[-1]] if len(last) > 1 else [last[0]]]
        kinds = {"h": np.int64, "id": np.int64, "size": np.int32, "pos": np.int32}
        columns = [pa.array(table[out, k].astype(kinds[c])) for table, cs in ((rows, names), (hub, names[1:])) for k, c in enumerate(names) if c in cs]
        yield pa.RecordBatch.from_arrays(columns, [*names, "hub", "hub_size", "hub_pos"])


@tidy
def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are similar."""
    for batch in batches:
        yes = []
        for x, y in zip(batch.column("sa"), batch.column("sb")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            yes.append(both >= SIMILAR * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))


def _common(texts: DataFrame) -> bytes:
    """A bitmap of the shingles that several texts of a sample have."""
    sample = texts.filter(F.pmod("id", F.lit(SAMPLE)) == 0).dropDuplicates(["id"]).select("text").mapInArrow(_each, "h long")
    at = F.col("h").bitwiseAND(F.lit(COMMON_BITS - 1)) + 1
    often = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
    pages = often.groupBy(F.bitmap_bucket_number(at).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
    bits = bytearray(COMMON_BITS // 8)
    for page, bitmap in pages.collect():  # COMMON_BITS / 32768 pages of 4 KB at most
        bits[(page - 1) * 4096 : page * 4096] = bitmap
    return bytes(bits)


def _similar_pairs(pairs: DataFrame, texts: DataFrame, sketches: DataFrame) -> DataFrame:
    """Of pairs (a, b) of text numbers, the links (digests a, b) of those that are similar. Only texts that their bitmaps leave possible are shuffled."""
    side = lambda df, c, **names: df.select(F.col("id").alias(c), *[F.col(old).alias(new) for new, old in names.items()])
    met = pairs.select("a", "b").join(side(sketches, "a", na="size", ba="bits"), "a").join(side(sketches, "b", nb="size", bb="bits"), "b")
    possible = stage(met.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(_possible, "a long, b long").distinct(), "near-possible")
    ids = stage(possible.select(F.col("a").alias("id")).unionByName(possible.select(F.col("b").alias("id"))).distinct(), "near-ids")
    wanted = passing(texts, ids, "id").join(ids, "id", "left_semi").select("id", "digest", "text")
    sets = stage(wanted.mapInArrow(_shingles, "id long, digest binary, shingles binary").dropDuplicates(["digest"]), "near-pair-sets")
    both = possible.join(side(sets, "a", da="digest", sa="shingles"), "a").join(side(sets, "b", db="digest", sb="shingles"), "b").select(F.col("da").alias("a"), F.col("db").alias("b"), "sa", "sb")
    return stage(both.mapInArrow(_judge, "a binary, b binary"), "near-links")


def _room(a: str, b: str) -> Column:
    """Whether two texts that meet first at a shingle may be similar: what comes from there on holds all that they must share."""
    size = lambda x: F.col(f"{x}_size")
    least = F.ceil((size(a) + size(b)) * (SIMILAR / (1 + SIMILAR)) - 1e-6)
    return F.least(size(a) - F.col(f"{a}_pos"), size(b) - F.col(f"{b}_pos")) >= least


def _pairs(met: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of met, staged."""
    return stage(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near-pairs")


def similar_links(texts: DataFrame, probed: DataFrame) -> DataFrame:
    """Links (digests a, b) that join all similar texts. texts: (id, digest, text), ids by digest; probed: pairs (x, y) of ids to look at first."""
    spark = texts.sparkSession
    order = spark.sparkContext.broadcast(_common(texts))
    sketches = stage(texts.select("id", "text").mapInArrow(_sketches, "id long, size int, bits binary").dropDuplicates(["id"]), "near-sketches")
    keyed = texts.select("id", "text").mapInArrow(_prefixes(order), "h long, id long, size int, pos int")
    keyed = keyed.repartition(partitions(spark), "h").sortWithinPartitions("h", "pos", "id")
    met = stage(keyed.mapInArrow(_meeting, "h long, id long, size int, pos int, hub long, hub_size int, hub_pos int"), "near-met")
    met = met.withColumnsRenamed({"id": "x", "size": "x_size", "pos": "x_pos", "hub": "y", "hub_size": "y_size", "hub_pos": "y_pos"})
    star = _pairs(met.filter((F.col("x") != F.col("y")) & _room("x", "y")).select("x", "y").unionByName(probed))
    links = _similar_pairs(star, texts, sketches)
    # Of two texts in different groups one is not in the largest group at their shingle: those texts meet all others there.
    roots = components(links).select(F.xxhash64("node").alias("x"), F.xxhash64("root").alias("x_root"))
    placed = stage(met.select("h", "x", "x_size", "x_pos").join(roots, "x", "left").withColumn("x_root", F.coalesce("x_root", "x")), "near-placed")
    groups = placed.groupBy("h", "x_root").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.count(F.lit(1)).alias("groups"), F.max(F.struct("n", "x_root"))["x_root"].alias("main"))
    open_ = stage(placed.join(stage(groups.filter("groups > 1").select("h", "main"), "near-mains"), "h"), "near-open")
    other = open_.select("h", *[F.col(c).alias(c.replace("x", "y", 1)) for c in ("x", "x_size", "x_pos", "x_root")])
    apart = (F.col("x_root") != F.col("y_root")) & ((F.col("y_root") == F.col("main")) | (F.col("x") < F.col("y")))
    last = _pairs(open_.filter("x_root != main").join(other, "h").filter(apart & _room("x", "y"))).join(star, ["a", "b"], "left_anti")
    return links.unionByName(_similar_pairs(stage(last, "near-last"), texts, sketches))


def near_groups(rows: DataFrame) -> DataFrame:
    """rows: (doc_id, text). One row for each distinct text: digest, doc_id (its smallest), n (rows with that identifier), group (a digest that all of a group share)."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    prints = stage(rows.mapInArrow(_prints, f"doc_id {kind}, digest binary, fp long"), "near-prints")
    each = prints.groupBy("digest", "fp", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("first")
    texts = stage(each.groupBy("digest", "fp").agg(first).select("digest", "fp", "first.doc_id", "first.n"), "near-texts")
    roots = components(links(stage(texts.select("fp").distinct(), "near-fps"), DISTANCE)).withColumnRenamed("node", "fp")
    members = stage(texts.join(roots, "fp", "left").select("digest", F.coalesce("root", "fp").alias("root")), "near-members")
    number = F.xxhash64("digest")
    least = stage(members.groupBy("root").agg(F.min("digest").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "near-least")
    probed = stage(members.join(least, "root").filter("digest != least").select(F.xxhash64("least").alias("x"), number.alias("y")), "near-probed")
    found = similar_links(rows.select(F.unhex(F.md5("text")).alias("digest"), "text").withColumn("id", number), probed)
    joined = components(found).withColumnRenamed("node", "digest").withColumnRenamed("root", "group")
    return texts.join(joined, "digest", "left").select("digest", "doc_id", "n", F.coalesce("group", "digest").alias("group"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which each group of equal or near-equal texts keeps one: that of the smallest identifier, null last.

    Groups are joined by similarities of SIMILAR or more; texts without words equal each other. Of rows that repeat one stays. Empty tables stay empty.
    """
    cols = docs.columns
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    groups = stage(near_groups(rows), "near-groups")
    best = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "n")).alias("best"))
    chosen = stage(best.select("best.digest", "best.doc_id", "best.n"), "near-chosen").select(F.struct("digest", "doc_id", "n").alias("chosen"))
    own = docs.select(F.struct(*[f"`{c}`" for c in cols]).alias("doc"), F.unhex(F.md5(text_of(text_col))).alias("digest"))
    kept = own.join(chosen, F.col("digest") == F.col("chosen.digest")).filter(F.col("doc")[id_col].eqNullSafe(F.col("chosen.doc_id")))
    if not chosen.filter("chosen.n > 1").isEmpty():  # rows that repeat with identifier and text
        kept = kept.dropDuplicates(["digest"])
    return kept.select("doc.*")
