"""Exact dedup by a log-structured merge index over text digests, in DataFrame operations only.

Every input partition is a memtable; flush() writes it as a run of (digest, identifier), sorted by digest. A batch of such runs is merged by compact() into one run of the index:
a row a digest with its count and its smallest and largest identifier, range-partitioned and sorted, so that its files don't overlap; partial
aggregation leaves a row a task of even the hottest digest. Parquet keeps ranges and Bloom filters of a run's files for point lookups.

The index takes batch after batch. A new run is looked up in the older ones before it joins them: a bitmap filter of each older run lets few digests through to the join
with it. FANOUT runs of a level are compacted into one of the next. Digests of several rows, in one run or over several, are hits; their counts and
identifiers are merged from the runs. The texts of hits only are then read again and compared by their bytes; digests whose bytes differ are told apart by them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of

#: Bits of a hit filter for each key, and in all at least and at most (64 MB, which is broadcast); more keys are joined by a shuffle.
KEY_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 18, 1 << 29
#: Runs of a level that are merged into one of the next, and batches that a whole table is taken in.
FANOUT, BATCHES = 4, 2
_BLOOM = {"parquet.bloom.filter.enabled#digest": "true"}


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def passing(rows: DataFrame, hits: DataFrame, key: str = "digest") -> DataFrame:
    """The rows whose key is among those of hits (a staged table), and few others. The filter is a bitmap in pages of 4 KB; its size follows the number of
    hits and is bounded, so the pages are broadcast. Beyond the bound the keys are joined by a shuffle."""
    n = hits.count()
    bits = max(LEAST_BITS, 1 << (KEY_BITS * n).bit_length())
    if bits > MOST_BITS:
        return rows.join(hits.select(key).distinct(), key, "left_semi")
    at = _bit(F.col(key), bits)
    position = F.bitmap_bit_position(at)
    pages = hits.groupBy(F.bitmap_bucket_number(at).alias("page")).agg(F.bitmap_construct_agg(position).alias("bitmap"))
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), F.pmod(position, F.lit(8)).cast("int") + 1)) != 0
    return rows.withColumn("page", F.bitmap_bucket_number(at)).join(F.broadcast(pages), "page").filter(set_).drop("page", "bitmap")


def flush(rows: DataFrame) -> DataFrame:
    """Memtables: a sorted run (digest, doc_id, batch) of each partition of rows, written with its filter. Rows of one identifier are in one batch."""
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)).cast("int").alias("batch")
    return stage(rows.select("digest", "doc_id", batch).sortWithinPartitions("digest", "doc_id"), "dedup-runs", **_BLOOM)


def entries(runs: DataFrame) -> DataFrame:
    """Rows of level 0 in the form of higher levels: digest, n, lo, hi."""
    return runs.select("digest", F.lit(1).cast("long").alias("n"), F.col("doc_id").alias("lo"), F.col("doc_id").alias("hi"))


def compact(runs: DataFrame, least: int = 1) -> DataFrame:
    """Runs (digest, n, lo, hi) of any levels merged into one sorted run of disjoint files: of each digest with least rows or more, how many rows it has and
    its smallest and largest identifier; null ones are passed over."""
    merged = runs.groupBy("digest").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter(F.col("n") >= least)
    return stage(merged.repartitionByRange("digest").sortWithinPartitions("digest"), "dedup-level", **_BLOOM)


class MergeIndex:
    """Runs by level, the newest last. insert() adds a batch, known() finds digests, merged() is all there is as one run."""

    def __init__(self, fanout: int = FANOUT) -> None:
        self.fanout, self.levels = fanout, [[]]

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def insert(self, rows: DataFrame) -> DataFrame:
        """Adds a batch (digest, doc_id); returns the digests that make hits: those of several of its rows, and those that older runs know."""
        run = compact(entries(rows))
        hits = run.filter("n > 1").select("digest")
        if self.runs:
            hits = hits.unionByName(self.known(run).select("digest")).distinct()
        hits = stage(hits, "dedup-hits")
        self._push(run, 0)
        return hits

    def _push(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._push(compact(reduce(DataFrame.unionByName, runs)), level + 1)

    def known(self, rows: DataFrame) -> DataFrame:
        """digest, n, lo, hi over all runs, of the digests of rows (one row each) that any run has. A run's filter stands before the join with it."""
        found = [passing(rows.select("digest"), run).join(run, "digest") for run in self.runs]
        return reduce(DataFrame.unionByName, found).groupBy("digest").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def merged(self) -> DataFrame:
        return compact(reduce(DataFrame.unionByName, self.runs))


def lookup(run: DataFrame, digests: list[bytes]) -> DataFrame:
    """The rows of a run with these digests; row groups are passed over by their range and their filter."""
    return run.filter(F.col("digest").isin([F.lit(d) for d in digests]))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" identifier of each group of equal texts stays. A null text equals an empty one.
    Null identifiers come after all others: they stay only where a group has no other (keep_id is then null).
    Rows that repeat with identifier and text are all marked kept if theirs is the identifier that stays. An empty
    table gives an empty result. Other columns are not read.
    """
    end = "lo" if keep == "smallest" else "hi"
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    runs = flush(rows)
    index = MergeIndex()
    found = [index.insert(runs.filter(F.col("batch") == b)) for b in range(BATCHES)]
    hits = stage(index.known(reduce(DataFrame.unionByName, found).distinct()), "dedup-level")
    runs = runs.drop("batch")
    bodies = stage(passing(rows, hits).groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).select("digest", F.xxhash64("text").alias("variant"), "n", "lo", "hi"), "dedup-bodies")
    collided = bodies.groupBy("digest").agg(F.count(F.lit(1)).alias("bodies")).filter("bodies > 1").select("digest")
    if collided.isEmpty():
        joined = runs.join(hits, "digest", "left")
    else:  # equal digests of different bytes: their rows find their class by the bytes, through a second hash
        collided = stage(collided, "dedup-collided")
        apart = bodies.join(collided, "digest").withColumnRenamed("digest", "of")
        same = runs.join(collided, "digest", "left_anti").join(hits, "digest", "left")
        keyed = passing(rows, collided).join(collided, "digest").select("digest", "doc_id", F.xxhash64("text").alias("found"))
        joined = same.unionByName(keyed.join(apart, (F.col("digest") == F.col("of")) & (F.col("found") == F.col("variant"))).select(*same.columns))
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col(end))
    return joined.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
