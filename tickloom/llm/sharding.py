"""Sharding by extendible hashing, in DataFrame operations only.

A shard is a bucket of the directory: a prefix of the bits of each row's hash. A bucket whose bytes exceed the limit splits on
its next bit; all others stay. The directory is built from byte counts of cells (long prefixes), summed with partial
aggregation, so no bucket's rows meet in one task, and a round settles all buckets but those that need still longer prefixes.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of

HASH_BITS = 60
#: Bits that one round adds to the directory; the first round also takes as many as the shards need at least.
ROUND_BITS = 6


def _bits(c: str) -> Column:
    return F.lpad(F.bin(c), HASH_BITS, "0")


def shard_directory(docs: DataFrame, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, shard (the bucket's prefix), depth, shard_bytes, shard_docs.

    The hash is of identifier and text, so rows with null or repeated identifiers part too; rows that are alike in both part
    by a random number given once, after the bits of the hash. A bucket of one row is not split, though it may exceed the limit (a text longer than
    a shard). A null text has no bytes. An empty table gives an empty directory. Other columns are not read.
    """
    return _placed(docs.select(id_col, text_col), max_bytes, id_col, text_col).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs")


def _placed(docs: DataFrame, max_bytes: int, id_col: str, text_col: str, *carried: Column) -> DataFrame:
    """The directory, and in it for each row the carried columns."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    key = F.md5(F.concat(ident, F.lit(":"), F.md5(text_of(text_col))))
    tie = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - HASH_BITS)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long").alias("hi"), tie.alias("lo"), *carried)
    rows = stage(keyed, "shard-keys").withColumn("bits", F.concat(_bits("hi"), _bits("lo"))).drop("hi", "lo")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    start, depth, found = 0, ROUND_BITS + max(0, math.ceil(math.log2(max(1, total / max_bytes)))), []
    while True:
        depth = min(depth, 2 * HASH_BITS)
        settled, over = _round(rows, start, depth, max_bytes)
        found.append(settled)
        if over.isEmpty():
            return reduce(DataFrame.unionByName, found)
        rows = stage(rows.withColumn("cell", F.substring("bits", 1, depth)).join(over, "cell", "left_semi").drop("cell"), "shard-open")
        start, depth = depth, depth + ROUND_BITS


def _round(rows: DataFrame, start: int, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """The rows whose bucket ends between these depths, and the cells that must be split further."""
    cells = stage(rows.groupBy(F.substring("bits", 1, depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs")), "shard-cells")
    levels = cells.select("cell", "bytes", "docs", F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("depth")).withColumn("shard", F.substring(F.col("cell"), F.lit(1), F.col("depth")))
    buckets = levels.groupBy("depth", "shard").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    splits = (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1) & (F.col("depth") < 2 * HASH_BITS)
    buckets = buckets.withColumn("splits", splits)
    parents = buckets.filter("splits").select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("parent"))
    reached = buckets.withColumn("parent", F.substring(F.col("shard"), F.lit(1), F.col("depth") - 1)).join(parents, ["depth", "parent"], "left_semi").drop("parent").unionByName(buckets.filter(F.col("depth") == start))
    reached = stage(reached, "shard-buckets")
    leaves = levels.select("cell", "depth", "shard").join(reached.filter("not splits").drop("splits"), ["depth", "shard"])
    settled = rows.withColumn("cell", F.substring("bits", 1, depth)).join(leaves, "cell").drop("cell", "bits").withColumn("depth", F.col("depth").cast("int"))
    return settled, reached.filter(F.col("splits") & (F.col("depth") == depth)).select(F.col("shard").alias("cell"))


def write_shards(docs: DataFrame, max_bytes: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the documents by shard, all columns, one folder a shard. Each row goes through the directory whole, so each is written once, whatever its identifier."""
    rows = _placed(docs, max_bytes, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows.select("row.*", "shard").repartition("shard").write.partitionBy("shard").parquet(path)


#: Bytes of a shard in the registered query.
QUERY_BYTES = 1 << 20

ORACLE = f"""
WITH RECURSIVE keyed AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         right(repeat('0', 60) || bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT), 60) AS bits
  FROM documents),
levels AS (
  SELECT d.depth, substr(bits, 1, d.depth) AS shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs
  FROM keyed, (SELECT unnest(range(0, 33))::INTEGER AS depth) d GROUP BY ALL),
open AS (SELECT depth, shard FROM levels WHERE shard_bytes > {QUERY_BYTES} AND shard_docs > 1)
SELECT k.doc_id, k.n_bytes, l.shard, l.depth, l.shard_bytes, l.shard_docs
FROM keyed k JOIN levels l ON l.shard = substr(k.bits, 1, l.depth)
WHERE NOT (l.shard_bytes > {QUERY_BYTES} AND l.shard_docs > 1)
  AND (l.depth = 0 OR EXISTS (SELECT 1 FROM open o WHERE o.depth = l.depth - 1 AND o.shard = substr(k.bits, 1, l.depth - 1)))
"""
