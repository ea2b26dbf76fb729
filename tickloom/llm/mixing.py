"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

All that is done per source works on sums with partial aggregation. A source's documents are dealt into hash bins, at most BINS a source. Each is taken as often as the target holds the whole
source, and some once more, or twice: those whose sizes add up to what is then left of the target, or come nearest to it, found by the sums that can be
reached. That is one pass over a source's bins, in one small table; no source's rows are sorted or gathered.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, small, stage, text_of, word_count

#: Hash bins of a source, and the words of a target up to which sums are looked at one by one; more is filled with bins in order down to half of that first.
BINS, EXACT = 4096, 1 << 18


def hash_bin(ident: Column, text: Column, seed: int) -> Column:
    key = F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(text)))
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df with its rank n (from 0) by a unique key, nulls last, without one task that sees all rows."""
    n = min(partitions(df.sparkSession), 64)
    dealt = stage(df.repartitionByRange(n, F.col(key).asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranks")
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n_part"))
    before = sizes.select("part", (F.sum("n_part").over(W.orderBy("part")) - F.col("n_part")).alias("before"))  # a row a partition
    inside = F.row_number().over(W.partitionBy("part").orderBy(F.col(key).asc_nulls_last())) - 1
    return dealt.withColumn("inside", inside).join(before, "part").withColumn("n", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Adds target to (weight, source_size): weight shares of all sizes, no more than max_epochs times the source's size each;
    what a capped source leaves goes to the others by weight, until none is above its cap."""
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        capped = F.lit(level) * F.col("weight") > cap
        left, weight = sources.agg(F.lit(total) - F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)), F.sum(F.when(~capped, F.col("weight")))).first()
        rise = float(left) / weight if weight else level
        if rise == level:
            return sources.withColumn("target", F.when(capped, cap.cast("double")).otherwise(F.lit(level) * F.col("weight")))
        level = rise


def plan(sized: DataFrame, max_epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, target, bin, reps, from staged (source, size, bin)."""
    bins = stage(sized.groupBy("source", "bin").agg(F.sum("size").alias("size")), "mix-bins")
    sources = numbered(bins.groupBy("source").agg(F.sum("size").alias("source_size")), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    filled = water_fill(stage(sources.select("source", "source_size", weight.alias("weight")), "mix-sources"), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    filled = filled.withColumn("whole", F.least(whole, F.lit(max_epochs)).cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    rows = bins.withColumnRenamed("source", "of").join(filled, F.col("of").eqNullSafe(F.col("source"))).drop("of")
    kind = sized.schema["source"].dataType.simpleString()
    schema = f"source {kind}, source_size long, target double, bin int, reps long"
    chosen = rows.select("source", "source_size", "target", "whole", "rest", "bin", "size").groupBy("source").applyInArrow(_chosen(max_epochs), schema)
    return stage(chosen, "mix-plan")


def filled_up(sizes: np.ndarray, want: float, copies: int) -> np.ndarray:
    """How often each of the sizes (in the order of their bins) is taken, copies times at most, so that the sum is as near to want as can be; of two equally near the lower one.
    First copies come before second ones, and a sum is made of the first sizes that reach it."""
    taken, left = np.zeros(len(sizes), np.int64), want
    order = [(k, int(w)) for _ in range(copies) for k, w in enumerate(sizes.tolist()) if w > 0]
    if left > EXACT:
        rest = []
        for k, w in order:
            if w <= left - EXACT / 2:
                taken[k] += 1
                left -= w
            else:
                rest.append((k, w))
        order = rest
    most = int(np.floor(2 * left))
    if left <= 0 or most > 2 * EXACT:
        return taken
    reach, via = np.zeros(most + 1, bool), np.full(most + 1, -1, np.int64)
    reach[0], nearest = True, int(np.ceil(left - 0.5))
    for n, (_, w) in enumerate(order):
        if w > most:
            continue
        new = np.flatnonzero(reach[: most + 1 - w] & ~reach[w:]) + w
        reach[new], via[new] = True, n
        if reach[nearest]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - left))])
    while at:
        k, w = order[via[at]]
        taken[k] += 1
        at -= w
    return taken


def _chosen(max_epochs: int) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        """Of a source's bins how often each is taken."""
        rows = rows.sort_by("bin")
        whole, want = rows.column("whole")[0].as_py(), rows.column("rest")[0].as_py()
        reps = whole + filled_up(rows.column("size").to_numpy(), want, max_epochs - whole)
        return pa.table({c: rows.column(c) for c in ("source", "source_size", "target", "bin")} | {"reps": pa.array(reps)})

    return run


def repetitions(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Adds source_size, target and reps to rows with (source, bin). The plan is broadcast if it counts few bins, else joined by shuffle."""
    planned = small(planned.withColumnRenamed("source", "of").withColumnRenamed("bin", "_bin"))
    return rows.join(planned, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("_bin"))).drop("of", "_bin")


def mix_plan(docs: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size (words), source_size, target, taken (size * reps), reps, source.

    A null text has no words; a null source is a source of its own, the last in order. Rows alike in identifier and text repeat alike. A source without words has target 0.
    An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_of(text_col)).alias("size"), hash_bin(F.col(id_col), text_of(text_col), seed).alias("bin"))
    sized = stage(rows, "mix-sizes")
    out = repetitions(sized, plan(sized, max_epochs, weights))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("reps")).alias("taken"), "reps", "source")


def mix(docs: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of docs, all columns, each as often as the plan says (0 to max_epochs times)."""
    cols = docs.columns
    key = F.struct(F.col(source_col).alias("source"), hash_bin(F.col(id_col), text_of(text_col), seed).alias("bin"))
    sized = stage(docs.select(key.alias("k"), word_count(text_of(text_col)).alias("size")).select("k.source", "k.bin", "size"), "mix-sizes")
    planned = small(plan(sized, max_epochs, weights).select(F.struct("source", "bin", "reps").alias("p")))
    rows = docs.select(F.struct(*[f"`{c}`" for c in cols]).alias("doc"), key.alias("k")).join(planned, F.col("k.source").eqNullSafe(F.col("p.source")) & (F.col("k.bin") == F.col("p.bin")))
    return rows.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("p.reps").cast("int")))).select("doc.*")


ORACLE = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':7:' || md5(coalesce(text, ''))), 1, 3))::INTEGER AS bin
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
sources AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM totals),
ranked AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM sources),
levels AS (
  SELECT k, cap, weight,
         ((SELECT sum(source_size) FROM sources) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
water AS (SELECT level FROM levels WHERE level * weight <= cap ORDER BY k LIMIT 1),
filled AS (SELECT source, source_size, CASE WHEN level * weight > cap THEN cap::DOUBLE ELSE level * weight END AS target FROM sources, water),
split AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM filled),
bins AS (SELECT source, bin, sum(size)::BIGINT AS size FROM sized GROUP BY ALL),
wanted AS (SELECT *, target - whole * source_size AS rest FROM split),
-- sums that can be reached, as bits: after each item (a bin once more) those before, and those before moved on by its size. Targets here are below EXACT.
items AS (SELECT w.source, b.bin, b.size::INTEGER AS size, floor(2 * rest)::INTEGER AS most, rest, row_number() OVER (PARTITION BY w.source ORDER BY c, b.bin) AS k
  FROM wanted w JOIN bins b ON b.source IS NOT DISTINCT FROM w.source JOIN (SELECT unnest(range(1, 4)) AS c) ON c <= 3 - whole WHERE rest > 0 AND b.size > 0 AND b.size <= floor(2 * rest)),
reach AS (
  SELECT source, 0::BIGINT AS k, set_bit(bitstring('0', floor(2 * rest)::INTEGER + 1), 0, 1) AS bits FROM wanted WHERE rest > 0
  UNION ALL SELECT i.source, i.k, r.bits | (r.bits >> i.size) FROM reach r JOIN items i ON i.source IS NOT DISTINCT FROM r.source AND i.k = r.k + 1),
last AS (SELECT r.source, r.k, r.bits, w.rest FROM reach r JOIN wanted w ON w.source IS NOT DISTINCT FROM r.source QUALIFY row_number() OVER (PARTITION BY r.source ORDER BY r.k DESC) = 1),
sums AS MATERIALIZED (SELECT source, k, arg_min(s, abs(s - rest) * 2 + s * 1e-9) AS spot FROM (SELECT source, k, rest, bits, unnest(range(0, bit_length(bits)::INTEGER)) AS s FROM last) WHERE get_bit(bits, s::INTEGER) = 1 GROUP BY source, k),
back AS (
  SELECT source, k, spot, NULL::INTEGER AS bin FROM sums
  UNION ALL SELECT b.source, b.k - 1, CASE WHEN get_bit(r.bits, b.spot::INTEGER) = 1 THEN b.spot ELSE b.spot - i.size END, CASE WHEN get_bit(r.bits, b.spot::INTEGER) = 1 THEN NULL ELSE i.bin END
    FROM back b JOIN reach r ON r.source IS NOT DISTINCT FROM b.source AND r.k = b.k - 1 JOIN items i ON i.source IS NOT DISTINCT FROM b.source AND i.k = b.k),
more AS (SELECT source, bin, count(*) AS n FROM back WHERE bin IS NOT NULL GROUP BY ALL),
done AS (SELECT z.*, w.source_size, w.target, w.whole + coalesce(m.n, 0) AS reps
  FROM sized z JOIN wanted w ON z.source IS NOT DISTINCT FROM w.source LEFT JOIN more m ON m.source IS NOT DISTINCT FROM z.source AND m.bin = z.bin)
SELECT doc_id, source, size, source_size, target, reps::BIGINT AS reps, size * reps::BIGINT AS taken FROM done
"""
