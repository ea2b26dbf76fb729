"""Running values of a symbol's bars without one task a symbol: scans over blocks, in native functions.

Within a block of bars a scan runs as a window. A table with one row a block then tells what each block starts from, and only this small table is put in order by
symbol. carried() does so for the last known value, the largest and the sum. smoothed() does it for linear recurrences y = a x + (1 - a) y': within a block that is a
running sum of x weighted by powers of the decay (a block is as short as doubles need to hold them), and what blocks end with is decayed as far back as it
counts (about exp(-300)).

A scan's input is written once, as both the windows and the table stand on it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import series
from ..staging import kept

#: Bars of a recurrence's block at most, and the exponent that doubles hold.
BLOCK, HELD = 1024, 300

_OVER = {
    "last": (lambda x: F.last(x, ignorenulls=True), lambda x: F.max_by(x, F.when(x.isNotNull(), F.col("i"))), F.coalesce),
    "max": (F.max, F.max, F.greatest),
    "sum": (F.sum, F.sum, lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, a * 0, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))),
}


def carried(df: DataFrame, columns: dict[str, tuple[str, Column, int]]) -> DataFrame:
    """Adds each named column: the last known value, the max or the sum of its input over the symbol's bars up to the bar (0) or to the one before (-1); null where there is none.
    columns: name -> (kind, input, 0 or -1)."""
    plain = df.columns
    df = kept(df.withColumns({f"_x_{n}": x for n, (_, x, _) in columns.items()} | {"_block": F.floor(F.col("i") / series.WIDTH)}))
    inside = W.partitionBy("symbol", "_block").orderBy("i")
    local = df.withColumns({f"_l_{n}": _OVER[kind][0](F.col(f"_x_{n}")).over(inside.rowsBetween(W.unboundedPreceding, upto)) for n, (kind, _, upto) in columns.items()})
    table = df.groupBy("symbol", "_block").agg(*[_OVER[kind][1](F.col(f"_x_{n}")).alias(f"_e_{n}") for n, (kind, _, _) in columns.items()])
    before = W.partitionBy("symbol").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    table = table.select("symbol", "_block", *[_OVER[kind][0](F.col(f"_e_{n}")).over(before).alias(f"_c_{n}") for n, (kind, _, _) in columns.items()])
    out = {n: _OVER[kind][2](F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n, (kind, _, _) in columns.items()}
    return local.join(table, ["symbol", "_block"]).withColumns(out).select(*plain, *columns)


def _reach(a: float) -> int:
    """Values after which one is decayed by exp(-HELD)."""
    return max(1, math.ceil(HELD / -math.log(1 - a))) if a < 1 else 1


def smoothed(df: DataFrame, columns: dict[str, tuple[Column, float]], seeded: bool = True) -> DataFrame:
    """Adds each named column: its input smoothed with its weight a. A null input carries the value before on. It begins as the first input, or, not seeded, from zero.
    All columns share one scan; those of the same input share its counts too."""
    if any(not 0 < a <= 1 for _, a in columns.values()):
        raise ValueError("weights are above 0, and 1 at most")
    plain, weight = df.columns, {n: a for n, (_, a) in columns.items()}
    inputs: dict[str, Column] = {}
    source = {}
    for n, (x, _) in columns.items():
        source[n] = next((k for k, y in inputs.items() if repr(y) == repr(x)), f"{len(inputs)}")
        inputs[source[n]] = x
    length = min(BLOCK, *(_reach(a) for a in weight.values() if a < 1), BLOCK)
    df = kept(df.withColumns({f"_x{k}": x.cast("double") for k, x in inputs.items()} | {"_block": F.floor(F.col("i") / length)}))
    inside = W.partitionBy("symbol", "_block").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns({f"_k{k}": F.count(f"_x{k}").over(inside) for k in inputs})
    df = df.withColumns({f"_l_{n}": _local(source[n], a, inside) for n, a in weight.items()})
    first = lambda k: F.min(F.when(F.col(f"_x{k}").isNotNull(), F.struct("i", f"_x{k}")))[f"_x{k}"].alias(f"_f{k}")
    table = df.groupBy("symbol", "_block").agg(*[e for k in inputs for e in (F.count(f"_x{k}").alias(f"_n{k}"), first(k))], *[F.max_by(f"_l_{n}", "i").alias(f"_c_{n}") for n in columns])
    table = _starts(table, weight, source, length, seeded)
    df = df.join(table.select("symbol", "_block", *[f"_t{k}" for k in inputs], *[f"_s_{n}" for n in columns]), ["symbol", "_block"])
    run = lambda n, a: F.pow(F.lit(1 - a), F.col(f"_k{source[n]}").cast("double")) * F.col(f"_s_{n}") + F.col(f"_l_{n}")
    out = {n: F.when(F.col(f"_t{source[n]}") + F.col(f"_k{source[n]}") > 0, run(n, a)) for n, a in weight.items()}
    return df.withColumns(out).select(*plain, *columns)


def _local(k: str, a: float, inside: W) -> Column:
    """What the block's values so far come to, from zero."""
    x, count = F.col(f"_x{k}"), F.col(f"_k{k}").cast("double")
    if a == 1:
        return F.coalesce(F.last(x, ignorenulls=True).over(inside), F.lit(0.0))
    decay = F.lit(1 - a)
    return F.coalesce(F.pow(decay, count) * F.sum(F.when(x.isNotNull(), x * a * F.pow(decay, -count))).over(inside), F.lit(0.0))


def _starts(table: DataFrame, weight: dict[str, float], source: dict[str, str], length: int, seeded: bool) -> DataFrame:
    """Adds the values before each block by input (_t), and what each recurrence has come to there (_s)."""
    blocks, inputs = W.partitionBy("symbol").orderBy("_block"), list(dict.fromkeys(source.values()))
    before, whole = blocks.rowsBetween(W.unboundedPreceding, -1), blocks.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    table = table.withColumns({f"_t{k}": F.coalesce(F.sum(f"_n{k}").over(before), F.lit(0)) for k in inputs} | {f"_f{k}": F.first(f"_f{k}", ignorenulls=True).over(whole) for k in inputs})
    ended = {}
    for k in inputs:
        same = [n for n in source if source[n] == k]
        recent = W.partitionBy("symbol").orderBy(f"_t{k}").rangeBetween(-max(_reach(weight[n]) for n in same) - length, -1)
        ended[f"_d{k}"] = F.collect_list(F.struct((F.col(f"_t{k}") + F.col(f"_n{k}")).alias("at"), *[f"_c_{n}" for n in same])).over(recent)
    table = table.withColumns(ended)
    return table.withColumns({f"_s_{n}": _start(n, source[n], a, seeded) for n, a in weight.items()})


def _start(n: str, k: str, a: float, seeded: bool) -> Column:
    t, decay = F.col(f"_t{k}"), F.lit(1 - a)
    total = F.aggregate(f"_d{k}", F.lit(0.0), lambda s, e: s + e[f"_c_{n}"] * F.pow(decay, (t - e["at"]).cast("double")))
    return total + (F.coalesce(f"_f{k}", F.lit(0.0)) * F.pow(decay, t.cast("double")) if seeded else F.lit(0.0))


def ewm(df: DataFrame, name: str, x: Column, span: float | None = None, alpha: float | None = None, adjust: bool = False) -> DataFrame:
    """Exponentially weighted mean by span or alpha. With adjust, weights are normalised over the values so far (nulls neither count nor decay)."""
    a = alpha if alpha is not None else 2.0 / (span + 1.0)
    if not adjust:
        return smoothed(df, {name: (x, a)})
    kept = df.columns
    both = smoothed(df, {"_num": (x, a), "_den": (F.when(x.isNotNull(), 1.0), a)}, seeded=False)
    return both.withColumn(name, F.try_divide(F.col("_num"), F.col("_den"))).select(*kept, name)
