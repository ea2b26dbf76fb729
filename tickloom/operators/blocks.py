"""Training and test rows of folds in blocks: one row of a table holds the rows of a range of bars as packed arrays, so that a step over all rows is one pass of
numpy over each block, and a fold of any size spreads over as many tasks as it has blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bars of a block.
BLOCK = 1 << 16
SCHEMA = "symbol string, fold int, block long, i binary, label binary, x binary"
KEY = ("symbol", "fold")


def pack(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("i")
    x = np.nan_to_num(np.array(rows.column("x").to_pylist(), np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    i, label = rows.column("i").to_numpy().astype(np.int64), rows.column("label").to_numpy().astype(np.int32)
    one = {c: [rows.column(c)[0].as_py()] for c in ("symbol", "fold", "block")}
    return pa.table({"symbol": pa.array(one["symbol"], pa.string()), "fold": pa.array(one["fold"], pa.int32()), "block": pa.array(one["block"], pa.int64()), **{n: pa.array([v.tobytes()], pa.binary()) for n, v in (("i", i), ("label", label), ("x", x))}})


def packed(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """SCHEMA from rows (symbol, fold, i, label, x); values that are not finite become 0. A block holds the rows of so many bars at most."""
    dealt = rows.select("symbol", F.col("fold").cast("int").alias("fold"), F.floor(F.col("i") / block).alias("block"), F.col("i").cast("long").alias("i"), F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("label"), "x")
    return dealt.groupBy("symbol", "fold", "block").applyInArrow(pack, SCHEMA)


def column(batch: pa.RecordBatch, name: str, k: int, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(batch.column(name)[k].as_buffer(), kind)


def each(run: Callable[[pa.RecordBatch, int], dict | None]) -> Callable:
    """A function of Arrow batches from one of a batch and a row number, which gives the columns of what comes of the row."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                if (out := run(batch, k)) is not None:
                    yield pa.RecordBatch.from_pydict(out)

    return over


def sole(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks of folds that have one, and those of folds that have more: the sums of the first are whole within their task."""
    counts = blocks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_blocks"))
    marked = blocks.join(counts, list(KEY))
    return marked.filter("_blocks = 1").drop("_blocks"), marked.filter("_blocks > 1").drop("_blocks")
