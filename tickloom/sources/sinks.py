"""Results to files, through Spark's writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_metrics(metrics: DataFrame, path: str) -> None:
    """JSON, a line a symbol. An infinite profit factor is written as the text "Infinity"."""
    metrics.write.mode("overwrite").json(path)


def write_equity(curve: DataFrame, path: str) -> None:
    """CSV of bar, timestamp, equity in order of bars; bar counts from 0 in each symbol's window."""
    first = curve.groupBy("symbol").agg(F.min("i").alias("_first"))
    rows = curve.join(first, "symbol").select("symbol", (F.col("i") - F.col("_first")).alias("bar"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "equity")
    rows.repartitionByRange("symbol", "bar").sortWithinPartitions("symbol", "bar").write.mode("overwrite").csv(path, header=True)
