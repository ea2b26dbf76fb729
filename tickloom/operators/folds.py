"""Purged walk-forward folds, as ranges of bars."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from .intervals import matches


def walk_forward(sizes: DataFrame, train: int | str, test: int | str, embargo: int, horizon: int = 0, mode: str = "expanding", min_train: int | None = None) -> DataFrame:
    """(symbol, fold, train_lo, train_hi, test_lo, test_hi), ends exclusive. sizes: symbol, n and, if given by name, the columns of train and test sizes.

    Test blocks follow each other from the first one after train and the gap (the larger of embargo and horizon); a block that does not fit is left out."""
    train, test = (F.col(x) if isinstance(x, str) else F.lit(x) for x in (train, test))
    gap = max(int(embargo), int(horizon), 0)
    s = sizes.withColumns({"_train": train, "_test": test}).filter("n > 0 and _train > 0 and _test > 0").withColumn("_last", F.floor((F.col("n") - F.col("_train") - gap) / F.col("_test")) - 1)
    s = s.filter("_last >= 0").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    s = s.withColumn("test_lo", F.col("_train") + gap + F.col("_k") * F.col("_test")).withColumn("train_hi", F.col("test_lo") - gap)
    s = s.withColumn("train_lo", F.greatest(F.lit(0), F.col("train_hi") - F.col("_train")) if mode == "rolling" else F.lit(0))
    s = s.filter(F.col("train_hi") - F.col("train_lo") >= (F.col("_train") if min_train is None else F.lit(min_train)))
    number = F.row_number().over(W.partitionBy("symbol").orderBy("test_lo")) - 1
    return s.select("symbol", number.alias("fold"), F.col("train_lo").cast("long").alias("train_lo"), F.col("train_hi").cast("long").alias("train_hi"), F.col("test_lo").cast("long").alias("test_lo"), (F.col("test_lo") + F.col("_test")).cast("long").alias("test_hi"))


def iter_walk_forward(*args, **kwargs) -> Iterator:
    """The folds one by one; there are few."""
    return walk_forward(*args, **kwargs).orderBy("symbol", "fold").toLocalIterator()


def adaptive(df: DataFrame, cfg: Config) -> DataFrame:
    """Folds sized to each symbol's bars; a symbol too short for any gets one fold that ends with its last bar."""
    sizes = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("train_n", F.least(F.lit(cfg.backtest.train_size), F.greatest(F.lit(50), F.floor(F.col("n") * 0.6)))).withColumn("test_n", F.least(F.lit(cfg.backtest.test_size), F.greatest(F.lit(20), F.floor(F.col("n") * 0.2))))
    folds = walk_forward(sizes, "train_n", "test_n", cfg.backtest.embargo, cfg.labeling.horizon)
    gap = max(cfg.backtest.embargo, cfg.labeling.horizon)
    short = sizes.join(folds.select("symbol").distinct(), "symbol", "left_anti").withColumn("split", F.greatest(F.lit(1), F.col("n") - F.col("test_n")))
    single = short.filter("split < n").select("symbol", F.lit(0).alias("fold"), F.lit(0).cast("long").alias("train_lo"), F.greatest(F.lit(1), F.col("split") - gap).cast("long").alias("train_hi"), F.col("split").cast("long").alias("test_lo"), F.col("n").cast("long").alias("test_hi"))
    return folds.unionByName(single)


def members(df: DataFrame, folds: DataFrame) -> DataFrame:
    """df's rows by fold and part (train, test); a bar may train in many folds. Folds are spread over bins of bars, so a bar meets those only whose ranges reach into its bin."""
    ranges = F.array(F.struct(F.lit("train").alias("part"), F.col("train_lo").alias("lo"), F.col("train_hi").alias("hi")), F.struct(F.lit("test").alias("part"), F.col("test_lo").alias("lo"), F.col("test_hi").alias("hi")))
    parts = folds.select("symbol", "fold", F.explode(ranges).alias("p")).select("symbol", "fold", "p.*")
    return matches(parts, df, F.col("lo"), F.col("hi") - 1).drop("lo", "hi")
