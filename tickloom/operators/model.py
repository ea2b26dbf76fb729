"""A multinomial logistic model for each fold, trained in parallel over folds and their blocks, scored with expressions."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..staging import kept
from .blocks import BLOCK, KEY, column, each, packed, sole
from .features import vector
from .folds import members

SCHEMA = "symbol string, fold int, classes array<int>, mean array<double>, std array<double>, weights array<array<double>>, bias array<double>"
#: Gradient steps, and rows that a fold must have to be trained.
STEPS, LEAST_ROWS, L2 = 400, 10, 1e-3


def learning_rate(cfg: Config) -> float:
    return min(max(4 * cfg.model.learning_rate, 0.05), 0.5)


def softmax(logits: np.ndarray) -> np.ndarray:
    logits = np.clip(logits, -30, 30)
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, rate: float, steps: int = STEPS, l2: float = L2, seed: int = 42) -> dict:
    """Full-batch gradient descent on standardised features; weights start small and seeded. One class only gives a model that is certain of it."""
    x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
    classes = sorted(set(int(v) for v in y))
    mean, std = x.mean(0), x.std(0)
    std = np.where(std > 0, std, 1.0)
    z = (x - mean) / np.where(std > 1e-12, std, 1.0)
    rng = random.Random(seed)
    if len(classes) < 2:
        w, b = np.zeros((1, x.shape[1])), np.zeros(1)
    else:
        w = np.array([[rng.uniform(-0.01, 0.01) for _ in range(x.shape[1])] for _ in classes])
        b = np.zeros(len(classes))
        target = (y[:, None] == np.array(classes)[None, :]).astype(float)
        for _ in range(steps):
            error = (softmax(z @ w.T + b) - target) / len(x)
            w -= rate * (error.T @ z + l2 * w)
            b -= rate * error.sum(0)
    return {"classes": classes, "mean": mean.tolist(), "std": std.tolist(), "weights": w.tolist(), "bias": b.tolist()}


def _row(batch: pa.RecordBatch, k: int, classes: list, mean: np.ndarray, std: np.ndarray, w: np.ndarray, b: np.ndarray) -> dict:
    doubles = pa.list_(pa.float64())
    made = {"classes": pa.array([classes], pa.list_(pa.int32())), "mean": pa.array([mean.tolist()], doubles), "std": pa.array([std.tolist()], doubles), "weights": pa.array([w.tolist()], pa.list_(doubles)), "bias": pa.array([b.tolist()], doubles)}
    return {c: batch.column(c).slice(k, 1) for c in KEY} | made


def _fitted(rate: float, steps: int, seed: int):
    def run(batch: pa.RecordBatch, k: int) -> dict | None:
        y = column(batch, "label", k, np.int32)
        if len(y) < LEAST_ROWS or len(set(y.tolist())) < 2:
            return None
        m = fit(column(batch, "x", k).reshape(len(y), -1), y, rate, steps, seed=seed)
        return _row(batch, k, m["classes"], *(np.array(m[c]) for c in ("mean", "std", "weights", "bias")))

    return each(run)


#: What a fold's descent has come to; part: a block's share of the sum that the next step needs.
_STATE = "symbol string, fold int, classes array<int>, n long, mean binary, std binary, weights binary"


def _share(step: str):
    """A block's share of the sums of features, of squared distances from their means, or of the gradient."""

    def run(batch: pa.RecordBatch, k: int) -> dict:
        y, classes, n = column(batch, "label", k, np.int32), batch.column("classes")[k].as_py(), batch.column("n")[k].as_py()
        x = column(batch, "x", k).reshape(len(y), -1)
        if step == "mean":
            part = x.sum(0)
        elif step == "std":
            part = ((x - column(batch, "mean", k)) ** 2).sum(0)
        else:
            z = (x - column(batch, "mean", k)) / column(batch, "std", k)
            w = column(batch, "weights", k).reshape(len(classes), -1)
            error = (softmax(z @ w[:, :-1].T + w[:, -1]) - (y[:, None] == np.array(classes))) / n
            part = np.hstack([error.T @ z, error.sum(0)[:, None]]).ravel()
        return {c: batch.column(c).slice(k, 1) for c in ("symbol", "fold", "classes", "n", "mean", "std", "weights", "block")} | {"part": pa.array([part.tobytes()], pa.binary())}

    return each(run)


def _moved(step: str, rate: float, seed: int):
    """The fold's state after a step, from the shares of its blocks in order."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        total = sum(np.frombuffer(p.as_buffer(), np.float64) for p in rows.column("part"))
        n, classes = rows.column("n")[0].as_py(), rows.column("classes")[0].as_py()
        state = {c: np.frombuffer(rows.column(c)[0].as_buffer(), np.float64) for c in ("mean", "std", "weights")}
        if step == "mean":
            state["mean"] = total / n
        elif step == "std":
            std = np.sqrt(total / n)
            rng = random.Random(seed)
            w = np.array([[rng.uniform(-0.01, 0.01) for _ in total] for _ in classes])
            state |= {"std": np.where(std > 1e-12, std, 1.0), "weights": np.hstack([w, np.zeros((len(classes), 1))]).ravel()}
        else:
            w = state["weights"].reshape(len(classes), -1)
            decay = w * L2
            decay[:, -1] = 0
            state["weights"] = (w - rate * (total.reshape(w.shape) + decay)).ravel()
        return pa.table({**{c: rows.column(c).slice(0, 1) for c in ("symbol", "fold", "classes", "n")}, **{c: pa.array([v.tobytes()], pa.binary()) for c, v in state.items()}})

    return run


def _told(batch: pa.RecordBatch, k: int) -> dict:
    classes = batch.column("classes")[k].as_py()
    w = column(batch, "weights", k).reshape(len(classes), -1)
    return _row(batch, k, classes, column(batch, "mean", k), column(batch, "std", k), w[:, :-1], w[:, -1])


def descended(blocks: DataFrame, heads: DataFrame, rate: float, steps: int, seed: int) -> DataFrame:
    """The same descent for folds of many blocks: a step of all folds is one pass, whose sums over blocks are a row a block."""
    empty = F.lit(b"")
    state = heads.select(*KEY, "classes", "n", *[empty.alias(c) for c in ("mean", "std", "weights")])
    for step in ["mean", "std"] + ["descent"] * steps:
        shares = blocks.join(state, list(KEY)).mapInArrow(_share(step), _STATE + ", block long, part binary")
        state = kept(shares.groupBy(*KEY).applyInArrow(_moved(step, rate, seed), _STATE))
    return state.mapInArrow(each(_told), SCHEMA)


def train_rows(rows: DataFrame, rate: float, steps: int = STEPS, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """A row of SCHEMA for each fold of training rows (symbol, fold, i, label, x; kept) with two classes and LEAST_ROWS rows at least."""
    one, many = sole(kept(packed(rows, block)))
    models, many = one.mapInArrow(_fitted(rate, steps, seed), SCHEMA), kept(many)
    if many.isEmpty():
        return models
    heads = rows.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.col("label").cast("int"))).alias("classes"), F.count(F.lit(1)).alias("n"))
    return models.unionByName(descended(many, heads.filter((F.size("classes") >= 2) & (F.col("n") >= LEAST_ROWS)), rate, steps, seed))


def training_rows(matrix: DataFrame, folds: DataFrame, names: list[str]) -> DataFrame:
    """symbol, fold, i, label, x of each fold's labelled rows out of warm-up, kept. matrix: features with label."""
    rows = matrix.filter("label is not null and not warmup").select("symbol", "i", "label", vector(names).alias("x"))
    return kept(members(rows, folds).filter("part = 'train'").drop("part"))


def train(matrix: DataFrame, folds: DataFrame, names: list[str], cfg: Config) -> DataFrame:
    """train_rows() of all folds: a fold of one block in the task that has it, one of more blocks by a pass over its blocks for each step."""
    return train_rows(training_rows(matrix, folds, names), learning_rate(cfg), seed=cfg.model.random_state)


def probabilities(x: Column, mean: Column, std: Column, weights: Column, bias: Column) -> Column:
    """Softmax of the clipped logits, in the order of classes."""
    scaled = F.transform(F.arrays_zip(x.alias("x"), mean.alias("m"), std.alias("s")), lambda t: (t["x"] - t["m"]) / F.when(t["s"] > 1e-12, t["s"]).otherwise(1.0))
    logit = lambda w, b: F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.aggregate(F.zip_with(scaled, w, lambda a, c: a * c), b, lambda a, c: a + c)))
    logits = F.zip_with(weights, bias, logit)
    powers = F.transform(logits, lambda v: F.exp(v))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, c: a + c))


def probability_of(label: int, proba: Column, classes: Column) -> Column:
    """0 for a label that the model has not seen."""
    return F.coalesce(F.try_element_at(proba, F.nullif(F.array_position(classes, label), F.lit(0)).cast("int")), F.lit(0.0))


def predicted(proba: Column, classes: Column) -> Column:
    """The most probable class, the first of equals."""
    return F.element_at(classes, F.array_position(proba, F.array_max(proba)).cast("int"))


def score(matrix: DataFrame, folds: DataFrame, models: DataFrame, names: list[str], label: int = 1) -> DataFrame:
    """symbol, i, probability of the label for all test bars, warm-up included; 1 where the fold has no model. Models are a row a fold, joined by key."""
    tests = members(matrix.select("symbol", "i", vector(names).alias("x")), folds).filter("part = 'test'").join(models, ["symbol", "fold"], "left")
    proba = probabilities(F.col("x"), F.col("mean"), F.col("std"), F.col("weights"), F.col("bias"))
    p = F.when(F.col("classes").isNull(), 1.0).when(F.size("classes") < 2, (F.col("classes")[0] == label).cast("double")).otherwise(probability_of(label, proba, F.col("classes")))
    return tests.select("symbol", "i", p.alias("probability"))


def save(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)
