"""Boosted trees over histograms, for all folds at once, with calibrated probabilities.

Features are cut into bins at quantiles of the fold's training rows. A round adds one tree for each class (one for two classes) to each of the fold's models. A level of all
these trees is one pass: each block sums gradients and curvatures by node, feature and bin, partial sums are added up, and splits are chosen from the small tables that result. Gradients
are whole multiples of 2**-30, so sums don't depend on the order in which blocks come. A fold of one block needs no exchange: its task runs the same steps to the end.

Three models share a fold: each is trained without one third of the rows, on which its probabilities are calibrated, class by class, by isotonic regression (by a
logistic curve below LEAST_ISOTONIC rows); the fold's probability is the mean of the three. Isotonic regression pools neighbours that decrease, in any order, so ranges of scores
are pooled in parallel and their pools are pooled again. A fold with less than three rows of a class has one model, as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..staging import kept
from .blocks import BLOCK, KEY, column, each, packed, sole
from .features import vector
from .folds import members
from .model import LEAST_ROWS, training_rows

#: Bins of a feature, models of a fold, rows from which calibration is isotonic, ranges of scores that are pooled apart, partial sums that are added first.
BINS, MODELS, LEAST_ISOTONIC, RANGES, SALT = 64, 3, 50, 64, 16
#: Multiples of which gradients are, the least sum of curvatures on a side of a split, and the least gain.
UNIT, LEAST_CURVE, LEAST_GAIN = float(1 << 30), 1e-3, 1e-10

READY = "symbol string, fold int, block long, classes array<int>, models int, base array<double>, edges array<array<double>>, bins binary, y binary, part binary, score binary"
TREES = "symbol string, fold int, round int, tree int, feature array<int>, bin array<int>, value array<double>"
SCORED = "symbol string, fold int, classes array<int>, models int, y binary, part binary, score binary"
SCHEMA = "symbol string, fold int, classes array<int>, models int, base array<double>, trees int, nodes int, feature binary, threshold binary, value binary, calibration array<struct<tree:int,method:string,lo:array<double>,hi:array<double>,value:array<double>>>"


@dataclass(frozen=True)
class Growth:
    rounds: int = 300
    rate: float = 0.05
    depth: int = 6
    leaves: int = 31
    least: int = 20
    share: float = 0.8
    seed: int = 42
    bins: int = BINS

    @property
    def nodes(self) -> int:
        return (2 << self.depth) - 1


def growth(cfg: Config) -> Growth:
    m = cfg.model
    return Growth(m.n_estimators, m.learning_rate, m.max_depth if m.max_depth > 0 else 12, m.num_leaves, m.min_child_samples, m.colsample_bytree, m.random_state)


# ---------------------------------------------------------------- steps over one block


def probabilities(score: np.ndarray) -> np.ndarray:
    """Of each class, from raw scores (rows, trees of a round): one tree speaks for the second of two classes."""
    if score.shape[1] == 1:
        p = 1.0 / (1.0 + np.exp(-score[:, 0]))
        return np.stack([1.0 - p, p], 1)
    e = np.exp(score - score.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def slopes(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of the log loss in units, (rows, trees of a round)."""
    p = probabilities(score)
    k = p.shape[1]
    p, at = (p[:, 1:], np.array([1])) if k == 2 else (p, np.arange(k))
    scale = 1.0 if k == 2 else k / (k - 1)
    return np.rint((p - (y[:, None] == at)) * UNIT), np.rint(scale * p * (1 - p) * UNIT)


def routed(bins: np.ndarray, feature: np.ndarray, split: np.ndarray) -> np.ndarray:
    """The node of a tree (in heap order) that each row ends in."""
    node, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while (on := feature[node] >= 0).any():
        f = np.maximum(feature[node], 0)
        node = np.where(on, 2 * node + 1 + (bins[row, f] > split[node]), node)
    return node


def histogram(bins: np.ndarray, slot: np.ndarray, slots: int, g: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """(slots, features, bins, 3): sums of gradients and curvatures, and rows; slot -1 is none."""
    use = slot >= 0
    features = bins.shape[1]
    at = ((slot[use, None] * features + np.arange(features)) * width + bins[use]).ravel()
    size = slots * features * width
    sums = [np.bincount(at, None if v is None else np.repeat(v[use], features), size) for v in (g, h, None)]
    return np.stack(sums, -1).astype(np.int64).reshape(slots, features, width, 3)


def choose(sums: np.ndarray, used: np.ndarray, how: Growth, budget: int) -> tuple[np.ndarray, ...]:
    """Of each slot the feature and bin of its split (-1: none), and the values of both sides. The budget goes to the highest gains."""
    left = sums.cumsum(2)
    whole = left[:, :1, -1:]
    left, right = left[:, :, :-1], whole - left[:, :, :-1]
    power = lambda s: (s[..., 0] / UNIT) ** 2 / np.maximum(s[..., 1] / UNIT, LEAST_CURVE)
    fits = (left[..., 2] >= how.least) & (right[..., 2] >= how.least) & (left[..., 1] >= LEAST_CURVE * UNIT) & (right[..., 1] >= LEAST_CURVE * UNIT) & used[None, :, None]
    gain = np.where(fits, power(left) + power(right) - power(whole), -np.inf).reshape(len(sums), -1)
    best = gain.argmax(1)
    top = gain[np.arange(len(gain)), best]
    order = np.argsort(-top, kind="stable")[: max(budget, 0)]
    taken = np.zeros(len(top), bool)
    taken[order] = True
    taken &= top > LEAST_GAIN
    width = left.shape[2]
    feature, split = np.where(taken, best // width, -1), np.where(taken, best % width, 0)
    slot = np.arange(len(sums))
    value = lambda s: -how.rate * s[slot, best // width, best % width, 0] / np.maximum(s[slot, best // width, best % width, 1], 1)
    return feature, split, value(left), value(right)


def started(nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)


def open_nodes(feature: np.ndarray, level: int) -> np.ndarray:
    """The nodes of a level that exist."""
    node = np.arange((1 << level) - 1, (2 << level) - 1)
    return node if level == 0 else node[feature[(node - 1) // 2] >= 0]


def extended(tree: tuple[np.ndarray, ...], level: int, sums: np.ndarray, how: Growth, round_: int, number: int) -> tuple[np.ndarray, ...]:
    """The tree with the splits of a level; sums are those of its open nodes."""
    feature, split, value = (v.copy() for v in tree)
    nodes, columns = open_nodes(feature, level), sums.shape[1]
    if not len(nodes):
        return tree
    if level == 0:
        g, h = sums[0, 0, :, 0].sum(), sums[0, 0, :, 1].sum()
        value[0] = -how.rate * g / max(h, 1)
    used = np.zeros(columns, bool)
    used[np.random.default_rng([how.seed, round_, number]).permutation(columns)[: max(1, round(how.share * columns))]] = True
    f, s, left, right = choose(sums, used, how, how.leaves - 1 - int((feature >= 0).sum()))
    cut = f >= 0
    feature[nodes[cut]], split[nodes[cut]] = f[cut], s[cut]
    value[2 * nodes[cut] + 1], value[2 * nodes[cut] + 2] = left[cut], right[cut]
    return feature, split, value


class Block:
    """A block's rows: bins, classes, thirds, and the raw scores of each model."""

    def __init__(self, batch: pa.RecordBatch, k: int) -> None:
        self.models = batch.column("models")[k].as_py()
        self.y, self.part = column(batch, "y", k, np.int32), column(batch, "part", k, np.int32)
        self.bins = column(batch, "bins", k, np.uint8).reshape(len(self.y), -1)
        self.score = column(batch, "score", k).reshape(self.models, len(self.y), -1).copy()
        self.per_round = self.score.shape[2]

    def slopes(self) -> None:
        self.g, self.h = (np.stack(v) for v in zip(*(slopes(s, self.y) for s in self.score)))

    def sums(self, number: int, tree: tuple[np.ndarray, ...], level: int, width: int) -> np.ndarray:
        """Of the open nodes of a level of a tree; number counts trees by model, then class."""
        model, k = divmod(number, self.per_round)
        nodes = open_nodes(tree[0], level)
        slot = np.full(len(tree[0]), -1)
        slot[nodes] = np.arange(len(nodes))
        trained = self.part != model
        return histogram(self.bins, np.where(trained, slot[routed(self.bins, tree[0], tree[1])], -1), len(nodes), self.g[model, :, k], self.h[model, :, k], width)

    def add(self, trees: list[tuple[np.ndarray, ...]]) -> None:
        for number, (feature, split, value) in enumerate(trees):
            model, k = divmod(number, self.per_round)
            self.score[model, :, k] += value[routed(self.bins, feature, split)]


def _grown(how: Growth):
    def run(batch: pa.RecordBatch, k: int) -> dict:
        """All rounds of a fold of one block, a row a tree; the last row has the scores."""
        block = Block(batch, k)
        count, rows = block.models * block.per_round, []
        for r in range(how.rounds):
            block.slopes()
            trees = []
            for n in range(count):
                tree = started(how.nodes)
                for level in range(how.depth):
                    if not len(open_nodes(tree[0], level)):
                        break
                    tree = extended(tree, level, block.sums(n, tree, level, how.bins), how, r, n)
                trees.append(tree)
            block.add(trees)
            rows += [(r, n, *tree) for n, tree in enumerate(trees)]
        one = [batch.column(c)[k].as_py() for c in KEY]
        cols = list(zip(*rows)) or [()] * 5
        m = len(rows) + 1
        lists = [pa.array([v.tolist() for v in c] + [None], pa.list_(t)) for c, t in zip(cols[2:], (pa.int32(), pa.int32(), pa.float64()))]
        return {"symbol": pa.array([one[0]] * m), "fold": pa.array([one[1]] * m, pa.int32()), "round": pa.array([*cols[0], -1], pa.int32()), "tree": pa.array([*cols[1], -1], pa.int32()), "feature": lists[0], "bin": lists[1], "value": lists[2], "score": pa.array([None] * (m - 1) + [block.score.tobytes()], pa.binary())}

    return each(run)


# ---------------------------------------------------------------- level by level, for folds of many blocks


def _summed(level: int, how: Growth):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial sums of each tree over the blocks of the task."""
        held: dict = {}
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(batch, k)
                block.slopes()
                for t in batch.column("grown")[k].as_py():
                    tree = tuple(np.array(t[c]) for c in ("feature", "bin", "value"))
                    key = (batch.column("symbol")[k].as_py(), batch.column("fold")[k].as_py(), t["tree"])
                    sums = block.sums(t["tree"], tree, level, how.bins)
                    held[key] = held[key] + sums if key in held else sums
        for (symbol, fold, n), sums in held.items():
            yield pa.RecordBatch.from_pydict({"symbol": pa.array([symbol], pa.string()), "fold": pa.array([fold], pa.int32()), "tree": pa.array([n], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

    return run


def _added(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(s.as_buffer(), np.int64) for s in rows.column("sums"))
    return pa.table({**{c: rows.column(c).slice(0, 1) for c in ("symbol", "fold", "tree")}, "sums": pa.array([total.tobytes()], pa.binary())})


def _split(level: int, how: Growth, round_: int):
    def run(batch: pa.RecordBatch, k: int) -> dict:
        tree = tuple(np.array(batch.column(c)[k].as_py()) for c in ("feature", "bin", "value"))
        n = batch.column("tree")[k].as_py()
        nodes = len(open_nodes(tree[0], level))
        if nodes:
            tree = extended(tree, level, column(batch, "sums", k, np.int64).reshape(nodes, -1, how.bins, 3), how, round_, n)
        lists = [pa.array([v.tolist()], pa.list_(t)) for v, t in zip(tree, (pa.int32(), pa.int32(), pa.float64()))]
        return {"symbol": batch.column("symbol").slice(k, 1), "fold": batch.column("fold").slice(k, 1), "round": pa.array([round_], pa.int32()), "tree": pa.array([n], pa.int32()), "feature": lists[0], "bin": lists[1], "value": lists[2]}

    return each(run)


def _advanced(batch: pa.RecordBatch, k: int) -> dict:
    block = Block(batch, k)
    block.add([tuple(np.array(t[c]) for c in ("feature", "bin", "value")) for t in sorted(batch.column("grown")[k].as_py(), key=lambda t: t["tree"])])
    keep = [c for c in batch.schema.names if c not in ("grown", "score")]
    return {c: batch.column(c).slice(k, 1) for c in keep} | {"score": pa.array([block.score.tobytes()], pa.binary())}


def grown_by_levels(ready: DataFrame, how: Growth) -> tuple[DataFrame, DataFrame]:
    """TREES and the blocks with their scores, of folds of many blocks. ready: READY, kept."""
    trees, state = None, ready
    per_round = F.when(F.size("classes") == 2, 1).otherwise(F.size("classes"))
    numbers = ready.select(*KEY, F.explode(F.sequence(F.lit(0), F.col("models") * per_round - 1)).alias("tree")).distinct()
    blank = [F.array_repeat(F.lit(v), how.nodes).alias(n) for v, n in ((-1, "feature"), (0, "bin"), (0.0, "value"))]
    for r in range(how.rounds):
        level_trees = numbers.select(*KEY, F.lit(r).alias("round"), "tree", *blank)
        for level in range(how.depth):
            grown = level_trees.groupBy(*KEY).agg(F.collect_list(F.struct("tree", "feature", "bin", "value")).alias("grown"))
            sums = state.join(grown, list(KEY)).mapInArrow(_summed(level, how), "symbol string, fold int, tree int, sums binary")
            for key in ((*KEY, "tree", "salt"), (*KEY, "tree")):
                salted = sums.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALT))) if "salt" in key else sums
                sums = salted.groupBy(*key).applyInArrow(_added, "symbol string, fold int, tree int, sums binary")
            level_trees = kept(level_trees.join(sums, [*KEY, "tree"]).mapInArrow(_split(level, how, r), TREES))
        grown = level_trees.groupBy(*KEY).agg(F.collect_list(F.struct("tree", "feature", "bin", "value")).alias("grown"))
        state = kept(state.join(grown, list(KEY)).mapInArrow(each(_advanced), READY))
        trees = level_trees if trees is None else trees.unionByName(level_trees)
    return trees, state


# ---------------------------------------------------------------- preparation


def thirds(labels: DataFrame) -> DataFrame:
    """symbol, fold, classes, counts, models, shares: of each class (by first appearance it takes the next places, dealt to the thirds in turn) how many rows are in each third.
    labels: symbol, fold, label, n, first_i. Folds of one class, or of less than LEAST_ROWS rows, have no model."""
    before = F.coalesce(F.sum("n").over(W.partitionBy(*KEY).orderBy("first_i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a class
    dealt = [(F.floor((F.col("b") + F.col("n") + 2 - k) / 3) - F.floor((F.col("b") + 2 - k) / 3)).cast("long") for k in range(3)]
    rows = labels.withColumn("b", before).withColumn("shares", F.array(*dealt))
    found = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("label", "n", "shares"))).alias("c"), F.sum("n").alias("rows"))
    found = found.filter((F.size("c") >= 2) & (F.col("rows") >= LEAST_ROWS))
    return found.select(*KEY, F.col("c.label").alias("classes"), F.col("c.n").alias("counts"), F.when(F.array_min("c.n") >= MODELS, MODELS).otherwise(1).alias("models"), F.col("c.shares").alias("shares"), "rows")


def edges(rows: DataFrame, columns: int, bins: int = BINS) -> DataFrame:
    """symbol, fold, edges: of each feature the values that part its bins, quantiles of the training rows."""
    at = [k / bins for k in range(1, bins)]
    cut = [F.array_sort(F.array_distinct(F.percentile_approx(F.col("x")[k], at, 10_000))).alias(f"e{k}") for k in range(columns)]
    return rows.groupBy(*KEY).agg(*cut).select(*KEY, F.array(*[f"e{k}" for k in range(columns)]).alias("edges"))


def binned(x: np.ndarray, cut: list[list[float]]) -> np.ndarray:
    return np.stack([np.searchsorted(np.array(e), x[:, f], "left") for f, e in enumerate(cut)], 1).astype(np.uint8)


def _ready(batch: pa.RecordBatch, k: int) -> dict:
    label = column(batch, "label", k, np.int32)
    classes, counts, shares, before = (batch.column(c)[k].as_py() for c in ("classes", "counts", "shares", "before"))
    models, cut = batch.column("models")[k].as_py(), batch.column("edges")[k].as_py()
    y = np.searchsorted(classes, label).astype(np.int32)
    part = np.full(len(y), -1, np.int32)
    if models == MODELS:
        for c in range(len(classes)):
            own = np.flatnonzero(y == c)
            part[own] = np.searchsorted(np.cumsum(shares[c]), before[c] + np.arange(len(own)), "right")
    base = []
    for m in range(models):
        n = np.array([counts[c] - (shares[c][m] if models == MODELS else 0) for c in range(len(classes))], float)
        p = np.maximum(n / n.sum(), 1e-15)
        base += [float(np.log(p[1] / p[0]))] if len(p) == 2 else np.log(p).tolist()
    score = np.repeat(np.array(base).reshape(models, 1, -1), len(y), 1)
    x = column(batch, "x", k).reshape(len(y), -1)
    made = {"bins": binned(x, cut), "y": y, "part": part, "score": score}
    return {c: batch.column(c).slice(k, 1) for c in ("symbol", "fold", "block", "classes", "models")} | {"base": pa.array([base], pa.list_(pa.float64())), "edges": batch.column("edges").slice(k, 1)} | {n: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for n, v in made.items()}


def prepared(rows: DataFrame, columns: int, how: Growth, block: int = BLOCK) -> DataFrame:
    """READY blocks of training rows (symbol, fold, i, label, x)."""
    labels = rows.groupBy(*KEY, "label").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first_i"))
    per_block = rows.groupBy(*KEY, F.floor(F.col("i") / block).alias("block"), "label").agg(F.count(F.lit(1)).alias("n"))
    before = per_block.withColumn("b", F.coalesce(F.sum("n").over(W.partitionBy(*KEY, "label").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a block and class
    before = before.groupBy(*KEY, "block").agg(F.map_from_entries(F.collect_list(F.struct("label", "b"))).alias("b"))
    plan = thirds(labels).join(edges(rows, columns, how.bins), list(KEY))
    blocks = packed(rows, block).join(before, [*KEY, "block"]).join(plan, list(KEY))
    blocks = blocks.withColumn("before", F.transform("classes", lambda c: F.coalesce(F.try_element_at(F.col("b"), c), F.lit(0).cast("long")))).drop("b", "rows")
    return blocks.mapInArrow(each(_ready), READY)


# ---------------------------------------------------------------- calibration


def pooled(lo: np.ndarray, hi: np.ndarray, hits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbours whose rate does not rise, made one, from the left; in any order the result is the same."""
    out: list[list] = []
    for pool in zip(lo.tolist(), hi.tolist(), hits.tolist(), n.tolist()):
        out.append(list(pool))
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, b, h, m = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = b, out[-1][2] + h, out[-1][3] + m
    return tuple(np.array(c) for c in zip(*out))


def isotonic(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Level within a pool, linear between pools, level beyond the first and the last."""
    return np.interp(x, np.stack([lo, hi], 1).ravel(), np.repeat(value, 2))


def curve(score: np.ndarray, hits: np.ndarray, n: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(a s + b)), by Newton's method with halved steps, against targets drawn in by one row of each kind."""
    yes, no = hits.sum(), (n - hits).sum()
    t = (hits * (yes + 1) / (yes + 2) + (n - hits) / (no + 2)) / n
    ab = np.array([0.0, np.log((no + 1) / (yes + 1))])
    loss = lambda v: float((n * (np.logaddexp(0, v[0] * score + v[1]) - (1 - t) * (v[0] * score + v[1]))).sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(ab[0] * score + ab[1]))
        d1, d2 = n * (t - p), n * p * (1 - p)
        g = np.array([(score * d1).sum(), d1.sum()])
        hess = np.array([[(score**2 * d2).sum(), (score * d2).sum()], [(score * d2).sum(), d2.sum()]]) + 1e-12 * np.eye(2)
        if np.abs(g).max() < 1e-10:
            break
        step = np.linalg.solve(hess, g)
        size = 1.0
        while size > 1e-10 and loss(ab - size * step) > loss(ab) - 1e-4 * size * float(g @ step):
            size /= 2
        if size <= 1e-10:
            break
        ab = ab - size * step
    return float(ab[0]), float(ab[1])


def _held_out(batch: pa.RecordBatch, k: int) -> dict | None:
    """The scores of a block's rows by the model that was not trained on them, by tree: equal scores once."""
    models = batch.column("models")[k].as_py()
    if models != MODELS:
        return None
    y, part = column(batch, "y", k, np.int32), column(batch, "part", k, np.int32)
    score = column(batch, "score", k).reshape(models, len(y), -1)
    rows = []
    for m in range(models):
        own = np.flatnonzero(part == m)
        p = probabilities(score[m, own]) if len(own) else np.zeros((0, 1))
        for c in range(score.shape[2]):
            s, target = p[:, 1 if score.shape[2] == 1 else c] if len(own) else np.zeros(0), y[own] == (1 if score.shape[2] == 1 else c)
            at, back = np.unique(s, return_inverse=True)
            rows.append((np.full(len(at), m * score.shape[2] + c), at, np.bincount(back, target, len(at)), np.bincount(back, minlength=len(at))))
    tree, at, hits, n = (np.concatenate(c) for c in zip(*rows))
    one = [batch.column(c)[k].as_py() for c in KEY]
    return {"symbol": pa.array([one[0]] * len(at), pa.string()), "fold": pa.array([one[1]] * len(at), pa.int32()), "tree": pa.array(tree, pa.int32()), "score": pa.array(at, pa.float64()), "hits": pa.array(hits.astype(np.int64)), "n": pa.array(n.astype(np.int64))}


def _pools(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("lo")
    lo, hi, hits, n = pooled(*(rows.column(c).to_numpy() for c in ("lo", "hi", "hits", "n")))
    same = {c: pa.array([rows.column(c)[0].as_py()] * len(lo), t) for c, t in (("symbol", pa.string()), ("fold", pa.int32()), ("tree", pa.int32()), ("rows", pa.int64()))}
    return pa.table({**same, "lo": lo, "hi": hi, "hits": pa.array(hits.astype(np.int64)), "n": pa.array(n.astype(np.int64))})


def _calibrated(rows: pa.Table) -> pa.Table:
    """The last step of a tree: its ranges' pools made one curve; or the logistic curve of few rows."""
    rows = rows.sort_by("lo")
    lo, hi, hits, n = (rows.column(c).to_numpy() for c in ("lo", "hi", "hits", "n"))
    if rows.column("rows")[0].as_py() >= LEAST_ISOTONIC:
        lo, hi, hits, n = pooled(lo, hi, hits, n)
        method, value = "isotonic", hits / n
    else:
        method, lo, hi, value = "sigmoid", np.zeros(0), np.zeros(0), np.array(curve(lo, hits, n))
    lists = {c: pa.array([v.tolist()], pa.list_(pa.float64())) for c, v in (("lo", lo), ("hi", hi), ("value", value))}
    return pa.table({**{c: rows.column(c).slice(0, 1) for c in ("symbol", "fold", "tree")}, "method": pa.array([method]), **lists})


def curves(points: DataFrame) -> DataFrame:
    """symbol, fold, tree, method, lo, hi, value: isotonic pools (level from lo to hi), or the logistic curve's two values. points: symbol, fold, tree, score (from 0 to 1, once
    each), hits, n, rows (of the fold, which choose the method)."""
    points = points.select(*KEY, "tree", F.least(F.floor(F.col("score") * RANGES), F.lit(RANGES - 1)).alias("range"), "rows", F.col("score").alias("lo"), F.col("score").alias("hi"), "hits", "n")
    pools = "symbol string, fold int, tree int, rows long, lo double, hi double, hits long, n long"
    many = points.filter(F.col("rows") >= LEAST_ISOTONIC).groupBy(*KEY, "tree", "range").applyInArrow(_pools, pools)
    few = points.filter(F.col("rows") < LEAST_ISOTONIC).drop("range")
    return many.unionByName(few).groupBy(*KEY, "tree").applyInArrow(_calibrated, "symbol string, fold int, tree int, method string, lo array<double>, hi array<double>, value array<double>")


def calibration(scored: DataFrame, sizes: DataFrame) -> DataFrame:
    """symbol, fold, calibration (by tree). scored: SCORED; sizes: symbol, fold, rows."""
    points = scored.mapInArrow(each(_held_out), "symbol string, fold int, tree int, score double, hits long, n long")
    points = points.groupBy(*KEY, "tree", "score").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).join(sizes, list(KEY))
    return curves(points).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("tree", "method", "lo", "hi", "value"))).alias("calibration"))


# ---------------------------------------------------------------- training and scoring


def _bound(rows: pa.Table) -> pa.Table:
    """All trees of a fold in one row, by round."""
    rows = rows.sort_by([("round", "ascending"), ("tree", "ascending")])
    feature, split, value = (np.array(rows.column(c).to_pylist()) for c in ("feature", "bin", "value"))
    cut = rows.column("edges")[0].as_py()
    wide = np.full((len(cut), max(map(len, cut)) + 1), np.inf)
    for f, e in enumerate(cut):
        wide[f, : len(e)] = e
    threshold = wide[np.maximum(feature, 0), split]
    trees = int(rows.column("tree").to_numpy().max()) + 1
    made = {"feature": feature.astype(np.int16), "threshold": threshold, "value": value}
    head = {c: rows.column(c).slice(0, 1) for c in ("symbol", "fold", "classes", "models", "base")}
    return pa.table({**head, "trees": pa.array([trees], pa.int32()), "nodes": pa.array([feature.shape[1]], pa.int32()), **{n: pa.array([v.tobytes()], pa.binary()) for n, v in made.items()}})


def train_rows(rows: DataFrame, columns: int, how: Growth, block: int = BLOCK) -> DataFrame:
    """SCHEMA: a row for each fold of training rows (symbol, fold, i, label, x) with two classes and LEAST_ROWS rows at least."""
    ready = kept(prepared(rows, columns, how, block))
    heads = ready.select(*KEY, "classes", "models", "base", "edges").dropDuplicates(list(KEY))
    one, many = sole(ready)
    grown = kept(one.mapInArrow(_grown(how), TREES + ", score binary"))
    trees = grown.filter("round >= 0").drop("score")
    scored = one.drop("score").join(grown.filter("round < 0").select(*KEY, "score"), list(KEY)).select(*KEY, "classes", "models", "y", "part", "score")
    many = kept(many)
    if not many.isEmpty():
        more, state = grown_by_levels(many, how)
        trees, scored = trees.unionByName(more), scored.unionByName(state.select(*KEY, "classes", "models", "y", "part", "score"))
    sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"))
    bound = trees.join(heads, list(KEY)).groupBy(*KEY).applyInArrow(_bound, SCHEMA.rsplit(", calibration", 1)[0])
    return bound.join(calibration(scored, sizes), list(KEY), "left")


def train(matrix: DataFrame, folds: DataFrame, names: list[str], cfg: Config, block: int = BLOCK) -> DataFrame:
    """train_rows() over each fold's labelled rows out of warm-up. matrix: features with label."""
    return train_rows(training_rows(matrix, folds, names), len(names), growth(cfg), block)


def save(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def voted(x: np.ndarray, model: dict) -> np.ndarray:
    """Probabilities (rows, classes) of a fold's model: the mean over its calibrated models."""
    classes, models = len(model["classes"]), model["models"]
    per_round = 1 if classes == 2 else classes
    nodes = model["nodes"]
    feature, threshold, value = (np.frombuffer(model[c], t).reshape(-1, model["trees"], nodes) for c, t in (("feature", np.int16), ("threshold", np.float64), ("value", np.float64)))
    score = np.repeat(np.array(model["base"]).reshape(models, 1, per_round), len(x), 1)
    row = np.arange(len(x))
    for r in range(len(feature)):
        for n in range(model["trees"]):
            f, t, node = feature[r, n], threshold[r, n], np.zeros(len(x), np.int64)
            while (on := f[node] >= 0).any():
                node = np.where(on, 2 * node + 1 + (x[row, np.maximum(f[node], 0)] > t[node]), node)
            score[n // per_round, :, n % per_round] += value[r, n][node]
    out = np.zeros((len(x), classes))
    by_tree = {c["tree"]: c for c in model["calibration"] or []}
    for m in range(models):
        p = probabilities(score[m])
        if by_tree:
            own = p[:, 1:] if per_round == 1 else p
            made = np.stack([_curved(own[:, c], by_tree[m * per_round + c]) for c in range(per_round)], 1)
            if per_round == 1:
                p = np.hstack([1 - made, made])
            else:
                whole = made.sum(1, keepdims=True)
                p = np.where(whole > 0, made / np.where(whole > 0, whole, 1), 1 / classes)
        out += p / models
    return out


def _curved(s: np.ndarray, c: dict) -> np.ndarray:
    if c["method"] == "isotonic":
        return isotonic(s, *(np.array(c[k]) for k in ("lo", "hi", "value")))
    return 1 / (1 + np.exp(c["value"][0] * s + c["value"][1]))


def _scored(label: int):
    def run(batch: pa.RecordBatch, k: int) -> dict:
        i = column(batch, "i", k, np.int64)
        p = np.ones(len(i))
        if batch.column("classes")[k].is_valid:
            model = {c: batch.column(c)[k].as_py() for c in ("classes", "models", "base", "trees", "nodes", "feature", "threshold", "value", "calibration")}
            seen = model["classes"]
            p = voted(column(batch, "x", k).reshape(len(i), -1), model)[:, seen.index(label)] if label in seen else np.zeros(len(i))
        return {"symbol": pa.array([batch.column("symbol")[k].as_py()] * len(i), pa.string()), "i": pa.array(i), "probability": pa.array(p)}

    return each(run)


def score(matrix: DataFrame, folds: DataFrame, models: DataFrame, names: list[str], label: int = 1, block: int = BLOCK) -> DataFrame:
    """symbol, i, probability of the label for all test bars, warm-up included; 1 where the fold has no model, 0 where its models have not seen the label."""
    tests = members(matrix.select("symbol", "i", vector(names).alias("x")), folds).filter("part = 'test'").withColumn("label", F.lit(0))
    return packed(tests, block).join(models, list(KEY), "left").mapInArrow(_scored(label), "symbol string, i long, probability double")
