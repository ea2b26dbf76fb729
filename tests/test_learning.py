"""Boosted trees, calibration and descent against loops."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.config import Config, from_dict
from tickloom.operators import boosting, folds
from tickloom.operators import model as md
from tickloom.plans.research import backend
from tickloom.staging import kept

FIELDS = "symbol string, fold int, i long, label int, x array<double>"


def made(n, seed, classes=(-1, 0, 1), features=4, symbol="A", fold=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.choice([0.0, 1.0, 2.5]), rng.random(), rng.gauss(0, 3), float(i % 7)][:features]
        chance = x[0] + x[2] * (0.5 if x[1] > 0.5 else -0.2) + rng.gauss(0, 0.7)
        rows.append((symbol, fold, i, classes[0] if chance < 0 else classes[-1] if chance > 1.4 or len(classes) == 2 else classes[1], x))
    return rows


def thirds_by_loop(labels):
    """Of each row its third: classes by first appearance stand behind each other, and each third takes what every third place holds of a class."""
    order = list(dict.fromkeys(labels))
    line = [c for c in order for _ in range(labels.count(c))]
    share = {c: [sum(1 for k, v in enumerate(line) if v == c and k % 3 == t) for t in range(3)] for c in order}
    queue = {c: [t for t in range(3) for _ in range(share[c][t])] for c in order}
    return [queue[c].pop(0) for c in labels]


def tree_by_loop(bins, g, h, how, used):
    """One tree, node by node: sums over rows, all splits, in plain loops. Node -> (feature, bin) or value."""
    rows = {0: list(range(len(bins)))}
    out, values = {}, {0: -how.rate * sum(g) / max(sum(h), 1)}
    leaves = 1
    for level in range(how.depth):
        found = []
        for node in [n for n in range((1 << level) - 1, (2 << level) - 1) if n in rows]:
            best = None
            G, H = sum(g[r] for r in rows[node]), sum(h[r] for r in rows[node])
            score = lambda a, b: (a / boosting.UNIT) ** 2 / max(b / boosting.UNIT, 1e-3)
            for f in used:
                for b in range(how.bins - 1):
                    left = [r for r in rows[node] if bins[r][f] <= b]
                    if min(len(left), len(rows[node]) - len(left)) < how.least:
                        continue
                    gl, hl = sum(g[r] for r in left), sum(h[r] for r in left)
                    if min(hl, H - hl) < 1e-3 * boosting.UNIT:
                        continue
                    gain = score(gl, hl) + score(G - gl, H - hl) - score(G, H)
                    if best is None or gain > best[0]:
                        best = (gain, f, b, gl, hl, G - gl, H - hl)
            if best and best[0] > 1e-10:
                found.append((node, best))
        for node, (_, f, b, gl, hl, gr, hr) in sorted(found, key=lambda t: -t[1][0])[: how.leaves - leaves]:
            leaves += 1
            out[node] = (f, b)
            for child, a, c, side in ((2 * node + 1, gl, hl, True), (2 * node + 2, gr, hr, False)):
                rows[child] = [r for r in rows[node] if (bins[r][f] <= b) == side]
                values[child] = -how.rate * a / max(c, 1)
    return out, values, {r: n for n, rs in rows.items() for r in rs if n not in out}


@pytest.mark.parametrize("classes", [(-1, 0, 1), (-1, 1)])
def test_trees_are_those_of_loops(spark, classes):
    rows = made(90, 3, classes)
    how = boosting.Growth(rounds=2, rate=0.3, depth=3, leaves=5, least=4, share=0.75, bins=8)
    df = kept(spark.createDataFrame(rows, FIELDS))
    got = boosting.train_rows(df, 4, how).collect()[0]
    x, labels = np.array([r[4] for r in rows]), [r[3] for r in rows]
    edges = [sorted(set(e)) for e in df.agg(*[F.percentile_approx(F.col("x")[k], [j / 8 for j in range(1, 8)], 10_000) for k in range(4)]).collect()[0]]
    bins = [[sum(e < v for e in edges[f]) for f, v in enumerate(row)] for row in x.tolist()]
    part, y = thirds_by_loop(labels), [sorted(set(labels)).index(c) for c in labels]
    per_round = 1 if len(classes) == 2 else 3
    feature = np.frombuffer(got.feature, np.int16).reshape(2, -1, how.nodes)
    threshold, value = (np.frombuffer(v, np.float64).reshape(2, -1, how.nodes) for v in (got.threshold, got.value))
    assert feature.shape[1] == 3 * per_round and (feature >= 0).sum() > 20
    for m in range(3):
        train = [r for r in range(90) if part[r] != m]
        share = [sum(y[r] == c for r in train) / len(train) for c in range(len(classes))]
        score = [[np.log(share[1] / share[0])] if per_round == 1 else [np.log(s) for s in share] for _ in range(90)]
        for t in range(2):
            new = [list(s) for s in score]
            for k in range(per_round):
                g, h = [], []
                for r in train:
                    e = [1.0, np.exp(score[r][0])] if per_round == 1 else [np.exp(v) for v in score[r]]
                    c = 1 if per_round == 1 else k
                    p = e[c] / sum(e)
                    g.append(round((p - (y[r] == c)) * boosting.UNIT))
                    h.append(round((1 if per_round == 1 else 1.5) * p * (1 - p) * boosting.UNIT))
                used = np.random.default_rng([how.seed, t, m * per_round + k]).permutation(4)[:3]
                splits, values, _ = tree_by_loop([bins[r] for r in train], g, h, how, sorted(used))
                n = m * per_round + k
                assert {a: (int(f), float(threshold[t, n, a])) for a, f in enumerate(feature[t, n]) if f >= 0} == {a: (f, edges[f][b]) for a, (f, b) in splits.items()}
                assert all(abs(value[t, n, a] - v) < 1e-6 for a, v in values.items())
                for r in range(90):
                    node = 0
                    while node in splits:
                        node = 2 * node + 1 + (bins[r][splits[node][0]] > splits[node][1])
                    new[r][k] += values[node]
            score = new


def test_folds_of_many_blocks_grow_the_same_trees(spark):
    rows = made(150, 5) + made(90, 6, (0, 1), fold=1) + made(60, 7, symbol="B") + made(9, 8, symbol="C") + [("D", 0, i, 1, [0.0, 1.0, 2.0, 3.0]) for i in range(30)]
    rows += [("E", 0, i, 1 if i < 2 else -1, [float(i), 0.0, 0.0, 1.0]) for i in range(40)]  # two rows of a class: one model without calibration
    df, how = kept(spark.createDataFrame(rows, FIELDS)), boosting.Growth(rounds=2, rate=0.2, depth=2, leaves=4, least=5, bins=16)
    told = lambda block: {(r.symbol, r.fold): r for r in boosting.train_rows(df, 4, how, block).collect()}
    one, many = told(1 << 16), told(40)
    assert one == many
    assert set(one) == {("A", 0), ("A", 1), ("B", 0), ("E", 0)}
    assert one["E", 0].models == 1 and one["E", 0].calibration is None and one["A", 1].trees == 3 and {c.method for c in one["A", 0].calibration} == {"isotonic"}


def test_few_rows_are_calibrated_by_a_curve(spark):
    df = kept(spark.createDataFrame(made(45, 4, (0, 1)), FIELDS))
    m = boosting.train_rows(df, 4, boosting.Growth(rounds=3, depth=2, least=3)).collect()[0]
    assert [c.method for c in m.calibration] == ["sigmoid"] * 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.booleans()), min_size=1, max_size=40), st.integers(1, 7))
def test_pools_are_isotonic_regression(points, cut):
    """Against the formula: the largest over starts of the smallest over ends of the mean between; and pooled range by range."""
    at = sorted({s for s, _ in points})
    hits = np.array([sum(h for s, h in points if s == a) for a in at])
    n = np.array([sum(1 for s, _ in points if s == a) for a in at])
    whole = boosting.pooled(np.array(at, float), np.array(at, float), hits, n)
    parts = [boosting.pooled(*(np.array(c)[k : k + cut] for c in (at, at, hits, n))) for k in range(0, len(at), cut)]
    merged = boosting.pooled(*(np.concatenate(c) for c in zip(*parts)))
    assert all((a == b).all() for a, b in zip(whole, merged))
    got = boosting.isotonic(np.array(at, float), whole[0], whole[1], whole[2] / whole[3])
    for k in range(len(at)):
        want = max(min(hits[a : b + 1].sum() / n[a : b + 1].sum() for b in range(k, len(at))) for a in range(k + 1))
        assert abs(got[k] - want) < 1e-12
    assert (np.diff(got) >= 0).all()


def test_the_curve_is_the_best_one():
    rng = np.random.default_rng(3)
    s = np.unique(rng.random(40))
    n, hits = np.ones(len(s)), (rng.random(len(s)) < s).astype(float)
    a, b = boosting.curve(s, hits, n)
    yes, no = hits.sum(), len(s) - hits.sum()
    t = np.where(hits > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    loss = lambda a, b: (np.logaddexp(0, a * s + b) - (1 - t) * (a * s + b)).sum()
    assert all(loss(a, b) <= loss(a + x, b + y) for x in (-0.01, 0, 0.01) for y in (-0.01, 0, 0.01)) and a < 0


def test_boosted_scores(spark):
    """A signal that a line cannot follow; scores of all test bars, calibrated, against the vote of the saved model; a fold without a model scores 1."""
    rng = random.Random(1)
    rows = [(s, i, *(x := (rng.random(), rng.random())), 1 if (x[0] > 0.5) != (x[1] > 0.5) else -1, False) for s, n in (("A", 500), ("B", 30)) for i in range(n)]
    matrix = spark.createDataFrame(rows, "symbol string, i long, a double, b double, label int, warmup boolean").withColumn("label", F.when((F.col("symbol") == "A"), F.col("label")))
    ranges = spark.createDataFrame([("A", 0, 0, 300, 320, 400), ("A", 1, 0, 380, 400, 500), ("B", 0, 0, 10, 12, 30)], "symbol string, fold int, train_lo long, train_hi long, test_lo long, test_hi long")
    cfg = from_dict({"model": {"n_estimators": 30, "learning_rate": 0.2, "max_depth": 3, "min_child_samples": 5}})
    assert backend(cfg) is boosting and backend(from_dict({"model": {"model_type": "plain"}})) is md
    models = kept(boosting.train(matrix, ranges, ["a", "b"], cfg))
    got = {(r.symbol, r.i): r.probability for r in boosting.score(matrix, ranges, models, ["a", "b"], block=64).collect()}
    assert len(got) == 80 + 100 + 18 and {p for (s, _), p in got.items() if s == "B"} == {1.0}
    want = {i: (a, b, y) for s, i, a, b, y, _ in rows if s == "A"}
    right = [(p > 0.5) == (want[i][2] == 1) for (s, i), p in got.items() if s == "A"]
    assert sum(right) / len(right) > 0.9 and all(0 <= p <= 1 for p in got.values())
    assert {p for r in boosting.score(matrix, ranges, models, ["a", "b"], label=0).filter("symbol = 'A'").collect() for p in [r.probability]} == {0.0}


def test_saved_models_score_alike(spark, tmp_path):
    df = kept(spark.createDataFrame(made(80, 2), FIELDS))
    models = kept(boosting.train_rows(df, 4, boosting.Growth(rounds=2, depth=2)))
    boosting.save(models, str(tmp_path / "m"))
    assert boosting.load(spark, str(tmp_path / "m")).collect() == models.collect()


def test_descent_over_blocks_is_that_of_one(spark):
    rows = made(120, 9) + made(70, 10, (0, 1), fold=1) + made(8, 11, symbol="C") + [("D", 0, i, 1, [1.0, 2.0, 3.0, 4.0]) for i in range(20)]
    df = kept(spark.createDataFrame(rows, FIELDS))
    one, many = ({(r.symbol, r.fold): r for r in md.train_rows(df, 0.2, steps=6, block=b).collect()} for b in (1 << 16, 32))
    assert set(one) == set(many) == {("A", 0), ("A", 1)}
    for k, m in one.items():
        assert m.classes == many[k].classes
        for c in ("mean", "weights", "bias"):
            assert np.allclose(np.array(m[c]), np.array(many[k][c]), rtol=0, atol=1e-9)
    x, y = np.array([r[4] for r in rows[:120]]), np.array([r[3] for r in rows[:120]])
    w, z = np.array(one["A", 0].weights), (x - x.mean(0)) / x.std(0)
    rng = random.Random(42)
    own, bias = [[rng.uniform(-0.01, 0.01) for _ in range(4)] for _ in range(3)], [0.0] * 3
    for _ in range(6):  # row by row
        gw, gb = [[0.0] * 4 for _ in range(3)], [0.0] * 3
        for a, c in zip(z.tolist(), y.tolist()):
            e = [np.exp(sum(p * q for p, q in zip(own[k], a)) + bias[k]) for k in range(3)]
            for k in range(3):
                err = (e[k] / sum(e) - ((-1, 0, 1)[k] == c)) / 120
                gb[k] += err
                gw[k] = [g + err * v for g, v in zip(gw[k], a)]
        bias = [b - 0.2 * g for b, g in zip(bias, gb)]
        own = [[p - 0.2 * (g + 1e-3 * p) for p, g in zip(own[k], gw[k])] for k in range(3)]
    assert np.allclose(w, own, rtol=0, atol=1e-9)


def test_each_bar_meets_its_folds(spark):
    n = 900
    bars = spark.range(n).select(F.lit("A").alias("symbol"), F.col("id").alias("i"))
    ranges = folds.walk_forward(spark.createDataFrame([("A", n)], "symbol string, n long"), 100, 50, 10, 24)
    got = sorted((r.fold, r.part, r.i) for r in folds.members(bars, ranges).collect())
    want = sorted((f.fold, p, i) for f in ranges.collect() for p, lo, hi in (("train", f.train_lo, f.train_hi), ("test", f.test_lo, f.test_hi)) for i in range(lo, hi))
    assert got == want
    assert len({i for _, p, i in got if p == "test"}) == sum(p == "test" for _, p, _ in got)


def test_default_model_is_boosted():
    assert backend(Config()) is boosting
