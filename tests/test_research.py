import json

import numpy as np
from pyspark.sql import functions as F

from tickloom import cli
from tickloom.config import from_dict
from tickloom.operators import boosting
from tickloom.operators import features as ft
from tickloom.operators import model as md
from tickloom.plans.research import research
from tickloom.sources.sample import sample_bars


def test_research_end_to_end(spark, tmp_path):
    """Two symbols, one too short for a model: its bars score 1. Scores against a loop over the saved coefficients."""
    cfg = from_dict({"model": {"model_type": "logistic"}})
    long, short = sample_bars(spark, rows=420), sample_bars(spark, rows=40, symbol="SHORT")
    r = research(long.unionByName(short), cfg)
    names = ft.feature_names(cfg)
    scored = {(x.symbol, x.i): x.probability for x in r.probabilities.collect()}
    assert {p for (s, _), p in scored.items() if s == "SHORT"} == {1.0}
    md.save(r.models, str(tmp_path / "models"))
    back = md.load(spark, str(tmp_path / "models"))
    assert sorted(back.collect()) == sorted(r.models.collect())
    models = {(m.symbol, m.fold): m for m in back.collect()}
    folds = {f.fold: f for f in r.folds.filter("symbol = 'SAMPLE'").collect()}
    assert models and len(folds) > 0
    rows = {x.i: np.array([x[n] if x[n] is not None else 0.0 for n in names]) for x in r.matrix.filter("symbol = 'SAMPLE'").collect()}
    for k, f in folds.items():
        m = models.get(("SAMPLE", k))
        for i in list(range(f.test_lo, f.test_hi))[::17]:
            want = 1.0
            if m:
                z = (rows[i] - np.array(m.mean)) / np.where(np.array(m.std) > 1e-12, m.std, 1.0)
                logits = np.clip(np.array(m.weights) @ z + np.array(m.bias), -30, 30)
                p = np.exp(logits) / np.exp(logits).sum()
                want = p[m.classes.index(1)] if 1 in m.classes else 0.0
            assert abs(scored["SAMPLE", i] - want) < 1e-9
    m = {x.symbol: x for x in r.metrics.collect()}
    assert m["SAMPLE"].num_trades == r.trades.filter("symbol = 'SAMPLE'").count()
    ends = {x.symbol: x.e for x in r.curve.groupBy("symbol").agg(F.max_by("equity", "i").alias("e")).collect()}
    assert all(abs(m[s].final_equity - e) < 1e-6 for s, e in ends.items())


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "small.yaml").write_text("model:\n  n_estimators: 4\n  max_depth: 2\nfeatures:\n  return_windows: [1]\n  ema_windows: [9]\nbacktest:\n  train_size: 120\n  test_size: 60\n")
    assert cli.main(["make-sample", "--rows", "50", "--out", str(tmp_path / "bars")]) == 0
    assert cli.main(["run", "--sample", "--config", str(tmp_path / "small.yaml"), "--out", str(tmp_path / "out")]) == 0
    assert "final equity" in capsys.readouterr().out
    told = json.loads(next((tmp_path / "out/metrics").glob("part-*.json")).read_text().splitlines()[0])
    assert told["symbol"] == "SAMPLE" and told["num_trades"] >= 0
    assert spark.read.csv(str(tmp_path / "out/equity_curve"), header=True).columns == ["symbol", "bar", "timestamp", "equity"]
    assert boosting.load(spark, str(tmp_path / "out/models")).filter("trees > 0").count() >= 1
