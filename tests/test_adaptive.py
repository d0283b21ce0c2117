"""The fitted model against a Newton fit in numpy over the same rows, its scores, and the walk-forward folds."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailward.operators import adaptive
from tailward.operators.features import FEATURES
from tailward.plans.catalog import QUERIES
from tailward.plans.products import Z_SCORES, Products

T0 = datetime(2024, 1, 1)


def newton_fit(rows, names, reg, label="label"):
    """Median for missing values, unit scale, regularised logistic weights without a penalty on the intercept."""
    x = np.array([[np.nan if r[c] is None else r[c] for c in names] for r in rows], float)
    y = np.array([r[label] for r in rows], float)
    known = ~np.isnan(x).all(0)
    names, x = [c for c, k in zip(names, known, strict=True) if k], x[:, known]
    # the median of the values, and of an even number the lower of the middle two
    medians = np.array([np.sort(c[~np.isnan(c)])[(np.sum(~np.isnan(c)) - 1) // 2] for c in x.T])
    filled = np.where(np.isnan(x), medians, x)
    mean, std = filled.mean(0), filled.std(0, ddof=1)
    scale = np.where(std > 0, std, np.inf)
    design = np.column_stack([(filled - mean) / scale, np.ones(len(y))])
    penalty = np.diag([reg] * len(names) + [0.0])
    w = np.zeros(design.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (p - y) / len(y) + penalty @ w
        hessian = (design * (p * (1 - p))[:, None]).T @ design / len(y) + penalty + 1e-12 * np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient)

    def score(more):
        z = np.array([[np.nan if r[c] is None else r[c] for c in names] for r in more], float)
        z = (np.where(np.isnan(z), medians, z) - mean) / scale
        return 1 / (1 + np.exp(-(z @ w[:-1] + w[-1])))

    return dict(zip([*names, "(intercept)"], w, strict=True)), score


@pytest.fixture(scope="module")
def products(spark):
    return Products.of_fixture(spark, "/root/testdata/sf0.01")


def test_weights_and_scores_equal_the_newton_fit(spark, products):
    labelled = products.labelled.collect()
    split = datetime.fromisoformat(products.split)
    wanted, score = newton_fit([r for r in labelled if r.bar < split], Z_SCORES, 0.01)
    got = {r.feature: r.weight for r in QUERIES["a1_bc_fit"](spark, products.sf_dir).collect()}
    for name, w in wanted.items():
        assert got[name.removeprefix("z_")] == pytest.approx(w, abs=2e-3)
    later = {(r.variety, r.bar): s for r, s in zip([r for r in labelled if r.bar >= split], score([r for r in labelled if r.bar >= split]), strict=True)}
    rows = QUERIES["a2_bc_score"](spark, products.sf_dir).collect()
    assert len(rows) == len(later)
    assert max(abs(r.score - later[r.variety, r.bar]) for r in rows) < 1e-3


def sample(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    rows = [(k % 4, T0 + timedelta(minutes=15 * (k // 4)), float(a), float(b), None if k % 7 == 0 else float(c), int(v)) for k, ((a, b, c), v) in enumerate(zip(x, y, strict=True))]
    return rows, spark.createDataFrame(rows, "variety int, bar timestamp_ntz, z_a double, z_b double, z_c double, label int")


def test_sweep_equals_newton_fits_of_earlier_folds(spark):
    rows, df = sample(spark)
    names, horizon = ["z_a", "z_b", "z_c"], timedelta(hours=4)
    got = adaptive.tuning_sweep(df, names, [0.001, 0.1, 1.0], folds=3).collect()
    assert [(r.fold, r.reg) for r in got] == [(f, g) for f in (1, 2, 3) for g in (0.001, 0.1, 1.0)]
    asdict = [dict(zip(("variety", "bar", *names, "label"), r, strict=True)) for r in rows]
    last = rows[-1][1]
    step = (last - T0) / 4
    for r in got:
        begin, end = T0 + step * r.fold, T0 + step * (r.fold + 1)
        train = [d for d in asdict if d["bar"] + horizon <= begin]
        valid = [d for d in asdict if begin <= d["bar"] and (d["bar"] < end or r.fold == 3)]
        assert (r.n_train, r.n_valid) == (len(train), len(valid))
        assert r.train_end == max(d["bar"] for d in train) and r.train_end + horizon <= r.valid_start
        _, score = newton_fit(train, names, r.reg)
        p, y = score(valid), np.array([d["label"] for d in valid])
        assert r.log_loss == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)), abs=1e-4)
    for f in (1, 2, 3):
        losses = {r.reg: (r.log_loss, r.chosen) for r in got if r.fold == f}
        assert [g for g, (_, chosen) in losses.items() if chosen] == [min(losses, key=lambda g: losses[g][0])]


def test_later_labels_do_not_reach_earlier_folds(spark):
    """Turning all labels of a fold, and those whose horizon reaches into it, leaves its training, and so earlier folds, as they were."""
    _, df = sample(spark)
    before = adaptive.tuning_sweep(df, ["z_a", "z_b"], [0.1], folds=3).collect()
    start = before[1].valid_start
    turned = df.withColumn("label", F.when(F.col("bar") + F.expr("INTERVAL 4 HOURS") > F.lit(start), 1 - F.col("label")).otherwise(F.col("label")))
    after = adaptive.tuning_sweep(turned, ["z_a", "z_b"], [0.1], folds=3).collect()
    p = lambda rows: [r.log_loss for r in rows]
    assert after[1].n_train == before[1].n_train and p(after)[1] != p(before)[1]
    train = lambda d: adaptive.bc_fit(d.where(F.col("bar") + F.expr("INTERVAL 4 HOURS") <= F.lit(start)), ["z_a", "z_b"])
    assert train(turned).stages[-1].coefficients == train(df).stages[-1].coefficients


def test_sweep_of_odd_tables(spark):
    _, df = sample(spark, 200)
    assert adaptive.tuning_sweep(df.where("false"), ["z_a"], [0.1]).count() == 0
    single = adaptive.tuning_sweep(df.withColumn("label", F.lit(0)), ["z_a"], [0.1, 1.0], folds=2).collect()
    assert [(r.log_loss, r.chosen) for r in single] == [(None, False)] * 4


def test_weights_query_has_every_feature(spark, products):
    rows = QUERIES["a1_bc_fit"](spark, products.sf_dir).collect()
    assert {r.feature for r in rows} == {*FEATURES, "(intercept)"}
