"""Ridge over a category of many levels against the dense solve."""

import numpy as np
import pandas as pd
import pytest

from lotwise.operators import levels


def _dense(data, names, alpha, known):
    """Weights, intercept and level weights of the ridge on explicit 0/1 columns, the intercept free."""
    place = {level: i for i, level in enumerate(known)}
    x = np.zeros((len(data), len(names) + len(known)))
    x[:, : len(names)] = data[names]
    for row, level in enumerate(data["k"]):
        if level is not None:
            x[row, len(names) + place[level]] = 1.0
    mean, y = x.mean(0), data["y"].to_numpy()
    centred = x - mean
    w = np.linalg.solve(centred.T @ centred + alpha * np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    return w[: len(names)], y.mean() - w @ mean, dict(zip(known, w[len(names) :], strict=True))


@pytest.mark.parametrize("alpha", [0.3, 5.0])
def test_five_thousand_levels_equal_the_dense_ridge(spark, alpha):
    rng = np.random.default_rng(5)
    n = 9000
    level = np.where(rng.random(n) < 0.33, 0, rng.integers(0, 5200, n))  # one level holds a third of the rows
    keys = np.array([f"k{v}" for v in level], dtype=object)
    keys[rng.random(n) < 0.05] = None
    keys[:5200] = [f"k{v}" for v in range(5200)]
    data = pd.DataFrame({"k": keys, "a": rng.normal(3, 2, n), "b b": rng.normal(size=n)})
    data["y"] = 100 + data["a"] - 2 * data["b b"] + 0.01 * level + rng.normal(size=n)
    frame = spark.createDataFrame(data, "k string, a double, `b b` double, y double").repartition(7)
    known = sorted({k for k in keys if k is not None})
    assert len(known) == 5200
    w, intercept, by_level = _dense(data, ["a", "b b"], alpha, known)
    sums = levels.level_sums(frame, ["a", "b b"], "y", "k")
    fit = levels.ridge_fit(sums, alpha)
    assert np.allclose(fit.model.weights, w, atol=1e-8) and np.isclose(fit.model.intercept, intercept, atol=1e-7)
    got = {r["k"]: r["weight"] for r in fit.weights.collect()}
    assert got.keys() == by_level.keys()
    assert max(abs(got[k] - by_level[k]) for k in known) < 1e-7


def test_null_unseen_and_unknown(spark):
    rows = [("a", 1.0, 2.0, 0), ("a", 2.0, 3.0, 1), ("b", 1.5, 9.0, 2), (None, 0.0, 1.0, 3), ("c", None, 4.0, 4), ("b", 1.0, None, 5)]
    frame = spark.createDataFrame(rows, "k string, x double, y double, _weight int")
    fit = levels.ridge_fit(levels.level_sums(frame, ["x"], "y", "k"))
    weights = {r["k"]: r["weight"] for r in fit.weights.collect()}
    assert set(weights) == {"a", "b"}  # the only row of c has no feature
    test = spark.createDataFrame([("a", 1.0, 7), (None, 1.0, 8), ("new", 1.0, 9)], "k string, x double, _weight int")
    scored = fit.predict(test)
    assert scored.columns == ["k", "x", "_weight", "pred"]
    got = {r["k"]: (r["pred"], r["_weight"]) for r in scored.collect()}
    base = fit.model.intercept + fit.model.weights[0]
    assert np.isclose(got["a"][0], base + weights["a"]) and np.isclose(got[None][0], base) and np.isclose(got["new"][0], base)
    assert got["new"][1] == 9


def test_nothing_to_fit_on(spark):
    frame = spark.createDataFrame([("a", None, 2.0)], "k string, x double, y double")
    sums = levels.level_sums(frame, ["x"], "y", "k")
    with pytest.raises(ValueError, match="no complete rows"):
        levels.ridge_fit(sums)
    with pytest.raises(ValueError, match="positive"):
        levels.ridge_fit(sums, 0.0)
