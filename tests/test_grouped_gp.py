"""Grouped exact GPs against dense numpy, on both the dense and the series path."""

import numpy as np
import pandas as pd
import pytest

from lotwise.operators import grouped_gp as gg


def sin_gap(seed, n=20, repeat=1):
    rng = np.random.default_rng(seed)
    x = np.concatenate([-0.75 + rng.random(n), 0.75 + rng.random(n)]).repeat(repeat)
    return x, np.sin(4 * x) + 0.1 * rng.normal(size=len(x))


def brute(x, y, xs, l, v, s):
    k = lambda a, b: v * np.exp(-l * (a[:, None] - b[None, :]) ** 2)
    c = k(x, x) + s * np.eye(len(x))
    mean = k(xs, x) @ np.linalg.solve(c, y)
    var = v - np.einsum("ij,ji->i", k(xs, x), np.linalg.solve(c, k(x, xs)))
    lml = -0.5 * y @ np.linalg.solve(c, y) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * len(y) * np.log(2 * np.pi)
    return mean, var, lml


@pytest.fixture(scope="module")
def frames(spark):
    parts = {"a": sin_gap(1), "b": sin_gap(2, 10, 3), "c": sin_gap(3, 60)}
    train = pd.concat([pd.DataFrame({"g": g, "x": x, "y": y}) for g, (x, y) in parts.items()])
    xs = np.arange(-4, 4, 0.5)
    test = pd.concat([pd.DataFrame({"g": g, "x": xs}) for g in [*parts, "unseen"]])
    return parts, xs, spark.createDataFrame(train).repartition(3), spark.createDataFrame(test)


@pytest.mark.parametrize("dense_upto", [400, 100, 0])
def test_posterior_is_exact_on_both_paths(spark, frames, dense_upto):
    parts, xs, train, test = frames
    got = gg.grouped_gp(train, test, "g", "x", "y", 0.5, 0.1, dense_upto=dense_upto).toPandas()
    assert len(got) == 4 * len(xs)
    assert got[got.g == "unseen"].gp_mean.isna().all()
    for g, (x, y) in parts.items():
        mean, var, _ = brute(x, y, xs, 0.5, 1.0, 0.01)
        mine = got[got.g == g].sort_values("x")
        assert np.allclose(mine.gp_mean, mean, atol=1e-6)
        assert np.allclose(mine.gp_var, var + 0.01, atol=1e-6)
        assert mine.gp_var.iloc[0] > mine.gp_var.iloc[8]  # uncertainty grows away from the data


@pytest.mark.parametrize("dense_upto", [400, 0])
def test_likelihood_and_gradient(spark, frames, dense_upto):
    parts, _, train, _ = frames
    got = gg.likelihood_grid(train, "g", "x", "y", [0.5, 2.0], 0.1, dense_upto).toPandas()
    assert len(got) == 6
    for g, (x, y) in parts.items():
        for l in (0.5, 2.0):
            row = got[(got.g == g) & (np.isclose(got.l, l))].iloc[0]
            f = lambda t: brute(x, y, x[:1], t, 1.0, 0.01)[2]
            assert row.lml == pytest.approx(f(l), abs=1e-4)
            assert row.gradient == pytest.approx((f(l + 1e-5) - f(l - 1e-5)) / 2e-5, rel=1e-3, abs=1e-2)


def test_all_gradients_by_finite_differences():
    x, y = sin_gap(4, 15, 2)
    theta = np.log([0.8, 1.3, 0.05])
    phi = gg.series(x, 0.5, 0.8, gg.terms_needed(2 * 0.8 * 4) + 2)
    frame = pd.DataFrame({"x": x, "y": y}).groupby("x").y.agg(["size", "mean", "var"]).reset_index()
    cells = (frame.x.to_numpy(), frame["size"].to_numpy(float), frame["mean"].to_numpy(), frame["var"].to_numpy() * (frame["size"] - 1).to_numpy())
    value, grad = gg.dense_likelihood(*cells, theta)
    assert value == pytest.approx(brute(x, y, x[:1], *np.exp(theta))[2])
    value2, grad2 = gg.series_likelihood(phi.T @ phi, phi.T @ y, y @ y, len(y), theta)
    assert value2 == pytest.approx(value, abs=1e-6) and np.allclose(grad, grad2, atol=1e-5)
    for i in range(3):
        e = np.eye(3)[i] * 1e-6
        slope = (gg.dense_likelihood(*cells, theta + e)[0] - gg.dense_likelihood(*cells, theta - e)[0]) / 2e-6
        assert grad[i] == pytest.approx(slope, rel=1e-4, abs=1e-4)


def test_tuning_raises_the_likelihood_alike_on_both_paths(spark, frames):
    parts, _, train, _ = frames
    dense = {r.g: r for r in gg.tune_lengthscale(train, "g", "x", "y").collect()}
    summed = {r.g: r for r in gg.tune_lengthscale(train, "g", "x", "y", dense_upto=0).collect()}
    for g, (x, y) in parts.items():
        assert dense[g].lml > brute(x, y, x[:1], 0.5, 1.0, 0.01)[2] + 1
        assert dense[g].l > 1.0
        assert summed[g].lml > brute(x, y, x[:1], 0.5, 1.0, 0.01)[2] + 1


@pytest.mark.parametrize("dense_upto", [400, 0])
def test_a_group_is_solved_once_however_many_chunks_it_is_scored_in(spark, frames, monkeypatch, dense_upto):
    parts, _, train, _ = frames
    xs = np.linspace(-2, 2, 300)
    test = spark.createDataFrame(pd.concat([pd.DataFrame({"g": g, "x": xs}) for g in parts]))
    groups = gg.Groups(train, "g", "x", "y", dense_upto)
    theta = gg.constant_theta(groups, [(np.log(0.5), 0.0, 2 * np.log(0.1))])
    unknowns = gg.solutions(groups, theta).groupBy("g", "dense").count().collect()
    assert len(unknowns) == 3 and all(r.dense == (dense_upto > 0) for r in unknowns)
    whole = gg.predict(groups, theta, test, "x").toPandas().sort_values(["g", "x"])
    monkeypatch.setattr(gg, "TEST_ROWS_PER_TASK", 40)
    pieces = gg.predict(groups, theta, test, "x").toPandas().sort_values(["g", "x"])
    assert np.allclose(whole.gp_mean, pieces.gp_mean, atol=1e-12) and np.allclose(whole.gp_var, pieces.gp_var, atol=1e-12)
    for g, (x, y) in parts.items():
        mean, var, _ = brute(x, y, xs, 0.5, 1.0, 0.01)
        mine = pieces[pieces.g == g]
        assert np.allclose(mine.gp_mean, mean, atol=1e-6) and np.allclose(mine.gp_var, var + 0.01, atol=1e-6)
