"""Closed forms and finite differences for the model fits."""

import numpy as np
import pytest

from lotwise.operators import gp, hierarchical as hier
from lotwise.operators.linear import ard_linear_fit, bayes_linear_fit, moments, ridge_fit


def frame(spark, x, y, names, parts=3):
    rows = [tuple(float(v) for v in (*r, t)) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*names, "y"])).repartition(parts)


@pytest.mark.parametrize("d", [3, 12])
def test_ridge_is_the_closed_form(spark, d):
    rng = np.random.default_rng(1)
    x, names = rng.normal(size=(200, d)) + 5, [f"f{i}" for i in range(d)]
    y = x @ rng.normal(size=d) + rng.normal(size=200)
    m = moments(frame(spark, x, y, names), names, "y")
    model = ridge_fit(m, 2.0)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(d), xc.T @ yc)
    assert np.allclose(model.weights, w)
    assert np.isclose(model.intercept, y.mean() - x.mean(0) @ w)
    part = ridge_fit(m.subset(names[:2]), 2.0)
    w2 = np.linalg.solve(xc[:, :2].T @ xc[:, :2] + 2.0 * np.eye(2), xc[:, :2].T @ yc)
    assert np.allclose(part.weights, w2)


def test_relevance_recovery(spark):
    rng = np.random.default_rng(42)
    d, k = 100, 10
    x, xt = rng.random((100, d)) - 0.5, rng.random((100, d)) - 0.5
    w = np.concatenate([100 * rng.normal(size=k), np.zeros(d - k)])
    y, yt = x @ w + 0.1 * rng.normal(size=100), xt @ w + 0.1 * rng.normal(size=100)
    names = [f"f{i}" for i in range(d)]
    train, test = moments(frame(spark, x, y, names), names, "y"), moments(frame(spark, xt, yt, names), names, "y")
    plain = bayes_linear_fit(train, test=test)
    v = np.linalg.inv(np.eye(d) + x.T @ x)
    assert np.allclose(plain.mean, v @ x.T @ y, atol=1e-6)
    assert np.isclose(plain.trace[0], np.sqrt(np.mean((yt - xt @ plain.mean) ** 2)), rtol=1e-6)
    ard = ard_linear_fit(train, test=test)
    assert len(ard.trace) == 10 and ard.trace[-1] < plain.trace[0]
    assert set(np.argsort(-np.abs(ard.mean))[: k - 2]) <= set(range(k))
    table = {r["feature"]: r for r in ard.table(spark).collect()}
    assert table["f0"]["alpha_hat"] == pytest.approx(ard.a / ard.b[0])


def toy(rng, n=60, d=2):
    x = rng.normal(size=(n, d))
    return x, np.sin(2 * x[:, 0]) + 0.1 * rng.normal(size=n)


def exact_lml(x, y, h):
    c = gp.rbf_block(x, x, h.scale, h.variance) + h.noise * np.eye(len(y))
    return -0.5 * y @ np.linalg.solve(c, y) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * len(y) * np.log(2 * np.pi)


def test_bound_with_all_points_is_the_marginal_likelihood(spark):
    x, y = toy(np.random.default_rng(3), 30)
    h = gp.Hyper(np.array([0.7, 1.1]), 1.3, 0.05, x, 1e-8)
    names = ["a", "b"]
    df = frame(spark, x, y, names)
    value, _ = gp.collapsed_bound(gp.row_sums(df, names, "y", h), h)
    assert value == pytest.approx(exact_lml(x, y, h), abs=1e-3)
    model = gp.condition(df, names, "y", h)
    xs = np.random.default_rng(4).normal(size=(5, 2))
    got = model.predict(frame(spark, xs, np.arange(5), names)).orderBy("y").collect()
    c = gp.rbf_block(x, x, h.scale, h.variance) + h.noise * np.eye(30)
    k = gp.rbf_block(xs, x, h.scale, h.variance)
    assert np.allclose([r["gp_mean"] for r in got], k @ np.linalg.solve(c, y), atol=1e-3)
    var = h.variance - np.einsum("ij,ji->i", k, np.linalg.solve(c, k.T))
    assert np.allclose([r["gp_var"] for r in got], var, atol=1e-3)


@pytest.mark.parametrize("deep", [False, True])
def test_gp_gradient_by_finite_differences(spark, deep):
    rng = np.random.default_rng(5)
    x, y = toy(rng, 40)
    names = ["a", "b"]
    df = frame(spark, x, y, names, 2).cache()
    net = gp.init_net(2, 4, 2, seed=1) if deep else None
    h = gp.Hyper(np.array([0.7, 1.1]), 1.3, 0.2, x[:5] + 0.1, 0.1, net)
    theta = h.pack(True)
    _, grad = gp.bound_and_gradient(df, names, "y", h, True)
    assert len(grad) == len(theta)

    def value(t):
        hh = h.unpack(t, True)
        k = hh.kernel(x)
        return gp.collapsed_bound(gp.RowSums(k.T @ k, k.T @ y, float(y @ y), len(y)), hh)[0]

    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-5
        assert grad[i] == pytest.approx((value(theta + step) - value(theta - step)) / 2e-5, rel=1e-4, abs=1e-4)


def test_gp_fit_learns_and_relevance_ranks_the_signal(spark):
    x, y = toy(np.random.default_rng(6), 200)
    names = ["a", "b"]
    df = frame(spark, x, y, names, 2).cache()
    z = gp.inducing_points(df, names, 12)
    model = gp.sparse_gp_fit(df, names, "y", z)
    assert model.trace[-1] > model.trace[0]
    assert model.relevance(spark).first()["feature"] == "a"
    deep = gp.deep_kernel_gp_fit(df, names, "y", z, tolerance=1e-4, hidden=6)
    assert deep.trace[-1] > deep.trace[0]
    assert {r["feature"] for r in deep.relevance(spark).collect()} == {"latent_0", "latent_1"}
    sweep = gp.posterior_sweep(model, df, "a", n=9).collect()
    assert len(sweep) == 9 and all(r["lower"] < r["pred"] < r["upper"] for r in sweep)


GROUPS = {"quality": ("q0", "q1"), "performance": ("p0",), "status": ("p0", "s0"), "seniority": ("e0",), "levy": ("l0",)}


def hier_rows(spark, n=80):
    rng = np.random.default_rng(8)
    names = ["q0", "q1", "p0", "s0", "e0", "l0"]
    x = rng.normal(size=(n, 6))
    y = np.logaddexp(0, 3 + 2 * x[:, 4]) + 1 + 0.3 * rng.normal(size=n)
    return frame(spark, x, y, names, 2).cache(), x, y


def test_hierarchical_gradient_by_finite_differences(spark):
    df, _, _ = hier_rows(spark)
    lay = hier.layout(GROUPS)
    mom = hier.column_moments(df, lay)
    rng = np.random.default_rng(9)
    theta = 0.3 * rng.normal(size=2 * lay.size)
    noise = rng.standard_normal((2, 4))
    block = df.select(*[c for c in lay.columns[:0]], "q0", "q1", "p0", "s0", "e0", "l0", "y").toPandas()
    cols = block[[*lay.columns]].to_numpy() if len(set(lay.columns)) == len(lay.columns) else np.column_stack(
        [block[c] for c in lay.columns]
    )
    data = np.column_stack([cols, block["y"]])

    def value(t):
        loc, scale = t[: lay.size], np.exp(t[lay.size :])
        draws = loc[lay.slices()["price"]] + scale[lay.slices()["price"]] * noise
        flat = hier._likelihood_block(data, [hier._argument(lay, loc, d)[0] for d in draws]).reshape(2, -1)
        const = -mom.n * (0.5 * np.log(2 * np.pi) + np.log(2.0))
        return hier.prior_terms(t, mom, lay)[0] + const + flat[:, 0].mean()

    v1, g1 = hier.prior_terms(theta, mom, lay)
    v2, g2, second = hier.likelihood_terms(df, "y", theta, noise, mom, lay)
    assert v1 + v2 == pytest.approx(value(theta))
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-5
        assert (g1 + g2)[i] == pytest.approx((value(theta + step) - value(theta - step)) / 2e-5, rel=1e-4, abs=1e-4)
    for i in (0, 4, 6, lay.slices()["price"].start, lay.size + lay.slices()["price"].start):
        step = np.zeros(len(theta))
        step[i] = 1e-4
        up, down = (hier.likelihood_terms(df, "y", theta + sign * step, noise, mom, lay)[1] for sign in (1, -1))
        assert np.allclose(second[i], (up - down) / 2e-4, rtol=1e-4, atol=1e-3)


def test_hierarchical_bound_agrees_with_sampling(spark):
    """The closed-form bound equals a plain Monte-Carlo estimate of log p − log q."""
    df, x, y = hier_rows(spark, 20)
    lay = hier.layout(GROUPS)
    at = lay.slices()
    mom = hier.column_moments(df, lay)
    rng = np.random.default_rng(10)
    theta = np.concatenate([0.3 * rng.normal(size=lay.size), np.log(np.full(lay.size, 0.4))])
    loc, scale = theta[: lay.size], np.exp(theta[lay.size :])
    names = ["q0", "q1", "p0", "s0", "e0", "l0"]
    xs = {f: x[:, [names.index(c) for c in GROUPS[f]]] for f in hier.FACTORS}
    lp = lambda v, m, s=1.0: -0.5 * ((v - m) / s) ** 2 - np.log(s) - 0.5 * np.log(2 * np.pi)
    total = []
    guide = {f: xs[f] @ loc[at[f]] + loc[at[f"b_{f}"]] for f in hier.FACTORS}
    guide["performance"] = guide["performance"] + loc[at["pq"]] * guide["quality"]
    for _ in range(6000):
        w = loc + scale * rng.standard_normal(lay.size)
        out = (lp(w, 0.0) - lp(w, loc, scale)).sum()
        latent = {f: guide[f] + rng.standard_normal(len(y)) for f in hier.FACTORS}
        for f in hier.FACTORS:
            mean = xs[f] @ w[at[f]] + w[at[f"b_{f}"]]
            if f == "performance":
                mean = mean + w[at["pq"]] * latent["quality"]
            out += (lp(latent[f], mean) - lp(latent[f], guide[f])).sum()
        perf, stat, sen, bias = w[at["price"]]
        z = perf * latent["performance"] + stat * latent["status"] + sen * latent["seniority"] + latent["levy"] + bias
        total.append(out + lp(y, np.logaddexp(0, z) + 1, 2.0).sum())
    noise = np.random.default_rng(11).standard_normal((4000, 4))
    value = hier.prior_terms(theta, mom, lay)[0] + hier.likelihood_terms(df, "y", theta, noise, mom, lay)[0]
    assert value == pytest.approx(np.mean(total), abs=5 * np.std(total) / np.sqrt(len(total)))


def test_hierarchical_fit_raises_the_bound_and_scores(spark):
    df, _, _ = hier_rows(spark, 150)
    model = hier.hierarchical_fit(df, "y", GROUPS)
    assert model.trace[-1] > model.trace[0] and abs(model.trace[-1] - model.trace[-2]) < 1e-6 * abs(model.trace[-1])
    # At the tolerance in use, no parameter has a slope left that one deviation of it would notice.
    lay = hier.layout(GROUPS)
    own_scale = np.concatenate([model.scale, np.ones(lay.size)])
    assert np.abs(model.gradient * own_scale).max() < 1e-2 and len(model.trace) < 40
    assert model.posterior(spark).count() == hier.layout(GROUPS).size
    scored = model.price(df)
    assert scored.where("pred <= 1 or pred is null").isEmpty()
    assert {"quality_score", "levy_score"} <= set(scored.columns)


def test_fitted_holdouts_equal_one_fit_per_run(spark):
    from lotwise.operators import encode, evaluate, sample
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.1] + 2
    y = 3 + np.sin(x[:, 0]) + 0.1 * x[:, 1] + 0.2 * rng.normal(size=300)
    rows = [(i // 2, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))] + [(None, 1.0, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0)]
    df, names = spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(3), ["a", "b", "c"]
    h = gp.Hyper(np.ones(3), 1.0, 0.5, rng.normal(size=(8, 3)), 0.1)
    got = gp.fitted_holdouts(df, names, "y", "id", h, runs=3).orderBy("run").collect()
    assert [r.run for r in got] == [1, 2, 3] and len({r.variance for r in got}) == 3
    for r in got:
        train, test = sample.train_test(df.dropna(), "id", str(r.run))
        scaler = encode.fit_scaler(train, [*names, "y"])
        model = gp.amplitude_fit(scaler.transform(train), names, "y", h)
        priced = gp.price_band(model.predict(scaler.transform(test)), scaler, "y").withColumn("truth", F.exp(scaler.inverse(F.col("y"), "y")))
        want = evaluate.evaluate(priced, "truth", "pred").first()
        assert np.allclose([r.variance, r.noise, r.bound], [model.hyper.variance, model.hyper.noise, model.trace[-1]], rtol=1e-5)
        assert np.allclose([r.mae, r.rmse, r.r2], [want.mae, want.rmse, want.r2], rtol=1e-5)
    with pytest.raises(ValueError):
        gp.fitted_holdouts(df, names, "y", "id", h, runs=gp.MOST_RUNS + 1)


def test_repeated_holdouts_equal_one_model_per_run(spark):
    from lotwise.operators import encode, evaluate, sample

    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.1] + 2
    y = 3 + np.sin(x[:, 0]) + 0.1 * x[:, 1] + 0.2 * rng.normal(size=300)
    rows = [(i // 2, *map(float, r), float(t), float(np.exp(t))) for i, (r, t) in enumerate(zip(x, y))]
    # Unknown values: in no mean of their own column, but the row's other values count; a NULL key is on the train side.
    rows += [(None, 1.0, 1.0, 1.0, 1.0, 3.0), (500, 9.0, 9.0, 1.0, 1.0, None)] + [(600 + i, None, 3.0 + i, 1.0, 4.0, 60.0) for i in range(30)]
    df, names = spark.createDataFrame(rows, "id long, a double, b double, c double, y double, price double").repartition(3), ["a", "b", "c"]
    plain = gp.Hyper(np.ones(3), 1.0, 0.5, rng.normal(size=(8, 3)), 0.1)
    models = {"plain": plain, "deep": gp.Hyper(np.ones(2), 1.3, 0.4, rng.normal(size=(5, 3)), 0.1, gp.init_net(3, 4, 2, 1))}
    got = gp.repeated_holdouts(df, names, "y", "price", "id", models, runs=3).collect()
    assert sorted((r.model, r.run) for r in got) == [(m, r) for m in ("deep", "plain") for r in (1, 2, 3)]
    for r in got:
        train, test = sample.train_test(df, "id", str(r.run))
        scaler = encode.fit_scaler(train, [*names, "y"])
        model = gp.condition(scaler.transform(train), names, "y", models[r.model])
        want = evaluate.evaluate(gp.price_band(model.predict(scaler.transform(test)), scaler, "y"), "price", "pred").first()
        assert np.allclose([r.mae, r.rmse, r.r2], [want.mae, want.rmse, want.r2], rtol=1e-9)
    # Rows of one key leave runs without test rows or without train rows: every run is there, without metrics.
    alone = gp.repeated_holdouts(df.where("id = 3"), names, "y", "price", "id", models, runs=10).collect()
    assert len(alone) == 20 and all(r.mae is None and r.r2 is None for r in alone)
    with pytest.raises(ValueError):
        gp.repeated_holdouts(df, names, "y", "price", "id", models, runs=gp.MOST_RUNS + 1)
