"""Behaviour that must not depend on size, order or partitions."""

import numpy as np
import pandas as pd
import pytest
from lotwise.functions import kernels
from lotwise.operators import ascent, blocks, gp, grouped_gp as gg, hierarchical as hier, pairwise, profile, sample
from lotwise.plans import gaussian_process as plans
from pyspark.sql import functions as F


def test_groups_of_any_number_of_cells_answer_and_agree_with_a_dense_solution(spark):
    rng = np.random.default_rng(2)
    parts = {}
    for name, n in (("a", 400), ("b", 401), ("c", 900)):
        x = np.linspace(-40, 40, n)
        parts[name] = (x, np.sin(x / 3) + 0.1 * rng.normal(size=n))
    wide = np.linspace(-40, 40, 100_000)
    rows = pd.concat([pd.DataFrame({"g": g, "x": x, "y": y}) for g, (x, y) in parts.items()] + [pd.DataFrame({"g": "w", "x": wide, "y": np.sin(wide / 3)})])
    points = pd.DataFrame([(g, x) for g in ("a", "b", "c", "w") for x in (-39.0, 0.05, 20.3)], columns=["g", "x"])
    got = gg.grouped_gp(spark.createDataFrame(rows).repartition(16), spark.createDataFrame(points), "g", "x", "y", 0.5, 0.1).toPandas()
    assert got.gp_mean.notna().all() and len(got) == 12
    for g, (x, y) in parts.items():
        xs = np.array([-39.0, 0.05, 20.3])
        k = np.exp(-0.5 * (x[:, None] - x) ** 2) + 0.01 * np.eye(len(x))
        ks = np.exp(-0.5 * (x[:, None] - xs) ** 2)
        mean, var = ks.T @ np.linalg.solve(k, y), 1.01 - (ks * np.linalg.solve(k, ks)).sum(0)
        mine = got[got.g == g].sort_values("x")
        assert np.allclose(mine.gp_mean, mean, atol=1e-6) and np.allclose(mine.gp_var, var, atol=1e-6)
    assert np.allclose(got[got.g == "w"].sort_values("x").gp_mean, np.sin(np.array([-39.0, 0.05, 20.3]) / 3), atol=0.01)


def test_a_feature_of_more_levels_tells_no_less(spark):
    rng = np.random.default_rng(0)
    base = rng.random(6_000)
    noise = rng.normal(size=6_000) * 0.05
    found = []
    for levels in (10, 20, 21, 40):
        frame = pd.DataFrame({"x": np.floor(base * levels), "y": base + noise})
        found.append(profile.mutual_information(spark.createDataFrame(frame), ["x"], "y").first()["mi"])
    assert all(b >= a - 0.02 for a, b in zip(found, found[1:]))


def test_a_missing_value_costs_only_its_own_feature(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"a": rng.normal(size=500), "b": rng.normal(size=500), "y": rng.normal(size=500)})
    whole = {r.feature: r.mi for r in profile.mutual_information(spark.createDataFrame(frame), ["a", "b"], "y").collect()}
    holes = spark.createDataFrame(frame).withColumn("b", F.when(F.col("b") > 0, F.col("b")))
    part = {r.feature: r.mi for r in profile.mutual_information(holes, ["a", "b"], "y").collect()}
    assert part["a"] == pytest.approx(whole["a"]) and part["b"] != pytest.approx(whole["b"])


def test_block_sums_do_not_depend_on_partitions_and_leave_out_unknown_rows(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(5_000, 3))
    frame = pd.DataFrame(rows, columns=list("abc"))
    holed = spark.createDataFrame(frame).unionByName(spark.createDataFrame([(1.0, None, 2.0), (float("nan"), 1.0, 1.0)], "a double, b double, c double"))
    square = lambda block, _: (block.T @ block).ravel()
    for n in (1, 8, 200):
        got = blocks.sum_blocks(holed.repartition(n), list("abc"), 9, square)
        assert np.allclose(got, (rows.T @ rows).ravel(), rtol=1e-10)


def test_outlier_counts_leave_no_row_out(spark):
    frame = spark.createDataFrame([(float(v), None if v % 2 else 1.0) for v in range(20)] + [(1e6, 9.0)], "a double, b double")
    got = {r.feature: r for r in profile.outlier_summary(frame, ["a", "b"]).collect()}
    assert got["a"].n_outliers == 1 and got["a"].percent == round(100 / 21, 2) and got["b"].n_outliers == 1


def test_ascent_ends_at_an_optimum_or_says_so():
    matrix = np.diag([1.0, 50.0, 2_000.0])
    bowl = lambda t: (1.0 - t @ matrix @ t, -2 * matrix @ t)
    theta, trace, gradient = ascent.ascent(np.array([3.0, -2.0, 1.0]), bowl, 1e-10)
    assert np.abs(theta).max() < 1e-3 and np.abs(gradient).max() < 0.05
    assert all(b >= a for a, b in zip(trace, trace[1:]))
    with pytest.raises(ascent.NotConverged):
        ascent.ascent(np.array([3.0, -2.0, 1.0]), bowl, 1e-10, most=2)


def test_newton_leaves_saddles_and_ends_at_an_optimum_or_says_so():
    def saddle(t):
        x, y = t
        value = -((x * x - 1) ** 2) - (y - x) ** 2
        gradient = np.array([-4 * x * (x * x - 1) + 2 * (y - x), -2 * (y - x)])
        return value, gradient, np.array([[-12 * x * x + 4 - 2, 2.0], [2.0, -2.0]])

    theta, trace, gradient = ascent.newton(np.array([1e-3, 0.3]), saddle)
    assert np.allclose(np.abs(theta), 1.0, atol=1e-5) and theta[0] * theta[1] > 0 and np.abs(gradient).max() < 1e-4
    assert all(b >= a for a, b in zip(trace, trace[1:]))
    with pytest.raises(ascent.NotConverged):
        ascent.newton(np.array([1e-3, 0.3]), saddle, most=2)
    square = ascent.slopes(lambda t: np.array([t[0] * t[1], t[1] ** 2]), np.array([2.0, 3.0]))
    assert np.allclose(square, [[3.0, 0.0], [2.0, 6.0]])


def test_the_factor_fit_ends_where_the_gradient_is_small(spark):
    rng = np.random.default_rng(8)
    names = ["q0", "q1", "p0", "s0", "e0", "l0"]
    groups = {"quality": ("q0", "q1"), "performance": ("p0",), "status": ("p0", "s0"), "seniority": ("e0",), "levy": ("l0",)}
    x = rng.normal(size=(200, 6))
    y = np.logaddexp(0, 3 + 2 * x[:, 4]) + 1 + 0.3 * rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=[*names, "y"])).cache()
    model = hier.hierarchical_fit(df, "y", groups)
    lay = hier.layout(groups)
    theta = np.concatenate([model.loc, np.log(model.scale)])
    mom = hier.column_moments(df, lay)
    value, gradient, second = hier.bound_expansion(df, "y", theta, hier.draws(), mom, lay)
    assert np.allclose(gradient, model.gradient, atol=1e-6) and value == model.trace[-1]
    assert np.linalg.eigvalsh(-second).min() > 0
    # No step along any axis goes up.
    for i in range(0, 2 * lay.size, 3):
        for side in (-0.01, 0.01):
            moved = theta.copy()
            moved[i] += side
            assert hier.bound_expansion(df, "y", moved, hier.draws(), mom, lay)[0] < value
    steepest = {n: abs(v) for n, v in zip(lay.names(), model.loc) if n[1]}
    assert max(steepest, key=steepest.get) == ("w_seniority", "e0")


@pytest.mark.parametrize("d", [1, 2, 3])
def test_near_pairs_equal_all_pairs_that_matter(spark, d):
    rng = np.random.default_rng(d)
    kernel = kernels.squared_exponential(2.0)
    reach = pairwise.reach_of(2.0)
    a, b = rng.normal(size=(300, d)) * 6, rng.normal(size=(200, d)) * 6
    a[:100] = a[0]  # a crowded place
    a[5, 0], names, others = np.nan, [f"x{i}" for i in range(d)], [f"z{i}" for i in range(d)]
    left = spark.createDataFrame(pd.DataFrame(a, columns=names).assign(i=range(300))).union(spark.createDataFrame([(None,) * d + (999,)], ", ".join(f"x{i} double" for i in range(d)) + ", i long"))
    right = spark.createDataFrame(pd.DataFrame(b, columns=others).assign(j=range(200)))
    got = pairwise.near_pairs(left, names, right, others, kernel, reach).select("i", "j", "k").toPandas()
    square = ((a[:, None] - b[None]) ** 2).sum(2)
    i, j = np.nonzero(square <= reach**2)
    want = {(x, y): np.exp(-2.0 * square[x, y]) for x, y in zip(i.tolist(), j.tolist())}
    assert len(got) == len(want) > 0 and all(np.isclose(k, want[x, y], atol=1e-15) for x, y, k in got.itertuples(index=False))
    assert np.exp(-2.0 * square[square > reach**2]).max() < 2e-16


def test_near_pairs_of_two_large_sides_have_no_limit(spark):
    left = spark.range(10_001).selectExpr("id as i", "cast(id as double) as x")
    right = spark.range(10_001).selectExpr("id as j", "id + 0.25 as z")
    found = pairwise.near_pairs(left, ["x"], right, ["z"], kernels.squared_exponential(1.0), 1.0)
    assert found.count() == 20_001 and "LocalTableScan" not in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        pairwise.near_pairs(left, ["x"], left, ["x"], kernels.squared_exponential(1.0), 1.0)


def test_fits_that_use_second_derivatives_end_at_rest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    y = np.sin(2 * x[:, 0]) + 0.3 * rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=["a", "b", "y"])).cache()
    z = x[:10]
    h = gp.Hyper(np.array([1.0, 1.5]), 1.0, 0.5, z, 0.1)
    model = gp.amplitude_fit(df, ["a", "b"], "y", h)
    best = model.hyper

    def bound(v, noise):
        now = gp.Hyper(h.scale, v, noise, z, 0.1)
        k = now.kernel(x)
        return gp.collapsed_bound(gp.RowSums(k.T @ k, k.T @ y, float(y @ y), 400.0), now)[0]

    assert np.abs(model.gradient).max() < 1e-3 and np.isclose(bound(best.variance, best.noise), model.trace[-1])
    for side in (0.98, 1.02):
        assert bound(best.variance * side, best.noise) < model.trace[-1] and bound(best.variance, best.noise * side) < model.trace[-1]
    centres = gp.lloyd(df, ["a", "b"], z[:4])
    nearest = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
    assert np.allclose(centres, [x[nearest == i].mean(0) for i in range(4)])
    # The metric of a deep kernel is a Gauss-Newton matrix: an uphill direction for any gradient.
    deep = gp.Hyper(np.ones(2), 1.0, 0.5, z, 0.1, gp.init_net(2, 5, 2, 3))
    _, gradient = gp.bound_and_gradient(df, ["a", "b"], "y", deep, True)
    turn = gp.deep_metric(df, ["a", "b"], "y", deep, 0.1)
    assert gradient @ turn(gradient) > 0
    slope, _, _ = gp._fit_slopes(x[:20], deep, np.arange(10.0))
    theta, at = deep.pack(True), [*range(3), *range(4 + z.size, len(deep.pack(True)))]
    for column, i in list(enumerate(at))[::4]:
        step = np.zeros(len(theta))
        step[i] = 1e-6
        up, down = (deep.unpack(theta + s * step, True).kernel(x[:20]) @ np.arange(10.0) for s in (1, -1))
        assert np.allclose(slope[:, column], (up - down) / 2e-6, atol=1e-5)
    fitted = gp.deep_kernel_gp_fit(df, ["a", "b"], "y", z, hidden=5, seed=3)
    assert fitted.trace[-1] > fitted.trace[0] + 50 and np.abs(fitted.gradient).max() < 0.05 * np.abs(gradient).max()


def test_samples_of_repeated_keys_do_not_depend_on_row_order(spark):
    rows = [(i % 50, 1, float(i)) for i in range(400)]
    one, two = (
        {tuple(r) for r in sample.random_rows(spark.createDataFrame(order, "a int, b int, v double").repartition(n), 33, ["a", "b"]).collect()}
        for n, order in ((1, rows), (7, rows[::-1]))
    )
    assert one == two and len(one) == 33


def test_the_factor_fit_takes_a_handful_of_passes_and_ends_where_newton_steps_end(spark, monkeypatch):
    rng = np.random.default_rng(9)
    names = ["q0", "q1", "p0", "s0", "e0", "l0"]
    groups = {"quality": ("q0", "q1"), "performance": ("p0",), "status": ("p0", "s0"), "seniority": ("e0",), "levy": ("l0",)}
    x = rng.normal(size=(4_000, 6))
    y = np.logaddexp(0, 20 + 0.5 * x[:, 4] + 0.3 * x[:, 2]) + 1 + 5 * rng.normal(size=4_000)
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=[*names, "y"])).cache()
    passes, real = [], hier.likelihood_sums
    monkeypatch.setattr(hier, "likelihood_sums", lambda *a: passes.append(1) or real(*a))
    model = hier.hierarchical_fit(df, "y", groups)
    assert len(passes) <= 8
    lay = hier.layout(groups)
    mom = hier.column_moments(df, lay)
    begin = hier.start(mom, lay, float(y.mean()) - 1.0)
    theta, trace, _ = ascent.newton(begin, lambda t: hier.bound_expansion(df, "y", t, hier.draws(), mom, lay))
    assert np.allclose(np.concatenate([model.loc, np.log(model.scale)]), theta, atol=1e-5) and np.isclose(model.trace[-1], trace[-1], rtol=1e-11)


def test_inducing_points_are_centres_of_all_rows_by_block_sums(spark, monkeypatch):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(40, 3)) * 20
    x = (middles[:, None] + 0.1 * rng.normal(size=(40, 100, 3))).reshape(-1, 3)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))).repartition(4).cache()
    passes, real = [], gp.sum_blocks
    monkeypatch.setattr(gp, "sum_blocks", lambda *a: passes.append(1) or real(*a))
    z = gp.inducing_points(df, list("abc"), 60, 7)
    assert z.shape == (60, 3) and 0 < len(passes) <= gp.SEED_ROUNDS + 1 + gp.CENTRE_STEPS
    square = ((x[:, None] - z) ** 2).sum(2)
    assert square.min(1).mean() < 0.05
    few = spark.createDataFrame(pd.DataFrame(np.repeat(np.eye(3), 50, axis=0), columns=list("abc")))
    assert np.allclose(gp.inducing_points(few, list("abc"), 10, 7), np.eye(3)[np.lexsort(np.eye(3).T[::-1])])
    assert np.array_equal(z, gp.inducing_points(df, list("abc"), 60, 7))


def test_kernel_blocks_hold_no_whole_kernel_matrix():
    import tracemalloc

    rng = np.random.default_rng(6)
    block, z = rng.normal(size=(20_000, 4)), rng.normal(size=(100, 3))
    h = gp.Hyper(np.ones(3), 1.3, 0.5, z)
    in_a, in_b = np.eye(100), rng.normal(size=100)
    k = 1.3 * np.exp(-0.5 * ((block[:, None, :-1] - z) ** 2).sum(2))
    tracemalloc.start()
    sums, slope = gp._sum_block(block, h), gp._gradient_block(block, (h, in_a, in_b))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < k.nbytes / 2
    assert np.allclose(sums[:10_000].reshape(100, 100), k.T @ k) and np.allclose(sums[10_000:-2], k.T @ block[:, -1])
    e = (2 * k + np.outer(block[:, -1], in_b)) * k
    assert np.isclose(slope[3], e.sum() / 1.3)
    assert np.allclose(slope[4:].reshape(100, 3), e.T @ block[:, :-1] - e.sum(0)[:, None] * z)


def test_runs_and_models_of_the_named_holdouts_share_their_scans(spark, tiny, monkeypatch):
    sums, stages, real_sums, real_stage = [], [], gp.sum_blocks, gp.stage
    monkeypatch.setattr(gp, "sum_blocks", lambda *a: sums.append(1) or real_sums(*a))
    monkeypatch.setattr(gp, "stage", lambda *a: stages.append(a[0].columns) or real_stage(*a))
    found = plans._holdouts(spark, tiny)
    assert len(sums) == 1 and found.count() == 20
    # The hashes of the key are made once, while the rows are written.
    assert stages == [[*plans.PAIR, "log_price", "truth", "tests"]]
