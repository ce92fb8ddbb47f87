"""Many small groups are climbed, solved and scored side by side, with the results of one by one."""

import numpy as np
import pandas as pd
import pytest
from lotwise.operators import ascent, grouped_gp as gg


def cells(rng, groups, m):
    x = np.sort(rng.normal(size=(groups, m)), axis=1)
    n = rng.integers(1, 9, size=(groups, m)).astype(float)
    return x, n, np.sin(2 * x) + 0.3 * rng.normal(size=(groups, m)), rng.random((groups, m)) * (n - 1)


@pytest.mark.parametrize("m", [1, 2, 5])
def test_stacked_likelihoods_and_climbs_are_those_of_single_groups(m):
    rng = np.random.default_rng(m)
    stack, at = cells(rng, 40, m), rng.normal(size=(40, 3))
    value, grad = gg.dense_likelihoods(*stack, at)
    single = [gg.dense_likelihood(*[c[i] for c in stack], at[i]) for i in range(40)]
    assert np.allclose(value, [s[0] for s in single], rtol=1e-12) and np.allclose(grad, [s[1] for s in single], rtol=1e-9, atol=1e-10)
    start = np.array([np.log(0.5), 0.0, 0.0])
    side, best, ended = ascent.ascents(np.zeros((40, 3)), lambda t, i: gg.dense_likelihoods(*[c[i] for c in stack], start + t), 1e-10, 500, 0.5)
    for i in range(40):
        mine = [c[i] for c in stack]
        try:
            _, trace, _ = ascent.ascent(np.zeros(3), lambda t: gg.dense_likelihood(*mine, start + t), 1e-10, 500, 0.5)
        except (ascent.NotConverged, np.linalg.LinAlgError):
            continue
        assert ended[i] and best[i] == pytest.approx(trace[-1], rel=1e-6, abs=1e-6)
        assert gg.dense_likelihood(*mine, start + side[i])[0] == pytest.approx(best[i], rel=1e-9, abs=1e-9)


def test_a_group_without_a_factor_or_an_end_leaves_the_others_alone():
    rng = np.random.default_rng(3)
    stack = cells(rng, 6, 2)
    theta = np.zeros((6, 3))
    stack[0][4], theta[4] = 1.0, [0.0, 0.0, -60.0]
    value, _ = gg.dense_likelihoods(*stack, theta)
    assert np.isnan(value[4]) and np.isfinite(np.delete(value, 4)).all()
    # Problem 1 never stands still, problem 2 begins outside.
    goal = lambda t, i: (np.where(i == 1, t[:, 0], np.where(i == 2, np.nan, -((t[:, 0] - i) ** 2))), np.where(i == 1, 1.0, -2 * (t[:, 0] - i))[:, None])
    found, _, ended = ascent.ascents(np.zeros((4, 1)), goal, 1e-9, 50)
    assert ended.tolist() == [True, False, False, True] and found[3, 0] == pytest.approx(3.0, abs=1e-4)


def test_groups_are_not_handed_to_python_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame([(g, x, np.sin(x) + 0.1 * rng.normal()) for g in range(300) for x in range(1 + g % 3) for _ in range(4)], columns=["g", "x", "y"])
    df = spark.createDataFrame(rows.astype({"x": float}))
    stacks = [(len(first), x.shape) for first, _, (x, *_) in gg._stacks(iter([]))]
    assert stacks == []
    plans, real = [], gg.stage
    monkeypatch.setattr(gg, "stage", lambda d, *a: plans.append(d._jdf.queryExecution().toString()) or real(d, *a))
    found = gg.grouped_variational_gp(df, df.select("g", "x"), "g", "x", "y")
    whole = found.toPandas()
    plans.append(found._jdf.queryExecution().toString())
    assert len(whole) == len(rows) and whole.gp_mean.notna().all()
    assert not any("FlatMapGroupsInPandas" in p or "CoGroups" in p for p in plans)


def test_stacks_hold_whole_groups_of_as_many_cells_however_rows_are_batched(monkeypatch):
    monkeypatch.setattr(gg, "STACK_GROUPS", 3)
    rows = pd.DataFrame([(m, f"{m}-{g}", i) for m in (1, 2, 5) for g in range(7) for i in range(m)], columns=["m", "g", "x"])
    rows["theta"], rows["n"], rows["ybar"], rows["ss"] = [np.zeros(3)] * len(rows), 1.0, 0.0, 0.0
    for size in (1, 4, 11, 100):
        seen = []
        for first, at, (x, *_) in gg._stacks(rows.iloc[i : i + size] for i in range(0, len(rows), size)):
            assert x.shape == (len(first), int(first.m.iloc[0])) and len(at) == len(first) <= 3
            assert (x == np.arange(x.shape[1])).all()
            seen += first.g.to_list()
        assert sorted(seen) == sorted(rows.g.unique())


def test_runs_are_whole_however_rows_are_batched():
    rows = pd.DataFrame({"k": [1.0] * 4 + [2.0] * 1 + [np.nan] * 6, "s": 0, "v": range(11)})
    for size in (1, 2, 3, 100):
        runs = [r["v"].tolist() for ended in gg._runs((rows.iloc[i : i + size] for i in range(0, 11, size)), ["k", "s"]) for r in ended]
        assert runs == [[0, 1, 2, 3], [4], [5, 6, 7, 8, 9, 10]]
