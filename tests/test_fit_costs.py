"""What a pass over the rows of a fit costs, and that cheaper passes give the same."""

import numpy as np
import pandas as pd
from lotwise import session
from lotwise.functions import parse
from lotwise.operators import gp
from lotwise.plans import gaussian_process as plans, price_models as flow
from pyspark.sql import functions as F


def test_numbers_of_model_rows_are_not_written_out_as_text(spark, tiny):
    df = spark.sql(
        """select * from values (double('nan'), 1, 2L, 'true'), (-0.5d, null, null, 'x'), (1e300d, -7, 9007199254740993L, '3.5'),
        (double('infinity'), 0, 0L, 'NaN') t(d, i, l, s)"""
    )
    text = df.select(*[parse.flag_number(F.col(c)).alias(c) for c in df.columns])
    assert flow.feature_numbers(df, df.columns).collect() == text.collect()
    ready = flow.gp_rows(plans.encoded(spark, tiny), "order_key", edges=plans.EDGES)
    plan = ready.train.select(*ready.features, ready.target)._jdf.queryExecution().optimizedPlan().toString()
    assert "try_cast" not in plan and "as string) IN" not in plan


def test_rows_of_costly_passes_are_dealt_evenly(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    few, odd, many = (spark.range(1000).repartition(n) for n in (cores, cores + 1, 4 * cores))
    assert session.spread(few) is few and session.spread(many) is many
    even = session.spread(odd)
    assert even.rdd.getNumPartitions() == 4 * cores and even.count() == 1000
    even.unpersist()


def test_a_fit_makes_the_sums_of_a_place_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, np.sin(2 * x[:, 0])]), columns=["a", "b", "y"])).cache()
    places, real = [], gp.row_sums
    monkeypatch.setattr(gp, "row_sums", lambda df, f, t, h: places.append(h.pack(True).tobytes()) or real(df, f, t, h))
    model = gp.deep_kernel_gp_fit(df, ["a", "b"], "y", x[:8], tolerance=1e-3, hidden=4)
    assert len(places) == len(set(places)) >= len(model.trace)
    again = gp.condition(df, ["a", "b"], "y", model.hyper)
    assert np.allclose(model.mean_weights, again.mean_weights, rtol=1e-6, atol=1e-9)


def test_the_metric_in_single_precision_is_that_of_double_precision():
    rng = np.random.default_rng(9)
    block, z = rng.normal(size=(1500, 4)), rng.normal(size=(12, 3))
    h = gp.Hyper(np.array([0.7, 1.0, 1.4]), 1.3, 0.5, z, 0.1, gp.init_net(3, 5, 3, 2))
    weights = rng.normal(size=12) * 1e30  # squares beyond single precision
    flat = gp._curvature_block(block, (h, weights))
    slope, e, _ = gp._fit_slopes(block[:, :-1], h, weights)
    wide = slope.shape[1]
    assert np.allclose(flat[: wide**2].reshape(wide, wide), slope.T @ slope, rtol=1e-4, atol=1e-5 * (slope**2).sum(0).max())
    w1, b1, w2, _ = h.net
    px, pz = gp.net_forward(block[:, :-1], h.net), gp.net_forward(z, h.net)
    for i, point in enumerate(flat[wide**2 :].reshape(12, 3, 3)):
        in_z = ((e[:, [i]] * (px - pz[i]) / h.scale**2) @ w2.T * (z[i] @ w1 + b1 > 0)) @ w1.T
        assert np.allclose(point, in_z.T @ in_z, rtol=1e-4, atol=1e-5 * (in_z**2).sum())
