"""Named queries: sparse and deep-kernel Gaussian processes, kernels' sums, densities."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import functions as F

from lotwise.functions import numeric
from lotwise.operators import density, encode, evaluate, gp, sample
from lotwise.plans import price_models as flow
from lotwise.plans.frames import EDGES, KEYS, SPLIT, encoded, imputed
from lotwise.plans.registry import query, rounded
from lotwise.session import spread, stage
from lotwise.sources.tables import table

PAIR = ["engine", "age"]
# A small fixed model, so that SQL can follow it: two inducing points, no learning.
FIXED = gp.Hyper(np.array([1.0, 1.5]), 1.0, 0.5, np.array([[-1.0, -1.0], [1.0, 1.0]]), 0.1)


def _scaled(spark, folder):
    rows = imputed(spark, folder).select(*KEYS, "price", *PAIR).withColumn("log_price", F.log("price"))
    train, test = sample.train_test(rows, "order_key")
    scaler = encode.fit_scaler(train, [*PAIR, "log_price"])
    return scaler.transform(train), scaler.transform(test), scaler


HEAD = (
    SPLIT
    + """, z as (select avg(engine) me, stddev_pop(engine) se, avg(age) ma, stddev_pop(age) sa, avg(ln(price)) mp,
      stddev_pop(ln(price)) sp from split where split = 'train'),
  sc as (select order_key, line_no, split, price, (engine - me) / se as x1, (age - ma) / sa as x2, (ln(price) - mp) / sp as y
    from split, z)"""
)
SUMS = """, st as (select sum(k1*k1) as a11, sum(k1*k2) as a12, sum(k2*k2) as a22, sum(k1*y) as b1, sum(k2*y) as b2, sum(y*y) as yy,
    cast(count(*) as double) as n from k where split = 'train')"""
SCALED = (
    HEAD
    + """, k as (select *, exp(-0.5 * (pow(x1 + 1, 2) + pow((x2 + 1) / 1.5, 2))) as k1,
    exp(-0.5 * (pow(x1 - 1, 2) + pow((x2 - 1) / 1.5, 2))) as k2 from sc)"""
    + SUMS
)


def _solved(u12: str) -> str:
    """The posterior and prices from the sums, for two inducing points of covariance ``u12``."""
    return f""", q as (select *, 1.1::double as u11, {u12} as u12 from st),
  bb as (select *, u11 + a11 / 0.5 as p11, u12 + a12 / 0.5 as p12, u11 + a22 / 0.5 as p22 from q),
  iv as (select *, p22 / (p11*p22 - p12*p12) as i11, -p12 / (p11*p22 - p12*p12) as i12, p11 / (p11*p22 - p12*p12) as i22,
    u11 / (u11*u11 - u12*u12) as j11, -u12 / (u11*u11 - u12*u12) as j12 from bb),
  gpred as (select k.order_key, k.line_no, k.split, k.price, (k1 * (i11*b1 + i12*b2) + k2 * (i12*b1 + i22*b2)) / 0.5 as mean,
    1 - (k1*k1 * (j11-i11) + 2*k1*k2 * (j12-i12) + k2*k2 * (j11-i22)) as var from k cross join iv where split = 'test'),
  gprice as (select gpred.*, exp(mean * sp + mp) as pred, exp(mean * sp + mp - 2 * sqrt(var) * sp) as lower,
    exp(mean * sp + mp + 2 * sqrt(var) * sp) as upper from gpred cross join z)"""


POSTERIOR = SCALED + _solved("exp(-0.5 * (4 + 4 / 2.25::double))")


@query(
    f"""with {SCALED} select 'a11' as name, round(a11, 4) as value from st union all select 'a12', round(a12, 4) from st
    union all select 'a22', round(a22, 4) from st union all select 'b1', round(b1, 4) from st
    union all select 'b2', round(b2, 4) from st union all select 'yy', round(yy, 4) from st
    union all select 'n', n from st"""
)
def inducing_sums(spark, folder):
    """The statistic every sparse fit rests on: Σkk', Σky, Σy², n."""
    train, _, _ = _scaled(spark, folder)
    s = gp.row_sums(train, PAIR, "log_price", FIXED)
    cells = {"a11": s.a[0, 0], "a12": s.a[0, 1], "a22": s.a[1, 1], "b1": s.b[0], "b2": s.b[1], "yy": s.yy, "n": s.n}
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in cells.items()], "name string, value double"), 4)


@query(
    f"""with {POSTERIOR} select round(-0.5 * n * ln(2 * pi()) - 0.5 * (ln(p11*p22 - p12*p12) - ln(u11*u11 - u12*u12)
      + n * ln(0.5)) - 0.5 * (yy / 0.5 - (b1*b1*i11 + 2*b1*b2*i12 + b2*b2*i22) / 0.25)
      - 0.5 * (n - (j11*a11 + 2*j12*a12 + j11*a22)) / 0.5, 3) as bound from iv"""
)
def collapsed_bound(spark, folder):
    train, _, _ = _scaled(spark, folder)
    value, _ = gp.collapsed_bound(gp.row_sums(train, PAIR, "log_price", FIXED), FIXED)
    return rounded(spark.createDataFrame([(value,)], "bound double"), 3)


@query(f"with {POSTERIOR} select order_key, line_no, round(mean, 6) as gp_mean, round(var, 6) as gp_var from gpred")
def gp_posterior(spark, folder):
    """Predictive mean and latent variance of the test rows under fixed hyper-parameters."""
    train, test, _ = _scaled(spark, folder)
    model = gp.condition(train, PAIR, "log_price", FIXED)
    return rounded(model.predict(test).select(*KEYS, "gp_mean", "gp_var"))


@query(
    f"""with {POSTERIOR} select order_key, line_no, price as truth, round(pred, 3) as pred, round(lower, 3) as lower,
    round(upper, 3) as upper, round(price - pred, 3) as residual from gprice"""
)
def gp_price_bands(spark, folder):
    """Price, ±2-deviation band and residual per test row."""
    train, test, scaler = _scaled(spark, folder)
    priced = gp.price_band(gp.condition(train, PAIR, "log_price", FIXED).predict(test), scaler, "log_price")
    return rounded(
        priced.select(
            *KEYS, F.col("price").alias("truth"), "pred", "lower", "upper", (F.col("price") - F.col("pred")).alias("residual")
        ),
        3,
    )


@query(
    f"""with {POSTERIOR} select round(avg(abs(price - pred)), 3) as mae, round(sqrt(avg(pow(price - pred, 2))), 3) as rmse,
    round(1 - sum(pow(price - pred, 2)) / (count(*) * var_pop(price)), 6) as r2 from gprice"""
)
def gp_metrics(spark, folder):
    train, test, scaler = _scaled(spark, folder)
    priced = gp.price_band(gp.condition(train, PAIR, "log_price", FIXED).predict(test), scaler, "log_price")
    found = evaluate.evaluate(priced, "price", "pred")
    return rounded(found.withColumns({"mae": F.round("mae", 3), "rmse": F.round("rmse", 3)}))


@query(
    f"""with {POSTERIOR}, tm as (select avg(x2) as x2 from sc where split = 'train'),
    g as (select i, -4 + i * 8.0::double / 499 as x from range(500) t(i)),
    gk as (select i, x, exp(-0.5 * (pow(x + 1, 2) + pow((x2 + 1) / 1.5, 2))) as k1,
      exp(-0.5 * (pow(x - 1, 2) + pow((x2 - 1) / 1.5, 2))) as k2 from g cross join tm),
    gm as (select i, x, (k1 * (i11*b1 + i12*b2) + k2 * (i12*b1 + i22*b2)) / 0.5 as mean,
      1 - (k1*k1 * (j11-i11) + 2*k1*k2 * (j12-i12) + k2*k2 * (j11-i22)) as var from gk cross join iv)
    select i, round(x, 6) as x, round(exp(mean * sp + mp), 3) as pred, round(exp(mean * sp + mp - 2 * sqrt(var) * sp), 3) as lower,
      round(exp(mean * sp + mp + 2 * sqrt(var) * sp), 3) as upper from gm cross join z"""
)
def gp_posterior_sweep(spark, folder):
    """One feature swept over [-4, 4], the other at its train mean."""
    train, _, scaler = _scaled(spark, folder)
    swept = gp.posterior_sweep(gp.condition(train, PAIR, "log_price", FIXED), train, "engine", 500, -4.0, 4.0, scaler, "log_price")
    return swept.select(
        "i", F.round("x", 6).alias("x"), *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("pred", "lower", "upper")]
    )


@query(
    f"""with {SPLIT}, t as (select * from split where split = 'train')
    select 'engine' as feature, round(stddev_pop(engine), 6) as lengthscale, round(1 / stddev_pop(engine), 6) as relevance from t
    union all select 'age', round(stddev_pop(age), 6), round(1 / stddev_pop(age), 6) from t"""
)
def relevance_of_scales(spark, folder):
    """Relevance under lengthscales of one deviation of each feature."""
    train, _, scaler = _scaled(spark, folder)
    wide = gp.Hyper(np.array([scaler.scale[c] for c in PAIR]), 1.0, 0.5, FIXED.z, 0.1)
    return rounded(gp.condition(train, PAIR, "log_price", wide).relevance(spark))


@query(
    f"""with {SCALED} select order_key, line_no, cast(2 as int) as width, round(x1, 6) + 0.0 as first, round(x2, 6) + 0.0 as last
    from sc where split = 'test'"""
)
def assembled_rows(spark, folder):
    """Features of a row as one array, as the kernels and k-means take them."""
    _, test, _ = _scaled(spark, folder)
    rows = test.select(*KEYS, numeric.assemble(PAIR).alias("v"))
    return rounded(rows.select(*KEYS, F.size("v").alias("width"), F.col("v")[0].alias("first"), F.col("v")[1].alias("last")))


# A fixed two-layer net of three hidden units, so that SQL can follow it.
NET = (
    np.array([[0.5, -1.0, 0.25], [1.0, 0.5, -0.75]]),
    np.array([0.1, 0.2, -0.1]),
    np.array([[1.0, -0.5], [0.5, 0.75], [-1.0, 0.25]]),
    np.array([0.05, -0.05]),
)
LATENT = (
    HEAD
    + """, hid as (select *, greatest(0.5*x1 + x2 + 0.1, 0) as h1, greatest(-x1 + 0.5*x2 + 0.2, 0) as h2,
      greatest(0.25*x1 - 0.75*x2 - 0.1, 0) as h3 from sc),
  lat as (select *, h1 + 0.5*h2 - h3 + 0.05 as f1, -0.5*h1 + 0.75*h2 + 0.25*h3 - 0.05 as f2 from hid),
  zl as (select 0.5*greatest(1 - 0.5 + 0.2, 0) - greatest(-0.25 + 0.75 - 0.1, 0) + 0.05 as z11,
        0.75*greatest(1 - 0.5 + 0.2, 0) + 0.25*greatest(-0.25 + 0.75 - 0.1, 0) - 0.05 as z12,
        greatest(0.5 + 1 + 0.1, 0) + 0.5*greatest(-1 + 0.5 + 0.2, 0) - greatest(0.25 - 0.75 - 0.1, 0) + 0.05 as z21,
        -0.5*greatest(0.5 + 1 + 0.1, 0) + 0.75*greatest(-1 + 0.5 + 0.2, 0) - 0.05 as z22),
  k as (select lat.*, exp(-0.5 * (pow(f1 - z11, 2) + pow((f2 - z12) / 1.5, 2))) as k1,
      exp(-0.5 * (pow(f1 - z21, 2) + pow((f2 - z22) / 1.5, 2))) as k2 from lat cross join zl)"""
    + SUMS
)
DEEP_POSTERIOR = LATENT + _solved("(select exp(-0.5 * (pow(z11 - z21, 2) + pow((z12 - z22) / 1.5, 2))) from zl)")


@query(f"with {LATENT} select order_key, line_no, round(f1, 6) as latent_0, round(f2, 6) as latent_1 from lat where split = 'train'")
def net_features(spark, folder):
    train, _, _ = _scaled(spark, folder)
    latent = gp.mlp_transform(train, PAIR, NET)
    return rounded(latent.select(*KEYS, F.col("latent")[0].alias("latent_0"), F.col("latent")[1].alias("latent_1")))


@query(
    f"""with {LATENT} select 'a11' as name, round(a11, 4) as value from st union all select 'a12', round(a12, 4) from st
    union all select 'a22', round(a22, 4) from st union all select 'b1', round(b1, 4) from st
    union all select 'b2', round(b2, 4) from st"""
)
def deep_kernel_sums(spark, folder):
    """The sparse statistic under a kernel over learned features; inducing points pass the net too."""
    train, _, _ = _scaled(spark, folder)
    deep = gp.Hyper(FIXED.scale, 1.0, 0.5, FIXED.z, 0.1, NET)
    s = gp.row_sums(train, PAIR, "log_price", deep)
    cells = {"a11": s.a[0, 0], "a12": s.a[0, 1], "a22": s.a[1, 1], "b1": s.b[0], "b2": s.b[1]}
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in cells.items()], "name string, value double"), 4)


@query(
    f"""with {SCALED} select order_key, line_no, round(x1, 6) + 0.0 as x, price as y from sc where split = 'train'
    order by md5(concat_ws('|', cast(order_key as varchar), cast(line_no as varchar), '42')), order_key, line_no, price, x1 limit 300"""
)
def gp_sweep_points(spark, folder):
    """Train points drawn beside the sweep: a repeatable sample on the swept feature's scale."""
    train, _, _ = _scaled(spark, folder)
    points = sample.random_rows(train.select(*KEYS, "price", "engine"), 300, list(KEYS))
    return rounded(points.select(*KEYS, F.col("engine").alias("x"), F.col("price").alias("y")))


_BOUND = """select round(-0.5 * n * ln(2 * pi()) - 0.5 * (ln(p11*p22 - p12*p12) - ln(u11*u11 - u12*u12)
      + n * ln(0.5)) - 0.5 * (yy / 0.5 - (b1*b1*i11 + 2*b1*b2*i12 + b2*b2*i22) / 0.25)
      - 0.5 * (n - (j11*a11 + 2*j12*a12 + j11*a22)) / 0.5, 3) as bound from iv"""


@query(f"with {DEEP_POSTERIOR} {_BOUND}")
def deep_kernel_bound(spark, folder):
    """The bound that a deep-kernel fit from the fixed net would begin at."""
    train, _, _ = _scaled(spark, folder)
    deep = gp.Hyper(FIXED.scale, 1.0, 0.5, FIXED.z, 0.1, NET)
    value, _ = gp.bound_then_gradient(train, PAIR, "log_price", deep, True)
    return rounded(spark.createDataFrame([(value,)], "bound double"), 3)


# --- fits that SQL can follow ----------------------------------------------------------------

# The bound as a function of log variance a and log noise b, from the sums st of a unit kernel.
_TRIED = """select a, b{more}, -0.5 * n * ln(2 * pi()) - 0.5 * (ln(p11*p22 - p12*p12) - ln(u11*u11 - u12*u12) + n * b)
        - 0.5 * (yy / s - (f1*f1*p22 - 2*f1*f2*p12 + f2*f2*p11) / (p11*p22 - p12*p12) / (s * s))
        - 0.5 * (n * v - (u11*g11 - 2*u12*g12 + u11*g22) / (u11*u11 - u12*u12)) / s as value
      from (select *, u11 + g11 / s as p11, u12 + g12 / s as p12, u11 + g22 / s as p22
        from (select *, v + 0.1 as u11, v * exp(-0.5 * (4 + 4 / 2.25::double)) as u12, v*v*a11 as g11, v*v*a12 as g12,
            v*v*a22 as g22, v*b1 as f1, v*b2 as f2
          from (select *, exp(a) as v, exp(b) as s from {source})))"""
_BEGIN = "(select st.*, 0::double as a, ln(0.5::double) as b from st)"
_AROUND = """(select st.*, r.a + x * r.step as a, r.b + y * r.step as b, r.step, r.turn, r.value as was
          from search r, st, (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1)) o(x, y)
          where r.step > 1e-7)"""


@query(
    f"""with recursive {SCALED}, search as (
      select a, b, 0.5::double as step, value, 0 as turn from ({_TRIED.format(more="", source=_BEGIN)})
      union all
      select arg_max(a, value), arg_max(b, value), case when max(value) > any_value(was) then any_value(step) else any_value(step) / 2 end,
        max(value), any_value(turn) + 1
      from ({_TRIED.format(more=", step, turn, was", source=_AROUND)}) having count(*) > 0)
    select round(exp(a), 4) as variance, round(exp(b), 4) as noise, round(value, 3) as bound from search order by turn desc limit 1"""
)
def sparse_gp_amplitudes(spark, folder):
    """Kernel variance and noise of a sparse process fitted to the train rows, scales and inducing points given."""
    train, _, _ = _scaled(spark, folder)
    model = gp.amplitude_fit(train, PAIR, "log_price", FIXED)
    row = (round(model.hyper.variance, 4), round(model.hyper.noise, 4), round(model.trace[-1], 3))
    return spark.createDataFrame([row], "variance double, noise double, bound double")


# Three centres that SQL can follow from a fixed start.
CENTRES = np.array([[-1.0, -1.0], [0.0, 1.0], [1.0, -1.0]])


@query(
    f"""with recursive {HEAD}, t as (select x1, x2 from sc where split = 'train'),
    steps as (
      select 0 as turn, [{{'i': 0, 'x': -1::double, 'y': -1::double}}, {{'i': 1, 'x': 0, 'y': 1}}, {{'i': 2, 'x': 1, 'y': -1}}] as centres,
        false as rest
      union all
      select turn + 1, list({{'i': i, 'x': x, 'y': y}} order by i), max(greatest(abs(x - old.x), abs(y - old.y))) < 1e-12
      from (select turn, i, any_value(centres[i + 1]) as old, avg(x1) as x, avg(x2) as y
        from (select turn, centres, x1, x2, list_sort(list_transform(centres,
              lambda c: {{'d': pow(x1 - c.x, 2) + pow(x2 - c.y, 2), 'i': c.i}}))[1].i as i
          from steps, t where not rest) group by turn, i) group by turn having count(*) > 0)
    select c.i as centre, round(c.x, 5) as engine, round(c.y, 5) as age from (select unnest(centres) as c from steps where rest)"""
)
def settled_centres(spark, folder):
    """Inducing points at rest: another step of k-means leaves them where they are."""
    train, _, _ = _scaled(spark, folder)
    centres = gp.lloyd(stage(train.select(*PAIR)), PAIR, CENTRES)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(centres)]
    return rounded(spark.createDataFrame(rows, "centre int, engine double, age double"), 5)


# --- repeated hold-outs ----------------------------------------------------------------------

RUNS = 10
MODELS = {"gp": (FIXED, POSTERIOR), "deep_kernel": (gp.Hyper(FIXED.scale, 1.0, 0.5, FIXED.z, 0.1, NET), DEEP_POSTERIOR)}
HOLDOUTS = "runs as (" + " union all ".join(
    f"""select '{name}' as model, cast({run} as int) as run, mae, rmse, r2 from (with {text.replace("'42'", f"'{run}'")}
      select avg(abs(price - pred)) as mae, sqrt(avg(pow(price - pred, 2))) as rmse,
        1 - sum(pow(price - pred, 2)) / (count(*) * var_pop(price)) as r2 from gprice)"""
    for name, (_, text) in MODELS.items() for run in range(1, RUNS + 1)
) + ")"


def _holdouts(spark, folder):
    """``(model, run, mae, rmse, r2)`` at fixed hyper-parameters; all runs of both models share the scans."""
    rows = imputed(spark, folder).select("order_key", "price", *PAIR, F.log("price").alias("log_price"))
    models = {name: h for name, (h, _) in MODELS.items()}
    return stage(gp.repeated_holdouts(rows, PAIR, "log_price", "price", "order_key", models, RUNS), "metrics")


@query(f"with {HOLDOUTS} select model, run, round(mae, 3) as mae, round(rmse, 3) as rmse, round(r2, 6) as r2 from runs")
def repeated_gp_holdouts(spark, folder):
    """Ten independent hold-outs of the sparse and of the deep-kernel process."""
    found = _holdouts(spark, folder)
    return rounded(found.withColumns({"mae": F.round("mae", 3), "rmse": F.round("rmse", 3)}))


@query(
    f"with {HOLDOUTS} "
    + " union all ".join(
        f"""select model, '{m}' as metric, count({m}) as runs, round(avg({m}), 3) as mean, round(stddev_samp({m}), 3) as sd,
        round(min({m}), 3) as low, round(max({m}), 3) as high from runs group by model"""
        for m in ("mae", "rmse", "r2")
    )
)
def repeated_gp_summary(spark, folder):
    """Mean, deviation, low and high of each model's metrics over its runs."""
    long = _holdouts(spark, folder).unpivot(["model", "run"], ["mae", "rmse", "r2"], "metric", "value")
    return rounded(evaluate.summarise_metrics(long, ["model"]), 3)


# Every run fitted: the search of sparse_gp_amplitudes on its own train rows, then prices of its test rows.
FITTED_RUN = f"""(with recursive {SCALED}, search as (
      select a, b, 0.5::double as step, value, 0 as turn from ({_TRIED.format(more="", source=_BEGIN)})
      union all
      select arg_max(a, value), arg_max(b, value), case when max(value) > any_value(was) then any_value(step) else any_value(step) / 2 end,
        max(value), any_value(turn) + 1
      from ({_TRIED.format(more=", step, turn, was", source=_AROUND)}) having count(*) > 0),
    best as (select exp(a) as v, exp(b) as s, value from search order by turn desc limit 1),
    ft as (select v, s, value, v + 0.1 + v*v*a11/s as p11, v * exp(-0.5 * (4 + 4 / 2.25::double)) + v*v*a12/s as p12,
      v + 0.1 + v*v*a22/s as p22, v*b1/s as f1, v*b2/s as f2 from st cross join best),
    fp as (select v, s, value, price,
      exp(v * (k1 * (p22*f1 - p12*f2) + k2 * (p11*f2 - p12*f1)) / (p11*p22 - p12*p12) * sp + mp) as pred
      from k cross join ft cross join z where split = 'test')
    select any_value(v) as variance, any_value(s) as noise, any_value(value) as bound, avg(abs(price - pred)) as mae,
      sqrt(avg(pow(price - pred, 2))) as rmse, 1 - sum(pow(price - pred, 2)) / (count(*) * var_pop(price)) as r2 from fp)"""
FITTED_RUNS = "runs as (" + " union all ".join(
    f"select cast({run} as int) as run, * from {FITTED_RUN}".replace("'42'", f"'{run}'") for run in range(1, RUNS + 1)
) + ")"
_TO_SCALE = {"variance": 4, "noise": 4, "bound": 3, "mae": 2, "rmse": 2, "r2": 6}


def _fitted_holdouts(spark, folder):
    rows = stage(imputed(spark, folder).select("order_key", *PAIR, F.log("price").alias("log_price")), "holdouts")
    return gp.fitted_holdouts(rows, PAIR, "log_price", "order_key", FIXED, RUNS)


@query(f"with {FITTED_RUNS} select run, " + ", ".join(f"round({c}, {n}) as {c}" for c, n in _TO_SCALE.items()) + " from runs")
def repeated_fitted_gp_holdouts(spark, folder):
    """Ten hold-outs of a sparse process whose variance and noise are fitted anew in every run."""
    found = _fitted_holdouts(spark, folder)
    return found.select("run", *[(F.round(c, n) + F.lit(0.0)).alias(c) for c, n in _TO_SCALE.items()])


@query(
    f"with {FITTED_RUNS} "
    + " union all ".join(
        f"""select '{m}' as metric, count({m}) as runs, round(avg({m}), 2) as mean, round(stddev_samp({m}), 2) as sd,
        round(min({m}), 2) as low, round(max({m}), 2) as high from runs"""
        for m in ("mae", "rmse", "r2")
    )
)
def repeated_fitted_gp_summary(spark, folder):
    """Mean, deviation, low and high of the metrics of ten fitted hold-outs."""
    return rounded(evaluate.holdout_summary(_fitted_holdouts(spark, folder)), 2)


# --- fits: iterative, so no SQL text --------------------------------------------------------

# As many inducing points as in the price study.
INDUCING = 300
# The named deep-kernel queries end at this change of the bound; the operator's own default is gp.DEEP_TOLERANCE.
DEEP_TOLERANCE = 1e-4


def _ready(spark, folder):
    ready = flow.gp_rows(encoded(spark, folder), "order_key", edges=EDGES)
    train = spread(stage(ready.train.select(*ready.features, ready.target))).persist()
    return ready, train


@query()
def inducing_points(spark, folder):
    """k-means centres of the scaled train rows, long form."""
    ready, train = _ready(spark, folder)
    z = gp.inducing_points(train, ready.features, INDUCING)
    rows = [(i, f, float(v)) for i, r in enumerate(z) for f, v in zip(ready.features, r, strict=True)]
    return rounded(spark.createDataFrame(rows, "point int, feature string, value double"))


def _fitted(spark, folder, deep: bool):
    ready, train = _ready(spark, folder)
    z = gp.inducing_points(train, ready.features, INDUCING)
    fit = partial(gp.deep_kernel_gp_fit, tolerance=DEEP_TOLERANCE) if deep else gp.sparse_gp_fit
    return ready, train, fit(train, ready.features, ready.target, z)


@query()
def repeated_fitted_gp_study(spark, folder):
    """Ten fitted hold-outs on all 13 features with as many inducing points as in the price study.

    Lengthscales are the root of the number of features. Maker codes come from one split for all runs.
    """
    coded = flow.coded_rows(encoded(spark, folder), "order_key", edges=EDGES)
    names = flow.gp_features(coded)
    numbers = flow.feature_numbers(coded, names)
    rows = spread(stage(numbers.select("order_key", *names, F.log("price").alias("log_price"))))
    scaled = encode.fit_scaler(rows, names).transform(rows.dropna())
    z = gp.inducing_points(scaled, names, INDUCING)
    start = gp.Hyper(np.full(len(names), len(names) ** 0.5), 1.0, 0.5, z)
    return rounded(gp.fitted_holdouts(rows, names, "log_price", "order_key", start, RUNS))


@query()
def sparse_gp_relevance(spark, folder):
    """Inverse lengthscales of a fitted sparse process, highest first."""
    return rounded(_fitted(spark, folder, False)[2].relevance(spark))


@query()
def sparse_gp_test_metrics(spark, folder):
    ready, _, model = _fitted(spark, folder, False)
    priced = gp.price_band(model.predict(ready.test), ready.target_scaler, ready.target)
    return rounded(evaluate.evaluate(priced, "price", "pred"))


@query()
def deep_kernel_gp_trace(spark, folder):
    """Bound per step of the deep-kernel fit."""
    return rounded(_fitted(spark, folder, True)[2].trace_table(spark))


@query()
def deep_kernel_gp_relevance(spark, folder):
    return rounded(_fitted(spark, folder, True)[2].relevance(spark))


# --- densities ------------------------------------------------------------------------------

_DENSITY = """exp(-0.5 * (s22 * pow(x - m1, 2) - 2 * s12 * (x - m1) * (y - m2) + s11 * pow(y - m2, 2)) / (s11*s22 - s12*s12))
  / (2 * pi() * sqrt(s11*s22 - s12*s12))"""
_FITTED = """g as (select avg(l_quantity) m1, avg(l_tax * 100) m2, var_pop(l_quantity) s11, var_pop(l_tax * 100) s22,
  covar_pop(l_quantity, l_tax * 100) s12 from lineitem)"""


@query(
    f"""with {_FITTED}, p as (select l_orderkey as order_key, l_linenumber as line_no, l_quantity as x, l_tax * 100 as y
    from lineitem) select order_key, line_no, round({_DENSITY}, 8) as density from p cross join g"""
)
def row_density(spark, folder):
    """Bivariate normal density of every row under the table's own mean and covariance."""
    rows = _density_rows(spark, folder)
    fitted = density.fit_gaussian(rows, "x", "y")
    return rows.select(*KEYS, F.round(density.gaussian_density(F.col("x"), F.col("y"), fitted), 8).alias("density"))


@query(
    f"""with {_FITTED}, p as (select i, j, m1 + (-2.5 + 0.1 * i) * sqrt(s11) as x, m2 + (-2.5 + 0.1 * j) * sqrt(s22) as y
    from range(50) a(i) cross join range(50) b(j) cross join g)
    select i, j, round(x, 6) as x, round(y, 6) as y, round({_DENSITY}, 8) as density from p cross join g"""
)
def density_contour(spark, folder):
    """The density on a 50 × 50 grid around the table's mean, 2.5 deviations each way."""
    fitted = density.fit_gaussian(_density_rows(spark, folder), "x", "y")
    grid = density.density_grid(spark, fitted, 2.5, 0.1)
    return grid.select(
        "i", "j", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("density", 8).alias("density")
    )


def _density_rows(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").alias("x"),
        (F.col("l_tax") * 100).alias("y"),
    )
