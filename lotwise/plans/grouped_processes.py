"""Named queries: one exact Gaussian process per group of events."""

from __future__ import annotations

from math import log

from pyspark.sql import functions as F

from lotwise.functions.numeric import band
from lotwise.operators import encode, grouped_gp as gg
from lotwise.plans.registry import query, rounded
from lotwise.sources.tables import table

L, SIGMA = 0.5, 0.5

# Inputs 0 and 1 (view or not) per user: a group folds to two cells, which SQL can solve by hand.
CELLS = """ev as (select event_id, user_id, cast(event_type = 'view' as double) as x, value / 10 as y from events),
  cl as (select user_id, count(*) filter (x = 0) as n0, count(*) filter (x = 1) as n1, coalesce(avg(y) filter (x = 0), 0) as y0,
    coalesce(avg(y) filter (x = 1), 0) as y1, coalesce(var_pop(y) filter (x = 0), 0) * count(*) filter (x = 0)
    + coalesce(var_pop(y) filter (x = 1), 0) * count(*) filter (x = 1) as ss, 0.25::double as s, exp(-{l}::double) as e from ev
    group by user_id),
  d as (select *, (n0 + s) * (n1 + s) - e * e * n0 * n1 as det from cl),
  al as (select *, n0 * ((n1 + s) * y0 - e * n1 * y1) / det as a0, n1 * (-e * n0 * y0 + (n0 + s) * y1) / det as a1,
    n0 * (n1 + s) / det as c00, -e * n0 * n1 / det as c01, n1 * (n0 + s) / det as c11 from d)"""
_CELLS = CELLS.format(l=L)


def _views(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", "user_id", (F.col("event_type") == "view").cast("double").alias("x"), (F.col("value") / 10).alias("y")
    )


@query(
    f"""with {_CELLS} select event_id, ev.user_id, round(case when x = 0 then a0 + e * a1 else e * a0 + a1 end, 6) as gp_mean,
    round(case when x = 0 then 1 + s - (c00 + 2 * e * c01 + e * e * c11) else 1 + s - (e * e * c00 + 2 * e * c01 + c11) end, 6)
      as gp_var from ev join al on ev.user_id = al.user_id"""
)
def group_posterior(spark, folder):
    """Predictive mean and variance (noise included) per event under its user's own process."""
    rows = _views(spark, folder)
    scored = gg.grouped_gp(rows, rows.select("event_id", "user_id", "x"), "user_id", "x", "y", L, SIGMA)
    return rounded(scored.select("event_id", "user_id", "gp_mean", "gp_var"))


def _likelihood(l: float) -> str:
    return f"""select user_id, {l}::double as l, round(-0.5 * (y0 * a0 + y1 * a1) - 0.5 * ln(det) - 0.5 * (n0 + n1) * ln(2 * pi())
    - 0.5 * (n0 + n1 - 2) * ln(s) - 0.5 * ss / s, 6) as lml, round(-e * a0 * a1 + e * c01, 6) + 0.0 as gradient
    from (with {CELLS.format(l=l)} select * from al)"""


@query(_likelihood(0.5) + " union all " + _likelihood(2.0))
def group_likelihoods(spark, folder):
    """Log marginal likelihood and its derivative per user and candidate l."""
    return rounded(gg.likelihood_grid(_views(spark, folder), "user_id", "x", "y", [0.5, 2.0], SIGMA))


def _timeline(spark, folder):
    """Log value against scaled time per event type; every type has many distinct times."""
    rows = table(spark, folder, "events").select(
        "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("x"), F.log1p("value").alias("y")
    )
    return encode.fit_scaler(rows, ["x", "y"]).transform(rows)


@query()
def group_lengthscales(spark, folder):
    """Best l per event type by marginal likelihood; large groups go through the series sums."""
    return rounded(gg.tune_lengthscale(_timeline(spark, folder), "event_type", "x", "y", 1.0))


@query()
def group_posterior_curves(spark, folder):
    """Mean and ±1-deviation band over a regular grid per event type, after tuning l."""
    groups = gg.Groups(_timeline(spark, folder), "event_type", "x", "y")
    theta = gg.tune(groups, (log(0.5), 0.0, 0.0))
    steps = F.sequence(F.lit(0), F.lit(159))
    grid = groups.keys.select("event_type", F.explode(steps).alias("i")).withColumn("x", F.lit(-4.0) + F.col("i") * 0.05)
    scored = gg.predict(groups, theta, grid, "x")
    lower, upper = band(F.col("gp_mean"), F.sqrt("gp_var"), 1.0)
    return rounded(scored.select("event_type", "x", F.col("gp_mean").alias("pred"), lower.alias("lower"), upper.alias("upper")))


# Parameters of the two-cell groups by pattern search: v and noise s as logarithms, e = exp(-l) between 0 and 1. Each round tries
# five places a parameter and shrinks the box around the best. An e of 1 is the end of the scale, where l is zero.
ROUNDS, SHRINK = 75, 0.7
_DET = "((n0 * exp(v) + exp(s)) * (n1 * exp(v) + exp(s)) - n0 * n1 * exp(2 * v) * e * e)"
SEARCHED = f"""{_CELLS.split(", d as")[0]}, st as (select user_id, n0, n1, y0, y1, ss from cl),
  steps as (select unnest([-1.0, -0.5, 0.0, 0.5, 1.0])::double as t),
  found as (
    select user_id, 1 as i, 0.0::double as v, 0.0::double as s, exp(-0.5::double) as e, null::double as lml from st
    union all
    select user_id, i + 1, best.v, best.s, best.e, best.lml from (
      select user_id, i, arg_max({{'v': v, 's': s, 'e': e, 'lml': lml}}, lml) as best from (
        select *, -0.5 * (n0 * (n1 * exp(v) + exp(s)) * y0 * y0 - 2 * n0 * n1 * exp(v) * e * y0 * y1 + n1 * (n0 * exp(v) + exp(s)) * y1 * y1)
            / {_DET} - 0.5 * ln({_DET}) - 0.5 * (n0 + n1) * ln(2 * pi()) - 0.5 * (n0 + n1 - 2) * s - 0.5 * ss / exp(s) as lml from (
          select f.user_id, f.i, n0, n1, y0, y1, ss, f.v + a.t * 2 * pow({SHRINK}, i) as v, f.s + b.t * 2 * pow({SHRINK}, i) as s,
            least(greatest(f.e + c.t * pow({SHRINK}, i), 0), 1) as e
          from found f join st on f.user_id = st.user_id cross join steps a cross join steps b cross join steps c where i <= {ROUNDS}))
      group by user_id, i)),
  fit as (select user_id, n0, n1, y0, y1, exp(v) as v, exp(s) as s, e, lml, {_DET} as det from found join st using (user_id)
    where i = {ROUNDS} + 1),
  post as (select *, n0 * ((n1 * v + s) * y0 - n1 * v * e * y1) / det as a0, n1 * ((n0 * v + s) * y1 - n0 * v * e * y0) / det as a1,
    n0 * (n1 * v + s) / det as c00, -n0 * n1 * v * e / det as c01, n1 * (n0 * v + s) / det as c11 from fit)"""
# Fitted as far as the likelihood tells values apart; that leaves the variance known to about 2e-5, hence the few digits below.
SHARP = 1e-14


@query(
    f"""with recursive {SEARCHED} select user_id, round(-ln(e), 3) + 0.0 as l, round(v, 1) as variance, round(s, 2) as noise,
    round(lml, 4) as lml from fit"""
)
def group_hyperparameters(spark, folder):
    """Lengthscale, variance and noise of every user by marginal likelihood, all three free."""
    groups = gg.Groups(_views(spark, folder), "user_id", "x", "y")
    found = gg.tune(groups, (log(0.5), 0.0, 0.0), (True, True, True), SHARP)
    l, variance, noise = (F.exp(F.col("theta")[i]) for i in range(3))
    return rounded(
        found.select("user_id", F.round(l, 3).alias("l"), F.round(variance, 1).alias("variance"), F.round(noise, 2).alias("noise"), F.round("lml", 4).alias("lml"))
    )


@query(
    f"""with recursive {SEARCHED} select event_id, ev.user_id, round(case when x = 0 then v * (a0 + e * a1) else v * (e * a0 + a1) end, 4)
      as gp_mean, round(v - v * v * case when x = 0 then c00 + 2 * e * c01 + e * e * c11 else e * e * c00 + 2 * e * c01 + c11 end, 3)
      as gp_var from ev join post on ev.user_id = post.user_id"""
)
def group_latent_posterior(spark, folder):
    """Latent posterior per user with lengthscale, variance and noise fitted by the bound."""
    rows = _views(spark, folder)
    scored = gg.grouped_variational_gp(rows, rows.select("event_id", "user_id", "x"), "user_id", "x", "y", tolerance=SHARP)
    return rounded(scored.select("event_id", "user_id", F.round("gp_mean", 4).alias("gp_mean"), F.round("gp_var", 3).alias("gp_var")))
