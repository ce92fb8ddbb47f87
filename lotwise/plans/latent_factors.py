"""Named queries: the hierarchical latent-factor price model."""

from __future__ import annotations

import numpy as np
from lotwise.operators import hierarchical as hier
from lotwise.plans import price_models as flow
from lotwise.plans.frames import CODED, EDGES, KEYS, encoded
from lotwise.plans.registry import query, rounded
from lotwise.session import stage

# Fixed weights, position i holding 0.01·(i + 1), so that SQL can follow the scoring.
LAYOUT = hier.layout()
FIXED = hier.FactorModel(LAYOUT, 0.01 * np.arange(1, LAYOUT.size + 1), np.ones(LAYOUT.size))


def _ready(spark, folder):
    return flow.factor_rows(encoded(spark, folder), "order_key", edges=EDGES)


ROWS = (
    CODED
    + """, ms as (select avg(mileage) as mm, stddev_pop(mileage) as sm from coded),
  rows as (select order_key, line_no, cast(turbo as double) as turbo, engine, cylinders, category_encoded, gearbox_encoded,
    cast(leather as double) as leather, maker_encoded, cast(age as double) as age, (mileage - mm) / sm as mileage,
    levy / 1000 as levy, price / 1000 as price_k, split from coded cross join ms where leather is not null)"""
)
SCORES = (
    ROWS
    + """, f as (select *, 0.01*turbo + 0.02*engine + 0.03*cylinders + 0.04 as q,
    0.09*leather + 0.10*category_encoded + 0.11*maker_encoded + 0.12 as s, 0.13*age + 0.14*mileage + 0.15 as e,
    0.16*levy + 0.17 as l from rows where split = 'test'),
  fp as (select *, 0.05*category_encoded + 0.06*gearbox_encoded + 0.07 + 0.08*q as p from f)"""
)


@query(
    f"""with {SCORES} select order_key, line_no, round(q, 6) as quality_score, round(p, 6) as performance_score,
    round(s, 6) as status_score, round(e, 6) as seniority_score, round(l, 6) as levy_score from fp"""
)
def factor_scores(spark, folder):
    """The five factor means per test row."""
    scored = FIXED.factor_scores(_ready(spark, folder).test)
    return rounded(scored.select(*KEYS, *[f"{f}_score" for f in hier.FACTORS]))


@query(
    f"""with {SCORES}, z as (select *, 0.18*p + 0.19*s + 0.20*e + l + 0.21 as m from fp)
    select order_key, line_no, round(price_k, 6) as price_k, round(greatest(m, 0) + ln(1 + exp(-abs(m))) + 1, 6) as pred from z"""
)
def factor_model_price(spark, folder):
    """Price mean in thousands from the factor scores."""
    priced = FIXED.price(_ready(spark, folder).test)
    return rounded(priced.select(*KEYS, "price_k", "pred"))


@query(
    f"""with {ROWS}, t as (select * from rows where split = 'train')
    select count(*) as n, round(sum(turbo), 4) as turbo, round(sum(engine * engine), 4) as engine2,
    round(sum(levy * levy), 4) as levy2, round(sum(mileage * mileage), 4) as mileage2,
    round(sum(turbo * engine), 4) as turbo_engine, round(sum(maker_encoded * maker_encoded), 4) as maker2 from t"""
)
def factor_moments(spark, folder):
    """The column moments that carry every term of the bound but the likelihood."""
    mom = hier.column_moments(_ready(spark, folder).train, LAYOUT)
    at = {c: i for i, c in enumerate(LAYOUT.columns)}
    cell = lambda a, b: float(mom.matrix[at[a], at[b]])
    row = (
        int(mom.n),
        float(mom.matrix[at["turbo"], -1]),
        cell("engine", "engine"),
        cell("levy", "levy"),
        cell("mileage", "mileage"),
        cell("turbo", "engine"),
        cell("maker_encoded", "maker_encoded"),
    )
    names = "n long, turbo double, engine2 double, levy2 double, mileage2 double, turbo_engine double, maker2 double"
    return rounded(spark.createDataFrame([row], names), 4)


# The bound at the fixed means with unit scales: squares of columns, then the likelihood at the price weights' means.
_Z = f"sqrt({0.18**2 + 0.19**2 + 0.20**2 + 1.0}::double)"
_NODES = " + ".join(
    f"{float(w)!r}::double * pow(price_k - 1 - (greatest(z, 0) + ln(1 + exp(-abs(z)))), 2)".replace("z", f"(m + {float(x)!r}::double * sd)")
    for x, w in zip(hier.NODES, hier.NODE_WEIGHTS, strict=True)
)
_SQUARES = " + ".join(f"sum({c} * {c})" for c in LAYOUT.columns)


@query(
    f"""with {SCORES.replace("split = 'test'", "split = 'train'")}, z as (select *, 0.18*p + 0.19*s + 0.20*e + l + 0.21 as m,
      {_Z} as sd from fp)
    select 'prior' as term, round({-0.5 * float((FIXED.loc**2).sum())!r}::double - 0.5 * ({_SQUARES} + 5 * count(*))
      - 0.5 * (sum(q * q) + count(*) * (0.0064 + 1)), 2) as value from z
    union all select 'likelihood', round(sum(-0.125 * ({_NODES})) - count(*) * (0.5 * ln(2 * pi()) + ln(2)), 2) from z"""
)
def factor_bound(spark, folder):
    """Both parts of the bound at fixed weights."""
    train = _ready(spark, folder).train
    train = stage(train.select(*dict.fromkeys(LAYOUT.columns), "price_k"), "factor-rows")
    mom = hier.column_moments(train, LAYOUT)
    theta = np.concatenate([FIXED.loc, np.zeros(LAYOUT.size)])
    prior, _ = hier.prior_terms(theta, mom, LAYOUT)
    fit = hier.likelihood_terms(train, "price_k", theta, np.zeros((1, 4)), mom, LAYOUT)[0]
    return rounded(spark.createDataFrame([("prior", float(prior)), ("likelihood", float(fit))], "term string, value double"), 2)


# Per node: weight, place, and the slope and curve of the log-likelihood there, for the argument m with deviation sd.
_STEPS = "unnest([" + ", ".join(f"{{'w': {float(w)!r}::double, 't': {float(x)!r}::double}}" for x, w in zip(hier.NODES, hier.NODE_WEIGHTS, strict=True)) + "])"
_FEATURES = list(dict.fromkeys(LAYOUT.columns))


@query(
    f"""with {SCORES.replace("split = 'test'", "split = 'train'")}, z as (select *, 0.18*p + 0.19*s + 0.20*e + l + 0.21 as m,
      {_Z} as sd, {_STEPS} as node from fp),
    n as (select *, node.w as w, node.t as t, m + node.t * sd as z from z),
    r as (select *, 1 / (1 + exp(-z)) as rise, price_k - 1 - (greatest(z, 0) + ln(1 + exp(-abs(z)))) as err from n),
    d as (select *, err * rise / 4 as one, (err * rise * (1 - rise) - rise * rise) / 4 as two from r)
    select 'level' as feature, round(sum(w * one), 3) as slope, round(sum(w * two), 3) as curve from d union all
    select 'variance', round(sum(w * t * one / (2 * sd)), 3),
      round(sum(w * (two * t * t / (4 * sd * sd) - one * t / (4 * pow(sd, 3)))), 3) from d union all """
    + " union all ".join(f"select '{c}', round(sum(w * one * {c}), 3), round(sum(w * two * {c} * {c}), 3) from d" for c in _FEATURES)
)
def factor_slopes(spark, folder):
    """First and second derivatives of the expected likelihood in the argument, at fixed weights: what a Newton step is made of."""
    train = _ready(spark, folder).train.select(*_FEATURES, "price_k")
    form, _ = hier._argument(LAYOUT, FIXED.loc, FIXED.loc[LAYOUT.slices()["price"]])
    ((_, pull, curve),) = hier.likelihood_sums(train, "price_k", [form], LAYOUT)
    names = [*LAYOUT.columns, "level", "variance"]
    rows = {n: (n, float(pull[i]), float(curve[i, i])) for i, n in enumerate(names)}
    return rounded(spark.createDataFrame(list(rows.values()), "feature string, slope double, curve double"), 3)


def _fitted(spark, folder):
    ready = _ready(spark, folder)
    return hier.hierarchical_fit(stage(ready.train.select(*ready.features, ready.target)), ready.target)


def _resting() -> str:
    seen, rows = {}, []
    for param, feature in LAYOUT.names():
        seen[param] = seen.get(param, -1) + 1
        rows += [f"('{param}', {seen[param]}, '{feature}', '{what}', true)" for what in ("loc", "scale")]
    return ", ".join(rows)


@query(f"select * from (values {_resting()}) t(param, idx, feature, part, at_rest)")
def factor_stationarity(spark, folder):
    """A certificate of the fit: no mean and no scale of a weight has a slope that moving by its own deviation would notice."""
    return _fitted(spark, folder).rest(spark)


@query()
def factor_posterior(spark, folder):
    """Posterior mean and scale of every weight."""
    return rounded(_fitted(spark, folder).posterior(spark))


@query()
def factor_weights(spark, folder):
    """Learned weight per feature and per factor."""
    return rounded(_fitted(spark, folder).weights(spark))


@query()
def factor_bound_trace(spark, folder):
    return rounded(_fitted(spark, folder).trace_table(spark), 3)
