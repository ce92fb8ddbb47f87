"""Hierarchical latent-factor price model, fitted by variational inference.

Five factors explain the price (in thousands)::

    quality     = Xq·w + b + ε         performance = Xp·w + w_q·quality + b + ε
    status      = Xs·w + b + ε         seniority   = Xe·w + b + ε
    levy        = Xl·w + b + ε
    price       ~ N(softplus(w_perf·performance + w_stat·status + w_sen·seniority + levy + b) + 1, 2)

with N(0, 1) priors on all weights and unit-scale ε. The guide is mean-field Gaussian; its
factors sit at the weight means with unit scale. Everything in the bound but the likelihood is
a closed form of column moments, which are summed once. Given the four draws of the price
weights, the likelihood's argument is Gaussian per row, so its expectation is a short
Gauss–Hermite sum: no per-row random numbers, the same result at any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions.numeric import linear, softplus_link
from lotwise.operators.ascent import TOLERANCE, remodelled, slopes
from lotwise.operators.blocks import sum_blocks

# Feature groups of the price study.
FEATURE_GROUPS = {
    "quality": ("turbo", "engine", "cylinders"),
    "performance": ("category_encoded", "gearbox_encoded"),
    "status": ("leather", "category_encoded", "maker_encoded"),
    "seniority": ("age", "mileage"),
    "levy": ("levy",),
}
FACTORS = tuple(FEATURE_GROUPS)
OBSERVATION_SCALE = 2.0
# Weights beyond this are no candidates: their squared errors overflow.
FAR = 1e50
NODES, NODE_WEIGHTS = (lambda x, w: (x * np.sqrt(2.0), w / np.sqrt(np.pi)))(*np.polynomial.hermite.hermgauss(12))


@dataclass(frozen=True)
class Layout:
    """Positions of every weight in one flat vector."""

    groups: dict[str, tuple[str, ...]]

    @property
    def columns(self) -> list[str]:
        return [c for f in FACTORS for c in self.groups[f]]

    def names(self) -> list[tuple[str, str]]:
        """``(parameter, feature)`` per position; the feature of a bias or factor weight is empty."""
        out = []
        for f in FACTORS:
            out += [(f"w_{f}", c) for c in self.groups[f]] + [(f"b_{f}", "")]
            if f == "performance":
                out.append(("w_performance_quality", ""))
        return [*out, ("w_perf", ""), ("w_stat", ""), ("w_sen", ""), ("bias", "")]

    def slices(self) -> dict[str, slice]:
        at, out = 0, {}
        for f in FACTORS:
            size = len(self.groups[f])
            out[f] = slice(at, at + size)
            out[f"b_{f}"] = slice(at + size, at + size + 1)
            at += size + 1
            if f == "performance":
                out["pq"] = slice(at, at + 1)
                at += 1
        out["price"] = slice(at, at + 4)
        return out

    @property
    def size(self) -> int:
        return self.slices()["price"].stop


def layout(groups: Mapping[str, Sequence[str]] = FEATURE_GROUPS) -> Layout:
    return Layout({f: tuple(groups[f]) for f in FACTORS})


# --- sums over rows -------------------------------------------------------------------------


def _moment_block(block: np.ndarray, _payload) -> np.ndarray:
    rows = np.column_stack([block, np.ones(len(block))])
    return (rows.T @ rows).ravel()


def _argument(lay: Layout, loc: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The likelihood's argument as a linear form of ``[x, 1]`` and its variance, and their derivatives.

    Given the price weights, the argument of a row is Gaussian: its mean is linear in the features, its variance the
    same for all rows. The derivatives have a row per weight; those of the price weights follow the others.
    """
    at, d = lay.slices(), len(lay.columns)
    (perf, stat, sen, bias), pq = price, loc[at["pq"]][0]
    reach = {"quality": perf * pq, "performance": perf, "status": stat, "seniority": sen, "levy": 1.0}
    # What one more unit of pq, perf, stat and sen adds to the reach of factors.
    more = [{"quality": perf}, {"quality": pq, "performance": 1.0}, {"status": 1.0}, {"seniority": 1.0}]
    rows = [at["pq"].start, *range(at["price"].start, at["price"].start + 3)]
    form, slope, start = np.zeros(d + 2), np.zeros((lay.size, d + 2)), 0
    for f in FACTORS:
        cols = np.arange(start, start + len(lay.groups[f]))
        w, b = loc[at[f]], loc[at[f"b_{f}"]][0]
        form[cols] = reach[f] * w
        form[d] += reach[f] * b
        slope[np.arange(at[f].start, at[f].stop), cols] = reach[f]
        slope[at[f"b_{f}"].start, d] = reach[f]
        for row, adds in zip(rows, more, strict=True):
            slope[row, cols] += adds.get(f, 0.0) * w
            slope[row, d] += adds.get(f, 0.0) * b
        start += len(cols)
    form[d] += bias
    form[d + 1] = perf**2 + stat**2 + sen**2 + 1.0
    slope[at["price"].start + 3, d] = 1.0
    slope[rows[1:], d + 1] = 2 * np.array([perf, stat, sen])
    return form, slope


def _form_bend(lay: Layout, loc: np.ndarray, price: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Second derivatives of ``pull`` times the form of ``_argument`` in the means, those of the price weights at ``price``."""
    at, d = lay.slices(), len(lay.columns)
    (perf, *_), pq = price, loc[at["pq"]][0]
    more = [{"quality": perf}, {"quality": pq, "performance": 1.0}, {"status": 1.0}, {"seniority": 1.0}]
    rows = [at["pq"].start, *range(at["price"].start, at["price"].start + 3)]
    bend, start = np.zeros((lay.size, lay.size)), 0
    for f in FACTORS:
        size = len(lay.groups[f])
        own, pulls = [*range(at[f].start, at[f].stop), at[f"b_{f}"].start], np.append(pull[start : start + size], pull[d])
        for row, adds in zip(rows, more, strict=True):
            bend[row, own] += adds.get(f, 0.0) * pulls
            bend[own, row] += adds.get(f, 0.0) * pulls
        if f == "quality":
            bend[rows[0], rows[1]] = bend[rows[1], rows[0]] = loc[own] @ pulls
        start += size
    bend[rows[1:], rows[1:]] += 2 * pull[d + 1]
    return bend


def _likelihood_block(block: np.ndarray, forms: Sequence[np.ndarray]) -> np.ndarray:
    """Per linear form: Σ over rows of the expected log-likelihood, of its derivatives in the argument's mean times ``[x, 1]``
    and in its variance, and of the second derivatives."""
    x, y = np.column_stack([block[:, :-1], np.ones(len(block))]), block[:, -1]
    out = []
    for form in forms:
        v = form[-1]
        sd = np.sqrt(v)
        z = (x @ form[:-1])[:, None] + sd * NODES
        small = np.exp(-np.abs(z))
        rise = np.where(z >= 0, 1.0, small) / (1.0 + small)
        error = y[:, None] - (np.maximum(z, 0.0) + np.log1p(small) + 1.0)
        first = error * rise / OBSERVATION_SCALE**2
        second = (error * rise * (1.0 - rise) - rise**2) / OBSERVATION_SCALE**2
        in_v = first @ (NODE_WEIGHTS * NODES) / (2 * sd)
        in_vv = second @ (NODE_WEIGHTS * NODES**2) / (4 * v) - in_v / (2 * v)
        mixed = second @ (NODE_WEIGHTS * NODES) / (2 * sd)
        value = -0.5 * (error**2 @ NODE_WEIGHTS) / OBSERVATION_SCALE**2
        curve = (x * (second @ NODE_WEIGHTS)[:, None]).T @ x
        out += [[value.sum()], (first @ NODE_WEIGHTS) @ x, [in_v.sum()], curve.ravel(), mixed @ x, [in_vv.sum()]]
    return np.concatenate(out)


# --- the bound ------------------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnMoments:
    """``Σ [x 1]'[x 1]`` over the rows, one pass before the first step."""

    matrix: np.ndarray

    @property
    def n(self) -> float:
        return float(self.matrix[-1, -1])

    def squares(self) -> np.ndarray:
        return np.diag(self.matrix)[:-1]


def column_moments(df: DataFrame, lay: Layout) -> ColumnMoments:
    d = len(lay.columns)
    cols = [F.col(c).alias(f"x{i}") for i, c in enumerate(lay.columns)]
    flat = sum_blocks(df.select(*cols), [f"x{i}" for i in range(d)], (d + 1) ** 2, _moment_block)
    return ColumnMoments(flat.reshape(d + 1, d + 1))


def prior_terms(theta: np.ndarray, mom: ColumnMoments, lay: Layout) -> tuple[float, np.ndarray]:
    """Minus the divergences of weights and factors from their priors, with gradient.

    ``theta`` holds means, then log scales.
    """
    p, at = lay.size, lay.slices()
    loc, var = theta[:p], np.exp(2 * theta[p:])
    in_loc, in_var = -loc, 0.5 * (1 / var - 1)
    value = -0.5 * float((var + loc**2 - 1 - np.log(var)).sum())
    squares, start = mom.squares(), 0
    for f in FACTORS:
        size = len(lay.groups[f])
        s2 = squares[start : start + size]
        value -= 0.5 * float(var[at[f]] @ s2 + mom.n * var[at[f"b_{f}"]][0])
        in_var[at[f]] -= 0.5 * s2
        in_var[at[f"b_{f}"]] -= 0.5 * mom.n
        start += size
    q = len(lay.groups["quality"])
    index = [*range(q), len(mom.matrix) - 1]
    gram, v = mom.matrix[np.ix_(index, index)], np.append(loc[at["quality"]], loc[at["b_quality"]])
    total, pq_loc, pq_var = float(v @ gram @ v), loc[at["pq"]][0], var[at["pq"]][0]
    value -= 0.5 * (pq_var * total + mom.n * (pq_loc**2 + pq_var))
    in_var[at["pq"]] -= 0.5 * (total + mom.n)
    in_loc[at["pq"]] -= mom.n * pq_loc
    back = pq_var * (gram @ v)
    in_loc[at["quality"]] -= back[:q]
    in_loc[at["b_quality"]] -= back[q]
    return value, np.concatenate([in_loc, in_var * 2 * var])


_NUMBERED: WeakKeyDictionary[DataFrame, dict] = WeakKeyDictionary()


def _numbered(df: DataFrame, lay: Layout, target: str) -> DataFrame:
    """The columns by position, as a feature can be in two groups; one frame for all steps of a fit."""
    plans, key = _NUMBERED.setdefault(df, {}), (*lay.columns, target)
    if key not in plans:
        plans[key] = df.select(*[F.col(c).alias(f"x{i}") for i, c in enumerate(lay.columns)], F.col(target).alias("y"))
    return plans[key]


def likelihood_sums(
    df: DataFrame, target: str, forms: Sequence[np.ndarray], lay: Layout
) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Per linear form of ``[x, 1]`` with its variance last: Σ over rows of the expected log-likelihood (without constants), and
    its first and second derivatives in the form. One pass."""
    d = len(lay.columns)
    width = 1 + (d + 2) + (d + 1) ** 2 + (d + 1) + 1
    flat = sum_blocks(_numbered(df, lay, target), [*[f"x{i}" for i in range(d)], "y"], width * len(forms), _likelihood_block, list(forms))
    out = []
    for part in flat.reshape(len(forms), width):
        curve = np.empty((d + 2, d + 2))
        curve[:-1, :-1] = part[d + 3 : d + 3 + (d + 1) ** 2].reshape(d + 1, d + 1)
        curve[:-1, -1] = curve[-1, :-1] = part[-d - 2 : -1]
        curve[-1, -1] = part[-1]
        out.append((float(part[0]), part[1 : d + 3], curve))
    return out


def likelihood_terms(
    df: DataFrame, target: str, theta: np.ndarray, noise: np.ndarray, mom: ColumnMoments, lay: Layout
) -> tuple[float, np.ndarray, np.ndarray]:
    """Expected log-likelihood averaged over the draws (``particles × 4`` normals), with gradient and second derivatives.

    One pass over the rows.
    """
    return _in_weights(theta, noise, _form_sums(df, target, theta, noise, lay), mom, lay)


FormSums = list[tuple[float, np.ndarray, np.ndarray]]


def _forms(theta: np.ndarray, noise: np.ndarray, lay: Layout) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per draw of the price weights: the linear form of the rows and its derivatives in means and log scales."""
    p, price = lay.size, lay.slices()["price"]
    loc, scale = theta[:p], np.exp(theta[p:])
    out = []
    for eps in noise:
        moved = eps * scale[price]
        form, slope = _argument(lay, loc, loc[price] + moved)
        in_scale = np.zeros_like(slope)
        in_scale[price] = moved[:, None] * slope[price]
        out.append((form, np.vstack([slope, in_scale])))
    return out


def _form_sums(df: DataFrame, target: str, theta: np.ndarray, noise: np.ndarray, lay: Layout) -> FormSums:
    now = [form for form, _ in _forms(theta, noise, lay)]
    if not max(np.abs(form).max() for form in now) < FAR:
        raise np.linalg.LinAlgError("a step beyond all numbers")
    return likelihood_sums(df, target, now, lay)


def _in_weights(
    theta: np.ndarray, noise: np.ndarray, sums: FormSums, mom: ColumnMoments, lay: Layout
) -> tuple[float, np.ndarray, np.ndarray]:
    """From sums in the linear forms to value, gradient and second derivatives in means and log scales."""
    p = lay.size
    value = -mom.n * (0.5 * np.log(2 * np.pi) + np.log(OBSERVATION_SCALE))
    gradient, second, loc, at = np.zeros(2 * p), np.zeros((2 * p, 2 * p)), theta[:p], lay.slices()["price"]
    for eps, (_, slope), (part, pull, curve) in zip(noise, _forms(theta, noise, lay), sums, strict=True):
        value += part / len(noise)
        gradient += slope @ pull / len(noise)
        second += slope @ curve @ slope.T / len(noise)
        # What the form itself bends by: in the means, and in the scales of the price weights, which move the draw.
        moved = eps * np.exp(theta[p:][at])
        bend, scales = _form_bend(lay, loc, loc[at] + moved, pull) / len(noise), slice(p + at.start, p + at.stop)
        second[:p, :p] += bend
        second[:p, scales] += bend[:, at] * moved
        second[scales, :p] += moved[:, None] * bend[at]
        second[scales, scales] += moved[:, None] * bend[at, at] * moved + np.diag(slope[scales] @ pull) / len(noise)
    return value, gradient, second


def _likelihood_model(
    theta: np.ndarray, noise: np.ndarray, sums: FormSums, lay: Layout, damping: float
) -> Callable[[np.ndarray], FormSums]:
    """The sums at other weights, as their expansion in the linear forms at ``theta`` says; no pass.

    The likelihood is close to a quadratic in the forms, while the forms are products of weights: what bends the bound is kept exactly.
    Curvatures are turned downwards, and ``damping`` adds to each its own share, so that a model has a top.
    """
    before, bends = [form for form, _ in _forms(theta, noise, lay)], []
    for _, _, curve in sums:
        own = np.abs(np.diag(curve))
        own = np.sqrt(np.maximum(own, 1e-12 * max(own.max(initial=0.0), 1e-300)))
        size, axes = np.linalg.eigh((curve + curve.T) / 2 / np.outer(own, own))
        bends.append(-np.outer(own, own) * ((axes * (np.abs(size) + damping)) @ axes.T))

    def at(theta: np.ndarray) -> FormSums:
        out = []
        for (form, _), was, (part, pull, _), bend in zip(_forms(theta, noise, lay), before, sums, bends, strict=True):
            step = form - was
            out.append((part + pull @ step + 0.5 * step @ bend @ step, pull + bend @ step, bend))
        return out

    return at


@dataclass(frozen=True)
class FactorModel:
    layout: Layout
    loc: np.ndarray
    scale: np.ndarray
    trace: tuple[float, ...] = ()
    gradient: np.ndarray | None = None

    def posterior(self, spark: SparkSession) -> DataFrame:
        """``(param, idx, feature, loc, scale)``"""
        seen: dict[str, int] = {}
        rows = []
        for (param, feature), loc, scale in zip(self.layout.names(), self.loc, self.scale, strict=True):
            idx = seen[param] = seen.get(param, -1) + 1
            rows.append((param, idx, feature, float(loc), float(scale)))
        return spark.createDataFrame(rows, "param string, idx int, feature string, loc double, scale double")

    def rest(self, spark: SparkSession, slack: float = 1e-2) -> DataFrame:
        """``(param, idx, feature, part, at_rest)``: whether the bound would change by less than ``slack`` if a mean moved by
        its deviation, or a scale by itself, as its slope at the end of the fit says."""
        slope = np.abs(self.gradient) * np.concatenate([self.scale, np.ones(len(self.scale))])
        seen: dict[str, int] = {}
        rows = []
        for i, (param, feature) in enumerate(self.layout.names()):
            idx = seen[param] = seen.get(param, -1) + 1
            for part, at in (("loc", i), ("scale", i + len(self.loc))):
                rows.append((param, idx, feature, part, bool(slope[at] < slack)))
        return spark.createDataFrame(rows, "param string, idx int, feature string, part string, at_rest boolean")

    def weights(self, spark: SparkSession) -> DataFrame:
        """Posterior mean per feature and per factor, biases left out."""
        return self.posterior(spark).where(~F.col("param").startswith("b")).select("param", "feature", "loc")

    def trace_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.trace, 1)), "step int, elbo double")

    def factor_scores(self, df: DataFrame) -> DataFrame:
        """Adds the five factor means at the posterior means; a plain projection."""
        at = self.layout.slices()
        score: dict[str, Column] = {
            f: linear(self.layout.groups[f], self.loc[at[f]], self.loc[at[f"b_{f}"]][0]) for f in FACTORS
        }
        score["performance"] = score["performance"] + F.lit(float(self.loc[at["pq"]][0])) * score["quality"]
        return df.withColumns({f"{f}_score": c for f, c in score.items()})

    def price(self, df: DataFrame, name: str = "pred") -> DataFrame:
        """Price mean in thousands from the factor scores, which are added as well."""
        perf, stat, sen, bias = self.loc[self.layout.slices()["price"]]
        argument = linear(
            ["performance_score", "status_score", "seniority_score", "levy_score"], [perf, stat, sen, 1.0], bias
        )
        return self.factor_scores(df).withColumn(name, softplus_link(argument))


def hierarchical_fit(
    df: DataFrame,
    target: str,
    groups: Mapping[str, Sequence[str]] = FEATURE_GROUPS,
    tolerance: float = TOLERANCE,
    particles: int = 16,
    seed: int = 42,
) -> FactorModel:
    """Maximise the bound, full batch, by second-order steps. Cache ``df``: each step reads it once.

    The price weights' draws are the same normals at every step, so the bound is one smooth function, and the sums of
    one pass hold its second derivatives: there are as many as weights squared, however many rows. Weights that share a product leave
    a bent ridge, the narrower the more rows: it is followed on the driver, in the model that a pass leaves behind, so that
    the number of passes does not grow with the rows. Factors and price weights can
    change sign together without changing the bound; the start, factors that raise the price, settles the sign.
    """
    lay = layout(groups)
    mom, noise = column_moments(df, lay), draws(particles, seed)
    level = df.agg(F.avg(target)).first()[0] or 1.0
    theta, trace, gradient = remodelled(start(mom, lay, level - 1.0), lambda t: measured_bound(df, target, t, noise, mom, lay), tolerance)
    return FactorModel(lay, theta[: lay.size], np.exp(theta[lay.size :]), tuple(trace), gradient)


def draws(particles: int = 16, seed: int = 42) -> np.ndarray:
    """Normals for the price weights, in opposite pairs: they average to zero exactly."""
    half = np.random.default_rng(seed).standard_normal((particles // 2, 4))
    return np.concatenate([half, -half])


def start(mom: ColumnMoments, lay: Layout, level: float = 0.0) -> np.ndarray:
    """The mean price alone, and factors that raise it a little; weights as sure as their priors and column sums make them."""
    at, loc, var = lay.slices(), np.zeros(lay.size), np.full(lay.size, 1.0 / (1.0 + mom.n))
    price = at["price"].start
    loc[[at["pq"].start, *range(price, price + 3)]] = 0.1
    loc[[at["b_levy"].start, price + 3]] = level / 2
    squares, first = mom.squares(), 0
    for f in FACTORS:
        size = len(lay.groups[f])
        var[at[f]] = 1.0 / (1.0 + squares[first : first + size])
        first += size
    return np.concatenate([loc, 0.5 * np.log(var)])


def bound_expansion(
    df: DataFrame, target: str, theta: np.ndarray, noise: np.ndarray, mom: ColumnMoments, lay: Layout
) -> tuple[float, np.ndarray, np.ndarray]:
    """The bound with gradient and second derivatives; one pass."""
    return measured_bound(df, target, theta, noise, mom, lay)[0]


def measured_bound(
    df: DataFrame, target: str, theta: np.ndarray, noise: np.ndarray, mom: ColumnMoments, lay: Layout
) -> tuple[tuple[float, np.ndarray, np.ndarray], Callable[[float], Callable]]:
    """The bound's expansion from one pass, and what makes a model of the bound around it, as ``remodelled`` takes them."""
    sums = _form_sums(df, target, theta, noise, lay)

    def whole(at: np.ndarray, sums: FormSums) -> tuple[float, np.ndarray, np.ndarray]:
        prior, in_prior = prior_terms(at, mom, lay)
        fit, in_fit, second = _in_weights(at, noise, sums, mom, lay)
        return prior + fit, in_prior + in_fit, second + slopes(lambda t: prior_terms(t, mom, lay)[1], at)

    def model(damping: float) -> Callable:
        modelled = _likelihood_model(theta, noise, sums, lay, damping)
        return lambda at: whole(at, modelled(at))

    return whole(theta, sums), model
