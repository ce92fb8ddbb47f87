"""Ridge and Bayesian linear regression from one second-moment pass.

The rows are read for the means and for the centred second moments; every solve is on the
D×D statistic. Sub-models and coordinate-ascent iterations reuse it without another scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions.numeric import linear
from lotwise.operators.blocks import sum_blocks

# Up to this many features the moments are aggregate expressions; above it, numpy blocks.
EXPRESSION_FEATURES = 8


@dataclass(frozen=True)
class Moments:
    """Second moments of ``(features, target)`` around ``mean``."""

    features: tuple[str, ...]
    target: str
    n: float
    mean: np.ndarray  # D + 1, target last
    centred: np.ndarray  # (D + 1) × (D + 1)

    def subset(self, features: Sequence[str]) -> Moments:
        keep = [self.features.index(f) for f in features] + [len(self.features)]
        return Moments(tuple(features), self.target, self.n, self.mean[keep], self.centred[np.ix_(keep, keep)])

    @property
    def raw(self) -> np.ndarray:
        """Uncentred ``[X y]'[X y]``."""
        return self.centred + self.n * np.outer(self.mean, self.mean)

    @property
    def xtx(self) -> np.ndarray:
        return self.raw[:-1, :-1]

    @property
    def xty(self) -> np.ndarray:
        return self.raw[:-1, -1]

    @property
    def yty(self) -> float:
        return float(self.raw[-1, -1])

    def rmse(self, weights: np.ndarray) -> float:
        """RMSE of ``X·weights`` on these rows, without reading them again."""
        total = self.yty - 2 * weights @ self.xty + weights @ self.xtx @ weights
        return float(np.sqrt(max(total, 0.0) / self.n))

    def table(self, spark: SparkSession) -> DataFrame:
        """``(a, b, value)`` of the uncentred matrix, lower triangle."""
        names, raw = [*self.features, self.target], self.raw
        rows = [(names[i], names[j], float(raw[i, j])) for i in range(len(names)) for j in range(i + 1)]
        return spark.createDataFrame(rows, "a string, b string, value double")


def _outer(block: np.ndarray, mean: np.ndarray) -> np.ndarray:
    rows = block - mean
    return (rows.T @ rows).ravel()


def moments(df: DataFrame, features: Sequence[str], target: str) -> Moments:
    """Two passes over rows without NULLs: means, then moments centred at them."""
    names = [*features, target]
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in names]).dropna()
    first = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(F.col(f"`{c}`")).alias(c) for c in names]).first()
    n, mean = float(first["_n"]), np.array([first[c] for c in names], dtype=float)
    if n == 0:
        raise ValueError("no complete rows to fit on")
    d = len(names)
    if len(features) <= EXPRESSION_FEATURES:
        centred = [F.col(f"`{c}`") - F.lit(float(m)) for c, m in zip(names, mean, strict=True)]
        cells = [(i, j) for i in range(d) for j in range(i + 1)]
        sums = rows.agg(*[F.sum(centred[i] * centred[j]).alias(f"s{i}_{j}") for i, j in cells]).first()
        matrix = np.zeros((d, d))
        for i, j in cells:
            matrix[i, j] = matrix[j, i] = sums[f"s{i}_{j}"]
    else:
        matrix = sum_blocks(rows, names, d * d, _outer, mean).reshape(d, d)
    return Moments(tuple(features), target, n, mean, matrix)


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    weights: np.ndarray
    intercept: float = 0.0

    def column(self) -> Column:
        return linear(self.features, self.weights, self.intercept)

    def predict(self, df: DataFrame, name: str = "pred") -> DataFrame:
        return df.withColumn(name, self.column())

    def table(self, spark: SparkSession) -> DataFrame:
        """Coefficients by absolute size, intercept apart: ``(feature, coefficient)``."""
        rows = [(f, float(w)) for f, w in zip(self.features, self.weights, strict=True)]
        return spark.createDataFrame(rows, "feature string, coefficient double").orderBy(
            F.abs("coefficient").desc(), "feature"
        )


def ridge_fit(m: Moments, alpha: float = 1.0) -> LinearModel:
    """Ridge with a free intercept: ``(S + αI) w = s`` on centred moments."""
    weights = np.linalg.solve(m.centred[:-1, :-1] + alpha * np.eye(len(m.features)), m.centred[:-1, -1])
    return LinearModel(m.features, weights, float(m.mean[-1] - weights @ m.mean[:-1]))


@dataclass(frozen=True)
class LinearPosterior:
    """Gaussian posterior over weights; with relevance determination also the Gamma parameters."""

    features: tuple[str, ...]
    mean: np.ndarray
    cov: np.ndarray
    a: float | None = None
    b: np.ndarray | None = None
    trace: tuple[float, ...] = ()

    def model(self) -> LinearModel:
        return LinearModel(self.features, self.mean)

    def table(self, spark: SparkSession) -> DataFrame:
        """``(feature, loc, scale, abs_loc, b, alpha_hat)``; the last two only with Gamma precisions."""
        rows = []
        for i, f in enumerate(self.features):
            b = None if self.b is None else float(self.b[i])
            rows.append(
                (
                    f,
                    float(self.mean[i]),
                    float(np.sqrt(self.cov[i, i])),
                    float(abs(self.mean[i])),
                    b,
                    None if b is None else float(self.a / b),
                )
            )
        return spark.createDataFrame(
            rows, "feature string, loc double, scale double, abs_loc double, b double, alpha_hat double"
        )

    def trace_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.trace, 1)), "iteration int, rmse double")


def _gaussian_posterior(m: Moments, precision: np.ndarray, sigma2: float) -> tuple[np.ndarray, np.ndarray]:
    cov = np.linalg.solve(np.diag(precision) + m.xtx / sigma2, np.eye(len(precision)))
    cov = (cov + cov.T) / 2
    return cov @ (m.xty / sigma2), cov


def bayes_linear_fit(
    m: Moments, alpha: float = 1.0, sigma2: float = 1.0, test: Moments | None = None
) -> LinearPosterior:
    """Exact posterior with precision ``α`` on every weight."""
    mean, cov = _gaussian_posterior(m, np.full(len(m.features), float(alpha)), sigma2)
    return LinearPosterior(m.features, mean, cov, trace=(test.rmse(mean),) if test else ())


def ard_linear_fit(
    m: Moments,
    sigma2: float = 1.0,
    a0: float = 10.0,
    b0: float = 10.0,
    iterations: int = 10,
    test: Moments | None = None,
) -> LinearPosterior:
    """Coordinate ascent with one Gamma precision per weight, on the statistic alone."""
    d = len(m.features)
    a, b = a0, np.full(d, float(b0))
    mean, cov, trace = np.zeros(d), np.eye(d), []
    for _ in range(iterations):
        mean, cov = _gaussian_posterior(m, a / b, sigma2)
        a, b = a0 + 0.5, b0 + 0.5 * (mean**2 + np.diag(cov))
        if test is not None:
            trace.append(test.rmse(mean))
    return LinearPosterior(m.features, mean, cov, a, b, tuple(trace))
