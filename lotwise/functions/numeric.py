"""Column expressions for links, bands, dot products and grids."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def softplus_link(x: Column) -> Column:
    """The price link of the latent-factor model: softplus plus one."""
    return softplus(x) + F.lit(1.0)


def linear(features: Sequence[str], weights: Sequence[float], bias: float = 0.0) -> Column:
    """Unrolled dot product; stays inside generated code."""
    total = F.lit(float(bias))
    for name, weight in zip(features, weights, strict=True):
        total = total + F.col(name) * F.lit(float(weight))
    return total


def band(mean: Column, sd: Column, k: float = 2.0, link=None) -> tuple[Column, Column]:
    """``mean ± k·sd``, mapped back through ``link`` when given."""
    lower, upper = mean - F.lit(k) * sd, mean + F.lit(k) * sd
    return (link(lower), link(upper)) if link else (lower, upper)


def residual(truth: str, pred: str) -> Column:
    return F.col(truth) - F.col(pred)


def assemble(features: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in features])


def linspace(spark: SparkSession, start: float, stop: float, n: int, name: str = "x") -> DataFrame:
    """``n`` evenly spaced values, both ends included: ``(i, name)``."""
    step = (stop - start) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(
        F.col("id").alias("i"), (F.lit(float(start)) + F.col("id") * F.lit(step)).alias(name)
    )


def arange(spark: SparkSession, start: float, stop: float, step: float, name: str = "x") -> DataFrame:
    """Values ``start, start + step, …`` below ``stop``: ``(i, name)``."""
    n = max(0, math.ceil((stop - start) / step - 1e-9))
    return spark.range(n).select(
        F.col("id").alias("i"), (F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias(name)
    )
