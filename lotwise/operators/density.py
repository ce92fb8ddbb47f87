"""Bivariate normal density as a column expression."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gaussian2:
    mean: tuple[float, float]
    var: tuple[float, float]
    cov: float


def fit_gaussian(df: DataFrame, x: str, y: str) -> Gaussian2:
    """Mean and covariance in one aggregation."""
    r = df.agg(F.avg(x), F.avg(y), F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)).first()
    return Gaussian2((r[0], r[1]), (r[2], r[3]), r[4])


def gaussian_density(x: Column, y: Column, g: Gaussian2) -> Column:
    det = g.var[0] * g.var[1] - g.cov**2
    if det <= 0:
        raise ValueError("covariance is not positive definite")
    u, v = x - F.lit(g.mean[0]), y - F.lit(g.mean[1])
    form = (F.lit(g.var[1]) * u * u - F.lit(2 * g.cov) * u * v + F.lit(g.var[0]) * v * v) / F.lit(det)
    return F.exp(F.lit(-0.5) * form) / F.lit(2 * math.pi * math.sqrt(det))


def density_grid(spark: SparkSession, g: Gaussian2, reach: float = 2.5, step: float = 0.1) -> DataFrame:
    """Density on a square grid in units of deviations: ``(i, j, x, y, density)``.

    Both indices come from one range, so the grid needs no join.
    """
    n = math.ceil(2 * reach / step - 1e-9)
    cell = spark.range(n * n).select(F.expr(f"id div {n}").alias("i"), (F.col("id") % n).alias("j"))
    at = lambda c, k: F.lit(g.mean[k]) + (F.lit(-reach) + F.lit(step) * F.col(c)) * F.lit(math.sqrt(g.var[k]))
    points = cell.select("i", "j", at("i", 0).alias("x"), at("j", 1).alias("y"))
    return points.withColumn("density", gaussian_density(F.col("x"), F.col("y"), g))
