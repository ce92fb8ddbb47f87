"""Ridge with a one-hot category of any number of levels, and no column per level.

A row has a one in a single level, so the level block of the normal equations is diagonal. It is eliminated inside
Spark: one aggregate per level (counts, means, scatter within the level), then sums over the levels. Only the D×D
system of the other features reaches the driver; the weights of the levels stay a table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.operators.linear import LinearModel
from lotwise.operators.lookup import lookup
from lotwise.session import settle, stage


@dataclass(frozen=True)
class LevelSums:
    """``table`` has ``key, n``, the means ``m0…`` of features and target, and their scatters ``s0_0…`` within the level."""

    features: tuple[str, ...]
    target: str
    key: str
    table: DataFrame


def level_sums(df: DataFrame, features: Sequence[str], target: str, key: str) -> LevelSums:
    """One pass over the rows, added up map-side, so that a hot level is a row per task.

    Rows with a NULL feature or target are left out. Rows with a NULL key are kept: they have no level.
    """
    names = [*features, target]
    rows = df.select(F.col(key).alias("key"), *[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    rows = rows.dropna(subset=[f"v{i}" for i in range(len(names))])
    n = F.count(F.lit(1))
    means = [F.avg(f"v{i}").alias(f"m{i}") for i in range(len(names))]
    scatter = [(F.covar_pop(f"v{i}", f"v{j}") * n).alias(f"s{i}_{j}") for i in range(len(names)) for j in range(i + 1)]
    table = rows.groupBy("key").agg(n.alias("n"), *means, *scatter)
    return LevelSums(tuple(features), target, key, stage(table.withColumnRenamed("key", key), "levels"))


@dataclass(frozen=True)
class LevelRidge:
    """``weights`` is ``(key, n, weight)``, one row per level."""

    model: LinearModel
    key: str
    weights: DataFrame

    def predict(self, df: DataFrame, name: str = "pred") -> DataFrame:
        """NULL and unseen levels count as zeros in every one-hot column."""
        own = max(df.columns, key=len) + "_weight"  # longer than any name of the rows
        scored = lookup(df, self.weights.select(self.key, F.col("weight").alias(own)), [self.key])
        pred = self.model.column() + F.coalesce(F.col(f"`{own}`"), F.lit(0.0))
        return scored.select(*[F.col(f"`{c}`") for c in df.columns if c != name], pred.alias(name))


def _pull(key: Column, alpha: float) -> Column:
    """What is left of a level's count once its own weight is eliminated; rows without a level keep all of theirs."""
    return F.when(key.isNull(), F.col("n")).otherwise(F.col("n") * F.lit(alpha) / (F.col("n") + F.lit(alpha)))


def ridge_fit(sums: LevelSums, alpha: float = 1.0) -> LevelRidge:
    """``α`` weighs the squares of all weights, those of the levels too; the intercept is free.

    The same sums serve any number of ``α``. A level's weight is ``n/(n+α)`` of the mean residual of its rows.
    """
    if not alpha > 0:
        raise ValueError("alpha must be positive: without it intercept and levels are not determined")
    d = len(sums.features)
    pull = _pull(F.col(sums.key), alpha)
    table = sums.table.withColumn("_pull", pull)
    first = table.agg(F.sum("_pull").alias("total"), *[F.sum(F.col("_pull") * F.col(f"m{i}")).alias(f"m{i}") for i in range(d + 1)]).first()
    if not first["total"]:
        raise ValueError("no complete rows to fit on")
    mean = np.array([first[f"m{i}"] for i in range(d + 1)]) / first["total"]
    off = [F.col(f"m{i}") - F.lit(float(mean[i])) for i in range(d + 1)]
    cells = [(i, j) for i in range(d + 1) for j in range(i + 1)]
    got = table.agg(*[F.sum(F.col(f"s{i}_{j}") + F.col("_pull") * off[i] * off[j]).alias(f"s{i}_{j}") for i, j in cells]).first()
    matrix = np.zeros((d + 1, d + 1))
    for i, j in cells:
        matrix[i, j] = matrix[j, i] = got[f"s{i}_{j}"]
    weights = np.linalg.solve(matrix[:-1, :-1] + alpha * np.eye(d), matrix[:-1, -1])
    intercept = float(mean[-1] - weights @ mean[:-1])
    left = F.col(f"m{d}") - F.lit(intercept)
    for i, w in enumerate(weights):
        left = left - F.lit(float(w)) * F.col(f"m{i}")
    known = sums.table.where(F.col(sums.key).isNotNull())
    found = known.select(sums.key, "n", (F.col("n") / (F.col("n") + F.lit(alpha)) * left).alias("weight"))
    return LevelRidge(LinearModel(sums.features, weights, intercept), sums.key, settle(found))
