"""Lookups against fitted tables: a left join whose miss is NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, fitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on one or more keys; every row of ``df`` comes out once.

    ``fitted`` should be settled (see ``session.settle``): the join is broadcast only if its
    measured size is small, and is a skew-split shuffle join otherwise.
    """
    return df.join(fitted, list(keys), "left")


def group_means(df: DataFrame, keys: Sequence[str], target: str, name: str = "mean") -> DataFrame:
    """Mean of ``target`` per key; NULL keys drop out as in a pandas group-by."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.avg(target).alias(name))


def column_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in cols])
