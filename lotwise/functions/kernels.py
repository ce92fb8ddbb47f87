"""Covariance functions as column expressions over two points.

A point is a sequence of columns, one per dimension. Kernels add and multiply.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = Sequence[Column]


@dataclass(frozen=True)
class Kernel:
    between: Callable[[Point, Point], Column]

    def __call__(self, a: Point, b: Point) -> Column:
        return self.between(a, b)

    def __add__(self, other: Kernel) -> Kernel:
        return Kernel(lambda a, b: self(a, b) + other(a, b))

    def __mul__(self, other: Kernel) -> Kernel:
        return Kernel(lambda a, b: self(a, b) * other(a, b))


def _total(terms) -> Column:
    return reduce(add, terms)


def squared_exponential(l: float) -> Kernel:
    """``exp(-l · |x - x'|²)``"""
    return Kernel(
        lambda a, b: F.exp(F.lit(-float(l)) * _total((p - q) * (p - q) for p, q in zip(a, b, strict=True)))
    )


def periodic(h: float, l: float, period: float) -> Kernel:
    """``h · exp(-l · Σ sin²(π (x - x') / period))``"""

    def between(a: Point, b: Point) -> Column:
        waves = [F.sin(F.lit(math.pi) * (p - q) / F.lit(float(period))) for p, q in zip(a, b, strict=True)]
        return F.lit(float(h)) * F.exp(F.lit(-float(l)) * _total(w * w for w in waves))

    return Kernel(between)


def white_noise(variance: float) -> Kernel:
    """``variance`` where both points are equal, else 0."""

    def between(a: Point, b: Point) -> Column:
        same = reduce(lambda s, t: s & t, [p == q for p, q in zip(a, b, strict=True)])
        return F.when(same, F.lit(float(variance))).otherwise(F.lit(0.0))

    return Kernel(between)


def rbf(lengthscales: Sequence[float], variance: float = 1.0) -> Kernel:
    """``variance · exp(-½ Σ ((x - x') / lengthscale)²)``, one lengthscale per dimension."""

    def between(a: Point, b: Point) -> Column:
        terms = [
            ((p - q) / F.lit(float(s))) * ((p - q) / F.lit(float(s)))
            for p, q, s in zip(a, b, lengthscales, strict=True)
        ]
        return F.lit(float(variance)) * F.exp(F.lit(-0.5) * _total(terms))

    return Kernel(between)
