"""Kernel values between the rows of a table and a bounded set of points, or between all near pairs of two large tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.kernels import Kernel


def pairwise_kernel(
    df: DataFrame,
    cols: Sequence[str],
    points: DataFrame,
    point_cols: Sequence[str],
    point_id: str,
    kernel: Kernel,
    most: int = 10_000,
) -> DataFrame:
    """Kernel of every row with every point of a bounded set, long form: adds ``(point_id, k)``.

    The set (inducing points, group centres) becomes an array literal inside the projection, so
    there is no join and no shuffle. A set above ``most`` points is an error: of two large tables
    only near pairs can be written out, by ``near_pairs``.
    """
    rows = points.select(point_id, *point_cols).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} points; use near_pairs, or the sparse Gaussian-process sums")
    kind = points.schema[point_id].dataType
    literal = F.array(
        *[
            F.struct(F.lit(r[0]).cast(kind).alias(point_id), *[F.lit(float(r[c])).alias(f"_{c}") for c in point_cols])
            for r in rows
        ]
    )
    pairs = df.select("*", F.inline(literal))
    value = kernel([F.col(c) for c in cols], [F.col(f"_{c}") for c in point_cols])
    return pairs.withColumn("k", value).drop(*[f"_{c}" for c in point_cols])


def reach_of(l: float, rounding: float = 2.0**-53) -> float:
    """The distance beyond which ``exp(-l · distance²)`` is below ``rounding``."""
    return math.sqrt(-math.log(rounding) / l)


def near_pairs(
    df: DataFrame, cols: Sequence[str], points: DataFrame, point_cols: Sequence[str], kernel: Kernel, reach: float
) -> DataFrame:
    """Kernel of all pairs of a row and a point at most ``reach`` apart: the columns of both sides, and ``k``.

    Both sides may have any size. Space is cut into cells as wide as the reach; a point is sent to its own and the
    neighbouring cells (3 to the power of the dimensions), where an ordinary equi-join meets it with the rows of that cell, so every
    near pair is found exactly once and far ones are never made. Crowded cells are split like any hot key of a
    join. For a kernel that vanishes beyond the reach (see ``reach_of``) the missing pairs are zeros. Rows and points with an
    unknown coordinate are near to nothing. The two sides' columns must have different names.
    """
    if reach <= 0:
        raise ValueError("the reach is positive")
    if shared := {c.lower() for c in df.columns} & {c.lower() for c in points.columns}:
        raise ValueError(f"both sides have {sorted(shared)}")
    cells = [f"__cell{i}" for i in range(len(cols))]
    place = lambda c: F.floor(F.col(f"`{c}`").cast("double") / F.lit(float(reach)))
    known = lambda names: reduce(and_, [F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double")) for c in names])
    rows = df.where(known(cols)).withColumns({cell: place(c) for cell, c in zip(cells, cols, strict=True)})
    spread = points.where(known(point_cols))
    for cell, c in zip(cells, point_cols, strict=True):
        at = place(c)
        spread = spread.select("*", F.explode(F.array(at - 1, at, at + 1)).alias(cell))
    gaps = [F.col(f"`{a}`") - F.col(f"`{b}`") for a, b in zip(cols, point_cols, strict=True)]
    met = rows.join(spread, cells).where(reduce(add, [g * g for g in gaps]) <= float(reach) ** 2)
    value = kernel([F.col(f"`{c}`") for c in cols], [F.col(f"`{c}`") for c in point_cols])
    return met.withColumn("k", value).drop(*cells)
