"""One exact Gaussian process per group, on one input.

Repeated inputs of a group are first folded into cells ``(x, n, mean y, scatter)``, which leaves
every result unchanged. A group can then be solved from its cells, or from the squared-exponential
kernel's power series around the group's centre: ``exp(-l (x-x')²) = Σ_n φ_n(x) φ_n(x')``, ``φ_n(x) = sqrt((2l)^n / n!) d^n exp(-l d²)``. The
series is cut where the rest is below rounding, so the posterior needs only ``Σ φφ'`` and
``Σ φy`` — sums that Spark adds up across tasks. Both are exact to rounding; each group and parameter
takes the one with the smaller system, as many unknowns as it has cells or terms. So a group's cost follows
its own range and cells, and no other group's. Rows of a large group are never gathered.

Parameters of a group are ``theta = (log l, log variance, log noise variance)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import lgamma, log

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.operators.ascent import QUIET_STEPS, TOLERANCE, NotConverged, ascents
from lotwise.operators.blocks import CHUNK
from lotwise.session import stage, settle

TEST_ROWS_PER_TASK = 20_000
# Cells of a group that one task sums.
CELLS_PER_TASK = 50_000
# Small groups of as many cells are solved side by side: at most so many, and so many entries of their matrices.
STACK_GROUPS, STACK_ENTRIES = 4096, 1 << 18


# --- likelihood and its gradient --------------------------------------------------------------


def dense_likelihood(x, n, ybar, ss, theta) -> tuple[float, np.ndarray]:
    """Log marginal likelihood of one group's cells and its gradient in ``theta``."""
    l, v, s = np.exp(theta)
    square = (x[:, None] - x[None, :]) ** 2
    k = v * np.exp(-l * square)
    low = np.linalg.cholesky(k + np.diag(s / n))
    half = np.linalg.solve(low, np.eye(len(x)))
    inv = half.T @ half
    alpha = inv @ ybar
    value = -0.5 * ybar @ alpha - np.log(np.diag(low)).sum() - 0.5 * n.sum() * np.log(2 * np.pi)
    value += (-0.5 * (n - 1) * np.log(s) - 0.5 * np.log(n) - 0.5 * ss / s).sum()
    g = 0.5 * (np.outer(alpha, alpha) - inv)
    in_s = (np.diag(g) / n).sum() + (-0.5 * (n - 1) / s + 0.5 * ss / s**2).sum()
    return float(value), np.array([-(g * k * square).sum() * l, (g * k).sum(), in_s * s])


def _lower(matrices: np.ndarray) -> np.ndarray:
    """Cholesky factors of a stack; NaN where there is none."""
    try:
        return np.linalg.cholesky(matrices)
    except np.linalg.LinAlgError:
        if len(matrices) == 1:
            return np.full_like(matrices, np.nan)
        middle = len(matrices) // 2
        return np.concatenate([_lower(matrices[:middle]), _lower(matrices[middle:])])


def _half_inverses(low: np.ndarray) -> np.ndarray:
    return np.linalg.solve(low, np.broadcast_to(np.eye(low.shape[-1]), low.shape))


def dense_likelihoods(x, n, ybar, ss, theta) -> tuple[np.ndarray, np.ndarray]:
    """``dense_likelihood`` of groups of as many cells, one row each; NaN where a system has no Cholesky factor."""
    l, v, s = (np.exp(theta[:, [i]]) for i in range(3))
    square = (x[:, :, None] - x[:, None, :]) ** 2
    k = v[:, :, None] * np.exp(-l[:, :, None] * square)
    noisy = k.copy()
    np.einsum("gii->gi", noisy)[...] += s / n
    low = _lower(noisy)
    known = np.isfinite(low).all((1, 2))
    half = _half_inverses(np.where(known[:, None, None], low, np.eye(x.shape[1])))
    inv = half.transpose(0, 2, 1) @ half
    alpha = (inv @ ybar[:, :, None])[:, :, 0]
    value = -0.5 * (ybar * alpha).sum(1) - np.log(np.einsum("gii->gi", low)).sum(1) - 0.5 * n.sum(1) * np.log(2 * np.pi)
    value += (-0.5 * (n - 1) * np.log(s) - 0.5 * np.log(n) - 0.5 * ss / s).sum(1)
    g = 0.5 * (alpha[:, :, None] * alpha[:, None, :] - inv)
    in_s = (np.einsum("gii->gi", g) / n).sum(1) + (-0.5 * (n - 1) / s + 0.5 * ss / s**2).sum(1)
    grad = np.column_stack([-(g * k * square).sum((1, 2)) * l[:, 0], (g * k).sum((1, 2)), in_s * s[:, 0]])
    return np.where(known, value, np.nan), np.where(known[:, None], grad, np.nan)


def series(x: np.ndarray, centre, l, terms: int) -> np.ndarray:
    """The first ``terms`` features of the kernel's power series, one row per input."""
    d = np.asarray(x - centre, dtype=float)
    l = np.broadcast_to(np.asarray(l, dtype=float), d.shape)
    order = np.arange(terms)
    scale = np.array([lgamma(i + 1) for i in order])
    with np.errstate(divide="ignore"):
        size = np.log(np.abs(d))[:, None]
    power = np.where(order == 0, 0.0, order * np.maximum(size, -700.0))
    value = np.exp(0.5 * (order * np.log(2 * l)[:, None] - scale) + power - (l * d**2)[:, None])
    return value * np.where(d[:, None] < 0, (-1.0) ** order, 1.0)


def terms_needed(rate: float, rest: float = 1e-18) -> int:
    """Number of terms after which the series' rest, a Poisson tail at ``rate``, is negligible."""
    n = max(2, int(rate) + 2)
    while n * log(max(rate, 1e-300)) - rate - lgamma(n + 1) > log(rest):
        n += 1 + n // 16
    return n


def _terms(rate: Column) -> Column:
    return F.pandas_udf(lambda rates: rates.map(terms_needed), "int")(rate)


def series_likelihood(a, b, yy, n, theta) -> tuple[float, np.ndarray]:
    """As ``dense_likelihood`` from the sums of a group; ``a`` and ``b`` hold two extra terms for
    the derivative in l, which maps term n to terms n and n + 2."""
    l, v, s = np.exp(theta)
    r = len(b) - 2
    order = np.arange(r)
    turn = np.zeros((r, r + 2))
    turn[order, order] = order / (2 * l)
    turn[order, order + 2] = -np.sqrt((order + 1.0) * (order + 2.0)) / (2 * l)
    in_a, in_b = turn @ a[:, :r], turn @ b
    in_a, a, b = in_a + in_a.T, a[:r, :r], b[:r]
    m = v * a + s * np.eye(r)
    low = np.linalg.cholesky(m)
    half = np.linalg.solve(low, np.eye(r))
    inv = half.T @ half
    c = inv @ b
    left = yy - v * (b @ c)
    logdet = 2 * np.log(np.diag(low)).sum() + (n - r) * np.log(s)
    value = -0.5 * left / s - 0.5 * logdet - 0.5 * n * np.log(2 * np.pi)
    in_l = -0.5 * v * (inv * in_a).sum() + 0.5 * (2 * v * (in_b @ c) - v * v * (c @ in_a @ c)) / s
    in_v = -0.5 * (inv * a).sum() + 0.5 * (b @ c - v * (c @ a @ c)) / s
    in_s = -0.5 * (np.trace(inv) + (n - r) / s) + 0.5 * left / s**2 - 0.5 * v * (c @ c) / s
    return float(value), np.array([in_l * l, in_v * v, in_s * s])


# --- cells and series sums --------------------------------------------------------------------


def fold_cells(train: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """One row per distinct input of a group; combined before the shuffle."""
    rows = train.select(F.col(key), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    return rows.groupBy(key, "x").agg(
        F.count("y").cast("double").alias("n"),
        F.avg("y").alias("ybar"),
        (F.var_pop("y") * F.count("y")).alias("ss"),
    )


class Groups:
    """Cells of all groups, and how each group and parameter slot is solved.

    ``dense_upto`` forces groups of so many cells to be solved densely and all others as series.
    """

    def __init__(self, train: DataFrame, key: str, x: str, y: str, dense_upto: int | None = None):
        self.key = key
        self.cells = stage(fold_cells(train, key, x, y))
        self.sizes = settle(
            self.cells.groupBy(key).agg(
                F.count("x").alias("m"), ((F.min("x") + F.max("x")) / 2).alias("c"),
                ((F.max("x") - F.min("x")) / 2).alias("r"),
            )
        )
        self.dense_upto = dense_upto
        self.key_type = train.schema[key].dataType.simpleString()
        self.keys = self.sizes.select(key)

    def ways(self, theta: DataFrame) -> DataFrame:
        """``(key, slot, theta, m, c, terms, dense)`` for every group and parameter slot."""
        rate = 2 * F.exp(F.col("theta")[0]) * F.col("r") * F.col("r")
        known = self.sizes.join(theta.where("theta is not null").select(self.key, "slot", "theta"), self.key).withColumn("terms", _terms(rate))
        dense = F.col("m") <= (F.col("terms") if self.dense_upto is None else F.lit(self.dense_upto))
        return settle(known.select(self.key, "slot", "theta", "m", "c", "terms", dense.alias("dense")))

    def dense_cells(self, ways: DataFrame) -> DataFrame:
        """Cells beside the parameters of the slots that are solved densely."""
        return self.cells.join(ways.where("dense").select(self.key, "slot", "theta"), self.key)

    def stacked_cells(self, ways: DataFrame) -> DataFrame:
        """The same, whole groups in a task and those of as many cells together, as ``_stacks`` takes them."""
        wanted = ways.where("dense").select(self.key, "slot", "theta", "m")
        rows = self.cells.join(wanted, self.key).repartition(self.key, "slot").sortWithinPartitions("m", self.key, "slot", "x")
        return rows.select(self.key, "slot", "theta", "m", "x", "n", "ybar", "ss")

    def series_sums(self, ways: DataFrame) -> DataFrame:
        """``(key, slot, chunk, part, theta, c)``: sums of every group and slot solved as a series, in chunks.

        Rows arrive sorted by group, so a task holds one group's sums at a time; large groups are
        spread over tasks.
        """
        key = self.key
        wanted = ways.where(~F.col("dense"))

        def fold(batches):
            at, total = None, None

            def chunks():
                parts = [total[i : i + CHUNK] for i in range(0, len(total), CHUNK)]
                return pd.DataFrame({key: at[0], "slot": at[1], "chunk": range(len(parts)), "part": parts})

            for batch in batches:
                for group, rows in batch.groupby([key, "slot"], sort=False):
                    if group != at:
                        if at is not None:
                            yield chunks()
                        at, total = group, None
                    x, n, ybar, ss = (rows[c].to_numpy(dtype=float) for c in ("x", "n", "ybar", "ss"))
                    phi = series(x, rows["c"].iloc[0], np.exp(rows["theta"].iloc[0][0]), int(rows["terms"].iloc[0]) + 2)
                    sums = np.concatenate(
                        [(phi.T @ (phi * n[:, None])).ravel(), phi.T @ (n * ybar), [(n * ybar**2 + ss).sum(), n.sum()]]
                    )
                    total = sums if total is None else total + sums
            if at is not None:
                yield chunks()

        spread = F.ceil(F.col("m") / CELLS_PER_TASK).cast("int")
        rows = self.cells.join(wanted, key).withColumn("_salt", F.pmod(F.xxhash64("x"), spread))
        sorted_rows = rows.repartition(key, "slot", "_salt").sortWithinPartitions(key, "slot")
        partial = sorted_rows.select(key, "slot", "theta", "c", "terms", "x", "n", "ybar", "ss").mapInPandas(
            fold, f"`{key}` {self.key_type}, slot int, chunk int, part array<double>"
        )
        summed = partial.groupBy(key, "slot", "chunk").agg(Summarizer.sum(array_to_vector("part")).alias("part"))
        flat = summed.select(key, "slot", "chunk", vector_to_array("part").alias("part"))
        return flat.join(wanted.select(key, "slot", "theta", "c"), [key, "slot"])


def _stacks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, list[np.ndarray]]]:
    """Groups of as many cells: the first row of each, their parameters, and their ``x, n, ybar, ss``, one row a group."""
    held: list[pd.DataFrame] = []

    def stacks(m: int, end: bool):
        most = m * max(1, min(STACK_GROUPS, STACK_ENTRIES // m**2))
        if not held or not (end or sum(map(len, held)) >= most):
            return
        rows = pd.concat(held, ignore_index=True)
        stop = len(rows) if end else len(rows) // most * most
        held[:] = [rows.iloc[stop:]] if stop < len(rows) else []
        for i in range(0, stop, most):
            part = rows.iloc[i : min(i + most, stop)]
            first = part.iloc[::m]
            cells = [part[c].to_numpy(dtype=float).reshape(-1, m) for c in ("x", "n", "ybar", "ss")]
            yield first, np.stack(first["theta"].to_list()).astype(float), cells

    at = None
    for batch in batches:
        for m, rows in batch.groupby("m", sort=False):
            if at is not None and m != at:
                yield from stacks(at, True)
            at = int(m)
            held.append(rows)
            yield from stacks(at, False)
    if at is not None:
        yield from stacks(at, True)


def _unpack_sums(rows: pd.DataFrame):
    flat = np.concatenate(list(rows.sort_values("chunk")["part"]))
    r = int(np.sqrt(len(flat) - 2 + 0.25) - 0.5 + 1e-9)  # r² + r + 2 numbers
    return flat[: r * r].reshape(r, r), flat[r * r : r * r + r], float(flat[-2]), float(flat[-1])


def _or_none(likelihood, *args):
    """NULL where the system has no Cholesky factor: such parameters are never better than others."""
    try:
        value, grad = likelihood(*args)
    except np.linalg.LinAlgError:
        return None, None
    return (value, grad) if np.isfinite(value) and np.isfinite(grad).all() else (None, None)


def likelihoods(groups: Groups, theta: DataFrame) -> DataFrame:
    """``(key, slot, theta, lml, grad)`` for every group and parameter slot of ``theta``."""
    key = groups.key
    schema = f"`{key}` {groups.key_type}, slot int, theta array<double>, lml double, grad array<double>"

    def dense(rows: pd.DataFrame) -> pd.DataFrame:
        cell = [rows[c].to_numpy(dtype=float) for c in ("x", "n", "ybar", "ss")]
        at = np.array(rows["theta"].iloc[0])
        value, grad = _or_none(dense_likelihood, *cell, at)
        return pd.DataFrame([(rows[key].iloc[0], rows["slot"].iloc[0], at, value, grad)], columns=[key, "slot", "theta", "lml", "grad"])

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        at = np.array(rows["theta"].iloc[0])
        value, grad = _or_none(series_likelihood, *_unpack_sums(rows), at)
        return pd.DataFrame([(rows[key].iloc[0], rows["slot"].iloc[0], at, value, grad)], columns=[key, "slot", "theta", "lml", "grad"])

    ways = groups.ways(theta)
    out = groups.dense_cells(ways).groupBy(key, "slot").applyInPandas(dense, schema)
    if not ways.where(~F.col("dense")).isEmpty():
        out = out.unionByName(groups.series_sums(ways).groupBy(key, "slot").applyInPandas(summed, schema))
    return out


def constant_theta(groups: Groups, thetas: Sequence[Sequence[float]]) -> DataFrame:
    """Every group with the same few parameter slots: ``(key, slot, theta)``."""
    slots = F.array(
        *[
            F.struct(F.lit(i).alias("slot"), F.array(*[F.lit(float(v)) for v in t]).alias("theta"))
            for i, t in enumerate(thetas)
        ]
    )
    return groups.keys.select(groups.key, F.inline(slots))


def likelihood_grid(
    train: DataFrame, key: str, x: str, y: str, lengths: Sequence[float], sigma: float = 0.1, dense_upto: int | None = None
) -> DataFrame:
    """Log marginal likelihood and its derivative in l per group and candidate l: ``(key, l, lml, gradient)``."""
    groups = Groups(train, key, x, y, dense_upto)
    found = likelihoods(groups, constant_theta(groups, [(log(v), 0.0, 2 * log(sigma)) for v in lengths]))
    l = F.exp(F.col("theta")[0])
    return found.select(key, F.round(l, 12).alias("l"), "lml", (F.col("grad")[0] / l).alias("gradient"))


def tune(
    groups: Groups, start: Sequence[float], free: Sequence[bool] = (True, False, False), tolerance: float = TOLERANCE, most: int = 500
) -> DataFrame:
    """Ascend the likelihood of every group: ``(key, slot, theta, lml)``.

    A group that is solved from its cells climbs inside its task, by the same ascent as other fits, side by side with
    groups of as many cells; one that does not settle there has NULL parameters and leaves the others alone. Groups that are solved as series need
    new sums for every l, so they climb together, one proposal each a round, in a metric learned from
    the last two points (the step of Barzilai and Borwein); a proposal that does not raise a group's likelihood
    shortens its step. Such a group is done when three accepted steps in a row change its likelihood by
    less than ``tolerance`` of itself, or its step has shrunk to nothing.
    """
    key = groups.key
    mask = np.array([1.0 if f else 0.0 for f in free])
    ways = groups.ways(constant_theta(groups, [start]))

    def climb(batches):
        for first, at, cells in _stacks(batches):

            def objective(step: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                value, grad = dense_likelihoods(*[c[which] for c in cells], at[which] + step * mask)
                return value, grad * mask

            with np.errstate(all="ignore"):
                step, value, ended = ascents(np.zeros_like(at), objective, tolerance, most, first_step=0.5)
            best = [t if e else None for t, e in zip(at + step * mask, ended, strict=True)]
            lml = pd.Series([v if e else None for v, e in zip(value, ended, strict=True)], dtype=object)
            yield pd.DataFrame({key: first[key].to_numpy(), "slot": first["slot"].to_numpy(), "theta": best, "lml": lml})

    schema = f"`{key}` {groups.key_type}, slot int, theta array<double>, lml double"
    alone = stage(groups.stacked_cells(ways).mapInPandas(climb, schema))
    others = ways.where(~F.col("dense")).select(key, "slot", "theta")
    if others.isEmpty():
        return alone
    return alone.unionByName(_climb_together(groups, others, mask.tolist(), tolerance, most))


def _climb_together(groups: Groups, start: DataFrame, mask: Sequence[float], tolerance: float, most: int) -> DataFrame:
    key = groups.key
    first = likelihoods(groups, start)
    best = stage(first.withColumns({"rate": F.lit(None).cast("double"), "shrink": F.lit(1.0), "quiet": F.lit(0)}))
    for _ in range(most):
        moves = (F.col("quiet") < QUIET_STEPS) & (F.col("shrink") > 1e-6)
        moving = best.where(moves)
        if moving.isEmpty():
            return best.select(key, "slot", "theta", "lml")
        slope = [F.lit(m) * F.col("grad")[i] for i, m in enumerate(mask)]
        size = F.greatest(*[F.abs(g) for g in slope], F.lit(1e-12))
        # At most one unit of the logarithms at a time.
        step = F.col("shrink") * F.least(F.coalesce("rate", F.lit(0.5) / size), F.lit(1.0) / size)
        moved = F.array(*[F.col("theta")[i] + step * g for i, g in enumerate(slope)])
        tried = likelihoods(groups, moving.select(key, "slot", moved.alias("theta"))).select(
            key, F.col("theta").alias("new_theta"), F.col("lml").alias("new_lml"), F.col("grad").alias("new_grad")
        )
        better = F.coalesce(F.col("new_lml") >= F.col("lml"), F.lit(False))
        pick = lambda c: F.when(better, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
        way = [F.col("new_theta")[i] - F.col("theta")[i] for i in range(len(mask))]
        turn = [F.lit(m) * (F.col("grad")[i] - F.col("new_grad")[i]) for i, m in enumerate(mask)]
        bend = sum((w * t for w, t in zip(way, turn, strict=True)), F.lit(0.0))
        rate = F.when(bend > 0, sum((w * w for w in way), F.lit(0.0)) / bend)
        change = F.abs(F.col("new_lml") - F.col("lml")) / F.greatest(F.abs("lml"), F.abs("new_lml"), F.lit(1e-300))
        best = stage(
            best.join(tried, key, "left").select(
                key, "slot", pick("theta"), pick("lml"), pick("grad"),
                F.when(better, rate).otherwise(F.col("rate")).alias("rate"),
                F.when(better, F.lit(1.0)).when(moves, F.col("shrink") / 2).otherwise(F.col("shrink")).alias("shrink"),
                F.when(better & (change < tolerance), F.col("quiet") + 1).when(better, 0).otherwise(F.col("quiet")).alias("quiet"),
            )
        )
    raise NotConverged(f"some groups still moved after {most} rounds")


def tune_lengthscale(
    train: DataFrame, key: str, x: str, y: str, sigma: float = 0.1, start: float = 0.5, dense_upto: int | None = None,
) -> DataFrame:
    """Best l per group by marginal likelihood: ``(key, l, lml)``."""
    found = tune(Groups(train, key, x, y, dense_upto), (log(start), 0.0, 2 * log(sigma)))
    return found.select(key, F.exp(F.col("theta")[0]).alias("l"), "lml")


# --- prediction -------------------------------------------------------------------------------


def solutions(groups: Groups, theta: DataFrame) -> DataFrame:
    """Every group solved once: ``(key, theta, c, dense, i, at, weight, form)``, one row per unknown of its system.

    An unknown is a cell at input ``at`` or the i-th term of the series. With φ the kernel between an input and the
    cells, or the features of the series, the mean is ``φ·weight`` and ``form φ`` gives what the variance needs.
    """
    key = groups.key
    names = [key, "theta", "c", "dense", "i", "at", "weight", "form"]
    schema = f"`{key}` {groups.key_type}, theta array<double>, c double, dense boolean, i int, at double, weight double, form array<double>"

    def dense(batches):
        for first, at, (xc, n, ybar, _) in _stacks(batches):
            count, m = xc.shape
            l, v, s = (np.exp(at[:, [i]]) for i in range(3))
            k = v[:, :, None] * np.exp(-l[:, :, None] * (xc[:, :, None] - xc[:, None, :]) ** 2)
            np.einsum("gii->gi", k)[...] += s / n
            half = _half_inverses(np.linalg.cholesky(k))
            weight = half.transpose(0, 2, 1) @ (half @ ybar[:, :, None])
            columns = [list(at.repeat(m, axis=0)), 0.0, True, np.tile(np.arange(m), count), xc.ravel(), weight.ravel(), list(half.reshape(-1, m))]
            yield pd.DataFrame({key: first[key].to_numpy().repeat(m), **dict(zip(names[1:], columns, strict=True))})

    def summed(fit: pd.DataFrame) -> pd.DataFrame:
        a, b, _, _ = _unpack_sums(fit)
        _, v, s = np.exp(np.array(fit["theta"].iloc[0]))
        half = np.linalg.solve(np.linalg.cholesky(v * a + s * np.eye(len(b))), np.eye(len(b)))
        columns = [[fit["theta"].iloc[0]] * len(b), float(fit["c"].iloc[0]), False, range(len(b)), np.zeros(len(b)), half.T @ (half @ (v * b)), list(half)]
        return pd.DataFrame({key: fit[key].iloc[0], **dict(zip(names[1:], columns, strict=True))})

    ways = groups.ways(theta)
    out = groups.stacked_cells(ways).mapInPandas(dense, schema)
    if not ways.where(~F.col("dense")).isEmpty():
        out = out.unionByName(groups.series_sums(ways).groupBy(key).applyInPandas(summed, schema))
    return stage(out, "solutions")


def _scores(theta, c, dense, at, weight, form, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, latent variance and noise variance at ``xs`` from a group's solution, its unknowns in order."""
    l, v, s = np.exp(theta)
    if dense:
        k = v * np.exp(-l * (xs[:, None] - at[None, :]) ** 2)
        return k @ weight, v - ((k @ form.T) ** 2).sum(1), s
    phi = series(xs, c, l, len(weight))
    return phi @ weight, v * (1.0 - (phi**2).sum(1)) + s * v * ((phi @ form.T) ** 2).sum(1), s


def _runs(batches: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator[list[dict[str, np.ndarray]]]:
    """For each batch the runs of equal ``by`` columns that have come to an end, column by column."""
    held: dict[str, list[np.ndarray]] = {}
    whole = lambda: {c: v[0] if len(v) == 1 else np.concatenate(v) for c, v in held.items()}
    differ = lambda a, b: (a != b) & ~((a != a) & (b != b))
    for batch in batches:
        if not len(batch):
            continue
        columns, ended = {c: batch[c].to_numpy() for c in batch}, []
        new = np.ones(len(batch), bool)
        new[1:] = np.any([differ(columns[c][1:], columns[c][:-1]) for c in by], axis=0)
        if held:
            new[0] = any(differ(held[c][-1][-1:], columns[c][:1])[0] for c in by)
        cuts = [*np.flatnonzero(new).tolist(), len(batch)]
        if cuts[0] > 0:
            for c, v in columns.items():
                held[c].append(v[: cuts[0]])
        for i, j in zip(cuts, cuts[1:]):
            if held:
                ended.append(whole())
            held = {c: [v[i:j]] for c, v in columns.items()}
        yield ended
    if held:
        yield [whole()]


def predict(groups: Groups, theta: DataFrame, test: DataFrame, x: str, include_noise: bool = True) -> DataFrame:
    """Posterior mean and variance per test row: adds ``gp_mean, gp_var``; NULL where the group is unknown.

    Every group is solved once. Its distinct test inputs are scored in chunks of bounded size, each next to a
    copy of the solution, and looked up by the rows. ``theta`` holds one parameter slot per group.
    """
    key = groups.key
    points = test.select(F.col(key), F.col(x).cast("double").alias("xs")).dropna().distinct()
    points = stage(points, "test-points")
    chunks = settle(
        points.groupBy(key).agg(F.ceil(F.count("xs") / F.lit(TEST_ROWS_PER_TASK)).cast("int").alias("_chunks"))
    )
    salted = points.join(chunks, key).withColumn("_salt", F.pmod(F.xxhash64("xs"), F.col("_chunks")).cast("int"))
    salted = salted.select(F.col(key).alias(key), F.col("_salt").alias("_salt"), F.col("xs").alias("xs"))
    per_salt = chunks.select(
        F.col(key).alias(key), F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_salt")
    )

    def score(batches):
        for ended in _runs(batches, by):
            parts = []
            for run in ended:
                size = int(np.isnan(run["xs"]).sum())  # the rows of the solution come first
                if 0 < size < len(run["xs"]):
                    fit = [run[c][:size].astype(float) for c in ("at", "weight")]
                    xs = run["xs"][size:]
                    mean, var, noise = _scores(run["theta"][0], run["c"][0], run["dense"][0], *fit, np.stack(run["form"][:size]), xs)
                    parts.append((run[key][size:], xs, mean, np.maximum(var, 0.0) + include_noise * noise))
            if parts:
                yield pd.DataFrame(dict(zip((key, "xs", "gp_mean", "gp_var"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    by = [key, "_salt"]
    solved = solutions(groups, theta).join(per_salt, key).withColumn("xs", F.lit(None).cast("double"))
    both = solved.unionByName(salted, allowMissingColumns=True).repartition(*by).sortWithinPartitions(*by, F.asc_nulls_first("xs"), "i")
    scored = both.mapInPandas(score, f"`{key}` {groups.key_type}, xs double, gp_mean double, gp_var double")
    looked = test.withColumn("xs", F.col(x).cast("double")).join(scored, [key, "xs"], "left")
    return looked.select(*test.columns, "gp_mean", "gp_var")


def grouped_gp(
    train: DataFrame, test: DataFrame, key: str, x: str, y: str, l: float = 0.5, sigma: float = 0.1,
    include_noise: bool = True, dense_upto: int | None = None,
) -> DataFrame:
    """Exact posterior per group for a given l; the variance includes the noise by default."""
    groups = Groups(train, key, x, y, dense_upto)
    return predict(groups, constant_theta(groups, [(log(l), 0.0, 2 * log(sigma))]), test, x, include_noise)


def grouped_variational_gp(
    train: DataFrame, test: DataFrame, key: str, x: str, y: str, dense_upto: int | None = None, tolerance: float = TOLERANCE
) -> DataFrame:
    """Latent posterior per group with lengthscale, variance and noise fitted by the bound.

    With a Gaussian likelihood and all points as inducing points the best Gaussian posterior is the
    exact one and the bound is the marginal likelihood, so no variational parameters are stepped.
    """
    groups = Groups(train, key, x, y, dense_upto)
    theta = tune(groups, (log(0.5), 0.0, 0.0), (True, True, True), tolerance)
    return predict(groups, theta, test, x, include_noise=False)
