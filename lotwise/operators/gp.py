"""Sparse Gaussian-process regression as sums over rows, with an optional learned feature map.

With M inducing points the collapsed bound needs only ``A = Σ k k'``, ``b = Σ k y``, ``Σ y²`` and n
(Titsias 2009; distributed form Gal et al. 2014; deep kernel Wilson et al. 2016). One Spark pass
forms them. The driver solves M×M systems and sends the derivative of the bound in A and b
back for a second pass, which pushes it through the kernel (and the net) row block by row block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions.numeric import band, linspace
from lotwise.operators.ascent import TOLERANCE, NotConverged, ascent, newton, slopes
from lotwise.operators.blocks import sum_blocks
from lotwise.operators.encode import Scaler
from lotwise.operators.evaluate import evaluate
from lotwise.operators.lookup import column_means
from lotwise.operators.sample import hash_bucket
from lotwise.session import stage

Net = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
# A deep kernel's fit ends at this change of the bound, three steps in a row. Its bound has no sharp end: the net has hundreds of
# weights, and each hundred further steps gain about a thousandth of the bound by learning the noise of the rows.
DEEP_TOLERANCE = 2e-5


# Rows of a block that are worked on at a time: their kernel matrix stays in a core's cache.
PIECE = 512


# --- kernel and feature map on row blocks ---------------------------------------------------


def _pieces(block: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(0, max(len(block), 1), PIECE):
        yield block[i : i + PIECE]


def _scratch(block: np.ndarray, width: int) -> np.ndarray:
    """Room for a piece's matrix, made once a block: fresh memory for every piece costs more than filling it."""
    return np.empty((min(PIECE, len(block)), width))


def rbf_block(x: np.ndarray, z: np.ndarray, scale: np.ndarray, variance: float, out: np.ndarray | None = None) -> np.ndarray:
    xs, zs, top = x / scale, z / scale, np.log(variance)
    # The exponent as one product, worked on in place.
    left = np.column_stack([xs, -0.5 * (xs**2).sum(1), np.ones(len(xs))])
    right = np.column_stack([zs, np.ones(len(zs)), top - 0.5 * (zs**2).sum(1)])
    k = np.matmul(left, right.T, out=out)
    np.minimum(k, top, out=k)
    return np.exp(k, out=k)


def rbf_backward(g, k, x, z, scale, variance):
    """Push ``g = ∂L/∂k`` through the kernel: gradients in scale, variance, x and z. ``g`` is overwritten."""
    e = np.multiply(g, k, out=g)
    # The sums along rows and columns come with the products.
    near, far = e @ np.column_stack([z, np.ones(len(z))]), e.T @ np.column_stack([x, np.ones(len(x))])
    near, row, far, col = near[:, :-1], near[:, -1], far[:, :-1], far[:, -1]
    in_scale = ((row @ x**2) + (col @ z**2) - 2 * np.einsum("nd,nd->d", x, near)) / scale**3
    in_x = (near - row[:, None] * x) / scale**2
    in_z = (far - col[:, None] * z) / scale**2
    return in_scale, row.sum() / variance, in_x, in_z


def net_forward(x: np.ndarray, net: Net | None) -> np.ndarray:
    """Two linear layers with a rectifier between; without a net the input itself."""
    if net is None:
        return x
    w1, b1, w2, b2 = net
    return np.maximum(x @ w1 + b1, 0.0) @ w2 + b2


def net_backward(g: np.ndarray, x: np.ndarray, net: Net) -> np.ndarray:
    """Gradient in all net weights, flattened in the order of ``Net``."""
    w1, b1, w2, _ = net
    hidden = np.maximum(x @ w1 + b1, 0.0)
    back = (g @ w2.T) * (hidden > 0)
    return np.concatenate([(x.T @ back).ravel(), back.sum(0), (hidden.T @ g).ravel(), g.sum(0)])


def init_net(n_in: int, hidden: int = 32, n_out: int | None = None, seed: int = 0) -> Net:
    rng = np.random.default_rng(seed)
    n_out = n_out or n_in
    u = lambda fan, *shape: rng.uniform(-1, 1, shape) / np.sqrt(fan)
    return u(n_in, n_in, hidden), u(n_in, hidden), u(hidden, hidden, n_out), u(hidden, n_out)


# --- the model ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Hyper:
    """Kernel, noise and inducing points; ``net`` makes the kernel a deep one."""

    scale: np.ndarray
    variance: float
    noise: float  # variance of the Gaussian likelihood
    z: np.ndarray
    jitter: float = 0.1
    net: Net | None = None

    def pack(self, learn_inducing: bool) -> np.ndarray:
        parts = [np.log(self.scale), [np.log(self.variance), np.log(self.noise)]]
        if learn_inducing:
            parts.append(self.z.ravel())
        if self.net is not None:
            parts += [w.ravel() for w in self.net]
        return np.concatenate(parts)

    def unpack(self, theta: np.ndarray, learn_inducing: bool) -> Hyper:
        d, at = len(self.scale), len(self.scale) + 2
        z, net = self.z, self.net
        if learn_inducing:
            z = theta[at : at + z.size].reshape(z.shape)
            at += z.size
        if net is not None:
            weights = []
            for w in net:
                weights.append(theta[at : at + w.size].reshape(w.shape))
                at += w.size
            net = tuple(weights)
        return replace(
            self, scale=np.exp(theta[:d]), variance=float(np.exp(theta[d])), noise=float(np.exp(theta[d + 1])), z=z, net=net
        )

    def kernel(self, x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        return rbf_block(net_forward(x, self.net), net_forward(self.z, self.net), self.scale, self.variance, out)

    def kuu(self) -> np.ndarray:
        return self.kernel(self.z) + self.jitter * np.eye(len(self.z))


@dataclass(frozen=True)
class RowSums:
    a: np.ndarray
    b: np.ndarray
    yy: float
    n: float


def _sum_block(block: np.ndarray, h: Hyper) -> np.ndarray:
    m = len(h.z)
    a, b, y, room = np.zeros((m, m)), np.zeros(m), block[:, -1], _scratch(block, m)
    for rows in _pieces(block):
        k = h.kernel(rows[:, :-1], room[: len(rows)])
        a += k.T @ k
        b += k.T @ rows[:, -1]
    return np.concatenate([a.ravel(), b, [y @ y, len(y)]])


def row_sums(df: DataFrame, features: Sequence[str], target: str, h: Hyper) -> RowSums:
    return _unpacked(sum_blocks(df, [*features, target], _width(h), _sum_block, h), h)


def _width(h: Hyper) -> int:
    return len(h.z) ** 2 + len(h.z) + 2


def _unpacked(flat: np.ndarray, h: Hyper) -> RowSums:
    m = len(h.z)
    return RowSums(flat[: m * m].reshape(m, m), flat[m * m : -2], float(flat[-2]), float(flat[-1]))


def _inverse(matrix: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse and log-determinant of a positive-definite matrix by Cholesky."""
    low = np.linalg.cholesky(matrix)
    half = np.linalg.solve(low, np.eye(len(matrix)))
    return half.T @ half, 2 * float(np.log(np.diag(low)).sum())


def collapsed_bound(s: RowSums, h: Hyper) -> tuple[float, dict]:
    """The bound and its derivatives in A, b, Kuu, kernel variance (diagonal term) and noise."""
    kuu_inv, kuu_logdet = _inverse(h.kuu())
    b_inv, b_logdet = _inverse(h.kuu() + s.a / h.noise)
    c, v = b_inv @ s.b, h.noise
    trace = float((kuu_inv * s.a).sum())
    value = (
        -0.5 * s.n * np.log(2 * np.pi)
        - 0.5 * (b_logdet - kuu_logdet + s.n * np.log(v))
        - 0.5 * (s.yy / v - s.b @ c / v**2)
        - 0.5 * (s.n * h.variance - trace) / v
    )
    cc = np.outer(c, c)
    grads = {
        "a": -0.5 * b_inv / v - 0.5 * cc / v**3 + 0.5 * kuu_inv / v,
        "b": c / v**2,
        "kuu": -0.5 * b_inv + 0.5 * kuu_inv - 0.5 * cc / v**2 - 0.5 * kuu_inv @ s.a @ kuu_inv / v,
        "variance": -0.5 * s.n / v,
        "noise": 0.5 * float((b_inv * s.a).sum()) / v**2
        - 0.5 * s.n / v
        + 0.5 * s.yy / v**2
        - s.b @ c / v**3
        + 0.5 * c @ s.a @ c / v**4
        + 0.5 * (s.n * h.variance - trace) / v**2,
    }
    return float(value), grads


def _push_back(g: np.ndarray, k: np.ndarray, x: np.ndarray, px: np.ndarray, pz: np.ndarray, h: Hyper) -> np.ndarray:
    """``∂L/∂k(x, z)`` to gradients in scale, variance, z and net, one flat vector."""
    in_scale, in_variance, in_px, in_pz = rbf_backward(g, k, px, pz, h.scale, h.variance)
    if h.net is None:
        return np.concatenate([in_scale, [in_variance], in_pz.ravel()])
    return np.concatenate([in_scale, [in_variance], in_pz.ravel(), net_backward(in_px, x, h.net)])


def _gradient_block(block: np.ndarray, payload) -> np.ndarray:
    h, in_a, in_b = payload
    # The part in b rides along in the product as one more column of k.
    both, pz, total, m = np.vstack([2 * in_a, in_b]), net_forward(h.z, h.net), 0.0, len(h.z)
    room, slopes_room = _scratch(block, m + 1), _scratch(block, m)
    for rows in _pieces(block):
        x, n = rows[:, :-1], len(rows)
        px = net_forward(x, h.net)
        k = rbf_block(px, pz, h.scale, h.variance, room[:n, :m])
        room[:n, m] = rows[:, -1]
        g = np.matmul(room[:n], both, out=slopes_room[:n])
        total = total + _push_back(g, k, x, px, pz, h)
    return total


def bound_then_gradient(
    df: DataFrame, features: Sequence[str], target: str, h: Hyper, learn_inducing: bool
) -> tuple[float, Callable[[], np.ndarray]]:
    """The bound, from one pass over the rows, and what gives its gradient in ``h.pack(...)`` by another one."""
    value, grads = collapsed_bound(row_sums(df, features, target, h), h)
    return value, lambda: _gradient(df, features, target, h, grads, learn_inducing)


def bound_and_gradient(
    df: DataFrame, features: Sequence[str], target: str, h: Hyper, learn_inducing: bool
) -> tuple[float, np.ndarray]:
    """Bound and its gradient in ``h.pack(...)``; two passes over the rows."""
    value, gradient = bound_then_gradient(df, features, target, h, learn_inducing)
    return value, gradient()


def _gradient(df, features, target, h: Hyper, grads: dict, learn_inducing: bool) -> np.ndarray:
    d, zsize = len(h.scale), net_forward(h.z, h.net).size
    size = d + 1 + zsize + (sum(w.size for w in h.net) if h.net else 0)
    flat = sum_blocks(df, [*features, target], size, _gradient_block, (h, grads["a"], grads["b"]))
    pz = net_forward(h.z, h.net)
    own = rbf_backward(grads["kuu"], h.kernel(h.z), pz, pz, h.scale, h.variance)
    in_scale, in_variance = flat[:d] + own[0], flat[d] + own[1] + grads["variance"]
    in_pz = flat[d + 1 : d + 1 + zsize].reshape(pz.shape) + own[2] + own[3]
    parts = [in_scale * h.scale, [in_variance * h.variance, grads["noise"] * h.noise]]
    if h.net is None:
        if learn_inducing:
            parts.append(in_pz.ravel())
    else:
        if learn_inducing:
            w1, b1, w2, _ = h.net
            parts.append((((in_pz @ w2.T) * (h.z @ w1 + b1 > 0)) @ w1.T).ravel())
        parts.append(flat[d + 1 + zsize :] + net_backward(in_pz, h.z, h.net))
    return np.concatenate(parts)


# --- Gauss-Newton sums of a deep kernel ------------------------------------------------------


def _fit_slopes(x: np.ndarray, h: Hyper, weights: np.ndarray, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Derivatives of each row's fitted value ``k(x)·weights``: in log scales, log variance and net, one row each; with the
    weighted kernel and the rows' hidden-layer pull ``x / scale² · w2'``, from which those in inducing points follow.

    Inducing points pass the net as well: what the net does to them is in its derivatives.
    """
    w1, b1, w2, _ = h.net
    n, s2 = len(x), h.scale**2
    hidden = np.maximum(x @ w1 + b1, 0.0)
    on, px, pz = hidden > 0, net_forward(x, h.net), net_forward(h.z, h.net)
    hidden_z = np.maximum(h.z @ w1 + b1, 0.0)
    on_z, pull, pull_z = hidden_z > 0, (px / s2) @ w2.T, (pz / s2) @ w2.T
    outer = lambda a, b: (a[:, :, None] * b[:, None, :]).reshape(len(a), -1)
    e = rbf_block(px, pz, h.scale, h.variance) * weights
    x, e, px, hidden, pull, s2, w2 = (part.astype(kind, copy=False) for part in (x, e, px, hidden, pull, s2, w2))
    # All that inducing points have a part in, as one product.
    of_z = [pz, pz**2, hidden_z, outer(hidden_z, pz / h.scale**2), outer(h.z, on_z), outer(h.z, on_z * pull_z), on_z, on_z * pull_z]
    near, near2, near_hidden, near_w2, near_on, near_w1, near_b1, near_pull = np.split(
        e @ np.hstack([np.ones((len(pz), 1)), *of_z]).astype(kind), np.cumsum([1] + [part.shape[1] for part in of_z])[:-1], axis=1
    )[1:]
    row = e.sum(1)[:, None]
    in_scale = (row * px**2 + near2 - 2 * px * near) / s2
    in_px = (near - row * px) / s2
    back = (in_px @ w2.T) * on
    in_w2 = outer(hidden, in_px) + outer(near_hidden, px / s2) - near_w2
    in_w1 = outer(x, back) + near_on * np.tile(pull, (1, x.shape[1])) - near_w1
    in_b1 = back + near_b1 * pull - near_pull
    # A shift of all learned features changes no distance.
    return np.hstack([in_scale, row, in_w1, in_b1, in_w2, np.zeros((n, px.shape[1]), kind)]), e, pull


def _curvature_block(block: np.ndarray, payload) -> np.ndarray:
    """Σ of the outer products of those derivatives: scales, variance and net together, each inducing point by itself.

    A piece's products are in single precision, their sums in double: the matrix only says where a step goes, never what it
    gained. Weights are taken in units of the largest one, so that no square leaves single precision.
    """
    h, weights = payload
    unit = max(float(np.abs(weights).max(initial=0.0)), 1e-300) * h.variance
    w1, b1, w2, _ = h.net
    on, pull_z = (h.z @ w1 + b1 > 0).astype(float), (net_forward(h.z, h.net) / h.scale**2) @ w2.T
    d, m, width = h.z.shape[1], len(h.z), w1.shape[1]
    upper = np.triu_indices(width)
    shared, half, once, square_sum = 0.0, np.zeros((m, len(upper[0]))), np.zeros((m, width)), np.zeros(m)
    for rows in _pieces(block):
        slope, e, pull = _fit_slopes(rows[:, :-1], h, weights / unit, np.float32)
        square = e**2
        # Σ e² pull pull' per inducing point, in the hidden layer; symmetric, so half of it.
        half += square.T @ (pull[:, upper[0]] * pull[:, upper[1]])
        once += square.T @ pull
        square_sum += square.sum(0)
        shared = shared + (slope.T @ slope).astype(float)
    both = np.zeros((m, width, width))
    both[:, upper[0], upper[1]] = both[:, upper[1], upper[0]] = half
    cross = once[:, :, None] * pull_z[:, None, :]
    hidden = both - cross - cross.transpose(0, 2, 1) + square_sum[:, None, None] * pull_z[:, :, None] * pull_z[:, None, :]
    left = on[:, :, None] * w1.T[None]
    points = left.transpose(0, 2, 1) @ hidden @ left
    return unit**2 * np.concatenate([shared.ravel(), points.reshape(m * d * d)])


def deep_metric(
    df: DataFrame, features: Sequence[str], target: str, h: Hyper, damping: float, s: RowSums | None = None
) -> Callable[[np.ndarray], np.ndarray]:
    """What turns a gradient in ``h.pack(True)`` into a Gauss-Newton step; sums of fixed size from one pass, or two if ``s`` is not given.

    The net, scales and variance share one matrix; inducing points have one each, the noise its own curvature n / 2.
    """
    s = s or row_sums(df, features, target, h)
    weights = _inverse(h.kuu() + s.a / h.noise)[0] @ s.b / h.noise
    d, m = h.z.shape[1], len(h.z)
    wide = len(h.scale) + 1 + sum(w.size for w in h.net)
    flat = sum_blocks(df, [*features, target], wide * wide + m * d * d, _curvature_block, (h, weights)) / h.noise
    one, points = flat[: wide * wide].reshape(wide, wide), flat[wide * wide :].reshape(m, d, d)
    one = one + np.diag(damping * (np.diag(one) + np.diag(one).mean()) + 1e-8)
    size = np.einsum("maa->m", points)
    own = np.maximum(np.einsum("maa->ma", points), 0.0) + size[:, None] / d
    points = points + (damping * own + 1e-2)[:, :, None] * np.eye(d)
    inverse, points = _inverse(one)[0], np.linalg.inv(points)
    at, stop = len(h.scale) + 1, len(h.scale) + 2 + h.z.size

    def turn(g: np.ndarray) -> np.ndarray:
        shared = inverse @ np.concatenate([g[:at], g[stop:]])
        moved = np.einsum("mab,mb->ma", points, g[at + 1 : stop].reshape(m, d)).ravel()
        return np.concatenate([shared[:at], [2 * g[at] / max(s.n, 1.0)], moved, shared[at:]])

    return turn


@dataclass(frozen=True)
class SparseGP:
    features: tuple[str, ...]
    hyper: Hyper
    mean_weights: np.ndarray  # B⁻¹ b / σ²
    variance_form: np.ndarray  # Kuu⁻¹ − B⁻¹
    trace: tuple[float, ...] = ()
    gradient: np.ndarray | None = None

    def predict(self, df: DataFrame, include_noise: bool = False, mean: str = "gp_mean", var: str = "gp_var") -> DataFrame:
        """Predictive mean and latent variance per row; only the features leave the JVM."""
        shared = df.sparkSession.sparkContext.broadcast(self)
        extra = self.hyper.noise if include_noise else 0.0

        @F.pandas_udf("mean double, var double")
        def score(*cols: pd.Series) -> pd.DataFrame:
            fitted, latent = shared.value.predict_block(np.column_stack([c.to_numpy(dtype=float) for c in cols]))
            return pd.DataFrame({"mean": fitted, "var": latent + extra})

        scored = df.withColumn("_gp", score(*[F.col(c).cast("double") for c in self.features]))
        return scored.withColumn(mean, F.col("_gp.mean")).withColumn(var, F.col("_gp.var")).drop("_gp")

    def predict_block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Predictive mean and latent variance of a block of rows."""
        k = self.hyper.kernel(x)
        return k @ self.mean_weights, np.maximum(self.hyper.variance - np.einsum("nm,nm->n", k @ self.variance_form, k), 0.0)

    def relevance(self, spark: SparkSession) -> DataFrame:
        """Inverse lengthscales, highest first. A deep kernel scores learned features, hence ``latent_i``."""
        if self.hyper.net is None:
            names = list(self.features)
        else:
            names = [f"latent_{i}" for i in range(len(self.hyper.scale))]
        rows = [(n, float(s)) for n, s in zip(names, self.hyper.scale, strict=True)]
        return (
            spark.createDataFrame(rows, "feature string, lengthscale double")
            .withColumn("relevance", F.lit(1.0) / F.col("lengthscale"))
            .orderBy(F.desc("relevance"), "feature")
        )

    def trace_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.trace, 1)), "step int, elbo double")


def condition(df: DataFrame, features: Sequence[str], target: str, h: Hyper, trace: Sequence[float] = ()) -> SparseGP:
    """The optimal posterior for fixed hyper-parameters; one pass."""
    return _conditioned(row_sums(df, features, target, h), features, h, trace)


def _conditioned(s: RowSums, features: Sequence[str], h: Hyper, trace: Sequence[float] = ()) -> SparseGP:
    kuu_inv, _ = _inverse(h.kuu())
    b_inv, _ = _inverse(h.kuu() + s.a / h.noise)
    return SparseGP(tuple(features), h, b_inv @ s.b / h.noise, kuu_inv - b_inv, tuple(trace))


def _fit(df, features, target, h, tolerance, learn_inducing) -> SparseGP:
    taken: list[tuple[np.ndarray, RowSums]] = []  # where the ascent stands, and the sums there

    def objective(theta: np.ndarray) -> tuple[float, Callable[[], np.ndarray]]:
        now = h.unpack(theta, learn_inducing)
        s = row_sums(df, features, target, now)
        value, grads = collapsed_bound(s, now)

        def gradient() -> np.ndarray:
            taken[:] = [(theta.copy(), s)]
            return _gradient(df, features, target, now, grads, learn_inducing)

        return value, gradient

    def sums(theta: np.ndarray) -> RowSums:
        """Those of the last step, or, for any other place, new ones."""
        if taken and np.array_equal(taken[0][0], theta):
            return taken[0][1]
        return row_sums(df, features, target, h.unpack(theta, learn_inducing))

    def metric(theta: np.ndarray, damping: float) -> Callable[[np.ndarray], np.ndarray]:
        return deep_metric(df, features, target, h.unpack(theta, True), damping, sums(theta))

    second_order = metric if h.net is not None and learn_inducing else None
    theta, trace, gradient = ascent(h.pack(learn_inducing), objective, tolerance, metric=second_order)
    return replace(_conditioned(sums(theta), features, h.unpack(theta, learn_inducing), trace), gradient=gradient)


# What Spark's own k-means does by default: rounds of seeding, candidates a round as a multiple of the centres, steps, and the
# move that counts as none.
SEED_ROUNDS, SEED_FACTOR, CENTRE_STEPS, CENTRE_MOVE = 2, 2, 20, 1e-4


def inducing_points(df: DataFrame, features: Sequence[str], m: int = 300, seed: int = 42) -> np.ndarray:
    """k-means centres of the given (train) rows, in a stable order; ``df`` is read once a step.

    Seeding is k-means||: in each round a row becomes a candidate with a chance that grows with its squared distance to the candidates so
    far. Candidates, weighted by their rows, are cut down to ``m`` on the driver; Lloyd steps over all rows follow.
    """
    rng = np.random.default_rng(seed)
    first = df.select(*features).dropna().orderBy(F.xxhash64(*features, F.lit(seed)), *features).limit(1)
    found = np.array([list(r) for r in first.collect()], dtype=float)
    for turn in range(SEED_ROUNDS):
        cost = sum_blocks(df, features, 1, _cost_block, found)[0]
        if cost > 0:
            found = np.unique(np.vstack([found, _candidates(df, features, found, SEED_FACTOR * m / cost, seed + turn)]), axis=0)
    if len(found) > m:
        weights = sum_blocks(df, features, len(found) * (len(features) + 1), _assigned, found).reshape(len(found), -1)[:, 0]
        found = _weighted_centres(found, weights, m, rng)
    for _ in range(CENTRE_STEPS):
        before, found = found, _moved(df, features, found)
        if np.sqrt(((found - before) ** 2).sum(1)).max() <= CENTRE_MOVE:
            break
    return found[np.lexsort(found.T[::-1])]


def _squares(block: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less each row's own square, which does not matter to the nearest one."""
    square = block @ (-2 * centres.T)
    square += (centres**2).sum(1)
    return square


def _nearest_square(block: np.ndarray, centres: np.ndarray) -> np.ndarray:
    least = np.concatenate([_squares(rows, centres).min(1) for rows in _pieces(block)])
    return np.maximum(least + (block**2).sum(1), 0.0)


def _cost_block(block: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.array([_nearest_square(block, centres).sum()])


def _candidates(df: DataFrame, features: Sequence[str], centres: np.ndarray, rate: float, seed: int) -> np.ndarray:
    """Rows drawn with a chance of ``rate`` times their squared distance to the centres: a few per centre, however many rows."""
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def draw(batches):
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            block = batch.to_numpy(dtype=float)
            known = ~np.isnan(block).any(axis=1)
            chance = np.zeros(len(block))
            if known.any():
                chance[known] = rate * _nearest_square(block[known], shared.value)
            yield batch[rng.random(len(block)) < chance]

    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    rows = numbers.mapInPandas(draw, numbers.schema).collect()
    shared.destroy()
    return np.array([list(r) for r in rows], dtype=float).reshape(-1, len(features))


def _weighted_centres(points: np.ndarray, weights: np.ndarray, m: int, rng: np.random.Generator, most: int = 30) -> np.ndarray:
    """k-means++ and Lloyd steps over few weighted points."""
    centres = points[[rng.choice(len(points), p=weights / weights.sum())]]
    while len(centres) < m:
        chance = weights * _nearest_square(points, centres)
        if chance.sum() <= 0:
            break
        centres = np.vstack([centres, points[rng.choice(len(points), p=chance / chance.sum())]])
    for _ in range(most):
        nearest = _squares(points, centres).argmin(1)
        total = np.bincount(nearest, weights, len(centres))[:, None]
        sums = np.column_stack([np.bincount(nearest, weights * c, len(centres)) for c in points.T])
        moved = np.where(total > 0, sums / np.maximum(total, 1e-300), centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def _assigned(block: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Per centre: the rows nearest to it (the first of equally near ones), and their sums."""
    if not len(block):
        return np.zeros(len(centres) * (block.shape[1] + 1))
    nearest = np.concatenate([_squares(rows, centres).argmin(1) for rows in _pieces(block)])
    return np.column_stack([np.bincount(nearest, w, len(centres)) for w in (None, *block.T)]).ravel()


def _moved(df: DataFrame, features: Sequence[str], centres: np.ndarray) -> np.ndarray:
    """Each centre at the mean of the rows nearest to it; one without rows stays."""
    found = sum_blocks(df, features, len(centres) * (centres.shape[1] + 1), _assigned, centres).reshape(len(centres), -1)
    return np.where(found[:, :1] > 0, found[:, 1:] / np.maximum(found[:, :1], 1.0), centres)


def lloyd(df: DataFrame, features: Sequence[str], centres: np.ndarray, most: int = 500) -> np.ndarray:
    """Moves centres to the mean of their rows until none moves any more; one pass a step. A centre without rows stays."""
    for _ in range(most):
        moved = _moved(df, features, centres)
        if np.abs(moved - centres).max() < 1e-12:
            return moved
        centres = moved
    raise NotConverged(f"centres still moved after {most} steps")


def amplitude_fit(df: DataFrame, features: Sequence[str], target: str, h: Hyper) -> SparseGP:
    """Fits kernel variance and noise where scales, inducing points and net are given.

    Both only scale the sums over the rows, so these are made once and the fit itself reads no row.
    """
    unit = replace(h, variance=1.0)
    fitted, trace, gradient = _amplitudes(row_sums(df, features, target, unit), h)
    return replace(condition(df, features, target, fitted, trace), gradient=gradient)


def _amplitudes(one: RowSums, h: Hyper) -> tuple[Hyper, list[float], np.ndarray]:
    """``h`` with the best variance and noise, given the sums of a kernel of variance 1; trace and last gradient."""
    base = replace(h, variance=1.0).kernel(h.z)

    def terms(theta: np.ndarray) -> tuple[float, np.ndarray]:
        v, noise = np.exp(theta)
        now = replace(h, variance=float(v), noise=float(noise))
        value, g = collapsed_bound(RowSums(v**2 * one.a, v * one.b, one.yy, one.n), now)
        in_v = 2 * v * float((g["a"] * one.a).sum()) + float(g["b"] @ one.b) + float((g["kuu"] * base).sum()) + g["variance"]
        return value, np.array([in_v * v, g["noise"] * noise])

    start = np.log([h.variance, h.noise])
    theta, trace, gradient = newton(start, lambda t: (*terms(t), slopes(lambda u: terms(u)[1], t)))
    return replace(h, variance=float(np.exp(theta[0])), noise=float(np.exp(theta[1]))), trace, gradient


# Test sides of the runs are bits of a double.
MOST_RUNS = 50


def _test_sides(key: str, runs: int, test_one_in: int) -> Column:
    """A number whose bit ``r - 1`` is set where run ``r`` tests the row; the run is the seed of its split."""
    if runs > MOST_RUNS:
        raise ValueError(f"at most {MOST_RUNS} runs at a time")
    tested = [hash_bucket(F.col(key), test_one_in, str(r)) == 0 for r in range(1, runs + 1)]
    return sum((F.when(t, float(1 << i)).otherwise(0.0) for i, t in enumerate(tested)), F.lit(0.0))


def _run_scales(rows: DataFrame, cols: Sequence[str], runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the columns over each run's train rows, as a ``Scaler`` has them, from one scan; a mean of no
    value is NaN."""
    left = F.array(*[F.when(F.shiftright(F.col("tests").cast("long"), r) % 2 == 0, r) for r in range(runs)])
    trained = rows.select(*cols, F.explode(F.array_compact(left)).alias("run"))
    moments = trained.groupBy("run").agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    means, scales = np.full((runs, len(cols)), np.nan), np.ones((runs, len(cols)))
    for r in moments.collect():  # one row per run
        means[r["run"]] = [np.nan if r[f"m{i}"] is None else r[f"m{i}"] for i in range(len(cols))]
        scales[r["run"]] = [r[f"s{i}"] or 1.0 for i in range(len(cols))]
    return means, scales


def _runs_block(block: np.ndarray, payload) -> np.ndarray:
    """The sums of every run's train rows under the run's own scaling, run after run, and in a run model after model."""
    models, means, scales = payload
    tests, sums = block[:, -1].astype(np.int64), []
    for r, (m, s) in enumerate(zip(means, scales, strict=True)):
        scaled = (block[tests >> r & 1 == 0, :-1] - m) / s
        sums += [_sum_block(scaled, h) for h in models]
    return np.concatenate(sums)


def _run_sums(rows: DataFrame, cols: Sequence[str], models: Sequence[Hyper], means: np.ndarray, scales: np.ndarray) -> list[list[RowSums]]:
    """Per run, per model: the sums over the run's train rows; one scan for all of them."""
    widths = [_width(h) for h in models] * len(means)
    flat = sum_blocks(rows, [*cols, "tests"], sum(widths), _runs_block, (models, means, scales))
    parts = iter(np.split(flat, np.cumsum(widths)[:-1]))
    return [[_unpacked(next(parts), h) for h in models] for _ in means]


def repeated_holdouts(
    df: DataFrame, features: Sequence[str], log_target: str, truth: str, key: str, models: Mapping[str, Hyper], runs: int = 10, test_one_in: int = 5
) -> DataFrame:
    """Repeated hold-outs of processes whose hyper-parameters are given: ``(model, run, mae, rmse, r2)``, metrics of ``truth``
    against exp(target).

    Every run scales features and target on its own train rows, conditions each model on them and is scored on its test rows. Runs
    and models are dimensions of the sums: the rows are written once with their sides, three scans of them serve all. An unknown
    value counts in no mean of its column, and its row neither in the sums nor in the metrics.
    """
    cols = [*features, log_target]
    numbers = [F.col(c).cast("double").alias(c) for c in cols]
    rows = stage(df.select(*numbers, F.col(truth).cast("double").alias("truth"), _test_sides(key, runs, test_one_in).alias("tests")), "holdouts")
    means, scales = _run_scales(rows, cols, runs)
    sums = _run_sums(rows, cols, list(models.values()), means, scales)
    fits = [[_conditioned(s, features, h) for s, h in zip(of_run, models.values(), strict=True)] for of_run in sums]
    shared = df.sparkSession.sparkContext.broadcast((fits, means[:, :-1], scales[:, :-1]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, mean, scale = shared.value
        for batch in batches:
            block = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            tests, parts = block[:, -1].astype(np.int64), []
            for r, of_run in enumerate(fits):
                mine = block[tests >> r & 1 == 1, :-1]
                x = (mine[:, :-1] - mean[r]) / scale[r]
                parts += [(np.full(len(x), i), np.full(len(x), r + 1), mine[:, -1], *fit.predict_block(x)) for i, fit in enumerate(of_run)]
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
            columns = [pa.array(np.concatenate(c), t, from_pandas=True) for c, t in zip(zip(*parts, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["model", "run", "truth", "gp_mean", "gp_var"])

    scored = rows.select(*features, "truth", "tests").mapInArrow(score, "model int, run int, truth double, gp_mean double, gp_var double")
    of_run = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("run"))
    priced = price_band(scored, Scaler({log_target: of_run(means[:, -1])}, {log_target: of_run(scales[:, -1])}), log_target)
    pairs = [(i, name, r) for i, name in enumerate(models) for r in range(1, runs + 1)]
    named = df.sparkSession.createDataFrame(pairs, "model int, name string, run int")
    found = named.join(evaluate(priced, "truth", "pred", ["model", "run"]), ["model", "run"], "left")
    return found.select(F.col("name").alias("model"), "run", "mae", "rmse", "r2")


def fitted_holdouts(
    df: DataFrame, features: Sequence[str], log_target: str, key: str, h: Hyper, runs: int = 10, test_one_in: int = 5
) -> DataFrame:
    """Repeated hold-outs of a fitted process: ``(run, variance, noise, bound, mae, rmse, r2)``, metrics of exp(target).

    Every run scales features and target on its own train rows, fits kernel variance and noise to them (each run starting
    from the one before) and is scored on its test rows. Scales, inducing points and net are those of ``h``, in scaled units.
    The runs are a dimension of the sums, so three scans of ``df`` serve all of them. Rows with a NULL are left out.
    """
    cols, seeds = [*features, log_target], range(1, runs + 1)
    rows = df.select(key, *cols).dropna().select(*cols, _test_sides(key, runs, test_one_in).alias("tests"))
    means, scales = _run_scales(rows, cols, runs)
    if np.isnan(means).all(1).any():
        raise ValueError("a run has no train rows")

    models, last = [], h
    for (one,) in _run_sums(rows, cols, [replace(h, variance=1.0)], means, scales):
        last, trace, _ = _amplitudes(one, last)
        v = last.variance
        b_inv, _ = _inverse(last.kuu() + v**2 * one.a / last.noise)
        models.append((last, b_inv @ (v * one.b) / last.noise, float(trace[-1])))

    shared = df.sparkSession.sparkContext.broadcast((models, means, scales))

    def score(batches):
        fits, mean, scale = shared.value
        for batch in batches:
            block = batch.to_numpy(dtype=float)
            tests = block[:, -1].astype(np.int64)
            for r, (now, weights, _) in enumerate(fits):
                mine = block[tests >> r & 1 == 1, :-1]
                found = now.kernel((mine[:, :-1] - mean[r, :-1]) / scale[r, :-1]) @ weights
                yield pd.DataFrame({"run": r + 1, "truth": np.exp(mine[:, -1]), "pred": np.exp(found * scale[r, -1] + mean[r, -1])})

    numbers = rows.select(*[F.col(c).cast("double").alias(c) for c in rows.columns])
    scored = numbers.mapInPandas(score, "run int, truth double, pred double")
    fits = [(r, f.variance, f.noise, bound) for r, (f, _, bound) in zip(seeds, models, strict=True)]
    fits = df.sparkSession.createDataFrame(fits, "run int, variance double, noise double, bound double")
    return fits.join(evaluate(scored, "truth", "pred", ["run"]), "run", "left")


def sparse_gp_fit(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    z: np.ndarray,
    tolerance: float = TOLERANCE,
    jitter: float = 0.1,
    lengthscale: float = 0.5,
    learn_inducing: bool = True,
) -> SparseGP:
    """Fit scales, variance, noise (and inducing points). Cache ``df``: each step reads it twice.

    Steps go on until the bound stands still. The posterior over inducing values is optimal at every
    step, so that takes far fewer of them than a stochastic fit.
    """
    h = Hyper(np.full(len(features), float(lengthscale)), 1.0, 1.0, z, jitter)
    return _fit(df, features, target, h, tolerance, learn_inducing)


def deep_kernel_gp_fit(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    z: np.ndarray,
    tolerance: float = DEEP_TOLERANCE,
    hidden: int = 32,
    jitter: float = 0.1,
    learn_inducing: bool = True,
    seed: int = 0,
) -> SparseGP:
    """Kernel over learned features; inducing points stay in input space and pass through the net.

    Steps are Gauss-Newton ones refined by L-BFGS: first-order steps alone need over a thousand passes.
    """
    d = len(features)
    h = Hyper(np.ones(d), 1.0, 1.0, z, jitter, init_net(d, hidden, d, seed))
    return _fit(df, features, target, h, tolerance, learn_inducing)


def mlp_transform(df: DataFrame, features: Sequence[str], net: Net, name: str = "latent") -> DataFrame:
    """The learned features as one array column."""
    shared = df.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("array<double>")
    def forward(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        return pd.Series(list(net_forward(x, shared.value)))

    return df.withColumn(name, forward(*[F.col(c).cast("double") for c in features]))


# --- reports --------------------------------------------------------------------------------


def price_band(df: DataFrame, scaler: Scaler, target: str, k: float = 2.0, mean: str = "gp_mean", var: str = "gp_var") -> DataFrame:
    """Median price and ±k-deviation band from a GP on the standardised log price.

    ``pred`` is exp of the mean, i.e. the median on the price scale.
    """
    centre: Column = scaler.inverse(F.col(mean), target)
    lower, upper = band(centre, F.sqrt(var) * F.lit(scaler.scale[target]), k, F.exp)
    return df.withColumns({"pred": F.exp(centre), "lower": lower, "upper": upper})


def posterior_sweep(
    model: SparseGP,
    train: DataFrame,
    feature: str,
    n: int = 500,
    start: float = -4.0,
    stop: float = 4.0,
    scaler: Scaler | None = None,
    target: str = "",
    k: float = 2.0,
) -> DataFrame:
    """Posterior along one feature with the others at their train means: ``(i, x, …)``.

    With a target scaler the band is on the price scale, else on the model scale.
    """
    means = column_means(train, model.features).first().asDict()
    grid = linspace(train.sparkSession, start, stop, n, "x")
    grid = grid.withColumns({f: F.col("x") if f == feature else F.lit(means[f]) for f in model.features})
    swept = model.predict(grid)
    if scaler is not None:
        return price_band(swept, scaler, target, k).select("i", "x", "pred", "lower", "upper")
    lower, upper = band(F.col("gp_mean"), F.sqrt("gp_var"), k)
    return swept.select("i", "x", F.col("gp_mean").alias("pred"), lower.alias("lower"), upper.alias("upper"))
