"""Quasi-Newton ascent on a parameter vector held by the driver; each value and gradient is a Spark job."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

# A fit ends when its value changes by less than this share of itself, several steps in a row.
TOLERANCE = 1e-6
QUIET_STEPS = 3
# Steps after which a metric is measured again, and its first damping.
METRIC_STEPS, METRIC_DAMPING = 15, 0.1
# How much a Newton step is damped at first, as a share of each parameter's own curvature; and how that changes.
DAMPING, MORE, LESS = 0.1, 8.0, 0.125
# What a step outside the domain raises: no Cholesky factor, a variance that is zero in floating point.
OUTSIDE = (np.linalg.LinAlgError, ZeroDivisionError)
# Curvature pairs kept.
MEMORY = 20


class NotConverged(RuntimeError):
    """The value still changed after the last step that was allowed."""


def ascent(
    theta: np.ndarray,
    value_and_gradient: Callable[[np.ndarray], tuple[float, np.ndarray | Callable[[], np.ndarray]]],
    tolerance: float = TOLERANCE,
    most: int = 2_000,
    first_step: float = 0.1,
    metric: Callable[[np.ndarray, float], Callable[[np.ndarray], np.ndarray]] | None = None,
) -> tuple[np.ndarray, list[float], np.ndarray]:
    """Maximise by L-BFGS with backtracking: the parameters, the value of each step, the last gradient.

    Ends when ``QUIET_STEPS`` steps in a row change the value by less than ``tolerance`` of itself, or when
    no step along the gradient raises it any more. ``most`` steps without that raise ``NotConverged``.

    The gradient may be a function without arguments: it is then asked for only where a step is taken. ``metric`` makes, from
    parameters and a damping, a function that turns a gradient into a step, such as the inverse of a Gauss-Newton
    matrix; the pairs of L-BFGS refine it, and every ``METRIC_STEPS`` steps it is measured again, damped
    more where steps were refused, less where none was.
    """
    value, gradient = _asked(value_and_gradient(theta))
    trace, pairs, quiet = [float(value)], [], 0
    turn, damping, age, refused = None, METRIC_DAMPING, 0, 0
    for _ in range(most):
        size = float(np.abs(gradient).max(initial=0.0))
        if size == 0.0:
            return theta, trace, gradient
        if metric is not None and (turn is None or age >= METRIC_STEPS):
            damping *= 2.0 if refused > METRIC_STEPS // 4 else 0.5 if age and not refused else 1.0
            turn, pairs, age, refused = metric(theta, damping), [], 0, 0
        way, kept = gradient.copy(), []
        for s, g in reversed(pairs):
            a = (s @ way) / (s @ g)
            kept.append(a)
            way -= a * g
        if turn is not None:
            way = turn(way)
        else:
            way *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else first_step / size
        for (s, g), a in zip(pairs, reversed(kept), strict=True):
            way += (a - (g @ way) / (s @ g)) * s
        slope = float(gradient @ way)
        step, found = 1.0, None
        while step > 1e-6:
            with np.errstate(all="ignore"):
                found = _tried(value_and_gradient, theta + step * way)
            if found is not None and found[0] >= value + 1e-4 * step * slope:
                break
            step, found, refused = step / 2, None, refused + 1
        found = found and _asked(found)
        if found is None or not np.isfinite(found[1]).all():
            if not pairs:
                return theta, trace, gradient
            pairs = []  # the curvature misleads: start again along the gradient
            continue
        s, g = step * way, gradient - found[1]
        if s @ g > 1e-10 * np.linalg.norm(s) * np.linalg.norm(g):
            pairs = [*pairs[1 - MEMORY :], (s, g)]
        change = abs(found[0] - value) / max(abs(value), abs(found[0]), 1e-300)
        theta, (value, gradient) = theta + s, found
        trace.append(float(value))
        age += 1
        quiet = quiet + 1 if change < tolerance else 0
        if quiet >= QUIET_STEPS:
            return theta, trace, gradient
    raise NotConverged(f"the value still changed after {most} steps")


def ascents(
    theta: np.ndarray,
    value_and_gradient: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]],
    tolerance: float = TOLERANCE,
    most: int = 2_000,
    first_step: float = 0.1,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ascent`` of many small problems side by side, one row of ``theta`` each: parameters, values, and which came to an end.

    ``value_and_gradient`` takes parameters and the rows they belong to, and gives NaN outside the domain. Every problem has its own pairs,
    step length and end, by the rules of ``ascent``; it is not asked for again once it has ended.
    """
    theta, (value, gradient) = theta.copy(), value_and_gradient(theta, np.arange(len(theta)))
    moves, turns = (np.zeros((len(theta), MEMORY, theta.shape[1])) for _ in range(2))
    count, quiet, ended = np.zeros(len(theta), int), np.zeros(len(theta), int), np.zeros(len(theta), bool)
    live = np.flatnonzero(np.isfinite(value) & np.isfinite(gradient).all(1))
    dot = lambda a, b: (a * b).sum(-1)
    for _ in range(most):
        flat = ~gradient[live].any(1)
        ended[live[flat]] = True
        live = live[~flat]
        if not len(live):
            break
        g, pairs = gradient[live], count[live]
        way, kept = g.copy(), np.zeros((len(live), MEMORY))
        mine, bent = moves[live, : pairs.max(initial=0)], turns[live, : pairs.max(initial=0)]
        has = np.arange(mine.shape[1]) < pairs[:, None]
        along = np.where(has, dot(mine, bent), 1.0)
        for j in reversed(range(mine.shape[1])):
            kept[:, j] = np.where(has[:, j], dot(mine[:, j], way) / along[:, j], 0.0)
            way -= kept[:, j, None] * bent[:, j]
        size = first_step / np.abs(g).max(1)
        if mine.shape[1]:
            newest = np.arange(len(live)), np.maximum(pairs - 1, 0)
            size = np.where(pairs > 0, along[newest] / np.where(pairs > 0, dot(bent[newest], bent[newest]), 1.0), size)
        way *= size[:, None]
        for j in range(mine.shape[1]):
            way += np.where(has[:, j], kept[:, j] - dot(bent[:, j], way) / along[:, j], 0.0)[:, None] * mine[:, j]
        slope, step = dot(g, way), np.ones(len(live))
        found, found_gradient, open_ = np.full(len(live), np.nan), np.zeros_like(g), np.ones(len(live), bool)
        while (at := np.flatnonzero(open_ & (step > 1e-6))).size:
            with np.errstate(all="ignore"):
                v, steep = value_and_gradient(theta[live[at]] + step[at, None] * way[at], live[at])
                good = np.isfinite(v) & np.isfinite(steep).all(1) & (v >= value[live[at]] + 1e-4 * step[at] * slope[at])
            found[at[good]], found_gradient[at[good]] = v[good], steep[good]
            open_[at[good]] = False
            step[at[~good]] /= 2
        ended[live[open_ & (pairs == 0)]] = True
        count[live[open_]] = 0  # the curvature misleads: start again along the gradient
        went = ~open_
        rows, s, turn = live[went], step[went, None] * way[went], g[went] - found_gradient[went]
        keep = dot(s, turn) > 1e-10 * np.linalg.norm(s, axis=1) * np.linalg.norm(turn, axis=1)
        full = rows[keep & (count[rows] == MEMORY)]
        moves[full, :-1], turns[full, :-1] = moves[full, 1:], turns[full, 1:]
        count[full] -= 1
        moves[rows[keep], count[rows[keep]]], turns[rows[keep], count[rows[keep]]] = s[keep], turn[keep]
        count[rows[keep]] += 1
        change = np.abs(found[went] - value[rows]) / np.maximum(np.maximum(np.abs(value[rows]), np.abs(found[went])), 1e-300)
        theta[rows], value[rows], gradient[rows] = theta[rows] + s, found[went], found_gradient[went]
        quiet[rows] = np.where(change < tolerance, quiet[rows] + 1, 0)
        ended[rows[quiet[rows] >= QUIET_STEPS]] = True
        live = live[~ended[live]]
    return theta, value, ended


def newton(
    theta: np.ndarray,
    expansion: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]],
    tolerance: float = TOLERANCE,
    most: int = 200,
) -> tuple[np.ndarray, list[float], np.ndarray]:
    """Maximise by damped Newton steps: the parameters, the value of each step, the last gradient.

    ``expansion`` gives value, gradient and second derivatives, all from one pass. Parameters are measured by their own
    curvature; where the value curves the wrong way the step goes uphill all the same. A step that does not help is
    damped more, and the next ones too, until steps do what was promised. Ends when an undamped step promises less than
    ``tolerance`` squared of the value, which leaves no slope that the parameters' own scales would notice.
    """
    value, gradient, second = expansion(theta)
    trace, damping = [float(value)], DAMPING
    for _ in range(most):
        bend, own, size, axes, along = _bent(gradient, second)
        if _undamped_gain(size, along) <= tolerance**2 * max(abs(value), 1e-300):
            return theta, trace, gradient
        while True:
            way = axes @ (along / (size + damping)) / own
            promised = float(gradient @ way - 0.5 * way @ bend @ way)
            with np.errstate(all="ignore"):
                found = _expanded(expansion, theta + way)
            if found is not None and found[0] >= value + 1e-4 * abs(promised):
                break
            damping *= MORE
            if damping > 1e12:  # the value's own rounding hides what is left to gain
                return theta, trace, gradient
        if found[0] - value > 0.5 * promised:
            damping = max(damping * LESS, 1e-9)
        theta, (value, gradient, second) = theta + way, found
        trace.append(float(value))
    raise NotConverged(f"the value still changed after {most} steps")


def _bent(gradient: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """Minus the second derivatives, each parameter's own scale, and in these scales the curvatures, axes and slopes along them."""
    bend = -(second + second.T) / 2
    own = np.abs(np.diag(bend))
    own = np.sqrt(np.maximum(own, 1e-12 * max(own.max(initial=0.0), 1e-300)))
    curve, axes = np.linalg.eigh(bend / np.outer(own, own))
    return bend, own, np.abs(curve), axes, axes.T @ (gradient / own)


def _undamped_gain(size: np.ndarray, along: np.ndarray) -> float:
    return 0.5 * float((along**2 / np.maximum(size, 1e-10)).sum())


def remodelled(
    theta: np.ndarray,
    measured: Callable[[np.ndarray], tuple[tuple[float, np.ndarray, np.ndarray], Callable[[float], Callable]]],
    tolerance: float = TOLERANCE,
    most: int = 200,
    most_inside: int = 5_000,
) -> tuple[np.ndarray, list[float], np.ndarray]:
    """Maximise by maximising one model after the other: the parameters, the value of each step, the last gradient.

    ``measured`` reads the rows: it gives the expansion that ``newton`` takes, and a function that makes from a damping a model of
    the value around these parameters. A model is itself an expansion, costs no pass, and is climbed by ``newton`` to its top;
    it may be curved where the value is, so that a narrow bent ridge costs steps on the driver instead of passes.
    A top that does not help is sought again with more damping. Ends as ``newton`` does, by the same test of the value itself.
    """
    (value, gradient, second), model = measured(theta)
    trace, damping = [float(value)], 0.0
    for _ in range(most):
        _, _, size, _, along = _bent(gradient, second)
        if _undamped_gain(size, along) <= tolerance**2 * max(abs(value), 1e-300):
            return theta, trace, gradient
        while True:
            with np.errstate(all="ignore"):
                top, inside, _ = newton(theta, model(damping), tolerance, most_inside)
                found = _measured(measured, top)
            promised = inside[-1] - inside[0]
            if found is not None and found[0][0] >= value + 1e-4 * promised and promised > 0:
                break
            damping = max(damping * MORE, DAMPING)
            if damping > 1e12:  # the value's own rounding hides what is left to gain
                return theta, trace, gradient
        if found[0][0] - value > 0.5 * promised:
            damping = damping * LESS if damping > 1e-6 else 0.0
        theta, ((value, gradient, second), model) = top, found
        trace.append(float(value))
    raise NotConverged(f"the value still changed after {most} steps")


def slopes(function: Callable[[np.ndarray], np.ndarray], at: np.ndarray) -> np.ndarray:
    """Derivatives of a vector function that costs nothing, by central differences: one row per parameter."""
    out = []
    for i, v in enumerate(at):
        step = np.zeros(len(at))
        step[i] = 1e-5 * max(1.0, abs(v))
        out.append((np.asarray(function(at + step)) - np.asarray(function(at - step))) / (2 * step[i]))
    return np.array(out)


def _expanded(expansion, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
    try:
        found = expansion(theta)
    except OUTSIDE:
        return None
    return found if np.isfinite(found[0]) and all(np.isfinite(f).all() for f in found[1:]) else None


def _measured(measured, theta: np.ndarray) -> tuple | None:
    made = []

    def expansion(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        made.append(measured(at))
        return made[0][0]

    return None if _expanded(expansion, theta) is None else made[0]


def _asked(found: tuple) -> tuple[float, np.ndarray]:
    return found[0], found[1]() if callable(found[1]) else found[1]


def _tried(value_and_gradient, theta: np.ndarray) -> tuple | None:
    """A step that leaves the domain (overflow, no Cholesky factor) counts as one that does not help."""
    try:
        value, gradient = value_and_gradient(theta)
    except OUTSIDE:
        return None
    return (value, gradient) if np.isfinite(value) and (callable(gradient) or np.isfinite(gradient).all()) else None
