"""Plug point: one-step volatility forecast of a short return array by a GARCH(1,1) fit.

Each array holds the trailing returns of one month-end, so the work is spread over all
(security, month) rows and no task receives a whole series.

The fit maximizes the normal likelihood over all three parameters: h = w + a e^2 + b h, started at
the sample variance. Inside, the parameters are free numbers: the logarithm of the long-run variance
w / (1 - a - b), and the logits of the persistence a + b and of a's share in it. The derivatives of h
follow the same recursion as h, so one pass over the returns gives likelihood and gradient. Starts
come from a coarse grid at the sample variance; quasi-Newton steps (BFGS) run for all arrays of a
batch together, and an array leaves the batch when its steps gain nothing more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

STARTS = np.array([(a, b) for a in (0.01, 0.04, 0.08, 0.15, 0.25, 0.4) for b in (0.03, 0.3, 0.5, 0.65, 0.75, 0.83, 0.89, 0.94, 0.97) if a + b < 0.995])
TOP = 0.9995  # largest persistence
LOWEST, HIGHEST = np.array([[-6.0], [-6.0], [-9.0]]), np.array([[6.0], [8.0], [9.0]])  # of the free parameters
FITS_AT_ONCE, ROUNDS, GAIN, LONGEST_STEP = 2048, 16, 1e-4, 1.5


def parameters(theta: np.ndarray):
    """w (in sample variances), a, b and the 3 x 3 Jacobian of (w, a, b), for theta [3, fits]."""
    long_run, p, s = np.exp(theta[0]), 1 / (1 + np.exp(-theta[1])), 1 / (1 + np.exp(-theta[2]))
    q = TOP * p
    w, a, b = long_run * (1 - q), q * s, q * (1 - s)
    jacobian = np.zeros((3, 3, theta.shape[1]))
    jacobian[0, 0], jacobian[0, 1] = w, -long_run * q * (1 - p)
    jacobian[1, 1], jacobian[1, 2] = a * (1 - p), a * (1 - s)
    jacobian[2, 1], jacobian[2, 2] = b * (1 - p), -a * (1 - s)
    return w, a, b, jacobian


def likelihood(e2: np.ndarray, start: np.ndarray, w, a, b) -> np.ndarray:
    """Cost sum(log h + e2 / h) of parameters [sets, fits]; ``e2`` [days, fits] in units of the variance.

    Days before ``start`` are padding, on which h stays at the variance.
    """
    h, cost, logs, part = np.ones(a.shape), np.zeros(a.shape), np.ones(a.shape), np.empty(a.shape)
    first = start.max(initial=0)
    for t, e in enumerate(e2):
        if t < first:
            live = t >= start
            cost += np.where(live, e / h, 0.0)
            logs *= np.where(live, h, 1.0)
            h = np.where(live, w + a * e + b * h, h)
        else:
            np.divide(e, h, out=part)
            cost += part
            logs *= h
            h *= b
            np.multiply(a, e, out=part)
            h += part
            h += w
        if t % 8 == 7:  # logarithms of a few days at once
            cost += np.log(logs)
            logs[:] = 1.0
    return cost + np.log(logs)


def derivatives(e2: np.ndarray, start: np.ndarray, theta: np.ndarray):
    """Cost, its gradient [3, fits] in the free parameters, and the next variance."""
    w, a, b, jacobian = parameters(theta)
    n, first = theta.shape[1], start.max(initial=0)
    state, source = np.zeros((4, n)), np.ones((4, n))  # h and its derivatives by w, a and b
    state[0] = 1.0
    cost, logs, gradient = np.zeros(n), np.ones(n), np.zeros((3, n))
    inverse, part, step = np.empty(n), np.empty(n), np.empty((3, n))
    for t, e in enumerate(e2):
        h = state[0]
        np.divide(1.0, h, out=inverse)
        np.multiply(e, inverse, out=part)
        live = None if t >= first else t >= start
        cost += part if live is None else np.where(live, part, 0.0)
        logs *= h if live is None else np.where(live, h, 1.0)
        np.subtract(1.0, part, out=part)
        part *= inverse
        np.multiply(part if live is None else np.where(live, part, 0.0), state[1:], out=step)
        gradient += step
        np.multiply(a, e, out=source[0])
        source[0] += w
        source[2], source[3] = e, h
        if live is None:
            state *= b
            state += source
        else:
            state = np.where(live, source + b * state, state)
        if t % 8 == 7:
            cost += np.log(logs)
            logs[:] = 1.0
    return cost + np.log(logs), np.einsum("ijn,in->jn", jacobian, gradient), state[0]


def starts(e2: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Free parameters at the best point of the coarse grid, for each array."""
    a, b = (np.repeat(x[:, None], e2.shape[1], axis=1) for x in STARTS.T)
    a, b = STARTS[likelihood(e2[:, None, :], start, 1 - a - b, a, b).argmin(axis=0)].T
    p, s = (a + b) / TOP, a / (a + b)
    return np.stack([np.zeros(len(a)), np.log(p / (1 - p)), np.log(s / (1 - s))])


def updated(inverse: np.ndarray, moved: np.ndarray, change: np.ndarray) -> np.ndarray:
    """BFGS update of inverse Hessians [fits, 3, 3] for steps and gradient changes [fits, 3]."""
    q = 1 / np.einsum("ni,ni->n", moved, change)[:, None, None]
    left = np.eye(3) - q * moved[:, :, None] * change[:, None, :]
    return left @ inverse @ left.transpose(0, 2, 1) + q * moved[:, :, None] * moved[:, None, :]


def fit(e2: np.ndarray, start: np.ndarray):
    """Free parameters, cost and next variance of every array."""
    theta = starts(e2, start)
    cost, gradient, h = derivatives(e2, start, theta)
    n = len(cost)
    inverse = np.eye(3) / 4 / np.maximum(1, np.abs(gradient).max(axis=0) / 4)[:, None, None]
    length, quiet, live = np.ones(n), np.zeros(n, int), np.arange(n)
    for _ in range(ROUNDS):
        if not len(live):
            break
        g = gradient[:, live]
        direction = -np.einsum("nij,jn->in", inverse[live], g)
        direction = np.where((direction * g).sum(axis=0) < 0, direction, -g)
        direction *= np.minimum(1, LONGEST_STEP / np.maximum(np.abs(direction).max(axis=0), 1e-12))
        trial = np.clip(theta[:, live] + length[live] * direction, LOWEST, HIGHEST)
        new_cost, new_gradient, new_h = derivatives(e2[:, live], start[live], trial)
        moved, change = trial - theta[:, live], new_gradient - g
        curved = (moved * change).sum(axis=0) > 1e-10
        if curved.any():
            inverse[live[curved]] = updated(inverse[live[curved]], moved[:, curved].T, change[:, curved].T)
        better = new_cost < cost[live]
        gain, at = np.where(better, cost[live] - new_cost, 0.0), live[better]
        theta[:, at], gradient[:, at] = trial[:, better], new_gradient[:, better]
        cost[at], h[at] = new_cost[better], new_h[better]
        length[live] = np.where(better, 1.0, length[live] * 0.3)
        quiet[live] = np.where(gain > GAIN, 0, quiet[live] + 1)
        live = live[quiet[live] < 3]
    return theta, cost, h


def prepared(arrays: list):
    """Usable rows, squared deviations [days, rows] in units of the variance, first days and variances."""
    clean = [np.asarray(r, dtype=float) for r in arrays]
    clean = [r[np.isfinite(r)] for r in clean]
    rows = [i for i, r in enumerate(clean) if r.size and np.ptp(r) > 0.0]
    width = max((clean[i].size for i in rows), default=0)
    e2, start, var = np.zeros((width, len(rows))), np.zeros(len(rows), dtype=int), np.ones(len(rows))
    for k, i in enumerate(rows):
        r = clean[i]
        start[k], var[k] = width - r.size, r.var()
        e2[start[k]:, k] = (r - r.mean()) ** 2 / var[k]
    return rows, e2, start, var


def fit_many(arrays: list) -> np.ndarray:
    """Next-step volatility per array; NaN for a constant or empty one."""
    out = np.full(len(arrays), np.nan)
    rows, e2, start, var = prepared(arrays)
    if rows:
        out[rows] = np.sqrt(fit(e2, start)[2] * var)
    return out


def garch_forecast(rets: Column) -> Column:
    @F.pandas_udf("double")
    def forecast(batch: pd.Series) -> pd.Series:
        parts = [fit_many(list(batch.iloc[i:i + FITS_AT_ONCE])) for i in range(0, len(batch), FITS_AT_ONCE)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0), index=batch.index)

    return F.nanvl(forecast(rets), F.lit(None).cast("double"))
