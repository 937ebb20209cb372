"""The GARCH fit: likelihood against a grid, derivatives, recovered parameters, odd arrays."""

import numpy as np
import pytest

from panelspark.operators import garch


def simulated(rng, w, a, b, n):
    h, out = w / (1 - a - b), []
    for _ in range(n):
        e = rng.normal() * np.sqrt(h)
        out.append(e)
        h = w + a * e * e + b * h
    return np.array(out)


def arrays():
    rng, out = np.random.default_rng(0), []
    for k in range(90):
        n = int(rng.integers(60, 251))
        out.append([lambda: rng.normal(size=n) * 0.02, lambda: simulated(rng, 1e-5, 0.1, 0.85, n), lambda: simulated(rng, 1e-4, 0.4, 0.3, n),
                    lambda: rng.standard_t(3, size=n) * 0.02, lambda: np.concatenate([rng.normal(size=n // 2) * 0.01, rng.normal(size=n - n // 2) * 0.04]),
                    lambda: rng.choice([0, 0, 0, 0.01, -0.02, 0.3], size=n) + rng.normal(size=n) * 1e-4][k % 6]())
    return out


def cost(e2, start, w, a, b):
    h, total = 1.0, 0.0
    for e in e2[start:]:
        total += np.log(h) + e / h
        h = w + a * e + b * h
    return total, h


def test_likelihood_is_that_of_the_plain_recursion():
    rows, e2, start, _ = garch.prepared(arrays())
    theta, best, h = garch.fit(e2, start)
    w, a, b, _ = garch.parameters(theta)
    assert (w > 0).all() and (a >= 0).all() and (b >= 0).all() and (a + b < 1).all()
    for k in range(0, len(rows), 7):
        assert (best[k], h[k]) == pytest.approx(cost(e2[:, k], start[k], w[k], a[k], b[k]))


def test_likelihood_is_not_below_that_of_a_fine_grid():
    """The grid holds the long-run variance fixed and refines the two other parameters three times."""
    _, e2, start, _ = garch.prepared(arrays())
    _, best, _ = garch.fit(e2, start)
    n = e2.shape[1]
    centre, width = np.tile([[0.15], [0.7]], (1, 1, n)).reshape(2, n), np.array([0.145, 0.29])
    for _ in range(3):
        steps = np.stack(np.meshgrid(np.linspace(-1, 1, 7), np.linspace(-1, 1, 7))).reshape(2, -1, 1) * width[:, None, None]
        a, b = centre[:, None, :] + steps
        bad = (a <= 0) | (b < 0) | (a + b >= 0.999)
        a, b = np.where(bad, 0.05, a), np.where(bad, 0.5, b)
        found = np.where(bad, np.inf, garch.likelihood(e2[:, None, :], start, 1 - a - b, a, b))
        at = found.argmin(axis=0), np.arange(n)
        centre, width = np.stack([a[at], b[at]]), width / 3
    assert (best - found.min(axis=0)).max() < 0.01 and np.mean(best - found.min(axis=0)) < -0.3


def test_gradient():
    _, e2, start, _ = garch.prepared(arrays()[:12])
    rng = np.random.default_rng(1)
    theta = rng.normal(size=(3, 12))
    _, gradient, _ = garch.derivatives(e2, start, theta)
    for i in range(3):
        up, down = theta.copy(), theta.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (garch.derivatives(e2, start, up)[0] - garch.derivatives(e2, start, down)[0]) / 2e-5
        assert np.allclose(gradient[i], slope, rtol=1e-4, atol=1e-4)


def test_parameters_are_recovered():
    """Medians over 40 series of 4,000 returns lie within 15 % of the truth (w) and 0.02 (a, b)."""
    rng = np.random.default_rng(4)
    for w, a, b in ((2e-5, 0.1, 0.8), (5e-5, 0.3, 0.5)):
        _, e2, start, var = garch.prepared([simulated(rng, w, a, b, 4000) for _ in range(40)])
        found = garch.parameters(garch.fit(e2, start)[0])
        assert np.median(found[0] * var) == pytest.approx(w, rel=0.15)
        assert np.median(found[1]) == pytest.approx(a, abs=0.02) and np.median(found[2]) == pytest.approx(b, abs=0.02)


def test_odd_arrays():
    out = garch.fit_many([[], [0.01] * 80, [np.nan] * 70, [0.0, 0.01], [1e8, -1e8] * 40, [np.nan, 0.01, -0.01] * 30])
    assert np.isnan(out[:3]).all() and np.isfinite(out[3:]).all() and (out[3:] > 0).all()
    assert garch.fit_many([]).size == 0
