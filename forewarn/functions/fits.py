"""Small numpy helpers used inside Arrow batches and calendar-bounded groups."""

from __future__ import annotations

import numpy as np


def _gev_nll(theta: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Negative log likelihood of each row of ``theta`` (location, log scale, shape) for the same row of ``x``."""
    loc, log_scale, xi = theta[:, :1], theta[:, 1], theta[:, 2:]
    with np.errstate(all="ignore"):
        z = (x - loc) / np.exp(log_scale)[:, None]
        t = 1 + xi * z
        out = x.shape[1] * log_scale + np.sum((1 + 1 / xi) * np.log(t) + t ** (-1 / xi), axis=1)
        out[np.any(t <= 0, axis=1)] = 1e12
        flat = np.abs(xi[:, 0]) < 1e-6
        if flat.any():
            out[flat] = x.shape[1] * log_scale[flat] + np.sum(z[flat] + np.exp(-z[flat]), axis=1)
    return out


def _simplex(f, start: np.ndarray, steps: int = 20000) -> tuple[np.ndarray, np.ndarray]:
    """Plain Nelder-Mead for three parameters, a search for each row of ``start``: the best point, and whether the points met.

    All searches take a step together; one that met, or that a step leaves as it was, takes no more. ``f`` gets points and
    the rows of ``start`` they belong to.
    """
    m, d = start.shape
    pts = np.repeat(start[:, None, :], d + 1, axis=1)
    for i in range(d):
        p = start[:, i]
        pts[:, i + 1, i] += np.where(p == 0, 0.1, 0.1 * np.abs(p))
    vals = f(pts.reshape(-1, d), np.repeat(np.arange(m), d + 1)).reshape(m, d + 1)
    best, met = np.empty((m, d)), np.zeros(m, bool)
    row = np.arange(m)

    def ended(which: np.ndarray) -> None:
        best[row[which]] = pts[which, np.argmin(vals[which], axis=1)]

    for _ in range(steps):
        order = np.argsort(vals, axis=1)
        pts, vals = np.take_along_axis(pts, order[:, :, None], axis=1), np.take_along_axis(vals, order, axis=1)
        with np.errstate(all="ignore"):
            done = np.abs(vals[:, -1] - vals[:, 0]) < 1e-10
        if done.any():
            met[row[done]] = True
            ended(done)
            pts, vals, row = pts[~done], vals[~done], row[~done]
        if not len(row):
            break
        worst = pts[:, -1]
        mid = np.mean(pts[:, :-1], axis=1)
        refl = mid + (mid - worst)
        fr = f(refl, row)
        new, new_vals = pts.copy(), vals.copy()
        far = fr < vals[:, 0]
        fine = far | (fr < vals[:, -2])
        new[fine, -1], new_vals[fine, -1] = refl[fine], fr[fine]
        if far.any():
            grown = mid[far] + 2 * (mid[far] - worst[far])
            fg = f(grown, row[far])
            better = np.flatnonzero(far)[fg < fr[far]]
            new[better, -1], new_vals[better, -1] = grown[fg < fr[far]], fg[fg < fr[far]]
        poor = np.flatnonzero(~fine)
        if len(poor):
            inner = mid[poor] + 0.5 * (worst[poor] - mid[poor])
            fi = f(inner, row[poor])
            closer = fi < vals[poor, -1]
            new[poor[closer], -1], new_vals[poor[closer], -1] = inner[closer], fi[closer]
            shrunk = poor[~closer]
            if len(shrunk):
                first = pts[shrunk, :1]
                new[shrunk] = first + 0.5 * (pts[shrunk] - first)
                new_vals[shrunk] = f(new[shrunk].reshape(-1, d), np.repeat(row[shrunk], d + 1)).reshape(-1, d + 1)
                still = np.zeros(len(row), bool)
                still[shrunk] = (new[shrunk] == pts[shrunk]).all(axis=(1, 2)) & (new_vals[shrunk] == vals[shrunk]).all(axis=1)
                if still.any():
                    ended(still)
                    new, new_vals, row = new[~still], new_vals[~still], row[~still]
        pts, vals = new, new_vals
    if len(row):
        ended(np.ones(len(row), bool))
    return best, met


def _level(theta: np.ndarray, period: int) -> np.ndarray:
    loc, log_scale, xi = theta.T
    y = -np.log(1 - 1 / period)
    flat = np.abs(xi) < 1e-6
    with np.errstate(all="ignore"):
        return np.where(flat, loc - np.exp(log_scale) * np.log(y), loc + np.exp(log_scale) * (y ** (-xi) - 1) / np.where(flat, 1.0, xi))


def gev_levels(x: np.ndarray, periods: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Return levels of each row of ``x``, the block maxima of one key, with delta-method intervals.

    Returns low, estimate and high (row, period, 3), and whether the search for the most likely parameters met. Bounds are NaN where it
    did not, or where the curvature there is not positive definite; a row of fewer than five values, or of equal ones, has no levels.
    """
    out = np.full((len(x), len(periods), 3), np.nan)
    met = np.zeros(len(x), bool)
    if x.shape[1] < 5:
        return out, met
    rows = np.flatnonzero(np.ptp(x, axis=1) != 0)
    x = x[rows]
    scale = np.std(x, axis=1, ddof=1) * np.sqrt(6) / np.pi
    start = np.stack([np.mean(x, axis=1) - 0.5772156649 * scale, np.log(scale), np.full(len(x), 0.05)], axis=1)
    theta, met[rows] = _simplex(lambda p, at: _gev_nll(p, x[at]), start)
    h = np.maximum(np.abs(theta), 1e-2) * 1e-3
    hess = np.empty((len(x), 3, 3))

    def at(i: int, j: int, a: int, b: int) -> np.ndarray:
        p = theta.copy()
        p[:, i] += a * h[:, i]
        p[:, j] += b * h[:, j]
        return _gev_nll(p, x)

    with np.errstate(all="ignore"):
        for i in range(3):
            for j in range(3):
                hess[:, i, j] = (at(i, j, 1, 1) - at(i, j, 1, -1) - at(i, j, -1, 1) + at(i, j, -1, -1)) / (4 * h[:, i] * h[:, j])
        sound = np.flatnonzero(met[rows] & np.isfinite(hess).all(axis=(1, 2)))
        sound = sound[(np.linalg.eigvalsh((hess[sound] + hess[sound].transpose(0, 2, 1)) / 2) > 0).all(axis=1)]
        cov = np.linalg.inv(hess[sound])
        for k, t in enumerate(periods):
            est = _level(theta, t)
            grad = np.empty((len(x), 3))
            for i in range(3):
                step = np.zeros_like(h)
                step[:, i] = h[:, i]
                grad[:, i] = (_level(theta + step, t) - _level(theta - step, t)) / (2 * h[:, i])
            se = np.full(len(x), np.nan)
            se[sound] = np.sqrt(np.einsum("ni,nij,nj->n", grad[sound], cov, grad[sound]))
            out[rows, k] = np.stack([est - 1.96 * se, est, est + 1.96 * se], axis=1)
    return out, met


def gamma_cdf(shape: np.ndarray, x: np.ndarray, lgamma: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma, vectorised over a batch.

    ``lgamma`` is the log gamma of ``shape + 1``. Up to ``shape + 1`` the series is added up, beyond it the continued
    fraction of the complement; a row leaves the loop when its own result stands still.
    """
    out = np.full(shape.shape, np.nan)
    ok = np.isfinite(shape) & np.isfinite(x) & (shape > 0)
    out[ok & (x <= 0)] = 0.0
    for low in (True, False):
        rows = np.flatnonzero(ok & (x > 0) & ((x <= shape + 1) == low))
        a, v = shape[rows], x[rows]
        front = np.exp(a * np.log(v) - v - lgamma[rows])
        out[rows] = np.minimum(front * _series(a, v), 1.0) if low else 1.0 - front * a * _fraction(a, v)
    return np.clip(out, 0.0, 1.0)


def _series(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    total, open_ = np.ones_like(v), np.arange(len(v))
    term, n = np.ones_like(v), 0
    while len(open_):
        n += 1
        term = term * v[open_] / (a[open_] + n)
        total[open_] += term
        left = term > 1e-17 * total[open_]
        open_, term = open_[left], term[left]
    return total


def _fraction(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    b = v + 1.0 - a
    c = np.full_like(v, 1e300)
    d = 1.0 / b
    h, open_, n = d.copy(), np.arange(len(v)), 0
    while len(open_):
        n += 1
        an = -n * (n - a[open_])
        b[open_] += 2.0
        d[open_] = 1.0 / (an * d[open_] + b[open_])
        c[open_] = b[open_] + an / c[open_]
        step = d[open_] * c[open_]
        h[open_] *= step
        open_ = open_[np.abs(step - 1.0) > 4e-16]
    return h
