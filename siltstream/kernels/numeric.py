"""Numerics that need no library beyond numpy."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t distribution, by bisection on its distribution function."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, df)
    cdf = lambda t: 1 - 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def erfinv(y: float) -> float:
    """Inverse error function, by Newton's method."""
    if abs(y) >= 1:
        return math.copysign(math.inf, y)
    a = 0.147
    ln = math.log(1 - y * y)
    x = math.copysign(math.sqrt(math.sqrt((2 / (math.pi * a) + ln / 2) ** 2 - ln / a) - (2 / (math.pi * a) + ln / 2)), y)
    for _ in range(6):
        x -= (math.erf(x) - y) / (2 / math.sqrt(math.pi) * math.exp(-x * x))
    return x


def neighbours(points: np.ndarray, n: int, p: float, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Distances (Minkowski p) and positions of the n nearest other points of each point, in blocks."""
    size = len(points)
    n = max(0, min(n, size - 1))
    dist, at = np.empty((size, n)), np.empty((size, n), np.int64)
    for a in range(0, size, block):
        diff = np.abs(points[a : a + block, None, :] - points[None, :, :])
        d = diff.sum(axis=2) if p == 1 else np.sqrt((diff * diff).sum(axis=2)) if p == 2 else (diff**p).sum(axis=2) ** (1 / p)
        rows = np.arange(len(d))
        d[rows, rows + a] = np.inf
        pick = np.argsort(d, axis=1, kind="stable")[:, :n]
        dist[a : a + block], at[a : a + block] = np.take_along_axis(d, pick, axis=1), pick
    return dist, at


def lof(points: np.ndarray, n: int, p: float) -> np.ndarray:
    """Negative local outlier factor of each point."""
    dist, at = neighbours(points, n, p)
    if dist.shape[1] == 0:
        return np.full(len(points), np.nan)
    reach = np.maximum(dist, dist[at, -1])
    density = 1 / (reach.mean(axis=1) + 1e-10)
    return -(density[at].mean(axis=1) / density)


def loop(points: np.ndarray, n: int, p: float, extent: float = 1.0) -> np.ndarray:
    """Negative local outlier probability of each point."""
    dist, at = neighbours(points, n, p)
    if dist.shape[1] == 0:
        return np.full(len(points), np.nan)
    sigma = np.sqrt((dist**2).sum(axis=1) / (dist.shape[1] + 1))
    lam = math.sqrt(2) * erfinv(extent) if extent < 1 else 1.0
    own = lam * sigma
    mean = np.concatenate([own[:, None], own[at]], axis=1).mean(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        plof = np.nan_to_num(own / mean - 1)
        nplof = lam * math.sqrt(2) * math.sqrt(float((plof**2).mean()))
        score = plof / nplof if nplof > 0 else np.zeros(len(plof))
    return -np.maximum(0, np.array([math.erf(x) for x in score]))


def grubbs(x: np.ndarray, alpha: float) -> np.ndarray:
    """Positions of outliers by the two-sided Grubbs test, taken out one by one."""
    left, out = np.flatnonzero(~np.isnan(x)), []
    while (n := len(left)) > 2:
        v = x[left]
        sd = v.std(ddof=1)
        if not sd:
            break
        i = int(np.argmax(np.abs(v - v.mean())))
        t = t_quantile(1 - alpha / (2 * n), n - 2)
        if abs(v[i] - v.mean()) / sd <= (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t)):
            break
        out.append(left[i])
        left = np.delete(left, i)
    return np.array(out, np.int64)


def stray(x: np.ndarray, start: float, alpha: float) -> np.ndarray:
    """Positions of the upper tail that begins with a gap too wide for the gaps below it."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    y = x[order]
    gaps = np.diff(y, prepend=y[:1])
    k = max(min(n // 4, 50), 2)
    weight = np.arange(2, k + 1) / (k - 1)
    for i in range(max(int(n * start), 1), n):
        back = gaps[max(0, i - k + 1) : i][::-1]
        if gaps[i] > -math.log(alpha) * float((weight[: len(back)] * back).sum()):
            return order[i:]
    return np.empty(0, np.int64)


def linkage_clusters(d: np.ndarray, cut: float, method: str = "single") -> np.ndarray:
    """Cluster numbers of an agglomerative clustering of a distance matrix, cut at a distance (Lance-Williams updates)."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    of, size, alive = np.arange(n), np.ones(n), np.ones(n, bool)
    for _ in range(n - 1):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if d[i, j] > cut:
            break
        for k in np.flatnonzero(alive):
            if k in (i, j):
                continue
            a, b = d[i, k], d[j, k]
            d[i, k] = d[k, i] = {"single": min(a, b), "complete": max(a, b), "average": (size[i] * a + size[j] * b) / (size[i] + size[j]), "weighted": (a + b) / 2}[method]
        size[i] += size[j]
        alive[j] = False
        d[j, :] = d[:, j] = np.inf
        of[of == j] = i
    return np.unique(of, return_inverse=True)[1]


def butter_low(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a digital Butterworth low-pass (cutoff as a share of the Nyquist frequency), by the bilinear transform."""
    warped = 4 * math.tan(math.pi * cutoff / 2)
    poles = warped * np.exp(1j * math.pi * (np.arange(1, order + 1) * 2 + order - 1) / (2 * order))
    z = (4 + poles) / (4 - poles)
    gain = (np.prod(-poles) / np.prod(4 - poles)).real
    return gain * np.poly(-np.ones(order)).real, np.poly(z).real


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    y, z = np.empty(len(x)), state.copy()
    for i, v in enumerate(x):
        y[i] = b[0] * v + z[0]
        z[:-1] = b[1:-1] * v + z[1:] - a[1:-1] * y[i]
        z[-1] = b[-1] * v - a[-1] * y[i]
    return y


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray | None:
    """Forward and backward filtering with odd padding; None for a series too short to pad."""
    pad, n = 3 * max(len(a), len(b)), len(a) - 1
    if len(x) <= pad:
        return None
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] += np.eye(n - 1)
    steady = np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])
    y = _filter(b, a, ext, steady * ext[0])
    y = _filter(b, a, y[::-1], steady * y[-1])[::-1]
    return y[pad:-pad]


def dtw(x: np.ndarray, y: np.ndarray) -> float:
    """Distance of two courses under dynamic time warping (absolute differences)."""
    n, m = len(x), len(y)
    row = np.full(m + 1, np.inf)
    row[0] = 0.0
    for i in range(n):
        cost = np.abs(x[i] - y)
        new = np.full(m + 1, np.inf)
        best = np.minimum(row[1:], row[:-1])
        acc = np.inf
        for j in range(m):
            acc = cost[j] + min(best[j], acc)
            new[j + 1] = acc
        row = new
    return float(row[m])


def ricker(width: float) -> np.ndarray:
    """A Ricker wavelet of ten widths."""
    n = max(3, int(10 * width))
    t = np.arange(n) - (n - 1) / 2
    r = (t / width) ** 2
    return 2 / (math.sqrt(3 * width) * math.pi**0.25) * (1 - r) * np.exp(-r / 2)


def fit_curve(model: Callable, x: np.ndarray, y: np.ndarray, start: np.ndarray, steps: int = 100) -> np.ndarray | None:
    """Least squares by Levenberg and Marquardt; None where it fails."""
    p, lam = np.asarray(start, float), 1e-3
    try:
        r = y - model(x, *p)
        for _ in range(steps):
            jac = np.stack([(model(x, *(p + h)) - model(x, *p)) / 1e-6 for h in np.eye(len(p)) * 1e-6], axis=1)
            a, g = jac.T @ jac, jac.T @ r
            step = np.linalg.solve(a + lam * np.diag(np.diag(a) + 1e-12), g)
            new = y - model(x, *(p + step))
            if np.isfinite(new).all() and new @ new < r @ r:
                p, done, r, lam = p + step, abs(r @ r - new @ new) < 1e-12 * (1 + r @ r), new, lam / 10
                if done:
                    break
            else:
                lam *= 10
                if lam > 1e12:
                    break
    except (np.linalg.LinAlgError, FloatingPointError, ValueError):
        return None
    return p if np.isfinite(p).all() else None


def pd_fill(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each value, or the last one before it."""
    return x[at[np.maximum(np.searchsorted(at, np.arange(len(x)), side="right") - 1, 0)]]


def interpolate(t: np.ndarray, x: np.ndarray, method: str = "time", gap_limit: int | None = None, extrapolate: str | None = None, order: int = 2) -> np.ndarray:
    """Fill gaps shorter than ``gap_limit`` values (None: all inner ones), and the ends if asked for."""
    out, known = x.copy(), ~np.isnan(x)
    if not known.any() or (gap_limit is not None and gap_limit < 2):
        return out
    at = np.flatnonzero(known)
    pos = t.astype(float) if method == "time" else np.arange(len(x), dtype=float)
    if method in ("spline", "polynomial") and len(at) > order:
        line = np.empty(len(x))
        for i in range(len(x)):  # through the nearest order + 1 values
            near = np.sort(at[np.argsort(np.abs(pos[at] - pos[i]), kind="stable")[: order + 1]])
            w = np.array([np.prod([(pos[i] - pos[k]) / (pos[j] - pos[k]) for k in near if k != j]) for j in near])
            line[i] = w @ x[near]
    elif method in ("time", "linear", "slinear", "index", "values"):
        if method in ("slinear", "index", "values"):
            pos = t.astype(float)
        line = np.interp(pos, pos[at], x[at])
    elif method in ("nearest", "zero"):
        pos = t.astype(float)
        after = np.clip(np.searchsorted(at, np.arange(len(x))), 0, len(at) - 1)
        before = np.maximum(np.searchsorted(at, np.arange(len(x)), side="right") - 1, 0)
        left, right = at[before], at[after]
        line = x[left if method == "zero" else np.where(pos - pos[left] <= pos[right] - pos, left, right)]
    elif method in ("pad", "ffill"):
        line = pd_fill(x, at)
    else:
        raise ValueError(f"unknown interpolation {method!r}")
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (~known).astype(int), [0]])))
    for a, b in edges.reshape(-1, 2):
        inner = a > 0 and b < len(x)
        end = (a == 0 and extrapolate in ("backward", "both")) or (b == len(x) and extrapolate in ("forward", "both"))
        if (inner or end) and (gap_limit is None or b - a < gap_limit):
            out[a:b] = line[a:b]
    return out
