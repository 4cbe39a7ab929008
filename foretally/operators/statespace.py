"""Seasonal ARIMA by exact likelihood.

The differenced series is an ARMA process in state-space form.  Its innovations come from a Kalman filter
whose gain follows the rank-one change of the state's covariance, so that a step costs a vector and not a
matrix; many parameter vectors are filtered at once, which gives gradients and line searches in one pass.  Mean
and variance are solved for inside the likelihood.  Differences are chosen by tests, orders by a stepwise search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The 5 % point of the KPSS statistic around a level, and the coefficients of the seasonal test's 5 % point by period.
KPSS_5 = 0.463
OCSB_5 = (-0.2937411, -0.2850853, 0.7656451, -0.05983644, -1.652202)
#: Iterations while orders are compared and for the model that is chosen.
SEARCH, FINAL = 6, 40


@dataclass(frozen=True)
class Order:
    p: int
    d: int
    q: int
    P: int = 0
    D: int = 0
    Q: int = 0
    m: int = 1
    mean: bool = True

    @property
    def size(self) -> int:
        return self.p + self.q + self.P + self.Q


def differenced(y: np.ndarray, o: Order) -> np.ndarray:
    w = y[o.m :] - y[: -o.m] if o.D else y
    return np.diff(w, n=o.d) if o.d else w


def coefficients(z: np.ndarray) -> np.ndarray:
    """Rows of a stationary autoregression from rows of free numbers, by way of partial autocorrelations."""
    r = np.tanh(z)
    out = np.zeros_like(r)
    for k in range(r.shape[1]):
        out[:, :k] = out[:, :k] - r[:, k : k + 1] * out[:, :k][:, ::-1]
        out[:, k] = r[:, k]
    return out


def free(phi: np.ndarray) -> np.ndarray:
    """The inverse of coefficients() for one row, which is drawn into the stationary region if it lies outside."""
    phi, r = np.array(phi, float), np.zeros(len(phi))
    for k in range(len(phi) - 1, -1, -1):
        r[k] = np.clip(phi[k], -0.95, 0.95)
        phi = (phi[:k] + r[k] * phi[:k][::-1]) / (1 - r[k] ** 2)
    return np.arctanh(r)


def polynomials(z: np.ndarray, o: Order) -> tuple[np.ndarray, np.ndarray]:
    """(autoregressive, moving-average) coefficients of each row of parameters, seasonal factors multiplied out."""
    cut = np.cumsum([o.p, o.q, o.P, o.Q])
    phi, theta, seasonal, seasonal_theta = (coefficients(z[:, a:b]) for a, b in zip([0, *cut[:-1]], cut, strict=True))

    def product(short: np.ndarray, long: np.ndarray, sign: int) -> np.ndarray:
        out = np.zeros((len(z), short.shape[1] + o.m * long.shape[1]))
        out[:, : short.shape[1]] = short
        for k in range(long.shape[1]):
            at = o.m * (k + 1)
            out[:, at - 1] += long[:, k]
            out[:, at : at + short.shape[1]] -= sign * short * long[:, k : k + 1]
        return out

    # (1 - a B)(1 - b B^m) and (1 + a B)(1 + b B^m), as what is subtracted from or added to 1
    return product(phi, seasonal, 1), product(-theta, -seasonal_theta, -1)


def autocovariances(phi: np.ndarray, theta: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """(covariances with the process up to `lags`, weights of past shocks) of ARMA processes with unit shocks."""
    b, p, q = len(phi), phi.shape[1], theta.shape[1]
    one = np.hstack((np.ones((b, 1)), theta))
    psi = np.zeros((b, q + 1))
    for k in range(q + 1):
        psi[:, k] = one[:, k] + (phi[:, : min(k, p)] * psi[:, :k][:, ::-1][:, :p]).sum(axis=1)
    right = np.zeros((b, p + 1))
    for k in range(min(p, q) + 1):
        right[:, k] = (one[:, k:] * psi[:, : q + 1 - k]).sum(axis=1)
    left = np.zeros((b, p + 1, p + 1))
    left[:, np.arange(p + 1), np.arange(p + 1)] = 1.0
    for k in range(p + 1):
        for j in range(1, p + 1):
            left[:, k, abs(k - j)] -= phi[:, j - 1]
    gamma = np.zeros((b, max(lags, p) + 1))
    gamma[:, : p + 1] = np.linalg.solve(left, right[:, :, None])[:, :, 0]
    for k in range(p + 1, lags + 1):
        gamma[:, k] = (phi * gamma[:, k - p : k][:, ::-1]).sum(axis=1) if p else 0.0
        if k <= q:
            gamma[:, k] += (one[:, k:] * psi[:, : q + 1 - k]).sum(axis=1)
    return gamma, psi


def innovations(phi: np.ndarray, theta: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one-step errors, their variances, last state) for each row of coefficients and each column of x, under unit shocks."""
    b, p, q = len(phi), phi.shape[1], theta.shape[1]
    r, n = max(p, q + 1), len(x)
    gamma, psi = autocovariances(phi, theta, r)
    ar, ma = np.zeros((b, r)), np.zeros((b, r))
    ar[:, :p], ma[:, 0], ma[:, 1 : q + 1] = phi, 1.0, theta
    # the covariance of the state with the process
    c = np.zeros((b, r + 1))
    c[:, 0] = gamma[:, 0]
    for i in range(1, r):
        c[:, i] = (ar[:, i:] * gamma[:, 1 : r - i + 1]).sum(axis=1) + (ma[:, i : q + 1] * psi[:, : max(0, q + 1 - i)]).sum(axis=1)
    f = gamma[:, 0].copy()
    gain = (ar * c[:, :1] + c[:, 1:]) / f[:, None]
    y = np.zeros((b, r + 1))
    y[:, :r], m = gain, -f
    a = np.zeros((b, r + 1, x.shape[1]))
    errors, variances = np.empty((n, b, x.shape[1])), np.empty((n, b))
    settled = False
    for t in range(n):
        v = x[t] - a[:, 0]
        errors[t], variances[t] = v, f
        a[:, :r] = ar[:, :, None] * a[:, :1] + a[:, 1:] + gain[:, :, None] * v[:, None]
        if settled:
            continue
        zy = y[:, 0].copy()
        mz = m * zy
        ahead = ar * zy[:, None] + y[:, 1:]
        after = f + mz * zy
        gain = (gain * f[:, None] + ahead * mz[:, None]) / after[:, None]
        y[:, :r] = ahead - gain * zy[:, None]
        m, f = m + mz * mz / f, after
        settled = t % 8 == 7 and float((np.abs(m)[:, None] * y[:, :r] ** 2).max()) < 1e-14
    return errors, variances, a


@dataclass(frozen=True)
class Fit:
    order: Order
    z: np.ndarray
    mean: float
    variance: float
    log_likelihood: float

    @property
    def aic(self) -> float:
        return 2 * (self.order.size + self.order.mean + 1) - 2 * self.log_likelihood


def _profiles(z: np.ndarray, o: Order, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihood, mean, variance) of each row of parameters, at the best mean and variance."""
    e, f, _ = innovations(*polynomials(z, o), np.stack((w, np.ones(len(w))), axis=1))
    mean = (e[:, :, 0] * e[:, :, 1] / f).sum(axis=0) / (e[:, :, 1] ** 2 / f).sum(axis=0) if o.mean else np.zeros(len(z))
    variance = np.maximum(((e[:, :, 0] - mean * e[:, :, 1]) ** 2 / f).mean(axis=0), 1e-300)
    return -0.5 * (len(w) * (np.log(2 * np.pi * variance) + 1) + np.log(f).sum(axis=0)), mean, variance


def log_likelihood(z: np.ndarray, o: Order, w: np.ndarray) -> float:
    return float(_profiles(np.atleast_2d(np.asarray(z, float)), o, w)[0][0])


def started(o: Order, w: np.ndarray) -> np.ndarray:
    """Parameters by two regressions: shocks from a long autoregression, then the series on its own and the shocks' past."""
    x = w - w.mean() if o.mean else w
    n = len(x)
    ar, ma = [*range(1, o.p + 1), *[o.m] * o.P], [*range(1, o.q + 1), *[o.m] * o.Q]
    if not ar and not ma:
        return np.zeros(0)
    long = min(max(int(10 * np.log10(max(n, 2))), 2 * o.m * bool(o.P or o.Q)), n // 4) if ma else 0
    past = lambda s, lags, first: [s[first - k : n - k] for k in lags]
    shocks = np.zeros(n)
    if long:
        a = np.stack(past(x, range(1, long + 1), long), axis=1)
        shocks[long:] = x[long:] - a @ np.linalg.lstsq(a, x[long:], rcond=None)[0]
    first = long + max([0, *ar, *ma])
    if n - first < 2 * (len(ar) + len(ma)):
        return np.zeros(o.size)
    b = np.linalg.lstsq(np.stack(past(x, ar, first) + past(shocks, ma, first), axis=1), x[first:], rcond=None)[0]
    cut = np.cumsum([o.p, o.P, o.q])
    phi, seasonal, theta, seasonal_theta = np.split(b, cut)
    return np.concatenate((free(phi), free(-theta), free(seasonal), free(-seasonal_theta)))


def fit(o: Order, w: np.ndarray, iterations: int, z: np.ndarray | None = None) -> Fit:
    """The likeliest parameters found in so many quasi-Newton iterations; each is two passes, one for the gradient and one for eight step lengths."""
    z = started(o, w) if z is None else z
    value, mean, variance = (x[0] for x in _profiles(z[None], o, w))
    k, h = o.size, 1e-5
    inverse, before = np.eye(k) / max(1, len(w)), None
    for _ in range(iterations if k else 0):
        around = _profiles(np.vstack((z + h * np.eye(k), z - h * np.eye(k))), o, w)[0]
        slope = -(around[:k] - around[k:]) / (2 * h)
        if before is not None:
            s, g = z - before[0], slope - before[1]
            if s @ g > 1e-12:
                rho = 1 / (s @ g)
                left = np.eye(k) - rho * np.outer(s, g)
                inverse = left @ inverse @ left.T + rho * np.outer(s, s)
        before = (z, slope)
        step = -inverse @ slope
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        tried = np.clip(z + step * (2.0 ** np.arange(1, -7, -1))[:, None], -8, 8)
        values, means, variances = _profiles(tried, o, w)
        best = int(np.nanargmax(values)) if np.isfinite(values).any() else 0
        if not values[best] > value + 1e-9:
            break
        z, value, mean, variance = tried[best], values[best], means[best], variances[best]
    return Fit(o, z, float(mean), float(variance), float(value))


def kpss(x: np.ndarray) -> float:
    """The KPSS statistic around a level."""
    n = len(x)
    e = x - x.mean()
    lags = int(3 * np.sqrt(n) / 13)
    long_run = e @ e / n + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
    return float((np.cumsum(e) ** 2).sum() / (n * n * long_run)) if long_run > 0 else 0.0


def seasonal_root(y: np.ndarray, m: int, most: int = 3) -> bool:
    """Whether a seasonal unit root isn't rejected by the regression of Osborn, Chui, Smith and Birchenhall; the lags with the least AIC."""
    both, best = np.diff(y[m:] - y[:-m]), None
    for lags in range(most + 1):
        first = lags + m + 1
        if len(both) - first < 3 * (lags + 2):
            break
        past = np.stack([both[lags - k : len(both) - k] for k in range(1, lags + 1)], axis=1) if lags else np.zeros((len(both), 0))
        weights = np.linalg.lstsq(past, both[lags:], rcond=None)[0] if lags else np.zeros(0)
        whiten = lambda s: s[lags:] - sum((w * s[lags - k : len(s) - k] for k, w in enumerate(weights, 1)), np.zeros(len(s) - lags))  # noqa: B023, E731
        z4, z5 = whiten(y[m:] - y[:-m]), whiten(np.diff(y))
        n = len(both) - lags - m
        if n < 2 * (lags + 2):
            break
        target = both[-n:]
        lagged = [both[len(both) - n - k : len(both) - k] for k in range(1, lags + 1)]
        a = np.stack([*lagged, z4[-n - 1 : -1], z5[-n - m : -m]], axis=1)
        w, *_ = np.linalg.lstsq(a, target, rcond=None)
        rss = max(float(((target - a @ w) ** 2).sum()), 1e-300)
        aic = n * np.log(rss / n) + 2 * a.shape[1]
        if best is None or aic < best[0]:
            error = np.sqrt(rss / max(n - a.shape[1], 1) * np.linalg.pinv(a.T @ a)[-1, -1])
            best = (aic, w[-1] / error if error > 0 else -np.inf)
    if best is None:
        return False
    a, b, c, d, e = OCSB_5
    u = np.log(m) - c
    return bool(best[1] > a * np.exp(b * u + d * u * u) + e)


def differences(y: np.ndarray, m: int) -> tuple[int, int]:
    """(d up to 2, D up to 1)."""
    D = int(m > 1 and len(y) > 3 * m and seasonal_root(y, m))
    w, d = (y[m:] - y[:-m] if D else y), 0
    while d < 2 and len(w) > 4 and np.ptp(w) > 0 and kpss(w) > KPSS_5:
        w, d = np.diff(w), d + 1
    return d, D


def auto_arima(history: np.ndarray, season: int, most: tuple[int, int, int, int] = (3, 3, 1, 1), last: int = 5000) -> Fit | None:
    """The model with the least AIC found by steps of one in the orders; None where there are too few values or no variation.

    Only the last 5,000 values count; there are seasonal terms for seasons of up to 24 in fewer than 3,000 values.
    """
    y = np.asarray(history, float)[-last:]
    m = season if 1 < season <= 24 and len(y) < 3000 else 1
    if len(y) < 4 or np.ptp(y) == 0:
        return None
    scale = y.std()
    y = (y - y.mean()) / scale
    d, D = differences(y, m)
    w = differenced(y, Order(0, d, 0, D=D, m=m))
    if np.ptp(w) < 1e-12:
        return Fit(Order(0, d, 0, D=D, m=m, mean=True), np.zeros(0), float(w[0]) * scale, 0.0, np.inf)
    tried: dict[Order, Fit] = {}

    def look(p: int, q: int, P: int, Q: int, mean: bool) -> Fit | None:
        o = Order(p, d, q, P, D, Q, m, mean)
        inside = all(0 <= v <= b for v, b in zip((p, q, P, Q), (*most[:2], *(most[2:] if m > 1 else (0, 0))), strict=True))
        if not inside or (mean and d + D > 1) or o.size + 2 >= len(w) or m * (P + Q > 0) >= len(w) / 2:
            return None
        if o not in tried:
            tried[o] = fit(o, w, SEARCH)
        return tried[o]

    some = d + D <= 1
    best = None
    for p, q, P, Q in ((2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1)):
        f = look(min(p, most[0]), min(q, most[1]), P * (m > 1), Q * (m > 1), some)
        best = f if f and (best is None or f.aic < best.aic) else best
    steps = [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (1, 1, 0, 0), (0, 0, 1, 1)]
    better = best is not None
    while better:
        o, better = best.order, False
        near = [(o.p + s * a, o.q + s * b, o.P + s * c, o.Q + s * e, o.mean) for a, b, c, e in steps for s in (1, -1)] + [(o.p, o.q, o.P, o.Q, not o.mean)]
        for f in (look(*x) for x in near):
            if f and f.aic < best.aic - 1e-9:
                best, better = f, True
                break
    if best is None:
        return None
    best = fit(best.order, w, FINAL, best.z)
    return Fit(best.order, best.z, best.mean * scale, best.variance * scale * scale, best.log_likelihood - len(w) * np.log(scale))


def forecast(model: Fit | None, history: np.ndarray, steps: int, last: int = 5000) -> np.ndarray:
    """The expected next values; without a model the last value stays."""
    y = np.asarray(history, float)[-last:]
    if model is None:
        return np.full(steps, y[-1])
    o, w = model.order, differenced(y, model.order)
    if model.variance == 0:
        ahead = np.full(steps, model.mean)
    else:
        phi, theta = polynomials(model.z[None], o)
        _, _, state = innovations(phi, theta, (w - model.mean)[:, None])
        a, ahead = state[0, :, 0], np.empty(steps)
        ar = np.zeros(len(a) - 1)
        ar[: phi.shape[1]] = phi[0]
        for h in range(steps):
            ahead[h] = a[0] + model.mean
            a = np.append(ar * a[0] + a[1:], 0.0)
    base = y[o.m :] - y[: -o.m] if o.D else y
    for k in range(o.d - 1, -1, -1):
        ahead = np.cumsum(ahead) + np.diff(base, n=k)[-1]
    if o.D:
        past = list(y[-o.m :])
        for x in ahead:
            past.append(past[-o.m] + x)
        ahead = np.array(past[o.m :])
    return ahead
