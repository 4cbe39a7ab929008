"""Autoregressions whose least squares follow a moving origin.

A shape is (d, seasonal, p): p lags and a constant on values differenced d times, after a seasonal difference
or none.  Its normal equations are kept as a triangular factor to which a new value adds one row, so that a rolling protocol is
one pass over the series and not a regression an origin.  Where old values leave the window,
the window is two stacks of factors: the older values' factors are made once, from the newest backwards, and dropped one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

Shape = tuple[int, int, int]
SHAPES: tuple[Shape, ...] = tuple((d, s, p) for d in (0, 1, 2) for s in (0, 1) for p in range(4))


def merged(*factors: np.ndarray) -> np.ndarray:
    """The triangular factor of rows that have these factors."""
    return np.linalg.qr(np.vstack(factors), mode="r")


class Regression:
    """Least squares of the last column of rows on the others."""

    def __init__(self, columns: int):
        self.empty = np.zeros((0, columns))
        self.new, self.rows, self.old = self.empty, [], []

    def __len__(self) -> int:
        return len(self.rows) + len(self.old)

    def add(self, rows: np.ndarray) -> None:
        self.rows += list(rows)
        self.new = merged(self.new, rows) if len(rows) else self.new

    def drop(self, n: int) -> None:
        """The n oldest rows go."""
        for _ in range(n):
            if not self.old:
                at = self.empty
                for row in reversed(self.rows):
                    at = merged(at, row[None])
                    self.old.append(at)
                self.rows, self.new = [], self.empty
            self.old.pop()

    def solved(self) -> tuple[np.ndarray, float]:
        """(weights, mean square of what is left)."""
        r = merged(self.old[-1], self.new) if self.old else self.new
        w, *_ = np.linalg.lstsq(r[:, :-1], r[:, -1], rcond=None)
        return w, float(((r[:, -1] - r[:, :-1] @ w) ** 2).sum()) / len(self)


def _rows(y: np.ndarray, shape: Shape, season: int, first: int, last: int) -> np.ndarray:
    """Lags (the nearest first), 1 and the value itself of the places first to last - 1 of y, all differenced."""
    d, seasonal, p = shape
    lead = d + season * seasonal + p
    z = y[first - lead : last]
    z = z[season:] - z[:-season] if seasonal else z
    z = np.diff(z, n=d) if d else z
    n = last - first
    return np.stack([*[z[p - k : p - k + n] for k in range(1, p + 1)], np.ones(n), z[p : p + n]], axis=1)


def criterion(mean_square: float, p: int, n: int) -> float:
    """Corrected AIC an observation, so that shapes with different numbers of rows compare."""
    k = p + 2
    return np.log(max(mean_square, 1e-12)) + (2 * k + 2 * k * (k + 1) / max(n - k - 1, 1)) / n


def fits(y: np.ndarray, origins: Sequence[int], season: int, shapes: Sequence[Shape] = SHAPES, last: int = 5000) -> Iterator[tuple[Shape, np.ndarray] | None]:
    """The best (shape, weights) of the `last` values before each origin; origins ascend.  None: too few values for any."""
    state = {s: (Regression(s[2] + 2), s[0] + season * s[1] + s[2]) for s in shapes if not s[1] or season > 1}
    done = 0
    for origin in origins:
        begin, best = max(0, origin - last), None
        for shape, (regression, lead) in state.items():
            new = max(done, lead)
            if origin > new:
                regression.add(_rows(y, shape, season, new, origin))
            regression.drop(max(0, len(regression) - max(0, origin - begin - lead)))
            n, p = len(regression), shape[2]
            if n < 2 * p + 5 or (shape[1] and not (season <= 24 and 3 * season < origin - begin < 3000)):
                continue
            weights, mean_square = regression.solved()
            value = criterion(mean_square, p, n)
            if best is None or value < best[0]:
                best = (value, shape, weights)
        done = origin
        yield best[1:] if best else None


def ahead(y: np.ndarray, fit: tuple[Shape, np.ndarray] | None, steps: int, season: int) -> np.ndarray:
    """The next values after y; without a fit the last one stays."""
    if fit is None:
        return np.full(steps, y[-1])
    (d, seasonal, p), weights = fit
    past = list(y[-(d + season * seasonal + p + 1) :])
    for _ in range(steps):
        x = np.array(past)
        z = x[season:] - x[:-season] if seasonal else x
        levels = [np.diff(z, n=k) for k in range(d + 1)]
        value = float(np.append(levels[d][::-1][:p], 1.0) @ weights) + sum(float(level[-1]) for level in levels[:d])
        past.append(value + (past[-season] if seasonal else 0.0))
    return np.array(past[len(past) - steps :])
