"""Aggregation multigrid as a preconditioner, and Jacobi and Chebyshev beside it.

A level joins each unknown with strongly coupled neighbours into aggregates; the
coarse matrix is the sum over pairs of aggregates.  A cycle smooths by damped
Jacobi, corrects from the coarse level, and smooths again; the coarsest level is
solved directly.  Matrices are rows, columns and values in numpy arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Apply = Callable[[np.ndarray], np.ndarray]
STRONG, DAMPING, SWEEPS, COARSEST, LEVELS = 0.25, 0.67, 2, 200, 20
#: A level must have fewer unknowns than this share of the one before.
FEWER = 0.9
#: Unknown i stands at place i * ORDER mod 2**32 in the order of founders: an odd factor, so all places differ.
ORDER = 2_654_435_761


@dataclass
class Level:
    n: int
    rows: np.ndarray
    cols: np.ndarray
    vals: np.ndarray
    inverse: np.ndarray  # of the diagonal
    owner: np.ndarray | None = None  # the aggregate of each unknown

    def apply(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.vals * x[self.cols], minlength=self.n)


def inverse_diagonal(n: int, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> np.ndarray:
    on = rows == cols
    d = np.bincount(rows[on], vals[on], minlength=n)
    return np.divide(1.0, d, out=np.ones(n), where=d != 0)


def founded(order: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The founder that takes each unknown in, -1 for those left over, given their order
    and their couplings, both ways."""
    n = len(order)
    owner = np.full(n, -1)
    while True:
        free = owner < 0
        live = free[r] & free[c]
        if not live.any():
            return owner
        r, c = r[live], c[live]
        least = order.copy()
        np.minimum.at(least, r, order[c])
        # The least within two steps: founders are so far apart that none takes in another.
        second = least.copy()
        np.minimum.at(second, r, least[c])
        founders = np.flatnonzero((second == order) & (np.bincount(r, minlength=n) > 0))
        owner[founders] = founders
        near = (owner[c] == c) & (owner[r] < 0)
        owner[r[near]] = c[near]


def aggregates(n: int, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, strong: float = STRONG) -> np.ndarray:
    """The aggregate of each unknown.  Every round, an unknown whose number, mixed,
    is the least among its free strong neighbours founds an aggregate and takes
    them in; those left beside an aggregate at the end join the strongest."""
    size, off = np.abs(vals), rows != cols
    most = np.zeros(n)
    np.maximum.at(most, rows[off], size[off])
    keep = off & (size >= strong * most[rows]) & (size > 0)
    # A coupling that is strong one way counts both ways.
    r, c, s = np.concatenate([rows[keep], cols[keep]]), np.concatenate([cols[keep], rows[keep]]), np.tile(size[keep], 2)
    owner = founded(np.arange(n) * ORDER % (1 << 32), r, c)
    rest = (owner[r] < 0) & (owner[c] >= 0)
    order = np.lexsort((-c[rest], s[rest]))  # the strongest last, of equals that of the least neighbour
    owner[r[rest][order]] = owner[c[rest][order]]
    alone = owner < 0
    owner[alone] = np.flatnonzero(alone)
    return np.unique(owner, return_inverse=True)[1].ravel()


def coarsened(level: Level) -> Level:
    n = int(level.owner.max()) + 1
    place, at = np.unique(level.owner[level.rows] * n + level.owner[level.cols], return_inverse=True)
    vals = np.bincount(at.ravel(), level.vals, len(place))
    rows, cols = place // n, place % n
    return Level(n, rows, cols, vals, inverse_diagonal(n, rows, cols, vals))


class Multigrid:
    """The levels of one matrix; ``cycle`` approximates its inverse."""

    def __init__(self, n: int, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray):
        self.levels = [Level(n, rows, cols, vals, inverse_diagonal(n, rows, cols, vals))]
        while self.levels[-1].n > COARSEST and len(self.levels) < LEVELS:
            own = self.levels[-1]
            own.owner = aggregates(own.n, own.rows, own.cols, own.vals)
            if own.owner.max() + 1 > FEWER * own.n:
                own.owner = None
                break
            self.levels.append(coarsened(own))
        last = self.levels[-1]
        last.owner, self.direct = None, None
        if last.n <= 10 * COARSEST:
            dense = np.zeros((last.n, last.n))
            np.add.at(dense, (last.rows, last.cols), last.vals)
            self.direct = np.linalg.pinv(dense)

    def cycle(self, r: np.ndarray, at: int = 0) -> np.ndarray:
        own = self.levels[at]
        if own.owner is None and self.direct is not None:
            return self.direct @ r
        x = DAMPING * own.inverse * r
        for _ in range(SWEEPS - 1):
            x += DAMPING * own.inverse * (r - own.apply(x))
        if own.owner is not None:
            coarse = np.bincount(own.owner, r - own.apply(x), minlength=self.levels[at + 1].n)
            x += self.cycle(coarse, at + 1)[own.owner]
        for _ in range(SWEEPS):
            x += DAMPING * own.inverse * (r - own.apply(x))
        return x
