"""Incomplete LU factors on the pattern of a matrix, ILU(0), by levels.

Row i waits for the rows that its entries left of the diagonal name.  The length of
the longest such path is its level; rows of one level are independent, so factoring
and both triangular solves go level by level, all rows of a level at once.
"""

from __future__ import annotations

import numpy as np


def levels_of(n: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The length of the longest path from each row, along entries (row, col) with
    col < row."""
    before = cols < rows
    starts, waits = np.searchsorted(rows[before], np.arange(n + 1)).tolist(), cols[before]
    level = np.zeros(n, np.int64)
    for i in range(n):
        if starts[i] < starts[i + 1]:
            level[i] = level[waits[starts[i] : starts[i + 1]]].max() + 1
    return level


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges [first, last), and which range each is of."""
    size = last - first
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[of], of


class Ilu:
    """The factors of a matrix whose entries are sorted by row and column.

    A missing diagonal entry is added as zero; a pivot that is zero or so small
    against its row that dividing by it says nothing gives way to the row's largest
    magnitude, which keeps the factors finite.
    """

    SMALL = 1e-12

    def __init__(self, n: int, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray):
        lacking = np.setdiff1d(np.arange(n), rows[rows == cols])
        rows, cols, vals = np.concatenate([rows, lacking]), np.concatenate([cols, lacking]), np.concatenate([vals.astype(float), np.zeros(len(lacking))])
        order = np.lexsort((cols, rows))
        self.n, self.rows, self.cols, self.vals = n, rows[order].astype(np.int64), cols[order].astype(np.int64), vals[order]
        self.offsets = np.searchsorted(self.rows, np.arange(n + 1))
        self.pivot = np.flatnonzero(self.rows == self.cols)
        self.level = levels_of(n, self.rows, self.cols)
        self.back = levels_of(n, (n - 1 - self.rows)[::-1], (n - 1 - self.cols)[::-1])[::-1]
        self.scale = np.maximum.reduceat(np.abs(self.vals), self.offsets[:-1]) if n else np.zeros(0)
        self._factor()
        self._forward = self._plan(self.level, self.cols < self.rows)
        self._backward = self._plan(self.back, self.cols > self.rows)

    def _factor(self) -> None:
        keys = self.rows * self.n + self.cols
        for at in range(int(self.level.max(initial=-1)) + 1):
            own = np.flatnonzero(self.level == at)
            # The t-th entry left of the diagonal of every row of the level, for t = 0, 1, ...
            left = self.pivot[own] - self.offsets[own]
            for t in range(int(left.max(initial=0))):
                i = own[left > t]
                entry = self.offsets[i] + t
                k = self.cols[entry]
                self.vals[entry] /= self.vals[self.pivot[k]]
                # Row k right of its diagonal, taken off where row i has an entry too.
                place, of = _ranges(self.pivot[k] + 1, self.offsets[k + 1])
                key = i[of] * self.n + self.cols[place]
                found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                there = keys[found] == key
                self.vals[found[there]] -= self.vals[entry][of[there]] * self.vals[place[there]]
            weak = own[np.abs(self.vals[self.pivot[own]]) <= self.SMALL * self.scale[own]]
            self.vals[self.pivot[weak]] = np.where(self.scale[weak] > 0, self.scale[weak], 1.0)

    def _plan(self, level: np.ndarray, part: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each level its rows, and the entries of ``part`` in them with their place among these rows."""
        entries = np.flatnonzero(part)
        by_level, of_row = np.argsort(level, kind="stable"), level[self.rows[entries]]
        order = np.argsort(of_row, kind="stable")
        count = int(level.max(initial=-1)) + 1
        cuts, entry_cuts = np.searchsorted(level[by_level], np.arange(count + 1)), np.searchsorted(of_row[order], np.arange(count + 1))
        place, out = np.zeros(self.n, np.int64), []
        for at in range(count):
            own, some = by_level[cuts[at] : cuts[at + 1]], entries[order[entry_cuts[at] : entry_cuts[at + 1]]]
            place[own] = np.arange(len(own))
            out.append((own, some, place[self.rows[some]]))
        return out

    def solve(self, r: np.ndarray) -> np.ndarray:
        """The x with L U x = r."""
        x = r.astype(float).copy()
        for own, entries, place in self._forward:
            if len(entries):
                x[own] -= np.bincount(place, self.vals[entries] * x[self.cols[entries]], minlength=len(own))
        for own, entries, place in self._backward:
            if len(entries):
                x[own] -= np.bincount(place, self.vals[entries] * x[self.cols[entries]], minlength=len(own))
            x[own] /= self.vals[self.pivot[own]]
        return x
