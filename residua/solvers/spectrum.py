"""What conjugate gradients tell of a spectrum, and what a solve will cost."""

from __future__ import annotations

import math

import numpy as np


def lanczos(alphas: list[float], betas: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """The diagonal and off-diagonal of the Lanczos matrix of a CG run."""
    n = len(alphas)
    a, b = np.array(alphas, float), np.array(betas[: n - 1], float)
    diag = 1 / a
    diag[1:] += b / a[:-1]
    return diag, np.sqrt(b) / a[:-1]


def _below(diag: np.ndarray, off: np.ndarray, x: float) -> int:
    """How many eigenvalues lie below x: signs in the Sturm sequence."""
    count, q = 0, 1.0
    for i, d in enumerate(diag):
        q = d - x - (off[i - 1] ** 2 / q if i else 0.0)
        if q == 0:
            q = 1e-300
        count += q < 0
    return count


def extremes(alphas: list[float], betas: list[float], steps: int = 64) -> tuple[float, float] | None:
    """The least and greatest Ritz value, by bisection between Gershgorin bounds."""
    if not alphas:
        return None
    diag, off = lanczos(alphas, betas)
    reach = np.append(off, 0.0) + np.insert(off, 0, 0.0)
    floor, ceiling = float((diag - reach).min()), float((diag + reach).max())

    def find(index: int) -> float:
        low, high = floor, ceiling
        for _ in range(steps):
            mid = (low + high) / 2
            if _below(diag, off, mid) > index:
                high = mid
            else:
                low = mid
        return (low + high) / 2

    return find(0), find(len(diag) - 1)


def iterations_needed(condition: float, reduction: float) -> float:
    """Steps of CG that bring the error down by ``reduction``, by the Chebyshev bound."""
    if condition <= 1:
        return 1.0
    root = math.sqrt(condition)
    rate = (root - 1) / (root + 1)
    return max(1.0, math.acosh(max(1.0, 1 / reduction)) / -math.log(rate))


def envelope(condition: float, steps: int) -> float:
    """The bound on what CG leaves of an error after some steps: one over the
    Chebyshev polynomial, by its hyperbolic cosine."""
    if condition <= 1:
        return 0.0 if steps else 1.0
    root = math.sqrt(condition)
    return 1 / math.cosh(min(700.0, steps * math.log((root + 1) / (root - 1))))


def trailing_rate(residuals: list[float], window: int = 8) -> float | None:
    """The mean factor of the last ``window`` steps; None if there are fewer."""
    if len(residuals) <= window or residuals[-1] <= 0 or residuals[-1 - window] <= 0:
        return None
    return (residuals[-1] / residuals[-1 - window]) ** (1 / window)


def cheaper(first_steps: float, first_cost: float, second_steps: float, second_cost: float, setup: float) -> str:
    """Which of two methods finishes sooner, the second paying for its set-up."""
    return "first" if first_steps * first_cost <= setup + second_steps * second_cost else "second"
