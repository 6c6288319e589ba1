"""Krylov solvers for one system in memory: numpy only, one right-hand side.

Every solver stops when the recurrence says so and then confirms the true
residual; a solver that cannot go on reports a status other than 0.  All take
``apply`` (A times a vector), ``b``, ``x0``, ``precondition`` (an approximate
inverse times a vector), tolerances and a limit of iterations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from residua.solvers.spectrum import trailing_rate

Apply = Callable[[np.ndarray], np.ndarray]
SOLVED, NOT_CONVERGED, BROKE_DOWN = 0, 1, 2


@dataclass
class Outcome:
    """A solution, its status, the iterations made, and what was seen on the way."""

    x: np.ndarray
    status: int
    iterations: int
    residuals: list[float] = field(default_factory=list)
    alphas: list[float] = field(default_factory=list)
    betas: list[float] = field(default_factory=list)
    aim: float = 0.0  # the residual norm that the run is to reach


#: Looks at a run after each step, and ends it by giving true.
Watch = Callable[[Outcome], bool]


def goal(b: np.ndarray, r0: np.ndarray, rtol: float, atol: float) -> float:
    """The residual norm to reach: relative to b, or to the first residual if b is zero."""
    size = float(np.linalg.norm(b)) or float(np.linalg.norm(r0))
    return max(rtol * size, atol)


def _begin(apply: Apply, b: np.ndarray, x0: np.ndarray, rtol: float, atol: float):
    x = np.array(x0, float)
    r = b - apply(x) if x.any() else b.copy()
    return x, r, goal(b, r, rtol, atol)


def _confirmed(apply: Apply, b: np.ndarray, x: np.ndarray, aim: float) -> bool:
    return bool(np.isfinite(x).all() and np.linalg.norm(b - apply(x)) <= aim * (1 + 1e-12))


#: The true residual is looked at every so many steps; it has drifted if it is so
#: many times the recurrence's; a run stalls if its mean factor over as many steps is above ``STALL``.
LOOK, DRIFT, STALL, WINDOW = 50, 10.0, 0.9999, 200


def cg(apply: Apply, b: np.ndarray, x0: np.ndarray, precondition: Apply, rtol: float, atol: float = 0.0, most: int = 10_000, watch: Watch | None = None) -> Outcome:
    """Preconditioned conjugate gradients, keeping the Lanczos coefficients.

    A direction of no positive curvature ends it with a breakdown.  Where the true
    residual has drifted from the recurrence, the run goes on from the truth; one
    that stalls, or that ``watch`` ends, is not converged.
    """
    x, r, aim = _begin(apply, b, x0, rtol, atol)
    out = Outcome(x, SOLVED, 0, [float(np.linalg.norm(r))], aim=aim)
    if out.residuals[0] <= aim:
        return out
    z = precondition(r)
    p, rz = z.copy(), float(r @ z)
    for out.iterations in range(1, most + 1):
        q = apply(p)
        curvature = float(p @ q)
        if not np.isfinite(curvature) or curvature <= 0 or rz <= 0:
            out.status = BROKE_DOWN
            return out
        alpha = rz / curvature
        out.alphas.append(alpha)
        x += alpha * p
        r -= alpha * q
        out.residuals.append(float(np.linalg.norm(r)))
        fresh = False
        if out.residuals[-1] <= aim or out.iterations % LOOK == 0:
            true = b - apply(x)
            size = float(np.linalg.norm(true))
            if size <= aim:
                out.residuals[-1] = size
                return out
            if out.residuals[-1] <= aim or size > DRIFT * out.residuals[-1]:
                r, fresh, out.residuals[-1] = true, True, size
        rate = trailing_rate(out.residuals, WINDOW)
        if rate is not None and rate > STALL or watch is not None and watch(out):
            break
        z = precondition(r)
        rz, last = float(r @ z), rz
        out.betas.append(rz / last)
        p = z if fresh else z + out.betas[-1] * p
    out.status = NOT_CONVERGED
    return out


#: After a segment of steps a run that has come to be so many times worse than its best goes back there.
SEGMENT, WORSE = 6, 1e3


def bicgstab(apply: Apply, b: np.ndarray, x0: np.ndarray, precondition: Apply, rtol: float, atol: float = 0.0, most: int = 10_000, least_angle: float = 0.7, watch: Watch | None = None) -> Outcome:
    """Stabilised bi-conjugate gradients.  The smoothing step is lengthened where
    its angle is poor, and a lost direction restarts from the true residual.  The
    best point at the end of a segment is kept, and one much worse goes back to it.
    A run that ``watch`` ends is not converged."""
    x, r, aim = _begin(apply, b, x0, rtol, atol)
    out = Outcome(x, SOLVED, 0, [float(np.linalg.norm(r))], aim=aim)
    if out.residuals[0] <= aim:
        return out
    shadow, p, v = r.copy(), np.zeros_like(r), np.zeros_like(r)
    rho = alpha = omega = 1.0
    restarts, best, kept = 0, out.residuals[0], x.copy()
    for out.iterations in range(1, most + 1):
        if out.iterations % SEGMENT == 0 and len(out.residuals) > 1:
            size = out.residuals[-1]
            if size < best:
                best, kept = size, x.copy()
            elif not size <= WORSE * best:
                x[:], omega = kept, 0.0
                r = b - apply(x)
        new = float(shadow @ r)
        if abs(new) <= 1e-14 * np.linalg.norm(shadow) * np.linalg.norm(r) or omega == 0:
            restarts += 1
            if restarts > 20:
                out.status = BROKE_DOWN
                return out
            r = b - apply(x)
            shadow, p, v = r.copy(), np.zeros_like(r), np.zeros_like(r)
            rho = alpha = omega = 1.0
            new = float(shadow @ r)
        beta = (new / rho) * (alpha / omega)
        p = r + beta * (p - omega * v)
        p_hat = precondition(p)
        v = apply(p_hat)
        along = float(shadow @ v)
        if along == 0 or not np.isfinite(along):
            omega = 0.0
            continue
        alpha = new / along
        s = r - alpha * v
        s_hat = precondition(s)
        t = apply(s_hat)
        tt, ts, ss = float(t @ t), float(t @ s), float(s @ s)
        if tt == 0 or ss == 0:
            omega = 0.0
            x += alpha * p_hat
        else:
            angle = ts / np.sqrt(tt * ss)
            omega = ts / tt
            if 0 < abs(angle) < least_angle:
                omega *= least_angle / abs(angle)
            x += alpha * p_hat + omega * s_hat
        r, rho = s - omega * t, new
        out.residuals.append(float(np.linalg.norm(r)))
        if out.residuals[-1] <= aim:
            r = b - apply(x)
            if np.linalg.norm(r) <= aim:
                return out
        if watch is not None and watch(out):
            break
    out.status = NOT_CONVERGED
    return out


def orthogonalize(basis: np.ndarray, w: np.ndarray, ratio: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """Classical Gram-Schmidt of w against the rows of ``basis``; done again if
    little of w is left."""
    before = np.linalg.norm(w)
    h = basis @ w
    w = w - h @ basis
    if np.linalg.norm(w) < ratio * before:
        more = basis @ w
        w, h = w - more @ basis, h + more
    return w, h


def gmres(apply: Apply, b: np.ndarray, x0: np.ndarray, precondition: Apply, rtol: float, atol: float = 0.0, most: int = 10_000, restart: int = 30, flexible: bool = False) -> Outcome:
    """Restarted GMRES, preconditioned on the right; flexible GMRES keeps the
    preconditioned directions, so that the preconditioner may change."""
    x, r, aim = _begin(apply, b, x0, rtol, atol)
    out = Outcome(x, SOLVED, 0, [float(np.linalg.norm(r))])
    n = len(b)
    m = min(restart, n)
    while True:
        beta = float(np.linalg.norm(r))
        if beta <= aim:
            return out
        if out.iterations >= most or not np.isfinite(beta):
            out.status = NOT_CONVERGED if np.isfinite(beta) else BROKE_DOWN
            return out
        v = np.zeros((m + 1, n))
        z = np.zeros((m, n)) if flexible else None
        h = np.zeros((m + 1, m))
        cs, sn, g = np.zeros(m), np.zeros(m), np.zeros(m + 1)
        v[0], g[0], k = r / beta, beta, 0
        while k < m and out.iterations < most:
            direction = precondition(v[k])
            if flexible:
                z[k] = direction
            w, h[: k + 1, k] = orthogonalize(v[: k + 1], apply(direction))
            h[k + 1, k] = np.linalg.norm(w)
            lucky = h[k + 1, k] <= 1e-15 * abs(g[0])
            if not lucky:
                v[k + 1] = w / h[k + 1, k]
            for i in range(k):  # the rotations made so far
                h[i, k], h[i + 1, k] = cs[i] * h[i, k] + sn[i] * h[i + 1, k], cs[i] * h[i + 1, k] - sn[i] * h[i, k]
            length = np.hypot(h[k, k], h[k + 1, k])
            out.iterations += 1
            if length == 0:
                break
            cs[k], sn[k] = h[k, k] / length, h[k + 1, k] / length
            h[k, k], h[k + 1, k] = length, 0.0
            g[k + 1], g[k] = -sn[k] * g[k], cs[k] * g[k]
            k += 1
            out.residuals.append(float(abs(g[k])))
            if out.residuals[-1] <= aim or lucky:
                break
        if k == 0:
            out.status = BROKE_DOWN
            return out
        y = np.zeros(k)
        for i in range(k - 1, -1, -1):
            y[i] = (g[i] - h[i, i + 1 : k] @ y[i + 1 :]) / h[i, i]
        x += y @ z[:k] if flexible else precondition(y @ v[:k])
        before, r = beta, b - apply(x)
        if np.linalg.norm(r) > aim and np.linalg.norm(r) >= before * (1 - 1e-14):
            out.status = NOT_CONVERGED  # a whole cycle without progress
            return out


def chebyshev(apply: Apply, low: float, high: float, steps: int = 4) -> Apply:
    """A fixed polynomial in A as preconditioner, for spectra in [low, high]."""
    centre, half = (high + low) / 2, (high - low) / 2

    def run(r: np.ndarray) -> np.ndarray:
        if half == 0:
            return r / centre
        sigma = centre / half
        rho, d = 1 / sigma, r / centre
        x, rest = d.copy(), r - apply(d)
        for _ in range(steps - 1):
            new = 1 / (2 * sigma - rho)
            d = new * rho * d + (2 * new / half) * rest
            x, rest, rho = x + d, rest - apply(d), new
        return x

    return run
