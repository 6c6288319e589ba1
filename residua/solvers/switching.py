"""Changing the method while a solve runs.

A cheap method begins.  Every few steps a controller says how many more it expects:
by the rate of the last steps, and by the Chebyshev bound over the spectrum that
the run itself has shown.  Where a stronger method would be done sooner, its set-up
included, that one goes on from the point reached, whose true residual it starts from.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

from residua.solvers import krylov, spectrum


@dataclass(frozen=True)
class Costs:
    """What the stronger method costs, in steps of the first: its set-up and a step of
    it; and the factor by which a step of it is taken to lessen the residual."""

    setup: float = 40.0
    step: float = 12.0
    rate: float = 0.3


@dataclass
class Controller:
    """Looks at a run every ``every`` steps and ends it where ``costs`` say so.

    The expected number of steps is the greater of two: what the trailing rate gives,
    and, where the run keeps Lanczos coefficients, what brings the envelope of the
    condition seen so far down to the reduction still needed; a spectrum that is not
    positive shows none.  A run that has not
    gained anything since the look before is expected never to end.
    """

    costs: Costs = field(default_factory=Costs)
    every: int = 10
    looks: list[tuple[int, float, float]] = field(default_factory=list)  # steps made, steps expected, those of the other method in steps of this one

    def __call__(self, out: krylov.Outcome) -> bool:
        done = len(out.residuals) - 1
        if done % self.every or not done or out.residuals[-1] <= 0:
            return False
        reduction = min(1.0, out.aim / out.residuals[-1])
        rate = spectrum.trailing_rate(out.residuals, self.every - 1) or 1.0
        by_rate = math.log(reduction) / math.log(rate) if rate < 1 else math.inf
        seen = spectrum.extremes(out.alphas, out.betas) if out.alphas else None
        shown = seen is not None and seen[0] > 0
        expected = max(by_rate, least_steps(seen[1] / seen[0], reduction)) if shown else by_rate
        fewer = math.log(reduction) / math.log(self.costs.rate)
        other = self.costs.setup + self.costs.step * fewer
        self.looks.append((done, expected, other))
        return spectrum.cheaper(expected, 1.0, fewer, self.costs.step, self.costs.setup) == "second"


def least_steps(condition: float, reduction: float) -> int:
    """The first number of steps whose envelope is at most ``reduction``."""
    steps = max(0, math.floor(spectrum.iterations_needed(condition, reduction)) - 2)
    while spectrum.envelope(condition, steps) > reduction:
        steps += 1
    return steps


def run(methods: Sequence[Callable[[np.ndarray, krylov.Watch | None], krylov.Outcome]], x0: np.ndarray, costs: Costs | None = None, every: int = 10) -> tuple[krylov.Outcome, list[Controller]]:
    """Solve by methods of growing strength, each given a point to start from and a
    watch; the last one has none.

    A method that the controller ends, that breaks down or that stalls hands its
    point on, if that is better than where it began.  Steps and residuals are those
    of all methods together, the status that of the last one used.
    """
    x, residuals, steps, controllers = x0, [], 0, []
    for k, method in enumerate(methods):
        last = k + 1 == len(methods)
        if not last:
            controllers.append(Controller(costs or Costs(), every))
        found = method(x, None if last else controllers[-1])
        steps, residuals = steps + found.iterations, residuals + found.residuals
        if found.status == krylov.SOLVED or last:
            break
        if np.isfinite(found.x).all() and found.residuals[-1] < found.residuals[0]:
            x = found.x
    return krylov.Outcome(found.x, found.status, steps, residuals, found.alphas, found.betas, found.aim), controllers
