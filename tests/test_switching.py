import numpy as np
import pytest
from test_cluster import _grid

from residua.operators import solve as S
from residua.solvers import krylov, spectrum, switching


def _csr(a):
    rows, cols = np.nonzero(a)
    return S.Csr(len(a), rows, cols, a[rows, cols])


def _solved(name, a, tolerance=1e-8):
    target = np.random.default_rng(1).standard_normal(len(a))
    solver = S.SOLVERS[name](tolerance)
    solver.setup(_csr(a), a @ target, np.zeros(len(a)))
    found = solver.solve()
    assert found.status == krylov.SOLVED and np.linalg.norm(a @ (found.x - target)) <= 1.01 * tolerance * np.linalg.norm(a @ target)
    return solver, found


@pytest.mark.parametrize("condition", [1.0, 1.5, 30.0, 1e4])
@pytest.mark.parametrize("reduction", [1.0, 0.3, 1e-9])
def test_least_steps_is_the_first_below_the_envelope(condition, reduction):
    steps = switching.least_steps(condition, reduction)
    assert spectrum.envelope(condition, steps) <= reduction
    assert steps == 0 or spectrum.envelope(condition, steps - 1) > reduction


@pytest.mark.parametrize("name", ["switching_cg", "switching_bicgstab"])
def test_a_hard_system_changes_to_multigrid_and_an_easy_one_does_not(name):
    easy = np.eye(300) * 4 + np.diag(np.full(299, -0.5), 1) + np.diag(np.full(299, -0.5), -1)
    solver, found = _solved(name, easy)
    assert solver.strong is None and all(expected <= other for _, expected, other in solver.controllers[0].looks)
    plain = S.SOLVERS[name.removeprefix("switching_")](1e-8)
    plain.setup(_csr(easy), solver.b, np.zeros(300))
    assert np.array_equal(found.x, plain.solve().x)
    # A grid of low diffusion in one direction: hundreds of steps by the diagonal.
    m = 40
    line = 2 * np.eye(m) - np.eye(m, k=1) - np.eye(m, k=-1)
    hard = np.kron(np.eye(m), line) + np.kron(np.diag(np.full(m, 1e-4)), np.eye(m)) + 1e-2 * np.kron(line, np.eye(m))
    solver, found = _solved(name, hard)
    done, expected, other = solver.controllers[0].looks[-1]
    assert solver.strong is not None and expected > other
    assert found.iterations < S.Krylov(name.removeprefix("switching_"), 1e-8).METHODS[name.removeprefix("switching_")](lambda v: hard @ v, solver.b, np.zeros(m * m), lambda r: r / np.diag(hard), 1e-8).iterations
    # The second method starts from the point that the first one reached.
    assert found.residuals[done + 1] == pytest.approx(found.residuals[done], rel=1e-6)


def test_a_set_up_is_used_again_for_the_same_matrix_only():
    solver, _ = _solved("switching_cg", _grid(40, 0.0), 1e-12)
    first = solver.strong
    assert first is not None
    solver.setup(solver.matrix, solver.b, solver.x0)
    assert solver.strong is first
    solver.setup(_csr(np.eye(3)), np.ones(3), np.zeros(3))
    assert solver.strong is None and np.allclose(solver.solve().x, 1)


def test_what_breaks_down_or_gets_worse_is_not_handed_on():
    outcomes = iter([krylov.Outcome(np.array([9.0]), krylov.BROKE_DOWN, 3, [1.0, 5.0]), krylov.Outcome(np.array([2.0]), krylov.NOT_CONVERGED, 2, [1.0, 0.5]), krylov.Outcome(np.array([1.0]), krylov.SOLVED, 1, [0.5, 0.0])])
    starts = []

    def method(x, watch):
        starts.append((x.tolist(), watch is None))
        return next(outcomes)

    found, controllers = switching.run([method] * 3, np.zeros(1))
    assert starts == [([0.0], False), ([0.0], False), ([2.0], True)]
    assert found.status == krylov.SOLVED and found.iterations == 6 and found.residuals == [1.0, 5.0, 1.0, 0.5, 0.5, 0.0] and len(controllers) == 2


def test_no_progress_is_no_prospect():
    controller = switching.Controller(every=2)
    assert not controller(krylov.Outcome(np.zeros(1), 0, 1, [1.0, 1.0], aim=1e-6))
    assert controller(krylov.Outcome(np.zeros(1), 0, 2, [1.0, 1.0, 1.0], aim=1e-6))
    assert controller.looks[0][1] == np.inf
