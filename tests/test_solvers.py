import numpy as np
import pytest

from residua.operators import solve as S
from residua.plans import derive as D
from residua.solvers import krylov as K
from residua.solvers import spectrum as P


def _system(n=60, seed=0, symmetric=False):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n, n))
    a = a @ a.T / n + np.eye(n) if symmetric else a + n * np.eye(n)
    x = rng.standard_normal(n)
    return a, x, a @ x


@pytest.mark.parametrize("method", ["bicgstab", "gmres", "fgmres", "cg"])
@pytest.mark.parametrize("warm", [False, True])
def test_methods_solve(method, warm):
    a, x, b = _system(symmetric=method == "cg")
    run = {"cg": K.cg, "bicgstab": K.bicgstab, "gmres": K.gmres, "fgmres": lambda *p, **k: K.gmres(*p, flexible=True, **k)}[method]
    d = np.diag(a)
    out = run(lambda v: a @ v, b, x * 0.9 if warm else np.zeros(len(b)), lambda r: r / d, 1e-11)
    assert out.status == K.SOLVED and np.allclose(out.x, x, atol=1e-8)


@pytest.mark.parametrize("run", [K.cg, K.bicgstab, K.gmres])
def test_early_ends(run):
    a, x, b = _system(symmetric=True)
    same = lambda r: r
    assert run(lambda v: a @ v, np.zeros(60), np.zeros(60), same, 1e-10).iterations == 0
    assert run(lambda v: a @ v, b, x, same, 1e-6).iterations == 0
    assert run(lambda v: a @ v, b, np.zeros(60), same, 1e-14, most=2).status == K.NOT_CONVERGED


def test_cg_reports_no_curvature():
    a = np.diag([1.0, -1.0])
    assert K.cg(lambda v: a @ v, np.ones(2), np.zeros(2), lambda r: r, 1e-10).status == K.BROKE_DOWN


def test_chebyshev_reduces():
    a, _, b = _system(symmetric=True)
    low, high = np.linalg.eigvalsh(a)[[0, -1]]
    x = K.chebyshev(lambda v: a @ v, low, high, 30)(b)
    assert np.linalg.norm(b - a @ x) < 1e-3 * np.linalg.norm(b)


def test_extremes_match_the_spectrum():
    a, _, b = _system(40, symmetric=True)
    out = K.cg(lambda v: a @ v, b, np.zeros(40), lambda r: r, 1e-13)
    low, high = P.extremes(out.alphas, out.betas)
    diag, off = P.lanczos(out.alphas, out.betas)
    want = np.linalg.eigvalsh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))
    assert np.allclose([low, high], want[[0, -1]], rtol=1e-9)
    assert P.extremes([], []) is None


def test_cost_rules():
    assert P.iterations_needed(1.0, 1e-6) == 1.0 < P.iterations_needed(100.0, 1e-6) < P.iterations_needed(1e4, 1e-6)
    assert P.trailing_rate([1.0] * 3) is None and np.isclose(P.trailing_rate([0.5**k for k in range(12)]), 0.5)
    assert P.cheaper(10, 1, 2, 3, 1) == "second"


def test_a_raising_solver_is_a_failed_run(spark, small):
    class Broken:
        def setup(self, matrix, b, x0):
            raise RuntimeError("no")

        def solve(self): ...

    class Spoils(S.Krylov):
        def solve(self):
            self.b[0] += 1
            return super().solve()

    a, n = D.entries(spark, small, 7).where("case_id = '1'"), D.sizes(spark, small, 7)
    b = D.rhs(spark, small, 7).where("case_id = '1'").selectExpr("case_id", "i", "x as b", "0D as x0")
    cases = n.selectExpr("case_id", "n", "1e-10 as tolerance")
    row = S.solve_groups(a, b, cases, lambda tol: Broken()).first()
    assert row["returncode"] == 1 and "RuntimeError: no" in row["diagnostics"]
    row = S.solve_groups(a, b, cases, lambda tol: Spoils("bicgstab", tol)).first()
    assert row["mutated"] is True
    assert set(S.registry()) == set(S.SOLVERS)


def test_distributed_solver_tells_when_it_has_not_converged(spark):
    from residua.operators import solve

    n = 12
    entries = [("c", i, i, 2.0) for i in range(n)] + [("c", i, i + s, -1.0) for i in range(n) for s in (-1, 1) if 0 <= i + s < n]
    a = spark.createDataFrame(entries, "case_id string, row long, col long, val double")
    b = spark.createDataFrame([("c", i, float(i % 3 + 1)) for i in range(n)], "case_id string, i long, x double")
    sizes = spark.createDataFrame([("c", n)], "case_id string, n long")
    assert solve.solve_distributed(a, b, sizes, 1e-9)[2] <= 1.01e-9
    with pytest.raises(ArithmeticError):
        solve.solve_distributed(a, b, sizes, 1e-9, most=2)


def test_ritz_extremes_equal_the_eigenvalues_of_the_lanczos_matrix():
    rng = np.random.default_rng(4)
    diag = 1 + np.sort(rng.random(80)) * 50
    found = K.cg(lambda x: diag * x, np.ones(80), np.zeros(80), lambda r: r, 1e-13, most=25)
    d, off = P.lanczos(found.alphas, found.betas)
    want = np.linalg.eigvalsh(np.diag(d) + np.diag(off, 1) + np.diag(off, -1))
    assert np.allclose(P.extremes(found.alphas, found.betas), (want[0], want[-1]), rtol=1e-9)


def test_envelope_bounds_the_error_of_cg():
    diag = np.linspace(1, 100, 200)
    x = np.cos(np.arange(200.0))
    b = diag * x
    for steps in (1, 5, 20):
        found = K.cg(lambda v: diag * v, b, np.zeros(200), lambda r: r, 1e-30, most=steps)
        error, first = found.x - x, -x
        assert np.sqrt(error @ (diag * error)) <= 1.0001 * 2 * P.envelope(100.0, steps) * np.sqrt(first @ (diag * first))


def test_bicgstab_goes_back_to_its_best_point():
    rng = np.random.default_rng(0)
    a = np.eye(60) * 4 + rng.standard_normal((60, 60))
    b = a @ np.ones(60)
    found = K.bicgstab(lambda x: a @ x, b, np.zeros(60), lambda r: r, 1e-9)
    assert found.status != 0 or np.allclose(found.x, 1, atol=1e-5)


def test_broken_systems_raise_when_solved_over_the_cluster(spark):
    entries = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 1, -1.0)], "case_id string, row bigint, col bigint, val double")
    b = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0)], "case_id string, i bigint, x double")
    sizes = spark.createDataFrame([("a", 2)], "case_id string, n bigint")
    with pytest.raises(ArithmeticError):
        S.solve_distributed(entries, b, sizes, 1e-10)


def test_setups_are_used_again_for_the_same_matrix_only():
    def of(scale):
        return S.Csr(3, np.arange(3), np.arange(3), np.full(3, scale))

    one, two = S.SOLVERS["cg"](1e-9), S.SOLVERS["cg"](1e-9)
    for solver in (one, two):
        solver.setup(of(2.0), np.ones(3), np.zeros(3))
    first = one.precondition
    assert two.precondition is not first  # solvers share nothing
    one.setup(of(2.0), np.ones(3), np.zeros(3))
    assert one.precondition is first
    one.setup(of(4.0), np.ones(3), np.zeros(3))
    assert one.precondition is not first and np.allclose(one.solve().x, 0.25)


def _plain_ilu(a):
    """ILU(0) row by row on the pattern of a dense matrix."""
    f, pattern = a.copy(), (a != 0) | np.eye(len(a), dtype=bool)
    for i in range(len(a)):
        for k in range(i):
            if pattern[i, k]:
                f[i, k] /= f[k, k]
                for j in range(k + 1, len(a)):
                    if pattern[i, j]:
                        f[i, j] -= f[i, k] * f[k, j]
    return f


@pytest.mark.parametrize("density", [0.05, 0.3])
def test_incomplete_factors_equal_plain_ones(density):
    from residua.solvers.ilu import Ilu, levels_of

    rng = np.random.default_rng(int(100 * density))
    n = 40
    a = np.where(rng.random((n, n)) < density, rng.standard_normal((n, n)), 0)
    a += np.diag(2 + np.abs(a).sum(axis=1))
    rows, cols = np.nonzero(a)
    own = Ilu(n, rows, cols, a[rows, cols])
    want = _plain_ilu(a)
    assert np.allclose(own.vals, want[own.rows, own.cols])
    lower, upper = np.tril(want, -1) + np.eye(n), np.triu(want)
    r = rng.standard_normal(n)
    assert np.allclose(own.solve(r), np.linalg.solve(upper, np.linalg.solve(lower, r)))
    level = levels_of(n, rows, cols)
    assert all(level[i] == max([level[j] + 1 for j in range(i) if a[i, j]], default=0) for i in range(n))


def test_incomplete_factors_of_a_band_are_whole_and_weak_pivots_stay_finite():
    from residua.solvers.ilu import Ilu

    n = 30
    a = np.diag(np.full(n, 4.0)) + np.diag(np.full(n - 1, -1.0), 1) + np.diag(np.full(n - 1, -2.0), -1)
    rows, cols = np.nonzero(a)
    b = np.arange(n, dtype=float)
    assert np.allclose(Ilu(n, rows, cols, a[rows, cols]).solve(b), np.linalg.solve(a, b))
    weak = Ilu(3, np.array([0, 0, 1, 2]), np.array([0, 1, 0, 2]), np.array([0.0, 1.0, 1.0, 5.0]))
    assert np.isfinite(weak.solve(np.ones(3))).all()
    assert Ilu(0, *[np.zeros(0, int)] * 2, np.zeros(0)).solve(np.zeros(0)).shape == (0,)
    assert Ilu(2, np.zeros(0, int), np.zeros(0, int), np.zeros(0)).solve(np.ones(2)).tolist() == [1.0, 1.0]
