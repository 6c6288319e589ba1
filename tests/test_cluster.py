import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.operators import cluster as C
from residua.operators import matrix as M
from residua.operators.storage import scratch, shared_dir, stored
from residua.solvers import multigrid


def _frame(spark, a):
    rows, cols = np.nonzero(a)
    entries = spark.createDataFrame([("c", int(i), int(j), float(a[i, j])) for i, j in zip(rows, cols, strict=True)], "case_id string, row bigint, col bigint, val double")
    return entries, spark.createDataFrame([("c", len(a))], "case_id string, n bigint")


def _vector(spark, x):
    return spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(x)], "case_id string, i bigint, x double")


def _grid(m, wind=0.4):
    """Convection and diffusion on an m by m grid: nonsymmetric, with a slow smooth part."""
    n = m * m
    a = np.zeros((n, n))
    for y in range(m):
        for x in range(m):
            i = y * m + x
            a[i, i] = 4.0
            for dx, dy, weight in ((1, 0, -1 + wind), (-1, 0, -1 - wind), (0, 1, -1.0), (0, -1, -1.0)):
                if 0 <= x + dx < m and 0 <= y + dy < m:
                    a[i, (y + dy) * m + x + dx] = weight
    return a


def _values(frame, n):
    out = np.full(n, np.nan)
    for r in frame.collect():
        out[r["i"]] = r["x"]
    return out


def test_gmres_solves_a_nonsymmetric_system_over_restarts(spark):
    a = _grid(6)
    target = np.cos(np.arange(36.0))
    entries, sizes = _frame(spark, a)
    x, steps, residual = C.solve_gmres(entries, _vector(spark, a @ target), sizes, 1e-8, restart=9)
    assert np.allclose(_values(x, 36), target, atol=1e-6) and residual <= 1.01e-8 and 9 < steps < 60
    assert len([f for f in os.listdir(f"{shared_dir(spark)}/residua") if f.startswith("gmres-step")]) == 0
    with pytest.raises(ArithmeticError, match="did not converge"):
        C.solve_gmres(entries, _vector(spark, a @ target), sizes, 1e-12, most=2)
    x, steps, _ = C.solve_gmres(entries, _vector(spark, np.zeros(36)), sizes, 1e-8)
    assert steps == 0 and not _values(x, 36).any()


def test_gmres_takes_as_many_steps_as_in_one_task(spark):
    from residua.solvers import krylov

    a = _grid(5, 0.7)
    entries, sizes = _frame(spark, a)
    b = np.sin(np.arange(25.0))
    inverse = 1 / np.diag(a)
    one = krylov.gmres(lambda v: a @ v, b, np.zeros(25), lambda v: inverse * v, 1e-9)
    x, steps, _ = C.solve_gmres(entries, _vector(spark, b), sizes, 1e-9)
    assert abs(steps - one.iterations) <= 1 and np.allclose(_values(x, 25), one.x, atol=1e-7)


def test_singular_system_is_told(spark):
    entries, sizes = _frame(spark, np.array([[1.0, 1.0], [1.0, 1.0]]))
    with pytest.raises(ArithmeticError):
        C.solve_gmres(entries, _vector(spark, [1.0, 2.0]), sizes, 1e-8, restart=2, most=8)


@pytest.mark.parametrize("kind", ["grid", "random", "diagonal", "one way"])
def test_aggregates_and_levels_equal_those_of_one_task(spark, kind):
    rng = np.random.default_rng(4)
    n = 144
    if kind == "grid":
        a = _grid(12)
    elif kind == "diagonal":
        a = np.eye(30)
    else:
        a = np.where(rng.random((n, n)) < 0.03, rng.integers(-4, 5, (n, n)), 0).astype(float)
        if kind == "one way":
            a = np.triu(a)
        a += np.diag(1 + np.abs(a).sum(axis=1))
    n = len(a)
    rows, cols = np.nonzero(a)
    entries, sizes = _frame(spark, a)
    with scratch(spark):
        owner = multigrid.aggregates(n, rows, cols, a[rows, cols])
        assert {r["i"]: r["owner"] for r in C.aggregates(entries, sizes).collect()} == dict(enumerate(owner.tolist()))
        levels = C.hierarchy(entries, sizes, coarsest=10)
        own = multigrid.Level(n, rows, cols, a[rows, cols], None)
        for level in levels[1:]:
            own.owner = multigrid.aggregates(own.n, own.rows, own.cols, own.vals)
            own = multigrid.coarsened(own)
            assert level.n == own.n
            found = {(r["row"], r["col"]): r["val"] for r in level.entries.collect()}
            assert found.keys() == set(zip(own.rows.tolist(), own.cols.tolist(), strict=True))
            assert all(abs(found[i, j] - v) < 1e-9 for i, j, v in zip(own.rows.tolist(), own.cols.tolist(), own.vals.tolist(), strict=True))
        assert len(levels) > 1 or kind == "diagonal"


def test_cycle_equals_that_of_one_task_and_speeds_up_gmres(spark, monkeypatch):
    a = _grid(10)
    monkeypatch.setattr(multigrid, "COARSEST", 20)
    entries, sizes = _frame(spark, a)
    rows, cols = np.nonzero(a)
    one = multigrid.Multigrid(len(a), rows, cols, a[rows, cols])
    r = np.cos(np.arange(100.0))
    with scratch(spark):
        levels = C.hierarchy(entries, sizes, 20)
        assert [level.n for level in levels] == [level.n for level in one.levels] and len(levels) >= 2
        assert np.allclose(_values(C.multigrid(levels)(_vector(spark, r)), 100), one.cycle(r), atol=1e-10)
    target = 1 + np.sin(np.arange(100.0))
    x, fast, _ = C.solve_multigrid(entries, _vector(spark, a @ target), sizes, 1e-7, 20)
    assert np.allclose(_values(x, 100), target, atol=1e-5)
    assert fast < 15


def test_scratch_deletes_and_keeps(spark):
    folder = lambda: set(os.listdir(f"{shared_dir(spark)}/residua"))
    stored(spark.range(1), "before")
    names = folder()
    with scratch(spark):
        with scratch(spark):
            stored(spark.range(2), "gone")
            kept = stored(spark.range(3), "kept", keep=True)
        assert len(folder() - names) == 1 and kept.count() == 3
    assert folder() == names


def test_dominant_diagonal(spark):
    off = spark.createDataFrame([("c", 0, 1, -2.0), ("c", 0, 2, 3.0)], "case_id string, row bigint, col bigint, val double")
    sizes = spark.createDataFrame([("c", 3)], "case_id string, n bigint")
    found = {(r["row"], r["col"]): r["val"] for r in M.with_dominant_diagonal(off, sizes, lambda t: 2 * F.greatest(t, F.lit(1.0))).collect()}
    assert found == {(0, 1): -2.0, (0, 2): 3.0, (0, 0): 10.0, (1, 1): 2.0, (2, 2): 2.0}


def test_approximate_inverse_equals_small_solves_and_speeds_up_gmres(spark, monkeypatch):
    a = _grid(7, wind=0.0)
    monkeypatch.setattr(C, "GROUP", 10)
    entries, sizes = _frame(spark, a)
    g = np.zeros_like(a)
    for r in C.fsai(entries).collect():
        g[r["row"], r["col"]] = r["val"]
    for i in range(len(a)):
        places = np.flatnonzero(a[i, : i + 1])
        y = np.linalg.solve(a[np.ix_(places, places)], np.eye(len(places))[-1])
        want = np.zeros(len(a))
        want[places] = y / np.sqrt(y[-1])
        assert np.allclose(g[i], want, atol=1e-12)
    target = np.sin(1.0 + np.arange(49.0))
    b = _vector(spark, a @ target)
    with scratch(spark):
        x, steps, _ = C.solve_gmres(entries, b, sizes, 1e-8, precondition=C.factored(stored(C.fsai(entries), "g"), sizes))
        found = _values(x, 49)
    plain = C.solve_gmres(entries, b, sizes, 1e-8)[1]
    assert np.allclose(found, target, atol=1e-6) and steps < plain
    with pytest.raises(Exception, match="not positive definite"):
        C.fsai(_frame(spark, np.array([[1.0, 2.0], [2.0, 1.0]]))[0]).collect()


def test_only_pairs_that_meet_an_entry_leave_a_task(spark, monkeypatch):
    """Of a row's pairs of places only those between which the matrix has an entry, or
    that are one place, are sent on, whatever the blocks and chunks are."""
    rng = np.random.default_rng(5)
    half = np.triu(np.where(rng.random((60, 60)) < 0.2, rng.normal(size=(60, 60)), 0.0), 1)
    a = half + half.T
    a += np.diag(1.0 + np.abs(a).sum(axis=1))
    entries, _ = _frame(spark, a)
    monkeypatch.setattr(C, "BLOCK", 16)
    monkeypatch.setattr(C, "PAIRS", 50)
    monkeypatch.setattr(C, "GROUP", 7)
    pairs = C.between(entries, C.lower_pattern(entries))
    want = {(i, j, k): a[j, k] for i in range(60) for j in np.flatnonzero(a[i, : i + 1]) for k in np.flatnonzero(a[i, : j + 1]) if a[j, k]}
    found = pairs.collect()
    assert len(found) == len(want) and {(r["i"], r["j"], r["k"]): r["val"] for r in found} == want
    g = np.zeros_like(a)
    for r in C.fsai(entries, pairs).collect():
        g[r["row"], r["col"]] = r["val"]
    products = C.product_on_pattern(C.fsai(entries), pairs).collect()
    assert len(products) == np.count_nonzero(np.tril(a))
    assert all(abs((g @ a)[r["row"], r["col"]] - r["product"]) < 1e-12 and g[r["row"], r["col"]] == pytest.approx(r["val"]) for r in products)


def test_fsai_of_a_row_without_its_diagonal_is_an_error(spark):
    a = np.diag([2.0, 2.0, 0.0])
    a[2, 0] = a[0, 2] = 1.0
    with pytest.raises(Exception, match="row 2 of c is not positive definite"):
        C.fsai(_frame(spark, a)[0]).collect()


def test_the_last_rounds_of_aggregates_are_one_task_and_give_the_same(spark, monkeypatch):
    """Whether all rounds, some or none are done over the cluster; a small graph takes few jobs."""
    a = _grid(9)
    entries, sizes = _frame(spark, a)
    rows, cols = np.nonzero(a)
    want = multigrid.aggregates(81, rows, cols, a[rows, cols], 0.25).tolist()
    jobs = {}
    for finish in (0, 60, 1_000_000):
        monkeypatch.setattr(C, "FINISH", finish)
        spark.sparkContext.setJobGroup(f"aggregates {finish}", "")
        found = {r["i"]: r["owner"] for r in C.aggregates(entries, sizes, 0.25).collect()}
        jobs[finish] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"aggregates {finish}"))
        assert [found[i] for i in range(81)] == want
    assert jobs[1_000_000] < jobs[60] < jobs[0]
