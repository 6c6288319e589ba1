"""Solvers as plug-ins: one system a group, or one system over the cluster.

A solver is an object with ``setup(matrix, b, x0)``, ``solve() -> Outcome`` and
optionally ``close()``; a factory makes one from tolerances.  ``solve_groups``
runs each case in one Python task and suits many systems that fit in memory;
``solve_distributed`` keeps vectors as DataFrames and suits one that does not.
"""

from __future__ import annotations

import functools
import hashlib
import inspect
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators import matrix as M
from residua.operators.storage import scratch, stored
from residua.solvers import ilu, krylov, multigrid, spectrum, switching
from residua.sources import wire

RESULT = "case_id string, role string, returncode int, wall_seconds double, diagnostics string, status int, iterations int, elapsed_ns bigint, create_ns bigint, setup_ns bigint, solve_ns bigint, mutated boolean, solution array<double>"


@dataclass(frozen=True)
class Csr:
    """A square matrix by rows; products by a running sum over the entries."""

    n: int
    rows: np.ndarray
    cols: np.ndarray
    vals: np.ndarray

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.vals * x[self.cols], minlength=self.n)

    def diagonal(self) -> np.ndarray:
        on = self.rows == self.cols
        return np.bincount(self.rows[on], self.vals[on], minlength=self.n)

    def fingerprint(self) -> bytes:
        return hashlib.sha256(self.rows.tobytes() + self.cols.tobytes() + self.vals.tobytes()).digest()


class Solver(Protocol):
    def setup(self, matrix: Csr, b: np.ndarray, x0: np.ndarray) -> None: ...

    def solve(self) -> krylov.Outcome: ...


#: Preconditioners by name: each takes a matrix and gives an approximate inverse.
PRECONDITIONERS: dict[str, Callable[[Csr], krylov.Apply]] = {
    "jacobi": lambda a: _diagonal(a),
    "multigrid": lambda a: multigrid.Multigrid(a.n, a.rows, a.cols, a.vals).cycle,
    "chebyshev": lambda a: _chebyshev(a),
    "ilu": lambda a: ilu.Ilu(a.n, a.rows, a.cols, a.vals).solve,
}


def _diagonal(a: Csr) -> krylov.Apply:
    inverse = multigrid.inverse_diagonal(a.n, a.rows, a.cols, a.vals)
    return lambda r: inverse * r


def _ritz(a: Csr, steps: int = 12) -> tuple[float, float]:
    """Bounds on the spectrum of the matrix scaled by its diagonal, from a few steps of CG."""
    probe = krylov.cg(lambda x: a @ x, np.cos(np.arange(a.n, dtype=float)), np.zeros(a.n), _diagonal(a), 1e-14, most=steps)
    return spectrum.extremes(probe.alphas, probe.betas) or (1.0, 1.0)


def _chebyshev(a: Csr) -> krylov.Apply:
    """A polynomial over the upper part of the spectrum, scaled by the diagonal."""
    scale = _diagonal(a)
    high = 1.1 * _ritz(a)[1]
    inner = krylov.chebyshev(lambda x: scale(a @ x), high / 30, high)
    return lambda r: inner(scale(r))


class Krylov:
    """A method of ``krylov`` with a preconditioner.

    What a solver has set up it uses again for the same matrix only: its fingerprint,
    taken from all its numbers, guards it.  Solvers share nothing, so that no run
    finds ready what another one has paid for.
    """

    METHODS = {"cg": krylov.cg, "bicgstab": krylov.bicgstab, "gmres": krylov.gmres, "fgmres": functools.partial(krylov.gmres, flexible=True)}

    def __init__(self, method: str, rtol: float, atol: float = 0.0, preconditioner: str = "jacobi", **options):
        self.method, self.rtol, self.atol, self.preconditioner, self.options = method, rtol, atol, preconditioner, options
        self.ready: tuple[str, bytes] | None = None

    def setup(self, matrix: Csr, b: np.ndarray, x0: np.ndarray) -> None:
        self.matrix, self.b, self.x0 = matrix, b, x0
        key = (self.preconditioner, matrix.fingerprint())
        if self.ready != key:
            self.precondition, self.ready = PRECONDITIONERS[self.preconditioner](matrix), key

    def solve(self) -> krylov.Outcome:
        return self.METHODS[self.method](lambda x: self.matrix @ x, self.b, self.x0, self.precondition, self.rtol, self.atol, **self.options)


class Cheapest(Krylov):
    """CG with the preconditioner that is predicted to finish sooner: Jacobi, or
    multigrid, whose set-up and cycle cost as many products as stated."""

    SETUP, CYCLE, GAIN = 40.0, 12.0, 25.0

    def __init__(self, rtol: float):
        super().__init__("cg", rtol)

    def setup(self, matrix: Csr, b: np.ndarray, x0: np.ndarray) -> None:
        low, high = _ritz(matrix)
        condition = max(1.0, high / low) if low > 0 else 1e12
        steps = spectrum.iterations_needed(condition, self.rtol)
        fewer = spectrum.iterations_needed(max(1.0, condition / self.GAIN), self.rtol)
        chosen = spectrum.cheaper(steps, 1.0, fewer, self.CYCLE, self.SETUP)
        self.preconditioner = "jacobi" if chosen == "first" else "multigrid"
        super().setup(matrix, b, x0)


class Switching(Krylov):
    """A method that begins by the diagonal and goes on by multigrid as soon as that is
    predicted to be done sooner; multigrid is set up only then."""

    def __init__(self, method: str, rtol: float, **options):
        super().__init__(method, rtol, **options)
        self.strong: krylov.Apply | None = None

    def setup(self, matrix: Csr, b: np.ndarray, x0: np.ndarray) -> None:
        before = self.ready
        super().setup(matrix, b, x0)
        if self.ready != before:
            self.strong = None

    def _strong(self, r: np.ndarray) -> np.ndarray:
        if self.strong is None:
            self.strong = PRECONDITIONERS["multigrid"](self.matrix)
        return self.strong(r)

    def solve(self) -> krylov.Outcome:
        def by(precondition: krylov.Apply) -> Callable:
            return lambda x, watch: self.METHODS[self.method](lambda v: self.matrix @ v, self.b, x, precondition, self.rtol, self.atol, watch=watch, **self.options)

        found, self.controllers = switching.run([by(self.precondition), by(self._strong)], self.x0)
        return found


#: Makers of solvers by name: called with the tolerance of the case.
SOLVERS: dict[str, Callable[[float], Solver]] = {
    "cg": lambda tol: Krylov("cg", tol),
    "bicgstab": lambda tol: Krylov("bicgstab", tol),
    "gmres": lambda tol: Krylov("gmres", tol, restart=50),
    "fgmres": lambda tol: Krylov("fgmres", tol, restart=40),
    "multigrid_cg": lambda tol: Krylov("cg", tol, preconditioner="multigrid"),
    "multigrid_gmres": lambda tol: Krylov("gmres", tol, preconditioner="multigrid", restart=50),
    "multigrid_bicgstab": lambda tol: Krylov("bicgstab", tol, preconditioner="multigrid"),
    "ilu_gmres": lambda tol: Krylov("gmres", tol, preconditioner="ilu", restart=50),
    "ilu_bicgstab": lambda tol: Krylov("bicgstab", tol, preconditioner="ilu"),
    "chebyshev_cg": lambda tol: Krylov("cg", tol, preconditioner="chebyshev"),
    "cheapest_cg": Cheapest,
    "switching_cg": lambda tol: Switching("cg", tol),
    "switching_bicgstab": lambda tol: Switching("bicgstab", tol),
}
#: What candidates are measured against.
REFERENCE = "multigrid_gmres"


def registry() -> dict[str, str]:
    """The name of each solver and the sha256 of the source it runs."""
    text = "".join(map(inspect.getsource, (ilu, krylov, multigrid, spectrum, switching, Krylov, Cheapest, Switching)))
    return {name: hashlib.sha256(f"{name}\0{text}".encode()).hexdigest() for name in SOLVERS}


def executed(case: str, role: str, maker: Callable[[float], Solver], system: Csr, b: np.ndarray, x0: np.ndarray, tolerance: float) -> dict:
    """One run of a solver on copies of a system, as a row of ``RESULT``.

    Making, setting up and solving are timed apart; then the matrix and b are
    compared with what they were.  A solver that raises gives returncode 1 and the
    end of its message."""
    row = {"case_id": case, "role": role, "returncode": 0, "diagnostics": "", "status": None, "iterations": None, "elapsed_ns": None, "create_ns": None, "setup_ns": None, "solve_ns": None, "mutated": None, "solution": None}
    began = time.perf_counter()
    try:
        matrix = Csr(system.n, system.rows.copy(), system.cols.copy(), system.vals.copy())
        own_b, own_x0 = b.copy(), x0.copy()
        t0 = time.perf_counter_ns()
        solver = maker(tolerance)
        t1 = time.perf_counter_ns()
        solver.setup(matrix, own_b, own_x0)
        t2 = time.perf_counter_ns()
        found = solver.solve()
        t3 = time.perf_counter_ns()
        if hasattr(solver, "close"):
            solver.close()
        x = np.asarray(found.x, float)
        if x.shape != (system.n,):
            raise ValueError(f"the solution has the shape {x.shape}, not ({system.n},)")
        mutated = matrix.fingerprint() != system.fingerprint() or own_b.tobytes() != b.tobytes()
        row |= {"status": found.status, "iterations": found.iterations, "elapsed_ns": t3 - t0, "create_ns": t1 - t0, "setup_ns": t2 - t1, "solve_ns": t3 - t2, "mutated": mutated, "solution": x.tolist()}
    except Exception as error:  # whatever a plug-in raises is a failed run, not a failed job
        row |= {"returncode": 1, "diagnostics": f"{type(error).__name__}: {error}"[-8_000:]}
    return row | {"wall_seconds": time.perf_counter() - began}


def solve_groups(entries: DataFrame, vectors: DataFrame, cases: DataFrame, make: Callable[[float], Solver] | str | dict[str, Callable[[float], Solver]] = "bicgstab", role: str = "candidate") -> DataFrame:
    """Solve each case in a task of its own; columns of ``RESULT``.

    ``vectors`` is (case_id, i, b, x0), ``cases`` (case_id, n, tolerance): what a
    solver may see, so targets never reach it.  ``make`` is a solver's name or maker,
    or a maker for each role: the roles of a case run in one task, one after the
    other, each on its own copy of the system, so that their times are under the same
    load; which of them comes first changes from case to case.
    """
    makers = make if isinstance(make, dict) else {role: SOLVERS[make] if isinstance(make, str) else make}
    wide = vectors.join(cases.select("case_id", "n", "tolerance"), "case_id").select(F.col("case_id").alias("case"), "i", "b", "x0", "n", "tolerance")

    def run(key, own: pa.Table, vecs: pa.Table) -> pa.Table:
        case = key[0].as_py()
        if not vecs.num_rows:
            rows = [{"case_id": case, "role": role, "returncode": 1, "diagnostics": "no vectors", "wall_seconds": 0.0} for role in makers]
            return pa.Table.from_pylist(rows, schema=_ARROW)
        n, tolerance, places = vecs["n"][0].as_py(), vecs["tolerance"][0].as_py(), np.array(vecs["i"])
        b, x0 = np.zeros(n), np.zeros(n)
        b[places], x0[places] = np.array(vecs["b"]), np.array(vecs["x0"])
        rows, cols, vals = (np.array(own[c]) for c in ("row", "col", "val"))
        order = np.lexsort((cols, rows))
        system = Csr(n, rows[order], cols[order], vals[order].astype(float))
        return pa.Table.from_pylist([executed(case, r, makers[r], system, b, x0, tolerance) for r in turns(case, makers)], schema=_ARROW)

    return entries.groupBy("case_id").cogroup(wide.groupBy("case")).applyInArrow(run, RESULT)


def solve_packed(inputs: DataFrame, makers: dict[str, Callable[[float], Solver]]) -> DataFrame:
    """``solve_groups`` over packed inputs (case_id, input), read as a solver process
    reads them; an input that cannot be read gives runs of returncode 1."""

    def run(key, own):
        case = key[0].as_py()
        try:
            found = wire.decode_input(own["input"][0].as_py())
        except (TypeError, ValueError) as error:
            return pa.Table.from_pylist([{"case_id": case, "role": role, "returncode": 1, "diagnostics": str(error), "wall_seconds": 0.0} for role in makers], schema=_ARROW)
        rows = np.repeat(np.arange(found["n"]), np.diff(found["offsets"].astype(np.int64)))
        system = Csr(found["n"], rows, found["cols"].astype(np.int64), found["vals"])
        return pa.Table.from_pylist([executed(case, r, makers[r], system, found["b"], found["x0"], found["tolerance"]) for r in turns(case, makers)], schema=_ARROW)

    return inputs.select("case_id", "input").groupBy("case_id").applyInArrow(run, RESULT)


def turns(case: str, roles: Iterable[str]) -> list[str]:
    """The order of the roles of a case: either, by its name."""
    order = list(roles)
    return order[::-1] if hashlib.sha256(case.encode()).digest()[0] % 2 else order


_ARROW = pa.schema([("case_id", pa.string()), ("role", pa.string()), ("returncode", pa.int32()), ("wall_seconds", pa.float64()), ("diagnostics", pa.string()), ("status", pa.int32()), ("iterations", pa.int32()), ("elapsed_ns", pa.int64()), ("create_ns", pa.int64()), ("setup_ns", pa.int64()), ("solve_ns", pa.int64()), ("mutated", pa.bool_()), ("solution", pa.list_(pa.float64()))])


def solutions(results: DataFrame) -> DataFrame:
    """The solution vectors of results: (case_id, i, x)."""
    return results.where(F.col("solution").isNotNull()).select("case_id", F.posexplode("solution").alias("i", "x")).select("case_id", F.col("i").cast("long").alias("i"), "x")


def jacobi(entries: DataFrame, b: DataFrame, sizes: DataFrame, sweeps: int) -> DataFrame:
    """``sweeps`` sweeps of Jacobi from zero: (case_id, i, x).  One plan, no driver loop."""
    off, diag = entries.where("row <> col"), M.diagonal(entries).withColumnRenamed("x", "d")
    key = ["case_id", "i"]
    x = b.select(*key, F.lit(0.0).alias("x"))
    for _ in range(sweeps):
        moved = M.matvec(off, x, sizes, "ax").join(b.select(*key, F.col("x").alias("b")), key).join(diag, key)
        x = moved.select(*key, F.try_divide(F.col("b") - F.col("ax"), F.col("d")).alias("x"))
    return x


def solve_distributed(entries: DataFrame, b: DataFrame, sizes: DataFrame, rtol: float, most: int = 500) -> tuple[DataFrame, int, float]:
    """Jacobi-preconditioned conjugate gradients for one symmetric positive
    definite system over the cluster: (x, iterations, relative residual).

    An iteration is one product and two aggregates of one row; vectors are
    written out each time, so that the plan stays short and a lost executor
    costs a re-read.  A direction of no positive curvature raises ArithmeticError,
    and so does a true residual, confirmed at the end, above ``rtol`` (but for
    rounding, a hundredth).
    """
    with scratch(entries.sparkSession):
        key = ["case_id", "i"]
        state = b.select(*key, F.lit(0.0).alias("x"), F.col("x").alias("r")).join(M.diagonal(entries).withColumnRenamed("x", "d"), key, "left")
        state = state.withColumn("d", F.coalesce("d", F.lit(1.0))).withColumn("p", F.col("r") / F.col("d"))
        state = stored(state, "cg")
        norm, rz = state.agg(F.sqrt(F.sum(F.col("r") * F.col("r"))), F.sum(F.col("r") * F.col("r") / F.col("d"))).first()
        aim, steps = rtol * (norm or 0.0), 0
        while norm and norm > aim and steps < most:
            ap = M.matvec(entries, state.select(*key, F.col("p").alias("x")), sizes, "ap")
            both = stored(state.join(ap, key), "cg-product")
            curvature = both.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
            if curvature is None or not curvature > 0 or not rz > 0:
                raise ArithmeticError(f"conjugate gradients broke down after {steps} iterations: curvature {curvature}")
            alpha = rz / curvature
            moved = both.select(*key, (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "d", "p")
            norm, new = moved.agg(F.sqrt(F.sum(F.col("r") * F.col("r"))), F.sum(F.col("r") * F.col("r") / F.col("d"))).first()
            state = stored(moved.withColumn("p", F.col("r") / F.col("d") + (new / rz) * F.col("p")), "cg")
            rz, steps = new, steps + 1
        x = stored(state.select(*key, "x"), "cg-solution", keep=True)
        true = M.matvec(entries, x, sizes, "ax").join(b.select(*key, F.col("x").alias("b")), key)
        top, bottom = true.agg(F.sum(F.pow(F.col("b") - F.col("ax"), 2)), F.sum(F.pow("b", 2))).first()
        residual = (top / bottom) ** 0.5 if bottom else 0.0
        if not residual <= 1.01 * rtol:
            raise ArithmeticError(f"conjugate gradients did not converge: relative residual {residual:.3g} after {steps} iterations, tolerance {rtol:.3g}")
        return x, steps, residual


def rayleigh(entries: DataFrame, x: DataFrame, sizes: DataFrame) -> DataFrame:
    """(case_id, quotient): x'Ax / x'x."""
    joined = M.matvec(entries, x, sizes, "ax").join(x, ["case_id", "i"])
    return joined.groupBy("case_id").agg(F.try_divide(F.sum(F.col("x") * F.col("ax")), F.sum(F.col("x") * F.col("x"))).alias("quotient"))


def warm_start_scale(entries: DataFrame, x0: DataFrame, b: DataFrame, sizes: DataFrame) -> DataFrame:
    """(case_id, alpha): the multiple of x0 whose residual is least."""
    joined = M.matvec(entries, x0, sizes, "ax").join(b.select("case_id", "i", F.col("x").alias("b")), ["case_id", "i"])
    return joined.groupBy("case_id").agg(F.try_divide(F.sum(F.col("b") * F.col("ax")), F.sum(F.col("ax") * F.col("ax"))).alias("alpha"))


def diagonal_defect(r: DataFrame, z: DataFrame) -> DataFrame:
    """(case_id, defect): 1 - (r,z)^2 / ((r,r)(z,z)), how far z is from a multiple of r."""
    joined = r.join(z.select("case_id", "i", F.col("x").alias("z")), ["case_id", "i"])
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    return joined.groupBy("case_id").agg((1 - F.try_divide(F.pow(dot("x", "z"), 2), dot("x", "x") * dot("z", "z"))).alias("defect"))
