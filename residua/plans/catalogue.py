"""Every query of the engine over the star-schema tables."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residua.functions import digests, exact
from residua.operators import blocks as B
from residua.operators import cases as C
from residua.operators import cluster as G
from residua.operators import inverses as N
from residua.operators import matrix as M
from residua.operators import metrics as E
from residua.operators import schwarz as W
from residua.operators import score as R
from residua.operators import solve as S
from residua.operators import vectors as V
from residua.operators import verdict as J
from residua.operators.storage import stored
from residua.plans import derive as D
from residua.schema import DIAGNOSTICS, METRICS
from residua.solvers import spectrum
from residua.sources import wire

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _system(spark, d, cases=1, diagonal="dominant"):
    return D.entries(spark, d, cases, diagonal), D.sizes(spark, d, cases)


def _ramp(spark, d, cases=1):
    """A vector of small integers: (case_id, i, x)."""
    return M.dense(D.sizes(spark, d, cases)).select("case_id", "i", (F.col("i") % 11 - 5).cast("double").alias("x"))


@query
def coo_canonicalize(spark, d):
    return M.canonicalize(D.raw_entries(spark, d, 7))


@query
def matrix_stats(spark, d):
    return M.stats(*_system(spark, d, 7))


@query
def matrix_transpose(spark, d):
    return M.transpose(D.entries(spark, d, 7))


@query
def csr_row_offsets(spark, d):
    return M.row_offsets(*_system(spark, d, 7))


@query
def csr_violations(spark, d):
    raw = D.raw_entries(spark, d, 7).withColumn("n", F.lit(None))
    wrong = raw.drop("n").withColumn("col", F.col("col") + F.when(F.col("row") % 5 == 0, 1_000_000_000).otherwise(0))
    return M.violations(wrong, D.sizes(spark, d, 7))


@query
def spmv(spark, d):
    a, n = _system(spark, d)
    return M.matvec(a, _ramp(spark, d), n)


@query
def spmv_transpose(spark, d):
    a, n = _system(spark, d)
    return M.matvec(M.transpose(a), _ramp(spark, d), n)


@query
def spmv_axpby(spark, d):
    a, n = _system(spark, d)
    x = _ramp(spark, d)
    return M.matvec_axpby(2.0, a, x, -0.5, x, n, transposed=True)


@query
def abs_spmv(spark, d):
    a, n = _system(spark, d)
    return M.product(a, _ramp(spark, d), n, ("y", F.abs(F.col("val")) * F.abs(F.col("x"))))


@query
def inf_norm(spark, d):
    return M.infinity_norm(D.entries(spark, d, 7))


@query
def one_norm(spark, d):
    return M.one_norm(D.entries(spark, d, 7))


@query
def asymmetry(spark, d):
    return M.asymmetry(D.entries(spark, d, 7))


@query
def max_abs(spark, d):
    return V.max_abs(D.rhs(spark, d, 7))


@query
def l2_norm(spark, d):
    return V.norm(D.rhs(spark, d, 7)).select("case_id", F.round("norm", 6).alias("norm"))


@query
def dot(spark, d):
    return V.dot(D.rhs(spark, d, 7), _ramp(spark, d, 7))


def _basis(spark, d):
    x, t = _ramp(spark, d), D.target(spark, d)
    named = lambda v, n: v.select("case_id", F.lit(n).alias("name"), "i", "x")
    return named(x, "ramp").unionByName(named(t, "target")).unionByName(named(V.scale(3.0, x), "steep"))


@query
def mass_dot(spark, d):
    return V.mass_dot(_basis(spark, d), ("with_ramp", _ramp(spark, d)), ("with_target", D.target(spark, d)))


@query
def tagged_dot(spark, d):
    x = _ramp(spark, d)
    return V.tagged_dot(x, D.target(spark, d), x.select("case_id", "i", (F.col("i") % 4).alias("tag")))


@query
def axpy(spark, d):
    return V.axpy(0.5, D.target(spark, d), _ramp(spark, d))


@query
def mass_axpy(spark, d):
    return V.mass_axpy({"ramp": 0.5, "target": -2.0, "steep": 0.25}, _basis(spark, d), D.target(spark, d))


@query
def scale(spark, d):
    return V.scale(-0.25, _ramp(spark, d))


@query
def diag_extract(spark, d):
    return M.diagonal(D.entries(spark, d, 7))


@query
def diag_scale(spark, d):
    return V.diagonal_scale(M.diagonal(D.entries(spark, d, 1, "dyadic")), _ramp(spark, d))


@query
def constant_vector(spark, d):
    return V.constant(M.dense(D.sizes(spark, d)), 0.0)


@query
def rademacher_target(spark, d):
    return D.target(spark, d)


@query
def manufactured_rhs(spark, d):
    return D.rhs(spark, d)


def _solved(spark, d):
    a, n = _system(spark, d, 7)
    return a, D.candidate(spark, d), D.rhs(spark, d, 7), n


@query
def residual(spark, d):
    a, x, b, _ = _solved(spark, d)
    return E.residuals(a, x, b).select("case_id", "i", "residual", F.round("spread", 6).alias("spread"), "row_norm")


def _measured(spark, d):
    return E.metrics(*_solved(spark, d), D.target(spark, d, 7))


def _rounded(frame: DataFrame, *names: str) -> DataFrame:
    """The metrics to nine decimals of their common logarithm; zero as -400."""
    return frame.select("case_id", *[F.round(F.when(F.col(m) == 0, -400.0).otherwise(F.log10(m)), 6).alias(m) for m in names])


@query
def normwise_error(spark, d):
    return _rounded(_measured(spark, d), METRICS[0])


@query
def componentwise_error(spark, d):
    return _rounded(_measured(spark, d), METRICS[1])


@query
def relative_residual(spark, d):
    return _rounded(_measured(spark, d), METRICS[2])


@query
def forward_errors(spark, d):
    return _rounded(_measured(spark, d), *METRICS[3:])


@query
def metrics_bundle(spark, d):
    return _rounded(_measured(spark, d), *METRICS)


@query
def accuracy_verdict(spark, d):
    both = D.case_table(spark, d)
    return J.accuracy(_measured(spark, d), both)


@query
def replay_verdict(spark, d):
    return J.accuracy(_measured(spark, d), D.case_table(spark, d, family="replay"))


@query
def verdict_cascade(spark, d):
    c = F.col("case_id").cast("int")
    runs = _measured(spark, d).join(D.case_table(spark, d), "case_id").select(
        "*", F.when(c == 1, 139).otherwise(0).alias("returncode"), (c != 2).alias("has_output"), F.when(c == 3, "driver output has the wrong size").alias("decode_error"),
        F.when(c == 4, 7).otherwise(0).alias("status"), (c == 5).alias("mutated"), (c != 6).alias("finite"), F.lit(True).alias("measured"),
    )
    return J.cascade(runs).select("case_id", "passed", "failure")


@query
def output_checks(spark, d):
    """Rules of a decoded output over timings taken from orders."""
    o = D.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("create"), (F.col("o_orderkey") % 5).alias("setup"), (F.col("o_orderkey") % 3).alias("solve"))
    elapsed = F.col("create") + F.col("setup") + F.col("solve") + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0)
    error = J.decode_checks(F.lit(64) + F.col("o_orderkey") % 13, F.lit(64) + F.col("o_orderkey") % 13 + F.when(F.col("o_orderkey") % 17 == 0, 8).otherwise(0), F.col("o_orderkey") % 19 != 0, elapsed, F.col("create"), F.col("setup"), F.col("solve"), F.when(F.col("o_orderkey") % 23 == 0, 2).otherwise(0))
    return o.select("o_orderkey", error.alias("error"))


@query
def finite_solution(spark, d):
    bad = D.candidate(spark, d).withColumn("x", F.when((F.col("case_id") == "3") & (F.col("i") == 5), F.lit(float("nan"))).when((F.col("case_id") == "6") & (F.col("i") == 9), F.lit(float("-inf"))).otherwise(F.col("x")))
    return E.finite_solutions(bad)


@query
def jacobi_sweeps_3(spark, d):
    a, n = _system(spark, d, 1, "dyadic")
    return S.jacobi(a, _ramp(spark, d), n, 3)


@query
def rayleigh_quotient(spark, d):
    a, n = _system(spark, d, 7)
    return S.rayleigh(a, _ramp(spark, d, 7), n).select("case_id", F.round("quotient", 6).alias("quotient"))


@query
def warmstart_rescale(spark, d):
    a, n = _system(spark, d, 7)
    return S.warm_start_scale(a, _ramp(spark, d, 7), D.rhs(spark, d, 7), n).select("case_id", F.round("alpha", 9).alias("alpha"))


@query
def diag_defect(spark, d):
    a, _ = _system(spark, d, 7)
    r = D.rhs(spark, d, 7)
    return S.diagonal_defect(r, V.diagonal_scale(M.diagonal(a), r)).select("case_id", F.round("defect", 9).alias("defect"))


def _problem(spark, d, symmetric=False):
    """(entries, right-hand sides, cases)."""
    if symmetric:
        a, n = D.symmetric_entries(spark, d), D.sizes(spark, d)
        b = M.matvec(a, D.target(spark, d), n, "x")
    else:
        a, n = _system(spark, d, 7)
        b = D.rhs(spark, d, 7)
    return a, b, n.withColumn("tolerance", F.lit(D.TOLERANCE))


def _grouped(spark, d, method, symmetric=False):
    a, b, cases = _problem(spark, d, symmetric)
    return S.solve_groups(a, b.select("case_id", "i", F.col("x").alias("b"), F.lit(0.0).alias("x0")), cases, method)


def _solved_by(spark, d, method, symmetric=False):
    """(case_id, i, x): each case in a task of its own if all are small, else over the cluster."""
    a, b, cases = _problem(spark, d, symmetric)
    if B.fits(a):
        return S.solutions(_grouped(spark, d, method, symmetric))
    return B.solve(a, b, cases.drop("tolerance"), D.TOLERANCE, method)[0]


def _rounded_solution(x: DataFrame) -> DataFrame:
    return x.select("case_id", "i", F.round("x", 5).alias("x"))


@query
def solve_bicgstab(spark, d):
    return _rounded_solution(_solved_by(spark, d, "bicgstab"))


@query
def solve_gmres(spark, d):
    return _rounded_solution(_solved_by(spark, d, "gmres"))


@query
def solve_fgmres(spark, d):
    return _rounded_solution(_solved_by(spark, d, "fgmres"))


@query
def solve_pcg(spark, d):
    return _rounded_solution(_solved_by(spark, d, "cg", symmetric=True))


@query
def solve_cg_distributed(spark, d):
    a, n = D.symmetric_entries(spark, d), D.sizes(spark, d)
    x, _ = B.solve(a, M.matvec(a, D.target(spark, d), n, "x"), n, 1e-9, "cg")
    return x.select("case_id", "i", F.round("x", 5).alias("x"))


@query
def solve_gmres_distributed(spark, d):
    """GMRES over the cluster on a nonsymmetric system, with its basis in blocks."""
    a, n = _system(spark, d)
    x, _ = B.solve(a, D.rhs(spark, d), n, 1e-9, "gmres")
    return x.select("case_id", "i", F.round("x", 5).alias("x"))


@query
def multigrid_couplings(spark, d):
    """Which unknowns are strongly coupled, either way."""
    return G.couplings(D.entries(spark, d, 7), D.COUPLED)


@query
def multigrid_aggregates(spark, d):
    """The aggregate of each unknown, founded over the cluster by independent sets."""
    return G.aggregates(*_system(spark, d), D.COUPLED)


@query
def multigrid_coarse(spark, d):
    """The matrix between aggregates, by sparse products."""
    a, n = _system(spark, d)
    return G.coarsened(a, G.aggregates(a, n, D.COUPLED))


@query
def multigrid_levels(spark, d):
    """Size, entries and sum of magnitudes of each level of a system's hierarchy."""
    a, n = _system(spark, d)
    levels = G.hierarchy(a, n, coarsest=20, strong=D.COUPLED)[:2]
    rows = [level.entries.groupBy("case_id").agg(F.lit(k).alias("level"), F.lit(level.n).cast("long").alias("n"), F.count("*").alias("nnz"), F.sum(F.abs("val")).alias("total")) for k, level in enumerate(levels)]
    return functools.reduce(DataFrame.unionByName, rows)


@query
def solve_ilu(spark, d):
    """Seven systems by BiCGStab with incomplete factors: each in a task if all are small,
    else over the cluster, with the factors of each block of rows."""
    return _rounded_solution(_solved_by(spark, d, "ilu_bicgstab"))


@query
def fsai_identity(spark, d):
    """What defines a factored approximate inverse G of a symmetric system: on the
    pattern of G, the product G A is zero but for the diagonal, where it is 1 / G."""
    found = N.fsai_products(D.symmetric_entries(spark, d), D.sizes(spark, d))
    return found.select("case_id", "row", "col", (F.round(F.col("product") * F.col("diagonal"), 9) + F.lit(0.0)).alias("identity"))


@query
def exact_sums(spark, d):
    """Prices summed without rounding on the way, by return flag and line."""
    own = D.table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", F.col("l_extendedprice").cast("double").alias("price"))
    return exact.exact_sums(own, ["l_returnflag", "l_linenumber"], "price").withColumn("total", F.round("total", 3))


@query
def solver_runs(spark, d):
    """Whether the grouped solves ended well: (case_id, status, returncode, mutated)."""
    a, b, cases = _problem(spark, d)
    if B.fits(a):
        return _grouped(spark, d, "bicgstab").select("case_id", "status", "returncode", "mutated")
    _, seen = B.solve(a, b, cases.drop("tolerance"), D.TOLERANCE, "bicgstab")
    # Tables are never written to: nothing can mutate.
    return spark.createDataFrame([(case, own.status, 0, False) for case, own in seen.items()], "case_id string, status int, returncode int, mutated boolean")


@query
def solve_and_verify(spark, d):
    """Solve, measure and judge, end to end: (case_id, passed, failure)."""
    a, n = _system(spark, d, 7)
    x = stored(_solved_by(spark, d, "bicgstab"), "results")
    return J.accuracy(E.metrics(a, x, D.rhs(spark, d, 7), n, D.target(spark, d, 7)), D.case_table(spark, d))


@query
def ritz_extremes(spark, d):
    """Extreme Ritz values of a conjugate-gradient run on each value of events."""

    def run(key, own):
        import numpy as np

        from residua.solvers.krylov import cg

        diag = 1.0 + np.sort(np.abs(np.array(own["value"], float)))
        found = cg(lambda x: diag * x, np.ones(len(diag)), np.zeros(len(diag)), lambda r: r, 1e-12, most=60)
        low, high = spectrum.extremes(found.alphas, found.betas)
        import pyarrow as pa

        return pa.table({"user_id": [key[0].as_py()], "low": [low], "high": [high], "least": [float(diag[0])], "greatest": [float(diag[-1])]})

    return D.table(spark, d, "events").groupBy("user_id").applyInArrow(run, "user_id long, low double, high double, least double, greatest double")


@query
def cost_switch(spark, d):
    """Which of two methods finishes sooner, from a condition number, by expressions."""
    cost = D.runs(spark, d).select("case_id", (1 + F.col("reference_ns") / 1e12).alias("condition"))
    root = F.sqrt("condition")
    steps = F.greatest(F.lit(1.0), F.acosh(F.lit(1e10)) / -F.log((root - 1) / (root + 1)))
    first = steps * 1.0
    second = F.lit(40.0) + F.sqrt(steps) * 5.0
    return cost.select("case_id", F.round(steps, 4).alias("steps"), F.when(first <= second, "first").otherwise("second").alias("choice"))


@query
def case_speedup(spark, d):
    return R.case_speedups(D.runs(spark, d)).select("case_id", "role", "passed", F.round("speedup", 6).alias("speedup"))


@query
def runtime_speedup(spark, d):
    """Gated on all cases, so null where one failed."""
    return R.runtime_speedup(D.runs(spark, d), D.plan(spark, d))


@query
def runtime_speedup_of_passing(spark, d):
    rows = D.runs(spark, d).where("passed")
    return R.runtime_speedup(rows, rows).withColumn("value", F.round("value", 9))


@query
def cases_solved(spark, d):
    return R.cases_solved(D.runs(spark, d), D.plan(spark, d))


@query
def completeness(spark, d):
    return R.completeness(D.runs(spark, d).where("case_id <> '3'"), D.plan(spark, d))


@query
def totals(spark, d):
    scored = D.runs(spark, d).where("role = 'scored'")
    return scored.agg(F.sum("reference_ns").alias("reference_ns"), F.sum("candidate_ns").alias("candidate_ns"), F.count("*").alias("cases"))


@query
def ordered_rows(spark, d):
    rows = D.plan(spark, d).select("case_id", F.col("case_id").cast("int").alias("idx")).withColumn("position", F.col("idx"))
    return R.in_order(rows)


@query
def paired_results(spark, d):
    rows = D.runs(spark, d)
    both = rows.select("case_id", F.lit("candidate").alias("role"), "passed", F.when(~F.col("passed"), "solution is not finite").alias("failure"), F.col("candidate_ns").alias("elapsed_ns"))
    both = both.unionByName(rows.select("case_id", F.lit("reference").alias("role"), F.lit(True).alias("passed"), F.lit(None).cast("string").alias("failure"), F.col("reference_ns").alias("elapsed_ns")))
    return R.paired(both)


@query
def best_candidate(spark, d):
    """The best supplier of each part by quantity, ties to the earliest order and line."""
    items = D.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return R.best_candidates(items, ["l_partkey"], "l_quantity", ["l_orderkey", "l_linenumber"])


@query
def running_best(spark, d):
    """The least value so far of each user, and the factor over the last eight events."""
    own = Window.partitionBy("user_id").orderBy("event_id")
    e = D.table(spark, d, "events")
    return e.select("event_id", "user_id", F.min("value").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("best"), F.lag("value", 8).over(own).alias("eight_before"))


@query
def case_select(spark, d):
    p = D.plan(spark, d).withColumn("idx", F.col("case_id").cast("int"))
    return C.select_cases(p, p.where("idx % 3 = 0").select("case_id")).select("case_id", "role", "idx")


@query
def unknown_cases(spark, d):
    p = D.plan(spark, d)
    wanted = p.select((F.col("case_id").cast("int") * 2).cast("string").alias("case_id"))
    return C.unknown_cases(p, wanted)


@query
def duplicate_ids(spark, d):
    return C.repeated(D.table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey")


@query
def manifest_violations(spark, d):
    o = D.table(spark, d, "orders")
    k = F.col("o_orderkey")
    rows = o.select(
        (k - k % 2 * F.when(k % 10 == 1, 1).otherwise(0)).cast("string").alias("case_id"), k.alias("position"), F.when(k % 13 == 0, k + 1).otherwise(k).alias("idx"), (k % 29).alias("n"), (k % 31 - 1).alias("nnz"),
        F.when(k % 37 == 0, F.lit(1.0)).otherwise(F.lit(0.5)).alias("tolerance"), F.when(k % 41 == 0, "other").otherwise("scored").alias("role"), F.when(k % 43 == 0, "xyz").otherwise(F.sha2(k.cast("string"), 256)).alias("input_sha256"),
    )
    return C.manifest_violations(rows)


@query
def run_coverage(spark, d):
    p = D.plan(spark, d)
    shifted = p.select((F.col("case_id").cast("int") + 2).cast("string").alias("case_id"), "role")
    return C.coverage(p, shifted)


@query
def forbidden_names(spark, d):
    names = D.table(spark, d, "nation").select(F.col("n_name").alias("name"))
    a = names.where(F.substring("name", 1, 1) < "F")
    b = D.table(spark, d, "region").select(F.col("r_name").alias("name"))
    return C.forbidden(names.union(b), a, b)


@query
def changed_metadata(spark, d):
    n = D.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("case_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    other = n.select("case_id", F.when(F.col("case_id").cast("int") % 4 == 0, F.lit(None)).otherwise(F.col("name")).alias("name"), F.when(F.col("case_id").cast("int") % 3 == 0, F.col("region") + 1).otherwise(F.col("region")).alias("region"))
    return C.changed_metadata(n, other)


@query
def diagnostics_tail(spark, d):
    own = D.table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.col("text").alias("diagnostics"))
    return C.tail_of_diagnostics(own, DIAGNOSTICS).select("case_id", F.length("diagnostics").alias("kept"), F.md5("diagnostics").alias("digest"))


@query
def source_audit(spark, d):
    own = D.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.concat(F.when(F.col("doc_id") % 3 == 0, "#include <a.h>\n").otherwise(""), F.when(F.col("doc_id") % 5 == 0, "  # include \"b.h\"\n").otherwise(""), F.col("text"), F.when(F.col("doc_id") % 7 == 0, "\r\n").otherwise("\n")).alias("text"))
    return C.source_violations(own, 8_000)


@query
def submission_audit(spark, d):
    c = D.table(spark, d, "customer")
    k = F.col("c_custkey")
    rows = c.select(F.concat(F.when(k % 7 == 0, "Bad Name").otherwise("solver-"), k.cast("string")).alias("name"), F.when(k % 11 == 0, "  ").otherwise("someone").alias("submitter"), F.when(k % 13 == 0, F.array(F.lit("mesh"), F.lit("other"))).otherwise(F.array(F.lit("mesh"))).alias("families"))
    return C.submission_violations(rows, ["mesh", "replay"])


@query
def wire_roundtrip(spark, d):
    """Cases packed as solver input in pieces, read back, and summed up."""
    a, n = _system(spark, d, 7)
    vecs = D.rhs(spark, d, 7).select("case_id", "i", F.col("x").alias("b"), F.lit(0.0).alias("x0"))
    return wire.read_inputs(wire.write_inputs(a, vecs, n.withColumn("tolerance", F.lit(D.TOLERANCE))))


@query
def matrix_digest(spark, d):
    return digests.matrix_digests(*_system(spark, d, 7))


@query
def vector_digest(spark, d):
    return digests.vector_digests(D.rhs(spark, d, 7))


@query
def solve_multigrid(spark, d):
    return _rounded_solution(_solved_by(spark, d, "multigrid_bicgstab"))


@query
def solve_chebyshev(spark, d):
    return _rounded_solution(_solved_by(spark, d, "chebyshev_cg", symmetric=True))


@query
def solve_cheapest(spark, d):
    return _rounded_solution(_solved_by(spark, d, "cheapest_cg", symmetric=True))


@query
def solve_switching(spark, d):
    """By the diagonal at first, by multigrid once that is predicted to end sooner."""
    return _rounded_solution(_solved_by(spark, d, "switching_cg", symmetric=True))


@query
def solve_switching_nonsymmetric(spark, d):
    return _rounded_solution(_solved_by(spark, d, "switching_bicgstab"))


@query
def schwarz_overlap(spark, d):
    """Parts of 16 unknowns each, with two layers of strongly coupled neighbours."""
    n = D.sizes(spark, d, 7)
    owned = M.dense(n).select("case_id", "i", F.expr("i div 16").alias("part"))
    return W.overlapping(D.entries(spark, d, 7), owned, 2, D.COUPLED, 6)


@query
def solve_schwarz(spark, d):
    """GMRES over the cluster with the weighted sum over overlapping parts."""
    a, n = _system(spark, d)
    x, _, _ = W.solve_schwarz(a, D.rhs(spark, d), n, 1e-9, strong=D.COUPLED)
    return x.select("case_id", "i", F.round("x", 5).alias("x"))


@query
def verdict_fail_closed(spark, d):
    """Solutions that are empty, short, doubled in a place, too long, not finite, or
    whole: each case has a verdict (case_id, passed, failure)."""
    c, i = F.col("case_id"), F.col("i")
    n = D.size(spark, d)
    x = D.target(spark, d, 7)
    kept = x.where((c != "1") & ~((c == "2") & (i == n - 1)) & ~((c == "3") & (i == 0)))
    extra = x.where((c == "3") & (i == 1)).unionByName(x.where((c == "4") & (i == 0)).withColumn("i", F.lit(n).cast("long")))
    x = kept.unionByName(extra).withColumn("x", F.when((c == "5") & (i == 2), F.lit(float("nan"))).otherwise(F.col("x")))
    a, sizes = _system(spark, d, 7)
    return J.accuracy(E.metrics(a, x, D.rhs(spark, d, 7), sizes, D.target(spark, d, 7)), D.case_table(spark, d))


@query
def case_pipeline(spark, d):
    """The seven systems packed as archives of a manifest and loaded again: the sums
    of what came back, and what is wrong.  Case 5 states another number of entries,
    case 6 lies under another digest, case 7 has no archive."""
    import hashlib

    from residua.functions.digests import matrix_digests
    from residua.sources import loading

    def pack(key, own):
        import io
        import tarfile

        import numpy as np
        import pyarrow as pa

        case = key[0].as_py()
        rows, cols, vals = (own[c].to_numpy() for c in ("row", "col", "val"))
        n = int(own["n"][0].as_py())
        head = f"%%MatrixMarket matrix coordinate real general\n{n} {n} {len(vals)}\n".encode()
        body = io.BytesIO()
        np.savetxt(body, np.column_stack([rows + 1, cols + 1, vals]), fmt=["%d", "%d", "%.17g"])
        data, out = head + body.getvalue(), io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz", compresslevel=1) as archive:
            info = tarfile.TarInfo(f"m{case}/m{case}.mtx")
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
        return pa.table({"case_id": [case], "content": pa.array([out.getvalue()], pa.binary())})

    a, sizes = _system(spark, d, 7)
    archives = a.where("case_id <> '7'").join(sizes, "case_id").groupBy("case_id").applyInArrow(pack, "case_id string, content binary")
    stated = a.groupBy("case_id").agg(F.count("*").alias("nnz")).join(matrix_digests(a, sizes), "case_id").join(sizes, "case_id").orderBy("case_id").collect()
    cases = [{"index": k, "case_id": r["case_id"], "n": r["n"], "nnz": r["nnz"] + (r["case_id"] == "5"), "tolerance": D.TOLERANCE, "source": {"name": f"m{r['case_id']}", "matrix_sha256": "0" * 64 if r["case_id"] == "6" else r["matrix_sha256"]}} for k, r in enumerate(stated)]
    rhs = {"scheme": "rademacher-hmac-sha256-v2", "public_key_hex": D.KEY.hex(), "key_id": hashlib.sha256(D.KEY).hexdigest(), "draw_index": 0}
    loaded, rules = loading.load(spark, {"family": "mesh", "release_id": "fixture", "rhs": rhs, "cases": cases}, archives)
    sums = loaded.entries.groupBy("case_id").agg(F.count("*").alias("entries"), F.sum("val").alias("sum_val"))
    signs = loaded.target.groupBy("case_id").agg(F.sum(F.abs("x")).alias("signs"))
    # A row of A sums to b where the target is one, so b = A target is told by its parity of signs: by A again.
    again = M.matvec(loaded.entries, loaded.target, loaded.cases.select("case_id", "n"), "y").join(loaded.b, ["case_id", "i"]).groupBy("case_id").agg(F.bool_and(F.col("y") == F.col("x")).alias("b_holds"))
    wrong = rules.groupBy("case_id").agg(F.concat_ws("; ", F.array_sort(F.collect_list("rule"))).alias("wrong"))
    out = loaded.cases.select("case_id", "n", F.length("input_sha256").alias("identity"))
    for part in (sums, signs, again, wrong):
        out = out.join(part, "case_id", "left")
    return out


@query
def matrix_market_load(spark, d):
    """The first system written as Matrix Market text in parts, and read again."""
    from residua.operators.storage import shared_dir
    from residua.sources.matrix_market import read_matrix_market

    a, sizes = _system(spark, d)
    n, nnz = D.size(spark, d), a.count()
    folder = f"{shared_dir(spark)}/residua/market-{uuid.uuid4().hex}"
    head = spark.range(1).select(F.concat(F.lit("%%MatrixMarket matrix coordinate real general\n"), F.repeat(F.lit("% a comment\n"), 500), F.lit(f"{n} {n} {nnz}")).alias("value"))
    body = a.select(F.format_string("%d %d %.17g", F.col("row") + 1, F.col("col") + 1, F.col("val")).alias("value"), F.col("row"), F.col("col"))
    # One text in parts: the head, and after it the entries in order.
    whole = head.select("value", F.lit(-1).cast("long").alias("row"), F.lit(-1).cast("long").alias("col")).unionByName(body)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole.repartitionByRange(parts, "row", "col").sortWithinPartitions("row", "col").select("value").write.text(folder)
    entries, _ = read_matrix_market(spark, folder, "0")
    return entries


@query
def archive_scan(spark, d):
    """Three of the seven systems, out of archives that hold them all: cases 1 to 4 in
    gzipped tar archives of their own, 5 to 7 in one zip archive."""
    from residua.operators.storage import shared_dir
    from residua.sources import archive_source

    folder = f"{shared_dir(spark)}/residua/archives-{uuid.uuid4().hex}"
    archive = F.when(F.col("case_id") < "5", F.concat(F.lit("m"), F.col("case_id"), F.lit(".tar.gz"))).otherwise("rest.zip")
    a, sizes = _system(spark, d, 7)

    def pack(key, own):
        import io
        import tarfile
        import zipfile

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        members, out = {}, io.BytesIO()
        for case in sorted(set(own["case_id"].to_pylist())):
            part = own.filter(pc.equal(own["case_id"], case))
            body, n = io.BytesIO(), part["n"][0].as_py()
            np.savetxt(body, np.column_stack([part["row"].to_numpy() + 1, part["col"].to_numpy() + 1, part["val"].to_numpy()]), fmt=["%d", "%d", "%.17g"])
            members[f"m{case}/m{case}.mtx"] = f"%%MatrixMarket matrix coordinate real general\n{n} {n} {part.num_rows}\n".encode() + body.getvalue()
        if key[0].as_py().endswith(".zip"):
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
                for name, data in members.items():
                    made.writestr(name, data)
        else:
            with tarfile.open(fileobj=out, mode="w:gz", compresslevel=1) as made:
                for name, data in members.items():
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    made.addfile(info, io.BytesIO(data))
        system, path = archive_source.opened(folder)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{key[0].as_py()}", compression=None) as file:
            file.write(out.getvalue())
        return pa.table({"archive": [key[0].as_py()]})

    # The systems are small enough for a task each: this is the fixture, the scan is what is tested.
    a.join(sizes, "case_id").withColumn("archive", archive).groupBy("archive").applyInArrow(pack, "archive string").write.format("noop").mode("overwrite").save()
    archive_source.register(spark)
    return spark.read.format(archive_source.NAME).load(folder).where(F.col("case_id").isin("m2", "m5", "m7"))


@query
def execution_violations(spark, d):
    """Executions and inputs that break a rule, over records made of orders."""
    k = F.col("o_orderkey")
    rows = D.table(spark, d, "orders").select(
        k.cast("string").alias("case_id"), F.when(k % 7 == 0, F.lit(None)).otherwise(k % 3).cast("int").alias("returncode"),
        F.when(k % 11 == 0, F.lit(float("nan"))).when(k % 13 == 0, F.lit(-1.0)).otherwise(F.lit(0.5)).alias("wall_seconds"), F.when(k % 17 == 0, F.lit(None)).otherwise(F.lit("said")).alias("diagnostics"),
    )
    return C.execution_violations(rows)


@query
def input_violations(spark, d):
    """Vectors that are not as long as their matrix, or hold what is not finite."""
    o = D.table(spark, d, "orders")
    k = F.col("o_orderkey")
    cases = o.select(F.when(k % 19 == 0, F.lit("caf\u00e9")).otherwise(k.cast("string")).alias("case_id"), k.alias("key"), (1 + k % 3).alias("n"), F.when(k % 5 == 0, F.lit(1.0)).otherwise(F.lit(0.5)).alias("tolerance"))
    vectors = cases.select("case_id", "key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - F.when(F.col("key") % 7 == 0, 0).otherwise(1))).alias("i")).select("case_id", "i", F.when(F.col("key") % 11 == 0, F.lit(float("inf"))).otherwise(F.lit(1.0)).alias("b"), F.lit(0.0).alias("x0"))
    return C.input_violations(cases.where("key % 19 <> 0").select("case_id", "n", "tolerance").unionByName(cases.where("key % 19 = 0").select("case_id", F.lit(1).cast("long").alias("n"), F.lit(0.5).alias("tolerance")).distinct()), vectors.where("case_id <> 'caf\u00e9'").unionByName(spark.range(1).select(F.lit("caf\u00e9").alias("case_id"), F.col("id").alias("i"), F.lit(1.0).alias("b"), F.lit(0.0).alias("x0"))))


@query
def resource_violations(spark, d):
    o = D.table(spark, d, "orders")
    k = F.col("o_orderkey")
    return C.resource_violations(o.select(k.cast("string").alias("name"), F.when(k % 5 == 0, F.lit(0.0)).otherwise(F.lit(2.0)).alias("cpus"), F.when(k % 7 == 0, F.lit(1000)).otherwise(F.lit(1 << 30)).cast("long").alias("memory_bytes")))


@query
def common_names(spark, d):
    """Names that all lists have: an intersection of sets."""
    li = D.table(spark, d, "lineitem")
    return C.common(*[li.where(F.col("l_linenumber") == k).select(F.col("l_partkey").cast("string").alias("name")) for k in (1, 2, 3)])


@query
def merged_identities(spark, d):
    """Two maps of fields merged, the second before the first, and their keys."""
    n = D.table(spark, d, "nation")
    first = F.create_map(F.lit("name"), F.col("n_name"), F.lit("key"), F.col("n_nationkey").cast("string"))
    second = F.create_map(F.lit("name"), F.lower("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    merged = n.select("n_nationkey", C.merged(first, second).alias("m"))
    return merged.select("n_nationkey", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), F.col("m")["name"].alias("name"), F.col("m")["key"].alias("key"), F.col("m")["region"].alias("region"))


@query
def reference_gate(spark, d):
    """Cases whose fixed reference failed: any makes an evaluation void."""
    rows = D.runs(spark, d).withColumn("reference_passed", F.col("case_id").cast("int") % 17 != 3)
    return R.reference_failures(rows)


@query
def execution_statistics(spark, d):
    """Counts and seconds of runs by role and outcome, with the share of the whole."""
    return R.statistics(D.runs(spark, d).select("case_id", "role", "passed", (F.col("candidate_ns") / 1e9).alias("seconds"))).select("role", "passed", "runs", F.round("total_seconds", 6).alias("total_seconds"), F.round("longest_seconds", 6).alias("longest_seconds"), F.round("share", 9).alias("share"))
