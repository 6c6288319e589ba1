import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.operators import blocks as B
from residua.operators import matrix as M
from residua.plans import derive as D


@pytest.fixture
def spans(monkeypatch):
    monkeypatch.setattr(B, "SPAN", 37)  # many blocks, the last one short


def _aimed(x, target):
    found = x.join(target.withColumnRenamed("x", "t"), ["case_id", "i"]).groupBy("case_id").agg(F.count("*").alias("n"), F.max(F.abs(F.col("x") - F.col("t"))).alias("error"))
    return {r["case_id"]: (r["n"], r["error"]) for r in found.collect()}


@pytest.mark.parametrize("method", ["cg", "chebyshev_cg", "cheapest_cg", "switching_cg"])
def test_cg_over_blocks(spark, small, spans, method):
    a, n, t = D.symmetric_entries(spark, small), D.sizes(spark, small), D.target(spark, small)
    x, seen = B.solve(a, M.matvec(a, t, n, "x"), n, 1e-10, method)
    size, error = _aimed(x, t)["0"]
    assert size == x.count() == D.size(spark, small) and error < 1e-7
    assert seen["0"].status == 0 and 0 < seen["0"].iterations < 60


def test_bicgstab_over_blocks_in_step(spark, small, spans):
    a, n, t = D.entries(spark, small, 7), D.sizes(spark, small, 7), D.target(spark, small, 7)
    # A case without a right-hand side is solved by zero, and does not keep the others waiting.
    b = D.rhs(spark, small, 7).withColumn("x", F.when(F.col("case_id") == "3", 0.0).otherwise(F.col("x")))
    x, seen = B.solve(a, b, n, 1e-10, "bicgstab")
    found = _aimed(x, t)
    assert len(found) == 7 and all(own == (D.size(spark, small), own[1]) for own in found.values())
    assert found.pop("3")[1] == 1.0 and max(error for _, error in found.values()) < 1e-7
    assert seen["3"].iterations == 0 and all(own.status == 0 for own in seen.values())


def test_what_is_not_definite_is_told(spark):
    a = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 1, -1.0)], "case_id string, row bigint, col bigint, val double")
    b = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0)], "case_id string, i bigint, x double")
    with pytest.raises(ArithmeticError, match="case a"):
        B.solve(a, b, spark.createDataFrame([("a", 2)], "case_id string, n bigint"), 1e-10, "cg")
    x, _ = B.solve(a, b, spark.createDataFrame([("a", 2)], "case_id string, n bigint"), 1e-10, "bicgstab")
    assert np.allclose([r["x"] for r in x.orderBy("i").collect()], [1.0, -2.0])


def test_a_case_is_handed_to_multigrid_where_it_is(spark, small, spans, monkeypatch):
    monkeypatch.setattr(B.switching.Controller, "__call__", lambda self, out: len(out.residuals) > 3)
    a, n, t = D.symmetric_entries(spark, small), D.sizes(spark, small), D.target(spark, small)
    x, seen = B.solve(a, M.matvec(a, t, n, "x"), n, 1e-10, "switching_cg")
    size, error = _aimed(x, t)["0"]
    assert size == D.size(spark, small) and error < 1e-7 and seen["0"].status == 0


def test_large_cases_leave_the_single_task(spark, small, spans, monkeypatch):
    from residua.operators import solve as S
    from residua.plans import catalogue

    monkeypatch.setattr(B, "IN_TASK", 1_000)
    monkeypatch.setattr(S, "solve_groups", None)
    found = catalogue.QUERIES["solve_pcg"](spark, small)
    size, error = _aimed(found, D.target(spark, small))["0"]
    assert size == D.size(spark, small) and error == 0
    runs = catalogue.QUERIES["solver_runs"](spark, small).collect()
    assert len(runs) == 7 and {tuple(r)[1:] for r in runs} == {(0, 0, False)}


@pytest.mark.parametrize("restart", [30, 4])
def test_gmres_over_blocks_in_step(spark, small, spans, restart, monkeypatch):
    monkeypatch.setitem(B.METHODS, "short", lambda systems, out, most: B._gmres(systems, out, most, restart))
    a, n, t = D.entries(spark, small, 7), D.sizes(spark, small, 7), D.target(spark, small, 7)
    b = D.rhs(spark, small, 7).withColumn("x", F.when(F.col("case_id") == "3", 0.0).otherwise(F.col("x")))
    # One case has an easier aim's worth of work: its matrix is its diagonal alone.
    a = a.where("case_id <> '5' or row = col")
    b = b.where("case_id <> '5'").unionByName(M.matvec(a.where("case_id = '5'"), t, n.where("case_id = '5'"), "x"))
    x, seen = B.solve(a, b, n, 1e-10, "short")
    found = _aimed(x, t)
    assert len(found) == 7 and found.pop("3")[1] == 1.0 and max(error for _, error in found.values()) < 1e-7
    assert seen["5"].iterations == 1 and seen["1"].iterations > 4 and all(own.status == 0 for own in seen.values())


@pytest.mark.parametrize("name", ["solve_gmres", "solve_fgmres"])
def test_large_cases_of_gmres_leave_the_single_task(spark, small, monkeypatch, name):
    from residua.operators import solve as S
    from residua.plans import catalogue

    monkeypatch.setattr(B, "IN_TASK", 100)
    monkeypatch.setattr(S, "solve_groups", None)
    found = _aimed(catalogue.QUERIES[name](spark, small), D.target(spark, small, 7))
    assert len(found) == 7 and set(found.values()) == {(D.size(spark, small), 0.0)}


def test_large_cases_of_multigrid_leave_the_single_task(spark, small, spans, monkeypatch):
    from residua.operators import solve as S
    from residua.plans import catalogue

    monkeypatch.setattr(B, "IN_TASK", 100)
    monkeypatch.setattr(S, "solve_groups", None)
    found = _aimed(catalogue.QUERIES["solve_multigrid"](spark, small), D.target(spark, small, 7))
    assert len(found) == 7 and set(found.values()) == {(D.size(spark, small), 0.0)}


def test_a_step_neither_shuffles_nor_rewrites_what_stays(spark, small, spans):
    from residua.operators.storage import scratch

    a, n, t = D.entries(spark, small), D.sizes(spark, small), D.target(spark, small)
    with scratch(spark):
        systems = B.Systems(spark, {"0": D.size(spark, small)})
        systems.load(a)
        systems.take(t, "t")
        systems.take(M.diagonal(a), "d")
        systems.step(["t", "d", "y"], {}, product=("t", "y"))
        before, kept = dict(systems.state["0"]), ["t", "d", "y", "w"]
        found = systems.step(kept, {"tz": ("t", "z")}, before=lambda v, s: v.update(z=2 * v["y"]), product=("z", "w"))
        assert sorted(systems.state["0"]) == sorted(kept) and all(systems.state["0"][name] == before[name] for name in before)
        assert systems.folders == set(systems.state["0"].values())
        y = systems.table("y", ["0"])
        assert "Exchange" not in y._jdf.queryExecution().executedPlan().toString()
        both = y.join(D.rhs(spark, small).withColumnRenamed("x", "b"), ["case_id", "i"]).join(t.withColumnRenamed("x", "t"), ["case_id", "i"]).toPandas()
        assert len(both) == D.size(spark, small) and np.allclose(both.x, both.b)
        assert np.isclose(found["0"]["tz"], 2 * both.x @ both.t)


def test_an_approximate_inverse_is_measured_without_pairs(spark, small, spans, monkeypatch):
    from residua.operators import cluster as G
    from residua.operators import inverses as N
    from residua.plans import catalogue

    monkeypatch.setattr(G, "GROUP", 8)
    monkeypatch.setattr(G, "PAIRS", 50)
    monkeypatch.setattr(N, "PLACES", 100)
    a = D.symmetric_entries(spark, small)
    pairs = G.between(a, G.lower_pattern(a))
    want = G.product_on_pattern(G.fsai(a, pairs), pairs).toPandas().sort_values(["row", "col"])
    found = N.fsai_products(a, D.sizes(spark, small)).toPandas().sort_values(["row", "col"])
    assert (found[["row", "col"]].to_numpy() == want[["row", "col"]].to_numpy()).all() and np.allclose(found[["val", "product"]], want[["val", "product"]])
    monkeypatch.setattr(G, "between", None)
    own = catalogue.QUERIES["fsai_identity"](spark, small)
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString() and own.count() == len(want)


def test_large_cases_of_incomplete_factors_leave_the_single_task(spark, small, spans, monkeypatch):
    from residua.operators import solve as S
    from residua.plans import catalogue

    monkeypatch.setattr(B, "IN_TASK", 100)
    monkeypatch.setattr(S, "solve_groups", None)
    found = _aimed(catalogue.QUERIES["solve_ilu"](spark, small), D.target(spark, small, 7))
    assert len(found) == 7 and set(found.values()) == {(D.size(spark, small), 0.0)}
