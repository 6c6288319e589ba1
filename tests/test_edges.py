import math

import pytest
from pyspark.sql import functions as F

from residua.functions.numeric import ratio_or_zero, safe_ratio, short_general
from residua.functions.rademacher import signs
from residua.operators import cases as C
from residua.operators import matrix as M
from residua.operators import metrics as E
from residua.operators import score as R
from residua.operators import vectors as V
from residua.operators import verdict as J
from residua.plans import derive as D
from residua.schema import METRICS

INF, NAN = float("inf"), float("nan")
E_, V_, S_ = "case_id string, row bigint, col bigint, val double", "case_id string, i bigint, x double", "case_id string, n bigint"


@pytest.mark.parametrize(("num", "den", "want"), [(1.0, 2.0, 0.5), (0.0, 0.0, 0.0), (1.0, 0.0, INF), (NAN, 1.0, INF), (1.0, INF, INF)])
def test_safe_ratio(spark, num, den, want):
    assert spark.range(1).select(safe_ratio(F.lit(num), F.lit(den))).first()[0] == want


def test_ratio_or_zero(spark):
    got = spark.range(1).select(ratio_or_zero(F.lit(0.0), F.lit(0.0)), ratio_or_zero(F.lit(-2.0), F.lit(0.0)), ratio_or_zero(F.lit(-2.0), F.lit(4.0))).first()
    assert tuple(got) == (0.0, INF, 0.5)


@pytest.mark.parametrize("x", [1e-10, 1.5e-8, 1e-5, 0.001, 2.5, 100.0, 123456.0, 1234567.0, 4.44089e-15, 1.0000010e-10])
def test_short_general(spark, x):
    assert spark.range(1).select(short_general(F.lit(x))).first()[0] == f"{x:g}"


def test_duplicates_that_cancel_disappear(spark):
    e = spark.createDataFrame([("a", 0, 0, 2.0), ("a", 0, 0, -2.0), ("a", 1, 0, 1.0), ("a", 1, 0, 2.0)], E_)
    assert [tuple(r) for r in M.canonicalize(e).collect()] == [("a", 1, 0, 3.0)]


def test_rules_of_entries(spark):
    rows = [("a", 0, 0, 1.0, 0), ("a", 0, 2, 1.0, 1), ("a", 0, 1, 1.0, 2), ("a", 1, 5, 1.0, 3), ("a", -1, 0, 1.0, 4), ("a", 1, 1, NAN, 5), ("a", 2, 1, 0.0, 6), ("z", 0, 0, 1.0, 7)]
    e = spark.createDataFrame(rows, E_ + ", pos bigint")
    found = {(r["case_id"], r["rule"]) for r in M.violations(e, spark.createDataFrame([("a", 3)], S_)).collect()}
    assert found == {("a", "columns not increasing"), ("a", "column out of range"), ("a", "row out of range"), ("a", "value not finite"), ("a", "explicit zero"), ("a", "columns not increasing"), ("z", "unknown case")}


def test_symmetric_matrix_is_told(spark):
    e = spark.createDataFrame([("s", 0, 1, 2.0), ("s", 1, 0, 2.0), ("n", 0, 1, 2.0)], E_)
    assert {r["case_id"]: r["nonsymmetric"] for r in M.asymmetry(e).collect()} == {"s": False, "n": True}


def test_rows_without_entries_count(spark):
    e = spark.createDataFrame([("a", 0, 0, 2.0)], E_)
    n = spark.createDataFrame([("a", 3)], S_)
    x = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), ("a", 2, 1.0)], V_)
    assert [r["y"] for r in M.matvec(e, x, n).orderBy("i").collect()] == [2.0, 0.0, 0.0]
    assert [(r["count"], r["start"]) for r in M.row_offsets(e, n).orderBy("i").collect()] == [(1, 0), (0, 1), (0, 1)]


def _metrics(spark, entries, x, b, target=None):
    e = spark.createDataFrame([("a", *t) for t in entries], E_)
    vec = lambda v: spark.createDataFrame([("a", i, float(t)) for i, t in enumerate(v)], V_)
    n = spark.createDataFrame([("a", len(x))], S_)
    return E.metrics(e, vec(x), vec(b), n, None if target is None else vec(target)).first()


def test_zero_rhs_and_zero_residual(spark):
    m = _metrics(spark, [(0, 0, 1.0), (1, 1, 1.0)], [0, 0], [0, 0])
    assert m[METRICS[0]] == 0 and m[METRICS[1]] == 0 and m[METRICS[2]] == 0 and m[METRICS[3]] is None


def test_zero_rhs_and_some_residual(spark):
    m = _metrics(spark, [(0, 0, 1.0), (1, 1, 1.0)], [1, 0], [0, 0], [0, 0])
    assert m[METRICS[2]] == INF and m[METRICS[3]] == INF and m[METRICS[4]] == INF


def test_huge_numbers_do_not_overflow(spark):
    m = _metrics(spark, [(0, 0, 1.0), (1, 1, 1.0)], [1e300, 1e300], [2e300, 2e300], [1e300, 2e300])
    assert math.isclose(m[METRICS[2]], 0.5, rel_tol=1e-12) and math.isclose(m[METRICS[3]], math.sqrt(0.2), rel_tol=1e-12)


def test_at_the_limit_passes_and_missing_is_invalid(spark):
    rows = [("a", 1e-10, 1e-8, 1.0, 1e-5, 1e-5), ("b", 1e-10, 1e-8, 1.0, None, 1e-5), ("c", NAN, 1e-8, 1.0, 1e-5, 1e-5), ("d", 1e-10, 2e-8, 1.0, 1e-5, 1e-5)]
    m = spark.createDataFrame(rows, "case_id string, " + ", ".join(f"{n} double" for n in METRICS))
    c = m.select("case_id", F.lit("mesh").alias("family"), F.lit(1e-6).alias("tolerance"))
    found = {r["case_id"]: r["failure"] for r in J.accuracy(m, c).collect()}
    assert found == {"a": None, "b": f"invalid {METRICS[3]}", "c": f"invalid {METRICS[0]}", "d": f"{METRICS[1]} exceeds 1e-08"}


def test_incomplete_runs_have_no_score(spark):
    rows = spark.createDataFrame([("a", "scored", True, 10, 5, True)], "case_id string, role string, passed boolean, reference_ns bigint, candidate_ns bigint, reference_passed boolean")
    plan = spark.createDataFrame([("a", "scored"), ("b", "scored")], "case_id string, role string")
    assert R.cases_solved(rows, plan).first().asDict() == {"value": None, "solved_cases": 1, "evaluated_cases": 1, "total_cases": 2, "complete": False, "all_passed": True}
    assert R.runtime_speedup(rows, plan).first()["value"] is None
    assert R.runtime_speedup(rows, plan.where("case_id = 'a'")).first()["value"] == 2.0


def test_failed_control_voids_the_speedup(spark):
    rows = spark.createDataFrame([("a", "scored", True, 10, 5, True), ("k", "control", False, 10, 5, True)], "case_id string, role string, passed boolean, reference_ns bigint, candidate_ns bigint, reference_passed boolean")
    got = R.runtime_speedup(rows, rows).first()
    assert got["value"] is None and got["all_passed"] is False and got["complete"] is True


def test_failed_reference_raises(spark):
    rows = spark.createDataFrame([("a", False)], "case_id string, reference_passed boolean")
    assert R.reference_failures(rows).count() == 1
    with pytest.raises(Exception, match="fixed reference failed on a"):
        R.require_references(rows).collect()


def test_report_has_null_for_infinity(spark):
    text = R.report(spark.createDataFrame([(INF, True)], "value double, complete boolean"), {"split": "dev"}, official_venue="v", venue="v")
    assert '"value": null' in text and '"official": true' in text


def test_cases_selected_twice_or_unknown(spark):
    cases = spark.createDataFrame([("b", 1), ("a", 0)], "case_id string, idx int")
    wanted = spark.createDataFrame([("b",), ("b",), ("q",)], "case_id string")
    assert [r[0] for r in C.select_cases(cases, wanted).collect()] == ["b"]
    assert [r[0] for r in C.unknown_cases(cases, wanted).collect()] == ["q"]


def test_indices_are_dealt_over_tasks_and_not_broadcast(spark):
    sizes = spark.createDataFrame([("a", 300_000), ("b", 5)], S_)
    indices = M.dense(sizes)
    assert indices.count() == 300_005
    filled = indices.groupBy(F.spark_partition_id()).count().collect()
    assert len(filled) > 1 and max(r["count"] for r in filled) < 300_000
    x = indices.select("case_id", "i", F.lit(2.0).alias("x"))
    joined = V.dot(x, x)
    assert {tuple(r) for r in joined.collect()} == {("a", 1_200_000.0), ("b", 20.0)}
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    target = signs(sizes, b"key", b"prefix")
    assert len(target.groupBy(F.spark_partition_id()).count().collect()) > 1


def test_partitions_of_metrics_do_not_grow_with_the_entries(spark, small, monkeypatch):
    a, x, b, n = D.entries(spark, small, 7), D.candidate(spark, small), D.rhs(spark, small, 7), D.sizes(spark, small, 7)
    before = E.residuals(a, x, b)
    want = sorted(map(tuple, before.select("case_id", "i", F.round("residual", 6), "row_norm").collect()))
    monkeypatch.setattr(E, "ROWS", 500)
    found = E.residuals(a, x, b)
    assert sorted(map(tuple, found.select("case_id", "i", F.round("residual", 6), "row_norm").collect())) == want
    assert found.rdd.getNumPartitions() == -(-a.count() // 500) > 4
    assert E.metrics(a, x, b, n, D.target(spark, small, 7)).count() == 7
