import numpy as np
import pytest
from pyspark.sql import functions as F
from test_cluster import _frame, _grid, _values, _vector

from residua.operators import cluster as C
from residua.operators import schwarz as W
from residua.operators.storage import scratch
from residua.solvers import krylov


def _members(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["part"], {})[r["i"]] = r["own"]
    return out


def _plain(a, members, restricted):
    """The preconditioner as a dense matrix."""
    out, held = np.zeros_like(a), np.zeros(len(a))
    for own in members.values():
        held[list(own)] += 1
    for own in members.values():
        places = sorted(own)
        weight = np.array([float(own[i]) if restricted else 1 / held[i] for i in places])
        out[np.ix_(places, places)] += weight[:, None] * np.linalg.inv(a[np.ix_(places, places)])
    return out


@pytest.mark.parametrize("restricted", [True, False])
def test_sum_over_parts_equals_small_inverses(spark, restricted):
    a = _grid(7)
    n = len(a)
    entries, sizes = _frame(spark, a)
    with scratch(spark):
        owned = W.parts(entries, sizes, 8)
        members = W.overlapping(entries, owned)
        inside = _members(members)
        r = np.cos(np.arange(float(n)))
        found = _values(W.schwarz(W.factors(entries, members, restricted))(_vector(spark, r)), n)
        assert np.allclose(found, _plain(a, inside, restricted) @ r, atol=1e-10)
        owners = [(i, p) for p, own in inside.items() for i, mine in own.items() if mine]
        assert sorted(i for i, _ in owners) == list(range(n)) and len(inside) > 3
        # One layer is the strongly coupled neighbours of what a part owns.
        links = {(x["i"], x["j"]) for x in C.couplings(entries).collect()}
        for p, own in inside.items():
            mine = {i for i, q in owners if q == p}
            assert set(own) == mine | {j for i, j in links if i in mine}


def test_gmres_takes_fewer_steps(spark):
    a = _grid(6)
    entries, sizes = _frame(spark, a)
    target = 1 + np.sin(np.arange(36.0))
    x, steps, residual = W.solve_schwarz(entries, _vector(spark, a @ target), sizes, 1e-6, size=8)
    assert np.allclose(_values(x, 36), target, atol=1e-4) and residual <= 1.01e-6
    # As many steps as the cluster's GMRES takes by the diagonal alone (tests/test_cluster.py).
    assert steps < krylov.gmres(lambda v: a @ v, a @ target, np.zeros(36), lambda v: v / np.diag(a), 1e-6).iterations


@pytest.mark.parametrize("kind", ["star", "diagonal", "grid"])
def test_parts_are_of_bounded_size(spark, kind):
    n, size = 144, 12
    if kind == "grid":
        a = _grid(12)
    else:
        a = np.eye(n)
        if kind == "star":
            a[0, 1:] = a[1:, 0] = -1.0
            a[0, 0] = n
    entries, sizes = _frame(spark, a)
    with scratch(spark):
        owned = W.parts(entries, sizes, size)
        counts = [r["count"] for r in owned.groupBy("part").count().collect()]
        assert sum(counts) == n == owned.select("i").distinct().count() and max(counts) <= 2.5 * size
        members = _members(W.overlapping(entries, owned))
        held = [len(own) for own in members.values()]
        # A hub stays in its own part, and brings none in.
        assert max(held) <= (2.5 * size if kind != "grid" else 5 * 2 * size)
        assert kind == "grid" or sum(held) == n


def test_layers_grow_and_singular_parts_have_a_pseudo_inverse(spark):
    a = np.diag(np.full(12, 2.0)) + np.diag(np.full(11, -1.0), 1) + np.diag(np.full(11, -1.0), -1)
    entries, _ = _frame(spark, a)
    owned = spark.range(12).select(F.lit("c").alias("case_id"), F.col("id").alias("i"), F.floor(F.col("id") / 4).alias("part"))
    for layers, want in ((0, range(4, 8)), (1, range(3, 9)), (3, range(1, 11))):
        assert sorted(_members(W.overlapping(entries, owned, layers))[1]) == list(want)
    single, sizes = _frame(spark, np.array([[1.0, 1.0], [1.0, 1.0]]))
    one = spark.createDataFrame([("c", 0, 0, True), ("c", 0, 1, True)], "case_id string, part bigint, i bigint, own boolean")
    assert np.allclose(_values(W.schwarz(W.factors(single, one))(_vector(spark, [2.0, 2.0])), 2), [1.0, 1.0])
    # An unknown without entries gives nothing.
    more = one.unionByName(spark.createDataFrame([("c", 0, 2, True)], one.schema))
    assert np.allclose(_values(W.schwarz(W.factors(single, more))(_vector(spark, [2.0, 2.0, 5.0])), 3), [1.0, 1.0, 0.0])


def test_kept_inverses_are_not_shuffled_again(spark, monkeypatch):
    a = np.diag([4.0] * 12) + np.diag([-1.0] * 11, 1) + np.diag([-1.0] * 11, -1)
    entries = spark.createDataFrame([("c", int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "case_id string, row bigint, col bigint, val double")
    b = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(a @ np.arange(12.0))], "case_id string, i bigint, x double")
    plans, plain = [], W.schwarz

    def watched(inverses):
        apply = plain(inverses)
        plans.append(apply(b)._jdf.queryExecution().executedPlan().toString())
        return apply

    monkeypatch.setattr(W, "schwarz", watched)
    x, _, _ = W.solve_schwarz(entries, b, spark.createDataFrame([("c", 12)], "case_id string, n bigint"), 1e-8, size=4)
    assert np.allclose([r["x"] for r in x.orderBy("i").collect()], np.arange(12.0), atol=1e-6)
    # The side of the inverses, down to where they are kept, has no exchange.
    side = plans[0].split("FlatMapCoGroupsInArrow")[1].split("InMemoryTableScan")[0]
    assert "InMemoryTableScan" in plans[0] and "Exchange" not in side


def test_large_systems_go_by_files_of_blocks(spark, monkeypatch):
    from residua.operators import blocks as B
    from residua.operators import schwarz_blocks as P

    a = _grid(12)
    n = len(a)
    monkeypatch.setattr(B, "SPAN", 60)
    monkeypatch.setattr(P, "PAIRS", 50)
    entries, sizes = _frame(spark, a)
    r, target = np.cos(np.arange(float(n))), 1 + np.sin(np.arange(float(n)))
    with scratch(spark):
        owned = W.parts(entries, sizes, 8)
        systems = B.Systems(spark, {sizes.first()["case_id"]: n})
        systems.load(entries)
        systems.take(C.M.diagonal(entries), "d")
        systems.take(_vector(spark, r), "r")
        deal, links = P.owners(systems, 8, 0.25)
        assert sorted(map(tuple, W._placed(deal, 8).collect())) == sorted(map(tuple, owned.collect()))
        members = W.overlapping(entries, owned, links=links)
        assert _members(members) == _members(W.overlapping(entries, owned))
        P.factors(systems, members)(systems, "r", "z")
        found = _values(systems.table("z", systems.cases), n)
        assert np.allclose(found, _plain(a, _members(members), True) @ r, atol=1e-10)
    monkeypatch.setattr(B, "IN_TASK", 100)
    monkeypatch.setattr(W, "solve_gmres", None)
    x, steps, residual = W.solve_schwarz(entries, _vector(spark, a @ target), sizes, 1e-6, size=8)
    assert np.allclose(_values(x, n), target, atol=1e-3) and residual <= 1e-6 and steps > 0
