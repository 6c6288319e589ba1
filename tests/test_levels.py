import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.operators import blocks as B
from residua.operators import levels as L
from residua.operators import matrix as M
from residua.operators.storage import scratch
from residua.plans import derive as D
from residua.solvers import multigrid


@pytest.fixture
def spans(monkeypatch):
    monkeypatch.setattr(B, "SPAN", 37)


@pytest.mark.parametrize("entries", [2_000_000, 400])
def test_levels_in_blocks_equal_those_of_one_task(spark, small, spans, entries, monkeypatch):
    """Two cases in step: aggregates, coarse matrices and a cycle, by blocks that are as long on each level or not."""
    monkeypatch.setattr(L, "ENTRIES", entries)
    a, n = D.entries(spark, small, 7).where("case_id < '3'"), D.size(spark, small)
    frame = a.toPandas()
    r = np.cos(np.arange(n))
    b = spark.range(n).select(F.explode(F.array(F.lit("1"), F.lit("2"))).alias("case_id"), F.col("id").alias("i"), F.cos("id").alias("x"))
    with scratch(spark):
        systems = B.Systems(spark, {"1": n, "2": n})
        systems.load(a)
        systems.take(M.diagonal(a), "d")
        systems.take(b, "b")
        levels = L.hierarchy(systems, coarsest=20, in_task=0)
        assert len(levels.own) > 1 and levels.packed and (levels.own[1].span < 37) == (entries == 400)
        L.cycle(levels, "b", "z")
        rank, z = (systems.table(name, ["1", "2"]).toPandas() for name in ("rank", "z"))
        for case in ("1", "2"):
            own = frame[frame.case_id == case].sort_values(["row", "col"])
            arrays = own.row.to_numpy(), own.col.to_numpy(), own.val.to_numpy()
            want = multigrid.aggregates(n, *arrays)
            assert rank[rank.case_id == case].sort_values("i").x.astype(int).tolist() == want.tolist()
            # Its one task goes on down by the same rule, but from another size.
            whole = multigrid.Multigrid.__new__(multigrid.Multigrid)
            whole.levels = [multigrid.Level(n, *arrays, multigrid.inverse_diagonal(n, *arrays), want)]
            for _ in range(len(levels.own) - 1):
                top = whole.levels[-1]
                if top.owner is None:
                    top.owner = multigrid.aggregates(top.n, top.rows, top.cols, top.vals)
                whole.levels.append(multigrid.coarsened(top))
            last = whole.levels[-1]
            assert last.n == levels.own[-1].sizes[case]
            dense = np.zeros((last.n, last.n))
            np.add.at(dense, (last.rows, last.cols), last.vals)
            whole.direct = np.linalg.pinv(dense)
            assert np.allclose(z[z.case_id == case].sort_values("i").x, whole.cycle(r))


def test_large_cases_go_down_their_levels_in_step(spark, small, spans, monkeypatch):
    """No case is solved apart from the others, and none by a plan of joins."""
    monkeypatch.setattr(B.G, "solve_multigrid", None)
    monkeypatch.setattr(L, "COARSEST", 20)
    a, n, t = (f(spark, small, 7) for f in (D.entries, D.sizes, D.target))
    x, seen = B.solve(a, D.rhs(spark, small, 7), n, 1e-10, "multigrid_bicgstab")
    error = x.join(t.withColumnRenamed("x", "t"), ["case_id", "i"]).agg(F.count("*").alias("n"), F.max(F.abs(F.col("x") - F.col("t"))).alias("error")).first()
    assert error["n"] == 7 * D.size(spark, small) and error["error"] < 1e-7 and all(own.status == 0 for own in seen.values())
