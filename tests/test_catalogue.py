import pytest
from compare import duck, same

import __spark_entry__ as entry
from residua.plans import catalogue, oracles


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in oracles.ORACLE_SQL])
def test_query_equals_its_sql(spark, small, name):
    same(catalogue.QUERIES[name](spark, small), duck(small), oracles.ORACLE_SQL[name])


def test_every_oracle_has_a_query():
    assert set(oracles.ORACLE_SQL) <= set(catalogue.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 7


def test_ritz_values_lie_in_the_spectrum(spark, small):
    for r in catalogue.QUERIES["ritz_extremes"](spark, small).collect():
        assert r["least"] * (1 - 1e-6) <= r["low"] <= r["high"] <= r["greatest"] * (1 + 1e-6)


def test_digests_equal_those_of_whole_arrays(spark, small):
    import numpy as np

    from residua.functions import digests
    from residua.plans import derive

    found = {r["case_id"]: r["matrix_sha256"] for r in catalogue.QUERIES["matrix_digest"](spark, small).collect()}
    vectors = {r["case_id"]: r["vector_sha256"] for r in catalogue.QUERIES["vector_digest"](spark, small).collect()}
    a = derive.entries(spark, small, 7).where("case_id = '3'").toPandas().sort_values(["row", "col"])
    n = derive.sizes(spark, small).first()["n"]
    offsets = np.searchsorted(a.row.values, np.arange(n + 1))
    assert found["3"] == digests.matrix_sha256(n, offsets, a.col.values, a.val.values)
    b = derive.rhs(spark, small, 7).where("case_id = '3'").toPandas().sort_values("i")
    assert vectors["3"] == digests.vector_sha256(b.x.values)


def test_signs_equal_hmac(spark):
    import hmac

    import numpy as np

    from residua.functions.rademacher import signs

    key, prefix, n = b"k" * 70, b'{"a":1}\0', 700
    raw = b"".join(hmac.digest(key, prefix + k.to_bytes(8, "little"), "sha256") for k in range(3))
    want = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[:n] * 2.0 - 1
    found = signs(spark.createDataFrame([("c", n)], "case_id string, n bigint"), key, prefix).orderBy("i").toPandas()
    assert found.x.tolist() == want.tolist()


def test_metrics_plan_reads_few_columns(spark, small):
    plan = catalogue.QUERIES["spmv"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_kept_systems_are_derived_anew_when_their_files_are_gone(spark, small):
    import shutil

    from residua.plans import derive

    first = derive.entries(spark, small)
    assert derive.entries(spark, small) is first
    shutil.rmtree(first.inputFiles()[0].removeprefix("file:").replace("//", "/").rpartition("/")[0])
    again = derive.entries(spark, small)
    assert again is not first and again.count() > 0
    derive.forget()
    assert derive.entries(spark, small) is not again
