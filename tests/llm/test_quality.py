import zlib

import numpy as np

from residua.llm import quality


def test_held_out_rows_are_told_apart(spark, small):
    docs, labels = (spark.read.parquet(f"{small.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs.select("doc_id", "text"), labels, keep=["doc_id"]).toPandas()
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    assert [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id] == got.held_out.tolist()
    both = got.merge(labels.toPandas(), on="doc_id")
    out = both[both.held_out]
    assert (out.predicted == out.quality).mean() >= 0.95


def test_fit_equals_numpy():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((400, 3)) * [1, 2, 3], rng.integers(0, 2, 400)
    x[y == 1] += 1
    model = quality.from_moments(np.bincount(y).astype(float), np.array([x[y == c].sum(0) for c in (0, 1)]), np.array([x[y == c].T @ x[y == c] for c in (0, 1)]), pooled=0.0, ridge=0.0)
    want = []
    for c in (0, 1):
        own = x[y == c]
        cov = np.cov(own.T, bias=True)
        d = x - own.mean(0)
        want.append(np.log(len(own) / 400) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d))
    got = model.difference(x)
    assert np.allclose(got - got.mean(), (want[1] - want[0]) - (want[1] - want[0]).mean())


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "word " * 50_000, "x")], "doc_id int, text string, score string")
    none = spark.createDataFrame([], "doc_id int, quality int")
    got = quality.classify(docs, none).collect()
    assert len(got) == 4 and {r["score"] for r in got} == {0.5} and quality.keep_good(docs, none).count() == 4
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, None), (None, 1)], "doc_id int, quality int")
    assert quality.classify(docs, labels).count() == 4 and quality.classify(docs.limit(0), labels).count() == 0
