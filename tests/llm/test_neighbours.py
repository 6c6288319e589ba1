import numpy as np
from pyspark.sql import functions as F

from residua.llm import neighbours as N


def _table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x") for i, v in vectors], "vec_id long, embedding array<float>, rank string")


def test_recall_against_brute_force(spark, small):
    sf = small.replace("0.001", "0.01")
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = N.search(t, F.col("vec_id") % 20 == 0).toPandas()
    e = t.toPandas()
    x, ids = np.stack(e.embedding.values).astype(float), e.vec_id.values
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = N.exact(x[i], x)
        keep = ids != ids[i]
        true = ids[keep][np.lexsort((ids[keep], -s[keep]))[:20]]
        own = got[got.query_id == ids[i]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and (np.diff(own.score) <= 0).all()
        assert all(s[ids == v][0] == z for v, z in zip(own.vec_id, own.score, strict=True))
        hit, total = hit + len(set(true) & set(own.vec_id)), total + 20
    assert hit / total >= 0.9


def test_blocks_do_not_change_small_results(spark, monkeypatch):
    rng = np.random.default_rng(0)
    t = _table(spark, list(enumerate(rng.standard_normal((30, 4)))))
    one = sorted(map(tuple, N.search(t, F.col("vec_id") % 5 == 0).collect()))
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "QUERIES", 2)
    assert one == sorted(map(tuple, N.search(t, F.col("vec_id") % 5 == 0).collect()))


def test_unusable_vectors_ties_and_copies(spark):
    same = [1.0, 0.0]
    rows = [(0, same), *[(i, same) for i in range(1, 40)], (40, None), (41, [0.0, 0.0]), (42, [None, 1.0]), (43, [float("nan"), 1.0]), (44, [float("inf"), 1.0]), (45, [1.0, 2.0, 3.0]), (60, [0.5, 0.5])]
    got = N.search(_table(spark, rows), F.col("vec_id").isin(0, 10, 40, 60)).collect()
    by = {q: [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 10, 40, 60)}
    assert by[0] == list(enumerate(range(1, 21), 1)) and [v for _, v in by[10]] == [*range(10), *range(11, 21)] and by[40] == []
    assert [v for _, v in by[60]] == list(range(20))


def test_few_or_none(spark):
    t = _table(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.0])])
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in N.search(t, F.col("vec_id") == 0).collect()] == [(0, 1, 0.5)]
    assert N.search(t.limit(0), F.lit(True)).count() == 0
    assert N.search(_table(spark, [(0, [1.0])]), F.lit(True)).count() == 0


def test_lengths_are_searched_apart(spark):
    t = _table(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [1.0, 1.0, 1.0]), (3, [2.0, 0.0, 0.0]), (4, [9.0])])
    got = N.search(t, F.lit(True)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 1, 0.5), (1, 1, 0, 0.5), (2, 1, 3, 2.0), (3, 1, 2, 2.0)]


def test_groups_and_full_buckets_do_not_change_results(spark, monkeypatch):
    rng = np.random.default_rng(1)
    # A third of the vectors lie in one bucket of every table.
    crowd = np.eye(8)[0] + 1e-6 * rng.standard_normal((200, 8))
    t = _table(spark, list(enumerate(np.vstack([rng.standard_normal((400, 8)), crowd]))))
    one = sorted(map(tuple, N.search(t, F.col("vec_id") % 50 == 0).collect()))
    monkeypatch.setattr(N, "BLOCK", 64)
    monkeypatch.setattr(N, "POSTINGS", 40)
    monkeypatch.setattr(N, "QUERIES", 3)
    assert one == sorted(map(tuple, N.search(t, F.col("vec_id") % 50 == 0).collect())) and len(one) == 12 * 20


def test_sequence_rises_and_crosses_no_cell_twice():
    sets = N.sequence(5, 40)
    assert not sets[0].any() and len({tuple(r) for r in sets}) == 40
    assert not (sets & sets[:, ::-1]).any()


def test_a_query_that_finds_too_few_visits_all(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 6))
    monkeypatch.setattr(N, "MOST_PROBES", 1)
    monkeypatch.setattr(N, "CELL", 0.05)
    got = N.search(_table(spark, list(enumerate(x))), F.col("vec_id") == 7).toPandas().sort_values("rank")
    s = x.astype(np.float32).astype(float) @ x.astype(np.float32).astype(float)[7]
    assert got.vec_id.tolist() == [i for i in np.argsort(-s) if i != 7][:20]


def test_candidates_of_no_query_leave_a_task(spark, monkeypatch):
    # However many candidates there are, a block gives ``top`` rows for a query, and nothing else is written.
    written, real = {}, N.materialize

    def counted(df, name, **options):
        found = real(df, name, **options)
        written[name] = found.count()
        return found

    monkeypatch.setattr(N, "materialize", counted)
    monkeypatch.setattr(N, "BLOCK", 500)
    rng = np.random.default_rng(3)
    t = _table(spark, list(enumerate(rng.standard_normal((2_000, 12)))))
    assert N.search(t, F.col("vec_id") % 20 == 0).count() == 100 * 20
    # Lists of candidates came by query, block and table.
    assert max(n for name, n in written.items() if name not in ("ann-rows", "ann-entries")) <= 100 * 21
