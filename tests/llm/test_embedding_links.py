import numpy as np
import pytest
from compare import duck, same

from residua.llm import embedding_links as L
from residua.llm.queries import op11_embedding_links


def _table(spark, vectors, kind="float"):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "x", 1) for i, v in vectors]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, mark string, n_links int")


def _brute(ids, x, similarity=0.9):
    """n_links and component of each row, by all cosines."""
    u = L.unit(x)
    linked = u @ u.T >= similarity
    np.fill_diagonal(linked, False)
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = top(i), top(j)
        root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return sorted((int(ids[i]), int(linked[i].sum()), int(least[top(i)]), bool(ids[i] == least[top(i)])) for i in range(len(ids)))


def _rows(frame):
    return sorted(tuple(r) for r in frame.select("vec_id", "n_links", "component_id", "kept").collect())


def _clusters(rng, dims=24):
    """Spread vectors, groups of near ones around the threshold, chains, and copies."""
    parts = [rng.standard_normal((300, dims))]
    for noise in (0.05, 0.2, 0.3, 0.35, 0.45):
        middle = rng.standard_normal(dims)
        middle /= np.linalg.norm(middle)
        near = rng.standard_normal((60, dims))
        parts.append(middle + noise * near / np.linalg.norm(near, axis=1, keepdims=True))
    angle = np.arange(40) * 0.4
    parts.append(np.column_stack([np.cos(angle / 3), np.sin(angle / 3), 0.02 * rng.standard_normal((40, dims - 2))]))
    parts.append(np.repeat(parts[0][:5], 8, axis=0))
    parts.append(7 * parts[0][:3])
    x = np.vstack(parts).astype(np.float32)
    return rng.permutation(len(x)) + 10, x


@pytest.mark.parametrize("piece", [4_096, 16])
def test_equals_all_cosines(spark, monkeypatch, piece):
    monkeypatch.setattr(L, "PIECE", piece)
    monkeypatch.setattr(L, "STRIP", 7)
    ids, x = _clusters(np.random.default_rng(piece))
    found = _rows(L.near_vectors(_table(spark, list(zip(ids.tolist(), x, strict=True)))))
    assert found == _brute(ids, x)
    assert sum(r[1] for r in found) > 1_000


def test_a_third_in_one_list(spark, monkeypatch):
    monkeypatch.setattr(L, "PIECE", 32)
    rng = np.random.default_rng(5)
    x = np.vstack([rng.standard_normal((120, 8)), np.eye(8)[0] + 0.05 * rng.standard_normal((100, 8)), np.tile(np.eye(8)[1], (80, 1))]).astype(np.float32)
    ids = np.arange(len(x))[::-1]
    assert _rows(L.near_vectors(_table(spark, list(zip(ids.tolist(), x, strict=True))))) == _brute(ids, x)


def test_query_on_the_tables_equals_its_sql(spark, small):
    same(op11_embedding_links(spark, small), duck(small), L.ORACLE_SQL)


def test_unusable_vectors_lengths_repeats_and_null_keys(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (1, [2, 0]), (1, [2, 0]), (2, None), (3, [0, 0]), (4, [None, 1]), (5, [nan, 1]), (6, [inf, 1]), (7, []), (8, [1, 0, 0]), (9, [3, 0, 0.1]), (None, [1, 0]), (10, [0, 1]), (10, [1, 0.1])]
    found = L.near_vectors(_table(spark, rows))
    assert found.columns == ["vec_id", "embedding", "mark", "n_links", "component_id", "kept"]
    got = sorted((repr(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in found.collect())
    alone = [(repr(i), 0, i, True) for i in (2, 3, 4, 5, 6, 7)]
    assert got == sorted([*alone, ("0", 3, 0, True), ("1", 3, 0, False), ("1", 3, 0, False), ("8", 1, 8, True), ("9", 1, 8, False), ("None", 0, None, True), ("10", 0, 10, True), ("10", 3, 0, False)])


def test_large_and_small_doubles_ties_and_empty(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [-1e300, 1e300]), (3, [3.0, 4.0]), (4, [0.0, 5e-324])]
    t = _table(spark, rows, "double")
    assert [r[1:3] for r in _rows(L.near_vectors(t))] == [(2, 0), (2, 0), (0, 2), (2, 0), (0, 4)]
    assert L.near_vectors(t.limit(0)).count() == 0
    # Cosines of exactly the threshold are links.
    at = _table(spark, [(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.8, 0.6])], "double")
    assert [r[1] for r in _rows(L.near_vectors(at, similarity=0.8))] == [1, 1, 2]


def test_codes_bound_distances_and_probes_reach_all():
    rng = np.random.default_rng(3)
    u = L.unit(rng.standard_normal((500, 16)))
    v = L.unit(u + 0.06 * rng.standard_normal(u.shape))
    quantiser = L.Quantiser.fit(u[:200], 12)
    own, radius, codes, error = quantiser.encode(u)
    radii = np.array([radius[own == c].max(initial=-1) for c in range(12)])
    of_v = quantiser.encode(v)[0]
    reach = 0.447
    probes = quantiser.probes(v, of_v, radii, reach)
    for i in range(500):
        exact = np.linalg.norm(u - v[i], axis=1)
        for c in range(12):
            members = np.flatnonzero(own == c)
            squares = (quantiser.coded(own[members], codes[members]) ** 2).sum(axis=1)
            coded = quantiser.distances(v[i : i + 1], quantiser.tables(v[i : i + 1]), c, codes[members], squares)[:, 0]
            assert (np.abs(np.sqrt(np.maximum(coded, 0)) - exact[members]) <= error[members] + 1e-3).all()
            assert (coded <= (exact[members] + error[members]) ** 2 + L.ROUNDING).all()
            assert c < of_v[i] or probes[i, c] or not (exact[members] <= reach).any()


def test_components_of_a_chain():
    n = 50
    linked = np.eye(n, dtype=bool) | np.eye(n, k=1, dtype=bool)
    rows, cols = L.components(linked, np.arange(n) + 100, np.arange(n))
    assert (rows == 0).all() and (cols == 0).all()


def test_smaller_margin_keeps_most_links(spark):
    rng = np.random.default_rng(8)
    x = L.unit(rng.standard_normal((1_500, 32)))
    aside = rng.standard_normal(x.shape)
    aside = L.unit(aside - (aside * x).sum(axis=1)[:, None] * x)
    x = np.vstack([x, 0.901 * x + np.sqrt(1 - 0.901**2) * aside]).astype(np.float32)
    t = _table(spark, list(enumerate(x)))
    most = sum(r[1] for r in _brute(np.arange(len(x)), x))
    assert sum(r[1] for r in _rows(L.near_vectors(t))) == most
    assert 0.9 * most <= sum(r[1] for r in _rows(L.near_vectors(t, margin=0.45))) <= most
