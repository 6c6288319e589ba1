import hashlib
import io
import json
import tarfile
import zipfile

import numpy as np
import pytest

from residua import cli, evaluate
from residua.functions.digests import json_sha256, matrix_sha256, vector_sha256
from residua.operators import solve
from residua.sources import loading, results, submission, wire

KEY = b"a key of sixteen bytes or more"


def _system(seed, n=40):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random((n, n)) < 0.15, rng.integers(-4, 5, (n, n)), 0).astype(float)
    a += np.diag(np.abs(a).sum(axis=1) - np.diag(a) + 1)
    rows, cols = np.nonzero(a)
    return a, np.searchsorted(rows, np.arange(n + 1)), cols, a[rows, cols]


def _tar(name, data):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def _npy(a):
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


def _mesh_case(folder, k, **changes):
    a, offsets, cols, vals = _system(k)
    rows = np.repeat(np.arange(len(a)), np.diff(offsets))
    text = f"%%MatrixMarket matrix coordinate real general\n{len(a)} {len(a)} {len(vals)}\n" + "".join(f"{i + 1} {j + 1} {v}\n" for i, j, v in zip(rows, cols, vals, strict=True))
    data = _tar(f"m{k}/m{k}.mtx", text.encode())
    (folder / f"m{k}").write_bytes(data)
    return {"index": k, "case_id": f"c{k}", "n": len(a), "nnz": len(vals), "tolerance": 1e-10, "source": {"name": f"m{k}", "url": f"file://{folder}/m{k}", "archive_sha256": hashlib.sha256(data).hexdigest(), "archive_bytes": len(data), "matrix_sha256": matrix_sha256(len(a), offsets, cols, vals)}} | changes


def _sealed(body):
    return body | {"manifest_sha256": json_sha256(body)}


def _mesh(folder, cases):
    return _sealed({"family": "mesh", "release_id": "r1", "split": "dev", "contracts": {"scoring": "cases-solved"}, "rhs": {"scheme": "rademacher-hmac-sha256-v2", "public_key_hex": KEY.hex(), "key_id": hashlib.sha256(KEY).hexdigest(), "draw_index": 0}, "cases": cases})


def _replay_case(folder, k):
    a, offsets, cols, vals = _system(k)
    b = a @ np.ones(len(a))
    source = {"matrix_sha256": matrix_sha256(len(a), offsets, cols, vals), "b_sha256": vector_sha256(b), "x0_sha256": vector_sha256(0 * b)}
    case = {"index": k, "case_id": f"c{k}", "n": len(a), "nnz": len(vals), "tolerance": 1e-8, "provenance_group": "g", "source_run": "r", "admission": {"step": 1, "solve_index": k}}
    matrix = _zip({"data.npy": _npy(vals), "indices.npy": _npy(cols), "indptr.npy": _npy(offsets), "format.npy": _npy(np.array(b"csr")), "shape.npy": _npy(np.array(a.shape))})
    files = {"matrix.npz": matrix, "b.npy": _npy(b), "x0.npy": _npy(0 * b)}
    meta = {"schema_version": 1, "case_id": f"c{k}", "family": "replay", "capture_kind": "k", "n": len(a), "nnz": len(vals), "relative_tolerance": 1e-8, "absolute_tolerance": 0, "provenance_group": "g", "source_run": "r", "step": 1, "solve_index": k, **source, "files": {f: hashlib.sha256(d).hexdigest() for f, d in files.items()}}
    data = _zip(files | {"case.json": json.dumps(meta).encode()})
    (folder / f"r{k}").write_bytes(data)
    return case | {"source": source | {"url": f"file://{folder}/r{k}", "archive_sha256": hashlib.sha256(data).hexdigest(), "archive_bytes": len(data)}}


def test_mesh_cases_from_files(spark, tmp_path):
    manifest = _mesh(tmp_path, [_mesh_case(tmp_path, k) for k in range(3)])
    loaded, rules = loading.load(spark, manifest, str(tmp_path / "cache"))
    assert rules.count() == 0
    got = {r["case_id"]: r for r in loaded.cases.collect()}
    x = loaded.target.where("case_id = 'c1'").orderBy("i").toPandas().x.to_numpy()
    b = loaded.b.where("case_id = 'c1'").orderBy("i").toPandas().x.to_numpy()
    a = _system(1)[0]
    assert set(np.abs(x)) == {1.0} and np.array_equal(a @ x, b)
    body = {"case_id": "c1", "tolerance": 1e-10, "matrix_sha256": manifest["cases"][1]["source"]["matrix_sha256"], "b_sha256": vector_sha256(b), "x0_sha256": vector_sha256(np.zeros(len(b))), "reference_kind": "manufactured", "reference_sha256": vector_sha256(x)}
    assert got["c1"]["input_sha256"] == json_sha256(body)
    # The same cases qualified, one of them as another system.
    cases = [c | {"qualification": {"system_sha256": got[c["case_id"]]["input_sha256"] if k else "0" * 64}} for k, c in enumerate(manifest["cases"])]
    _, rules = loading.load(spark, _mesh(tmp_path, cases), str(tmp_path / "cache"))
    assert [tuple(r) for r in rules.collect()] == [("c0", "the system is not the qualified one")]


def test_what_is_wrong_with_cases(spark, tmp_path):
    cases = [_mesh_case(tmp_path, 0, nnz=7), _mesh_case(tmp_path, 1, n=41), _mesh_case(tmp_path, 2)]
    cases[2]["source"]["matrix_sha256"] = "1" * 64
    _, rules = loading.load(spark, _mesh(tmp_path, cases), str(tmp_path / "cache"))
    assert sorted(r["rule"] for r in rules.collect()) == ["fault: the matrix is not that of the manifest", "fault: the number of entries is not that of the manifest", "fault: the order is not that of the manifest"]
    with pytest.raises(ValueError, match="c0: fault"):
        loading.require(*loading.load(spark, _mesh(tmp_path, cases), str(tmp_path / "cache"), ["c0"]))
    for wanted in ([], ["c0", "c0"], ["c9"]):
        with pytest.raises(ValueError):
            loading.chosen_cases(_mesh(tmp_path, cases), wanted)
    with pytest.raises(ValueError):
        loading.authentic(_mesh(tmp_path, cases) | {"split": "other"})
    with pytest.raises(ValueError):
        loading.authentic(_mesh(tmp_path, cases), "0" * 64)


def test_recipe_faults():
    from residua.functions.rademacher import Recipe

    good = _mesh(None, [])
    assert Recipe.of(good, {"r1": "old"}).fields["release_id"] == "old"
    for change in ({"scheme": "x"}, {"public_key_hex": "zz"}, {"public_key_hex": "00"}, {"key_id": "0"}):
        with pytest.raises(ValueError):
            Recipe.of(good | {"rhs": good["rhs"] | change})


def test_evaluation_of_mesh_cases(spark, tmp_path):
    manifest, told = _mesh(tmp_path, [_mesh_case(tmp_path, k) for k in range(2)]), []
    report = evaluate.evaluate(spark, "multigrid_bicgstab", manifest, str(tmp_path / "cache"), progress=told.append)
    assert report["complete"] and report["all_passed"] and report["value"] == 2 and not report["official"] and told
    assert list(cli.lines_of(report)) == ["2 solved of 2 cases", "passed c0", "passed c1"]
    report = evaluate.evaluate(spark, "bicgstab", manifest, str(tmp_path / "cache"), ["c1"])
    assert report["value"] is None and list(cli.lines_of(report))[0] == "1 solved of 1 cases, a part of 2"


def test_evaluation_from_a_bundle(spark, tmp_path):
    manifest, kept = _mesh(tmp_path, [_mesh_case(tmp_path, k) for k in range(2)]), str(tmp_path / "bundles")

    def stats():
        report = evaluate.evaluate(spark, "multigrid_bicgstab", manifest, str(tmp_path / "cache"), bundle_cache=kept)
        assert report["value"] == 2 and report["all_passed"]
        return report["execution_stats"]

    first, second = stats(), stats()
    assert not first["bundle_cache_hit"] and second["bundle_cache_hit"]
    assert first["solve_rows"] == first["candidate_verification_rows"] == 2 and first["solve_bytes"] > 0 and second["bundle_bytes"] == first["bundle_bytes"] > 0
    # A member that was changed, one that is repeated, and one that is gone: written anew.
    folder = next((tmp_path / "bundles").iterdir())
    rows = [tuple(r) for r in spark.read.parquet(str(folder)).collect()]
    changed = [(rows[0][0], bytes(rows[0][1][:-1]) + b"\1"), rows[1]]
    for other in (changed, [*rows, rows[0]], rows[:1]):
        spark.createDataFrame(other, "case_id string, input binary").write.mode("overwrite").parquet(str(folder))
        assert not stats()["bundle_cache_hit"]
    assert stats()["bundle_cache_hit"]


def test_packed_inputs_that_cannot_be_read(spark):
    inputs = spark.createDataFrame([("a", b"short"), ("b", None)], "case_id string, input binary")
    rows = solve.solve_packed(inputs, {"candidate": solve.SOLVERS["cg"]}).collect()
    assert {r["case_id"] for r in rows} == {"a", "b"} and all(r["returncode"] == 1 and r["solution"] is None for r in rows)


HALF = "class S:\n    def setup(self, a, b, x0):\n        self.b = b\n    def solve(self):\n        from residua.solvers.krylov import Outcome\n        return Outcome(%s, 0, 1)\ndef make(tolerance):\n    return S()\n"


@pytest.mark.parametrize(("x", "failure"), [("self.b[:0]", "process failed"), ("self.b[:-1]", "process failed"), ("self.b * float('nan')", "solution is not finite"), ("self.b * 0", "normwise_backward_error exceeds 1e-10"), ("None", "process failed")])
def test_wrong_solutions_fail(spark, tmp_path, x, failure):
    (tmp_path / "s.py").write_text(HALF % x)
    report = evaluate.evaluate(spark, str(tmp_path / "s.py"), _mesh(tmp_path, [_mesh_case(tmp_path, k) for k in range(2)]), str(tmp_path / "cache"))
    assert [c["candidate"]["failure"] for c in report["cases"]] == [failure] * 2 and report["value"] == 0


def test_command_line_on_replay_cases(spark, tmp_path, capsys):
    body = {"family": "replay", "release_id": "r", "split": "dev", "contracts": {"scoring": "speedup"}, "cases": [_replay_case(tmp_path, k) for k in range(2)]}
    (tmp_path / "m.json").write_text(json.dumps(_sealed(body)))
    args = ["run", "gmres", "--manifest", str(tmp_path / "m.json"), "--cache", str(tmp_path / "cache"), "--capture-kind", "k", "--output", str(tmp_path / "out" / "r.json")]
    assert cli.main(args) == 0
    report, said = json.loads((tmp_path / "out" / "r.json").read_text()), capsys.readouterr()
    assert report["value"] > 0 and "times as fast as the reference\npassed c0 at " in said.out and "verifying the reference" in said.err
    assert cli.main([*args, "--case", "nothing"]) == 2 and cli.main([*args, "--pinned", "0" * 64]) == 2
    (tmp_path / "s.py").write_text(HALF % "self.b * 0")
    assert cli.main([args[0], str(tmp_path / "s.py"), *args[2:]]) == 1
    said = capsys.readouterr().out
    assert said.startswith("no score") and "failed c0: " in said


def test_submissions(tmp_path, capsys):
    (tmp_path / "s.py").write_text(HALF % "self.b")
    args = ["submit", str(tmp_path / "s.py"), "--name", "my-solver", "--family", "mesh", "--submitter", "Me", "--output", str(tmp_path / "sub")]
    assert cli.main(args) == 0 and cli.main(args) == 2
    assert submission.check(tmp_path / "sub")["families"] == ["mesh"] and cli.main(["check", str(tmp_path / "sub")]) == 0
    (tmp_path / "sub" / "solver.py").write_text("def make(t):\n    return 1\n")
    with pytest.raises(ValueError, match="source_sha256 does not hold"):
        submission.check(tmp_path / "sub")
    (tmp_path / "sub" / "more").write_text("")
    with pytest.raises(ValueError, match="more does not belong there"):
        submission.check(tmp_path / "sub")
    good = submission.documents(submission.Offer("my-solver", " Me ", ("replay", "mesh", "mesh"), b"def make(t):\n    return 1\n"))
    assert submission.faults(good) == [] and submission.description(good)["families"] == ["mesh", "replay"]
    stated = submission.description(good)
    for name, values in {"name": ["A", "", None, 3], "submitter": ["  ", None], "families": [[], ["x"], ["mesh", "mesh"], "mesh", None], "schema_version": [1, "2"], "source": ["solver.c"], "candidate_abi": [None], "source_sha256": ["0" * 64]}.items():
        for value in values:
            assert submission.faults(good | {"submission.json": json.dumps(stated | {name: value}).encode()}) == [f"submission.json: {name} does not hold"]
    assert submission.faults({}) and submission.faults(good | {"README.md": b" \n"}) == ["README.md is empty"]
    assert submission.faults(good | {"submission.json": json.dumps(stated | {"more": 1}).encode()}) == ["submission.json: more is unknown"]
    with pytest.raises(ValueError, match="families"):
        submission.package(tmp_path / "s.py", tmp_path / "sub2", "my-solver", ["other"], "Me")
    for data in (b"\xff", b"x = 1\n", b"def make(t): return 1\r\n", b"def make(\n"):
        assert submission.source_faults(data)


def test_results_archive(spark):
    cases, roles = [("a", 2), ("b", 1)], ["reference", "candidate"]
    out = wire.encode_output(np.array([1.0, 2.0]), 0, 1, 2, 3, False)
    rows = [("a", "reference", 0, 1.0, "ok", bytearray(out)), ("a", "candidate", 1, 0.5, "bad", None), ("b", "reference", 0, 1.0, "", bytearray(out[:-8])), ("b", "candidate", 0, 1.0, "", bytearray(b"x"))]
    frame = spark.createDataFrame(rows, "case_id string, role string, returncode int, wall_seconds double, diagnostics string, output binary")
    payload = results.write_results(frame, cases, roles)
    assert sorted(map(tuple, results.read_results(spark, payload, cases, roles).collect())) == sorted(rows)
    for wrong in (cases[:1], [("a", 2), ("b", 1), ("c", 1)]):
        with pytest.raises(ValueError):
            results.read_results(spark, payload, wrong, roles)
    with pytest.raises(ValueError):
        results.read_results(spark, payload, cases, roles[:1])


@pytest.mark.parametrize("name", list(solve.SOLVERS))
def test_solvers_on_a_grid(name):
    m = 20
    i = np.arange(m * m)
    near = [(i % m < m - 1, 1), (i % m > 0, -1), (i < m * m - m, m), (i >= m, -m)]
    rows, cols = np.concatenate([i, *[i[k] for k, _ in near]]), np.concatenate([i, *[i[k] + d for k, d in near]])
    vals = np.concatenate([np.full(m * m, 4.01), *[np.full(k.sum(), -1.0) for k, _ in near]])
    order = np.lexsort((cols, rows))
    a = solve.Csr(m * m, rows[order], cols[order], vals[order])
    b = a @ np.cos(i * 1.0)
    solver = solve.SOLVERS[name](1e-9)
    solver.setup(a, b, np.zeros(m * m))
    found = solver.solve()
    assert found.status == 0 and np.allclose(found.x, np.cos(i * 1.0), atol=1e-6)
    if "multigrid" in name:
        assert found.iterations < 30


def test_every_run_pays_for_its_set_up(monkeypatch):
    made = []
    monkeypatch.setitem(solve.PRECONDITIONERS, "counted", lambda a: made.append(a.n) or (lambda r: r))
    dense, _, _, _ = _system(3)
    rows, cols = np.nonzero(dense)
    a, b = solve.Csr(len(dense), rows, cols, dense[rows, cols]), dense @ np.ones(len(dense))
    maker = lambda tol: solve.Krylov("gmres", tol, preconditioner="counted", restart=40)
    for role in ("candidate", "reference", "candidate"):
        assert solve.executed("c", role, maker, a, b, 0 * b, 1e-9)["status"] == 0
    assert len(made) == 3
    # One solver uses again what it has for the same matrix, and nothing else.
    solver = maker(1e-9)
    for vals in (a.vals, a.vals.copy(), 2 * a.vals):
        solver.setup(solve.Csr(a.n, rows, cols, vals), b, 0 * b)
    assert len(made) == 5


def test_roles_of_a_case_run_in_one_task_on_their_own_copies(spark):
    class Spoiler:
        """Changes what it gets, and then gives the right answer."""

        def __init__(self, tolerance):
            self.inner = solve.SOLVERS["gmres"](tolerance)

        def setup(self, matrix, b, x0):
            self.inner.setup(solve.Csr(matrix.n, matrix.rows, matrix.cols, matrix.vals.copy()), b.copy(), x0)
            matrix.vals[:] = 0
            b[:] = 0

        def solve(self):
            return self.inner.solve()

    rows, vectors, names = [], [], [f"case {k}" for k in range(6)]
    for k, name in enumerate(names):
        a = _system(k, 12)[0]
        rows += [(name, int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
        vectors += [(name, i, float(v), 0.0) for i, v in enumerate(a @ np.ones(12))]
    entries = spark.createDataFrame(rows, "case_id string, row bigint, col bigint, val double")
    given = spark.createDataFrame(vectors, "case_id string, i bigint, b double, x0 double")
    cases = spark.createDataFrame([(n, 12, 1e-9) for n in [*names, "none"]], "case_id string, n bigint, tolerance double")
    found = solve.solve_groups(entries, given, cases, {"candidate": Spoiler, "reference": solve.SOLVERS["gmres"]}).collect()
    assert len(found) == 12 and all(r["returncode"] == 0 and np.allclose(r["solution"], 1, atol=1e-6) for r in found)
    assert {r["role"]: r["mutated"] for r in found} == {"candidate": True, "reference": False}
    first = {r["case_id"]: r["role"] for r in reversed(found)}
    assert set(first.values()) == {"candidate", "reference"}
    lost = solve.solve_groups(entries, given.where("case_id <> 'case 1'"), cases, "gmres").where("case_id = 'case 1'").collect()
    assert [(r["returncode"], r["diagnostics"]) for r in lost] == [(1, "no vectors")]
