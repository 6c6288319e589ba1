import hashlib
import io
import json
import tarfile
import zipfile

import numpy as np
import pytest

from residua.functions.digests import matrix_sha256, vector_sha256
from residua.sources import archive_source, archives, bundles, manifest, market_stream, matrix_market, replay, wire


def _tar(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


SYM = "%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 3\n1 1 2.0\n2 1 -1.5\n3 3 4\n"


def test_matrix_market_file(spark, tmp_path):
    (tmp_path / "a.mtx").write_text(SYM)
    entries, sizes = matrix_market.read_matrix_market(spark, str(tmp_path / "a.mtx"), "a")
    assert sorted(tuple(r)[1:] for r in entries.collect()) == [(0, 0, 2.0), (0, 1, -1.5), (1, 0, -1.5), (2, 2, 4.0)]
    assert tuple(sizes.first()) == ("a", 3, 3)


def test_size_line_after_many_comments(spark, tmp_path):
    # Splits of a few kilobytes, the first of them all comments; one entry reads like the size line.
    lines = ["%%MatrixMarket matrix coordinate real general", *["% a comment of some length to fill splits"] * 4_000, "3 3 3", "2 2 4.0", "3 3 3", "1 2 5"]
    (tmp_path / "a.mtx").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        entries, sizes = matrix_market.read_matrix_market(spark, str(tmp_path / "a.mtx"), "a")
        assert sorted(tuple(r)[1:] for r in entries.collect()) == [(0, 1, 5.0), (1, 1, 4.0), (2, 2, 3.0)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tuple(sizes.first()) == ("a", 3, 3)


@pytest.mark.parametrize("body", ["3 3 9\n1 1 1\n", "3 3 1\n7 1 1\n", "3 3 1\n1 1 x\n", "3 3 1\n1 1 nan\n", "3 3 1\n1 1\n", "3 4 1\n1 1 1\n"])
def test_wrong_entries_are_refused(spark, tmp_path, body):
    text = "%%MatrixMarket matrix coordinate real general\n" + body
    (tmp_path / "a.mtx").write_text(text)
    with pytest.raises(ValueError):
        matrix_market.read_matrix_market(spark, str(tmp_path / "a.mtx"), "a")
    with pytest.raises(ValueError):
        list(market_stream.Entries(io.BytesIO(text.encode())))


def test_matrix_market_archive(spark, tmp_path):
    (tmp_path / "m.tar.gz").write_bytes(_tar([("x/x.mtx", SYM.encode()), ("x/readme", b"hi")]))
    assert archive_source.read_archives(spark, str(tmp_path / "m.tar.gz")).count() == 4


@pytest.mark.parametrize("head", ["%%MatrixMarket matrix array real general", "%%MatrixMarket matrix coordinate complex general", "hello"])
def test_other_matrices_are_refused(head):
    with pytest.raises(ValueError, match="coordinate"):
        matrix_market.header_of(head)


def test_unsafe_archives():
    with pytest.raises(archives.UnsafeArchive):
        list(archives.safe_files(_tar([("../x", b"1")]), 100))
    with pytest.raises(archives.UnsafeArchive):
        list(archives.safe_files(_tar([("a", b"1"), ("a", b"1")]), 100))
    for bad in ("/x", "a/../x", "./x", "a//b", "a\\b", "c:x"):
        assert archives.faults([archives.Member(bad, 1, "file", bytes)], 10) == ["a member stands outside its folder"]
    assert archives.faults([archives.Member("a/..b/c.d", 1, "file", bytes), archives.Member("a/", 0, "folder", bytes)], 10) == []
    with pytest.raises(archives.UnsafeArchive):
        archives.read_files(_zip([("a", b"123")]), {"a": 2})
    with pytest.raises(archives.UnsafeArchive):
        archives.read_files(_zip([("b", b"1")]), {"a": 2})
    with pytest.raises(ValueError):
        archives.read_files(b"none", {"a": 2})


def _npy(a):
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


def _replay(change=None):
    offsets, cols, vals = np.array([0, 2, 3]), np.array([0, 1, 1]), np.array([2.0, 1.0, 3.0])
    b, x0 = np.array([1.0, 2.0]), np.zeros(2)
    matrix = _zip([("data.npy", _npy(vals)), ("indices.npy", _npy(cols)), ("indptr.npy", _npy(offsets)), ("format.npy", _npy(np.array(b"csr"))), ("shape.npy", _npy(np.array([2, 2])))])
    case = {"case_id": "c", "n": 2, "nnz": 3, "tolerance": 1e-6, "provenance_group": "g", "source_run": "r", "admission": {"step": 1, "solve_index": 2}, "source": {"matrix_sha256": matrix_sha256(2, offsets, cols, vals), "b_sha256": vector_sha256(b), "x0_sha256": vector_sha256(x0)}}
    files = {"matrix.npz": matrix, "b.npy": _npy(b), "x0.npy": _npy(x0)}
    meta = {"schema_version": 1, "case_id": "c", "family": "replay", "capture_kind": "k", "n": 2, "nnz": 3, "relative_tolerance": 1e-6, "absolute_tolerance": 0, "provenance_group": "g", "source_run": "r", "step": 1, "solve_index": 2, **case["source"], "files": {k: hashlib.sha256(v).hexdigest() for k, v in files.items()}} | (change or {})
    return [*files.items(), ("case.json", json.dumps(meta).encode())], case


@pytest.mark.parametrize("pack", [_zip, _tar])
def test_replay_archive(pack):
    files, case = _replay()
    got = replay.read_replay(pack(files), case, "replay", "k")
    assert got["vals"].tolist() == [2.0, 1.0, 3.0] and got["b"].tolist() == [1.0, 2.0]


def test_replay_archive_is_checked():
    files, case = _replay({"step": 9})
    with pytest.raises(ValueError, match="step"):
        replay.read_replay(_zip(files), case, "replay", "k")
    with pytest.raises(archives.UnsafeArchive):
        replay.read_replay(_zip(files[:3]), case, "replay", "k")


def test_npy_is_checked():
    with pytest.raises(ValueError):
        replay.read_npy(_npy(np.zeros(3)), (4,), "f")
    with pytest.raises(ValueError):
        replay.read_npy(_npy(np.zeros(3)) + b"x", (3,), "f")
    assert replay.read_npy(_npy(np.arange(3)), (3,), "iu").tolist() == [0, 1, 2]


def test_wire_formats():
    payload = wire.encode_input(2, np.array([0, 1, 2]), np.array([0, 1]), np.array([1.0, 2.0]), np.ones(2), np.zeros(2), 1e-6)
    assert len(payload) == 40 + 8 * 3 + 12 * 2 + 32
    assert wire.decode_input(payload)["vals"].tolist() == [1.0, 2.0]
    for broken in (payload[:-1], b"X" + payload[1:], payload[:40] + b"\1" + payload[41:]):
        with pytest.raises(ValueError):
            wire.decode_input(broken)
    out = wire.encode_output(np.array([1.0, 2.0]), 0, 1, 2, 3, False)
    assert wire.decode_output(out, 2)["solution"] == [1.0, 2.0] and wire.decode_output(out, 2)["elapsed_ns"] == 6
    assert "size" in wire.decode_output(out[:-8], 2)["error"]
    assert "header" in wire.decode_output(b"?" + out[1:], 2)["error"]
    assert "timing" in wire.decode_output(out[:56] + b"\2" + out[57:], 2)["error"]
    assert "timing" in wire.decode_output(wire.encode_output(np.ones(2), 0, 0, 0, 0, False), 2)["error"]


def test_manifest(spark, tmp_path):
    body = {"family": "mesh", "release_id": "r", "split": "dev", "cases": [{"index": 0, "case_id": "a", "n": 2, "nnz": 3, "tolerance": 1e-6, "source": {"url": "ftp://x", "archive_sha256": "0" * 64, "matrix_sha256": "x", "archive_bytes": 5}}]}
    (tmp_path / "m.json").write_text(json.dumps(body, indent=1))
    cases = manifest.cases_of(manifest.read_manifest(spark, str(tmp_path / "m.json")))
    assert cases.first()["role"] == "scored" and cases.first()["position"] == 0
    assert {r["rule"] for r in manifest.source_violations(cases).collect()} == {"matrix digest is malformed", "address is not https or file"}


def test_fetch(tmp_path):
    (tmp_path / "f").write_bytes(b"hello")
    digest = hashlib.sha256(b"hello").hexdigest()
    at = manifest.fetch(f"file://{tmp_path}/f", digest, 5, str(tmp_path / "cache"))
    assert at.read_bytes() == b"hello"
    (tmp_path / "f").unlink()
    assert manifest.fetch(f"file://{tmp_path}/f", digest, 5, str(tmp_path / "cache")) == at
    with pytest.raises(ValueError):
        manifest.fetch("ftp://x/y", "0" * 64, 5, str(tmp_path / "cache"))


def test_bundles(spark, tmp_path):
    cases = spark.createDataFrame([("a", 0, "d1"), ("b", 1, "d2")], "case_id string, idx int, input_sha256 string")
    inputs = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "case_id string, input binary")
    kept, hit = bundles.store_bundle(cases, inputs, str(tmp_path))
    assert not hit and kept.count() == 2
    assert bundles.store_bundle(cases, inputs, str(tmp_path))[1]


def _text(a, symmetry="general"):
    rows, cols = np.nonzero(a)
    if symmetry != "general":
        rows, cols = rows[rows >= cols], cols[rows >= cols]
    lines = [f"%%MatrixMarket matrix coordinate real {symmetry}", "% note", "", f"{len(a)} {len(a)} {len(rows)}", *(f"{i + 1} \t{j + 1}  {a[i, j]:.17g}" for i, j in zip(rows, cols, strict=True))]
    return "\n".join(lines).encode()


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_streamed_entries_equal_the_matrix(chunk):
    rng = np.random.default_rng(chunk)
    a = np.where(rng.random((30, 30)) < 0.2, rng.standard_normal((30, 30)), 0)
    for symmetry, whole in (("general", a), ("symmetric", a + a.T), ("skew-symmetric", np.tril(a, -1) - np.tril(a, -1).T)):
        entries = market_stream.Entries(io.BytesIO(_text(whole, symmetry) + b"\n% end\n\n"), chunk)
        found = np.zeros((30, 30))
        for rows, cols, vals in entries:
            assert len(rows) <= max(2, chunk)
            np.add.at(found, (rows, cols), vals)
        assert np.array_equal(found, whole) and entries.n == 30 and entries.symmetry == symmetry
    pattern = market_stream.Entries(io.BytesIO(b"%%MatrixMarket matrix coordinate pattern general\n2 2 2\n1 2\n2 1\n"), chunk)
    assert [x.tolist() for x in market_stream.whole(pattern)] == [[0, 1], [1, 0], [1.0, 1.0]]
    for body in (b"", b"2 2 1\n1.5 1 1\n", b"2 2 1\n1 1 1\n1 2 1\n", b"2 2 2\n1 1 1\n", b"2 2 1\n0 1 1\n", b"2 2 1\n1 1 1 1\n", b"2 2 1\n1 1 inf\n", b"2 2 1\n" + b"9" * 10_000):
        with pytest.raises(ValueError):
            list(market_stream.Entries(io.BytesIO(b"%%MatrixMarket matrix coordinate real general\n" + body), chunk))
    assert [len(x) for x in market_stream.whole(market_stream.Entries(io.BytesIO(b"%%MatrixMarket matrix coordinate real general\n5 5 0\n"), chunk))] == [0, 0, 0]


def test_streamed_archives_are_bounded_and_digested():
    a, b = np.eye(4), 2 * np.eye(3)
    data = _tar([("a/a.mtx", _text(a)), ("a/a_b.mtx", b"other"), ("readme", b"x"), ("b/b.mtx", _text(b))])
    sha = hashlib.sha256(data).hexdigest()
    read = lambda **k: {case: (m.n, market_stream.whole(m)[2].sum()) for case, m in market_stream.matrices(io.BytesIO(data), **k)}
    assert read(sha256=sha) == {"a": (4, 4.0), "b": (3, 6.0)} and read(wanted={"b"}, sha256=sha) == {"b": (3, 6.0)}
    with pytest.raises(archives.UnsafeArchive, match="another"):
        read(sha256="0" * 64)
    with pytest.raises(archives.UnsafeArchive):
        read(most_bytes=20)
    for bad in ([("../a/a.mtx", b"")], [("a/a.mtx", _text(a)), ("a/a.mtx", b"")]):
        with pytest.raises(archives.UnsafeArchive):
            [list(m) for _, m in market_stream.matrices(io.BytesIO(_tar(bad)))]
    with pytest.raises(ValueError):
        [list(m) for _, m in market_stream.matrices(io.BytesIO(data[: len(data) // 2]))]
    with pytest.raises(ValueError):
        list(market_stream.matrices(io.BytesIO(b"no archive")))


def test_memory_of_a_stream_is_bounded():
    import tracemalloc

    lines = 400_000
    text = b"%%MatrixMarket matrix coordinate real general\n1000 1000 400000\n" + b"123 456 0.125\n" * lines
    source = io.BytesIO(text)
    tracemalloc.start()
    count = sum(len(rows) for rows, _, _ in market_stream.Entries(source, 1 << 18))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == lines and peak < 8 << 20


def test_archive_source_plans_by_case(spark, tmp_path):
    made = {k: np.diag(np.arange(1.0, k + 2)) for k in range(5)}
    for k in (0, 1):
        (tmp_path / f"m{k}.tar.gz").write_bytes(_tar([(f"m{k}/m{k}.mtx", _text(made[k])), ("about", b"x")]))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "more.zip").write_bytes(_zip([(f"m{k}/m{k}.mtx", _text(made[k])) for k in (2, 3, 4)]))
    (tmp_path / "notes.txt").write_text("not an archive")
    archive_source.register(spark)
    frame = spark.read.format("matrix_archives").load(str(tmp_path))
    assert frame.rdd.getNumPartitions() == 5
    sums = {r["case_id"]: r["t"] for r in frame.groupBy("case_id").sum("val").withColumnRenamed("sum(val)", "t").collect()}
    assert sums == {f"m{k}": made[k].sum() for k in range(5)}
    one = frame.where("case_id = 'm3' and row > 0")
    assert one.rdd.getNumPartitions() == 3  # one member, and the two archives that may hold it
    assert one.count() == 3 and {r["archive"] for r in one.collect()} == {"more.zip"}
    assert frame.where("case_id in ('m0', 'm4')").count() == 6 and frame.where("case_id = 'm0' and case_id = 'm1'").count() == 0
    named = spark.read.format("matrix_archives").option("named", "true").load(str(tmp_path))
    assert named.where("case_id = 'm1'").rdd.getNumPartitions() == 1 and named.where("case_id = 'm1'").count() == 2
    heads = spark.read.format("matrix_archives").option("part", "heads").load(f"{tmp_path}/deep/more.zip")
    assert sorted((r["case_id"], r["n"], r["stated"]) for r in heads.collect()) == [(f"m{k}", k + 1, k + 1) for k in (2, 3, 4)]


def test_a_matrix_market_text_in_parts(spark, tmp_path):
    from residua.sources.matrix_market import read_matrix_market

    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "part-00000.txt").write_text("%%MatrixMarket matrix coordinate real general\n% a comment\n3 3 3\n1 1 2.5\n")
    (folder / "part-00001.txt").write_text("2 2 1.5\n3 3 3\n")
    entries, stated = read_matrix_market(spark, str(folder), "a")
    assert sorted(map(tuple, entries.collect())) == [("a", 0, 0, 2.5), ("a", 1, 1, 1.5), ("a", 2, 2, 3.0)]
    assert stated.first()["nnz"] == 3


def test_no_task_has_the_whole_matrix_market_text(spark, small):
    import os
    from urllib.parse import urlparse

    from residua.plans import catalogue

    found = catalogue.QUERIES["matrix_market_load"](spark, small)
    sizes = [os.path.getsize(urlparse(f).path) for f in found.inputFiles()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)


def test_inputs_in_pieces_are_those_of_whole_cases(spark, small, monkeypatch):
    from pyspark.sql import functions as F

    from residua.plans import catalogue
    from residua.plans import derive as D

    monkeypatch.setattr(wire, "SPAN", 37)
    a, n = D.entries(spark, small, 7).where("row < 37 or row >= 111"), D.sizes(spark, small, 7).withColumn("tolerance", F.lit(1e-6))
    vecs = D.rhs(spark, small, 7).select("case_id", "i", F.col("x").alias("b"), F.lit(0.5).alias("x0"))
    whole = {r["case_id"]: bytes(r["input"]) for r in wire.encode_inputs(a, vecs, n).collect()}
    pieces = wire.write_inputs(a, vecs, n)
    found = {}
    for r in sorted(pieces.collect(), key=lambda r: r["at"]):
        with open(r["path"], "rb") as file:
            found[r["case_id"]] = found.get(r["case_id"], b"") + file.read()
    assert found == whole and pieces.count() > 7 * 5 * 5
    read = {r["case_id"]: (r["n"], r["nnz"], r["sum_val"]) for r in wire.read_inputs(pieces).collect()}
    decoded = {case: wire.decode_input(data) for case, data in whole.items()}
    assert read == {case: (d["n"], len(d["vals"]), d["vals"].sum()) for case, d in decoded.items()}
    with pytest.raises(Exception, match="wrong size"):
        wire.read_inputs(pieces.where("not (case_id = '2' and at > 1000)")).collect()
    monkeypatch.setattr(wire, "encode_input", None)
    assert catalogue.QUERIES["wire_roundtrip"](spark, small).count() == 7
