"""The binary formats by which cases reach a solver process and results return."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators.storage import scratch_dir
from residua.schema import DECODED
from residua.sources.archive_source import opened

# The two formats.
INPUT_MAGIC, OUTPUT_MAGIC, VERSION = b"LSBIN001", b"LSBOUT01", 1
#: Rows of a case in one piece of its input.
SPAN = 1 << 16
INPUT_HEADER, OUTPUT_HEADER = struct.Struct("<8sIIQQd"), struct.Struct("<8sIiQQQQQB7x")


def encode_input(n: int, offsets: np.ndarray, cols: np.ndarray, vals: np.ndarray, b: np.ndarray, x0: np.ndarray, tolerance: float) -> bytes:
    arrays = ((offsets, "<u8"), (cols, "<u4"), (vals, "<f8"), (b, "<f8"), (x0, "<f8"))
    return _head(n, len(vals), tolerance) + b"".join(np.ascontiguousarray(a, t).tobytes() for a, t in arrays)


def _head(n: int, nnz: int, tolerance: float) -> bytes:
    return INPUT_HEADER.pack(INPUT_MAGIC, VERSION, 0, n, nnz, tolerance)


def _headed(payload: bytes) -> tuple[int, int, float]:
    """The sizes and the tolerance of an input, checked."""
    if len(payload) < INPUT_HEADER.size:
        raise ValueError("the input has no header")
    magic, version, reserved, n, nnz, tolerance = INPUT_HEADER.unpack_from(payload)
    if magic != INPUT_MAGIC or version != VERSION or reserved:
        raise ValueError("the header of the input is wrong")
    if not 0 < n < 2**31 or nnz >= 2**31 or not 0 < tolerance < 1:
        raise ValueError("the sizes or the tolerance are out of range")
    return n, nnz, tolerance


def decode_input(payload: bytes) -> dict:
    """The arrays of an input, whose lengths and rules are checked."""
    n, nnz, tolerance = _headed(payload)
    if len(payload) != INPUT_HEADER.size + 8 * (n + 1) + 12 * nnz + 16 * n:
        raise ValueError("the input has the wrong size")
    at, out = INPUT_HEADER.size, {"n": n, "tolerance": tolerance}
    for name, kind, count in (("offsets", "<u8", n + 1), ("cols", "<u4", nnz), ("vals", "<f8", nnz), ("b", "<f8", n), ("x0", "<f8", n)):
        out[name] = np.frombuffer(payload, kind, count, at)
        at += out[name].nbytes
    offsets = out["offsets"].astype(np.int64)
    if offsets[0] or offsets[-1] != nnz or (np.diff(offsets) < 0).any() or (out["cols"] >= n).any():
        raise ValueError("the rows or columns of the input are wrong")
    if not all(np.isfinite(out[k]).all() for k in ("vals", "b", "x0")):
        raise ValueError("the input holds numbers that are not finite")
    return out


def encode_output(x: np.ndarray, status: int, create_ns: int, setup_ns: int, solve_ns: int, mutated: bool) -> bytes:
    total = create_ns + setup_ns + solve_ns
    return OUTPUT_HEADER.pack(OUTPUT_MAGIC, VERSION, status, len(x), total, create_ns, setup_ns, solve_ns, mutated) + np.ascontiguousarray(x, "<f8").tobytes()


def decode_output(payload: bytes, n: int) -> dict:
    """The fields of an output, or ``error``."""
    if len(payload) != OUTPUT_HEADER.size + 8 * n:
        return {"error": "driver output has the wrong size"}
    magic, version, status, size, elapsed, create, setup, solve, mutated = OUTPUT_HEADER.unpack_from(payload)
    if magic != OUTPUT_MAGIC or version != VERSION or size != n:
        return {"error": "driver output header is invalid"}
    if mutated > 1 or not elapsed or create + setup + solve != elapsed or elapsed >= 2**63:
        return {"error": "driver timing or mutation fields are invalid"}
    return {"status": status, "elapsed_ns": elapsed, "create_ns": create, "setup_ns": setup, "solve_ns": solve, "mutated": bool(mutated), "solution": np.frombuffer(payload, "<f8", n, OUTPUT_HEADER.size).tolist()}


def decode_outputs(executions: DataFrame, sizes: DataFrame) -> DataFrame:
    """``executions`` with the fields of ``DECODED`` in the place of output; rows
    without output have has_output false and no fields."""
    joined = executions.join(sizes.select("case_id", "n"), "case_id")
    kept = [c for c in joined.columns if c not in ("output", "n")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*kept).schema], "has_output boolean", DECODED])
    fields = pa.schema([("status", pa.int32()), ("elapsed_ns", pa.int64()), ("create_ns", pa.int64()), ("setup_ns", pa.int64()), ("solve_ns", pa.int64()), ("mutated", pa.bool_()), ("solution", pa.list_(pa.float64())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, ns = batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist()
            found = [decode_output(o, n) if o is not None else {} for o, n in zip(outputs, ns, strict=True)]
            columns = [pa.array([f.get(name) for f in found], kind) for name, kind in zip(fields.names, fields.types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([o is not None for o in outputs]), *columns], names=[*kept, "has_output", *fields.names])

    return joined.select(*kept, "output", "n").mapInArrow(run, schema)


def encode_inputs(entries: DataFrame, vectors: DataFrame, cases: DataFrame) -> DataFrame:
    """Each case as the bytes that a solver process reads: (case_id, input)."""
    wide = vectors.join(cases.select("case_id", "n", "tolerance"), "case_id").withColumnRenamed("case_id", "case")

    def run(key, own: pa.Table, vecs: pa.Table) -> pa.Table:
        n = vecs["n"][0].as_py()
        vecs = vecs.sort_by("i")
        rows, cols, vals = (np.array(own[c]) for c in ("row", "col", "val"))
        order = np.lexsort((cols, rows))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows.astype(np.int64), minlength=n))])
        payload = encode_input(n, offsets, cols[order], vals[order], np.array(vecs["b"]), np.array(vecs["x0"]), vecs["tolerance"][0].as_py())
        return pa.table({"case_id": [key[0].as_py()], "input": pa.array([payload], pa.binary())})

    return entries.groupBy("case_id").cogroup(wide.groupBy("case")).applyInArrow(run, "case_id string, input binary")


def _sections(n: int, nnz: int) -> dict[str, tuple[str, int, int]]:
    """The arrays of an input: their type, and where they begin and end."""
    at, out = INPUT_HEADER.size, {}
    for name, kind, count in (("offsets", "<u8", n + 1), ("cols", "<u4", nnz), ("vals", "<f8", nnz), ("b", "<f8", n), ("x0", "<f8", n)):
        out[name] = (kind, at, at + count * int(kind[2]))
        at = out[name][2]
    return out


def write_inputs(entries: DataFrame, vectors: DataFrame, cases: DataFrame) -> DataFrame:
    """``encode_inputs`` in pieces: each is a file of the shared folder, named by its case
    and by the byte at which it begins, so that the pieces of a case, one after the
    other, are its input.  A task holds a block of rows, not a case: (case_id, path, at)."""
    spark, span = entries.sparkSession, SPAN
    folder = scratch_dir(spark, "wire")
    known = {r["case_id"]: (r["n"], r["tolerance"]) for r in cases.select("case_id", "n", "tolerance").collect()}
    nnz, before = dict.fromkeys(known, 0), {}
    block = lambda i: F.expr(f"int({i} div {span})")
    for r in entries.groupBy("case_id", block("row").alias("block")).count().orderBy("case_id", "block").collect():
        before[r["case_id"], r["block"]] = nnz[r["case_id"]]
        nnz[r["case_id"]] += r["count"]
    ahead = {case: sorted((k, n) for (c, k), n in before.items() if c == case) for case in known}

    def written(key, own, vecs):
        case, k = key[0].as_py(), key[1].as_py()
        (n, tolerance), sections = known[case], _sections(known[case][0], nnz[case])
        first, size = k * span, min(span, known[case][0] - k * span)
        start = before.get((case, k))
        if start is None:  # no entry in these rows: those of the rows before
            start = next((s for j, s in ahead[case] if j > k), nnz[case])
        rows, cols, vals = (own[c].to_numpy() for c in ("row", "col", "val"))
        order = np.lexsort((cols, rows))
        b, x0, places = np.zeros(size), np.zeros(size), vecs["i"].to_numpy() - first
        b[places], x0[places] = vecs["b"].to_numpy(), vecs["x0"].to_numpy()
        arrays = {"offsets": (first + 1, start + np.cumsum(np.bincount(rows - first, minlength=size))), "cols": (start, cols[order]), "vals": (start, vals[order]), "b": (first, b), "x0": (first, x0)}
        pieces = {sections[name][1] + at * int(sections[name][0][2]): np.ascontiguousarray(a, sections[name][0]).tobytes() for name, (at, a) in arrays.items() if len(a)}
        if k == 0:
            pieces[0] = _head(n, nnz[case], tolerance) + bytes(8)  # the first row begins at 0
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        names = []
        for at, data in pieces.items():
            names.append(f"{folder}/{case.encode().hex()}.{at}")
            with system.open_output_stream(opened(names[-1])[1], compression=None) as out:
                out.write(data)
        return pa.table({"case_id": pa.repeat(key[0], len(names)), "path": names, "at": pa.array(list(pieces), pa.int64())})

    left = entries.select(F.col("case_id"), block("row").alias("block"), "row", "col", "val").groupBy("case_id", "block")
    right = vectors.select(F.col("case_id").alias("case"), block("i").alias("piece"), "i", "b", "x0").groupBy("case", "piece")
    found = left.cogroup(right).applyInArrow(written, "case_id string, path string, at bigint").collect()
    return spark.createDataFrame([tuple(r) for r in found], "case_id string, path string, at bigint")


def read_inputs(pieces: DataFrame) -> DataFrame:
    """What ``write_inputs`` wrote, piece by piece: (case_id, n, nnz, sum_val, sum_b).  A
    case whose pieces break a rule of ``decode_input`` is an error."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = pieces.where("at = 0").select("case_id", F.col("path").alias("head"))
    schema = pa.schema([("case_id", pa.string()), ("n", pa.int64()), ("nnz", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("sum_val", pa.float64()), ("sum_b", pa.float64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def data(path: str) -> pa.Buffer:
            system, path = opened(path)
            with system.open_input_file(path) as file:
                return file.read_buffer()

        for batch in batches:
            for r in batch.to_pylist():
                if r["head"] is None:
                    raise ValueError("the input has no header")
                n, nnz, _ = _headed(data(r["head"]))
                piece, at = data(r["path"]), r["at"]
                row = {"case_id": r["case_id"], "n": n, "nnz": nnz, "at": at, "size": piece.size, "low": None, "high": None, "sum_val": 0.0, "sum_b": 0.0}
                for name, (kind, start, end) in _sections(n, nnz).items():
                    low, high = max(at, start), min(at + piece.size, end)
                    if low >= high:
                        continue
                    if (low - start) % int(kind[2]) or (high - low) % int(kind[2]):
                        raise ValueError("a piece of the input ends within a number")
                    own = np.frombuffer(piece, kind, (high - low) // int(kind[2]), low - at)
                    if name == "offsets":
                        row["low"], row["high"] = int(own[0]), int(own[-1])
                        if (np.diff(own.astype(np.int64)) < 0).any():
                            raise ValueError("the rows or columns of the input are wrong")
                    elif name == "cols" and (own >= n).any():
                        raise ValueError("the rows or columns of the input are wrong")
                    elif name != "cols" and not np.isfinite(own).all():
                        raise ValueError("the input holds numbers that are not finite")
                    if name in ("vals", "b"):
                        row["sum_val" if name == "vals" else "sum_b"] += float(own.sum())
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    def whole(key, own):
        own = own.sort_by("at")
        at, size, n, nnz = own["at"].to_numpy(), own["size"].to_numpy(), own["n"][0].as_py(), own["nnz"][0].as_py()
        if (at != np.append(0, np.cumsum(size)[:-1])).any() or size.sum() != _sections(n, nnz)["x0"][2]:
            raise ValueError("the input has the wrong size")
        bounds = [x for low, high in zip(own["low"].to_pylist(), own["high"].to_pylist(), strict=True) if low is not None for x in (low, high)]
        if bounds[0] or bounds[-1] != nnz or bounds != sorted(bounds):
            raise ValueError("the rows or columns of the input are wrong")
        return pa.table({"case_id": [key[0].as_py()], "n": [n], "nnz": [nnz], "sum_val": [float(np.sum(own["sum_val"].to_numpy()))], "sum_b": [float(np.sum(own["sum_b"].to_numpy()))]})

    seen = pieces.join(F.broadcast(heads), "case_id", "left").repartition(parts).select("case_id", "path", "at", "head").mapInArrow(read, "case_id string, n bigint, nnz bigint, at bigint, size bigint, low bigint, high bigint, sum_val double, sum_b double")
    return seen.groupBy("case_id").applyInArrow(whole, "case_id string, n long, nnz long, sum_val double, sum_b double")
