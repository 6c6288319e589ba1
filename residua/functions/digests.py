"""Digests of matrices, vectors and inputs, over packed little-endian arrays.

The tags at the head of a digest name a format; callers that need the digests
of another program pass that program's tags.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MATRIX_TAG, VECTOR_TAG = b"residua-csr-float64\0", b"residua-vector-float64\0"


def canonical_json(value: object) -> bytes:
    """Sorted keys, no spaces, ASCII, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False).encode("ascii")


def json_sha256(value: object) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def vector_sha256(vector: np.ndarray, tag: bytes = VECTOR_TAG) -> str:
    own = np.ascontiguousarray(vector, "<f8")
    return hashlib.sha256(tag + len(own).to_bytes(8, "little") + own.tobytes()).hexdigest()


def matrix_sha256(n: int, offsets: np.ndarray, cols: np.ndarray, vals: np.ndarray, tag: bytes = MATRIX_TAG) -> str:
    parts = (tag, n.to_bytes(8, "little"), np.ascontiguousarray(offsets, "<u8").tobytes(), np.ascontiguousarray(cols, "<u4").tobytes(), np.ascontiguousarray(vals, "<f8").tobytes())
    return hashlib.sha256(b"".join(parts)).hexdigest()


# The keys of an identity and its two kinds of reference.
def input_sha256(case_id: str, tolerance: float, digests: dict[str, str], target_sha256: str | None) -> str:
    """The identity of a case from digests already at hand."""
    kind = "none" if target_sha256 is None else "manufactured"
    return json_sha256(digests | {"case_id": case_id, "tolerance": tolerance, "reference_kind": kind, "reference_sha256": target_sha256})


def matrix_digests(entries: DataFrame, sizes: DataFrame, tag: bytes = MATRIX_TAG) -> DataFrame:
    """sha256 of each case's matrix: (case_id, matrix_sha256).

    ``entries`` must be canonical.  A case's entries are streamed in order
    through one digest; offsets come first, so a case's row counts are read
    before its entries: both are sorted into one partition of the case.
    """

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        n = right["n"][0].as_py() if right.num_rows else 0
        rows, cols, vals = (np.array(left[c]) for c in ("row", "col", "val"))
        order = np.lexsort((cols, rows))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows.astype(np.int64), minlength=n))]) if len(rows) else np.zeros(n + 1)
        return pa.table({"case_id": [key[0].as_py()], "matrix_sha256": [matrix_sha256(n, offsets, cols[order], vals[order], tag)]})

    return entries.groupBy("case_id").cogroup(sizes.groupBy("case_id")).applyInArrow(run, "case_id string, matrix_sha256 string")


def vector_digests(vectors: DataFrame, tag: bytes = VECTOR_TAG) -> DataFrame:
    """sha256 of each case's vector: (case_id, vector_sha256)."""

    def run(key, own):
        own = own.sort_by("i")
        return pa.table({"case_id": [key[0].as_py()], "vector_sha256": [vector_sha256(np.array(own["x"]), tag)]})

    return vectors.groupBy("case_id").applyInArrow(run, "case_id string, vector_sha256 string")


