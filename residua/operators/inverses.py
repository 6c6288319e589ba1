"""Factored approximate inverses of systems in blocks of rows, held against their matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators import blocks as B
from residua.operators import cluster as G

#: Places whose rows meet the matrix at once, as far as rows are not longer.
PLACES = 1 << 18
_PRODUCTS = pa.schema([("case_id", pa.string()), ("row", pa.int64()), ("col", pa.int64()), ("val", pa.float64()), ("product", pa.float64()), ("diagonal", pa.float64())])


def fsai_products(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of ``cluster.fsai`` of symmetric positive definite systems, and the product
    with the matrix at their places: (case_id, row, col, val, product, diagonal), the
    last being that of the row.

    Blocks of rows of the lower triangle are files in the shared folder.  A task takes the
    rows of a block and looks up the pairs of their places in one block of the matrix
    after the other, so pairs are never written or shuffled.
    """
    own = B.Systems(entries.sparkSession, {r["case_id"]: r["n"] for r in sizes.select("case_id", "n").collect()})
    folder, ids, n, span = own.folder, own.ids, own.sizes, own.span
    held = entries.where("col <= row and val <> 0").select("case_id", F.expr(f"int(row div {span})").alias("down"), F.expr(f"row % {span}").alias("r"), "col", F.col("val").cast("double").alias("val"))

    def written(key, own):
        keys = own["r"].to_numpy() * n[key[0].as_py()] + own["col"].to_numpy()
        order = np.argsort(keys)
        B.Files(folder).write(f"lower/{ids[key[0].as_py()]}.{key[1].as_py()}", keys[order], own["val"].to_numpy()[order])
        return pa.table({"case_id": [key[0].as_py()], "down": [key[1].as_py()]}, schema=B._PLACE)

    there = {(r["case_id"], r["down"]) for r in held.groupBy("case_id", "down").applyInArrow(written, "case_id string, down int").collect()}

    def rows_of(case: str, block: int, lower, i: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        wide, begins, met = n[case], np.searchsorted(i, i), []
        for reach in np.unique(places // span).tolist():
            if (case, reach) not in there:
                raise ArithmeticError(f"block {reach} of {case} has no diagonal")
            known, vals = lower(case, reach)
            upper = np.flatnonzero(places // span == reach)
            counts = upper - begins[upper] + 1
            for some in np.split(np.arange(len(upper)), np.flatnonzero(np.diff(np.cumsum(counts) // G.PAIRS)) + 1):
                count = counts[some]
                before = np.cumsum(count) - count
                j = np.repeat(places[upper[some]], count)
                k = places[np.repeat(begins[upper[some]] - before, count) + np.arange(count.sum())]
                wanted = (j - reach * span) * wide + k
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                found = known[at] == wanted
                keep = np.flatnonzero(found | (j == k))
                met.append((np.repeat(i[upper[some]], count)[keep], j[keep], k[keep], np.where(found[keep], vals[at[keep]], 0.0)))
        of, j, k, val = map(np.concatenate, zip(*met, strict=True))
        order = np.argsort(of, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(of[order] // G.GROUP)) + 1):
            own_i = of[part] + block * span
            rows, cols, g = G.rows_solved(case, own_i, j[part], k[part], val[part])
            products = G._products((rows - rows[0]) * wide + cols, g, (own_i - rows[0]) * wide, j[part], k[part], val[part])
            yield pa.RecordBatch.from_arrays([pa.array([case]).take(pa.array(np.zeros(len(g), np.int64))), pa.array(rows), pa.array(cols), pa.array(g), pa.array(products), pa.array(g[np.searchsorted(rows, rows, "right") - 1])], schema=_PRODUCTS)

    def work(blocks: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
        files = B.Files(folder)

        def lower(case: str, block: int) -> tuple[np.ndarray, np.ndarray]:
            data = files.read(f"lower/{ids[case]}.{block}")
            return np.frombuffer(data, np.int64, data.size // 16), np.frombuffer(data, np.float64, data.size // 16, data.size // 2)

        for case, block, _ in blocks:
            if (case, block) not in there:
                continue
            wide, keys = n[case], lower(case, block)[0]
            cuts = np.searchsorted(keys, np.unique(np.append(keys[::PLACES] // wide, span)) * wide)
            for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield from rows_of(case, block, lower, keys[first:last] // wide, keys[first:last] % wide)

    return own.dealt(work, "case_id string, row bigint, col bigint, val double, product double, diagonal double", own.cases)
