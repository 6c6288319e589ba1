"""Krylov methods for large systems over the cluster, several systems in step.

Vectors are files of ``SPAN`` components, one for each block of a case, in the folder that
driver and executors share, and so is the matrix, by blocks of rows.  A step is a job of
tasks that read the blocks they need and write those that they change: nothing
is shuffled, and what does not change is not written again.  A task holds the entries of
one block of rows, its vectors, and up to ``HELD`` blocks of the vector that the matrix is
applied to.  The driver holds a few inner products for each case.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator, MutableMapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators import cluster as G
from residua.operators import matrix as M
from residua.operators.storage import scratch, scratch_dir, stored
from residua.solvers import ilu, krylov, spectrum, switching
from residua.sources.archive_source import opened

SPAN = 1 << 16
#: Entries of a case up to which one task may hold it.
IN_TASK = 2_000_000
#: Blocks of a vector that a task holds at once.
HELD = 128
Scalars = dict[str, dict[str, float]]  # by case and name
#: Inner products of a block, by name.
Dots = dict[str, tuple[str, str]]


class Files:
    """Arrays under a folder that driver and executors share.  A file is there as a
    whole or not at all, and a task that runs again writes the same once more."""

    def __init__(self, folder: str):
        self.system, self.path = opened(folder)

    def write(self, name: str, *arrays: np.ndarray) -> None:
        path = f"{self.path}/{name}"
        part = f"{path}.{uuid.uuid4().hex}"
        self.system.create_dir(path.rpartition("/")[0], recursive=True)
        with self.system.open_output_stream(part, compression=None) as out:
            for array in arrays:
                out.write(np.ascontiguousarray(array).data)
        self.system.move(part, path)

    def read(self, name: str) -> pa.Buffer:
        with self.system.open_input_file(f"{self.path}/{name}") as file:
            return file.read_buffer()

    def vector(self, name: str) -> np.ndarray:
        return np.frombuffer(self.read(name), np.float64)

    def delete(self, name: str) -> None:
        self.system.delete_dir(f"{self.path}/{name}")


class Vectors(MutableMapping):
    """The vectors of a block by name, read when they are needed, and which have changed."""

    def __init__(self, read: Callable[[str], np.ndarray], names: set[str], size: int, first: int, case: str):
        self.read, self.names, self.size, self.first, self.case, self.factors = read, names, size, first, case, None
        self.held: dict[str, np.ndarray] = {}
        self.changed: set[str] = set()

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.held:
            self.held[name] = np.arange(self.first, self.first + self.size, dtype=float) if name == "i" else self.read(name)
        return self.held[name]

    def __setitem__(self, name: str, value: np.ndarray) -> None:
        self.held[name] = value
        self.changed.add(name)

    def __delitem__(self, name: str) -> None:
        raise TypeError("vectors are let go of by not being kept")

    def __iter__(self) -> Iterator[str]:
        return iter(self.names | set(self.held))

    def __len__(self) -> int:
        return len(self.names | set(self.held))


#: Changes the vectors of a block, given the scalars of its case.
Change = Callable[[Vectors, dict[str, float]], None]


def laid(block: np.ndarray, r: np.ndarray, c: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries sorted by block of columns as the arrays of ``rows_of``, their lengths first."""
    cells, counts = np.unique(block, return_counts=True)
    return np.array([len(cells), len(r)], np.int64), cells.astype(np.int64), np.cumsum(counts), r.astype(np.int32), c.astype(np.int32), val


def rows_of(files: Files, name: str) -> tuple[np.ndarray, ...]:
    """A block of rows as (blocks of columns, where each ends, rows, columns, values):
    sorted by block of columns, rows and columns counted from where their blocks begin."""
    data = files.read(name)
    cells, count = np.frombuffer(data, np.int64, 2)
    at, out = 16, []
    for kind, size in ((np.int64, cells), (np.int64, cells), (np.int32, count), (np.int32, count), (np.float64, count)):
        out.append(np.frombuffer(data, kind, size, at))
        at += out[-1].nbytes
    return tuple(out)


@dataclass
class Product:
    """What a matrix makes of a vector: its sums by row, or what ``kernel(v, rows, cols,
    vals, x)`` gives, where x is the vector at the columns.  The vector may be of other
    systems, whose blocks the columns then count."""

    source: str
    goal: str
    matrix: str = "matrix"
    of: Systems | None = None
    kernel: Callable[[Vectors, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None
    diagonal: bool = False


@dataclass
class Systems:
    """Matrices and vectors in blocks, of the cases that are not solved yet."""

    spark: object
    sizes: dict[str, int]
    cases: list[str] = field(default_factory=list)
    handed: set[str] = field(default_factory=set)  # cases that a stronger method is to go on with
    high: dict[str, float] | None = None  # bounds on the spectra, once a probe has run
    levels: list | None = None  # those of multigrid, once it is set up
    span: int = 0  # components of a block; SPAN if not told
    factors: Callable | None = None  # the solution by incomplete factors, once they are there

    def __post_init__(self):
        self.span, self.held = self.span or SPAN, HELD
        self.across: dict[str, int] = {}  # components of a block of columns, of matrices to other systems
        self.entries: dict[str, int] = {}  # of the matrix
        self.folder = scratch_dir(self.spark, "blocks")
        self.files = Files(self.folder)
        self.cases = self.cases or sorted(self.sizes)
        self.ids = {case: k for k, case in enumerate(sorted(self.sizes))}
        self.state: dict[str, dict[str, str]] = {case: {} for case in self.sizes}  # the folder of each vector
        self.there: dict[str, set[tuple[str, int]]] = {}  # what blocks of a matrix, or of a vector just read, have a file
        self.folders: set[str] = set()
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _new(self, name: str) -> str:
        return f"{name}-{uuid.uuid4().hex}"

    def load(self, entries: DataFrame, name: str = "matrix", merge: np.ufunc | None = None, diagonal: bool = False, square: bool = True, across: int | None = None) -> dict[str, int]:
        """Write entries in blocks of rows, and give how many each case has.  Those on the
        diagonal are left out, or become the vector d (``diagonal``); entries at
        one place become one by ``merge``.  A matrix that is not ``square`` has no diagonal."""
        span, folder, ids, sizes, at = self.span, self.folder, self.ids, self.sizes, self._new("d")
        across = self.across[name] = across or span
        own = (entries if diagonal or not square else entries.where("row <> col")).select("case_id", F.expr(f"int(row div {span})").alias("down"), F.expr(f"int(row % {span})").alias("r"), F.expr(f"int(col div {across})").alias("block"), F.expr(f"int(col % {across})").alias("c"), F.col("val").cast("double").alias("val"))

        def written(key, own):
            case, down, files = key[0].as_py(), key[1].as_py(), Files(folder)
            block, r, c, val = (own[name].to_numpy() for name in ("block", "r", "c", "val"))
            if diagonal:
                on = (block == down) & (r == c)
                files.write(f"{at}/{ids[case]}.{down}", np.bincount(r[on], val[on], min(span, sizes[case] - span * down)))
                block, r, c, val = block[~on], r[~on], c[~on], val[~on]
            keys = block.astype(np.int64) * span + r
            if merge is None:
                order = np.argsort(keys)
                block, r, c, val = block[order], r[order], c[order], val[order]
            elif len(r):
                order = np.lexsort((c, keys))
                new = np.flatnonzero(np.append(True, (np.diff(keys[order]) != 0) | (np.diff(c[order]) != 0)))
                block, r, c, val = block[order][new], r[order][new], c[order][new], merge.reduceat(val[order], new)
            files.write(f"{name}/{ids[case]}.{down}", *laid(block, r, c, val))
            return pa.table({"case_id": [case], "down": [down], "count": [len(r)]}, schema=_PLACE.append(pa.field("count", pa.int64())))

        found = own.groupBy("case_id", "down").applyInArrow(written, "case_id string, down int, count bigint").collect()
        self.there[name] = {(r["case_id"], r["down"]) for r in found}
        if diagonal:
            self.there[at] = self.there[name]
            self.folders.add(at)
            for case in self.sizes:
                self.state[case]["d"] = at
        counts = {case: sum(r["count"] for r in found if r["case_id"] == case) for case in self.sizes}
        if name == "matrix":
            self.entries = counts
        return counts

    def take(self, vectors: DataFrame, name: str) -> None:
        """Write ``vectors(case_id, i, x)``; components without a row are zero."""
        span, folder, ids, sizes, at = self.span, self.folder, self.ids, self.sizes, self._new(name)
        held = vectors.select("case_id", F.expr(f"int(i div {span})").alias("block"), F.expr(f"int(i % {span})").alias("at"), F.col("x").cast("double").alias("x"))

        def written(key, own):
            case, block = key[0].as_py(), key[1].as_py()
            x = np.zeros(min(span, sizes[case] - span * block))
            x[own["at"].to_numpy()] = own["x"].to_numpy()
            Files(folder).write(f"{at}/{ids[case]}.{block}", x)
            return pa.table({"case_id": [case], "down": [block]}, schema=_PLACE)

        found = held.groupBy("case_id", "block").applyInArrow(written, "case_id string, down int").collect()
        self.there[at] = {(r["case_id"], r["down"]) for r in found}
        self.folders.add(at)
        for case in self.sizes:
            self.state[case][name] = at

    def _blocks(self, cases: list[str]) -> list[tuple[str, int, int]]:
        return [(case, block, min(self.span, self.sizes[case] - self.span * block)) for case in cases for block in range(-(-self.sizes[case] // self.span))]

    def dealt(self, work: Callable[[list[tuple[str, int, int]]], Iterator[pa.RecordBatch]], schema: str, cases: list[str], whole: bool = False, blocks: list[tuple[str, int, int]] | None = None) -> DataFrame:
        """``work`` on the blocks of the cases, neighbours in one task, or all of a case."""
        blocks = blocks or self._blocks(cases)
        if whole:
            shares = [[b for b in blocks if b[0] == case] for case in cases]
        else:
            shares = [[blocks[k] for k in some] for some in np.array_split(np.arange(len(blocks)), min(self.parts, len(blocks)))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield from work(shares[k])

        return self.spark.range(0, len(shares), 1, len(shares)).mapInArrow(run, schema)

    def gather(self, matrix: str, source: str | None, of: Systems | None = None) -> Callable[[Files, str, int], tuple[np.ndarray, ...] | None]:
        """In a task, the (rows, columns, values) of a block of rows and the vector at the
        columns; None where the block has no entry.  Rows count from where the block
        begins, columns from the start."""
        most, ids, there = self.held, self.ids, self.there.get(matrix, set())
        other = of or self
        read, beside, sizes, across = other.reader(), other.folder, other.sizes, self.across.get(matrix, self.span)
        held: dict[int, np.ndarray] = {}
        last: list[str] = []

        def run(files: Files, case: str, block: int) -> tuple[np.ndarray, ...] | None:
            if (case, block) not in there:
                return None
            if last != [case]:
                held.clear()
                last[:] = [case]
            cells, ends, rows, cols, vals = rows_of(files, f"{matrix}/{ids[case]}.{block}")
            places = cols + np.repeat(cells * across, np.diff(ends, prepend=0))
            if source is None:
                return rows, places, vals, vals
            x, start, others = np.empty(len(vals)), 0, Files(beside)
            for cell, end in zip(cells.tolist(), ends.tolist(), strict=True):
                if cell not in held:
                    if len(held) >= most:
                        held.pop(next(iter(held)))
                    held[cell] = read(others, case, source, cell, min(across, sizes[case] - across * cell))
                np.take(held[cell], cols[start:end], out=x[start:end])
                start = end
            return rows, places, vals, x

        return run

    def reader(self) -> Callable[[Files, str, str, int, int], np.ndarray]:
        """Reads a vector of a case in a task: (files, case, name, block, size)."""
        state, ids, there = {c: dict(self.state[c]) for c in self.cases}, self.ids, self.there

        def read(files: Files, case: str, name: str, block: int, size: int) -> np.ndarray:
            folder = state[case][name]
            if folder in there and (case, block) not in there[folder]:
                return np.zeros(size)
            return files.vector(f"{folder}/{ids[case]}.{block}")

        return read

    def step(self, keep: list[str], dots: Dots, scalars: Scalars | None = None, before: Change | None = None, product: tuple[str, str] | Product | None = None, after: Change | None = None) -> Scalars:
        """Change the vectors by ``before``, put A times the vector ``product[0]`` into
        ``product[1]``, change them by ``after``, keep those named, and give the sums of
        ``dots`` over the blocks of each case.  One job, and one more where the vector to
        be multiplied is changed first."""
        if before is not None and product is not None:
            self._changed(None, {}, scalars or {}, [before], None)
            before = None
        if isinstance(product, tuple):
            product = Product(*product, diagonal=True)
        return self._changed(keep, dots, scalars or {}, [c for c in (before, after) if c is not None], product)

    def _changed(self, keep: list[str] | None, dots: Dots, scalars: Scalars, changes: list[Change], product: Product | None) -> Scalars:
        folder, span, ids, new, read = self.folder, self.span, self.ids, uuid.uuid4().hex, self.reader()
        names, multiplied = {c: set(self.state[c]) for c in self.cases}, product is not None
        if product is not None:
            gather, source, goal, kernel, diagonal = self.gather(product.matrix, product.source, product.of), product.source, product.goal, product.kernel, product.diagonal
            none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

        def work(blocks: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
            files = Files(folder)
            for case, block, size in blocks:
                v = Vectors(lambda name, c=case, k=block, n=size: read(files, c, name, k, n), names[case], size, span * block, case)
                if multiplied:
                    rows, cols, vals, x = gather(files, case, block) or none
                    if kernel is not None:
                        v[goal] = kernel(v, rows, cols, vals, x)
                    else:
                        y = np.bincount(rows, vals * x, size)
                        v[goal] = y + v["d"] * v[source] if diagonal else y
                for change in changes:
                    change(v, scalars.get(case, {}))
                kept = sorted(v.changed if keep is None else v.changed & set(keep))
                for name in kept:
                    files.write(f"{name}-{new}/{ids[case]}.{block}", v[name])
                yield pa.RecordBatch.from_arrays([pa.array([case]), pa.array([block], pa.int32()), pa.array([kept], pa.list_(pa.string())), pa.array([[float(v[a] @ v[b]) for a, b in dots.values()]], pa.list_(pa.float64()))], names=["case_id", "block", "kept", "dots"])

        sums, self.of_block = {case: np.zeros(len(dots)) for case in self.cases}, {}
        for r in self.dealt(work, "case_id string, block int, kept array<string>, dots array<double>", self.cases).collect():
            sums[r["case_id"]] += r["dots"]
            self.of_block[r["case_id"], r["block"]] = dict(zip(dots, r["dots"], strict=True))
            for name in r["kept"]:
                self.state[r["case_id"]][name] = f"{name}-{new}"
                self.folders.add(f"{name}-{new}")
        if keep is not None:
            for case in self.cases:
                self.state[case] = {name: at for name, at in self.state[case].items() if name in keep}
        self._tidy()
        return {case: dict(zip(dots, own.tolist(), strict=True)) for case, own in sums.items()}

    def _tidy(self) -> None:
        """Delete the vectors that no case has any more."""
        for folder in self.folders - {at for case in self.cases for at in self.state[case].values()}:
            self.files.delete(folder)
            self.folders.remove(folder)

    def table(self, name: str, cases: list[str]) -> DataFrame:
        """A vector of some cases as (case_id, i, x), read from its files."""
        folder, span, read = self.folder, self.span, self.reader()

        def work(blocks: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
            files = Files(folder)
            for case, block, size in blocks:
                yield pa.RecordBatch.from_arrays([pa.array([case] * size), pa.array(np.arange(span * block, span * block + size)), pa.array(read(files, case, name, block, size))], names=["case_id", "i", "x"])

        return self.dealt(work, "case_id string, i bigint, x double", cases)


_PLACE = pa.schema([("case_id", pa.string()), ("down", pa.int32())])


def fits(entries: DataFrame) -> bool:
    """Whether every case is small enough for a task of its own."""
    return entries.groupBy("case_id").count().where(F.col("count") > IN_TASK).isEmpty()


def _residual(v: Vectors, s: dict[str, float]) -> None:
    v["r"] = v["b"] - v["ax"]


def solve(entries: DataFrame, b: DataFrame, sizes: DataFrame, rtol: float, method: str | Callable[[Systems, dict[str, krylov.Outcome], int], None] = "cg", most: int = 500) -> tuple[DataFrame, dict[str, krylov.Outcome]]:
    """Solve each case from zero by ``METHODS[method]``, or a method itself: (case_id, i, x), and for each case
    what was seen on the way (without x).  Where a method changes to multigrid, the
    levels of ``cluster`` go on from the point reached.

    A case is solved when its true residual is at most ``rtol`` of b; one that breaks
    down or does not get there in ``most`` steps raises ArithmeticError.
    """
    spark, run = entries.sparkSession, METHODS[method] if isinstance(method, str) else method
    with scratch(spark):
        systems, solved = Systems(spark, {r["case_id"]: r["n"] for r in sizes.select("case_id", "n").collect()}), []
        systems.load(entries)
        systems.take(b, "b")
        systems.take(M.diagonal(entries), "d")
        cases = list(systems.cases)
        norms = systems.step(["b", "d", "x", "r"], {"bb": ("b", "b")}, after=lambda v, s: v.update(x=np.zeros_like(v["b"]), r=v["b"]))
        out = {case: krylov.Outcome(np.zeros(0), krylov.NOT_CONVERGED, 0, [norms[case]["bb"] ** 0.5], aim=rtol * norms[case]["bb"] ** 0.5) for case in cases}

        def done(ended: list[str]) -> None:
            for case in ended:
                out[case].status = krylov.SOLVED
            if ended:
                solved.append(stored(systems.table("x", ended), "blocks-solution", keep=True))
                systems.cases = [c for c in systems.cases if c not in ended]

        done([c for c in cases if out[c].residuals[0] == 0])
        while systems.cases:
            before = {c: out[c].iterations for c in systems.cases}
            run(systems, out, most)
            # From the truth, not from the recurrences.
            true = systems.step(["b", "d", "x", "r"], {"rr": ("r", "r")}, product=("x", "ax"), after=_residual)
            for case in systems.cases:
                out[case].residuals.append(true[case]["rr"] ** 0.5)
            done([c for c in systems.cases if out[c].residuals[-1] <= out[c].aim])
            for case in [c for c in systems.cases if c in systems.handed]:
                own = [f.where(F.col("case_id") == case) for f in (entries, sizes)]
                rest = stored(systems.table("r", [case]), "blocks-rest")
                more, steps, _ = G.solve_multigrid(own[0], rest, own[1], out[case].aim / out[case].residuals[-1])
                both = systems.table("x", [case]).join(more.withColumnRenamed("x", "more"), ["case_id", "i"]).select("case_id", "i", (F.col("x") + F.col("more")).alias("x"))
                solved.append(stored(both, "blocks-solution", keep=True))
                out[case].status, out[case].iterations = krylov.SOLVED, out[case].iterations + steps
                systems.cases.remove(case)
            lost = [c for c in systems.cases if out[c].iterations >= most or out[c].iterations == before[c] or not np.isfinite(out[c].residuals[-1])]
            if lost:
                raise ArithmeticError(f"{method} did not converge: " + "; ".join(f"case {c}, {out[c].iterations} steps, residual {out[c].residuals[-1]:.3g}, aim {out[c].aim:.3g}" for c in lost))
    x = solved[0]
    for part in solved[1:]:
        x = x.unionByName(part)
    return x, out


def _scaled(v: Vectors, x: str) -> np.ndarray:
    return np.divide(v[x], v["d"], out=v[x].copy(), where=v["d"] != 0)


Watch = Callable[[krylov.Outcome], bool]


def _by_diagonal(systems: Systems, scalars: Scalars, moved: Change) -> Scalars:
    """Move on, and divide the residual by the diagonal."""

    def after(v: Vectors, s: dict[str, float]) -> None:
        moved(v, s)
        v["z"] = _scaled(v, "r")

    return systems.step(["b", "d", "x", "r", "p", "z"], {"rr": ("r", "r"), "rz": ("r", "z")}, scalars, after=after)


def _by_chebyshev(high: dict[str, float], degree: int = 4) -> Callable[[Systems, Scalars, Change], Scalars]:
    """Move on, and put the polynomial of ``krylov.chebyshev`` to the residual."""

    def run(systems: Systems, scalars: Scalars, moved: Change) -> Scalars:
        kept = ["b", "d", "x", "r", "p", "z", "e", "rest"]
        centre, half = ({c: h * k for c, h in high.items()} for k in ((1 + 1 / 30) / 2, (1 - 1 / 30) / 2))
        sigma, rhos = (1 + 1 / 30) / (1 - 1 / 30), [(1 - 1 / 30) / (1 + 1 / 30)]
        for _ in range(degree - 1):
            rhos.append(1 / (2 * sigma - rhos[-1]))

        def begun(v: Vectors, s: dict[str, float]) -> None:
            moved(v, s)
            v["rest"] = _scaled(v, "r")
            v["e"] = v["rest"] / s["centre"]
            v["z"] = v["e"].copy()

        def further(v: Vectors, s: dict[str, float]) -> None:
            v["rest"] = v["rest"] - _scaled(v, "w")
            v["e"] = s["new"] * s["rho"] * v["e"] + 2 * s["new"] / s["half"] * v["rest"]
            v["z"] = v["z"] + v["e"]

        for k in range(degree - 1):
            own = {c: {**scalars.get(c, {}), "centre": centre[c], "half": half[c], "rho": rhos[k], "new": rhos[k + 1]} for c in systems.cases}
            found = systems.step(kept, {"rr": ("r", "r"), "rz": ("r", "z")}, own, begun if k == 0 else None, ("e", "w"), further)
        return found

    return run


def _cg(systems: Systems, out: dict[str, krylov.Outcome], most: int, precondition: Callable[[Systems, Scalars, Change], Scalars] = _by_diagonal, watches: dict[str, Watch] | None = None) -> None:
    """Conjugate gradients until every recurrence says that the aim is reached."""

    def turned(v: Vectors, s: dict[str, float]) -> None:
        v["p"] = v["z"] + s["beta"] * v["p"]

    def begun(v: Vectors, s: dict[str, float]) -> None:
        v["p"] = np.zeros_like(v["r"])

    def moved(v: Vectors, s: dict[str, float]) -> None:
        v["x"] = v["x"] + s["alpha"] * v["p"]
        v["r"] = v["r"] - s["alpha"] * v["q"]

    every, watches = list(systems.cases), watches or {}
    rz = {c: f["rz"] for c, f in precondition(systems, {}, begun).items()}
    scalars, active = {c: {"beta": 0.0} for c in every}, set(every)
    while active:
        found = systems.step(["b", "d", "x", "r", "p", "q"], {"pq": ("p", "q")}, scalars, turned, ("p", "q"))
        for case in every:
            # A case that is done, or breaks down, stands still.
            if case in active and not (found[case]["pq"] > 0 and rz[case] > 0):
                active.discard(case)
            scalars[case] = {"alpha": rz[case] / found[case]["pq"] if case in active else 0.0}
        found = precondition(systems, scalars, moved)
        for case in sorted(active):
            own = out[case]
            own.iterations += 1
            own.alphas.append(scalars[case]["alpha"])
            own.residuals.append(found[case]["rr"] ** 0.5)
            own.betas.append(found[case]["rz"] / rz[case])
            rz[case] = found[case]["rz"]
            if own.residuals[-1] <= own.aim or own.iterations >= most:
                active.discard(case)
            elif case in watches and watches[case](own):
                active.discard(case)
                systems.handed.add(case)
        scalars = {case: {"beta": out[case].betas[-1] if out[case].betas else 0.0} for case in every}


def _ritz(systems: Systems, steps: int = 12) -> dict[str, tuple[float, float]]:
    """Bounds on the spectra scaled by the diagonal, from a few steps of CG on a probe."""
    kept, dots = ["b", "d", "x", "r"], {"rr": ("r", "r")}
    first = systems.step(kept, dots, after=lambda v, s: v.update(r=np.cos(v["i"])))
    seen = {c: krylov.Outcome(np.zeros(0), krylov.NOT_CONVERGED, 0, aim=1e-14 * first[c]["rr"] ** 0.5) for c in systems.cases}
    _cg(systems, seen, steps)
    systems.step(kept, {}, after=lambda v, s: v.update(x=np.zeros_like(v["b"]), r=v["b"]))
    return {c: spectrum.extremes(own.alphas, own.betas) or (1.0, 1.0) for c, own in seen.items()}


def _chebyshev_cg(systems: Systems, out: dict[str, krylov.Outcome], most: int) -> None:
    if systems.high is None:
        systems.high = {c: 1.1 * high for c, (_, high) in _ritz(systems).items()}
    _cg(systems, out, most, _by_chebyshev(systems.high))


def _cheapest_cg(systems: Systems, out: dict[str, krylov.Outcome], most: int) -> None:
    """By the diagonal, or handed to multigrid where that is predicted to end sooner."""
    from residua.operators.solve import Cheapest

    if systems.high is None:
        found, systems.high = _ritz(systems), {}
        for case, (low, high) in found.items():
            condition = max(1.0, high / low) if low > 0 else 1e12
            reduction = out[case].aim / out[case].residuals[0]
            steps, fewer = spectrum.iterations_needed(condition, reduction), spectrum.iterations_needed(max(1.0, condition / Cheapest.GAIN), reduction)
            if spectrum.cheaper(steps, 1.0, fewer, Cheapest.CYCLE, Cheapest.SETUP) == "second":
                systems.handed.add(case)
    if any(c not in systems.handed for c in systems.cases):
        _cg(systems, out, most)


def _switching(method: Callable) -> Callable[[Systems, dict[str, krylov.Outcome], int], None]:
    return lambda systems, out, most: method(systems, out, most, watches={c: switching.Controller() for c in systems.cases})


def _factors(systems: Systems) -> Callable[[Vectors, str], np.ndarray]:
    """Incomplete factors of the block of each block of rows on the diagonal, kept as files:
    what gives their solution for a vector."""
    folder, span, ids, read, gather = systems.folder, systems.span, systems.ids, systems.reader(), systems.gather("matrix", None)
    name = systems._new("factors")

    def work(blocks: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
        files = Files(folder)
        for case, block, size in blocks:
            every = np.arange(size)
            parts = [(every, every, read(files, case, "d", block, size))]
            if found := gather(files, case, block):
                rows, cols, vals, _ = found
                inside = cols // span == block
                parts.append((rows[inside], cols[inside] - span * block, vals[inside]))
            rows, cols, vals = map(np.concatenate, zip(*parts, strict=True))
            order = np.lexsort((cols, rows))
            files.write(f"{name}/{ids[case]}.{block}", np.frombuffer(pickle.dumps(ilu.Ilu(size, rows[order], cols[order], vals[order]), 5), np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([case])], names=["case_id"])

    systems.dealt(work, "case_id string", systems.cases).collect()

    def scaled(v: Vectors, x: str) -> np.ndarray:
        if v.factors is None:
            v.factors = pickle.loads(Files(folder).read(f"{name}/{ids[v.case]}.{v.first // span}"))
        return v.factors.solve(v[x])

    return scaled


def _ilu_bicgstab(systems: Systems, out: dict[str, krylov.Outcome], most: int) -> None:
    if systems.factors is None:
        systems.factors = _factors(systems)
    _bicgstab(systems, out, most, scaled=systems.factors)


def _bicgstab(systems: Systems, out: dict[str, krylov.Outcome], most: int, watches: dict[str, Watch] | None = None, scaled: Callable[[Vectors, str], np.ndarray] = _scaled) -> None:
    """Stabilised bi-conjugate gradients until every recurrence says that the aim is
    reached; the smoothing step is lengthened where its angle is poor."""

    def first(v: Vectors, s: dict[str, float]) -> None:
        if "beta" not in s:
            v.update(w=v["r"].copy(), p=v["r"].copy())
        else:
            v["x"] = v["x"] + s["alpha"] * scaled(v, "p") + s["omega"] * scaled(v, "r")
            r = v["r"] - s["omega"] * v["t"]  # r holds what is left after the first half
            v["p"] = r + s["beta"] * (v["p"] - s["omega"] * v["v"])
            v["r"] = r
        v["ph"] = scaled(v, "p")

    def second(v: Vectors, s: dict[str, float]) -> None:
        v["r"] = v["r"] - s["alpha"] * v["v"]
        v["sh"] = scaled(v, "r")

    every, active, scalars = list(systems.cases), set(systems.cases), {}
    rho = {c: out[c].residuals[-1] ** 2 for c in every}
    while True:
        kept = ["b", "d", "x", "r", "p", "v", "w"]
        found = systems.step(kept, {"wv": ("w", "v")}, scalars, first, ("ph", "v"))
        if not active:
            return  # the last half-step has brought x up to date
        alpha = {c: rho[c] / found[c]["wv"] if c in active and found[c]["wv"] else 0.0 for c in every}
        found = systems.step([*kept, "t"], {"tt": ("t", "t"), "ts": ("t", "r"), "ss": ("r", "r"), "ws": ("w", "r"), "wt": ("w", "t")}, {c: {"alpha": alpha[c]} for c in every}, second, ("sh", "t"))
        for case in every:
            own, f = out[case], found[case]
            angle = f["ts"] / (f["tt"] * f["ss"]) ** 0.5 if f["tt"] > 0 and f["ss"] > 0 else 0.0
            if case not in active or not alpha[case] or not angle and f["ss"] > own.aim**2:
                active.discard(case)
                scalars[case] = {"alpha": alpha[case] if case in active else 0.0, "omega": 0.0, "beta": 0.0}
                continue
            omega = f["ts"] / f["tt"] * max(1.0, 0.7 / abs(angle)) if angle else 0.0
            new = f["ws"] - omega * f["wt"]
            own.iterations += 1
            own.residuals.append(max(0.0, f["ss"] - 2 * omega * f["ts"] + omega**2 * f["tt"]) ** 0.5)
            if own.residuals[-1] <= own.aim or own.iterations >= most or not omega or not new:
                active.discard(case)
            elif case in (watches or {}) and watches[case](own):
                active.discard(case)
                systems.handed.add(case)
            scalars[case] = {"alpha": alpha[case], "omega": omega, "beta": new / rho[case] * (alpha[case] / omega) if omega else 0.0}
            rho[case] = new


def _gmres(systems: Systems, out: dict[str, krylov.Outcome], most: int, restart: int = 30, precondition: Callable[[Systems, str, str], None] | None = None) -> None:
    """One cycle of GMRES, by the diagonal on the right, or by ``precondition``: the basis is kept as blocks, and a
    step is one product with the inner products of the new vector, and one that takes
    the basis out of it, twice over.  Preconditioned vectors are not kept, since the
    diagonal is the same in each step."""
    every, active, plain = list(systems.cases), set(systems.cases), precondition is None
    beta = {c: out[c].residuals[-1] for c in every}
    h, y = {c: np.zeros((restart + 1, restart)) for c in every}, {c: np.zeros(0) for c in every}
    kept = ["b", "d", "x", "r"]
    scalars: Scalars = {c: {"scale": beta[c]} for c in every}

    def less(v: Vectors, s: dict[str, float], k: int) -> None:
        for j in range(k):
            v["w"] = v["w"] - s[f"h{j}"] * v[f"v{j}"]

    for k in range(restart):
        basis = [f"v{j}" for j in range(k + 1)]

        def begun(v: Vectors, s: dict[str, float], k: int = k) -> None:
            # The newest vector: what was left of the last product, or the residual.
            if k:
                less(v, s, k)
            v[f"v{k}"] = v["w" if k else "r"] / s["scale"]
            if plain:
                v["z"] = _scaled(v, f"v{k}")

        if not plain:
            systems.step([*kept, *basis], {}, scalars, begun)
            precondition(systems, f"v{k}", "z")
        once = systems.step([*kept, *basis, "w"], {v: (v, "w") for v in basis}, scalars, begun if plain else None, ("z", "w"))
        twice = systems.step([*kept, *basis, "w"], {**{v: (v, "w") for v in basis}, "ww": ("w", "w")}, {c: {f"h{j}": once[c][v] for j, v in enumerate(basis)} for c in every}, after=lambda v, s, k=k: less(v, s, k + 1))
        for case in every:
            first, second = (np.array([f[case][v] for v in basis]) for f in (once, twice))
            norm = max(0.0, twice[case]["ww"] - float(second @ second)) ** 0.5
            # A case that is done stands still: its further vectors are zero.
            scalars[case] = {"scale": norm if case in active and norm else np.inf, **{f"h{j}": second[j] for j in range(k + 1)}}
            if case not in active:
                continue
            own, column = out[case], h[case][:, k]
            column[: k + 1], column[k + 1] = first + second, norm
            y[case], least = G._least_squares(h[case][: k + 2, : k + 1], beta[case])
            own.iterations += 1
            own.residuals.append(least)
            if least <= own.aim or own.iterations >= most or norm <= 1e-14 * np.linalg.norm(column[: k + 1]):
                active.discard(case)
                scalars[case]["scale"] = np.inf
        if not active:
            break

    def summed(v: Vectors, s: dict[str, float]) -> None:
        v["more"] = sum((s.get(f"y{j}", 0.0) * v[name] for j, name in enumerate(basis)), np.zeros_like(v["x"]))

    def moved(v: Vectors, s: dict[str, float]) -> None:
        v["x"] = v["x"] + (_scaled(v, "more") if plain else v["z"])

    weights = {c: {f"y{j}": float(a) for j, a in enumerate(y[c])} for c in every}
    if plain:
        systems.step(kept, {}, weights, before=summed, after=moved)
    else:
        systems.step([*kept, "more"], {}, weights, after=summed)
        precondition(systems, "more", "z")
        systems.step(kept, {}, after=moved)


def _multigrid(systems: Systems, out: dict[str, krylov.Outcome], most: int) -> None:
    """A cycle of GMRES by the levels of all cases, which are made once."""
    from residua.operators import levels as L

    if systems.levels is None:
        systems.levels = L.hierarchy(systems)
    _gmres(systems, out, most, 30, lambda own, source, goal: L.cycle(systems.levels, source, goal))


METHODS: dict[str, Callable[[Systems, dict[str, krylov.Outcome], int], None]] = {
    "cg": _cg,
    "bicgstab": _bicgstab,
    "gmres": lambda systems, out, most: _gmres(systems, out, most, 50),
    # By a diagonal that never changes, flexible GMRES is GMRES.
    "fgmres": lambda systems, out, most: _gmres(systems, out, most, 40),
    "chebyshev_cg": _chebyshev_cg,
    "cheapest_cg": _cheapest_cg,
    "switching_cg": _switching(_cg),
    "switching_bicgstab": _switching(_bicgstab),
    # The same preconditioner, from the levels of the cluster, inside GMRES.
    "multigrid_bicgstab": _multigrid,
    # Incomplete factors of the blocks on the diagonal: those of the whole would be solved level by level.
    "ilu_bicgstab": _ilu_bicgstab,
}
