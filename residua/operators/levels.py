"""Aggregation multigrid over the cluster, the levels of several cases in step.

The rules are those of ``solvers.multigrid``; matrices and vectors of a level are the
files of ``blocks``, and so are its aggregates, as matrices of one entry a row.  From the
level on at which no case is too large for a task, one task for each case does the rest.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from residua.operators import blocks as B
from residua.solvers.multigrid import COARSEST, DAMPING, FEWER, LEVELS, ORDER, STRONG, SWEEPS, Multigrid

#: Entries that leave a task in one batch.
BATCH = 1 << 20
#: Entries that a block of rows of a coarse level has at the most, if they are even.
ENTRIES = 2_000_000
_ENTRIES = "case_id string, row bigint, col bigint, val double"


@dataclass
class Levels:
    own: list[B.Systems]
    packed: bool = False  # whether the last one is solved by one task for each case


def _batches(case: str, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), BATCH):
        some = slice(k, k + BATCH)
        size = len(rows[some])
        yield pa.RecordBatch.from_arrays([pa.array([case]).take(pa.array(np.zeros(size, np.int64))), pa.array(rows[some].astype(np.int64)), pa.array(cols[some].astype(np.int64)), pa.array(vals[some].astype(float))], names=["case_id", "row", "col", "val"])


def _strong(rows: np.ndarray, vals: np.ndarray, size: int, strong: float) -> np.ndarray:
    most, magnitude = np.zeros(size), np.abs(vals)
    np.maximum.at(most, rows, magnitude)
    return (magnitude >= strong * most[rows]) & (magnitude > 0)


def couple(own: B.Systems, strong: float = STRONG) -> None:
    """The matrix ``strong``: the sizes of strong couplings, both ways.  Only those that go
    to other rows are shuffled."""
    folder, ids, span, gather = own.folder, own.ids, own.span, own.gather("matrix", None)

    def turned(blocks: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
        files = B.Files(folder)
        for case, block, size in blocks:
            if found := gather(files, case, block):
                rows, cols, vals, _ = found
                keep = _strong(rows, vals, size, strong)
                yield from _batches(case, cols[keep], rows[keep] + span * block, np.abs(vals[keep]))

    own.load(own.dealt(turned, _ENTRIES, own.cases), "turned")
    other = own.gather("turned", None)

    def both(blocks: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
        files = B.Files(folder)
        for case, block, size in blocks:
            found = []
            for k, part in enumerate((gather(files, case, block), other(files, case, block))):
                if part is not None:
                    rows, cols, vals, _ = part
                    keep = _strong(rows, vals, size, strong) if k == 0 else slice(None)
                    found.append((rows[keep], cols[keep], np.abs(vals[keep])))
            if found:
                rows, cols, vals = map(np.concatenate, zip(*found, strict=True))
                order = np.lexsort((cols, rows, cols // span))
                rows, cols, vals = rows[order], cols[order], vals[order]
                new = np.flatnonzero(np.append(True, (np.diff(rows) != 0) | (np.diff(cols) != 0)))
                files.write(f"strong/{ids[case]}.{block}", *B.laid(cols[new] // span, rows[new], cols[new] % span, np.maximum.reduceat(vals, new)))
            yield pa.RecordBatch.from_arrays([pa.array([case]), pa.array([block], pa.int32()), pa.array([bool(found)])], names=["case_id", "down", "some"])

    own.there["strong"] = {(r["case_id"], r["down"]) for r in own.dealt(both, "case_id string, down int, some boolean", own.cases).collect() if r["some"]}
    own.files.delete("turned") if own.there.pop("turned") else None


def _least(v, rows, cols, vals, x):
    out = np.full(v.size, np.inf)
    np.minimum.at(out, rows, x)
    return out


def _greatest(v, rows, cols, vals, x):
    out = np.full(v.size, -1.0)
    np.maximum.at(out, rows, x)
    return out


def _strongest(v, rows, cols, vals, x):
    """Of the neighbours with an aggregate, that of the strongest; of equals, of the least."""
    out = np.full(v.size, -1.0)
    some = (v["owner"][rows] < 0) & (x >= 0)
    rows, cols, vals, x = rows[some], cols[some], vals[some], x[some]
    order = np.lexsort((-cols, vals, rows))  # the best of a row last
    rows, x = rows[order], x[order]
    last = np.append(np.diff(rows) != 0, True)[: len(rows)]
    out[rows[last]] = x[last]
    return out


def aggregate(own: B.Systems) -> dict[str, int]:
    """The vector ``rank``, the number of each unknown's aggregate, and how many there
    are; the same as ``solvers.multigrid.aggregates``.  A round is three products."""
    base = [name for name in own.state[own.cases[0]]]
    kept = [*base, "order", "owner"]

    def begun(v, s):
        v["order"] = (v["i"].astype(np.int64) * ORDER % (1 << 32)).astype(float)
        v["owner"] = np.full(v.size, -1.0)

    def lowest(v, s):
        live = np.isfinite(v["order"]) & np.isfinite(v["near"])
        v["least"] = np.where(live, np.minimum(v["near"], v["order"]), np.inf)
        v["live"] = live.astype(float)

    def founding(v, s):
        v["founder"] = np.where((v["live"] > 0) & (np.minimum(v["near"], v["least"]) == v["order"]), v["i"], -1.0)

    def taken(v, s):
        free = (v["owner"] < 0) & (v["near"] >= 0)
        v["owner"] = np.where(v["founder"] >= 0, v["founder"], np.where(free, v["near"], v["owner"]))
        v["order"] = np.where(v["owner"] >= 0, np.inf, v["order"])

    own.step(kept, {}, after=begun)
    while True:
        found = own.step([*kept, "least", "live"], {"live": ("live", "live")}, product=B.Product("order", "near", "strong", kernel=_least), after=lowest)
        if not any(f["live"] for f in found.values()):
            break
        own.step([*kept, "founder"], {}, product=B.Product("least", "near", "strong", kernel=_least), after=founding)
        own.step(kept, {}, product=B.Product("founder", "near", "strong", kernel=_greatest), after=taken)

    def joined(v, s):
        v["owner"] = np.where(v["owner"] >= 0, v["owner"], np.where(v["near"] >= 0, v["near"], v["i"]))
        v["one"] = (v["owner"] == v["i"]).astype(float)

    counts = own.step([*base, "owner", "one"], {"one": ("one", "one")}, product=B.Product("owner", "near", "strong", kernel=_strongest), after=joined)
    starts = {case: {} for case in own.cases}
    for case in own.cases:
        total = 0
        for block in range(-(-own.sizes[case] // own.span)):
            starts[case][f"from{block * own.span}"] = float(total)
            total += round(own.of_block[case, block]["one"])

    def ranked(v, s):
        v["number"] = s[f"from{v.first}"] + np.cumsum(v["one"]) - v["one"]

    own.step([*base, "owner", "number"], {}, starts, after=ranked)
    _single(own, "owners", "owner")
    own.step([*base, "rank"], {}, product=B.Product("number", "rank", "owners"))
    own.files.delete("owners")
    del own.there["owners"]
    return {case: round(f["one"]) for case, f in counts.items()}


def _single(own: B.Systems, matrix: str, vector: str, across: int | None = None) -> None:
    """A matrix with a one in each row, in the column that a vector tells."""
    folder, ids, read = own.folder, own.ids, own.reader()
    span = own.across[matrix] = across or own.span

    def work(blocks: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
        files = B.Files(folder)
        for case, block, size in blocks:
            to = read(files, case, vector, block, size).astype(np.int64)
            order = np.argsort(to // span, kind="stable")
            files.write(f"{matrix}/{ids[case]}.{block}", *B.laid(to[order] // span, order, to[order] % span, np.ones(size)))
            yield pa.RecordBatch.from_arrays([pa.array([case])], names=["case_id"])

    own.dealt(work, "case_id string", own.cases).collect()
    own.there[matrix] = {(case, block) for case, block, _ in own._blocks(own.cases)}


def coarser(own: B.Systems, sizes: dict[str, int]) -> tuple[B.Systems, dict[str, int]]:
    """The level between the aggregates of ``rank``, and its entries off the diagonal."""
    # Rows grow longer as they grow fewer: blocks have fewer of them.
    longest = max(own.entries[c] / sizes[c] for c in own.cases)
    below = B.Systems(own.spark, sizes, span=min(own.span, 1 << max(4, int(ENTRIES / max(longest, 1.0)).bit_length() - 1)))
    folder, span, read, gather = own.folder, own.span, own.reader(), own.gather("matrix", "rank")

    def work(blocks: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
        files = B.Files(folder)
        for case, block, size in blocks:
            rank = read(files, case, "rank", block, size).astype(np.int64)
            keys, vals = [rank * sizes[case] + rank], [read(files, case, "d", block, size)]
            if found := gather(files, case, block):
                rows, _, val, to = found
                keys.append(rank[rows] * sizes[case] + to.astype(np.int64))
                vals.append(val)
            places, at = np.unique(np.concatenate(keys), return_inverse=True)
            yield from _batches(case, places // sizes[case], places % sizes[case], np.bincount(at.ravel(), np.concatenate(vals), len(places)))

    counts = below.load(own.dealt(work, _ENTRIES, own.cases), merge=np.add, diagonal=True)
    _single(own, "up", "rank", below.span)

    def turned(blocks: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
        files = B.Files(folder)
        for case, block, size in blocks:
            yield from _batches(case, read(files, case, "rank", block, size), np.arange(size) + span * block, np.ones(size))

    below.load(own.dealt(turned, _ENTRIES, own.cases), "down", square=False, across=own.span)
    return below, counts


def hierarchy(systems: B.Systems, coarsest: int | None = None, strong: float = STRONG, in_task: int | None = None) -> Levels:
    """The levels of all cases, down to one that a task for each case can hold."""
    in_task, coarsest = B.IN_TASK if in_task is None else in_task, COARSEST if coarsest is None else coarsest
    levels, counts = Levels([systems]), None
    while len(levels.own) < LEVELS:
        own = levels.own[-1]
        if max(own.sizes[c] for c in own.cases) <= coarsest or counts is not None and max(counts.values()) <= in_task:
            break
        couple(own, strong)
        sizes = aggregate(own)
        own.files.delete("strong") if own.there.pop("strong") else None
        if all(sizes[c] > FEWER * own.sizes[c] for c in own.cases):
            break
        below, counts = coarser(own, sizes)
        levels.own.append(below)
    last = levels.own[-1]
    if max(last.sizes[c] for c in last.cases) <= coarsest or counts is not None and max(counts.values()) <= in_task:
        _pack(last)
        levels.packed = True
    return levels


def _pack(last: B.Systems) -> None:
    """The further levels of each case, set up by one task and kept for each cycle."""
    folder, ids, span, read, gather, n = last.folder, last.ids, last.span, last.reader(), last.gather("matrix", None), last.sizes

    def work(blocks: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
        files, case = B.Files(folder), blocks[0][0]
        d = np.concatenate([read(files, case, "d", block, size) for _, block, size in blocks])
        parts = [(np.arange(n[case]), np.arange(n[case]), d)]
        for _, block, _ in blocks:
            if found := gather(files, case, block):
                parts.append((found[0] + span * block, found[1], found[2]))
        made = Multigrid(n[case], *map(np.concatenate, zip(*parts, strict=True)))
        files.write(f"packed/{ids[case]}", np.frombuffer(pickle.dumps(made, 5), np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([case])], names=["case_id"])

    last.dealt(work, "case_id string", last.cases, whole=True).collect()


def _packed(last: B.Systems, source: str, goal: str) -> None:
    folder, ids, span, read, new = last.folder, last.ids, last.span, last.reader(), last._new(goal)

    def work(blocks: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
        files, case = B.Files(folder), blocks[0][0]
        found = pickle.loads(files.read(f"packed/{ids[case]}")).cycle(np.concatenate([read(files, case, source, block, size) for _, block, size in blocks]))
        for _, block, size in blocks:
            files.write(f"{new}/{ids[case]}.{block}", found[span * block : span * block + size])
        yield pa.RecordBatch.from_arrays([pa.array([case])], names=["case_id"])

    last.dealt(work, "case_id string", last.cases, whole=True).collect()
    last.folders.add(new)
    for case in last.cases:
        last.state[case][goal] = new


def cycle(levels: Levels, source: str, goal: str, at: int = 0) -> None:
    """A cycle on the vector ``source`` of a level, which leaves the vector ``goal``."""
    own, last = levels.own[at], at == len(levels.own) - 1
    cases = levels.own[0].cases
    own.cases = list(cases)
    if last and levels.packed:
        _packed(own, source, goal)
        return
    kept = [name for name in own.state[cases[0]] if name not in (goal, "cycle", "rest")]

    def smoothed(v, s):
        v["left"] = v[source] - v["product"]
        v["cycle"] = v["cycle"] + DAMPING * B._scaled(v, "left")

    def ended(v, s):
        smoothed(v, s)
        v[goal] = v["cycle"]

    def smooth(end: bool = False) -> None:
        own.step([*kept, goal if end else "cycle"], {}, product=("cycle", "product"), after=ended if end else smoothed)

    own.step([*kept, "cycle"], {}, after=lambda v, s: v.update(cycle=DAMPING * B._scaled(v, source)))
    for _ in range(SWEEPS - 1):
        smooth()
    if not last:
        below = levels.own[at + 1]
        below.cases = list(cases)
        own.step([*kept, "cycle", "rest"], {}, product=("cycle", "product"), after=lambda v, s: v.update(rest=v[source] - v["product"]))
        below.step(["d", "right"], {}, product=B.Product("rest", "right", "down", of=own))
        cycle(levels, "right", "found", at + 1)
        own.step([*kept, "cycle"], {}, product=B.Product("found", "coarse", "up", of=below), after=lambda v, s: v.update(cycle=v["cycle"] + v["coarse"]))
    for k in range(SWEEPS):
        smooth(k + 1 == SWEEPS)
