"""Additive Schwarz over files of blocks: parts, their inverses, and GMRES with their sum.

The parts are those of ``schwarz``.  Which entries lie within a part is looked up in one
block of columns after the other, and inverses are files of some parts each, so that
neither members times entries nor inverses are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators import blocks as B
from residua.operators import levels as L
from residua.operators.storage import stored
from residua.solvers.multigrid import FEWER, LEVELS

#: Parts whose inverses are one file, and pairs of entries and parts that are looked up at once.
PARTS, PAIRS = 64, 1 << 20


def links_of(own: B.Systems) -> DataFrame:
    """The strong couplings that ``levels.couple`` has left: (case_id, i, j)."""
    folder, span, gather = own.folder, own.span, own.gather("strong", None)

    def work(blocks: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
        files = B.Files(folder)
        for case, block, _ in blocks:
            if found := gather(files, case, block):
                yield from L._batches(case, found[0] + span * block, found[1], found[2])

    return own.dealt(work, L._ENTRIES, own.cases).select("case_id", F.col("row").alias("i"), F.col("col").alias("j"))


def owners(systems: B.Systems, size: int, strong: float) -> tuple[DataFrame, DataFrame]:
    """What ``schwarz.parts`` deals by, (case_id, i, owner), and the couplings of the systems."""
    levels, links = [systems], None
    for _ in range(LEVELS):
        own = levels[-1]
        done = all(own.sizes[c] * size <= systems.sizes[c] for c in systems.cases)
        if done and links is not None:
            break
        L.couple(own, strong)
        if links is None:
            links = stored(links_of(own), "schwarz-links")
        sizes = {} if done else L.aggregate(own)
        if own.there.pop("strong"):
            own.files.delete("strong")
        if done or all(sizes[c] > FEWER * own.sizes[c] for c in own.cases):
            break
        levels.append(L.coarser(own, sizes)[0])
    if len(levels) == 1:
        return systems.table("d", systems.cases).select("case_id", "i", F.col("i").alias("owner")), links
    for at in reversed(range(len(levels) - 1)):
        own = levels[at]
        if at == len(levels) - 2:
            own.step([*own.state[own.cases[0]], "owner"], {}, after=lambda v, s: v.update(owner=v["rank"]))
        else:
            own.step([*own.state[own.cases[0]], "owner"], {}, product=B.Product("owner", "owner", "up", of=levels[at + 1]))
    return stored(systems.table("owner", systems.cases), "schwarz-owners").select("case_id", "i", F.col("x").cast("long").alias("owner")), links


def factors(systems: B.Systems, members: DataFrame) -> Callable[[B.Systems, str, str], None]:
    """Invert the matrices of the parts, and give what puts their sum for one vector into another."""
    folder, span, ids, read, gather = systems.folder, systems.span, systems.ids, systems.reader(), systems.gather("matrix", None)
    some = max(1, min(PARTS, span // 256))
    count = members.agg(F.max("part")).first()[0] + 1
    held = members.select("case_id", F.expr(f"int(i div {span})").alias("down"), (F.expr(f"i % {span}") * count + F.col("part")).alias("key"))

    def written(key, own):
        B.Files(folder).write(f"members/{ids[key[0].as_py()]}.{key[1].as_py()}", np.sort(own["key"].to_numpy()))
        return pa.table({"case_id": [key[0].as_py()], "down": [key[1].as_py()]}, schema=B._PLACE)

    there = {(r["case_id"], r["down"]) for r in held.groupBy("case_id", "down").applyInArrow(written, "case_id string, down int").collect()}

    def inside(blocks: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
        files = B.Files(folder)

        def batch(case, part, row, col, val):
            return pa.RecordBatch.from_arrays([pa.array([case]).take(pa.array(np.zeros(len(part), np.int64))), pa.array(part), pa.array(row), pa.array(col), pa.array(val)], names=["case_id", "part", "row", "col", "val"])

        for case, block, size in blocks:
            if (case, block) not in there:
                continue
            own = np.frombuffer(files.read(f"members/{ids[case]}.{block}"), np.int64)
            r, part = own // count, own % count
            yield batch(case, part, r + span * block, r + span * block, read(files, case, "d", block, size)[r])
            found = gather(files, case, block)
            if found is None:
                continue
            rows, cols, vals, _ = found
            starts = np.searchsorted(r, np.arange(size + 1))
            for cell in np.unique(cols // span).tolist():
                if (case, cell) not in there:
                    continue
                known = np.frombuffer(files.read(f"members/{ids[case]}.{cell}"), np.int64)
                own = np.flatnonzero(cols // span == cell)
                many = starts[rows[own] + 1] - starts[rows[own]]
                for few in np.split(np.arange(len(own)), np.flatnonzero(np.diff(np.cumsum(many) // PAIRS)) + 1):
                    entry, times = own[few], many[few]
                    before = np.cumsum(times) - times
                    of = np.repeat(entry, times)
                    p = part[np.repeat(starts[rows[entry]] - before, times) + np.arange(times.sum())]
                    wanted = (cols[of] - cell * span) * count + p
                    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                    hit = np.flatnonzero(known[at] == wanted)
                    if len(hit):
                        yield batch(case, p[hit], rows[of[hit]].astype(np.int64) + span * block, cols[of[hit]], vals[of[hit]])

    local = systems.dealt(inside, "case_id string, part bigint, row bigint, col bigint, val double", systems.cases)

    def inverted(key, own, rows):
        case, group, files = key[0].as_py(), key[1].as_py(), B.Files(folder)
        i, part, mine = own["i"].to_numpy(), own["part"].to_numpy(), own["own"].to_numpy(zero_copy_only=False)
        order = np.lexsort((i, part))
        i, part, mine = i[order], part[order], mine[order]
        row, col, val, of = (rows[c].to_numpy() for c in ("row", "col", "val", "part"))
        order = np.argsort(of, kind="stable")
        row, col, val, of = row[order], col[order], val[order], of[order]
        names, starts = np.unique(part, return_index=True)
        ends, sizes, gives, inverses = np.append(starts[1:], len(part)), [], [], []
        for name, start, end in zip(names.tolist(), starts.tolist(), ends.tolist(), strict=True):
            places, dense = i[start:end], np.zeros((end - start, end - start))
            a, z = np.searchsorted(of, [name, name + 1])
            np.add.at(dense, (np.searchsorted(places, row[a:z]), np.searchsorted(places, col[a:z])), val[a:z])
            give = np.flatnonzero(mine[start:end])
            try:
                aim = np.zeros((end - start, len(give)))
                aim[give, np.arange(len(give))] = 1.0
                inverse = np.linalg.solve(dense.T, aim).T  # the rows of the inverse that the part gives
            except np.linalg.LinAlgError:
                inverse = np.linalg.pinv(dense)[give]
            sizes.append((end - start, len(give)))
            gives.append(places[give])
            inverses.append(inverse.ravel())
        files.write(f"inverses/{ids[case]}.{group}", np.array([len(sizes)], np.int64), np.array(sizes, np.int64), *inverses)
        order = np.argsort(i // span, kind="stable")
        files.write(f"places/{ids[case]}.{group}", *B.laid(i[order] // span, order, i[order] % span, np.ones(len(i))))
        out = np.concatenate(gives)
        return pa.table({"case_id": pa.repeat(key[0], len(out)), "row": pa.array(out), "col": pa.array(np.arange(len(out)) + group * span), "val": pa.array(np.ones(len(out)))})

    group = lambda p: F.expr(f"int({p} div {some})")
    left = members.select("case_id", group("part").alias("group"), "part", "i", "own").groupBy("case_id", "group")
    right = local.select(F.col("case_id").alias("case"), group("part").alias("piece"), "part", "row", "col", "val").groupBy("case", "piece")
    systems.load(left.cogroup(right).applyInArrow(inverted, L._ENTRIES), "given", square=False)
    groups = [(r["case_id"], r["group"], 0) for r in members.select("case_id", group("part").alias("group")).distinct().orderBy("case_id", "group").collect()]
    systems.there["places"] = {(case, g) for case, g, _ in groups}

    def apply(own: B.Systems, source: str, goal: str) -> None:
        gather, new = own.gather("places", source), own._new("parts")

        def work(blocks: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
            files = B.Files(folder)
            for case, g, _ in blocks:
                rows, _, _, x = gather(files, case, g)
                right, data = np.empty(len(x)), files.read(f"inverses/{ids[case]}.{g}")
                right[rows] = x
                parts = int(np.frombuffer(data, np.int64, 1)[0])
                sizes, at, start, out = np.frombuffer(data, np.int64, 2 * parts, 8).reshape(parts, 2).tolist(), 8 + 16 * parts, 0, []
                for size, give in sizes:
                    out.append(np.frombuffer(data, np.float64, size * give, at).reshape(give, size) @ right[start : start + size])
                    at, start = at + 8 * size * give, start + size
                files.write(f"{new}/{ids[case]}.{g}", np.concatenate(out))
                yield pa.RecordBatch.from_arrays([pa.array([case])], names=["case_id"])

        own.dealt(work, "case_id string", own.cases, blocks=[b for b in groups if b[0] in own.cases]).collect()
        own.folders.add(new)
        kept = [*own.state[own.cases[0]], goal]
        for case in own.cases:
            own.state[case]["parts"] = new
        own.step(kept, {}, product=B.Product("parts", goal, "given"))

    return apply
