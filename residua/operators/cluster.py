"""One nonsymmetric system over the cluster: GMRES, and multigrid as its preconditioner.

Vectors are columns of one table that is written out at each step, so the plan stays
short and a lost executor costs a re-read.  What the driver holds is small: one row
of inner products a step, the Hessenberg matrix, and the coarsest level.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.operators import matrix as M
from residua.operators.storage import measured, scratch, stored
from residua.solvers.multigrid import COARSEST, DAMPING, FEWER, LEVELS, ORDER, STRONG, SWEEPS, founded

_KEY = ["case_id", "i"]
#: Rows that are solved in one group, and rows of a matrix in which pairs are looked up by one task.
GROUP, BLOCK = 256, 1 << 15
#: Couplings from which on one task founds the aggregates that are left.
FINISH = 1_000_000
#: Pairs that are looked up at once, and places of dense systems that are factored at once.
PAIRS, DENSE = 1 << 20, 1 << 20
Precondition = Callable[[DataFrame], DataFrame]


def jacobi(entries: DataFrame) -> Precondition:
    """Division by the diagonal, where there is one."""
    diagonal = M.diagonal(entries).withColumnRenamed("x", "d")
    return lambda r: r.join(diagonal, _KEY, "left").select(*_KEY, (F.col("x") / F.when(F.coalesce("d", F.lit(0.0)) != 0, F.col("d")).otherwise(1.0)).alias("x"))


def _combined(weights: np.ndarray) -> Column:
    """The sum of the vectors v[0], v[1], ... with these weights."""
    return reduce(add, (F.lit(float(c)) * F.get("v", F.lit(j)) for j, c in enumerate(weights)))


def _least_squares(h: np.ndarray, beta: float) -> tuple[np.ndarray, float]:
    """The y that brings beta e1 - h y to its least norm, and that norm."""
    aim = np.zeros(len(h))
    aim[0] = beta
    y = np.linalg.lstsq(h, aim, rcond=None)[0]
    return y, float(np.linalg.norm(aim - h @ y))


def solve_gmres(entries: DataFrame, b: DataFrame, sizes: DataFrame, rtol: float, restart: int = 30, most: int = 300, precondition: Precondition | None = None) -> tuple[DataFrame, int, float]:
    """Restarted GMRES, preconditioned on the right, for one system: (x, iterations,
    relative residual).

    The basis is one array a row, so a step is one product, one join, and two
    aggregations of one row: all inner products with the basis at once, twice over,
    for a basis that is orthogonal to rounding.  A residual, confirmed at the end,
    above ``rtol`` (but for rounding, a hundredth) raises ArithmeticError, and so does
    a cycle that brings nothing.
    """
    precondition, dot = precondition or jacobi(entries), lambda x, y: F.coalesce(F.sum(x * y), F.lit(0.0))
    v = lambda j: F.get("v", F.lit(j))
    with scratch(b.sparkSession):
        state = stored(b.select(*_KEY, F.col("x").alias("b"), F.lit(0.0).alias("x"), F.col("x").alias("r")), "gmres")
        whole = state.agg(F.sqrt(dot(F.col("b"), F.col("b")))).first()[0]
        aim, steps, beta = rtol * whole, 0, whole
        while beta > aim and steps < most:
            cycle = state.select(*_KEY, "b", "x", F.array(F.col("r") / beta).alias("v"))
            h = np.zeros((restart + 1, restart))
            for k in range(restart):
                direction = precondition(cycle.select(*_KEY, v(k).alias("x")))
                step = stored(cycle.join(M.matvec(entries, direction, sizes, "w"), _KEY), "gmres-step")
                once = np.array(step.agg(*[dot(v(j), F.col("w")) for j in range(k + 1)]).first())
                step = step.withColumn("w", F.col("w") - _combined(once))
                *twice, square = step.agg(*[dot(v(j), F.col("w")) for j in range(k + 1)], dot(F.col("w"), F.col("w"))).first()
                twice = np.array(twice)
                h[: k + 1, k] = once + twice
                h[k + 1, k] = np.sqrt(max(0.0, square - float(twice @ twice)))
                steps += 1
                y, least = _least_squares(h[: k + 2, : k + 1], beta)
                done = least <= aim or steps >= most or k + 1 == restart or h[k + 1, k] <= 1e-14 * np.linalg.norm(h[: k + 1, k])
                if done:
                    cycle = step.drop("w")
                    break
                cycle = step.withColumn("v", F.array_append("v", (F.col("w") - _combined(twice)) / float(h[k + 1, k]))).drop("w")
            moved = precondition(cycle.select(*_KEY, _combined(y).alias("x"))).withColumnRenamed("x", "more")
            x = stored(cycle.select(*_KEY, "b", "x").join(moved, _KEY).select(*_KEY, "b", (F.col("x") + F.col("more")).alias("x")), "gmres-x")
            state = stored(x.join(M.matvec(entries, x.select(*_KEY, "x"), sizes, "ax"), _KEY).select(*_KEY, "b", "x", (F.col("b") - F.col("ax")).alias("r")), "gmres")
            before, beta = beta, state.agg(F.sqrt(dot(F.col("r"), F.col("r")))).first()[0]
            if not beta < before:
                break
        residual = beta / whole if whole else 0.0
        if not residual <= 1.01 * rtol:
            raise ArithmeticError(f"GMRES did not converge: relative residual {residual:.3g} after {steps} iterations, tolerance {rtol:.3g}")
        return stored(state.select(*_KEY, "x"), "gmres-solution", keep=True), steps, residual


def couplings(entries: DataFrame, strong: float = STRONG) -> DataFrame:
    """Strong couplings, both ways: (case_id, i, j, size).  A coupling is strong if its
    magnitude is at least ``strong`` of the greatest in its row; one that is strong one
    way counts both ways, with the greater of the magnitudes that are strong."""
    off = entries.where("row <> col and val <> 0").select("case_id", F.col("row").alias("i"), F.col("col").alias("j"), F.abs("val").alias("size"))
    most = off.groupBy(*_KEY).agg(F.max("size").alias("most"))
    keep = off.join(most, _KEY).where(F.col("size") >= strong * F.col("most")).drop("most")
    both = keep.unionByName(keep.select("case_id", F.col("j").alias("i"), F.col("i").alias("j"), "size"))
    return both.groupBy("case_id", "i", "j").agg(F.max("size").alias("size"))


def _order(i: str) -> Column:
    return F.pmod(F.col(i) * ORDER, F.lit(1 << 32))


def _founded(key, own):
    ids, places = np.unique(np.concatenate([own["i"].to_numpy(), own["j"].to_numpy()]), return_inverse=True)
    r, c = np.split(places.ravel(), 2)
    owner = founded(ids * ORDER % (1 << 32), r, c)
    some = np.flatnonzero(owner >= 0)
    return pa.table({"case_id": pa.repeat(key[0], len(some)), "i": pa.array(ids[some]), "owner": pa.array(ids[owner[some]])})


def aggregates(entries: DataFrame, sizes: DataFrame, strong: float = STRONG) -> DataFrame:
    """The aggregate of each unknown: (case_id, i, owner), owners numbered from 0 in the
    order of their founders; the same as ``solvers.multigrid.aggregates``.

    A round is four aggregations over the couplings between free unknowns: the least
    order around each, the least of those, the founders where it is their own, and
    what they take in.  Founders are over two steps apart, so none competes.  Once at most
    ``FINISH`` couplings are left, one task does the further rounds of each system.
    """
    with scratch(entries.sparkSession):
        all_pairs, seen = measured(couplings(entries, strong), "multigrid-couplings", keep=True)
        live, left, owned = all_pairs.select("case_id", "i", "j"), seen["rows"], None
        while left:
            if left <= FINISH:
                new = stored(live.groupBy("case_id").applyInArrow(_founded, "case_id string, i bigint, owner bigint"), "multigrid-owned", keep=True)
                owned = new if owned is None else owned.unionByName(new)
                break
            least = stored(live.groupBy(*_KEY).agg(F.least(F.min(_order("j")), _order("i")).alias("least")), "multigrid-least")
            around = live.join(least.select("case_id", F.col("i").alias("j"), "least"), ["case_id", "j"]).groupBy(*_KEY).agg(F.min("least").alias("second"))
            # The own order is among the neighbours' least ones, or they are less.
            founders = stored(around.where(F.col("second") == _order("i")).select(*_KEY), "multigrid-founders")
            taken = live.join(founders.select("case_id", F.col("i").alias("j")), ["case_id", "j"]).select("case_id", "i", F.col("j").alias("owner"))
            new = stored(founders.withColumn("owner", F.col("i")).unionByName(taken), "multigrid-owned", keep=True)
            owned = new if owned is None else owned.unionByName(new)
            gone = new.select(*_KEY)
            live = live.join(gone, _KEY, "left_anti").join(gone.withColumnRenamed("i", "j"), ["case_id", "j"], "left_anti")
            live, seen = measured(live.select("case_id", "i", "j"), "multigrid-live")
            left = seen["rows"]
        indices = M.dense(sizes)
        if owned is None:
            return indices.withColumn("owner", F.col("i"))
        beside = all_pairs.join(owned.select("case_id", F.col("i").alias("j"), "owner"), ["case_id", "j"]).join(owned.select(*_KEY), _KEY, "left_anti")
        # The strongest coupling decides, the least neighbour of equals.
        joined = beside.groupBy(*_KEY).agg(F.max(F.struct("size", (-F.col("j")).alias("less"), "owner")).alias("best")).select(*_KEY, F.col("best.owner").alias("owner"))
        every = indices.join(owned.unionByName(joined), _KEY, "left").select(*_KEY, F.coalesce("owner", "i").alias("owner"))
        every = stored(every, "multigrid-owners", keep=True)
        ranks = M.running_total(every.select(*_KEY, (F.col("owner") == F.col("i")).cast("long").alias("founder")), "founder", "rank").where("founder = 1")
        return stored(every.join(ranks.select("case_id", F.col("i").alias("owner"), "rank"), ["case_id", "owner"]).select(*_KEY, F.col("rank").alias("owner")), "multigrid-aggregates", keep=True)


def coarsened(entries: DataFrame, owners: DataFrame) -> DataFrame:
    """The matrix between aggregates, by two joins and one aggregation."""
    rows = entries.join(owners.select("case_id", F.col("i").alias("row"), F.col("owner").alias("r")), ["case_id", "row"])
    both = rows.join(owners.select("case_id", F.col("i").alias("col"), F.col("owner").alias("c")), ["case_id", "col"])
    return both.groupBy("case_id", F.col("r").alias("row"), F.col("c").alias("col")).agg(F.sum("val").alias("val"))


@dataclass
class Level:
    sizes: DataFrame
    entries: DataFrame
    n: int
    owners: DataFrame | None = None


def hierarchy(entries: DataFrame, sizes: DataFrame, coarsest: int = COARSEST, strong: float = STRONG) -> list[Level]:
    """The levels of one system, each a table."""
    levels = [Level(sizes, entries, sizes.first()["n"])]
    while levels[-1].n > coarsest and len(levels) < LEVELS:
        own = levels[-1]
        owners = aggregates(own.entries, own.sizes, strong)
        n = owners.agg(F.max("owner")).first()[0] + 1
        if n > FEWER * own.n:
            break
        own.owners = owners
        levels.append(Level(own.sizes.withColumn("n", F.lit(n).cast("long")), stored(coarsened(own.entries, owners), "multigrid-level"), n))
    return levels


def multigrid(levels: list[Level], direct: int = 10 * COARSEST) -> Precondition:
    """A cycle over ``levels``: damped Jacobi, a correction from the coarser level, and
    Jacobi again.  A coarsest level of at most ``direct`` unknowns is inverted by the
    driver, a larger one smoothed."""
    last, inverse = levels[-1], None
    if last.n <= direct:
        dense = np.zeros((last.n, last.n))
        for r in last.entries.toLocalIterator():  # of the coarsest level
            dense[r["row"], r["col"]] += r["val"]
        inverse = np.linalg.pinv(dense)

    def solved(r: DataFrame) -> DataFrame:
        right = np.zeros(last.n)
        for row in r.collect():
            right[row["i"]] = row["x"]
        spark, case = r.sparkSession, last.sizes.first()["case_id"]
        return spark.createDataFrame([(case, i, float(x)) for i, x in enumerate(inverse @ right)], "case_id string, i bigint, x double")

    def cycle(r: DataFrame, at: int = 0) -> DataFrame:
        own = levels[at]
        if own.owners is None and inverse is not None:
            return solved(r)
        scaled = jacobi(own.entries)

        def smoothed(x: DataFrame) -> DataFrame:
            step = scaled(_residual(own, r, x)).withColumnRenamed("x", "step")
            return x.join(step, _KEY).select(*_KEY, (F.col("x") + DAMPING * F.col("step")).alias("x"))

        r = stored(r, "multigrid-right")
        x = scaled(r).select(*_KEY, (DAMPING * F.col("x")).alias("x"))
        for _ in range(SWEEPS - 1):
            x = smoothed(x)
        if own.owners is not None:
            x = stored(x, "multigrid-smoothed")
            rest = _residual(own, r, x).join(own.owners, _KEY).groupBy("case_id", F.col("owner").alias("i")).agg(F.sum("x").alias("x"))
            more = cycle(rest, at + 1).select("case_id", F.col("i").alias("owner"), F.col("x").alias("more"))
            x = x.join(own.owners, _KEY).join(more, ["case_id", "owner"]).select(*_KEY, (F.col("x") + F.col("more")).alias("x"))
        for _ in range(SWEEPS):
            x = smoothed(stored(x, "multigrid-smoothed"))
        return stored(x, "multigrid-cycle")

    return cycle


def _residual(own: Level, r: DataFrame, x: DataFrame) -> DataFrame:
    return r.join(M.matvec(own.entries, x, own.sizes, "ax"), _KEY).select(*_KEY, (F.col("x") - F.col("ax")).alias("x"))


def solve_multigrid(entries: DataFrame, b: DataFrame, sizes: DataFrame, rtol: float, coarsest: int = COARSEST, **options) -> tuple[DataFrame, int, float]:
    """``solve_gmres`` with the multigrid cycle of the system's own levels."""
    with scratch(entries.sparkSession):
        x, steps, residual = solve_gmres(entries, b, sizes, rtol, precondition=multigrid(hierarchy(entries, sizes, coarsest)), **options)
        return stored(x, "multigrid-solution", keep=True), steps, residual


def between(entries: DataFrame, pattern: DataFrame) -> DataFrame:
    """The entries of the lower triangle between the places of each row's pattern:
    (case_id, i, j, k, val) with k <= j, for ``pattern(case_id, i, j)``.  The pair of a
    place with itself is always there, as zero where the matrix has no such entry.

    Patterns are sent, as one array each, to the blocks of rows of the matrix that they
    reach into, and pairs of places are looked up there: no pair that meets no entry
    leaves a task.  A task holds the rows of one block and a bounded number of pairs.
    """
    names = ["case_id", "block"]
    held = entries.where("col <= row and val <> 0").select("case_id", F.expr(f"row div {BLOCK}").alias("block"), F.col("row").alias("j"), F.col("col").alias("k"), "val")
    sent_schema = pa.schema([("of", pa.string()), ("reach", pa.int64()), ("i", pa.int64()), ("places", pa.list_(pa.int64()))])
    schema = pa.schema([("case_id", pa.string()), *((name, pa.int64()) for name in "ijk"), ("val", pa.float64())])

    def sent(key, own):
        i, j = own["i"].to_numpy(), own["j"].to_numpy()
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        new = np.append(True, np.diff(i) != 0)
        starts = np.flatnonzero(new)[np.cumsum(new) - 1]
        # The last place of a row in a block: all places up to it go there.
        last = np.flatnonzero(np.append((np.diff(i) != 0) | (np.diff(j // BLOCK) != 0), True))
        counts = last + 1 - starts[last]
        offsets = np.append(0, np.cumsum(counts))
        at = np.repeat(starts[last] - offsets[:-1], counts) + np.arange(offsets[-1])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(j[at]))
        return pa.table([pa.repeat(key[0], len(last)), pa.array(j[last] // BLOCK), pa.array(i[last]), lists], schema=sent_schema)

    def met(key, rows, patterns):
        if not patterns.num_rows:
            return schema.empty_table()
        first, lists = key[1].as_py() * BLOCK, patterns["places"].combine_chunks()
        places, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
        whole = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        begins = (ends - np.diff(ends, prepend=0))[whole]
        wide = int(places.max()) + 1
        keys = (rows["j"].to_numpy() - first) * wide + rows["k"].to_numpy()
        fit = rows["k"].to_numpy() < wide
        order = np.argsort(keys[fit])
        keys, vals = keys[fit][order], rows["val"].to_numpy()[fit][order]
        keys, vals = np.append(keys, np.iinfo(np.int64).max), np.append(vals, 0.0)
        upper, i, out = np.flatnonzero(places >= first), patterns["i"].to_numpy(), []
        counts = upper - begins[upper] + 1
        for some in np.split(np.arange(len(upper)), np.flatnonzero(np.diff(np.cumsum(counts) // PAIRS)) + 1):
            count = counts[some]
            before = np.cumsum(count) - count
            j = np.repeat(places[upper[some]], count)
            k = places[np.repeat(begins[upper[some]] - before, count) + np.arange(count.sum())]
            wanted = (j - first) * wide + k
            at = np.searchsorted(keys, wanted)
            found = keys[at] == wanted
            keep = np.flatnonzero(found | (j == k))
            out.append((np.repeat(i[whole[upper[some]]], count)[keep], j[keep], k[keep], np.where(found[keep], vals[at[keep]], 0.0)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table([pa.repeat(key[0], len(columns[0])), *map(pa.array, columns)], schema=schema)

    reached = pattern.select("case_id", F.expr(f"i div {BLOCK // 8}").alias("part"), "i", "j").groupBy("case_id", "part").applyInArrow(sent, "of string, reach bigint, i bigint, places array<bigint>")
    return held.groupBy(*names).cogroup(reached.groupBy("of", "reach")).applyInArrow(met, "case_id string, i bigint, j bigint, k bigint, val double")


def lower_pattern(entries: DataFrame) -> DataFrame:
    """Where the lower triangle has entries: (case_id, i, j)."""
    return entries.where("col <= row and val <> 0").select("case_id", F.col("row").alias("i"), F.col("col").alias("j"))


def fsai(entries: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """A factored sparse approximate inverse of symmetric positive definite systems:
    the lower triangular G with the pattern of the matrix for which G A G' is nearest to
    one: (case_id, row, col, val).

    The entries between the places of a row's pattern (``pairs``, if they are there
    already) are a small dense system; those of a group of rows are factored
    together.  Rows are independent, so nothing is factored in order.  A row whose small
    system is not positive definite raises ArithmeticError.
    """
    pairs = between(entries, lower_pattern(entries)) if pairs is None else pairs
    schema = pa.schema([("case_id", pa.string()), ("row", pa.int64()), ("col", pa.int64()), ("val", pa.float64())])

    def solved(key, own):
        of, places, g = rows_solved(key[0].as_py(), *(own[c].to_numpy() for c in ("i", "j", "k", "val")))
        return pa.table([pa.repeat(key[0], len(g)), pa.array(of), pa.array(places), pa.array(g)], schema=schema)

    dealt = pairs.withColumn("group", F.col("i") - F.col("i") % GROUP)
    return dealt.groupBy("case_id", "group").applyInArrow(solved, "case_id string, row bigint, col bigint, val double")


def rows_solved(case: str, all_i: np.ndarray, all_j: np.ndarray, all_k: np.ndarray, all_val: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of ``fsai`` from the pairs of their places: (rows, columns, values)."""
    on = all_j == all_k
    order = np.lexsort((all_j[on], all_i[on]))
    of, places = all_i[on][order], all_j[on][order]
    rows, starts, sizes = np.unique(of, return_index=True, return_counts=True)
    wide = int(places.max()) + 1
    flat = (of - rows[0]) * wide + places
    g = np.empty(len(places))
    # Rows of like sizes together: a small system stands at the end of a wider one.
    by_size = np.argsort(sizes, kind="stable")
    group = np.empty(len(rows), np.int64)
    group[by_size] = np.cumsum(sizes[by_size] ** 2) // DENSE
    pad = np.zeros(len(rows), np.int64)
    at_row = np.searchsorted(rows, all_i)
    for one in np.unique(group):
        some = np.flatnonzero(group == one)
        m = int(sizes[some].max())
        pad[some] = m - sizes[some]
        inside = np.flatnonzero(group[at_row] == one)
        r = at_row[inside]
        base = (all_i[inside] - rows[0]) * wide
        j = np.searchsorted(flat, base + all_j[inside]) - starts[r] + pad[r]
        k = np.searchsorted(flat, base + all_k[inside]) - starts[r] + pad[r]
        dense = np.zeros((len(some), m, m))
        dense[:, np.arange(m), np.arange(m)] = np.arange(m) < pad[some][:, None]
        local = np.searchsorted(some, r)
        dense[local, j, k] = dense[local, k, j] = all_val[inside]
        last = np.zeros((m, 1))
        last[-1] = 1.0
        try:
            if (places[starts[some] + sizes[some] - 1] != rows[some]).any():
                raise np.linalg.LinAlgError
            # With A = L L', the last column of the inverse over the root of its last place is that of L'.
            found = np.linalg.solve(np.swapaxes(np.linalg.cholesky(dense), 1, 2), np.broadcast_to(last, (len(some), m, 1)))[:, :, 0]
        except np.linalg.LinAlgError:
            bad = next(i for i, s in enumerate(some) if places[starts[s] + sizes[s] - 1] != rows[s] or not np.linalg.eigvalsh(dense[i])[0] > 0)
            raise ArithmeticError(f"row {rows[some[bad]]} of {case} is not positive definite on its pattern") from None
        for i, s in enumerate(some):
            g[starts[s] : starts[s] + sizes[s]] = found[i, pad[s] :]
    return of, places, g


def _products(flat: np.ndarray, val: np.ndarray, base: np.ndarray, j: np.ndarray, k: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The products of rows of G at their places ``flat``, by the entries between these."""
    j, k = np.searchsorted(flat, base + j), np.searchsorted(flat, base + k)
    off = j != k
    return np.bincount(j, val[k] * a, len(flat)) + np.bincount(k[off], val[j[off]] * a[off], len(flat))


def product_on_pattern(g: DataFrame, pairs: DataFrame) -> DataFrame:
    """The product of a lower triangular matrix and a symmetric one at the places of the
    first: (case_id, row, col, val, product), by the entries of the second between
    them (``between``).  Both meet in groups of rows; no other place is computed."""
    schema = pa.schema([("case_id", pa.string()), ("row", pa.int64()), ("col", pa.int64()), ("val", pa.float64()), ("product", pa.float64())])

    def run(key, own, some):
        row, col = own["row"].to_numpy(), own["col"].to_numpy()
        if not len(row):
            return schema.empty_table()
        first, wide = int(row.min()), int(col.max()) + 1
        flat = (row - first) * wide + col
        order = np.argsort(flat)
        row, col, flat, val = row[order], col[order], flat[order], own["val"].to_numpy()[order]
        found = _products(flat, val, (some["i"].to_numpy() - first) * wide, *(some[c].to_numpy() for c in ("j", "k", "val")))
        return pa.table([pa.repeat(key[0], len(row)), pa.array(row), pa.array(col), pa.array(val), pa.array(found)], schema=schema)

    left = g.withColumn("group", F.col("row") - F.col("row") % GROUP).groupBy("case_id", "group")
    right = pairs.select(F.col("case_id").alias("of"), "i", "j", "k", "val", (F.col("i") - F.col("i") % GROUP).alias("piece")).groupBy("of", "piece")
    return left.cogroup(right).applyInArrow(run, "case_id string, row bigint, col bigint, val double, product double")


def factored(g: DataFrame, sizes: DataFrame) -> Precondition:
    """The preconditioner G' G."""
    turned = M.transpose(g)
    return lambda r: M.matvec(turned, M.matvec(g, r, sizes, "x"), sizes, "x")
