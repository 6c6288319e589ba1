"""Largest inner products by multiprobe p-stable hashing.

Vectors are scaled by the largest norm and given one more component that brings
each to norm one, so that the nearest by distance is the largest by inner
product.  Each of ``TABLES`` tables hashes a vector by ``WIDE`` projections on
Gaussian directions (turned square to each other where they fit) cut into cells
of width ``CELL``.  A query visits its own bucket of each table and then
perturbed ones: a perturbation moves some of the projections to a neighbouring
cell, and the order of visits is that of the estimated success, the expected sum
of squared distances to the boundaries that are crossed.  That order is one
sequence over the ranks of the boundaries, the same for every query, which each
query applies to its own boundaries from the nearest to the farthest.

How many buckets are visited is fitted on a bounded sample: as many as find
``TARGET`` of the sample's true neighbours, ``MOST_PROBES`` at most.  In a
sample, neighbours are farther than in the whole, so the recall of the whole is
higher.  A query that finds fewer candidates than asked for visits all.

Every vector is indexed.  Vectors are dealt into blocks of bounded size, each with
tables of its own over its vectors' keys, so no bucket, however full, lands in one
task.  A task has one block and a crowd of queries: it looks up the buckets
that these visit, merges what the tables find, a few queries at a time, and reranks the
candidates exactly.  Lists of candidates, whose number grows with the square of the
input where vectors are spread evenly, are never shuffled or held.  Equal vectors
are one entry that holds their smallest ids, as many as can be asked for.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.llm._shared import let_go, materialize, scratch

TABLES, WIDE, CELL = 16, 20, 3.5
SAMPLE, SAMPLE_QUERIES, TARGET, MOST_PROBES = 8_192, 256, 0.94, 2_048
#: Vectors of a block and queries of a crowd at most; crowds of fewer queries, FEW at least, until there are so many tasks;
#: marks of candidates in a task at a time.
BLOCK, QUERIES, FEW, TASKS, POSTINGS = 1 << 16, 1 << 15, 64, 32, 1 << 22
SLACK = 1e-9


def sequence(wide: int, count: int) -> np.ndarray:
    """The first ``count`` sets of boundaries in the order of estimated success.

    Row by row, a set of ranks among the 2 * ``wide`` boundaries of a query from
    nearest (0) to farthest, marked by ones; the first set is empty.  The score
    of a set is the sum of expected squared distances of its ranks for
    projections spread evenly over their cells.  Ranks r and 2 * wide - 1 - r are
    the two sides of one cell and never stand in one set.
    """
    k, r = wide, np.arange(1, 2 * wide + 1)
    near, far = r * (r + 1) / (4 * (k + 1) * (k + 2)), 1 - (2 * k + 1 - r) / (k + 1) + (2 * k + 1 - r) * (2 * k + 2 - r) / (4 * (k + 1) * (k + 2))
    price = np.where(r <= k, near, far).tolist()
    sets: list[tuple[int, ...]] = [()]
    waiting = [(price[0], (0,))]
    while waiting and len(sets) < count:
        score, own = heapq.heappop(waiting)
        if own[-1] + 1 < 2 * k:
            # Its two successors: the last rank moved on by one, or the next rank added.
            heapq.heappush(waiting, (score - price[own[-1]] + price[own[-1] + 1], (*own[:-1], own[-1] + 1)))
            heapq.heappush(waiting, (score + price[own[-1] + 1], (*own, own[-1] + 1)))
        if not any(2 * k - 1 - x in own for x in own):
            sets.append(own)
    out = np.zeros((len(sets), 2 * k), np.int64)
    for i, own in enumerate(sets):
        out[i, list(own)] = 1
    return out


@dataclass(frozen=True)
class Index:
    """Directions, offsets and key weights of the tables, the largest norm, and
    how many buckets of a table a query visits."""

    largest: float
    planes: np.ndarray  # tables, components + 1, projections
    shifts: np.ndarray  # tables, projections
    weights: np.ndarray  # tables, projections
    probes: int = MOST_PROBES

    @classmethod
    def make(cls, size: int, largest: float, seed: int = 7) -> Index:
        rng, planes = np.random.default_rng(seed), []
        while len(planes) < TABLES:
            turned = rng.standard_normal((size + 1, size + 1))
            if size + 1 >= WIDE:
                # The directions of a table, and of as many tables as fit, are square to each other.
                turned = np.linalg.qr(turned)[0] * np.sqrt(size + 1)
                planes += [turned[:, k : k + WIDE] for k in range(0, size + 2 - WIDE, WIDE)]
            else:
                planes.append(rng.standard_normal((size + 1, WIDE)))
        weights = rng.integers(1 << 40, 1 << 62, (TABLES, WIDE)) | 1
        return cls(largest, np.array(planes[:TABLES]), rng.uniform(0, 1, (TABLES, WIDE)), weights)

    def places(self, x: np.ndarray, t: int, asked: bool) -> np.ndarray:
        """Projections in cells: of indexed vectors, or of queries, whose length does not matter."""
        if asked:
            x = np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])
        else:
            x = x / self.largest
            x = np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))])
        return x @ self.planes[t] / CELL + self.shifts[t]

    def keys(self, x: np.ndarray, t: int) -> np.ndarray:
        """The key of each indexed vector's bucket in table ``t``."""
        return _short(np.floor(self.places(x, t, False)).astype(np.int64) @ self.weights[t])

    def visits(self, q: np.ndarray, t: int, sets: np.ndarray) -> Iterator[np.ndarray]:
        """For each query the keys of the buckets of table ``t`` in the order of visits."""
        places = self.places(q, t, True)
        cells = np.floor(places)
        inside = places - cells
        own = cells.astype(np.int64) @ self.weights[t]
        # Distances to the lower and the upper boundary of each cell, and what crossing adds to a key.
        nearest = np.argsort(np.concatenate([inside, 1 - inside], axis=1), axis=1, kind="stable")
        moves = np.concatenate([-self.weights[t], self.weights[t]])
        for i, order in enumerate(nearest):
            yield _short(own[i] + sets @ moves[order])


def _short(keys: np.ndarray) -> np.ndarray:
    """The upper half of 64-bit keys: vectors of two buckets that share it are
    candidates too many, never too few."""
    return (keys >> 32).astype(np.int32)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of a vector with rows, summed from first to last component."""
    total = np.zeros(len(x))
    for k in range(len(q)):
        total += q[k] * x[:, k]
    return total


def fit(sample: np.ndarray, largest: float, top: int) -> Index:
    """Fit the number of visits to a sample of vectors."""
    index = Index.make(sample.shape[1], largest)
    if len(sample) <= 2 * top:
        return index
    step = max(1, len(sample) // SAMPLE_QUERIES)
    asked, sets, true = sample[::step], sequence(WIDE, MOST_PROBES), []
    for i, q in enumerate(asked):
        products = sample @ q
        products[i * step] = -np.inf
        true.append(np.argpartition(-products, top)[:top])
    needed = np.full((len(asked), top), MOST_PROBES)
    for t in range(TABLES):
        keys = index.keys(sample, t)
        for i, visited in enumerate(index.visits(asked, t, sets)):
            at = visited == keys[true[i]][:, None]
            needed[i] = np.minimum(needed[i], np.where(at.any(axis=1), at.argmax(axis=1), MOST_PROBES))
    probes = int(np.quantile(needed, TARGET, method="higher")) + 1
    return Index(index.largest, index.planes, index.shifts, index.weights, min(probes, MOST_PROBES))


def best_of(own: np.ndarray, x: np.ndarray, ids: np.ndarray, found: np.ndarray, products: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the candidates ``found`` with rounded products: places and exact
    products of the ``top`` best, ties to smaller ids."""
    if len(found) > top:
        limit = np.partition(products, len(found) - top)[len(found) - top]
        found = found[products >= limit - SLACK * max(1.0, abs(limit))]
    products = exact(own, x[found])
    best = np.lexsort((ids[found], -products))[:top]
    return found[best], products[best]


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null or zero, no null or non-finite component."""
    v = F.col(vector)
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return v.isNotNull() & F.forall(v, lambda c: F.coalesce(fine(c), F.lit(False))) & F.exists(v, lambda c: c != 0)


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(column.flatten(), float).reshape(-1, size)


def _numbered(entries: DataFrame) -> tuple[DataFrame, int]:
    """``entries`` with nth, whole numbers from 0 without gaps, and their count."""
    rows = materialize(entries.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ann-entries")
    # One row for each task that wrote.
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, n = [], 0
    for part in sorted(counts):
        before.append((part, n))
        n += counts[part]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "part int, before long"))
    return rows.join(offsets, "part").withColumn("nth", F.col("nth") + F.col("before")).drop("part", "before"), n


def _seen(index: Index, sets: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]], asked: np.ndarray) -> np.ndarray:
    """Which vectors of a block (columns) each query (rows) meets in the buckets that it
    visits; ``tables`` has the block's keys in order, and whose they are."""
    seen = np.zeros((len(asked), len(tables[0][0])), bool)
    for t, (keys, whose) in enumerate(tables):
        probes = np.stack(list(index.visits(asked, t, sets)))
        low = np.searchsorted(keys, probes.ravel(), "left")
        hits = np.searchsorted(keys, probes.ravel(), "right") - low
        some = np.flatnonzero(hits)
        low, hits = low[some], hits[some]
        if len(some):
            ends = np.cumsum(hits)
            seen[np.repeat(some // probes.shape[1], hits), whose[np.arange(ends[-1]) - np.repeat(ends - hits - low, hits)]] = True
    return seen


def _ranked(entries: DataFrame, asked: DataFrame, index: Index, size: int, blocks: int, crowds: int, top: int, everywhere: bool = False) -> DataFrame:
    """(ask, ids, score): of each query and block the ``top`` best of the candidates in the
    buckets that it visits there, or of the whole block.

    A task holds a block's tables and a few queries at a time, so what it needs
    does not grow with the candidates, and no list of them leaves it."""
    schema = pa.schema([("ask", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
    sets = sequence(WIDE, index.probes)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    stored = entries.select((F.col("nth") % blocks).cast("int").alias("block"), every(crowds).alias("crowd"), "nth", "v", "ids")
    queries = asked.select(every(blocks).alias("block2"), F.pmod(F.xxhash64("nth"), F.lit(crowds)).cast("int").alias("crowd2"), F.col("nth").alias("ask"), F.col("v").alias("own"))

    def run(vectors: pa.Table, own: pa.Table) -> pa.Table:
        let_go()
        if not vectors.num_rows or not own.num_rows:
            return schema.empty_table()
        x, q, asks, all_ids = _matrix(vectors["v"], size), _matrix(own["own"], size), np.array(own["ask"]), vectors["ids"].combine_chunks()
        least = all_ids.flatten().to_numpy()[all_ids.offsets.to_numpy()[:-1] - all_ids.offsets[0].as_py()]
        tables = []
        for t in range(0 if everywhere else TABLES):
            keys = index.keys(x, t)
            order = np.argsort(keys, kind="stable")
            tables.append((keys[order], order))
        places, found_by, scores = [], [], []
        step = max(1, POSTINGS // max(len(x), index.probes))
        for a in range(0, len(q), step):
            part = q[a : a + step]
            seen = np.ones((len(part), len(x)), bool) if everywhere else _seen(index, sets, tables, part)
            products = part @ x.T if 8 * seen.sum() >= seen.size else None
            for i in range(len(part)):
                some = np.flatnonzero(seen[i])
                best, exactly = best_of(part[i], x, least, some, x[some] @ part[i] if products is None else products[i, some], top)
                places.append(best)
                found_by.append(np.full(len(best), asks[a + i]))
                scores.append(exactly)
        return pa.table([pa.array(np.concatenate(found_by)), all_ids.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores))], schema=schema)

    return stored.groupBy("block", "crowd").cogroup(queries.groupBy("block2", "crowd2")).applyInArrow(run, "ask long, ids array<bigint>, score double")


def _best(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` best rows of each query."""
    order = Window.partitionBy("ask").orderBy(F.desc("score"), F.element_at("ids", 1))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("place")


_RESULT = "query_id long, rank int, vec_id long, score double"


def _search(rows: DataFrame, size: int, top: int) -> DataFrame:
    """``search`` over ``rows(id, v, ask)`` of one length."""
    rows = materialize(rows.where(F.size("v") == size).withColumn("mark", F.md5(F.col("v").cast("string"))), "ann-rows", keep=True)
    # At most top + 1 ids of a vector can be asked for; the limit works before the shuffle too.
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("mark").orderBy("id"))).where(F.col("place") <= top + 1)
    merged = first.groupBy("mark").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))
    askers = rows.where("ask").select("mark").distinct().withColumn("ask", F.lit(True))
    entries, n = _numbered(merged.join(askers, "mark", "left"))
    asked = entries.where("ask")
    largest, n_asked = entries.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c))), F.count("ask")).first()
    part = max(1, n // SAMPLE)
    sample = entries.where(F.pmod(F.xxhash64("mark"), F.lit(part)) == 0).orderBy("mark").limit(SAMPLE).select("v").toPandas()["v"]
    index = fit(np.array(sample.tolist(), float).reshape(-1, size), float(largest), top)
    blocks = -(-n // BLOCK)
    # As few copies of the vectors as give all tasks work.
    crowds = max(-(-n_asked // QUERIES), min(-(-TASKS // blocks), -(-n_asked // FEW)), 1)
    best = materialize(_best(_ranked(entries, asked, index, size, blocks, crowds, top + 1), top + 1), "ann-best")
    # Entries, not ids, are counted: at least as many ids stand behind them.
    short = asked.select("nth", "v").join(best.groupBy(F.col("ask").alias("nth")).agg(F.count("*").alias("n")), "nth", "left").where(F.coalesce("n", F.lit(0)) < min(top + 1, n)).select("nth", "v")
    short = materialize(short, "ann-short")
    if not short.isEmpty():
        more = _best(_ranked(entries, short, index, size, blocks, crowds, top + 1, everywhere=True), top + 1)
        best = best.join(short.select(F.col("nth").alias("ask")), "ask", "left_anti").select("ask", "ids", "score").unionAll(materialize(more, "ann-more").select("ask", "ids", "score"))
    lists = best.groupBy("ask").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    lists = materialize(lists.join(asked.select(F.col("nth").alias("ask"), "mark"), "ask").select("mark", "found"), "ann-lists", keep=True)
    queries = rows.where("ask").select(F.col("id").alias("query_id"), "mark")
    pairs = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct((-f["score"]).alias("less"), i.alias("vec_id")))))
    others = F.slice(F.array_sort(F.filter("pairs", lambda p: p["vec_id"] != F.col("query_id"))), 1, top)
    answered = queries.join(lists, "mark").withColumn("pairs", pairs).select("query_id", F.posexplode(others).alias("place", "pair"))
    return answered.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("pair.vec_id").alias("vec_id"), (-F.col("pair.less")).alias("score"))


def search(table: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", top: int = 20) -> DataFrame:
    """The ``top`` rows of largest inner product for each query row.

    Returns query_id, rank (from 1), vec_id, score (the inner product in double
    precision, components added in order).  Queries are the rows where
    ``is_query`` holds; every other usable row of as many components is a
    candidate, equal vectors too; ties go to the smaller id.  Vectors that are
    null, zero, or hold null or non-finite components take no part, nor do rows
    with a null id.  Vectors of different lengths have no inner product and are
    searched length by length.  Rows repeated under one id stand side by side
    among the candidates, but no row answers a query of its own id.  With fewer
    candidates than ``top`` all are given.  An empty table gives an empty result.
    """
    spark = table.sparkSession
    kind = "float" if table.schema[vector].dataType.elementType.typeName() == "float" else "double"
    rows = table.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    out = None
    # One row for each length of vectors that a query has.
    for r in rows.groupBy(F.size("v").alias("size")).agg(F.bool_or("ask").alias("asked")).where("asked").orderBy("size").collect():
        with scratch(spark):
            part = _search(rows, r["size"], top)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], _RESULT) if out is None else out
