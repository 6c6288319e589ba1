"""Additive Schwarz for one system over the cluster: overlapping parts, a small inverse
for each, and the weighted sum of what they give."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators import blocks as B
from residua.operators import matrix as M
from residua.operators.cluster import Precondition, aggregates, coarsened, couplings, solve_gmres
from residua.operators.storage import scratch, stored
from residua.solvers.multigrid import FEWER, LEVELS, STRONG

_KEY = ["case_id", "i"]
_PART = ["case_id", "part"]
#: Unknowns of a part before it takes in others; couplings beyond which an unknown neither takes in nor is taken in.
PART, HUB = 64, 32


def parts(entries: DataFrame, sizes: DataFrame, size: int = PART, strong: float = STRONG) -> DataFrame:
    """A partition of the unknowns: (case_id, i, part).

    Unknowns join in aggregates, and these in coarser ones, until there are as few as
    there should be parts.  Aggregates then lie one after the other, and what begins
    within the same ``size`` places is a part.  One of over ``size`` unknowns is dealt
    over as many places as it has, so whatever the graph, no part has many more than
    twice ``size``.
    """
    with scratch(entries.sparkSession):
        n = now = sizes.first()["n"]
        owned, own, own_sizes = M.dense(sizes).withColumn("owner", F.col("i")), entries, sizes
        for _ in range(LEVELS):
            if now * size <= n:
                break
            owners = aggregates(own, own_sizes, strong)
            found = owners.agg(F.max("owner")).first()[0] + 1
            if found > FEWER * now:
                break
            coarser = owners.select("case_id", F.col("i").alias("owner"), F.col("owner").alias("next"))
            owned = stored(owned.join(coarser, ["case_id", "owner"]).select(*_KEY, F.col("next").alias("owner")), "schwarz-owners")
            now, own_sizes = found, sizes.withColumn("n", F.lit(found).cast("long"))
            own = stored(coarsened(own, owners), "schwarz-level")
        return stored(_placed(owned, size), "schwarz-parts", keep=True)


def _placed(owned: DataFrame, size: int) -> DataFrame:
    """The part of each unknown, given its aggregate."""
    counts = owned.groupBy("case_id", F.col("owner").alias("i")).agg(F.count("*").alias("count"))
    starts = M.running_total(counts, "count", "start").select("case_id", F.col("i").alias("owner"), "count", "start")
    within = F.when(F.col("count") > size, F.pmod(F.xxhash64("i"), F.col("count"))).otherwise(0)
    placed = owned.join(starts, ["case_id", "owner"]).select(*_KEY, "start", within.alias("within"))
    return placed.select(*_KEY, F.floor((F.col("start") + F.col("within")) / size).cast("long").alias("part"))


def overlapping(entries: DataFrame, owned: DataFrame, layers: int = 1, strong: float = STRONG, hub: int = HUB, links: DataFrame | None = None) -> DataFrame:
    """The members of each part: (case_id, part, i, own).  In each layer a part takes in
    the strongly coupled neighbours of its members.  An unknown of over ``hub`` such
    neighbours stays in its own part and brings none in, so that parts stay small
    and none of its many entries is copied to other parts."""
    links = couplings(entries, strong).select("case_id", "i", "j") if links is None else links
    few = links.groupBy(*_KEY).agg(F.count("*").alias("count")).where(F.col("count") <= hub).select(*_KEY)
    links = links.join(few, _KEY).join(few.withColumnRenamed("i", "j"), ["case_id", "j"])
    members = owned.select("case_id", "part", "i", F.lit(True).alias("own"))
    for _ in range(layers):
        taken = members.join(links, _KEY).select("case_id", "part", F.col("j").alias("i"), F.lit(False).alias("own"))
        members = members.unionByName(taken).groupBy("case_id", "part", "i").agg(F.max("own").alias("own"))
    return members


def factors(entries: DataFrame, members: DataFrame, restricted: bool = True) -> DataFrame:
    """The inverse of each part's own matrix: (case_id, part, places, gives, inverse).

    ``places`` are its members in order, ``gives`` those it gives a correction for, and
    ``inverse`` the rows of these, weighted.  A restricted sum takes each unknown from
    the part that owns it; otherwise it is the mean over the parts that hold it.  A
    singular matrix has its pseudo-inverse.
    """
    if restricted:
        weighed = members.withColumn("weight", F.col("own").cast("double"))
    else:
        weighed = members.join(members.groupBy(*_KEY).agg((1.0 / F.count("*")).alias("weight")), _KEY)
    weighed = weighed.select("case_id", "part", "i", "weight")
    rows = members.select("case_id", "part", F.col("i").alias("row")).join(entries, ["case_id", "row"])
    local = rows.join(members.select("case_id", "part", F.col("i").alias("col")), ["case_id", "part", "col"]).select(F.col("case_id").alias("case"), F.col("part").alias("piece"), "row", "col", "val")
    schema = pa.schema([("case_id", pa.string()), ("part", pa.int64()), ("places", pa.list_(pa.int64())), ("gives", pa.list_(pa.int64())), ("inverse", pa.list_(pa.float64()))])

    def inverted(key, own: pa.Table, some: pa.Table) -> pa.Table:
        order = np.argsort(own["i"].to_numpy())
        places, weight = own["i"].to_numpy()[order], own["weight"].to_numpy()[order]
        dense = np.zeros((len(places), len(places)))
        dense[np.searchsorted(places, some["row"].to_numpy()), np.searchsorted(places, some["col"].to_numpy())] = some["val"].to_numpy()
        try:
            inverse = np.linalg.inv(dense)
        except np.linalg.LinAlgError:
            inverse = np.linalg.pinv(dense)
        giving = weight > 0
        rows = (weight[:, None] * inverse)[giving].ravel()
        return pa.table({"case_id": [key[0].as_py()], "part": [key[1].as_py()], "places": [places], "gives": [places[giving]], "inverse": [rows]}, schema=schema)

    return weighed.groupBy(*_PART).cogroup(local.groupBy("case", "piece")).applyInArrow(inverted, "case_id string, part bigint, places array<bigint>, gives array<bigint>, inverse array<double>")


def schwarz(inverses: DataFrame) -> Precondition:
    """The sum of what the parts give for a vector: (case_id, i, x).  Parts meet their
    pieces of the vector by two shuffles, and what they give is summed by a third.
    Inverses that are kept dealt by part are not shuffled."""
    places = stored(inverses.select("case_id", "part", F.explode("places").alias("i")), "schwarz-places")
    held = inverses.select(*_PART, "places", "gives", "inverse")

    def given(key, own: pa.Table, piece: pa.Table) -> pa.Table:
        gives, size = own["gives"].combine_chunks().values.to_numpy(), len(own["places"].combine_chunks().values)
        right = np.zeros(size)
        right[np.searchsorted(own["places"].combine_chunks().values.to_numpy(), piece["i"].to_numpy())] = piece["x"].to_numpy()
        found = own["inverse"].combine_chunks().values.to_numpy().reshape(len(gives), size) @ right
        return pa.table({"case_id": pa.repeat(key[0], len(gives)), "i": pa.array(gives), "x": pa.array(found)})

    def apply(r: DataFrame) -> DataFrame:
        pieces = places.join(r.select(*_KEY, "x"), _KEY).select(F.col("case_id").alias("case"), F.col("part").alias("piece"), "i", "x")
        found = held.groupBy(*_PART).cogroup(pieces.groupBy("case", "piece")).applyInArrow(given, "case_id string, i bigint, x double")
        return found.groupBy(*_KEY).agg(F.sum("x").alias("x"))

    return apply


def solve_schwarz(entries: DataFrame, b: DataFrame, sizes: DataFrame, rtol: float, size: int = PART, layers: int = 1, strong: float = STRONG, restricted: bool = True, **options) -> tuple[DataFrame, int, float]:
    """``solve_gmres`` with the weighted sum over overlapping parts of the system.  A
    system too large for a task goes by the files of ``blocks``, by ``solve_in_blocks``."""
    if restricted and not options and not B.fits(entries):
        return solve_in_blocks(entries, b, sizes, rtol, size, layers, strong)
    with scratch(entries.sparkSession):
        members = stored(overlapping(entries, parts(entries, sizes, size, strong), layers, strong), "schwarz-members")
        # Dealt by part once and kept so: a step shuffles pieces of vectors alone.
        dealt = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        inverses = factors(entries, members, restricted).repartition(dealt, *_PART).persist(StorageLevel.DISK_ONLY)
        try:
            x, steps, residual = solve_gmres(entries, b, sizes, rtol, precondition=schwarz(inverses), **options)
        finally:
            inverses.unpersist()
        return stored(x, "schwarz-solution", keep=True), steps, residual


def solve_in_blocks(entries: DataFrame, b: DataFrame, sizes: DataFrame, rtol: float, size: int = PART, layers: int = 1, strong: float = STRONG) -> tuple[DataFrame, int, float]:
    """The same by GMRES over blocks: vectors, matrix and inverses are files."""
    from residua.operators import schwarz_blocks as P

    made = []

    def method(systems: B.Systems, out: dict, most: int) -> None:
        if not made:
            owned, links = P.owners(systems, size, strong)
            members = stored(overlapping(entries, stored(_placed(owned, size), "schwarz-parts"), layers, strong, links=links), "schwarz-members")
            made.append(P.factors(systems, members))
        B._gmres(systems, out, most, 30, made[0])

    x, seen = B.solve(entries, b, sizes, rtol, method, 300)
    own = next(iter(seen.values()))
    return x, own.iterations, own.residuals[-1] / own.residuals[0] if own.residuals[0] else 0.0
