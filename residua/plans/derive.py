"""Sparse systems, candidate solutions and runs derived from the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions.rademacher import domain, signs
from residua.operators import matrix as M
from residua.operators.storage import is_there, state_of, stored

KEY = b"residua fixture key 0001"
FIELDS = {"scheme": "rademacher-hmac-sha256-v2", "release_id": "fixture", "family": "mesh", "rhs_kind": "rademacher", "draw_index": 0}
PREFIX = domain(FIELDS, "0" * 64)
TOLERANCE = 1e-10
#: Perturbations of case k: powers of two, none for the last case.
STEPS = (4, 12, 20, 28, 36, 40, None)
#: Couplings count as strong from this share of the greatest in a row: the derived graphs have no near and far.
COUPLED = 0.9
#: Diagonals other than the default: the power of two above twice a row's sum.
WEIGHTS = {"dominant": (), "dyadic": (lambda total: F.pow(F.lit(2.0), F.ceil(F.log2(1 + 2 * total))),)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], make: Callable[[], object]) -> object:
    """What ``make`` gives, kept for the application as long as the files of the
    tables are the same and what was written is there: systems are derived and written
    once, whatever uses them.  ``forget`` lets go of all."""
    key = (spark.sparkContext.applicationId, sf_dir, name, state_of(spark, *[f"{sf_dir}/{t}.parquet" for t in tables]))
    found = _kept.get(key)
    if found is None or isinstance(found, DataFrame) and not is_there(found):
        for old in [k for k in _kept if k[0] != key[0] or k[1:3] == key[1:3]]:
            del _kept[old]  # of an application that has ended, or of files that have changed
        found = _kept[key] = make()
    return found


def forget() -> None:
    """Derive everything anew from now on."""
    _kept.clear()


def size(spark: SparkSession, sf_dir: str) -> int:
    return once(spark, sf_dir, "size", ("part",), lambda: table(spark, sf_dir, "part").count())


def sizes(spark: SparkSession, sf_dir: str, cases: int = 1) -> DataFrame:
    """(case_id, n): case '0' alone, or cases '1' to '7' of the same size."""
    ids = spark.range(1, 8, 1, 1) if cases > 1 else spark.range(0, 1, 1, 1)
    return ids.select(F.col("id").cast("string").alias("case_id"), F.lit(size(spark, sf_dir)).cast("long").alias("n"))


def raw_entries(spark: SparkSession, sf_dir: str, cases: int = 1) -> DataFrame:
    """Uncombined entries: (case_id, row, col, val), several at one place."""
    n = F.lit(size(spark, sf_dir))
    case = F.col("l_linenumber").cast("string") if cases > 1 else F.lit("0")
    return table(spark, sf_dir, "lineitem").select(case.alias("case_id"), (F.col("l_partkey") % n).cast("long").alias("row"), (F.col("l_orderkey") % n).cast("long").alias("col"), F.col("l_quantity").cast("double").alias("val"))


def entries(spark: SparkSession, sf_dir: str, cases: int = 1, diagonal: str = "dominant") -> DataFrame:
    """A canonical nonsymmetric system.  The diagonal is one more than its row's
    sum of magnitudes, or ('dyadic') the power of two above twice that."""

    def make() -> DataFrame:
        off = M.canonicalize(raw_entries(spark, sf_dir, cases).where("row <> col"))
        return stored(M.with_dominant_diagonal(off, sizes(spark, sf_dir, cases), *WEIGHTS[diagonal]), "system")

    return once(spark, sf_dir, f"entries {cases} {diagonal}", ("part", "lineitem"), make)


def symmetric_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The off-diagonal part plus its transpose, with a dominant diagonal."""

    def make() -> DataFrame:
        off = raw_entries(spark, sf_dir).where("row <> col")
        both = M.canonicalize(off.unionByName(M.transpose(off)))
        return stored(M.with_dominant_diagonal(both, sizes(spark, sf_dir)), "symmetric")

    return once(spark, sf_dir, "symmetric", ("part", "lineitem"), make)


def target(spark: SparkSession, sf_dir: str, cases: int = 1) -> DataFrame:
    """Signs from the fixture key: (case_id, i, x)."""
    return once(spark, sf_dir, f"target {cases}", ("part",), lambda: stored(signs(sizes(spark, sf_dir, cases), KEY, PREFIX), "target"))


def rhs(spark: SparkSession, sf_dir: str, cases: int = 1, diagonal: str = "dominant") -> DataFrame:
    """b = A target: (case_id, i, x)."""

    def make() -> DataFrame:
        return stored(M.matvec(entries(spark, sf_dir, cases, diagonal), target(spark, sf_dir, cases), sizes(spark, sf_dir, cases), "x"), "rhs")

    return once(spark, sf_dir, f"rhs {cases} {diagonal}", ("part", "lineitem"), make)


def candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solutions of the seven cases that miss the target by known powers of two."""
    size = F.coalesce(*[F.when(F.col("case_id") == str(k), F.lit(0.0 if e is None else 2.0**-e)) for k, e in enumerate(STEPS, 1)])
    return target(spark, sf_dir, 7).select("case_id", "i", (F.col("x") + (F.col("i") % 7 - 3) * size).alias("x"))


def case_table(spark: SparkSession, sf_dir: str, cases: int = 7, family: str = "mesh") -> DataFrame:
    return sizes(spark, sf_dir, cases).select("case_id", "n", F.lit(family).alias("family"), F.lit(TOLERANCE).alias("tolerance"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs from events: (case_id, role, reference_ns, candidate_ns, passed, reference_passed)."""
    cents = F.round(F.col("value") * 100).cast("long") * 10_000_000
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(cents).alias("reference_ns"), F.sum(F.when(F.col("event_id") % 2 == 0, cents)).alias("candidate_ns"), (4 * F.count_if(F.col("event_type") == "error") <= F.count("*")).alias("passed"))
    return own.select(F.col("user_id").cast("string").alias("case_id"), F.when(F.col("user_id") % 10 == 9, "control").otherwise("scored").alias("role"), "reference_ns", "candidate_ns", "passed", F.lit(True).alias("reference_passed"))


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases that ought to run: (case_id, role)."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(F.col("user_id").cast("string").alias("case_id"), F.when(F.col("user_id") % 10 == 9, "control").otherwise("scored").alias("role"))
