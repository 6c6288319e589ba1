"""Pass or fail: accuracy limits of a family, and the order of failures of a run.

The sentences that name a failure are values: reports are compared by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions.numeric import is_finite, short_general
from residua.schema import EPSILON, METRICS

# The limits of the two families.  'mesh' has limits of its own;
# 'replay' follows the tolerance of the case.
MESH = {METRICS[0]: 1e-10, METRICS[1]: 1e-8, METRICS[3]: 1e-5, METRICS[4]: 1e-5}
REPLAY_EPSILONS, REPLAY_MARGIN = 20, 1e-6
FAMILIES = ("mesh", "replay")


def limits(family: Column, tolerance: Column) -> dict[str, Column]:
    """For each metric, in the order of judgement, its limit; null if not judged."""
    mesh, replay = family == "mesh", family == "replay"
    follow = {METRICS[0]: F.greatest(tolerance, F.lit(REPLAY_EPSILONS * EPSILON)), METRICS[2]: tolerance * (1 + REPLAY_MARGIN)}
    return {m: F.when(mesh, F.lit(MESH.get(m)).cast("double")).when(replay, follow.get(m, F.lit(None).cast("double"))) for m in METRICS}


def accuracy_failure(family: Column, tolerance: Column, metric: dict[str, Column] | None = None) -> Column:
    """The first failure among the metrics, or null: a value that is missing or not
    finite is invalid, one above its limit exceeds it, one at its limit passes."""
    metric = metric or {m: F.col(m) for m in METRICS}
    checks = []
    for name, limit in limits(family, tolerance).items():
        value = metric[name]
        bad = F.when(~is_finite(value), F.lit(f"invalid {name}")).when(value > limit, F.concat(F.lit(f"{name} exceeds "), short_general(limit)))
        checks.append(F.when(limit.isNotNull(), bad))
    return F.when(~family.isin(*FAMILIES), F.lit("unknown family")).otherwise(F.coalesce(*checks))


def accuracy(measured: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, passed, failure) of every case of cases(case_id, family, tolerance);
    one that was not measured fails as one whose errors are missing."""
    joined = cases.select("case_id", "family", "tolerance").join(measured, "case_id", "left")
    failure = accuracy_failure(F.col("family"), F.col("tolerance"))
    return joined.select("case_id", failure.isNull().alias("passed"), failure.alias("failure"))


def cascade(runs: DataFrame) -> DataFrame:
    """The verdict of each run, failing closed.

    ``runs`` has returncode, has_output, decode_error, status, mutated, finite,
    measured (whether metrics could be had), family, tolerance and the metrics;
    ``passed`` and ``failure`` are added.  The order of the tests counts: what
    fails first names the failure.
    """
    c = F.col
    failure = (
        F.when(F.coalesce(c("returncode") != 0, F.lit(True)), "process failed")
        .when(~F.coalesce(c("has_output"), F.lit(False)), "missing driver output")
        .when(c("decode_error").isNotNull(), c("decode_error"))
        .when(F.coalesce(c("status") != 0, F.lit(True)), "solver returned an error")
        .when(F.coalesce(c("mutated"), F.lit(True)), "solver mutated its input")
        .when(~F.coalesce(c("finite"), F.lit(False)), "solution is not finite")
        .when(~F.coalesce(c("measured"), F.lit(False)), "verification failed")
        .otherwise(accuracy_failure(c("family"), c("tolerance")))
    )
    return runs.withColumn("failure", failure).withColumn("passed", c("failure").isNull())


def decode_checks(size: Column, expected: Column, header_ok: Column, elapsed: Column, create: Column, setup: Column, solve: Column, mutated: Column) -> Column:
    """The error of a decoded output, or null: its size, its header, its timings."""
    return (
        F.when(size != expected, "driver output has the wrong size")
        .when(~header_ok, "driver output header is invalid")
        .when(~mutated.isin(0, 1) | (elapsed <= 0) | (create + setup + solve != elapsed), "driver timing or mutation fields are invalid")
    )
