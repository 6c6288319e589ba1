"""The two roles of a case brought together as their verdicts arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("passed", "failure", "elapsed_ns", "at")


def paired(verdicts: DataFrame, wait: str = "1 hour") -> DataFrame:
    """A row for each case of a stream (or table) of verdicts(case_id, role, passed,
    failure, elapsed_ns, at): case_id, passed, failure, candidate_ns, reference_ns,
    speedup, at.

    It appears when both roles are there, at most ``wait`` apart; a role that is still
    missing when the stream's time has gone ``wait`` past the other one makes the
    case fail.  The state is one row for each role that waits, and goes when the
    watermark has passed it.  A repeated verdict pairs with each of the other role.
    """

    def side(role: str, mark: str) -> DataFrame:
        own = verdicts.where(F.col("role") == role).select(F.col("case_id").alias(f"{mark}_case"), *[F.col(f).alias(f"{mark}_{f}") for f in FIELDS])
        return own.withWatermark(f"{mark}_at", wait)

    near = F.expr(f"c_case = r_case AND r_at >= c_at - INTERVAL {wait} AND r_at <= c_at + INTERVAL {wait}")
    both = side("candidate", "c").join(side("reference", "r"), near, "full_outer")
    failure = (
        F.when(F.col("c_case").isNull(), F.lit(f"no candidate within {wait}"))
        .when(F.col("r_case").isNull(), F.lit(f"no reference within {wait}"))
        .when(~F.coalesce("r_passed", F.lit(False)), F.concat(F.lit("the fixed reference failed: "), F.coalesce("r_failure", F.lit("no reason given"))))
        .when(~F.coalesce("c_passed", F.lit(False)), F.coalesce("c_failure", F.lit("no reason given")))
    )
    speedup = F.when(failure.isNull(), F.try_divide(F.col("r_elapsed_ns").cast("double"), F.col("c_elapsed_ns").cast("double")))
    return both.select(
        F.coalesce("c_case", "r_case").alias("case_id"), failure.isNull().alias("passed"), failure.alias("failure"),
        F.col("c_elapsed_ns").alias("candidate_ns"), F.col("r_elapsed_ns").alias("reference_ns"), speedup.alias("speedup"), F.greatest("c_at", "r_at").alias("at"),
    )
