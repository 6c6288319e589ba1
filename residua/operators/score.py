"""From verdicts to scores and a report."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residua.functions.numeric import is_finite
from residua.operators.matrix import SPAN


def paired(results: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """One row for each of ``keys``, by default the case, from ``results(keys..., role,
    passed, failure, elapsed_ns)``, role being 'reference' or 'candidate'."""
    pick = lambda role, column: F.max(F.when(F.col("role") == role, F.col(column)))
    return results.groupBy(*keys).agg(pick("candidate", "passed").alias("passed"), pick("candidate", "elapsed_ns").alias("candidate_ns"), pick("candidate", "failure").alias("failure"), pick("reference", "elapsed_ns").alias("reference_ns"), pick("reference", "passed").alias("reference_passed"))


def reference_failures(rows: DataFrame) -> DataFrame:
    """Cases whose fixed reference did not pass; any row makes an evaluation void."""
    return rows.where(~F.coalesce("reference_passed", F.lit(True))).select("case_id")


def require_references(rows: DataFrame) -> DataFrame:
    """The rows, or an error as soon as a reference among them has failed."""
    fine = F.assert_true(F.coalesce("reference_passed", F.lit(True)), F.concat(F.lit("the fixed reference failed on "), F.col("case_id")))
    return rows.withColumn("__fine", fine).where(F.col("__fine").isNull()).drop("__fine")


def case_speedups(rows: DataFrame) -> DataFrame:
    """``rows`` with speedup: reference over candidate, where the candidate passed."""
    return rows.withColumn("speedup", F.when(F.col("passed"), F.try_divide(F.col("reference_ns").cast("double"), F.col("candidate_ns").cast("double"))))


def completeness(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """A one-row frame whether the cases of ``rows`` are those of ``plan``, each once."""
    left = plan.select("case_id").withColumn("p", F.lit(1))
    right = rows.select("case_id").withColumn("r", F.lit(1))
    counts = left.unionByName(right, allowMissingColumns=True).groupBy("case_id").agg(F.count("p").alias("p"), F.count("r").alias("r"))
    return counts.agg(F.coalesce(F.bool_and((F.col("p") == 1) & (F.col("r") == 1)), F.lit(True)).alias("complete"))


def in_order(rows: DataFrame) -> DataFrame:
    """(ordered): whether rows(case_id, idx, position) stand in the order of the plan.

    Judged in spans of ``SPAN`` positions: within a span by a window, and between
    spans by their ends, so that only one row for each span meets in one task.
    """
    held = rows.withColumn("span", F.expr(f"position div {SPAN}"))
    prev = F.lag("idx").over(Window.partitionBy("span").orderBy("position"))
    fine = held.select("span", "idx", "position", F.coalesce(prev < F.col("idx"), F.lit(True)).alias("fine"))
    ends = fine.groupBy("span").agg(F.bool_and("fine").alias("fine"), F.min_by("idx", "position").alias("first"), F.max_by("idx", "position").alias("last"))
    before = F.lag("last").over(Window.orderBy("span"))
    between = ends.select((F.col("fine") & F.coalesce(before < F.col("first"), F.lit(True))).alias("fine"))
    return between.agg(F.coalesce(F.bool_and("fine"), F.lit(True)).alias("ordered"))


def cases_solved(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The score of the mesh family: (value, solved_cases, evaluated_cases,
    total_cases, complete, all_passed).  Controls are not counted; the value is
    null unless every case of the plan was run."""
    scored = F.col("role") == "scored"
    own = rows.agg(F.count_if(scored & F.col("passed")).alias("solved_cases"), F.count_if(scored).alias("evaluated_cases"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"))
    total = plan.agg(F.count_if(F.coalesce("role", F.lit("scored")) == "scored").alias("total_cases"))
    one = own.crossJoin(total).crossJoin(completeness(rows, plan))  # three frames of one row
    return one.select(F.when(F.col("complete"), F.col("solved_cases")).alias("value"), "solved_cases", "evaluated_cases", "total_cases", "complete", "all_passed")


def runtime_speedup(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The score of the replay family: (value, total_reference_ns,
    total_candidate_ns, complete, all_passed).  It is the ratio of the sums, over
    scored cases, and null unless every case, controls too, was run and passed."""
    scored = F.col("role") == "scored"
    total = lambda c: F.sum(F.when(scored, F.col(c)))
    sound = F.coalesce(F.bool_and(F.when(scored, (F.col("reference_ns") > 0) & (F.col("candidate_ns") > 0))), F.lit(False))
    own = rows.agg(total("reference_ns").alias("r"), total("candidate_ns").alias("c"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"), F.count_if(scored).alias("scored"), sound.alias("sound"))
    one = own.crossJoin(completeness(rows, plan))  # two frames of one row
    counts = F.col("complete") & F.col("all_passed") & (F.col("scored") > 0) & F.col("sound")
    ratio = F.try_divide(F.col("r").cast("double"), F.col("c").cast("double"))
    return one.select(F.when(counts, ratio).alias("value"), F.when(counts, F.col("r")).alias("total_reference_ns"), F.when(counts, F.col("c")).alias("total_candidate_ns"), "complete", "all_passed")


def best_candidates(rows: DataFrame, keys: list[str], value: str, ties: list[str]) -> DataFrame:
    """The best row of each key by ``value``, ties to the first by ``ties``."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(value), *ties)
    return rows.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")


def statistics(runs: DataFrame) -> DataFrame:
    """(role, passed, runs, total_seconds, longest_seconds, share) of
    runs(role, passed, seconds): share of the seconds of all runs."""
    own = runs.groupBy("role", "passed").agg(F.count("*").alias("runs"), F.sum("seconds").alias("total_seconds"), F.max("seconds").alias("longest_seconds"))
    whole = own.agg(F.sum("total_seconds").alias("whole"))
    return own.crossJoin(whole).withColumn("share", F.try_divide("total_seconds", "whole")).drop("whole")  # a row for each role and outcome, and one


def report(summary: DataFrame, head: dict, rows: DataFrame | None = None, official_venue: str = "", venue: str = "local") -> str:
    """A report as JSON text: sorted keys, two spaces, and null in the place of
    numbers that are not finite."""
    body = {**head, **summary.first().asDict(recursive=True)}
    body["official"] = bool(body.get("complete")) and venue == official_venue
    body["venue"] = venue
    if rows is not None:
        body["cases"] = [r.asDict(recursive=True) for r in rows.orderBy("case_id").toLocalIterator()]
    return json.dumps(_finite(body), indent=2, sort_keys=True, allow_nan=False) + "\n"


def _finite(value):
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_finite(v) for v in value]
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    return value


def finite_columns(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` with null in the place of numbers that are not finite."""
    return rows.withColumns({n: F.when(is_finite(F.col(n)), F.col(n)) for n in names})
