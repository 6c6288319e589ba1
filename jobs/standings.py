"""Daily standings of solver runs, partitioned by day.

    python -m jobs.standings --runs IN --output OUT [--config jobs/standings.json]

Input is a log of runs with one row for each run of a case; the configuration says,
by SQL expressions over the log's own columns, what its case, role (candidate or
reference), time, order, result and elapsed nanoseconds are.  Of each case and role
the last run of a day counts.  ``cases/day=...`` has for each case of a day both
roles' times, the speedup, the best candidate time of earlier days and whether the
case has become slower than that by more than the tolerated share;
``days/day=...`` has the score of each day: how many cases are solved and the ratio
of summed times over those that both roles have passed.

The job reads the whole log, because a late row may change any day, and replaces
only those days that it has rows for (dynamic partition overwrite): a day whose log
has been archived stays.  Cases are written first and days are derived from them, so
a run after a lost one makes up for it; reruns give the same files' content.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import command, fresh_folder, logger, settings_of, table_or_none
from residua.operators import score

CONFIG = os.path.splitext(os.path.abspath(__file__))[0] + ".json"
#: Expressions over the log, and the share by which a case may become slower.
DEFAULTS = {"case_id": "case_id", "role": "role", "at": "at", "nth": "nth", "passed": "passed", "failure": "failure", "elapsed_ns": "elapsed_ns", "slower": 0.25}
CASES = "case_id string, passed boolean, failure string, candidate_ns long, reference_passed boolean, reference_ns long, speedup double, best_before_ns long, slower boolean, day date"
DAYS = "cases long, solved long, slower long, compared long, reference_ns long, candidate_ns long, speedup double, day date"

_log = logger("standings")


def runs_of(log: DataFrame, settings: dict) -> DataFrame:
    """The log's rows as runs: (day, case_id, role, at, nth, passed, failure, elapsed_ns);
    rows without a case, a role of the two, or a time are no runs."""
    kinds = {"case_id": "string", "role": "string", "at": "timestamp_ntz", "nth": "long", "passed": "boolean", "failure": "string", "elapsed_ns": "long"}
    runs = log.select(*[F.expr(settings[name]).cast(kind).alias(name) for name, kind in kinds.items()])
    return runs.where(F.col("case_id").isNotNull() & F.col("at").isNotNull() & F.col("role").isin("candidate", "reference")).withColumn("day", F.to_date("at"))


def last_runs(runs: DataFrame) -> DataFrame:
    """Of each day, case and role the run of greatest (at, nth); of equal ones the one
    that failed or was slower.  A partial aggregate: no case's runs meet in one task."""
    order = F.struct("at", "nth", (~F.coalesce("passed", F.lit(False))).alias("failed"), "elapsed_ns", "failure")
    return runs.groupBy("day", "case_id", "role").agg(F.max(order).alias("last")).select("day", "case_id", "role", (~F.col("last.failed")).alias("passed"), "last.failure", "last.elapsed_ns")


def daily_cases(runs: DataFrame, slower: float) -> DataFrame:
    """One row for each day and case (``CASES``)."""
    rows = score.case_speedups(score.paired(last_runs(runs), ("day", "case_id")).withColumn("passed", F.coalesce("passed", F.lit(False))))
    earlier = Window.partitionBy("case_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    best = rows.withColumn("best_before_ns", F.min(F.when(F.col("passed"), F.col("candidate_ns"))).over(earlier))
    worse = F.col("candidate_ns") > F.col("best_before_ns") * (1 + slower)
    return best.withColumn("slower", F.coalesce(F.col("passed") & worse, F.lit(False)))


def daily_scores(cases: DataFrame) -> DataFrame:
    """One row for each day (``DAYS``)."""
    both = F.col("passed") & F.coalesce("reference_passed", F.lit(False)) & (F.col("candidate_ns") > 0) & (F.col("reference_ns") > 0)
    total = lambda c: F.sum(F.when(both, F.col(c)))
    days = cases.groupBy("day").agg(F.count("*").alias("cases"), F.count_if("passed").alias("solved"), F.count_if("slower").alias("slower"), F.count_if(both).alias("compared"), total("reference_ns").alias("reference_ns"), total("candidate_ns").alias("candidate_ns"))
    return days.withColumn("speedup", F.try_divide(F.col("reference_ns").cast("double"), F.col("candidate_ns").cast("double")))


def _write(frame: DataFrame, path: str) -> None:
    frame.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def run(spark: SparkSession, log: str, output: str, config: str | None = None) -> dict:
    """Write the standings of every day of the log; counts of what was read and written."""
    settings = settings_of(spark, config, DEFAULTS)
    runs = runs_of(spark.read.parquet(log), settings)
    read = runs.count()  # of few columns
    _log.info("read %d runs from %s", read, log)
    _write(daily_cases(runs, settings["slower"]), f"{output}/cases")
    cases = table_or_none(spark, f"{output}/cases", CASES)
    if cases is None:
        return {"runs": read, "days": 0, "cases": 0}
    _write(daily_scores(cases), f"{output}/days")
    days = spark.read.schema(DAYS).parquet(f"{output}/days")
    wrote = days.agg(F.count("*").alias("days"), F.coalesce(F.sum("cases"), F.lit(0)).alias("cases"), F.coalesce(F.sum("slower"), F.lit(0)).alias("slower")).first()
    _log.info("standings of %d days and %d cases, %d of them slower than before, are at %s", wrote["days"], wrote["cases"], wrote["slower"], output)
    return {"runs": read, "days": wrote["days"], "cases": wrote["cases"]}


def result(spark: SparkSession, output: str) -> DataFrame:
    """Cases and days at ``output`` as one table: rows of a day have no case_id."""
    cases = table_or_none(spark, f"{output}/cases", CASES)
    days = table_or_none(spark, f"{output}/days", DAYS)
    counts = ("cases", "solved", "compared")
    zero = lambda name: F.lit(None).cast("long").alias(name)
    if cases is None or days is None:
        empty = spark.createDataFrame([], CASES)
        return empty.withColumn("slower", F.col("slower").cast("long")).select("*", *map(zero, counts))
    rows = cases.withColumn("slower", F.col("slower").cast("long")).select("*", *map(zero, counts))
    return rows.unionByName(days, allowMissingColumns=True)


def job2_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over the whole of ``events``, run twice into a new folder."""
    folder = fresh_folder(spark, "job2")
    for _ in range(2):
        run(spark, f"{sf_dir}/events.parquet", folder, CONFIG)
    return result(spark, folder)


ORACLE_SQL = """
WITH runs AS (
    SELECT CAST(user_id AS VARCHAR) AS case_id, CASE WHEN event_id % 2 = 0 THEN 'candidate' ELSE 'reference' END AS role, ts, event_id,
        event_type <> 'error' AS passed, CASE WHEN event_type = 'error' THEN 'error' END AS failure, CAST(round(value * 100) AS BIGINT) * 10000000 AS elapsed_ns, CAST(ts AS DATE) AS day
    FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
),
last AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY day, case_id, role ORDER BY ts DESC, event_id DESC, passed, elapsed_ns DESC) = 1),
pairs AS (
    SELECT day, case_id, coalesce(bool_or(passed) FILTER (role = 'candidate'), false) AS passed, max(failure) FILTER (role = 'candidate') AS failure, max(elapsed_ns) FILTER (role = 'candidate') AS candidate_ns,
        bool_or(passed) FILTER (role = 'reference') AS reference_passed, max(elapsed_ns) FILTER (role = 'reference') AS reference_ns
    FROM last GROUP BY day, case_id
),
best AS (SELECT *, min(CASE WHEN passed THEN candidate_ns END) OVER (PARTITION BY case_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before_ns FROM pairs),
cases AS (
    SELECT case_id, passed, failure, candidate_ns, reference_passed, reference_ns, CASE WHEN passed AND candidate_ns <> 0 THEN CAST(reference_ns AS DOUBLE) / CAST(candidate_ns AS DOUBLE) END AS speedup,
        best_before_ns, coalesce(passed AND candidate_ns > best_before_ns * CAST(1.25 AS DOUBLE), false) AS slower, day
    FROM best
),
days AS (
    SELECT day, count(*) AS cases, count(*) FILTER (passed) AS solved, count(*) FILTER (slower) AS slower, count(*) FILTER (passed AND reference_passed AND candidate_ns > 0 AND reference_ns > 0) AS compared,
        CAST(sum(reference_ns) FILTER (passed AND reference_passed AND candidate_ns > 0 AND reference_ns > 0) AS BIGINT) AS reference_ns, CAST(sum(candidate_ns) FILTER (passed AND reference_passed AND candidate_ns > 0 AND reference_ns > 0) AS BIGINT) AS candidate_ns
    FROM cases GROUP BY day
)
SELECT case_id, passed, failure, candidate_ns, reference_passed, reference_ns, speedup, best_before_ns, CAST(slower AS BIGINT) AS slower, day, CAST(NULL AS BIGINT) AS cases, CAST(NULL AS BIGINT) AS solved, CAST(NULL AS BIGINT) AS compared FROM cases
UNION ALL
SELECT NULL, NULL, NULL, candidate_ns, NULL, reference_ns, CAST(reference_ns AS DOUBLE) / CAST(candidate_ns AS DOUBLE), NULL, slower, day, cases, solved, compared FROM days
"""

ARGUMENTS = {"runs": "Parquet table of the log", "output": "folder that the standings are written to", "config": "a JSON file of settings"}


def main(argv: list[str] | None = None) -> int:
    return command("standings", __doc__, ARGUMENTS, lambda spark, a: run(spark, a.runs, a.output, a.config), argv)


if __name__ == "__main__":
    sys.exit(main())
