"""Verification as executions arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from residua.operators.metrics import finite_solutions, metrics
from residua.operators.solve import solutions
from residua.operators.verdict import cascade
from residua.schema import EXECUTIONS, METRICS
from residua.sources.wire import decode_outputs


def judge(executions: DataFrame, entries: DataFrame, b: DataFrame, target: DataFrame | None, cases: DataFrame) -> DataFrame:
    """Verdicts of executions: their columns, the decoded fields, metrics, passed, failure.

    Runs of several roles are judged apart: a run is named by its case and role.
    """
    decoded = decode_outputs(executions, cases)
    run = F.concat_ws("\0", "case_id", "role")
    named = decoded.withColumn("run", run)
    x = solutions(named.select(F.col("run").alias("case_id"), "solution"))
    runs = named.select("case_id", "run")
    spread = lambda t: t.join(runs, "case_id").drop("case_id").withColumnRenamed("run", "case_id")
    measured = metrics(spread(entries), x, spread(b), spread(cases.select("case_id", "n")), None if target is None else spread(target)).withColumnRenamed("case_id", "run").withColumn("measured", F.lit(True))
    finite = finite_solutions(x).withColumnRenamed("case_id", "run")
    joined = named.join(measured, "run", "left").join(finite, "run", "left").join(cases.select("case_id", "family", "tolerance"), "case_id").withColumnRenamed("error", "decode_error")
    return cascade(joined).drop("run", "solution", "has_output", "decode_error", "finite", "measured", "family", "tolerance").select("case_id", "role", "passed", "failure", "status", "elapsed_ns", "create_ns", "setup_ns", "solve_ns", "mutated", *METRICS)


def watch(spark: SparkSession, folder: str, results: str, checkpoint: str, entries: DataFrame, b: DataFrame, target: DataFrame | None, cases: DataFrame) -> StreamingQuery:
    """Judge the executions that arrive as Parquet in ``folder`` and append the
    verdicts to ``results``; each file is judged once, also over restarts."""
    stream = spark.readStream.schema(EXECUTIONS).parquet(folder)

    def handle(batch: DataFrame, number: int) -> None:
        judge(batch, entries, b, target, cases).write.mode("overwrite").parquet(f"{results}/batch={number}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_scores(verdicts: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts of passed and failed runs in windows of arrival time ``at``, for a
    stream or a table of verdicts; rows later than ``delay`` are left out of a stream."""
    return verdicts.withWatermark("at", delay).groupBy(F.window("at", window), "role").agg(F.count_if("passed").alias("passed"), F.count("*").alias("runs"))
