"""Inputs kept as Parquet under a key of their identities, checked when reused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions.digests import json_sha256


def bundle_key(cases: DataFrame) -> str:
    """The key of the cases (case_id, idx, input_sha256), in their order."""
    rows = cases.select("case_id", "input_sha256").orderBy("idx").collect()  # a manifest's cases: hundreds
    return json_sha256([[r[0], r[1]] for r in rows])


def store_bundle(cases: DataFrame, inputs: DataFrame, cache: str) -> tuple[DataFrame, bool]:
    """The inputs (case_id, input) of the cases, and whether they were there.

    A bundle whose write was completed is read again, and every member's digest is
    compared with that of the input as it is now; one that lacks, repeats or adds a
    case, or holds another input, is written anew.
    """
    spark = cases.sparkSession
    path = f"{cache.rstrip('/')}/{bundle_key(cases)}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        kept = spark.read.schema("case_id string, input binary").parquet(path)
        if holds(cases, kept, inputs):
            return kept, True
    inputs.select("case_id", "input").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), False


def holds(cases: DataFrame, kept: DataFrame, inputs: DataFrame) -> bool:
    """Whether ``kept`` has each of the cases once, with the bytes of ``inputs``."""
    theirs = kept.groupBy("case_id").agg(F.count("*").alias("times"), F.max(F.sha2("input", 256)).alias("found"))
    same = (F.col("times") == 1) & (F.col("found") == F.col("digest"))
    wrong = theirs.join(inputs.select("case_id", F.sha2("input", 256).alias("digest")), "case_id", "full_outer").where(~F.coalesce(same, F.lit(False)))
    return wrong.isEmpty() and not coverage_gap(cases, kept)


def coverage_gap(cases: DataFrame, kept: DataFrame) -> bool:
    """Whether the two tables do not have the same cases."""
    return bool(cases.join(kept, "case_id", "left_anti").limit(1).count() or kept.join(cases, "case_id", "left_anti").limit(1).count())
