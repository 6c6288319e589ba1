"""Selection of cases and the checks of manifests, executions and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions.numeric import is_finite
from residua.schema import LARGEST

HEX_DIGEST = "^[0-9a-f]{64}$"
# Fixed value: what a submission may be called.
SUBMISSION_NAME = "^[a-z0-9][a-z0-9_-]{1,63}$"
ROLES = ("scored", "control")


def select_cases(cases: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The cases whose id is wanted, in the order of the manifest; all if None."""
    chosen = cases if wanted is None else cases.join(wanted.select("case_id").distinct(), "case_id", "left_semi")
    return chosen.orderBy("idx")


def unknown_cases(cases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted ids that are no case: (case_id)."""
    return wanted.select("case_id").distinct().join(cases.select("case_id"), "case_id", "left_anti")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that several rows hold: (key, count)."""
    return rows.groupBy(key).agg(F.count("*").alias("count")).where("count > 1")


def manifest_violations(cases: DataFrame) -> DataFrame:
    """(case_id, rule) of cases that break a rule of manifests.

    ``cases`` has position (from 0) beside the columns of a case.
    """
    c = F.col
    rules = [
        ("index is not its position", ~c("idx").eqNullSafe(c("position"))),
        ("size is not positive", ~F.coalesce((c("n") > 0) & (c("n") <= LARGEST), F.lit(False))),
        ("entries are not positive", ~F.coalesce((c("nnz") > 0) & (c("nnz") <= LARGEST), F.lit(False))),
        ("tolerance is not between 0 and 1", ~F.coalesce(is_finite(c("tolerance")) & (c("tolerance") > 0) & (c("tolerance") < 1), F.lit(False))),
        ("role is unknown", ~F.coalesce(c("role").isin(*ROLES), F.lit(False))),
        ("digest is malformed", ~F.coalesce(c("input_sha256").rlike(HEX_DIGEST), F.lit(False))),
    ]
    own = cases.select("case_id", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules])).alias("rules"))
    twice = repeated(cases, "case_id").select("case_id", F.lit("id is repeated").alias("rule"))
    return own.select("case_id", F.explode("rules").alias("rule")).unionByName(twice)


def coverage(plan: DataFrame, found: DataFrame) -> DataFrame:
    """Runs that are missing or foreign: (case_id, role, problem)."""
    key = ["case_id", "role"]
    missing = plan.select(*key).distinct().join(found.select(*key), key, "left_anti").withColumn("problem", F.lit("missing"))
    foreign = found.select(*key).distinct().join(plan.select(*key), key, "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(foreign)


def forbidden(names: DataFrame, *allowed: DataFrame) -> DataFrame:
    """Names in none of the allowed sets: (name)."""
    union = allowed[0].select("name")
    for more in allowed[1:]:
        union = union.union(more.select("name"))
    return names.select("name").distinct().join(union.distinct(), "name", "left_anti")


def common(*names: DataFrame) -> DataFrame:
    """Names that are in every one of the sets: (name)."""
    out = names[0].select("name").distinct()
    for more in names[1:]:
        out = out.join(more.select("name").distinct(), "name", "left_semi")
    return out


def merged(first: Column, second: Column) -> Column:
    """The map of both maps' fields; where both have one, that of the second."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k)), second)


def _flagged(rows: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    return rows.select(key, F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))).alias("rule"))


def execution_violations(executions: DataFrame) -> DataFrame:
    """(case_id, rule) of executions(case_id, returncode, wall_seconds, diagnostics)
    that no process can have left."""
    c = F.col
    return _flagged(executions, "case_id", [
        ("there is no return code", c("returncode").isNull()),
        ("seconds are not finite and positive", ~F.coalesce(is_finite(c("wall_seconds")) & (c("wall_seconds") >= 0), F.lit(False))),
        ("there are no diagnostics", c("diagnostics").isNull()),
    ])


def input_violations(cases: DataFrame, vectors: DataFrame) -> DataFrame:
    """(case_id, rule) of cases(case_id, n, tolerance) whose id, tolerance or
    vectors(case_id, i, b, x0) are not fit for a solver."""
    c = F.col
    found = vectors.groupBy("case_id").agg(F.count("*").alias("rows"), F.min("i").alias("first"), F.max("i").alias("last"), F.countDistinct("i").alias("places"), F.bool_and(is_finite(c("b")) & is_finite(c("x0"))).alias("finite"))
    whole = (c("rows") == c("n")) & (c("places") == c("n")) & (c("first") == 0) & (c("last") == c("n") - 1)
    return _flagged(cases.join(found, "case_id", "left"), "case_id", [
        ("id is not ASCII", ~F.coalesce(c("case_id").rlike(r"^[\x00-\x7f]+$"), F.lit(False))),
        ("tolerance is not between 0 and 1", ~F.coalesce((c("tolerance") > 0) & (c("tolerance") < 1), F.lit(False))),
        ("vectors are not as long as the matrix", ~F.coalesce(whole, F.lit(False))),
        ("vectors are not finite", ~F.coalesce(c("finite"), F.lit(True))),
    ])


def resource_violations(executions: DataFrame, unit: int = 1 << 20) -> DataFrame:
    """(name, rule) of machines(name, cpus, memory_bytes) that cannot be asked for."""
    c = F.col
    return _flagged(executions, "name", [
        ("cpus are not positive", ~F.coalesce(is_finite(c("cpus")) & (c("cpus") > 0), F.lit(False))),
        ("memory is not a positive multiple of a mebibyte", ~F.coalesce((c("memory_bytes") > 0) & (c("memory_bytes") % unit == 0), F.lit(False))),
    ])


def changed_metadata(stated: DataFrame, found: DataFrame, key: str = "case_id") -> DataFrame:
    """Fields in which two tables of the same columns differ, null-safe: (key, field)."""
    fields = [f for f in stated.columns if f != key]
    other = found.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = stated.join(other, key)
    differs = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), F.lit(f)) for f in fields]))
    return joined.select(key, F.explode(differs).alias("field"))


def tail_of_diagnostics(executions: DataFrame, most: int) -> DataFrame:
    """Executions with the last ``most`` characters of their diagnostics."""
    return executions.withColumn("diagnostics", F.right("diagnostics", F.lit(most)))


def source_violations(sources: DataFrame, most_bytes: int = 65_536) -> DataFrame:
    """(name, rule) of solver sources (name, text) that may not be built."""
    text = F.col("text")
    includes = F.regexp_count(text, F.lit(r"(?m)^[ \t]*#[ \t]*include\b"))
    rules = [("too long", F.octet_length(text) > most_bytes), ("line ends are not LF", text.contains("\r")), ("holds NUL", text.contains("\0")), ("must include exactly one header", includes != 1)]
    return sources.select("name", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules]))).alias("rule"))


def submission_violations(submissions: DataFrame, families: list[str]) -> DataFrame:
    """(name, rule) of submissions (name, submitter, families array<string>)."""
    c = F.col
    rules = [
        ("name is malformed", ~F.coalesce(c("name").rlike(SUBMISSION_NAME), F.lit(False))),
        ("submitter is blank", F.coalesce(F.trim("submitter") == "", F.lit(True))),
        ("no family", F.coalesce(F.size("families") == 0, F.lit(True))),
        ("unknown family", F.coalesce(F.size(F.array_except("families", F.array(*map(F.lit, families)))) > 0, F.lit(False))),
    ]
    return submissions.select("name", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules]))).alias("rule"))
