"""Errors of a solution, measured without trusting the solver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions.numeric import is_finite, largest, norm_ratio, ratio_or_zero, safe_ratio, square_sums
from residua.schema import METRICS


#: Entries of a partition, about, where the session's number of partitions would make them larger.
ROWS = 1 << 20


def residuals(entries: DataFrame, x: DataFrame, b: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """For each row of b or x: (case_id, i, x, b, residual, spread, row_norm, target),
    where the residual is b - A x, the spread |A| |x| + |b|, and row_norm the row's
    sum of magnitudes.

    One join of the entries with x; then products, x, b and target meet in one
    aggregation by row.  A component that x lacks or holds twice gives null x and
    residual in its row: nothing is measured on part of a solution.
    """
    least, needed = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // ROWS)
    dealt = lambda frame, place: frame.repartition(needed, "case_id", place) if needed > least else frame
    val, xj = F.col("val"), F.col("xj")
    columns = ("ax", "abs_ax", "row_norm", "x", "b", "target")
    parts = [dealt(entries, "col").join(dealt(x.select("case_id", F.col("i").alias("col"), F.col("x").alias("xj")), "col"), ["case_id", "col"], "left").select("case_id", F.col("row").alias("i"), (val * xj).alias("ax"), (F.abs(val) * F.abs(xj)).alias("abs_ax"), F.abs(val).alias("row_norm"))]
    parts += [v.select("case_id", "i", F.col("x").alias(name)) for name, v in (("x", x), ("b", b), ("target", target)) if v is not None]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    if target is None:
        union = union.withColumn("target", F.lit(None).cast("double"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
    rows = dealt(union, "i").groupBy("case_id", "i").agg(*map(total, columns[:3]), *[F.max(c).alias(c) for c in columns[3:]], F.count("x").alias("xs"), F.count("b").alias("bs")).where("bs > 0 or xs > 0")
    own = F.when((F.col("xs") == 1) & (F.col("bs") == 1), F.col("x"))
    return rows.withColumn("x", own).select("case_id", "i", "x", "b", F.when(F.col("x").isNotNull(), F.col("b") - F.col("ax")).alias("residual"), (F.col("abs_ax") + F.abs("b")).alias("spread"), "row_norm", "target")


def metrics(entries: DataFrame, x: DataFrame, b: DataFrame, sizes: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """The five errors of each case of ``sizes``: case_id and the names of ``METRICS``.

    The forward errors are null for cases without a target.  All are null for a
    case whose solution, or whose b, has not exactly one component for each of
    its n rows.
    """
    rows = residuals(entries, x, b, target).withColumn("error", F.col("x") - F.col("target"))
    c = F.col
    made = rows.groupBy("case_id").agg(
        largest(c("residual")).alias("r_max"), largest(c("b")).alias("b_max"), largest(c("x")).alias("x_max"), largest(c("error")).alias("e_max"), largest(c("target")).alias("t_max"),
        F.max("row_norm").alias("a_norm"), F.max(ratio_or_zero(c("residual"), c("spread"))).alias("componentwise"),
        F.count("x").alias("known_x"), F.count("*").alias("rows"), (F.count("target") == F.count("*")).alias("known"),
        *[square_sums(c(v)).alias(f"{v}_squares") for v in ("residual", "b", "error", "target")],
    )
    whole = (c("known_x") == c("n")) & (c("rows") == c("n"))
    known = lambda value: F.when(c("known") & whole, value)
    return sizes.select("case_id", "n").join(made, "case_id", "left").select(
        "case_id",
        F.when(whole, safe_ratio(c("r_max"), c("a_norm") * c("x_max") + c("b_max"))).alias(METRICS[0]),
        F.when(whole, c("componentwise")).alias(METRICS[1]),
        F.when(whole, norm_ratio("residual_squares", "b_squares", c("r_max"), c("b_max"))).alias(METRICS[2]),
        known(norm_ratio("error_squares", "target_squares", c("e_max"), c("t_max"))).alias(METRICS[3]),
        known(safe_ratio(c("e_max"), c("t_max"))).alias(METRICS[4]),
    )


def finite_solutions(x: DataFrame) -> DataFrame:
    """(case_id, finite): whether every component is a finite number."""
    return x.groupBy("case_id").agg(F.bool_and(is_finite(F.col("x"))).alias("finite"))
