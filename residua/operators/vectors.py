"""Dense vectors as (case_id, i, x); several at once with a name each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions.numeric import largest

_KEY = ["case_id", "i"]


def constant(indices: DataFrame, value: float = 0.0) -> DataFrame:
    """A vector of one value over ``indices(case_id, i)``."""
    return indices.select(*_KEY, F.lit(value).alias("x"))


def scale(alpha: float, x: DataFrame) -> DataFrame:
    return x.select(*_KEY, (alpha * F.col("x")).alias("x"))


def axpy(alpha: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """alpha x + y."""
    return x.join(y.select(*_KEY, F.col("x").alias("y")), _KEY).select(*_KEY, (alpha * F.col("x") + F.col("y")).alias("x"))


def mass_axpy(weights: dict[str, float], basis: DataFrame, y: DataFrame) -> DataFrame:
    """y plus the weighted sum of the vectors of ``basis(case_id, name, i, x)``: one aggregation."""
    weight = F.coalesce(*[F.when(F.col("name") == n, F.lit(w)) for n, w in weights.items()])
    terms = basis.where(F.col("name").isin(*weights)).select(*_KEY, (weight * F.col("x")).alias("x"))
    return terms.unionByName(y.select(*_KEY, "x")).groupBy(*_KEY).agg(F.sum("x").alias("x"))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """(case_id, dot)."""
    return x.join(y.select(*_KEY, F.col("x").alias("y")), _KEY).groupBy("case_id").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))


def mass_dot(basis: DataFrame, *others: tuple[str, DataFrame]) -> DataFrame:
    """The inner products of each vector of ``basis(case_id, name, i, x)`` with each
    of the others, in one pass: (case_id, name, others' names...)."""
    joined = basis
    for n, o in others:
        joined = joined.join(o.select(*_KEY, F.col("x").alias(f"__{n}")), _KEY)
    return joined.groupBy("case_id", "name").agg(*[F.sum(F.col("x") * F.col(f"__{n}")).alias(n) for n, _ in others])


def tagged_dot(x: DataFrame, y: DataFrame, tags: DataFrame) -> DataFrame:
    """Inner products within each tag of ``tags(case_id, i, tag)``: (case_id, tag, dot)."""
    joined = x.join(y.select(*_KEY, F.col("x").alias("y")), _KEY).join(tags, _KEY)
    return joined.groupBy("case_id", "tag").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))


def max_abs(x: DataFrame) -> DataFrame:
    """(case_id, max_abs)."""
    return x.groupBy("case_id").agg(largest(F.col("x")).alias("max_abs"))


def norm(x: DataFrame) -> DataFrame:
    """(case_id, norm): the L2 norm, scaled so that it does not overflow early."""
    top = max_abs(x)
    scaled = x.join(top, "case_id").groupBy("case_id", "max_abs").agg(F.sum(F.pow(F.try_divide("x", "max_abs"), 2)).alias("squares"))
    return scaled.select("case_id", F.when(F.col("max_abs") == 0, 0.0).otherwise(F.col("max_abs") * F.sqrt("squares")).alias("norm"))


def diagonal_scale(diagonal: DataFrame, r: DataFrame) -> DataFrame:
    """r divided by the diagonal, element by element; null where it is zero or missing."""
    return r.join(diagonal.select(*_KEY, F.col("x").alias("d")), _KEY, "left").select(*_KEY, F.try_divide("x", "d").alias("x"))
