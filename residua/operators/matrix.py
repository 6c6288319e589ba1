"""Sparse matrices as coordinate entries: (case_id, row, col, val).

A canonical matrix has one entry for each place and no zeros.  ``sizes`` has
(case_id, n).  Everything is an equi-join or an aggregation on (case_id, row)
or (case_id, col), so one large case spreads like many small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.functions.numeric import is_finite, largest
from residua.functions.spreading import spread
from residua.schema import LARGEST

SPAN = 1 << 16


def canonicalize(entries: DataFrame) -> DataFrame:
    """Sum entries of one place; leave out those that sum to zero."""
    return entries.groupBy("case_id", "row", "col").agg(F.sum("val").alias("val")).where("val <> 0")


def transpose(entries: DataFrame) -> DataFrame:
    return entries.select("case_id", F.col("col").alias("row"), F.col("row").alias("col"), "val")


def _indices(sizes: DataFrame) -> DataFrame:
    spans = sizes.where("n > 0").select("case_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {SPAN}"))).alias("span"))
    first = F.col("span") * SPAN
    return spread(spans).select("case_id", F.explode(F.sequence(first, F.least(first + SPAN, F.col("n")) - 1)).alias("i"))


def dense(sizes: DataFrame) -> DataFrame:
    """Every index of every case: (case_id, i), in spans so that no array is long and no
    task has them all.  Spark takes the rows for as few as the sizes that they come
    from, so joins are told not to broadcast them."""
    return _indices(sizes).hint("merge")


def running_total(rows: DataFrame, value: str, out: str) -> DataFrame:
    """The sum of ``value`` over the rows of smaller i in the case, by spans of
    ``SPAN`` indices, so that one case is not one task."""
    held = rows.withColumn("span", F.expr(f"i div {SPAN}"))
    before = held.groupBy("case_id", "span").agg(F.sum(value).alias("here"))
    ahead = Window.partitionBy("case_id").orderBy("span")
    before = before.withColumn("ahead", F.sum("here").over(ahead) - F.col("here")).drop("here")
    inner = Window.partitionBy("case_id", "span").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = held.withColumn("local", F.sum(value).over(inner) - F.col(value))
    return local.join(before, ["case_id", "span"]).withColumn(out, F.col("ahead") + F.col("local")).drop("span", "ahead", "local")


def row_offsets(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Start of each row in row-compressed order: (case_id, i, count, start)."""
    places = entries.select("case_id", F.col("row").alias("i"), F.lit(1).alias("count")).unionByName(_indices(sizes).withColumn("count", F.lit(0)))
    full = places.groupBy("case_id", "i").agg(F.sum("count").alias("count"))
    return running_total(full, "count", "start")


def stats(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """(case_id, n, nnz, max_abs, min_row_nnz, max_row_nnz, diagonals)."""
    own = entries.groupBy("case_id").agg(F.count("*").alias("nnz"), largest(F.col("val")).alias("max_abs"), F.count_if(F.col("row") == F.col("col")).alias("diagonals"))
    rows = entries.groupBy("case_id", "row").agg(F.count("*").alias("k")).groupBy("case_id").agg(F.min("k").alias("low"), F.max("k").alias("max_row_nnz"), F.count("*").alias("filled"))
    joined = sizes.select("case_id", "n").join(own, "case_id", "left").join(rows, "case_id", "left")
    zero = F.lit(0).cast("long")
    return joined.select("case_id", "n", F.coalesce("nnz", zero).alias("nnz"), F.coalesce("max_abs", F.lit(0.0)).alias("max_abs"), F.when(F.coalesce("filled", zero) < F.col("n"), zero).otherwise(F.coalesce("low", zero)).alias("min_row_nnz"), F.coalesce("max_row_nnz", zero).alias("max_row_nnz"), F.coalesce("diagonals", zero).alias("diagonals"))


def violations(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Entries, in the order they are stored, that break the rules of a canonical
    matrix: (case_id, rule, count).  ``entries`` may have ``pos``, their place
    in storage; without it, order is not judged, but repeats are."""
    where = entries.join(sizes.select("case_id", "n"), "case_id", "left")
    bad = [
        ("unknown case", F.col("n").isNull()),
        ("size out of range", (F.col("n") <= 0) | (F.col("n") > LARGEST)),
        ("row out of range", (F.col("row") < 0) | (F.col("row") >= F.col("n"))),
        ("column out of range", (F.col("col") < 0) | (F.col("col") >= F.col("n"))),
        ("value not finite", ~is_finite(F.col("val"))),
        ("explicit zero", F.col("val") == 0),
    ]
    if "pos" in entries.columns:
        prev = Window.partitionBy("case_id", "row").orderBy("pos")
        bad.append(("columns not increasing", F.coalesce(F.lag("col").over(prev) >= F.col("col"), F.lit(False))))
    else:
        bad.append(("repeated place", F.row_number().over(Window.partitionBy("case_id", "row", "col").orderBy("val")) > 1))
    flagged = where.select("case_id", *[F.coalesce(test, F.lit(False)).cast("int").alias(f"t{k}") for k, (_, test) in enumerate(bad)])
    counts = flagged.groupBy("case_id").agg(*[F.sum(f"t{k}").alias(f"t{k}") for k in range(len(bad))])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"t{k}").alias("count")) for k, (name, _) in enumerate(bad)])
    return counts.select("case_id", F.inline(pairs)).where("count > 0")


def product(entries: DataFrame, vector: DataFrame, sizes: DataFrame, *sums: tuple[str, Column]) -> DataFrame:
    """For each row the ``sums`` over its entries, where val is the entry and x the
    vector at its column; rows with no entries get 0: (case_id, i, names...).

    The indices of all rows go through the same aggregation as the entries."""
    named = vector.select("case_id", F.col("i").alias("col"), "x")
    terms = entries.join(named, ["case_id", "col"]).select("case_id", F.col("row").alias("i"), *[c.alias(n) for n, c in sums])
    zeros = _indices(sizes).select("case_id", "i", *[F.lit(0.0).alias(n) for n, _ in sums])
    return terms.unionByName(zeros).groupBy("case_id", "i").agg(*[F.sum(n).alias(n) for n, _ in sums])


def matvec(entries: DataFrame, vector: DataFrame, sizes: DataFrame, name: str = "y") -> DataFrame:
    """A x: (case_id, i, y)."""
    return product(entries, vector, sizes, (name, F.col("val") * F.col("x")))


def matvec_axpby(alpha: float, entries: DataFrame, x: DataFrame, beta: float, y: DataFrame, sizes: DataFrame, transposed: bool = False) -> DataFrame:
    """alpha A x + beta y, or with A transposed: (case_id, i, y)."""
    made = matvec(transpose(entries) if transposed else entries, x, sizes, "ax")
    return made.join(y.select("case_id", "i", F.col("x").alias("old")), ["case_id", "i"]).select("case_id", "i", (alpha * F.col("ax") + beta * F.col("old")).alias("y"))


def row_sums(entries: DataFrame) -> DataFrame:
    return entries.groupBy("case_id", "row").agg(F.sum(F.abs("val")).alias("total"))


def infinity_norm(entries: DataFrame) -> DataFrame:
    """(case_id, norm): the largest row sum of magnitudes."""
    return row_sums(entries).groupBy("case_id").agg(F.max("total").alias("norm"))


def one_norm(entries: DataFrame) -> DataFrame:
    """(case_id, norm): the largest column sum of magnitudes."""
    return infinity_norm(transpose(entries))


def asymmetry(entries: DataFrame, least: float = 1e-12) -> DataFrame:
    """(case_id, scale, asymmetry, nonsymmetric): the largest magnitude, the
    largest difference from the transpose, and whether it matters."""
    other = entries.select("case_id", F.col("col").alias("row"), F.col("row").alias("col"), F.col("val").alias("mirror"))
    both = entries.join(other, ["case_id", "row", "col"], "full").select("case_id", F.coalesce("val", F.lit(0.0)).alias("val"), F.coalesce("mirror", F.lit(0.0)).alias("mirror"))
    out = both.groupBy("case_id").agg(largest(F.col("val")).alias("scale"), largest(F.col("val") - F.col("mirror")).alias("asymmetry"))
    return out.withColumn("nonsymmetric", (F.col("scale") != 0) & (F.col("asymmetry") > least * F.col("scale")))


def diagonal(entries: DataFrame) -> DataFrame:
    return entries.where("row = col").select("case_id", F.col("row").alias("i"), F.col("val").alias("x"))


def with_dominant_diagonal(off: DataFrame, sizes: DataFrame, weight=lambda total: 1 + total) -> DataFrame:
    """``off``, which has no diagonal, and a diagonal entry for each row: ``weight`` of
    the sum of the row's magnitudes, by default one more.  One aggregation by row."""
    rows = off.select("case_id", F.col("row").alias("i"), F.abs("val").alias("size")).unionByName(_indices(sizes).withColumn("size", F.lit(0.0)))
    total = rows.groupBy("case_id", "i").agg(F.sum("size").alias("total"))
    return off.unionByName(total.select("case_id", F.col("i").alias("row"), F.col("i").alias("col"), weight(F.col("total")).alias("val")))
