"""Sums of doubles that do not depend on order or partitions.

A double is a whole number of small units of its own size.  Numbers are dealt into
bins of thirty-two binades; inside a bin they are whole numbers of one unit, split
into two halves that integers hold, and integers add without rounding.  What is left
of a group is a few whole numbers for each bin, whose sum is rounded once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, BELOW, HALF = 32, 54, 43


def _total(bins: list[dict]) -> float:
    """The sum of what bins hold, rounded once.  A half of a bin is a whole number that
    is cut into pieces that doubles hold."""
    parts = []
    for b in bins:
        unit = WIDTH * b["bin"] - BELOW
        for whole, shift in ((int(b["high"]), unit + HALF), (int(b["low"]), unit)):
            sign, rest, k = (-1 if whole < 0 else 1), abs(whole), 0
            while rest:
                parts.append((sign * (rest & 0xFFFFFFFF), shift + k))
                rest, k = rest >> 32, k + 32
    if not parts:
        return 0.0
    least = min(shift for _, shift in parts)
    whole = sum(part << (shift - least) for part, shift in parts)
    try:
        return whole * 2.0**least if abs(whole) < 1 << 53 and least > -1000 else float(whole * (1 << max(least, 0))) if least >= 0 else whole / (1 << -least)
    except OverflowError:
        return math.copysign(math.inf, whole)


def exact_sums(rows: DataFrame, keys: list[str], value: str, out: str = "total") -> DataFrame:
    """(keys..., out): the sum of ``value`` in each group, as if added without rounding
    and rounded once.  Nulls are left out, and a group of nothing else is 0; NaN, or
    infinities of both signs, give NaN."""
    x = F.col(value).cast("double")
    special = F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    finite = F.when(x.isNotNull() & ~special & (x != 0), x)
    place = F.floor(F.log2(F.abs(finite)) / WIDTH).cast("int")
    up = (BELOW - WIDTH * F.col("__bin")).cast("double")
    # In two steps: one power of two may be out of range where the product is not.
    units = F.col("__x") * F.pow(F.lit(2.0), F.floor(up / 2)) * F.pow(F.lit(2.0), up - F.floor(up / 2))
    high = F.floor(units / F.lit(2.0**HALF))
    held = [F.col(f"`{k}`") for k in keys]
    own = rows.select(*held, finite.alias("__x"), place.alias("__bin"), F.when(special, x).alias("__special"))
    halves = own.select(*held, "__bin", "__special", high.cast("long").alias("__high"), (units - high.cast("double") * F.lit(2.0**HALF)).cast("long").alias("__low"))
    bins = halves.groupBy(*keys, "__bin").agg(F.sum(F.col("__high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("__low").cast("decimal(38,0)")).alias("low"), F.sum("__special").alias("special"))
    groups = bins.groupBy(*keys).agg(F.collect_list(F.when(F.col("high").isNotNull(), F.struct(F.col("__bin").alias("bin"), "high", "low"))).alias("bins"), F.sum("special").alias("special"))
    schema = groups.select(*held).withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = [_total(b) if s is None else s for b, s in zip(batch.column("bins").to_pylist(), batch.column("special").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(totals, pa.float64())], names=[*keys, out])

    return groups.mapInArrow(run, schema)
