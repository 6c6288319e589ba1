"""Quality by a regularised quadratic discriminant over document statistics.

Each class is a Gaussian over transformed statistics of the text.  Its
covariance is shrunk towards the pooled one and then towards a multiple of the
identity; the log-density difference comes from Mahalanobis distances by forward
substitution with Cholesky factors that are computed once.  Class sums and
second moments are added up over all labelled rows; only those sums, a fixed
number of them, reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm._shared import let_go, materialize

POOLED, RIDGE = 0.3, 0.01
#: The log-density difference is divided by this before the logistic curve, so
#: that sure decisions do not all round to 0 or 1.
TEMPERATURE = 10.0
_SYMBOLS = str.maketrans("", "", "#$%&*|<>{}[]~^\\")
_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]+")
STATISTICS = ("words", "symbols", "exclamations", "capitals", "repeats", "stops", "word_length", "bars", "variety")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text; defined for null and empty ones."""
    text = text or ""
    words = text.split()
    size, count = len(text) + 20, len(words) + 4
    rates = [
        1000 * (len(text) - len(text.translate(_SYMBOLS))) / size,
        1000 * text.count("!") / size,
        1000 * sum(map(len, _UPPER.findall(text))) / size,
        100 * sum(map(eq, words, words[1:])) / count,
        1000 * (text.count(".") + text.count(",") + 2) / size,
        size / count,
        1000 * text.count("|") / size,
    ]
    return [*np.log1p([len(words), *rates]).tolist(), len(set(words)) / count]


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns if None) and __x, the statistics as array<double>."""
    held = [c for c in (docs.columns if keep is None else keep) if c != "__residua_x"]
    frame = docs.select(*[F.col(f"`{c}`") for c in held], F.col(text).alias("__residua_text"))
    schema = frame.drop("__residua_text").withColumn("__residua_x", F.array(F.lit(0.0))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            found = [statistics(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "__residua_x"])

    return frame.mapInArrow(run, schema)


def forward(factor: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution y of L y = right for a lower triangular L, row after row."""
    out = np.empty_like(right)
    for i in range(len(factor)):
        out[i] = (right[i] - factor[i, :i] @ out[:i]) / factor[i, i]
    return out


@dataclass(frozen=True)
class Discriminant:
    """Centre and scale of the statistics; mean, Cholesky factor and offset of each class."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    offsets: tuple[float, float]

    def difference(self, x: np.ndarray) -> np.ndarray:
        """The log-density of class 1 less that of class 0, for rows of statistics."""
        z = ((x - self.centre) / self.scale).T
        logs = [offset - 0.5 * (forward(factor, z - mean[:, None]) ** 2).sum(axis=0) for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True)]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; 0.5 where both classes are equally likely."""
        return 1 / (1 + np.exp(-np.clip(self.difference(x) / TEMPERATURE, -700, 700)))


def from_moments(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, pooled: float = POOLED, ridge: float = RIDGE) -> Discriminant:
    """Fit from each class's count, sum and second moments (classes 0 and 1)."""
    n, d = counts.sum(), sums.shape[1]
    centre = sums.sum(axis=0) / n
    scale = np.sqrt(np.maximum(np.diag(squares.sum(axis=0)) / n - centre**2, 1e-12))
    means, spreads = [], []
    for c in (0, 1):
        mean = sums[c] / counts[c]
        spread = (squares[c] / counts[c] - np.outer(mean, mean)) / np.outer(scale, scale)
        means.append((mean - centre) / scale)
        spreads.append(spread)
    common = sum(k * s for k, s in zip(counts, spreads, strict=True)) / n
    factors, offsets = [], []
    for c in (0, 1):
        own = (1 - pooled) * spreads[c] + pooled * common
        own = (1 - ridge) * own + ridge * max(np.trace(own) / d, 1e-6) * np.eye(d)
        factors.append(np.linalg.cholesky(own))
        offsets.append(float(np.log(counts[c] / n) - np.log(np.diag(factors[-1])).sum()))
    return Discriminant(centre, scale, tuple(means), tuple(factors), tuple(offsets))


def held_out(key: str = "doc_id"):
    """Whether a row is kept from the fit: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(rows: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Discriminant | None:
    """Fit on all labelled rows that are not held out.

    ``rows`` has ``key`` and __x.  Rows without a label, with a null key or a
    label other than 0 and 1 are left out; a row labelled twice counts twice.
    None if a class has no rows.
    """
    d = len(STATISTICS)
    marks = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).where(F.col("__label").isin(0, 1))
    known = rows.where(~held_out(key)).select(F.col(key).alias("__key"), "__residua_x").join(marks, "__key").select("__label", "__residua_x")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y, x = np.array(batch.column(0)), np.array(batch.column(1).flatten()).reshape(-1, d)
            for c in (0, 1):
                own = x[y == c]
                totals[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        labels, places = np.divmod(np.arange(totals.size), totals.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(places, pa.int32()), pa.array(totals.ravel())], names=["label", "place", "total"])

    sums = known.mapInArrow(moments, "label int, place int, total double").groupBy("label", "place").agg(F.sum("total").alias("total"))
    totals = np.zeros((2, 1 + d + d * d))
    for r in sums.collect():  # 2 * (1 + d + d * d) rows
        totals[r["label"], r["place"]] = r["total"]
    if not totals[:, 0].all():
        return None
    return from_moments(totals[:, 0], totals[:, 1 : 1 + d], totals[:, 1 + d :].reshape(2, d, d))


def score(rows: DataFrame, model: Discriminant | None) -> DataFrame:
    """``rows`` without __x, and score and predicted (1 if the score is 0.5 or
    more).  Without a model (no labels of a class) every score is 0.5."""
    schema = rows.drop("__residua_x").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    kept = [c for c in rows.columns if c != "__residua_x"]
    ordered = rows.select(*[F.col(f"`{c}`") for c in kept], "__residua_x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            x = np.array(batch.column(batch.num_columns - 1).flatten()).reshape(-1, len(STATISTICS))
            found = model.score(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    return ordered.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", keep: list[str] | None = None, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Score every whole text.

    Returns ``keep`` (all columns of ``docs`` if None), held_out, score and
    predicted.  The statistics are taken once and kept in the shared folder
    with ``keep``; the fit reads them back.  Labels, languages, sources and ids
    are never inputs of a score.  Null and empty texts have statistics like any
    other; equal texts score alike; an empty table gives an empty result;
    columns named like the new ones are replaced.
    """
    held = [c for c in (docs.columns if keep is None else keep) if c not in ("held_out", "score", "predicted")]
    rows = materialize(with_statistics(docs, text, list(dict.fromkeys([*held, key]))), "quality-rows")
    scored = score(rows, fit(rows, labels, key, label))
    return scored.select(*[F.col(f"`{c}`") for c in held], held_out(key).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that ``classify`` would predict as class 1, all columns.

    Texts are read twice, for the fit and for the choice, and never shuffled.
    Null and empty texts are judged like any other, repeated rows alike; without
    labels of both classes all rows stay; an empty table gives an empty result.
    """
    model, columns = fit(with_statistics(docs, text, [key]), labels, key, label), docs.columns
    place = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            x = np.array([statistics(v.as_py()) for v in batch.column(place)]).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model.score(x) >= 0.5))

    return docs if model is None else docs.mapInArrow(run, docs.schema)
