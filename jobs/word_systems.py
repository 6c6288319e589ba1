"""Sparse test systems from a growing folder of texts, one for each language.

    python -m jobs.word_systems --documents IN --output OUT --checkpoint CP [--config jobs/word_systems.json]

Those who compare solvers need systems of other shapes than meshes.  The words of
texts that follow each other make a directed graph with a heavy-tailed degree; its
Laplacian plus the identity is a nonsymmetric matrix with a dominant diagonal.
Words are indices by a hash, so the size of a system is fixed and new words need no
numbering.

The job is incremental.  A file stream (``availableNow``, with a checkpoint) takes
the files that no run has taken; each batch leaves its counts of transitions under
its own number, so a batch that is repeated after a failure replaces itself.  Then
the systems of those languages that have newer counts than their row in ``cases``
tells are made anew, from counts alone, and replace their partitions; the row in
``cases`` is written last, so whatever a lost run has left undone the next one does.
A run that finds nothing new writes nothing.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, fresh_folder, logger, settings_of, table_or_none
from residua.operators import matrix as M

CONFIG = os.path.splitext(os.path.abspath(__file__))[0] + ".json"
#: Size of the systems, period of the known solution, tolerance of the cases, and files of a batch at most.
DEFAULTS = {"size": 4096, "period": 11, "tolerance": 1e-10, "files_per_batch": 1000}

DOCUMENTS = "doc_id long, text string, lang string"
COUNTS = "row long, col long, count long, batch int, case_id string"
ENTRIES = "row long, col long, val double, case_id string"
VECTORS = "i long, target double, b double, case_id string"
CASES = "n long, nnz long, documents long, words long, max_abs double, max_row_nnz long, one_norm double, infinity_norm double, asymmetry double, nonsymmetric boolean, period int, tolerance double, batch int, case_id string"
#: Rows of counts that are no transitions: documents and words of a language.
NOT_A_ROW, OF_DOCUMENTS, OF_WORDS = -1, -1, -2

_log = logger("word_systems")


def transitions(documents: DataFrame, size: int) -> DataFrame:
    """(case_id, row, col, count): how often a word with index ``row`` is followed by
    one with index ``col`` inside a text, with the language as the case.

    Words stand between white space; A to Z count as lower case.  An index is the
    first eight digits of the word's md5 modulo ``size``.  Texts that are null or have
    no word count as documents only; a null or empty language is 'und'.
    """
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), letters, letters.lower()), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    index = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % size
    place = lambda row, col, count: F.struct(row.cast("long").alias("row"), col.cast("long").alias("col"), count.cast("long").alias("count"))
    own = documents.select(F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("und")).alias("case_id"), F.transform(words, index).alias("at"))
    n = F.size("at")
    pairs = F.zip_with(F.slice("at", 1, F.greatest(n - 1, F.lit(0))), F.slice("at", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: place(a, b, F.lit(1)))
    extra = F.array(place(F.lit(NOT_A_ROW), F.lit(OF_DOCUMENTS), F.lit(1)), place(F.lit(NOT_A_ROW), F.lit(OF_WORDS), n))
    return own.select("case_id", F.inline(F.concat(pairs, extra))).groupBy("case_id", "row", "col").agg(F.sum("count").alias("count"))


def entries_of(counts: DataFrame, size: int) -> DataFrame:
    """The matrix of each language of ``counts``: off the diagonal minus the count of
    a transition, and a diagonal of one more than its row's sum."""
    places = counts.where("row >= 0 and row <> col").select("case_id", "row", "col", (-F.col("count")).cast("double").alias("val"))
    return M.with_dominant_diagonal(M.canonicalize(places), _sizes(counts, size))


def _sizes(counts: DataFrame, size: int) -> DataFrame:
    return counts.where("row < 0").select("case_id").distinct().select("case_id", F.lit(size).cast("long").alias("n"))


def vectors_of(entries: DataFrame, sizes: DataFrame, period: int) -> DataFrame:
    """(case_id, i, target, b): a known solution of small whole numbers, and its right
    side.  Every sum is exact, so no order of rows changes a result."""
    target = M.dense(sizes).select("case_id", "i", (F.col("i") % period - period // 2).cast("double").alias("x"))
    return target.withColumnRenamed("x", "target").join(M.matvec(entries, target, sizes, "b"), ["case_id", "i"])


def cases_of(entries: DataFrame, counts: DataFrame, settings: dict) -> DataFrame:
    """A row for each language: what its system is like, and what it was made of."""
    of = lambda col: F.sum(F.when(F.col("col") == col, F.col("count")).otherwise(0))
    known = counts.where("row < 0").groupBy("case_id").agg(of(OF_DOCUMENTS).alias("documents"), of(OF_WORDS).alias("words"), F.max("batch").alias("batch"))
    stats = M.stats(entries, _sizes(counts, settings["size"])).drop("min_row_nnz", "diagonals")
    norms = M.infinity_norm(entries).withColumnRenamed("norm", "infinity_norm").join(M.one_norm(entries).withColumnRenamed("norm", "one_norm"), "case_id")
    made = known.join(stats, "case_id").join(norms, "case_id").join(M.asymmetry(entries).drop("scale"), "case_id")
    return made.withColumns({"period": F.lit(settings["period"]), "tolerance": F.lit(settings["tolerance"])})


def _write(frame: DataFrame, path: str) -> None:
    """Replace the partitions of the cases of ``frame``, in files of even size."""
    frame.hint("rebalance", "case_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(path)


def take_new(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: dict) -> int:
    """Count the transitions of files that no run has taken; the documents that were read."""
    taken: list[int] = []

    def take(batch: DataFrame, number: int) -> None:
        path = f"{output}/counts/batch={number}"
        transitions(batch, settings["size"]).hint("rebalance", "case_id").write.mode("overwrite").partitionBy("case_id").parquet(path)
        own = spark.read.schema(COUNTS).parquet(path).where((F.col("row") == NOT_A_ROW) & (F.col("col") == OF_DOCUMENTS))
        taken.append(own.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])
        _log.info("batch %d: read %d new documents of %s", number, taken[-1], documents)

    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(documents)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    _log.info("took %d new documents in %d batches", sum(taken), len(taken))
    return sum(taken)


def assemble(spark: SparkSession, output: str, settings: dict) -> int:
    """Make the systems anew whose counts are newer than their rows in ``cases``; how many."""
    counts = table_or_none(spark, f"{output}/counts", COUNTS)
    if counts is None:
        _log.info("no counts at %s yet", output)
        return 0
    newest = counts.where("row < 0").groupBy("case_id").agg(F.max("batch").alias("batch"))
    done = table_or_none(spark, f"{output}/cases", CASES)
    if done is not None:
        same = done.where((F.col("period") == settings["period"]) & (F.col("tolerance") == settings["tolerance"]))
        newest = newest.join(same, ["case_id", "batch"], "left_anti")
    stale = [r["case_id"] for r in newest.select("case_id").orderBy("case_id").collect()]  # a row for each language
    if not stale:
        _log.info("every system is up to date")
        return 0
    own = F.col("case_id").isin(stale)
    counts = counts.where(own)
    _write(entries_of(counts, settings["size"]), f"{output}/entries")
    # What follows is derived from the entries as written, so that they are made once.
    entries = spark.read.schema(ENTRIES).parquet(f"{output}/entries").where(own)
    _write(vectors_of(entries, _sizes(counts, settings["size"]), settings["period"]), f"{output}/vectors")
    _write(cases_of(entries, counts, settings), f"{output}/cases")
    for r in spark.read.schema(CASES).parquet(f"{output}/cases").where(own).orderBy("case_id").collect():
        _log.info("wrote system %s: size %d, %d entries, from %d documents", r["case_id"], r["n"], r["nnz"], r["documents"])
    return len(stale)


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: str | None = None) -> dict:
    """Take new documents and bring the systems up to date; counts of what was done.

    Output and checkpoint belong together; the size of the systems is theirs for
    good, since counts are kept by index.  Files are taken once, by name: documents
    are added by adding files.
    """
    settings = settings_of(spark, config, DEFAULTS)
    done = table_or_none(spark, f"{output}/cases", CASES)
    if done is not None and not done.where(F.col("n") != settings["size"]).isEmpty():
        raise ValueError(f"the systems at {output} are of another size than {settings['size']}: take a new output and checkpoint")
    return {"documents": take_new(spark, documents, output, checkpoint, settings), "systems": assemble(spark, output, settings)}


def result(spark: SparkSession, output: str) -> DataFrame:
    """All that is at ``output``, as one table: (case_id, part, i, j, val).  A part
    is 'entry', 'target', 'b', or the name of a number in ``cases``."""
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{output}/{name}")
    entries = read("entries", ENTRIES).select("case_id", F.lit("entry").alias("part"), F.col("row").alias("i"), F.col("col").alias("j"), "val")
    none = F.lit(None).cast("long")
    vectors = read("vectors", VECTORS)
    sides = [vectors.select("case_id", F.lit(name).alias("part"), "i", none.alias("j"), F.col(name).alias("val")) for name in ("target", "b")]
    numbers = [F.struct(F.lit(name).alias("part"), F.col(name).cast("double").alias("val")) for name in NUMBERS]
    cases = read("cases", CASES).select("case_id", F.inline(F.array(*numbers))).select("case_id", "part", none.alias("i"), none.alias("j"), "val")
    return entries.unionByName(sides[0]).unionByName(sides[1]).unionByName(cases)


NUMBERS = ("n", "nnz", "documents", "words", "max_abs", "max_row_nnz", "one_norm", "infinity_norm", "asymmetry", "nonsymmetric", "period", "tolerance")


def job1_word_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over the whole of ``documents``, run twice into a new folder."""
    folder = fresh_folder(spark, "job1")
    for _ in range(2):
        # A pattern, since a stream reads a table that is a single file only by one.
        run(spark, f"{sf_dir}/document[s].parquet", f"{folder}/out", f"{folder}/checkpoint", CONFIG)
    return result(spark, f"{folder}/out")


ORACLE_SQL = r"""
WITH w AS (
    SELECT coalesce(nullif(lang, ''), 'und') AS case_id,
        list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 4096) AS places
    FROM documents
),
known AS (SELECT case_id, count(*) AS documents, sum(len(places)) AS words FROM w GROUP BY case_id),
pairs AS (SELECT case_id, unnest(places[1:len(places) - 1]) AS i, unnest(places[2:len(places)]) AS j FROM w WHERE len(places) > 1),
off_diagonal AS (SELECT case_id, i, j, CAST(-count(*) AS DOUBLE) AS val FROM pairs WHERE i <> j GROUP BY ALL),
indices AS (SELECT case_id, unnest(range(4096)) AS i FROM known),
diagonal AS (SELECT x.case_id, x.i, x.i AS j, 1 + coalesce(sum(abs(o.val)), 0) AS val FROM indices x LEFT JOIN off_diagonal o ON o.case_id = x.case_id AND o.i = x.i GROUP BY x.case_id, x.i),
entries AS (SELECT * FROM off_diagonal UNION ALL SELECT * FROM diagonal),
target AS (SELECT case_id, i, CAST(i % 11 - 5 AS DOUBLE) AS val FROM indices),
b AS (SELECT e.case_id, e.i, sum(e.val * t.val) AS val FROM entries e JOIN target t ON t.case_id = e.case_id AND t.i = e.j GROUP BY e.case_id, e.i),
by_row AS (SELECT case_id, i, count(*) AS k, sum(abs(val)) AS total FROM entries GROUP BY ALL),
by_col AS (SELECT case_id, j, sum(abs(val)) AS total FROM entries GROUP BY ALL),
mirror AS (SELECT coalesce(x.case_id, y.case_id) AS case_id, max(abs(coalesce(x.val, 0) - coalesce(y.val, 0))) AS asymmetry FROM entries x FULL JOIN entries y ON y.case_id = x.case_id AND y.i = x.j AND y.j = x.i GROUP BY ALL),
whole AS (SELECT case_id, count(*) AS nnz, max(abs(val)) AS max_abs FROM entries GROUP BY case_id),
numbers AS (
    SELECT k.case_id, {'n': 4096.0, 'nnz': CAST(nnz AS DOUBLE), 'documents': CAST(documents AS DOUBLE), 'words': CAST(words AS DOUBLE), 'max_abs': max_abs,
        'max_row_nnz': CAST((SELECT max(r.k) FROM by_row r WHERE r.case_id = k.case_id) AS DOUBLE), 'one_norm': (SELECT max(c.total) FROM by_col c WHERE c.case_id = k.case_id),
        'infinity_norm': (SELECT max(r.total) FROM by_row r WHERE r.case_id = k.case_id), 'asymmetry': asymmetry, 'nonsymmetric': CAST(asymmetry > 1e-12 * max_abs AS DOUBLE), 'period': 11.0, 'tolerance': 1e-10} AS s
    FROM known k JOIN whole USING (case_id) JOIN mirror USING (case_id)
),
names AS (SELECT unnest(['n', 'nnz', 'documents', 'words', 'max_abs', 'max_row_nnz', 'one_norm', 'infinity_norm', 'asymmetry', 'nonsymmetric', 'period', 'tolerance']) AS part)
SELECT case_id, 'entry' AS part, i, j, val FROM entries
UNION ALL SELECT case_id, 'target', i, NULL, val FROM target
UNION ALL SELECT case_id, 'b', i, NULL, val FROM b
UNION ALL SELECT case_id, part, NULL, NULL, CAST(CASE part WHEN 'n' THEN s.n WHEN 'nnz' THEN s.nnz WHEN 'documents' THEN s.documents WHEN 'words' THEN s.words WHEN 'max_abs' THEN s.max_abs WHEN 'max_row_nnz' THEN s.max_row_nnz WHEN 'one_norm' THEN s.one_norm WHEN 'infinity_norm' THEN s.infinity_norm WHEN 'asymmetry' THEN s.asymmetry WHEN 'nonsymmetric' THEN s.nonsymmetric WHEN 'period' THEN s.period ELSE s.tolerance END AS DOUBLE) FROM numbers, names
"""

ARGUMENTS = {"documents": "folder of Parquet files with doc_id, text, lang, or a pattern of such", "output": "folder that the systems are written to", "checkpoint": "folder of the stream's checkpoint", "config": "a JSON file of settings"}


def main(argv: list[str] | None = None) -> int:
    return command("word_systems", __doc__, ARGUMENTS, lambda spark, a: run(spark, a.documents, a.output, a.checkpoint, a.config), argv)


if __name__ == "__main__":
    sys.exit(main())
