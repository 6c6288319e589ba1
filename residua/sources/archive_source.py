"""A data source of matrices in archives: ``spark.read.format("matrix_archives")``.

    register(spark)
    spark.read.format("matrix_archives").load("/archives").where("case_id = 'm3'")

Option ``path`` is a folder or a file, local or a URI that Arrow's file systems know.
A gzipped tar archive is one partition, read as a stream; a zip archive has a
directory, so each of its matrices is one.  Filters on case_id are used in planning:
partitions without a wanted case are left out, and other members of an archive are
skipped without being decoded.  With the option ``named`` ('true') a tar archive
holds the case of its own name alone, so that it needs not be opened to be left out.
With ``part`` = 'heads' there is one row for each matrix instead of its entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zipfile import ZipFile

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from residua.operators.matrix import canonicalize
from residua.sources.market_stream import Entries, matrices, zipped_cases

NAME = "matrix_archives"
SCHEMAS = {"entries": "archive string, case_id string, row bigint, col bigint, val double", "heads": "archive string, case_id string, n bigint, stated bigint, symmetry string"}
TAR, ZIP = (".tar.gz", ".tgz"), (".zip",)
BATCH = 1 << 16


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let its filters reach it."""
    spark.dataSource.register(MatrixArchives)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _stem(path: str) -> str:
    name = path.rpartition("/")[2]
    return next((name[: -len(end)] for end in (*TAR, *ZIP) if name.endswith(end)), name)


@dataclass
class Part(InputPartition):
    """An archive, and one of its members, or all of it."""

    path: str
    member: str | None = None
    case: str | None = None


class MatrixArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMAS[self.options.get("part", "entries")]

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.part = options["path"], options.get("part", "entries")
        self.named = options.get("named", "false").lower() == "true"
        self.wanted: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("case_id",):
                own = frozenset(f.value if isinstance(f, In) else [f.value])
                self.wanted = own if self.wanted is None else self.wanted & own
            else:
                yield f

    def _wants(self, case: str) -> bool:
        return self.wanted is None or case in self.wanted

    def partitions(self) -> list[Part]:
        system, path = opened(self.path)
        top = system.get_file_info(path)
        files = [top] if top.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        out: list[Part] = []
        for file in sorted((f for f in files if f.is_file), key=lambda f: f.path):
            if file.path.endswith(TAR) and (not self.named or self._wants(_stem(file.path))):
                out.append(Part(file.path))
            elif file.path.endswith(ZIP):
                with system.open_input_file(file.path) as raw:
                    out += [Part(file.path, member, case) for case, member in sorted(zipped_cases(raw).items()) if self._wants(case)]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        if partition.member is not None:
            with system.open_input_file(partition.path) as raw, ZipFile(raw) as archive, archive.open(partition.member) as text:
                yield from self._batches(partition.path, partition.case, Entries(text))
            return
        with system.open_input_stream(partition.path, compression=None) as raw:
            for case, entries in matrices(raw, self.wanted):
                yield from self._batches(partition.path, case, entries)

    def _batches(self, path: str, case: str, entries: Entries) -> Iterator[pa.RecordBatch]:
        archive = path.rpartition("/")[2]
        if self.part == "heads":
            yield pa.RecordBatch.from_pylist([{"archive": archive, "case_id": case, "n": entries.n, "stated": entries.stated, "symmetry": entries.symmetry}], pa.schema([("archive", pa.string()), ("case_id", pa.string()), ("n", pa.int64()), ("stated", pa.int64()), ("symmetry", pa.string())]))
            return
        for rows, cols, vals in entries:
            for a in range(0, len(rows), BATCH):
                own: list[np.ndarray] = [x[a : a + BATCH] for x in (rows, cols, vals)]
                yield pa.RecordBatch.from_arrays([pa.repeat(archive, len(own[0])), pa.repeat(case, len(own[0])), *map(pa.array, own)], names=["archive", "case_id", "row", "col", "val"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Canonical entries of every matrix in the archives at ``path``."""
    register(spark)
    return canonicalize(spark.read.format(NAME).load(path).drop("archive"))
