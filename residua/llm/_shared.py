"""What several of the operators need: shared storage, memory of workers, spans of batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 8 << 20
SPARKS_BOUND = "67108864b"


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none (tests on one machine) a temporary folder is
    made once and put into the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(spark, "_residua_dir", None)
        if found is None:
            found = spark._residua_dir = tempfile.mkdtemp(prefix="residua-")
    return found.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get to ``BATCH_BYTES``, unless
    the session has another bound than Spark's own: texts may be very long, and
    a worker holds a batch several times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == SPARKS_BOUND:
        spark.conf.set(key, str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/residua/{name}-{uuid.uuid4().hex}"


_scopes = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end.

    Those that the caller's result still reads are written with ``keep``: they
    belong to the scope around this one, and stay if there is none.
    """
    scopes = _scopes.__dict__.setdefault("open", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            remove_path(spark, path)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here
    and a lost executor costs only a re-read."""
    path = new_path(df.sparkSession, name)
    if len(scopes := _scopes.__dict__.get("open", [])) > keep:
        scopes[-1 - keep].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path in the shared folder, if it is there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_held: tuple[object, object] = (None, None)


def held(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives for ``key``, kept in this Python worker for its next
    tasks.  A worker keeps one thing: Spark hands workers from one operator to
    the next, and tables of several would add up."""
    global _held
    if _held[0] != key:
        if _held[1] is not None:
            _held = (None, None)
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:  # give freed memory back, where the C library can
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:
                pass
        _held = (key, make())
    return _held[1]


def let_go() -> None:
    """Drop what another operator has left in this Python worker."""
    held("nothing", object)


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8_size(column: str):
    """Bytes of the column's UTF-8 text; null counts as none."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


def spans(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of a column of texts of about ``most`` bytes each, one text at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64) + 16
    start, ends = 0, np.cumsum(sizes)
    while start < len(ends):
        reach = most + (int(ends[start - 1]) if start else 0)
        stop = max(start + 1, int(np.searchsorted(ends, reach, side="right")))
        yield start, stop
        start = stop
