"""Tables that are used more than once, in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session names none and runs on one
    machine (tests), a temporary folder that goes with the process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(spark, "_residua_own", None)
        if found is None:
            found = spark._residua_own = tempfile.mkdtemp(prefix="residua-")
            atexit.register(shutil.rmtree, found, True)
    return found.rstrip("/")


_scopes = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes inside are deleted at the end, but for those with
    ``keep``, which belong to the scope around this one, or stay if there is none."""
    scopes = _scopes.__dict__.setdefault("open", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder beside the stored tables, deleted with those of the innermost scope."""
    path = f"{shared_dir(spark)}/residua/{name}-{uuid.uuid4().hex}"
    if scopes := _scopes.__dict__.get("open", []):
        scopes[-1].append(path)
    return path


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there,
    and a lost executor costs a re-read."""
    path = f"{shared_dir(df.sparkSession)}/residua/{name}-{uuid.uuid4().hex}"
    if len(scopes := _scopes.__dict__.get("open", [])) > keep:
        scopes[-1 - keep].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = context._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def measured(df: DataFrame, name: str, keep: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """``stored``, with the rows and bytes that were written, seen on the way."""
    seen = Observation()
    found = stored(df.observe(seen, F.count(F.lit(1)).alias("rows")), name, keep)
    return found, {"rows": seen.get.get("rows", 0), "bytes": sum(f[2] for f in state_of(df.sparkSession, *found.inputFiles()))}


def state_of(spark: SparkSession, *paths: str) -> tuple:
    """What tells whether tables have changed: the size and the time of their files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(conf).globStatus(at)
        for top in files or []:
            inner = [top] if top.isFile() else at.getFileSystem(conf).listStatus(top.getPath())
            found += [(path, f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in inner]
    return tuple(sorted(found))


def is_there(df: DataFrame) -> bool:
    """Whether the files that a stored table is read from are still there."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    return all(at.getFileSystem(conf).exists(at) for at in paths)
