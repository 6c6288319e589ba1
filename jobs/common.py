"""What the jobs share: settings, tables that may not be there yet, and their log."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from residua.operators.storage import shared_dir


def settings_of(spark: SparkSession, path: str | None, defaults: Mapping[str, object]) -> dict:
    """``defaults``, overruled by the JSON object in the file at ``path``; an unknown
    name is an error, and so is a value of another type."""
    given = {} if path is None else json.loads(spark.read.text(path, wholetext=True).first()[0])
    for name, value in given.items():
        if name not in defaults:
            raise ValueError(f"unknown setting: {name}")
        if type(value) is not type(defaults[name]):
            raise ValueError(f"setting {name} must be of type {type(defaults[name]).__name__}")
    return {**defaults, **given}


def table_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table at ``path``, or None where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"residua.jobs.{name}")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder below the shared one that nothing uses yet."""
    return f"{shared_dir(spark)}/residua/{name}-{uuid.uuid4().hex}"


def command(name: str, about: str, arguments: Mapping[str, str], work: Callable[[SparkSession, argparse.Namespace], object], argv: list[str] | None) -> int:
    """Parse a command line of plain paths, and do ``work`` in a session of its own."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    for argument, meaning in arguments.items():
        parser.add_argument(f"--{argument}", required=argument != "config", help=meaning)
    args = parser.parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        work(spark, args)
    finally:
        spark.stop()
    return 0
