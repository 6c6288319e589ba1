"""A whole evaluation: load, solve by every role, verify, score, report."""

from __future__ import annotations

import importlib.util
import json
import sys
import time
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.operators import score, solve
from residua.operators.metrics import finite_solutions, metrics
from residua.operators.storage import measured, state_of
from residua.operators.verdict import cascade
from residua.schema import METRICS
from residua.sources import bundles, loading, wire

CANDIDATE, REFERENCE = "candidate", "reference"
RUN = ("status", "elapsed_ns", "create_ns", "setup_ns", "solve_ns", "mutated", "passed", "failure", *METRICS)


def maker_of(source: str) -> Callable[[float], solve.Solver]:
    """The maker of a registered solver, or ``make`` of a Python file, which is sent
    to the executors by value."""
    if source in solve.SOLVERS:
        return solve.SOLVERS[source]
    if not Path(source).is_file():
        raise ValueError(f"neither a registered solver nor a file: {source}")
    spec = importlib.util.spec_from_file_location("residua_candidate", source)
    module = importlib.util.module_from_spec(spec)
    sys.modules[spec.name] = module
    spec.loader.exec_module(module)
    cloudpickle.register_pickle_by_value(module)
    if not callable(getattr(module, "make", None)):
        raise ValueError(f"{source} has no make(tolerance)")
    return module.make


def verify(results: DataFrame, loaded: loading.Loaded) -> DataFrame:
    """Verdicts of one role's results, one row for every case: case_id, role and ``RUN``.
    A case without a result, or with half a solution, fails."""
    x = solve.solutions(results)
    sizes = loaded.cases.select("case_id", "n")
    measured = metrics(loaded.entries, x, loaded.b, sizes, loaded.target).withColumn("measured", F.col(METRICS[0]).isNotNull())
    joined = loaded.cases.select("case_id", "family", "tolerance").join(results, "case_id", "left").join(measured, "case_id", "left").join(finite_solutions(x), "case_id", "left")
    joined = joined.withColumn("has_output", F.col("solution").isNotNull()).withColumn("decode_error", F.lit(None).cast("string"))
    return cascade(joined).select("case_id", "role", *RUN)


def evaluate(spark: SparkSession, source: str, manifest: dict, archives: DataFrame | str, wanted: Sequence[str] | None = None, venue: str = "local", official_venue: str = "", capture_kind: str = "", progress: Callable[[str], None] | None = None, bundle_cache: str | None = None) -> dict:
    """The report of a solver on the wanted cases of a manifest.

    Replay cases are solved by the fixed reference too, which must pass; their
    score is the ratio of summed times, that of mesh cases the number solved.  With
    a ``bundle_cache`` solvers read inputs packed there, every one checked anew.  The
    report tells the seconds of each step, the rows and bytes that it wrote, and
    whether the bundle was there.
    """
    tell, stats = progress or (lambda _: None), {}

    def timed(name: str, make: Callable[[], object]) -> object:
        began = time.perf_counter()
        found = make()
        stats[f"{name}_seconds"] = round(time.perf_counter() - began, 6)
        return found

    def written(name: str, make: Callable[[], DataFrame], table: str) -> DataFrame:
        found, seen = timed(name, lambda: measured(make(), table))
        stats.update({f"{name}_{what}": value for what, value in seen.items()})
        return found

    family, maker = manifest["family"], maker_of(source)
    tell("loading cases")
    loaded = timed("input_prepare", lambda: loading.require(*loading.load(spark, manifest, archives, wanted, capture_kind)))
    vectors = loaded.b.select("case_id", "i", F.col("x").alias("b")).join(loaded.x0.select("case_id", "i", F.col("x").alias("x0")), ["case_id", "i"])
    roles = {CANDIDATE: maker} | ({REFERENCE: solve.SOLVERS[solve.REFERENCE]} if family == loading.REPLAY else {})
    tell(f"solving by {' and '.join(roles)}")
    if bundle_cache is None:
        results = written("solve", lambda: solve.solve_groups(loaded.entries, vectors, loaded.cases, roles), "results")
    else:
        packed, hit = timed("bundle", lambda: bundles.store_bundle(loaded.cases, wire.encode_inputs(loaded.entries, vectors, loaded.cases), bundle_cache))
        stats |= {"bundle_cache_hit": hit, "bundle_bytes": sum(f[2] for f in state_of(spark, *packed.inputFiles()))}
        results = written("solve", lambda: solve.solve_packed(packed, roles), "results")
    verdicts = {}
    for role in roles:
        tell(f"verifying the {role}")
        verdicts[role] = written(f"{role}_verification", lambda role=role: verify(results.where(F.col("role") == role), loaded), "verdicts")
    if REFERENCE in verdicts and (failed := verdicts[REFERENCE].where(~F.col("passed")).orderBy("case_id").limit(1).collect()):
        raise RuntimeError(f"the fixed reference failed on {failed[0]['case_id']}: {failed[0]['failure']}")
    rows = loaded.cases.select("case_id", "idx", "role", "input_sha256").join(verdicts[CANDIDATE].select("case_id", "passed", F.col("elapsed_ns").alias("candidate_ns"), F.struct(*RUN).alias(CANDIDATE)), "case_id")
    plan = loading.case_table(spark, family, manifest["cases"]).select("case_id", "role")
    if REFERENCE in verdicts:
        rows = score.case_speedups(rows.join(verdicts[REFERENCE].select("case_id", F.col("elapsed_ns").alias("reference_ns"), F.struct(*RUN).alias(REFERENCE)), "case_id"))
        summary = score.runtime_speedup(rows, plan)
    else:
        summary = score.cases_solved(rows, plan)
    head = {"schema_version": 1 + (family == loading.REPLAY), "release_id": manifest["release_id"], "family": family, "split": manifest.get("split"), "manifest_sha256": manifest.get("manifest_sha256"), "metric": (manifest.get("contracts") or {}).get("scoring"), "solver": source, "solvers": solve.registry(), "execution_stats": stats}
    tell("reporting")
    return json.loads(score.report(summary, head, rows.drop("idx"), official_venue, venue))
