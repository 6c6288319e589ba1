import hashlib
import json
import os
import random
import re
import shutil
import subprocess
import sys
from collections import Counter
from datetime import datetime

import pytest
from compare import duck, same
from conftest import HERE

from jobs import common, standings, word_systems

WORDS = word_systems


def _rows(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


def _config(folder, **settings):
    path = folder / "config.json"
    path.write_text(json.dumps(settings))
    return str(path)


def _documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")


def _files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names}


def test_job1_equals_its_sql(spark, small):
    same(WORDS.job1_word_systems(spark, small), duck(small), WORDS.ORACLE_SQL)


def test_job2_equals_its_sql(spark, small):
    same(standings.job2_standings(spark, small), duck(small), standings.ORACLE_SQL)


def test_growing_input_is_taken_once_and_equals_a_whole_run(spark, small, tmp_path):
    docs, config = _documents(spark, small), _config(tmp_path, size=128, files_per_batch=1)
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    docs.where("doc_id % 3 = 0").coalesce(2).write.parquet(source)
    first = WORDS.run(spark, source, out, cp, config)
    assert first == {"documents": docs.where("doc_id % 3 = 0").count(), "systems": 4}
    docs.where("doc_id % 3 = 1 and lang = 'en'").write.mode("append").parquet(source)
    before = _files(f"{out}/entries/case_id=fr")
    second = WORDS.run(spark, source, out, cp, config)
    assert second == {"documents": docs.where("doc_id % 3 = 1 and lang = 'en'").count(), "systems": 1}
    assert _files(f"{out}/entries/case_id=fr") == before  # only what has changed is made anew
    docs.where("doc_id % 3 = 2 or doc_id % 3 = 1 and lang <> 'en'").coalesce(1).write.mode("append").parquet(source)
    assert WORDS.run(spark, source, out, cp, config)["systems"] == 4
    written = _files(out)
    assert WORDS.run(spark, source, out, cp, config) == {"documents": 0, "systems": 0} and _files(out) == written
    docs.write.parquet(str(tmp_path / "all"))
    WORDS.run(spark, str(tmp_path / "all"), str(tmp_path / "out2"), str(tmp_path / "cp2"), config)
    assert _rows(WORDS.result(spark, out)) == _rows(WORDS.result(spark, str(tmp_path / "out2")))


def test_lost_runs_are_made_up_for(spark, small, tmp_path):
    config = _config(tmp_path, size=64)
    settings = common.settings_of(spark, config, WORDS.DEFAULTS)
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    _documents(spark, small).write.parquet(source)
    # Lost after the stream: the next run finds nothing new and makes the systems.
    WORDS.take_new(spark, source, out, cp, settings)
    assert WORDS.run(spark, source, out, cp, config) == {"documents": 0, "systems": 4}
    want = _rows(WORDS.result(spark, out))
    # Lost before the rows of cases, and before the batch was committed.
    shutil.rmtree(f"{out}/cases/case_id=en")
    assert WORDS.run(spark, source, out, cp, config)["systems"] == 1 and _rows(WORDS.result(spark, out)) == want
    for name in ("0", ".0.crc"):
        os.remove(f"{cp}/commits/{name}")
    WORDS.run(spark, source, out, cp, config)
    assert _rows(WORDS.result(spark, out)) == want


def test_other_settings(spark, small, tmp_path):
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    _documents(spark, small).where("lang = 'es'").write.parquet(source)
    WORDS.run(spark, source, out, cp, _config(tmp_path, size=64))
    assert WORDS.run(spark, source, out, cp, _config(tmp_path, size=64, period=5)) == {"documents": 0, "systems": 1}
    assert {r["target"] for r in spark.read.parquet(f"{out}/vectors").collect()} == {-2.0, -1.0, 0.0, 1.0, 2.0}
    with pytest.raises(ValueError, match="another size"):
        WORDS.run(spark, source, out, cp, _config(tmp_path, size=65))
    with pytest.raises(ValueError, match="unknown setting"):
        WORDS.run(spark, source, out, cp, _config(tmp_path, sizes=64))
    with pytest.raises(ValueError, match="must be of type int"):
        WORDS.run(spark, source, out, cp, _config(tmp_path, size="64"))


def test_transitions_equal_plain_python(spark):
    rng = random.Random(3)
    texts = [(None, "en"), ("", "en"), ("  \n", ""), ("one", None), ("One one ONE\tone", "en"), ("É é x y", "fr"), ("a b " * 20_000, "en"), ("w" * 100_000 + " end", "de"), *[(" ".join(rng.choices("abcdef", k=30)), rng.choice(["en", "de"])) for _ in range(40)]]
    texts += texts[:3]
    want = Counter()
    for text, lang in texts:
        case = lang or "und"
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        at = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 97 for w in re.findall(r"[^ \t-\r]+", lowered)]
        want.update((case, a, b) for a, b in zip(at, at[1:], strict=False))
        want[case, -1, -1] += 1
        want[case, -1, -2] += len(at)
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(texts)], WORDS.DOCUMENTS)
    found = {(r["case_id"], r["row"], r["col"]): r["count"] for r in WORDS.transitions(docs, 97).collect()}
    assert found == dict(want)
    assert WORDS.transitions(docs.limit(0), 97).count() == 0
    plan = WORDS.transitions(docs, 97)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2 and "BatchEval" not in plan


def test_systems_have_their_known_solution(spark, small, tmp_path):
    from residua.operators import metrics
    from pyspark.sql import functions as F

    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    _documents(spark, small).write.parquet(source)
    WORDS.run(spark, source, out, cp, _config(tmp_path, size=64))
    entries, vectors = spark.read.parquet(f"{out}/entries"), spark.read.parquet(f"{out}/vectors")
    sizes = spark.read.parquet(f"{out}/cases").select("case_id", F.col("n").cast("long").alias("n"))
    x, b = vectors.select("case_id", "i", F.col("target").alias("x")), vectors.select("case_id", "i", F.col("b").alias("x"))
    found = metrics.metrics(entries, x, b, sizes, x).collect()
    assert len(found) == 4 and all(r["relative_residual"] == 0 and r["relative_l2_forward_error"] == 0 for r in found)


LOG = "case_id string, role string, at timestamp, nth long, passed boolean, failure string, elapsed_ns long, note string"


def _log(spark, rows):
    moments = [(c, role, None if at is None else datetime.fromisoformat(at), n, ok, why, ns, "x") for c, role, at, n, ok, why, ns in rows]
    return spark.createDataFrame(moments, LOG)


def test_standings_day_by_day(spark, tmp_path):
    one = [
        ("a", "candidate", "2024-01-01T10:00:00", 1, True, None, 100), ("a", "reference", "2024-01-01T10:00:00", 2, True, None, 300),
        ("b", "candidate", "2024-01-01T09:00:00", 3, True, None, 50), ("b", "candidate", "2024-01-01T11:00:00", 4, False, "died", 60),
        (None, "candidate", "2024-01-01T11:00:00", 5, True, None, 1), ("a", "other", "2024-01-01T11:00:00", 6, True, None, 1), ("a", "candidate", None, 7, True, None, 1),
    ]
    two = [("a", "candidate", "2024-01-02T10:00:00", 8, True, None, 130), ("a", "reference", "2024-01-02T10:00:00", 9, None, None, 300), ("a", "candidate", "2024-01-02T10:00:00", 8, True, None, 110), ("b", "candidate", "2024-01-02T10:00:00", 9, True, None, 0)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _log(spark, one).write.parquet(source)
    assert standings.run(spark, source, out) == {"runs": 4, "days": 1, "cases": 2}
    _log(spark, two).write.mode("append").parquet(source)
    for _ in range(2):
        assert standings.run(spark, source, out) == {"runs": 8, "days": 2, "cases": 4}
        cases = {(str(r["day"]), r["case_id"]): r for r in spark.read.parquet(f"{out}/cases").collect()}
        assert len(cases) == 4
    a1, b1, a2, b2 = (cases[d, c] for d in ("2024-01-01", "2024-01-02") for c in "ab")
    assert a1["speedup"] == 3.0 and a1["best_before_ns"] is None and not a1["slower"]
    assert not b1["passed"] and b1["failure"] == "died" and b1["speedup"] is None and b1["reference_ns"] is None
    # Of equal times the slower run counts; it is more than a quarter above the best of earlier days.
    assert a2["candidate_ns"] == 130 and a2["best_before_ns"] == 100 and a2["slower"] and a2["reference_passed"] is False
    assert b2["passed"] and b2["best_before_ns"] is None and b2["speedup"] is None
    days = {str(r["day"]): r for r in spark.read.parquet(f"{out}/days").collect()}
    assert days["2024-01-01"]["solved"] == 1 and days["2024-01-01"]["speedup"] == 3.0
    assert days["2024-01-02"]["solved"] == 2 and days["2024-01-02"]["compared"] == 0 and days["2024-01-02"]["speedup"] is None
    # A day whose log is gone stays as it was.
    _log(spark, two).write.parquet(str(tmp_path / "late"))
    standings.run(spark, str(tmp_path / "late"), out)
    assert {str(r["day"]) for r in spark.read.parquet(f"{out}/days").collect()} == {"2024-01-01", "2024-01-02"}


def test_standings_of_nothing(spark, tmp_path):
    _log(spark, []).write.parquet(str(tmp_path / "in"))
    assert standings.run(spark, str(tmp_path / "in"), str(tmp_path / "out"))["days"] == 0
    assert standings.result(spark, str(tmp_path / "none")).count() == 0


def test_command_lines(spark, small, tmp_path):
    _log(spark, [("a", "candidate", "2024-01-01T10:00:00", 1, True, None, 100)]).write.parquet(str(tmp_path / "log"))
    _documents(spark, small).where("doc_id < 20").write.parquet(str(tmp_path / "docs"))
    env = {**os.environ, "PYTHONPATH": HERE}
    run = lambda *args: subprocess.run([sys.executable, "-m", *args], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    done = run("jobs.standings", "--runs", "log", "--output", "standings")
    assert done.returncode == 0 and "read 1 runs from log" in done.stderr
    assert spark.read.parquet(str(tmp_path / "standings/days")).first()["solved"] == 1
    done = run("jobs.word_systems", "--documents", "docs", "--output", "words", "--checkpoint", "cp", "--config", _config(tmp_path, size=32))
    assert done.returncode == 0 and "took 20 new documents in 1 batches" in done.stderr
    assert spark.read.parquet(str(tmp_path / "words/cases")).where("n = 32").count() >= 1
    assert run("jobs.standings", "--runs", "log").returncode == 2
