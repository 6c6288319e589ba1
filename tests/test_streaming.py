from pyspark.sql import functions as F

from residua.plans import derive as D
from residua.sources.wire import encode_output
from residua.streaming.executions import running_scores, watch


def test_executions_are_judged_as_they_arrive(spark, small, tmp_path):
    import numpy as np

    t = D.target(spark, small, 7).where("case_id = '7'").orderBy("i").toPandas().x.values
    good, bad = encode_output(t, 0, 1, 1, 1, False), encode_output(t + 0.5, 0, 1, 1, 1, False)
    rows = [("7", "candidate", 0, 0.1, "", bytearray(good)), ("6", "candidate", 0, 0.1, "", bytearray(bad)), ("5", "candidate", 9, 0.1, "died", None), ("4", "candidate", 0, 0.1, "", None), ("3", "candidate", 0, 0.1, "", bytearray(good[:-1])), ("2", "candidate", 0, 0.1, "", bytearray(encode_output(np.full(len(t), np.nan), 0, 1, 1, 1, False)))]
    frame = spark.createDataFrame(rows, "case_id string, role string, returncode int, wall_seconds double, diagnostics string, output binary")
    frame.write.parquet(str(tmp_path / "in"))
    args = (D.entries(spark, small, 7), D.rhs(spark, small, 7), D.target(spark, small, 7), D.case_table(spark, small))
    for _ in range(2):  # a restart finds nothing new
        watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), *args).awaitTermination()
    found = {r["case_id"]: r["failure"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found["7"] is None and found["6"].startswith("normwise") and found["5"] == "process failed"
    assert found["4"] == "missing driver output" and "size" in found["3"] and found["2"] == "solution is not finite"


def test_running_scores(spark):
    rows = spark.createDataFrame([("candidate", True), ("candidate", False)], "role string, passed boolean").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    assert tuple(running_scores(rows).first())[1:] == ("candidate", 1, 2)


def test_roles_are_paired_as_they_arrive_or_fail_when_time_is_out(spark, tmp_path):
    from datetime import datetime

    from residua.streaming.pairing import paired

    schema = "case_id string, role string, passed boolean, failure string, elapsed_ns long, at timestamp"
    row = lambda case, role, hour, ok=True, why=None, ns=100: (case, role, ok, why, ns, datetime(2024, 1, 1, hour, 30))
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = paired(spark.readStream.schema(schema).parquet(source), "1 hour")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
        return {r["case_id"]: (r["passed"], r["failure"], r["speedup"]) for r in spark.read.parquet(out).collect()}

    rows = [[row("a", "candidate", 1), row("b", "candidate", 1), row("c", "reference", 1)], [row("a", "reference", 2, ns=250), row("d", "candidate", 2, False, "died"), row("d", "reference", 2), row("e", "candidate", 2), row("e", "reference", 2, False)]]
    assert arrive(*rows[0]) == {}
    found = arrive(*rows[1])
    want = {"a": (True, None, 2.5), "d": (False, "died", None), "e": (False, "the fixed reference failed: no reason given", None)}
    assert found == want
    # Later verdicts move the stream's time on: what still waits alone has failed.
    late = [row("f", "candidate", 8), row("f", "reference", 8)]
    found = arrive(*late) | arrive(row("g", "candidate", 9), row("g", "reference", 9))
    want |= {"b": (False, "no reference within 1 hour", None), "c": (False, "no candidate within 1 hour", None), "f": (True, None, 1.0)}
    assert {k: v for k, v in found.items() if k != "g"} == want
    # A table of the same rows gives the same, without any waiting.
    whole = paired(spark.createDataFrame([*rows[0], *rows[1], *late], schema), "1 hour").collect()
    assert {r["case_id"]: (r["passed"], r["failure"], r["speedup"]) for r in whole} == want
