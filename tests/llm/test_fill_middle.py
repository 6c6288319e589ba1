import hashlib
import re

import pytest
from compare import duck, same
from pyspark.sql import functions as F

from residua.llm import fill_middle as M
from residua.llm.queries import op12_fill_middle


def _plain(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ROWS = [
    (0, None), (1, ""), (2, "one line"), (3, "a\nb\nc\n"), (4, "a\nb\nc"), (5, "\n\n\n"), (6, "x <S> y\nz"), (7, "almost <P\n>S>\n<"), (8, "𝒳é\n日本\r\nq r\n"),
    (9, "line of words\n" * 50_000), (10, "w" * 300_000), (10, "same id\nother text"), (2, "one line"), (None, "no id\nat all"), (-5, "\t \n\n x"), (11, "\\E.*\\Q\n$1\n"),
]


def test_query_equals_its_sql(spark, small):
    same(op12_fill_middle(spark, small), duck(small), M.ORACLE_SQL)


@pytest.mark.parametrize(("rate", "spm", "seed"), [(100, 50, 7), (40, 0, 7), (60, 100, 3), (0, 50, 7)])
def test_equals_plain_python_and_restores(spark, rate, spm, seed):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    out = M.transform(docs, rate=rate, spm_rate=spm, seed=seed).withColumn("back", M.restore(F.col("output"), F.col("form")))
    found = sorted((repr(r["doc_id"]), r["text"] or "", r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out.collect())
    want = sorted((repr(i), t or "", *_plain(i, t, rate, spm, seed), t or "") for i, t in ROWS)
    assert [tuple(map(repr, r)) for r in found] == [tuple(map(repr, r)) for r in want]
    assert {r[3] for r in found} >= ({"plain"} if not rate else {"plain", "spm"} if spm else {"plain", "psm"})


def test_clashing_columns_other_units_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 5, "x", "y")], "doc_id long, text string, n int, form string, fim_text string")
    got = M.transform(docs, units=r"\S+\s*", sentinels=("[1]", "{2}", "(3)")).collect()
    assert got[0]["n"] == 5 and got[0]["fim_text"] == "y" and got[0]["form"] in ("psm", "spm")
    assert M.transform(docs.limit(0)).columns == ["doc_id", "text", "fim_text", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert M.transform(docs.limit(0)).count() == 0
    for wrong in [("<P>", "<P>", "<M>"), ("<P>", "<PP>", "P<"), ("", "a", "b")]:
        with pytest.raises(ValueError):
            M.transform(docs, sentinels=wrong)


def test_plan_is_native_reads_two_columns_and_cuts_units_once(spark, small):
    plan = op12_fill_middle(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert plan.count("regexp_extract_all(") == 1
