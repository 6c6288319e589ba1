"""Fill-in-the-middle: texts cut at unit boundaries and put together anew, by SQL functions alone.

``regexp_extract_all`` makes the array of a text's units, by default its lines.
Four numbers, the first four groups of eight hexadecimal digits of
``sha2(seed:id)``, decide: two cuts, whether the text is transformed, and which
arrangement it gets.  ``slice`` and ``array_join`` build prefix, middle and suffix,
and sentinels mark them in the output.  A text that holds a sentinel stays plain,
so what ``restore`` reads from an output is unambiguous: sentinels begin with a
character that occurs nowhere else in them, so none can arise where a part and a
sentinel meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.llm._shared import unused

#: Lines with their ends; the last may lack one.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50


def numbers(seed: int, key: Column) -> list[Column]:
    """The first four groups of eight digits of the hexadecimal sha256 of
    ``seed:key`` as whole numbers; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, units: str = LINES, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)
) -> DataFrame:
    """Cut and rearrange every whole text.

    Returns ``keep`` (all of ``docs`` if None) and n (long, units), form ('plain',
    'psm' or 'spm'), prefix_chars and middle_chars (long, code points; null if
    plain), output.  Of 100 texts ``rate`` are transformed, and of 100 of those
    ``spm_rate`` have the suffix first; both follow from seed and key alone, so rows
    of one key and text are alike, wherever they are.

    Null and empty texts are plain and empty; null keys count as an empty one;
    repeated rows are each transformed; an empty table gives an empty result;
    columns named like the new ones are replaced.  No shuffle: a row needs nothing
    but itself.
    """
    first, second, third = sentinels
    if any(not s or s[0] in t[1:] for s in sentinels for t in sentinels) or len(set(sentinels)) < 3 or any(s != t and t.startswith(s) for s in sentinels for t in sentinels):
        raise ValueError("sentinels must differ, none may begin another, and their first characters may not occur later in them")
    new = ["n", "form", "prefix_chars", "middle_chars", "output"]
    held = [c for c in (docs.columns if keep is None else keep) if c not in new]
    inner = {n: unused([*docs.columns, *new], f"fim_{n}") for n in ("text", "units", "h", "low", "high", "prefix", "middle", "suffix")}
    c = {n: F.col(f"`{name}`") for n, name in inner.items()}
    column = lambda name: F.col(f"`{name}`")

    rows = docs.select(*[column(x) for x in held], F.array(*numbers(seed, column(key))).alias(inner["h"]), F.coalesce(column(text).cast("string"), F.lit("")).alias(inner["text"]))
    rows = rows.withColumn(inner["units"], F.regexp_extract_all(c["text"], F.lit(units), F.lit(0)))
    h = lambda k: c["h"][k]
    n = F.size(c["units"])
    cut = lambda k: F.pmod(h(k), (n + 1).cast("long")).cast("int")
    marked = F.lit(False)
    for s in sentinels:
        marked = marked | F.contains(c["text"], F.lit(s))
    plain = (c["text"] == "") | marked | (h(2) % 100 >= rate)
    rows = rows.withColumns({"n": n.cast("long"), inner["low"]: F.least(cut(0), cut(1)), inner["high"]: F.greatest(cut(0), cut(1)), "form": F.when(plain, "plain").when(h(3) % 100 < spm_rate, "spm").otherwise("psm")})
    piece = lambda start, length: F.array_join(F.slice(c["units"], start + 1, length), "")
    rows = rows.withColumns({inner["prefix"]: piece(F.lit(0), c["low"]), inner["middle"]: piece(c["low"], c["high"] - c["low"]), inner["suffix"]: piece(c["high"], F.col("n").cast("int") - c["high"])})
    size = lambda part: F.when(F.col("form") != "plain", F.length(c[part]).cast("long"))
    front, back = F.concat(F.lit(first), c["prefix"]), F.concat(F.lit(second), c["suffix"])
    output = F.when(F.col("form") == "plain", c["text"]).when(F.col("form") == "spm", F.concat(back, front, F.lit(third), c["middle"])).otherwise(F.concat(front, back, F.lit(third), c["middle"]))
    return rows.select(*[column(x) for x in held], "n", "form", size("prefix").alias("prefix_chars"), size("middle").alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output of ``transform`` was made of, from its sentinels; null of null."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    prefix, suffix = F.when(form == "psm", parts[1]).otherwise(parts[2]), F.when(form == "psm", parts[2]).otherwise(parts[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))


def digests(outputs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, the small columns of ``transform``, and the sha256 of output and restored text."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return outputs.select(*[F.col(f"`{x}`") for x in keep], "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS s FROM documents),
u AS (
    SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units,
        CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4
    FROM d
),
c AS (
    SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM u
),
p AS (
    SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p
"""
