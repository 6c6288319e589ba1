"""Shards by proportional stratified interleaving.

Rows are shuffled within each source by a seeded digest and ranked; row r of n
gets the fractional rank (r - 1 + u) / n with an offset u in [0, 1) of its
source, so that small sources do not crowd at one place.  Sorted by fractional
rank, any stretch holds every source in proportion, give or take a row, and
equal cuts of the order are shards that match the mixture.

Both ranks are counted without a global sort.  The digest spreads a source over
buckets; a row's rank is its rank in the bucket plus the rows of earlier
buckets.  Fractional ranks are uniform, so that the same holds for the order.
A hot source is spread over its buckets like any other rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residua.llm._shared import materialize, scratch, utf8_size

BUCKET_ROWS, SPAN = 1_024, 4_096
HEX = 13  # digits of a digest that a double holds exactly
SEED = "residua"


def _unit(digest):
    """A digest's first 52 bits as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, HEX), 16, 10).cast("long").cast("double") / F.lit(float(16**HEX))


def order_of(rows: DataFrame, source: str, key: str, seed: str = SEED) -> DataFrame:
    """``rows`` with __place, each row's place (from 0) in the interleaved order,
    and __n, the number of rows.

    ``key`` seeds the shuffle; rows of equal key stand by all columns, so that
    only identical rows may change places.  Where over ``BUCKET_ROWS`` rows share a
    key, or are null there, they are shuffled by all their columns, and such as
    are alike in all of them anyhow, so that no key and no row is one task.
    """
    with scratch(rows.sparkSession):
        return _order_of(rows, source, key, seed)


def _order_of(rows: DataFrame, source: str, key: str, seed: str) -> DataFrame:
    ties = [c for c in rows.columns if c != source]
    own = rows.withColumn("__source", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-")))
    own = own.withColumn("__digest", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    own = materialize(own.withColumn("__part", F.spark_partition_id()), "shard-rows")
    n = own.count()
    own = _spread(own, lambda rows: rows.withColumn("__mix", F.to_json(F.struct(*ties))))
    own = _spread(own, _counted).drop("__part")
    buckets = max(1, -(-n // BUCKET_ROWS))
    own = own.withColumn("__bucket", F.floor(_unit("__digest") * buckets).cast("int"))
    cells = own.groupBy("__source", "__bucket").agg(F.count("*").alias("__here"))
    by_source = Window.partitionBy("__source")
    cells = cells.withColumn("__before", F.sum("__here").over(by_source.orderBy("__bucket")) - F.col("__here")).withColumn("__all", F.sum("__here").over(by_source))
    local = Window.partitionBy("__source", "__bucket").orderBy("__digest", *ties)
    ranked = own.withColumn("__local", F.row_number().over(local)).join(materialize(cells, "shard-cells").drop("__here"), ["__source", "__bucket"])
    offset = _unit(F.md5(F.concat_ws("|", F.lit(seed), F.col("__source"))))
    placed = ranked.withColumn("__share", (F.col("__before") + F.col("__local") - 1 + offset) / F.col("__all"))
    placed = placed.withColumn("__slice", F.least(F.floor(F.col("__share") * buckets).cast("int"), F.lit(buckets - 1)))
    placed = materialize(placed.drop("__bucket", "__before", "__local", "__all"), "shard-placed", keep=True)
    slices = placed.groupBy("__slice").agg(F.count("*").alias("__here"))
    # Rows ahead of a slice: of earlier spans of slices, and of earlier slices in its
    # span; the window without partitions has n / (BUCKET_ROWS * SPAN) rows.
    slices = materialize(slices.withColumn("__span", F.floor(F.col("__slice") / SPAN)), "shard-slices")
    spans = slices.groupBy("__span").agg(F.sum("__here").alias("__whole"))
    spans = spans.withColumn("__passed", F.sum("__whole").over(Window.orderBy("__span")) - F.col("__whole")).drop("__whole")
    within = F.sum("__here").over(Window.partitionBy("__span").orderBy("__slice")) - F.col("__here")
    slices = slices.withColumn("__within", within).join(spans, "__span").withColumn("__ahead", F.col("__passed") + F.col("__within")).select("__slice", "__ahead")
    inner = Window.partitionBy("__slice").orderBy("__share", "__source", "__digest", *ties)
    out = placed.withColumn("__nth", F.row_number().over(inner)).join(materialize(slices, "shard-ahead", keep=True), "__slice")
    return out.withColumn("__place", F.col("__ahead") + F.col("__nth") - 1).withColumn("__n", F.lit(n).cast("long")).drop("__slice", "__share", "__nth", "__ahead", "__source", "__digest")


def _counted(rows: DataFrame) -> DataFrame:
    """``rows`` with __mix, the number of each among those of its digest, counted by
    the parts that the rows were read in."""
    key = ["__source", "__digest"]
    parts = rows.groupBy(*key, "__part").agg(F.count("*").alias("__here"))
    ahead = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*key, "__part", F.coalesce(F.sum("__here").over(ahead), F.lit(0)).alias("__ahead"))
    inner = Window.partitionBy(*key, "__part").orderBy(F.lit(0))
    numbered = rows.withColumn("__nth", F.row_number().over(inner)).join(parts, [*key, "__part"])
    return numbered.withColumn("__mix", (F.col("__ahead") + F.col("__nth")).cast("string")).drop("__ahead", "__nth")


def _spread(own: DataFrame, mixed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``own`` with other digests where a source has over ``BUCKET_ROWS`` rows of one:
    ``mixed`` adds to such rows what their digests are mixed with, as __mix."""
    full = own.groupBy("__source", "__digest").agg(F.count("*").alias("__rows")).where(F.col("__rows") > BUCKET_ROWS)
    full = materialize(full.select("__source", "__digest"), "shard-full")
    if full.isEmpty():
        return own
    key = ["__source", "__digest"]
    new = mixed(own.join(full, key, "left_semi")).withColumn("__digest", F.md5(F.concat_ws("|", "__digest", "__mix"))).drop("__mix")
    return materialize(own.join(full, key, "left_anti").unionByName(new), "shard-spread")


def assign_shards(docs: DataFrame, shards: int = 40, text: str = "text", source: str = "source", key: str = "doc_id", keep: list[str] | None = None, seed: str = SEED) -> DataFrame:
    """Put every row into one of ``shards`` shards whose counts differ by one at
    most and whose sources stand in the proportions of the whole.

    Returns ``keep`` (all columns if None) and size (UTF-8 bytes of the text
    plus 16), text_crc32, law ('rows'), shard, slot (from 0 within the shard,
    no gaps, in interleaved order), grown_shard (null: under this law a further
    shard moves rows of all).  A null text counts as empty; a null source is a
    source of its own; rows with equal or null ids are ordered by their other
    columns; repeated rows are each placed; with fewer rows than shards some
    shards are empty; an empty table gives an empty result.  Columns named like
    the new ones are replaced.  Texts are not shuffled unless ``keep`` asks.
    """
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    held = [c for c in (docs.columns if keep is None else keep) if c not in new]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in held],
        F.col(key).alias("__key"),
        F.col(source).alias("__src"),
        (utf8_size(text) + 16).alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = order_of(rows, "__src", "__key", seed)
    shard = F.expr(f"(__place * {shards}) div __n")
    # The first place of shard s is ceil(s * n / shards).
    first = F.expr(f"(shard * __n + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("__place") - first).cast("long"))
        .select(*[F.col(f"`{c}`") for c in held], "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    )


# DuckDB has no crc32: the table of its 256 remainders comes from the polynomial
# (fixed value 3988292384), and a fold over the bytes uses it.
ORACLE_SQL = f"""
with ranked as (
  select doc_id, octet_length(encode(coalesce(text, ''))) + 16 as size, text, hex(encode(coalesce(text, ''))) as h,
         coalesce('=' || source, '-') as src, md5('{SEED}|' || coalesce(doc_id::varchar, '')) as digest,
         row_number() over (partition by source order by md5('{SEED}|' || coalesce(doc_id::varchar, '')), doc_id, text) as r,
         count(*) over (partition by source) as n
  from documents),
placed as (
  select *, row_number() over (order by (r - 1 + ('0x' || substr(md5('{SEED}|' || src), 1, {HEX}))::bigint::double / {16**HEX}.0) / n, src, digest, doc_id, text) - 1 as place,
         count(*) over () as total
  from ranked),
remainders as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) as t
  from range(256) r(i))
select doc_id, size::bigint as size,
       xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::bigint)),
           lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295)::bigint as text_crc32,
       'rows' as law, (place * 40 // total)::int as shard,
       (place - ((place * 40 // total) * total + 39) // 40)::bigint as slot, null::int as grown_shard
from placed, remainders
"""
