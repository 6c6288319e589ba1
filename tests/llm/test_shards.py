from collections import Counter

from compare import duck

from residua.llm import sharding


def test_counts_slots_and_mixture(spark):
    rows = [(i, f"t{i % 7}", "big" if i % 3 else f"s{i % 30}", 9) for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, shard int")
    got = sharding.assign_shards(docs, 16).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == 2_000 and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(16))
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
        assert abs(sum(r["source"] == "big" for r in got if r["shard"] == s) - 1333 / 16) <= 3
    assert {r["law"] for r in got} == {"rows"}


def test_buckets_do_not_change_the_order(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x", "ab"[i % 2]) for i in range(500)], "doc_id int, text string, source string")
    one = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign_shards(docs, 7).collect()}
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    assert one == {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign_shards(docs, 7).collect()}


def test_nulls_repeats_and_few_rows(spark):
    docs = spark.createDataFrame([(None, None, None), (None, None, None), (1, "", "a"), (1, "é", None)], "doc_id int, text string, source string")
    got = sharding.assign_shards(docs, 40).collect()
    assert len(got) == 4 and len({(r["shard"], r["slot"]) for r in got}) == 4
    assert {r["size"] for r in got} == {16, 18}
    assert sharding.assign_shards(docs.limit(0), 40).count() == 0


def test_hot_keys_are_spread(spark, monkeypatch):
    """A third of the rows without id, a third of one id, half of these alike in all columns."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    rows = [(None, f"t{i}", "s") for i in range(300)] + [(7, "same" if i % 2 else f"u{i}", "s") for i in range(300)] + [(1_000 + i, "x", "r") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string").repartition(3)
    placed = sharding.order_of(docs.withColumnRenamed("doc_id", "k"), "source", "k")
    assert sorted(r["__place"] for r in placed.collect()) == list(range(900))
    got = sharding.assign_shards(docs, 9).collect()
    for s in range(9):
        own = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(100)) and abs(sum(r["source"] == "r" for r in own) - 33) <= 2
        # The hot rows lie in every shard: no run of one key.
        assert 15 <= sum(r["doc_id"] is None for r in own) <= 55 and 15 <= sum(r["doc_id"] == 7 for r in own) <= 55
    again = sharding.assign_shards(docs.repartition(5), 9).collect()
    of = lambda rows: sorted((str(r["doc_id"]), r["text"], r["shard"], r["slot"]) for r in rows)
    assert of(got) == of(again)


def test_sql(spark, small):
    found = duck(small).execute(sharding.ORACLE_SQL)
    names = [c[0] for c in found.description]
    theirs = sorted(tuple(map(str, r)) for r in found.fetchall())
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ours = sorted(tuple(map(str, r)) for r in sharding.assign_shards(docs, keep=["doc_id"]).select(*names).collect())
    assert ours == theirs
