import random

import numpy as np

from residua.llm import decontaminate as D

ITEM = "The quick brown fox jumps over the lazy dog while seven wizards quietly brew potions near the old mill"


def _sellers(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, d in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != d)))
        prev = cur
    return min(prev), prev.index(min(prev))


def test_myers_equals_dynamic_programming():
    rnd = random.Random(5)
    for _ in range(1_000):
        p, t = ("".join(rnd.choice("abc") for _ in range(rnd.randint(lo, 70))) for lo in (1, 0))
        assert D.myers(D.masks(p), len(p), t) == _sellers(p, t)


def test_every_match_within_the_budget_is_found():
    m, rnd = D.Matcher([(1, ITEM)]), random.Random(1)
    for _ in range(300):
        s = list(ITEM)
        for _ in range(rnd.randint(0, D.budget(D.normal(ITEM)))):
            j = rnd.randrange(len(s))
            s[j : j + rnd.randint(0, 1)] = rnd.choice(["q", "", "z"])
        text = "some words before " + "".join(s) + " and after"
        found = m.find(text)
        assert found and found[0][0] == 1
        assert _sellers(D.normal(ITEM), D.normal(text))[0] == found[0][1]


def test_spans_and_edges(spark):
    docs = spark.createDataFrame([(1, f"x  {ITEM.upper().replace(' ', '  ')} y", 0), (2, None, 0), (3, "", 0), (4, "clean text of no interest to anyone", 0), (1, f"x  {ITEM.upper().replace(' ', '  ')} y", 0), (5, "w " * 200_000 + ITEM, 0)], "doc_id int, text string, distance int")
    items = spark.createDataFrame([(7, ITEM), (8, ITEM), (9, None), (None, ITEM), (10, "")], "item_id long, text string")
    got = D.leaks(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 7), (1, 7), (1, 8), (1, 8), (5, 7), (5, 8)]
    r = next(r for r in got if r["doc_id"] == 1)
    assert D.normal(r["text"][r["start"] : r["end"]]) == D.normal(ITEM) and r["distance"] == 0
    assert sorted(r["doc_id"] for r in D.without_leaks(docs, items).collect()) == [2, 3, 4]
    assert D.leaks(docs, items.limit(0)).count() == 0 and D.leaks(docs.limit(0), items).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(k, f"item number {k} " + "abcdefgh"[k] * 30) for k in range(6)], "item_id long, text string")
    assert len(list(D.item_blocks(items, "item_id", "text", 100))) == 3
    docs = spark.createDataFrame([(k, f"so item number {k} {'abcdefgh'[k] * 30} or item number {k + 1} {'abcdefgh'[k + 1] * 30}") for k in range(7)] + [(9, "none of them")], "doc_id int, text string")
    one = sorted((r["doc_id"], r["item_id"], r["distance"], r["start"], r["end"]) for r in D.leaks(docs, items).collect())
    left = sorted(r["doc_id"] for r in D.without_leaks(docs, items).collect())
    assert left == [9] or left == [6, 9]
    monkeypatch.setattr(D, "item_blocks", lambda items, key, text, own=D.item_blocks: own(items, key, text, 100))
    assert one == sorted((r["doc_id"], r["item_id"], r["distance"], r["start"], r["end"]) for r in D.leaks(docs, items).collect())
    assert left == sorted(r["doc_id"] for r in D.without_leaks(docs, items).collect())


def test_every_occurrence_is_reported():
    m = D.Matcher([(1, ITEM)])
    changed = ITEM.replace("lazy", "l4zy")
    text = f"{ITEM} {changed} and {ITEM}{ITEM}"
    found = m.find(text)
    assert [(text[a:b], d) for _, d, a, b in sorted(found, key=lambda f: f[2])] == [(ITEM, 0), (changed, 1), (ITEM, 0), (ITEM, 0)]


def test_ties_go_to_the_first():
    found = D.Matcher([(1, "abcdefghijklmnopqrstuvwxyz")]).find("abcdefghijklmnopqrstuvwxy abcdefghijklmnopqrstuvwxy!")
    assert sorted(f[1:3] for f in found) == [(1, 0), (1, 26)]


def least(p, t):
    """The least edit distance of a pattern to any substring, by columns of the pattern, all ends at once."""
    t = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    row, steps = np.zeros(len(t) + 1, np.int64), np.arange(len(t) + 1)
    for i, c in enumerate(p, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (t != ord(c)))])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def test_documents_against_dynamic_programming(spark, small):
    """The items that each document holds, by plain dynamic programming over all of its text."""
    items = [(r["item_id"], D.normal(r["text"])) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}

    texts = [(r["doc_id"], D.normal(r["text"])) for r in docs.collect()]
    texts = [t for t in texts if t[0] in {d for d, _ in got}] + [t for t in texts if len(t[1]) < 2_000][:60]
    assert len(got) >= 3
    for doc, text in texts:
        for key, item in items:
            assert (least(item, text) <= D.budget(item)) == ((doc, key) in got)


def _by_parts(p, text, most):
    """Best occurrence first, then those in what is left on either side."""
    todo, out = [(0, len(text))], []
    places, back = D.masks(p), D.masks(p[::-1])
    while todo:
        a, b = todo.pop()
        if b - a < len(p) - most:
            continue
        distance, length = D.myers(places, len(p), text[a:b])
        if distance <= most:
            end = a + length
            start = end - D.myers(back, len(p), text[max(a, end - len(p) - most) : end][::-1])[1]
            out.append((distance, start, end))
            todo += [(a, start), (end, b)]
    return sorted(out)


def test_occurrences_equal_those_found_part_by_part():
    rnd = random.Random(2)
    for _ in range(400):
        p = "".join(rnd.choice("abc") for _ in range(rnd.randint(12, 30)))
        text = ""
        for _ in range(rnd.randint(1, 6)):
            s = list(p)
            for _ in range(rnd.randint(0, 3)):
                j = rnd.randrange(len(s))
                s[j : j + rnd.randint(0, 1)] = rnd.choice(["a", "", "b"])
            text += "".join(s) + "".join(rnd.choice("abc ") for _ in range(rnd.choice([0, 1, 9])))
        m = D.Matcher([(1, p)], 0.15)
        own = D.normal(p)
        if own != p:
            continue
        assert sorted(m._occurrences(0, text, 0, len(text))) == _by_parts(p, text, m.budgets[0])


def test_time_is_linear_in_occurrences():
    import time

    def seconds(n):
        text = " ".join([ITEM] * n)
        began = time.process_time()
        assert len(D.Matcher([(1, ITEM)]).find(text)) == n
        return time.process_time() - began

    assert seconds(4_000) < 8 * max(seconds(1_000), 0.05)


def test_items_of_several_kinds_in_long_documents(spark):
    """Items with edits in texts of 2,000 to 60,000 characters, against dynamic programming."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(rnd.randint(6, 30)))) for k in range(12)]
    rows = []
    for i in range(14):
        own = [word() for _ in range(rnd.choice([400, 2_000, 10_000]))]
        for _ in range(rnd.randint(0, 4)):
            s = list(rnd.choice(items)[1])
            for _ in range(rnd.randint(0, len(s) // 8)):
                j = rnd.randrange(len(s))
                s[j : j + rnd.randint(0, 1)] = rnd.choice(["x", "", " "])
            own.insert(rnd.randrange(len(own)), "".join(s))
        rows.append((i, " ".join(own)))
    docs, table = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, table).collect()}
    assert got == {(i, k) for i, text in rows for k, item in items if least(D.normal(item), D.normal(text)) <= D.budget(D.normal(item))}
