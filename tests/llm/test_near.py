import itertools
import random

import numpy as np
import pytest

from residua.llm import simhash as S
from residua.llm.components import connected_components


def test_triples_cover():
    triples = S.covering_triples()
    assert len(triples) == 20 and all(any(set(t) <= set(q) for t in triples) for q in itertools.combinations(range(8), 4))


def _brute(text, k=4):
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "A b\x0bC", "x y z w", "a b c d e f g É é" * 30, "w " * 100_000])
def test_fingerprint(text):
    assert S.fingerprint(text) == _brute(text)


@pytest.mark.parametrize("block", [2_000, 3])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(20)]
    marks = set(base)
    for b in base[:8]:
        for _ in range(20):
            marks.add(b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(1, 7))))
    marks = np.array(sorted(marks), np.uint64)
    root = list(range(len(marks)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(marks)), 2):
        if int(marks[i] ^ marks[j]).bit_count() <= 4:
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    frame = spark.createDataFrame([(int(x),) for x in marks.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in S.links(frame).collect()}
    want = {}
    for i, x in enumerate(marks.view(np.int64)):
        want.setdefault(top(i), []).append(int(x))
    for group in want.values():
        assert {got.get(x, x) for x in group} == {min(group)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


ROWS = [(5, "same text of several words here", "x"), (3, "same text of several words here", "x"), (3, "same text of several words here", "x"), (8, None, "x"), (9, "", "x"), (None, "alone and without an id in this world", "x"), (2, "quite another text of some other words", "x")]


def test_near_duplicates_edges(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, fingerprint string")
    got = [(r["doc_id"], r["component_id"]) for r in S.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (3, 3), (8, 8), (9, 8), (None, None), (2, 2)], key=str)
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(3_000)]
    texts = [words[200 * k : 200 * k + 200] for k in range(15)]
    near = [[*t[:90], "changed", *t[91:]] for t in texts[:5]]
    rows = [(i, " ".join(t), "k") for i, t in enumerate(texts + near)] + [(90, None, "n"), (91, "", "e"), (91, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __extra string")
    got = S.one_of_each(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [*range(15), 90]
    assert S.one_of_each(docs.limit(0)).count() == 0


def _components(ids, linked):
    root = {i: i for i in ids}
    for a, b in linked:
        x, y = root[a], root[b]
        if x != y:
            root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    return root


@pytest.mark.parametrize("block", [2_000, 5])
def test_one_of_each_equals_brute_force_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    line = [word() for _ in range(30)]
    rows = []
    for length in (6, 9, 40, 60, 200):
        for _ in range(6):
            base = [*[word() for _ in range(length)], *(line if length > 40 else [])]
            rows.append(base)
            for _ in range(7):  # about 0.6 to 1
                own = list(rnd.choice([rows[-1], base]))
                for _ in range(rnd.randint(0, length // 60)):
                    own[rnd.randrange(length)] = word()
                rows.append(own + [word() for _ in range(rnd.randint(0, max(1, length // 8)))])
    rnd.shuffle(rows)
    sets = [{" ".join(r[i : i + 5]) for i in range(len(r) - 4)} for r in rows]
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    just = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if 0.7 <= len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.8]
    assert len(near) > 100 and len(just) > 30
    want = set(_components(range(len(rows)), near).values())
    got = S.one_of_each(spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string").repartition(4))
    assert {r["doc_id"] for r in got.collect()} == want


def test_candidate_bits_hold_pairs_at_the_threshold():
    rnd = np.random.default_rng(3)
    most = S.candidate_bits(0.8)
    for common, left, right in [(4, 0, 1), (8, 1, 1), (8, 0, 2), (40, 5, 5), (40, 0, 10), (240, 30, 30), (240, 0, 60)]:
        for _ in range(300):
            mers = rnd.integers(0, 1 << 64, common + left + right, np.uint64)
            one, two = S.wide_of(mers[: common + left]), S.wide_of(np.concatenate([mers[:common], mers[common + left :]]))
            assert sum(int(x).bit_count() for x in (one ^ two).view(np.uint64)) <= most


def test_blocks_by_shingles_and_by_members_do_not_change_groups(spark, monkeypatch):
    import random

    from residua.llm import simhash

    rnd = random.Random(7)
    base = [f"w{rnd.randrange(10_000)}" for _ in range(400)]
    rows = []
    for i in range(60):
        own = list(base) if i % 2 else [f"v{rnd.randrange(10_000)}" for _ in range(300)] + base[:20]
        for _ in range(rnd.randint(0, 12)):
            own[rnd.randrange(len(own))] = f"x{rnd.randrange(10_000)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for members, shingles in ((1_000, 2_000_000), (7, 2_000_000), (1_000, 900)):
        monkeypatch.setattr(simhash, "BLOCK", members)
        monkeypatch.setattr(simhash, "BLOCK_SHINGLES", shingles)
        found.append(sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) >= 30


def test_fingerprint_index_joins_before_shingles_meet(spark, monkeypatch):
    """Near duplicates come through the byte-position index of their fingerprints; shingles meet for the rest alone."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(900)]
        rows += [base, [*base, word()], [word(), *base[1:]]]
    seen, likely, links = [], S._likely, S.links

    def counted(pairs, *more):
        seen.append({frozenset((r["a"], r["b"])) for r in pairs.collect()})
        return likely(pairs, *more)

    def indexed(marks, *more):
        seen.append(marks.count())
        return links(marks, *more)

    monkeypatch.setattr(S, "_likely", counted)
    monkeypatch.setattr(S, "links", indexed)
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in S.one_of_each(docs).collect()) == list(range(0, 36, 3))
    # All pairs that the index covers are joined before.
    marks = [int(S.wide_of(S.shingle_set(" ".join(r)))[0]) & (1 << 64) - 1 for r in rows]
    apart = [(a, b) for k in range(0, 36, 3) for a, b in ((k, k + 1), (k, k + 2)) if (marks[a] ^ marks[b]).bit_count() > 4]
    assert seen[0] == len(set(marks)) and len(seen[1]) <= len(apart) < 6
