"""SimHash near-duplicates by a byte-position index with count filtering.

Two 64-bit fingerprints that differ in at most four bits share at least four of
their eight positional bytes, since each differing bit spoils one byte at most.
The inverted index has a posting for each position and byte of a fingerprint.
Lists of single bytes would grow with a 256th of the rows each, so pairs meet in
prefilter lists of three positions: the twenty triples below leave no four
positions without one of them, so every pair with four shared bytes meets, and a
list holds a 2**-24th of the fingerprints.  For each pair that meets, the shared
postings are counted; pairs that reach four are retained, and then verified bit
by bit.

Equal fingerprints are one node.  In a list, every member is first compared
with the list's least and greatest fingerprint only, which links dense groups
in linear time; only lists that still hold several components are compared in
full, between components alone, in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.llm._shared import let_go, materialize, scratch, unused
from residua.llm.components import connected_components

BYTES, BITS = 8, 64
BLOCK, PAIRS_AT_ONCE = 1_000, 1 << 15
#: Shingles of the sets of a block at most, so that long texts make small blocks.
BLOCK_SHINGLES = 2_000_000
HASHES_AT_ONCE = 1 << 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text: ASCII lower case, words between
    ASCII white space, shingles of ``shingle`` words with repeats (all words if
    fewer), XXH64 of each; a bit is set if over half of the hashes have it.  No
    words give zero."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    stops = ends[k - 1 :]
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(stops)]
    n, ones = len(stops), np.zeros(BITS, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        part = [xxh64_intdigest(flat[a:b], seed) for a, b in zip(starts[at : at + HASHES_AT_ONCE].tolist(), stops[at : at + HASHES_AT_ONCE].tolist(), strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, shingle: int = 4) -> DataFrame:
    """``keep`` (all columns if None) and __fp, the fingerprint as a signed long."""
    held = [c for c in (docs.columns if keep is None else keep) if c != "__fp"]
    frame = docs.select(*[F.col(f"`{c}`") for c in held], F.col(text).alias("__text"))
    schema = frame.drop("__text").withColumn("__fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            marks = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(batch.num_columns - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(marks.view(np.int64))], names=[*batch.schema.names[:-1], "__fp"])

    return frame.mapInArrow(run, schema)


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of positions such that any four positions contain one: the
    positions fall into three classes in a circle; a triple within a class, or
    with two in a class and one in the next, is taken (20 of the 56)."""
    classes = [i % 3 for i in range(BYTES)]

    def taken(triple: tuple[int, ...]) -> bool:
        count = [sum(classes[i] == c for i in triple) for c in range(3)]
        return 3 in count or any(count[c] == 2 and count[(c + 1) % 3] == 1 for c in range(3))

    return [t for t in itertools.combinations(range(BYTES), 3) if taken(t)]


def postings(fp: Column) -> Column:
    """The eight postings of a fingerprint: position and byte, as one number each."""
    return F.array(*[(F.lit(i << 8) + F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))).cast("int") for i in range(BYTES)])


def retained(pairs: DataFrame, least: int) -> DataFrame:
    """The distinct pairs (a, b) of ``pairs`` that share ``least`` postings or more:
    postings of either side are joined and counted for each pair."""
    one = pairs.select("a", "b", F.explode(postings(F.col("a"))).alias("posting"))
    two = pairs.select("a", "b", F.explode(postings(F.col("b"))).alias("posting"))
    shared = one.unionAll(two).groupBy("a", "b", "posting").agg(F.count("*").alias("sides")).where("sides = 2")
    return shared.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least).select("a", "b")


def verified(pairs: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b) that differ in ``most`` bits or fewer."""
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)


def links(marks: DataFrame, most: int = 4) -> DataFrame:
    """Components of the distinct fingerprints ``marks(fp)`` linked at ``most``
    (at most four) or fewer differing bits: (node, root) of those with a link."""
    if not 0 <= most <= 4:
        raise ValueError("the index covers up to four differing bits")
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))
    keys = [(F.lit(n << 24) + F.shiftleft(byte(i), 16) + F.shiftleft(byte(j), 8) + byte(k)).cast("int") for n, (i, j, k) in enumerate(covering_triples())]
    index = marks.select("fp", F.explode(F.array(*keys)).alias("key"))
    lists = materialize(index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("first"), F.max("fp").alias("last")).where("n > 1"), "simhash-lists")
    met = materialize(index.join(lists, "key"), "simhash-met")
    star = met.select(F.col("fp").alias("a"), F.explode(F.array("first", "last")).alias("b")).where("a <> b").distinct()
    found = materialize(verified(retained(materialize(star, "simhash-stars"), BYTES - most), most), "simhash-found")
    parts = materialize(connected_components(found, "simhash-cc"), "simhash-parts")
    # With three members or fewer the two pivots have met every pair.
    wide = met.where("n > 3").join(parts.select(F.col("node").alias("fp"), "root"), "fp", "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("part"))
    wide = materialize(wide, "simhash-wide")
    mixed = materialize(wide.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key"), "simhash-mixed")
    rest = wide.join(mixed, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    across = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = rest.select("key", "fp", "part", postings(F.col("fp")).alias("posts"), F.col("block").alias("i"), F.explode(across).alias("j"))
    right = rest.select(F.col("key").alias("key2"), F.col("fp").alias("fp2"), F.col("part").alias("part2"), postings(F.col("fp")).alias("posts2"), F.explode(across).alias("i2"), F.col("block").alias("j2"))
    # Here the pairs of a list are counted as they meet, so that only those retained leave the join.
    enough = F.size(F.array_intersect("posts", "posts2")) >= BYTES - most
    on = (F.col("key") == F.col("key2")) & (F.col("i") == F.col("i2")) & (F.col("j") == F.col("j2")) & (F.col("part") < F.col("part2")) & enough
    # A pair of components needs one link, however many of their members meet.
    between = left.join(right, on).select("part", "part2", F.col("fp").alias("a"), F.col("fp2").alias("b"))
    more = materialize(verified(between, most).select(F.col("part").alias("a"), F.col("part2").alias("b")).distinct(), "simhash-more")
    if more.isEmpty():
        return parts
    return connected_components(found.unionByName(more), "simhash-cc2")


def near_duplicates(docs: DataFrame, text: str = "text", keep: list[str] | None = None, most: int = 4, shingle: int = 4) -> DataFrame:
    """Every document with its fingerprint and its component.

    Returns ``keep`` (all columns of ``docs`` if None), fingerprint (16 hex
    digits) and component_id: the smallest doc_id reachable over links of
    ``most`` or fewer differing bits, itself included.  Null and empty texts
    have fingerprint zero and are linked like any other.  Rows repeated, or of
    equal text, share a component; a null doc_id is never the smallest unless
    nothing else is there (then null).  An empty table gives an empty result.
    Columns named like the new ones are replaced.
    """
    held = [c for c in (docs.columns if keep is None else keep) if c not in ("fingerprint", "component_id")]
    with scratch(docs.sparkSession):
        marked = materialize(with_fingerprints(docs, text, list(dict.fromkeys([*held, "doc_id"])), shingle), "simhash-marked", keep=True)
        marks = materialize(marked.groupBy(F.col("__fp").alias("fp")).agg(F.min("doc_id").alias("least")), "simhash-marks")
        roots = links(marks.select("fp"), most)
        rooted = materialize(marks.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
        classes = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-classes")
        named = materialize(rooted.join(classes, "root").select(F.col("fp").alias("__fp"), "component_id"), "simhash-named", keep=True)
    return marked.join(named, "__fp").select(*[F.col(f"`{c}`") for c in held], F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- Jaccard similarities: the same index, and shingles with wider fingerprints
# for what 64 bits cannot tell ---------------------------------------------------

#: 64-bit words of a wide fingerprint.
WIDE = 4
#: Shingles in ``FREQUENT`` documents or more are frequent; the ``MOST_FREQUENT`` of
#: them are known to every task.  A task counts with ``COUNTERS`` counters at most.
FREQUENT, MOST_FREQUENT, COUNTERS = 16, 50_000, 1 << 18


def shingle_hashes(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The hashes of a text's shingles as ``fingerprint`` takes them, with repeats."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[min(shingle, len(words)) - 1 :]
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(stops)]
    return np.fromiter((xxh64_intdigest(flat[a:b], seed) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, len(stops))


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(shingle_hashes(text, shingle, seed))


def wide_of(hashes: np.ndarray) -> np.ndarray:
    """As ``fingerprint``, but ``WIDE`` words over given hashes: the further
    words take hashes that are mixed from the first."""
    n, ones = len(hashes), np.zeros((WIDE, BITS), np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        part = hashes[at : at + HASHES_AT_ONCE]
        for k in range(WIDE):
            if k:  # the finishing steps of a common 64-bit mixer
                part = part + np.uint64(0x9E3779B97F4A7C15)
                part = (part ^ (part >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                part = (part ^ (part >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                part ^= part >> np.uint64(31)
            ones[k] += np.unpackbits(part.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view("<i8").ravel()


def candidate_bits(similarity: float) -> int:
    """Differing bits that a pair of the similarity has next to never more of.

    Small sets differ more often than the angle says (three bits in sixteen for
    four shingles of five), so the mean is taken at five quarters of the angle's;
    six standard deviations of independent bits are added.
    """
    p = min(0.5, 1.25 * np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(np.ceil(BITS * WIDE * p + 6 * np.sqrt(BITS * WIDE * p * (1 - p))))


def prefix(hashes: np.ndarray, similarity: float, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first ``n - ceil(similarity * n) + 1`` of a set's hashes in an order that
    is the same for all sets: ``frequent`` ones (sorted) last, by ``rank``.

    Two sets of the similarity share ``ceil(similarity * n)`` hashes of either, so
    by the pigeonhole principle their prefixes share one at least.
    """
    n = len(hashes)
    if not n:
        return hashes
    length = n - int(np.ceil(similarity * n - 1e-9)) + 1
    place = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        place = np.where(frequent[at] == hashes, rank[at], 0)
    return hashes[np.argsort(place, kind="stable")[:length]]


def fewer(mers: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` counters: all are lowered by as much as leaves so many above
    zero.  What is left of a hash is at most that much too low."""
    if len(mers) <= most:
        return mers, counts
    counts = counts - np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]
    return mers[counts > 0], counts[counts > 0]


def _frequent(docs: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles of all documents, sorted, and their ranks from 1, the
    most frequent last.  They only order the shingles of a set, so that counts may
    be a little low, but not differ between documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        mers, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            own, seen = np.unique(np.concatenate([mers, *[shingle_set(x.as_py(), shingle) for x in batch.column(0)]]), return_counts=True)
            seen[np.searchsorted(own, mers)] += counts - 1
            mers, counts = fewer(own, seen, COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array(mers.view(np.int64)), pa.array(counts)], names=["mer", "n"])

    counted = docs.select(F.col(text).alias("__text")).mapInArrow(run, "mer long, n long")
    rows = counted.groupBy("mer").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "mer").limit(MOST_FREQUENT).select("mer").collect()
    mers = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(mers)
    return mers[order], (len(mers) - order).astype(np.int64)


def _met(index: DataFrame) -> DataFrame:
    """(key, node, first) of every member of a posting list of ``index(key, node)``
    but its first, the least node.  The least nodes are partial aggregates, so that a
    long list is split like any other skewed side of a join."""
    first = materialize(index.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").drop("last"), "simhash-first")
    return index.join(first, "key").where("node <> first")


def _alike(most: int, similarity: float) -> Column:
    """Whether rows with (w0.., n) and (v0.., m) are candidates."""
    bits = sum((F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"v{k}"))) for k in range(WIDE)), F.lit(0))
    return (bits <= most) & (F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m") - 1e-9)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose ``sets(node, mers)`` have the Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = np.asarray(x.values), np.asarray(y.values)
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(both >= similarity * (len(one) + len(two) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    ones = pairs.join(sets.select(F.col("node").alias("a"), F.col("mers").alias("x")), "a")
    both = ones.join(sets.select(F.col("node").alias("b"), F.col("mers").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def _different(members: DataFrame) -> DataFrame:
    """Of the lists of ``members(key, node, part)`` that hold several parts one key for
    each set of members: lists of the same members hold the same pairs.  Sets are
    told apart by their size and 128 bits of their members' hashes."""
    of = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}")
    sets = members.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("size"), of(1), of(2)).where("low < high")
    return sets.groupBy("x1", "x2", "size").agg(F.min("key").alias("key")).select("key")


def _dealt(lists: DataFrame, most: int, similarity: float) -> DataFrame:
    """Of ``lists(key, node, part, w0.., n)`` the members that have a candidate of
    another part there: (key, low, high, node, part, w0.., n, before), before being
    the lesser keys of the node.

    Lists of over ``BLOCK`` members, or whose sets hold over ``BLOCK_SHINGLES``, are
    dealt over pairs of blocks, low and high.
    Two semi-joins give members, never pairs: the first leaves those with a
    candidate by fingerprint; their lists are the keys of a node, and the second
    leaves those with a candidate that counts here, which is where the two have no
    lesser key in common, so that a pair is looked at once.
    """
    sized = lists.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rest = materialize(lists.join(sized, "key").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "simhash-dealt")
    prints = [f"w{k}" for k in range(WIDE)]
    rows = rest.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "i", "j", "node", "part", *prints, "n")

    def facing(rows: DataFrame, *more: str) -> DataFrame:
        """The same rows as partners: those of block j for block i."""
        return rows.select(F.col("key").alias("key2"), F.col("j").alias("i2"), F.col("i").alias("j2"), F.col("part").alias("part2"), *[F.col(c).alias(c.replace("w", "v")) for c in prints], F.col("n").alias("m"), *[F.col(c).alias(f"{c}2") for c in more])

    on = (F.col("key") == F.col("key2")) & (F.col("i") == F.col("i2")) & (F.col("j") == F.col("j2")) & (F.col("part") != F.col("part2")) & _alike(most, similarity)
    near = materialize(rows.join(facing(rows), on, "left_semi"), "simhash-near")
    own = near.select("key", "node", "part").distinct()
    own = materialize(own.join(_different(own), "key"), "simhash-own")
    keys = own.groupBy("node").agg(F.collect_list("key").alias("keys"))
    named = near.join(own.select("key").distinct(), "key").join(keys, "node").withColumn("before", F.filter("keys", lambda k: k < F.col("key"))).drop("keys")
    named = materialize(named, "simhash-keyed")
    once = ~F.arrays_overlap("before", "before2")
    active = named.join(facing(named, "before"), on & once, "left_semi")
    return active.select("key", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), "node", "part", *prints, "n", "before")


def _linked_within(nodes: np.ndarray, parts: np.ndarray, prints: np.ndarray, sizes: np.ndarray, before: list[set[int]], sets: list[np.ndarray], most: int, similarity: float) -> list[tuple[int, int]]:
    """Links (a, b) that join the parts of one group as all its links would: pairs of
    near fingerprints first, and only pairs whose parts are still apart."""
    root = {p: p for p in set(parts.tolist())}

    def top(p: int) -> int:
        while root[p] != p:
            root[p] = p = root[root[p]]
        return p

    found: list[tuple[np.ndarray, ...]] = []
    for i in range(len(nodes) - 1):
        bits = np.bitwise_count(prints[i] ^ prints[i + 1 :]).sum(axis=1, dtype=np.int16)
        low, high = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        near = np.flatnonzero((bits <= most) & (low >= similarity * high - 1e-9) & (parts[i] != parts[i + 1 :]))
        found.append((bits[near], np.full(len(near), i, np.int32), (near + i + 1).astype(np.int32)))
    if not found:
        return []
    bits, left, right = map(np.concatenate, zip(*found, strict=True))
    order, out = np.argsort(bits, kind="stable"), []
    for at in range(0, len(order), PAIRS_AT_ONCE):
        some = order[at : at + PAIRS_AT_ONCE]
        now = np.array([top(p) for p in parts.tolist()])
        some = some[now[left[some]] != now[right[some]]]
        for i, j in zip(left[some].tolist(), right[some].tolist(), strict=True):
            a, b = top(int(parts[i])), top(int(parts[j]))
            if a == b or not before[i].isdisjoint(before[j]):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                root[max(a, b)] = min(a, b)
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def _between(lists: DataFrame, sets_of: Callable[[DataFrame], DataFrame], most: int, similarity: float) -> DataFrame:
    """Links (a, b) between the parts of ``lists``: as many as join what all links join."""
    dealt = materialize(_dealt(lists, most, similarity), "simhash-active")
    sets = materialize(sets_of(dealt.select("node").distinct()), "simhash-active-sets")
    names = [f"w{k}" for k in range(WIDE)]

    def run(group: pa.Table) -> pa.Table:
        let_go()
        lists_of = lambda c: [np.asarray(x.values) for x in group[c].combine_chunks()]
        prints = np.column_stack([np.array(group[c]) for c in names]).view(np.uint64)
        links = _linked_within(np.array(group["node"]), np.array(group["part"]), prints, np.array(group["n"]), [set(k.tolist()) for k in lists_of("before")], lists_of("mers"), most, similarity)
        return pa.table({"a": pa.array([max(x) for x in links], pa.int64()), "b": pa.array([min(x) for x in links], pa.int64())})

    return dealt.join(sets, "node").groupBy("key", "low", "high").applyInArrow(run, "a long, b long")


def _likely(pairs: DataFrame, prints: DataFrame, most: int, similarity: float) -> DataFrame:
    """The pairs (a, b) that their fingerprints and sizes don't rule out."""
    ones = pairs.join(prints.withColumnRenamed("node", "a"), "a")
    twos = ones.join(prints.select(F.col("node").alias("b"), *[F.col(f"w{k}").alias(f"v{k}") for k in range(WIDE)], F.col("n").alias("m")), "b")
    return twos.where(_alike(most, similarity)).select("a", "b")


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Candidates (a, b) of ``prints(node, w0.., n)`` by the byte-position index of their
    first words, which are 64-bit fingerprints of the sets: pairs that share four
    postings or more and differ in four bits or fewer (``links``).  Each node of a
    component meets its least node, and the least one of its own fingerprint."""
    marks = materialize(prints.groupBy(F.col("w0").alias("fp")).agg(F.min("node").alias("least")), "simhash-prints")
    roots = links(marks.select("fp"))
    rooted = materialize(marks.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-print-roots")
    firsts = rooted.groupBy("root").agg(F.min("least").alias("first"))
    named = prints.select("node", F.col("w0").alias("fp")).join(rooted.join(firsts, "root"), "fp")
    return named.select(F.col("node").alias("a"), F.explode(F.array("least", "first")).alias("b")).where("a <> b").distinct()


def similar(index: DataFrame, prints: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float = 0.8) -> DataFrame:
    """(node, root) of the nodes of ``prints(node, w0.., n)`` that are linked by a
    Jaccard similarity of their shingle sets.

    First ``fingerprint_links`` joins what the byte-position index of the fingerprints
    finds.  What it leaves apart, since fingerprints of the similarity may differ in
    more bits than the index covers, meets by shingles: ``index(key, node)`` has the
    prefix of each set, and every pair of the similarity
    meets in a posting list.  ``sets_of`` gives (node, mers) of the nodes of a
    frame.  Each member of a list meets the least of its list, and postings
    shared with it are counted over all lists; a node is first held against the
    one that it shares most with.  Then lists that still hold several components
    are compared in full, between components alone, in blocks of bounded size,
    pairs of near fingerprints first.  Fingerprints rule out pairs that meet by
    chance; the others are verified by their sets.
    """
    most, name = candidate_bits(similarity), "simhash-similar"

    def checked(candidates: DataFrame) -> DataFrame:
        candidates = materialize(candidates, f"{name}-pairs")
        named = candidates.select(F.col("a").alias("node")).union(candidates.select("b")).distinct()
        return materialize(_verified(candidates, materialize(sets_of(named), f"{name}-sets"), similarity), f"{name}-found")

    near = checked(fingerprint_links(prints))
    known = materialize(connected_components(near, f"{name}-near"), f"{name}-known")
    met = materialize(_met(index), "simhash-met")
    shared = met.groupBy(F.col("node").alias("a"), F.col("first").alias("b")).agg(F.count("*").alias("shared"))
    # Pairs that the fingerprints have joined need not be looked at again.
    ones = shared.join(known.select(F.col("node").alias("a"), F.col("root").alias("one")), "a", "left")
    twos = ones.join(known.select(F.col("node").alias("b"), F.col("root").alias("two")), "b", "left")
    shared = materialize(twos.where(F.coalesce("one", "a") != F.coalesce("two", "b")).select("a", "b", "shared"), "simhash-shared")
    best = shared.groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("less"))).alias("best")).select("a", (-F.col("best.less")).alias("b"))
    found = near.unionByName(checked(_likely(best, prints, most, similarity)))
    parts = materialize(connected_components(found, name), f"{name}-parts")
    members = materialize(met.select("key", "node").union(met.select("key", F.col("first").alias("node")).distinct()), f"{name}-members")
    placed = materialize(members.join(parts, "node", "left").select("key", "node", F.coalesce("root", "node").alias("part")), f"{name}-placed")
    lists = materialize(placed.join(_different(placed), "key").join(prints, "node"), f"{name}-listed")
    more = materialize(_between(lists, sets_of, most, similarity), f"{name}-between")
    if more.isEmpty():
        return parts
    return connected_components(found.unionByName(more), f"{name}-last")


def row_digest(columns: list[str], text: str) -> Column:
    """A digest of a whole row: rows of equal digest are alike in every column."""
    others = [F.col(f"`{c}`") for c in columns if c != text]
    return F.md5(F.concat_ws("|", F.coalesce(F.md5(F.col(text).cast("string").cast("binary")), F.lit("-")), F.to_json(F.struct(*others)) if others else F.lit("")).cast("binary"))


def one_of_each(docs: DataFrame, text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one of each group of near duplicates, all columns.

    Groups are the components over pairs whose sets of shingles have a Jaccard
    similarity of ``similarity`` or more.  The row of smallest doc_id stays (null
    last, and of rows alike any one); null and empty texts are one group; an
    empty table gives an empty result.

    Texts are read, not written: rows are known by a digest of all their columns,
    and the chosen ones are joined with ``docs`` at the end.
    """
    spark, columns = docs.sparkSession, docs.columns
    mark = unused(columns, "__digest")
    whole = docs.withColumn(mark, row_digest(columns, text))
    frame = whole.select(F.col(mark).alias("__digest"), F.col("doc_id").cast("long").alias("id"), F.col(text).alias("__text"))
    prints = [f"w{k}" for k in range(WIDE)]
    schema = ", ".join(["node long, digest string, id long", *[f"{c} long" for c in prints], "n int, mark string, keys array<bigint>"])

    def sets_of(named: DataFrame) -> DataFrame:
        """The shingle sets of some nodes, from their texts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            let_go()
            for batch in batches:
                sets = [shingle_set(x.as_py(), shingle).view(np.int64) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "mers"])

        wanted = named.join(narrow.select("node", F.col("digest").alias("__digest")), "node")
        texts = frame.select("__digest", "__text").join(wanted, "__digest").select("node", "__text")
        if alike:  # a row that stands there several times has one set
            texts = texts.groupBy("node").agg(F.min("__text").alias("__text"))
        return texts.mapInArrow(run, "node long, mers array<bigint>")

    with scratch(spark):
        frequent, rank = _frequent(docs, text, shingle)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            let_go()
            from pyspark import TaskContext

            at = TaskContext.get().partitionId() << 40
            for batch in batches:
                words, sizes, marks, keys = [], [], [], []
                for value in batch.column(2):
                    own = shingle_set(value.as_py(), shingle)
                    words.append(wide_of(own))
                    sizes.append(len(own))
                    marks.append(hashlib.md5(own.tobytes()).hexdigest())
                    keys.append(prefix(own, similarity, frequent, rank).view(np.int64))
                rows = np.array(words, np.int64).reshape(-1, WIDE)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(words))), batch.column(0), batch.column(1), *[pa.array(rows[:, k]) for k in range(WIDE)], pa.array(sizes, pa.int32()), pa.array(marks, pa.string()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "digest", "id", *prints, "n", "mark", "keys"])
                at += len(words)

        marked = materialize(frame.mapInArrow(run, schema), "simhash-rows")
        # Rows of equal sets are one node, named by the row that would stay.
        order = F.struct(F.col("id").isNull().alias("last"), "id", "digest", "node")
        firsts = materialize(marked.groupBy("mark").agg(F.min(order).alias("first")).select(F.col("first.node").alias("node"), "first"), "simhash-firsts")
        index = marked.select("node", "keys").join(firsts.select("node"), "node", "left_semi").select(F.explode("keys").alias("key"), "node")
        narrow = materialize(marked.drop("keys").join(firsts.select("node"), "node", "left_semi"), "simhash-nodes")
        alike = materialize(marked.groupBy("digest").agg(F.count("*").alias("rows")).where("rows > 1").select("digest"), "simhash-alike")
        twins, alike = alike, not alike.isEmpty()
        roots = similar(index, narrow.select("node", *prints, "n"), sets_of, similarity)
        kept = firsts.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
        chosen = materialize(kept.select(F.col("first.digest").alias(mark)), "simhash-chosen", keep=True)
        if alike:
            twins = materialize(chosen.join(twins.withColumnRenamed("digest", mark), mark, "left_semi"), "simhash-twins", keep=True)
    stay = whole.join(chosen, mark, "left_semi")
    if alike:
        both = whole.join(twins, mark, "left_semi").dropDuplicates([mark])
        stay = whole.join(chosen.join(twins, mark, "left_anti"), mark, "left_semi").unionByName(both)
    return stay.select(*[F.col(f"`{c}`") for c in columns])
