"""Benchmark items inside documents, within an edit budget.

An item of m characters may be changed by k = floor(RATE * m) edits.  Cut into
k + 1 pieces, one piece at least is untouched, so every match holds an exact
piece at nearly its own offset.  One automaton of all pieces reads each text
once; every hit opens a window around the place where its item would lie, and
windows of one item that overlap are one.  Myers' bit-parallel distance, with
the item as the pattern and one bit a character, decides each window.

Texts and items are compared in lower case with white space as single spaces;
spans are of the original text.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm._shared import held, materialize

RATE = 0.08
BLOCK_CHARS = 4_000_000
_WORD = re.compile(r"\S+")


def normal(text: str | None) -> str:
    """Lower case, white space as single spaces."""
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float = RATE) -> int:
    """Edits allowed for a normal item."""
    return int(rate * len(item))


def masks(pattern: str) -> dict[str, int]:
    """For each character the bits of its places in the pattern."""
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def distances(places: dict[str, int], size: int, text: str) -> list[int]:
    """For each end in ``text`` (0 to its length) the least edit distance of a
    pattern of ``size`` characters to a substring that ends there."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, distance = full, 0, size
    out, get = [size], places.get
    for c in text:
        eq = get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(across | plus), plus & across
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, down = up << 1, down << 1
        plus, minus = (down | ~(vertical | up)) & full, up & vertical & full
        out.append(distance)
    return out


def myers(places: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """The least edit distance of a pattern of ``size`` characters to any
    substring of ``text``, and the end of the first substring that has it."""
    found = distances(places, size, text)
    best = min(found)
    return best, found.index(best)


class Matcher:
    """All items of a block, with one automaton over their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        by_text: dict[str, list[int]] = defaultdict(list)
        for key, text in items:
            if own := normal(text):
                by_text[own].append(key)
        self.texts, self.keys = list(by_text), list(by_text.values())
        self.budgets = [budget(t, rate) for t in self.texts]
        self.bits = [masks(t) for t in self.texts]
        self.back = [masks(t[::-1]) for t in self.texts]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (text, most) in enumerate(zip(self.texts, self.budgets, strict=True)):
            for p in range(most + 1):
                a, b = p * len(text) // (most + 1), (p + 1) * len(text) // (most + 1)
                places[text[a:b]].append((i, a))
        self.pieces = ahocorasick.Automaton()
        for piece, own in places.items():
            self.pieces.add_word(piece, (len(piece), own))
        if places:
            self.pieces.make_automaton()

    def _occurrences(self, i: int, own: str, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """(distance, start, end) of the matches of item i in a stretch of a normal
        text: the best one, the first of equals, and those beside it that do not
        overlap it.

        One pass gives the distance at every end.  Ends are taken from the best on; an
        end's start comes from the same pattern backwards, not beyond the match
        before it, and an end that is dearer for that waits for its turn."""
        size, most = len(self.texts[i]), self.budgets[i]
        waiting = [(distance, end) for end, distance in enumerate(distances(self.bits[i], size, own[a:b]), a) if distance <= most]
        heapq.heapify(waiting)
        starts: list[int] = []
        ends: list[int] = []
        while waiting:
            distance, end = heapq.heappop(waiting)
            k = bisect_left(ends, end)  # the matches before this end are those before k
            if k < len(ends) and starts[k] < end:
                continue
            floor = ends[k - 1] if k else a
            if end - floor < size - most:
                continue
            least, back = myers(self.back[i], size, own[max(floor, end - size - most) : end][::-1])
            if least > distance:
                if least <= most:
                    heapq.heappush(waiting, (least, end))
                continue
            starts.insert(k, end - back)
            ends.insert(k, end)
            yield distance, end - back, end

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item key, distance, start, end in the text) of every occurrence of every
        item; of overlapping ones the best, the first of equals."""
        own = normal(text)
        if not own or not self.texts:
            return []
        starts: dict[int, list[int]] = defaultdict(list)
        for last, (size, places) in self.pieces.iter(own):
            for i, offset in places:
                starts[i].append(last + 1 - size - offset)
        found: list[tuple[int, int, int, int]] = []
        for i, hits in starts.items():
            size, most = len(self.texts[i]), self.budgets[i]
            hits.sort()
            low = high = hits[0]
            for at in [*hits[1:], None]:
                if at is not None and at - high <= 2 * most + size:
                    high = at
                    continue
                found += [(i, *m) for m in self._occurrences(i, own, max(0, low - most), min(len(own), high + size + most))]
                low = high = at
        if not found:
            return []
        words = [m.span() for m in _WORD.finditer(text)]
        firsts, at = [], 0
        for a, b in words:
            firsts.append(at)
            at += len(text[a:b].lower()) + 1
        return sorted((key, distance, self._place(words, firsts, a, False), self._place(words, firsts, b, True)) for i, distance, a, b in found for key in self.keys[i])

    @staticmethod
    def _place(words: list[tuple[int, int]], firsts: list[int], at: int, is_end: bool) -> int:
        k = bisect_right(firsts, at - is_end) - 1
        return min(words[k][0] + at - firsts[k], words[k][1])


def item_blocks(items: DataFrame, key: str, text: str, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``most`` characters (one item at least)."""
    block, size = [], 0
    for row in items.select(F.col(key).cast("long"), F.col(text).cast("string")).where(F.col(key).isNotNull() & F.col(text).isNotNull()).toLocalIterator():
        if block and size + len(row[1]) > most:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


_FOUND = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def with_matches(docs: DataFrame, block: list[tuple[int, str]], text: str, rate: float, keep: list[str]) -> DataFrame:
    """``keep`` and __found, the matches of one block of items in each row."""
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__residua_text"))
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in frame.drop("__residua_text").schema], "__residua_found array<struct<item_id:bigint,distance:int,start:bigint,end:bigint>>"])
    name = ("matcher", rate, len(block), hash(tuple(block)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(name, lambda: Matcher(block, rate))
        for batch in batches:
            found = [[dict(zip(("item_id", "distance", "start", "end"), m, strict=True)) for m in own.find(x.as_py())] for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _FOUND)], names=[*keep, "__residua_found"])

    return frame.mapInArrow(run, fields)


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", keep: list[str] | None = None, item_key: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """One row for each occurrence of an item in a document.

    Returns ``keep`` (all columns of ``docs`` if None), item_id, distance (int,
    edits), start and end (of the match in the text; code points, end exclusive);
    of occurrences that overlap the best is given, the first of equals.  Items are
    read in blocks of bounded size, each of which meets all documents: one block
    goes to the tasks with the plan; of several, each is a job of its own, so that
    no task and no driver holds more than one.  Null and empty texts hold nothing;
    null and empty items, or items with a null id, are in nothing; items of equal
    text are each reported, repeated rows each searched; an empty table on either
    side gives an empty result; columns named like the new ones are replaced.
    """
    new = ["item_id", "distance", "start", "end"]
    held = [c for c in (docs.columns if keep is None else keep) if c not in new]
    out = None
    for block, last in _with_last(item_blocks(items, item_key, item_text)):
        part = with_matches(docs, block, text, rate, held).where(F.size("__residua_found") > 0).select(*[F.col(f"`{c}`") for c in held], F.inline("__residua_found"))
        if out is not None or not last:
            part = materialize(part, "leaks-block", keep=True)
        out = part if out is None else out.unionByName(part)
    if out is None:
        none = F.expr("cast(array() as array<struct<item_id:bigint,distance:int,start:bigint,end:bigint>>)")
        return docs.select(*[F.col(f"`{c}`") for c in held], F.inline(none))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", rate: float = RATE, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns, nothing shuffled.

    Rows with null and empty texts stay, repeated rows stay or go together, an
    empty table on either side leaves the rows as they are.  Of several blocks of
    items each but the last is a job of its own.
    """
    out, columns = docs, docs.columns
    for block, last in _with_last(item_blocks(items, item_key, item_text)):
        out = with_matches(out, block, text, rate, columns).where(F.size("__residua_found") == 0).drop("__residua_found")
        out = out if last else materialize(out, "leaks-left", keep=True)
    return out


def _with_last(blocks: Iterator) -> Iterator[tuple]:
    """Each of an iterator with whether it is the last, one ahead."""
    ahead = next(blocks, None)
    while ahead is not None:
        block, ahead = ahead, next(blocks, None)
        yield block, ahead is None
