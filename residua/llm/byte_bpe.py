"""Byte-level BPE by recursive queries: encode and decode inside each partition.

Each Python worker opens one in-memory DuckDB database with the merge table of
the vocabulary.  A batch of new words becomes token-position rows
``(word, place, token)`` that also name their neighbour; a recursive query joins
neighbours with the merge table and contracts each word's leftmost pair of least rank until no pair
is left.  A word of n bytes takes up to n steps of n rows.  So words over
``LONG_WORD`` bytes contract, in one step, the further occurrences of that pair
too, after the query has made sure that they are the very merges that would
come next one at a time: a merge could be preceded only by a pair of lesser
rank, which none but a merge beside it could bring about.  Both ways are the
same function of the word; only the number of steps differs.  Decoding joins the ids with the vocabulary and aggregates the
pieces of a document in order of position.

A worker remembers the words it has encoded, up to ``cache_words``; past that
it forgets them and encodes them again, so memory stays bounded and results do
not change.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm._shared import held, spans
from residua.llm._words import Memory

LONG_WORD = 200
CACHE_WORDS = 1_000_000
WORDS_AT_ONCE = 20_000
ROWS_AT_ONCE = 2_000_000
BYTES_AT_ONCE = 1_000_000

_LEFTMOST = """
with recursive steps(step, word, place, token, next_place, next_token) as (
  select 0, word, place, token, next_place, next_token from start
  union all
  (with pairs as materialized (
     select s.*, (m.token::bigint << 32) | s.place as pair
     from steps s left join merges m on m.ends = (s.token::bigint << 32) | s.next_token),
   best as (
     select word, min(pair) as pair, arg_min(next_place, pair) as eaten
     from pairs where pair is not null group by word),
   merged as materialized (
     select b.word, (b.pair & 4294967295)::int as place, (b.pair >> 32)::int as token, b.eaten, e.next_place, e.next_token
     from best b join pairs e on e.place = b.eaten)
   select p.step + 1, p.word, p.place,
          case when p.place = m.place then m.token else p.token end,
          case when p.place = m.place then m.next_place else p.next_place end,
          case when p.place = m.place then m.next_token when p.next_place = m.place then m.token else p.next_token end
   from pairs p join merged m on m.word = p.word
   where p.place <> m.eaten)),
finished as (select word, max(step) as step from steps group by word)
select s.word, string_agg(s.token::varchar, ',' order by s.place) as ids
from steps s join finished f on f.word = s.word and f.step = s.step
group by s.word
"""

# As above, many merges of a word in one step: besides the leftmost pair of least rank
# all its further occurrences, but only where none of them brings a pair of lesser rank
# about.  Then the leftmost least pair after each merge is the next occurrence, so that
# one at a time would do the same; else the step contracts the leftmost pair alone.
_OCCURRENCES = """
with recursive steps(step, word, place, token) as (
  select 0, word, place, token from start
  union all
  (with pairs as materialized (
     select s.step, s.word, s.place, s.token, s.nth, m.token as made
     from (select *, lead(token) over o as next, row_number() over o as nth from steps window o as (partition by word order by place)) s
     left join merges m on m.ends = (s.token::bigint << 32) | s.next),
   least as materialized (select word, min(made) as made from pairs group by word having min(made) is not null),
   found as (
     select p.word, p.nth, p.made, p.nth - row_number() over (partition by p.word order by p.nth) as run
     from pairs p join least l on l.word = p.word and l.made = p.made),
   chosen as materialized (
     select word, nth, made from (select *, row_number() over (partition by word, run order by nth) as k from found) where k % 2 = 1),
   lesser as (
     select distinct c.word
     from chosen c
     left join chosen before on before.word = c.word and before.nth = c.nth - 2
     left join pairs l on l.word = c.word and l.nth = c.nth - 1
     left join pairs r on r.word = c.word and r.nth = c.nth + 2
     left join merges lm on lm.ends = (coalesce(before.made, l.token)::bigint << 32) | c.made
     left join merges rm on rm.ends = (c.made::bigint << 32) | r.token
     where lm.token < c.made or rm.token < c.made),
   firsts as (select word, min(nth) as nth from chosen group by word),
   taken as materialized (
     select c.word, c.nth, c.made from chosen c join firsts f on f.word = c.word
     where c.nth = f.nth or c.word not in (select word from lesser))
   select p.step + 1, p.word, p.place, coalesce(t.made, p.token)
   from pairs p
   join least on least.word = p.word
   left join taken t on t.word = p.word and t.nth = p.nth
   left join taken eaten on eaten.word = p.word and eaten.nth = p.nth - 1
   where eaten.nth is null and p.step < $steps)),
finished as (select word, max(step) as step from steps group by word)
select s.step, s.word, s.place, s.token
from steps s join finished f on f.word = s.word and f.step = s.step
order by s.word, s.place
"""

_DECODE = """
select t.doc, string_agg(v.piece, '' order by t.place) as pieces
from ids t join vocabulary v on v.token = t.token
group by t.doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file (one base64 token and its rank a line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class Codec:
    """Encoder and decoder of one vocabulary, for use inside one process."""

    def __init__(self, ranks_path: str, pattern: str, cache_words: int = CACHE_WORDS):
        import duckdb

        self.ranks = read_ranks(ranks_path)
        self.bytes_to_token = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.memory = Memory(pattern, self._words, ",".join, cache_words)
        ends, tokens = [], []
        for piece, rank in self.ranks.items():
            for cut in range(1, len(piece)):
                head, tail = self.ranks.get(piece[:cut]), self.ranks.get(piece[cut:])
                if head is not None and tail is not None:
                    ends.append(head << 32 | tail)
                    tokens.append(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self._table("merges", ends=pa.array(ends, pa.int64()), token=pa.array(tokens, pa.int32()))
        # A byte b is held as the character 256 + b: no NULs, and two bytes each in UTF-16.
        self._table("vocabulary", token=pa.array(self.ranks.values(), pa.int32()), piece=["".join(chr(256 + b) for b in p) for p in self.ranks])

    def _table(self, name: str, **columns) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"create or replace table {name} as select * from incoming")
        self.db.unregister("incoming")

    def _start(self, words: list[bytes]) -> dict[str, np.ndarray]:
        flat, sizes = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        return {"word": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "place": np.arange(len(flat), dtype=np.int32), "token": self.bytes_to_token[flat]}

    def _contract(self, words: list[bytes]) -> list[str]:
        """The ids of each word, one merge of a word in a step."""
        start = self._start(words)
        word, place, token = start["word"], start["place"], start["token"]
        last = np.append(word[1:] != word[:-1], True)
        next_token, next_place = np.where(last, -1, np.roll(token, -1)), np.where(last, -1, place + 1)
        self.db.register("start", pa.table(start | {"next_place": next_place.astype(np.int32), "next_token": next_token.astype(np.int32)}))
        found = self.db.sql(_LEFTMOST).to_arrow_table()
        self.db.unregister("start")
        out = [""] * len(words)
        for i, ids in zip(found["word"].to_pylist(), found["ids"].to_pylist(), strict=True):
            out[i] = ids
        return out

    def _contract_long(self, word: bytes) -> str:
        """The ids of one word of any length.  A query holds the rows of all its
        steps, so their number is bounded and the next query goes on from there."""
        rows = self._start([word])
        while True:
            steps = max(2, ROWS_AT_ONCE // len(rows["word"]))
            self.db.register("start", pa.table(rows))
            found = self.db.sql(_OCCURRENCES.replace("$steps", str(steps))).to_arrow_table()
            self.db.unregister("start")
            rows = {name: found[name].to_numpy() for name in ("word", "place", "token")}
            if not len(rows["word"]) or found["step"][0].as_py() < steps:
                return ",".join(map(str, rows["token"].tolist()))

    def _words(self, words: list[str]) -> list[str]:
        """The ids of each word as decimal text, joined by commas."""
        out = [""] * len(words)
        rest: list[tuple[int, bytes]] = []
        for i, word in enumerate(words):
            rank = self.ranks.get(piece := word.encode())
            if rank is not None:
                out[i] = str(rank)
            elif len(piece) <= LONG_WORD:
                rest.append((i, piece))
            else:
                out[i] = self._contract_long(piece)
        for at in range(0, len(rest), WORDS_AT_ONCE):
            part = rest[at : at + WORDS_AT_ONCE]
            for (i, _), ids in zip(part, self._contract([p for _, p in part]), strict=True):
                out[i] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[str]:
        """For each text its ids as decimal text, joined by commas."""
        return self.memory.encode(texts)

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """For each array of ids the bytes they stand for."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        out = [b""] * len(ids)
        if sizes.sum():
            flat = np.concatenate(ids)
            self.db.register("ids", pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "place": np.arange(len(flat), dtype=np.int32), "token": flat.astype(np.int32)}))
            found = self.db.sql(_DECODE).to_arrow_table()
            self.db.unregister("ids")
            for i, pieces in zip(found["doc"].to_pylist(), found["pieces"].to_pylist(), strict=True):
                out[i] = pieces.encode("utf-16-le")[::2]
        return out


def codec(ranks_path: str, pattern: str, cache_words: int = CACHE_WORDS) -> Codec:
    """This process's codec of a vocabulary."""
    key = (ranks_path, pattern, cache_words)
    return held(("codec", *key), lambda: Codec(*key))


def parse_ids(ids: str) -> np.ndarray:
    """The array of ids that stand in decimal text."""
    return np.fromstring(ids, np.int32, sep=",") if ids else np.empty(0, np.int32)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns the columns ``keep`` (all of ``docs`` if None) and ``bpe_ids``
    (array of int), ``bpe_text`` (binary, the bytes that the ids decode to).
    A null or empty text has no ids and decodes to no bytes; repeated rows are
    encoded each on their own; an empty table gives an empty result.  Columns
    of ``docs`` named like the new ones are replaced.  No shuffle.
    """
    held = [c for c in (docs.columns if keep is None else keep) if c not in ("bpe_ids", "bpe_text")]
    frame = docs.select(*[F.col(f"`{c}`") for c in held], F.col(text).alias("__residua_text"))
    schema = frame.drop("__residua_text").withColumns({"bpe_ids": F.array(F.lit(0)), "bpe_text": F.lit(b"")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern, cache_words)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in spans(texts, BYTES_AT_ONCE):
                ids = [parse_ids(x) for x in own.encode(texts.slice(a, b - a).to_pylist())]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                arrays = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))), pa.array(own.decode(ids), pa.binary())]
                yield pa.RecordBatch.from_arrays(batch.slice(a, b - a).columns[:-1] + arrays, names=[*batch.schema.names[:-1], "bpe_ids", "bpe_text"])

    return frame.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """``encode_decode`` followed by digests of its two results.

    Returns ``keep`` and n_tokens, ids_sha256 (of the decimal ids joined by
    commas), decoded_sha256 (of the decoded bytes), and with ``with_ids`` the ids
    (array<int>).  The digests are taken in the same pass, so that neither the
    decimal ids nor the decoded bytes leave the Python worker.
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    held = [c for c in (docs.columns if keep is None else keep) if c not in new]
    frame = docs.select(*[F.col(f"`{c}`") for c in held], F.col(text).alias("__residua_text"))
    schema = frame.drop("__residua_text").withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit(""), **({"ids": F.array(F.lit(0))} if with_ids else {})}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern, cache_words)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in spans(texts, BYTES_AT_ONCE):
                joined = own.encode(texts.slice(a, b - a).to_pylist())
                ids = [parse_ids(x) for x in joined]
                arrays = [
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(ids)]),
                ]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(batch.slice(a, b - a).columns[:-1] + arrays, names=[*batch.schema.names[:-1], *new])

    return frame.mapInArrow(run, schema)
