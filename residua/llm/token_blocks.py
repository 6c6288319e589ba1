"""Token ids on disk: one concatenated array, Elias-Fano coded document boundaries.

A token file is a folder with two Parquet tables.  ``blocks`` holds the ids in
blocks of whole documents: ``part`` and ``block`` (its place), ``n_ids``, ``ids``
(little-endian unsigned 32-bit), ``doc_ids`` and the documents' ends within the
block as an Elias-Fano sequence (``low``, ``high``, ``samples``).  ``parts``
holds, for each part, how many ids stand before it, so that every offset in the
whole array is part base + block base + a select in the block.  Parts follow
one another in ascending order of doc_id.

Elias-Fano: of n non-decreasing ends below u, the low floor(log2(u / n)) bits
stand packed in ``low``; the high parts stand in unary in the bit vector
``high`` of n + u / 2**l + 1 bits at most: about 2 + log2(u / n) bits a
document, where a table of 64-bit offsets takes 64.  Select finds the i-th one
of ``high`` with a directory of 32-bit counts, one for each ``SAMPLE`` bits.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm._shared import held, spans
from residua.llm._words import BYTE_LEVEL, Packed

SAMPLE = 512
BLOCK_IDS = 1 << 20
BYTES_AT_ONCE = 1_000_000
WORDS = 600_000
BLOCK_SCHEMA = "part int, block int, base long, n_ids long, doc_ids array<bigint>, low_bits int, low binary, high binary, samples binary, ids binary"


@dataclass(frozen=True)
class EliasFano:
    """A non-decreasing sequence of unsigned integers."""

    count: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        low_bits = max(0, int(int(values[-1]) // n).bit_length() - 1)
        lows = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(int(ones[-1]) + 1) // SAMPLE) * SAMPLE, np.uint8)
        bits[ones] = 1
        before = np.concatenate([[0], np.cumsum(bits.reshape(-1, SAMPLE).sum(axis=1))[:-1]])
        return cls(n, low_bits, np.packbits(lows.astype(np.uint8), bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(), before.astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th value, reading one sample's stretch of the bit vector."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        samples = np.frombuffer(self.samples, "<u4")
        k = int(samples.searchsorted(i, side="right")) - 1
        stretch = np.unpackbits(np.frombuffer(self.high, np.uint8, SAMPLE // 8, k * SAMPLE // 8), bitorder="little")
        one = k * SAMPLE + int(stretch.nonzero()[0][i - int(samples[k])])
        first = i * self.low_bits
        last = first + self.low_bits
        low = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3], "little") >> (first & 7)
        return (one - i) << self.low_bits | low & ((1 << self.low_bits) - 1)

    def span(self, i: int) -> tuple[int, int]:
        """Where the i-th of consecutive items starts and ends, if the values are their ends."""
        return self.select(i - 1) if i else 0, self.select(i)


class Encoder:
    """A tokenizer of the tokenizers library for whole texts, one per process.

    A byte-level tokenizer without normalizer encodes the words that its own
    pattern cuts each by itself; so the library encodes each distinct word
    once, and texts are put together from them.  Any other tokenizer encodes
    whole texts, and so does this one where a text holds the string of an
    added token, which the library finds before it cuts words: such a string
    becomes its token, or ordinary text with ``special_as_text``.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = special_as_text
        self.own.no_truncation()
        self.own.no_padding()
        cut, self.memory = json.loads(self.own.to_str()), None
        # As text they are cut like any other, by the words' path too.
        self.added = [] if special_as_text and all(t["special"] for t in cut["added_tokens"]) else [t["content"] for t in cut["added_tokens"]]
        before = cut["pre_tokenizer"] or {}
        if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not cut["normalizer"]:
            self.memory = Packed(BYTE_LEVEL, self._words, WORDS)
            self.uncut = Tokenizer.from_file(path)
            self.uncut.encode_special_tokens = True
            self.uncut.no_truncation()
            self.uncut.no_padding()
            self.uncut.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # its words are cut

    def _words(self, words: list[str]) -> list[bytes]:
        found = self.uncut.encode(words, is_pretokenized=True, add_special_tokens=False)
        ends = (np.cumsum(np.bincount(np.array(found.word_ids), minlength=len(words))) * 4).tolist()
        flat = np.array(found.ids, "<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        whole = {i for i, t in enumerate(texts) if t and (self.memory is None or any(a in t for a in self.added))}
        out = [b""] * len(texts) if self.memory is None else self.memory.encode([None if i in whole else t for i, t in enumerate(texts)])
        for i, found in zip(whole, self.own.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, "<u4").tobytes()
        return out


def _encoder(path: str, special_as_text: bool) -> Encoder:
    return held(("encoder", path, special_as_text), lambda: Encoder(path, special_as_text))


def _block(part: int, block: int, base: int, doc_ids: list, ids: list[bytes]) -> dict:
    ends = EliasFano.encode(np.cumsum([len(x) // 4 for x in ids]))
    return {"part": part, "block": block, "base": base, "n_ids": sum(map(len, ids)) // 4, "doc_ids": doc_ids, "low_bits": ends.low_bits, "low": ends.low, "high": ends.high, "samples": ends.samples, "ids": b"".join(ids)}


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, text: str = "text", block_ids: int = BLOCK_IDS, partitions: int | None = None, special_as_text: bool = False) -> None:
    """Encode every whole text, append ``end_id`` and write a token file in order of doc_id.

    One shuffle: rows are range-partitioned by doc_id and sorted; each task
    encodes as it reads and closes a block when it holds ``block_ids`` ids, so
    that a task holds one block and one batch.  A null or empty text gives the
    end id alone.  The string of a special token becomes its id, as the library
    does it, or ordinary text with ``special_as_text``.  A null doc_id sorts first; rows of equal doc_id stand
    together, by text (null first), repeats each on their own.  Other columns
    are not written.  An empty table gives a file of no blocks.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("base", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, block, base = _encoder(tokenizer_path, special_as_text), TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        ids: list[bytes] = []
        last = np.array([end_id], "<u4").tobytes()
        held = 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in spans(texts, BYTES_AT_ONCE):
                for key, found in zip(keys[a:b], own.encode(texts.slice(a, b - a).to_pylist()), strict=True):
                    doc_ids.append(key)
                    ids.append(found + last)
                    held += len(ids[-1]) // 4
                    if held >= block_ids:
                        yield pa.RecordBatch.from_pylist([_block(part, block, base, doc_ids, ids)], schema)
                        block, base, held, doc_ids, ids = block + 1, base + held, 0, [], []
        if ids:
            yield pa.RecordBatch.from_pylist([_block(part, block, base, doc_ids, ids)], schema)

    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "snappy").parquet(f"{path}/blocks")
    # One row for each part, however long the input: the number of partitions bounds it.
    totals = {r["part"]: r["n"] for r in spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, parts = 0, []
    for part in sorted(totals):
        parts.append((part, before))
        before += totals[part]
    spark.createDataFrame(parts, "part int, before long").coalesce(1).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a token file: doc_id, start (ids of all documents before
    it), n_tokens (with the end id), ids (binary, little-endian unsigned 32-bit)."""
    return _documents(spark, path, "ids binary", lambda ids: ids.tobytes())


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_tokens``, with the unsigned crc32 of a document's ids as
    ids_crc32 (long) instead of the ids."""
    return _documents(spark, path, "ids_crc32 long", zlib.crc32)


def _documents(spark: SparkSession, path: str, last: str, digest) -> DataFrame:
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    parts = spark.read.schema("part int, before long").parquet(f"{path}/parts")
    # ``parts`` has a row for each task that wrote: bounded, and joined on its key.
    joined = blocks.join(F.broadcast(parts), "part").select((F.col("before") + F.col("base")).alias("before"), "doc_ids", "low_bits", "low", "high", "samples", "ids")
    name, kind = last.split()
    out_type = pa.binary() if kind == "binary" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = EliasFano(len(row["doc_ids"]), row["low_bits"], row["low"], row["high"], row["samples"])
                ids, starts, sizes, found = np.frombuffer(row["ids"], "<u4"), [], [], []
                for i in range(ends.count):
                    # Every offset is a select; the end of one document is not carried to the next.
                    start, end = ends.span(i)
                    starts.append(row["before"] + start)
                    sizes.append(end - start)
                    found.append(digest(ids[start:end]))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, out_type)], names=["doc_id", "start", "n_tokens", name])

    return joined.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")
