import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from residua.llm import byte_bpe, token_blocks
from residua.llm._shared import new_path

TEXTS = ["", "a", "the cat, the hat", "  two  spaces\n\n x ", "don't 'S 's", "<|endoftext|> 12 ²½ ª", "中文字符测试 的", "é ​　😀", "\x00\x1c \x1d", "ab" * 400, "x" * 3000]


def _own():
    """The library's tokenizer as the file gives it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


ENCODER, WHOLE = token_blocks.Encoder(P.path("byte_bpe_50k.json")), _own()


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, cache_words=40)


@given(st.lists(st.integers(0, 2**40), max_size=300))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(values):
    values = sorted(values)
    e = token_blocks.EliasFano.encode(np.array(values, np.uint64))
    assert [e.select(i) for i in range(len(values))] == values
    assert [e.span(i) for i in range(len(values))] == list(zip([0, *values], values, strict=False))
    with pytest.raises(IndexError):
        e.select(len(values))


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(0).integers(1, 1000, 10_000))
    e = token_blocks.EliasFano.encode(v)
    assert len(e.low) + len(e.high) + len(e.samples) < 10_000 * 8 / 4


def test_words_encode_like_whole_texts():
    texts = [*TEXTS, "a<|endoftext|><|endoftext|> b", "<|endoftext", "|> x <|endoftext|>"]
    for as_text in (False, True):
        own, enc = _own(), token_blocks.Encoder(P.path("byte_bpe_50k.json"), as_text)
        own.encode_special_tokens = as_text
        for text, found in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(found, "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet="ab 's\n\t1²é中😀\x1c!.<|>", max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text_encodes_like_the_library(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_codec_equals_tiktoken(codec, tiktoken_encoding):
    rnd = random.Random(2)
    texts = TEXTS + ["".join(rnd.choice(["a", "the", " ", "  ", "\n", "1", "'s", "é", "中", "!"]) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    texts += ["".join(rnd.choice("abcde") for _ in range(500))]
    for text, found in zip(texts, codec.encode(texts), strict=True):
        ids = byte_bpe.parse_ids(found)
        assert ids.tolist() == tiktoken_encoding.encode_ordinary(text)
    assert codec.decode([byte_bpe.parse_ids(x) for x in codec.encode(texts)]) == [t.encode() for t in texts]


def test_long_words_equal_tiktoken(codec, tiktoken_encoding):
    """Words over the length from which several merges are made in a step, of tokens
    that can be split into parts of which one ranks after the whole: there rank order
    alone does not tell that merges may be made together."""
    rnd = random.Random(3)
    ranks = codec.ranks
    risky = [p for p, r in ranks.items() if p.isalpha() and p.isascii() and any(max(ranks.get(p[:k], -1), ranks.get(p[k:], -1)) > r and p[:k] in ranks and p[k:] in ranks for k in range(1, len(p)))]
    assert len(risky) > 1_000
    for _ in range(60):
        pool = rnd.sample(risky, rnd.choice([1, 2, 3, 6]))
        word = b"".join(rnd.choice(pool) for _ in range(rnd.randint(60, 120)))[rnd.randint(0, 3) :]
        ids = tiktoken_encoding.encode_ordinary(word.decode())
        assert len(word) > byte_bpe.LONG_WORD // 2 and codec._contract_long(word) == ",".join(map(str, ids)) == codec._contract([word])[0]
    for word in (b"a" * 50_000, "é中".encode() * 2_000, bytes(rnd.choice(b"abcdefgh") for _ in range(4_000))):
        assert byte_bpe.parse_ids(codec._contract_long(word)).tolist() == tiktoken_encoding.encode_ordinary(word.decode())


def test_token_file(spark):
    rows = [(3, "c c", "x"), (1, None, "y"), (2, "", None), (5, "long word " * 3000, "z"), (3, "c c", "x"), (None, "n", "n"), (7, "a<|endoftext|>b", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    path = new_path(spark, "t")
    token_blocks.write_tokens(docs, path, P.path("byte_bpe_50k.json"), block_ids=100, partitions=3)
    own, at = _own(), 0
    got = token_blocks.read_tokens(spark, path).orderBy("start").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    digests = {r["start"]: r["ids_crc32"] for r in token_blocks.token_digests(spark, path).collect()}
    for r, w in zip(got, want, strict=True):
        ids = np.array([*own.encode(w[1] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) == (w[0], at, len(ids), ids.tobytes())
        assert digests[at] == zlib.crc32(ids)
        at += len(ids)


def test_empty_token_file(spark):
    path = new_path(spark, "t")
    token_blocks.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, P.path("byte_bpe_50k.json"))
    assert token_blocks.read_tokens(spark, path).count() == 0


def test_encode_decode_frame(spark, tiktoken_encoding):
    rows = [(1, t, "c") for t in TEXTS] + [(2, None, None), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, bpe_ids string")
    got = byte_bpe.encode_decode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        assert bytes(r["bpe_text"]) == (r["text"] or "").encode() and r["bpe_ids"] == tiktoken_encoding.encode_ordinary(r["text"] or "")
    assert byte_bpe.digests(docs.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
