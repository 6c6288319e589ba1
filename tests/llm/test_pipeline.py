import hashlib
import re

import public_tokenizers as P
import pytest
import tiktoken
from test_leaks import least
from test_pii import brute

import corpus_pipeline as C
from residua.llm import byte_bpe, decontaminate, pii, quality
from residua.llm.queries import QUERIES


def test_queries_are_whole():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 13))


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _one_of_each(rows):
    """Ids that stay of (id, text), by exact Jaccard similarity and union-find."""
    sets, root = {i: _shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and 5 * len(a & b) >= 4 * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if root[i] == i}


SECRET = re.compile(r"""(?:token|secret|passwd|password|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?["']?[ \t]{0,8}[:=][ \t]{0,8}(["'])([^\s"']{8,})\1""", re.I)


def _masked(text):
    spans = sorted([*brute(text), *[(m.start(2), 4, m.end(2)) for m in SECRET.finditer(text)]])
    out, at = "", 0
    for a, k, b in spans:
        if a >= at:
            out += text[at:a] + "[" + ("email", "ip", "card", "phone", "secret")[k] + "]"
        at = max(at, b)
    return out + text[at:]


def _encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(C.RANKS), special_tokens={})


def test_stages_against_plain_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: r for r in C.run(spark, small).collect()}
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in quality.classify(docs, spark.read.parquet(f"{small}/labels.parquet")).where("predicted = 1").collect()}
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    kept = _one_of_each([(i, rows[i]["text"]) for i in good])
    near = {i for i in kept if i not in got or len(rows[i]["text"] or "") < 1_500}  # dynamic programming takes its time
    leaky = {i for i in near if any(least(t, decontaminate.normal(rows[i]["text"])) <= decontaminate.budget(t) for t in items)}
    assert set(got) <= kept and kept - set(got) == leaky
    encoding, masked = _encoding(), 0
    for i, r in got.items():
        text = _masked(rows[i]["text"] or "")
        masked += text != rows[i]["text"]
        ids = encoding.encode_ordinary(text)
        assert (r["n_chars"], r["n_tokens"], r["ids"]) == (len(text) if text != rows[i]["text"] else rows[i]["n_chars"], len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["lang"], r["source"]) == (rows[i]["lang"], rows[i]["source"])
    assert masked


LONG = " ".join(f"word{k % 997} and{k}" for k in range(60_000))


@pytest.fixture(scope="module")
def edges(spark, small):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    own = "doc_id long, text string, lang string, source string, n_chars long, ids string, __digest string, score string"
    rows = [(None, "a null id beside a text of its own words", "en", "s", 40, "x", "y", "z"), (1, None, None, None, None, None, None, None), (2, "", "en", "s", 0, "x", "y", "z"), (3, LONG, "en", "s", len(LONG), "x", "y", "z")]
    rows += [(4, "two rows alike, of mail 1@b.example and more words here", "en", "s", 55, "x", "y", "z")] * 2
    rows += [(5, "two rows alike, of mail 1@b.example and more words here", "en", "s", 55, "x", "y", "z"), (6, "my password = 'correcthorse1' stands in these plain words", "en", "s", 1, "x", "y", "z")]
    return spark.createDataFrame(rows, own)


def test_every_stage_on_edge_rows(spark, small, edges):
    kept = {}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, edges, small)
        assert out.columns == edges.columns and out.schema == edges.schema
        kept[name] = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
        assert stage(spark, edges.limit(0), small).count() == 0
    assert [i for i, _ in kept["SimHash near-dedup"]] == [1, 3, 4, 6, None]
    assert len(kept["benchmark decontamination"]) == 8
    assert (4, "two rows alike, of mail [email] and more words here") in kept["PII"] and (6, "my password = '[secret]' stands in these plain words") in kept["PII"] and (1, None) in kept["PII"]
    good = {r["doc_id"] for r in quality.classify(edges, spark.read.parquet(f"{small}/labels.parquet")).where("predicted = 1").collect()}
    assert {i for i, _ in kept["quality classifier"]} == good
    last, encoding = C.STAGES[-1][1](spark, edges, small), _encoding()
    got = last.collect()
    assert "text" not in last.columns and len(got) == 8
    for r in got:
        text = {1: "", 2: "", 3: LONG}.get(r["doc_id"])
        if text is not None:
            assert r["ids"] == encoding.encode_ordinary(text) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_long_texts_of_all_kinds(spark):
    """A megabyte through the operators that read words and spans."""
    text = (LONG + " 4111 1111 1111 1111 x@y.example ")[:1_000_000]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ids = byte_bpe.digests(docs, C.RANKS, P.PATTERN, with_ids=True).first()["ids"]
    assert ids == _encoding().encode_ordinary(text)
    found = pii.find(docs).first()
    assert [(s["start"], s["kind"], s["end"]) for s in found["pii_spans"] if s["kind"] < 4] == brute(text)
