import hashlib
import random
import re

from residua.llm import pii


def brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(map(int, str(int(c) * 2))) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rnd = random.Random(3)
    for _ in range(20_000):
        letters = rnd.choice(["ab@.%", "12.@ -+()", "19. 25-", "+1 (52)-.@a", "a@.b-%é٣"])
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        assert brute(t) == pii.base_spans(t), t


def test_long_texts_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1 " * 100_000, "@" * 200_000):
        pii.base_spans(t)


ROWS = [(i, f"call me at phone {p} now", "c") for i, p in enumerate(["+1 (521) 555-6210", "+1 (521) 555-6211", "+44 20 7946 0958", "(521) 555-6219", "521-555-6212"])]


def test_contexts_discover_and_masks_hide(spark):
    docs = spark.createDataFrame([*ROWS, (9, None, None), (9, None, None), (10, "", "x"), (11, "version 123-456-7890 here", "x")], "doc_id int, text string, n_ip string")
    got = pii.find(docs).select("doc_id", "text", "n_phone", "n_added", "base_sha256", pii.spans_text().alias("s"), pii.mask().alias("m")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(ROWS) + 4
    assert by[3]["n_added"] == 1 and by[3]["s"] == "phone:17:31" and by[3]["n_phone"] == 0 and by[4]["m"] == "call me at phone [phone] now"
    assert by[11]["s"] == "" and by[9]["m"] is None and by[10]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark):
    assert pii.find(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    for r in pii.find(docs).collect():
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute(r["text"] or ""))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_rounds_go_to_rest(spark):
    # Two of twenty in a context are known: confidence 0.10, 0.26, 0.47, 0.70, ...
    known = [f"+1 (521) 555-62{k:02}" for k in range(2)]
    unseen = [f"521-555-{1000 + k}" for k in range(18)]
    rows = [(k, f"call me at phone {p} now") for k, p in enumerate(known + unseen)]
    # A context that only discovered ones have, and one more there.
    rows += [(100 + k, f"my new pager number {p} today") for k, p in enumerate([*unseen[:3], "521-555-7777"])]
    rows += [(200, "version of build 123-456-7890 here")]
    got = {r["doc_id"]: r["n_added"] for r in pii.find(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert all(got[k] == 1 for k in range(2, 20)) and got[103] == 1
    assert got[0] == got[1] == got[200] == 0


def test_runs_are_found_in_linear_time():
    for t in ("1 " * 150_000, "a1" * 150_000, "((1))" * 60_000, "@ " * 150_000, "token='" * 40_000, "x1\t" * 100_000):
        base = pii.base_spans(t)
        pii.runs(t, sorted(base + pii.secret_spans(t)))
    assert pii.runs("call (020) 7946 0958, or 1@x.y. now", []) == [(5, 20), (25, 30)]
    assert pii.runs("a 5 b@c 6 d", [(4, 0, 7)]) == [(2, 3), (8, 9)]


def test_contexts_take_whole_words():
    long = "w" * 5_000
    text = f"say {long} (555-1234) {'v' * 70}, end"
    got = pii.Contexts(text).of(text.index("555"), text.index("555") + 8)
    md5 = lambda w: hashlib.md5(w.encode()).hexdigest()
    assert got == [f"say {md5(long)} _", f"{md5(long)} _ {md5('v' * 70)}"]
    assert pii.Contexts("12").of(0, 2) == [] and pii.Contexts("| 12 |").of(2, 4) == [] and pii.Contexts("tel:12").of(4, 6) == ["^ tel _", "tel _ $"]


def test_secrets_and_ties(spark):
    rows = [(k, f'export API_TOKEN = "{k}abcdef0123456789" done') for k in range(4)] + [(9, 'export API_TOKEN = <<xyz-77-unquoted>> done'), (10, "both 1.2.3.4 1.2.3.4 here"), (10, "both 1.2.3.4 1.2.3.4 here")]
    got = pii.find(spark.createDataFrame(rows, "doc_id int, text string")).select("*", pii.mask().alias("m"), pii.spans_text().alias("s")).collect()
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["n_secret"] == 1 and by[k]["m"] == 'export API_TOKEN = "[secret]" done' and by[k]["s"] == "" for k in range(4))
    assert by[9]["n_secret"] == by[9]["n_added"] == 1 and by[9]["m"] == "export API_TOKEN = <<[secret]>> done"
    assert [r["n_ip"] for r in got if r["doc_id"] == 10] == [2, 2] and by[10]["m"] == "both [ip] [ip] here"


def test_precision_and_recall_of_discovery(spark, small):
    """Identifiers that no format knows, planted into prose in contexts that known ones stand in too."""
    rnd = random.Random(11)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    known = {
        "email": lambda: f"{digits(4)}@mail{digits(2)}.example.com",
        "ip": lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4)),
        "phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}",
    }
    unseen = {
        "email": [lambda: f"jörg{digits(3)}@büro.example", lambda: f"u{digits(5)} at mail{digits(1)}"],
        "ip": [lambda: ":".join(f"{rnd.randint(4096, 65535):x}" for _ in range(8)), lambda: f"0x{rnd.randint(1 << 28, 1 << 32):x}1"],
        "phone": [lambda: f"{digits(3)}-555-{digits(4)}", lambda: f"({digits(3)}) 555 {digits(4)}"],
    }
    frames = {"email": ["please write to {} for details", "her mailbox is {} since"], "ip": ["connection from host {} was refused", "the server at {} went down"], "phone": ["you can call {} at any", "his mobile number {} is busy"]}
    noise = ["in the year {} there", "page {} of the report", "a price of {} euros and", "build {} was released", "chapter {} begins", "about {} people came"]
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect() if r["text"]]
    rows, truth, false = [], 0, 0
    for k in range(600):
        words = rnd.choice(texts).split()[:60]
        words = [w for w in words if not re.search(r"[0-9@]", w)]
        kind = rnd.choice(list(frames))
        if k % 3 == 0:
            value, want = known[kind](), 0
        elif k % 3 == 1:
            value, want = rnd.choice(unseen[kind])(), 1
            if " at " in value:  # only its parts with digits can be found
                value = value.replace(" at ", "@")
        else:
            value, want, kind = digits(rnd.randint(2, 9)), 0, "noise"
        frame = rnd.choice(noise if kind == "noise" else frames[kind])
        at = rnd.randint(0, len(words))
        rows.append((k, " ".join([*words[:at], frame.format(value), *words[at:]]), kind, value, want))
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id int, text string")).collect()}
    hit = wrong = 0
    for k, text, kind, value, want in rows:
        added = [(text[s["start"] : s["end"]], pii.ALL_KINDS[s["kind"]]) for s in got[k]["pii_spans"]] if got[k]["n_added"] else []
        truth += want
        hit += want and (value, kind) in added
        wrong += len(added) - (want and (value, kind) in added)
    assert hit >= 0.9 * truth and wrong <= 0.05 * hit, (hit, truth, wrong)


def test_seeds_in_plain_places_have_one_belief(spark):
    values = [f"zq{k}x-77-hidden{k}" for k in range(4)]
    rows = [(k, f'config password = "{v}" set') for k, v in enumerate(values[:3])] + [(10 + k, f"the unlock code {v} works well") for k, v in enumerate(values)] + [(20, "version 4.4-rc was built")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: r["m"] for r in pii.find(docs).select("doc_id", pii.mask().alias("m")).collect()}
    assert all(got[10 + k] == "the unlock code [secret] works well" for k in range(4)) and got[20] == "version 4.4-rc was built"
    graph = [("p", v, pii.SECRET) for v in values[:3]] + [("q", v, -1) for v in values] + [("p", "a@b.c", 0), ("q", "a@b.c", 0), ("q", "a@b.c", pii.SECRET)]
    scored, believed = pii.score_graph(spark.createDataFrame(graph, "pattern string, instance string, own int"))
    assert all(0 <= r["confidence"] <= 1 for r in scored.collect())
    rows = [(r["instance"], r["kind"], r["belief"]) for r in believed.collect()]
    assert len({r[:2] for r in rows}) == len(rows) and all(0 <= r[2] <= 1 for r in rows)
    assert {r[:2] for r in rows if r[0] == "a@b.c"} == {("a@b.c", 0), ("a@b.c", pii.SECRET)}


def test_masks_of_many_and_overlapping_spans(spark):
    text = "1.2.3.4 " * 50_000
    spans = [{"start": a, "kind": k, "end": b} for a, k, b in pii.base_spans(text)]
    assert pii.hidden(text, spans) == "[ip] " * 50_000
    rnd = random.Random(1)
    for _ in range(200):
        some = sorted((rnd.randrange(40), rnd.randrange(5), 0) for _ in range(rnd.randrange(8)))
        some = [(a, k, a + rnd.randint(1, 12)) for a, k, _ in some]
        own, want, at = "abcdefghij" * 5, "", 0
        for a, k, b in some:
            if a >= at:
                want += own[at:a] + f"[{pii.ALL_KINDS[k]}]"
            at = max(at, b)
        assert pii.hidden(own, [{"start": a, "kind": k, "end": b} for a, k, b in some]) == want + own[at:]
    rows = [(1, None), (2, ""), (3, "nothing"), (4, "é 1.2.3.4 ü 1.2.3.4")]
    got = {r["doc_id"]: r["m"] for r in pii.find(spark.createDataFrame(rows, "doc_id int, text string")).select("doc_id", pii.mask().alias("m")).collect()}
    assert got == {1: None, 2: "", 3: "nothing", 4: "é [ip] ü [ip]"}
