"""Personal data: fixed formats, and bootstrapped contextual extraction beyond them.

One scan of the text finds the base spans, which are the seed entities, and what
else may be an identifier: every run of neighbouring words that hold a digit or
an at sign, whatever its shape.  Each occurrence of either induces lexical
patterns, its slot between the words around it: the two words before, and the
words on either side, whole.  Patterns and instances form a graph that Spark
scores in rounds, to rest.  A pattern is of the kind of the instances believed in
its slot, and as good as the share of its distinct instances that are believed;
an instance that no format knows is believed by noisy-or over its patterns, of
any kind.  Seeds keep belief one and never change their kind.  What stands in the
slot of a pattern of high confidence and enough strong instances is extracted as
its kind if its own belief is high, and then supports further patterns itself.

Besides the four kinds there are secrets: values in quotes that are assigned to
a name such as token or password.  They are seeds of a kind of their own.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.llm._shared import let_go, materialize, scratch

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
ALL_KINDS = (*KINDS, "secret")
DAMPING, SUPPORT, CONFIDENCE, BELIEF = 0.9, 2, 0.5, 0.4
#: Instances believed so much count as support; at rest, all beliefs together rise by
#: less than this share of theirs, or of one if they are less.
STRONG, REST = 0.8, 1e-3
#: Words and instances of more characters stand in the graph by a digest.
LONG = 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SIGN = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")
_LETTER = re.compile(r"[^\W\d_]")
# Names that values in quotes are secret under.
_SECRET = re.compile(r"""(?:token|secret|passwd|password|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?["']?[\x20\t]{0,8}[:=][\x20\t]{0,8}(["'])([^\s"']{8,})\1""", re.I)
_BEFORE, _AFTER = "\"'`([{<", "\"'`.,;:!?)]}>"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        # No local part reaches over this sign, and none begins inside a match.
        floor = found.end() if found else at + 1
        at = text.find("@", floor)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, at = run[0].split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the check-digit rule of card numbers."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end) of every base span, sorted; code points, end
    exclusive.  Time is linear in the text, whatever it holds."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(a, 1, b) for a, b in _addresses(text)]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, SECRET, end) of every value in quotes under the name of a secret."""
    if "=" not in text and ":" not in text:
        return []
    return [(m.start(2), SECRET, m.end(2)) for m in _SECRET.finditer(text)]


def runs(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of words with a digit or an at sign, single spaces between them, that
    touch no span of ``taken`` (sorted); brackets and marks around a run are not
    part of it.  Time is linear in the text."""
    out: list[list[int]] = []
    hit, floor, k, reach = _SIGN.search(text), 0, 0, -1
    while hit:
        start = hit.start()
        while start > floor and not text[start - 1].isspace():
            start -= 1
        word = _WORD.match(text, start)
        end = floor = word.end()
        while k < len(taken) and taken[k][0] < end:
            reach = max(reach, taken[k][2])
            k += 1
        if reach <= start:
            if out and out[-1][1] + 1 == start and text[start - 1] == " ":
                out[-1][1] = end
            else:
                out.append([start, end])
        hit = _SIGN.search(text, end)
    found = []
    for a, b in out:
        opened, closed = "(" in text[a:b], ")" in text[a:b]
        while text[a] in _BEFORE and not (text[a] == "(" and closed):
            a += 1
        while text[b - 1] in _AFTER and not (text[b - 1] == ")" and opened):
            b -= 1
        found.append((a, b))
    return found


def _short(word: str) -> str:
    return word if len(word) <= LONG else hashlib.md5(word.encode()).hexdigest()


class Contexts:
    """The lexical patterns around spans of one text."""

    def __init__(self, text: str):
        self.text = text
        found = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]

    @staticmethod
    def _plain(word: str) -> str:
        """A word without the marks around it; marks alone stand for themselves."""
        return _short((word.strip(".,;:!?\"'`()[]{}<>") or word).lower())

    def of(self, start: int, end: int) -> list[str]:
        """The patterns of a span, ``_`` for its slot; ^ and $ stand before and
        after the text.  A pattern without letters says nothing and is left out."""
        k = bisect_right(self.starts, start) - 1  # the word that the span begins in
        left = [self.text[self.starts[j] : self.ends[j]] for j in range(max(0, k - 2), k)]
        glued = self.text[self.starts[k] : start]
        if _LETTER.search(glued):
            left.append(glued)
        k = bisect_left(self.ends, end)  # the word that it ends in
        glued = self.text[end : self.ends[k]]
        right = glued if _LETTER.search(glued) else self.text[self.starts[k + 1] : self.ends[k + 1]] if k + 1 < len(self.starts) else ""
        two, one = (["", "", *map(self._plain, left)])[-2:]
        after = self._plain(right) if right else ""
        out = []
        if _LETTER.search(two + one):
            out.append(f"{two or '^'} {one or '^'} _")
        if _LETTER.search(one + after):
            out.append(f"{one or '^'} _ {after or '$'}")
        return out


_SPAN = "struct<start:bigint,kind:int,end:bigint>"
_MARK = "struct<start:bigint,kind:int,end:bigint,instance:string,patterns:array<string>>"


def _scan(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """For each row: keep, __row, __base, __sha, __marks (seeds of a kind, and runs of kind -1, with patterns)."""
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__residua_text"))
    held = frame.drop("__residua_text").schema
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in held], "__residua_row string", f"__residua_base array<{_SPAN}>", "__residua_sha string", f"__residua_marks array<{_MARK}>"])
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    mark = pa.struct([*span, pa.field("instance", pa.string()), pa.field("patterns", pa.list_(pa.string()))])

    def marks(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
        seeds = sorted(base + secret_spans(text))
        spans = [*seeds, *((a, -1, b) for a, b in runs(text, seeds))] if _SIGN.search(text) else seeds
        if not spans:
            return []
        around = Contexts(text)
        return [{"start": a, "kind": k, "end": b, "instance": _short(text[a:b].lower()), "patterns": around.of(a, b)} for a, k, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, bases, shas, all_marks = [], [], [], []
            for value in batch.column(batch.num_columns - 1):
                own = value.as_py() or ""
                base = base_spans(own)
                rows.append(f"{part}-{n}")
                n += 1
                bases.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest())
                all_marks.append(marks(own, base))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.string()), pa.array(bases, pa.list_(span)), pa.array(shas, pa.string()), pa.array(all_marks, pa.list_(mark))], names=[*held.names, "__residua_row", "__residua_base", "__residua_sha", "__residua_marks"])

    return frame.mapInArrow(run, schema)


def score_graph(occurrences: DataFrame, damping: float = DAMPING, rest: float = REST) -> tuple[DataFrame, DataFrame]:
    """Score a graph ``occurrences(pattern, instance, own)`` of distinct rows, where
    ``own`` is the kind of a seed and -1 for any other instance.

    Returns ``patterns(pattern, kind, confidence)``, those with enough strong
    instances of a kind, and ``instances(instance, kind, belief)``, seeds too.  An
    instance that is a seed anywhere is one everywhere, with belief one in its own
    kinds and in no other, so that there is one belief for each instance and kind
    and no confidence is above one.  Each round is aggregations with partial sums and
    equi-joins; the scores go through the shared folder.  Beliefs only rise, so the
    rounds end: when a round adds less than ``rest`` of all beliefs together to them.
    """
    seeds = materialize(occurrences.where("own >= 0").select("instance", F.col("own").alias("kind")).distinct().withColumn("belief", F.lit(1.0)), "pii-seeds")
    beliefs, total, k = seeds, 0.0, 0
    pairs = materialize(occurrences.select("pattern", "instance").distinct(), "pii-pairs")
    sizes = materialize(pairs.groupBy("pattern").agg(F.count("*").alias("size")), "pii-sizes")
    unknown = materialize(pairs.join(seeds.select("instance").distinct(), "instance", "left_anti"), "pii-unknown")
    while True:
        # An instance believed of several kinds counts for each; a seed only for its own.
        stood = pairs.join(beliefs, "instance")
        scored = stood.groupBy("pattern", "kind").agg(F.sum("belief").alias("believed"), F.count_if(F.col("belief") >= STRONG).alias("support")).where(F.col("support") >= SUPPORT)
        scored = materialize(scored.join(sizes, "pattern").select("pattern", "kind", F.least(F.col("believed") / F.col("size"), F.lit(1.0)).alias("confidence")), f"pii-patterns-{k}")
        noisy = unknown.join(scored, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-damping * F.col("confidence"))))).alias("belief"))
        found = materialize(noisy, f"pii-instances-{k}")
        before, total = total, found.agg(F.coalesce(F.sum("belief"), F.lit(0.0))).first()[0]
        if total - before < rest * max(1.0, total):
            return scored, seeds.unionByName(found)
        beliefs, k = seeds.unionByName(found), k + 1


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Personal data in every whole text.

    Returns the columns ``keep`` (all of ``docs`` if None) and n_email, n_ip,
    n_card, n_phone (long, base spans), base_sha256, pii_spans
    (array<struct<start, kind, end>>, all spans in order of start then kind, kind
    an index into ALL_KINDS), n_secret, n_added (long: spans that patterns have
    extracted) and n_found (long, all spans).  Null and empty texts have no
    spans; repeated rows are each searched; an empty table gives an empty
    result; columns named like the new ones are replaced.

    Text is read once and never shuffled: the scan writes one small row for
    each document (and whatever ``keep`` asks for) to the shared folder, and
    only rows with candidates meet the scored graph.
    """
    new = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "pii_spans", "n_secret", "n_added", "n_found"]
    held = [c for c in (docs.columns if keep is None else keep) if c not in new]
    with scratch(docs.sparkSession):
        found = materialize(_scan(docs, text, held), "pii-found", keep=True)
        marks = found.where(F.size("__residua_marks") > 0).select("__residua_row", F.explode("__residua_marks").alias("m")).select("__residua_row", "m.start", "m.end", "m.kind", "m.instance", F.explode("m.patterns").alias("pattern"))
        marks = materialize(marks, "pii-marks")
        graph = materialize(marks.select("pattern", "instance", F.col("kind").alias("own")).distinct(), "pii-graph")
        scored, believed = score_graph(graph)
        good = scored.where(F.col("confidence") >= CONFIDENCE).select("pattern", F.col("kind").alias("as"))
        spans = marks.where("kind < 0").join(good, "pattern").join(believed.where(F.col("belief") >= BELIEF).select("instance", F.col("kind").alias("as"), "belief"), ["instance", "as"])
        # One span is extracted once, as the kind of highest belief, the first of equals.
        best = spans.groupBy("__residua_row", "start", "end").agg(F.max(F.struct("belief", (-F.col("as")).alias("less"))).alias("best"))
        added = materialize(best.groupBy("__residua_row").agg(F.collect_list(F.struct(F.col("start"), (-F.col("best.less")).alias("kind"), F.col("end"))).alias("__residua_added")), "pii-added", keep=True)
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    maybe = F.exists("__residua_marks", lambda m: m["kind"] < 0)
    both = found.where(~maybe).withColumn("__residua_added", none).unionByName(found.where(maybe).join(added, "__residua_row", "left").withColumn("__residua_added", F.coalesce("__residua_added", none)))
    secrets = F.transform(F.filter("__residua_marks", lambda m: m["kind"] == SECRET), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    every = F.array_sort(F.concat("__residua_base", secrets, "__residua_added"))
    count = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return both.withColumn("__residua_all", every).select(
        *[F.col(f"`{c}`") for c in held],
        *[count("__residua_base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.col("__residua_sha").alias("base_sha256"),
        F.col("__residua_all").alias("pii_spans"),
        count("__residua_all", SECRET).alias("n_secret"),
        F.size("__residua_added").cast("long").alias("n_added"),
        F.size("__residua_all").cast("long").alias("n_found"),
    )


def spans_text(spans: str = "pii_spans"):
    """All spans of the four kinds as kind:start:end joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    personal = F.filter(F.col(spans), lambda s: s["kind"] < len(KINDS))
    return F.array_join(F.transform(personal, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def hidden(text: str, spans: list[dict]) -> str:
    """``text`` with each span, in order of their starts, replaced by its kind in square
    brackets; spans that overlap an earlier one go with it.  Linear in both."""
    out, at = [], 0
    for span in spans:
        if span["start"] >= at:
            out += [text[at : span["start"]], f"[{ALL_KINDS[span['kind']]}]"]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def _hidden(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([None if t is None else hidden(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())


def mask(text: str = "text", spans: str = "pii_spans") -> Column:
    """The text with each span replaced by its kind in square brackets, e.g.
    ``[email]``; spans that overlap an earlier one go with it.  Null stays null; only
    texts with spans go to Python."""
    some = F.size(spans) > 0
    masked = F.arrow_udf(_hidden, "string")
    return F.when(some, masked(F.when(some, F.col(text)), F.when(some, F.col(spans)))).otherwise(F.col(text))
