import html as H
import re

import numpy as np

from residua.llm import html_text
from residua.llm.html_text import extract, main_text

LONG = "A long paragraph of plain words that nobody would take for a menu or an advert at all."


def test_article_without_its_surroundings():
    html = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='ad'>{LONG}</div><article><h1>H &amp; h</h1><p><b>{LONG}<br><p>Ok.</p><script>var t='</p>';</script><aside>side</aside><form>mail<input></form><div class='comments'><p>{LONG}</p></div></article><footer>&copy; me</footer></body></html>"
    assert extract(html) == f"H & h {LONG} Ok."


def test_without_article():
    html = f"<body><div id=menu><a>Home</a> <a>News</a></div><div class=text><h1>T</h1><p>{LONG}</p><p>So <i>it</i>\n\n is.</p></div><div id=cookie-notice>{LONG}</div></body>"
    assert extract(html) == f"T {LONG} So it is."


def test_edges(spark):
    assert [extract(x) for x in (None, "", "<p></p>", "<nav>x</nav>")] == [""] * 4
    assert extract("just text") == "just text"
    assert len(extract("<article>" + "<p>word word word</p>" * 20_000 + "</article>")) == 20_000 * 15 - 1
    pages = spark.createDataFrame([(1, None, "a"), (1, f"<p>{LONG}", "b"), (1, f"<p>{LONG}", "b")], "page_id int, html string, text string")
    assert sorted(r["n_chars"] for r in main_text(pages).collect()) == [0, len(LONG), len(LONG)]
    assert main_text(pages.limit(0)).count() == 0


def _article(html):
    """What stands in the article element, cut out by its tags."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = (" ".join(H.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p|br)\b[^>]*>", inner))
    return " ".join(b for b in blocks if b)


def test_pages(spark, small):
    for r in main_text(spark.read.parquet(f"{small}/pages.parquet")).collect():
        assert r["text"] == _article(r["html"])


def test_clusters_decide_without_names(spark, small, monkeypatch):
    """Pages without article element and class names: nothing but the ratio tells the text from the advert."""
    pages = [r["html"] for r in spark.read.parquet(f"{small.replace('0.001', '0.01')}/pages.parquet").select("html").collect()]
    plain = [re.sub(r"<(/?)article>", r"<\1div>", p).replace(' class="ad"', "") for p in pages]
    right = sum(extract(p) == _article(q) for p, q in zip(plain, pages, strict=True))
    assert right >= 0.95 * len(pages)
    monkeypatch.setattr(html_text, "smooth_by_section", lambda values, sections: np.ones(len(values)))
    assert sum(extract(p) == _article(q) for p, q in zip(plain, pages, strict=True)) < 0.05 * len(pages)


def test_regions():
    short = "<p>Short.</p>"
    assert extract(f"<div><p>Buy now.</p></div><div>{short}<div><p>{LONG}</p><p>{LONG}</p></div></div><div><p>Menu of the day.</p></div>") == f"{LONG} {LONG}"
    assert extract(f"<div><p>{LONG}</p><div>{short}</div><p>{LONG}</p></div>") == f"{LONG} Short. {LONG}"
    assert extract(f"<article><section>{short}</section><section><p>{LONG}</p></section><section>{short}</section></article><div>{short}</div>") == f"Short. {LONG} Short."
    assert extract(f"<div id=content><div class=body>{f'<p>{LONG}</p>' * 100}</div><div class=more><p>{LONG}</p></div></div>") == " ".join([LONG] * 101)


def test_time_is_linear_in_open_elements():
    import time

    def seconds(html):
        began = time.process_time()
        extract(html)
        return time.process_time() - began

    for piece in ("<span><h1>", "<div>", "<p><li><span>", "<head><noscript><b>", "</x><i>"):
        assert seconds(piece * 40_000) < 20 * max(seconds(piece * 4_000), 0.02)


def test_head_without_end_tag():
    assert extract("<html><head><title>T</title><body><article><p>Hello</p></article></body></html>") == "Hello"
    assert extract("<head><meta charset=utf-8><style>p{}</style><noscript><p>no</p></noscript><template><div>t</div></template><p>Hello <b>you</b>") == "Hello you"
    assert extract("<head><script>x</script></head><body><p>Hello") == "Hello"


def test_second_block_of_a_long_page():
    more = " ".join(["More", LONG])
    for n in (50, 110):
        html = f"<body><div id=menu><a>Home</a></div><div id=content><div class=body>{f'<p>{LONG}</p>' * n}</div><div class=more>{f'<p>{more}</p>' * 6}</div></div></body>"
        assert extract(html) == " ".join([LONG] * n + [more] * 6)


def test_names_alone_delete_nothing():
    prose = "Prose of some length about the work of others, which a name should not hide from the reader of the article. " * 3
    prose = prose.strip()
    for inner, want in [
        ('<h2 id="search">Search</h2>', "Search"), (f'<div class="related-work"><p>{prose}</p></div>', prose), (f'<section id="alert-levels"><p>{prose}</p></section>', prose),
        ('<p class="notice">Short.</p>', "Short."), (f'<section id="search"><h2>Search</h2>{f"<p>{prose}</p>" * 2}</section>', None),
    ]:
        got = extract(f"<body><article><h1>T</h1><p>{LONG}</p>{inner}<p>{LONG}</p></article></body>")
        if want is not None:
            assert got == f"T {LONG} {want} {LONG}"
    # Where the clusters find nothing else that is content, a name does not empty the page.
    assert extract(f"<body><div class=search><p>{LONG}</p></div></body>") == LONG
    # Names of nothing but listed words weigh, in the middle of a text too.
    for name in ("ad", "comment-list", "cookie_notice top", "site-sidebar"):
        assert extract(f"<body><div><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div><p>{LONG}</p></div></body>") == f"{LONG} {LONG}"


def test_clusters_decide_on_pages_as_they_are(spark, small, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").select("html").collect()]
    monkeypatch.setattr(html_text, "smooth_by_section", lambda values, sections: np.ones(len(values)))
    assert sum(extract(p) != _article(p) for p in pages) > 0.5 * len(pages)
