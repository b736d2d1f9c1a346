"""The tokenizer and the selector subset on small pages."""

import pytest

from pyspark.sql import functions as F

from freshet.operators import selectors
from freshet.operators.markup import decode_page, find_anchors
from freshet.operators.parse import parse_pages


def hrefs(page, skip_navigation=True):
    return [href for _, href, _, _ in find_anchors(page, skip_navigation)[1]]


def titles(page):
    return [title for _, _, title, _ in find_anchors(page, True)[1]]


@pytest.fixture(scope="module")
def selected(spark):
    """What selectors choose on pages: (page, selector) pairs to lists of addresses, None for an unsupported selector."""

    def choose(pairs):
        rows = [(k, page, selector, True) for k, (page, selector) in enumerate(pairs)]
        parsed = parse_pages(spark.createDataFrame(rows, "k int, html string, selector string, skip_navigation boolean"))
        parsed = parsed.withColumn("chains", selectors.chains(F.col("selector")))
        chosen = F.filter("anchors", lambda a: selectors.is_selected(a["path"], F.col("chains")))
        out = parsed.select("k", F.when(~selectors.is_unsupported(F.col("selector")), F.transform(chosen, lambda a: a["href"])).alias("found"))
        return [r.found for r in out.orderBy("k").collect()]

    return choose


@pytest.mark.parametrize(
    "page, want",
    [
        ("<a href=/x>t</a>", ["/x"]),
        ("<A HREF='/x'>t</A>", ["/x"]),
        ("<a name=x>t</a><a>u</a>", []),
        ("<!-- <a href=/no>t</a> --><a href=/y>t</a>", ["/y"]),
        ("<script>var s='<a href=/no>'</script><a href=/y>", ["/y"]),
        ("<style>a{}</style><!DOCTYPE html><?pi?><a href=/y/>", ["/y/"]),
        ('<a title="a > b" href="/q?a=1&amp;b=2&copy=3">t</a>', ["/q?a=1&b=2&copy=3"]),
        ('<a href="/open>t</a><a href=/lost>', ["/open>t</a><a href=/lost>"]),
        ("<a href=/1 href=/2>t</a>", ["/1"]),
        ("a < b <a href=/x>t</a> c <", ["/x"]),
        ("<nav><div></nav><a href=/in>x</a></div></nav><a href=/out>y</a>", ["/out"]),
        ("<nav><b></nav><a href=/out>y</a>", ["/out"]),
        ("<footer/><a href=/out>y</a>", ["/out"]),
    ],
)
def test_anchors(page, want):
    assert hrefs(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<a href=/1>  two\n<b>words</b>　x </a>", ["two words x"]),
        ("<a href=/1>a<!-- no -->b<script>c</script>d</a>", ["a b d"]),
        ("<a href=/1><ruby>漢<rp>(</rp><rt>かん</rt><rp>)</rp></ruby></a>", ["漢"]),
        ("<a href=/1>&lt;x&gt; &#12354;&nbsp;&#x3042; &unknown; &copy</a>", ["<x> あ あ &unknown; &copy"]),
        ("<a href=/1>one<a href=/2>two</a>", ["one", "two"]),
        ("<a href=/1><img alt=' '><img alt='second'><img alt='third'></a>", ["second"]),
        ("<a href=/1 title=' t '><img></a>", ["t"]),
        ("<a href=/1>unclosed", ["unclosed"]),
    ],
)
def test_titles(page, want):
    assert titles(page) == want


LIST = (
    '<div id=main class="c x"><ul class="articles big"><li class=hot><a href=/1>1</a></li><li><p><a href=/2 rel="nofollow me">2</a></p></li></ul>'
    '<a class=more href=/3>3</a></div><nav><ul><li><a href=/4 data-k>4</a></li></ul></nav>'
)


CASES = [
    ("ul.articles a", ["/1", "/2"]),
    ("ul.articles.big", ["/1", "/2"]),
    ("ul > li > a", ["/1", "/4"]),
    ("nav a", ["/4"]),
    ("#main > a, nav", ["/3", "/4"]),
    ("a.more", ["/3"]),
    ("body > nav li", ["/4"]),
    ("*", ["/1", "/2", "/3", "/4"]),
    ("article a", []),
    ("ul>li a", ["/1", "/2", "/4"]),
    ("div ul li p a", ["/2"]),
    ("div > li a", []),
    ("UL.articles LI.hot", ["/1"]),
    (".c.x#main .more", ["/3"]),
    ("html > body > div > ul > li > p > a", ["/2"]),
    ("li a , .more", ["/1", "/2", "/3", "/4"]),
    ('a[rel~="me"]', ["/2"]),
    ("a[data-k]", ["/4"]),
    ("a[href^='/'][href$=\"3\"]", ["/3"]),
    ("ul a[href]", ["/1", "/2", "/4"]),
    ("a[href*='']", []),
    ("[id|=main] > a[class=more]", ["/3"]),
    ("nav a[rel]", []),
]


def test_selectors(selected):
    assert selected([(LIST, s) for s, _ in CASES]) == [want for _, want in CASES]


def test_the_elements_of_the_root_have_attributes(selected):
    page = "<html id=top><body class='k l'><div><a href=/1>1</a><div><a href=/2>2</a></div></div></body></html>"
    cases = [("#top a", ["/1", "/2"]), ("body.k > div > a", ["/1"]), ("html.no a", []), ("div div a", ["/2"]), ("div > div > a", ["/2"]), ("div > a", ["/1", "/2"])]
    assert selected([(page, s) for s, _ in cases]) == [want for _, want in cases]


def test_selectors_outside_the_subset(selected):
    bad = ["a:hover", "ul >", "> a", "a,,b", "a[", "a + b", "..x", "a:nth-child(2)", "a[href=]", "ul ~ a", ","]
    assert selected([(LIST, s) for s in bad]) == [None] * len(bad)


def test_base_is_the_first_with_an_href():
    assert find_anchors("<base target=x><base href=/1><base href=/2>", True)[0] == "/1"


def test_decoding():
    text = "日本語の見出し"
    meta = '<meta http-equiv="Content-Type" content="text/html; charset=%s">'
    assert text in decode_page((meta % "Shift_JIS" + text).encode("cp932"), None)
    assert text in decode_page((meta % "utf-8" + text).encode("euc_jp"), "EUC-JP")
    assert text in decode_page(text.encode(), "no-such-charset")
    assert decode_page(b"\xef\xbb\xbfx", None) == "x"
    assert decode_page(b"caf\xe9", None) == "café"
    # The first label that fits all bytes counts; other codecs are no text.
    assert text in decode_page((meta % "Shift_JIS" + text).encode("cp932"), "utf-8")
    assert decode_page(b"a\xff", "utf-8") == "a\ufffd"


@pytest.mark.parametrize("label", ["hex", "base64", "rot13", "idna", "undefined", "zlib", "punycode", "unicode_escape"])
def test_labels_that_name_no_usable_charset(spark, label):
    page = f"<meta charset={label}><a href=/x>ok</a>".encode()
    rows = [(page, label, None, True), (page, None, None, True), (b"<a href=/y>ok</a>", None, None, True)]
    out = parse_pages(spark.createDataFrame(rows, "content binary, charset_hint string, selector string, skip_navigation boolean")).collect()
    assert [[a.href for a in r.anchors] for r in out] == [["/x"], ["/x"], ["/y"]] and all(r.parse_error is None for r in out)


def test_a_failing_page_fails_alone(spark, monkeypatch):
    from freshet.operators import markup, parse

    def broken(page, *rest):
        raise RecursionError

    class Half:
        decode_page = staticmethod(markup.decode_page)
        find_anchors = staticmethod(lambda page, *rest: broken(page) if "bad" in page else markup.find_anchors(page, *rest))

    import pyarrow as pa

    monkeypatch.setattr(parse, "markup", Half)
    batch = pa.RecordBatch.from_pylist([{"html": h, "selector": None, "skip_navigation": True} for h in ("<a href=/1>", "bad", "<a href=/2>")])
    batch = batch.set_column(1, "selector", pa.array([None] * 3, pa.string()))
    (out,) = parse._anchors_of(iter([batch]))
    assert out.column("parse_error").to_pylist() == [None, "RecursionError", None]
    assert [[a["href"] for a in page] for page in out.column("anchors").to_pylist()] == [["/1"], [], ["/2"]]


def test_broken_markup_stays_linear():
    import time

    began = time.time()
    for piece in ("<a \"", "<a href=", "<!--", "<script>", "<nav>", "</div", "&#", "<a b='"):
        find_anchors(piece * 20000, True)
    find_anchors("<ul>" + "<li>" * 5000 + "<b><a href=/x>x</a>", True, True)
    assert time.time() - began < 10
