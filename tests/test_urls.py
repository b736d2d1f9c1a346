"""URL Columns against the standard library on generated and hand-picked URLs."""

import random
import re
from urllib.parse import parse_qsl, urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from freshet.functions import urls

SAFE_QUERY = re.compile(r"(?:[A-Za-z0-9_.~+-]|%[0-9A-F]{2}|[=&])*")
BASES = [
    "https://press.harbour.test/board/",
    "http://a.example/x/y/z.html?q=1#f",
    "http://a.example",
    "https://a.example/d;p=1/e;v=2?k",
    "HTTP://A.example:80/b//c/",
    "http://a.example//p/q",
]
PIECES = ["a", "b.html", "..", ".", "", "日本", "x;y", ";", ";z=1", "%7e", "%zz", "%", "A b", "~u", "...", ".h", "*"]
QUERIES = [
    "", "?", "?a=1", "?utm_source=x&b=2", "?UTM_x=1", "?a", "?a=&b", "?&&c=%E3%81%82", "?q=%ff", "?q=%zz+x y*~'",
    "?fbclid=1&_ga=2", "?a=b=c", "?a;b=1", "?日=本", "?%75tm_source=1&d=/", "?+=+",
]
HOSTS = [
    "//b.example", "//B.Example:443", "//b.example:80", "http://c.example", "https://c.example:443", "HTTPS://C.example:80",
    "ftp://d.example", "mailto:x", "http:", "https:", "//u:p@e.example:8080", "//[::1]:80", "//[::1", "//x]", "http://[v1.a]",
    "http://[1::2::3]", "http://a[::1]", "//[1:2:3:4:5:6:7::]", "//[::1.2.3.4]", "//[1.2.3.4]", "//ex℀mple", "//日本.example",
]
HAND = [
    "", "#x", "?p=1", "/", "//", "///x", "////x", "../..", "./", "..", ".", "a/./b/../../..//c", "/l/../a/./b/../../..//c",
    "\thttp://a.example/\nx", " /y", "/x\ny", "a//b", "/a//b", "x:y", "1:2", "g;x=1/../y", "g?y/../x", ";x", "..;x", "a/..",
]


def generated(n=3000):
    rng = random.Random(7)
    for _ in range(n):
        head = rng.choice(["", "", "", "/", "/", rng.choice(HOSTS)])
        path = "/".join(rng.choice(PIECES) for _ in range(rng.randrange(5)))
        if "//" in head and path:
            path = "/" + path
        yield head + path + rng.choice(QUERIES) + rng.choice(["", "", "#f", "#a?b"])


def or_none(f, *args):
    try:
        return f(*args)
    except ValueError:
        return None


def test_join_and_normalise_agree_with_the_standard_library(spark):
    rows = [(b, r) for b in BASES for r in HAND]
    rows += [(random.Random(i).choice(BASES), r) for i, r in enumerate(generated())]
    got = (
        spark.createDataFrame(rows, "base string, ref string")
        .select("base", "ref", urls.split_url(F.col("base")).alias("b"), urls.split_url(F.col("ref")).alias("r"))
        .select("base", "ref", "r", urls.resolve(F.col("b"), F.col("r")).alias("joined"))
        .select("*", urls.compose_canonical(F.col("joined")).alias("canonical"), urls.is_bad_netloc(F.col("r")[1]).alias("bad"))
        .collect()
    )
    wrong = []
    tracked = {*urls.TRACKING_PARAMS}
    for row in got:
        want = or_none(lambda: urlsplit(urljoin(row["base"], row["ref"])))
        if want is None or row["bad"]:
            if (want is None) != row["bad"]:
                wrong.append((row["base"], row["ref"], want, row["bad"]))
            continue
        if want.scheme not in ("http", "https"):
            assert row["joined"][0] not in ("http", "https")
            continue
        # What the join must keep, and what the canonical form must look like, whatever went in.
        have = urlsplit(row["canonical"])
        parameters = parse_qsl(have.query, keep_blank_values=True)
        given = parse_qsl(want.query, keep_blank_values=True)
        lost = [p for p in given if p not in parameters]
        fine = (
            (have.scheme, have.path, have.fragment) == (want.scheme, want.path or "/", "")
            and have.netloc == have.netloc.lower()
            and want.netloc.lower() in (have.netloc, have.netloc + ":80", have.netloc + ":443")
            and SAFE_QUERY.fullmatch(have.query) is not None
            and [p for p in given if p not in lost] == parameters
            and all(name.lower().startswith("utm_") or name.lower() in tracked for name, _ in lost)
            and not any(name.lower().startswith("utm_") or name.lower() in tracked for name, _ in parameters)
        )
        if not fine:
            wrong.append((row["base"], row["ref"], want.geturl(), row["canonical"]))
    assert wrong == []


def test_normalising_twice_changes_nothing(spark):
    rows = [(urljoin(BASES[0], r),) for r in generated(1500) if or_none(urljoin, BASES[0], r)]
    df = spark.createDataFrame(rows, "u string").withColumn("once", urls.normalize_url(F.col("u")))
    df = df.withColumn("twice", urls.normalize_url(F.col("once")))
    assert df.filter(F.col("u").startswith("http") & (F.col("once") != F.col("twice"))).collect() == []


@pytest.mark.parametrize(
    "url, want",
    [
        ("Https://Quay.Harbour.TEST:443/B?z=1&UTM_Term=q&a=2&gclid=7#top", "https://quay.harbour.test/B?z=1&a=2"),
        ("http://harbour.test:80?", "http://harbour.test/"),
        ("https://harbour.test:80/x", "https://harbour.test:80/x"),
        ("http://harbour.test:8080/ö?q=ö+%7e*", "http://harbour.test:8080/ö?q=%C3%B6+~%2A"),
        ("http://harbour.test/?a=&b", "http://harbour.test/?a=&b="),
        ("http://[x", None),
        ("http://[::1]:80/x", "http://[::1]/x"),
    ],
)
def test_canonical_form(spark, url, want):
    got = spark.createDataFrame([(url,)], "u string").select(urls.normalize_url(F.col("u"))).first()[0]
    assert got == want


@pytest.mark.parametrize(
    "link, page, allow, want",
    [
        ("tides.harbour.test", "www.harbour.test", [], True),
        ("harbour.test", "harbour.test", [], True),
        ("a.b.harbour.test", "harbour.test", [], True),
        ("harbour.test", "tides.harbour.test", [], False),
        ("harbour.example", "harbour.test", [], False),
        ("img.depot.example", "harbour.test", ["else.example", "depot.example"], True),
        ("depot.example.harbour", "harbour.test", ["depot.example"], False),
        ("harbour.test:8443", "harbour.test", [], False),
        ("oldharbour.test", "harbour.test", [], False),
    ],
)
def test_same_site(spark, link, page, allow, want):
    df = spark.createDataFrame([(link, page, allow)], "l string, p string, a array<string>")
    assert df.select(urls.is_same_site(F.col("l"), F.col("p"), F.col("a"))).first()[0] is want


def test_join_url_and_path_prefix(spark):
    df = spark.createDataFrame(
        [("https://a.jp/x/", "../y?z#f", "https://a.jp/log/book/7/x"), ("https://a.jp/", "//[x", "https://a.jp/index.html")],
        "b string, r string, u string",
    )
    got = df.select(urls.join_url(F.col("b"), F.col("r")), urls.path_prefix(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("https://a.jp/y?z", "/log/book"), (None, "/")]
    assert df.select(urls.parent_hosts(F.lit("Blog.a.b"))).first()[0] == ["a.b", "b"]
