"""Extraction: every case is a site of its own, all go through in one job."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from freshet.operators.extract import NO_LINKS, explode_links, extract, path_prefix_stats, same_site_pairs
from freshet.operators.report import inspect_links

PAGE = "https://press.harbour.test/board/"
HOST = "https://press.harbour.test"
TS = datetime(2026, 8, 3)

# A notice board: two notices, one in the archive, and everything that is none.
BOARD = """<html><body><header><a href="/">Harbour</a><a href="/signin">Members</a></header>
<section id="notices"><h2><a href="notice-41">Ferry timetable</a></h2>
<h2><a href="/board/notice-42?utm_campaign=mail&amp;lang=en">Pier closed</a></h2>
<div class="old"><a href="//press.harbour.test/archive/notice-7#p2">Storm of May</a></div></section>
<div><a href="https://tickets.example.net/buy">Tickets</a><a href="map.SVG">Map</a><a href="/atom/">Updates</a><a href="tel:5550">Call</a>
<a href="data:,x">d</a><a href="#notices">Top</a><a href="mailto:x@harbour.test">Mail</a><a href="javascript:go()">Go</a></div></body></html>"""
TIDES = """<nav><a href=/depths>Depths</a></nav><article><a href=/tides/today>Today</a><p><a href=/tides/week>Week</a></p>
<footer><a href=/imprint>Imprint</a></footer></article><header><a href=/harbour-news>News</a></header>"""
N = [f"{HOST}/board/notice-41", f"{HOST}/board/notice-42?lang=en", f"{HOST}/archive/notice-7"]
BUY = "https://tickets.example.net/buy"

# name: (page, settings, wanted URLs)
URL_CASES = {
    "plain": (BOARD, {}, N),
    "selector": (BOARD, {"selector": "#notices > .old a, h2 b"}, N[2:]),
    "selector_without_articles": (BOARD, {"selector": "header a"}, []),
    "include": (BOARD, {"include": ["/board/", "/nothing"]}, N[:2]),
    "exclude": (BOARD, {"exclude": ["archive", "lang="]}, N[:1]),
    "external": (BOARD, {"allow_external": True}, [*N, BUY]),
    "allow_hosts": (BOARD, {"allow_hosts": ["elsewhere.test", "Example.NET"]}, [*N, BUY]),
    "navigation": (TIDES, {}, [f"{HOST}/tides/today", f"{HOST}/tides/week"]),
    "navigation_kept": (
        TIDES,
        {"skip_navigation": False},
        [f"{HOST}/{p}" for p in ("depths", "tides/today", "tides/week", "imprint", "harbour-news")],
    ),
    "navigation_selected": (TIDES, {"selector": "footer a"}, [f"{HOST}/imprint"]),
    "navigation_far_above": ("<header><section><p><b><i><a href=/under>x</a></i></b></p></section></header><a href=/over>y</a>", {}, [f"{HOST}/over"]),
    "default_excludes_off": (BOARD, {"use_default_exclude": False, "skip_navigation": False}, [f"{HOST}/signin", *N, f"{HOST}/atom/"]),
    "default_excludes": (
        "".join(f"<a href={p}>x</a>" for p in ("/RSS/", "/wp-json/x", "/a/xmlrpc.php", "/sitemap", "/Signup", "/feeds", "/x/atom/y")),
        {},
        [f"{HOST}/feeds", f"{HOST}/x/atom/y"],
    ),
    "min_title": ("<a href=/m/7>brief</a><a href=/m/8>sevenly</a><a href=/m/9>more than that</a>", {"min_title_length": 7}, [f"{HOST}/m/8", f"{HOST}/m/9"]),
    "min_title_counts_characters": ("<a href=/a/1>五文字以上</a><a href=/a/2>四文字以</a>", {"min_title_length": 5}, [f"{HOST}/a/1"]),
    "base": (f"<base href={HOST}/log/book/><a href=entry>x</a><a href=/top>y</a>", {}, [f"{HOST}/log/book/entry", f"{HOST}/top"]),
    "relative_base": ("<base href=../b/><a href=a.html>x</a>", {}, [f"{HOST}/b/a.html"]),
    "root_with_query": ("<a href='/?p=1'>x</a><a href=/p>y</a>", {}, [f"{HOST}/p"]),
    "itself": ("<a href=''>x</a><a href=./>y</a><a href='?utm_source=z'>z</a><a href=/q>q</a>", {}, [f"{HOST}/q"]),
    "port": (f"<a href={HOST}:443/x>x</a><a href=/y>y</a>", {}, [f"{HOST}/y"]),
    "subdomain_and_parent": ("<a href=https://pilots.press.harbour.test/x>x</a><a href=https://harbour.test/y>y</a>", {}, ["https://pilots.press.harbour.test/x"]),
    "suffixes": ("<a href=/a.PDF>x</a><a href=/a.Xml>x</a><a href=/a.css?x=y.html>x</a><a href=/woff2>x</a>", {}, [f"{HOST}/a.PDF", f"{HOST}/woff2"]),
    "needles_see_the_reencoded_query": ("<a href='/s?q=日 本'>x</a><a href='/t?q=b'>y</a>", {"include": ["%E6%97%A5+"]}, [f"{HOST}/s?q=%E6%97%A5+%E6%9C%AC"]),
    "other_schemes": ("<a href=ftp://press.harbour.test/x>x</a><a href=MAILTO:x>x</a><a href=/k>k</a>", {}, [f"{HOST}/k"]),
    "untitled_is_kept": ("<a href=/u><img src=x></a>", {}, [f"{HOST}/u"]),
    "order_of_first": ("<a href=/1>a</a><a href=/2>b</a><a href=/1>c</a>", {}, [f"{HOST}/1", f"{HOST}/2"]),
}
TITLE_CASES = {
    "picture_and_attribute": ("<a href=/buoy title=Buoys><img src=b></a><a href=/crane title=no><img alt=' A  crane '></a>", ["Buoys", "A crane"]),
    "picture_link_repeated_with_text": ("<a href=/dock><img src=d></a><a href=/quay>Quay</a><a href=/dock>Dry dock</a><a href=/dock>Dock two</a>", ["Dry dock", "Quay"]),
    "short_first_reserves_nothing": ("<a href=/a/1></a><a href=/a/2>two</a><a href=/a/1>one</a>", ["one", "two"]),
}
ERROR_CASES = {
    "malformed_link": ("<a href=/x>x</a><a href='http://[x'>y</a>", {}, "解析エラー: ValueError"),
    "malformed_base": ("<base href='http://[x'><a href=/x>x</a>", {}, "解析エラー: ValueError"),
    "bad_selector": ("<a href=/x>x</a>", {"selector": "a:hover"}, "解析エラー: SelectorSyntaxError"),
    "no_links": ("<p>nothing</p>", {}, NO_LINKS),
    "malformed_but_skipped": ("<nav><a href='http://[x'>y</a></nav><a href=/x>x</a>", {}, None),
}
SETTINGS = "selector string, include array<string>, exclude array<string>, use_default_exclude boolean, skip_navigation boolean, allow_hosts array<string>, allow_external boolean, min_title_length int, max_items int"
DEFAULTS = dict(selector=None, include=[], exclude=[], use_default_exclude=True, skip_navigation=True, allow_hosts=[], allow_external=False, min_title_length=0, max_items=50)


@pytest.fixture(scope="module")
def pages(spark):
    cases = {**URL_CASES, **ERROR_CASES, **{k: (v[0], {}, None) for k, v in TITLE_CASES.items()}}
    cases["off"] = (BOARD, {"enabled": False}, [])
    sites, rows = [], []
    for name, (html, settings, _) in cases.items():
        values = {**DEFAULTS, **settings}
        sites.append((name, settings.get("enabled", True), *[values[k] for k in DEFAULTS]))
        rows.append((name, TS, PAGE, html, None, None, None))
    declared = "<meta charset='windows-1251'><a href=/novosti>Новости порта</a>".encode("cp1251")
    hinted = "<meta charset=utf-8><a href=/novosti>Новости порта</a>".encode("koi8-r")
    for name, content, hint in (("declared", declared, None), ("hinted", hinted, "koi8-r")):
        sites.append((name, True, *DEFAULTS.values()))
        rows.append((name, TS, PAGE, None, content, hint, None))
    sites.append(("failed", True, *DEFAULTS.values()))
    rows.append(("failed", TS, PAGE, None, None, None, "HTTP 404"))
    rows.append(("not_configured", TS, PAGE, BOARD, None, None, None))
    snapshots = spark.createDataFrame(
        rows, "site_id string, run_ts timestamp, page_url string, html string, content binary, charset_hint string, error string"
    )
    sites = spark.createDataFrame(sites, f"site_id string, enabled boolean, {SETTINGS}")
    return extract(snapshots, sites).persist()


@pytest.fixture(scope="module")
def by_case(pages):
    return {r["site_id"]: r for r in pages.collect()}


@pytest.mark.parametrize("case", URL_CASES)
def test_links(by_case, case):
    assert [x["url"] for x in by_case[case]["links"]] == URL_CASES[case][2]
    assert by_case[case]["link_count"] == len(URL_CASES[case][2])
    assert by_case[case]["error"] == (None if URL_CASES[case][2] else NO_LINKS)


@pytest.mark.parametrize("case", TITLE_CASES)
def test_titles(by_case, case):
    assert [x["title"] for x in by_case[case]["links"]] == TITLE_CASES[case][1]


@pytest.mark.parametrize("case", ERROR_CASES)
def test_errors(by_case, case):
    assert by_case[case]["error"] == ERROR_CASES[case][2]
    assert (by_case[case]["link_count"] == 0) == (ERROR_CASES[case][2] is not None)


def test_other_pages(by_case):
    assert by_case["declared"]["links"][0]["title"] == by_case["hinted"]["links"][0]["title"] == "Новости порта"
    assert by_case["failed"]["error"] == "HTTP 404"
    assert "off" not in by_case and "not_configured" not in by_case


def test_profile_and_inspection(spark, pages):
    links = explode_links(pages.filter("site_id = 'plain'"))
    assert [tuple(r) for r in path_prefix_stats(links, ["site_id"]).select("prefix", "n").collect()] == [("/board/notice-41", 1), ("/board/notice-42", 1), ("/archive/notice-7", 1)]
    shown = inspect_links(pages.filter("site_id in ('plain', 'failed')"), ["site_id"], 2).orderBy("rank").collect()
    assert [(r["site_id"], r["rank"], r["title"]) for r in shown] == [("plain", 1, "Ferry timetable"), ("plain", 2, "Pier closed")]
    paths = ["/k.htm", "/t/u/v/1", "/w/", "/t/u/2.php", "/t/u/w/x/3", "/m.htm"]
    flat = spark.createDataFrame([("s", f"{HOST}{p}", i) for i, p in enumerate(paths)], "site_id string, url string, pos int")
    ranked = path_prefix_stats(flat, ["site_id"]).orderBy("rank").collect()
    assert [(r["prefix"], r["n"]) for r in ranked] == [("/t/u", 3), ("/", 2), ("/w", 1)]


def test_same_site_pairs_equal_the_theta_join(spark):
    from freshet.functions.urls import is_same_site

    hosts = ["a.jp", "www.a.jp", "WWW.b.a.jp", "b.a.jp", "xa.jp", "jp", "www.jp", "a.jp:443", "www.www.a.jp", "c.b.a.jp"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    lower = df.select(F.lower("host").alias("h"))
    theta = lower.alias("p").crossJoin(lower.alias("l")).filter(is_same_site(F.col("l.h"), F.col("p.h")))
    want = {tuple(r) for r in theta.select("p.h", "l.h").collect()}
    assert {tuple(r) for r in same_site_pairs(df).collect()} == want
