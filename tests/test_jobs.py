"""Maintenance, report, reader, stores and jobs on small tables."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from freshet import schemas
from freshet.operators import attempts, maintain, reader, report
from freshet.operators.detect import State
from freshet.operators.extract import extract
from freshet.plans import crawl
from freshet.sources import feed as feed_source
from freshet.sources import state as state_source
from freshet.sources.snapshots import read_page_files, read_snapshots, succeeded
from freshet.streaming import continuous

T0 = datetime(2026, 8, 3, tzinfo=timezone.utc)
SITES = "ord int, site_id string, name string, url string, enabled boolean"


def at(n):
    return T0 + timedelta(hours=n)


def naive(n):
    return at(n).replace(tzinfo=None)


@pytest.fixture(scope="module")
def sites(spark):
    rows = [(1, "a", "Site A", "https://a.example/", True), (2, "b", "Site B", "https://b.example/", True), (3, "c", "Site C", "https://c.example/", False)]
    return spark.createDataFrame(rows, SITES).persist()


@pytest.fixture(scope="module")
def state(spark):
    known = [(s, f"https://{s}.example/{i}", f"t{i}", at(i), i) for s in "ab" for i in (1, 2)]
    recent = [(s, 2 - i, f"t{i}", f"https://{s}.example/{i}", at(i)) for s in "ab" for i in (1, 2)]
    states = [(s, True, at(0), at(2), at(2), "ok", None, 0) for s in "ab"] + [("gone", True, at(0), at(2), None, "error", "HTTP 500", 3)]
    return State(
        spark.createDataFrame(known, schemas.KNOWN).persist(),
        spark.createDataFrame(recent, schemas.RECENT).persist(),
        spark.createDataFrame(states, schemas.SITE_STATE).persist(),
    )


def ids(df):
    return sorted(r["site_id"] for r in df.select("site_id").distinct().collect())


def named(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "site_id string")


def tables(state):
    return [sorted(map(tuple, t.collect()), key=str) for t in (state.known, state.recent, state.sites)]


def snapshots(spark, *rows):
    """(site, hour, [slugs] or error) as snapshots."""
    out = []
    for site, hour, found in rows:
        html = "".join(f"<a href=/{slug}>title {slug}</a>" for slug in found) if isinstance(found, list) else None
        out.append((site, at(hour), f"https://{site}.example/", html, None if html is not None else found))
    return spark.createDataFrame(out, "site_id string, run_ts timestamp, page_url string, html string, error string")


# --- maintenance ---


def test_reset(spark, state):
    assert ids(maintain.resettable(state, named(spark, "a", "gone", "missing"))) == ["a"]
    after = maintain.reset_history(state, named(spark, "a"))
    assert ids(after.recent) == ["b"] and ids(after.known) == ["a", "b"]
    updates = {r["site_id"]: (r["last_update"], r["seeded"]) for r in after.sites.collect()}
    assert updates == {"a": (None, True), "b": (naive(2), True), "gone": (None, True)}


def test_refill(spark, state):
    after = maintain.refill(state, named(spark, "a", "fresh"))
    assert ids(after.known) == ids(after.recent) == ["b"]
    rows = {r["site_id"]: r for r in after.sites.collect()}
    assert rows["a"]["seeded"] and rows["a"]["last_update"] is None and rows["a"]["first_checked"] == naive(0)
    assert rows["fresh"]["seeded"] and rows["fresh"]["last_status"] == "pending"
    assert rows["b"]["last_update"] == naive(2) and rows["gone"]["consecutive_errors"] == 3


def test_prune_and_replace(spark, state, sites):
    assert ids(maintain.prune(state, sites).sites) == ["a", "b"]
    update = State(
        spark.createDataFrame([("a", "u", "t", at(9), 0)], schemas.KNOWN),
        spark.createDataFrame([], schemas.RECENT),
        spark.createDataFrame([("a", True, at(0), at(9), None, "ok", None, 0)], schemas.SITE_STATE),
    )
    after = maintain.replace_sites(state, update)
    assert [r["url"] for r in after.known.filter("site_id = 'a'").collect()] == ["u"]
    assert ids(after.recent) == ["b"] and ids(after.sites) == ["a", "b", "gone"]


# --- attempts ---


def test_attempts(spark):
    rows = [
        ("ok", 0, 503, None), ("ok", 1, 200, None),
        ("late", 0, None, "Timeout"), ("late", 1, None, "Timeout"), ("late", 2, 503, None), ("late", 3, 200, None),
        ("mixed", 0, 503, None), ("mixed", 1, None, "ConnectionError"), ("mixed", 2, None, "Timeout"),
        ("missing", 0, 404, None), ("missing", 1, 200, None), ("cut", 0, None, "Timeout"),
    ]
    df = spark.createDataFrame([(s, at(0), a, c, f) for s, a, c, f in rows], schemas.ATTEMPTS)
    got = {r["site_id"]: (r["attempts"], r["http_status"], r["error"]) for r in attempts.resolve_attempts(df).collect()}
    assert got == {
        "ok": (2, 200, None), "late": (3, 503, "HTTP 503"), "mixed": (3, 503, "タイムアウト（20秒）"), "missing": (1, 404, "HTTP 404"),
        "cut": (1, None, "タイムアウト（20秒）"),
    }


@pytest.mark.parametrize(
    "header, want",
    [
        ("text/html; charset=Shift_JIS", "Shift_JIS"), ("text/html;CHARSET= 'utf-8' ", "utf-8"), ("text/html", None),
        ("text/html; charset=ISO-8859-1", None), ("text/html; charset=; charset=iso-8859-1; charset=\"euc-jp\"", "euc-jp"), ("", None),
    ],
)
def test_charset_hint(spark, header, want):
    assert spark.createDataFrame([(header,)], "h string").select(attempts.charset_hint(F.col("h"))).first()[0] == want


# --- report and reader ---


@pytest.fixture(scope="module")
def feed_parts(spark, sites, state):
    results = spark.createDataFrame([("b", at(2), "ok", None, 5, 1, False)], "site_id string, run_ts timestamp, status string, error string, link_count int, new_count int, seeded_now boolean")
    return results, report.build_feed(results, sites, state)


def test_feed(feed_parts):
    feed = feed_parts[1]
    rows = feed.sites.orderBy("result_ord").collect()
    assert [(r["site_id"], r["status"], r["new_count"], r["link_count"], len(r["items"])) for r in rows] == [
        ("b", "ok", 1, 5, 2), ("a", "ok", 0, 0, 2), ("c", "pending", 0, 0, 0),
    ]
    assert [i["title"] for i in rows[0]["items"]] == ["t2", "t1"]
    assert [(r["site_name"], r["title"]) for r in feed.timeline.collect()] == [("Site B", "t2"), ("Site A", "t2"), ("Site B", "t1"), ("Site A", "t1")]
    assert tuple(feed.totals.first()) == (3, 1, 0)


def test_feed_document_round_trip(spark, feed_parts, tmp_path):
    feed = feed_parts[1]
    feed_source.write_feed_document(feed, str(tmp_path / "doc"), F.lit("2026-08-03 03:00:00").cast("timestamp"))
    document = json.loads("".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "doc").glob("*.txt"))))
    assert (document["version"], document["generated_at"], document["new_count"]) == (1, "2026-08-03T03:00:00+00:00", 1)
    assert [s["id"] for s in document["sites"]] == ["b", "a", "c"] and document["sites"][2]["items"] == []
    assert document["sites"][0]["error"] is None
    assert document["timeline"][0] == {"site_id": "b", "site_name": "Site B", "title": "t2", "url": "https://b.example/2", "first_seen": "2026-08-03T02:00:00+00:00"}
    back = feed_source.read_feed_document(spark, str(tmp_path / "doc"))
    assert [tuple(r) for r in back.timeline.orderBy("ord").select("site_id", "url", "first_seen").collect()] == [
        tuple(r) for r in feed.timeline.select("site_id", "url", "first_seen").collect()
    ]
    assert feed_source.items_of(back).count() == 4
    (tmp_path / "bare.json").write_text('{"site_count": 0}')
    assert feed_source.read_feed_document(spark, str(tmp_path / "bare.json")).timeline.count() == 0


def test_run_summary(spark, sites):
    results = spark.createDataFrame(
        [("a", at(1), "ok", None, 3, 7, False), ("b", at(1), "error", "HTTP 503", 0, 0, False), ("c", at(1), "ok", None, 4, 0, True)],
        "site_id string, run_ts timestamp, status string, error string, link_count int, new_count int, seeded_now boolean",
    )
    rows = report.in_summary_order(report.run_summary(results, sites)).collect()
    assert [(r["site_id"], r["label"]) for r in rows] == [("b", "失敗"), ("a", "新着"), ("c", "初回")]
    new = spark.createDataFrame([("a", "x" * 70 if i else "", f"u{i}", at(1), i) for i in range(7)], "site_id string, title string, url string, first_seen timestamp, pos int")
    titles = report.summary_titles(new, results).orderBy("rank").collect()
    assert len(titles) == 5 and titles[0]["title"] == "(タイトルなし)" and titles[1]["title"] == "x" * 60 and titles[0]["more"] == 2
    assert tuple(report.run_totals(results).first()) == (3, 7, 1)


def test_reader(spark, sites, state, feed_parts):
    feed = feed_parts[1]
    reads = spark.createDataFrame([("r", "https://b.example/2", at(5)), ("other", "https://a.example/1", at(5))], schemas.READS)
    mine = reader.reads_of(reads, "r")
    rows = reader.with_unread(feed.sites.drop("items"), state.recent, mine)
    assert {r["site_id"]: r["unread"] for r in rows.collect()} == {"a": 2, "b": 1, "c": 0}
    assert [r["site_id"] for r in reader.rank_sites(rows).collect()] == ["a", "b", "c"]
    assert [r["badge"] for r in reader.badge(rows).orderBy("site_id").collect()] == ["未読 2", "未読 1", "更新なし"]
    assert reader.search_timeline(feed.timeline, mine, " site B", unread_only=True).count() == 1
    assert reader.search_timeline(feed.timeline, mine).count() == 4
    assert ids(reader.search_sites(rows, state.recent, "T2")) == ["a", "b"] and ids(reader.search_sites(rows, state.recent, "c.EXAMPLE")) == ["c"]
    assert reader.card_items(state.recent, mine, "t", unread_only=True).count() == 3
    assert tuple(reader.header(feed.totals, feed.timeline, mine, F.lit("g")).first()) == ("g", 3, 3, 0)
    assert reader.with_read_flag(feed.timeline, mine).filter("is_read").count() == 1

    clicks = spark.createDataFrame([("r", "https://b.example/2", at(9)), ("r", "new", at(9))], schemas.READS)
    after = {(r["reader_id"], r["url"]): r["read_at"] for r in reader.mark_read(reads, clicks).collect()}
    assert after[("r", "https://b.example/2")] == naive(5) and after[("r", "new")] == naive(9) and len(after) == 3
    everything = reader.mark_all_read(reads, feed.timeline, F.lit("r"), F.lit(at(10)))
    assert {r["read_at"] for r in everything.filter("reader_id = 'r'").collect()} == {naive(10)} and everything.count() == 5
    assert [r["url"] for r in reader.keep_newest_reads(clicks.unionByName(reads), 1).filter("reader_id = 'r'").collect()] == ["https://b.example/2"]


def test_ranking_puts_failures_first_and_sorts_names_as_japanese(spark):
    rows = spark.createDataFrame(
        [("x", "うみ", 0, "ok", 1), ("y", "アキ", 0, "ok", 2), ("z", "んん", 0, "error", 3), ("w", "いぬ", 2, "ok", 4), ("v", "アキ", 0, "ok", 0)],
        "site_id string, name string, unread int, status string, result_ord int",
    )
    assert [r["site_id"] for r in reader.rank_sites(rows).collect()] == ["w", "z", "v", "y", "x"]


@pytest.mark.parametrize(
    "status, error, times, seeded, badge, message",
    [
        ("error", "HTTP 503", 2, False, "エラー", "取得に失敗しました: HTTP 503（2回連続）"),
        ("error", None, 1, False, "エラー", "取得に失敗しました: 原因不明"),
        ("ok", None, 0, True, "登録済み", "初回巡回のため 4 件のリンクを記録しました。新着の検知は次回からです。"),
        ("ok", None, 0, False, "更新なし", None),
    ],
)
def test_badges(spark, status, error, times, seeded, badge, message):
    row = spark.createDataFrame(
        [(status, error, times, seeded, 4, 0)], "status string, error string, consecutive_errors int, seeded_now boolean, link_count int, unread int"
    )
    got = reader.badge(row).first()
    assert (got["badge"], got["message"], got["is_open"]) == (badge, message, status == "error")


def test_shown_texts(spark):
    from freshet.functions.text import absolute_time, clean_text, display_title, relative_age, slugify

    cases = [
        ("　 t ", "u", "t"), ("", "https://a.jp/%E6%97%A5/x%2Fy", "/日/x%2Fy"), (None, "https://a.jp/%zz", "https://a.jp/%zz"),
        ("", "https://a.jp/%ff", "https://a.jp/%ff"), ("", "https://a.jp", "/"), ("", "https://a.jp/a+b?q", "/a+b"), ("", "not a url", "not a url"),
        ("", "http://[x/y", "http://[x/y"),
    ]
    df = spark.createDataFrame(cases, "title string, url string, want string")
    assert [r[0] for r in df.select(display_title(F.col("title"), F.col("url"))).collect()] == [c[2] for c in cases]
    ages = [(0, "たった今"), (59, "たった今"), (60, "1分前"), (7199, "1時間前"), (86400 * 30 - 1, "29日前"), (86400 * 30, "2026/07/04 09:00"), (-5, "たった今")]
    df = spark.createDataFrame([(T0 - timedelta(seconds=s),) for s, _ in ages] + [(None,)], "ts timestamp")
    assert [r[0] for r in df.select(relative_age(F.col("ts"), F.lit(T0), "Asia/Tokyo")).collect()] == [w for _, w in ages] + ["―"]
    df = spark.createDataFrame([("  a\x1c　b\xa0\n c ", "総務省 A&B 2")], "t string, n string")
    assert tuple(df.select(clean_text(F.col("t")), slugify(F.col("n")), absolute_time(F.lit(None).cast("timestamp"))).first()) == ("a b c", "a-b-2", "―")


# --- stores, jobs, streaming ---


def test_state_round_trips(spark, state, tmp_path):
    store = state_source.StateStore(spark, str(tmp_path / "store"))
    assert store.version() is None and store.load().known.count() == 0
    assert tables(store.save(state)) == tables(state)
    store.save(maintain.refill(store.load(), named(spark, "a")))
    assert store.version() == 1 and ids(store.load().known) == ["b"] and tables(store.load(0)) == tables(state)
    state_source.export_state(state, str(tmp_path / "lines"))
    back = state_source.import_state_lines(spark, str(tmp_path / "lines"))
    state_source.write_state_document(state, str(tmp_path / "document"), F.lit(T0))
    document = json.loads("".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "document").glob("*.txt"))))
    assert document["version"] == 1 and list(document["sites"]) == ["a", "b", "gone"]
    assert list(document["sites"]["a"]["known"]) == ["https://a.example/1", "https://a.example/2"]
    (tmp_path / "doc.json").write_text(json.dumps(document, indent=2), encoding="utf-8")
    for again in (back, state_source.import_state_document(spark, str(tmp_path / "doc.json"))):
        assert [sorted(r[:4] for r in t) if i == 0 else t for i, t in enumerate(tables(again))] == [
            sorted(r[:4] for r in t) if i == 0 else t for i, t in enumerate(tables(state))
        ]


@pytest.mark.parametrize("content", ["{\"sites\": {", "[1]", '{"sites": 3}', "", '{"sites": {"a": 1}}'])
def test_broken_state_is_the_empty_state(spark, tmp_path, content):
    (tmp_path / "s.json").write_text(content)
    assert tables(state_source.import_state_document(spark, str(tmp_path / "s.json"))) == [[], [], []]
    assert tables(state_source.import_state_document(spark, str(tmp_path / "none.json"))) == [[], [], []]


def test_state_import_is_tolerant(spark, tmp_path):
    raw = {"sites": {"a": {"known": {"u": {"title": None}, "v": "text", "w": {"title": "t", "first_seen": "2026-08-03T01:00:00+00:00"}}, "recent": [{"url": "w"}, 5]}}}
    (tmp_path / "s.json").write_text(json.dumps(raw))
    got = state_source.import_state_document(spark, str(tmp_path / "s.json"))
    assert tables(got)[0] == [("a", "u", "", None, 0), ("a", "w", "t", naive(1), 2)]
    assert [r[:4] for r in tables(got)[1]] == [("a", 0, "", "w")]
    assert tables(got)[2] == [("a", False, None, None, None, "pending", None, 0)]


def test_check_reset_refill(spark, sites, tmp_path):
    store, out = state_source.StateStore(spark, str(tmp_path / "store")), str(tmp_path / "feed")
    first = crawl.check(store, sites, snapshots(spark, ("a", 0, ["x", "y"]), ("b", 0, "HTTP 404"), ("c", 0, ["x"])), out)
    assert first.outcome.new_items.count() == 0 and ids(first.state.sites) == ["a", "b"]
    dry = crawl.check(store, sites, snapshots(spark, ("a", 3, ["z"])), out, dry_run=True)
    assert dry.outcome.new_items.count() == 1 and store.version() == 0
    second = crawl.check(store, sites, snapshots(spark, ("a", 3, ["z", "x"]), ("b", 3, ["q"])), out, only=named(spark, "a"))
    assert [r["title"] for r in second.outcome.new_items.collect()] == ["title z"]
    feed = feed_source.read_feed(spark, out)
    assert [(r["site_id"], r["status"], r["new_count"]) for r in feed.sites.orderBy("result_ord").collect()] == [("a", "ok", 1), ("b", "error", 0), ("c", "pending", 0)]
    assert tuple(feed.totals.first()) == (3, 1, 1)
    cleared, feed = crawl.reset_history(store, sites, out, named(spark, "a", "c"))
    assert cleared == 1 and feed.timeline.count() == 0 and ids(store.load().known) == ["a"]
    count, _ = crawl.refill(store, sites, out)
    assert count == 3 and store.load().known.count() == 0
    again = crawl.check(store, sites, snapshots(spark, ("a", 9, ["z", "x"])), out)
    assert [r["url"] for r in again.outcome.new_items.orderBy("pos").collect()] == ["https://a.example/z", "https://a.example/x"]
    with pytest.raises(maintain.UnknownSite):
        crawl.reset_history(store, sites, out, named(spark, "zzz"))
    with pytest.raises(crawl.NothingToCheck):
        crawl.check(store, sites, snapshots(spark, ("c", 9, ["x"])), out, only=named(spark, "c"))


def test_inspect(spark):
    shown = crawl.inspect(snapshots(spark, ("a", 0, ["n/1", "n/2", "m"])), "https://a.example/", limit=2)
    assert shown["count"].first()["link_count"] == 3 and shown["links"].count() == 2
    assert [r["prefix"] for r in shown["prefixes"].orderBy("rank").collect()][0] == "/n/1"


def test_streaming_equals_replay_and_repeats_change_nothing(spark, tmp_path):
    store = state_source.StateStore(spark, str(tmp_path / "store"))
    runs = [("a", 0, ["x"]), ("a", 1, ["y", "x"]), ("b", 1, ["p"]), ("a", 2, "HTTP 500"), ("b", 3, ["q"]), ("a", 4, ["z"])]

    def arrive(*rows):
        df = snapshots(spark, *rows)
        full = [F.lit(None).cast(t).alias(n) for n, t in (("content", "binary"), ("charset_hint", "string"), ("http_status", "int"))]
        df.select("site_id", "run_ts", "page_url", full[0], "html", full[1], full[2], "error").write.mode("append").parquet(str(tmp_path / "in"))
        arriving = continuous.stream_snapshots(spark, str(tmp_path / "in"))
        continuous.detect_continuously(arriving, store, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()

    arrive(*runs[:3])
    arrive(*runs[3:], ("a", 1, ["late"]))
    new = continuous.new_items_of(spark, str(tmp_path / "out"))
    assert sorted(r["url"] for r in new.collect()) == ["https://a.example/y", "https://a.example/z", "https://b.example/q"]
    assert spark.read.parquet(str(tmp_path / "out" / "late")).count() == 1
    before = tables(store.load())
    batch = snapshots(spark, ("a", 9, ["never"]))
    continuous.MicroBatch(store, str(tmp_path / "ckpt"), str(tmp_path / "out"), None)(batch, 1)
    assert tables(store.load()) == before and store.version() == 1


def test_page_files(spark, tmp_path):
    (tmp_path / "p1.html").write_bytes("<a href=/x>日本</a>".encode("euc_jp"))
    index = spark.createDataFrame(
        [("p1.html", "a", at(0), "https://a.example/", "text/html; charset=euc-jp", 200), ("p2.html", "b", at(0), "https://b.example/", None, 404)],
        "file string, site_id string, run_ts timestamp, page_url string, content_type string, http_status int",
    )
    snaps = read_page_files(spark, str(tmp_path), index)
    rows = {r["site_id"]: r for r in extract(snaps).collect()}
    assert rows["a"]["links"][0]["title"] == "日本" and rows["b"]["error"] == "HTTP 404"
    snaps.write.parquet(str(tmp_path / "snapshots"))
    assert succeeded(read_snapshots(spark, str(tmp_path / "snapshots"), F.lit(at(-1)))).count() == 1


def test_read_log_documents(spark, tmp_path):
    assert feed_source.read_log(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "r.json").write_text('{"u": 1000, "v": 2500}')
    (tmp_path / "bad.json").write_text("nope")
    assert sorted((r["url"], r["read_at"].second) for r in feed_source.read_log_document(spark, str(tmp_path / "r.json"), "me").collect()) == [("u", 1), ("v", 2)]
    assert feed_source.read_log_document(spark, str(tmp_path / "bad.json"), "me").count() == 0


def test_fetch_outcomes_become_snapshots(spark):
    from datetime import datetime

    from freshet.operators.attempts import with_outcomes

    run = datetime(2026, 5, 1, 6)
    sites = spark.createDataFrame([("p", "https://p.test/", 0, 9), ("q", "https://q.test/", 3, 20), ("r", "https://r.test/", 1, 5)], "site_id string, url string, retries int, timeout int")
    tries = [("p", run, 0, 503, None), ("p", run, 1, 200, None), ("q", run, 0, 503, None), ("q", run, 1, 200, None), ("r", run, 0, None, "Timeout"), ("r", run, 1, None, "Timeout")]
    attempts = spark.createDataFrame(tries, "site_id string, run_ts timestamp, attempt int, http_status int, failure string")
    pages = spark.createDataFrame([("q", run, "https://q.test/list", "<a href=/1>one</a>")], "site_id string, run_ts timestamp, page_url string, html string")
    rows = {r.site_id: r for r in with_outcomes(pages, attempts, sites).collect()}
    # p may not try again, q may; r gives up after its own timeout.
    assert (rows["p"].error, rows["p"].html, rows["p"].page_url) == ("HTTP 503", None, "https://p.test/")
    assert (rows["q"].error, rows["q"].http_status, rows["q"].page_url) == (None, 200, "https://q.test/list")
    assert "5" in rows["r"].error and rows["r"].http_status is None
    found = {r.site_id: (r.error, r.link_count) for r in extract(with_outcomes(pages, attempts, sites), skip_navigation=False).collect()}
    assert found["q"] == (None, 1) and found["p"][0] == "HTTP 503"


def test_a_repeated_run_is_put_aside(spark, sites, tmp_path):
    from datetime import datetime

    store = state_source.StateStore(spark, str(tmp_path / "repeat"))
    row = ("a", datetime(2026, 5, 1, 6, 0, 0, 900_000), "https://a.example/", None, "HTTP 500")
    snapshots = spark.createDataFrame([row], "site_id string, run_ts timestamp, page_url string, html string, error string")
    first, again = (crawl.check(store, sites, snapshots) for _ in range(2))
    assert first.late.count() == 0 and again.late.count() == 1
    assert [(r["site_id"], r["consecutive_errors"]) for r in again.state.sites.collect()] == [("a", 1)]
    # Times are kept to the second.
    assert again.state.sites.first()["last_checked"] == datetime(2026, 5, 1, 6)
    assert [r["label"] for r in first.summary().collect()] == ["失敗"] and tuple(first.totals().first()) == (1, 0, 1)


def test_read_log(spark, tmp_path):
    from datetime import datetime

    from freshet.sources.reads import ReadLog

    def at(hour):
        return datetime(2026, 5, 1, hour)

    def clicks(*rows):
        return spark.createDataFrame(rows, "reader_id string, url string, read_at timestamp")

    log = ReadLog(spark, str(tmp_path / "reads"), limit=2)
    assert log.load().count() == 0
    log.mark(clicks(("u", "x", at(5)), ("u", "y", at(6)), ("v", "x", at(7))))
    out = log.mark(clicks(("u", "x", at(1)), ("u", "z", at(9)), ("v", "w", at(3))))
    # A click does not change what is stored; only the newest two of each reader stay.
    assert sorted(map(tuple, out.collect())) == [("u", "y", at(6)), ("u", "z", at(9)), ("v", "w", at(3)), ("v", "x", at(7))]
    items = spark.createDataFrame([("k",), ("x",)], "url string")
    out = log.mark_all(items, F.lit("v"), F.lit("2026-05-02 00:00:00").cast("timestamp"))
    assert sorted((r.url, r.read_at.day) for r in out.filter("reader_id = 'v'").collect()) == [("k", 2), ("x", 2)]
    assert log.version() == 2


def test_documents_of_many_parts(spark, state, feed_parts, tmp_path):
    """Parts of two lines: all comes back, and what is missing or broken raises."""
    from pathlib import Path

    import pytest
    from pyspark.errors import PySparkException

    from freshet.sources.documents import DamagedDocument

    whole, parts = tmp_path / "state", tmp_path / "parts"
    now = F.lit(at(9))
    state_source.write_state_document(state, str(whole), now)
    state_source.write_state_document(state, str(parts), now, lines_per_part=2)
    files = sorted(parts.glob("part-*"))
    assert len(files) > 1
    back = state_source.import_state_document(spark, str(parts))
    assert tables(back) == tables(state_source.import_state_document(spark, str(whole)))
    assert back.sites.count() == state.sites.count() and back.known.count() == state.known.count()

    feed = feed_parts[1]
    doc = tmp_path / "feed"
    feed_source.write_feed_document(feed, str(doc), now, lines_per_part=1)
    again = feed_source.read_feed_document(spark, str(doc))
    assert [r["site_id"] for r in again.sites.orderBy("result_ord").collect()] == [r["site_id"] for r in feed.sites.orderBy("result_ord").collect()]
    assert again.timeline.count() == feed.timeline.count()

    def damaged(change):
        copy = tmp_path / f"copy{len(list(tmp_path.iterdir()))}"
        copy.mkdir()
        for file in files:
            (copy / file.name).write_text(file.read_text())
        change(copy, sorted(copy.glob("part-*")))
        return str(copy)

    def cut(folder: Path, names: list[Path]):
        text = names[1].read_text()
        names[1].write_text(text.rstrip("\n")[:-3] + "\n")

    for change in (lambda folder, names: names[0].unlink(), lambda folder, names: names[-1].unlink(), lambda folder, names: [n.unlink() for n in names[1:-1]] and names[0].unlink()):
        with pytest.raises(DamagedDocument):
            state_source.import_state_document(spark, damaged(change))
    with pytest.raises((PySparkException, DamagedDocument)):
        tables(state_source.import_state_document(spark, damaged(cut)))
    lost = sorted(doc.glob("part-*"))
    site = next(file for file in lost if '"id":' in file.read_text() and "version" not in file.read_text())
    site.unlink()
    with pytest.raises(DamagedDocument):
        feed_source.read_feed_document(spark, str(doc))


def test_a_partial_run_leaves_other_buckets_alone(spark, tmp_path):
    names = [f"s{i}" for i in range(12)]
    many = spark.createDataFrame([(i, n, n, f"https://{n}.example/", True) for i, n in enumerate(names)], SITES)
    store = state_source.StateStore(spark, str(tmp_path / "buckets"), buckets=6)
    crawl.check(store, many, snapshots(spark, *[(n, 0, ["x", "y"]) for n in names]))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "buckets" / "data").rglob("*.parquet")}
    first = store.commits.read(0)["tables"]
    crawl.check(store, many, snapshots(spark, ("s3", 1, ["z"])), only=named(spark, "s3"))
    second = store.commits.read(1)["tables"]
    bucket = str(store.buckets_of(named(spark, "s3"))[0])
    for table in ("known", "sites"):
        assert {b for b in first[table] if first[table][b] != second[table][b]} == {bucket}
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    assert store.load().known.count() == 25 and ids(store.load().sites) == sorted(names)
    # A site that is no longer configured goes, also in a partial run.
    fewer = many.filter("site_id <> 's7'")
    crawl.check(store, fewer, snapshots(spark, ("s3", 2, ["z"])), only=named(spark, "s3"))
    assert ids(store.load().sites) == sorted(set(names) - {"s7"}) and "s7" not in ids(store.load().known)
    held = tables(store.load())
    assert store.vacuum(keep=1, older_than_hours=0) and tables(store.load()) == held and store.commits.versions() == [2]


def test_of_two_writers_one_fails(spark, state, tmp_path):
    from freshet.sources.commits import ConflictingWrite

    one, two = (state_source.StateStore(spark, str(tmp_path / "race")) for _ in range(2))
    one.save(state)
    mine, theirs = one.load(), two.load()
    one.save(maintain.refill(mine, named(spark, "a")))
    with pytest.raises(ConflictingWrite):
        two.save(maintain.refill(theirs, named(spark, "b")))
    assert ids(one.load().known) == ["b"] and two.version() == 1
    two.save(maintain.refill(two.load(), named(spark, "b")))
    assert one.load().known.count() == 0


def test_a_feed_is_whole_or_the_one_before(spark, feed_parts, tmp_path, monkeypatch):
    path, feed = str(tmp_path / "versions"), feed_parts[1]
    feed_source.write_feed(feed, path, F.lit(T0))
    before = feed_source.feed_folder(spark, path)

    def fails(*_):
        raise RuntimeError("died half-way")

    monkeypatch.setattr(feed_source, "write_feed_document", fails)
    with pytest.raises(RuntimeError):
        feed_source.write_feed(feed, path, F.lit(T0))
    assert feed_source.feed_folder(spark, path) == before and feed_source.read_feed(spark, path).sites.count() == 3
    assert len(feed_source.vacuum_feed(spark, path, older_than_hours=0)) == 1
    assert feed_source.read_feed_document(spark, f"{before}/document").sites.count() == 3


def test_a_click_writes_one_small_file(spark, tmp_path):
    from freshet.sources.reads import ReadLog

    def clicks(*rows):
        return spark.createDataFrame([(r, u, at(n)) for r, u, n in rows], "reader_id string, url string, read_at timestamp")

    def files():
        return {p for p in (tmp_path / "reads" / "data").rglob("*.parquet")}

    log = ReadLog(spark, str(tmp_path / "reads"), limit=3, compact_after=4)
    log.mark(clicks(*[(f"r{i}", f"u{k}", k) for i in range(9) for k in range(5)]))
    log.compact()
    before = files()
    log.mark(clicks(("r1", "new", 50)))
    assert len(files() - before) == 1
    # Two writers at once: both marks land.
    other = ReadLog(spark, str(tmp_path / "reads"), limit=3, compact_after=4)
    version = log.version()
    log.version = lambda: version  # what it saw before the other committed
    other.mark(clicks(("r2", "theirs", 60)))
    del log.version
    out = log.mark(clicks(("r1", "mine", 70), ("r1", "u4", 80)))
    got = {r: sorted(x["url"] for x in out.collect() if x["reader_id"] == r) for r in ("r0", "r1", "r2")}
    # A URL that is read keeps its time, so that newer ones drive it out.
    assert got == {"r0": ["u2", "u3", "u4"], "r1": ["mine", "new", "u4"], "r2": ["theirs", "u3", "u4"]}
    again = log.mark(clicks(("r5", "last", 90)))
    assert log._record(log.version())["marks"] == [] and again.filter("reader_id = 'r1'").count() == 3


def test_one_time_rule_for_job_and_stream(spark, tmp_path):
    """Several pages of a site in one second, some of them twice: the last counts, in the job as in the stream."""
    rows = [("a", 0, 100, ["x"]), ("a", 0, 700, ["y"]), ("a", 0, 700, ["y"]), ("a", 0, 400, "HTTP 500"), ("b", 0, 0, ["p"]), ("a", 5, 300, ["z", "y"]), ("a", 5, 200, ["q"])]
    made = [
        (site, T0 + timedelta(seconds=second, milliseconds=ms), f"https://{site}.example/", "".join(f"<a href=/{s}>{s}</a>" for s in found) if isinstance(found, list) else None,
         None if isinstance(found, list) else found)
        for site, second, ms, found in rows
    ]
    pages = spark.createDataFrame(made, "site_id string, run_ts timestamp, page_url string, html string, error string")
    configured = spark.createDataFrame([(0, "a", "a", "https://a.example/", True), (1, "b", "b", "https://b.example/", True)], SITES)
    job, stream = (state_source.StateStore(spark, str(tmp_path / n)) for n in ("job", "stream"))
    done = crawl.check(job, configured, pages)
    assert [r["url"] for r in done.outcome.new_items.collect()] == ["https://a.example/z"] and done.late.count() == 3
    continuous.MicroBatch(stream, "s", str(tmp_path / "out"), configured)(pages, 0)
    assert tables(stream.load()) == tables(job.load()) and spark.read.parquet(str(tmp_path / "out" / "late")).count() == 3
    assert sorted(job.load().known.select("url").toPandas()["url"]) == ["https://a.example/y", "https://a.example/z", "https://b.example/p"]


def test_a_batch_writes_the_buckets_of_its_sites(spark, tmp_path):
    store = state_source.StateStore(spark, str(tmp_path / "wide"), buckets=16)
    batch = continuous.MicroBatch(store, "s", str(tmp_path / "out"), None)
    batch(snapshots(spark, *[(f"s{i}", 0, [f"{k}" for k in range(30)]) for i in range(40)]), 0)

    def size():
        return sum(p.stat().st_size for p in (tmp_path / "wide" / "data").rglob("*.parquet"))

    whole = size()
    batch(snapshots(spark, ("s7", 1, ["new"])), 1)
    assert size() - whole < whole / 4 and store.load().known.count() == 1201
    bucket = store.buckets_of(named(spark, "s7"))
    first, second = (store.commits.read(v)["tables"]["known"] for v in (0, 1))
    assert [int(b) for b in first if first[b] != second[b]] == bucket
