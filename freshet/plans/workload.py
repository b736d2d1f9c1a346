"""Every operator as a query over the test tables: ``pages`` as a crawl history, ``events`` as outcomes and reads.

A page's host is its site and its id its run. All anchors of these pages stand inside ``<nav>``, so links are
extracted with navigation kept. Times are returned as text, to compare equal across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.functions import text, urls
from freshet.operators import attempts, maintain, reader, report, settings
from freshet.operators.detect import Advance, advance, replay
from freshet.operators.extract import explode_links, extract, link_sites, path_prefix_stats, same_site_pairs
from freshet.plans import crawl
from freshet.session import scratch_folder, stage
from freshet.sources import feed as feed_source
from freshet.sources import state as state_source
from freshet.sources.reads import ReadLog
from freshet.sources.search import SearchIndex
from freshet.sources.snapshots import snapshots_of_pages
from freshet.streaming import continuous

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# --- inputs ---


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots_of_pages(table(spark, sf_dir, "pages"))


def crawled(spark: SparkSession, sf_dir: str, **overrides: object) -> DataFrame:
    return extract(snapshots(spark, sf_dir), **{"skip_navigation": False, **overrides})


def site_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site per host, listed by first page; hosts under .org are switched off."""
    host = F.lower(urls.url_netloc(F.col("url")))
    pages = table(spark, sf_dir, "pages").select(host.alias("site_id"), "page_id")
    return pages.groupBy("site_id").agg(F.min("page_id").alias("ord")).select(
        "site_id", "ord", F.col("site_id").alias("name"), F.concat(F.lit("https://"), "site_id", F.lit("/")).alias("url"),
        (~F.col("site_id").endswith(".org")).alias("enabled"), F.lit(False).alias("skip_navigation"),
    )


def halves(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The snapshots before and after the middle of their history."""
    middle = history.agg((F.max(F.unix_timestamp("run_ts")) + F.min(F.unix_timestamp("run_ts"))).alias("span"))
    marked = history.crossJoin(F.broadcast(middle)).withColumn("late", F.unix_timestamp("run_ts") * 2 > F.col("span")).drop("span")
    return marked.filter("NOT late").drop("late"), marked.filter("late").drop("late")


def crawled_halves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    pages, _ = stage(crawled(spark, sf_dir), "crawled")
    return list(halves(pages))


def read_urls(outcome: Advance) -> DataFrame:
    """What one reader has read: the known URLs whose length is a multiple of three."""
    return outcome.known.filter(F.length("url") % 3 == 0).select("url", F.col("first_seen").alias("read_at"))


def feed_of(spark: SparkSession, sf_dir: str, outcome: Advance) -> report.Feed:
    return report.build_feed(outcome.results, site_list(spark, sf_dir), outcome.state)


def rows_of(spark: SparkSession, sf_dir: str, outcome: Advance) -> DataFrame:
    return report.all_results(outcome.results, site_list(spark, sf_dir), outcome.sites)


def as_text(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def in_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: as_text(c) for c in columns})


NEW_ITEM = ["site_id", "url", "title", "pos", "first_seen"]
KNOWN = ["site_id", "url", "title", "first_seen", "seq"]
SITE = ["site_id", "seeded", "first_checked", "last_checked", "last_update", "last_status", "last_error", "consecutive_errors"]


def new_items_of(outcome: Advance) -> DataFrame:
    return in_text(outcome.new_items.select(*NEW_ITEM), "first_seen")


def site_states(sites: DataFrame) -> DataFrame:
    return in_text(sites.select(*SITE), "first_checked", "last_checked", "last_update")


# --- extraction ---


@query
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_text(explode_links(crawled(spark, sf_dir)), "run_ts")


@query
def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = crawled(spark, sf_dir)
    return in_text(pages.select("site_id", "run_ts", "link_count", "error"), "run_ts")


@query
def page_links_default_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(snapshots(spark, sf_dir))
    return pages.groupBy("error").agg(F.count("*").alias("pages"), F.sum("link_count").alias("links"))


@query
def page_links_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = crawled(spark, sf_dir, include=["/t", "/a", "/e"], exclude=["tion", ".org/"], min_title_length=4)
    return in_text(explode_links(pages), "run_ts")


@query
def page_links_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors that differ by site, from the site table; sites that are off drop out before parsing."""
    host = F.col("site_id")
    selector = F.when(host.endswith(".net"), "article a, h1 > a").when(host.startswith("www."), "nav > ul > li > a").otherwise("ul a[href]")
    pages = extract(snapshots(spark, sf_dir), site_list(spark, sf_dir).withColumn("selector", selector))
    return in_text(pages.select("site_id", "run_ts", "link_count", "error"), "run_ts")


@query
def selected_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that a path of elements and attributes chooses, page by page."""
    selector = "html > body nav > ul a[href^='/'], main .none"
    pages = extract(snapshots(spark, sf_dir), selector=selector)
    return in_text(explode_links(pages).select("site_id", "run_ts", "pos", "url", "title"), "run_ts")


@query
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("canonical_url"))


@query
def joined_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's URL joined with a relative reference made of its own path."""
    url = F.col("url")
    reference = F.concat(F.lit("../x/./"), F.regexp_replace(urls.url_path(url), "^/", ""), F.lit("?k=1#f"))
    return table(spark, sf_dir, "pages").select("page_id", urls.join_url(url, reference).alias("joined_url"))


@query
def same_site_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(urls.url_netloc(F.col("url")).alias("host"))
    return same_site_pairs(hosts)


@query
def link_path_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_prefix_stats(explode_links(crawled(spark, sf_dir)), ["site_id"])


@query
def page_path_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_prefix_stats(snapshots(spark, sf_dir).withColumnRenamed("page_url", "url").withColumn("pos", F.lit(0)), ["site_id"])


@query
def inspected_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_text(report.inspect_links(crawled(spark, sf_dir), ["site_id", "run_ts"], 3), "run_ts")


@query
def charset_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-Type headers made of each document's language and source."""
    header = F.concat(
        F.lit("text/html; x="), "source", F.when(F.col("lang") == "en", F.lit("; charset=ISO-8859-1")).otherwise(F.lit("")),
        F.lit('; Charset="'), "lang", F.lit('"'),
    )
    return table(spark, sf_dir, "documents").select("doc_id", attempts.charset_hint(header).alias("hint"))


@query
def fetch_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a day as the attempts of one fetch."""
    in_order = Window.partitionBy("user_id", F.to_date("ts")).orderBy("event_id")
    kind, value = F.col("event_type"), F.col("value")
    tried = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("site_id"),
        F.date_trunc("day", "ts").alias("run_ts"),
        (F.row_number().over(in_order) - 1).alias("attempt"),
        F.when(kind == "error", F.when((value >= 10) & (value < 25), 503)).when(value > 30, 404).otherwise(200).alias("http_status"),
        F.when((kind == "error") & (value < 10), "Timeout").when((kind == "error") & (value >= 25), "ConnectionError").alias("failure"),
    )
    return in_text(attempts.resolve_attempts(tried), "run_ts")


# --- pages dressed with what the test pages lack ---

#: Anchors put before a page's own ones, in this order: what a page may hold and the test pages don't.
DRESSING = """<a href="rel/x">rel</a><a href="mailto:a@b.c">m</a><a href="#top">t</a><a href="/">r</a><a href="/?p=1">q</a>
<a href="{url}">self</a><a href="/pic.PNG">pic</a><a href=" /doc.pdf ">doc</a><a href="/feed">feed</a>
<a href="HTTP://{upper}/Upper">upper</a><a href="http://{host}:80/Port">port</a>
<a href="/t?fbclid=1&amp;utm_source=x&amp;id=3">tracked</a><a href="/img-x"><img src="i.gif" alt=" A  picture "></a>
<a href="/ta-x" title="By  title"><b></b></a><a href="/late-x">{late}</a><a href="https://partner.example/p">partner</a>
<a href="https://sub.partner.example/s">partner sub</a><a href="https://other.test/o">other</a><a href="http://sub.{root}/s">sub</a>
<a href="{last}">ok</a><a href="/doc.pdf">again</a>"""
ALLOWED = ["partner.example"]


def dressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with ``DRESSING``: every fifth has a base, every 17th a malformed address, every third titles a link that
    is untitled elsewhere."""
    i, url = F.col("page_id"), F.col("url")
    host = F.lower(urls.url_netloc(url))
    filled = F.lit(DRESSING.replace("\n", ""))
    for name, value in {
        "url": F.replace(url, F.lit("&"), F.lit("&amp;")), "upper": F.upper(host), "host": host, "root": urls.base_host(host),
        "late": F.when(i % 3 == 0, "Late").otherwise(""), "last": F.when(i % 17 == 3, "http://[x").otherwise("/ok-x"),
    }.items():
        filled = F.replace(filled, F.lit("{" + name + "}"), value)
    base = F.when(i % 5 == 0, F.concat(F.lit('<head><base href="/b'), i.cast("string"), F.lit('/">'))).otherwise("<head>")
    html = F.replace(F.replace(F.col("html"), F.lit("<nav><ul>"), F.concat(F.lit("<nav><ul>"), filled)), F.lit("<head>"), base)
    return snapshots_of_pages(table(spark, sf_dir, "pages").withColumn("html", html))


def dressed_pages(spark: SparkSession, sf_dir: str, **settings: object) -> DataFrame:
    return extract(dressed(spark, sf_dir), skip_navigation=False, **settings)


@query
def dressed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_text(explode_links(dressed_pages(spark, sf_dir, allow_hosts=ALLOWED)), "run_ts")


@query
def dressed_links_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with links to all hosts, and titles of three characters or more."""
    return in_text(explode_links(dressed_pages(spark, sf_dir, allow_external=True, use_default_exclude=False, min_title_length=3)), "run_ts")


@query
def dressed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_text(dressed_pages(spark, sf_dir).select("site_id", "run_ts", "link_count", "error"), "run_ts")


@query
def same_site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_text(link_sites(dressed(spark, sf_dir), skip_navigation=False, allow_hosts=ALLOWED), "run_ts")


@query
def titles_filled_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of a link that is untitled on most pages, and the title its item had when it was new."""
    outcome = replay(dressed_pages(spark, sf_dir))
    late = outcome.known.filter(F.col("url").endswith("/late-x")).select("site_id", "url", "title")
    items = outcome.new_items.select("site_id", "url", F.col("title").alias("item_title"))
    return late.join(items, ["site_id", "url"], "left")


@query
def page_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as bytes: by header hint, by declaration, by byte-order mark, or as plain UTF-8."""
    way = F.unix_timestamp("run_ts") % 4
    undeclared = F.replace(F.col("html"), F.lit('<meta charset="utf-8">'), F.lit(""))
    declared = F.replace(F.col("html"), F.lit('"utf-8"'), F.lit('"iso-8859-1"'))
    content = (
        F.when(way == 0, F.encode("html", "UTF-8")).when(way == 1, F.encode(undeclared, "ISO-8859-1")).when(way == 2, F.encode(declared, "ISO-8859-1"))
        .otherwise(F.encode(F.concat(F.lit("\ufeff"), undeclared), "UTF-16LE"))
    )
    pages = snapshots(spark, sf_dir).withColumns({"content": content, "charset_hint": F.when(way == 1, "windows-1252")})
    return in_text(explode_links(extract(pages.drop("html"), skip_navigation=False)), "run_ts")


# --- change detection ---


@query
def new_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_items_of(replay(crawled(spark, sf_dir)))


@query
def new_links_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the history against the state the first half left."""
    before, after = crawled_halves(spark, sf_dir)
    return new_items_of(advance(replay(before).state, after))


@query
def known_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_text(replay(crawled(spark, sf_dir)).known.select(*KNOWN), "first_seen")


def _last_runs(history: DataFrame) -> list[DataFrame]:
    """Extracted pages before each site's last run, and of it."""
    pages, _ = stage(extract(history, skip_navigation=False), "crawled")
    last = pages.groupBy("site_id").agg(F.max("run_ts").alias("last"))
    marked = pages.join(last, "site_id")
    return [marked.filter("run_ts < last").drop("last"), marked.filter("run_ts = last").drop("last")]


@query
def known_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's last run against all runs before it, keeping five known URLs."""
    earlier, last = _last_runs(snapshots(spark, sf_dir))
    kept = advance(replay(earlier).state, last.withColumn("known_limit", F.lit(5))).known
    return in_text(kept.select(*KNOWN), "first_seen")


@query
def known_overflowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole history with room for five known URLs only: evicted ones come back as new."""
    pages = crawled(spark, sf_dir).withColumn("known_limit", F.lit(5))
    return new_items_of(replay(pages))


@query
def recent_per_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = replay(crawled(spark, sf_dir, max_items=7)).recent
    return in_text(recent.select("site_id", "ord", "url", "title", "first_seen"), "first_seen")


@query
def site_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_states(replay(crawled(spark, sf_dir, include=["/th", "/e"])).sites)


@query
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_text(replay(crawled(spark, sf_dir, include=["/th", "/e"])).results, "run_ts")


@query
def error_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a history of runs: errors fail, other events find one link."""
    events = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    link = F.struct(
        F.lit(0).alias("pos"), F.concat(F.lit("https://events.example/"), "event_type").alias("url"), F.col("event_type").alias("title")
    )
    pages = events.select(
        F.col("user_id").cast("string").alias("site_id"), F.col("ts").alias("run_ts"), F.lit(50).alias("max_items"),
        F.when(~failed, F.array(link)).otherwise(F.array().cast("array<struct<pos:int,url:string,title:string>>")).alias("links"),
        F.when(failed, 0).otherwise(1).alias("link_count"), F.when(failed, F.lit("HTTP 503")).alias("error"),
    )
    return site_states(replay(pages).sites)


# --- maintenance ---


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_list(spark, sf_dir).filter(F.col("site_id").endswith(".com")).select("site_id")


@query
def after_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = maintain.reset_history(replay(crawled(spark, sf_dir)).state, _targets(spark, sf_dir))
    recent = state.recent.groupBy("site_id").agg(F.count("*").alias("recent"))
    known = state.known.groupBy("site_id").agg(F.count("*").alias("known"))
    return (
        site_states(state.sites).select("site_id", "seeded", "last_update").join(recent, "site_id", "left").join(known, "site_id", "left")
    )


@query
def reset_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.resettable(replay(crawled(spark, sf_dir)).state, _targets(spark, sf_dir))


@query
def after_refill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second half reports when some sites were refilled after the first."""
    before, after = crawled_halves(spark, sf_dir)
    state = maintain.refill(replay(before).state, _targets(spark, sf_dir))
    return new_items_of(advance(state, after))


@query
def after_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = site_list(spark, sf_dir).filter("enabled")
    return in_text(maintain.prune(replay(crawled(spark, sf_dir)).state, sites).known.select(*KNOWN), "first_seen")


@query
def partial_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only some sites are checked in the second half; the feed still lists all of them."""
    sites, only = site_list(spark, sf_dir), _targets(spark, sf_dir)
    before, after = crawled_halves(spark, sf_dir)
    wanted = maintain.enabled_sites(sites, only)
    outcome = advance(replay(before).state, after.join(wanted.select("site_id"), "site_id", "left_semi"))
    rows = report.all_results(outcome.results, sites, outcome.sites)
    shown = ["site_id", "status", "last_checked", "last_update", "new_count", "link_count", "seeded_now", "result_ord"]
    return in_text(rows.select(*shown), "last_checked", "last_update")


# --- report ---


@query
def timeline_300(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = replay(crawled(spark, sf_dir))
    items = report.timeline(rows_of(spark, sf_dir, outcome), outcome.recent)
    return in_text(items.select("site_id", "site_name", "title", "url", "first_seen", "ord"), "first_seen")


@query
def feed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = feed_of(spark, sf_dir, replay(crawled(spark, sf_dir)))
    flat = feed.sites.select(
        "site_id", "name", "url", "status", "error", "consecutive_errors", "last_checked", "last_update", "new_count",
        "link_count", "seeded_now", F.size("items").alias("item_count"),
        F.array_join(F.transform("items", lambda i: i["url"]), " ").alias("item_urls"),
    )
    return in_text(flat, "last_checked", "last_update")


@query
def feed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_of(spark, sf_dir, replay(crawled(spark, sf_dir, include=["/th", "/e"]))).totals


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = report.run_summary(replay(crawled(spark, sf_dir, include=["/th", "/e"])).results, site_list(spark, sf_dir))
    return report.in_summary_order(summary).select("site_id", "label", "detail", "ord", "summary_ord")


@query
def run_summary_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = replay(crawled(spark, sf_dir))
    return report.summary_titles(outcome.new_items, outcome.results)


# --- reader ---


@query
def unread_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = replay(crawled(spark, sf_dir))
    items = report.timeline(rows_of(spark, sf_dir, outcome), outcome.recent)
    found = reader.search_timeline(items, read_urls(outcome), " TH ", unread_only=True)
    return in_text(found.select("site_id", "title", "url", "first_seen"), "first_seen")


@query
def unread_per_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = replay(crawled(spark, sf_dir))
    return reader.unread_counts(outcome.recent, read_urls(outcome))


@query
def reader_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = replay(crawled(spark, sf_dir, include=["/th", "/e"]))
    feed = feed_of(spark, sf_dir, outcome)
    return reader.header(feed.totals, feed.timeline, read_urls(outcome), F.lit("run")).drop("generated_at")


@query
def site_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = replay(crawled(spark, sf_dir, include=["/th", "/e"]))
    rows = reader.with_unread(rows_of(spark, sf_dir, outcome), outcome.recent, read_urls(outcome))
    return reader.rank_sites(rows).select("site_id", "unread", "status", "rank")


@query
def site_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = replay(crawled(spark, sf_dir))
    return reader.search_sites(rows_of(spark, sf_dir, outcome), outcome.recent, "Tion").select("site_id")


@query
def site_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search, items found through the index."""
    outcome = replay(crawled(spark, sf_dir))
    rows = rows_of(spark, sf_dir, outcome)
    found = SearchIndex(spark, scratch_folder(spark, "search")).build(outcome.recent).search("Tion")
    own = rows.filter(text.matches_query(F.concat_ws(" ", "name", "url"), "Tion")).select("site_id")
    return own.unionByName(found.select("site_id")).distinct()


@query
def card_items_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unread items on the cards that hold a query, found through the index."""
    outcome = replay(crawled(spark, sf_dir))
    found = SearchIndex(spark, scratch_folder(spark, "search")).build(outcome.recent).search(" THe ")
    return reader.card_items(found, read_urls(outcome), "", unread_only=True).select("site_id", "ord", "display_title")


@query
def site_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = replay(crawled(spark, sf_dir, include=["/th", "/e"]))
    rows = reader.with_unread(rows_of(spark, sf_dir, outcome), outcome.recent, read_urls(outcome))
    return reader.badge(rows).select("site_id", "badge", "is_open", "message")


@query
def card_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = replay(crawled(spark, sf_dir))
    return reader.card_items(outcome.recent, read_urls(outcome), "th", unread_only=True).select("site_id", "ord", "display_title")


@query
def marked_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with even ids are in the log; the others are clicks, which change no time in the log."""
    reads = _reads(spark, sf_dir)
    stored = reads.filter("event_id % 2 = 0").groupBy("reader_id", "url").agg(F.min("read_at").alias("read_at"))
    clicks = reads.filter("event_id % 2 = 1").drop("event_id")
    return in_text(reader.mark_read(stored, clicks), "read_at")


@query
def all_marked_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = replay(crawled(spark, sf_dir))
    items = report.timeline(rows_of(spark, sf_dir, outcome), outcome.recent)
    reads = read_urls(outcome).withColumn("reader_id", F.lit("r")).select("reader_id", "url", "read_at")
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    return in_text(reader.mark_all_read(reads, items, F.lit("r"), now), "read_at")


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("reader_id"),
        F.concat(F.lit("https://read.example/"), "event_type", F.lit("/"), F.floor(F.col("value")).cast("string")).alias("url"),
        F.col("ts").alias("read_at"), "event_id",
    )


@query
def read_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = _reads(spark, sf_dir).drop("event_id")
    reads = reader.mark_read(spark.createDataFrame([], clicks.schema), clicks)
    return in_text(reader.keep_newest_reads(reads, 20), "read_at")


@query
def age_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2024-02-15 12:00:00").cast("timestamp")
    age = text.relative_age(F.col("ts"), as_of)
    return table(spark, sf_dir, "events").groupBy(age.alias("age")).agg(F.count("*").alias("events"))


@query
def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages named after themselves where the host is a ``www``, else by their path."""
    title = F.when(F.col("url").contains("//www."), F.concat(F.lit(" 　"), "url", F.lit(" ")))
    return table(spark, sf_dir, "pages").select("page_id", text.display_title(title, F.col("url")).alias("display_title"))


# --- site settings ---


def raw_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw settings as each page might declare them: some complete, some sparse, some wrong."""
    pages, i, url = table(spark, sf_dir, "pages"), F.col("page_id"), F.col("url")

    def member(key: str, value: Column | str, when: Column) -> Column:
        return F.when(when, F.concat(F.lit(f'"{key}":'), F.lit(value) if isinstance(value, str) else value))

    quoted = F.to_json(F.struct(url.alias("u")))
    members = F.array_compact(
        F.array(
            member("url", F.regexp_extract(quoted, r'^\{"u":(.*)\}$', 1), i % 11 != 0),
            member("url", '"ftp://x.example/"', i % 22 == 11),
            member("name", F.concat(F.lit('" Page No. '), (i % 40).cast("string"), F.lit(' "')), i % 3 == 0),
            member("id", F.concat(F.lit('"p-'), i.cast("string"), F.lit('"')), i % 2 == 0),
            member("timeout", F.concat(F.lit('"'), i.cast("string"), F.lit('"')), i % 5 == 1),
            member("retries", "null", i % 35 == 3),
            member("max_items", "2.7", i % 4 == 1),
            member("max_items", "100", i % 4 == 2),
            member("include", '"/news/"', i % 6 == 0),
            member("include", "null", i % 6 == 1),
            member("include", '["/a",1,true]', i % 6 == 2),
            member("exclude", '{"a":1}', i % 50 == 7),
            member("enabled", "0", i % 7 == 0),
            member("enabled", '"false"', i % 7 == 1),
            member("selector", "null", i % 2 == 1),
            member("selector", '"ul a"', i % 8 == 4),
            member("colour", '"unknown keys are ignored"', i % 2 == 0),
        )
    )
    return pages.select(i.alias("ord"), F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")).alias("entry"))


@query
def site_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = settings.site_table(raw_settings(spark, sf_dir), {"timeout": 30, "selector": "main a", "include": ["/x/"], "max_items": 10})
    joined = {c: F.array_join(c, "|") for c in ("include", "exclude")}
    return sites.withColumns(joined).select(
        "ord", "site_id", "name", "url", "selector", "include", "exclude", "enabled", "skip_navigation", "timeout", "retries",
        "max_items", "known_limit",
    )


@query
def site_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings.violations(raw_settings(spark, sf_dir))


# --- sources, sinks and streaming, over a fresh folder ---


@query
def stored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known URLs after the state was written, committed and read back."""
    store = state_source.StateStore(spark, scratch_folder(spark, "state"))
    state = store.save(replay(crawled(spark, sf_dir)).state)
    return in_text(state.known.select(*KNOWN), "first_seen")


@query
def exported_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent items after the state went out as JSON lines and came back."""
    path = scratch_folder(spark, "state-json")
    state_source.export_state(replay(crawled(spark, sf_dir, max_items=7)).state, path)
    recent = state_source.import_state_lines(spark, path).recent
    return in_text(recent.select("site_id", "ord", "url", "title", "first_seen"), "first_seen")


#: Lines in a part of a document that is read back: several parts even of a small one.
PART = 40


@query
def state_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known URLs, in the order they are kept in, after the state went out as one JSON document in parts and came back."""
    path = scratch_folder(spark, "state-document")
    state_source.write_state_document(replay(crawled(spark, sf_dir)).state, path, F.lit("2024-06-01 00:00:00").cast("timestamp"), PART)
    known = state_source.import_state_document(spark, path).known
    return in_text(known.select(*KNOWN), "first_seen")


@query
def state_document_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site states after the same way, of a history with failed pages."""
    path = scratch_folder(spark, "state-document")
    state_source.write_state_document(replay(crawled(spark, sf_dir, include=["/th", "/e"])).state, path, F.lit("2024-06-01 00:00:00").cast("timestamp"), PART)
    return site_states(state_source.import_state_document(spark, path).sites)


def _feed_document(spark: SparkSession, sf_dir: str) -> report.Feed:
    path = scratch_folder(spark, "feed-document")
    feed = feed_of(spark, sf_dir, replay(crawled(spark, sf_dir)))
    feed_source.write_feed_document(feed, path, F.lit("2024-06-01 00:00:00").cast("timestamp"), PART)
    return feed_source.read_feed_document(spark, path)


@query
def feed_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline, in its order, after the feed went out as one JSON document in parts and came back."""
    return in_text(_feed_document(spark, sf_dir).timeline.select("site_id", "site_name", "title", "url", "first_seen", "ord"), "first_seen")


@query
def feed_document_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site cards after the same way, in their order."""
    sites = _feed_document(spark, sf_dir).sites
    flat = sites.select(
        "site_id", "url", "status", "error", "consecutive_errors", "last_checked", "last_update", "new_count", "link_count", "seeded_now",
        F.array_join(F.transform("items", lambda i: F.concat_ws(" ", i["url"], i["title"], as_text(i["first_seen"]))), "|").alias("items"), "result_ord",
    )
    return in_text(flat, "last_checked", "last_update")


@query
def feed_document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed_document(spark, sf_dir).totals


@query
def feed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline after the feed was written and read back."""
    path = scratch_folder(spark, "feed")
    feed_source.write_feed(feed_of(spark, sf_dir, replay(crawled(spark, sf_dir))), path)
    items = feed_source.read_feed(spark, path).timeline
    return in_text(items.select("site_id", "site_name", "title", "url", "first_seen", "ord"), "first_seen")


@query
def checked_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored runs of the job, over the first and the second half of the history; what the second reports."""
    store, sites = state_source.StateStore(spark, scratch_folder(spark, "check")), site_list(spark, sf_dir)
    before, after = halves(snapshots(spark, sf_dir))
    crawl.check(store, sites, before)
    return new_items_of(crawl.check(store, sites, after).outcome)


@query
def checked_in_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half stored, then a run of some sites over the second: their buckets are rewritten, all known URLs are there."""
    store, sites = state_source.StateStore(spark, scratch_folder(spark, "check"), buckets=4), site_list(spark, sf_dir)
    before, after = halves(snapshots(spark, sf_dir))
    crawl.check(store, sites, before)
    crawl.check(store, sites, after, only=_targets(spark, sf_dir))
    return in_text(store.load().known.select(*KNOWN), "first_seen")


@query
def feed_after_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half stored and published, some sites reset: the timeline of the document that is published again."""
    store, sites, path = state_source.StateStore(spark, scratch_folder(spark, "check")), site_list(spark, sf_dir), scratch_folder(spark, "feed")
    crawl.check(store, sites, halves(snapshots(spark, sf_dir))[0], path)
    crawl.reset_history(store, sites, path, _targets(spark, sf_dir))
    items = feed_source.read_feed_document(spark, f"{feed_source.feed_folder(spark, path)}/document").timeline
    return in_text(items.select("site_id", "title", "url", "first_seen", "ord"), "first_seen")


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts at each page: every seventh never answers, every eleventh is missing, every fifth answers the second time."""
    i = F.col("page_id")
    tried = snapshots_of_pages(table(spark, sf_dir, "pages")).select("site_id", "run_ts", F.unix_timestamp("run_ts").alias("page_id"))

    def tries(*outcomes: tuple[int | None, str | None]) -> Column:
        made = [(F.lit(n), F.lit(status).cast("int"), F.lit(failure).cast("string")) for n, (status, failure) in enumerate(outcomes)]
        return F.array(*[F.struct(n.alias("attempt"), status.alias("http_status"), failure.alias("failure")) for n, status, failure in made])

    status = (
        F.when(i % 7 == 0, tries((None, "Timeout"), (None, "Timeout"), (None, "Timeout"))).when(i % 11 == 0, tries((404, None)))
        .when(i % 5 == 0, tries((503, None), (200, None))).otherwise(tries((200, None)))
    )
    return tried.select("site_id", "run_ts", F.inline(status))


def _fetched_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_list(spark, sf_dir).withColumns({"retries": F.lit(2), "timeout": F.lit(20)})


@query
def attempts_to_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the outcomes of their fetches; those that never came have no row among the snapshots."""
    history = snapshots(spark, sf_dir).filter(F.unix_timestamp("run_ts") % 7 != 0)
    joined = attempts.with_outcomes(history, _attempts(spark, sf_dir), _fetched_sites(spark, sf_dir))
    pages = extract(joined, skip_navigation=False)
    return in_text(pages.select("site_id", "run_ts", "link_count", "error"), "run_ts")


@query
def checked_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site states after a job that was given the attempts."""
    store, sites = state_source.StateStore(spark, scratch_folder(spark, "check")), _fetched_sites(spark, sf_dir)
    return site_states(crawl.check(store, sites, snapshots(spark, sf_dir), attempts=_attempts(spark, sf_dir)).state.sites)


@query
def pages_within_a_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pages of a site a second, in the job: the last counts, the others are put aside."""
    store, sites = state_source.StateStore(spark, scratch_folder(spark, "check")), site_list(spark, sf_dir)
    at = F.unix_timestamp("run_ts")
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    quarter = F.timestamp_micros((start * 1_000_000 + (at - start) * 2_000).cast("bigint"))
    done = crawl.check(store, sites, snapshots(spark, sf_dir).withColumn("run_ts", quarter))
    late = done.late.groupBy("site_id").agg(F.count("*").alias("aside"))
    return in_text(done.state.sites.join(late, "site_id", "left").select("site_id", "last_checked", "aside"), "last_checked")


@query
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half stored, the second looked at only: what it would report, and the number of the version that stays."""
    store, sites = state_source.StateStore(spark, scratch_folder(spark, "check")), site_list(spark, sf_dir)
    before, after = halves(snapshots(spark, sf_dir))
    crawl.check(store, sites, before)
    looked = crawl.check(store, sites, after, only=_targets(spark, sf_dir), dry_run=True)
    return new_items_of(looked.outcome).withColumn("version", F.lit(store.version()))


@query
def replaced_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole history's state, with that of the first half put back for the maintained sites, disabled ones included."""
    sites = site_list(spark, sf_dir)
    pages, _ = stage(crawled(spark, sf_dir), "crawled")
    targets = maintain.target_sites(sites, sites.filter(F.col("site_id").endswith(".org")))
    old, new = replay(halves(pages)[0]).state, replay(pages).state
    update = maintain.prune(old, targets)
    return in_text(maintain.replace_sites(new, update).known.select(*KNOWN), "first_seen")


@query
def late_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the history, then all of it: the job puts the first half aside."""
    store, sites = state_source.StateStore(spark, scratch_folder(spark, "check")), site_list(spark, sf_dir)
    history = snapshots(spark, sf_dir)
    crawl.check(store, sites, halves(history)[0])
    return in_text(crawl.check(store, sites, history).late.select("site_id", "run_ts", "page_url"), "run_ts")


@query
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.run_totals(replay(crawled(spark, sf_dir)).results)


@query
def read_log_after_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with even ids are marked in a stored log of twenty reads a reader, then the others."""
    log, events = ReadLog(spark, scratch_folder(spark, "reads"), 20), _reads(spark, sf_dir)
    log.mark(events.filter("event_id % 2 = 0").drop("event_id"))
    return in_text(log.mark(events.filter("event_id % 2 = 1").drop("event_id")), "read_at")


@query
def read_log_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same marks, with the log compacted between them and after."""
    log, events = ReadLog(spark, scratch_folder(spark, "reads"), 20), _reads(spark, sf_dir)
    log.mark(events.filter("event_id % 2 = 0").drop("event_id"))
    log.compact()
    log.mark(events.filter("event_id % 2 = 1").drop("event_id"))
    log.compact()
    return in_text(log.load(), "read_at")


@query
def stream_new_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two halves of the history arriving one after the other as snapshot files."""
    folder = scratch_folder(spark, "stream")
    store = state_source.StateStore(spark, f"{folder}/state")
    for part in halves(snapshots(spark, sf_dir)):
        part.select(
            "site_id", "run_ts", "page_url", F.lit(None).cast("binary").alias("content"), "html",
            F.lit(None).cast("string").alias("charset_hint"), F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("error"),
        ).write.mode("append").parquet(f"{folder}/in")
        arriving = continuous.stream_snapshots(spark, f"{folder}/in")
        continuous.detect_continuously(
            arriving, store, f"{folder}/out", f"{folder}/checkpoint", skip_navigation=False
        ).awaitTermination()
    return in_text(continuous.new_items_of(spark, f"{folder}/out").select(*NEW_ITEM), "first_seen")
