"""From run results and state to the feed: site rows, timeline, totals, run summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.text import NO_TITLE, blank_to_null
from freshet.operators.detect import State, states_of
from freshet.operators.topk import numbered, top_per_group

# The feed's version and lengths, and the texts of the run summary.
FEED_VERSION = 1
TIMELINE_LIMIT = 300
SUMMARY_TITLES = 5
SUMMARY_WIDTH = 60
INSPECT_WIDTH = 70
FAILED = "失敗"
FIRST_RUN = "初回"
FOUND_NEW = "新着"
UNCHANGED = "更新なし"
FIRST_RUN_DETAIL = "%d件のリンクを記録（新着判定は次回から）"
FOUND_NEW_DETAIL = "%d件"

_UNCHECKED = 1 << 40


@dataclass(frozen=True)
class Feed:
    """A feed as tables: one row per site, the cross-site timeline, and the totals (one row)."""

    sites: DataFrame
    timeline: DataFrame
    totals: DataFrame


def all_results(results: DataFrame, sites: DataFrame, states: DataFrame) -> DataFrame:
    """Results of the checked sites, then every other site with its remembered state and nothing new.

    ``result_ord`` carries the order: checked sites as listed, then the others as listed.
    """
    configured = sites.select("site_id", "ord", "name", "url")
    checked = results.select("site_id", "link_count", "new_count", "seeded_now", F.lit(True).alias("checked"))
    joined = states_of(configured, states).join(checked, "site_id", "left")
    return joined.select(
        "site_id",
        "name",
        "url",
        F.col("last_status").alias("status"),
        F.col("last_error").alias("error"),
        "consecutive_errors",
        "last_checked",
        "last_update",
        F.coalesce("new_count", F.lit(0)).alias("new_count"),
        F.coalesce("link_count", F.lit(0)).alias("link_count"),
        F.coalesce("seeded_now", F.lit(False)).alias("seeded_now"),
        (F.col("ord") + F.when(F.col("checked"), F.lit(0)).otherwise(F.lit(_UNCHECKED))).alias("result_ord"),
    )


def feed_sites(rows: DataFrame, recent: DataFrame) -> DataFrame:
    """Site rows with their recent items nested; a site has at most ``max_items`` of them."""
    items = recent.groupBy("site_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ord", "title", "url", "first_seen"))),
            lambda i: F.struct(i["title"].alias("title"), i["url"].alias("url"), i["first_seen"].alias("first_seen")),
        ).alias("items")
    )
    empty = F.array().cast("array<struct<title:string,url:string,first_seen:timestamp>>")
    return rows.join(items, "site_id", "left").withColumn("items", F.coalesce("items", empty))


def timeline(rows: DataFrame, recent: DataFrame, limit: int = TIMELINE_LIMIT) -> DataFrame:
    """The newest items of all sites; equal times keep the order of sites and of items within them."""
    return (
        recent.join(rows.select("site_id", F.col("name").alias("site_name"), "result_ord"), "site_id")
        .orderBy(F.col("first_seen").desc(), "result_ord", "ord")
        .limit(limit)
        .select("site_id", "site_name", "title", "url", "first_seen", "result_ord", "ord")
    )


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("site_count"),
        F.coalesce(F.sum("new_count"), F.lit(0)).alias("new_count"),
        F.count_if(F.col("status") == "error").alias("error_count"),
    )


def build_feed(results: DataFrame, sites: DataFrame, state: State) -> Feed:
    rows = all_results(results, sites, state.sites)
    return Feed(feed_sites(rows, state.recent), timeline(rows, state.recent), totals(rows))


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def feed_lines(feed: Feed, generated_at: Column) -> DataFrame:
    """The feed as the lines of one JSON document, in order: a head, a line for each site, a line for each timeline entry.

    The lines are sorted by ranges and written in parts, of which each is a piece of the document: no number of sites is
    too many, and nothing is gathered in one row.
    """
    site = F.struct(
        F.col("site_id").alias("id"), "name", "url", "status", "error", "consecutive_errors",
        _iso(F.col("last_checked")).alias("last_checked"), _iso(F.col("last_update")).alias("last_update"),
        "new_count", "link_count", "seeded_now",
        F.transform("items", lambda i: F.struct(i["title"].alias("title"), i["url"].alias("url"), _iso(i["first_seen"]).alias("first_seen"))).alias("items"),
    )
    entry = F.struct("site_id", "site_name", "title", "url", _iso(F.col("first_seen")).alias("first_seen"))
    head = F.struct(F.lit(FEED_VERSION).alias("version"), _iso(generated_at).alias("generated_at"), "site_count", "new_count", "error_count")
    opened = F.concat(F.regexp_replace(_json(head), "\\}$", ""), F.lit(',"sites":['))
    newest = -F.unix_micros(F.col("first_seen"))
    return in_document([
        (feed.totals, [], opened),
        (feed.sites, [F.lit(""), F.col("result_ord")], _json(site)),
        (feed.totals, [], F.lit('],"timeline":[')),
        (feed.timeline, [F.lit(""), newest, F.col("result_ord"), F.col("ord")], _json(entry)),
        (feed.totals, [], F.lit("]}")),
    ])


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def in_document(sections: list[tuple[DataFrame, list[Column], Column]]) -> DataFrame:
    """``value``: the lines of a document made of sections (rows, order, line), sorted by section and order.

    An order is a name and up to three numbers. The lines of a section that has one form a list: each but the first
    begins with a comma.
    """
    parts = []
    for number, (rows, order, line) in enumerate(sections):
        name, *numbers = order or [F.lit("")]
        keys = [(numbers[k] if k < len(numbers) else F.lit(0)).cast("bigint").alias(f"k{k}") for k in range(3)]
        part = rows.select(F.lit(number).alias("section"), name.alias("name"), *keys, line.alias("line"))
        if order:
            at = F.struct("name", "k0", "k1", "k2")
            first = part.agg(F.min(at).alias("first"))
            part = part.crossJoin(F.broadcast(first)).withColumn("line", F.when(at != F.col("first"), F.concat(F.lit(","), F.col("line"))).otherwise(F.col("line"))).drop("first")
        parts.append(part)
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines.orderBy("section", "name", "k0", "k1", "k2").select(F.col("line").alias("value"))


def run_summary(results: DataFrame, sites: DataFrame) -> DataFrame:
    """What the run's summary says of each checked site; ``in_summary_order`` puts failures first, then most news."""
    named = results.join(sites.select("site_id", "ord", "name"), "site_id")
    failed, seeded, found = F.col("status") == "error", F.col("seeded_now"), F.col("new_count") > 0
    label = F.when(failed, FAILED).when(seeded, FIRST_RUN).when(found, FOUND_NEW).otherwise(UNCHANGED)
    detail = (
        F.when(failed, F.col("error"))
        .when(seeded, F.format_string(FIRST_RUN_DETAIL, "link_count"))
        .when(found, F.format_string(FOUND_NEW_DETAIL, "new_count"))
        .otherwise("")
    )
    return named.select(
        "site_id", "name", label.alias("label"), detail.alias("detail"), "status", "new_count", "link_count", "ord"
    )


def in_summary_order(summary: DataFrame) -> DataFrame:
    """The summary with its order as ``summary_ord``, from 1."""
    order = [(F.col("status") != "error").asc(), F.col("new_count").desc(), F.col("ord").asc()]
    return numbered(summary, order, "summary_ord").orderBy("summary_ord")


def summary_titles(new_items: DataFrame, results: DataFrame, shown: int = SUMMARY_TITLES) -> DataFrame:
    """The first titles each site's last run found new, cut to width, with how many more there are."""
    current = new_items.join(
        results.filter(~F.col("seeded_now")).select("site_id", F.col("run_ts").alias("first_seen"), "new_count"),
        ["site_id", "first_seen"],
    )
    return top_per_group(current, ["site_id"], [F.col("pos")], shown, ["pos"]).select(
        "site_id",
        "rank",
        F.coalesce(blank_to_null(F.substring("title", 1, SUMMARY_WIDTH)), F.lit(NO_TITLE)).alias("title"),
        F.greatest(F.col("new_count") - shown, F.lit(0)).alias("more"),
    )


def run_totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("site_count"),
        F.coalesce(F.sum("new_count"), F.lit(0)).alias("new_count"),
        F.count_if(F.col("status") == "error").alias("error_count"),
    )


def inspect_links(pages: DataFrame, by: list[str], limit: int = 30) -> DataFrame:
    """The first links of each page as shown for inspection: a slice of the page's own list, without a shuffle."""
    shown = pages.filter(F.col("error").isNull()).select(*by, F.posexplode(F.slice("links", 1, limit)).alias("at", "link"))
    title = F.coalesce(blank_to_null(F.substring("link.title", 1, INSPECT_WIDTH)), F.lit(NO_TITLE))
    return shown.select(*by, (F.col("at") + 1).alias("rank"), title.alias("title"), F.col("link.url").alias("url"))
