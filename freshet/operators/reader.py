"""The reader's side of a feed: what is unread, searching, ranking, and the log of what was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.text import display_title, matches_query
from freshet.operators.topk import numbered, top_per_group

# The length of the read log, and the texts on a site's card.
READ_LIMIT = 3000
BADGE_ERROR = "エラー"
BADGE_SEEDED = "登録済み"
BADGE_UNREAD = "未読 %d"
BADGE_NONE = "更新なし"
CARD_ERROR = "取得に失敗しました: %s"
CARD_ERROR_TIMES = "（%d回連続）"
CARD_ERROR_UNKNOWN = "原因不明"
CARD_SEEDED = "初回巡回のため %d 件のリンクを記録しました。新着の検知は次回からです。"


def reads_of(reads: DataFrame, reader_id: str) -> DataFrame:
    return reads.filter(F.col("reader_id") == reader_id).select("url", "read_at")


def unread(items: DataFrame, reads: DataFrame) -> DataFrame:
    return items.join(reads.select("url"), "url", "left_anti")


def with_read_flag(items: DataFrame, reads: DataFrame) -> DataFrame:
    seen = reads.select("url").distinct().withColumn("is_read", F.lit(True))
    return items.join(seen, "url", "left").withColumn("is_read", F.coalesce("is_read", F.lit(False)))


def mark_read(reads: DataFrame, clicks: DataFrame) -> DataFrame:
    """Add clicked URLs at the time of their first click; what was read before keeps its time, whatever the clicks say."""
    first = clicks.groupBy("reader_id", "url").agg(F.min("read_at").alias("read_at"))
    return reads.unionByName(first.join(reads, ["reader_id", "url"], "left_anti"))


def mark_all_read(reads: DataFrame, timeline: DataFrame, reader_id: Column, now: Column) -> DataFrame:
    """Every timeline item is read now, also one read before; items outside the timeline stay as they are."""
    marked = timeline.select(reader_id.alias("reader_id"), "url", now.alias("read_at")).distinct()
    return reads.join(marked, ["reader_id", "url"], "left_anti").unionByName(marked)


def keep_newest_reads(reads: DataFrame, limit: int = READ_LIMIT) -> DataFrame:
    """The latest reads of each reader; Spark cuts each partition to the limit before the shuffle."""
    order = [F.col("read_at").desc(), F.col("url")]
    return top_per_group(reads, ["reader_id"], order, limit, ["url"]).drop("rank")


def search_timeline(timeline: DataFrame, reads: DataFrame, query: str = "", unread_only: bool = False) -> DataFrame:
    """Timeline entries whose shown title and site name hold the query."""
    items = unread(timeline, reads) if unread_only else timeline
    text = F.concat(display_title(F.col("title"), F.col("url")), F.lit(" "), F.coalesce("site_name", F.lit("")))
    return items.filter(matches_query(text, query))


def unread_counts(recent: DataFrame, reads: DataFrame) -> DataFrame:
    """Unread items per site, for sites that have any."""
    return unread(recent, reads).groupBy("site_id").agg(F.count("*").alias("unread"))


def with_unread(rows: DataFrame, recent: DataFrame, reads: DataFrame) -> DataFrame:
    counts = unread_counts(recent, reads)
    return rows.join(counts, "site_id", "left").withColumn("unread", F.coalesce("unread", F.lit(0)))


def header(totals: DataFrame, timeline: DataFrame, reads: DataFrame, generated_at: Column) -> DataFrame:
    """Last run, sites, errors, and unread entries of the timeline."""
    count = unread(timeline, reads).agg(F.count("*").alias("unread"))
    return totals.crossJoin(count).select(generated_at.alias("generated_at"), "site_count", "unread", "error_count")


def search_sites(rows: DataFrame, recent: DataFrame, query: str = "") -> DataFrame:
    """Sites whose name or URL, or any of whose items' titles, hold the query."""
    own = matches_query(F.concat_ws(" ", "name", "url"), query)
    hits = recent.filter(matches_query(display_title(F.col("title"), F.col("url")), query)).select("site_id").distinct()
    by_item = hits.withColumn("_hit", F.lit(True))
    return rows.join(by_item, "site_id", "left").filter(own | F.col("_hit").isNotNull()).drop("_hit")


def rank_sites(rows_with_unread: DataFrame) -> DataFrame:
    """Most unread first, then failures, then by name as Japanese readers sort it, then as listed: numbered from 1 in ``rank``."""
    failed = (F.col("status") == "error").cast("int")
    order = [F.col("unread").desc(), failed.desc(), F.collate("name", "ja").asc(), F.col("result_ord").asc()]
    return numbered(rows_with_unread, order).orderBy("rank")


def badge(rows_with_unread: DataFrame) -> DataFrame:
    """What a site's card shows: badge, whether it is open, and the message of a failed or new site."""
    failed, seeded = F.col("status") == "error", F.col("seeded_now")
    label = (
        F.when(failed, F.lit(BADGE_ERROR))
        .when(seeded, F.lit(BADGE_SEEDED))
        .when(F.col("unread") > 0, F.format_string(BADGE_UNREAD, "unread"))
        .otherwise(F.lit(BADGE_NONE))
    )
    reason = F.when(F.coalesce("error", F.lit("")) != "", F.col("error")).otherwise(F.lit(CARD_ERROR_UNKNOWN))
    times = F.when(F.col("consecutive_errors") > 1, F.format_string(CARD_ERROR_TIMES, "consecutive_errors"))
    failure = F.concat(F.format_string(CARD_ERROR, reason), F.coalesce(times, F.lit("")))
    message = F.when(failed, failure).when(seeded, F.format_string(CARD_SEEDED, "link_count"))
    is_open = (F.col("unread") > 0) | failed
    return rows_with_unread.withColumns({"badge": label, "is_open": is_open, "message": message})


def card_items(recent: DataFrame, reads: DataFrame, query: str = "", unread_only: bool = False) -> DataFrame:
    """The items listed on the cards: matched by their own shown title only."""
    items = unread(recent, reads) if unread_only else recent
    shown = items.withColumn("display_title", display_title(F.col("title"), F.col("url")))
    return shown.filter(matches_query(F.col("display_title"), query))
