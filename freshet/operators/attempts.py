"""Fetch attempts to one outcome per site and run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.session import join_dimension, stage
from freshet.functions.text import strip_text

# Statuses worth another attempt, and the messages of a failed one.
RETRY_STATUS = [408, 425, 429, 500, 502, 503, 504]
TIMED_OUT = "タイムアウト（%s秒）"
NO_CONNECTION = "接続エラー: "
UNKNOWN_ERROR = "不明なエラー"


def charset_hint(content_type: Column) -> Column:
    """The first usable ``charset`` of a Content-Type header; ISO-8859-1 is a client's default and tells nothing."""
    parts = F.transform(F.split(content_type, ";"), strip_text)
    named = F.filter(parts, lambda p: F.lower(p).startswith("charset="))
    values = F.transform(named, lambda p: F.regexp_replace(strip_text(F.substring(p, 9, 2**31 - 1)), "^[\"']+|[\"']+\\z", ""))
    return F.get(F.filter(values, lambda v: (v != "") & (F.lower(v) != "iso-8859-1")), F.lit(0))


def is_retryable(http_status: Column, failure: Column) -> Column:
    """Timeouts, connection failures and transient statuses are tried again."""
    return failure.isNotNull() | http_status.isin(RETRY_STATUS)


def attempt_error(http_status: Column, failure: Column, timeout: Column) -> Column:
    """Message of one attempt, NULL for a success. ``failure`` is ``Timeout`` or the connection error's name."""
    return (
        F.when(failure == "Timeout", F.format_string(TIMED_OUT, timeout.cast("string")))
        .when(failure.isNotNull(), F.concat(F.lit(NO_CONNECTION), failure))
        .when(http_status >= 400, F.concat(F.lit("HTTP "), http_status.cast("string")))
    )


#: Outcomes (a few narrow columns each) are broadcast up to this many, after counting.
BROADCAST_OUTCOMES = 500_000


def with_outcomes(snapshots: DataFrame, attempts: DataFrame, sites: DataFrame) -> DataFrame:
    """Snapshots with the outcome of their fetch: each site's own retries and timeout decide, and a failure becomes the
    snapshot's error. A run that left attempts but no page is a snapshot without a page.

    Outcomes go to the pages, not pages to the outcomes: what moves are keys, and page texts only where there are more
    outcomes than can be broadcast.
    """
    own = join_dimension(attempts, sites.select("site_id", "retries", "timeout"), "site_id")
    outcome = resolve_attempts(own, F.col("retries"), F.col("timeout")).select("site_id", "run_ts", "http_status", "error")
    outcome, _ = stage(outcome, "outcomes")
    pages = snapshots.drop("http_status", "error")
    small = F.broadcast(outcome) if outcome.count() <= BROADCAST_OUTCOMES else outcome
    fetched = pages.join(small, ["site_id", "run_ts"], "left")
    home = sites.select("site_id", F.col("url").alias("page_url"))
    lost = join_dimension(outcome.join(pages.select("site_id", "run_ts"), ["site_id", "run_ts"], "left_anti"), home, "site_id", "left")
    return fetched.unionByName(lost, allowMissingColumns=True)


def resolve_attempts(attempts: DataFrame, retries: int | Column = 2, timeout: int | Column = 20) -> DataFrame:
    """Outcome per site and run: the first final attempt, else the last error with the last status seen.

    ``attempts``: site_id, run_ts, attempt (from 0), http_status, failure. One aggregation, combined map-side.
    """
    retries = F.lit(retries) if isinstance(retries, int) else retries
    timeout = F.lit(timeout) if isinstance(timeout, int) else timeout
    status, failure, attempt = F.col("http_status"), F.col("failure"), F.col("attempt")
    final = ~is_retryable(status, failure)
    outcome = F.struct(status.alias("status"), attempt_error(status, failure, timeout).alias("error"))
    return (
        attempts.filter(attempt <= retries)
        .groupBy("site_id", "run_ts")
        .agg(
            F.min(F.when(final, attempt)).alias("final_attempt"),
            F.min_by(outcome, F.when(final, attempt)).alias("final"),
            F.max_by(outcome, attempt).alias("last"),
            F.max_by(status, F.when(status.isNotNull() & failure.isNull(), attempt)).alias("last_status"),
            F.max(attempt).alias("last_attempt"),
        )
        .select(
            "site_id",
            "run_ts",
            (F.coalesce("final_attempt", "last_attempt") + 1).alias("attempts"),
            F.when(F.col("final_attempt").isNotNull(), F.col("final.status")).otherwise(F.col("last_status")).alias("http_status"),
            F.when(F.col("final_attempt").isNotNull(), F.col("final.error"))
            .otherwise(F.coalesce("last.error", F.lit(UNKNOWN_ERROR)))
            .alias("error"),
        )
    )
