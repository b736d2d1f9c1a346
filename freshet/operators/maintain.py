"""State maintenance: prune, reset, refill, replace. Each takes the targets as a table of ``site_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.detect import State


# Fixed value: the message for ids no site has.
UNKNOWN_SITE = "存在しないサイトIDです: "
#: Ids in an error's text; its rows have all.
SHOWN = 10


class UnknownSite(ValueError):
    """Site ids that no configured site has; ``rows`` has all of them, the message the first."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.orderBy("site_id")
        super().__init__(UNKNOWN_SITE + ", ".join(r["site_id"] for r in self.rows.take(SHOWN)))


def _ids(df: DataFrame) -> DataFrame:
    return df.select("site_id").distinct()


def unknown_ids(wanted: DataFrame, sites: DataFrame) -> DataFrame:
    return _ids(wanted).join(sites, "site_id", "left_anti")


def require_known(wanted: DataFrame, sites: DataFrame) -> None:
    """Raise for ids without a site."""
    unknown = unknown_ids(wanted, sites)
    if not unknown.isEmpty():
        raise UnknownSite(unknown)


def enabled_sites(sites: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Sites to crawl: the enabled ones, or those of them that are named. A disabled site stays out even if named."""
    enabled = sites.filter("enabled")
    return enabled if only is None else enabled.join(_ids(only), "site_id", "left_semi")


def target_sites(sites: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Sites to maintain: all configured ones, disabled included, or the named ones."""
    return _ids(sites if only is None else only)


def prune(state: State, sites: DataFrame) -> State:
    """Forget sites that are no longer configured."""
    keep = _ids(sites)
    return State(*(table.join(keep, "site_id", "left_semi") for table in (state.known, state.recent, state.sites)))


def resettable(state: State, targets: DataFrame) -> DataFrame:
    """Targets a reset changes: those with a history or a last update."""
    dated = state.sites.filter(F.col("last_update").isNotNull()).select("site_id")
    return _ids(targets).join(dated.unionByName(_ids(state.recent)).distinct(), "site_id", "left_semi")


def reset_history(state: State, targets: DataFrame) -> State:
    """Clear the recent items and the last update; known URLs stay, so nothing is reported again."""
    targets = _ids(targets)
    marked = state.sites.join(targets.withColumn("_reset", F.lit(True)), "site_id", "left")
    sites = marked.withColumn("last_update", F.when(F.col("_reset").isNull(), F.col("last_update"))).drop("_reset")
    return State(state.known, state.recent.join(targets, "site_id", "left_anti"), sites)


def refill(state: State, targets: DataFrame) -> State:
    """Forget known URLs and history and mark as seeded, so that the next run reports all it finds."""
    targets = _ids(targets)
    marked = state.sites.join(targets.withColumn("_refill", F.lit(True)), "site_id", "full_outer")
    hit = F.col("_refill").isNotNull()
    sites = marked.select(
        "site_id",
        F.when(hit, True).otherwise(F.col("seeded")).alias("seeded"),
        "first_checked",
        "last_checked",
        F.when(~hit, F.col("last_update")).alias("last_update"),
        F.coalesce("last_status", F.lit("pending")).alias("last_status"),
        "last_error",
        F.coalesce("consecutive_errors", F.lit(0)).alias("consecutive_errors"),
    )
    return State(
        state.known.join(targets, "site_id", "left_anti"), state.recent.join(targets, "site_id", "left_anti"), sites
    )


def replace_sites(state: State, update: State) -> State:
    """Take over ``update`` for every site it has a state of."""
    updated = _ids(update.sites)

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(updated, "site_id", "left_anti").unionByName(new)

    return State(merge(state.known, update.known), merge(state.recent, update.recent), merge(state.sites, update.sites))
