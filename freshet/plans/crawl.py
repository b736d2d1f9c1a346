"""The jobs a user runs: check, inspect, reset, refill. They tie sources, operators and sinks together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators import maintain, report
from freshet.operators.attempts import with_outcomes
from freshet.operators.detect import Advance, State, advance, intake
from freshet.operators.extract import explode_links, extract, path_prefix_stats
from freshet.session import stage
from freshet.sources.feed import write_feed
from freshet.sources.state import StateStore


class NothingToCheck(ValueError):
    """No enabled site among those asked for."""


@dataclass(frozen=True)
class Check:
    """A finished run: what it found, the state it left, the feed over all configured sites, and what was put aside.

    ``late`` has the snapshots not later than their site's last check: they are not folded in, so that a run that is
    repeated changes nothing.
    """

    outcome: Advance
    state: State
    feed: report.Feed
    late: DataFrame
    sites: DataFrame

    def summary(self) -> DataFrame:
        """A row for each checked site, in the order of ``summary_ord``."""
        return report.in_summary_order(report.run_summary(self.outcome.results, self.sites))

    def titles(self) -> DataFrame:
        return report.summary_titles(self.outcome.new_items, self.outcome.results)

    def totals(self) -> DataFrame:
        return report.run_totals(self.outcome.results)


def run(state: State, sites: DataFrame, snapshots: DataFrame, only: DataFrame | None = None) -> tuple[Advance, DataFrame]:
    """All sites of a run in one job, a site's failure being a row like any other; and the late pages."""
    if only is not None:
        maintain.require_known(only, sites)
    pages, folder = stage(extract(snapshots, maintain.enabled_sites(sites, only)), "pages")
    fresh, late = intake(pages, state.sites)
    outcome = advance(state, fresh)
    outcome.staged.append(folder)
    return outcome, late.select("site_id", "run_ts", "page_url", "error")


def _touched(store: StateStore, sites: DataFrame, targets: DataFrame) -> list[int]:
    """The buckets of ``targets`` and of sites that are remembered but no longer configured."""
    forgotten = store.load().sites.select("site_id").join(sites, "site_id", "left_anti")
    return store.buckets_of(targets.select("site_id").unionByName(forgotten))


def check(
    store: StateStore,
    sites: DataFrame,
    snapshots: DataFrame,
    feed_path: str | None = None,
    only: DataFrame | None = None,
    dry_run: bool = False,
    attempts: DataFrame | None = None,
) -> Check:
    """One run over the stored state. Writes the next state version and the feed, unless ``dry_run``.

    A partial run (``only``) still gives a feed of all sites, with what is remembered of the others; it reads and writes the
    buckets of its sites alone. With ``attempts``, the fetches' outcomes are told from them (see ``with_outcomes``).
    """
    wanted = maintain.enabled_sites(sites, only)
    if wanted.isEmpty():
        raise NothingToCheck("no enabled site to check")
    buckets = None if only is None else _touched(store, sites, wanted)
    if attempts is not None:
        snapshots = with_outcomes(snapshots, attempts, sites)
    outcome, late = run(store.load(buckets=buckets), sites, snapshots, only)
    if not dry_run:
        # The feed is built on the written version.
        state = store.save(maintain.prune(outcome.state, sites), buckets=buckets)
    else:
        state = outcome.state if buckets is None else maintain.replace_sites(store.load(), outcome.state)
    feed = report.build_feed(outcome.results, sites, state)
    if feed_path is not None and not dry_run:
        write_feed(feed, feed_path, F.current_timestamp())
    return Check(outcome, state, feed, late, sites)


def _republish(store: StateStore, state: State, buckets: list[int] | None, sites: DataFrame, feed_path: str | None) -> report.Feed:
    state = store.save(state, buckets=buckets)
    nothing = sites.sparkSession.createDataFrame([], "site_id string, link_count int, new_count int, seeded_now boolean")
    feed = report.build_feed(nothing, sites, state)
    if feed_path is not None:
        write_feed(feed, feed_path, F.current_timestamp())
    return feed


def reset_history(
    store: StateStore, sites: DataFrame, feed_path: str | None = None, only: DataFrame | None = None
) -> tuple[int, report.Feed]:
    """Clear the histories of the named sites, or of all; returns how many had any."""
    if only is not None:
        maintain.require_known(only, sites)
    targets = maintain.target_sites(sites, only)
    buckets = None if only is None else store.buckets_of(targets)
    state = store.load(buckets=buckets)
    cleared = maintain.resettable(state, targets).count()
    return cleared, _republish(store, maintain.reset_history(state, targets), buckets, sites, feed_path)


def refill(
    store: StateStore, sites: DataFrame, feed_path: str | None = None, only: DataFrame | None = None
) -> tuple[int, report.Feed]:
    """Let the next run report all it finds on the named sites, or on all; returns how many sites that is."""
    if only is not None:
        maintain.require_known(only, sites)
    targets = maintain.target_sites(sites, only)
    buckets = None if only is None else store.buckets_of(targets)
    return targets.count(), _republish(store, maintain.refill(store.load(buckets=buckets), targets), buckets, sites, feed_path)


def inspect(snapshots: DataFrame, page_url: str | Column, selector: str | None = None, limit: int = 30) -> dict[str, DataFrame]:
    """What would be extracted from matching pages: ``count``, ``prefixes`` and the first ``links`` of each."""
    wanted = snapshots.filter(F.col("page_url") == page_url if isinstance(page_url, str) else page_url)
    pages = extract(wanted, **({"selector": selector} if selector else {}))
    links = explode_links(pages)
    by = ["site_id", "run_ts"]
    return {
        "count": pages.select(*by, "page_url", "link_count", "error"),
        "prefixes": path_prefix_stats(links, by),
        "links": report.inspect_links(pages, by, limit),
    }
