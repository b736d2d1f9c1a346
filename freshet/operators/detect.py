"""Change detection: state of all sites + newly crawled pages -> next state and what is new.

One operator covers a single run, a backlog of several runs, and a replay of the whole history from an empty state.
A site's runs are folded in closed form: a URL is new at its first sighting, whatever happened in between, as long as
nothing can be evicted meanwhile. Only sites that outgrow their limit during a backlog need their runs in order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet import schemas
from freshet.functions.text import blank_to_null
from freshet.operators.extract import explode_links
from freshet.operators.overflow import fold_overflowing
from freshet.operators.topk import top_per_group
from freshet.session import drop_staged, join_dimension, stage


@dataclass(frozen=True)
class State:
    """What is remembered between runs."""

    known: DataFrame
    recent: DataFrame
    sites: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> State:
        return State(
            spark.createDataFrame([], schemas.KNOWN),
            spark.createDataFrame([], schemas.RECENT),
            spark.createDataFrame([], schemas.SITE_STATE),
        )


def states_of(sites: DataFrame, states: DataFrame) -> DataFrame:
    """The given sites with their states, the initial one where there is none."""
    initial = {"seeded": F.lit(False), "last_status": F.lit("pending"), "consecutive_errors": F.lit(0)}
    joined = sites.join(states, "site_id", "left")
    return joined.withColumns({name: F.coalesce(F.col(name), value) for name, value in initial.items()})


class Advance:
    """Outcome of ``advance``. Each table is planned when asked for, over the intermediates they share.

    ``known``, ``recent`` and ``sites`` make up the next ``state``; ``new_items`` is every new item of the batch and
    ``results`` each site's last run.
    """

    def __init__(self, prior: State, pages: DataFrame, runs: DataFrame, known: DataFrame, new_items: DataFrame):
        self.known, self.new_items = known, new_items
        self._prior, self._pages, self._runs = prior, pages, runs
        self.staged: list[str] = []

    @cached_property
    def recent(self) -> DataFrame:
        return _recent(self.new_items, self._prior.recent, self._runs)

    @cached_property
    def sites(self) -> DataFrame:
        return _next_sites(self._prior.sites, self._pages, self._runs, self.new_items)

    @cached_property
    def results(self) -> DataFrame:
        return _results(self._runs, self.new_items)

    @cached_property
    def state(self) -> State:
        return State(self.known, self.recent, self.sites)

    def release(self) -> None:
        """Delete the intermediates; call it once everything wanted is written."""
        for folder in self.staged:
            drop_staged(self.known.sparkSession, folder)


def _site_runs(pages: DataFrame) -> DataFrame:
    """One row per site: its runs in this batch, folded."""
    ok = F.col("error").isNull()
    return pages.groupBy("site_id").agg(
        F.min(F.when(ok, F.col("run_ts"))).alias("first_ok"),
        F.max(F.when(ok, F.col("run_ts"))).alias("last_ok"),
        F.max("run_ts").alias("last_run"),
        F.count_if(ok).alias("ok_runs"),
        F.max_by("error", "run_ts").alias("run_error"),
        F.max_by("link_count", "run_ts").alias("run_links"),
        F.max_by("max_items", "run_ts").alias("max_items"),
        F.max_by("known_limit", "run_ts").alias("known_limit"),
    )


def _trailing_errors(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Failures since each site's last success in the batch."""
    failures = pages.filter(F.col("error").isNotNull()).select("site_id", "run_ts")
    last = runs.select("site_id", "last_ok")
    return (
        join_dimension(failures, last, "site_id")
        .filter(F.col("last_ok").isNull() | (F.col("run_ts") > F.col("last_ok")))
        .groupBy("site_id")
        .agg(F.count("*").cast("int").alias("trailing_errors"))
    )


def first_sightings(links: DataFrame) -> DataFrame:
    """Per site and URL: first sighting, first titled sighting, last sighting. Combines map-side."""
    sighting = F.struct("run_ts", "pos", "title")
    return (
        links.groupBy("site_id", "url")
        .agg(
            F.min(sighting).alias("first"),
            F.min(F.when(F.col("title") != "", sighting)).alias("titled"),
            F.max("run_ts").alias("last_seen"),
        )
        .select("site_id", "url", "first", F.col("titled.title").alias("any_title"), "last_seen")
    )


def _merge(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Known URLs after the batch, before eviction; ``is_new`` marks those not known before."""
    old = known.select("site_id", "url", F.col("title").alias("old_title"), F.col("first_seen").alias("old_seen"), F.col("seq").alias("old_seq"))
    is_new = F.col("old_seq").isNull()
    return old.join(seen, ["site_id", "url"], "full_outer").select(
        "site_id",
        "url",
        F.coalesce(blank_to_null(F.col("old_title")), F.col("any_title"), F.lit("")).alias("title"),
        F.when(is_new, F.col("first.run_ts")).otherwise(F.col("old_seen")).alias("first_seen"),
        F.when(is_new, F.col("first.pos").cast("bigint")).otherwise(F.col("old_seq")).alias("seq"),
        is_new.alias("is_new"),
        F.coalesce(F.col("first.title"), F.lit("")).alias("first_title"),
        "last_seen",
    )


def evict(merged: DataFrame, over: DataFrame) -> DataFrame:
    """What the sites in ``over`` keep: without the oldest URLs that left the page, as many as exceed the limit.

    ``over``: site_id, excess (rows over the limit), last_ok. The cut-off is found on a histogram of first-seen
    times per site; single rows are only ranked within the one run the cut-off falls into.
    """
    over = join_dimension(merged, over.select("site_id", "excess", "last_ok"), "site_id")
    gone = over.filter(F.col("last_seen").isNull() | (F.col("last_seen") < F.col("last_ok")))
    by_time = Window.partitionBy("site_id").orderBy(F.col("first_seen").asc_nulls_first())
    cut = (
        gone.groupBy("site_id", "first_seen", "excess")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(by_time.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("quota", F.col("excess") - F.coalesce("before", F.lit(0)))
        .filter(F.col("quota") > 0)
        .select("site_id", F.col("first_seen").alias("cut_seen"), "n", "quota")
    )
    candidates = gone.select("site_id", "url", "first_seen", "seq").join(
        cut.withColumnRenamed("site_id", "cut_site"),
        (F.col("site_id") == F.col("cut_site")) & F.col("first_seen").eqNullSafe(F.col("cut_seen")),
    )
    split = Window.partitionBy("site_id", "first_seen").orderBy("seq", "url")
    evicted = (
        candidates.filter(F.col("n") <= F.col("quota"))
        .select("site_id", "url")
        .unionByName(
            candidates.filter(F.col("n") > F.col("quota"))
            .withColumn("rank", F.row_number().over(split))
            .filter(F.col("rank") <= F.col("quota"))
            .select("site_id", "url")
        )
    )
    return over.join(evicted, ["site_id", "url"], "left_anti")


def _recent(new_items: DataFrame, old: DataFrame, runs: DataFrame) -> DataFrame:
    """New items, latest run first and in page order, ahead of the old ones; cut to the site's ``max_items``."""
    limits = runs.select("site_id", "max_items")
    fresh = new_items.select(
        "site_id", "title", "url", "first_seen", F.lit(0).alias("age"), F.col("first_seen").alias("at"), F.col("pos").alias("place")
    )
    kept = old.select(
        "site_id", "title", "url", "first_seen", F.lit(1).alias("age"), F.lit(None).cast("timestamp").alias("at"), F.col("ord").alias("place")
    )
    ranked = top_per_group(
        join_dimension(fresh.unionByName(kept), limits, "site_id", "left"),
        ["site_id"],
        [F.col("age"), F.col("at").desc(), F.col("place")],
        F.coalesce("max_items", F.lit(2**31 - 1)),
        ["age", "at", "place"],
    )
    return ranked.select("site_id", (F.col("rank") - 1).alias("ord"), "title", "url", "first_seen")


def advance(state: State, pages: DataFrame) -> Advance:
    """Fold crawled pages (see ``extract``) into the state.

    ``pages`` may hold any number of runs per site, all later than the state's last check of that site.
    ``pages`` and an intermediate of one row per known URL are read repeatedly: both are staged in the shared folder.
    """
    if "known_limit" not in pages.columns:
        pages = pages.withColumn("known_limit", schemas.known_limit(F.col("max_items")))
    pages, folder = stage(pages, "pages")
    staged = [folder]
    seeded = state.sites.select("site_id", F.col("seeded").alias("was_seeded"))
    runs = _site_runs(pages).join(seeded, "site_id", "left").withColumn("was_seeded", F.coalesce("was_seeded", F.lit(False)))
    runs, folder = stage(runs, "runs")
    staged.append(folder)
    merged, folder = stage(_merge(state.known, first_sightings(explode_links(pages))), "known")
    staged.append(folder)

    # New: first sighting in this batch, unless that was the run that seeded the site.
    seeds = runs.select("site_id", "was_seeded", "first_ok")
    new_items = (
        join_dimension(merged.filter("is_new"), seeds, "site_id")
        .filter(F.col("was_seeded") | (F.col("first_seen") > F.col("first_ok")))
        .select("site_id", F.col("first_title").alias("title"), "url", "first_seen", F.col("seq").cast("int").alias("pos"))
    )
    known_columns = ["site_id", "url", "title", "first_seen", "seq"]
    known = merged.select(*known_columns)

    sizes = merged.groupBy("site_id").agg(F.count("*").alias("size"))
    over = (
        sizes.join(runs.filter(F.col("last_ok").isNotNull()), "site_id")
        .withColumn("excess", F.col("size") - F.col("known_limit"))
        .filter(F.col("excess") > 0)
        .select("site_id", "last_ok", "ok_runs", "known_limit", "was_seeded", "excess")
    )
    if not over.isEmpty():
        over, folder = stage(over, "over")
        staged.append(folder)
        ordered = over.filter(F.col("ok_runs") > 1)
        known = join_dimension(known, over.select("site_id"), "site_id", "left_anti").unionByName(
            evict(merged, over.filter(F.col("ok_runs") <= 1)).select(*known_columns)
        )
        if not ordered.isEmpty():
            folded = fold_overflowing(state.known, pages, ordered)
            staged += folded.staged
            known = known.unionByName(folded.known.select(*known_columns))
            closed_form = join_dimension(new_items, ordered.select("site_id"), "site_id", "left_anti")
            events = join_dimension(folded.events, seeds, "site_id").filter(F.col("was_seeded") | (F.col("first_seen") > F.col("first_ok")))
            new_items = closed_form.unionByName(events.withColumn("pos", F.col("seq").cast("int")).select(*new_items.columns))

    outcome = Advance(state, pages, runs, known, new_items)
    outcome.staged += staged
    return outcome


def _next_sites(prior: DataFrame, pages: DataFrame, runs: DataFrame, new_items: DataFrame) -> DataFrame:
    updates = new_items.groupBy("site_id").agg(F.max("first_seen").alias("updated"))
    joined = (
        prior.join(runs.drop("was_seeded"), "site_id", "full_outer")
        .join(_trailing_errors(pages, runs), "site_id", "left")
        .join(updates, "site_id", "left")
    )
    checked, ok = F.col("last_run").isNotNull(), F.col("last_ok").isNotNull()
    failures = F.coalesce("trailing_errors", F.lit(0))
    return joined.select(
        "site_id",
        (F.coalesce("seeded", F.lit(False)) | ok).alias("seeded"),
        F.coalesce("first_checked", "first_ok").alias("first_checked"),
        F.coalesce("last_run", "last_checked").alias("last_checked"),
        F.coalesce("updated", "last_update").alias("last_update"),
        F.when(~checked, F.col("last_status")).when(F.col("run_error").isNull(), "ok").otherwise("error").alias("last_status"),
        F.when(~checked, F.col("last_error")).otherwise(F.col("run_error")).alias("last_error"),
        F.when(~checked, F.col("consecutive_errors"))
        .when(ok, failures)
        .otherwise(F.coalesce("consecutive_errors", F.lit(0)) + failures)
        .cast("int")
        .alias("consecutive_errors"),
    )


def _results(runs: DataFrame, new_items: DataFrame) -> DataFrame:
    """Each site's last run: outcome, link count, what it found new, whether it seeded the site."""
    counts = new_items.groupBy("site_id", F.col("first_seen").alias("last_run")).agg(F.count("*").alias("new_count"))
    ok = F.col("run_error").isNull()
    return runs.join(counts, ["site_id", "last_run"], "left").select(
        "site_id",
        F.col("last_run").alias("run_ts"),
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.col("run_error").alias("error"),
        F.when(ok, F.col("run_links")).otherwise(0).cast("int").alias("link_count"),
        F.coalesce("new_count", F.lit(0)).cast("int").alias("new_count"),
        (ok & ~F.col("was_seeded") & (F.col("last_run") == F.col("first_ok"))).alias("seeded_now"),
    )


def replay(pages: DataFrame) -> Advance:
    """The state and the new items of a whole crawl history."""
    return advance(State.empty(pages.sparkSession), pages)


def split_late(pages: DataFrame, site_state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages after their site's last check, and those not after it, which can no longer be folded in."""
    marked = join_dimension(pages, site_state.select("site_id", "last_checked"), "site_id", "left")
    late = F.col("last_checked").isNotNull() & (F.col("run_ts") <= F.col("last_checked"))
    return marked.filter(~late).drop("last_checked"), marked.filter(late).drop("last_checked")


def intake(pages: DataFrame, site_state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The time rule of job and stream alike: what can be folded in, and what is put aside.

    Times are kept to the second, as the exchanged state has them. Of several pages of a site in one second the last counts, by
    its time before cutting, then by URL and outcome; the others are put aside, as are pages not after their site's last check.
    ``pages`` is a written table.
    """
    second = F.date_trunc("second", "run_ts")
    place = F.struct("run_ts", F.coalesce("page_url", F.lit("")).alias("page_url"), F.coalesce("error", F.lit("")).alias("error"), F.xxhash64("links").alias("links"))
    seconds = pages.groupBy("site_id", second.alias("second")).agg(F.count("*").alias("n"), F.max(place).alias("last"))
    # Few seconds of a site have more than one page: only their pages are told apart.
    repeated = seconds.filter("n > 1").select("site_id", "second", "last")
    marked = join_dimension(pages.withColumn("second", second), repeated, ["site_id", "second"], "left")
    beaten = F.col("last").isNotNull() & (place != F.col("last"))
    once = marked.withColumn("_beaten", beaten).drop("last")
    once = once.withColumn("run_ts", F.col("second")).drop("second")
    fresh, late = split_late(once.filter("NOT _beaten").drop("_beaten"), site_state)
    # Repeated rows of the last page are one page.
    fresh = fresh.dropDuplicates(["site_id", "run_ts"]) if not repeated.isEmpty() else fresh
    return fresh, late.unionByName(once.filter("_beaten").drop("_beaten"))
