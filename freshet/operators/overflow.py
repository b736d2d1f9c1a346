"""Backlogs of sites that outgrow their known-URL limit: their runs must be taken in order.

An evicted URL that reappears is new again, so eviction and detection depend on each other run by run. Known URLs form a
queue: new ones join at the end, and what exceeds the limit leaves from the front, but for what is on the page. What must
go in order is reduced first, in parallel: a run counts only by what came onto the page and what left it since the run
before (gaps and islands per URL).

A site's history is cut into spans of its own runs, and all spans of all sites are worked through at once, each from a
guess at the queue it begins with: the page's URLs by their first sightings. Then each span's beginning is compared with the
end of the one before, and those that were guessed wrong are worked through again from that end, round by round, until all
fit. A queue forgets what it began with as it turns over, so a few rounds do; what does not fit by then is finished in
order. A task holds one queue at a time: a limit plus one page. First sightings and titles are read off the events at the end.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.session import join_dimension, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A span has at least about so many runs, and a site at most so many spans.
RUNS_PER_SPAN = 64
SPANS = 256
#: Rounds in which spans are worked through at once; what does not fit then is finished in order.
ROUNDS = 8

_FLUSH_ROWS = 50_000
KNOWN, CAME, LEFT = 0, 1, 2
EVENT, EXIT, ENDS = 0, 1, 2
_OUT = "site_id string, span int, kind int, url string, title string, run_ts timestamp, seq bigint, begun string, ended string"


@dataclass(frozen=True)
class Folded:
    """Known URLs at the end, and every sighting that made a URL known (``events``; the first run's of a site included)."""

    known: DataFrame
    events: DataFrame
    staged: list[str]
    rounds: int


def _with_spans(pages: DataFrame, runs_per_span: int) -> DataFrame:
    """Cut each site's runs into spans of about equal numbers of runs: at quantiles, which combine map-side."""
    if SPANS < 2:
        return pages.withColumn("span", F.lit(0))
    shares = [F.lit(k / SPANS) for k in range(1, SPANS)]
    micros = F.unix_micros("run_ts")
    cuts = pages.groupBy("site_id").agg(F.percentile_approx(micros, F.array(*shares), F.lit(10_000)).alias("cuts"), F.count("*").alias("runs"))
    # Every 2^k-th quantile, so that spans are long enough.
    wanted = F.greatest(F.lit(1), F.least(F.lit(SPANS), F.floor(F.col("runs") / runs_per_span)))
    step = F.lit(SPANS) / F.pow(F.lit(2), F.floor(F.log2(wanted)))
    kept = F.array_distinct(F.filter("cuts", lambda _, i: (i + 1) % step == 0))
    cut = join_dimension(pages, cuts.select("site_id", kept.alias("cuts")), "site_id")
    return cut.withColumn("span", F.size(F.filter("cuts", lambda c: c < micros)).cast("int")).drop("cuts")


def _page_changes(pages: DataFrame) -> DataFrame:
    """Per run, the links that came onto the page or changed title, and the URLs that left it.

    The first run of a span lists its whole page, marked ``restart``.
    """
    in_order = Window.partitionBy("site_id", "span").orderBy("run_ts")
    sightings = (
        pages.withColumn("run", F.row_number().over(in_order))
        .withColumn("next_ts", F.lead("run_ts").over(in_order))
        .select("site_id", "span", "run", "run_ts", "next_ts", F.explode("links").alias("link"))
        .select("site_id", "span", "run", "run_ts", "next_ts", "link.*")
    )
    # Partitioned as above, plus the URL: no further shuffle.
    of_url = Window.partitionBy("site_id", "span", "url").orderBy("run")
    marked = sightings.withColumns(
        {
            "came": ~(F.lag("run").over(of_url).eqNullSafe(F.col("run") - 1) & (F.lag("title").over(of_url) == F.col("title"))),
            "leaves": F.col("next_ts").isNotNull() & ~F.lead("run").over(of_url).eqNullSafe(F.col("run") + 1),
        }
    )
    came = F.when(
        F.coalesce("came", F.lit(True)),
        F.struct(F.lit(CAME).alias("kind"), F.col("run_ts").alias("at"), F.col("title").alias("text"), F.col("pos").cast("bigint").alias("seq"), (F.col("run") == 1).alias("restart")),
    )
    left = F.when(
        F.col("leaves"),
        F.struct(F.lit(LEFT).alias("kind"), F.col("next_ts").alias("at"), F.lit("").alias("text"), F.lit(-1).cast("bigint").alias("seq"), F.lit(False).alias("restart")),
    )
    return marked.select("site_id", "span", "url", F.explode(F.array_compact(F.array(came, left))).alias("c")).select(
        "site_id", "span", "url", "c.kind", F.col("c.at").alias("run_ts"), F.col("c.text").alias("title"), "c.seq", "c.restart"
    )


def _digest(queue: list[str]) -> str:
    return hashlib.md5("\n".join(queue).encode()).hexdigest()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a span arrive together: the queue it begins with, in order, then the changes of its runs in order."""
    group = run = limit = None
    begun = ""
    known: dict[str, None] = {}  # in the order in which they joined
    on_page: set[str] = set()
    out: list[tuple] = []

    def end_run() -> None:
        excess = len(known) - limit
        if excess > 0:
            gone = []
            for url in known:
                if len(gone) == excess:
                    break
                if url not in on_page:
                    gone.append(url)
            for url in gone:
                del known[url]

    def end_span() -> None:
        if run is not None:
            end_run()
        queue = list(known)
        out.extend((*group, EXIT, url, None, None, place, None, None) for place, url in enumerate(queue))
        out.append((*group, ENDS, None, None, None, None, begun, _digest(queue)))
        known.clear()
        on_page.clear()

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 9
        types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.string(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in _OUT.split(", ")])
        out.clear()
        return batch

    for batch in batches:
        stamps = batch.column("run_ts").cast(pa.int64()).to_pylist()
        wanted = ("site_id", "span", "url", "kind", "title", "seq", "restart", "known_limit")
        for at, row in zip(stamps, zip(*(batch.column(c).to_pylist() for c in wanted))):
            site, span, url, kind, title, seq, restart, row_limit = row
            if (site, span) != group:
                if group is not None:
                    end_span()
                group, run, limit, begun = (site, span), None, row_limit, ""
            if kind == KNOWN:
                known[url] = None
                continue
            if at != run:
                if run is None:
                    begun = _digest(list(known))
                else:
                    end_run()
                run = at
                if restart:
                    on_page.clear()
            if kind == LEFT:
                on_page.discard(url)
                continue
            on_page.add(url)
            if url not in known:
                known[url] = None
                out.append((*group, EVENT, url, title, at, seq, None, None))
        if len(out) >= _FLUSH_ROWS:
            yield flush()
    if group is not None:
        end_span()
    yield flush()


def _work(changes: DataFrame, queues: DataFrame, limits: DataFrame) -> DataFrame:
    """Spans (site_id, span) worked through from their queues (site_id, span, place, url)."""
    none = F.lit(None)
    begin = queues.select(
        "site_id", "span", "url", F.lit(KNOWN).alias("kind"), none.cast("timestamp").alias("run_ts"), F.lit("").alias("title"), F.col("place").alias("seq"), F.lit(False).alias("restart")
    )
    return (
        join_dimension(changes.unionByName(begin), limits, "site_id")
        .repartition("site_id", "span")
        .sortWithinPartitions("site_id", "span", F.col("kind") != KNOWN, "run_ts", "seq")
        .mapInArrow(_fold, _OUT)
    )


def fold_overflowing(known: DataFrame, pages: DataFrame, sites: DataFrame, runs_per_span: int | None = None) -> Folded:
    """All ok runs of ``sites`` (site_id, known_limit) in order."""
    limits = sites.select("site_id", "known_limit")
    own = limits.select("site_id")
    ok_pages = pages.filter(F.col("error").isNull()).select("site_id", "run_ts", "links")
    staged: list[str] = []

    def kept(df: DataFrame, label: str) -> DataFrame:
        table, folder = stage(df, label)
        staged.append(folder)
        return table

    changes = kept(_page_changes(_with_spans(join_dimension(ok_pages, own, "site_id", "left_semi"), runs_per_span or RUNS_PER_SPAN)), "changes")
    prior = kept(join_dimension(known, own, "site_id", "left_semi").select("site_id", "url", "title", "first_seen", "seq"), "prior")
    order = Window.partitionBy("site_id").orderBy(F.col("first_seen").asc_nulls_first(), "seq", "url")
    # A site's known URLs are as many as its limit and a page.
    at_first = prior.withColumn("place", F.row_number().over(order).cast("bigint")).select("site_id", F.lit(0).alias("span"), "place", "url")

    # The guess: what is on a span's first page and was seen before, by first sightings.
    came = changes.filter(F.col("kind") == CAME)
    seen = came.groupBy("site_id", "url").agg(F.min(F.struct("run_ts", "seq")).alias("sighted"))
    old = prior.select("site_id", "url", F.struct(F.col("first_seen").alias("run_ts"), "seq").alias("stored"))
    guess = came.filter("restart AND span > 0").join(seen, ["site_id", "url"]).join(old, ["site_id", "url"], "left")
    guess = guess.withColumn("since", F.coalesce("stored", "sighted")).filter(F.col("stored").isNotNull() | (F.col("sighted.run_ts") < F.col("run_ts")))
    by_age = Window.partitionBy("site_id", "span").orderBy("since", "url")
    guess = guess.withColumn("place", F.row_number().over(by_age).cast("bigint")).select("site_id", "span", "place", "url")

    results = [kept(_work(changes, at_first.unionByName(guess), limits), "spans")]
    latest = results[0].filter(F.col("kind") == ENDS).select("site_id", "span", "begun", "ended", F.lit(0).alias("round"))
    one_before = Window.partitionBy("site_id").orderBy("span")
    while True:
        linked = latest.withColumns({"ended_before": F.lag("ended").over(one_before), "round_before": F.lag("round").over(one_before), "span_before": F.lag("span").over(one_before)})
        wrong = kept(linked.filter(F.col("ended_before") != F.col("begun")), "wrong")
        if wrong.isEmpty():
            break
        last = len(results) >= ROUNDS
        if last:
            # From a site's first span that does not fit on, its spans are one.
            first = wrong.groupBy("site_id").agg(F.min(F.struct("span", "span_before", "round_before")).alias("f")).select("site_id", "f.*")
            wrong = kept(first, "wrong")
            todo = changes.join(wrong.select("site_id", F.col("span").alias("from")), "site_id").filter(F.col("span") >= F.col("from")).withColumn("span", F.col("from")).drop("from")
        else:
            todo = changes.join(wrong.select("site_id", "span"), ["site_id", "span"], "left_semi")
        ends = wrong.select("site_id", "span", F.col("span_before").alias("span_at"), F.col("round_before").alias("round_at"))
        queues = _at(results, EXIT).join(ends, (F.col("site") == F.col("site_id")) & (F.col("at") == F.col("span_at")) & (F.col("round") == F.col("round_at")))
        queues = queues.select("site_id", "span", F.col("seq").alias("place"), "url")
        results.append(kept(_work(todo, queues, limits), "spans"))
        renewed = results[-1].filter(F.col("kind") == ENDS).select("site_id", "span", "begun", "ended", F.lit(len(results) - 1).alias("round"))
        stay = latest.join(wrong.select("site_id", F.col("span").alias("from")), "site_id", "left").filter(F.col("from").isNull() | (F.col("span") < F.col("from"))).drop("from") if last else latest.join(wrong.select("site_id", "span"), ["site_id", "span"], "left_anti")
        latest = kept(stay.unionByName(renewed), "latest")

    chosen = latest.select(F.col("site_id").alias("c_site"), F.col("span").alias("c_span"), F.col("round").alias("c_round"))
    match = (F.col("site") == F.col("c_site")) & (F.col("at") == F.col("c_span")) & (F.col("round") == F.col("c_round"))
    events = kept(_at(results, EVENT).join(chosen, match).select(F.col("site").alias("site_id"), "url", "title", F.col("run_ts").alias("first_seen"), "seq"), "events")
    final = latest.groupBy("site_id").agg(F.max(F.struct("span", "round")).alias("f")).select(F.col("site_id").alias("c_site"), F.col("f.span").alias("c_span"), F.col("f.round").alias("c_round"))
    stays = _at(results, EXIT).join(final, match).select(F.col("site").alias("site_id"), "url")

    # A URL has been known since its last event; one without any since before.
    since = events.groupBy("site_id", "url").agg(F.max(F.struct("first_seen", "seq", "title")).alias("e"))
    held = stays.join(since, ["site_id", "url"], "left").join(prior.withColumnsRenamed({"title": "p_title", "first_seen": "p_seen", "seq": "p_seq"}), ["site_id", "url"], "left")
    held = held.select(
        "site_id", "url", F.when(F.col("e").isNull(), F.col("p_title")).otherwise(F.col("e.title")).alias("title"),
        F.when(F.col("e").isNull(), F.col("p_seen")).otherwise(F.col("e.first_seen")).alias("first_seen"), F.when(F.col("e").isNull(), F.col("p_seq")).otherwise(F.col("e.seq")).alias("seq"),
        F.col("e.first_seen").alias("_from"),
    )
    titles = came.filter("title <> ''").select("site_id", "url", "run_ts", F.col("title").alias("later"))
    titled = held.filter("title = ''").join(titles, ["site_id", "url"]).filter(F.col("_from").isNull() | (F.col("run_ts") >= F.col("_from")))
    titled = titled.groupBy("site_id", "url").agg(F.min_by("later", "run_ts").alias("later"))
    held = held.join(titled, ["site_id", "url"], "left").withColumn("title", F.coalesce("later", "title")).select("site_id", "url", "title", "first_seen", "seq")
    return Folded(kept(held, "folded"), events, staged, len(results))


def _at(results: list[DataFrame], kind: int) -> DataFrame:
    """Rows of a kind from all rounds, with their round."""
    every = None
    for number, result in enumerate(results):
        rows = result.filter(F.col("kind") == kind).select(F.col("site_id").alias("site"), F.col("span").alias("at"), "url", "title", "run_ts", "seq", F.lit(number).alias("round"))
        every = rows if every is None else every.unionByName(rows)
    return every
