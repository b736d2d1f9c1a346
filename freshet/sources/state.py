"""State between runs: versioned Parquet tables, and the JSON form for exchange."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import schemas
from freshet.functions.text import blank_to_null
from freshet.operators.detect import State
from freshet.operators.report import in_document
from freshet.sources import documents
from freshet.sources.commits import CommitLog, Folder

# Fixed value.
STATE_VERSION = 1

_TABLES = {"known": schemas.KNOWN, "recent": schemas.RECENT, "sites": schemas.SITE_STATE}

#: Buckets of sites that a new store has.
BUCKETS = 64
#: Shares of a bucket's rows that are written by tasks of their own: a site with many known URLs is written by several.
SHARES = 8


class StateStore:
    """Versions of the state under one folder, in buckets of sites.

    A version is a commit that names each bucket's folder. A run writes the buckets of the sites it touched; the others stay
    where they are, named again. A commit is created only if nobody created that version before: of two runs that began
    on one version, one fails. What a failed run wrote is named by no commit, and ``vacuum`` deletes it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self._new_buckets = spark, path.rstrip("/"), buckets
        self.commits = CommitLog(spark, f"{self.path}/commits")
        self.data = Folder(spark, f"{self.path}/data")
        self._base: int | None = None

    def _record(self, version: int | None) -> dict:
        if version is None:
            return {"buckets": self._new_buckets, "sources": {}, "tables": {table: {} for table in _TABLES}}
        return self.commits.read(version)

    def version(self) -> int | None:
        """The latest committed version, None before the first."""
        return self.commits.latest()

    def holds(self, source: str, batch: int) -> bool:
        """Whether a batch of a source is already part of the state."""
        return self._record(self.version())["sources"].get(source, -1) >= batch

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64("site_id"), F.lit(n)).cast("int")

    def buckets_of(self, sites: DataFrame) -> list[int]:
        """The buckets that hold the given sites: at most as many numbers as there are buckets."""
        n = self._record(self.version())["buckets"]
        return sorted(r[0] for r in sites.select(self._bucket(n)).distinct().collect())

    def load(self, version: int | None = None, buckets: list[int] | None = None) -> State:
        """A version, the latest by default, or some buckets of it. What is saved next is built on it."""
        if version is None:
            version = self._base = self.version()
        tables = self._record(version)["tables"]
        return State(*(self._read(schema, [f for b, f in tables[table].items() if buckets is None or int(b) in buckets]) for table, schema in _TABLES.items()))

    def _read(self, schema: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.data.path}/{f}" for f in folders))

    def save(self, state: State, source: str | None = None, batch: int | None = None, buckets: list[int] | None = None) -> State:
        """Write and commit the version after the one loaded; returns it as read back. With ``buckets``, the state's rows of
        these replace those stored, and the other buckets stay."""
        base = self.version() if self._base is None else self._base
        record, version = self._record(base), 0 if base is None else base + 1
        name = f"{version:012d}-{uuid.uuid4().hex}"
        n = record["buckets"]
        for table in _TABLES:
            rows = getattr(state, table).withColumn("bucket", self._bucket(n))
            if buckets is not None:
                rows = rows.filter(F.col("bucket").isin(buckets))
            share = F.pmod(F.xxhash64("url" if table == "known" else "site_id"), F.lit(SHARES))
            rows.repartition("bucket", share).write.partitionBy("bucket").parquet(f"{self.data.path}/{name}/{table}")
            written = [x.removeprefix("bucket=") for x in self.data.names(f"{name}/{table}") if x.startswith("bucket=")]
            stays = {} if buckets is None else {b: f for b, f in record["tables"][table].items() if int(b) not in buckets}
            record["tables"][table] = stays | {b: f"{name}/{table}/bucket={b}" for b in written}
        if source is not None:
            record["sources"][source] = batch
        self.commits.append(version, record)
        self._base = version
        return self.load(version)

    def vacuum(self, keep: int = 2, older_than_hours: float = 24.0) -> list[str]:
        """Delete versions but the last ``keep``, and the folders that no kept one names. Folders younger than a run may take
        stay: a run that has not committed yet may have written them. Returns the folders deleted."""
        versions = sorted(self.commits.versions())
        for version in versions[:-keep]:
            self.commits.forget(version)
        named = {f.split("/")[0] for v in versions[-keep:] for table in self.commits.read(v)["tables"].values() for f in table.values()}
        before = int((time.time() - 3600 * older_than_hours) * 1000)
        gone = [name for name in self.data.names(older_than_ms=before) if name not in named]
        for name in gone:
            self.data.delete(name)
        return gone


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def state_rows(state: State) -> DataFrame:
    """One row per site with its known URLs and recent items nested, as the JSON form has them.

    Both are bounded per site: known URLs by the retention limit, recent items by ``max_items``.
    """
    known = state.known.groupBy("site_id").agg(
        F.map_from_entries(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col("first_seen"), F.col("seq"), F.col("url"), F.col("title")))),
                lambda k: F.struct(
                    k["url"], F.struct(k["title"].alias("title"), F.coalesce(_iso(k["first_seen"]), F.lit("")).alias("first_seen"))
                ),
            )
        ).alias("known")
    )
    recent = state.recent.groupBy("site_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ord", "title", "url", "first_seen"))),
            lambda r: F.struct(r["title"].alias("title"), r["url"].alias("url"), _iso(r["first_seen"]).alias("first_seen")),
        ).alias("recent")
    )
    times = ["first_checked", "last_checked", "last_update"]
    return (
        state.sites.join(known, "site_id", "left")
        .join(recent, "site_id", "left")
        .select(
            "site_id", "seeded", *[_iso(F.col(t)).alias(t) for t in times], "last_status", "last_error", "consecutive_errors",
            F.coalesce("known", F.create_map().cast("map<string,struct<title:string,first_seen:string>>")).alias("known"),
            F.coalesce("recent", F.array().cast("array<struct<title:string,url:string,first_seen:string>>")).alias("recent"),
        )
    )


def export_state(state: State, path: str) -> None:
    """JSON lines, one site per line in order of id."""
    state_rows(state).orderBy("site_id").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def state_lines(state: State, updated_at: Column) -> DataFrame:
    """The whole state as the lines of one JSON document, a line for each site in order of id (see ``in_document``)."""
    rows = state_rows(state)
    body = F.to_json(F.struct(*[c for c in rows.columns if c != "site_id"]), {"ignoreNullFields": "false"})
    # {"k":"id"} without its ends, and the key
    name = F.regexp_replace(F.to_json(F.struct(F.col("site_id").alias("k"))), r'^\{"k":|\}$', "")
    one = state.sites.sparkSession.range(1)
    head = F.concat(F.lit(f'{{"version":{STATE_VERSION},"updated_at":"'), _iso(updated_at), F.lit('","sites":{'))
    return in_document([(one, [], head), (rows, [F.col("site_id")], F.concat(name, F.lit(":"), body)), (one, [], F.lit("}}"))])


def write_state_document(state: State, path: str, updated_at: Column, lines_per_part: int | None = None) -> None:
    """The state as one JSON document: the parts, in the order of their names, are its pieces."""
    documents.write_pieces(state_lines(state, updated_at), path, lines_per_part)


def _timestamp(text: Column) -> Column:
    return F.date_trunc("second", text.try_cast("timestamp"))


def _decode_sites(sites: DataFrame) -> State:
    """State from (site_id, raw JSON object per site): absent fields get defaults, malformed entries are dropped."""
    fields = (
        "seeded boolean, first_checked string, last_checked string, last_update string, last_status string, "
        "last_error string, consecutive_errors string, known map<string,string>, recent array<string>"
    )
    decoded = sites.filter(F.col("raw").startswith("{")).select("site_id", F.from_json("raw", fields).alias("s")).select("site_id", "s.*")
    scalars = decoded.select(
        "site_id",
        F.coalesce("seeded", F.lit(False)).alias("seeded"),
        *[_timestamp(F.col(c)).alias(c) for c in ("first_checked", "last_checked", "last_update")],
        F.coalesce("last_status", F.lit("pending")).alias("last_status"),
        "last_error",
        F.coalesce(F.col("consecutive_errors").try_cast("int"), F.lit(0)).alias("consecutive_errors"),
    )
    entry = F.from_json("entry", "title string, first_seen string")
    known = (
        decoded.select("site_id", F.posexplode(F.map_entries("known")).alias("seq", "pair"))
        .select("site_id", "seq", F.col("pair.key").alias("url"), F.col("pair.value").alias("entry"))
        .filter(F.col("entry").startswith("{"))
        .withColumn("e", entry)
        .select(
            "site_id", "url", F.coalesce("e.title", F.lit("")).alias("title"),
            _timestamp(F.col("e.first_seen")).alias("first_seen"), F.col("seq").cast("bigint").alias("seq"),
        )
    )
    recent = (
        decoded.select("site_id", F.posexplode("recent").alias("ord", "entry"))
        .filter(F.col("entry").startswith("{"))
        .withColumn("e", F.from_json("entry", "title string, url string, first_seen string"))
        .select(
            "site_id", "ord", F.coalesce("e.title", F.lit("")).alias("title"), F.coalesce("e.url", F.lit("")).alias("url"),
            _timestamp(F.col("e.first_seen")).alias("first_seen"),
        )
    )
    return State(known, recent, scalars)


def import_state_lines(spark: SparkSession, path: str) -> State:
    """State from JSON lines (see ``export_state``); lines that are no JSON object are skipped."""
    lines = spark.read.text(path)
    named = lines.select(F.get_json_object("value", "$.site_id").alias("site_id"), F.col("value").alias("raw"))
    return _decode_sites(named.filter(blank_to_null(F.col("site_id")).isNotNull()))


_HEAD, _TAIL = r'^\{"version":\d+,"updated_at":.*,"sites":\{$', "}}"


def import_state_document(spark: SparkSession, path: str) -> State:
    """State from one JSON document.

    A document of pieces, as ``write_state_document`` leaves it, is parsed a site at a time; a broken line in it raises, as does a
    missing head or tail. Any other file is read whole: missing, broken or differently shaped, it gives the empty state.
    """
    lines = documents.read_pieces(spark, path)
    if lines is None:
        return State.empty(spark)
    if documents.in_pieces(lines, _HEAD, [_TAIL], path):
        line = F.col("value")
        inner = lines.filter(~line.rlike(_HEAD) & (line != _TAIL))
        entry = F.from_json(F.concat(F.lit("{"), documents.record(line), F.lit("}")), "map<string,string>")
        return _decode_sites(inner.select(F.explode(documents.valid(line, F.when(F.size(entry) > 0, entry), path)).alias("site_id", "raw")))
    text = spark.read.text(path, wholetext=True)
    sites = (
        text.filter(F.try_parse_json("value").isNotNull())
        .select(F.from_json("value", "sites map<string,string>").alias("doc"))
        .select(F.explode("doc.sites").alias("site_id", "raw"))
    )
    return _decode_sites(sites)
