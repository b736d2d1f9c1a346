"""The feed on disk, and the reader's read log."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators.report import Feed, feed_lines
from freshet.operators.topk import numbered
from freshet.schemas import READS
from freshet.sources import documents
from freshet.sources.commits import Folder

_SITE = (
    "id string, name string, url string, status string, error string, consecutive_errors int, last_checked string, "
    "last_update string, new_count int, link_count int, seeded_now boolean, items array<struct<title:string,url:string,first_seen:string>>"
)
_ENTRY = "site_id string, site_name string, title string, url string, first_seen string"
_TOTALS = "version int, generated_at string, site_count bigint, new_count bigint, error_count bigint"
_DOCUMENT = f"{_TOTALS}, sites array<struct<{_SITE}>>, timeline array<struct<{_ENTRY}>>"
_HEAD, _BETWEEN, _TAIL = r'^\{"version":.*"sites":\[$', '],"timeline":[', "]}"


_TABLES = ("sites", "timeline", "totals")
_POINTER = "current.json"


def write_feed(feed: Feed, path: str, generated_at: Column | None = None) -> None:
    """The feed as tables, however many sites it has, and with ``generated_at`` as a document too.

    All goes to a folder of its own; a pointer, replaced last, makes it the feed. Who reads meanwhile reads the one before.
    """
    spark = feed.sites.sparkSession
    name = f"feed-{uuid.uuid4().hex}"
    for table in _TABLES:
        getattr(feed, table).write.parquet(f"{path}/{name}/{table}")
    if generated_at is not None:
        write_feed_document(feed, f"{path}/{name}/document", generated_at)
    Folder(spark, path).write(_POINTER, json.dumps({"folder": name}), replace=True)


def feed_folder(spark: SparkSession, path: str) -> str:
    """Where the current feed's tables and its ``document`` are."""
    return f"{path}/{json.loads(Folder(spark, path).read(_POINTER))['folder']}"


def read_feed(spark: SparkSession, path: str) -> Feed:
    folder = feed_folder(spark, path)
    return Feed(*(spark.read.parquet(f"{folder}/{table}") for table in _TABLES))


def vacuum_feed(spark: SparkSession, path: str, older_than_hours: float = 24.0) -> list[str]:
    """Delete feeds but the current one that are older than a reader or a writer may take."""
    folder, current = Folder(spark, path), feed_folder(spark, path).rsplit("/", 1)[1]
    old = folder.names(older_than_ms=int((time.time() - 3600 * older_than_hours) * 1000))
    gone = [name for name in old if name.startswith("feed-") and name != current]
    for name in gone:
        folder.delete(name)
    return gone


def write_feed_document(feed: Feed, path: str, generated_at: Column, lines_per_part: int | None = None) -> None:
    """The feed as one JSON document, however many sites it has: the parts, in the order of their names, are its pieces."""
    documents.write_pieces(feed_lines(feed, generated_at), path, lines_per_part)


def _read_whole(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    document = spark.read.schema(_DOCUMENT).json(path, multiLine=True)
    sites = document.select(F.posexplode("sites").alias("result_ord", "s")).select(F.col("result_ord").cast("bigint").alias("result_ord"), "s.*")
    timeline = document.select(F.posexplode("timeline").alias("ord", "t")).select(F.col("ord").cast("bigint").alias("ord"), "t.*")
    return sites, timeline, document.select("site_count", "new_count", "error_count")


def _read_pieces(lines: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sites have an ``id``, entries of the timeline a ``site_id``; their places are those of their lines."""
    line = F.col("value")
    head = F.from_json(F.concat(line, F.lit("]}")), _TOTALS)
    totals = lines.filter(line.rlike(_HEAD)).select(head.alias("t")).select("t.site_count", "t.new_count", "t.error_count")
    inner = lines.filter(~line.rlike(_HEAD) & ~line.isin(_BETWEEN, _TAIL))
    text = documents.record(line)
    is_record = F.try_parse_json(text).isNotNull() & (F.get_json_object(text, "$.id").isNotNull() | F.get_json_object(text, "$.site_id").isNotNull())
    text = documents.valid(line, F.when(is_record, text), path)
    parsed = inner.select(*documents.ORDER, F.from_json(text, f"{_SITE}, site_id string, site_name string, title string, first_seen string").alias("r"))
    order = [F.col(c) for c in documents.ORDER]

    def section(key: str, fields: str, place: str) -> DataFrame:
        rows = numbered(parsed.filter(F.col(f"r.{key}").isNotNull()).select(*documents.ORDER, *[f"r.{f.split()[0]}" for f in fields.split(", ")]), order, place)
        return rows.withColumn(place, F.col(place) - 1).drop(*documents.ORDER)

    found, told = inner.filter(F.get_json_object(documents.record(line), "$.id").isNotNull()).count(), totals.first()["site_count"]
    if found != told:
        raise documents.DamagedDocument(f"{path}: {found} sites, its head tells of {told}")
    return section("id", _SITE, "result_ord"), section("site_id", _ENTRY, "ord"), totals


def read_feed_document(spark: SparkSession, path: str) -> Feed:
    """A JSON feed document as tables; a missing timeline is an empty one.

    A document of pieces, as ``write_feed_document`` leaves it, is parsed a line at a time; a broken line raises, as do missing
    pieces. Any other file is read whole.
    """
    lines = documents.read_pieces(spark, path)
    if lines is not None and documents.in_pieces(lines, _HEAD, [_BETWEEN, _TAIL], path):
        sites, timeline, totals = _read_pieces(lines, path)
    else:
        sites, timeline, totals = _read_whole(spark, path)

    def time(column: str) -> Column:
        return F.col(column).try_cast("timestamp")

    sites = sites.withColumnRenamed("id", "site_id").withColumns({c: time(c) for c in ("last_checked", "last_update")})
    sites = sites.withColumn(
        "items",
        F.transform("items", lambda i: F.struct(i["title"], i["url"], i["first_seen"].try_cast("timestamp").alias("first_seen"))),
    )
    timeline = timeline.withColumn("first_seen", time("first_seen")).withColumn("result_ord", F.lit(0))
    return Feed(sites, timeline, totals)


def items_of(feed: Feed) -> DataFrame:
    """The items of all site cards, flat: the ``recent`` form the reader operators take."""
    return feed.sites.select("site_id", F.posexplode("items").alias("ord", "item")).select("site_id", "ord", "item.*")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The table of reads; empty before the first."""
    try:
        return spark.read.schema(READS).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], READS)


def read_log_document(spark: SparkSession, path: str, reader_id: str) -> DataFrame:
    """A browser's read map (URL to epoch milliseconds) as reads; anything but an object is an empty log."""
    text = spark.read.text(path, wholetext=True).filter(F.try_parse_json("value").isNotNull())
    return text.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("url", "ms")).select(
        F.lit(reader_id).alias("reader_id"), "url", F.timestamp_millis("ms").alias("read_at")
    )
