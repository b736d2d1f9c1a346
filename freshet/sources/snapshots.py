"""Page snapshots as a table, from a crawler's Parquet output or from page files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.urls import netloc_of, split_url
from freshet.operators.attempts import charset_hint
from freshet.schemas import SNAPSHOTS


def read_snapshots(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """Crawler output in the ``SNAPSHOTS`` schema; ``since`` prunes runs at the scan."""
    snapshots = spark.read.schema(SNAPSHOTS).parquet(path)
    return snapshots if since is None else snapshots.filter(F.col("run_ts") > since)


def read_page_files(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """Pages kept as files, joined to their crawl ``index``.

    ``index``: file (its path below ``path``), site_id, run_ts, page_url and, optionally, content_type, http_status, error.
    """
    optional = {"content_type": "string", "http_status": "int", "error": "string"}
    index = index.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in index.columns})
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    name = F.substr(F.col("path"), F.lit(len(root) + 2))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(name.alias("file"), "content")
    return index.join(files, "file", "left").select(
        "site_id", "run_ts", "page_url", "content", F.lit(None).cast("string").alias("html"),
        charset_hint(F.col("content_type")).alias("charset_hint"), "http_status",
        F.coalesce("error", F.when(F.col("http_status") >= 400, F.concat(F.lit("HTTP "), F.col("http_status").cast("string")))).alias("error"),
    )


def succeeded(snapshots: DataFrame) -> DataFrame:
    return snapshots.filter(F.col("error").isNull())


def snapshots_of_pages(pages: DataFrame, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """A plain ``(page_id, url, html)`` table as a crawl history: one site per host, one run per page in id order."""
    return pages.select(
        F.lower(netloc_of(split_url(F.col("url")))).alias("site_id"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.col("page_id")).alias("run_ts"),
        F.col("url").alias("page_url"),
        "html",
    )
