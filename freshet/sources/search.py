"""A search index over items: posting lists of the three-character pieces of their shown titles.

An item that holds a query holds every piece of it. The index lies in buckets of pieces, sorted by piece, so that a search reads
the posting lists of its query's pieces alone; what has them all is looked at itself. Queries shorter than a piece are
looked for in the items' own table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from freshet.functions.text import display_title, matches_query, search_key
from freshet.sources.commits import Folder

PIECE = 3
#: Buckets of pieces; a search reads one for each of its query's pieces at most.
BUCKETS = 256
#: Shares of a piece's postings that are written by tasks of their own: a piece may stand in every title.
SHARES = 8


def pieces(text: Column) -> Column:
    """The distinct pieces of a lower-cased text, by character."""
    low = F.lower(text)
    each = F.transform(F.sequence(F.lit(1), F.char_length(low) - (PIECE - 1)), lambda i: F.substr(low, i, F.lit(PIECE)))
    return F.when(F.char_length(low) >= PIECE, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def _bucket(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")


def _site_bucket(site: Column | str) -> Column:
    return F.pmod(F.xxhash64(site), F.lit(BUCKETS)).cast("int")


class SearchIndex:
    """An index of items (site_id, ord, title, url) under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, items: DataFrame, extra: Column | None = None) -> SearchIndex:
        """Write items and posting lists. An item is searched by its shown title, or by that and ``extra`` after a blank."""
        shown = display_title(F.col("title"), F.col("url"))
        text = shown if extra is None else F.concat(shown, F.lit(" "), F.coalesce(extra, F.lit("")))
        table = items.withColumn("text", text).withColumn("site_bucket", _site_bucket("site_id"))
        table.repartition("site_bucket", F.pmod(F.xxhash64("url"), F.lit(SHARES))).sortWithinPartitions("site_bucket", "site_id", "ord").write.partitionBy("site_bucket").parquet(f"{self.path}/items")
        Folder(self.spark, self.path).write("items.json", table.schema.json(), replace=True)
        stored = self._items()
        postings = stored.select("site_id", "ord", F.explode(pieces(F.col("text"))).alias("piece")).withColumn("bucket", _bucket(F.col("piece")))
        share = F.pmod(F.xxhash64("site_id", "ord"), F.lit(SHARES))
        postings.repartition("bucket", share).sortWithinPartitions("bucket", "piece", "site_id", "ord").write.partitionBy("bucket").parquet(f"{self.path}/postings")
        return self

    def _items(self) -> DataFrame:
        schema = StructType.fromJson(json.loads(Folder(self.spark, self.path).read("items.json")))
        return self.spark.read.schema(schema).parquet(f"{self.path}/items")

    def _wanted(self, query: str) -> list[str]:
        low = self.spark.range(1).select(F.array_sort(pieces(F.lit(search_key(query)))).alias("p")).first()["p"]
        return list(low)

    def candidates(self, query: str) -> DataFrame | None:
        """(site_id, ord) of the items that hold every piece of the query; None if it has none."""
        wanted = self._wanted(query)
        if not wanted:
            return None
        buckets = [r[0] for r in self.spark.createDataFrame([(w,) for w in wanted], "p string").select(_bucket(F.col("p"))).distinct().collect()]
        there = {int(n.removeprefix("bucket=")) for n in Folder(self.spark, self.path).names("postings") if n.startswith("bucket=")}
        folders = [f"{self.path}/postings/bucket={b}" for b in sorted(set(buckets) & there)]
        if not folders:
            return self.spark.createDataFrame([], "site_id string, ord int")
        lists = self.spark.read.schema("site_id string, ord int, piece string").parquet(*folders).filter(F.col("piece").isin(wanted))
        return lists.groupBy("site_id", "ord").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("site_id", "ord")

    def search(self, query: str) -> DataFrame:
        """The items whose text holds the query, in any case; all of them for a blank one."""
        items = self._items()
        found = self.candidates(query)
        if found is not None:
            # Only the buckets of the candidates' sites are read: pruned at run time by their number.
            near = found.withColumn("site_bucket", _site_bucket("site_id"))
            items = items.join(near, ["site_bucket", "site_id", "ord"], "left_semi")
        return items.filter(matches_query(F.col("text"), query)).drop("site_bucket", "text")
