"""Per-group top-k that never brings a whole hot group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.session import stage

SALTS = 64


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int | Column, spread_by: list[str], rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group in ``order``, numbered from 1 in column ``rank``.

    A constant ``k`` is left to Spark, which cuts each partition to ``k`` rows per group before the shuffle. A ``k``
    that differs by row is not, so a first pass keeps the top ``k`` of each salted share of a group: the final
    pass then sees at most ``SALTS * k`` rows of it, and no row of the true top ``k`` is lost on the way.
    """
    if not isinstance(k, int):
        share = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)))
            .withColumn(rank, F.row_number().over(share))
            .filter(F.col(rank) <= k)
            .drop("_salt", rank)
        )
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number all rows from 1 in ``order``: sorted by ranges, each range numbered by itself, after the counts of the
    ranges before. Only those counts, one for each range, meet in one task."""
    ranges = df.sparkSession.sparkContext.defaultParallelism
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows, _ = stage(placed, "numbered")
    bits = 33  # of the row within its partition
    rows = rows.withColumn("_range", F.shiftright("_at", bits))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    return rows.join(counts, "_range").withColumn(name, place.cast("bigint")).drop("_range", "_at", "_before")
