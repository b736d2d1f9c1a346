"""The log of what readers have read: marks are appended, merged when read, and compacted in buckets of readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import reader
from freshet.schemas import READS
from freshet.sources.commits import CommitLog, ConflictingWrite, Folder

#: Buckets of readers in which the compacted log lies.
BUCKETS = 16
#: Marks after which the log is compacted: reading merges as many at most.
COMPACT_AFTER = 12
#: Attempts at a commit while others commit too.
ATTEMPTS = 20

CLICKS, ALL = "clicks", "all"


class ReadLog:
    """A mark writes one small file and a commit that names it after those before; so marks of many writers all land, in the
    order of their commits. Reading applies them in that order, to the readers they are of, and keeps every reader's newest
    ``limit`` after each. Compaction writes that down, for the buckets of those readers."""

    def __init__(self, spark: SparkSession, path: str, limit: int = reader.READ_LIMIT, compact_after: int = COMPACT_AFTER):
        self.spark, self.path, self.limit, self.compact_after = spark, path.rstrip("/"), limit, compact_after
        self.commits = CommitLog(spark, f"{self.path}/commits")
        self.data = Folder(spark, f"{self.path}/data")

    def version(self) -> int | None:
        return self.commits.latest()

    def _record(self, version: int | None) -> dict:
        return {"buckets": {}, "marks": []} if version is None else self.commits.read(version)

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], READS)
        return self.spark.read.schema(READS).parquet(*(f"{self.data.path}/{f}" for f in folders))

    def load(self) -> DataFrame:
        return self._merged(self._record(self.version()))

    def _touched(self, record: dict) -> DataFrame:
        return self._read([folder for folder, _ in record["marks"]]).select("reader_id").distinct()

    def _merged(self, record: dict) -> DataFrame:
        log = self._read(list(record["buckets"].values()))
        if not record["marks"]:
            return log
        touched = self._touched(record)
        own = log.join(touched, "reader_id", "left_semi")
        for folder, kind in record["marks"]:
            marks = self._read([folder])
            own = reader.mark_read(own, marks) if kind == CLICKS else own.join(marks, ["reader_id", "url"], "left_anti").unionByName(marks)
            own = reader.keep_newest_reads(own, self.limit).select("reader_id", "url", "read_at")
        return log.join(touched, "reader_id", "left_anti").unionByName(own)

    def mark(self, clicks: DataFrame) -> DataFrame:
        """Clicked URLs are read from their first click on, unless they were read before."""
        return self._append(clicks.groupBy("reader_id", "url").agg(F.min("read_at").alias("read_at")), CLICKS)

    def mark_all(self, timeline: DataFrame, reader_id: Column, now: Column) -> DataFrame:
        """Everything on the timeline is read now."""
        return self._append(timeline.select(reader_id.alias("reader_id"), "url", now.alias("read_at")).distinct(), ALL)

    def _append(self, marks: DataFrame, kind: str) -> DataFrame:
        name = f"marks-{uuid.uuid4().hex}"
        marks.select("reader_id", "url", "read_at").coalesce(1).write.parquet(f"{self.data.path}/{name}")
        record = self._commit(lambda record: record | {"marks": [*record["marks"], [name, kind]]})
        if len(record["marks"]) >= self.compact_after:
            self.compact()
        return self.load()

    def _commit(self, change) -> dict:
        """Commit a change of the latest record; if another commit came first, of that one."""
        for _ in range(ATTEMPTS):
            version = self.version()
            record = change(self._record(version))
            try:
                self.commits.append(0 if version is None else version + 1, record)
                return record
            except ConflictingWrite:
                continue
        raise ConflictingWrite(f"{self.path}: {ATTEMPTS} commits came first")

    def compact(self) -> None:
        """Merge the marks so far into the buckets of their readers; marks that others add meanwhile stay marks."""
        record = self._record(self.version())
        if not record["marks"]:
            return
        bucket = F.pmod(F.xxhash64("reader_id"), F.lit(BUCKETS)).cast("int")
        buckets = sorted(r[0] for r in self._touched(record).select(bucket).distinct().collect())
        name = f"log-{uuid.uuid4().hex}"
        rows = self._merged(record).withColumn("bucket", bucket).filter(F.col("bucket").isin(buckets))
        rows.repartition("bucket", F.pmod(F.xxhash64("url"), F.lit(4))).write.partitionBy("bucket").parquet(f"{self.data.path}/{name}")
        written = {x.removeprefix("bucket="): f"{name}/{x}" for x in self.data.names(name) if x.startswith("bucket=")}
        done = len(record["marks"])

        def renew(latest: dict) -> dict:
            if latest["marks"][:done] != record["marks"]:
                raise ConflictingWrite(f"{self.path}: compacted by another meanwhile")
            stays = {b: f for b, f in latest["buckets"].items() if int(b) not in buckets}
            return {"buckets": stays | written, "marks": latest["marks"][done:]}

        self._commit(renew)
