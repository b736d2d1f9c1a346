"""Continuous change detection: snapshots arrive as files, each micro-batch moves the state on by one version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from freshet.operators.detect import advance, intake
from freshet.operators.extract import extract
from freshet.operators.maintain import prune
from freshet.schemas import SNAPSHOTS
from freshet.session import drop_staged, stage
from freshet.sources.state import StateStore


def stream_snapshots(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SNAPSHOTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


class MicroBatch:
    """Folds one batch into the store. The store records which batches of ``source`` it holds, so that a repeated
    batch changes nothing; a batch's outputs go to folders named by its id and are overwritten when it is repeated.
    """

    def __init__(self, store: StateStore, source: str, output: str, sites: DataFrame | None, **settings: object):
        self.store, self.source, self.output, self.sites, self.settings = store, source, output, sites, settings

    def _buckets(self, pages: DataFrame) -> list[int]:
        """The buckets of state that the batch reads and writes: those of its sites, and of sites to forget."""
        touched = pages.select("site_id")
        if self.sites is not None:
            touched = touched.unionByName(self.store.load().sites.select("site_id").join(self.sites, "site_id", "left_anti"))
        return self.store.buckets_of(touched)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.store.holds(self.source, batch_id):
            return
        # Page texts are read once; what is late is told from the pages' own rows.
        pages, folder = stage(extract(batch, self.sites, **self.settings), "batch")
        buckets = self._buckets(pages)
        state = self.store.load(buckets=buckets)
        fresh, late = intake(pages, state.sites)
        late.select("site_id", "run_ts", "page_url", "error").write.mode("overwrite").parquet(f"{self.output}/late/batch={batch_id}")
        outcome = advance(state, fresh)
        outcome.new_items.write.mode("overwrite").parquet(f"{self.output}/new_items/batch={batch_id}")
        outcome.results.write.mode("overwrite").parquet(f"{self.output}/results/batch={batch_id}")
        kept = outcome.state if self.sites is None else prune(outcome.state, self.sites)
        self.store.save(kept, self.source, batch_id, buckets)
        outcome.release()
        drop_staged(self.store.spark, folder)


def detect_continuously(
    snapshots: DataFrame, store: StateStore, output: str, checkpoint: str, sites: DataFrame | None = None, **settings: object
) -> StreamingQuery:
    """Work through all snapshots available, then stop; run it again, or on a schedule, for those to come."""
    return (
        snapshots.writeStream.foreachBatch(MicroBatch(store, checkpoint, output, sites, **settings))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def new_items_of(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(f"{output}/new_items").drop("batch")
