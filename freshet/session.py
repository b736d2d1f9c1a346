"""Session settings the jobs are written for, and the helpers that depend on the session."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps
from typing import TypeVar

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession

T = TypeVar("T")

# Input for which a core's share is smaller than this is dealt to all cores before it is parsed.
SMALL_SHARE_BYTES = 16 * 1024 * 1024


def build_session(app: str = "freshet", **settings: str) -> SparkSession:
    """A session with the settings the jobs assume; keyword arguments use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # The jobs build large expressions; recording a Python call site for each node only slows planning.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Page rows are wide: bound an Arrow batch by bytes, not by the default 10,000 rows.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(32 * 1024 * 1024))
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def once_per_application(build: Callable[[], T]) -> Callable[[], T]:
    """Build a set of Columns once per Spark application: they are large, immutable and tied to its JVM."""
    built: dict[str, T] = {}

    @wraps(build)
    def get() -> T:
        application = SparkContext.getOrCreate().applicationId
        if application not in built:
            built.clear()
            built[application] = build()
        return built[application]

    return get


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate, from the plan alone: rough, so that only the plan may depend on it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_dimension(facts: DataFrame, dimension: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """Join a dimension. Whether it is broadcast is for Spark to say, by its own threshold and by sizes at run time;
    beyond it a sort-merge join under AQE's skew handling takes over."""
    return facts.join(dimension, on, how)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a small input to all cores; a large one has partitions enough and is left alone. Looks at the plan's size
    estimate only: nothing is executed while planning."""
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(df) >= parallelism * SMALL_SHARE_BYTES:
        return df
    return df.repartition(parallelism, *keys)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name in the shared place the cluster names; beside the warehouse, which is shared too, where it names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/freshet/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write an intermediate that is read several times, and continue from the written table.

    Cuts the lineage, outlives lost executors, lets each reader scan only its columns, and gives the optimizer the
    true size. Returns the table and its folder, for ``drop_staged``.
    """
    folder = scratch_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def drop_staged(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
