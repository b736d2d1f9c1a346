"""What the corpus operators share: bounded Arrow batches, shared files, size-checked joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of whole texts in one Arrow batch: a thousand long texts still fit a Python worker.
BATCH_ROWS = 500
#: A table is broadcast only after its rows were counted and found to be at most this many.
BROADCAST_ROWS = 200_000

Batches = Iterator[pa.RecordBatch]


def map_texts(df: DataFrame, work: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches small enough for whole texts. The session's batch size is put back afterwards only
    by a caller that set it: the setting is read when the plan is executed."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(work, schema)


def gathered(batches: Batches, n_bytes: int) -> Batches:
    """Batches of at least ``n_bytes``, but for the last; empty ones are left out."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if held and sum(b.nbytes for b in held) >= n_bytes:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def once(df: DataFrame, **named: Column) -> DataFrame:
    """Add columns that are computed once, however often later expressions use them.

    Catalyst substitutes a projected expression into each of its uses; a generator over one row stops that.
    """
    packed = F.struct(*[value.alias(name) for name, value in named.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in named]
    return df.select(*kept, F.inline(F.array(packed)))


def row_key(df: DataFrame, name: str = "_row") -> DataFrame:
    """Number the rows. Stable only in a table that is then written: write it before the number is used twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def join_counted(left: DataFrame, small: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """Join ``small``, of ``rows`` counted rows of fixed width: broadcast up to ``BROADCAST_ROWS``, else by shuffle."""
    return left.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


#: Rows of a key from which on it counts as hot.
HOT_ROWS = 1024


def join_to_one(many: DataFrame, one: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has at most one row for each key; ``many`` is a written table.

    Keys that hold many rows are counted first. There can't be more of them than rows by the limit, so that their rows of
    ``one`` are of bounded number and are broadcast; the others meet by shuffle.
    """
    limit = max(HOT_ROWS, many.count() // BROADCAST_ROWS)
    hot = many.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).drop("_n")
    at_hot = one.join(F.broadcast(hot), on, "left_semi")
    others = many.join(F.broadcast(hot), on, "left_anti").join(one, on)
    return many.join(F.broadcast(at_hot), on).unionByName(others)


def count_rows(spark: SparkSession, folder: str) -> int:
    """Rows of a written table, from its footers."""
    return spark.read.parquet(folder).count()


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder and the path in it (local paths, file:, s3:, gs:, abfs:, hdfs:)."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def commit_file(files: pafs.FileSystem, temporary: str, final: str) -> None:
    """Give a finished file its final name. Repeated attempts write the same bytes, so the last one may win."""
    files.move(temporary, final)


def identity(key: str, text: str) -> list[Column]:
    """``id_a`` and ``id_b``: 128 bits that name a row by key and text; never null, equal for repeated rows."""
    return [F.xxhash64(key, text).alias("id_a"), F.xxhash64(text, F.lit(1), key).alias("id_b")]


def join_decisions(docs: DataFrame, decisions: DataFrame, how: str, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Join ``decisions`` (id_a, id_b and what was decided) to the rows of ``docs`` they were made on; other columns of
    ``docs`` may have any name."""
    left, right = (fresh(docs, name) for name in ("id_a", "id_b"))
    named = docs.withColumns(dict(zip((left, right), identity(f"`{key}`", f"`{text}`"), strict=True)))
    decisions = decisions.withColumnsRenamed({"id_a": left, "id_b": right})
    small = F.broadcast(decisions) if rows <= BROADCAST_ROWS else decisions.hint("shuffle_hash")
    return named.join(small, [left, right], how).drop(left, right)


def fresh(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name
