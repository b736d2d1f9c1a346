"""JSON documents of any size, written as ordered pieces: a head, a record a line, a tail (see ``report.in_document``).

Such a document is read a line at a time, in parallel. Nothing of it is skipped: a line that is no record, or a document
without its head or tail, raises.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What orders the lines of a document: its files by name, in a file its blocks, in a block its lines.
ORDER = ["_file", "_block", "_line"]


class DamagedDocument(ValueError):
    """A document of several pieces lacks some of them."""


def write_pieces(lines: DataFrame, path: str, lines_per_part: int | None = None) -> None:
    """Write sorted ``value`` lines; the files in the order of their names are the document."""
    writer = lines.write.mode("overwrite")
    if lines_per_part is not None:
        writer = writer.option("maxRecordsPerFile", lines_per_part)
    writer.text(path)


def read_pieces(spark: SparkSession, path: str) -> DataFrame | None:
    """``value`` and ``ORDER`` of every line that isn't blank; None where there is no document."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None
    placed = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return placed.withColumn("_line", F.monotonically_increasing_id()).filter(F.trim("value") != "")


def in_pieces(lines: DataFrame, head: str, tail: list[str], path: str) -> bool:
    """Whether a document is one of lines, by the patterns of its head and the lines after it; raises if it is one in part."""
    marks = [F.col("value").rlike(head), *[F.col("value") == line for line in tail]]
    found = lines.agg(*[F.count_if(mark) for mark in marks], *[F.min_by(mark, F.struct(*ORDER)) for mark in marks[:1]], F.max_by(marks[-1], F.struct(*ORDER))).first()
    counts, at_ends = list(found[: len(marks)]), list(found[len(marks) :])
    if counts == [1] * len(marks) and at_ends == [True, True]:
        return True
    # A document in one piece begins as one; a piece from within begins with a record, a comma or what closes a section.
    begins = lines.agg(F.min_by("value", F.struct(*ORDER))).first()[0] or ""
    if counts[0] == 0 and not begins.startswith((",", '"', "}", "]")) and lines.select("_file").distinct().count() <= 1:
        return False
    raise DamagedDocument(f"{path}: {counts[0]} heads, {counts[1:]} of the lines that close a section; these must be one each, at the ends")


def record(line: Column) -> Column:
    """A record's line without the comma that joins it to the one before."""
    return F.regexp_replace(line, "^,", "")


def valid(line: Column, parsed: Column, path: str) -> Column:
    """``parsed``, or an error that names the line where it is null."""
    return F.coalesce(parsed, F.raise_error(F.concat(F.lit(f"{path}: no record: "), F.substring(line, 1, 80))))
