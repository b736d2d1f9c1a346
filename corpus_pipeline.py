"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, token ids.

Each stage takes all that the one before kept; all but the last return the columns of ``documents``. A stage decides on
narrow tables and joins its decisions back to the texts by the rows' identity (key and text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import decontaminate, line_frequency, minmax_dedup, mixing
from freshet.llm.common import fresh, join_decisions
from freshet.llm.token_store import store_tokens
from freshet.session import stage

#: Words in a shingle of the near-duplicate stage; the query op5 takes four by contract.
SHINGLE = 5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; from the others boilerplate lines are removed, and ``n_chars`` follows."""
    judged = line_frequency.judge(docs, max_texts=line_frequency.SHARE_FLOOR, max_percent=line_frequency.SHARE_PERCENT)
    touched = judged.filter(~F.col("kept") | (F.col("n_removed") > 0)).select("id_a", "id_b", "kept", "removed")
    # Repeated rows have one verdict, by equal hashes of lines.
    touched, _ = stage(touched.groupBy("id_a", "id_b").agg(F.min("kept").alias("kept"), F.flatten(F.collect_set("removed")).alias("removed")), "verdicts")
    rows, lines = touched.agg(F.count("*"), F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()
    verdict = fresh(docs, "verdict")
    joined = join_decisions(docs, touched.select("id_a", "id_b", F.struct("kept", "removed").alias(verdict)), "left", rows + lines // 4)
    joined = joined.filter(F.col(verdict).isNull() | F.col(verdict)["kept"])
    removed = F.col(verdict)["removed"]
    trimmed = removed.isNotNull() & (F.size(removed) > 0)
    text = line_frequency.without_lines(F.col("text"), removed)
    new = {"text": text, "n_chars": F.when(trimmed, F.char_length(text).cast("bigint")).otherwise(F.col("n_chars"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; documents without words are in none."""
    found = minmax_dedup.near_duplicates(docs, shingle=SHINGLE)
    gone, _ = stage(minmax_dedup.superfluous(found.withColumnRenamed("doc_id", "key")), "superfluous")
    left = join_decisions(docs, gone, "left_anti", gone.count())
    rows = found.filter("group is not null").select("id_a", "id_b")
    if rows.count() > rows.distinct().count():
        left = left.dropDuplicates(["doc_id", "text"])
    return left


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone, _ = stage(found.filter("n_hit > 0").select("id_a", "id_b").distinct(), "contaminated")
    return join_decisions(docs, gone, "left_anti", gone.count())


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture has it, sources weighed by tokens: at least once."""
    mixed = mixing.mix(docs, mixing.PRODUCTION, tokens=True)
    n, copy = fresh(docs, "copies"), fresh(docs, "copy")
    copies, _ = stage(mixed.groupBy("id_a", "id_b").agg(F.count("*").alias(n), F.countDistinct("epoch").alias("n_epochs")), "copies")
    rows, repeated = copies.agg(F.count("*"), F.coalesce(F.max(F.col(n) > F.col("n_epochs")), F.lit(False))).first()
    # Repeated rows were counted together: their copies go out from one of them.
    single = docs.dropDuplicates(["doc_id", "text"]) if repeated else docs
    joined = join_decisions(single, copies.drop("n_epochs"), "inner", rows)
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n))).alias(copy)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], each).drop(copy)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, in key order, with where each begins."""
    return store_tokens(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token ids", token_ids),
]

#: Tokenizing has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs, _ = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
