"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its share of the size raised to an exponent, normalised. The exponent is found by bisection: the
largest one at most 1 whose weights reach an entropy, or the smallest one at least 0 at which no source is repeated more
often than a limit. A source's weight times the budget is what it may spend. Its documents are dealt into blocks; each
epoch runs through the blocks in an order of its own, and the last epoch ends, within a block, where the budget is spent.

Only sums by source and by block meet in one task; documents are ordered within their block alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from freshet.llm.common import identity
from freshet.llm.token_store import with_token_counts
from freshet.session import stage

#: Size of a block, in the unit of the sizes (words or tokens), on the average.
BLOCK_SIZE = 250_000
STEPS = 60
SEED = "mix-1"


@dataclass(frozen=True)
class Target:
    """What the mixture must reach: a normalised entropy (1: all sources alike), or a limit on repetition (how many times
    a document may stand in the mixture) while every document is in it once."""

    entropy: float | None = None
    max_epochs: float | None = None


def weights(sizes: dict[str, int], exponent: float) -> dict[str, float]:
    """Shares raised to the exponent, normalised; in the order of the names, so that sums come out alike everywhere."""
    total = sum(sizes.values())
    raised = {k: (sizes[k] / total) ** exponent for k in sorted(sizes)}
    whole = sum(raised.values())
    return {k: v / whole for k, v in raised.items()}


def entropy(shares: dict[str, float]) -> float:
    if len(shares) < 2:
        return 1.0
    return -sum(p * math.log(p) for p in shares.values() if p > 0) / math.log(len(shares))


def epochs(sizes: dict[str, int], exponent: float) -> dict[str, float]:
    """How often each source is passed when the least repeated one is passed once."""
    total = sum(sizes.values())
    rates = {k: p * total / sizes[k] for k, p in weights(sizes, exponent).items()}
    least = min(rates.values())
    return {k: r / least for k, r in rates.items()}


def bisect_exponent(sizes: dict[str, int], target: Target) -> float:
    """The exponent in [0, 1] that meets the target; 1 (the shares as they are) if they meet it already, 0 if none does."""

    def met(exponent: float) -> bool:
        if target.entropy is not None:
            return entropy(weights(sizes, exponent)) >= target.entropy
        return max(epochs(sizes, exponent).values()) <= target.max_epochs

    # Entropy falls and repetition falls as the exponent grows: what is sought lies at either end of what meets it.
    low, high = 0.0, 1.0
    if target.entropy is not None:
        if met(high):
            return high
        for _ in range(STEPS):
            middle = (low + high) / 2
            low, high = (middle, high) if met(middle) else (low, middle)
        return low
    if met(low):
        return low
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if met(middle) else (middle, high)
    return high


def hashed(*parts: Column | str) -> Column:
    """60 bits of an MD5: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts])), 1, 15), 16, 10).cast("bigint")


def mix(
    docs: DataFrame, target: Target, budget: int | None = None, key: str = "doc_id", text: str = "text", source: str = "source",
    block_size: int = BLOCK_SIZE, seed: str = SEED, tokens: bool = False,
) -> DataFrame:
    """The mixture, a row for each time a document stands in it: key, source, size, its identity, epoch (from 0), block, block_place (the
    block's place in its epoch), place (a number that orders the block's documents), weight and exponent.

    A document's size is its words between blanks and line ends, at least 1, so that empty and null texts are spent too;
    with ``tokens``, the number of its ids in a token store, the end included.
    A null source is a source of its own, named "". Repeated rows are documents like any other; ties in order are broken
    by key and text hash. Without ``budget`` the mixture is as small as it can be with every document in it once. Empty
    tables give no rows. Other columns are ignored.
    """
    words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[ \\n]"), lambda w: w != ""))
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.greatest(words, F.lit(1)).cast("bigint").alias("size"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"),
        *identity(key, text), *[F.col(text).alias("text")] * tokens,
    )
    if tokens:
        rows = with_token_counts(rows.drop("size"), "text", "size")
    # Texts stay behind; what follows reads this narrow table several times.
    rows, _ = stage(rows, "mix-sizes")
    # One row for each source.
    sizes = {r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    plan = plan_sources(sizes, target, budget)
    spark = docs.sparkSession
    plan_table = spark.createDataFrame(
        [(s, sizes[s], max(1, round(sizes[s] / block_size)), *p) for s, p in plan.items()],
        "source string, total bigint, n_blocks bigint, exponent double, weight double, quota bigint",
    )
    rows = rows.join(F.broadcast(plan_table), "source")
    order = hashed(seed, "document", F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("digest"))
    rows = rows.withColumn("place", order).withColumn("block", F.col("place") % F.col("n_blocks"))
    blocks = rows.groupBy("source", "block", "total", "quota").agg(F.sum("size").alias("block_total"))
    # Whole epochs, and the part of one in which the budget ends.
    whole = F.floor(F.col("quota") / F.col("total"))
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), whole)))
    blocks = blocks.withColumn("block_place", hashed(seed, "block", F.col("source"), F.col("epoch").cast("string"), F.col("block").cast("string")))
    run = W.partitionBy("source", "epoch").orderBy("block_place", "block").rowsBetween(W.unboundedPreceding, -1)
    begun = F.coalesce(F.sum("block_total").over(run), F.lit(0))
    blocks = blocks.withColumn("budget", F.when(F.col("epoch") < whole, F.col("block_total")).otherwise(F.col("quota") - whole * F.col("total") - begun))
    blocks = blocks.filter("budget > 0").select("source", "block", "epoch", "block_place", "block_total", "budget")
    mixed = rows.join(blocks, ["source", "block"])
    # In the block that the budget ends in, documents are taken in order while the sum before them is under the budget.
    cut = mixed.filter("budget < block_total")
    spent = F.coalesce(F.sum("size").over(W.partitionBy("source", "block", "epoch").orderBy("place", "key", "digest").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = cut.withColumn("spent", spent).filter("spent < budget").drop("spent")
    return mixed.filter("budget >= block_total").unionByName(cut).select(
        F.col("key").alias(key), "source", "size", "id_a", "id_b", F.col("epoch").cast("bigint").alias("epoch"), "block", "block_place", "place", "weight", "exponent"
    )


def plan_sources(sizes: dict[str, int], target: Target, budget: int | None) -> dict[str, tuple[float, float, int]]:
    """Exponent, weight and quota of each source."""
    if not sizes:
        return {}
    exponent = bisect_exponent(sizes, target)
    shares = weights(sizes, exponent)
    if budget is None:
        # The source with the least share of its own size is passed once.
        return {s: (exponent, shares[s], max(sizes[s], round(sizes[s] * e))) for s, e in epochs(sizes, exponent).items()}
    return {s: (exponent, w, round(w * budget)) for s, w in shares.items()}


#: No document more than twice, each at least once.
PRODUCTION = Target(max_epochs=2.0)


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture over all documents. Weight and exponent are rounded to nine places."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), PRODUCTION)
    return mixed.drop("id_a", "id_b").withColumns({c: F.round(c, 9) for c in ("weight", "exponent")})


def oracle_sql() -> str:
    """The same mixture in SQL; the exponent by the same bisection, as a recursive query."""
    h = "CAST(('0x' || substr(md5(concat_ws('|', {})), 1, 15)) AS BIGINT)"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, greatest(1, len(list_filter(string_split(replace(coalesce(text, ''), chr(10), ' '), ' '), lambda x: x <> ''))) AS size,
    md5(coalesce(text, '')) AS digest FROM documents),
s AS MATERIALIZED (SELECT source, sum(size)::BIGINT AS total, sum(size) / (SELECT sum(size) FROM d)::DOUBLE AS share FROM d GROUP BY source),
b AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT step + 1, CASE WHEN met THEN low ELSE (low + high) / 2 END, CASE WHEN met THEN (low + high) / 2 ELSE high END
  FROM (SELECT step, low, high, (SELECT max(pow(share, (low + high) / 2) / share) / min(pow(share, (low + high) / 2) / share) FROM s) <= {PRODUCTION.max_epochs} AS met FROM b WHERE step < {STEPS})),
x AS (SELECT CASE WHEN (SELECT max(1 / share) / min(1 / share) FROM s) <= {PRODUCTION.max_epochs} THEN 0.0 ELSE high END AS exponent FROM b WHERE step = {STEPS}),
p AS (
  SELECT source, total, greatest(1, round_even(total / {BLOCK_SIZE}::DOUBLE, 0))::BIGINT AS n_blocks, exponent, pow(share, exponent) / (SELECT sum(pow(share, exponent)) FROM s, x) AS weight,
    greatest(total, round_even(total * ((pow(share, exponent) / share) / (SELECT min(pow(share, exponent) / share) FROM s, x)), 0))::BIGINT AS quota FROM s, x),
r AS (SELECT d.*, n_blocks, exponent, weight, total, quota, {h.format(f"'{SEED}', 'document', doc_id, digest")} AS place FROM d JOIN p USING (source)),
rb AS (SELECT *, place % n_blocks AS block FROM r),
bl AS (SELECT source, block, total, quota, sum(size)::BIGINT AS block_total, unnest(range(0, quota // total + 1)) AS epoch FROM rb GROUP BY source, block, total, quota),
bp AS (SELECT *, {h.format(f"'{SEED}', 'block', source, epoch, block")} AS block_place FROM bl),
bq AS (
  SELECT source, block, epoch, block_place, block_total, CASE WHEN epoch < quota // total THEN block_total ELSE quota - (quota // total) * total
    - coalesce(sum(block_total) OVER (PARTITION BY source, epoch ORDER BY block_place, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS budget FROM bp),
m AS (
  SELECT rb.*, epoch, block_place, block_total, budget,
    coalesce(sum(size) OVER (PARTITION BY source, rb.block, epoch ORDER BY place, doc_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
  FROM rb JOIN bq USING (source, block) WHERE budget > 0)
SELECT doc_id, source, size, epoch, block, block_place, place, round(weight, 9) AS weight, round(exponent, 9) AS exponent FROM m WHERE budget >= block_total OR spent < budget
"""
