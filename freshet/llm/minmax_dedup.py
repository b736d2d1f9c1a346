"""Near-duplicates by min-max hashing.

Each permutation gives a text two values, the least and the greatest hash of its shingles, so that ``VALUES`` values cost
half as many hash evaluations; both estimate the same similarity without bias. Bands of ``ROWS`` values, each from
different permutations, make buckets: at similarity 0.8 a pair shares none of the ``BANDS`` buckets with a probability of
5e-9, and less above.

Texts with equal shingle sets are one node. Links are confirmed on full sets of 64-bit shingle hashes:

1. In every bucket the most central node (the one with the fewest shingles of its own) is compared with the others.
2. Buckets whose nodes are then of one component are done. A node is also done if too few of its shingles occur in any
   other candidate: it can't reach the similarity with anyone.
3. What is left of a bucket is compared whole, in blocks of nodes: each node outside the bucket's main component against
   all nodes of other components. No pair that shares a bucket and could still join components goes unchecked.

Groups are never gathered in a task: hubs and blocks split them, and nothing lists all pairs of a group of copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import Batches, identity, map_texts
from freshet.session import drop_staged, stage

BANDS, ROWS = 48, 5
VALUES = BANDS * ROWS
SHINGLE, PERCENT = 4, 80
#: Nodes in a block of an exact comparison.
BLOCK = 64
SKETCH = "key bigint, id_a bigint, id_b bigint, n bigint, node binary, buckets array<bigint>"
#: Bare ids are broadcast up to this many rows (16 bytes each), after counting.
BROADCAST_IDS = 1_000_000

_RANDOM = np.random.default_rng(20260101)
_FACTORS = _RANDOM.integers(0, 2**63, VALUES // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 2**63, VALUES // 2, dtype=np.uint64) * np.uint64(2)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles: A-Z in lower case, words between ASCII white space."""
    words = (text or "").encode(errors="surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    mixed = hashes[: len(words) - size + 1].copy()
    for k in range(1, size):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX + hashes[k : len(words) - size + 1 + k]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def min_max(found: np.ndarray) -> np.ndarray:
    """The least value under every permutation, then the greatest under every one."""
    least = np.full(VALUES // 2, np.iinfo(np.uint64).max, np.uint64)
    most = np.zeros(VALUES // 2, np.uint64)
    for begin in range(0, len(found), 4096):
        permuted = found[None, begin : begin + 4096] * _FACTORS[:, None] + _TERMS[:, None]
        np.minimum(least, permuted.min(axis=1), out=least)
        np.maximum(most, permuted.max(axis=1), out=most)
    return np.concatenate([least, most])


def buckets(values: np.ndarray) -> np.ndarray:
    """A key for each band. The values of a band come from different permutations."""
    mixed = np.arange(BANDS, dtype=np.uint64) * _MIX
    for column in values.reshape(BANDS, ROWS).T:
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX + column
    return ((mixed ^ (mixed >> np.uint64(32))) * _MIX).view(np.int64)


def node_of(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _sketch(size: int):
    def work(batches: Batches) -> Batches:
        for batch in batches:
            sets = [shingles(text, size) for text in batch.column(1).to_pylist()]
            rows = [(len(s), node_of(s), buckets(min_max(s))) if len(s) else (0, None, None) for s in sets]
            n, node, keys = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["key", "id_a", "id_b", "n", "node", "buckets"],
            )

    return work


def _full_sets(size: int):
    def work(batches: Batches) -> Batches:
        for batch in batches:
            wanted, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sets = [(node, s) for node, text in zip(wanted, texts, strict=True) if len(s := shingles(text, size)) and node_of(s) == node]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in sets], pa.binary()), pa.array([len(x[1]) for x in sets], pa.int64()), pa.array([x[1].view(np.int64) for x in sets], pa.list_(pa.int64()))],
                names=["node", "n", "shingles"],
            )

    return work


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _confirm(percent: int):
    def work(batches: Batches) -> Batches:
        for batch in batches:
            a, b, left, right = batch.columns
            mask = [similar(x.values.to_numpy(), y.values.to_numpy(), percent) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(mask, pa.bool_()))

    return work


def _compare_blocks(percent: int):
    def work(block: pd.DataFrame) -> pd.DataFrame:
        own, others = block[block["outside"]], block[~block["outside"]]
        links = [
            (x.node, y.node)
            for x in own.itertuples()
            for y in others.itertuples()
            if x.comp != y.comp and similar(np.asarray(x.shingles), np.asarray(y.shingles), percent)
        ]
        return pd.DataFrame(links, columns=["a", "b"])

    return work


def join_ids(left: DataFrame, ids: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    return left.join(F.broadcast(ids) if rows <= BROADCAST_IDS else ids.hint("shuffle_hash"), on, how)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node with an edge; comp is the least node reachable. Each round takes the least label
    among neighbours and then the label's own label, and is written; rounds grow with the logarithm of the longest path."""
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both, edge_folder = stage(both, "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp"))
    labels, folder = stage(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        step = step.join(up, "comp", "left").select("node", "old", F.least("comp", "further").alias("comp"))
        step, next_folder = stage(step, "labels")
        changed = not step.filter(F.col("old") != F.col("comp")).isEmpty()
        drop_staged(spark, folder)
        labels, folder = step.drop("old"), next_folder
        if not changed:
            drop_staged(spark, edge_folder)
            return labels


class NearDuplicates:
    """One deduplication: its parameters and written intermediates."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> None:
        self.spark, self.shingle, self.percent, self.folders = docs.sparkSession, shingle, percent, []
        self.docs = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        table, folder = stage(df, label)
        self.folders.append(folder)
        return table

    def release(self) -> None:
        while self.folders:
            drop_staged(self.spark, self.folders.pop())

    def confirm(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
        with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
        return map_texts(with_b.select("a", "b", "left", "right"), _confirm(self.percent), "a binary, b binary")

    def members(self, sketches: DataFrame) -> DataFrame:
        """(bucket, node) of the buckets with two nodes or more."""
        short = F.xxhash64("node")
        every = sketches.filter("n > 0").select("node", F.explode("buckets").alias("bucket"))
        shared = every.groupBy("bucket").agg(F.min(short).alias("x"), F.max(short).alias("y")).filter("x != y").select("bucket")
        shared = self.keep(shared, "buckets")
        return self.keep(join_ids(every, shared, ["bucket"], "left_semi", shared.count()).distinct(), "bucket-nodes")

    def full_sets(self, heads: DataFrame, members: DataFrame) -> DataFrame:
        """(node, n, shingles) of all nodes in shared buckets, from the texts again."""
        wanted = self.keep(heads.join(members.select("node").distinct(), "node").select("node", F.col("head").alias("key")), "wanted")
        # A null key can't be joined by equality; its texts are tried against every node without a key.
        keyed = join_ids(self.docs, wanted.filter("key is not null"), ["key"], "inner", wanted.count()).select("node", "text")
        bare = self.docs.filter("key is null").select("text").distinct()
        lone = map_texts(bare, _name_sets(self.shingle), "node binary, text string").join(wanted.filter("key is null").select("node"), "node")
        return self.keep(map_texts(keyed.union(lone), _full_sets(self.shingle), "node binary, n bigint, shingles array<bigint>").dropDuplicates(["node"]), "sets")

    def common(self, sets: DataFrame) -> DataFrame:
        """(node, n, shared): how many of its shingles another candidate has too."""
        each = sets.select("node", F.explode("shingles").alias("shingle"))
        twice = each.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
        shared = each.join(twice, "shingle").groupBy("node").agg(F.count("*").alias("shared"), F.sum("df").alias("weight"))
        out = sets.select("node", "n").join(shared, "node", "left")
        return self.keep(out.select("node", "n", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("weight", F.lit(0)).alias("weight")), "commonness")

    def stars(self, members: DataFrame, common: DataFrame) -> DataFrame:
        """(a, b): each bucket's most central node with each other node of a size that fits."""
        placed = members.join(common, "node")
        rank = F.struct((F.col("shared") / F.col("n")).alias("part"), (F.col("weight") / F.col("n")).alias("mean"), "node", "n")
        hubs = placed.groupBy("bucket").agg(F.max(rank).alias("hub"))
        pairs = placed.join(hubs, "bucket").filter(F.col("hub.node") != F.col("node"))
        fits = 100 * F.least("n", "hub.n") >= self.percent * F.greatest("n", "hub.n")
        return pairs.filter(fits).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()

    def rest(self, members: DataFrame, common: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame | None:
        """Links among nodes that share a bucket and are of different components still."""
        live = common.filter(100 * F.col("shared") >= self.percent * F.col("n")).select("node")
        placed = members.join(live, "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        per = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
        mixed = per.groupBy("bucket").agg(F.count("*").alias("comps"), F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("main")).filter("comps > 1")
        open_buckets = placed.join(mixed.select("bucket", "size", F.col("main.comp").alias("main")), "bucket")
        # Many bands hold the same nodes: of buckets with equal contents one is enough.
        content = open_buckets.groupBy("bucket").agg(F.sum(F.xxhash64("node") % (1 << 40)).alias("x"), F.sum(F.xxhash64(F.lit(7), "node") % (1 << 40)).alias("y"))
        one = content.groupBy("x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
        left = self.keep(open_buckets.join(one, "bucket"), "open-buckets")
        if left.isEmpty():
            return None
        outside = left.filter(F.col("comp") != F.col("main"))
        counts = outside.groupBy("bucket").agg(F.count("*").alias("n_outside"))
        own = F.ceil(F.col("n_outside") / BLOCK).cast("int")
        other = F.ceil(F.col("size") / BLOCK).cast("int")
        deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
        rows = left.join(counts, "bucket")
        first = rows.filter(F.col("comp") != F.col("main")).select(
            "bucket", "node", "comp", deal(own).alias("i"), F.explode(F.sequence(F.lit(0), other - 1)).alias("j"), F.lit(True).alias("outside")
        )
        second = rows.select("bucket", "node", "comp", F.explode(F.sequence(F.lit(0), own - 1)).alias("i"), deal(other).alias("j"), F.lit(False).alias("outside"))
        blocks = first.union(second).join(sets.select("node", "shingles"), "node")
        return blocks.groupBy("bucket", "i", "j").applyInPandas(_compare_blocks(self.percent), "a binary, b binary").distinct()

    def run(self) -> DataFrame:
        sketches = map_texts(self.docs.select("key", "text", *identity("key", "text")), _sketch(self.shingle), SKETCH)
        sketches = self.keep(sketches, "sketches")
        heads = self.keep(sketches.filter("n > 0").groupBy("node").agg(F.min("key").alias("head")), "heads")
        members = self.members(sketches)
        sets = self.full_sets(heads, members)
        common = self.common(sets)
        links = self.keep(self.confirm(self.stars(members, common), sets), "links")
        comps = components(links)
        more = self.rest(members, common, comps, sets)
        if more is not None:
            more = self.keep(more, "more-links")
            if not more.isEmpty():
                comps = components(links.union(more))
        named = heads.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = named.groupBy("comp").agg(F.min("head").alias("component_id"))
        named = named.join(least, "comp").select("node", "component_id", F.col("comp").alias("group"))
        out = sketches.select("key", "id_a", "id_b", "n", "node").join(named, "node", "left")
        component = F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component_id"))
        out = out.select("key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"), "id_a", "id_b", "group")
        result, _ = stage(out, "near-duplicates")
        self.release()
        return result


def _name_sets(size: int):
    def work(batches: Batches) -> Batches:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            nodes = [node_of(s) if len(s := shingles(t, size)) else None for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), batch.column(0)], names=["node", "text"])

    return work


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row for each document: ``key``, n_shingles, component_id (the least key reachable over links), kept, its identity
    and group (a name of the component; null without shingles).

    Null and empty texts have no shingles and link with nothing, not even each other. Rows with equal texts are linked,
    whatever their keys; repeated rows keep a row each. A null key is in a component but never names one that has other
    keys. An empty table gives no rows. Other columns are ignored.
    """
    return NearDuplicates(docs, key, text, shingle, percent).run().withColumnRenamed("key", key)


def near_duplicates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")


def superfluous(found: DataFrame) -> DataFrame:
    """The identities of rows to drop so that one row of each group stays: the one with the least key. Rows are told
    from the ones that stay by identity; a group of any size meets in no task."""
    named = F.col("component_id").isNotNull()
    row = F.struct((~named).alias("bare"), F.coalesce(F.col("key") != F.col("component_id"), named).alias("other"), "id_a", "id_b")
    grouped = found.filter("group is not null")
    best = grouped.groupBy("group").agg(F.min(row).alias("best")).select("best.id_a", "best.id_b")
    return grouped.select("id_a", "id_b").join(best, ["id_a", "id_b"], "left_anti").distinct()


def oracle_sql() -> str:
    """All pairs that share a shingle, and the components of the links."""
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS sh
    FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {SHINGLE - 2}))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= {PERCENT} * (na.n + nb.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
