"""Shards by a hierarchical weighted hash tree: a row descends region, rack and shard levels.

At each node a row draws a number for every child, an exponential variate of the hash of key and child at the child's
weight, and goes to the child of the least draw. A child's draw depends on nothing but key, child and weight. So a row
leaves a child only when a weight changes: movement stays within the subtrees whose weights change, and a child that
grows takes rows without any passing between its siblings. A new shard opens a region of its own, of one rack: one more
shard takes rows only into itself.

All is Columns: the tree is a literal, a level one expression, and nothing is shuffled to place a row. Slots number the
rows of a shard by ranges of the key, so that no shard is ever one task's work.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import fresh, once
from freshet.operators.topk import numbered

SEED = "tree-1"
ROOT = ""
#: Bits of a draw: they fit a double exactly.
DRAW_BITS = 52
LEVELS = ("region", "rack", "shard")


@dataclass(frozen=True)
class Leaf:
    """A shard, where it stands, and its weight."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    """Shards in racks in regions. It is configuration, not data: a few thousand leaves at most."""

    leaves: tuple[Leaf, ...]

    @staticmethod
    def even(regions: int, racks: int, shards: int) -> Tree:
        """So many regions, racks in each and shards in each rack, numbered in this order, of equal weights."""
        per_region = racks * shards
        return Tree(tuple(Leaf(s, f"r{s // per_region}", f"k{s % per_region // shards}") for s in range(regions * per_region)))

    def with_shard(self, weight: float = 1.0) -> Tree:
        """One more shard, in a rack and a region of its own."""
        shard = 1 + max((leaf.shard for leaf in self.leaves), default=-1)
        taken = {leaf.region for leaf in self.leaves}
        region = next(name for name in (f"r{n}" for n in range(len(taken) + 1)) if name not in taken)
        return Tree((*self.leaves, Leaf(shard, region, "k0", weight)))

    def reweighted(self, shard: int, weight: float) -> Tree:
        return Tree(tuple(Leaf(x.shard, x.region, x.rack, weight) if x.shard == shard else x for x in self.leaves))

    def children(self) -> dict[str, dict[str, float]]:
        """Each inner node's children and their weights, by paths (``region``, ``region/rack``, ``region/rack/shard``);
        what has no weight is left out."""
        if len({leaf.shard for leaf in self.leaves}) < len(self.leaves):
            raise ValueError("a shard stands twice in the tree")
        found: dict[str, dict[str, float]] = {ROOT: {}}
        for leaf in self.leaves:
            if leaf.weight < 0 or "/" in leaf.region + leaf.rack:
                raise ValueError(f"bad leaf: {leaf}")
            if leaf.weight > 0:
                parent = ROOT
                for path in (leaf.region, f"{leaf.region}/{leaf.rack}", f"{leaf.region}/{leaf.rack}/{leaf.shard}"):
                    among = found.setdefault(parent, {})
                    among[path] = among.get(path, 0.0) + leaf.weight
                    parent = path
        if not found[ROOT]:
            raise ValueError("no shard has a weight")
        return found


def _draw(key: Column, child: Column, weight: Column, seed: str) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), child, key)), 1, DRAW_BITS // 4), 16, 10).cast("double")
    return -F.log((bits + 1) / float(1 << DRAW_BITS)) / weight


def _chosen(key: Column, children: Column, seed: str) -> Column:
    """The child of the least draw; of equal draws the one of the least name."""
    drawn = F.transform(children, lambda c: F.struct(_draw(key, c["name"], c["weight"], seed).alias("draw"), c["name"].alias("name")))
    return F.array_min(drawn)["name"]


def descend(rows: DataFrame, tree: Tree, key: Column, name: str, seed: str = SEED) -> DataFrame:
    """Add a struct of ``region``, ``rack`` (paths) and ``shard``. The key's text decides, with the tree; a null key counts
    as empty text. Equal keys go to equal shards. Other columns stay as they are."""
    below = tree.children()
    literal = F.create_map(
        *[x for parent, found in below.items() for x in (F.lit(parent), F.array(*[F.struct(F.lit(c).alias("name"), F.lit(float(w)).alias("weight")) for c, w in found.items()]))]
    )
    names = [fresh(rows, f"{name}_{level}") for level in ("key", *LEVELS)]
    placed, at = once(rows, **{names[0]: F.coalesce(key.cast("string"), F.lit(""))}), F.lit(ROOT)
    for level in names[1:]:
        # A level is computed once: the next one uses it several times.
        placed = once(placed, **{level: _chosen(F.col(f"`{names[0]}`"), F.element_at(literal, at), seed)})
        at = F.col(f"`{level}`")
    region, rack, shard = (F.col(f"`{level}`") for level in names[1:])
    packed = F.struct(region.alias("region"), rack.alias("rack"), F.substring_index(shard, "/", -1).cast("int").alias("shard"))
    return placed.withColumn(name, packed).drop(*names)


def with_slots(rows: DataFrame, shard: str, order: Iterable[str], slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 in ``order`` (nulls first). Rows are sorted by ranges over all shards; a row per
    shard is joined back."""
    every = fresh(rows, "_every")
    counted = numbered(rows, [F.col(shard).asc(), *[F.col(c).asc_nulls_first() for c in order]], every)
    # One row for each shard of the tree.
    starts = counted.groupBy(F.col(shard).alias("_shard")).agg(F.min(every).alias("_start"))
    joined = counted.join(F.broadcast(starts), F.col(shard) == F.col("_shard"))
    return joined.withColumn(slot, F.col(every) - F.col("_start")).drop("_shard", "_start", every)


def shard_documents(docs: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """A row for each document: the key, ``size`` (UTF-8 bytes of the text and 1), ``text_crc32``, ``region``, ``rack``, ``shard``,
    ``slot`` (from 0 without gaps within the shard, by key, nulls first), ``grown_shard`` (with one more shard).

    A null text has size 1 and the checksum of the empty one; a null key goes where an empty text as key goes; repeated
    rows each have a slot; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = descend(descend(rows, tree, F.col("key"), "now", seed), tree.with_shard(), F.col("key"), "grown", seed)
    rows = rows.select("key", "size", "text_crc32", "now.region", "now.rack", "now.shard", F.col("grown.shard").alias("grown_shard"))
    return with_slots(rows, "shard", ["key", "text_crc32", "size"]).withColumnRenamed("key", key)


#: Shards 0 to 15: two regions of two racks of four.
PRODUCTION = Tree.even(2, 2, 4)


def shards_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), PRODUCTION)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: CRC-32 of bytes in SQL: the table of its polynomial, then a byte at a time.
CRC_TABLE = """bits AS (SELECT i::BIGINT AS n, i::BIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY n) AS crcs FROM bits WHERE k = 8)"""


def crc32_sql(text: str) -> str:
    """An expression for a table joined with ``crc_table``."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda a, x: xor(a >> 8, crcs[(xor(a, x) & 255) + 1])), 4294967295)"


def oracle_sql() -> str:
    """The same descent in SQL, a level a join."""
    trees = {"now": PRODUCTION, "grown": PRODUCTION.with_shard()}
    nodes = ", ".join(f"('{t}', '{parent}', '{c}', {w}::DOUBLE)" for t, tree in trees.items() for parent, found in tree.children().items() for c, w in found.items())
    draw = f"-ln((('0x' || substr(md5(concat_ws('|', '{SEED}', name, k)), 1, {DRAW_BITS // 4}))::BIGINT::DOUBLE + 1) / {1 << DRAW_BITS}::DOUBLE) / weight"

    def level(source: str, parent: str) -> str:
        return f"(SELECT tree, k, arg_min(name, (d, name)) AS path FROM (SELECT s.tree, k, name, {draw} AS d FROM {source} s JOIN nodes n ON n.tree = s.tree AND n.parent = {parent}) GROUP BY tree, k)"

    return f"""
WITH RECURSIVE {CRC_TABLE},
nodes(tree, parent, name, weight) AS (VALUES {nodes}),
k AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS k, tree FROM documents, (SELECT DISTINCT tree FROM nodes)),
l1 AS {level('k', "''")}, l2 AS {level('l1', 's.path')}, l3 AS {level('l2', 's.path')},
p AS (SELECT k, max(path) FILTER (WHERE tree = 'now') AS base, max(path) FILTER (WHERE tree = 'grown') AS grown FROM l3 GROUP BY k),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32, string_split(base, '/')[3]::INT AS shard, string_split(grown, '/')[3]::INT AS grown_shard
  FROM documents JOIN p ON coalesce(doc_id::VARCHAR, '') = k, crc_table)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM d
"""
