"""A trie of conversation prefixes, in balanced parentheses.

A node is a distinct sequence of turns with which conversations begin; its id is a hash of the sequence, built from running
sums, so that a conversation of any length is cut into chunks and no task holds it whole. Nodes are put into preorder by a
key that strings can be sorted by: all nodes of the same least conversation form a chain down the trie, and a chain's key
is its parent chain's, the depth where it leaves it (deeper ones first) and its conversation.

Ranges of the preorder are shards. A shard encodes its nodes as balanced parentheses with the least excess of each block and
a tree of these minima above: ``findclose`` delimits a node's subtree, the rank of leaf pairs "()" counts its leaves, and
cumulative sums give its savings. Nodes that a shard leaves open, its right spine, are completed from the shards after it:
of those, a row with totals each, and for the depths that it closes the sums before that, are all that is read.

Nodes below a conversation's last shared node are its alone and need no parentheses: one leaf, no savings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from freshet.llm.common import Batches, gathered, join_to_one, open_folder
from freshet.llm.hash_tree import CRC_TABLE, crc32_sql
from freshet.session import stage

#: Nodes in a shard, on the average.
NODES_PER_SHARD = 1 << 18
#: Parentheses in a block of the range min-max tree.
BLOCK = 512
#: Bytes of member ids hashed at once.
CHUNK_BYTES = 1 << 20
NO_ENDS = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------------------------------------- balanced parentheses
class Parentheses:
    """A forest's parentheses, a bit each (1 opens), which may leave some open at the end."""

    def __init__(self, bits: np.ndarray) -> None:
        self.n = len(bits)
        self.packed = np.packbits(bits)
        steps = np.where(bits == 1, 1, -1).astype(np.int64)
        excess = np.cumsum(steps)
        n_blocks = -(-self.n // BLOCK)
        self.before = np.concatenate([[0], excess[BLOCK - 1 :: BLOCK]])[:n_blocks]
        width = 1
        while width < max(n_blocks, 1):
            width *= 2
        #: Least excess of each block, and of each pair of nodes below; 1 is the root.
        self.least = np.full(2 * width, np.iinfo(np.int64).max)
        if n_blocks:
            self.least[width : width + n_blocks] = np.minimum.reduceat(excess, np.arange(0, self.n, BLOCK))
        for node in range(width - 1, 0, -1):
            self.least[node] = min(self.least[2 * node], self.least[2 * node + 1])
        self.width = width
        pairs = np.zeros(self.n, np.int64)
        pairs[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.pairs = np.concatenate([[0], np.cumsum(pairs)])

    def block(self, k: int) -> np.ndarray:
        """Excess after each parenthesis of a block."""
        bits = np.unpackbits(self.packed[k * BLOCK // 8 : (k + 1) * BLOCK // 8])[: self.n - k * BLOCK]
        return self.before[k] + np.cumsum(np.where(bits == 1, 1, -1))

    def _next_block(self, after: int, target: int) -> int | None:
        """The first block after one in which the excess comes down to the target."""
        node = self.width + after
        while node > 1:
            if node % 2 == 0 and self.least[node + 1] <= target:
                node += 1
                while node < self.width:
                    node = 2 * node if self.least[2 * node] <= target else 2 * node + 1
                return node - self.width
            node //= 2
        return None

    def findclose(self) -> np.ndarray:
        """For each opening parenthesis, in order, where it is closed, or -1."""
        found: list[np.ndarray] = []
        for k in range(len(self.before)):
            excess = self.block(k)
            opens = np.flatnonzero(np.diff(excess, prepend=self.before[k]) > 0)
            target = excess[opens] - 1
            closed = (excess[None, :] <= target[:, None]) & (np.arange(len(excess))[None, :] > opens[:, None])
            at = np.where(closed.any(axis=1), closed.argmax(axis=1) + k * BLOCK, -1)
            for i in np.flatnonzero(at < 0):
                later = self._next_block(k, int(target[i]))
                if later is not None:
                    at[i] = later * BLOCK + int(np.argmax(self.block(later) <= target[i]))
            found.append(at)
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def leaves(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Leaf pairs that open from ``begin`` on and before ``end``."""
        return self.pairs[end] - self.pairs[begin]


def encode(depth: np.ndarray, last_is_leaf: bool) -> tuple[np.ndarray, np.ndarray]:
    """Parentheses of nodes in preorder, and where each opens. What was open before the first node is not in them; the last
    node is closed only if it is known to be a leaf."""
    least = np.minimum.accumulate(depth)
    closes = np.zeros(len(depth), np.int64)
    closes[:-1] = np.maximum(0, depth[:-1] - np.maximum(depth[1:], least[:-1]) + 1)
    closes[-1] = int(last_is_leaf)
    opens = np.arange(len(depth)) + np.cumsum(closes) - closes
    bits = np.zeros(len(depth) + int(closes.sum()), np.uint8)
    bits[opens] = 1
    return bits, opens


# ---------------------------------------------------------------------------------------------- turns and prefixes
def place_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns as ``conv``, ``chunk``, ``place`` (from 0), ``a`` and ``b`` (128 bits of role and text), ``chars`` (code points of the
    text) and ``length`` (turns of the conversation), written.

    Turns are in order of ``turn``, null first; equal ones by the hash of role and text. Null role and text count as empty.
    Rows without a conversation belong to none and are not placed. A conversation's turns are numbered by chunks, the parts of
    it that ranges over all turns hold.
    """
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    rows = conversations.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("bigint").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(text, F.lit(1), role).alias("b"), F.char_length(text).cast("bigint").alias("chars"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    placed, _ = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "turns")
    placed = placed.withColumn("chunk", F.shiftright("at", 33))
    chunks = placed.groupBy("conv", "chunk").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # A row for each chunk of a conversation: as many as ranges at most.
    whole = W.partitionBy("conv")
    chunks = chunks.withColumn("before", F.coalesce(F.sum("n").over(whole.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("length", F.sum("n").over(whole)).drop("n")
    placed = placed.join(chunks, ["conv", "chunk"]).withColumn("place", F.col("at") - F.col("first") + F.col("before"))
    return stage(placed.select("conv", "chunk", "place", "a", "b", "chars", "length"), "placed")[0]


def by_chunk(turns: DataFrame, per_conversation: DataFrame) -> DataFrame:
    """Join what is known of each conversation to its turns, by chunk: a long conversation is joined in many tasks."""
    chunks = turns.select("conv", "chunk").distinct().join(per_conversation, "conv")
    return turns.join(chunks, ["conv", "chunk"])


def _hashes(depth: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(depth, *sums), F.xxhash64(*reversed(sums), depth)]


def prefixes(turns: DataFrame) -> DataFrame:
    """Each turn as the prefix that ends with it: ``na``, ``nb`` (its id), ``pa``, ``pb`` (its parent's), ``conv``, ``depth``, ``chars``,
    ``ends`` (whether the conversation does). A prefix's id is a hash of sums of its turns' hashes by place: sums of chunks add up."""
    depth = F.col("place") + 1
    first, second = F.xxhash64(depth, "a", "b"), F.xxhash64("b", F.lit(7), depth, "a")
    half = F.lit(0xFFFFFFFF)
    # Sums of 32-bit halves don't overflow.
    lanes = {f"l{i}": lane for i, lane in enumerate((first.bitwiseAND(half), F.shiftrightunsigned(first, 32), second.bitwiseAND(half), F.shiftrightunsigned(second, 32)))}
    turns = turns.withColumns(lanes)
    chunks = turns.groupBy("conv", "chunk").agg(*[F.sum(lane).alias(f"c{lane}") for lane in lanes])
    earlier = W.partitionBy("conv").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select("conv", "chunk", *[F.coalesce(F.sum(f"c{lane}").over(earlier), F.lit(0)).alias(f"c{lane}") for lane in lanes])
    within = W.partitionBy("conv", "chunk").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    turns = turns.join(chunks, ["conv", "chunk"]).withColumns({f"s{lane}": F.sum(lane).over(within) + F.col(f"c{lane}") for lane in lanes})
    node = _hashes(depth, [F.col(f"s{lane}") for lane in lanes])
    parent = _hashes(depth - 1, [F.col(f"s{lane}") - F.col(lane) for lane in lanes])
    return turns.select(
        node[0].alias("na"), node[1].alias("nb"), parent[0].alias("pa"), parent[1].alias("pb"), "conv", depth.cast("bigint").alias("depth"), "chars",
        (depth == F.col("length")).alias("ends"),
    )


# ---------------------------------------------------------------------------------------------- preorder
def _with_keys(nodes: DataFrame) -> DataFrame:
    """Add ``key``: nodes sorted by key and depth are in preorder. ``nodes`` is a written table with ``conv_id``, ``depth`` and
    ``parent_conv_id``, closed upwards. Chains are keyed a level at a time: as many rounds as the least member changes on
    the way down, at most; a few, unless ids are dealt for the worst."""
    heads = nodes.filter(F.col("parent_conv_id").isNull() | (F.col("parent_conv_id") != F.col("conv_id")))
    heads, _ = stage(heads.select("conv_id", F.col("parent_conv_id").alias("on"), "depth"), "chains")
    step = F.concat(F.lpad(F.hex(F.lit(0x7FFFFFFF) - F.col("depth")), 8, "0"), F.lpad(F.hex("conv_id"), 16, "0"))
    level = heads.filter("on is null").select("conv_id", F.lit("").alias("key"))
    level, _ = stage(level, "chain-keys")
    keys = level
    waiting = heads.filter("on is not null")
    while True:
        level, _ = stage(join_to_one(waiting, level.select(F.col("conv_id").alias("on"), F.col("key").alias("above")), ["on"]).select("conv_id", F.concat("above", step).alias("key")), "chain-keys")
        if level.isEmpty():
            return join_to_one(nodes, keys, ["conv_id"])
        keys = keys.unionByName(level)


# ---------------------------------------------------------------------------------------------- shards
_SHARD = "kind string, shard int, na bigint, nb bigint, depth bigint, leaves bigint, saved bigint"


def _shard_rows(kind: str, shard: int, depth: np.ndarray, leaves: np.ndarray, saved: np.ndarray, na: pa.Array | None = None, nb: pa.Array | None = None) -> pa.RecordBatch:
    n = len(depth)
    none = pa.nulls(n, pa.int64())
    columns = [pa.array([kind] * n, pa.string()), pa.array(np.full(n, shard, np.int32)), none if na is None else na, none if nb is None else nb]
    return pa.RecordBatch.from_arrays([*columns, *[pa.array(x.astype(np.int64)) for x in (depth, leaves, saved)]], names=[f.split()[0] for f in _SHARD.split(", ")])


def _shard(batches: Batches) -> Batches:
    """A range of the preorder (na, nb, depth, leaf, saved): ``node`` rows of subtrees that end in it, ``open`` ones of those
    that don't (what of them is in the shard), ``edge`` rows (for each depth that was open before and ends here, the sums
    before it ends), and a ``total`` (with the least depth)."""
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    for batch in gathered(batches, 1 << 62):
        depth, saved = batch.column(2).to_numpy(), batch.column(4).to_numpy()
        bits, opens = encode(depth, bool(batch.column(3)[-1].as_py()))
        forest = Parentheses(bits)
        closes = forest.findclose()
        inside = closes >= 0
        end = np.where(inside, closes, forest.n)
        # Opening parentheses before a place: the nodes before it.
        behind = np.searchsorted(opens, end)
        sums = np.concatenate([[0], np.cumsum(saved)])
        leaves, total = forest.leaves(opens, end), sums[behind] - sums[:-1]
        for kind, which in (("node", inside), ("open", ~inside)):
            at = np.flatnonzero(which)
            if len(at):
                yield _shard_rows(kind, shard, depth[at], leaves[at], total[at], batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)))
        least = np.minimum.accumulate(depth)
        ends = np.arange(int(least[-1]), int(depth[0]))
        first = np.searchsorted(-least, -ends)  # the first node that is no deeper
        begins = opens[first] if len(ends) else np.zeros(0, np.int64)
        if len(ends):
            yield _shard_rows("edge", shard, ends, forest.leaves(np.zeros(len(ends), np.int64), begins), sums[first])
        yield _shard_rows("total", shard, least[-1:], forest.pairs[-1:], sums[-1:])


def _spines(folder: str) -> Callable[[Batches], Batches]:
    """Open nodes to the shard that ends them (-1: none does), with the sums of the shards between added."""

    def work(batches: Batches) -> Batches:
        files, root = open_folder(folder)
        totals = pq.read_table(root, filesystem=files).to_pandas().sort_values("shard")
        shards, least = totals["shard"].to_numpy(), totals["depth"].to_numpy()
        sums = {name: np.concatenate([[0], np.cumsum(totals[name].to_numpy())]) for name in ("leaves", "saved")}
        for batch in batches:
            rows = batch.to_pydict()
            here = np.searchsorted(shards, rows["shard"])
            ends = []
            for i, depth in zip(here.tolist(), rows["depth"], strict=True):
                later = np.flatnonzero(least[i + 1 :] <= depth)
                ends.append(i + 1 + int(later[0]) if len(later) else len(shards))
            end = np.array(ends, np.int64)
            found = [pa.array(np.array([*shards, -1], np.int32)[end])]
            found += [pa.array(np.array(rows[name]) + sums[name][end] - sums[name][here + 1]) for name in ("leaves", "saved")]
            yield pa.RecordBatch.from_arrays([found[0], *[batch.column(batch.schema.get_field_index(c)) for c in ("na", "nb", "depth")], *found[1:]], names=["shard", "na", "nb", "depth", "leaves", "saved"])

    return work


def subtree_sums(nodes: DataFrame, nodes_per_shard: int = NODES_PER_SHARD) -> DataFrame:
    """``na``, ``nb``, ``n_leaves`` and ``saved_tokens`` of each node. ``nodes`` is a written table with ``key`` and ``depth`` (the
    preorder), ``leaf`` and ``saved`` (what the node itself saves)."""
    shards = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-nodes.count() // nodes_per_shard))
    ordered = nodes.repartitionByRange(shards, "key", "depth").sortWithinPartitions("key", "depth").select("na", "nb", "depth", "leaf", "saved")
    found, _ = stage(ordered.mapInArrow(_shard, _SHARD), "shards")
    # A row for each shard.
    _, totals = stage(found.filter("kind = 'total'").select("shard", "depth", "leaves", "saved"), "shard-totals")
    spines = found.filter("kind = 'open'").select("shard", "na", "nb", "depth", "leaves", "saved").mapInArrow(_spines(totals), "shard int, na bigint, nb bigint, depth bigint, leaves bigint, saved bigint")
    edges = found.filter("kind = 'edge'").select("shard", "depth", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    merged = spines.join(edges, ["shard", "depth"], "left")
    merged = merged.select("na", "nb", *[(F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c) for c in ("leaves", "saved")])
    return found.filter("kind = 'node'").select("na", "nb", "leaves", "saved").unionByName(merged).withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"})


# ---------------------------------------------------------------------------------------------- members
def _join_ids(batches: Batches) -> Batches:
    """Sorted (na, nb, conv) to rows of decimal ids joined by commas, a chunk of one node each."""
    from pyspark import TaskContext

    place = TaskContext.get().partitionId() << 33
    node, ids, size = None, [], 0

    def out() -> pa.RecordBatch:
        nonlocal place, ids, size
        row = pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([place], pa.int64()), pa.array([",".join(ids)])], names=["na", "nb", "at", "ids"])
        place, ids, size = place + 1, [], 0
        return row

    for batch in batches:
        for *here, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if here != node or size > CHUNK_BYTES:
                if ids:
                    yield out()
                node = here
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        yield out()


def _hash_ids(batches: Batches) -> Batches:
    node, digest = None, None
    for batch in batches:
        done: list[tuple[int, int, str]] = []
        for *here, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if here != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = here, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["na", "nb", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], names=["na", "nb", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """``na``, ``nb`` and the SHA-256 of the ids of the conversations that end there, ascending. The ids are sorted and joined by
    ranges over all nodes; what one task hashes in sequence, as SHA-256 must be, are a node's pieces of a megabyte."""
    order = ["na", "nb", "conv"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_join_ids, "na bigint, nb bigint, at bigint, ids string")
    pieces, _ = stage(pieces, "ends")
    return pieces.repartition("na", "nb").sortWithinPartitions("na", "nb", "at").select("na", "nb", "ids").mapInArrow(_hash_ids, "na bigint, nb bigint, ends_sha256 string")


# ---------------------------------------------------------------------------------------------- the trie
def prefix_trie(turns: DataFrame, members: DataFrame, nodes_per_shard: int = NODES_PER_SHARD) -> DataFrame:
    """A row for each node: ``conv_id`` (its least member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (over its subtree, members but one times code points of the last text), ``ends_sha256``.

    ``turns`` as from ``place_turns``; ``members`` has every conversation as ``conv``, also those without turns, which end at the
    root. Without members there are no rows.
    """
    rows, _ = stage(prefixes(turns), "prefixes")
    found = rows.groupBy("na", "nb").agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("chars").alias("chars")
    )
    origin = _hashes(F.lit(0).cast("bigint"), [F.lit(0).cast("bigint")] * 4)
    origin = [origin[0].alias("na"), origin[1].alias("nb")]
    root = members.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    none = F.lit(None).cast("bigint")
    root = root.select(*origin, "conv_id", "n_convs", F.lit(0).cast("bigint").alias("depth"), none.alias("pa"), none.alias("pb"), F.lit(0).cast("bigint").alias("chars"))
    found, _ = stage(found.unionByName(root), "nodes")

    children = found.filter("pa is not null").groupBy(F.col("pa").alias("na"), F.col("pb").alias("nb")).agg(F.count("*").alias("n_children"))
    above = found.select(F.col("na").alias("pa"), F.col("nb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("beside"))
    top = found.filter("pa is null").withColumns({"parent_conv_id": none, "beside": none})
    nodes = join_to_one(found.filter("pa is not null"), above, ["pa", "pb"]).unionByName(top).drop("pa", "pb").join(children, ["na", "nb"], "left")
    nodes, _ = stage(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie")

    shared = (F.col("n_convs") > 1) | (F.col("beside") > 1) | (F.col("depth") == 0)
    inner = nodes.filter(shared).select(
        "na", "nb", "conv_id", "depth", "parent_conv_id", ((F.col("n_convs") == 1) | (F.col("n_children") == 0)).alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    )
    inner, _ = stage(inner, "inner")
    keyed, _ = stage(_with_keys(inner).select("na", "nb", "key", "depth", "leaf", "saved"), "preorder")
    sums = subtree_sums(keyed, nodes_per_shard)
    sums = nodes.filter(shared).join(sums, ["na", "nb"])
    alone = nodes.filter(~shared).withColumns({"n_leaves": F.lit(1).cast("bigint"), "saved_tokens": F.lit(0).cast("bigint")})

    turnless = members.join(turns.filter("place = 0").select("conv"), "conv", "left_anti").select(*origin, "conv")
    digests = ends_digest(rows.filter("ends").select("na", "nb", "conv").unionByName(turnless))
    full = sums.unionByName(alone).join(digests, ["na", "nb"], "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return full.select(*columns, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


# ---------------------------------------------------------------------------------------------- the query
#: The query rebuilds conversations: their first turns, fewer than this, come from their hundred's first conversation.
MOST_TAKEN = 6
HUNDRED = 100


def taken(conv: Column) -> Column:
    """How many first turns a conversation takes over."""
    return (F.crc32(conv.cast("string")) % MOST_TAKEN).cast("bigint")


def rebuild(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns, as ``place_turns`` gives them, and all conversations. The remainder of a negative id has its sign."""
    convs, _ = stage(placed.groupBy("conv").agg(F.max("length").alias("length")), "conversations")
    first = F.col("conv") - F.col("conv") % HUNDRED
    lengths = convs.filter(F.col("conv") % HUNDRED == 0).select(F.col("conv").alias("base"), F.col("length").alias("there"))
    plan = convs.withColumn("base", first).withColumn("h", taken(F.col("conv"))).join(lengths, "base", "left")
    plan = plan.withColumn("head", F.least("h", F.coalesce("there", F.lit(0))))
    plan, _ = stage(plan.select("conv", "base", "h", "head", (F.col("head") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("whole")), "rebuild")
    # At most a hundred conversations take over a turn, and few turns are taken over.
    heads = placed.filter((F.col("conv") % HUNDRED == 0) & (F.col("place") < MOST_TAKEN - 1)).select(F.col("conv").alias("base"), "place", "a", "b", "chars")
    heads = plan.join(heads, "base").filter(F.col("place") < F.col("h"))
    heads = heads.select("conv", F.lit(-1).cast("bigint").alias("chunk"), "place", "a", "b", "chars", F.col("whole").alias("length"))
    own = by_chunk(placed.filter(F.col("place") >= taken(F.col("conv"))).drop("length"), plan.select("conv", "h", "head", "whole"))
    own = own.select("conv", "chunk", (F.col("place") - F.col("h") + F.col("head")).alias("place"), "a", "b", "chars", F.col("whole").alias("length"))
    return stage(own.unionByName(heads), "rebuilt")[0], convs.select("conv")


def trie_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuild(place_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def oracle_sql() -> str:
    return f"""
WITH RECURSIVE {CRC_TABLE},
c AS (SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % {MOST_TAKEN} AS h, conv_id - conv_id % {HUNDRED} AS base FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc_table),
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (
  SELECT c.conv_id, place, 0 AS own, turn, chars FROM c JOIN t ON t.conv_id = base WHERE place < h
  UNION ALL SELECT c.conv_id, place, 1, turn, chars FROM c JOIN t ON t.conv_id = c.conv_id WHERE place >= h),
p AS (
  SELECT conv_id, chars, row_number() OVER w AS depth, list(turn) OVER w AS path, count(*) OVER (PARTITION BY conv_id) AS whole
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, place)
  UNION ALL SELECT conv_id, 0, 0, [], (SELECT count(*) FROM r WHERE r.conv_id = c.conv_id) FROM c),
n AS (
  SELECT path, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = whole), '')) AS ends_sha256
  FROM p GROUP BY path),
k AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
u AS (SELECT path[:d] AS path, sum(saved)::BIGINT AS saved_tokens, sum((n_children = 0)::INT)::BIGINT AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, x.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN u USING (path) LEFT JOIN f x ON f.depth > 0 AND x.path = f.path[:f.depth - 1]
"""
