"""Ranking all documents for many queries at once, sharing what the queries have in common.

Items hold overlapping sets of terms. They are dealt into blocks; in each block the shared term sets are mined: terms held
by the same items form one set, and the two sets that most items hold together are joined, again and again, until none is
shared. The result is a graph in which a node is a sum of nodes or terms and an item a sum of nodes. For a batch of
documents each node's accumulator, one number a document, is computed once, however many items use it; items combine
accumulators along the graph. Rows of the final ranking come out of these sums alone.

Documents are read once: a first pass keeps of each its number of terms and its counts of the items' terms. Counts over the
corpus come from that table; so does the ranking, whose tasks hold an accumulator batch and the best documents of each item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from freshet.llm.common import Batches, map_texts, open_folder
from freshet.session import stage

#: Documents in an item's ranking.
DEPTH = 20
#: Items whose term sets are mined together, on the average.
ITEMS_PER_BLOCK = 256
#: Term sets among which pairs are looked for at once.
TILE = 512
#: Blocks that one pass over the documents serves: its tasks hold these blocks' graphs.
BLOCKS_PER_PASS = 16
#: Memory of a batch's accumulators.
ACCUMULATOR_BYTES = 48 << 20

#: Bytes of UTF-8 that stand in a term (letters and digits of ASCII, all beyond ASCII), A-Z lower-cased; others are blanks.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same for Columns.
TERM = r"[0-9a-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), 0)


# ---------------------------------------------------------------------------------------------- the sharing graph
@dataclass(frozen=True)
class Graph:
    """Nodes in an order in which each comes after those it sums: first a node for each (term, times) pair, then sums."""

    leaves: list[tuple[int, int]]  # term, times
    sums: list[tuple[int, ...]]  # nodes
    items: dict[int, tuple[int, ...]]  # item: nodes

    @property
    def additions(self) -> int:
        """Additions of accumulators a batch of documents costs."""
        return sum(len(s) - 1 for s in self.sums) + sum(max(0, len(s) - 1) for s in self.items.values())


def mine(items: dict[int, Counter]) -> Graph:
    """The graph of a block: ``items`` has each item's terms and how often it holds them.

    Terms that the same items hold are one set from the start. Sets are then taken in tiles, those that more items hold first;
    in a tile the two sets that most items hold together become one, again and again, while two items share any two. That is
    repeated with what is left until a round joins nothing. The work grows with the number of sets times a tile's.
    """
    row = {item: i for i, item in enumerate(sorted(items))}
    holders: dict[tuple[int, int], list[int]] = {}
    for item, i in row.items():
        for pair in items[item].items():
            holders.setdefault(pair, []).append(i)
    leaves = sorted(holders)
    classes: dict[tuple[int, ...], list[int]] = {}
    for node, pair in enumerate(leaves):
        classes.setdefault(tuple(holders[pair]), []).append(node)
    sums: list[tuple[int, ...]] = []
    parts: list[list[int]] = [[] for _ in row]
    shared: list[tuple[int, np.ndarray]] = []
    for held_by, members in classes.items():
        if len(held_by) == 1:
            parts[held_by[0]] += members
            continue
        if len(members) > 1:
            sums.append(tuple(members))
        holds = np.zeros(len(row), bool)
        holds[list(held_by)] = True
        shared.append((len(leaves) + len(sums) - 1 if len(members) > 1 else members[0], holds))
    while True:
        shared.sort(key=lambda x: (-int(x[1].sum()), x[0]))
        before, left = len(sums), []
        for begin in range(0, len(shared), TILE):
            left += _join(shared[begin : begin + TILE], len(leaves), sums)
        shared = left
        if len(sums) == before:
            break
    for node, holds in shared:
        for i in np.flatnonzero(holds):
            parts[i].append(node)
    return Graph(leaves, sums, {item: tuple(sorted(parts[i])) for item, i in row.items()})


def _join(sets: list[tuple[int, np.ndarray]], n_leaves: int, sums: list[tuple[int, ...]]) -> list[tuple[int, np.ndarray]]:
    """Join pairs of a tile's sets, the most shared first, and say what is still held, and by which items."""
    nodes = [node for node, _ in sets]
    holds = np.array([h for _, h in sets], np.int32)
    together = np.triu(holds @ holds.T, 1)
    while together.size and (most := together.max()) > 1:
        a, b = np.unravel_index(int(together.argmax()), together.shape)
        both = holds[a] & holds[b]
        nodes.append(n_leaves + len(sums))
        sums.append((nodes[a], nodes[b]))
        holds[a] -= both
        holds[b] -= both
        # A set that no item holds by itself any more gives its place to the new one.
        empty = next((i for i in (a, b) if not holds[i].any()), None)
        if empty is None:
            empty = len(holds)
            holds = np.vstack([holds, both])
            together = np.pad(together, ((0, 1), (0, 1)))
        else:
            nodes[empty] = nodes.pop()
            holds[empty] = both
        for i in {a, b, empty}:
            meets = holds @ holds[i]
            together[i, i + 1 :], together[:i, i] = meets[i + 1 :], meets[:i]
    return [(node, h.astype(bool)) for node, h in zip(nodes, holds, strict=True) if h.any()]


def _graph_rows(items: pd.DataFrame) -> pd.DataFrame:
    """A block's graph as rows of (block, kind, id, nodes); a leaf's nodes are its term and its times, an item's id is its row."""
    held: dict[int, Counter] = {}
    for item, term, times in zip(items["item"], items["term"], items["times"], strict=True):
        held.setdefault(int(item), Counter())[int(term)] = int(times)
    graph = mine(held)
    rows = [("leaf", i, list(pair)) for i, pair in enumerate(graph.leaves)]
    rows += [("sum", len(graph.leaves) + i, list(nodes)) for i, nodes in enumerate(graph.sums)]
    rows += [("item", item, list(nodes)) for item, nodes in graph.items.items()]
    return pd.DataFrame({"block": int(items["block"].iloc[0]), "kind": [r[0] for r in rows], "id": [r[1] for r in rows], "nodes": [r[2] for r in rows]})


class Accumulators:
    """One block's graph, ready to be computed for batches of documents."""

    def __init__(self, rows: pd.DataFrame) -> None:
        nodes = {kind: part.sort_values("id") for kind, part in rows.groupby("kind")}
        leaves = np.array([list(x) for x in nodes["leaf"]["nodes"]], np.int64).reshape(-1, 2)
        self.terms, self.times = leaves[:, 0], leaves[:, 1]
        self.sums = [np.asarray(x, np.int64) for x in nodes["sum"]["nodes"]] if "sum" in nodes else []
        self.items = nodes["item"]["id"].to_numpy(np.int64)
        self.parts = [np.asarray(x, np.int64) for x in nodes["item"]["nodes"]]
        self.n_nodes = len(leaves) + len(self.sums)
        # Leaves by term: where each term's nodes are, and how many.
        self.order = np.argsort(self.terms, kind="stable")
        self.known, self.first, self.count = np.unique(self.terms[self.order], return_index=True, return_counts=True)

    def scores(self, doc: np.ndarray, term: np.ndarray, part: np.ndarray, n_docs: int) -> np.ndarray:
        """Items by documents. ``part`` is what a term adds to the score of a document that an item holding it once gets."""
        held = np.zeros((self.n_nodes, n_docs), np.int64)
        at = np.searchsorted(self.known, term)
        at[at == len(self.known)] = 0
        hit = np.flatnonzero(self.known[at] == term) if len(self.known) else np.zeros(0, np.int64)
        at = at[hit]
        for k in range(int(self.count.max()) if len(self.count) else 0):
            more = self.count[at] > k
            node = self.order[self.first[at[more]] + k]
            held[node, doc[hit[more]]] = part[hit[more]] * self.times[node]
        for i, nodes in enumerate(self.sums):
            into = held[len(self.terms) + i]
            np.add(held[nodes[0]], held[nodes[1]], out=into)
            for node in nodes[2:]:
                into += held[node]
        out = np.zeros((len(self.parts), n_docs), np.int64)
        for into, nodes in zip(out, self.parts, strict=True):
            for node in nodes:
                into += held[node]
        return out


# ---------------------------------------------------------------------------------------------- over the documents
def _count_terms(folder: str) -> object:
    """Documents to ``key``, ``n`` (terms, with repeats) and the items' terms they hold, with counts."""

    def work(batches: Batches) -> Batches:
        known = _read(folder, ["term", "number"])
        numbers = dict(zip(known["term"].to_pylist(), known["number"].to_pylist(), strict=True))
        for batch in batches:
            found_n, offsets, terms, counts = [], [0], [], []
            for text in batch.column(1).to_pylist():
                # Codes of ASCII stand in no other character's UTF-8: bytes can be told one by one.
                words = text.encode().translate(_TERM_BYTES).split() if text else []
                found_n.append(len(words))
                held = Counter(map(numbers.get, words, repeat(-1)))
                held.pop(-1, None)
                terms += held.keys()
                counts += held.values()
                offsets.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64())) for values in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found_n, pa.int64()), *lists], names=["key", "n", "terms", "counts"])

    return work


def _read(folder: str, columns: list[str]) -> pa.Table:
    files, root = open_folder(folder)
    return pq.read_table(root, columns=columns, filesystem=files)


def _rank(graphs: str, weights: str, n_docs: int, n_terms: int, depth: int) -> object:
    """The best documents of each item among a task's."""

    def work(batches: Batches) -> Batches:
        blocks = [Accumulators(rows) for _, rows in _read(graphs, ["block", "kind", "id", "nodes"]).to_pandas().groupby("block")]
        if not blocks:
            return
        table = _read(weights, ["number", "weight"])
        weight = np.zeros(1 + max(table["number"].to_pylist(), default=0), np.int64)
        weight[table["number"].to_numpy()] = table["weight"].to_numpy()
        wide = max(1, min(4096, ACCUMULATOR_BYTES // (8 * max(b.n_nodes + len(b.parts) for b in blocks))))
        best = [_Best(len(b.parts), depth) for b in blocks]
        for batch in batches:
            for begin in range(0, batch.num_rows, wide):
                part = batch.slice(begin, wide)
                n = part.column(1).to_numpy()
                lists = part.column(2)
                lengths = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(part.num_rows), lengths)
                term, tf = lists.flatten().to_numpy(), part.column(3).flatten().to_numpy()
                m = 75 + (25 * n * n_docs) // max(n_terms, 1)
                gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                keys = part.column(0)
                for block, found in zip(blocks, best, strict=True):
                    found.add(block.scores(doc, term, gain, part.num_rows), keys)
        for block, found in zip(blocks, best, strict=True):
            yield from found.rows(block.items)

    return work


class _Best:
    """The documents of highest score for each item so far; of equal scores those of the least key, null first."""

    def __init__(self, items: int, depth: int) -> None:
        self.depth = depth
        self.kept: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)

    def add(self, scores: np.ndarray, keys: pa.Array) -> None:
        rows, docs = np.nonzero(scores >= self.least[:, None])
        if not len(rows):
            return
        cuts = np.flatnonzero(np.diff(rows)) + 1
        for mine in np.split(np.arange(len(rows)), cuts):
            item = int(rows[mine[0]])
            at, found = docs[mine], scores[item, docs[mine]]
            if len(at) > 4 * self.depth:
                # Ties at the limit stay: the key decides among them.
                limit = np.partition(found, -self.depth)[-self.depth]
                at, found = at[found >= limit], found[found >= limit]
            named = keys.take(pa.array(at)).to_pylist()
            merged = self.kept[item] + [(-int(s), k is not None, k or 0) for s, k in zip(found, named, strict=True)]
            merged.sort()
            self.kept[item] = merged[: self.depth]
            if len(merged) >= self.depth:
                self.least[item] = -self.kept[item][-1][0]

    def rows(self, items: np.ndarray) -> Iterator[pa.RecordBatch]:
        flat = [(int(item), key if given else None, -score) for item, kept in zip(items, self.kept, strict=True) for score, given, key in kept]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat, strict=True)], names=["item", "key", "score"])


def rank_documents(
    docs: DataFrame, items: DataFrame, depth: int = DEPTH, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    items_per_block: int = ITEMS_PER_BLOCK, blocks_per_pass: int = BLOCKS_PER_PASS,
) -> DataFrame:
    """For each item the ``depth`` documents of highest score above 0: item, rank (from 1), key, score; of equal scores the
    least key first, a null one before all others.

    Null and empty texts have no terms; such items have no rows, and such documents none either. Every row of items is an item
    of its own and every row of documents a document, also if repeated or of equal or null ids; ids of items keep their type,
    keys are integers. Empty tables give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{item}`").alias("item"), terms_of(F.col(f"`{item_text}`")).alias("terms"))
    rows, _ = stage(rows, "rank-items")
    held = rows.select("row", F.explode("terms").alias("term")).groupBy("row", "term").agg(F.count("*").alias("times"))
    # The items' terms, numbered within the ranges they are written in.
    known = held.select(F.encode("term", "UTF-8").alias("term")).distinct()
    _, raw = stage(known, "rank-terms-raw")
    known = spark.read.schema("term binary").parquet(raw)
    total = known.count()
    order = F.row_number().over(W.partitionBy("_part").orderBy("term"))
    parts = max(1, -(-total // 100_000))
    known = known.withColumn("_part", F.pmod(F.xxhash64("term"), F.lit(parts))).withColumn("number", (order - 1).cast("bigint") * parts + F.col("_part")).drop("_part")
    known, terms_folder = stage(known, "rank-terms")

    counted = map_texts(docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text")), _count_terms(terms_folder), "key bigint, n bigint, terms array<bigint>, counts array<bigint>")
    counted, _ = stage(counted, "rank-counts")
    n_docs, n_terms = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = counted.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("df"))

    def weigh(batches: Batches) -> Batches:
        for batch in batches:
            found = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["number", "weight"])

    _, weights = stage(holding.mapInArrow(weigh, "number bigint, weight bigint"), "rank-weights")

    n_blocks = max(1, -(-rows.count() // items_per_block))
    numbered = held.withColumn("term", F.encode("term", "UTF-8")).join(known, "term")
    numbered = numbered.select(F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("block"), F.col("row").alias("item"), F.col("number").alias("term"), "times")
    graphs, graph_folder = stage(numbered.groupBy("block").applyInPandas(_graph_rows, "block int, kind string, id bigint, nodes array<bigint>").withColumn("pass", F.floor(F.col("block") / blocks_per_pass)), "rank-graphs")

    best = None
    for turn in range(-(-n_blocks // blocks_per_pass)):
        # A pass's tasks read its blocks' graphs themselves, from the shared folder.
        folder = graph_folder
        if n_blocks > blocks_per_pass:
            _, folder = stage(graphs.filter(F.col("pass") == turn), "rank-pass")
        found = counted.filter("size(terms) > 0").mapInArrow(_rank(folder, weights, n_docs, n_terms, depth), "item bigint, key bigint, score bigint")
        best = found if best is None else best.unionByName(found)
    place = F.row_number().over(W.partitionBy("row").orderBy(F.col("score").desc(), F.col("key").asc_nulls_first()))
    best = best.withColumnRenamed("item", "row").withColumn("rank", place).filter(F.col("rank") <= depth)
    return best.join(rows.select("row", "item"), "row").select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")


def ranking_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def oracle_sql() -> str:
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS terms FROM documents),
n AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS i, item_id, {terms} AS terms FROM benchmark)) GROUP BY i, item_id, term),
t AS (SELECT r, doc_id, size, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS size, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, size, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM t, n GROUP BY term, n_docs),
g AS (SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * n_docs) // n_terms))) AS gain FROM t JOIN w USING (term), n),
s AS (SELECT i, item_id, r, doc_id, sum(gain * times)::BIGINT AS score FROM q JOIN g USING (term) GROUP BY i, item_id, r, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= {DEPTH}
"""
