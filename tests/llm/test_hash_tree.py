import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from freshet.llm.hash_tree import PRODUCTION, SEED, Leaf, Tree, descend, shard_documents


def brute(tree, key):
    """The same descent, a key at a time."""
    path = []
    for level in range(3):
        weights = Counter()
        for leaf in tree.leaves:
            names = [leaf.region, f"{leaf.region}/{leaf.rack}", f"{leaf.region}/{leaf.rack}/{leaf.shard}"]
            if level == 0 or names[level - 1] == path[-1]:
                weights[names[level]] += leaf.weight

        def draw(name):
            bits = int(hashlib.md5(f"{SEED}|{name}|{'' if key is None else key}".encode()).hexdigest()[:13], 16)
            return -math.log((bits + 1) / 2**52) / weights[name], name

        path.append(min(draw(name) for name in weights if weights[name])[1])
    return int(path[-1].split("/")[2])


def placed(spark, tree, keys):
    rows = descend(spark.createDataFrame([(k,) for k in keys], "k bigint"), tree, F.col("k"), "to").select("k", "to.*").collect()
    return {r["k"]: (r["region"], r["rack"], r["shard"]) for r in rows}


UNEVEN = Tree((Leaf(0, "a", "x", 3.0), Leaf(1, "a", "y", 1.0), Leaf(2, "a", "y", 0.0), Leaf(3, "b", "x", 0.5), Leaf(7, "b", "x", 1.5)))


def test_equals_brute_force(spark):
    for tree in (UNEVEN, PRODUCTION, Tree.even(1, 1, 1)):
        found = placed(spark, tree, range(-40, 160))
        assert {k: v[2] for k, v in found.items()} == {k: brute(tree, k) for k in range(-40, 160)}


def test_shares_follow_weights(spark):
    n = 6000
    shares = Counter(v[2] for v in placed(spark, UNEVEN, range(n)).values())
    for leaf in UNEVEN.leaves:
        p = leaf.weight / 6
        assert abs(shares[leaf.shard] - n * p) <= 5 * math.sqrt(n * p * (1 - p)) + 1e-9


@pytest.mark.parametrize("tree", [UNEVEN, PRODUCTION, PRODUCTION.with_shard(2.0)])
def test_one_more_shard_takes_rows_only_into_itself(spark, tree):
    before, after = placed(spark, tree, range(2000)), placed(spark, tree.with_shard(), range(2000))
    new = 1 + max(leaf.shard for leaf in tree.leaves)
    moved = [k for k in before if before[k] != after[k]]
    assert moved and all(after[k][2] == new for k in moved)


def test_movement_stays_in_subtrees_whose_weights_change(spark):
    before, after = placed(spark, PRODUCTION, range(3000)), placed(spark, PRODUCTION.reweighted(5, 2.0), range(3000))
    moved = [k for k in before if before[k] != after[k]]
    assert moved
    for k in moved:
        # Shard 5 stands in r0/k1: a row goes into the region, in it into the rack, in it into the shard, or stays at that level.
        assert after[k][0] == "r0" and (before[k][0] == "r1" or after[k][1] == "r0/k1")
        assert before[k][1] != "r0/k1" or after[k][2] == 5
    lighter = placed(spark, PRODUCTION.reweighted(5, 0.0), range(3000))
    assert not any(v[2] == 5 for v in lighter.values())
    assert all(before[k][0] == "r0" for k in before if before[k] != lighter[k])


def test_documents(spark, table, hard_rows):
    docs = table(hard_rows)
    rows = shard_documents(docs, PRODUCTION).collect()
    assert len(rows) == len(hard_rows)
    texts = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), brute(PRODUCTION, k), brute(PRODUCTION.with_shard(), k)) for k, t, _, _ in hard_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in rows) == texts
    for shard in {r["shard"] for r in rows}:
        mine = sorted((r for r in rows if r["shard"] == shard), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        keys = [r["doc_id"] for r in mine]
        assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert shard_documents(docs.limit(0), PRODUCTION).count() == 0


def test_bad_trees(spark):
    for leaves in ((), (Leaf(0, "a", "x", 0.0),), (Leaf(0, "a", "x"), Leaf(0, "b", "x")), (Leaf(0, "a", "x", -1.0),), (Leaf(0, "a/b", "x"),)):
        with pytest.raises(ValueError):
            Tree(leaves).children()
