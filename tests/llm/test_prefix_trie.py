import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from freshet.llm import prefix_trie
from freshet.llm.prefix_trie import Parentheses, by_chunk, encode, place_turns, rebuild

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string, chunk string, conv string, a string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)


def brute(sequences):
    """Rows of the trie over {conversation: [(role, text)]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv in sorted(sequences):
        turns = tuple(sequences[conv])
        ends[turns].append(conv)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(convs) - 1) * (len(path[-1][1]) if path else 0)
    return Counter(
        (convs[0], len(p), members[p[:-1]][0] if p else None, len(convs), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, convs in members.items()
    )


def own(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns)] for c, turns in found.items()}


def rebuilt(rows):
    turns = own(rows)
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + mine[h:]
    return out


def trie_of(placed, n=4):
    return Counter(map(tuple, prefix_trie.prefix_trie(placed, placed.select("conv").distinct(), nodes_per_shard=n).collect()))


@given(st.lists(st.booleans(), max_size=3000))
@settings(max_examples=60, deadline=None)
def test_findclose(steps):
    bits, height = [], 0
    for up in steps:
        if up or height:
            bits.append(int(up))
            height += 1 if up else -1
    bits = np.array(bits, np.uint8)
    stack, expected = [], {}
    for i, bit in enumerate(bits):
        if bit:
            stack.append(i)
        else:
            expected[stack.pop()] = i
    opens = np.flatnonzero(bits)
    forest = Parentheses(bits)
    assert forest.findclose().tolist() == [expected.get(i, -1) for i in opens.tolist()]
    pairs = [i for i in range(len(bits) - 1) if bits[i] and not bits[i + 1]]
    assert forest.leaves(np.array([0]), np.array([len(bits)])).tolist() == [len(pairs)]


def test_findclose_of_deep_and_wide():
    for bits in ([1] * 5000 + [0] * 5000, [1] + [1, 0] * 4000 + [0], [1] * 3000):
        closes = Parentheses(np.array(bits, np.uint8)).findclose()
        assert closes[0] == (len(bits) - 1 if 0 in bits else -1)
    bits, opens = encode(np.array([2, 3, 3, 1, 2, 0, 1]), False)
    assert bits.tolist() == [1, 1, 0, 1, 0, 0, 1, 1, 0, 0, 1, 1]
    assert opens.tolist() == [0, 1, 3, 6, 7, 10, 11]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-50, 400), 70):
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, turn, rng.choice("ua"), rng.choice(["", "x", "yy", "é日"])))
    placed = place_turns(frame(spark, rows))
    assert trie_of(placed) == brute(own(rows))
    whole, convs = rebuild(placed)
    found = prefix_trie.prefix_trie(whole, convs, nodes_per_shard=3)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(map(tuple, found.collect())) == brute(rebuilt(rows))


def test_hot_groups(spark, monkeypatch):
    """One long conversation, its copy, many copies of a short one, a common first turn, and few rows to count as hot."""
    monkeypatch.setattr("freshet.llm.common.HOT_ROWS", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 10)
    rows = [(c, t, "u", f"turn {t}") for c in (500, 900) for t in range(150)]
    rows += [(c, t, "u", ["hello", "same"][t]) for c in range(1001, 1060) for t in range(2)]
    rows += [(c, t, "u", ["hello", f"own {c}", "bye"][t]) for c in range(2001, 2060) for t in range(3)]
    rows += [(3000, t, "u", f"turn {t}" if t < 90 else "left") for t in range(120)]
    placed = place_turns(frame(spark, rows).repartition(7))
    assert placed.filter("conv = 500").select("chunk").distinct().count() >= 1
    assert by_chunk(placed, placed.select("conv").distinct().selectExpr("conv", "conv AS again")).filter("conv = again").count() == len(rows)
    assert trie_of(placed, 9) == brute(own(rows))


def test_nulls_repeats_and_emptiness(spark):
    rows = [(1, None, "u", "first"), (1, 0, None, None), (1, 0, "", ""), (1, 2, "u", "x" * 100_000), (None, 1, "u", "nobody's"), (2, 5, "u", "first"), (2, 5, "u", "first")]
    rows += [(104, 0, "u", "a"), (107, None, None, None), (7, 1, "ab", "c"), (8, 1, "a", "bc")]
    placed = place_turns(frame(spark, rows))
    assert trie_of(placed) == brute(own(rows))
    whole, convs = rebuild(placed)
    expected = rebuilt(rows)
    assert any(not turns for turns in expected.values())
    assert Counter(map(tuple, prefix_trie.prefix_trie(whole, convs).collect())) == brute(expected)
    nothing = place_turns(frame(spark, rows).limit(0))
    assert prefix_trie.prefix_trie(*rebuild(nothing)).count() == 0
