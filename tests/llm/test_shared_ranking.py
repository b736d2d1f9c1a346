import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from freshet.llm.shared_ranking import Accumulators, Graph, _graph_rows, mine, rank_documents


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


def brute(docs, items, depth):
    held = [(k, Counter(words), len(words)) for k, text in docs if (words := terms(text))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for key, counts, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * counts[t] // (1000 * counts[t] + 12 * m))
                for t in terms(text) if counts[t]
            )
            if score > 0:
                found.append((-score, key is not None, key or 0, key))
        out += [(item, rank, key, -s) for rank, (s, _, _, key) in enumerate(sorted(found)[:depth], 1)]
    return Counter(out)


def expand(graph: Graph):
    """Each item's leaves and how often they come in."""

    def of(node):
        return Counter([node]) if node < len(graph.leaves) else sum((of(n) for n in graph.sums[node - len(graph.leaves)]), Counter())

    return {item: sum((of(n) for n in nodes), Counter()) for item, nodes in graph.items.items()}


@given(st.dictionaries(st.integers(0, 30), st.dictionaries(st.integers(0, 12), st.integers(1, 3), min_size=1), min_size=1, max_size=14))
@settings(max_examples=150, deadline=None)
def test_graph_holds_every_item_once(items):
    items = {k: Counter(v) for k, v in items.items()}
    graph = mine(items)
    assert {k: {graph.leaves[leaf]: n for leaf, n in v.items()} for k, v in expand(graph).items()} == {k: dict.fromkeys(v.items(), 1) for k, v in items.items()}
    assert graph.additions <= sum(len(v) - 1 for v in items.values())


def test_sharing_saves_additions():
    rng = random.Random(5)
    phrases = [rng.sample(range(400), 8) for _ in range(12)]
    items = {i: Counter(t for p in rng.sample(phrases, 4) for t in p) for i in range(80)}
    assert mine(items).additions < sum(len(v) - 1 for v in items.values()) / 3


@given(st.dictionaries(st.integers(0, 9), st.dictionaries(st.integers(0, 9), st.integers(1, 3), min_size=1), min_size=1, max_size=8), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_accumulators_equal_sums(items, seed):
    rng = np.random.default_rng(seed)
    gains = rng.integers(0, 1000, (7, 12)) * (rng.random((7, 12)) < 0.4)
    rows = pd.DataFrame([(0, i, t, n) for i, v in items.items() for t, n in v.items()], columns=["block", "item", "term", "times"])
    block = Accumulators(_graph_rows(rows))
    doc, term = np.nonzero(gains)
    found = block.scores(doc, term, gains[doc, term], 7)
    for item, scores in zip(block.items, found, strict=True):
        assert scores.tolist() == [sum(int(gains[d, t]) * n for t, n in items[item].items()) for d in range(7)]


@pytest.mark.parametrize("blocks", [(256, 16), (2, 1)])
def test_equals_brute_force(spark, table, hard_rows, blocks):
    rng = random.Random(8)
    words = ["the", "The", "été", "a1", "b", "c", "x-y", "日本", "zz", "q", "r", "s"]
    rows = hard_rows + [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 40))), "en", "s") for i in range(60)]
    # More ties than the ranking is deep.
    rows += [(300 - i, "tied words here", "en", "s") for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(7)]
    items += [(7, None), (8, ""), (9, "tied WORDS, tied"), (9, "b b c"), (None, "the, été"), (10, "absent"), (11, hard_rows[0][1])]
    found = rank_documents(
        table(rows), spark.createDataFrame([(*x, "n") for x in items], "item_id bigint, text string, score string"), depth=5, items_per_block=blocks[0], blocks_per_pass=blocks[1]
    )
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, found.collect())) == brute([(k, t) for k, t, _, _ in rows], items, 5)


def test_empty_tables(spark, table, hard_rows):
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert rank_documents(table([]), items).count() == 0
    assert rank_documents(table(hard_rows), items.limit(0)).count() == 0
    assert rank_documents(table([(1, "!", "en", "x"), (2, None, "en", "x")]), items).count() == 0
