import math
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from freshet.llm.mixing import Target, bisect_exponent, entropy, epochs, mix, weights
from freshet.llm.token_store import default_vocabulary

SIZES = st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(1, 10**9), min_size=1, max_size=8)


@given(SIZES, st.floats(0.05, 0.99))
def test_entropy_is_met_at_the_largest_exponent(sizes, wanted):
    exponent = bisect_exponent(sizes, Target(entropy=wanted))
    assert 0 <= exponent <= 1 and entropy(weights(sizes, exponent)) >= wanted - 1e-9
    if exponent < 1:
        assert entropy(weights(sizes, min(1, exponent + 1e-6))) < wanted + 1e-6


@given(SIZES, st.floats(1, 20))
def test_repetition_is_met_at_the_smallest_exponent(sizes, limit):
    exponent = bisect_exponent(sizes, Target(max_epochs=limit))
    assert max(epochs(sizes, exponent).values()) <= limit + 1e-6
    if exponent > 0:
        assert max(epochs(sizes, max(0, exponent - 1e-6)).values()) > limit - 1e-3


def test_shares_are_kept_or_levelled():
    sizes = {"a": 900, "b": 100}
    assert weights(sizes, 1) == pytest.approx({"a": 0.9, "b": 0.1}) and weights(sizes, 0) == {"a": 0.5, "b": 0.5}
    assert math.isclose(weights(sizes, 0.5)["a"] / weights(sizes, 0.5)["b"], 3)


def rows_of(prose):
    rows = [(k, prose(k, 5 + k % 17), "en", "big") for k in range(300)]
    return rows + [(1000 + k, prose(k, 30), "en", "mid") for k in range(30)] + [(2000 + k, prose(k, 9), "en", None) for k in range(10)]


def test_every_document_once_and_none_too_often(table, hard_rows, prose):
    rows = rows_of(prose) + hard_rows
    out = mix(table(rows), Target(max_epochs=3.0), block_size=200).collect()
    times = Counter((r.doc_id, r.source, r.size) for r in out)
    copies = Counter((k, s or "", max(1, len((t or "").split()))) for k, t, _, s in rows)
    # A long document may be begun once more than its source's share.
    assert set(times) == set(copies) and all(copies[d] <= n <= 4 * copies[d] for d, n in times.items())


def test_sizes_in_tokens(table, hard_rows, prose):
    # Texts without blanks are one word each, however long; the source's weight must follow their tokens.
    rows = [(k, prose(k, 400).replace(" ", "\t"), "en", "tabs") for k in range(20)] + [(100 + k, prose(k, 20), "en", "blanks") for k in range(20)] + hard_rows
    encode = Tokenizer.from_file(default_vocabulary()).encode
    size = lambda t: len(encode(t or "", add_special_tokens=False).ids) + 1
    out = mix(table(rows), Target(max_epochs=2.0), block_size=5000, tokens=True).collect()
    assert {(r.doc_id, r.source, r.size) for r in out} == {(k, s or "", size(t)) for k, t, _, s in rows}
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s or ""] += size(t)
    expected = weights(sizes, bisect_exponent(sizes, Target(max_epochs=2.0)))
    assert {r.source: round(r.weight, 9) for r in out} == {s: round(w, 9) for s, w in expected.items()}
    assert mix(table([]), Target(max_epochs=2.0), tokens=True).count() == 0


def test_budget_is_spent_by_weight(table, prose):
    rows = rows_of(prose)
    budget = 6000
    out = mix(table(rows), Target(entropy=0.8), budget=budget, block_size=150).collect()
    spent, sizes = defaultdict(int), defaultdict(int)
    for r in out:
        spent[r.source] += r.size
    for _, t, _, s in rows:
        sizes[s or ""] += len(t.split())
    exponent = bisect_exponent(sizes, Target(entropy=0.8))
    for s, w in weights(sizes, exponent).items():
        # The budget ends within a document.
        assert round(w * budget) <= spent[s] < round(w * budget) + 31
    assert {round(r.exponent, 12) for r in out} == {round(exponent, 12)}


def test_epochs_are_permutations_of_blocks(table, prose):
    out = mix(table(rows_of(prose)), Target(max_epochs=4.0), block_size=150).collect()
    order = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.source, r.epoch, r.block_place, r.place)):
        if r.block not in order[r.source, r.epoch]:
            order[r.source, r.epoch].append(r.block)
    first = {s: b for (s, e), b in order.items() if e == 0}
    assert len(first["big"]) > 5
    for (s, e), blocks in order.items():
        assert set(blocks) <= set(first[s])
        if e and len(first[s]) > 3:
            assert blocks != first[s][: len(blocks)]
    # No document twice in an epoch; a block's documents stand in one order.
    assert max(Counter((r.doc_id, r.epoch) for r in out).values()) == 1


def test_same_mixture_from_any_partitioning(table, prose):
    docs = table(rows_of(prose))
    a, b = (sorted(map(str, mix(d, Target(max_epochs=2.5), block_size=300).collect())) for d in (docs, docs.repartition(7)))
    assert a == b


def test_empty(table):
    assert mix(table([]), Target(max_epochs=2.0)).count() == 0
