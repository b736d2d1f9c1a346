import random
import re

import pytest
from pyspark.sql import functions as F

from freshet.llm import decontaminate
from freshet.llm.decontaminate import find_contamination, without_spans


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def brute(rows, items):
    out = []
    for i, t, *_ in rows:
        w, hit, found = words_of(t), set(), set()
        for item, text in items:
            v = words_of(text)
            size = min(10, len(v))
            grams = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v and item is not None else set()
            for k in range(len(w) - size + 1):
                if size and tuple(w[k : k + size]) in grams:
                    hit |= set(range(k, k + size))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), sorted(found)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def bench(spark):
    return lambda items: spark.createDataFrame([(i, t, "k") for i, t in items], "item_id bigint, text string, gram string")


def case(prose):
    rng = random.Random(8)
    long = prose(50, 40)
    items = [(1, long), (2, "Just Four Words here"), (3, None), (4, "  !! "), (None, prose(51, 20)), (10, prose(52, 10)), (5, long), (6, "é-É naïve"), (1, long)]
    parts = [t for _, t in items if t]
    rows = []
    for k in range(60, 90):
        text = [prose(k, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(parts).split()
            text.append(" ".join(w[rng.randint(0, 3) :]).upper() if rng.random() < 0.3 else ", ".join(w[rng.randint(0, 3) :]))
        rows.append((k, "\n".join(text), "en", "x"))
    return rows, items


@pytest.mark.parametrize("broadcast", [True, False])
def test_equals_brute_force(table, hard_rows, bench, prose, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
        monkeypatch.setattr("freshet.llm.common.BROADCAST_ROWS", 0)
    rows, items = case(prose)
    rows += hard_rows
    out = find_contamination(table(rows), bench(items)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items) for r in out), key=str) == brute(rows, items)
    assert any(r.n_items > 2 for r in out) and any(0 < r.n_hit < 10 for r in out)


def test_spans_are_cut(table, bench, prose):
    long = prose(70, 25)
    rows = [(1, f"(Before) it: {long}! After.", "en", "x"), (2, f"{long}", "en", "x"), (3, "clean text", "en", "x"), (4, None, "en", "x")]
    docs = table(rows)
    found = find_contamination(docs, bench([(1, long)])).select("doc_id", F.col("spans").alias("cut"))
    out = {r.doc_id: r.t for r in docs.join(found, "doc_id").select("doc_id", without_spans(F.col("text"), F.col("cut")).alias("t")).collect()}
    assert out[1].split() == ["(Before)", "it:", "!", "After."] and out[2].strip() == "" and out[3] == "clean text" and out[4] is None


def test_empty(table, bench):
    assert find_contamination(table([]), bench([(1, "some words")])).count() == 0
    out = find_contamination(table([(1, "some words", "en", "x")]), bench([])).collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in out] == [(1, 2, 0, 0)]
