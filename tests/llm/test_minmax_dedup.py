import random
import re

import numpy as np
import pytest

from freshet.llm import minmax_dedup as mm
from freshet.llm.minmax_dedup import components, min_max, near_duplicates, shingles, superfluous


def set_of(text):
    w = [x for x in re.split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    """(key, n, component, kept) with links over all pairs."""
    sets = [set_of(t) for _, t, *_ in rows]
    comp = list(range(len(rows)))

    def root(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * len(sets[a] | sets[b]):
                comp[root(a)] = root(b)
    least = {}
    for a, (k, *_) in enumerate(rows):
        if k is not None and sets[a]:
            least[root(a)] = min(k, least.get(root(a), k))
    out = []
    for a, (k, *_) in enumerate(rows):
        c = least.get(root(a)) if sets[a] else k
        out.append((k, len(sets[a]), c, k == c))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in frame.collect()), key=str)


def edited(words, rng, share):
    return " ".join(f"e{rng.randint(0, 10**9)}" if rng.random() < share else w for w in words)


def cases(prose):
    rng = random.Random(4)
    rows, k = [], 1000
    # Copies edited to all degrees around the threshold, a chain of small changes, texts that share a passage, short texts.
    for g in range(5):
        base = prose(200 + g, 120).split()
        for _ in range(25):
            rows.append((k := k + rng.randint(1, 3), edited(base, rng, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05])), "en", "x"))
    chain = prose(300, 100).split()
    for step in range(20):
        chain[5 * step % 100] = f"c{step}"
        rows.append((k := k + 1, " ".join(chain), "en", "x"))
    passage = prose(301, 60)
    rows += [(k := k + 1, f"{passage} {prose(400 + j, rng.randint(5, 80))}", "en", "x") for j in range(40)]
    rows += [(k := k + 1, t, "en", "x") for t in ("a b c", "A  b\tc", "a b", "a b c d", "a b c d e", "a b c d e f g h", "x a b c d e f g h", "É b c", "é b c", "a b c\x1c")]
    rows += [(k := k + 1, rows[3][1], "en", "x") for _ in range(30)]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(table, hard_rows, prose):
    rows = cases(prose) + hard_rows
    rows = [r for r in rows if r[:2] != (1, "another text under one id")]
    assert got(near_duplicates(table(rows))) == brute(rows)


def test_rest_of_buckets_is_compared_whole(table, prose, monkeypatch):
    """With small blocks and a poor choice of hubs the components are the same."""
    monkeypatch.setattr(mm, "BLOCK", 4)
    monkeypatch.setattr(mm, "BROADCAST_IDS", 0)
    stars = mm.NearDuplicates.stars
    monkeypatch.setattr(mm.NearDuplicates, "stars", lambda self, members, common: stars(self, members, common).limit(3))
    rows = cases(prose)
    assert got(near_duplicates(table(rows))) == brute(rows)


def test_one_of_each_group_stays(table, prose):
    rows = cases(prose)
    out = near_duplicates(table(rows)).withColumnRenamed("doc_id", "key")
    gone = superfluous(out).count()
    assert len(rows) - gone == len({c for _, _, c, _ in brute(rows)})


def test_values_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:2400], rng.integers(0, 2**63, 600, dtype=np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    equal = min_max(a) == min_max(b)
    assert abs(equal.mean() - true) < 0.1
    half = len(equal) // 2
    assert abs(equal[:half].mean() - true) < 0.13 and abs(equal[half:].mean() - true) < 0.13


def test_bands_use_each_permutation_once():
    permutation = np.concatenate([np.arange(mm.VALUES // 2)] * 2).reshape(mm.BANDS, mm.ROWS)
    assert all(len(set(row)) == mm.ROWS for row in permutation.tolist())
    assert (1 - 0.8**mm.ROWS) ** mm.BANDS < 1e-8


@pytest.mark.parametrize("n", [2, 40])
def test_components_of_paths_and_stars(spark, n):
    name = lambda k: f"{k * 7919 % 10007:05d}".encode()
    path = [(name(k), name(k + 1)) for k in range(n)]
    star = [(b"z0", b"z%d" % (k + 1)) for k in range(n)]
    out = {bytes(r.node): bytes(r.comp) for r in components(spark.createDataFrame(path + star, "a binary, b binary")).collect()}
    assert {out[name(k)] for k in range(n + 1)} == {min(name(k) for k in range(n + 1))}
    assert {v for k, v in out.items() if k.startswith(b"z")} == {b"z0"}


def test_shingle_sets():
    for text in (None, "", " \t", "One two", "a b c d", "a b c d a b c d", "É é " * 9, "x " * 5000):
        assert len(shingles(text)) == len(set_of(text))


def test_empty(table):
    assert near_duplicates(table([])).count() == 0
    assert got(near_duplicates(table([(5, None, "en", "x"), (6, "", "en", "x")]))) == [(5, 0, 5, True), (6, 0, 6, True)]
