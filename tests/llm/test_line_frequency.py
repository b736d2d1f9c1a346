import random
import re
from collections import Counter, defaultdict

from freshet.llm.line_frequency import judge, line_quality_query, without_lines

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    return [w for w in re.split("[ \t-\r]+", text) if w]


def normal(line):
    return re.sub("[0-9]+", "0", re.sub("[ \t-\r]+", " ", line.lower()).strip(" "))


def brute(rows, max_texts, min_words=20, min_percent=20):
    holders, first = defaultdict(set), {}
    for i, t, _, s in rows:
        for line in (t or "").split("\n"):
            if words_of(line):
                at = (s or "", normal(line))
                holders[at].add(t)
                if i is not None:
                    first[at] = min(i, first.get(at, i))
    out = []
    for i, t, _, s in rows:
        text = t or ""
        w = words_of(text)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {k + o for k in range(len(w) - 7) for o in range(8) if windows[tuple(w[k : k + 8])] > 1}
        lines = [x for x in text.split("\n") if words_of(x)]
        gone = sum(len(words_of(x)) for x in lines if len(holders[s or "", normal(x)]) > max_texts and (i is None or first.get((s or "", normal(x))) != i))
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        depleted = gone and (len(w) - gone < min_words or 100 * (len(w) - gone) < min_percent * len(w))
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed, gone, not (failed or depleted)))
    return sorted(out, key=str)


def test_equals_brute_force(table, hard_rows, prose):
    rng = random.Random(5)
    rows = list(hard_rows)
    for k in range(40, 100):
        lines = [prose(k, rng.randint(1, 40)) for _ in range(rng.randint(1, 4))]
        lines += rng.sample(["All rights  reserved by nobody 2024", "Read more <here> & now | then", "all RIGHTS reserved by nobody 7"], rng.randint(0, 3))
        if k % 7 == 0:
            lines.append(lines[0])
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines), "en", rng.choice(["x", "y", None])))
    rows += [(200 + k, "\n".join([f"shared line of boilerplate number {k % 3} " * 5] * 1 + [f"w{k}"]), "en", "z") for k in range(12)]
    rows += [(300 + k, "a copy of one text is no boilerplate at all " * 1 + prose(7, 30), "en", "c") for k in range(9)]
    out = judge(table(rows), max_texts=3).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_removed, r.kept) for r in out), key=str)
    assert got == brute(rows, 3)
    assert any(r.n_removed for r in out) and any(not r.kept and not r.base_failed for r in out)
    assert all(r.kept for r in out if r.doc_id and r.doc_id >= 300)


def test_repeated_windows_overlap(table):
    base = " ".join(f"w{k}" for k in range(12))
    rows = [(1, base + " x " + base, "en", "s"), (2, "a " * 40, "en", "s"), (3, " ".join(f"u{k}" for k in range(60)) + " " + base + " y " + base, "en", "s")]
    out = judge(table(rows)).collect()
    assert sorted(((r.doc_id, r.n_repeat_words) for r in out)) == [(i, n) for i, _, _, _, _, n, *_ in brute(rows, 50)]


def test_lines_are_removed(spark, table, prose):
    line = "the same footer everywhere"
    rows = [(k, f"{prose(k, 50)}\n{line} \n\nend {k} {prose(100 + k, 5)}", "en", "s") for k in range(8)]
    docs = table(rows)
    judged = judge(docs, max_texts=5).select("doc_id", "removed", "kept")
    from pyspark.sql import functions as F

    out = {r.doc_id: r.t for r in docs.join(judged.withColumnRenamed("kept", "ok"), "doc_id").select("doc_id", without_lines(F.col("text"), F.col("removed")).alias("t")).collect()}
    assert out[0] == rows[0][1]
    assert all(out[k] == rows[k][1].replace(f"{line} \n", "") for k in range(1, 8))


def test_share_is_alike_at_every_size(table, prose):
    # A footer of a tenth of the texts goes, a heading of a fiftieth stays, in a host of 100 texts as in one of 3000.
    for n in (100, 3000):
        rows = []
        for k in range(n):
            extra = ["the footer of this very host"] * (k % 10 == 0) + ["a heading"] * (k % 50 == 1)
            rows.append((k, "\n".join([prose(k, 25), *extra]), "en", "hot"))
        out = {r.doc_id: r for r in judge(table(rows), max_texts=5, max_percent=5).collect()}
        assert [k for k, r in out.items() if r.n_removed == 6] and {k for k, r in out.items() if r.n_removed} == set(range(10, n, 10)), n
        assert all(r.kept for r in out.values())


def test_op7_where_it_fires(spark, table, prose, tmp_path):
    rows = [(k, f"{prose(k, 25)}\nthe footer of this very host" if k < 60 else prose(k, 25), "en", "hot") for k in range(90)]
    table(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_removed, r.kept) for r in line_quality_query(spark, str(tmp_path)).collect())
    assert got == sorted(brute(rows, 50)) and sum(r[7] > 0 for r in got) == 59


def test_empty(table):
    assert judge(table([])).count() == 0
