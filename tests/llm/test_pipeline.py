"""The stages against brute force, each on what the one before kept."""

import zlib
from collections import Counter

import numpy as np
import pytest
import test_decontaminate
import test_line_frequency
import test_minmax_dedup
from tokenizers import Tokenizer

import corpus_pipeline
from freshet.llm.token_store import default_vocabulary
from freshet.session import stage

FOOTER = "Every page ends with this very line, number 7"


@pytest.fixture(scope="module")
def inputs(spark, table, hard_rows, prose, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    item = prose(900, 30)
    rows = list(hard_rows)
    rows += [(100 + k, f"{prose(1000 + k, 40)}\n{FOOTER}", "en", "hot") for k in range(60)]
    rows += [(200, f"{prose(2000, 19)}\n{FOOTER}", "en", "hot"), (201, f"{prose(2001, 8)}\n{FOOTER} {FOOTER}", "en", "hot"), (202, "too short", "en", "small")]
    base = prose(3000, 90).split()
    rows += [(300 + k, " ".join([*base[:k], "changed", *base[k + 1 :]]), "en", ("hot", "small")[k % 2]) for k in range(8)]
    rows += [(400, base_text := prose(4000, 50), "en", "small"), (401, base_text, "en", "mid"), (402, base_text, "en", "mid")]
    rows += [(500, f"{prose(5000, 30)} {' '.join(item.split()[5:20])} {prose(5001, 30)}", "en", "mid"), (501, f"{prose(5002, 40)}", "en", None)]
    table(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, [(1, item), (2, None)]


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_stages(spark, inputs):
    folder, items = inputs
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, by_name, seen = docs.columns, dict(corpus_pipeline.STAGES), {}
    assert list(by_name) == ["quality rules", "near duplicates", "decontamination", "mixture", "token ids"]
    for name, step in by_name.items():
        before = rows_of(docs)
        docs, _ = stage(step(spark, docs, folder), "test-stage")
        if name == "token ids":
            break
        assert docs.columns == columns
        after = seen[name] = rows_of(docs)
        keys = Counter(k for k, *_ in after)
        if name == "quality rules":
            judged = test_line_frequency.brute(before, 50)
            assert sorted(keys.elements(), key=str) == sorted((k for k, *_, kept in judged if kept), key=str)
            # The footer stays in the first document that has it.
            assert [k for k, t, *_ in after if FOOTER in t] == [100]
            assert {200, 201, 202}.isdisjoint(keys) and keys[1] == 2
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "near duplicates":
            groups = {}
            for k, t, *_ in before:
                groups.setdefault(frozenset(test_minmax_dedup.set_of(t)), []).append(k)
            least = {c for _, _, c, _ in test_minmax_dedup.brute(before)}
            assert set(keys) == least and max(keys.values()) == 1
            assert {300, 400} <= set(keys) and not {301, 307, 401, 402} & set(keys)
        elif name == "decontamination":
            clean = [k for k, _, hit, *_ in test_decontaminate.brute(before, items) if not hit]
            assert sorted(keys.elements(), key=str) == sorted(clean, key=str) and 500 not in keys
        else:
            assert set(after) == set(before) and set(Counter(after).values()) <= {1, 2}
    encode = Tokenizer.from_file(default_vocabulary()).encode
    expected = [(k, [*encode(t or "", add_special_tokens=False).ids, 0]) for k, t, *_ in seen["mixture"]]
    got = sorted(docs.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(k for k, _ in expected)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((k, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for k, i in expected)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_run_over_no_documents(spark, table, tmp_path):
    table([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_boilerplate_is_told_by_share(spark, table, prose):
    # In 60 of 3000 texts of a host: more than 50, yet no boilerplate. In 8 of 20: boilerplate, yet fewer than 50.
    rows = [(k, prose(k, 25) + "\na common heading" * (k % 50 == 0), "en", "large") for k in range(3000)]
    rows += [(5000 + k, prose(5000 + k, 25) + "\na footer of ours" * (k < 8), "en", "small") for k in range(20)]
    after = {k: t for k, t, *_ in rows_of(corpus_pipeline.quality_rules(spark, table(rows), ""))}
    assert all(after[k] == t for k, t, *_ in rows if k < 5001)
    assert all("footer" not in after[5000 + k] for k in range(1, 20)) and len(after) == len(rows)


def test_near_duplicates_take_five_words(spark, table):
    words = [f"w{k}" for k in range(80)]
    other = [*words[:25], "x", *words[26:50], "y", *words[51:]]
    # 69 of 85 shingles of four words are shared (0.81), 66 of 86 of five (0.77); one changed word alone leaves 71 of 81.
    rows = [(1, " ".join(words), "en", "s"), (2, " ".join(other), "en", "s"), (3, " ".join([*words[:25], "z", *words[26:]]), "en", "t")]
    assert {k for k, *_ in rows_of(corpus_pipeline.near_duplicates(spark, table(rows[:2]), ""))} == {1, 2}
    assert {k for k, *_ in rows_of(corpus_pipeline.near_duplicates(spark, table(rows[::2]), ""))} == {1}
