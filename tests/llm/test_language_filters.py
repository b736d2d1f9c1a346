import zlib

import numpy as np

from freshet.llm.language_filters import HASHES, SLOTS, decide, grams, language_query, predict, train

SF = "/root/testdata/sf0.01"


def brute_grams(text):
    clean = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + "   "
    return [clean[i : i + 4] for i in range(len(clean) - 3) if clean[i + 1] != " "]


def test_grams_equal_brute_force():
    texts = ["", "a", "Ab, cd!", "é1x", " \n", "𝔘nï" * 3, "word " * 50]
    hashes, owner = grams(texts)
    assert np.bincount(owner, minlength=len(texts)).tolist() == [len(brute_grams(t)) for t in texts]
    names: dict[str, int] = {}
    for i, t in enumerate(texts):
        for g, h in zip(brute_grams(t), hashes[owner == i].tolist(), strict=True):
            assert names.setdefault(g, h) == h
    assert len(set(names.values())) == len(names)


def test_held_out_accuracy(spark):
    out = language_query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    assert len(out) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in out)


def test_hard_rows(spark, table, hard_rows, prose):
    train_rows = [(k, "der die das und " * 20, "de", "x") for k in range(3)] + [(k, "the and of with " * 20, "en", "x") for k in range(3)] + [(9, None, "fr", "x"), (10, "no label", None, "x")]
    filters = train(table(train_rows))
    assert filters.languages == ["de", "en"]
    docs = table([*hard_rows, (30, "das und die", "en", "x"), (31, "12 !?", "en", "x"), (32, "with the", None, None)])
    out = predict(docs, filters).collect()
    assert len(out) == len(hard_rows) + 3 and "text" not in out[0].asDict()
    got = {r.doc_id: r.lang_pred for r in out}
    assert (got[30], got[31], got[32], got[3], got[4], got[5]) == ("de", "und", "en", "und", "und", "und")
    assert predict(table([]), filters).count() == 0


def test_chance_is_taken_off(table):
    filters = train(table([(1, "der die das und nicht", "de", "x"), (2, "the and of with", "en", "x")]))
    bits = np.array([np.count_nonzero(filters.masks[0] >> np.uint64(k) & np.uint64(1)) for k in (0, 1)])
    assert np.allclose(filters.chance, (bits / SLOTS) ** HASHES)
    # Unknown n-grams: nobody is ahead, the first name is taken with score 0.
    assert [x[0] for x in decide(filters, ["qqqqzzzz"])] == ["de", 0.0]


def test_no_training_rows(table):
    filters = train(table([(1, None, None, None)]))
    assert predict(table([(1, "text", "en", "x")]), filters).collect()[0].lang_pred == "und"
