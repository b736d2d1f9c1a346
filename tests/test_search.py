"""The search index against a scan."""

import random

from pyspark.sql import functions as F

from freshet.functions.text import display_title, matches_query
from freshet.sources import search
from freshet.sources.search import SearchIndex

ITEMS = "site_id string, ord int, title string, url string"


def test_search_equals_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BUCKETS", 32)
    rng = random.Random(3)
    syllables = ["ka", "to", "ri", "mu", "se", "Ä", "ß", "日本", "語", "-", "%"]
    rows = [(f"s{s}", n, "".join(rng.choices(syllables, k=rng.randint(1, 9))), f"https://s{s}.test/{n}") for s in range(9) for n in range(40)]
    rows += [("s1", 90, "", "https://s1.test/caf%C3%A9/katori"), ("s1", 91, None, "https://s1.test/"), ("s2", 92, "  KATORI  ", "u"), ("s2", 93, "x", "u2")]
    items = spark.createDataFrame(rows, ITEMS)
    index = SearchIndex(spark, str(tmp_path / "index")).build(items)
    whole = items.withColumn("text", display_title(F.col("title"), F.col("url")))
    for query in ("katori", " KaTo ", "日本語", "日本", "x", "", "café", "ß-", "%%%", "no such thing", "tototototo", "a"):
        want = whole.filter(matches_query(F.col("text"), query)).select("site_id", "ord").collect()
        found = index.search(query)
        assert found.columns == items.columns and sorted(map(tuple, found.select("site_id", "ord").collect())) == sorted(map(tuple, want)), query


def test_a_search_reads_its_own_lists(spark, tmp_path):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    items = spark.createDataFrame([(f"s{n % 7}", n, "".join(rng.choices(letters, k=24)), f"https://t.test/{n}") for n in range(1500)] + [("s0", 9999, "quixotic voyage", "u")], ITEMS)
    index = SearchIndex(spark, str(tmp_path / "index")).build(items)
    postings = spark.read.parquet(f"{index.path}/postings")
    piece = [r[0] for r in spark.createDataFrame([(p,) for p in index._wanted("quix")], "p string").select(search._bucket(F.col("p"))).collect()]
    assert postings.filter(F.col("bucket").isin(piece)).count() < postings.count() / 10
    assert index.search("quix").count() >= 1 and index.search("Quixotic").select("ord").collect()[0][0] == 9999


def test_an_empty_index(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "none")).build(spark.createDataFrame([], ITEMS))
    assert index.candidates("abc").count() == 0
