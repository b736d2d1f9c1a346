"""Benchmark decontamination: a broadcast hash set of the benchmark's n-grams against every token window of the corpus.
DataFrame functions only.

Items are cut into windows of ``WINDOW`` words (an item of fewer words is one window). Each document's windows are hashed
and looked up in the set of item windows; a hit is verified word by word. The set is broadcast when its counted rows are
few; otherwise windows and set are joined by shuffle, with a digest in place of the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import BROADCAST_ROWS, count_rows, identity, join_counted, once, row_key
from freshet.session import stage

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, once A-Z are in lower case: all of ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP), "")


def windows(n_words: Column, length: int) -> Column:
    """Hashes of all windows of that many words, by place (from 1); none if the text is shorter."""
    places = F.when(n_words >= length, F.sequence(F.lit(1), n_words - (length - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("place"), F.lit(length).alias("length"), F.xxhash64(F.slice("hashed", i, length)).alias("h")))


def with_words(df: DataFrame, text: str) -> DataFrame:
    """Add words, n_words, and the words' hashes; null text has no words."""
    df = once(df, words=split_words(F.coalesce(F.col(text), F.lit(""))))
    return once(df, hashed=F.transform("words", lambda w: F.xxhash64(w)), n_words=F.size("words"))


def gram_text(place: Column, length: Column) -> Column:
    return F.array_join(F.slice("words", place, length), " ")


def item_grams(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(h, gram, length, item) of every window of every item."""
    items = with_words(benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")), "text")
    items = items.filter("n_words > 0 and item is not null").withColumn("length", F.least(F.lit(WINDOW), F.col("n_words")))
    places = F.sequence(F.lit(1), F.col("n_words") - F.col("length") + 1)
    items = items.withColumn("place", F.explode(places))
    gram = gram_text(F.col("place"), F.col("length"))
    return items.select(F.xxhash64(F.slice("hashed", F.col("place"), F.col("length"))).alias("h"), gram.alias("gram"), "length", "item").distinct()


def find_hits(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str) -> tuple[DataFrame, DataFrame, int]:
    """A written table with a row for each document (place null) and for each verified hit; the item windows, and their
    number."""
    spark = docs.sparkSession
    grams, grams_folder = stage(item_grams(benchmark, item, item_text), "item-grams")
    rows = count_rows(spark, grams_folder)
    # At most WINDOW lengths.
    lengths = sorted(r.length for r in grams.select("length").distinct().collect())
    wanted = grams.select("h", F.col("gram").alias("wanted")).distinct()
    texts = row_key(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *identity(key, text)))
    texts = with_words(texts, "text").drop("text")
    none = F.array(F.struct(F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("bigint").alias("h")))
    every = F.concat(*[windows(F.col("n_words"), n) for n in lengths], none)
    exploded = once(texts, every=every).select("_row", "key", "id_a", "id_b", "n_words", "words", F.inline("every"))
    if rows <= BROADCAST_ROWS:
        found = exploded.join(F.broadcast(wanted), "h", "left")
        found = found.filter(F.col("place").isNull() | (F.col("wanted") == gram_text(F.col("place"), F.col("length"))))
    else:
        digest = F.md5(gram_text(F.col("place"), F.col("length")))
        narrow = exploded.select("_row", "key", "id_a", "id_b", "n_words", "place", "length", "h", digest.alias("digest"))
        found = narrow.join(wanted.withColumn("digest", F.md5("wanted")), ["h", "digest"], "left").filter("place is null or wanted is not null")
    found, _ = stage(found.select("_row", "key", "id_a", "id_b", "n_words", "place", "length", F.col("wanted").alias("gram")), "window-hits")
    return found, grams.select("gram", "item").distinct(), rows


def covered(spans: Column) -> Column:
    """Words inside any of the spans (place, length)."""

    def add(state: Column, span: Column) -> Column:
        stop = span["place"] + span["length"]
        fresh = F.greatest(F.lit(0), stop - F.greatest(state["stop"], span["place"]))
        return F.struct(F.greatest(state["stop"], stop).alias("stop"), (state["n"] + fresh).cast("bigint").alias("n"))

    zero = F.struct(F.lit(0).alias("stop"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(F.sort_array(spans), zero, add, lambda s: s["n"])


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """A row for each document: ``key``, its identity, n_words, n_hit (words inside item windows), n_items, items (sorted as strings)
    and spans (place from 1 and length, in words).

    Null text has no words; items without a word or id match nothing; repeated documents keep a row each, repeated items
    count once; empty tables give no rows or no hits. Other columns are ignored.
    """
    found, gram_items, rows = find_hits(docs, benchmark, key, text, item, item_text)
    hits = found.filter("place is not null")
    spans = hits.groupBy("_row").agg(F.collect_list(F.struct("place", "length")).alias("spans"))
    pairs = join_counted(hits.select("_row", "gram").distinct(), gram_items, ["gram"], "inner", rows).select("_row", "item").distinct()
    items = pairs.groupBy("_row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    every = found.filter("place is null").select("_row", "key", "id_a", "id_b", F.col("n_words").cast("bigint").alias("n_words"))
    out = every.join(spans, "_row", "left").join(items, "_row", "left").drop("_row").withColumnRenamed("key", key)
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        key, "id_a", "id_b", "n_words", F.coalesce(covered(F.col("spans")), F.lit(0).cast("bigint")).alias("n_hit"), F.size(listed).cast("bigint").alias("n_items"),
        listed.alias("items"), F.coalesce("spans", F.array().cast("array<struct<place:int,length:int>>")).alias("spans"),
    )


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words inside ``spans``; what stands between words stays. A column of one text and its spans."""
    pieces = F.regexp_extract_all(text, F.lit(f"({GAP.replace('x60', 'x40').replace('x7B', 'x5B-\\x60\\x7B')}|[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+)"), F.lit(1))
    first_is_gap = F.element_at(pieces, 1).rlike("^" + GAP.replace("x60", "x40").replace("x7B", "x5B-\\x60\\x7B"))
    shift = F.when(first_is_gap, 0).otherwise(1)

    def stays(piece: Column, k: Column) -> Column:
        word = F.floor((k + shift + 1) / 2)
        is_word = (k + shift) % 2 == 1
        return ~(is_word & F.exists(spans, lambda s: (s["place"] <= word) & (word < s["place"] + s["length"])))

    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.filter(pieces, stays), ""))


def contamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def oracle_sql() -> str:
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT item, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
win AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
hit AS (SELECT doc_id, win.n, i, item FROM win JOIN g ON g.gram = win.gram AND g.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
