"""Quality rules: line frequency across documents, with counts of words, symbols and repeats. DataFrame functions only.

For each host (source) and normalised line, the distinct texts that hold the line are counted. Lines in more than
``max_texts`` of them, and in more than ``max_percent`` of all distinct texts of the host, are boilerplate: they are removed everywhere but in the host's first document that has them. A
document that the removal depletes is rejected. Copies of one text count once: they are no sign of boilerplate, and which
copy stays is for deduplication to say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import count_rows, identity, join_counted, once, row_key
from freshet.session import stage

#: A host's line is boilerplate in more than this percentage of its distinct texts, and in more than a few: alike at every size.
SHARE_PERCENT, SHARE_FLOOR = 5, 5
#: A document is depleted when fewer words than this remain ...
MIN_WORDS = 20
#: ... or, in percent, less of its words than this.
MIN_PERCENT = 20

SPACE = "[ \\t-\\r]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def split_words(text: Column) -> Column:
    """Runs of characters that are no ASCII white space."""
    return F.array_remove(F.split(text, SPACE), "")


def normalised(line: Column) -> Column:
    """Letters in lower case, white space runs as one blank, none at the ends, digits as 0."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), SPACE, " ")), "[0-9]+", "0")


def count_characters(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def with_repeat_words(rows: DataFrame) -> DataFrame:
    """Add n_repeat_words: words inside windows of ``WINDOW`` words that occur twice or more in the text, the first
    occurrence included. Needs ``words`` and ``n_words``.

    Windows are compared by hash. Most texts repeat none; only where the distinct hashes are fewer than the windows are
    the repeated ones sought, by sorting (hash, place) and looking at neighbours. Each step is a column of its own, so
    that no lambda computes an array anew.
    """
    count = F.col("n_words") - (WINDOW - 1)
    rows = once(rows, hashed=F.transform("words", lambda w: F.xxhash64(w)))
    windows = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice("hashed", i, WINDOW)))
    rows = once(rows, windows=F.when(count > 1, windows)).drop("hashed")
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = once(rows, placed=F.when(repeats, F.sort_array(pairs))).drop("windows")

    def same(k: Column, other: Column) -> Column:
        return F.coalesce(F.get("placed", k)["h"] == F.get("placed", other)["h"], F.lit(False))

    places = F.filter(F.sequence(F.lit(0), F.size("placed") - 1), lambda k: same(k, k - 1) | same(k, k + 1))
    starts = F.sort_array(F.transform(places, lambda k: F.get("placed", k)["i"]))
    rows = once(rows, starts=F.when(F.col("placed").isNotNull(), starts)).drop("placed")

    def add(state: Column, start: Column) -> Column:
        # Each window adds the words that lie beyond the window before it.
        fresh = F.least(F.lit(WINDOW), start + WINDOW - state["stop"])
        return F.struct((start + WINDOW).alias("stop"), (state["n"] + fresh).cast("bigint").alias("n"))

    zero = F.struct(F.lit(0).alias("stop"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate("starts", zero, add, lambda s: s["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("starts")


def measure(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """One row for each document: counts, base verdict, hash of the text, and its lines as (hash, words)."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("text"), *identity(key, text))
    rows = once(rows, words=split_words(whole), lines=F.filter(F.split(whole, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]")))
    rows = with_repeat_words(once(rows, n_words=F.size("words")))
    counted = {
        "word_chars": (F.char_length(whole) - count_characters(whole, SPACES)).cast("bigint"),
        "n_symbols": count_characters(whole, SYMBOLS).cast("bigint"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
        "text_hash": F.xxhash64("text"),
        "line_list": F.transform("lines", lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.size(split_words(x)).alias("words"))),
    }
    rows = once(rows, **counted).drop("text", "words", "lines").withColumn("n_words", F.col("n_words").cast("bigint"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return row_key(rows.withColumn("base_failed", failed))


def frequent_lines(measured: DataFrame, max_texts: int = SHARE_FLOOR, max_percent: int = SHARE_PERCENT) -> DataFrame:
    """Lines of a host in more than ``max_texts`` distinct texts and more than ``max_percent`` of the host's: host, line,
    first (the least key that has it).

    Counted in two sums, by (host, line, text) and by (host, line): a line that stands everywhere is dealt by its texts
    first, and what meets in one task are counts.
    """
    lines = measured.select("host", "key", "text_hash", F.explode(F.array_distinct("line_list.line")).alias("line"))
    texts = lines.groupBy("host", "line", "text_hash").agg(F.min("key").alias("key"))
    found = texts.groupBy("host", "line").agg(F.count("*").alias("n"), F.min("key").alias("first")).filter(F.col("n") > max_texts)
    if max_percent:
        all_texts = measured.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("texts"))
        all_texts, folder = stage(all_texts, "host-texts")
        found = join_counted(found, all_texts, ["host"], "inner", count_rows(measured.sparkSession, folder))
        found = found.filter(100 * F.col("n") > max_percent * F.col("texts")).drop("texts")
    return found.drop("n")


def judge(
    docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_texts: int = SHARE_FLOOR,
    min_words: int = MIN_WORDS, min_percent: int = MIN_PERCENT, max_percent: int = 0,
) -> DataFrame:
    """A row for each document: ``key``, its identity, text_hash, the counts, base_failed, n_removed (words in boilerplate lines),
    removed (hashes of those lines) and kept.

    Null text has no words and fails; a null host is one host of its own; repeated rows keep a row each and get one
    verdict; an empty table gives none. Equal keys share the first-document privilege. Other columns are ignored.
    """
    spark = docs.sparkSession
    measured, folder = stage(measure(docs, key, text, host), "line-measures")
    frequent, frequent_folder = stage(frequent_lines(measured, max_texts, max_percent), "frequent-lines")
    lines = measured.filter(F.size("line_list") > 0).select("_row", "host", "key", F.inline("line_list"))
    hits = join_counted(lines, frequent, ["host", "line"], "inner", count_rows(spark, frequent_folder))
    hits = hits.filter(~F.col("key").eqNullSafe(F.col("first")))
    removed = hits.groupBy("_row").agg(F.sum("words").alias("n_removed"), F.collect_set("line").alias("removed"))
    rows = measured.drop("line_list", "host").join(removed, "_row", "left").drop("_row")
    gone = F.coalesce(F.col("n_removed"), F.lit(0))
    left = F.col("n_words") - gone
    depleted = (gone > 0) & ((left < min_words) | (100 * left < min_percent * F.col("n_words")))
    return rows.withColumn("n_removed", gone.cast("bigint")).withColumn("kept", ~(F.col("base_failed") | depleted)).withColumnRenamed("key", key)


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose hashes are in ``removed``."""
    lines = F.split(text, "\n", -1)
    stays = F.filter(lines, lambda x: ~F.array_contains(removed, F.xxhash64(normalised(x))) | ~x.rlike("[^ \\t-\\r]"))
    return F.when(removed.isNull() | (F.size(removed) == 0), text).otherwise(F.array_join(stays, "\n"))


def line_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), max_texts=SHARE_FLOOR, max_percent=SHARE_PERCENT)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")


def oracle_sql() -> str:
    """The query in SQL, with the same parameters."""
    space, white = "[ \\t\\n\\x0B\\f\\r]+", "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
    norm = f"regexp_replace(trim(regexp_replace(lower(l), '{space}', ' ', 'g')), '[0-9]+', '0', 'g')"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id) AS r,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{space}'), lambda x: x <> '') AS w FROM documents),
ln AS (
  SELECT r, host, doc_id, t, l, {norm} AS nl, len(list_filter(regexp_split_to_array(l, '{space}'), lambda x: x <> '')) AS lw
  FROM (SELECT r, host, doc_id, t, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r]')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM ln GROUP BY r),
win AS (SELECT r, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win), (SELECT unnest(range({WINDOW})) AS o) WHERE c > 1 GROUP BY r),
ht AS (SELECT host, count(DISTINCT t) AS texts FROM d GROUP BY host),
fr AS (
  SELECT host, nl, first FROM (SELECT host, nl, min(doc_id) AS first, count(DISTINCT t) AS n FROM ln GROUP BY host, nl) JOIN ht USING (host)
  WHERE n > {SHARE_FLOOR} AND 100 * n > {SHARE_PERCENT} * texts),
gone AS (SELECT r, sum(lw) AS n FROM ln JOIN fr USING (host, nl) WHERE doc_id IS DISTINCT FROM first GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, length(t) - length(regexp_replace(t, '[^ \\t\\n\\x0B\\f\\r]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    coalesce(gone.n, 0) AS n_removed
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_removed > 0 AND (n_words - n_removed < {MIN_WORDS} OR 100 * (n_words - n_removed) < {MIN_PERCENT} * n_words)) AS kept,
  CAST(n_removed AS BIGINT) AS n_removed
FROM m
"""
