"""Quotation linking: conversations in reply order, without quotes. DataFrame functions only.

A line's quote level is the number of ``>`` before its text. Adjacent lines of one level are a passage: its words, in lower
case and without what stands between them, are hashed in windows of ``WINDOW`` words, or as one if they are fewer. The
messages' own text is hashed alike, by its unquoted passages, and by its lines where these are short. A passage comes from
the message by which the last of its windows was first written, if that message holds them all; so quotes that are wrapped
anew, or that give a part, find their origin. A passage without one is tried line by line. A message answers the latest
message among the origins of its first-level quotes; deeper levels are links too. Messages that answer one another form a
thread; threads stand in the order of their first message, messages in a thread in the order they were written.

A conversation, a passage or a thread may hold any share of the rows: first writers are least turns by (conversation,
window), summed before they are dealt; thread starts are found by doubling steps; places are counted by ranges of the order, never
over a whole conversation in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from freshet.llm.common import count_rows, join_counted, join_to_one, once, row_key
from freshet.session import drop_staged, stage

#: Words in a window. A shorter passage must be a whole passage or line of its origin.
WINDOW = 5
QUOTE = "^((?:[ \\t]*>)+)"


def normalised(line: Column) -> Column:
    """Lower case, one blank for each run of anything but letters and digits, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), "[^\\p{L}\\p{N}]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """(_row, conv, turn, run, level, lines) of every passage that has a letter or digit: its lines' normalised words, lines
    without any as empty ones."""
    rows = once(messages.select("_row", "conv", "turn", "text"), line=F.split("text", "\n", -1)).drop("text").filter("line is not null")
    marks = F.transform("line", lambda x: F.regexp_extract(x, QUOTE, 1))
    levels = F.transform(marks, lambda m: F.char_length(m) - F.char_length(F.replace(m, F.lit(">"), F.lit(""))))
    rows = once(rows, levels=levels, bodies=F.transform("line", lambda x: normalised(F.regexp_replace(x, QUOTE, "")))).drop("line")
    # A passage is one string, its lines between marks: normalised text holds no control characters.
    level = lambda i: F.get("levels", i)
    piece = F.transform(
        "bodies", lambda body, i: F.when((i > 0) & (level(i) == level(i - 1)), F.concat(F.lit("\x01"), body)).otherwise(F.concat(F.lit("\x03"), level(i).cast("string"), F.lit("\x02"), body))
    )
    found = rows.select("_row", "conv", "turn", F.posexplode(F.split(F.array_join(piece, ""), "\x03")).alias("run", "passage"))
    found = found.filter(F.regexp_replace(F.substring_index("passage", "\x02", -1), "[\x01 ]", "") != "")
    lines = F.split(F.substring_index("passage", "\x02", -1), "\x01")
    return found.select("_row", "conv", "turn", "run", F.substring_index("passage", "\x02", 1).cast("int").alias("level"), lines.alias("lines"))


def windows(rows: DataFrame, words: Column) -> DataFrame:
    """Add ``windows``: the distinct hashes of the windows of a list of words, or of the whole where it is shorter."""
    rows = once(rows, _hashed=F.transform(words, lambda w: F.xxhash64(w)))
    each = F.transform(F.sequence(F.lit(1), F.size("_hashed") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_hashed", i, WINDOW)))
    found = F.when(F.size("_hashed") < WINDOW, F.array(F.xxhash64("_hashed"))).otherwise(F.array_distinct(each))
    return once(rows, windows=found).drop("_hashed")


def _words(lines: Column) -> Column:
    return F.array_remove(F.split(F.array_join(lines, " "), " "), "")


def own_windows(found: DataFrame) -> DataFrame:
    """(conv, turn, hash) of what messages wrote themselves."""
    own = found.filter("level = 0 AND turn is not null").select("conv", "turn", "lines")
    whole = windows(own, _words(F.col("lines"))).select("conv", "turn", F.explode("windows").alias("hash"))
    short = own.filter(F.size("lines") > 1).select("conv", "turn", F.explode("lines").alias("line")).filter("line != ''")
    short = windows(short.filter(F.size(F.split("line", " ")) < WINDOW), F.split("line", " ")).select("conv", "turn", F.explode("windows").alias("hash"))
    return whole.unionByName(short)


def link_quotes(rows: DataFrame) -> DataFrame:
    """(_row, conv, turn, level, origin) of every quoted line that has a letter or digit; the origin is a turn before, or null."""
    found, _ = stage(passages(rows), "passages")
    quoted = found.filter("level > 0")
    convs, folder = stage(quoted.select("conv").distinct(), "quoting")
    own = own_windows(join_counted(found.filter("level = 0"), convs, ["conv"], "left_semi", count_rows(rows.sparkSession, folder)))
    lines = quoted.select("_row", "conv", "turn", "run", "level", F.posexplode("lines").alias("line", "body")).filter("body != ''")
    units = lines.select("_row", "conv", "turn", "run", "line", F.split("body", " ").alias("words"))
    several = F.size(F.filter("lines", lambda x: x != "")) > 1
    units = units.unionByName(quoted.filter(several).select("_row", "conv", "turn", "run", F.lit(-1).alias("line"), _words(F.col("lines")).alias("words")))
    units = windows(units, F.col("words")).select("_row", "conv", "turn", "run", "line", F.size("windows").alias("n"), F.explode("windows").alias("hash"))
    units, _ = stage(units, "quote-windows")

    unit = ["_row", "run", "line"]
    first = own.groupBy("conv", "hash").agg(F.min("turn").alias("first"))
    met, _ = stage(join_to_one(units, first, ["conv", "hash"]), "first-writers")
    whole = met.groupBy(*unit, "conv", "turn", "n").agg(F.count("*").alias("found"), F.max("first").alias("origin")).filter("found = n AND origin < turn")
    whole, _ = stage(whole.select(*unit, "conv", "origin"), "origins")
    # What was first written before the origin must stand in the origin too.
    earlier = met.select(*unit, "hash", "first").join(whole, unit).filter("first < origin").select(*unit, "conv", "origin", "hash")
    lacking = earlier.join(own.select("conv", F.col("turn").alias("origin"), "hash"), ["conv", "origin", "hash"], "left_anti")
    linked, _ = stage(whole.join(lacking.select(*unit).distinct(), unit, "left_anti"), "linked")
    by_passage = linked.filter("line = -1").select("_row", "run", F.col("origin").alias("of_passage"))
    by_line = linked.filter("line >= 0").select(*unit, F.col("origin").alias("of_line"))
    out = lines.drop("body").join(by_passage, ["_row", "run"], "left").join(by_line, unit, "left")
    return out.select("_row", "conv", "turn", "level", F.coalesce("of_passage", "of_line").alias("origin"))


def without_quotes(text: Column) -> Column:
    """The lines that aren't quoted, without blank lines at either end."""
    own = F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike("^[ \\t]*>"))
    return F.regexp_replace(F.array_join(own, "\n"), "^\\n+|\\n+$", "")


def thread_starts(parents: DataFrame) -> DataFrame:
    """(conv, turn, start, depth) for messages with a parent, by doubling: each round looks up the message reached so far."""
    spark = parents.sparkSession
    reached, folder = stage(parents.select("conv", "turn", F.col("parent").alias("start"), F.lit(1).cast("bigint").alias("depth")), "threads")
    while True:
        further = reached.select("conv", F.col("turn").alias("start"), F.col("start").alias("next"), F.col("depth").alias("more"))
        step = reached.join(further, ["conv", "start"], "left")
        step = step.select("conv", "turn", F.coalesce("next", "start").alias("start"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"))
        step, next_folder = stage(step, "threads")
        moved = not step.filter("moved").isEmpty()
        drop_staged(spark, folder)
        reached, folder = step.drop("moved"), next_folder
        if not moved:
            return reached


def with_positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Number each group's rows from 1 in the given order. The order is cut into ranges that hold parts of large groups;
    a row's number is its number in the range after the counts of the ranges before."""
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in [group, *order]]
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged, _ = stage(rows.repartitionByRange(tasks, *keys).withColumn("_range", F.spark_partition_id()), "reply-order")
    counts = ranged.groupBy("_range", group).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("_range", F.col(group).alias("_group"), F.coalesce(before, F.lit(0)).alias("_before"))
    local = ranged.withColumn("_place", F.row_number().over(W.partitionBy("_range", group).orderBy(*keys[1:])))
    joined = local.join(counts.withColumnRenamed("_range", "_at"), (F.col("_range") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn("position", (F.col("_before") + F.col("_place")).cast("bigint")).drop("_range", "_at", "_group", "_before", "_place")


def link_conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each message: conv, turn, role, position (from 1, in reply order), thread_turn (its thread's first turn),
    depth (messages from there to here), parent_turn, n_quoted and n_linked (quoted lines; those whose origin is known),
    max_level, and text without quotes.

    Null text stays null; a null turn stands first and links with nothing; messages without a conversation are one
    conversation in which nothing links. Rows with one turn share its parent; repeated rows keep a place each. What a
    message quotes from itself or from later is not linked. Empty tables give no rows; other columns are ignored.
    """
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows, _ = stage(row_key(rows), "messages")
    quotes = link_quotes(rows)
    summary = quotes.groupBy("_row", "conv", "turn").agg(
        F.count("*").alias("n_quoted"), F.count("origin").alias("n_linked"), F.max("level").alias("max_level"), F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("parent")
    )
    summary, _ = stage(summary, "quotes")
    parents = summary.groupBy("conv", "turn").agg(F.max("parent").alias("parent")).filter("parent is not null")
    starts = thread_starts(parents).join(parents, ["conv", "turn"])
    # Everything is placed without the texts; they join last, once.
    narrow = rows.select("_row", "conv", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("_digest"))
    out = narrow.join(summary.drop("conv", "turn", "parent"), "_row", "left").join(starts, ["conv", "turn"], "left")
    none = F.lit(0).cast("bigint")
    out = out.select(
        "_row", "conv", "turn", "role", F.coalesce("start", "turn").alias("thread_turn"), F.coalesce("depth", none).alias("depth"),
        F.col("parent").alias("parent_turn"), F.coalesce("n_quoted", none).alias("n_quoted"), F.coalesce("n_linked", none).alias("n_linked"),
        F.coalesce("max_level", F.lit(0)).cast("bigint").alias("max_level"), "_digest",
    )
    out = with_positions(out, "conv", ["thread_turn", "turn", "role", "_digest"]).drop("_digest")
    texts = rows.select("_row", without_quotes(F.col("text")).alias("text"))
    return out.join(texts, "_row").drop("_row").withColumnRenamed("conv", conv)


def quotation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def oracle_sql() -> str:
    body = "trim(regexp_replace(lower(regexp_replace(l, '^(?:[ \\t]*>)+', '')), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
    marks = "regexp_extract(l, '^((?:[ \\t]*>)+)', 1)"
    pieces = f"CASE WHEN len(w) >= {WINDOW} THEN list_distinct(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) ELSE [array_to_string(w, ' ')] END"
    return f"""
WITH RECURSIVE m AS (SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) AS r, conv_id, turn, role, text FROM conversations),
ln AS (
  SELECT r, conv_id, turn, i, length({marks}) - length(replace({marks}, '>', '')) AS level, {body} AS body
  FROM (SELECT r, conv_id, turn, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m)),
rn AS (
  SELECT *, sum(begins) OVER (PARTITION BY r ORDER BY i) AS run
  FROM (SELECT *, (level IS DISTINCT FROM lag(level) OVER (PARTITION BY r ORDER BY i))::INT AS begins FROM ln)),
pg AS (
  SELECT r, conv_id, turn, run, level, string_split(string_agg(body, ' ' ORDER BY i), ' ') AS w, count(*) AS n_lines
  FROM rn WHERE body <> '' GROUP BY ALL),
own AS (
  SELECT DISTINCT conv_id, turn, unnest({pieces}) AS p FROM pg WHERE level = 0 AND turn IS NOT NULL
  UNION SELECT conv_id, turn, body FROM rn WHERE level = 0 AND body <> '' AND turn IS NOT NULL AND len(string_split(body, ' ')) < {WINDOW}),
un AS (
  SELECT r, conv_id, turn, run, -1 AS line, {pieces} AS ps FROM pg WHERE level > 0 AND n_lines > 1
  UNION ALL SELECT r, conv_id, turn, run, i, {pieces} FROM (SELECT *, string_split(body, ' ') AS w FROM rn WHERE level > 0 AND body <> '')),
up AS (SELECT r, conv_id, turn, run, line, len(ps) AS n, unnest(ps) AS p FROM un),
fw AS (SELECT conv_id, p, min(turn) AS first FROM own GROUP BY 1, 2),
mt AS (SELECT up.*, first FROM up JOIN fw USING (conv_id, p)),
cd AS (SELECT r, run, line, conv_id, max(first) AS origin FROM mt GROUP BY r, run, line, conv_id, turn, n HAVING count(*) = n AND max(first) < turn),
bad AS (
  SELECT DISTINCT r, run, line FROM mt JOIN cd USING (r, run, line, conv_id)
  WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.conv_id = mt.conv_id AND o.turn = cd.origin AND o.p = mt.p)),
ok AS (SELECT * FROM cd WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.r = cd.r AND bad.run = cd.run AND bad.line = cd.line)),
q AS (
  SELECT x.r, x.conv_id, x.turn, x.level, coalesce(a.origin, b.origin) AS origin FROM rn x
  LEFT JOIN ok a ON a.r = x.r AND a.run = x.run AND a.line = -1 LEFT JOIN ok b ON b.r = x.r AND b.run = x.run AND b.line = x.i
  WHERE x.level > 0 AND x.body <> ''),
sm AS (SELECT r, count(*) AS n_quoted, count(origin) AS n_linked, max(level) AS max_level FROM q GROUP BY r),
pa AS (SELECT conv_id, turn, max(origin) AS parent FROM q WHERE level = 1 GROUP BY 1, 2 HAVING max(origin) IS NOT NULL),
th AS (
  SELECT conv_id, turn, parent AS start, 1 AS depth FROM pa
  UNION ALL
  SELECT th.conv_id, th.turn, pa.parent, depth + 1 FROM th JOIN pa ON pa.conv_id = th.conv_id AND pa.turn = th.start),
st AS (SELECT conv_id, turn, min(start) AS start, max(depth) AS depth FROM th GROUP BY 1, 2),
x AS (
  SELECT m.*, coalesce(start, turn) AS thread_turn, coalesce(depth, 0) AS depth, parent AS parent_turn, coalesce(n_quoted, 0) AS n_quoted,
    coalesce(n_linked, 0) AS n_linked, coalesce(max_level, 0) AS max_level
  FROM m LEFT JOIN sm USING (r) LEFT JOIN st USING (conv_id, turn) LEFT JOIN pa USING (conv_id, turn))
SELECT conv_id, turn, role, thread_turn, CAST(depth AS BIGINT) AS depth, parent_turn, n_quoted, n_linked, CAST(max_level AS BIGINT) AS max_level,
  regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^[ \\t]*>')), chr(10)), '^\\n+|\\n+$', '', 'g') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY thread_turn NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, md5(coalesce(text, ''))) AS position
FROM x
"""
