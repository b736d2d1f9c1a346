"""Secret scan over an incremental ledger of blobs.

Every version of every path is content-addressed (SHA-256 of its text). A ledger keeps, for each blob and rule version,
the spans found. A run scans only pairs of blob and rule version that the ledger lacks, one representative per blob,
appends what it found (blobs without a finding too), and joins the findings back to all paths that ever held the blob.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import Batches, map_texts
from freshet.session import scratch_folder


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the least length of the part that counts, and that part's group. ``span``: the group
    that is the secret, where the pattern matches more before it. ``mark``: what every match holds; texts without it are
    not searched."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    ignore_case: bool = False
    span: int = 0
    mark: str = ""


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    # The same spans as every run of these characters, kept if it has 24 or more.
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: Formats that carry their own mark: web tokens, key blocks, and prefixed service tokens.
MARKED_RULES = (
    # The same spans as eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}, of any length. In a run of these
    # characters only the first "eyJ" can begin a match; beginning at the run and never going back keeps it linear.
    Rule(
        "jwt", r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)", 32, 1, span=1, mark="eyJ",
    ),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
    Rule("prefixed", r"(gh[pousr]_|glpat-|xox[abprs]-|sk_live_|npm_)[A-Za-z0-9_-]+", 24),
)
RULES = BASE_RULES + MARKED_RULES

SPANS = "array<struct<kind:string,start:int,stop:int>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def rule_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find_spans(text: str, rules: tuple[Rule, ...], compiled: list[re.Pattern[str]]) -> list[tuple[str, int, int]]:
    """All spans by start, then by the rules' order. Matches of a rule do not overlap; too short ones are dropped."""
    found = [
        (m.start(rule.span), order, m.end(rule.span))
        for order, (rule, pattern) in enumerate(zip(rules, compiled, strict=True))
        if rule.mark in text
        for m in pattern.finditer(text)
        if m.end(rule.group) - m.start(rule.group) >= rule.least
    ]
    return [(rules[order].kind, start, stop) for start, order, stop in sorted(found)]


def compile_rules(rules: tuple[Rule, ...]) -> list[re.Pattern[str]]:
    # ASCII: letters fold only with ASCII letters.
    return [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.ignore_case else 0)) for r in rules]


def _scan(rules: tuple[Rule, ...]):
    def work(batches: Batches) -> Batches:
        compiled = compile_rules(rules)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [
                [{"kind": k, "start": a, "stop": b} for k, a, b in find_spans(text or "", rules, compiled)] for text in texts
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPAN_TYPE)], names=["blob", "spans"])

    return work


def address(docs: DataFrame, text: str) -> DataFrame:
    """Add ``blob``: the SHA-256 of the text; a null text is the empty blob."""
    return docs.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def scan_unseen(docs: DataFrame, ledger: str, key: str, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the blobs that the ledger lacks for these rules; append them to the ledger and return its rows for the rules.

    ``key`` names a version (a path, a document id); it may be null or repeat. Copies of a blob, however many, are
    scanned once: the representative is chosen on addresses alone, and only its text is moved, dealt by address *and* key.
    """
    spark, version = docs.sparkSession, rule_version(rules)
    versions = address(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text")
    first = versions.groupBy("blob").agg(F.min("_key").alias("_key"))
    seen = read_ledger(spark, ledger, version)
    unseen = first if seen is None else first.join(seen.select("blob"), "blob", "left_anti")
    wanted = unseen.select("blob", F.col("_key").alias("_first")).hint("shuffle_hash")
    one = versions.join(wanted, (versions["blob"] == wanted["blob"]) & versions["_key"].eqNullSafe(wanted["_first"]), "left_semi")
    found = map_texts(one.select("blob", "_text"), _scan(rules), f"blob string, spans {SPANS}")
    # A version that stands in the table twice was scanned twice, with the same result.
    found = found.groupBy("blob").agg(F.first("spans").alias("spans"))
    found.write.mode("append").parquet(f"{ledger}/rules={version}")
    return read_ledger(spark, ledger, version)


def read_ledger(spark: SparkSession, ledger: str, version: str) -> DataFrame | None:
    """The ledger's rows of one rule version, or None while there are none. Two runs at the same time may have scanned the
    same blob, with the same result: it has one row all the same."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/rules={version}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.schema(f"blob string, spans {SPANS}").parquet(f"{ledger}/rules={version}")
    return rows.groupBy("blob").agg(F.first("spans").alias("spans"))


def findings_by_path(docs: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each version (row of ``docs``): key, blob, spans. Nulls and repeated rows keep a row each."""
    return address(docs.select(key, text), text).select(key, "blob").join(known, "blob", "left")


def scan_history(docs: DataFrame, ledger: str, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger up to date with ``docs`` and return the spans of every version.

    Null text counts as empty; an empty table gives no rows; columns other than ``key`` and ``text`` are ignored.
    """
    return findings_by_path(docs, scan_unseen(docs, ledger, key, text, rules), key, text)


def span_digest(spans: F.Column, kinds: tuple[str, ...] | None = None) -> F.Column:
    """``kind:start:end`` joined by commas, of the given kinds or all, in the array's order."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def count_kind(spans: F.Column, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and base counts for every document, over a ledger that starts empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ledger = scratch_folder(spark, "blob-ledger")
    spans = F.col("spans")
    base = tuple(rule.kind for rule in BASE_RULES)
    counts = [count_kind(spans, kind).alias(f"n_{kind}") for kind in base]
    return scan_history(docs, ledger).select(
        "doc_id", *counts, F.sha2(span_digest(spans, base), 256).alias("base_sha256"), span_digest(spans).alias("spans")
    )


def oracle_sql() -> str:
    """The spans in SQL: what a pattern matches and what stands between its matches give the places."""

    # The same spans without looking behind.
    plain = {"jwt": Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 32)}

    def pattern(rule: Rule) -> str:
        text = rule.pattern
        if rule.ignore_case:
            # Letters of the first group in either case, without any other folding.
            words = re.match(r"\(([a-z_?|]+)\)", text)[0]
            text = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words) + text[len(words) :]
        return text.replace("'", "''")

    kinds = []
    for order, rule in enumerate(RULES):
        rule = plain.get(rule.kind, rule)
        p = pattern(rule)
        kinds.append(
            f"""SELECT doc_id, '{rule.kind}' AS kind, {order} AS ord, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
    a := CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT), n := length(m[i]), g := length(g[i])))) AS x
  FROM (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {rule.group}) AS g, regexp_split_to_array(t, '{p}') AS s FROM d) WHERE len(m) > 0"""
        )
    least = " ".join(f"WHEN {order} THEN {rule.least}" for order, rule in enumerate(RULES))
    base = len(BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (ord = {order}) AS n_{rule.kind}" for order, rule in enumerate(BASE_RULES))
    named = "kind || ':' || x.a || ':' || (x.a + x.n)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(kinds)}),
k AS (SELECT * FROM f WHERE x.g >= CASE ord {least} END)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({named}, ',' ORDER BY x.a, ord) FILTER (ord < {base}), '')) AS base_sha256,
  coalesce(string_agg({named}, ',' ORDER BY x.a, ord), '') AS spans
FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id
"""
