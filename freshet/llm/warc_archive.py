"""A deterministic, sharded WARC archive: written in page order, committed by manifest, read back record by record.

Pages are dealt and sorted by ranges of their id. Each task writes gzip members, one a record, to a file with a temporary
name, begins a new file when the compressed size passes a limit, and renames finished files. A manifest written last
names them; files of failed attempts are in no manifest. Headers, record ids and digests are derived from the page alone,
so that a repeated task writes the same bytes.

Of pages with equal payloads one is a ``response`` and the others ``revisit`` it. Which, is decided on digests alone; the
decision reaches the writer as a marker that sorts before its page, so that page texts are moved once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import Batches, commit_file, count_rows, map_texts, open_folder
from freshet.session import scratch_folder

PAGES_PER_TASK = 16_384
ROLL_BYTES = 256 * 1024 * 1024
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records bigint, n_bytes bigint, first_page bigint, last_page bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload string"
_NAMES = uuid.UUID("6b8f7a52-3c1d-5e0a-9b44-0d6a8f0c5e21")


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page}:{payload_digest}')}>"


def clean_url(url: str | None) -> str:
    """A URL fit for a header line: control characters and blanks are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")


def build_record(page: int | None, url: str | None, payload: bytes, date: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record with its HTTP block; a revisit has the HTTP header alone."""
    payload_digest = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, payload_digest)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {clean_url(url)}", "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{digest(block)}", f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Page-Id: {'' if page is None else page}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, payload_digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Roller:
    """Files of one task: a new one begins when the compressed size has passed the limit."""

    def __init__(self, folder: str, task: int, attempt: str, roll_bytes: int, level: int) -> None:
        self.folder, self.task, self.attempt, self.roll_bytes, self.level = folder, task, attempt, roll_bytes, level
        self.files, self.root = open_folder(folder)
        self.done: list[list[Any]] = []
        self.sink = None

    def add(self, page: int | None, record: bytes) -> None:
        if self.sink is None:
            self.name = f"part-{self.task:06d}-{len(self.done):05d}.warc.gz"
            self.files.create_dir(f"{self.root}/_temporary", recursive=True)
            self.temporary = f"{self.root}/_temporary/{self.attempt}-{self.name}"
            self.sink = self.files.open_output_stream(self.temporary, compression=None)
            self.row = [f"{self.folder}/{self.name}", 0, 0, page, page]
        squeeze = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = squeeze.compress(record) + squeeze.flush()
        self.sink.write(data)
        self.row[1:] = self.row[1] + 1, self.row[2] + len(data), self.row[3] if self.row[3] is not None else page, page
        if self.row[2] >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            commit_file(self.files, self.temporary, f"{self.root}/{self.name}")
            self.done.append(self.row)
            self.sink = None


def _write(folder: str, date: str, roll_bytes: int, level: int) -> Callable[[Batches], Batches]:
    def work(batches: Batches) -> Batches:
        from pyspark import TaskContext

        context = TaskContext.get()
        roller = Roller(folder, context.partitionId(), f"{context.taskAttemptId()}-{uuid.uuid4().hex}", roll_bytes, level)
        current, heads = None, {}
        for batch in batches:
            for page, url, html, marked, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page != current:
                    current, heads = page, {}
                if marked is not None:
                    heads[marked] = head
                    continue
                payload = (html or "").encode()
                refers_to = heads.get(hashlib.sha1(payload).hexdigest()) if heads else None
                roller.add(page, build_record(page, url, payload, date, refers_to))
        roller.close()
        columns = list(zip(*roller.done, strict=True)) or [[]] * 5
        types = [pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in MANIFEST.split(", ")])

    return work


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages that repeat a payload of at least ``min_bytes``: page_id, digest (hex), head (the page they repeat, the
    largest id of the group). The grouping sees digests, never texts; it is summed before it is dealt."""
    narrow = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    narrow = narrow.filter(F.col("size") >= min_bytes).drop("size")
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return narrow.join(groups, "digest").filter(F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))).distinct()


def write_archive(
    pages: DataFrame, folder: str, date: str = "2026-01-01T00:00:00Z", roll_bytes: int = ROLL_BYTES, level: int = 6,
    min_bytes: int = 0, pages_per_task: int = PAGES_PER_TASK,
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as ``*.warc.gz`` in ``folder``; returns the manifest.

    A null html is an empty payload, a null url an empty address; null ids come first and never are the page revisited
    while another has the payload. Rows with one id stay together, each with a record; equal rows with the group's
    largest id are all responses. No page gives no file. Other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    marks = revisits(rows, min_bytes)
    none = F.lit(None)
    union = rows.select("page_id", "url", "html", none.cast("string").alias("digest"), none.cast("bigint").alias("head")).unionByName(
        marks.select("page_id", none.cast("string").alias("url"), none.cast("string").alias("html"), "digest", "head")
    )
    tasks = max(spark.sparkContext.defaultParallelism, -(-pages.select("page_id").count() // pages_per_task))
    order = [F.col("page_id").asc_nulls_first(), F.col("digest").asc_nulls_last(), F.xxhash64("url", "html")]
    placed = union.repartitionByRange(tasks, order[0]).sortWithinPartitions(*order)
    map_texts(placed, _write(folder, date, roll_bytes, level), MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(stream: Any, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    data, opened, parts = b"", None, []
    while data or (data := stream.read(chunk)):
        opened = opened or zlib.decompressobj(31)
        parts.append(opened.decompress(data))
        data = opened.unused_data
        if opened.eof:
            yield b"".join(parts)
            opened, parts = None, []
    if opened is not None:
        raise ValueError("the archive ends within a record")


def parse_record(record: bytes) -> dict[str, Any]:
    """A record's fields; digests and lengths are held against the content."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = fields["WARC-Block-Digest"] == f"sha1:{digest(block)}" and (kind == "revisit" or len(payload) == size and digest(payload) == stated)
    if version != "WARC/1.1" or not whole:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    page, refers_to = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id")
    return {
        "page_id": int(page) if page else None, "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": stated,
        "record_type": kind, "refers_to": int(refers_to) if refers_to else None, "payload": payload.decode() if kind == "response" else None,
    }


def _read(with_payload: bool) -> Callable[[Batches], Batches]:
    def work(batches: Batches) -> Batches:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = open_folder(path)
                rows: list[dict[str, Any]] = []
                with files.open_input_stream(name, compression=None) as stream:
                    for member in members(stream):
                        rows.append(parse_record(member) | ({} if with_payload else {"payload": None}))
                        if len(rows) == 200:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return work


def read_archive(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the files that the manifest names."""
    paths = read_manifest(spark, folder).select("path")
    tasks = max(1, min(count_rows(spark, f"{folder}/manifest"), 16 * spark.sparkContext.defaultParallelism))
    return paths.repartition(tasks, "path").mapInArrow(_read(with_payload), RECORDS)


def archive_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archive(spark, folder).drop("payload", "url")


def oracle_sql() -> str:
    """What the archive must say of each page; base32 from the hexadecimal digest, 20 bits at a time."""
    chunk = "CAST('0x' || substr(h, 1 + 5 * (j // 4), 5) AS BIGINT)"
    letter = f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(({chunk} >> (15 - 5 * (j % 4))) & 31 AS INTEGER), 1)"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, array_to_string(list_transform(range(32), lambda j: {letter}), '') AS payload_digest,
  CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN head <> page_id THEN head END AS refers_to
FROM p
"""
