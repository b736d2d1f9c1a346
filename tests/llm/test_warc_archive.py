import base64
import gzip
import hashlib

import pytest

from freshet.llm.warc_archive import build_record, members, parse_record, read_archive, read_manifest, write_archive


@pytest.fixture(scope="module")
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], "page_id bigint, url string, html string, digest string, head string, _row string")

    return make


ROWS = [
    (1, "http://a.example/ x\r\ny", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b.example/", None), (4, "http://b.example/é", ""), (5, "u", "é\r\n\r\nWARC/1.1 " * 3),
    (6, "u", "<p>one</p>"), (6, "u", "<p>one</p>"), (7, "u", "x" * 3_000_000), (None, "u", "<p>one</p>"), (None, None, "alone"), (8, "v", "y" * 3_000_000), (6, "w", "two under one id"),
]


def expected(rows):
    heads = {}
    for i, _, h in rows:
        if i is not None:
            heads[h or ""] = max(i, heads.get(h or "", i))
    out = []
    for i, _, h in rows:
        payload = (h or "").encode()
        head = heads.get(h or "")
        revisit = head is not None and head != i
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, pages, tmp_path):
    folder = str(tmp_path / "warc")
    manifest = write_archive(pages(ROWS), folder, roll_bytes=4000, pages_per_task=4).collect()
    out = read_archive(spark, folder, with_payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == expected(ROWS)
    assert sorted((str(r.page_id), r.payload) for r in out if r.record_type == "response" and r.page_id != 3) == sorted(
        (str(i), h or "") for (i, _, h), e in zip(ROWS, ROWS, strict=True) if i != 3 and (i, "response") in {(x[0], x[3]) for x in expected(ROWS) if x[1] == len((h or "").encode())}
    )
    # Files roll: more of them than tasks with rows, each finished; nothing temporary is left.
    assert sum(m.n_records for m in manifest) == len(ROWS)
    assert not list((tmp_path / "warc" / "_temporary").iterdir())
    ordered = [r for m in sorted(manifest, key=lambda m: m.path) for r in members(open(m.path, "rb"))]
    ids = [parse_record(r)["page_id"] for r in ordered]
    assert ids == [None, None, *sorted(i for i, *_ in ROWS if i is not None)]
    # The files are ordinary gzip files of WARC records.
    text = gzip.open(manifest[0].path).read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_bytes_are_deterministic(spark, pages, tmp_path):
    files = []
    for k, rows in enumerate((ROWS, ROWS[::-1])):
        write_archive(pages(rows).repartition(3 + k), str(tmp_path / f"w{k}"), pages_per_task=100).collect()
        files.append(b"".join(p.read_bytes() for p in sorted((tmp_path / f"w{k}").glob("*.warc.gz"))))
    assert files[0] == files[1]


def test_least_size_for_revisits(spark, pages, tmp_path):
    write_archive(pages(ROWS), str(tmp_path / "w"), min_bytes=1).collect()
    kinds = {r.page_id: r.record_type for r in read_archive(spark, str(tmp_path / "w")).filter("payload_bytes = 0").collect()}
    assert kinds == {3: "response", 4: "response"}


def test_damage_is_seen():
    record = build_record(1, "u", b"payload", "2026-01-01T00:00:00Z", None)
    assert parse_record(record)["payload"] == "payload"
    with pytest.raises(ValueError, match="damaged"):
        parse_record(record.replace(b"payload\r\n", b"paxload\r\n"))


def test_empty(spark, pages, tmp_path):
    write_archive(pages([]), str(tmp_path / "w")).collect()
    assert read_archive(spark, str(tmp_path / "w")).count() == 0 and read_manifest(spark, str(tmp_path / "w")).count() == 0
