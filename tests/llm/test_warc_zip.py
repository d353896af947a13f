import base64
import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from tokenloom.llm import warc_zip
from tokenloom.llm.queries import QUERIES


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_query_reads_back_all_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = {r["page_id"]: r for r in QUERIES["op9_zip_warc"](spark, sf).collect()}
    assert set(rows) == set(pages)
    last = {}
    for i in sorted(pages):
        last[pages[i]] = i
    for i, payload in pages.items():
        r, keeper = rows[i], last[payload]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), digest(payload))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if keeper == i else ("revisit", keeper))


PAGES = [(1, "http://a/b c\r\nX: y", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>"), (4, "u", "<p>é</p>"),
         (None, "u", "<p>é</p>"), (None, "u", "only"), (7, "u", "x" * 3_000_000), (8, "u", "a\r\n\r\nb"), (9, "u", "WARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("archive_bytes", [warc_zip.ARCHIVE_BYTES, 200])
def test_odd_rows(spark, archive_bytes):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, payload string, revisit int")
    archives = warc_zip.write_archives(pages.repartition(2), archive_bytes=archive_bytes)
    rows = warc_zip.read_records(warc_zip.index_entries(archives)).collect()
    assert sum(r["records"] for r in archives.collect()) == len(rows) == len(PAGES)
    found = sorted(((r["page_id"] is None, r["page_id"] or 0), r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in rows)
    keep = {"<p>é</p>": 4, "": 3, "only": None}
    want = []
    for i, _, html in PAGES:
        keeper = keep.get(html or "", i)
        revisit = keeper != i
        want.append(((i is None, i or 0), digest((html or "").encode()), "revisit" if revisit else "response", keeper if revisit else 0))
    assert found == sorted(want)
    payloads = {r["payload_digest"]: r["payload"] for r in rows if r["record_type"] == "response"}
    assert payloads == {digest(p): p for p in {(h or "").encode() for _, _, h in PAGES}}
    assert warc_zip.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = warc_zip.archive_round_trip(spark, pages, least_bytes=10_000).collect()
    assert {r["record_type"] for r in rows} == {"response"}


def zip_bytes(names, **how):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", **how) as z:
        for name in names:
            with z.open(name, "w", force_zip64=True) as member:
                member.write(name.encode() * 50)
        z.comment = b"a comment with PK\x05\x06 inside"
    return out.getvalue()


def test_directories_are_read_with_and_without_zip64(monkeypatch):
    names = [f"archive/data{i}.warc" for i in range(5)]
    for limit in (None, 100):
        if limit:  # everything above 100 bytes or 2 members needs the ZIP64 fields
            monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
            monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
        data = zip_bytes(names)
        assert (b"PK\x06\x06" in data) == bool(limit)
        handle = pa.BufferReader(data)
        found = list(warc_zip.members(handle))
        assert [f[0] for f in found] == names
        for name, method, offset, size in found:
            assert method == 0 and data[offset:offset + size] == name.encode() * 50


def test_not_an_archive():
    with pytest.raises(ValueError):
        list(warc_zip.members(pa.BufferReader(b"no archive at all")))


def test_records_are_read_by_many_tasks(spark, monkeypatch):
    """As many tasks as the records' bytes ask for, however narrow their index rows are."""
    monkeypatch.setattr(warc_zip, "READ_BYTES", 2000)
    monkeypatch.setattr(warc_zip, "TASK_BYTES", 20_000)
    pages = spark.range(600).selectExpr("id as page_id", "concat('u', id) as url", "repeat(sha2(cast(id as string), 512), 6) as html")
    read = warc_zip.archive_round_trip(spark, pages)
    assert read.rdd.getNumPartitions() >= 8
    rows = {r["page_id"]: (r["payload_bytes"], r["record_type"]) for r in read.collect()}
    assert rows == {i: (768, "response") for i in range(600)}
