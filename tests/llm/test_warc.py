import base64
import gzip
import hashlib
import time
import zlib

import pytest
from quillmill.llm import warc

PAGE = "page_id long, url string, html string, payload string, page int"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://a/1", "<p>same</p>"),
        (2, "http://a/2", "<p>same</p>"),
        (3, None, "other\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\né🙂"),
        (4, "http://a/\r\nX: y", ""),
        (5, "u", None),
        (None, "u", "<p>same</p>"),
        (None, "u", "alone"),
        (2, "again", "<p>same</p>"),
        (6, "u", "x" * 100_000),
    ]
    return spark.createDataFrame([(*r, "p", 0) for r in rows], PAGE)


def test_round_trip(pages):
    rows = sorted(map(tuple, warc.archive_round_trip(pages).collect()), key=repr)
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, 11, sha("<p>same</p>"), "revisit", 2), (2, 11, sha("<p>same</p>"), "response", None), (2, 11, sha("<p>same</p>"), "response", None), (None, 11, sha("<p>same</p>"), "revisit", 2), (None, 5, sha("alone"), "response", None)]
    want += [(4, 0, sha(""), "revisit", 5), (5, 0, sha(""), "response", None), (6, 100_000, sha("x" * 100_000), "response", None)]
    third = "other\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\né🙂"
    want.append((3, len(third.encode()), sha(third), "response", None))
    assert rows == sorted(want, key=repr)


def test_archives_hold_payloads_once(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    records = [(head, b"".join(parts)) for f in (tmp_path / "w").glob("part-*") for head, parts in warc.parse([gzip.decompress(f.read_bytes())])]
    assert len(records) == pages.count()
    for head, block in records:
        assert int(head["Content-Length"]) == len(block)
        assert (head["WARC-Type"] == "revisit") == (block == b"")
        assert ("WARC-Refers-To" in head) == ("WARC-Refers-To-Date" in head) == (head["WARC-Type"] == "revisit")
    by_id = {head["WARC-Record-ID"]: head for head, _ in records}
    for head, _ in records:
        if head["WARC-Type"] == "revisit":
            original = by_id[head["WARC-Refers-To"]]
            assert original["WARC-Type"] == "response" and original["WARC-Payload-Digest"] == head["WARC-Payload-Digest"]
            assert original.get("WARC-Target-URI") == head.get("WARC-Refers-To-Target-URI") or original["X-Page-ID"] == "2"
    read = warc.read_archives(spark, path).where("record_type = 'response'")
    assert {r["page_id"]: r["payload"] for r in read.collect() if r["page_id"] in (3, 6)} == {r["page_id"]: r["html"] for r in pages.collect() if r["page_id"] in (3, 6)}


def test_every_record_is_a_gzip_member_and_archives_are_bounded(spark, tmp_path):
    path = str(tmp_path / "w")
    df = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "concat(id, repeat(sha2(string(id), 256), 20)) AS html").repartition(2)
    warc.write_archives(df, path, archive_bytes=10_000)
    files = [f.read_bytes() for f in (tmp_path / "w").glob("part-*")]
    assert len(files) > 5 and max(map(len, files)) < 12_000
    members = 0
    for data in files:
        while data:
            d = zlib.decompressobj(31)
            one = d.decompress(data)
            members += one.startswith(b"WARC/1.1") and one.endswith(b"\r\n\r\n")
            assert one.count(b"WARC/1.1") == (1 if one else 0)
            data = d.unused_data
    assert members == 400
    assert warc.read_archives(spark, path).where("payload = concat(page_id, repeat(sha2(string(page_id), 256), 20))").count() == 400


def test_very_long_payload(spark):
    """Time and memory grow with the length, not with its square."""
    df = spark.range(2).selectExpr("id AS page_id", "'u' AS url", "repeat('0123456789abcdef', cast(4194304 AS int)) AS html")  # 64 MiB
    rows = {r["page_id"]: r for r in warc.archive_round_trip(df).collect()}
    assert rows[1]["payload_bytes"] == 1 << 26 and rows[1]["record_type"] == "response" and rows[0]["refers_to"] == 1
    record = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % (1 << 27) + b"x" * (1 << 27) + b"\r\n\r\n"
    began = time.perf_counter()
    (_, n), = [(head, sum(map(len, parts))) for head, parts in warc.parse(warc.inflated(zlib.compress(record, 1, 31)))]
    assert n == 1 << 27 and time.perf_counter() - began < 5


def test_small_payloads_stay_responses(pages):
    rows = warc.archive_round_trip(pages, least_bytes=12).collect()
    assert {r["record_type"] for r in rows} == {"response"}


def test_empty(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGE)).count() == 0


def test_hot_payload(spark):
    df = spark.range(600).selectExpr("id AS page_id", "'u' AS url", "if(id % 3 = 0, 'hot', concat('own', id)) AS html")
    got = warc.archive_round_trip(df)
    assert got.where("record_type = 'revisit'").count() == 199
    assert got.where("refers_to IS NOT NULL").select("refers_to").distinct().count() == 1


def test_any_blocks_give_the_same_records():
    record = lambda n: b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % n + b"\r\n" * (n // 2) + b"x" * (n % 2) + b"\r\n\r\n"
    data = b"".join(record(n) for n in (0, 7, 100, 3))
    listed = lambda blocks: [(head, b"".join(parts)) for head, parts in warc.parse(blocks)]
    want = listed([data])
    assert [len(b) for _, b in want] == [0, 7, 100, 3]
    for step in (1, 5, 64):
        assert listed(data[k : k + step] for k in range(0, len(data), step)) == want
    assert [head for head, _ in warc.parse([data])] == [head for head, _ in want]
    two = gzip.compress(data) + gzip.compress(b"") + gzip.compress(data)
    for fed, block in ((1, 10), (7, 3), (1000, 1 << 20)):
        assert b"".join(warc.inflated(two, fed, block)) == data * 2
    for bad in (data[:-1], data[:10], b"HTTP/1.1 200\r\n\r\n"):
        with pytest.raises(ValueError, match="archive ends|no WARC"):
            listed([bad])
    with pytest.raises(ValueError, match="doesn't end"):
        listed([data.replace(b"Content-Length: 7", b"Content-Length: 5")])
    with pytest.raises(ValueError, match="gzip"):
        list(warc.inflated(two[:-12]))
