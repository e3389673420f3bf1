import base64
import gzip
import hashlib
import random
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.llm.common import frame  # noqa: F401
from tidepool.llm import queries, warc


def brute(rows):
    """(page_id, bytes, digest, type, refers_to) of (page_id, url, html)."""
    first, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    for page_id, _, html in order:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        new = digest not in first
        first.setdefault(digest, page_id)
        out.append((page_id, len(body), digest, "response" if new else "revisit", None if new else first[digest]))
    return out


def rows_of(spark, tmp_path, rows):
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, key long")
    path = f"file://{tmp_path}/archives"
    warc.write_archives(pages, path)
    return path, warc.read_archives(spark, path, strict=True)


KEY = lambda r: tuple((x is None, x) for x in r)


def awkward():
    rnd = random.Random(5)
    big = "".join(rnd.choice("abcdefgh <>\n") for _ in range(300_000))
    rows = [(i, f"http://a{i}.net/", rnd.choice([f"<p>{i}</p>", "<p>same</p>", "", None, "é\x00ü\r\n\r\nWARC/1.1\r\n"])) for i in range(80)]
    rows += [(200, "http://x/", big), (201, None, big), (150, "http://y\r\nX-Page-Id: 7", big)]
    rows += [(7, "http://a7.net/", "twice"), (7, "http://a7.net/", "twice"), (7, None, "twice"), (None, None, "twice"), (None, "u", "alone"), (None, "u", "alone"), (None, None, None)]
    return rows


def test_round_trip_equals_brute_force(spark, tmp_path):
    rows = awkward()
    path, back = rows_of(spark, tmp_path, rows)
    kept = back.where("record_type <> 'warcinfo'")
    got = kept.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long")).collect()
    assert sorted(map(tuple, got), key=KEY) == sorted(brute(rows), key=KEY)
    whole = {r.payload_digest: r.payload for r in kept.where("record_type = 'response'").collect()}
    assert {bytes(v) for v in whole.values()} == {(r[2] or "").encode() for r in rows}
    ids = {r.record_id: r for r in kept.collect()}
    assert len(ids) == len(rows)
    assert all(ids[r.refers_to_id].payload_digest == r.payload_digest and ids[r.refers_to_id].record_type == "response" for r in ids.values() if r.record_type == "revisit")


def test_files_are_gzip_members_of_one_record(spark, tmp_path):
    rows_of(spark, tmp_path, awkward())
    n = 0
    for file in (tmp_path / "archives").glob("part-*"):
        raw = file.read_bytes()
        records = [m for _, m, fault in warc.members(memoryview(raw)) if not fault]
        assert b"".join(records) == gzip.decompress(raw)  # another reader, without padding or garbage
        assert all(r.startswith(b"WARC/1.1\r\n") and r.count(b"\nWARC-Type:") == 1 for r in records)
        n += sum(b"WARC-Type: warcinfo" not in r for r in records)
    assert n == len(awkward())


def test_broken_members_become_faults(spark, tmp_path):
    good = [warc.member("response", "", f"HTTP/1.1 200 OK\r\n\r\nbody {i}".encode()) for i in range(4)]
    cut = bytearray(good[1])
    cut[20] ^= 0xFF
    wrong = zlib.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Block-Digest: sha1:AAAA\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", 6, wbits=31)
    long = zlib.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 30\r\n\r\nabc\r\n\r\n", 6, wbits=31)
    (tmp_path / "a.warc.gz").write_bytes(good[0] + bytes(cut) + good[2] + wrong + long + zlib.compress(b"none", wbits=31) + good[3][:-9])
    got = warc.read_archives(spark, f"file://{tmp_path}").orderBy("offset").collect()
    assert [r.fault is None for r in got] == [True, False, True, False, False, False, False]
    assert bytes(got[2].payload) == b"body 2"
    with pytest.raises(Exception, match="digest|no end|invalid|incorrect"):
        warc.read_archives(spark, f"file://{tmp_path}", strict=True).count()


def test_a_record_over_16_megabytes(spark, tmp_path):
    body = "long line \n" * 1_700_000
    _, back = rows_of(spark, tmp_path, [(1, "u", body), (2, "u", body), (3, "u", "short")])
    got = {r.page_id: r for r in back.where("page_id is not null").collect()}
    assert (got["1"].payload_bytes, got["1"].record_type, got["2"].refers_to) == (len(body), "response", "1")
    assert bytes(got["1"].payload) == body.encode()
    files = list(Path(tmp_path / "archives").glob("part-*"))
    assert all(gzip.decompress(f.read_bytes()) for f in files)


def test_many_copies_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 7)
    rows = [(1, "u", "x")] * 50 + [(0, "v", "x"), (2, "u", "y")]
    _, back = rows_of(spark, tmp_path, rows)
    got = back.where("record_type <> 'warcinfo'").select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long")).collect()
    assert sorted(map(tuple, got), key=KEY) == sorted(brute(rows), key=KEY)


def test_no_pages(spark, tmp_path):
    _, back = rows_of(spark, tmp_path, [])
    assert back.where("record_type <> 'warcinfo'").count() == 0


def test_query_equals_sql(spark):
    from tests.oracle import rows

    got, want = rows(spark, "op11_warc", queries.op11_warc, queries.ORACLES["op11_warc"], "/root/testdata/sf0.01")
    assert got == want and len(got) == 250
