import base64
import hashlib

import pytest
from test_queries import DIR

from quillfold.llm import warc
from quillfold.llm.queries import QUERIES
from quillfold.llm.warc import parse_records, read_headers, read_pages, read_records, verify, write_archive

LONG = "http://x.org/" + "y" * 100_000
ROWS = [(3, "u", b"a"), (1, "v", b"a"), (2, None, None), (5, "w\r\nX: y%0A", b""), (1, "v", b"a"), (None, "q", b"z"), (9, "big", b"p" * 100_000), (8, "a%20b", b"p" * 100_000), (7, "", b"\r\n\r\nWARC-Type: x\xff\x00"), (6, LONG, "\u00e9\r\n".encode())]
SCHEMA = "page_id long, url string, payload binary, digest string, header string"


def sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(rows, least=0):
    """What each record holds, in the order of (digest, id, url): plain loops over the rows."""
    first, out = {}, []
    for i, url, body in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        body = body or b""
        again = body in first and len(body) >= least
        first.setdefault(body, i)
        out.append((i, url, "revisit" if again else "response", first[body] if again else None, len(body), sha1(body), True))
    return sorted(map(str, out))


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "z", "z") for r in rows], SCHEMA)


@pytest.mark.parametrize("hot", [1, 1_000_000])
@pytest.mark.parametrize("least", [0, 10])
def test_archive(spark, tmp_path, monkeypatch, hot, least):
    monkeypatch.setattr(warc, "HOT", hot)
    path = str(tmp_path / "w")
    write_archive(spark, frame(spark), path, least)
    stored = {r.digest: r for r in verify(spark, path).collect()}
    assert len(stored) == 6 and all(r.sound for r in stored.values())
    assert sorted(str(tuple(r)) for r in read_pages(spark, path).collect()) == brute(ROWS, least)


def test_records_are_whole(spark, tmp_path):
    """Each record by a reader of bytes, and the archive read as plain folders."""
    path = str(tmp_path / "w")
    write_archive(spark, frame(spark), path)
    for table in ("records", "payloads"):
        spark.sql(f"DROP TABLE {warc._name(f'{path}/{table}')}")
    bodies = {sha1(b or b"") for _, _, b in ROWS}
    for r in read_records(spark, path).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert rest[-4:] == b"\r\n\r\n" and int(fields["Content-Length"]) == len(rest) - 4
        stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        assert stated in bodies and (r.record_type == "revisit" or sha1(rest[:-4]) == stated)
    urls = sorted(str(r.url) for r in parse_records(read_records(spark, path)).select("url").collect())
    assert urls == sorted(str(u) for _, u, _ in ROWS)
    assert read_headers(spark, path).where("url IS NULL").count() == 1


def test_an_unsound_payload_is_reported(spark, tmp_path):
    path = str(tmp_path / "w")
    write_archive(spark, frame(spark, [(1, "a", b"one"), (2, "b", b"one"), (3, "c", b"two")]), path)
    spoilt = spark.read.parquet(f"{path}/payloads").selectExpr("digest", "CASE WHEN payload = X'6F6E65' THEN X'6F6E66' ELSE payload END AS payload").collect()
    for table in ("records", "payloads"):
        spark.sql(f"DROP TABLE {warc._name(f'{path}/{table}')}")
    spark.createDataFrame(spoilt, "digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    assert sorted((r.page_id, r.sound) for r in read_pages(spark, path).collect()) == [(1, False), (2, False), (3, True)]


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "w")
    write_archive(spark, frame(spark, []), path)
    assert read_headers(spark, path).count() == 0 == verify(spark, path).count() == read_pages(spark, path).count()


def test_query(spark):
    """The whole table against plain loops."""
    rows = [(r.page_id, r.url, (r.html or "").encode()) for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()]
    got = QUERIES["op10_warc_archive"](spark, DIR).collect()
    want = {(i, kind, to, n, digest) for i, _, kind, to, n, digest, _ in map(eval, brute(rows))}
    assert len(got) == len(rows) and {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got} == want
    assert all(r.sound for r in got)
