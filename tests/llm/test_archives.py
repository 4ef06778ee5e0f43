import gzip
from collections import Counter
from hashlib import sha1

import pytest

from plugload.llm import archives as A
from plugload.session import new_folder

SCHEMA = "page_id bigint, url string, html string, type string, refers string"


def naive(pages):
    payloads = [(i, (h or "").encode()) for i, _, h in pages]
    best = {}
    for i, p in payloads:
        if len(p) >= 1000:
            best[p] = max(best.get(p, -10**18), -10**17 if i is None else i)
    out = []
    for i, p in payloads:
        again = len(p) >= 1000 and best[p] != (-10**17 if i is None else i)
        out.append((i, len(p), sha1(p).hexdigest(), "revisit" if again else "response", best[p] if again else None))
    return Counter(out)


def check(spark, pages):
    df = spark.createDataFrame([(i, u, h, "t", "r") for i, u, h in pages], SCHEMA).repartition(3)
    assert Counter(map(tuple, A.through_archives(df).collect())) == naive(pages)


def test_round_trip_of_odd_pages(spark, monkeypatch):
    monkeypatch.setattr(A, "FILE_BYTES", 5000)
    long, wide = "x" * 1000, "é" * 500
    pages = [(1, "http://a.example/", long), (2, "http://a.example/ b c\n", long), (3, None, long), (4, "u", wide), (5, "u", wide), (6, "v", None), (7, "v", ""),
             (8, "w", "y" * 999), (9, "w", "y" * 999), (10, "x", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n" * 60), (11, "x", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n" * 60),
             (12, "z", "\n\n"), (13, "z", "a\x00b\r\n" * 500), (14, "big", "q" * 3_000_000), (14, "big", "q" * 3_000_000), (-5, "n", long), (None, "null", long), (None, "null", "short")]
    pages += [(100 + i, "many", "m" * 1200) for i in range(300)]
    check(spark, pages)


def test_given_pages(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    check(spark, rows)


def test_no_pages(spark):
    assert A.through_archives(spark.createDataFrame([], SCHEMA)).count() == 0


HTTP = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>a</p>"


def arc(version, *records):
    return A.arc_head(version, "19970101000000") + b"".join(records)


def one(version, url, block, length=None, date="19970102030405"):
    return A.arc_line(version, url, date, "text/html", len(block) if length is None else length) + block + b"\n"


@pytest.mark.parametrize("version", [1, 2])
def test_header_lines_of_both_versions(version):
    data = arc(version, one(version, "http://h/a b", HTTP), one(version, "dns:h", b"1.2.3.4\n"), b"\n\nbroken line\n", one(version, "http://h/c", b""), one(version, "http://h/d", HTTP, len(HTTP) + 50))
    head, *rest = A.parse_arc(data)
    assert head.url.startswith("filedesc:") and head.version == version
    assert [r.url for r in rest] == ["http://h/a b", "dns:h", "http://h/c", "http://h/d"]
    assert [r.block for r in rest[:3]] == [HTTP, b"1.2.3.4\n", b""]
    assert rest[3].truncated and not rest[0].truncated and rest[0].version == version
    assert [A.warc_type(r)[0] for r in (head, *rest)] == ["warcinfo", "response", "resource", "resource", "response"]


def test_equivalent_warc_record():
    record = list(A.parse_arc(arc(1, one(1, "http://h/", HTTP))))[1]
    (headers, block), = A.parse_warc(A.warc_record(record))
    assert block == HTTP and headers["warc-type"] == "response" and headers["warc-date"] == "1997-01-02T03:04:05Z"
    assert headers["warc-payload-digest"] == A.digest(b"<p>a</p>") and headers["warc-block-digest"] == A.digest(HTTP)
    assert headers["warc-record-id"] == A.record_id(record) and headers["content-length"] == str(len(HTTP))
    (headers, block), = A.parse_warc(A.warc_record(record, {"id": "<urn:uuid:1>", "url": "http://g/", "date": "1996"}))
    assert headers["warc-type"] == "revisit" and headers["warc-refers-to"] == "<urn:uuid:1>" and block.endswith(b"\r\n\r\n")
    assert headers["warc-refers-to-date"] == "1996-01-01T00:00:00Z" and headers["warc-payload-digest"] == A.digest(b"<p>a</p>")
    cut = list(A.parse_arc(arc(1, one(1, "http://h/", HTTP, 10_000))))[1]
    assert b"WARC-Truncated: length" in A.warc_record(cut)


def test_files_are_real_archives(spark, tmp_path):
    from pathlib import Path

    folder = new_folder(spark, "arc-test")
    df = spark.createDataFrame([(i, "http://h/", "é" * 3000) for i in range(5)], "page_id bigint, url string, html string").coalesce(1)
    A.write_arc(df, folder)
    files = list(Path(folder.removeprefix("file:")).glob("*.gz"))
    data = gzip.decompress(files[0].read_bytes())
    assert len(files) == 1 and data.startswith(b"filedesc://") and data.endswith("é\n".encode())
    assert len(list(A.parse_arc(data))) == 6
