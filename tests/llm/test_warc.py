import base64
import gzip
import hashlib
import tracemalloc

import pytest

from lenscube.llm import warc


def brute(rows, least=0):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    top = {}
    for p, _, h in rows:
        if p is not None:
            top[digest(h)] = max(top.get(digest(h), p), p)
    out = []
    for p, _, h in rows:
        n, o = len((h or "").encode()), top.get(digest(h))
        again = p is not None and n >= least and o != p
        out.append((p, n, digest(h), "revisit" if again else "response", o if again else None))
    return sorted(out, key=repr)


ROWS = [(1, "http://a/", "x"), (2, "http://b/", "x"), (3, None, None), (4, "u\r\nv", ""), (5, "", "é\r\n\r\nWARC/1.1\r\n\r\n"), (6, "c", "y" * 200_000), (2, "http://b/", "x"), (7, "d", "y" * 200_000), (None, "e", "z")]


def test_round_trip_equals_brute_force(spark):
    pages = spark.createDataFrame([(*r, "noise") for r in ROWS], "page_id long, url string, html string, digest string").repartition(3)
    for least in (0, 1, 10):
        got = [tuple(r) for r in warc.report(warc.round_trip(pages, least)).collect()]
        assert sorted(got, key=repr) == brute(ROWS, least)


def test_captures_are_whole(spark):
    pages = spark.createDataFrame(ROWS[:5], "page_id long, url string, html string")
    got = {r.metadata.page_id: r for r in warc.round_trip(pages, payloads=True).collect()}
    assert got[5].response.payload == ROWS[4][2] and got[5].request.record_type == "request" and got[4].request.uri == "u%0D%0Av" and got[4].metadata.uri == "u\r\nv"
    assert got[1].response.record_type == "revisit" and got[1].response.refers_to == got[2].response.record_id and got[1].response.payload is None


def test_rows_that_repeat_are_a_capture_each(spark):
    rows = [(1, "http://a/", "x"), (1, "http://b/", "x"), (1, "http://b/", "x"), (0, "http://c/", "x")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.metadata.page_id, r.response.uri, r.response.record_type, r.metadata.refers_to) for r in got) == [
        (0, "http://c/", "revisit", "1"), (1, "http://a/", "response", None), (1, "http://b/", "response", None), (1, "http://b/", "response", None)
    ]
    assert len({r.capture_id for r in got}) == 4


def test_files_are_bounded_by_bytes_and_read_in_pieces(spark, tmp_path):
    big = "".join(f"{i:x}" for i in range(8_000_000))  # some 50 MB
    pages = spark.createDataFrame([(i, "u", "v" * 100_000 + str(i)) for i in range(30)], "page_id long, url string, html string")
    pages = pages.unionAll(spark.createDataFrame([(99, "big", big)], "page_id long, url string, html string")).repartition(1)
    warc.write(pages, f"{tmp_path}/w", file_bytes=1 << 20)
    files = list((tmp_path / "w").rglob("part-*.gz"))
    sizes = [len(gzip.decompress(f.read_bytes())) for f in files]
    assert len(files) in (3, 4) and sum(n <= (1 << 20) + 101_500 for n in sizes) == len(files) - 1
    got = {r.metadata.page_id: r.response for r in warc.assemble(warc.read(spark, f"{tmp_path}/w")).collect()}
    assert len(got) == 31 and got[99].payload == big
    tracemalloc.start()
    for f in files:
        for headers, block in warc.records(f.read_bytes()):
            assert int(headers["content-length"][0]) == len(block)
    assert tracemalloc.get_traced_memory()[1] < 4 * len(big)  # the file, what is held of it and a block
    tracemalloc.stop()


def test_foreign_records(spark, tmp_path):
    def record(kind, number, block, *headers, end=b"\r\n\r\n"):
        lines = ["WARC/1.0", f"warc-type:{kind}", f"WARC-Record-ID: <r{number}>", f"content-length:   {len(block)}", *headers]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + end

    plain = record("warcinfo", 0, b"software: x") + record("response", 1, b"HTTP/1.1 200 OK\r\n\r\nbody", "WARC-Concurrent-To: <r2>", "WARC-Concurrent-To:", " <r3>", end=b"\r\n\r\n\r\n")
    plain += record("request", 2, b"GET /") + record("metadata", 3, b"page-id: 7\r\n") + record("response", 4, b"no http")
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record("response", 5, b"HTTP/1.1 200 OK\r\ncontent-LENGTH:2\r\n\r\nxy")) + gzip.compress(record("request", 6, b"", "WARC-Concurrent-To: <r5>")))
    got = warc.assemble(warc.read(spark, str(tmp_path)), several=True).collect()
    seen = sorted((r.response.payload, r.response.payload_bytes, r.response.payload_digest, r.request and r.request.record_id, r.metadata and r.metadata.page_id) for r in got)
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert seen == [("body", 4, sha(b"body"), "<r2>", 7), ("no http", 7, sha(b"no http"), None, None), ("xy", 2, sha(b"xy"), "<r6>", None)]
    (tmp_path / "c.warc").write_bytes(record("response", 8, b"abc", end=b"")[:-1])
    with pytest.raises(Exception, match="breaks off"):
        warc.read(spark, str(tmp_path)).collect()


def test_empty_table(spark):
    assert warc.report(warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
