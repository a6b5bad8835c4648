"""Literal ARC archives of both versions, damaged ones too, and the query against a plain version."""

import gzip
import hashlib
import io

from corpusloom.llm import warc
from corpusloom.llm.common import shared_dir
from corpusloom.llm.files import reading, writing

BODY_CRLF = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Record-Key: 1\r\n\r\n<p>one</p>\n\nmore"
BODY_LF = b"HTTP/1.0 200 OK\nContent-Type: text/html\nX-Record-Key: 2\n\n<p>two</p>"


def archive(version: int, records: list[tuple[bytes, bytes]]) -> bytes:
    about = f"{version} 0 someone\n{' '.join(warc.ARC_FIELDS[version])}\n\n".encode()
    out = b"filedesc://x.arc 0.0.0.0 20010203040506 text/plain %d\n" % len(about) + about + b"\n"
    for head, body in records:
        out += head + b"\n" + body + b"\n"
    return out


def v1(url: bytes, body: bytes) -> tuple[bytes, bytes]:
    return url + b" 1.2.3.4 20010203040506 text/html %d" % len(body), body


def v2(url: bytes, body: bytes) -> tuple[bytes, bytes]:
    return url + b" 1.2.3.4 20010203040506 text/html 302 abc123 http://to/ 77 x.arc %d" % len(body), body


def read(data: bytes):
    damaged: list[str] = []
    return list(warc.parse_arc(io.BytesIO(data), damaged)), damaged


def test_both_versions_by_their_declared_fields():
    for version, line in ((1, v1), (2, v2)):
        records, damaged = read(archive(version, [line(b"http://a/ b", BODY_CRLF), line("http://é/".encode("latin-1"), BODY_LF), line(b"dns:host", b"1.2.3.4")]))
        assert not damaged and [r["URL"] for r in records[1:]] == ["http://a/ b", "http://é/", "dns:host"]
        assert [r["body"] for r in records[1:]] == [BODY_CRLF, BODY_LF, b"1.2.3.4"]
        assert records[0]["version"] == version
    text = warc.as_warc(records[1], "x.arc.gz", None).decode("latin-1")
    assert "WARC-X-ARC-Result-code: 302" in text and "WARC-X-ARC-Checksum: abc123" in text and "WARC-X-ARC-Location: http://to/" in text
    assert "WARC-Date: 2001-02-03T04:05:06Z" in text and "WARC-Type: response" in text
    assert "WARC-Type: resource" in warc.as_warc(records[3], "x.arc.gz", None).decode("latin-1")


def test_heads_that_end_with_line_feeds():
    assert warc.http_parts(BODY_LF) == (BODY_LF[: -len(b"<p>two</p>")], b"<p>two</p>")
    assert warc.http_parts(BODY_CRLF)[1] == b"<p>one</p>\n\nmore"
    assert warc.http_parts(b"HTTP/1.0 204\n") == (b"HTTP/1.0 204\n", b"")


def test_damaged_records_are_left_out_and_counted():
    good, bad = v1(b"http://a/", BODY_CRLF), (b"http://b/ 1.2.3.4 2001 text/html many", b"body\nlines")
    records, damaged = read(archive(1, [good, bad, good]))
    assert [r["URL"] for r in records[1:]] == ["http://a/"] * 2 and len(damaged) == 1
    records, damaged = read(archive(1, [good, (b"http://b/ 1.2.3.4 20010203040506 text/html 900", b"short")]))
    assert len(records) == 2 and len(damaged) == 1
    records, damaged = read(archive(1, [good])[:-30])
    assert len(records) == 1 and len(damaged) == 1
    assert read(b"") == ([], [])


def test_reading_goes_on_inside_the_bytes_that_a_wrong_length_took():
    good, late = v1(b"http://a/", BODY_CRLF), v1(b"http://c/", BODY_LF)
    records, damaged = read(archive(1, [good, (b"http://b/ 1.2.3.4 20010203040506 text/html 99999", b"short"), late, good]))
    assert [r["URL"] for r in records[1:]] == ["http://a/", "http://c/", "http://a/"] and [r["place"] for r in records[1:]] == [1, 2, 3]
    assert len(damaged) == 1 and "early" in damaged[0] and "bytes passed over" in damaged[0]


def test_several_archives_in_one_file_and_strange_versions():
    one, two = archive(1, [v1(b"http://a/", BODY_CRLF)]), archive(2, [v2(b"http://b/", BODY_LF)])
    records, damaged = read(one + two)
    assert not damaged and [(r["URL"], r["place"]) for r in records if r["place"]] == [("http://a/", 1), ("http://b/", 2)]
    assert records[-1]["Location"] == "http://to/"
    records, damaged = read(one.replace(b"1 0 someone", b"x 0 someone"))
    assert len(records) == 2 and len(damaged) == 1
    records, damaged = read(b"no archive at all\n" * 50)
    assert records == [] and len(damaged) == 1 and "bytes passed over" in damaged[0]


def test_conversion_of_legacy_archives(spark):
    folder = shared_dir(spark, "test-arc")
    long = b"HTTP/1.0 200 OK\nX-Record-Key: %d\n\n" + b"x" * 200
    for name, data in (("a.arc.gz", archive(1, [v1(b"http://a/", long % 5), (b"broken", b"")])), ("b.arc.gz", archive(2, [v2("http://é/".encode("latin-1"), long % 4)]))):
        with writing(f"{folder}/{name}") as out:
            out.write(gzip.compress(data))
    with writing(f"{folder}/c.arc") as out:  # plain, two archives in one
        out.write(archive(1, [v1(b"http://c/", long % 6)]) + archive(2, [v2(b"http://d/", b"HTTP/1.0 200 OK\nX-Record-Key: 7\n\nseven")]))
    with writing(f"{folder}/d.arc") as out:
        out.write(b"\x00\x01 nothing that can be read")
    arcs = spark.createDataFrame([(f"{folder}/{x}", 1) for x in ("a.arc.gz", "b.arc.gz", "c.arc", "d.arc")], "uri string, records long")
    warcs = warc.convert_arcs(arcs, shared_dir(spark, "test-warc"))
    assert sorted(len(r.damaged) for r in warcs.collect()) == [0, 0, 1, 1]
    got = {r.page_id: r for r in warc.read_warcs(warcs).collect()}
    assert got[4].record_type == "response" and (got[5].record_type, got[5].refers_to, got[5].payload_bytes) == ("revisit", 4, 200)
    assert (got[6].refers_to, got[7].payload_bytes) == (4, 5)


def test_query_against_a_plain_version(spark, tmp_path):
    long, other = "y" * 150, "é" * 60
    rows = [(i, f"http://h/{i}", [long, other, "short", None, "", "z" * 300_000][i % 6], "clash", "c") for i in range(60)]
    rows += [(None, "u", long, "clash", "c"), (0, "http://h/0", long, "clash", "c")]  # a null key, a repeated row
    folder = str(tmp_path)
    spark.createDataFrame(rows, "page_id long, url string, html string, HTML_ string, payload_digest string").write.parquet(f"{folder}/pages.parquet")
    want = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, *_ in rows if p is not None and (h or "").encode() == data]
        again = page is not None and len(data) >= 100 and min(same) < page
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    got = warc.op1_arc_to_warc(spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    versions = set()
    for r in warc.write_arcs(spark.read.parquet(f"{folder}/pages.parquet"), shared_dir(spark, "test-versions")).collect():
        with reading(r.uri) as f:
            versions.add(next(warc.parse_arc(warc.unzipped(f)))["version"])
    assert versions == {1, 2}
    empty = spark.read.parquet(f"{folder}/pages.parquet").where("false")
    assert warc.read_warcs(warc.convert_arcs(warc.write_arcs(empty, shared_dir(spark, "e")), shared_dir(spark, "e"))).count() == 0
