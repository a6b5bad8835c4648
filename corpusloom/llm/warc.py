"""Web archives: ARC files of either version, converted to WARC files, which are read back.

``write_arcs`` makes ARC shards from a table of pages (versions 1 and 2 in turn, two shards at least), ``convert_arcs`` turns ARC
shards into WARC shards, ``read_warcs`` reads WARC shards. All archives are gzip files with one member for each record.

An ARC file begins with a record whose body names the version and the fields of every header line; each later record is such
a header line, as many bytes as its length field declares, and a line feed. The converter takes the fields by the names in
that body, and from the right for the one field that may hold spaces (the address). Bytes that are no UTF-8 are read as Latin-1, and
heads of responses may end their lines with LF alone. It synthesises, for each record:

* WARC-Record-ID: a name-based UUID of the archive's name and the record's place in it, so a repeated run gives equal ids,
* WARC-Date from the 14-digit date, WARC-Type by address and content (warcinfo for the file's own record, response for HTTP,
  resource for the rest), WARC-Payload-Digest and WARC-Block-Digest (SHA-256),
* the fields that only version 2 has (result code, checksum, location) as WARC-X-ARC-... headers, unless they are "-",
* revisit records: of records with equal payloads of at least MIN_REVISIT bytes, the one with the smallest key is the
  response and the others refer to it.

A record that can't be read (a header line of other fields, a length that is no number or runs past the end) is left out and
counted in ``damaged``, with the bytes passed over; reading goes on at the next line that looks like a header, in the bytes that a wrong length had
taken as well. Archives may be gzip or plain, and several in one file, each with a record of its own that names its
fields; a file that is no archive is one damaged entry.

Which record is a revisit is found over (archive, place, key, digest) rows only: payloads are never shuffled. Rows of a frequent
payload are dealt to several tasks in the join by digest.

Cases: null html gives an empty payload; a null url is written as ``unknown:``; blanks and control characters of a url are
percent-encoded; a record with a null key is always a response; rows that repeat the smallest key are all responses; an
empty table gives archives with no page; other columns are left out.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, grouped, hot_keys, salted_join, shared_dir, small_batches, table, take, written, written_at
from .files import reading, writing

#: About so many characters of pages make one archive.
SHARD_CHARS = 64 << 20
#: Payloads shorter than this are never revisits.
MIN_REVISIT = 100
CAPTURED = "20260101000000"

# The header fields of the two versions of the ARC format.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
KEY_FIELD = "X-Record-Key"
REFERS_KEY_FIELD = "WARC-X-Refers-To-Key"
LENGTH_FIELD = "WARC-X-Payload-Length"
#: Fields of version 2 that become headers of the WARC record.
KEPT_FIELDS = ["Result-code", "Checksum", "Location"]
#: A line that looks like a record's header: an address, another field, a date, at last a length.
HEADER = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]*:[^\r\n]* \S+ [0-9]{8,14} [^\r\n]*[0-9]+\r?\n")
BLANK_LINE = re.compile(rb"\r?\n\r?\n")


def text_of(data: bytes) -> str:
    """UTF-8, or Latin-1 where the bytes are none."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def unzipped(f) -> io.BufferedReader:
    """The bytes of an archive, gzip or plain."""
    zipped = f.read(2) == b"\x1f\x8b"
    f.seek(0)
    return io.BufferedReader(gzip.GzipFile(fileobj=f, mode="rb") if zipped else f, 1 << 20)


def exactly(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ValueError(f"the record ends {n - len(data)} bytes early")
    return data


class Rereadable:
    """A stream to which bytes can be given back."""

    def __init__(self, f):
        self.f, self.back = f, io.BytesIO()

    def readline(self) -> bytes:
        line = self.back.readline()
        return line if line.endswith(b"\n") else line + self.f.readline()

    def read(self, n: int) -> bytes:
        """n bytes, fewer at the end of the stream or where the archive is damaged."""
        parts = [self.back.read(n)]
        left = n - len(parts[0])
        while left > 0:
            try:
                data = self.f.read(min(left, 1 << 20))
            except (EOFError, OSError, zlib.error):
                data = b""
            if not data:
                break
            parts.append(data)
            left -= len(data)
        return b"".join(parts)

    def give_back(self, data: bytes) -> None:
        self.back = io.BytesIO(data + self.back.read())


# ---------------------------------------------------------------- ARC


def arc_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "unknown:"


def arc_record(version: int, url: str, mime: str, body: bytes, name: str, offset: int) -> bytes:
    values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": CAPTURED, "Content-type": mime, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(body))}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode("utf-8") + b"\n" + body + b"\n"


def http_block(key, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
    return (head + (f"{KEY_FIELD}: {key}\r\n" if key is not None else "") + "\r\n").encode() + payload


def write_arcs(pages: DataFrame, folder: str) -> DataFrame:
    """(uri, records) of the ARC shards. Shards 0, 2, ... have version 1, shards 1, 3, ... version 2."""
    p = take(pages, "page_id", "url", "html")
    chars = p.agg(F.sum(F.length("html"))).first()[0] or 0
    n = max(2, -(-chars // SHARD_CHARS), min(-(-chars >> 20), 2 * p.sparkSession.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:06d}.arc.gz"
        uri, k, at = f"{folder}/{name}", 0, 0
        with writing(uri) as out:
            about = f"{version} 0 corpusloom\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
            at += out.write(member(arc_record(version, f"filedesc://{name}", "text/plain", about, name, 0))) or 0
            for b in batches:
                for key, url, html in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                    data = member(arc_record(version, arc_url(url), "text/html", http_block(key, (html or "").encode("utf-8")), name, at))
                    out.write(data)
                    at, k = at + len(data), k + 1
        yield pa.record_batch([pa.array([uri]), pa.array([k], pa.int64())], ["uri", "records"])

    return written(small_batches(p).repartition(n, "page_id").mapInArrow(run, "uri string, records long"), "arcs")


def parse_arc(f, damaged: list[str] | None = None) -> Iterator[dict]:
    """The records of one ARC stream: its fields by name, ``body``, and ``place`` (0 for the file's own record, then the count of
    readable records). Why a record was left out is added to ``damaged``."""
    fields, place, lost = ARC_FIELDS[1], 0, 0
    damaged = [] if damaged is None else damaged
    f = Rereadable(f)

    def passed_over() -> None:
        if lost > 1:
            damaged[-1] += f" ({lost} bytes passed over)"

    while True:
        try:
            line = f.readline()
        except (EOFError, OSError, zlib.error) as e:  # the archive itself is cut off or damaged
            passed_over()
            damaged.append(str(e))
            return
        if not line:
            passed_over()
            return
        if line in (b"\n", b"\r\n") or lost and not HEADER.fullmatch(line):
            lost += len(line) if lost else 0
            continue
        passed_over()
        lost = 0
        head = text_of(line).rstrip("\r\n")
        own = place == 0 or head.startswith("filedesc:")  # the record of an archive itself; another archive may follow
        names = ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"] if own else fields
        values = head.rsplit(" ", len(names) - 1)
        record = dict(zip(names, values, strict=False))
        if len(values) != len(names) or not record["Archive-length"].isdecimal() or not record["Archive-date"].isdecimal():
            damaged.append(f"not a header of {len(names)} fields: {head[:200]}")
            lost = len(line)
            continue
        size = int(record["Archive-length"][:18])
        body = f.read(size)
        if len(body) < size:
            damaged.append(f"{record['URL'][:200]}: the record ends {size - len(body)} bytes early")
            f.give_back(body)
            lost = len(line)
            continue
        if record["URL"].startswith("filedesc:"):
            lines = text_of(body).split("\n")
            version = lines[0].split(" ")[0]
            record["version"] = int(version) if version in ("1", "2") else 1
            if version not in ("1", "2"):
                damaged.append(f"{record['URL'][:200]}: ARC version {version[:20]!r} is read as 1")
            fields = lines[1].split() if len(lines) > 1 and "Archive-length" in lines[1] else ARC_FIELDS[record["version"]]
            yield record | {"body": body, "place": 0, "first": place == 0}
            place = max(place, 1)
            continue
        place = max(place, 1)  # no record of its own: version 1
        yield record | {"body": body, "place": place}
        place += 1


def http_parts(body: bytes) -> tuple[bytes, bytes]:
    """(status line and headers with their blank line, payload); a body that isn't HTTP is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    m = BLANK_LINE.search(body)
    return (body[: m.end()], body[m.end() :]) if m else (body, b"")


def field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return text_of(m[1]).strip() if m else None


def record_id(name: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{name}#{place}')}>"


def arc_index(arcs: DataFrame) -> DataFrame:
    """(uri, place, key, digest, n_bytes, url) of every page in the archives; no payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows = []
                with reading(uri) as f:
                    for r in parse_arc(unzipped(f)):
                        if r["place"]:
                            head, payload = http_parts(r["body"])
                            key = field(head, KEY_FIELD)
                            rows.append((uri, r["place"], int(key) if key else None, hashlib.sha256(payload).hexdigest(), len(payload), r["URL"]))
                        if len(rows) == 4096:
                            yield INDEX(rows)
                            rows = []
                yield INDEX(rows)

    return spread(arcs).mapInArrow(run, "uri string, place int, key long, digest string, n_bytes long, url string")


def INDEX(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["uri", "place", "key", "digest", "n_bytes", "url"])


def spread(listed: DataFrame) -> DataFrame:
    """A row is a whole archive: about one task for each."""
    n = listed.count()
    return listed.select("uri").repartition(max(1, min(n, 100_000)), "uri")


def revisits(index: DataFrame) -> DataFrame:
    """(uri, place, refers_uri, refers_place, refers_key, refers_url) of the records that repeat another's payload."""
    long = index.where((F.col("n_bytes") >= MIN_REVISIT) & F.col("key").isNotNull())
    first = written(long.groupBy("digest").agg(F.min(F.struct("key", "uri", "place", "url")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first-payloads")
    return (
        salted_join(long, first.select("digest", "first"), "digest", hot_keys(first, "digest", "n"))
        .where(F.col("key") != F.col("first.key"))
        .select("uri", "place", F.col("first.uri").alias("refers_uri"), F.col("first.place").alias("refers_place"), F.col("first.key").alias("refers_key"), F.col("first.url").alias("refers_url"))
    )


# ---------------------------------------------------------------- WARC


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode("utf-8") + block + b"\r\n\r\n"


def warc_date(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def as_warc(r: dict, name: str, refers: tuple | None) -> bytes:
    """The WARC record that stands for an ARC record; ``refers``: (uri, place, key, url) of the response it repeats."""
    fields = [("WARC-Record-ID", record_id(name, r["place"])), ("WARC-Date", warc_date(r["Archive-date"]))]
    if r["place"] == 0:
        body = f"software: corpusloom\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC {r['version']}\r\n".encode()
        return warc_record([("WARC-Type", "warcinfo"), *fields, ("WARC-Filename", name.replace(".arc", ".warc")), ("Content-Type", "application/warc-fields")], body)
    head, payload = http_parts(r["body"])
    kind = "revisit" if refers else "response" if head else "resource"
    block = head if refers else r["body"]
    fields = [("WARC-Type", kind), *fields, ("WARC-Target-URI", r["URL"]), ("WARC-IP-Address", r.get("IP-address", "0.0.0.0")), ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()), ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Type", "application/http; msgtype=response" if head else r["Content-type"])]
    fields += [(f"WARC-X-ARC-{f}", r[f]) for f in KEPT_FIELDS if r.get(f, "-") != "-"]
    if refers:
        uri, place, key, url = refers
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(uri.rsplit("/", 1)[1], place)), ("WARC-Refers-To-Target-URI", url), (REFERS_KEY_FIELD, str(key)), (LENGTH_FIELD, str(len(payload)))]
    return warc_record(fields, block)


def convert_arcs(arcs: DataFrame, folder: str) -> DataFrame:
    """Turn each ARC shard into a WARC shard. Returns (uri, records, damaged): how many records were written, and why others were not."""
    index, index_at = written_at(arc_index(arcs), "arc-index")
    again = revisits(index)
    none = [F.lit(None).cast(t).alias(n) for n, t in (("place", "int"), ("refers_uri", "string"), ("refers_place", "int"), ("refers_key", "long"), ("refers_url", "string"))]
    per_arc = again.unionByName(arcs.select("uri", *none)).repartition(max(1, arcs.count()), "uri").sortWithinPartitions("uri")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["uri"]):
            uri = t.column("uri")[0].as_py()
            refers = {r["place"]: (r["refers_uri"], r["refers_place"], r["refers_key"], r["refers_url"]) for r in t.to_pylist() if r["place"] is not None}
            name = uri.rsplit("/", 1)[1]
            to, k = f"{folder}/{name.replace('.arc', '.warc')}", 0
            damaged: list[str] = []
            with reading(uri) as f, writing(to) as out:
                for r in parse_arc(unzipped(f), damaged):
                    if not r.get("first", True):  # one warcinfo record stands for all archives of a file
                        continue
                    out.write(member(as_warc(r, name, refers.get(r["place"]))))
                    k += 1
            yield pa.record_batch([pa.array([to]), pa.array([k], pa.int64()), pa.array([damaged], pa.list_(pa.string()))], ["uri", "records", "damaged"])

    out = written(per_arc.mapInArrow(run, "uri string, records long, damaged array<string>"), "warcs")
    discard(index_at)
    return out


def parse_warc(f) -> Iterator[tuple[bytes, bytes]]:
    """(header lines, block) of each record."""
    while True:
        line = f.readline()
        while line == b"\r\n":
            line = f.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        lines = []
        while (line := f.readline()) not in (b"\r\n", b""):
            lines.append(line)
        head = b"".join(lines)
        yield head, exactly(f, int(field(head, "Content-Length")))


def read_warcs(warcs: DataFrame) -> DataFrame:
    """(page_id, url, warc_date, payload_bytes, payload_digest, record_type, refers_to, record_id) of each page record. A response's payload is
    checked against its digest; a revisit has the digest and length it declares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows = []
                with reading(uri) as f:
                    for head, block in parse_warc(unzipped(f)):
                        kind = field(head, "WARC-Type")
                        if kind not in ("response", "revisit", "resource"):
                            continue
                        http, payload = http_parts(block)
                        said = field(head, "WARC-Payload-Digest").partition(":")[2]
                        n = int(field(head, LENGTH_FIELD)) if kind == "revisit" else len(payload)
                        if kind != "revisit" and hashlib.sha256(payload).hexdigest() != said:
                            raise ValueError(f"a payload in {uri} doesn't have its digest")
                        key, refers = field(http, KEY_FIELD), field(head, REFERS_KEY_FIELD)
                        rows.append((int(key) if key else None, field(head, "WARC-Target-URI"), field(head, "WARC-Date"), n, said, kind, int(refers) if refers else None, field(head, "WARC-Record-ID")))
                        if len(rows) == 4096:
                            yield PAGES(rows)
                            rows = []
                yield PAGES(rows)

    return spread(warcs).mapInArrow(run, "page_id long, url string, warc_date string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string")


def PAGES(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["page_id", "url", "warc_date", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = write_arcs(table(spark, sf_dir, "pages"), shared_dir(spark, "arc"))
    warcs = convert_arcs(arcs, shared_dir(spark, "warc"))
    return read_warcs(warcs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
  CASE WHEN f.first_id IS NULL OR f.first_id = d.page_id OR d.page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest AND d.payload_bytes >= 100
"""
