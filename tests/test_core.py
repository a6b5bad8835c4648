"""Core queries against their SQL, and row-level rules on literal cases."""

import datetime
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import columns as C
from corpusloom.operators import checks, ingest, lookups
from corpusloom.plans import catalog
from corpusloom.sources import html
from corpusloom.sources.tables import Tables
from corpusloom.streaming import streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    mine = Counter(repr([plain(r[c]) for c in names]) for r in df.collect())
    found = duck.execute(catalog.oracle_sql()[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == names
    assert mine == Counter(repr([plain(r[at.index(c)]) for c in names]) for r in found.fetchall())


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,day", [("April 15, 2026", "2026-04-15"), ("Apr 15, 2026", "2026-04-15"), ("April 17th, 2026", "2026-04-17"), ("04/15/2026", "2026-04-15"), ("4.15.26", "2026-04-15"), ("2026-04-15", "2026-04-15"), ("Feb 30, 2026", None)])
def test_date_text(spark, text, day):
    found = one(spark, C.parse_date_text(F.col("t")), t=text).value
    assert found == (datetime.date.fromisoformat(day) if day else None)


@pytest.mark.parametrize("url,day,confidence", [("/2026/04/15/x", "2026-04-15", 0.9), ("/2026/04/x", "2026-04-01", 0.7), ("/04/15/2026/x", "2026-04-15", 0.8), ("/a/b", None, None)])
def test_date_from_url(spark, url, day, confidence):
    found = one(spark, C.date_from_url(F.col("u")), u="https://h.gov" + url)
    assert (found.value and found.value.isoformat(), found.confidence) == (day, confidence)


def test_normalize_url(spark):
    assert one(spark, C.normalize_url(F.col("u")), u="http://X.Senate.gov/A/?ID=1&utm_source=z#f") == "https://x.senate.gov/A?id=1"


@pytest.mark.parametrize("title,url,kind", [("Leads Letter to X", "https://h/press-releases/a", "press_release"), ("LETTER: to X", "https://h/a", "letter"), ("x", "https://h/op-eds/a", "op_ed"), ("Photo: x", "https://h/a", "photo_release"), ("x", "https://h/a", "press_release")])
def test_classify(spark, title, url, kind):
    assert one(spark, C.classify(F.col("t"), F.col("u")), t=title, u=url) == kind


def test_feed_date_repairs_day_of_year(spark):
    assert one(spark, C.parse_feed_date(F.col("t")), t="Thu, 113 Apr 2026 12:00:00 EST").date() == datetime.date(2026, 4, 23)


def test_upsert_is_idempotent(spark):
    schema = "url string, title string, body_text string, content_hash string"
    target = spark.createDataFrame([("a", "t", "old", "1"), ("b", "t", "same", "2")], schema)
    batch = spark.createDataFrame([("a", "t", "new", "9"), ("b", "t", "same", "2"), ("c", "t", "x", "3"), ("c", "t", "x", "3")], schema)
    first = ingest.upsert(target, batch)
    assert {r.url: r.outcome for r in first.collect()} == {"a": "updated", "b": "touched", "c": "inserted"}
    assert [r.body_text for r in ingest.archived(first).collect()] == ["old"]
    again = ingest.upsert(ingest.applied(target, first), batch)
    assert {r.outcome for r in again.collect()} == {"touched"}


def test_diversified_feeds(spark):
    rows = [(i, m, "c", i) for i, m in enumerate([1, 1, 1, 1, 2, 2, 3, 1])]
    feeds = spark.createDataFrame(rows, "release_id long, member_id long, chamber string, at long").withColumn("effective_at", -F.col("at"))
    got = [r.release_id for r in checks.diversified(feeds, "chamber").orderBy("place").collect()]
    assert got == [0, 1, 4, 2, 3, 5, 6, 7]
    page = checks.diversified(feeds.where("member_id = 1"), "chamber", size=3).collect()
    assert len(page) == 3
    assert checks.diversified(feeds.where("false"), "chamber").count() == 0


def test_feed_items(spark):
    rss = "<rss><item><title>A &amp; B</title><link>https://h/a</link><pubDate>Thu, 16 Apr 2026 12:00:00 EST</pubDate><description><![CDATA[<p>x</p>]]></description></item><item><title>no link</title></item></rss>"
    atom = '<feed><entry><title>C</title><link href="https://h/c"/><updated>2026-04-15T10:00:00Z</updated></entry></feed>'
    feeds = spark.createDataFrame([(1, rss), (2, atom), (3, None), (4, "")], "feed_id long, xml string")
    got = {(r.feed_id, r.title, r.link, str(r.published_at.date()), r.summary) for r in html.feed_items(feeds).collect()}
    assert got == {(1, "A & B", "https://h/a", "2026-04-16", "x"), (2, "C", "https://h/c", "2026-04-15", "")}
    q = {r.feed_id: (r.n_items, r.dated_share, r.stale_days) for r in html.feed_quality(html.feed_items(feeds), "2026-04-26").collect()}
    assert q == {1: (1, 1.0, 10), 2: (1, 1.0, 11)}


@pytest.mark.parametrize(
    "page,day,source",
    [
        ('<meta property="article:published_time" content="2026-04-15T00:00:00Z"><time datetime="2026-01-01">', "2026-04-15", "meta_tag"),
        ('{"datePublished": "2026-04-14"}', "2026-04-14", "json_ld"),
        ('<time datetime="2026-04-13">x</time>', "2026-04-13", "time_element"),
        ("<time>April 12, 2026</time>", "2026-04-12", "time_text"),
        ("<p>2026-04-11</p>", None, None),
    ],
)
def test_date_from_html(spark, page, day, source):
    found = one(spark, html.date_from_html(F.col("h")), h=page)
    assert (found.value and found.value.isoformat(), found.source) == (day, source)


def run_stream(frame, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return frame.sparkSession.table(name).collect()


def test_stream_of_checks_equals_the_batch(spark, tmp_path):
    schema = "url string, status int, checked_at timestamp, page_id long"
    at = lambda i: datetime.datetime(2026, 4, 25, 0, i)
    codes = {"a": [404] * 4, "b": [410, 404, 404, 404], "c": [404, 404, 200, 404, 404, 404], "d": [404, 410, 404, 410], "e": [404, 404, 404]}
    for k in (0, 1, 2):  # three files, one for each batch
        rows = [(u, s, at(i), 0) for u, c in codes.items() for i, s in enumerate(c) if i // 2 == k]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    want = {r.url for r in ingest.tombstones(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert {r.url for r in run_stream(streams.gone_urls(stream), "gone")} == want == {"a", "b"}


def test_stream_of_activity(spark, tmp_path):
    at = lambda d: datetime.datetime(2026, 4, d, 9)
    spark.createDataFrame([("x", at(1)), ("x", at(1)), ("y", at(2))], "content_type string, published_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("content_type string, published_at timestamp").parquet(str(tmp_path / "in"))
    got = {(r.content_type, r.day.isoformat(), r.n) for r in run_stream(streams.activity_windows(stream), "activity_days", "complete")}
    assert got == {("x", "2026-04-01", 2), ("y", "2026-04-02", 1)}


def test_stream_of_upserts(spark, tmp_path):
    log, versions, source = str(tmp_path / "log"), str(tmp_path / "versions"), str(tmp_path / "in")
    for rows in ([("a", "t", "old", "1"), ("b", "t", "same", "2")], [("a", "t", "new", "9"), ("b", "t", "same", "2"), ("c", "t", "x", "3")]):
        spark.createDataFrame(rows, streams.LOG).coalesce(1).write.mode("append").parquet(source)
        q = streams.upsert_stream(spark.readStream.schema(streams.LOG).parquet(source), log, versions, str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    assert {(r.url, r.body_text) for r in streams.current(spark, log).collect()} == {("a", "new"), ("b", "same"), ("c", "x")}
    assert [(r.url, r.body_text) for r in spark.read.parquet(versions).collect()] == [("a", "old")]


@pytest.mark.parametrize("name,family", [("Ann Lee", "Lee"), ("Bo Roe, Jr.", "Roe"), ("Cy Poe III", "Poe"), ("", "")])
def test_family_name(spark, name, family):
    assert one(spark, lookups.family_name(F.col("n")), n=name) == family


def test_stream_of_first_seen(spark, tmp_path):
    at = lambda d: datetime.datetime(2026, 4, d, 9)
    spark.createDataFrame([("a", at(1)), ("a", at(2)), ("b", at(2)), (None, at(3))], "url string, published_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, published_at timestamp").parquet(str(tmp_path / "in"))
    assert sorted(str(r.url) for r in run_stream(streams.first_seen(stream), "first_seen")) == ["None", "a", "b"]


def test_version_similarity_reads_whole_texts(spark):
    """An edit after many characters counts: of 101 words the version lacks one."""
    body = " ".join(f"word{i}" for i in range(100)) + " the end"
    rows = [(1, body), (2, "the end"), (3, ""), (4, "no article")]
    d = spark.createDataFrame(rows, "release_id long, body_text string")
    t = Tables(None, d, *[None] * 6)
    got = {r.release_id: r.similarity for r in catalog._QUERIES["b39_whole_version_similarity"][0](t).collect()}
    want = {}
    for i, text in rows:
        a, b = set(text.replace("the ", "").split()), set(text.split())
        want[i] = round(len(a & b) / len(a | b), 6) if a | b else 1.0
    assert got == want and got[1] < 1


def test_version_similarity_against_brute_force(spark):
    import re

    words = lambda x: {w for w in re.split("[^a-z0-9]+", x.lower()) if w}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.release_id: r.similarity for r in catalog.queries()["b39_whole_version_similarity"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        if text is not None:
            a, b = words(text.replace("the ", "")), words(text)
            assert got[i] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=1e-6)
