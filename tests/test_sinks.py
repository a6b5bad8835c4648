"""Feeds are told by their kind or their first characters, reports keep their nesting, a run's probes count once."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import feeds, ingest
from corpusloom.sources import html, records


@pytest.mark.parametrize(
    ("kind", "body", "want"),
    [
        ("application/rss+xml; charset=utf-8", "", True),
        ("application/ATOM+xml", None, True),
        ("text/html", "<?xml version='1.0'?><rss version='2.0'>", True),
        (None, "<FEED xmlns='http://www.w3.org/2005/Atom'>", True),
        ("text/html", "<html>" + " " * 500 + "<rss>", False),
        ("text/html", "<html><p>rss</p>", False),
        (None, None, False),
    ],
)
def test_looks_like_feed(spark, kind, body, want):
    df = spark.createDataFrame([(kind, body)], "k string, b string")
    assert df.select(html.looks_like_feed(F.col("k"), F.col("b")).alias("x")).first().x is want


def test_a_report_keeps_its_nesting(spark, tmp_path):
    rows = spark.createDataFrame([(1, {"a": 2}, [("x", None)]), (2, None, [])], "id long, counts map<string,int>, items array<struct<k:string,v:string>>")
    for _ in range(2):  # written again, it is replaced
        records.write_report(rows, str(tmp_path / "report"))
    got = sorted((json.loads(line) for f in (tmp_path / "report").glob("*.json") for line in f.read_text().splitlines()), key=lambda r: r["id"])
    assert got == [{"id": 1, "counts": {"a": 2}, "items": [{"k": "x"}]}, {"id": 2, "items": []}]
    records.write_report(rows.where("false"), str(tmp_path / "empty"))
    assert spark.read.schema(rows.schema).json(str(tmp_path / "empty")).count() == 0


def test_probes_are_appended_once(spark, tmp_path):
    at = lambda d, h=0: datetime.datetime(2026, 4, d, h)
    schema, path = "probe_id long, member_id long, checked_at timestamp, url_status int", str(tmp_path / "log")
    one = spark.createDataFrame([(1, 7, at(1), 200), (2, 8, at(2), 500)], schema)
    two = spark.createDataFrame([(3, 7, at(3), 404), (4, 7, at(3), 200), (5, 9, None, 200)], schema)
    ingest.append_probes(one, path, "a")
    ingest.append_probes(two, path, "b")
    ingest.append_probes(two, path, "b")  # a repeated run replaces its own rows
    log = spark.read.parquet(path)
    assert log.count() == 5
    assert sorted((r.member_id, r.probe_id) for r in ingest.newest_probes(log, "2026-01-01").collect()) == [(7, 4), (8, 2)]
    assert [r.member_id for r in ingest.newest_probes(log, "2026-04-03").collect()] == [7]
    assert "PartitionFilters: [isnotnull(day" in ingest.newest_probes(log, "2026-04-03")._jdf.queryExecution().toString()


def test_repairs_with_nulls(spark):
    schema = "release_id long, member_id long, url string, published_at timestamp_ntz, body_text string, content_type string, deleted_at timestamp, date_source string, confidence double, chamber string"
    rows = spark.createDataFrame([(1, None, None, None, None, None, None, None, None, "x"), (2, 5, "https://a/B.PDF", datetime.datetime(2026, 1, 1), "", "press_release", None, "meta_tag", 0.95, "x")], schema)
    got = sorted((r.release_id, r.kind) for r in feeds.repair_kinds(rows.drop("chamber"), spark.createDataFrame([(5, "tx_senate")], "member_id long, chamber string")).collect())
    assert got == [(1, "no_body"), (1, "null_date"), (2, "document_body"), (2, "no_body")]
