"""The tables that operators work on: members, releases, pages, versions, url_checks, runs, probes, activity.

``Tables.of(spark, sf_dir)`` derives them lazily from the given parquet tables; each is a plan over a scan, so column pruning and
pushed filters reach the files. Timestamps have no time zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment that the derived releases and activity are looked at, and the start of the corpus.
AS_OF = "2026-04-26 00:00:00"
ACTIVITY_AS_OF = "2024-01-31 00:00:00"
WINDOW_START = "2025-01-01 00:00:00"


def ts(value: str | Column) -> Column:
    return (F.lit(value) if isinstance(value, str) else value).cast("timestamp_ntz")


def days(n) -> Column:
    return F.make_dt_interval(days=n if isinstance(n, Column) else F.lit(n))


@dataclass
class Tables:
    members: DataFrame
    releases: DataFrame
    activity: DataFrame
    pages: DataFrame
    versions: DataFrame
    url_checks: DataFrame
    runs: DataFrame
    probes: DataFrame

    @staticmethod
    def of(spark: SparkSession, sf_dir: str) -> Tables:
        read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        seg, d = F.col("c_mktsegment"), F.col("doc_id")
        members = (
            read("customer")
            .join(read("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
            .join(read("region"), F.col("r_regionkey") == F.col("n_regionkey"))
            .select(
                F.col("c_custkey").alias("member_id"),
                F.col("c_name").alias("full_name"),
                F.when(seg.isin("AUTOMOBILE", "BUILDING"), "D").when(seg.isin("FURNITURE", "HOUSEHOLD"), "R").otherwise("I").alias("party"),
                F.col("n_name").alias("state"),
                F.when(F.col("r_name").isin("ASIA", "EUROPE"), "tx_senate").otherwise("senate").alias("chamber"),
                F.when(F.col("c_acctbal") < 0, "former").otherwise("active").alias("status"),
                F.when(F.col("c_custkey") % 10 == 9, None).when(F.col("c_custkey") % 3 == 0, "rss").otherwise("httpx").alias("collection_method"),
            )
        )
        offset = days(((d * 7919) % 480).cast("int"))
        releases = read("documents").select(
            d.alias("release_id"),
            ((d * 31) % 150).alias("member_id"),
            F.substring("text", 1, 120).alias("title"),
            F.col("text").alias("body_text"),
            F.when(d % 37 == 0, None).otherwise(ts("2025-01-01 00:00:00") + offset).alias("published_at"),
            (ts("2025-01-01 06:00:00") + offset).alias("scraped_at"),
            F.when(d % 29 == 0, ts("2026-04-20 00:00:00")).alias("deleted_at"),
            F.when(d % 7 == 0, "statement").when(d % 7 == 1, "op_ed").when(d % 7 == 2, "photo_release").when(d % 7 == 3, "blog").otherwise("press_release").alias("content_type"),
            "lang",
            "source",
        )
        events = read("events")
        at, e = F.col("ts").cast("timestamp_ntz"), F.col("event_id")
        activity = events.select(e.alias("release_id"), F.col("user_id").alias("member_id"), at.alias("published_at"), F.col("event_type").alias("content_type"), "value", "props")
        versions = releases.where(F.col("release_id") % 11 == 0).select(
            F.col("release_id").alias("version_id"), "release_id", F.replace(F.substring("body_text", 1, 200), F.lit("the "), F.lit("")).alias("body_text"), (F.col("scraped_at") + days(1)).alias("captured_at")
        )
        pages = read("pages")
        n, p = F.col("n"), F.col("page_id") % 9
        url_checks = pages.select("page_id", "url", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n")).select(
            "page_id",
            "url",
            (ts("2026-04-25 00:00:00") + F.make_dt_interval(mins=n)).alias("checked_at"),
            F.when(p == 0, 404).when(p == 1, F.when(n == 2, 200).otherwise(404)).when(p == 2, 410).when(p == 3, F.when(n == 0, 410).otherwise(404)).when(p == 4, 403).otherwise(200).alias("status"),
        )
        runs = events.where(e % 50 == 0).select(
            e.alias("run_id"),
            F.when(e % 100 == 0, "daily").otherwise("backfill").alias("run_type"),
            at.alias("started_at"),
            F.when(e % 11 == 0, None).otherwise(at + F.make_dt_interval(mins=(e % 7).cast("int"))).alias("finished_at"),
            F.col("props").alias("stats"),
        )
        probes = events.select(e.alias("probe_id"), F.col("user_id").alias("member_id"), at.alias("checked_at"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("url_status"), (e % 4).alias("items_found"))
        return Tables(members, releases, activity, pages, versions, url_checks, runs, probes)


#: The same tables as SQL, for the queries that state expected results.
VIEWS_SQL = """WITH RECURSIVE members AS (
SELECT c.c_custkey AS member_id, c.c_name AS full_name,
  CASE WHEN c.c_mktsegment IN ('AUTOMOBILE','BUILDING') THEN 'D' WHEN c.c_mktsegment IN ('FURNITURE','HOUSEHOLD') THEN 'R' ELSE 'I' END AS party,
  n.n_name AS state, CASE WHEN r.r_name IN ('ASIA','EUROPE') THEN 'tx_senate' ELSE 'senate' END AS chamber,
  CASE WHEN c.c_acctbal < 0 THEN 'former' ELSE 'active' END AS status,
  CASE WHEN c.c_custkey % 10 = 9 THEN NULL WHEN c.c_custkey % 3 = 0 THEN 'rss' ELSE 'httpx' END AS collection_method
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey),
releases AS (
SELECT doc_id AS release_id, (doc_id * 31) % 150 AS member_id, substr(text, 1, 120) AS title, text AS body_text,
  CASE WHEN doc_id % 37 = 0 THEN NULL ELSE TIMESTAMP '2025-01-01 00:00:00' + CAST((doc_id * 7919) % 480 AS INT) * INTERVAL '1' DAY END AS published_at,
  TIMESTAMP '2025-01-01 06:00:00' + CAST((doc_id * 7919) % 480 AS INT) * INTERVAL '1' DAY AS scraped_at,
  CASE WHEN doc_id % 29 = 0 THEN TIMESTAMP '2026-04-20 00:00:00' ELSE NULL END AS deleted_at,
  CASE doc_id % 7 WHEN 0 THEN 'statement' WHEN 1 THEN 'op_ed' WHEN 2 THEN 'photo_release' WHEN 3 THEN 'blog' ELSE 'press_release' END AS content_type,
  lang, source FROM documents),
visible AS (SELECT * FROM releases WHERE deleted_at IS NULL AND content_type <> 'photo_release'),
activity AS (SELECT event_id AS release_id, user_id AS member_id, CAST(ts AS TIMESTAMP) AS published_at, event_type AS content_type, value, props FROM events),
versions AS (SELECT release_id AS version_id, release_id, replace(substr(body_text, 1, 200), 'the ', '') AS body_text, scraped_at + INTERVAL '1' DAY AS captured_at FROM releases WHERE release_id % 11 = 0),
url_checks AS (SELECT page_id, url, TIMESTAMP '2026-04-25 00:00:00' + CAST(n AS INT) * INTERVAL '1' MINUTE AS checked_at,
  CASE page_id % 9 WHEN 0 THEN 404 WHEN 1 THEN CASE WHEN n = 2 THEN 200 ELSE 404 END WHEN 2 THEN 410 WHEN 3 THEN CASE WHEN n = 0 THEN 410 ELSE 404 END WHEN 4 THEN 403 ELSE 200 END AS status
  FROM pages, range(0, 4) AS x(n)),
runs AS (SELECT event_id AS run_id, CASE WHEN event_id % 100 = 0 THEN 'daily' ELSE 'backfill' END AS run_type, CAST(ts AS TIMESTAMP) AS started_at,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) + CAST(event_id % 7 AS INT) * INTERVAL '1' MINUTE END AS finished_at, props AS stats FROM events WHERE event_id % 50 = 0),
probes AS (SELECT event_id AS probe_id, user_id AS member_id, CAST(ts AS TIMESTAMP) AS checked_at, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS url_status, event_id % 4 AS items_found FROM events)
"""
