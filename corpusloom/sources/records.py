"""Records out of nested or marked-up texts: rosters, listings by year, posts, contacts, the body of a page; and two sinks."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .folders import small_batches
from .tree import Page

ROSTER = "struct<members:array<struct<id:string,full_name:string,chamber:string,party:string,selectors:map<string,string>>>>"
POST = """struct<uri:string,cid:string,record:struct<text:string,createdAt:string,reply:struct<parent:struct<uri:string>>>,
  embed:struct<`$type`:string,external:struct<uri:string>,record:struct<uri:string>,images:array<string>>>"""

# How footers introduce a contact, what is no name, and containers of a page's body in order (ancestor, element).
PERSON = r"([A-Z][a-z]+(?:\s+[A-Z]\.?\s*)?[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"
CONTACTS = [
    rf"(?i)(?:press\s+)?contact\s*:\s*{PERSON}(?:\s*[,\-]\s*(.+?))?(?:\n|$)",
    rf"(?i)for\s+(?:more\s+)?information\s*,?\s*contact\s+{PERSON}()",
    rf"(?i)media\s+contact\s*:\s*{PERSON}()",
    rf"(?i)spokesperson\s*:\s*{PERSON}()",
]
NO_NAMES = ["press release", "press secretary", "united states", "capitol hill", "read more", "click here", "senate office", "washington dc", "more information", "press office"]
EMAIL, PHONE = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", r"\(?[0-9]{3}\)?[\s.\-]?[0-9]{3}[\s.\-]?[0-9]{4}"
BODIES = [
    ("article", ".body"),
    ("", ".press-release-content"),
    ("", ".field-name-body"),
    ("", ".bodycopy"),
    ("", ".entry-content"),
    ("article", ".content"),
    ("", ".press_release__body"),
    ("", "#press-release-body"),
    ("", ".newsroom__press-release"),
    ("", ".et_pb_post_content"),
    ("", ".et_pb_text_inner"),
    (".elementor-widget-theme-post-content", ".elementor-widget-container"),
    ("", ".js-press-release"),
    ("", ".RawHTML"),
    ("", ".post-content"),
    ("", "#newscontent"),
    ("", "#press"),
    ("main", "article"),
    ("main", ".content"),
]
#: Pages that a worker gets at once.
ROWS = 200
#: A body has more characters than this.
SHORTEST_BODY = 100


def roster(files: DataFrame, chambers: list[str] | None = None) -> DataFrame:
    """(member_id, full_name, chamber, party, n_selectors) of the members in JSON files, which share a default chamber a file.

    files: json (one whole file a row, as ``spark.read.text(path, wholetext=True)`` gives), default_chamber.
    """
    m = files.select("default_chamber", F.explode(F.from_json("json", ROSTER)["members"]).alias("m"))
    rows = m.select(F.col("m.id").alias("member_id"), "m.full_name", F.coalesce("m.chamber", "default_chamber").alias("chamber"), "m.party", F.coalesce(F.size("m.selectors"), F.lit(0)).alias("n_selectors"))
    return rows.where(F.col("chamber").isin(chambers)) if chambers else rows


def year_listing(pages: DataFrame) -> DataFrame:
    """(page_id, pos, title, href, published, content_type) of the linked paragraphs of listings under headings of years.

    A paragraph's M/D/YYYY is its date; without one that the calendar has, January 1 of the last year in a heading above. Only
    documents, press pages and videos count. The order is that of one page's own elements.
    """
    blocks = F.regexp_extract_all("html", F.lit(r"(?is)<h3[^>]*>.*?</h3>|<p[\s>].*?</p>"), 0)
    rows = pages.select("page_id", F.posexplode(blocks).alias("pos", "block"))
    heading = F.when(F.col("block").rlike("(?i)^<h3"), F.nullif(F.regexp_extract(C.html_to_text(F.col("block")), r"^([0-9]{4})", 1), F.lit("")))
    rows = rows.withColumn("year", F.last(heading, ignorenulls=True).over(Window.partitionBy("page_id").orderBy("pos")))
    rows = rows.where(~F.col("block").rlike("(?i)^<h3"))
    href, label = F.regexp_extract("block", r'(?is)<a [^>]*?href="([^"]*)"', 1), C.html_to_text(F.regexp_extract("block", r"(?is)<a [^>]*>(.*?)</a>", 1))
    rows = rows.select("page_id", "pos", "year", href.alias("href"), label.alias("label"), F.regexp_extract(C.html_to_text(F.col("block")), r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})", 1).alias("day"))
    low = F.lower("href")
    video = low.contains("videoplayer.php")
    kept = rows.where((F.col("label") != "") & ~F.col("href").rlike("^(#|mailto:|javascript:|$)") & (low.endswith(".pdf") | low.contains("/press/") | low.contains("press.php") | video))
    day = F.coalesce(F.to_date(F.try_to_timestamp("day", F.lit("M/d/yyyy"))), F.to_date(F.try_to_timestamp("year", F.lit("yyyy"))))
    title = F.when(video & ~F.upper("label").startswith("VIDEO"), F.concat(F.lit("VIDEO: "), "label")).otherwise(F.col("label"))
    return kept.select("page_id", "pos", title.alias("title"), "href", day.alias("published"), F.when(video, "other").otherwise("press_release").alias("content_type"))


def social_posts(raw: DataFrame, since: str) -> DataFrame:
    """(account, uri, cid, text, created_at, reply_parent, embed) of posts in JSON, from ``since`` on. raw: account, post."""
    p = raw.select("account", F.from_json("post", POST).alias("p"))
    kind = F.col("p.embed.`$type`")
    embed = (
        F.when(F.col("p.embed").isNull(), None)
        .when(kind.contains("external"), F.concat(F.lit("link:"), F.coalesce("p.embed.external.uri", F.lit(""))))
        .when(kind.contains("record"), F.concat(F.lit("quote:"), F.coalesce("p.embed.record.uri", F.lit(""))))
        .when(kind.contains("images"), F.concat(F.lit("images:"), F.coalesce(F.size("p.embed.images"), F.lit(0)).cast("string")))
        .otherwise(F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown")))
    )
    at = F.try_to_timestamp(F.replace(F.col("p.record.createdAt"), F.lit("Z"), F.lit(""))).cast("timestamp_ntz")
    rows = p.select("account", "p.uri", "p.cid", F.coalesce("p.record.text", F.lit("")).alias("text"), at.alias("created_at"), F.col("p.record.reply.parent.uri").alias("reply_parent"), embed.alias("embed"))
    return rows.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))


def contacts(releases: DataFrame) -> DataFrame:
    """(member_id, release_id, name, title, email, phone) of the contacts that the last 500 characters of a text introduce; address
    and number are the first within 50 characters before and 200 after. releases: member_id, release_id, body_text."""
    footer = F.expr("right(body_text, 500)")
    r = releases.select("member_id", "release_id", footer.alias("footer"))
    parts = lambda p, g: F.regexp_extract_all("footer", F.lit(p), g)
    zipped = [F.arrays_zip(parts(p, 0).alias("whole"), parts(p, 1).alias("name"), parts(p, 2).alias("title")) for p in CONTACTS]
    r = r.select("member_id", "release_id", "footer", F.explode(F.concat(*zipped)).alias("x")).withColumn("at", F.expr("locate(x.whole, footer)"))
    start, end = F.greatest(F.col("at") - 50, F.lit(1)), F.col("at") + F.length("x.whole") + 200
    name = F.trim(F.col("x.name"))
    title = F.regexp_replace(F.trim(F.element_at(F.split("x.title", r"[(0-9]"), 1)), r"[,.\- ]+$", "")
    none = lambda c: F.nullif(c, F.lit(""))
    rows = r.select("member_id", "release_id", name.alias("name"), none(F.when(F.length(title) < 60, title)).alias("title"), F.substr("footer", start, end - start).alias("context"))
    rows = rows.where(~F.lower("name").isin(NO_NAMES) & (F.length("name") >= 4))
    return rows.select("member_id", "release_id", "name", "title", none(F.regexp_extract("context", EMAIL, 0)).alias("email"), none(F.regexp_extract("context", PHONE, 0)).alias("phone"))


def ranked_contacts(found: DataFrame, k: int = 5) -> DataFrame:
    """(member_id, rank, name, mentions, title, email, phone): each member's k most named contacts, with the fullest mention's data."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("title", "email", "phone")), F.lit(0))
    per = found.groupBy("member_id", "name").agg(F.count(F.lit(1)).alias("mentions"), F.max_by(F.struct("title", "email", "phone"), F.struct(filled, -F.col("release_id"))).alias("best"))
    rank = F.row_number().over(Window.partitionBy("member_id").orderBy(F.desc("mentions"), "name"))
    return per.withColumn("rank", rank).where(F.col("rank") <= k).select("member_id", "rank", "name", "mentions", "best.*")


def body_of(html: str | None) -> str:
    """The text of the first container of BODIES with more than SHORTEST_BODY characters, else of the paragraphs of that block of
    the page's main part whose paragraphs are longest, else ''."""
    page = Page(html)
    words = lambda node: " ".join(" ".join(x.split()) for x in node.texts())
    for above, mark in BODIES:
        first = page.first(f"{above} {mark}")
        if first and len(text := words(first)) > SHORTEST_BODY:
            return text
    root = next((n for part in ("main", "article", "body") if (n := page.first(part))), None)
    if root is None:
        return ""
    paragraphs = [(n, t) for n in page.select("p", root) if (t := words(n))]
    places = [n.place for n, _ in paragraphs]
    length = [0, *accumulate(len(t) + 1 for _, t in paragraphs)]  # up to each paragraph, line ends included
    best = (0, 0, 0)
    for block in [root, *page.select("div, section", root)]:
        if block.tag in ("div", "section"):
            i, j = bisect_right(places, block.place), bisect_right(places, block.last)
            best = max(best, (length[j] - length[i], -i, -j))
    text = "\n".join(t for _, t in paragraphs[-best[1] : -best[2]]) if best[0] else ""
    return text if len(text) > SHORTEST_BODY else ""


def _bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"page_id": b.page_id, "body": [body_of(h) for h in b.html]})


def page_bodies(pages: DataFrame) -> DataFrame:
    """(page_id, body) of each page. A null page has the body ''."""
    return small_batches(pages.select("page_id", "html"), ROWS).mapInPandas(_bodies, "page_id long, body string")


def with_reason(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Rows with the first reason that holds, or null."""
    return rows.withColumn("reason", F.coalesce(*[F.when(cond, name) for name, cond in reasons.items()]))


def write_quarantine(rows: DataFrame, path: str) -> None:
    """Writes what has a reason to ``path``/quarantine, in a folder a reason, and the rest to ``path``/kept."""
    rows.where("reason is not null").write.mode("overwrite").partitionBy("reason").parquet(f"{path}/quarantine")
    rows.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{path}/kept")


def write_report(rows: DataFrame, path: str) -> None:
    """Writes a report as JSON lines; nested columns stay nested."""
    rows.write.mode("overwrite").json(path)
