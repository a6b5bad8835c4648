"""What pages and feeds hold, as column expressions: links, titles, dates, feed items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

# Names of metadata that hold a publication date.
DATE_META = ["article:published_time", "datePublished", "date", "DC.date.issued", "publish_date", "pubdate"]


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, label) of each plain link, in document order."""
    pattern = r'<a href="([^"]*)"[^>]*>([^<]*)</a>'
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), 1).alias("href"), F.regexp_extract_all("html", F.lit(pattern), 2).alias("label"))
    return pages.select("page_id", F.posexplode(both).alias("pos", "x")).select("page_id", "pos", "x.href", "x.label")


def paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, pos, text) of each closed paragraph, in document order, without its tags."""
    texts = F.regexp_extract_all("html", F.lit(r"(?s)<p>((?:(?!<p>).)*?)</p>"), 1)
    return pages.select("page_id", F.posexplode(texts).alias("pos", "inner")).select("page_id", "pos", C.html_to_text(F.col("inner")).alias("text"))


def section_links(pages: DataFrame, longest: int = 40) -> DataFrame:
    """(page_id, href, label) of the links in a page's navigation: short labels, each address once."""
    nav = F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1)
    found = links(pages.select("page_id", nav.alias("html"))).where((F.col("label") != "") & (F.length("label") <= longest))
    return found.groupBy("page_id", "href").agg(F.min_by("label", "pos").alias("label"))


def canonical_title(html: Column, listed: Column) -> Column:
    """The page's own title (og:title, else h1) if it is 6 to 399 characters long and the listed one is over 250 or 1.5 times longer."""
    og = F.regexp_extract(html, r'(?i)<meta[^>]*property="og:title"[^>]*content="([^"]*)"', 1)
    h1 = C.html_to_text(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    own = F.when(F.trim(og) != "", F.trim(og)).otherwise(h1)
    size = F.length(own)
    return F.when((size > 5) & (size < 400) & ((F.length(listed) > 250) | (F.length(listed) > 1.5 * size)), own).otherwise(listed)


def date_from_html(html: Column) -> Column:
    """struct(value, source, confidence) by metadata (.95), JSON-LD (.95), time elements (.90 by attribute, .85 by text), else nulls."""
    names = "|".join(n.replace(".", r"\.") for n in DATE_META)
    meta = F.regexp_extract(html, rf'(?i)<meta[^>]*(?:name|property)="(?:{names})"[^>]*content="([^"]*)"', 1)
    ld = F.regexp_extract(html, r'(?s)"datePublished"\s*:\s*"([^"]*)"', 1)
    stamp = F.regexp_extract(html, r'(?i)<time[^>]*datetime="([^"]*)"', 1)
    text = F.regexp_extract(html, r"(?is)<time[^>]*>(.*?)</time>", 1)
    steps = [(meta, "meta_tag", 0.95), (ld, "json_ld", 0.95), (stamp, "time_element", 0.9), (text, "time_text", 0.85)]
    found = [F.struct(C.parse_date_text(x)["value"].alias("value"), F.lit(s).alias("source"), F.lit(c).alias("confidence")) for x, s, c in steps]
    none = F.struct(F.lit(None).cast("date").alias("value"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("confidence"))
    return reduce(lambda rest, s: F.when(s["value"].isNotNull(), s).otherwise(rest), reversed(found), none)


def looks_like_feed(content_type: Column, body: Column) -> Column:
    head = F.lower(F.substring(body, 1, 500))
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return kind.rlike("rss|atom") | F.coalesce(head.contains("<rss") | head.contains("<feed"), F.lit(False))


def feed_items(feeds: DataFrame) -> DataFrame:
    """(feed_id, pos, title, link, published_at, summary) of RSS items, else Atom entries; items without title or link are left
    out. feeds: feed_id, xml."""
    rss, atom = F.regexp_extract_all("xml", F.lit(r"(?s)<item[ >](.*?)</item>"), 1), F.regexp_extract_all("xml", F.lit(r"(?s)<entry[ >](.*?)</entry>"), 1)
    items = feeds.select("feed_id", F.posexplode(F.when(F.size(rss) > 0, rss).otherwise(atom)).alias("pos", "item"))
    inner = lambda tag: F.regexp_extract("item", rf"(?s)<{tag}(?:\s[^>]*)?>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>", 1)
    href = F.regexp_extract("item", r'<link[^>]*href="([^"]*)"', 1)
    link = F.trim(F.when(inner("link") != "", inner("link")).otherwise(href))
    when = F.coalesce(*[C.parse_feed_date(inner(tag)) for tag in ("pubDate", "published", "updated")])
    summary = F.when(inner("description") != "", inner("description")).otherwise(inner("summary"))
    rows = items.select("feed_id", "pos", C.html_to_text(inner("title")).alias("title"), link.alias("link"), when.alias("published_at"), F.substring(C.html_to_text(summary), 1, 500).alias("summary"))
    return rows.where("title <> '' and link <> ''")


def feed_quality(items: DataFrame, as_of: str) -> DataFrame:
    """Per feed: items, share dated, first and last day, span and staleness in days."""
    at = F.col("published_at")
    return items.groupBy("feed_id").agg(F.count(F.lit(1)).alias("n_items"), (F.count(at) / F.count(F.lit(1))).alias("dated_share"), F.to_date(F.min(at)).alias("first_day"), F.to_date(F.max(at)).alias("last_day")).withColumns(
        {"span_days": F.datediff("last_day", "first_day"), "stale_days": F.datediff(F.lit(as_of).cast("date"), "last_day")}
    )
