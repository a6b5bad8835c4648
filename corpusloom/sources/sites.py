"""What a site's pages, sitemaps and content APIs tell: platform, pagination, listings, records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

# Patterns of dates, of titles that are no press releases, and of phrases on listings.
MONTH_DATE = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+[0-9]{1,2},?\s+[0-9]{4}"
LISTING_PHRASES = ["press release", "news release", "statement", "newsroom"]
ODD_TITLES = [r"\bnewsletter\b", r"\bweek in review\b", r"\bweekly (update|roundup|recap)\b", r"\bpodcast\b", r"^\s*episode [0-9]+", r"\bin the news\b"]

#: A sitemap's index is followed this deep.
SITEMAP_DEPTH = 3


def n_matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), 0))


def email_platform(html: Column) -> Column:
    """The vendor of a page's newsletter: govdelivery, mailchimp, constant_contact, custom_form or unknown."""
    form = html.rlike(r"""(?i)type=["']email["']""") & html.rlike("(?i)subscribe|sign.?up|newsletter")
    return (
        F.when(html.rlike("(?i)govdelivery\\.com/accounts/[A-Za-z0-9_]"), "govdelivery")
        .when(html.rlike("(?i)(list-manage|mailchimp)\\.com"), "mailchimp")
        .when(html.rlike("(?i)constantcontact\\.com"), "constant_contact")
        .when(form, "custom_form")
        .otherwise("unknown")
    )


def email_account(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, "(?i)govdelivery\\.com/accounts/([A-Za-z0-9_]+)", 1), F.lit(""))


def site_family(html: Column) -> Column:
    """The system a page was made with: wordpress, drupal, coldfusion, fireside, js-spa (an empty body) or unknown."""
    head = F.lower(F.substring(html, 1, 5000))
    body = C.html_to_text(F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1))
    maker = F.lower(F.regexp_extract(html, r'(?i)<meta[^>]*name="generator"[^>]*content="([^"]*)"', 1))
    return (
        F.when(head.contains("wp-content") | head.contains("wp-json") | maker.contains("wordpress"), "wordpress")
        .when(head.contains("drupal") | html.rlike(r"""class=["'][^"']*(drupal|views-row)"""), "drupal")
        .when(head.contains("index.cfm") | head.contains("coldfusion"), "coldfusion")
        .when(head.contains("fireside21") | head.contains("sos_widget"), "fireside")
        .when(head.rlike(r"""id=["'](app|root|__next)["']""") & (F.length(body) < 200), "js-spa")
        .otherwise("unknown")
    )


def pagination(html: Column) -> Column:
    """struct(total, unit): "Page 1 of N", "of N results", the highest /page/N or the highest offset=N of a link; else nulls."""
    text = C.html_to_text(html)
    top = lambda p: F.array_max(F.transform(F.regexp_extract_all(html, F.lit(p), 1), lambda x: x.cast("long")))
    one = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("long")
    steps = [
        (one(r"[Pp]age\s+[0-9]+\s+of\s+([0-9]{1,18})"), "pages"),
        (one(r"of\s+([0-9]{1,18})\s+(?:results?|entries|items|records)"), "items"),
        (top(r'href="[^"]*/page/([0-9]{1,18})'), "pages"),
        (top(r'href="[^"]*offset=([0-9]{1,18})'), "offset"),
    ]
    none = F.struct(F.lit(None).cast("long").alias("total"), F.lit(None).cast("string").alias("unit"))
    return reduce(lambda rest, s: F.when(s[0].isNotNull(), F.struct(s[0].alias("total"), F.lit(s[1]).alias("unit"))).otherwise(rest), reversed(steps), none)


def is_press_listing(html: Column) -> Column:
    """A page that names press releases or shows three dates."""
    text = C.html_to_text(html)
    named = reduce(lambda a, b: a | b, [F.lower(text).contains(p) for p in LISTING_PHRASES])
    return named | (n_matches(text, MONTH_DATE) >= 3)


def is_list_like(html: Column) -> Column:
    """Three articles, twenty linked items or five linked headings."""
    headings = n_matches(html, r"(?is)<h[23][^>]*>\s*<a[\s>]")
    return (n_matches(html, r"(?i)<article[\s>]") >= 3) | (n_matches(html, r"(?is)<li[^>]*>\s*<a[\s>]") >= 20) | (headings >= 5)


def site_confidence(item: Column, title: Column, date: Column, link: Column, paged: Column, n_dates: Column) -> Column:
    """0.3 for a listing found, more for each selector that was, for known pagination and for five dates; at most 1."""
    add = lambda cond, weight: F.when(cond, weight).otherwise(0.0)
    total = F.lit(0.3) + add(item, 0.25) + add(title, 0.15) + add(date, 0.1) + add(link, 0.1) + add(paged, 0.1) + add(n_dates >= 5, 0.05)
    return F.round(F.least(F.lit(1.0), total), 2)


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "mid").otherwise("low")


def page_signals(pages: DataFrame) -> DataFrame:
    """One row a page: family, email platform, whether it is a listing or list-like, pagination, confidence and its band."""
    html = F.col("html")
    rows = pages.select(
        "page_id",
        site_family(html).alias("family"),
        email_platform(html).alias("platform"),
        is_press_listing(html).alias("press_listing"),
        is_list_like(html).alias("list_like"),
        pagination(html).alias("p"),
        html.rlike("(?i)<(li|article)[\\s>]").alias("item"),
        html.rlike("(?i)<h[1-4][\\s>]").alias("title"),
        html.rlike("(?i)<time[\\s>]").alias("date"),
        html.rlike('(?i)<a [^>]*href="').alias("link"),
        n_matches(html, MONTH_DATE).alias("n_dates"),
    )
    score = site_confidence(F.col("item"), F.col("title"), F.col("date"), F.col("link"), F.col("p.unit").isNotNull(), F.col("n_dates"))
    return rows.select("page_id", "family", "platform", "press_listing", "list_like", F.col("p.total").alias("total"), F.col("p.unit").alias("unit"), score.alias("confidence")).withColumn("band", confidence_band(F.col("confidence")))


def titles_homogeneous(titles: DataFrame) -> DataFrame:
    """(feed_id, homogeneous): no title of the feed looks like a newsletter, review or podcast, and they average 15 characters."""
    odd = reduce(lambda a, b: a | b, [F.lower("title").rlike(p) for p in ODD_TITLES])
    return titles.groupBy("feed_id").agg((~F.coalesce(F.bool_or(odd), F.lit(False)) & (F.coalesce(F.avg(F.length("title")), F.lit(0.0)) >= 15)).alias("homogeneous"))


# What makes a feed fit for daily use.
MIN_ITEMS, MIN_DATED, MAX_STALE_DAYS, MIN_LINKS_OK, FULL_BODY = 10, 0.9, 90, 2, 200


def best_feeds(items: DataFrame, as_of: str) -> DataFrame:
    """(member_id, feed_id, n_items, dated_share, span_days, stale_days, mean_body, full_bodies, eligible, reasons): each member's best feed (most items,
    then the longest span, then the smallest id), and why it isn't fit for daily use, if it isn't. Bodies, titles and links are judged
    by a feed's first three items.

    items: member_id, feed_id, pos (from 0), title, published_at, body, link_status. A null status was not checked; null titles and bodies are
    empty. All measures come from one aggregation, and the best feed from another over one row for each feed."""
    at, first = F.col("published_at"), F.col("pos") < 3
    title = F.when(first, F.coalesce("title", F.lit("")))
    odd = F.bool_or(first & F.lower(F.coalesce("title", F.lit(""))).rlike("|".join(ODD_TITLES)))
    per = items.groupBy("member_id", "feed_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        (F.count(at) / F.count(F.lit(1))).alias("dated_share"),
        F.datediff(F.max(at), F.min(at)).alias("span_days"),
        F.datediff(F.lit(as_of).cast("date"), F.max(at)).alias("stale_days"),
        F.floor(F.avg(F.when(first, F.length(C.html_to_text(F.coalesce("body", F.lit(""))))))).alias("mean_body"),
        odd.alias("odd_title"),
        F.avg(F.length(title)).alias("title_length"),
        F.count(F.when(first, F.col("link_status"))).alias("checked"),
        F.count_if(first & (F.col("link_status") == 200)).alias("links_ok"),
    )
    row = F.struct(*[c for c in per.columns if c != "member_id"])
    best = per.groupBy("member_id").agg(F.max_by(row, F.struct("n_items", F.coalesce("span_days", F.lit(0)), -F.col("feed_id"))).alias("x")).select("member_id", "x.*")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("n_items") < MIN_ITEMS, "few items"),
            F.when(F.col("dated_share") < MIN_DATED, "undated items"),
            F.when(F.col("stale_days").isNull(), "no dates").when(F.col("stale_days") > MAX_STALE_DAYS, "stale"),
            F.when(F.col("odd_title"), "other titles").when(F.col("title_length") < 15, "short titles"),
            F.when(F.col("checked") == 0, "no links checked").when(F.col("links_ok") < MIN_LINKS_OK, "dead links"),
        )
    )
    return best.select("member_id", "feed_id", "n_items", "dated_share", "span_days", "stale_days", "mean_body", (F.col("mean_body") >= FULL_BODY).alias("full_bodies"), (F.size(reasons) == 0).alias("eligible"), reasons.alias("reasons"))


def sitemap_urls(maps: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(root, url, lastmod) of the addresses that sitemaps list; an index (``<sitemapindex``) stands for its children (the first
    ``most`` of them, if given; a crawler is polite with 30), as far as they end in .xml and are among ``maps``, to SITEMAP_DEPTH.

    maps: map_url, xml. roots: map_url. Each level is one join by address, so the number of sitemaps is not bounded.
    """
    texts = maps.select("map_url", "xml", F.col("xml").contains("<sitemapindex").alias("is_index"))
    level, found = roots.select(F.col("map_url").alias("root"), "map_url"), None
    for depth in range(SITEMAP_DEPTH + 1):
        at = level.join(texts, "map_url")
        block = r"(?s)<url>(.*?)</url>"
        urls = at.where(~F.col("is_index")).select("root", F.explode(F.regexp_extract_all("xml", F.lit(block), 1)).alias("b"))
        urls = urls.select("root", F.trim(F.regexp_extract("b", r"<loc>([^<]+)</loc>", 1)).alias("url"), F.nullif(F.regexp_extract("b", r"<lastmod>([^<]+)</lastmod>", 1), F.lit("")).alias("lastmod")).where("url <> ''")
        found = urls if found is None else found.unionByName(urls)
        if depth < SITEMAP_DEPTH:
            children = F.regexp_extract_all("xml", F.lit(r"<loc>([^<]+)</loc>"), 1)
            children = F.slice(children, 1, most) if most is not None else children
            level = at.where("is_index").select("root", F.explode(children).alias("map_url")).where(F.col("map_url").endswith(".xml"))
    return found


RECORD = "array<struct<link:string,date:string,date_gmt:string,title:struct<rendered:string>,content:struct<rendered:string>>>"


def cms_records(bodies: DataFrame, since: str) -> DataFrame:
    """(body_id, url, published_at, title, body_text) of the records in JSON responses, whatever stands before the first [ and
    after the last ]. Records need a link, a date from ``since`` on and a title of five characters. bodies: body_id, body."""
    records = F.from_json(F.regexp_extract("body", r"(?s)(\[.*\])", 1), RECORD)
    r = bodies.select("body_id", F.explode(records).alias("r"))
    at = F.try_to_timestamp(F.replace(F.coalesce(F.nullif("r.date_gmt", F.lit("")), "r.date"), F.lit("Z"), F.lit("")))
    rows = r.select("body_id", C.normalize_url(F.col("r.link")).alias("url"), at.cast("timestamp_ntz").alias("published_at"), C.html_to_text(F.col("r.title.rendered")).alias("title"), C.html_to_text(F.col("r.content.rendered")).alias("body_text"))
    return rows.where((F.col("url") != "") & (F.col("published_at") >= F.lit(since).cast("timestamp_ntz")) & (F.length("title") >= 5))
