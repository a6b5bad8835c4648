"""Audits of sites and sources, and the cleaning of texts taken from documents laid out for print."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import sites
from ..sources.tables import WINDOW_START, Tables, ts
from .lookups import untapped_sections
from .stats import active, n, visible

# What navigation labels say of a stream of documents, in order of precedence; pages that are no documents; hosts.
STREAMS = [
    ("op_ed", r"\bop[- ]?eds?\b|\beditorials?\b"),
    ("blog", r"\bblogs?\b|\bdiary\b|\bdiaries\b|\bweekly[- ]?(column|update|report)s?\b"),
    ("commentary", r"\bcommentary\b|\bcolumns?\b|\bperspectives?\b"),
    ("floor_statement", r"\bfloor[- ]?(statements?|speeches|speech|remarks?)\b"),
    ("speech", r"^\s*speeches?\s*$|^\s*remarks?\s*$|\bpublic[- ]?speeches?\b"),
    ("letter", r"^\s*letters?\s*$|\boversight[- ]?letters?\b|\bpublic[- ]?letters?\b"),
    ("newsletter", r"\bnewsletters?\b|\be[- ]?newsletters?\b"),
    ("video", r"^\s*videos?\s*$"),
    ("podcast", r"\bpodcasts?\b"),
]
LISTING_LEAF = r"/(press-releases|news-releases|newsroom|news)/?$"
NAVIGATION = r"/(about|contact|services|issues)/?([?].*)?$"
SOCIAL = ["facebook.com", "twitter.com", "bsky.app"]
# What a label or an address says of coverage by others.
EXCLUDE = [
    r"\bin[- ]?the[- ]?(?:news|media)\b",
    r"\bnews[- ]?clips?\b",
    r"\bnews[- ]?clippings?\b",
    r"\bmedia[- ]?(?:coverage|mentions|hits|clips?)\b",
    r"\bpress[- ]?(?:coverage|clips?|mentions)\b",
    r"\bICYMI\b",
    r"\bfeatured[- ]?in\b",
    r"\bnews[- ]?coverage\b",
]
# Forms for opinions.
OPINION_FORM = [r"\bshare[- ]?your[- ]?opinion\b", r"\bcontact[- ]?(?:my[- ]?)?office\b", r"/contact/|/share-your-opinion"]
# Labels that name a part of a site, as a whole.
STRUCTURAL_JUNK = [
    "home", "contact", "about", "biography", "biograf", "services?", "help", "issues?", "legislation",
    "committee(?:s)?", "constituent[- ]?services?", "serving[- ]?you", "visiting[- ]?washington",
    "schedule[- ]?(?:a[- ]?)?meeting", "request", "tour", "flag", "internship", "jobs?", "employment",
    "privacy", "accessibility", "rss", "subscribe", "sign[- ]?up", "search", "menu", "skip[- ]?to",
    "academy[- ]?nominations?", "grants?", "veterans?", "casework", "photos?", "gallery",
]
# Pieces of a section's path for which it is left out.
SKIP_SECTIONS = [
    "/in-the-news", "/in_the_news",
    "/videos", "/video",
    "/photos", "/photo",
    "/clips", "/clip",
    "/audio",
    "/multimedia", "/photo-galleries", "-photo-galleries",
    "/news-coverage",
    "/success-stories", "-success-stories",
    "/toolkit",
    "/events", "/event", "/upcoming-events",
    "/about", "/biography", "/bio",
    "/contact",
    "/services", "/help", "/casework", "/get-help",
    "/issues",
    "/legislation",
    "/committee", "/committees",
    "/constituent", "/student", "/students", "/delawareans",
    "/internship", "/jobs", "/employment",
    "/visiting", "/visit", "/tours", "/flag",
    "/newsletter-signup", "/sign-up", "/signup", "/join-newsletter",
    "/privacy", "/accessibility", "/terms",
    "/connect", "/serving-you",
    "/wp-content", "/wp-admin", "/wp-includes", "/wp-json",
    "/feed", "/rss",
    "/category/", "/tag/", "/author/",
    "/page/",
    "/search",
    "/download/",
    "/coronavirus/",
    "/priorities",
    "/spending-requests",
    "/grants",
    "/es/", "/es-mx/",
    "/ultimas-noticias", "/comunicados", "/comunicados-de-prensa",
    "/jet-popup", "/popup",
    "/meet-", "/working-for-",
    "/2021/", "/2022/", "/2023/", "/2024/",
]
# Fixed value: an archive of a year or month.
YEAR_ARCHIVE = r"^/(19|20)[0-9]{2}(/[0-9]{1,2})?/*$"
#: A path is skipped if this is found in it, in lower case.
SKIPPED = "|".join([*SKIP_SECTIONS, YEAR_ARCHIVE])

#: A line of at most this many words and characters is a fragment; this many of them in a run are joined.
FRAGMENT_WORDS, FRAGMENT_CHARS, FRAGMENT_RUN = 3, 24, 3


def cleaned(text: str | None) -> str:
    """A text with blanks collapsed, runs of fragments joined, and marks of its end dropped, in one pass over its lines."""
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", text or ""))
    done: list[str] = []
    bits: list[str] = []

    def flush() -> None:
        done.extend([" ".join(bits)] if len(bits) >= FRAGMENT_RUN else bits)
        bits.clear()

    for raw in text.split("\n"):
        line = raw.replace("\t", " ").replace("\r", " ").strip(" ")
        if line and len(line) <= FRAGMENT_CHARS and len(line.split()) <= FRAGMENT_WORDS:
            bits.append(line)
        elif line:
            flush()
            done.append(line)
        elif not bits:
            done.append("")
    flush()
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(done))
    return re.sub(r"(?m)\n+#{2,}[ \t]*$|\n+-[ \t]*30[ \t]*-[ \t]*$", "", text).strip(" \t\n\x0b\f\r")


def clean_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with blanks collapsed, runs of one-word lines joined, and marks of a document's end dropped.

    docs: doc_id, text. A line of few words is a fragment; blank lines after the first fragment of a run are no lines. Each text is
    cleaned in its row: nothing is shuffled. Null texts become ''; repeated rows and null ids are cleaned one by one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([cleaned(t) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string")


def recon_summary(pages: DataFrame) -> DataFrame:
    """(signal, value, n): how many pages have each family, band of confidence, email platform and kind of pagination."""
    s = sites.page_signals(pages)
    pair = lambda name, value: F.struct(F.lit(name).alias("signal"), value.alias("value"))
    pairs = F.array(pair("family", F.col("family")), pair("band", F.col("band")), pair("platform", F.col("platform")), pair("pagination", F.coalesce("unit", F.lit("unknown"))))
    return s.select(F.explode(pairs).alias("x")).groupBy("x.signal", "x.value").agg(n().alias("n"))


def stream_of_label(label: Column, href: Column | None = None) -> Column:
    """The stream that a navigation label or the path of its address names, by the first pattern that either matches, else null. Links to
    coverage by others, to forms for opinions and to a site's parts name none."""
    text = F.lower(label)
    path = F.lower(F.regexp_extract(F.coalesce(href, F.lit("")), r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)) if href is not None else None
    said = lambda pattern: text.rlike(pattern) if path is None else text.rlike(pattern) | path.rlike(pattern)
    none = said("(?i)" + "|".join(EXCLUDE)) | said("(?i)" + "|".join(OPINION_FORM)) | text.rlike(r"^(?:" + "|".join(STRUCTURAL_JUNK) + r")\s*$")
    return F.coalesce(*[F.when(~none & said(p), name) for name, p in STREAMS])


def stream_findings(links: DataFrame, earlier: DataFrame) -> DataFrame:
    """(category, n, n_pages, n_new): labelled links by stream, pages with any, pages that an earlier pass had not found.

    links: page_id, label, and if they have it href, whose path is looked at as well. earlier: page_id.
    """
    found = links.select("page_id", stream_of_label(F.col("label"), F.col("href") if "href" in links.columns else None).alias("category")).where("category is not null")
    found = found.join(earlier.select("page_id", F.lit(True).alias("known")).distinct(), "page_id", "left")
    return found.groupBy("category").agg(n().alias("n"), F.countDistinct("page_id").alias("n_pages"), F.countDistinct(F.when(F.col("known").isNull(), F.col("page_id"))).alias("n_new"))


def url_checks_report(pages: DataFrame, suffixes: list[str]) -> DataFrame:
    """(check_id, observed, passed) of the checks on addresses: given hosts only, no listings, no navigation or social pages."""
    host = F.lower(F.regexp_extract("url", r"^[^:/]+://([^/?#]*)", 1))
    inside = reduce(lambda a, b: a | b, [host.endswith(s) for s in suffixes])
    social = reduce(lambda a, b: a | b, [F.col("url").contains(s) for s in SOCIAL])
    checks = {"q10_foreign_host": ~inside, "q11_listing": F.col("url").rlike(LISTING_LEAF), "q12_navigation": F.col("url").rlike(NAVIGATION) | social}
    one = pages.agg(*[F.count_if(c).alias(name) for name, c in checks.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("check_id"), F.col(name).alias("observed")) for name in checks])
    return one.select(F.explode(rows).alias("x")).select("x.check_id", "x.observed", (F.col("x.observed") == 0).alias("passed"))


def roster_checks(t: Tables, least: int = 100, publishing: int = 95) -> DataFrame:
    """(check_id, observed, passed): members, members without a collection method, members that publish."""
    per = visible(t.releases).groupBy("member_id").agg(n().alias("n"))
    one = t.members.join(per, "member_id", "left").agg(n().alias("q01_members"), F.count_if(F.col("collection_method").isNull()).alias("q02_no_method"), F.count("n").alias("q03_publishing"))
    ok = {"q01_members": F.col("q01_members") >= least, "q02_no_method": F.col("q02_no_method") == 0, "q03_publishing": F.col("q03_publishing") >= publishing}
    rows = F.array(*[F.struct(F.lit(k).alias("check_id"), F.col(k).alias("observed"), v.alias("passed")) for k, v in ok.items()])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def live_vs_corpus(t: Tables, observed: DataFrame, start: str = WINDOW_START) -> DataFrame:
    """(member_id, stored, live, delta, verdict, flags) of the active members: what their sites show against what is stored.

    observed: member_id, published_at of what was seen live. OK within one; LOW if the corpus lacks some, HIGH if it has more.
    """
    count = lambda rows, name: rows.where(F.col("published_at") >= ts(start)).groupBy("member_id").agg(n().alias(name), F.max("published_at").alias(f"{name}_last"))
    m = active(t.members).select("member_id").join(count(visible(t.releases), "stored"), "member_id", "left").join(count(observed, "live"), "member_id", "left")
    m = m.withColumns({"stored": F.coalesce("stored", F.lit(0)), "live": F.coalesce("live", F.lit(0))})
    delta, lag = F.col("live") - F.col("stored"), F.datediff("live_last", "stored_last")
    flags = F.array(
        F.when(F.col("live") == 0, "0-items"),
        F.when(lag > 14, F.concat(F.lit("lag>"), lag.cast("string"), F.lit("d"))),
        F.when(F.col("stored") == 0, "db=0"),
        F.when((F.col("live") > 0) & (F.col("stored") > 0) & (F.col("stored") < 0.5 * F.col("live")), "undercollect"),
    )
    verdict = F.when(F.abs(delta) <= 1, "OK").when(delta > 1, "LOW").otherwise("HIGH")
    return m.select("member_id", "stored", "live", delta.alias("delta"), verdict.alias("verdict"), F.array_join(F.array_compact(flags), ",").alias("flags"))


#: Child pages that are read where a section's own page has no date in the window.
CHILDREN = 5


def shown_dates(html: Column) -> Column:
    """struct(method, days) of the first method with a date: ``time`` elements (attribute or text), elements with ``date`` in their class, dates
    with a month's name anywhere. Each day once."""
    text = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+[0-9]{1,2},?\s+[0-9]{4}"
    days_of = lambda found: F.array_distinct(F.filter(F.transform(found, lambda x: C.parse_date_text(x)["value"]), lambda d: d.isNotNull()))
    stamps = F.regexp_extract_all(html, F.lit(r"""(?is)<time\b[^>]*?datetime\s*=\s*["']?([^"'\s>]+)"""), 1)
    times = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<time\b[^>]*>(.*?)</time>"), 1), lambda x: C.html_to_text(x))
    classed = F.transform(F.regexp_extract_all(html, F.lit(r"""(?is)<[a-z0-9]+\b[^>]*?class\s*=\s*(?:"[^"]*date[^"]*"|'[^']*date[^']*'|[^\s"'>]*date[^\s"'>]*)[^>]*>(.*?)</"""), 1), lambda x: C.html_to_text(x))
    steps = [("time", days_of(F.concat(stamps, times))), ("class", days_of(classed)), ("text", days_of(F.regexp_extract_all(html, F.lit(text), 0)))]
    return F.coalesce(*[F.when(F.size(d) > 0, F.struct(F.lit(m).alias("method"), d.alias("days"))) for m, d in steps])


def section_dates(sections: DataFrame, children: DataFrame, start: str = WINDOW_START) -> DataFrame:
    """(section, method, n_dates, in_window, latest) of each section's page; where it has no date from ``start`` on, of its first CHILDREN
    child pages together, if these have one (method ``child:`` and theirs). Nulls and zeros where no page has a date.

    sections: section, html, one row each. children: section, pos, html. Child pages are read of the sections that need them only."""
    since = F.lit(start).cast("date")
    own = sections.select("section", shown_dates(F.col("html")).alias("d")).withColumn("fits", F.coalesce(F.exists("d.days", lambda x: x >= since), F.lit(False)))
    first = F.row_number().over(Window.partitionBy("section").orderBy("pos"))
    read = children.join(own.where("NOT fits").select("section"), "section", "left_semi").withColumn("n", first).where(F.col("n") <= CHILDREN)
    found = read.select("section", "pos", shown_dates(F.col("html")).alias("d")).where("d is not null")
    below = found.groupBy("section").agg(F.min_by("d.method", "pos").alias("child_method"), F.array_distinct(F.flatten(F.collect_list("d.days"))).alias("child_days"))
    both = own.join(below, "section", "left")
    turned = ~F.col("fits") & F.coalesce(F.exists("child_days", lambda x: x >= since), F.lit(False))
    method = F.when(turned, F.concat(F.lit("child:"), F.col("child_method"))).otherwise(F.col("d.method"))
    chosen = F.when(turned, F.col("child_days")).otherwise(F.coalesce("d.days", F.array().cast("array<date>")))
    return both.select("section", method.alias("method"), chosen.alias("days")).select("section", "method", F.size("days").alias("n_dates"), F.size(F.filter("days", lambda x: x >= since)).alias("in_window"), F.array_max("days").alias("latest"))


def section_recency(rows: DataFrame, start: str = WINDOW_START) -> DataFrame:
    """(section, n_dates, in_window, latest) of the numbered dates (M/D/YYYY or ISO) in the texts of each section of a site.

    rows: section, text. Dates that the calendar lacks are left out; a date counts once a row.
    """
    us = F.transform(F.regexp_extract_all("text", F.lit(r"\b([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})\b"), 1), lambda d: F.to_date(F.try_to_timestamp(d, F.lit("M/d/yyyy"))))
    iso = F.transform(F.regexp_extract_all("text", F.lit(r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b"), 1), lambda d: F.to_date(F.try_to_timestamp(d, F.lit("yyyy-MM-dd"))))
    dates = rows.select("section", F.explode(F.array_distinct(F.array_compact(F.concat(us, iso)))).alias("day"))
    return dates.groupBy("section").agg(n().alias("n_dates"), F.count_if(F.col("day") >= F.lit(start).cast("date")).alias("in_window"), F.max("day").alias("latest"))


def probe_phases(t: Tables) -> DataFrame:
    """(phase, option, n_new, reached): members by the first way to collect them that works, and members reached so far.

    Ways in order: a feed, a page that answers with items, a page that answers, none. The running count is over a row a phase.
    """
    last = F.max_by(F.struct("url_status", "items_found"), F.struct("checked_at", "probe_id")).alias("p")
    m = active(t.members).select("member_id", "collection_method").join(t.probes.groupBy("member_id").agg(last), "member_id", "left")
    live = F.col("p.url_status") == 200
    phase = F.when(F.col("collection_method") == "rss", 1).when(live & (F.col("p.items_found") > 0), 2).when(live, 3).otherwise(4)
    option = F.element_at(F.array(F.lit("feed"), F.lit("items"), F.lit("page"), F.lit("none")), F.col("phase"))
    per = m.groupBy(phase.alias("phase")).agg(n().alias("n_new"))
    return per.select("phase", option.alias("option"), "n_new", F.sum("n_new").over(Window.orderBy("phase")).alias("reached"))


def source_health(results: DataFrame) -> DataFrame:
    """(member_id, url_status, items_found, selector_ok, errors) over the sources of a member: worst status, all items, whether every
    selector held, the first message. results: member_id, ord, url_status, items_found, error (null if none)."""
    return results.groupBy("member_id").agg(
        F.max("url_status").alias("url_status"), F.sum("items_found").alias("items_found"), F.bool_and(F.col("items_found") > 0).alias("selector_ok"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("ord"))).alias("error")
    )


def silo_classes(silos: DataFrame, post_types: DataFrame, collected: DataFrame, least: int = 20, least_in_window: int = 5) -> DataFrame:
    """(site, section, slug, class) of the sections of sites by whether a post type of the site's API serves them.

    silos: site, section, n, in_window (null: no sitemap told), slugs (candidates in order). post_types: site, slug, wp_total,
    wp_in_window. collected: site, slug. The first candidate with ``least`` records or more is taken, through one join.
    """
    tried = silos.select("site", "section", F.posexplode("slugs").alias("ord", "slug")).join(post_types.where(F.col("wp_total") >= least), ["site", "slug"])
    best = tried.groupBy("site", "section").agg(F.min_by(F.struct("slug", "wp_in_window"), "ord").alias("best")).select("site", "section", "best.*")
    known = collected.select("site", "slug", F.lit(True).alias("known")).distinct()
    s = silos.join(best, ["site", "section"], "left").join(known, ["site", "slug"], "left")
    label = (
        F.when(F.col("n") < least, "low_value")
        .when(F.col("slug").isNotNull() & F.col("known"), "wp_already_collected")
        .when(F.col("slug").isNotNull() & (F.col("wp_in_window") < least_in_window), "wp_pre_window_only")
        .when(F.col("slug").isNotNull(), "wp_extras_ready")
        .when(F.col("in_window").isNull(), "needs_custom_scraper_unverified")
        .when(F.col("in_window") == 0, "section_dormant")
        .otherwise("needs_custom_scraper")
    )
    return s.select("site", "section", "slug", label.alias("class"))


def source_audit(urls: DataFrame, collected: DataFrame, statuses: DataFrame, least: int = 10, start: str = WINDOW_START, skip: str = SKIPPED) -> DataFrame:
    """(section, n, in_window, class) of the sections that a site lists and nobody collects: archival (dated, none in the window),
    dead (404 or 410), unknown (refused, failing, or never asked), else untapped.

    urls: section, lastmod, url. collected: section. statuses: section, status. Sections with fewer addresses, and those that
    ``skip`` matches (in lower case), are left out.
    """
    dated = F.col("lastmod").isNotNull()
    recent = F.when(dated, F.col("lastmod") >= start[:10]).otherwise(F.col("url").rlike("/202[56]"))
    per = urls.groupBy("section").agg(n().alias("n"), F.bool_or(dated).alias("dated"), F.count_if(recent).alias("in_window"))
    gaps = untapped_sections(per.where((F.col("n") >= least) & ~F.lower("section").rlike(skip)), collected)
    s = gaps.join(statuses.groupBy("section").agg(F.min("status").alias("status")), "section", "left")
    label = F.when(F.col("dated") & (F.col("in_window") == 0), "archival").when(F.col("status").isin(404, 410), "dead").when(F.coalesce("status", F.lit(0)).isin(0, 403, 503), "unknown").otherwise("untapped")
    return s.select("section", "n", "in_window", label.alias("class"))


def listing_dates(rows: DataFrame) -> DataFrame:
    """(url, day): the first date that listings give an address: M/D/YY(YY), else "Apr 16" with the year in the address's path.

    rows: url, pos, text. Addresses are compared without fragment and last slash; days that the calendar lacks are no dates.
    """
    part = lambda i: F.regexp_extract("text", r"([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4}|[0-9]{2})", i)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    mdy = F.to_date(F.try_to_timestamp(F.concat_ws("/", part(1), part(2), year), F.lit("M/d/yyyy")))
    short = lambda i: F.regexp_extract("text", r"(?i)(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+([0-9]{1,2})", i)
    named = F.to_date(F.try_to_timestamp(F.concat_ws(" ", F.initcap(short(1)), short(2), F.regexp_extract("url", "/([0-9]{4})/", 1)), F.lit("MMM d yyyy")))
    found = rows.select(C.normalize_url_light(F.col("url")).alias("url"), "pos", F.coalesce(mdy, named).alias("day")).where("day is not null")
    return found.groupBy("url").agg(F.min_by("day", "pos").alias("day"))
