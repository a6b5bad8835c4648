"""Row-level rules as column expressions: they run inside the JVM and fold into the scan they are applied to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track where a visitor came from.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "mc_cid", "mc_eid", "_ga", "_gl", "ref", "source", "et_blog"]

# The content types, and the markers that tell them, in order of precedence.
PRESS_MARKERS = ["/press-release", "/press_release", "/press-releases", "/newsroom/press", "/news/press"]
URL_TYPES = [
    ("/op-ed", "op_ed"),
    ("/op_ed", "op_ed"),
    ("/commentary", "op_ed"),
    ("/floor-statement", "floor_statement"),
    ("/floor-speech", "floor_statement"),
    ("/speeches", "floor_statement"),
    ("/letters/", "letter"),
    ("/letter-to-", "letter"),
    ("/photo-release", "photo_release"),
    ("/presidential-actions/", "presidential_action"),
    ("/briefings-statements/", "statement"),
    ("/newsletters/", "blog"),
    ("/newsletter/", "blog"),
    ("/weekly-column/", "blog"),
    ("/weekly-update/", "blog"),
    ("/diary/", "blog"),
    ("/blog/", "blog"),
]
TITLE_TYPES = [
    (r"^(?:PHOTO\s*(?:RELEASE)?)\s*:", "photo_release"),
    (r"^(?:OP[- ]?ED)\s*:", "op_ed"),
    (r"^(?:COMMENTARY)\s*:", "op_ed"),
    (r"^(?:LETTER)\s*:", "letter"),
    (r"^(?:FLOOR\s+STATEMENT)\s*:", "floor_statement"),
    (r"^(?:STATEMENT)\s*:", "statement"),
    (r"\b(?:pens?|authors?|wrote|writes)\s+op[- ]?ed\b", "op_ed"),
    (r"\bop[- ]?ed\s+by\s+(?:sen\.?|senator)\b", "op_ed"),
    (r"\b(?:delivers?|gives?|made)\s+(?:floor\s+)?(?:speech|statement|remarks)\b", "floor_statement"),
    (r"^floor (?:speech|statement|remarks)\b", "floor_statement"),
    (r"^letter\s+to\b", "letter"),
]
CATEGORY_TYPES = {
    "press releases": "press_release",
    "press release": "press_release",
    "statements": "statement",
    "statement": "statement",
    "op-eds": "op_ed",
    "op-ed": "op_ed",
    "commentary": "op_ed",
    "commentaries": "op_ed",
    "letters": "letter",
    "letter": "letter",
    "floor statements": "floor_statement",
    "floor statement": "floor_statement",
    "speeches": "floor_statement",
    "speech": "floor_statement",
    "photo releases": "photo_release",
    "photo release": "photo_release",
    "blog": "blog",
    "blogs": "blog",
    "blog post": "blog",
    "blog posts": "blog",
    "newsletter": "blog",
    "newsletters": "blog",
    "weekly column": "blog",
    "weekly columns": "blog",
    "weekly update": "blog",
    "weekly updates": "blog",
}


def effective_date(published: Column, scraped: Column) -> Column:
    """The earlier of the two, so that a mistyped future date doesn't sort first; nulls are ignored."""
    return F.least(published, scraped)


def normalize_url(url: Column, secure_suffixes: list[str] | None = None) -> Column:
    """The identity of an address: lower-case scheme and host, https for the given hosts, no tracking parameters, lower-case
    parameter names, no fragment, no trailing slash."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[^:/]+://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[^:/]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    secure = reduce(lambda a, b: a | b, [host.endswith(s) for s in secure_suffixes or [".gov"]])
    scheme = F.when((scheme == "http") & secure, "https").otherwise(scheme)
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    key = lambda p: F.lower(F.split(p, "=")[0])
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~key(p).isin(TRACKING))
    kept = F.transform(kept, lambda p: F.concat(key(p), F.substring(p, F.length(F.split(p, "=")[0]) + 1, F.length(p))))
    query = F.array_join(kept, "&")
    return F.when(url.isNull() | (url == ""), "").otherwise(F.concat(scheme, F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def normalize_url_light(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/index\\.php/", "/"), "/+$", "")


def content_hash(text: Column) -> Column:
    t = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), "^ | $", "")
    return F.when(text.isNull() | (t == ""), "").otherwise(F.sha2(t, 256))


def title_key(member: Column, title: Column) -> Column:
    plain = F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", "")
    return F.concat(member.cast("string"), F.lit(":"), F.trim(F.regexp_replace(plain, r"\s+", " ")))


def classify(title: Column, url: Column, categories: Column | None = None) -> Column:
    """The content type: section of the address, then title, then categories, else a press release."""
    u = F.lower(F.coalesce(url, F.lit("")))
    found = F.when(reduce(lambda a, b: a | b, [u.contains(m) for m in PRESS_MARKERS]), "press_release")
    for marker, kind in URL_TYPES:
        found = found.when(u.contains(marker), kind)
    for pattern, kind in TITLE_TYPES:
        found = found.when(F.trim(F.coalesce(title, F.lit(""))).rlike("(?i)" + pattern), kind)
    if categories is None:
        return found.otherwise("press_release")
    names = F.create_map(*[F.lit(x) for kv in CATEGORY_TYPES.items() for x in kv])
    kinds = F.filter(F.transform(categories, lambda c: names[F.lower(F.trim(c))]), lambda k: k.isNotNull())
    return found.otherwise(F.coalesce(F.get(kinds, F.lit(0)), F.lit("press_release")))


def is_listing_url(url: Column, leaves: list[str]) -> Column:
    leaf = F.regexp_extract(F.regexp_extract(url, r"^[^:/]+://[^/?#]*([^?#]*)", 1), r"([^/]*)/?$", 1)
    return F.lower(leaf).isin(leaves)


def date_from_url(url: Column) -> Column:
    """struct(value, confidence) from /Y/M/D/ (.9), /Y/M/ (.7), /M/D/Y/ (.8); null parts where there is none."""
    ymd = [F.regexp_extract(url, r"/(20[0-9]{2})/([0-9]{1,2})/([0-9]{1,2})(?:/|$)", i) for i in (1, 2, 3)]
    ym = [F.regexp_extract(url, r"/(20[0-9]{2})/([0-9]{1,2})/", i) for i in (1, 2)]
    mdy = [F.regexp_extract(url, r"/([0-9]{1,2})/([0-9]{1,2})/(20[0-9]{2})(?:/|$)", i) for i in (3, 1, 2)]
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    a, b, c = day(*ymd), day(*ym, F.lit("1")), day(*mdy)
    conf = F.when(a.isNotNull(), 0.9).when(b.isNotNull(), 0.7).when(c.isNotNull(), 0.8)
    return F.struct(F.coalesce(a, b, c).alias("value"), F.when(conf.isNotNull(), "url_path").alias("source"), conf.alias("confidence"))


# Month names by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def parse_date_text(text: Column) -> Column:
    """struct(value, source, confidence): month name D, YYYY (.85), then M/D/YY(YY) (.75), then ISO (.9); an impossible date
    falls through to the next form."""
    name = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\s+([0-9]{4})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(text, name, 1))).cast("string")
    slash = r"\b([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4}|[0-9]{2})\b"
    year = F.regexp_extract(text, slash, 3)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    iso = r"([0-9]{4})-([0-9]{2})-([0-9]{2})"
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    a = day(F.regexp_extract(text, name, 3), month, F.regexp_extract(text, name, 2))
    b = day(year, F.regexp_extract(text, slash, 1), F.regexp_extract(text, slash, 2))
    c = day(*[F.regexp_extract(text, iso, i) for i in (1, 2, 3)])
    conf = F.when(a.isNotNull(), 0.85).when(b.isNotNull(), 0.75).when(c.isNotNull(), 0.9)
    return F.struct(F.coalesce(a, b, c).alias("value"), F.when(conf.isNotNull(), "page_text").alias("source"), conf.alias("confidence"))


def best_date(*candidates: Column) -> Column:
    """Of (value, source, confidence) candidates the surest; the first of equals."""
    known = F.filter(F.array(*candidates), lambda c: c["value"].isNotNull())
    best = F.aggregate(known, F.get(known, F.lit(0)), lambda a, c: F.when(c["confidence"] > a["confidence"], c).otherwise(a))
    return best


def demote_future(value: Column, source: Column, confidence: Column, as_of: Column, tolerance_days: int = 1) -> tuple[Column, Column]:
    """(source, confidence) with dates beyond the tolerance marked as upstream typos."""
    late = value > as_of + F.make_dt_interval(days=F.lit(tolerance_days))
    marked = F.when(late & ~source.endswith("_future_typo"), F.concat(source, F.lit("_future_typo"))).otherwise(source)
    return marked, F.when(late, F.least(confidence, F.lit(0.2))).otherwise(confidence)


def parse_feed_date(text: Column) -> Column:
    """A feed's date: RFC 2822, ISO, or a day-of-year mistaken for a day of the month ("Thu, 113 Apr 2026")."""
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    rfc = F.try_to_timestamp(F.regexp_extract(plain, r"^([0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    iso = F.try_to_timestamp(F.regexp_extract(plain, r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})", 1), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    doy = F.regexp_extract(plain, r"^([0-9]{2,3}) [A-Za-z]{3} ([0-9]{4})", 1).try_cast("int")
    year = F.regexp_extract(plain, r"^([0-9]{2,3}) [A-Za-z]{3} ([0-9]{4})", 2).try_cast("int")
    repaired = F.when(doy.between(32, 366), F.date_add(F.make_date(year, F.lit(1), F.lit(1)), doy - 1).cast("timestamp"))
    return F.coalesce(rfc, iso, repaired)


def section_of_url(url: Column) -> Column:
    return F.regexp_replace(url, r"^(https?://[^/]+/[^/]+(?:/[^/]+)?/).*$", "$1")


def section_label(section: Column) -> Column:
    leaf = F.element_at(F.split(F.regexp_replace(section, "/+$", ""), "/"), -1)
    return F.initcap(F.regexp_replace(leaf, "-", " "))


def html_to_text(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def terms(text: Column) -> Column:
    """The light analyser's terms, in order: lower case, split at other than letters and digits, one trailing s dropped."""
    return F.transform(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != ""), lambda w: F.regexp_replace(w, "s$", ""))


def title_words(title: Column, blank: str) -> Column:
    """Lower-case words of a title whose other characters became ``blank`` ('' joins "co-pay", ' ' parts it)."""
    return F.split(F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), "[^a-zA-Z ]", blank)), " ")


def has_time(at: Column) -> Column:
    return (F.hour(at) != 0) | (F.minute(at) != 0)
