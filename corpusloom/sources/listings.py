"""What listing pages, release pages and staff pages say: items, publication dates, contacts. Each page is parsed once in its task; what
its parts mean (dates, sources, which contact is the fullest) is decided by expressions and aggregates.

Cases: null and empty pages have no items, dates or contacts; repeated pages give their rows each time; broken markup is read as far as it
goes; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .folders import small_batches
from .records import EMAIL, NO_NAMES, PHONE, ROWS
from .tree import Node, Page

# ---------------------------------------------------------------- fixed values

# Containers of a listing's items, in order; the first with two hits or more counts. An item of the fourth must hold the second selector.
CONTAINERS = [
    ("article_block", ".ArticleBlock", ""),
    ("loop_item", "div.e-loop-item", ""),
    ("media_list", "div.media-list-body", ""),
    ("record_list", "table.recordList tr", "td.recordListTitle"),
    ("element", "div.element", ""),
    ("press_block", ".PressBlock", ""),
    ("jet_grid", ".jet-listing-grid__item", ""),
    ("divi_post", "article.et_pb_post", ""),
    ("post_item", "article.postItem", ""),
    ("archive_item", "article.sen-listing-item-archive-page", ""),
    ("press_heading", "div#press h2.title", ""),
]
# Configured selectors that are known to name parts of navigation.
NO_CONTAINERS = ["span.elementor-grid-item", "li.page-item"]
# Where no container is known: the first of these with two hits or more.
FALLBACKS = ["table.table-striped tbody tr", "table tbody tr", "table tr", ".views-row", "article", ".element-list .element", "li.press-release", ".record", ".entry", ".list-item", ".news-item"]
# Names of metadata that hold a publication date.
PUBLISHED_META = ["article:published_time", "og:article:published_time", "datePublished", "date", "DC.date.issued", "pubdate"]
# Classes of elements that hold a date.
DATE_CLASSES = [".date", ".post-date", ".entry-date", ".published", ".ArticleBlock__date", ".press-release-date", ".field-name-field-date", ".post-media-list-date", "span.datetime", ".recordListDate", ".pressDate"]
# Forms of a date in an item, in the order in which they are looked for.
DATES = [r"\d{1,2}[./]\d{1,2}[./]\d{2,4}", r"(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}", r"\d{4}-\d{2}-\d{2}"]
# Titles of staff that speak to the press.
PRESS_TITLES = [
    r"press\s+secretary",
    r"deputy\s+press\s+secretary",
    r"communications?\s+director",
    r"deputy\s+communications?\s+director",
    r"spokesperson",
    r"media\s+(?:liaison|relations|contact|director|coordinator)",
    r"director\s+of\s+communications?",
    r"chief\s+of\s+communications?",
    r"press\s+(?:aide|assistant|contact|office|rep)",
    r"digital\s+(?:director|communications?)",
    r"senior\s+communications?\s+(?:advisor|adviser)",
    r"communications?\s+(?:manager|advisor|adviser|strategist|specialist|coordinator)",
    r"public\s+(?:affairs|relations)\s+(?:director|officer|specialist)",
]
# Layouts of items by their class: where title, link and date are. ``shortest``: characters a link's label must exceed; ``avoid``: what
# the address or label must not hold; ``search``: where a date's form is looked for if no element has it ("" for the whole item).
LAYOUTS = [
    {"class": "PressBlock", "links": ".PressBlock__content a, a", "shortest": 10, "dates": [".PressBlock__date, .date"], "search": ""},
    {"class": "media-list-body", "title": [".post-media-list-title, a.media-list-body-link"], "links": "a.media-list-body-link|div.media-list-content a[href]", "dates": [".post-media-list-date"]},
    {"class": "et_pb_post", "links": "h3.entry-title a, h2.entry-title a, .entry-title a", "dates": ["span.published"], "search": ".post-meta"},
    {"class": "postItem", "each": "a[href]", "shortest": 15, "avoid_href": ["category"], "dates": [".postDate span, .postDate"]},
    {"class": "sen-listing-item-archive-page", "links": "h3 a, h2 a", "dates": ["strong"]},
    {"class": "jet-listing-grid__item", "links": ".jet-listing-dynamic-link a, a[href*='/news/release/']", "dated": "h3"},
    {"class": "e-loop-item", "each": "a", "shortest": 15, "avoid_label": ["home", "about", "contact", "menu"], "dates": [".elementor-widget-post-info"], "search": ""},
]
ARTICLE = {"title": [".ArticleTitle"], "links": ".ArticleBlock__link, .ArticleTitle__link, .ArticleTitle a", "dates": [".ArticleBlock__date", ".Heading--time", ".Heading--overline"]}
ELEMENT = {"title": [".element-title"], "links": "a[href]", "dates": [".element-datetime", ".element-date"]}
GENERIC_DATES = [".date", ".datetime", ".timestamp", ".ArticleBlock__date"]

# ---------------------------------------------------------------- items of a listing


def date_in(text: str) -> str:
    return next((m[0] for p in DATES if (m := re.search(p, text))), "")


def containers(page: Page, selector: str | None) -> tuple[str, list[Node]]:
    """(name of the rule, items): known containers, the configured one, common ones, at last links below the page's own address."""
    for name, container, needed in CONTAINERS:
        items = [n for n in page.select(container) if not needed or page.first(needed, n)]
        if len(items) >= 2:
            return name, items
    if selector and selector not in NO_CONTAINERS and (items := page.select(selector)):
        return "configured", items
    for container in FALLBACKS:
        if len(items := page.select(container)) >= 2:
            return container, items
    base = page.first("link[rel='canonical']")
    stem = (base.attrs.get("href") or "").split("/newsroom")[0] if base else ""
    links = [
        a
        for a in (page.select("a[href]") if stem else [])
        if stem in a.attrs["href"] and len(a.text()) > 20 and a.parent.tag not in ("nav", "header", "footer") and not any("menu-item" in c for c in a.parent.classes)
    ]
    return ("canonical_links", links) if len(links) >= 3 else ("none", [])


def by_layout(page: Page, item: Node, layout: dict, domain: str) -> tuple[str, Node | None, str]:
    """(title, link, date text) of an item by a layout."""
    title, link = "", None
    if "each" in layout:
        for a in page.select(layout["each"], item):
            label, href = a.text(), a.attrs.get("href", "")
            if len(label) > layout["shortest"] and domain in href and href and not any(x in href for x in layout.get("avoid_href", ())) and not any(x in label.lower() for x in layout.get("avoid_label", ())):
                title, link = label, a
                break
    else:
        found = next((a for s in layout["links"].split("|") if (a := page.first(s, item))), None)
        if found is not None and len(found.text()) > layout.get("shortest", -1):
            link = found
            title = found.text() if "title" not in layout else ""
        for s in layout.get("title", ()):
            node = page.first(s, item)
            title = node.text() if node else title
            if node is not None and link is None:
                link = next((a for a in node.above() if a.tag == "a" and a.attrs.get("href")), None)
        title = title or (link.text() if link is not None and "title" in layout else title)
    if "dated" in layout:
        return title, link, next((t for h in page.select(layout["dated"], item) if date_in(t := h.text())), "")
    date = next((n.text() for s in layout.get("dates", ()) if (n := page.first(s, item))), "")
    if not date and "search" in layout:
        where = page.first(layout["search"], item) if layout["search"] else item
        date = date_in(where.text(" ")) if where else ""
    return title, link, date


def generic(page: Page, item: Node) -> tuple[str, Node | None, str]:
    title, link = "", None
    if item.tag == "a":
        return item.text(), item, ""
    for s in ("h2 a", "h3 a", "h4 a", "a"):
        node = page.first(s, item)
        if node and len(node.text()) > 10:
            title, link = node.text(), node if node.attrs.get("href") not in (None, "#") else None
            break
    if not title:
        node = next((n for s in ("h2", "h3", "h4", "td a") if (n := page.first(s, item)) and len(n.text()) > 5), None)
        if node:
            title, link = node.text(), node if node.tag == "a" else None
    stamp = page.first("time", item)
    if stamp:
        return title, link, stamp.attrs.get("datetime") or stamp.text()
    return title, link, next((n.text() for s in GENERIC_DATES if (n := page.first(s, item))), "") or date_in(item.text(" "))


def item_of(page: Page, item: Node, domain: str) -> tuple[str, Node | None, str]:
    layout = next((x for x in LAYOUTS if x["class"] in item.classes), None)
    if layout:
        return by_layout(page, item, layout, domain)
    if item.tag == "h2" and "title" in item.classes:  # flat: the date is a sibling before the heading
        link, date = page.first("a", item), ""
        for other in item.parent.children:
            if other is item:
                break
            if isinstance(other, Node) and other.tag == "span" and "date" in other.classes:
                date = other.text()
        return link.text() if link else "", link, date
    if page.first(ARTICLE["links"], item) or page.first(".ArticleTitle", item):
        title, link, date = by_layout(page, item, ARTICLE, domain)
        return title, link or (item if item.tag == "a" else None), date
    if "element" in item.classes and page.first(".element-title", item):
        return by_layout(page, item, ELEMENT, domain)
    return generic(page, item)


def listing_items(pages: DataFrame, domain: str = "") -> DataFrame:
    """(page_id, rule, pos, title, date_text, detail_url) of the items of listing pages, in document order. pages: page_id, url, html, and
    if it has it ``selector``, the configured container. ``domain``: what addresses must hold where a layout takes any link."""
    config = F.col("selector") if "selector" in pages.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page_id, url, html, selector in zip(b.page_id, b.url, b.html, b.selector, strict=True):
                page = Page(html)
                rule, items = containers(page, selector)
                for pos, item in enumerate(items):
                    title, link, date = item_of(page, item, domain)
                    href = link.attrs.get("href", "") if link is not None else ""
                    rows.append((page_id, rule, pos, title, date, joined(url, href)))
            yield pd.DataFrame(rows, columns=["page_id", "rule", "pos", "title", "date_text", "detail_url"])

    return small_batches(pages.select("page_id", "url", "html", config.alias("selector")), ROWS).mapInPandas(run, "page_id long, rule string, pos int, title string, date_text string, detail_url string")


def joined(base: str | None, href: str) -> str:
    try:
        return urljoin(base or "", href) if href else ""
    except ValueError:  # an address that is none
        return href


# ---------------------------------------------------------------- links of a site's navigation

# Fixed value: where a page's navigation is; all links stand in where it has fewer than NAV_LINKS there.
NAVIGATION = "nav a, header a, .menu a, #menu a, .navigation a, .nav a"
NAV_LINKS, LONGEST_LABEL = 5, 40


def navigation_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, label, href) of the links in a page's navigation (menus and headers in any markup, labels in any elements inside): labels of at
    most LONGEST_LABEL characters, addresses of the page's own host (or one below it) as absolute ones, each once without its fragment and last slash,
    in any case of letters; the first wins. pages: page_id, url, html."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page_id, url, html in zip(b.page_id, b.url, b.html, strict=True):
                page = Page(html)
                links = page.select(NAVIGATION)
                links = links if len(links) >= NAV_LINKS else page.select("a")
                for a in links:
                    label, href = " ".join(a.text(" ").split()), (a.attrs.get("href") or "").strip()
                    if 0 < len(label) <= LONGEST_LABEL and href and not re.match(r"(?i)#|mailto:|tel:|javascript:", href):
                        rows.append((page_id, a.place, label, joined(url, href), url))
            yield pd.DataFrame(rows, columns=["page_id", "pos", "label", "href", "url"], dtype=object)

    found = small_batches(pages.select("page_id", "url", "html"), ROWS).mapInPandas(run, "page_id long, pos int, label string, href string, url string")
    host = lambda c: F.regexp_replace(F.lower(F.regexp_extract(c, r"^[^:/?#]+://([^/?#:]*)", 1)), "^www\\.", "")
    own = (host(F.col("href")) == host(F.col("url"))) | F.endswith(host(F.col("href")), F.concat(F.lit("."), host(F.col("url"))))
    plain = F.lower(F.regexp_replace(F.regexp_replace("href", "#.*$", ""), "/+$", ""))
    first = found.where(own & (host(F.col("url")) != "")).groupBy("page_id", plain.alias("plain")).agg(F.min_by(F.struct("pos", "label", "href"), "pos").alias("x"))
    return first.select("page_id", "x.pos", "x.label", "x.href")


# ---------------------------------------------------------------- publication dates


def date_candidates(pages: DataFrame) -> DataFrame:
    """(page_id, meta, ld, stamp, time_text, classes, main): the texts in which a page's date is looked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page_id, html in zip(b.page_id, b.html, strict=True):
                page = Page(html)
                metas = page.select("meta")
                named = [next((m for key in ("property", "name") for m in metas if m.attrs.get(key) == name), None) for name in PUBLISHED_META]
                ld = [m[1] for s in page.select("script[type='application/ld+json']") if (m := re.search(r'"datePublished"\s*:\s*"([^"]+)"', "".join(x for x in s.children if isinstance(x, str))))]
                stamp, shown = page.first("time[datetime]"), page.first("time")
                classes = [n.text() for s in DATE_CLASSES if (n := page.first(s))]
                main = page.first("main") or page.first("article") or page.first("body")
                rows.append((page_id, [m.attrs.get("content", "") for m in named if m], ld, stamp.attrs["datetime"] if stamp else None, shown.text() if shown else None, classes, main.text(" ")[:1000] if main else None))
            yield pd.DataFrame(rows, columns=["page_id", "meta", "ld", "stamp", "time_text", "classes", "main"])

    return small_batches(pages.select("page_id", "html"), ROWS).mapInPandas(run, "page_id long, meta array<string>, ld array<string>, stamp string, time_text string, classes array<string>, main string")


def iso_day(text: Column) -> Column:
    return F.try_to_date(F.regexp_extract(F.trim(text), r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T ].*)?$", 1), "yyyy-MM-dd")


def page_dates(pages: DataFrame) -> DataFrame:
    """(page_id, value, source, confidence) by six steps: metadata and JSON-LD (.95), a time element's attribute (.9) or text (.85), elements of
    eleven classes (.8), the first 1,000 characters of the main part (.5); nulls where none has a date."""
    told = lambda c: C.parse_date_text(c)["value"]
    first = lambda found: F.get(F.filter(found, lambda d: d.isNotNull()), F.lit(0))
    steps = [
        (first(F.transform("meta", iso_day)), "meta_tag", 0.95),
        (first(F.transform("ld", iso_day)), "json_ld", 0.95),
        (iso_day(F.col("stamp")), "time_element", 0.9),
        (told(F.col("time_text")), "time_element", 0.85),
        (first(F.transform("classes", told)), "css_selector", 0.8),
        (told(F.col("main")), "page_text", 0.5),
    ]
    found = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(s).alias("source"), F.lit(c).alias("confidence"))) for v, s, c in steps])
    return date_candidates(pages).select("page_id", found.alias("d")).select("page_id", "d.value", "d.source", "d.confidence")


# ---------------------------------------------------------------- staff contacts

TITLE = re.compile(r"\b(" + "|".join(sorted(PRESS_TITLES, key=len, reverse=True)) + r")\b", re.I)
#: A name: two or three capitalised words, with an initial between them or not.
PERSON = r"([A-Z][a-z]+(?:\s+[A-Z]\.?)?(?:\s+(?:Mc|O')?[A-Z][a-z]+){1,2})"
NAME = re.compile(PERSON)
NAMED = re.compile(PERSON + r"\s*[,\-|]\s*((?i:" + "|".join(sorted(PRESS_TITLES, key=len, reverse=True)) + r"))\b")
CONTACT_LINE = re.compile(r"(?i:(?:press\s+)?contacts?\s*:\s*)([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})")
#: Elements that hold one person each, and the words of a class that make any element such a one.
CARDS, CARD_WORDS = {"tr", "li", "dd"}, ("staff", "team", "person", "card", "contact")


def reached_at(text: str) -> tuple[str | None, str | None]:
    mail, phone = re.search(EMAIL, text), re.search(PHONE, text)
    return mail[0] if mail else None, phone[0] if phone else None


def is_name(name: str) -> bool:
    return len(name) >= 4 and not name.isupper() and name.lower() not in NO_NAMES and not TITLE.search(name)


def contacts_of(page: Page, office_domain: str) -> Iterator[tuple]:
    """(name, title, email, phone, method): cards of one person each (table rows, list items, definitions, elements named so), names with a
    title in running text, lines that name a contact, and mail addresses of the press office."""
    cards = [n for n in page.nodes if n.tag in CARDS or any(w in c.lower() for c in n.classes for w in CARD_WORDS)]
    inner = {above.place for n in cards for above in n.above()}
    for n in cards:
        if n.place in inner:
            continue  # the cards inside it are the persons
        text = n.text(" ")
        if n.tag == "dd":  # its term belongs to it
            before = [x for x in n.parent.children if isinstance(x, Node) and x.place < n.place]
            text = (before[-1].text(" ") + " " if before and before[-1].tag == "dt" else "") + text
        title = TITLE.search(text)
        if not title:
            continue
        name = next((m for part in (text[: title.start()], text[title.end() :]) for m in NAME.findall(part) if is_name(m)), None)
        if name:
            mail = page.first("a[href*='mailto:']", n)
            email, phone = reached_at(text)
            yield name, title[1], mail.attrs["href"].split(":", 1)[1].split("?")[0] if mail else email, phone, "card"
    text = page.root.text(" ")
    for method, found, before, after in (("name_title", NAMED.finditer(text), 200, 200), ("contact_line", CONTACT_LINE.finditer(text), 100, 300)):
        for m in found:
            if is_name(m[1]):
                yield m[1], m[2] if method == "name_title" else "press contact", *reached_at(text[max(0, m.start() - before) : m.end() + after]), method
    links = " ".join(a.attrs["href"] for a in page.select("a[href*='mailto:']"))
    for mail in re.findall(rf"(?i)\b(?:press|media|communications)@[a-zA-Z0-9.\-]*{re.escape(office_domain)}\b", text + " " + links):
        yield None, "press office", mail.lower(), None, "office_address"


def staff_contacts(pages: DataFrame, office_domain: str = "") -> DataFrame:
    """(page_id, name, title, email, phone, method): of each page's contacts with one name and title (of offices: address and title) the
    fullest, and of equally full ones the first found. Titles and names are compared in lower case."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, *x) for i, html in zip(b.page_id, b.html, strict=True) for k, x in enumerate(contacts_of(Page(html), office_domain))]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "name", "title", "email", "phone", "method"], dtype=object)

    found = small_batches(pages.select("page_id", "html"), ROWS).mapInPandas(run, "page_id long, pos int, name string, title string, email string, phone string, method string")
    found = found.withColumn("title", F.initcap(F.regexp_replace(F.lower("title"), r"\s+", " ")))
    filled = F.col("email").isNotNull().cast("int") + F.col("phone").isNotNull().cast("int")
    best = found.groupBy("page_id", F.lower(F.coalesce("name", "email")).alias("who"), "title").agg(F.max_by(F.struct("name", "email", "phone", "method"), F.struct(filled, -F.col("pos"))).alias("x"))
    return best.select("page_id", "x.name", "title", "x.email", "x.phone", "x.method")
