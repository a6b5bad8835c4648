"""Queries on parsed pages, by name, with the SQL that states the same result. Listings, dated pages and staff pages are made from the given
pages: their titles, addresses and whole texts in the layouts that the rules know."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import feeds, recon
from ..sources import listings
from ..sources.tables import Tables

QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str]] = {}


def add(name: str, op: Callable[[Tables], DataFrame], sql: str = "") -> None:
    QUERIES[name] = (op, sql)


#: Items of a listing, and its layouts: (rule, head of the list, item with T title, U address, D date, I day in ISO form, foot of the list).
ITEMS = 10
LISTED = [
    ("article_block", "", '<div class="wide ArticleBlock"><a class=\'ArticleBlock__link\' href="U"><h2 class="ArticleTitle">T</h2></a><span class="Heading--time">D</span></div>', ""),
    ("loop_item", "", "<div class=e-loop-item><a href='/'>back to where all of it began</a><a href='U'><b>T</b></a><p>posted D</p></div>", ""),
    ("media_list", "", '<div class="media-list-body"><a class="media-list-body-link" href="U"><div class="post-media-list-title">T</div></a><span class="post-media-list-date">D</span></div>', ""),
    ("record_list", '<table class="recordList"><tr><th>Title<th>Day</tr>', '<tr><td class="recordListTitle"><a href="U">T</a><td class="date">D</tr>', "</table>"),
    ("element", "", '<div class="element"><div class="element-title">T</div><a href="U">more</a><span class="element-date">D</span></div>', ""),
    ("press_block", "", '<div class="PressBlock"><div class="PressBlock__content"><a title="x" href="U">T</a></div>D</div>', ""),
    ("jet_grid", "", '<div class="jet-listing-grid__item"><h3>Latest</h3><h3>D</h3><span class="jet-listing-dynamic-link"><a href="U">T</a></span></div>', ""),
    ("divi_post", "", '<article class="post et_pb_post"><h2 class="entry-title"><a href="U">T</a></h2><p class="post-meta">by <span class="author">1/1/99 Desk</span> | <span class="published">D</span></p></article>', ""),
    ("post_item", "", '<article class="postItem"><a href="U/category/">all that is in this category</a><a href="U">T</a><div class="postDate"><span>D</span></div></article>', ""),
    ("archive_item", "", '<article class="sen-listing-item-archive-page"><strong>D</strong><h3><a href="U">T</a></h3></article>', ""),
    ("press_heading", '<div id="press">', '<span class="date">D</span><h2 class="title"><a href="U">T</a></h2>', "</div>"),
    ("configured", "", '<section class="row"><a href="U">T</a><time datetime="I">D</time></section>', ""),
    (".news-item", "", '<div class="news-item"><h4><a href="U">T</a></h4><span class="timestamp">D</span></div>', ""),
    ("canonical_links", "", '<p><a href="https://list.example.org/newsroom/nP">T</a></p>', ""),
]
#: The date of a page's item, as text of one of two forms.
DAY = "date_add(DATE'2025-01-01', cast(page_id % 400 as int))"
SHOWN = f"if(page_id % 2 = 0, date_format({DAY}, 'MMMM d, yyyy'), date_format({DAY}, 'M/d/yyyy'))"
SQL_DAY = "(DATE '2025-01-01' + CAST(page_id % 400 AS INT))"
SQL_SHOWN = f"CASE WHEN page_id % 2 = 0 THEN strftime({SQL_DAY}, '%B %-d, %Y') ELSE strftime({SQL_DAY}, '%-m/%-d/%Y') END"


def listing_pages(t: Tables) -> DataFrame:
    """(page_id, url, html, selector): each ITEMS pages as one listing, its layout by turns."""
    layouts = F.array(*[F.struct(F.lit(head).alias("head"), F.lit(item).alias("item"), F.lit(foot).alias("foot")) for _, head, item, foot in LISTED])
    listing = F.floor(F.col("page_id") / ITEMS)
    layout = F.element_at(layouts, (listing % len(LISTED) + 1).cast("int"))
    title = F.concat(F.lit("Notice "), F.col("page_id").cast("string"), F.lit(" of "), F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1))
    parts = {"U": F.replace("url", F.lit("&"), F.lit("&amp;")), "D": F.expr(SHOWN), "I": F.expr(f"cast({DAY} as string)"), "P": F.col("page_id").cast("string"), "T": title}
    # The marks become strange characters first, so that none in a title or address is taken for one.
    item = layout["item"]
    for k, mark in enumerate(parts):
        item = F.regexp_replace(item, rf"(?<=[\"'>nd ]){mark}(?=[\"'</])", chr(0xE000 + k))
    for k, value in enumerate(parts.values()):
        item = F.replace(item, F.lit(chr(0xE000 + k)), value)
    rows = t.pages.select("page_id", listing.alias("listing"), layout["head"].alias("head"), layout["foot"].alias("foot"), item.alias("item"))
    pages = rows.groupBy("listing").agg(F.array_sort(F.collect_list(F.struct("page_id", "item"))).alias("items"), F.first("head").alias("head"), F.first("foot").alias("foot"))
    body = F.concat(F.lit("<html><head><link href='https://list.example.org/newsroom' rel=canonical></head><body><nav><ul><li class=menu-item><a href='/x'>a menu entry of some length</a></ul></nav>"), "head", F.array_join("items.item", "\n"), "foot", F.lit("</body></html>"))
    return pages.where(F.size("items") > 2).select(F.col("listing").alias("page_id"), F.lit("https://list.example.org/newsroom").alias("url"), body.alias("html"), F.lit("section.row").alias("selector"))


# A title's entities as a parser of pages reads them: also those that lost their semicolon, as where a title was cut short.
PLAIN_TITLE = "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"
for _entity, _char in (("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("#0*39", "chr(39)"), ("amp", "'&'")):
    PLAIN_TITLE = f"regexp_replace({PLAIN_TITLE}, '&{_entity};?', {_char}, 'g')"
#: The first form of a date in the whole text of an item, for layouts that have no element for it: a title may hold one too.
SQL_FIRST_DATE = "coalesce(" + ", ".join(f"nullif(regexp_extract(whole, '{p}'), '')" for p in (r"[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}", r"(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[\pL\pN_]*[\s\pZ]+[0-9]{1,2}(?:st|nd|rd|th)?,?[\s\pZ]+[0-9]{4}", r"[0-9]{4}-[0-9]{2}-[0-9]{2}")) + ", '')"
add(
    "a09_listing_items",
    lambda t: listings.listing_items(listing_pages(t), "example.").select(F.col("page_id").alias("listing"), "rule", "pos", F.sha2("title", 256).alias("title_hash"), "date_text", "detail_url"),
    f""", x AS (SELECT page_id, url, page_id // {ITEMS} AS listing, (page_id // {ITEMS}) % {len(LISTED)} AS layout, rtrim('Notice ' || page_id || ' of ' || {PLAIN_TITLE}) AS title, {SQL_SHOWN} AS shown, CAST({SQL_DAY} AS VARCHAR) AS iso, count(*) OVER (PARTITION BY page_id // {ITEMS}) AS n FROM pages),
  y AS (SELECT *, layout = 1 AND regexp_matches(lower(title), 'home|about|contact|menu') AS dropped, CASE layout WHEN 1 THEN 'back to where all of it began ' || title || ' posted ' || shown ELSE title || ' ' || shown END AS whole FROM x WHERE n > 2)
  SELECT listing, [{", ".join(f"'{rule}'" for rule, *_ in LISTED)}][layout + 1] AS rule, CAST(row_number() OVER (PARTITION BY listing ORDER BY page_id) - 1 AS INT) AS pos, sha256(CASE WHEN dropped THEN '' ELSE title END) AS title_hash,
    CASE WHEN layout IN (1, 5) THEN {SQL_FIRST_DATE} WHEN layout = 11 THEN iso WHEN layout = 13 THEN '' ELSE shown END AS date_text, CASE WHEN dropped THEN '' WHEN layout = 13 THEN 'https://list.example.org/newsroom/n' || page_id ELSE url END AS detail_url FROM y""",
)

#: What says a page's date, by turns: (markup for its head, markup for the start of its main part, source, confidence). I: ISO day, D: text.
DATED = [
    ('<meta property="article:published_time" content="IT10:00:00Z">', "", "meta_tag", 0.95),
    ("<meta content='I' name='date'>", "", "meta_tag", 0.95),
    ('<meta content="soon" name="date"><meta name=pubdate content=I>', "", "meta_tag", 0.95),
    ('<script type="application/ld+json">{"@type": "Article", "datePublished" : "IT08:30:00+00:00"}</script>', "", "json_ld", 0.95),
    ("", "<time class='when' datetime='I'>long ago</time>", "time_element", 0.9),
    ("", "<time>D</time>", "time_element", 0.85),
    ("", "<time>soon</time><p class='meta post-date'><i>D</i></p>", "css_selector", 0.8),
    ("", "<span class='pressDate'>undated</span><span class=published>D</span>", "css_selector", 0.8),
    ("", "<p>Released on D by the office.</p>", "page_text", 0.5),
]


def dated_pages(t: Tables) -> DataFrame:
    """The given pages with a date in one of the forms of DATED."""
    at = (F.col("page_id") % len(DATED) + 1).cast("int")

    def put(k: int) -> Column:
        mark = F.element_at(F.array(*[F.lit(d[k]) for d in DATED]), at)
        mark = F.regexp_replace(mark, "(?<=[\"'= ])I(?=[T\"'>])", chr(0xE000))
        mark = F.regexp_replace(mark, "(?<=[ >])D(?=[ <])", chr(0xE001))
        return F.replace(F.replace(mark, F.lit(chr(0xE000)), F.expr(f"cast({DAY} as string)")), F.lit(chr(0xE001)), F.expr(SHOWN))

    html = F.replace(F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), put(0))), F.lit("<article>"), F.concat(F.lit("<article>"), put(1)))
    return t.pages.select("page_id", html.alias("html"))


add(
    "b12_page_dates",
    lambda t: listings.page_dates(dated_pages(t)),
    f"""SELECT page_id, {SQL_DAY} AS value, [{", ".join(f"'{s}'" for *_, s, _ in DATED)}][page_id % {len(DATED)} + 1] AS source, CAST([{", ".join(str(c) for *_, c in DATED)}][page_id % {len(DATED)} + 1] AS DOUBLE) AS confidence FROM pages""",
)

#: Staff as a page shows it, by turns; N name, M address, T title. Each says one person twice, once with less.
FIRST, LAST = ["Ann", "Bea", "Carl", "Dora", "Emil", "Fay", "Gus"], ["Stone", "Hill", "Lake", "Field", "Marsh"]
STAFF_TITLES = ["Press Secretary", "Communications Director", "Digital Director", "Media Liaison"]
STAFF = [
    "<table><tr><th>Name<th>Role</tr><tr><td>N<td>T<td><a class=m href='mailto:M?subject=x'>write</a><td>(202) 555-0100</tr><tr><td>N<td>T</tr></table>",
    "<dl><dt>N<dd>T, reach M or 202-555-0100<dt>The Building<dd>open all day</dl><p>N, T</p>",
    "<div class='team-list'><div class='staff-card'><h3>N</h3><p>T</p><p>202.555.0100</p><a href=\"mailto:M\">mail</a></div><div class='staff-card'><h3>N</h3><p>T</p></div></div>",
    "<p>For the record: N, T, can be reached at M or 202 555 0100.</p><ul><li>N: T</ul>",
]
#: Keeps numbers in a page's own text out of a contact's reach.
APART = "<p>" + "- " * 150 + "</p>"


def staff_pages(t: Tables) -> DataFrame:
    """The given pages with staff above their texts, and the address of the office."""
    i = F.col("page_id")
    pick = lambda words, k: F.element_at(F.array(*[F.lit(w) for w in words]), (k % len(words) + 1).cast("int"))
    first, last = pick(FIRST, i), pick(LAST, F.floor(i / 7))
    block = pick(STAFF, i)
    for mark, value in (("T", pick(STAFF_TITLES, F.floor(i / 4))), ("M", F.concat(F.lower(first), F.lit("@x.example.org"))), ("N", F.concat(first, F.lit(" "), last))):
        block = F.regexp_replace(block, rf"(?<![A-Za-z]){mark}(?![A-Za-z])", F.concat(F.lit(chr(0xE000)), F.lit(mark)))
        block = F.replace(block, F.lit(chr(0xE000) + mark), value)
    office = F.when(i % 3 == 0, "<p>Mail <a href='mailto:Press@Office.example.org'>the desk</a></p>").otherwise("")
    return t.pages.select("page_id", F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>" + APART), block, office, F.lit(APART))).alias("html"))


add(
    "b30_staff_contacts",
    lambda t: listings.staff_contacts(staff_pages(t), ".example.org").select("page_id", "name", "title", "email", F.regexp_replace("phone", "[^0-9]", "").alias("phone"), "method"),
    f""", x AS (SELECT page_id, [{", ".join(f"'{x}'" for x in FIRST)}][page_id % 7 + 1] AS first, [{", ".join(f"'{x}'" for x in LAST)}][(page_id // 7) % 5 + 1] AS last FROM pages)
  SELECT page_id, first || ' ' || last AS name, [{", ".join(f"'{x}'" for x in STAFF_TITLES)}][(page_id // 4) % 4 + 1] AS title, lower(first) || '@x.example.org' AS email, '2025550100' AS phone, CASE WHEN page_id % 4 = 3 THEN 'name_title' ELSE 'card' END AS method FROM x
  UNION ALL SELECT page_id, NULL, 'Press Office', 'press@office.example.org', NULL, 'office_address' FROM pages WHERE page_id % 3 = 0""",
)
add(
    "f39_contact_summary",
    lambda t: feeds.contact_summary(t.pages, listings.staff_contacts(staff_pages(t), ".example.org").where("page_id % 5 < 2 or (page_id % 5 = 2 and name is null)")),
    """, x AS (SELECT CASE WHEN page_id % 5 < 2 THEN 'found' WHEN page_id % 5 = 2 AND page_id % 3 = 0 THEN 'email_only' ELSE 'not_found' END AS outcome, CASE WHEN page_id % 5 < 2 THEN 1 ELSE 0 END + CASE WHEN page_id % 5 < 3 AND page_id % 3 = 0 THEN 1 ELSE 0 END AS c FROM pages)
  SELECT outcome, count(*) AS n_pages, CAST(sum(c) AS BIGINT) AS n_contacts FROM x GROUP BY outcome""",
)

#: Each dozen pages as a section: the first is its own page, the others its child pages; three of four pages say a date, by turns in three ways.
DOZEN = 12
SECTION_DAY = "date_add(DATE'2025-01-01', cast(page_id * 37 % 400 as int))"


def _section_pages(t: Tables) -> DataFrame:
    kind = (F.floor(F.col("page_id") / DOZEN) + F.col("page_id")) % 4
    shown = F.expr(f"date_format({SECTION_DAY}, 'MMMM d, yyyy')")
    said = F.when(kind == 0, F.concat(F.lit("<time class=x datetime='"), F.expr(f"cast({SECTION_DAY} as string)"), F.lit("'>then</time>"))).when(kind == 1, F.concat(F.lit("<p class='post-date'><b>"), shown, F.lit("</b></p>"))).when(kind == 2, F.concat(F.lit("<p>Said on "), shown, F.lit("</p>"))).otherwise("")
    return t.pages.select(F.floor(F.col("page_id") / DOZEN).alias("section"), (F.col("page_id") % DOZEN).alias("pos"), F.replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), said)).alias("html"))


add(
    "f37_section_dates",
    lambda t: recon.section_dates(_section_pages(t).where("pos = 0"), _section_pages(t).where("pos > 0"), "2025-11-01"),
    """, x AS (SELECT page_id // 12 AS section, page_id % 12 AS pos, (page_id // 12 + page_id) % 4 AS kind, DATE '2025-01-01' + CAST(page_id * 37 % 400 AS INT) AS day FROM pages),
  o AS (SELECT section, kind, day FROM x WHERE pos = 0),
  c AS (SELECT section, arg_min(kind, pos) AS kind, list_distinct(list(day)) AS days FROM x WHERE pos BETWEEN 1 AND 5 AND kind < 3 GROUP BY section),
  j AS (SELECT o.section, CASE WHEN o.kind < 3 THEN [o.day] ELSE [] END AS own, o.kind AS own_kind, c.kind AS child_kind, c.days AS child_days,
    NOT (o.kind < 3 AND o.day >= DATE '2025-11-01') AND coalesce(list_max(c.days) >= DATE '2025-11-01', false) AS turned FROM o LEFT JOIN c ON c.section = o.section),
  k AS (SELECT section, CASE WHEN turned THEN 'child:' || ['time', 'class', 'text'][child_kind + 1] ELSE ['time', 'class', 'text', NULL][own_kind + 1] END AS method, CASE WHEN turned THEN child_days ELSE own END AS days FROM j)
  SELECT section, method, CAST(len(days) AS INT) AS n_dates, CAST(len(list_filter(days, lambda d: d >= DATE '2025-11-01')) AS INT) AS in_window, list_max(days) AS latest FROM k""",
)

add(
    "b35_stream_links",
    lambda t: listings.navigation_links(t.pages).select("page_id", "label", "href", recon.stream_of_label(F.col("label"), F.col("href")).alias("category")),
    """, k AS (SELECT page_id, url, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages),
  l AS (SELECT page_id, url, unnest(regexp_extract_all(nav, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(nav, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS label, unnest(range(len(regexp_extract_all(nav, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 1)))) AS pos FROM k),
  d AS (SELECT page_id, pos, replace(replace(replace(trim(label), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS label, regexp_extract(url, '^[^:/]+://[^/?#]*') || replace(replace(replace(href, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS href FROM l),
  e AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(regexp_replace(regexp_replace(href, '#.*$', ''), '/+$', '')) ORDER BY pos) AS rn FROM d WHERE length(label) BETWEEN 1 AND 40)
  SELECT page_id, label, href, CAST(NULL AS VARCHAR) AS category FROM e WHERE rn = 1""",
)
