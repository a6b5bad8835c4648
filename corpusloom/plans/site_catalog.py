"""Queries about titles, names, sites, sources and ranked search, by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import feeds, fulltext, recon, terms
from ..sources import html, records, sites
from ..sources.tables import AS_OF, Tables

QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str]] = {}

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FULL_NAMES = ["Charles E. Able", "Bob Stone Jr.", "Katherine Hill", "Ted Ångström", "Solo"]
#: DuckDB's form of html_to_text of a column.
PLAIN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({x}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))"""
HAVE = "list_transform(list_filter(string_split_regex(lower(concat_ws(' ', title, body_text)), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: regexp_replace(w, 's$', ''))"


def add(name: str, op: Callable[[Tables], DataFrame], sql: str = "") -> None:
    QUERIES[name] = (op, sql)


def listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _titles(t: Tables) -> DataFrame:
    """Titles with entities of each kind; every other one in capitals."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    title = F.concat(F.when(F.col("page_id") % 2 == 0, F.translate(title, LOWER, UPPER)).otherwise(title), F.lit(" &#8217;&#x2014;&x2026; &amp;"))
    return t.pages.select("page_id", N.normalize_title(title).alias("title"))


def _numbered_sql(x: str, mark: str, digits: str, number: str) -> str:
    """Entities of one form as the characters of their numbers; numbers that are no character stay as they are."""
    entity = f"&{mark}[{digits}]+;?"
    digit = f"regexp_extract(p, '&{mark}([{digits}]+)', 1)"
    code = f"CASE WHEN regexp_full_match(p, '{entity}') AND length({digit}) <= 8 THEN TRY_CAST({number.format(d=digit)} AS BIGINT) END"
    good = "n BETWEEN 1 AND 55295 OR n BETWEEN 57344 AND 1114111"
    char = f"list_transform([{code}], lambda n: CASE WHEN {good} THEN chr(CAST(CASE WHEN {good} THEN n ELSE 32 END AS INT)) ELSE p END)[1]"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '{entity}|[^&]+|&'), lambda p: {char}), '')"


def _decoded_sql(x: str) -> str:
    """DuckDB's form of decode_entities of a column."""
    for mark, digits, number in (("#x", "0-9a-fA-F", "'0x' || {d}"), ("#", "0-9", "{d}"), ("x", "0-9a-fA-F", "'0x' || {d}")):
        x = _numbered_sql(x, mark, digits, number)
    for name, char in [kv for kv in N.ENTITIES.items() if kv[0] != "amp"] + [("amp", "&")]:
        x = f"replace({x}, '&{name};', {listed([char])})"
    return x


#: Letters whose capitals are several characters, which DuckDB's upper() doesn't know (it makes one of a sharp s).
CAPITALS = "MAP {" + ", ".join(f"'{c}': '{c.upper()}'" for c in map(chr, range(0x110000)) if len(c.upper()) > 1) + "}"

add(
    "b21_normalize_title",
    _titles,
    rf"""SELECT page_id, CASE WHEN letters = 0 OR capitals < 0.7 * letters THEN x ELSE array_to_string(list_transform(regexp_extract_all(x, '\s+|\S+'), lambda w, i:
  CASE WHEN regexp_full_match(regexp_replace(w, '[^a-zA-Z]', '', 'g'), '[A-Z]{{2,4}}') AND lower(regexp_replace(w, '[^a-zA-Z]', '', 'g')) NOT IN ({listed(N.SMALL_WORDS)}) THEN w
       WHEN i > 1 AND lower(regexp_replace(w, '[^a-zA-Z]', '', 'g')) IN ({listed(N.SMALL_WORDS)}) THEN lower(w) ELSE coalesce({CAPITALS}[substr(w, 1, 1)], upper(substr(w, 1, 1))) || lower(substr(w, 2)) END), '') END AS title
  FROM (SELECT page_id, x, length(regexp_replace(x, '[^a-zA-Z]', '', 'g')) AS letters, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS capitals FROM (
    SELECT page_id, {_decoded_sql("y")} AS x FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN translate(h, '{LOWER}', '{UPPER}') ELSE h END || ' &#8217;&#x2014;&x2026; &amp;' AS y FROM (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS h FROM pages))))""",
)
add(
    "b23_name_exclusions",
    lambda t: t.members.select("member_id", F.array_join(N.name_exclusions(F.element_at(N.strings(FULL_NAMES), (F.col("member_id") % 5 + 1).cast("int")), F.lower("state")), " ").alias("tokens")),
    f""", nick AS (SELECT formal, unnest(string_split(nicks, ' ')) AS nick FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in ((k, ' '.join(v)) for k, v in N.NICKNAMES.items()))}) AS v(formal, nicks)),
  tok AS (SELECT member_id, unnest(string_split_regex(lower(list_extract([{listed(FULL_NAMES)}], member_id % 5 + 1) || ' ' || state), '[^a-z]+')) AS w FROM members),
  every AS (SELECT member_id, w FROM tok UNION SELECT member_id, nick FROM tok JOIN nick ON formal = w UNION SELECT member_id, formal FROM tok JOIN nick ON nick = w)
  SELECT member_id, string_agg(w, ' ' ORDER BY w) AS tokens FROM every WHERE length(w) > 2 GROUP BY member_id""",
)
add(
    "b24_entity_key",
    lambda t: t.members.select("member_id", N.entity_key(F.element_at(N.strings(FULL_NAMES), (F.col("member_id") % 5 + 1).cast("int"))).alias("key")),
    "SELECT member_id, list_extract(['able-charles', 'stone-bob', 'hill-katherine', 'ngstrm-ted', 'solo'], member_id % 5 + 1) AS key FROM members",
)


def _text_names(t: Tables) -> DataFrame:
    """The name that a text's first words make: two words, or three for every third text."""
    words = F.slice(F.expr("regexp_extract_all(lower(body_text), '[a-zà-ÿ]+', 0)"), 1, F.when(F.col("release_id") % 3 == 0, 3).otherwise(2))
    return t.releases.select("release_id", F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " ").alias("name"), words.alias("w"))


def _asked_names(t: Tables) -> DataFrame:
    """Each name as another source writes it, by turns: its id, in capitals, without marks, with a suffix, under another first name."""
    n, i = _text_names(t), F.col("release_id")
    plain = N.without_marks(F.lower("name"))
    entity = F.when(i % 5 == 0, F.concat_ws("-", F.element_at(F.split(plain, " "), -1), F.get(F.split(plain, " "), F.lit(0))))
    name = F.when(i % 5 == 0, "").when(i % 5 == 1, F.upper("name")).when(i % 5 == 2, plain).when(i % 5 == 3, F.concat(plain, F.lit(", Jr."))).otherwise(F.concat(F.lit("Zzyzx "), F.element_at(F.split(plain, " "), -1)))
    return n.where("size(w) > 1").select(i.alias("ask_id"), entity.alias("entity_id"), name.alias("full_name"))


add(
    "b24_resolved_names",
    lambda t: N.resolve_names(_asked_names(t), _text_names(t).where("size(w) > 1").select(F.col("release_id").alias("known_id"), F.col("name").alias("full_name"))),
    r""", w AS (SELECT release_id, regexp_extract_all(lower(body_text), '[a-zà-ÿ]+')[1 : CASE WHEN release_id % 3 = 0 THEN 3 ELSE 2 END] AS w FROM releases),
  n AS (SELECT release_id, array_to_string(w, ' ') AS lower, strip_accents(array_to_string(w, ' ')) AS plain, list_transform(w, lambda x: strip_accents(x)) AS p FROM w WHERE len(w) > 1),
  ks AS (SELECT release_id AS id, unnest([{'s': 0, 'k': p[len(p)] || '-' || p[1]}, {'s': 0, 'k': array_to_string(p[2:], '-') || '-' || p[1]}, {'s': 1, 'k': lower}, {'s': 2, 'k': plain}, {'s': 3, 'k': plain}, {'s': 4, 'k': p[len(p)]}]) AS kk FROM n),
  sure AS (SELECT kk.s AS s, kk.k AS k, min(id) AS id FROM ks GROUP BY ALL HAVING count(DISTINCT id) = 1),
  a AS (SELECT release_id AS ask_id, unnest(CASE release_id % 5 WHEN 0 THEN [{'s': 0, 'k': p[len(p)] || '-' || p[1]}]
    WHEN 1 THEN [{'s': 1, 'k': lower}, {'s': 2, 'k': plain}, {'s': 3, 'k': regexp_replace(plain, '\s*\b(jr|sr|iii|ii|iv)$', '')}, {'s': 4, 'k': string_split(trim(regexp_replace(plain, '\s*\b(jr|sr|iii|ii|iv)$', '')), ' ')[-1]}]
    WHEN 2 THEN [{'s': 1, 'k': plain}, {'s': 2, 'k': plain}, {'s': 3, 'k': regexp_replace(plain, '\s*\b(jr|sr|iii|ii|iv)$', '')}, {'s': 4, 'k': string_split(trim(regexp_replace(plain, '\s*\b(jr|sr|iii|ii|iv)$', '')), ' ')[-1]}]
    WHEN 3 THEN [{'s': 1, 'k': plain || ', jr.'}, {'s': 2, 'k': plain || ', jr.'}, {'s': 3, 'k': plain}, {'s': 4, 'k': p[len(p)]}]
    ELSE [{'s': 1, 'k': 'zzyzx ' || p[len(p)]}, {'s': 2, 'k': 'zzyzx ' || p[len(p)]}, {'s': 3, 'k': 'zzyzx ' || p[len(p)]}, {'s': 4, 'k': p[len(p)]}] END) AS kk FROM n),
  f AS (SELECT ask_id, min({'s': sure.s, 'id': sure.id}) FILTER (sure.id IS NOT NULL) AS x FROM a LEFT JOIN sure ON sure.s = a.kk.s AND sure.k = a.kk.k GROUP BY ask_id)
  SELECT ask_id, x.id AS known_id, ['id', 'name', 'plain', 'no_suffix', 'last_name'][x.s + 1] AS stage FROM f""",
)


def _laid_out(t: Tables) -> DataFrame:
    """Texts with a word a line for the first two dozen words of every third document, and end marks."""
    x = F.col("body_text")
    shaped = F.when(F.col("release_id") % 3 == 0, F.concat(F.regexp_replace(F.substring(x, 1, 150), " ", "\n\n"), F.substr(x, F.lit(151)))).otherwise(x)
    return t.releases.select(F.col("release_id").alias("doc_id"), F.concat(shaped, F.lit("\n\n###  ")).alias("text"))


add(
    "b28_clean_texts",
    lambda t: recon.clean_texts(_laid_out(t)).select("doc_id", F.md5("text").alias("text_hash")),
    r""", d AS (SELECT release_id AS doc_id, coalesce(CASE WHEN release_id % 3 = 0 THEN replace(substr(body_text, 1, 150), ' ', chr(10) || chr(10)) || substr(body_text, 151) ELSE body_text END || chr(10) || chr(10) || '###  ', '') AS text FROM releases),
  s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) AS ls FROM d),
  l AS (SELECT doc_id, i AS pos, trim(regexp_replace(ls[i], '[\t\r]', ' ', 'g')) AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM s)),
  f AS (SELECT *, line <> '' AND length(line) <= 24 AND len(list_filter(string_split_regex(line, '\s+'), lambda w: w <> '')) <= 3 AS frag FROM l),
  r AS (SELECT *, sum(CASE WHEN line <> '' AND NOT frag THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f),
  k AS (SELECT * FROM (SELECT *, bool_or(frag) OVER (PARTITION BY doc_id, run ORDER BY pos) AS seen FROM r) WHERE line <> '' OR NOT seen),
  p AS (SELECT doc_id, run, concat_ws(chr(10), string_agg(line, chr(10) ORDER BY pos) FILTER (NOT frag), CASE WHEN count(*) FILTER (frag) >= 3 THEN string_agg(line, ' ' ORDER BY pos) FILTER (frag) ELSE string_agg(line, chr(10) ORDER BY pos) FILTER (frag) END) AS part FROM k GROUP BY doc_id, run),
  w AS (SELECT doc_id, string_agg(part, chr(10) ORDER BY run) AS text FROM p GROUP BY doc_id)
  SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '(?m)\n+#{2,}[ \t]*$|\n+-[ \t]*30[ \t]*-[ \t]*$', '', 'g'), '^\s+|\s+$', '', 'g')) AS text_hash FROM w""",
)
SIGNALS = rf""", q AS (SELECT page_id, html, lower(substr(html, 1, 5000)) AS head, {PLAIN.format(x="html")} AS text FROM pages),
  u AS (SELECT page_id, CASE WHEN contains(head, 'wp-content') OR contains(head, 'wp-json') THEN 'wordpress' WHEN contains(head, 'drupal') OR regexp_matches(html, 'class=["''][^"'']*(drupal|views-row)') THEN 'drupal'
      WHEN contains(head, 'index.cfm') OR contains(head, 'coldfusion') THEN 'coldfusion' WHEN contains(head, 'fireside21') OR contains(head, 'sos_widget') THEN 'fireside' ELSE 'unknown' END AS family,
    CASE WHEN regexp_matches(html, '(?i)govdelivery\.com/accounts/[A-Za-z0-9_]') THEN 'govdelivery' WHEN regexp_matches(html, '(?i)(list-manage|mailchimp)\.com') THEN 'mailchimp' WHEN regexp_matches(html, '(?i)constantcontact\.com') THEN 'constant_contact'
      WHEN regexp_matches(html, '(?i)type=["'']email["'']') AND regexp_matches(html, '(?i)subscribe|sign.?up|newsletter') THEN 'custom_form' ELSE 'unknown' END AS platform,
    contains(lower(text), 'press release') OR contains(lower(text), 'news release') OR contains(lower(text), 'statement') OR contains(lower(text), 'newsroom') OR len(regexp_extract_all(text, '{sites.MONTH_DATE}')) >= 3 AS press_listing,
    len(regexp_extract_all(html, '(?i)<article[\s>]')) >= 3 OR len(regexp_extract_all(html, '(?is)<li[^>]*>\s*<a[\s>]')) >= 20 OR len(regexp_extract_all(html, '(?is)<h[23][^>]*>\s*<a[\s>]')) >= 5 AS list_like,
    TRY_CAST(regexp_extract(text, 'of\s+([0-9]{{1,18}})\s+(?:results?|entries|items|records)', 1) AS BIGINT) AS total,
    round(least(1.0, 0.3::DOUBLE + CASE WHEN regexp_matches(html, '(?i)<(li|article)[\s>]') THEN 0.25 ELSE 0 END + CASE WHEN regexp_matches(html, '(?i)<h[1-4][\s>]') THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(html, '(?i)<time[\s>]') THEN 0.1 ELSE 0 END
      + CASE WHEN regexp_matches(html, '(?i)<a [^>]*href="') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(text, 'of\s+[0-9]{{1,18}}\s+(results?|entries|items|records)') THEN 0.1 ELSE 0 END + CASE WHEN len(regexp_extract_all(html, '{sites.MONTH_DATE}')) >= 5 THEN 0.05 ELSE 0 END), 2) AS confidence FROM q),
  v AS (SELECT *, CASE WHEN total IS NOT NULL THEN 'items' END AS unit, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'mid' ELSE 'low' END AS band FROM u)"""


add("b31_b45_page_signals", lambda t: sites.page_signals(t.pages), f"{SIGNALS} SELECT page_id, family, platform, press_listing, list_like, total, unit, confidence, band FROM v")
add(
    "f32_recon_summary",
    lambda t: recon.recon_summary(t.pages),
    f"""{SIGNALS} SELECT 'family' AS signal, family AS value, count(*) AS n FROM v GROUP BY family UNION ALL SELECT 'band', band, count(*) FROM v GROUP BY band
  UNION ALL SELECT 'platform', platform, count(*) FROM v GROUP BY platform UNION ALL SELECT 'pagination', coalesce(unit, 'unknown'), count(*) FROM v GROUP BY 2""",
)
add(
    "b36_migration_stamped",
    lambda t: t.releases.select("release_id", N.migration_stamped(F.col("published_at"), F.col("scraped_at") - F.make_dt_interval(hours=F.when(F.col("release_id") % 2 == 0, 6).otherwise(0)), "2025-09-29").alias("stamped"), N.numbered_slug(F.concat(F.lit("/news/x-"), F.col("release_id").cast("string"))).alias("numbered")),
    "SELECT release_id, coalesce(published_at = TIMESTAMP '2025-09-29' AND release_id % 2 = 0, false) AS stamped, true AS numbered FROM releases",
)
add(
    "b37_slug_candidates",
    lambda t: t.pages.select("page_id", F.array_join(N.slug_candidates(F.concat(F.lit("/news-room/"), F.when(F.col("page_id") % 2 == 0, "op-eds").otherwise("letters"), F.lit("/"))), " ").alias("slugs")),
    "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'op-eds op_eds opeds op-ed op_ed news-room news_room newsroom' ELSE 'letters letter news-room news_room newsroom' END AS slugs FROM pages",
)
add(
    "b41_tenure",
    lambda t: t.releases.select("release_id", N.years_in_office(F.to_date("published_at"), F.lit(AS_OF).cast("date")).alias("years"), N.next_election(F.to_date("published_at")).alias("election")),
    f"SELECT release_id, CASE WHEN published_at IS NULL THEN '—' WHEN d / 365.25 < 1 THEN '<1' ELSE CAST(CAST(floor(d / 365.25) AS BIGINT) AS VARCHAR) END AS years, coalesce('Nov ' || CAST(year(published_at) - 1 AS VARCHAR), '—') AS election FROM (SELECT *, date_diff('day', CAST(published_at AS DATE), DATE '{AS_OF[:10]}') AS d FROM releases)",
)


def _sitemaps(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Sitemaps of 50 addresses each, and indexes of 40 sitemaps each."""
    leaf = F.floor(F.col("page_id") / 50)
    entry = F.concat(F.lit("<url><loc>"), F.col("url"), F.lit("</loc>"), F.when(F.col("page_id") % 2 == 0, "<lastmod>2025-01-02</lastmod>").otherwise(""), F.lit("</url>"))
    leaves = t.pages.groupBy(leaf.alias("k")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("xml"))
    child = F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("<sitemap><loc>leaf-"), F.col("k").cast("string"), F.lit(".xml</loc></sitemap>")).alias("s"))))
    indexes = t.pages.select(leaf.alias("k")).distinct().groupBy(F.floor(F.col("k") / 40).alias("j")).agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform(child, lambda x: x["s"]), ""), F.lit("</sitemapindex>")).alias("xml"))
    roots = indexes.select(F.concat(F.lit("index-"), F.col("j").cast("string"), F.lit(".xml")).alias("map_url"), "xml")
    return leaves.select(F.concat(F.lit("leaf-"), F.col("k").cast("string"), F.lit(".xml")).alias("map_url"), "xml").unionByName(roots), roots.select("map_url")


add(
    "a07_sitemap_urls",
    lambda t: sites.sitemap_urls(*_sitemaps(t)),
    "SELECT 'index-' || page_id // 50 // 40 || '.xml' AS root, url, CASE WHEN page_id % 2 = 0 THEN '2025-01-02' END AS lastmod FROM pages",
)


def _responses(t: Tables) -> DataFrame:
    rendered = lambda x: F.struct(x.alias("rendered"))
    record = F.struct(
        F.concat(F.lit("https://h.example.com/p/"), F.col("release_id").cast("string"), F.lit("/?utm_source=x")).alias("link"),
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("date_gmt"),
        rendered(F.when(F.col("release_id") % 4 == 0, "<b>No</b>").otherwise(F.concat(F.lit("<b>From</b> "), F.col("source")))).alias("title"),
        rendered(F.concat(F.lit("<p>"), F.col("body_text"), F.lit("</p>"))).alias("content"),
    )
    return t.releases.select(F.col("release_id").alias("body_id"), F.concat(F.lit("<!-- cache -->"), F.to_json(F.array(record)), F.lit("<br>")).alias("body"))


add(
    "a08_cms_records",
    lambda t: sites.cms_records(_responses(t), "2025-06-01").select("body_id", "url", F.to_date("published_at").alias("day"), "title"),
    "SELECT release_id AS body_id, 'https://h.example.com/p/' || release_id AS url, CAST(published_at AS DATE) AS day, trim('From ' || source) AS title FROM releases WHERE published_at >= TIMESTAMP '2025-06-01' AND release_id % 4 <> 0 AND length(trim('From ' || source)) >= 5",
)
add(
    "a06_titles_homogeneous",
    lambda t: sites.titles_homogeneous(t.releases.select(F.col("member_id").alias("feed_id"), "title")),
    r"SELECT member_id AS feed_id, NOT coalesce(bool_or(regexp_matches(lower(title), '\bnewsletter\b|\bweek in review\b|\bweekly (update|roundup|recap)\b|\bpodcast\b|^\s*episode [0-9]+|\bin the news\b')), false) AND coalesce(avg(length(title)), 0) >= 15 AS homogeneous FROM releases GROUP BY member_id",
)
def _feed_items(t: Tables) -> DataFrame:
    """The releases as items of feeds: two for each member, in order of ids, with whole bodies as markup and the status of some links."""
    i = F.col("release_id")
    feed = F.col("member_id") * 2 + F.floor(i / 150) % 2
    pos = F.row_number().over(Window.partitionBy(feed).orderBy("release_id")) - 1
    status = F.when(i % 7 != 0, F.when(i % 4 == 0, 404).otherwise(200))
    return t.releases.select("member_id", feed.alias("feed_id"), pos.alias("pos"), "title", "published_at", F.concat(F.lit("<p>"), F.regexp_replace("body_text", "[<>&]", " "), F.lit("</p>")).alias("body"), status.alias("link_status"))


add(
    "a05_best_feeds",
    lambda t: sites.best_feeds(_feed_items(t), AS_OF).select("member_id", "feed_id", "n_items", F.round("dated_share", 6).alias("dated_share"), "span_days", "stale_days", "mean_body", "full_bodies", "eligible", F.array_join("reasons", ", ").alias("reasons")),
    r""", i AS (SELECT *, member_id * 2 + (release_id // 150) % 2 AS feed_id, length(trim(regexp_replace(regexp_replace(coalesce(body_text, ''), '[<>&]', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS chars, CASE WHEN release_id % 7 <> 0 THEN CASE WHEN release_id % 4 = 0 THEN 404 ELSE 200 END END AS status FROM releases),
  p AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY release_id) <= 3 AS top FROM i),
  f AS (SELECT member_id, feed_id, count(*) AS n_items, round(count(published_at) / count(*), 6) AS dated_share, date_diff('day', CAST(min(published_at) AS DATE), CAST(max(published_at) AS DATE)) AS span_days, date_diff('day', CAST(max(published_at) AS DATE), DATE '2026-04-26') AS stale_days,
    CAST(floor(avg(chars) FILTER (top)) AS BIGINT) AS mean_body, coalesce(bool_or(regexp_matches(lower(title), '\bnewsletter\b|\bweek in review\b|\bweekly (update|roundup|recap)\b|\bpodcast\b|^\s*episode [0-9]+|\bin the news\b')) FILTER (top), false) AS odd, avg(length(title)) FILTER (top) AS title_length,
    count(status) FILTER (top) AS checked, count(*) FILTER (top AND status = 200) AS ok FROM p GROUP BY ALL),
  b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY n_items DESC, coalesce(span_days, 0) DESC, feed_id) = 1),
  r AS (SELECT *, concat_ws(', ', CASE WHEN n_items < 10 THEN 'few items' END, CASE WHEN dated_share < 0.9 THEN 'undated items' END, CASE WHEN stale_days IS NULL THEN 'no dates' WHEN stale_days > 90 THEN 'stale' END, CASE WHEN odd THEN 'other titles' WHEN title_length < 15 THEN 'short titles' END, CASE WHEN checked = 0 THEN 'no links checked' WHEN ok < 2 THEN 'dead links' END) AS reasons FROM b)
  SELECT member_id, feed_id, n_items, dated_share, span_days, stale_days, mean_body, mean_body >= 200 AS full_bodies, reasons = '' AS eligible, reasons FROM r""",
)
add(
    "f39_feed_summary",
    lambda t: feeds.feed_summary(t.members, sites.best_feeds(_feed_items(t).where("member_id % 3 > 0"), AS_OF)),
    QUERIES["a05_best_feeds"][1].replace("FROM releases)", "FROM releases WHERE member_id % 3 > 0)").replace("SELECT member_id, feed_id, n_items, dated_share, span_days,", ", x AS (SELECT member_id, feed_id, n_items, dated_share, span_days,").replace("reasons FROM r", "reasons FROM r)")
    + " SELECT coalesce(collection_method, 'none') AS method, x.member_id IS NOT NULL AS has_feed, coalesce(eligible, false) AS eligible, count(*) AS n FROM members m LEFT JOIN x ON x.member_id = m.member_id WHERE m.status = 'active' GROUP BY ALL",
)
add(
    "a13_source_health",
    lambda t: recon.source_health(t.probes.select("member_id", F.col("probe_id").alias("ord"), "url_status", "items_found", F.when(F.col("url_status") != 200, F.concat(F.lit("probe "), F.col("probe_id").cast("string"))).alias("error"))),
    "SELECT member_id, max(url_status) AS url_status, sum(items_found) AS items_found, bool_and(items_found > 0) AS selector_ok, arg_min('probe ' || probe_id, probe_id) FILTER (url_status <> 200) AS error FROM probes GROUP BY member_id",
)
add(
    "d04_rank_all",
    lambda t: terms.rank_all(t, "the", "of", 25),
    f""", p AS (SELECT release_id, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM (SELECT release_id, {HAVE} AS ws FROM releases)),
  a AS (SELECT release_id, pos FROM p WHERE w = 'the'), b AS (SELECT release_id, pos FROM p WHERE w = 'of')
  SELECT a.release_id, count(DISTINCT a.pos) AS hits, round(1.0 - exp(coalesce(sum(ln(1.0 - 0.1 * sqrt(1.0 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2.0))))) FILTER (abs(a.pos - b.pos) <= 100), 0.0)), 6) AS score
  FROM a JOIN b ON a.release_id = b.release_id GROUP BY a.release_id ORDER BY score DESC, a.release_id LIMIT 25""",
)
add("d05_headlines", lambda t: terms.headlines(t, ["thble", "thtion"]))
# English stems and stop words: no SQL states them.
add("d01_english_postings", lambda t: fulltext.postings(t.releases).withColumn("positions", F.array_join("positions", ",")))
add("d02_english_search_all", lambda t: fulltext.search(fulltext.postings(t.releases), all_of=["thble", "thtion"]))
add("d03_english_search_web", lambda t: fulltext.search(fulltext.postings(t.releases), any_of=["thble", "thtion"], none_of=["ertion"]))
add("d04_english_rank", lambda t: fulltext.rank(fulltext.postings(t.releases), "thble", 25))
add("d08_english_term_counts", lambda t: fulltext.term_counts(fulltext.postings(t.releases)))
add(
    "f34_live_vs_corpus",
    lambda t: recon.live_vs_corpus(t, t.releases.where("release_id % 3 <> 0 or member_id % 2 = 0")),
    """, s AS (SELECT member_id, count(*) AS n, max(published_at) AS last FROM visible WHERE published_at >= TIMESTAMP '2025-01-01' GROUP BY 1),
  o AS (SELECT member_id, count(*) AS n, max(published_at) AS last FROM releases WHERE published_at >= TIMESTAMP '2025-01-01' AND (release_id % 3 <> 0 OR member_id % 2 = 0) GROUP BY 1),
  j AS (SELECT m.member_id, coalesce(s.n, 0) AS stored, coalesce(o.n, 0) AS live, date_diff('day', CAST(s.last AS DATE), CAST(o.last AS DATE)) AS lag FROM members m LEFT JOIN s ON s.member_id = m.member_id LEFT JOIN o ON o.member_id = m.member_id WHERE m.status = 'active')
  SELECT member_id, stored, live, live - stored AS delta, CASE WHEN abs(live - stored) <= 1 THEN 'OK' WHEN live - stored > 1 THEN 'LOW' ELSE 'HIGH' END AS verdict,
    array_to_string(list_filter([CASE WHEN live = 0 THEN '0-items' END, CASE WHEN lag > 14 THEN 'lag>' || lag || 'd' END, CASE WHEN stored = 0 THEN 'db=0' END, CASE WHEN live > 0 AND stored > 0 AND stored < 0.5 * live THEN 'undercollect' END], lambda x: x IS NOT NULL), ',') AS flags FROM j""",
)
add(
    "f37_section_recency",
    lambda t: recon.section_recency(t.releases.select(F.col("content_type").alias("section"), F.concat_ws(" ", F.date_format("published_at", "M/d/yyyy"), F.date_format("scraped_at", "yyyy-MM-dd"), F.lit("2/30/2025")).alias("text")), "2025-07-01"),
    """, d AS (SELECT content_type AS section, unnest(list_distinct(list_filter([CAST(published_at AS DATE), CAST(scraped_at AS DATE)], lambda x: x IS NOT NULL))) AS day FROM releases)
  SELECT section, count(*) AS n_dates, count(*) FILTER (day >= DATE '2025-07-01') AS in_window, max(day) AS latest FROM d GROUP BY section""",
)
add(
    "f38_stream_findings",
    lambda t: recon.stream_findings(html.links(t.pages).select("page_id", F.element_at(N.strings(["Op-Eds", "Blog", "Letters", "Videos", "About", "Floor Speeches"]), (F.length("label") % 6 + 1).cast("int")).alias("label")), t.pages.where("page_id % 3 = 0").select("page_id")),
    """, k AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS label FROM pages), c AS (SELECT page_id, list_extract(['op_ed', 'blog', 'letter', 'video', NULL, 'floor_statement'], length(label) % 6 + 1) AS category FROM k)
  SELECT category, count(*) AS n, count(DISTINCT page_id) AS n_pages, count(DISTINCT page_id) FILTER (page_id % 3 <> 0) AS n_new FROM c WHERE category IS NOT NULL GROUP BY category""",
)
add(
    "f31_probe_phases",
    recon.probe_phases,
    """, p AS (SELECT member_id, arg_max(url_status, checked_at * 1) AS s FROM (SELECT member_id, url_status, row_number() OVER (PARTITION BY member_id ORDER BY checked_at, probe_id) AS checked_at FROM probes) GROUP BY 1),
  i AS (SELECT member_id, arg_max(items_found, k) AS items FROM (SELECT member_id, items_found, row_number() OVER (PARTITION BY member_id ORDER BY checked_at, probe_id) AS k FROM probes) GROUP BY 1),
  f AS (SELECT CASE WHEN collection_method = 'rss' THEN 1 WHEN s = 200 AND items > 0 THEN 2 WHEN s = 200 THEN 3 ELSE 4 END AS phase FROM members m LEFT JOIN p ON p.member_id = m.member_id LEFT JOIN i ON i.member_id = m.member_id WHERE status = 'active')
  SELECT phase, list_extract(['feed', 'items', 'page', 'none'], phase) AS option, count(*) AS n_new, CAST(sum(count(*)) OVER (ORDER BY phase) AS BIGINT) AS reached FROM f GROUP BY phase""",
)
add(
    "q10_q12_url_checks",
    lambda t: recon.url_checks_report(t.pages, [".example.com", ".example.net"]),
    r""", h AS (SELECT url, lower(regexp_extract(url, '^[^:/]+://([^/?#]*)', 1)) AS host FROM pages), o AS (
  SELECT 'q10_foreign_host' AS check_id, count(*) FILTER (NOT (ends_with(host, '.example.com') OR ends_with(host, '.example.net'))) AS observed FROM h UNION ALL SELECT 'q11_listing', count(*) FILTER (regexp_matches(url, '/(press-releases|news-releases|newsroom|news)/?$')) FROM h
  UNION ALL SELECT 'q12_navigation', count(*) FILTER (regexp_matches(url, '/(about|contact|services|issues)/?([?].*)?$') OR contains(url, 'facebook.com') OR contains(url, 'twitter.com') OR contains(url, 'bsky.app')) FROM h) SELECT *, observed = 0 AS passed FROM o""",
)
add(
    "q01_q03_roster",
    recon.roster_checks,
    """, j AS (SELECT m.*, v.n FROM members m LEFT JOIN (SELECT member_id, count(*) AS n FROM visible GROUP BY 1) v ON v.member_id = m.member_id)
  SELECT 'q01_members' AS check_id, count(*) AS observed, count(*) >= 100 AS passed FROM j UNION ALL SELECT 'q02_no_method', count(*) FILTER (collection_method IS NULL), count(*) FILTER (collection_method IS NULL) = 0 FROM j UNION ALL SELECT 'q03_publishing', count(n), count(n) >= 95 FROM j""",
)


def _rosters(t: Tables) -> DataFrame:
    """A JSON file for each state; members whose id is even name their chamber themselves."""
    m = F.struct(F.col("member_id").cast("string").alias("id"), "full_name", F.when(F.col("member_id") % 2 == 0, F.col("chamber")).alias("chamber"), "party", F.create_map(F.lit("title"), F.lit("h2"), F.lit("date"), F.lit("time")).alias("selectors"))
    return t.members.groupBy("state", F.floor(F.col("member_id") / 1000)).agg(F.to_json(F.struct(F.collect_list(m).alias("members"))).alias("json")).select("json", F.lit("executive").alias("default_chamber"))


add(
    "a02_roster",
    lambda t: records.roster(_rosters(t), ["senate", "executive"]),
    "SELECT CAST(member_id AS VARCHAR) AS member_id, full_name, c AS chamber, party, 2 AS n_selectors FROM (SELECT *, CASE WHEN member_id % 2 = 0 THEN chamber ELSE 'executive' END AS c FROM members) WHERE c IN ('senate', 'executive')",
)


def _year_pages(t: Tables) -> DataFrame:
    """Listings of twenty releases each, with a heading before every fifth."""
    d = F.col("release_id")
    head = F.when(d % 5 == 0, F.concat(F.lit("<h3>"), (2020 + d % 7).cast("string"), F.lit(" releases</h3>"))).otherwise("")
    day = F.when(d % 3 == 0, F.date_format("scraped_at", "M/d/yyyy")).when(d % 3 == 1, "2/30/2025").otherwise("")
    href = F.when(d % 4 == 0, "/videoplayer.php?v=1").when(d % 4 == 1, "#top").otherwise(F.concat(F.lit("/press/"), d.cast("string"), F.lit(".pdf")))
    item = F.concat(head, F.lit("<p>"), day, F.lit(' <a href="'), href, F.lit('">Item '), d.cast("string"), F.lit("</a></p>"))
    items = t.releases.groupBy(F.floor(d / 20).alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(d.alias("d"), item.alias("i")))).alias("x"))
    return items.select("page_id", F.array_join(F.transform("x", lambda x: x["i"]), "\n").alias("html"))


add(
    "a10_year_listing",
    lambda t: records.year_listing(_year_pages(t)).drop("pos"),
    """, y AS (SELECT release_id // 20 AS page_id, release_id AS d, scraped_at, last_value(CASE WHEN release_id % 5 = 0 THEN 2020 + release_id % 7 END IGNORE NULLS) OVER (PARTITION BY release_id // 20 ORDER BY release_id) AS year FROM releases)
  SELECT page_id, CASE WHEN d % 4 = 0 THEN 'VIDEO: ' ELSE '' END || 'Item ' || d AS title, CASE WHEN d % 4 = 0 THEN '/videoplayer.php?v=1' ELSE '/press/' || d || '.pdf' END AS href,
    CASE WHEN d % 3 = 0 THEN CAST(scraped_at AS DATE) ELSE make_date(CAST(year AS BIGINT), 1, 1) END AS published, CASE WHEN d % 4 = 0 THEN 'other' ELSE 'press_release' END AS content_type FROM y WHERE d % 4 <> 1""",
)


def _posts(t: Tables) -> DataFrame:
    d, s = F.col("release_id"), F.col("release_id").cast("string")
    kind = F.element_at(N.strings(["app.embed.external", "app.embed.record", "app.embed.images", "app.embed.video"]), (d % 4 + 1).cast("int"))
    embed = F.struct(kind.alias("$type"), F.struct(F.concat(F.lit("https://x/"), s).alias("uri")).alias("external"), F.struct(F.concat(F.lit("at://q/"), s).alias("uri")).alias("record"), F.array(F.lit("a"), F.lit("b")).alias("images"))
    reply = F.when(d % 3 == 0, F.struct(F.struct(F.concat(F.lit("at://p/"), s).alias("uri")).alias("parent")))
    post = F.struct(F.concat(F.lit("at://"), s).alias("uri"), s.alias("cid"), F.struct(F.col("lang").alias("text"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"), reply.alias("reply")).alias("record"), F.when(d % 5 != 0, embed).alias("embed"))
    return t.releases.select(F.col("member_id").alias("account"), F.to_json(post).alias("post"))


add(
    "a12_social_posts",
    lambda t: records.social_posts(_posts(t), "2025-06-01").select("account", "uri", "cid", "text", F.to_date("created_at").alias("day"), "reply_parent", "embed"),
    """SELECT member_id AS account, 'at://' || release_id AS uri, CAST(release_id AS VARCHAR) AS cid, coalesce(lang, '') AS text, CAST(published_at AS DATE) AS day, CASE WHEN release_id % 3 = 0 THEN 'at://p/' || release_id END AS reply_parent,
  CASE WHEN release_id % 5 = 0 THEN NULL WHEN release_id % 4 = 0 THEN 'link:https://x/' || release_id WHEN release_id % 4 = 1 THEN 'quote:at://q/' || release_id WHEN release_id % 4 = 2 THEN 'images:2' ELSE 'app.embed.video' END AS embed FROM releases WHERE published_at >= TIMESTAMP '2025-06-01'""",
)
add("b26_page_bodies", lambda t: records.page_bodies(t.pages))


def _signed(t: Tables) -> DataFrame:
    """Releases with a contact below the text: one of four people, by turns with a title, an address and a number."""
    d = F.col("release_id")
    who = F.element_at(N.strings(["Ann Lee", "Bea Stone", "Cal Ford", "Press Office"]), (d % 4 + 1).cast("int"))
    line = F.concat(F.lit("\n\nContact: "), who, F.when(d % 3 == 0, ", Director").otherwise(""), F.lit("\n"), F.when(d % 5 == 0, "call (202) 555-0100 or p@x.example.org").otherwise(""))
    return t.releases.select("member_id", "release_id", F.concat(F.coalesce("body_text", F.lit("")), line).alias("body_text"))


add(
    "f33_ranked_contacts",
    lambda t: records.ranked_contacts(records.contacts(_signed(t))),
    rf""", x AS (SELECT member_id, release_id, list_extract(['Ann Lee', 'Bea Stone', 'Cal Ford'], release_id % 4 + 1) AS name, CASE WHEN release_id % 3 = 0 THEN 'Director' END AS title,
    right(coalesce(body_text, ''), 48) || ' : ' || CASE WHEN release_id % 5 = 0 THEN 'call (202) 555-0100 or p@x.example.org' ELSE '' END AS context FROM releases WHERE release_id % 4 < 3),
  c AS (SELECT member_id, release_id, name, title, nullif(regexp_extract(context, '{records.EMAIL}'), '') AS email, nullif(regexp_extract(context, '{records.PHONE}'), '') AS phone FROM x),
  p AS (SELECT member_id, name, count(*) AS mentions FROM c GROUP BY 1, 2), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member_id, name ORDER BY CASE WHEN title IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN email IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 1 ELSE 0 END DESC, release_id) AS rn FROM c) WHERE rn = 1)
  SELECT * FROM (SELECT p.member_id, row_number() OVER (PARTITION BY p.member_id ORDER BY mentions DESC, p.name) AS rank, p.name, mentions, title, email, phone FROM p JOIN b ON b.member_id = p.member_id AND b.name = p.name) WHERE rank <= 5""",
)


def _silos(t: Tables) -> DataFrame:
    per = t.releases.groupBy(F.col("member_id").alias("site"), "content_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("published_at") >= F.lit("2026-03-01").cast("timestamp_ntz")).alias("w"))
    section = F.concat(F.lit("/news/"), F.replace("content_type", F.lit("_"), F.lit("-")), F.lit("s/"))
    return per.select("site", section.alias("section"), "n", F.when(F.col("site") % 4 != 0, F.col("w")).alias("in_window"), N.slug_candidates(section).alias("slugs"))


add(
    "f30_silo_classes",
    lambda t: recon.silo_classes(_silos(t), _silos(t).where("site % 2 = 0").select("site", F.element_at("slugs", 1).alias("slug"), F.lit(50).alias("wp_total"), (F.col("site") % 9).alias("wp_in_window")), _silos(t).where("site % 10 = 0").select("site", F.element_at("slugs", 1).alias("slug")), 2),
    """, s AS (SELECT member_id AS site, content_type AS k, count(*) AS n, count(*) FILTER (published_at >= TIMESTAMP '2026-03-01') AS w FROM releases GROUP BY 1, 2),
  m AS (SELECT *, '/news/' || replace(k, '_', '-') || 's/' AS section, CASE WHEN site % 2 = 0 THEN replace(k, '_', '-') || 's' END AS slug FROM s)
  SELECT site, section, slug, CASE WHEN n < 2 THEN 'low_value' WHEN site % 2 = 0 AND site % 10 = 0 THEN 'wp_already_collected' WHEN site % 2 = 0 AND site % 9 < 5 THEN 'wp_pre_window_only' WHEN site % 2 = 0 THEN 'wp_extras_ready'
    WHEN site % 4 = 0 THEN 'needs_custom_scraper_unverified' WHEN w = 0 THEN 'section_dormant' ELSE 'needs_custom_scraper' END AS class FROM m""",
)


def _sections(t: Tables) -> DataFrame:
    """Addresses in sections of sections; every other section's have dates."""
    d = F.col("release_id")
    section = F.concat(F.lit("/news/"), F.col("content_type"), F.lit("-"), (d % 25).cast("string"), F.lit("/"))
    return t.releases.select(section.alias("section"), F.when(d % 2 == 0, F.date_format("published_at", "yyyy-MM-dd")).alias("lastmod"), F.concat(section, F.when(d % 3 == 0, "2025/").otherwise(""), d.cast("string")).alias("url"), (d % 25).alias("k"))


#: The sections that the SQL of f29_source_audit leaves out; f29_source_audit_all_rules has the whole list.
SQL_SKIPPED = r"/(20[0-9]{2}|about|contact|services|issues)/"
#: Sections of which the rules reject all but those at 0, 4, 8, 9 and 11.
SECTIONS = ["/newsroom/", "/News/Photos/", "/public/legislation/bills/", "/news/photo_release/", "/op-eds/", "/ES/noticias/", "/news/2023/", "/2025/03/", "/news/2025/", "/blog/", "/Category/press/", "/letters/"]


def _all_sections(t: Tables) -> DataFrame:
    d = F.col("release_id")
    section = F.element_at(N.strings(SECTIONS), (d % 12 + 1).cast("int"))
    return t.releases.select(section.alias("section"), F.when(d % 2 == 0, F.date_format("published_at", "yyyy-MM-dd")).alias("lastmod"), F.concat(section, d.cast("string")).alias("url"))


def _statuses(t: Tables) -> DataFrame:
    section = F.col("section")
    return _all_sections(t).where("section <> '/newsroom/'").select("section", F.when(section == "/op-eds/", 404).when(section == "/news/2025/", 403).otherwise(200).alias("status"))


add(
    "f29_source_audit_all_rules",
    lambda t: recon.source_audit(_all_sections(t), _all_sections(t).where("section = '/blog/'").select("section").distinct(), _statuses(t), 3, "2025-08-01"),
    f""", s AS (SELECT list_extract({SECTIONS}, CAST(release_id % 12 + 1 AS INT)) AS section, release_id % 12 AS i, CASE WHEN release_id % 2 = 0 THEN CAST(CAST(published_at AS DATE) AS VARCHAR) END AS lm, release_id FROM releases),
  g AS (SELECT section, i, count(*) AS n, bool_or(lm IS NOT NULL) AS dated, count(*) FILTER (CASE WHEN lm IS NOT NULL THEN lm >= '2025-08-01' ELSE regexp_matches(section || release_id, '/202[56]') END) AS in_window FROM s GROUP BY 1, 2 HAVING count(*) >= 3)
  SELECT section, n, in_window, CASE WHEN dated AND in_window = 0 THEN 'archival' WHEN i = 4 THEN 'dead' WHEN i IN (0, 8) THEN 'unknown' ELSE 'untapped' END AS class FROM g WHERE i IN (0, 4, 8, 11)""",
)
add(
    "f29_source_audit",
    lambda t: recon.source_audit(_sections(t), _sections(t).where("k % 6 = 0").select("section").distinct(), _sections(t).where("k % 5 <> 4").select("section", F.element_at(F.array(F.lit(200), F.lit(404), F.lit(403), F.lit(410)), (F.col("k") % 4 + 1).cast("int")).alias("status")), 3, "2025-08-01", SQL_SKIPPED),
    """, s AS (SELECT '/news/' || content_type || '-' || release_id % 25 || '/' AS section, release_id % 25 AS k, CASE WHEN release_id % 2 = 0 THEN CAST(CAST(published_at AS DATE) AS VARCHAR) END AS lm, regexp_matches(section || CASE WHEN release_id % 3 = 0 THEN '2025/' ELSE '' END || release_id, '/202[56]') AS u FROM releases),
  g AS (SELECT section, k, count(*) AS n, bool_or(lm IS NOT NULL) AS dated, count(*) FILTER (CASE WHEN lm IS NOT NULL THEN lm >= '2025-08-01' ELSE u END) AS in_window FROM s GROUP BY 1, 2 HAVING count(*) >= 3)
  SELECT section, n, in_window, CASE WHEN dated AND in_window = 0 THEN 'archival' WHEN k % 5 = 4 OR k % 4 = 2 THEN 'unknown' WHEN k % 4 IN (1, 3) THEN 'dead' ELSE 'untapped' END AS class FROM g WHERE k % 6 <> 0""",
)
add(
    "a11_listing_dates",
    lambda t: recon.listing_dates(t.releases.select(F.concat(F.lit("https://h.org/"), F.year("scraped_at").cast("string"), F.lit("/"), (F.col("release_id") % 300).cast("string"), F.lit("/")).alias("url"), F.col("release_id").alias("pos"), F.when(F.col("release_id") % 3 == 0, F.date_format("scraped_at", "M/d/yy")).when(F.col("release_id") % 3 == 1, F.date_format("scraped_at", "MMM d")).otherwise("2/30/2025").alias("text"))),
    """, x AS (SELECT 'https://h.org/' || year(scraped_at) || '/' || release_id % 300 AS url, release_id, CAST(scraped_at AS DATE) AS day FROM releases WHERE release_id % 3 < 2) SELECT url, arg_min(day, release_id) AS day FROM x GROUP BY url""",
)
