"""Queries about feeds, rosters, addresses, repairs, runs and dates, by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import feeds, ingest, lookups, recon, stats, terms
from ..sources.tables import AS_OF, Tables, days, ts

QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str]] = {}


def add(name: str, op: Callable[[Tables], DataFrame], sql: str = "") -> None:
    QUERIES[name] = (op, sql)


def listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


SECTION = r"regexp_replace(url, '^(https?://[^/]+/[^/]+(?:/[^/]+)?/).*$', '\1')"
LABEL = r"list_aggregate(list_transform(string_split(replace(split_part(regexp_replace(section, '/+$', ''), '/', -1), '-', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), 'string_agg', ' ')"
ACTIVE_VISIBLE = "visible v JOIN members m ON m.member_id = v.member_id AND m.status = 'active'"
HAVE = "list_transform(list_filter(string_split_regex(lower(concat_ws(' ', title, body_text)), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: regexp_replace(w, 's$', ''))"

# ---------------------------------------------------------------- feeds

add(
    "h01_feed_total",
    lambda t: feeds.feed_total(stats.feed(t, party="D")),
    f"SELECT count(*) AS total FROM {ACTIVE_VISIBLE} WHERE m.party = 'D'",
)
add(
    "h02_member_feed",
    lambda t: feeds.member_feed(t, 7).select("release_id", "content_type", F.to_date("effective_at").alias("day")).unionByName(feeds.member_feed(t, 31, "op_ed").select("release_id", "content_type", F.to_date("effective_at").alias("day"))),
    """SELECT release_id, content_type, CAST(least(published_at, scraped_at) AS DATE) AS day FROM releases WHERE deleted_at IS NULL AND ((member_id = 7 AND content_type <> 'photo_release') OR (member_id = 31 AND content_type = 'op_ed'))""",
)
add(
    "h03_latest",
    lambda t: feeds.latest(t, "senate", 6, "press_release").select("release_id", "member_id"),
    f"SELECT release_id, v.member_id FROM {ACTIVE_VISIBLE} WHERE m.chamber = 'senate' AND v.content_type = 'press_release' ORDER BY least(published_at, scraped_at) DESC NULLS LAST, release_id LIMIT 6",
)
add(
    "h07_member_lookup",
    feeds.member_lookup,
    "SELECT m.member_id, full_name, party, state, chamber, status, count(v.release_id) AS n_releases, CAST(min(published_at) AS DATE) AS first_day, CAST(max(published_at) AS DATE) AS last_day FROM members m LEFT JOIN visible v ON v.member_id = m.member_id GROUP BY ALL",
)
add(
    "e17_release_versions",
    feeds.release_versions,
    "SELECT release_id, CAST(row_number() OVER (PARTITION BY release_id ORDER BY captured_at DESC, version_id DESC) AS INT) AS rank, version_id, captured_at FROM versions",
)
add(
    "h09_directory_orders",
    feeds.directory_orders,
    """SELECT member_id, CAST(row_number() OVER (ORDER BY n DESC, full_name, member_id) AS INT) AS by_count, CAST(row_number() OVER (ORDER BY state, full_name, member_id) AS INT) AS by_state,
  CAST(row_number() OVER (ORDER BY full_name, member_id) AS INT) AS by_name, CAST(row_number() OVER (ORDER BY CASE party WHEN 'D' THEN 0 WHEN 'I' THEN 1 WHEN 'R' THEN 2 ELSE 9 END, n DESC, full_name, member_id) AS INT) AS by_party
  FROM (SELECT m.member_id, m.full_name, m.state, m.party, count(v.release_id) AS n FROM members m LEFT JOIN visible v ON v.member_id = m.member_id WHERE m.status = 'active' GROUP BY ALL)""",
)
add(
    "g10_rank_display",
    lambda t: feeds.rank_display(stats.ranked_members(t, "2025-06-01 00:00:00", 15), "n", "member_id"),
    f"""SELECT member_id, n, CAST(row_number() OVER (ORDER BY n DESC, member_id) AS INT) AS place, CASE WHEN max(n) OVER () > 0 THEN round(greatest(2.0, 100.0 * n / max(n) OVER ()), 6) ELSE 0.0 END AS bar
  FROM (SELECT v.member_id, count(*) AS n FROM {ACTIVE_VISIBLE} WHERE published_at >= TIMESTAMP '2025-06-01' GROUP BY v.member_id ORDER BY n DESC, v.member_id LIMIT 15)""",
)
RANGES = ["week", "month", "year", "ytd", "all"]
add(
    "f03_members_by_range",
    lambda t: feeds.members_by_range(t, RANGES, 10),
    """, s AS (SELECT * FROM (VALUES ('week', TIMESTAMP '2026-04-19'), ('month', TIMESTAMP '2026-03-27'), ('year', TIMESTAMP '2025-04-26'), ('ytd', TIMESTAMP '2026-01-01'), ('all', NULL)) AS x(range, since)),
c AS (SELECT s.range, m.member_id, m.collection_method, count(v.release_id) AS n FROM members m CROSS JOIN s LEFT JOIN visible v ON v.member_id = m.member_id AND (s.since IS NULL OR v.published_at >= s.since) WHERE m.status = 'active' GROUP BY ALL),
r AS (SELECT range, 'top' AS side, row_number() OVER (PARTITION BY range ORDER BY n DESC, member_id) AS rank, member_id, n FROM c WHERE n > 0
  UNION ALL SELECT range, 'bottom', row_number() OVER (PARTITION BY range ORDER BY n, member_id), member_id, n FROM c WHERE collection_method IS NOT NULL)
SELECT range, side, CAST(rank AS INT) AS rank, member_id, n FROM r WHERE rank <= 10""",
)
add(
    "d07_facets_simple",
    lambda t: feeds.facets_simple(t, "thble", "senate"),
    f""", h AS (SELECT m.party, v.content_type FROM {ACTIVE_VISIBLE} WHERE m.chamber = 'senate' AND list_contains({HAVE}, 'thble'))
SELECT 'party' AS facet, party AS key, count(*) AS n FROM h GROUP BY party UNION ALL SELECT 'type', content_type, count(*) FROM h GROUP BY content_type""",
)
WORD_ROWS = "SELECT release_id, published_at, unnest(list_distinct(list_transform(string_split(lower(regexp_replace(coalesce(title, ''), '[^a-zA-Z ]', '', 'g')), ' '), lambda w: regexp_replace(w, 's$', '')))) AS word FROM visible"
for prior_name, prior, prior_end in (("k02_trending_ytd", "same_calendar", "2025-04-27"), ("k02_trending_ytd_as_written", "as_written", "2025-09-09")):
    add(
        prior_name,
        lambda t, prior=prior: terms.trending(t, "ytd", prior=prior),
        f""", w AS ({WORD_ROWS}), c AS (SELECT word, count(*) FILTER (published_at >= TIMESTAMP '2026-01-01') AS recent_count, count(*) FILTER (published_at >= TIMESTAMP '2025-01-01' AND published_at < TIMESTAMP '{prior_end}') AS prior_count
  FROM w WHERE length(word) > 4 AND word NOT IN ({listed(terms.TREND_STOP)}) GROUP BY word)
SELECT word, recent_count, prior_count, recent_count - prior_count AS delta FROM c WHERE recent_count >= 5 ORDER BY recent_count DESC, word LIMIT 30""",
    )
add(
    "f01_type_map",
    lambda t: stats.type_map(t).select("member_id", F.array_join(F.transform(F.array_sort(F.map_entries("type_counts")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("type_counts")),
    "SELECT member_id, string_agg(content_type || ':' || n, ',' ORDER BY content_type) AS type_counts FROM (SELECT member_id, content_type, count(*) AS n FROM visible GROUP BY ALL) GROUP BY member_id",
)

# ---------------------------------------------------------------- rosters and overlays

IDS = "SELECT member_id, CASE WHEN member_id % 4 = 0 THEN NULL ELSE '{\"district\": ' || (member_id % 29 + 1) || '}' END AS config, CASE WHEN member_id % 8 = 0 THEN 'tx-d' || lpad(CAST(member_id % 31 + 1 AS VARCHAR), 2, '0') || '-x' ELSE 'm' || member_id END AS handle FROM members WHERE chamber = 'tx_senate' AND member_id < 150"


def _roster(t: Tables) -> DataFrame:
    """The state's members, a quarter of them without a configuration, half of those with a telling handle."""
    i = F.col("member_id")
    return t.members.where("chamber = 'tx_senate' and member_id < 150").select(
        "member_id", F.when(i % 4 != 0, F.concat(F.lit('{"district": '), (i % 29 + 1).cast("string"), F.lit("}"))).alias("config"), F.when(i % 8 == 0, F.concat(F.lit("tx-d"), F.lpad((i % 31 + 1).cast("string"), 2, "0"), F.lit("-x"))).otherwise(F.concat(F.lit("m"), i.cast("string"))).alias("handle")
    )


ROSTER_SQL = f", ids AS ({IDS}), roster AS (SELECT i.member_id, coalesce(TRY_CAST(json_extract_string(config, '$.district') AS INT), TRY_CAST(nullif(regexp_extract(handle, '^tx-d([0-9]{{2}})-', 1), '') AS INT), 0) AS district, count(v.release_id) AS n_releases FROM ids i LEFT JOIN visible v ON v.member_id = i.member_id GROUP BY ALL)"
add("f14_roster_with_counts", lambda t: feeds.roster_with_counts(t, _roster(t)), f"{ROSTER_SQL} SELECT * FROM roster")
for order, by in (("district", ""), ("count", "n_releases DESC, "), ("name", "full_name, "), ("party", "CASE party WHEN 'D' THEN 0 WHEN 'R' THEN 1 WHEN 'I' THEN 2 ELSE 9 END, ")):
    add(
        f"h09_roster_by_{order}",
        lambda t, order=order: feeds.roster_page(t, feeds.roster_with_counts(t, _roster(t)), order),
        f"{ROSTER_SQL} SELECT CAST(row_number() OVER (ORDER BY {by}district, r.member_id) AS INT) AS place, r.member_id, district, n_releases FROM roster r JOIN members m ON m.member_id = r.member_id ORDER BY place LIMIT 50",
    )
add(
    "f14_vacant_seats",
    lambda t: feeds.vacant_seats(feeds.roster_with_counts(t, _roster(t)).where("district % 5 <> 2")),
    f"{ROSTER_SQL} SELECT CAST(d AS INT) AS district FROM range(1, 32) AS x(d) WHERE d NOT IN (SELECT district FROM roster WHERE district % 5 <> 2)",
)


def _seeds(t: Tables) -> DataFrame:
    i = F.col("member_id")
    return t.members.where(i % 3 == 0).select("member_id", F.when(i % 2 == 0, "").otherwise(F.concat(F.lit("Seed "), i.cast("string"))).alias("full_name"), F.when(i % 5 == 0, "seeded").alias("collection_method"))


add(
    "e12_seed_overlay",
    lambda t: feeds.seed_overlay(t.members, _seeds(t), ["full_name", "collection_method"]).select("member_id", "full_name", "collection_method", "state"),
    """SELECT member_id, CASE WHEN member_id % 3 = 0 AND member_id % 2 <> 0 THEN 'Seed ' || member_id ELSE full_name END AS full_name, CASE WHEN member_id % 15 = 0 THEN 'seeded' ELSE collection_method END AS collection_method, state FROM members""",
)


def _static_states(t: Tables) -> DataFrame:
    """A static row for each state, and for one that has no members."""
    return t.members.select("state").distinct().unionByName(t.members.select(F.lit("ATLANTIS").alias("state")).distinct()).select("state", F.lit(31).cast("long").alias("n_members"), F.lit(314).cast("long").alias("n_releases"))


add(
    "f13_state_coverage_overlay",
    lambda t: feeds.state_coverage_overlay(t, _static_states(t)),
    """, live AS (SELECT m.state, count(DISTINCT m.member_id) AS a, count(v.release_id) AS b FROM members m LEFT JOIN visible v ON v.member_id = m.member_id WHERE m.status = 'active' GROUP BY m.state),
s AS (SELECT DISTINCT state FROM members UNION ALL SELECT 'ATLANTIS')
SELECT s.state, coalesce(a, 31) AS n_members, coalesce(b, 314) AS n_releases FROM s LEFT JOIN live ON live.state = s.state""",
)
add(
    "f08_monthly_sessions",
    feeds.monthly_volume,
    "SELECT month, n, CASE WHEN month <= DATE '2025-06-02' AND last_day(month) >= DATE '2025-01-14' THEN '89th regular session' END AS session FROM (SELECT CAST(date_trunc('month', published_at) AS DATE) AS month, count(*) AS n FROM visible WHERE published_at IS NOT NULL GROUP BY 1)",
)

# ---------------------------------------------------------------- addresses

# Addresses of several sorts, derived from the pages: government and other hosts, listings, anchors, social networks, years.
URL_SQL = """, urls AS (SELECT page_id, page_id % 150 AS member_id, page_id % 13 = 0 AS is_deleted, CASE page_id % 9 WHEN 0 THEN 'https://www.senate.gov/press-releases/' WHEN 1 THEN 'https://Stone.House.gov/news/press-releases#a' || page_id
  WHEN 2 THEN 'https://bsky.app/profile/' || page_id WHEN 3 THEN 'https://www.senate.gov/newsroom/press/2026/0' || (page_id % 8 + 1) || '/item-' || page_id WHEN 4 THEN 'https://www.senate.gov/public/index.cfm/2019/03/' || page_id
  WHEN 5 THEN 'https://senate.gov.bsky.app/x/' || page_id WHEN 6 THEN 'https://king.senate.gov/newsroom/op-ed/' || page_id WHEN 7 THEN '' ELSE url END AS url,
  CASE WHEN page_id % 5 = 0 THEN NULL ELSE DATE '2024-06-01' + CAST(page_id % 700 AS INT) END AS lastmod FROM pages)"""


def _urls(t: Tables) -> DataFrame:
    i, text = F.col("page_id"), F.col("page_id").cast("string")
    k = i % 9
    url = (
        F.when(k == 0, "https://www.senate.gov/press-releases/")
        .when(k == 1, F.concat(F.lit("https://Stone.House.gov/news/press-releases#a"), text))
        .when(k == 2, F.concat(F.lit("https://bsky.app/profile/"), text))
        .when(k == 3, F.concat(F.lit("https://www.senate.gov/newsroom/press/2026/0"), (i % 8 + 1).cast("string"), F.lit("/item-"), text))
        .when(k == 4, F.concat(F.lit("https://www.senate.gov/public/index.cfm/2019/03/"), text))
        .when(k == 5, F.concat(F.lit("https://senate.gov.bsky.app/x/"), text))
        .when(k == 6, F.concat(F.lit("https://king.senate.gov/newsroom/op-ed/"), text))
        .when(k == 7, "")
        .otherwise(F.col("url"))
    )
    day = F.when(i % 5 != 0, F.date_add(F.lit("2024-06-01").cast("date"), (i % 700).cast("int")))
    return t.pages.select("page_id", (i % 150).alias("member_id"), (i % 13 == 0).alias("is_deleted"), url.alias("url"), day.alias("lastmod"))


add(
    "b07_is_external",
    lambda t: _urls(t).select("page_id", feeds.is_external(F.col("url")).alias("external")),
    f"{URL_SQL} SELECT page_id, url <> '' AND NOT (lower(url) LIKE '%senate.gov%' OR lower(url) LIKE '%house.gov%' OR lower(url) LIKE '%whitehouse.gov%') AS external FROM urls",
)
add(
    "b09_bad_url_reason",
    lambda t: _urls(t).select("page_id", feeds.bad_url_reason(F.col("url")).alias("reason")),
    f"""{URL_SQL} SELECT page_id, CASE WHEN NOT (host LIKE '%senate.gov%' OR host LIKE '%house.gov%') THEN 'non-government domain: ' || host WHEN host LIKE '%bsky.app%' OR host LIKE '%twitter.com%' OR host LIKE '%facebook.com%' THEN 'social media: ' || host
  WHEN regexp_matches(url, '/press-releases/?$') THEN 'listing page URL, not a detail page' WHEN regexp_matches(url, '#.') AND regexp_matches(split_part(url, '#', 1), '/press-releases/?$') THEN 'listing page with anchor' END AS reason
  FROM (SELECT *, lower(regexp_extract(url, '^[^:/]+://([^/?#]*)', 1)) AS host FROM urls)""",
)
WINDOW_SQL = "CASE WHEN regexp_matches(url, '/202[56]/') THEN 'in' WHEN regexp_matches(url, '/20(0[0-9]|1[0-9]|2[0-4])/') THEN 'pre' WHEN lastmod IS NULL THEN 'undated' WHEN lastmod >= DATE '2025-01-01' THEN 'in' ELSE 'pre' END"
add("b20_url_window", lambda t: _urls(t).select("page_id", feeds.url_window(F.col("url"), F.col("lastmod")).alias("span")), f"{URL_SQL} SELECT page_id, {WINDOW_SQL} AS span FROM urls")
add(
    "b20_url_window_of_2023",
    lambda t: _urls(t).select("page_id", feeds.url_window(F.concat("url", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/"), (F.col("page_id") % 8 + 2019).cast("string"), F.lit("/x"))).otherwise("")), F.col("lastmod"), "2023-06-01", "2024-12-31").alias("span")),
    f"""{URL_SQL} SELECT page_id, CASE WHEN regexp_matches(u, '/202[34]/') THEN 'in' WHEN regexp_matches(u, '/20([01][0-9]|2[0-2])/') THEN 'pre' WHEN lastmod IS NULL THEN 'undated' WHEN lastmod >= DATE '2023-06-01' THEN 'in' ELSE 'pre' END AS span
  FROM (SELECT *, url || CASE WHEN page_id % 3 = 0 THEN '/' || (page_id % 8 + 2019) || '/x' ELSE '' END AS u FROM urls)""",
)
add(
    "b19_skip_sections",
    lambda t: _urls(t).select("page_id", F.lower(F.regexp_extract("url", r"^[^:/]+://[^/?#]*([^?#]*)", 1)).rlike(recon.SKIPPED).alias("skipped")),
    f"{URL_SQL} SELECT page_id, len(list_filter([{listed(recon.SKIP_SECTIONS)}], lambda piece: contains(path, piece))) > 0 OR regexp_matches(path, '^/(19|20)[0-9]{{2}}(/[0-9]{{1,2}})?/*$') AS skipped FROM (SELECT page_id, lower(regexp_extract(url, '^[^:/]+://[^/?#]*([^?#]*)', 1)) AS path FROM urls)",
)
add("b18_all_section_labels", lambda t: _urls(t).groupBy(C.section_label(C.section_of_url(F.col("url"))).alias("label")).agg(stats.n().alias("n")), f"{URL_SQL} SELECT {LABEL} AS label, count(*) AS n FROM (SELECT {SECTION} AS section FROM urls) GROUP BY 1")
add(
    "f05_member_sections",
    lambda t: feeds.member_sections(_urls(t).select((F.col("member_id") % 6).alias("member_id"), "url")),
    f"""{URL_SQL}, c AS (SELECT member_id % 6 AS member_id, {SECTION} AS section, count(*) AS n FROM urls GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY n DESC, section) AS rank FROM c WHERE n >= 5 AND regexp_matches(section, '{feeds.SECTION_WORDS}'))
SELECT member_id, CAST(rank AS INT) AS rank, section, {LABEL} AS label, n FROM r WHERE rank <= 6""",
)
PATTERNS = ["/news/press-releases", "/public/index.cfm", "king.senate.gov/newsroom"]
add(
    "f27_url_pattern_audit",
    lambda t: feeds.url_pattern_audit(_urls(t), PATTERNS),
    rf"""{URL_SQL}, e AS (SELECT is_deleted, 'pattern' AS kind, CASE {' '.join(f"WHEN url LIKE '%{p}%' THEN '{p}'" for p in PATTERNS)} ELSE 'other' END AS pattern FROM urls
  UNION ALL SELECT is_deleted, 'host', regexp_replace(url, '^https?://([^/]+).*$', '\1') FROM urls UNION ALL SELECT is_deleted, 'root', regexp_replace(url, '^https?://([^/]+)(/[^/]+/?[^/]*).*$', '\1\2') FROM urls)
SELECT kind, pattern, is_deleted, count(*) AS n FROM e GROUP BY ALL""",
)
add(
    "f28_sitemap_sections",
    lambda t: feeds.sitemap_sections(_urls(t).where("url <> ''")).select("section", "label", "n", "in_window", "pre_window", "undated", "sample"),
    f"""{URL_SQL}, s AS (SELECT {SECTION} AS section, url, {WINDOW_SQL} AS w FROM urls WHERE url <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY url) AS rn FROM s)
SELECT section, {LABEL} AS label, count(*) AS n, count(*) FILTER (w = 'in') AS in_window, count(*) FILTER (w = 'pre') AS pre_window, count(*) FILTER (w = 'undated') AS undated, string_agg(url, ' ' ORDER BY url) FILTER (rn <= 3) AS sample
FROM k GROUP BY section HAVING count(*) >= 3""",
)

# ---------------------------------------------------------------- repairs, runs, alerts, edits

def _dated_releases(t: Tables) -> DataFrame:
    """The releases with an address, a date's source and confidence, and shortened bodies, by their ids."""
    i = F.col("release_id")
    url = F.concat(F.lit("https://x.example.org/"), i.cast("string"), F.when(i % 4 == 0, ".PDF").when(i % 4 == 1, "/press.php?id=1").otherwise(""))
    body = F.when(i % 10 != 3, F.substring(F.col("body_text"), F.lit(1), (40 + i % 5 * 5000).cast("int")))
    source = F.when(i % 6 == 0, None).when(i % 6 == 1, "url_path").when(i % 6 == 2, "meta_tag").otherwise("page_text")
    return t.releases.withColumns({"url": url, "body_text": body, "date_source": source, "confidence": F.when(i % 6 == 3, 0.5).when(i % 6 == 4, None).otherwise(0.95)})


add(
    "c05_repair_kinds",
    lambda t: feeds.repair_kinds(_dated_releases(t), t.members),
    """, d AS (SELECT *, 'https://x.example.org/' || release_id || CASE WHEN release_id % 4 = 0 THEN '.PDF' WHEN release_id % 4 = 1 THEN '/press.php?id=1' ELSE '' END AS url, CASE WHEN release_id % 10 = 3 THEN NULL ELSE left(body_text, 40 + CAST(release_id % 5 AS INT) * 5000) END AS body,
    CASE release_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'url_path' WHEN 2 THEN 'meta_tag' ELSE 'page_text' END AS date_source, CASE WHEN release_id % 6 = 3 THEN 0.5 WHEN release_id % 6 = 4 THEN NULL ELSE 0.95 END AS confidence FROM releases WHERE deleted_at IS NULL)
  SELECT 'null_date' AS kind, release_id, member_id FROM d WHERE published_at IS NULL UNION ALL SELECT 'no_body', release_id, member_id FROM d WHERE body IS NULL OR length(body) < 50
  UNION ALL SELECT 'weak_date', release_id, member_id FROM d WHERE published_at >= TIMESTAMP '2025-01-01' AND (date_source IS NULL OR date_source = 'url_path' OR confidence < 0.9)
  UNION ALL SELECT 'document_body', release_id, d.member_id FROM d JOIN members m ON m.member_id = d.member_id AND m.chamber = 'tx_senate' WHERE content_type = 'press_release' AND (lower(url) LIKE '%.pdf' OR url LIKE '%press.php%') AND (body IS NULL OR length(body) < 50)""",
)
add(
    "q_offenders",
    feeds.offenders,
    """, o AS (SELECT count(*) FILTER (coalesce(length(trim(title)), 0) < 5) AS q05_short_titles, count(*) FILTER (published_at IS NULL) AS q07_undated, count(*) FILTER (published_at < TIMESTAMP '2010-01-01' OR published_at > TIMESTAMP '2026-06-25') AS q08_dates_out_of_range,
    count(*) FILTER (published_at > TIMESTAMP '2026-04-27' AND published_at <= TIMESTAMP '2026-06-25') AS q09_future_dates, count(*) FILTER (coalesce(length(body_text), 0) <= 100) AS q21_no_body,
    (SELECT count(*) FROM members WHERE status = 'active' AND member_id NOT IN (SELECT member_id FROM releases WHERE deleted_at IS NULL)) AS q03_silent_members FROM releases WHERE deleted_at IS NULL)
  SELECT check_id, n_offenders FROM (UNPIVOT o ON COLUMNS(*) INTO NAME check_id VALUE n_offenders)""",
)
add(
    "c05_repair_candidates",
    feeds.repair_candidates,
    "SELECT 'null_date' AS kind, release_id, member_id FROM releases WHERE deleted_at IS NULL AND published_at IS NULL UNION ALL SELECT 'no_body', release_id, member_id FROM releases WHERE deleted_at IS NULL AND coalesce(length(body_text), 0) < 50",
)


def _sources(t: Tables) -> DataFrame:
    i = F.col("member_id") % 6
    selectors = F.when(i == 0, '{"list_item": "li.item", "title": "h2"}').when(i == 1, '{"list_item": "li.page-item", "title": "h2"}').when(i == 2, '{"list_item": "li.item"}').when(i == 3, '{"list_item": "", "title": "h2"}').when(i == 4, "{}")
    return t.members.select(F.col("member_id").alias("source_id"), "collection_method", selectors.alias("selectors"))


add("c06_source_candidates", lambda t: feeds.source_candidates(_sources(t)), "SELECT member_id AS source_id FROM members WHERE collection_method = 'httpx' AND member_id % 6 <> 0")


def _outcomes(t: Tables) -> DataFrame:
    """Outcomes of ingest runs, derived from the activity: a run a day."""
    i = F.col("release_id")
    outcome = F.when(i % 7 == 0, "inserted").when(i % 11 == 0, "updated").when(i % 13 == 0, "error").otherwise("skipped")
    return t.activity.select(F.to_date("published_at").alias("run_id"), "member_id", outcome.alias("outcome"))


add(
    "f36_run_stats",
    lambda t: feeds.run_stats(_outcomes(t)),
    """, o AS (SELECT CAST(published_at AS DATE) AS run_id, member_id, CASE WHEN release_id % 7 = 0 THEN 'inserted' WHEN release_id % 11 = 0 THEN 'updated' WHEN release_id % 13 = 0 THEN 'error' ELSE 'skipped' END AS outcome FROM activity)
SELECT run_id, count(*) FILTER (outcome = 'inserted') AS total_inserted, count(*) FILTER (outcome = 'updated') AS total_updated, count(*) FILTER (outcome = 'skipped') AS total_skipped, count(*) FILTER (outcome = 'error') AS total_error,
  count(DISTINCT member_id) AS members, count(DISTINCT member_id) FILTER (outcome = 'inserted') AS members_with_new, count(DISTINCT member_id) FILTER (outcome = 'updated') AS members_with_updates FROM o GROUP BY run_id""",
)
add(
    "h08_alerts_open",
    lambda t: feeds.alerts_open(t.probes.where("url_status = 500").select(F.col("probe_id").alias("alert_id"), F.col("checked_at").alias("created_at"), "member_id", (F.col("probe_id") % 3 == 0).alias("acknowledged"))).select("alert_id", "member_id"),
    "SELECT probe_id AS alert_id, member_id FROM probes WHERE url_status = 500 AND probe_id % 3 <> 0 ORDER BY checked_at DESC, probe_id DESC LIMIT 50",
)
add(
    "f26_edit_totals",
    feeds.edit_totals,
    """SELECT a.total_releases, a.tombstones, b.total_versions, b.releases_with_versions, round(100.0 * b.releases_with_versions / a.total_releases, 4) AS edit_rate FROM (SELECT count(*) FILTER (deleted_at IS NULL) AS total_releases, count(deleted_at) AS tombstones FROM releases) a,
  (SELECT count(*) AS total_versions, count(DISTINCT release_id) AS releases_with_versions FROM versions) b""",
)
add("f26_most_edited", lambda t: feeds.most_edited(t).select("release_id", "member_id", "n_versions"), "SELECT v.release_id, r.member_id, count(*) AS n_versions FROM versions v JOIN releases r ON r.release_id = v.release_id GROUP BY v.release_id, r.member_id ORDER BY n_versions DESC, max(captured_at) DESC, v.release_id LIMIT 10")
add("f26_edits_by_month", feeds.edits_by_month, "SELECT CAST(date_trunc('month', captured_at) AS DATE) AS month, count(*) AS edits, count(DISTINCT release_id) AS releases_edited FROM versions GROUP BY 1 ORDER BY 1 DESC LIMIT 12")

# ---------------------------------------------------------------- checks

BOUNDS = {"q03_members": ("least", 95), "q04_rows": ("least", 500), "q05_short_titles": ("most", 5), "q07_dated_share": ("least", 0.5), "q08_dates_out_of_range": ("most", 0), "q09_future_dates": ("most", 0), "q21_body_share": ("least", 0.7)}
add(
    "q_judged_report",
    lambda t: feeds.judged_checks(stats.quality_report(t), BOUNDS),
    f""", o AS (SELECT CAST(count(*) AS DOUBLE) AS q04_rows, CAST(count(*) FILTER (coalesce(length(trim(title)), 0) < 5) AS DOUBLE) AS q05_short_titles, round(count(published_at) / count(*), 6) AS q07_dated_share,
  CAST(count(*) FILTER (published_at < TIMESTAMP '2010-01-01' OR published_at > TIMESTAMP '2026-06-25') AS DOUBLE) AS q08_dates_out_of_range, CAST(count(*) FILTER (published_at > TIMESTAMP '2026-04-27' AND published_at <= TIMESTAMP '2026-06-25') AS DOUBLE) AS q09_future_dates,
  round(count(*) FILTER (length(body_text) > 100) / count(*), 6) AS q21_body_share, CAST(count(DISTINCT member_id) AS DOUBLE) AS q03_members FROM releases WHERE deleted_at IS NULL),
u AS (UNPIVOT o ON COLUMNS(*) INTO NAME check_id VALUE observed), b AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{side}', CAST({v} AS DOUBLE))" for k, (side, v) in BOUNDS.items())}) AS x(check_id, side, threshold))
SELECT u.check_id, observed, threshold, CASE WHEN side = 'least' THEN observed >= threshold ELSE observed <= threshold END AS passed FROM u JOIN b ON b.check_id = u.check_id""",
)
add(
    "q02_missing_urls",
    lambda t: feeds.missing_urls(t.members.select("full_name", F.when(F.col("member_id") % 40 != 0, "https://x").alias("url")), ["Customer#000000040", "Customer#000000080"]),
    "SELECT full_name FROM members WHERE member_id % 40 = 0 AND full_name NOT IN ('Customer#000000040', 'Customer#000000080')",
)
add(
    "c08_since_moment",
    lambda t: feeds.since_moment(t.activity.withColumn("published_at", F.when(F.col("release_id") % 17 != 0, F.col("published_at"))), lookups.ingest_cutoff(t)).select("release_id"),
    """, c AS (SELECT coalesce(max(started_at) FILTER (run_type = 'daily' AND finished_at IS NOT NULL), TIMESTAMP '2024-01-24') AS since FROM runs)
SELECT release_id FROM activity, c WHERE release_id % 17 = 0 OR published_at >= since""",
)

# ---------------------------------------------------------------- dates, names and ingest by rows

add(
    "b10_date_texts",
    lambda t: t.releases.select("release_id", C.parse_date_text(F.concat(F.lit("on "), F.when(F.col("release_id") % 3 == 0, F.date_format("scraped_at", "MMMM d, yyyy")).when(F.col("release_id") % 3 == 1, F.date_format("scraped_at", "M/d/yy")).otherwise(F.date_format("scraped_at", "yyyy-MM-dd")))).alias("d")).select("release_id", F.col("d.value").alias("day"), F.col("d.confidence").alias("confidence")),
    "SELECT release_id, CAST(scraped_at AS DATE) AS day, CAST(CASE release_id % 3 WHEN 0 THEN 0.85 WHEN 1 THEN 0.75 ELSE 0.9 END AS DOUBLE) AS confidence FROM releases",
)
add(
    "b11_dates_of_urls",
    lambda t: _urls(t).select("page_id", C.date_from_url(F.col("url")).alias("d")).select("page_id", F.col("d.value").alias("day"), F.col("d.confidence").alias("confidence")),
    f"""{URL_SQL} SELECT page_id, coalesce(a, b) AS day, CAST(CASE WHEN a IS NOT NULL THEN 0.9 WHEN b IS NOT NULL THEN 0.7 END AS DOUBLE) AS confidence FROM (SELECT page_id, TRY_CAST(nullif(regexp_replace(regexp_extract(url, '/(20[0-9]{{2}}/[0-9]{{1,2}}/[0-9]{{1,2}})(?:/|$)', 1), '/', '-', 'g'), '') AS DATE) AS a,
  TRY_CAST(nullif(regexp_replace(regexp_extract(url, '/(20[0-9]{{2}}/[0-9]{{1,2}})/', 1), '/', '-', 'g'), '') || '-01' AS DATE) AS b FROM urls)""",
)


def _candidates(t: Tables) -> DataFrame:
    """Two dates for each release, of changing confidence."""
    i, none = F.col("release_id"), F.lit(None).cast("date")
    one = F.struct(F.when(i % 5 != 0, F.to_date("published_at")).otherwise(none).alias("value"), F.lit("feed").alias("source"), ((i % 3) * 0.25).cast("double").alias("confidence"))
    two = F.struct(F.to_date("scraped_at").alias("value"), F.lit("page").alias("source"), ((i % 4) * 0.25).cast("double").alias("confidence"))
    return t.releases.select("release_id", C.best_date(one, two).alias("d")).select("release_id", "d.*")


CANDIDATES_SQL = "SELECT release_id, CASE WHEN one THEN CAST(published_at AS DATE) ELSE CAST(scraped_at AS DATE) END AS value, CASE WHEN one THEN 'feed' ELSE 'page' END AS source, CAST(CASE WHEN one THEN release_id % 3 ELSE release_id % 4 END AS DOUBLE) * 0.25 AS confidence FROM (SELECT *, release_id % 5 <> 0 AND published_at IS NOT NULL AND release_id % 3 >= release_id % 4 AS one FROM releases)"
add("b13_best_dates", _candidates, CANDIDATES_SQL)


def _demoted(t: Tables) -> DataFrame:
    source, confidence = C.demote_future(F.col("value").cast("timestamp_ntz"), F.col("source"), F.col("confidence"), ts("2026-03-01 00:00:00"))
    return _candidates(t).select("release_id", source.alias("source"), confidence.alias("confidence"))


add("b14_demoted_dates", _demoted, f"SELECT release_id, CASE WHEN value > DATE '2026-03-02' THEN source || '_future_typo' ELSE source END AS source, CASE WHEN value > DATE '2026-03-02' THEN least(confidence, 0.2) ELSE confidence END AS confidence FROM ({CANDIDATES_SQL})")
add(
    "b16_feed_dates",
    lambda t: t.releases.select("release_id", C.parse_feed_date(F.when(F.col("release_id") % 3 == 0, F.concat(F.lit("Mon, "), F.date_format("scraped_at", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(F.col("release_id") % 3 == 1, F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.concat(F.lit("Thu, "), F.lit("113 Apr "), F.date_format("scraped_at", "yyyy")))).cast("date").alias("day")),
    "SELECT release_id, CASE WHEN release_id % 3 = 2 THEN make_date(year(scraped_at), 1, 1) + 112 ELSE CAST(scraped_at AS DATE) END AS day FROM releases",
)
add(
    "b22_family_names",
    lambda t: t.members.select("member_id", lookups.family_name(F.when(F.col("member_id") % 3 == 0, F.concat(F.col("full_name"), F.lit(" Jr."))).when(F.col("member_id") % 3 == 1, F.concat(F.lit("Ann "), F.col("full_name"), F.lit(", III"))).otherwise(F.concat(F.lit("  Bo  "), F.col("full_name")))).alias("family")),
    "SELECT member_id, full_name AS family FROM members",
)
add(
    "b06_classified",
    lambda t: _urls(t).select("page_id", C.classify(F.when(F.col("page_id") % 4 == 0, "Op-Ed: on bread").when(F.col("page_id") % 4 == 1, "Senator delivers floor speech").when(F.col("page_id") % 4 == 2, "Letter to the board").otherwise("News"), F.col("url")).alias("kind")),
    f"""{URL_SQL} SELECT page_id, CASE WHEN lower(url) LIKE '%/press-release%' OR lower(url) LIKE '%/newsroom/press%' OR lower(url) LIKE '%/news/press%' THEN 'press_release' WHEN lower(url) LIKE '%/op-ed%' THEN 'op_ed' WHEN lower(url) LIKE '%/blog/%' THEN 'blog'
  ELSE CASE page_id % 4 WHEN 0 THEN 'op_ed' WHEN 1 THEN 'floor_statement' WHEN 2 THEN 'letter' ELSE 'press_release' END END AS kind FROM urls""",
)
add(
    "s03_insert_ignore",
    lambda t: ingest.insert_ignore(t.releases.where("release_id % 2 = 0").select(F.col("release_id").alias("url")), t.releases.select((F.col("release_id") - F.col("release_id") % 3).alias("url"))).select("url"),
    "SELECT DISTINCT release_id - release_id % 3 AS url FROM releases WHERE release_id - release_id % 3 NOT IN (SELECT release_id FROM releases WHERE release_id % 2 = 0)",
)
add(
    "s06_restored",
    lambda t: ingest.restored(t.pages.select("url").distinct(), t.url_checks),
    "SELECT url FROM (SELECT url, max_by(status, (checked_at, status)) AS status FROM url_checks GROUP BY url) WHERE status = 200",
)
add(
    "m02_coverage_percentiles",
    lambda t: feeds.coverage_percentiles(stats.coverage_audit(t)),
)
add("b05_repeated_titles", lambda t: t.releases.select("release_id", C.title_key(F.lit(1), F.col("title")).alias("key")).groupBy("key").agg(stats.n().alias("n")).where("n > 1").select(F.sha2("key", 256).alias("key"), "n"), r"SELECT sha256(k) AS key, count(*) AS n FROM (SELECT '1:' || trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS k FROM releases) GROUP BY k HAVING count(*) > 1")
