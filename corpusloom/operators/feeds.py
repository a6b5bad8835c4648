"""Feeds of one member or chamber, directories, rosters, ranges, repair lists and the totals of ingest runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.tables import AS_OF, WINDOW_START, Tables, days, ts
from . import stats
from .stats import FEED_TYPES, active, n, visible
from .terms import may_have

# Seats of the state's senate; its sessions; the hosts of first-party addresses; selectors known to be too wide.
SEATS = 31
SESSIONS = [("89th regular session", "2025-01-14", "2025-06-02")]
FIRST_PARTY = ["senate.gov", "house.gov", "whitehouse.gov"]
GOVERNMENT = ["senate.gov", "house.gov"]
SOCIAL = ["bsky.app", "twitter.com", "facebook.com"]
BAD_SELECTORS = ["span.elementor-grid-item", "li.page-item"]
SECTION_WORDS = "/(press|news|newsroom|op|letters|releases|briefings|presidential)"
PARTY_RANK = {"D": 0, "I": 1, "R": 2}


# ---------------------------------------------------------------- feeds


def member_feed(t: Tables, member: int, kind: str | None = None) -> DataFrame:
    """One member's releases, newest first by effective date. A valid type replaces the filter against photo releases."""
    r = t.releases.where((F.col("member_id") == member) & F.col("deleted_at").isNull())
    r = r.where(F.col("content_type") == kind) if kind in FEED_TYPES else r.where("content_type <> 'photo_release'")
    return r.withColumn("effective_at", C.effective_date(F.col("published_at"), F.col("scraped_at")))


def latest(t: Tables, chamber: str | None, k: int, kind: str | None = None) -> DataFrame:
    """The k newest visible releases of a chamber's active members."""
    rows = stats.feed(t, chamber=chamber, kind=kind)
    return rows.orderBy(F.col("effective_at").desc_nulls_last(), "release_id").limit(k)


def feed_total(rows: DataFrame) -> DataFrame:
    """One row: how many releases a feed has over all its pages."""
    return rows.agg(n().alias("total"))


def member_lookup(t: Tables) -> DataFrame:
    """Each member's row with the number, first and newest of its visible releases, for its page."""
    per = visible(t.releases).groupBy("member_id").agg(n().alias("n"), F.min("published_at").alias("first"), F.max("published_at").alias("last"))
    m = t.members.join(per, "member_id", "left")
    return m.select("member_id", "full_name", "party", "state", "chamber", "status", F.coalesce("n", F.lit(0)).alias("n_releases"), F.to_date("first").alias("first_day"), F.to_date("last").alias("last_day"))


def release_versions(t: Tables) -> DataFrame:
    """(release_id, rank, version_id, captured_at): the versions of each release, newest first."""
    w = Window.partitionBy("release_id").orderBy(F.desc("captured_at"), F.desc("version_id"))
    return t.versions.select("release_id", F.row_number().over(w).alias("rank"), "version_id", "captured_at")


def directory_orders(t: Tables) -> DataFrame:
    """(member_id, by_count, by_state, by_name, by_party): the place of each active member in every order of the directory. Order
    is total: ties go by name, then id."""
    per = visible(t.releases).groupBy("member_id").agg(n().alias("n"))
    m = active(t.members).join(per, "member_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in PARTY_RANK.items() for x in kv])[F.col("party")], F.lit(9))
    place = lambda *by: F.row_number().over(Window.orderBy(*by, "full_name", "member_id"))
    return m.select("member_id", place(F.desc("n")).alias("by_count"), place("state").alias("by_state"), place().alias("by_name"), place(rank, F.desc("n")).alias("by_party"))


# Parties in the order of a state's roster.
ROSTER_PARTIES = {"D": 0, "R": 1, "I": 2}


def roster_page(t: Tables, roster: DataFrame, order: str, k: int = 50) -> DataFrame:
    """(place, member_id, district, n_releases): the first k of a roster (``roster_with_counts``) in one of its orders: district, count, name or party.
    Ties go by district, then id. A sort and a limit: no window holds the roster."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in ROSTER_PARTIES.items() for x in kv])[F.col("party")], F.lit(9))
    by = {"district": [], "count": [F.desc("n_releases")], "name": [F.asc("full_name")], "party": [rank]}[order]
    r = roster.join(t.members.select("member_id", "full_name", "party"), "member_id")
    first = r.orderBy(*by, "district", "member_id").limit(k)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*by, "district", "member_id"))).select("place", "member_id", "district", "n_releases")


def rank_display(rows: DataFrame, value: str, key: str) -> DataFrame:
    """Adds ``place`` (1, 2, ...) and ``bar``: the percentage of the largest value, 2 at least, 0 where all are 0."""
    top = F.max(value).over(Window.partitionBy())
    bar = F.when(top > 0, F.round(F.greatest(F.lit(2.0), 100.0 * F.col(value) / top), 6)).otherwise(0.0)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc(value), key))).withColumn("bar", bar)


def since_of_range(name: str, as_of: str = AS_OF) -> Column:
    """The first moment of a range: week, month, year, ytd; all has none (null)."""
    back = {"week": 7, "month": 30, "year": 365}
    if name == "all":
        return F.lit(None).cast("timestamp_ntz")
    return F.date_trunc("year", ts(as_of)).cast("timestamp_ntz") if name == "ytd" else ts(as_of) - days(back[name])


def members_by_range(t: Tables, ranges: list[str], k: int, as_of: str = AS_OF) -> DataFrame:
    """(range, side, rank, member_id, n): the k most and k least active members of each range. The least active ones include those
    without a release and leave out members that nobody collects. One scan counts all ranges."""
    at = F.col("published_at")
    c = {r: F.count_if(at >= since_of_range(r, as_of)) if r != "all" else n() for r in ranges}
    per = visible(t.releases).groupBy("member_id").agg(*[x.alias(r) for r, x in c.items()])
    m = active(t.members).select("member_id", "collection_method").join(per, "member_id", "left")
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("range"), F.coalesce(F.col(r), F.lit(0)).alias("n")) for r in ranges]))
    m = m.select("member_id", "collection_method", each.alias("x")).select("member_id", "collection_method", "x.*")
    ranked = lambda rows, side, by: rows.withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy(by, "member_id"))).where(F.col("rank") <= k).select("range", F.lit(side).alias("side"), "rank", "member_id", "n")
    return ranked(m.where("n > 0"), "top", F.desc("n")).unionByName(ranked(m.where("collection_method is not null"), "bottom", F.asc("n")))


def facets_simple(t: Tables, term: str, chamber: str) -> DataFrame:
    """(facet, key, n) of a chamber's search hits by party and by type, whatever other filters are set."""
    have = C.terms(F.concat_ws(" ", "title", "body_text"))
    r = visible(may_have(t.releases, [term])).where(F.array_contains(have, term)).join(active(t.members, chamber).select("member_id", "party"), "member_id")
    each = F.explode(F.array(F.struct(F.lit("party").alias("facet"), F.col("party").alias("key")), F.struct(F.lit("type").alias("facet"), F.col("content_type").alias("key"))))
    return r.select(each.alias("x")).groupBy("x.facet", "x.key").agg(n().alias("n"))


# ---------------------------------------------------------------- rosters and overlays


def roster_with_counts(t: Tables, roster: DataFrame) -> DataFrame:
    """(member_id, district, n_releases): a roster's members with their district, from their configuration, else their handle, else
    0. roster: member_id, handle, config (JSON)."""
    per = visible(t.releases).groupBy("member_id").agg(n().alias("n"))
    told, handle = F.get_json_object("config", "$.district").try_cast("int"), F.regexp_extract("handle", "^tx-d([0-9]{2})-", 1).try_cast("int")
    return roster.join(per, "member_id", "left").select("member_id", F.coalesce(told, handle, F.lit(0)).alias("district"), F.coalesce("n", F.lit(0)).alias("n_releases"))


def vacant_seats(roster: DataFrame, seats: int = SEATS) -> DataFrame:
    """(district) of the seats from 1 on that nobody in a roster (with ``district``) holds."""
    every = roster.sparkSession.range(1, seats + 1).select(F.col("id").cast("int").alias("district"))
    return every.join(roster.select("district").distinct(), "district", "left_anti")


def seed_overlay(members: DataFrame, seeds: DataFrame, columns: list[str]) -> DataFrame:
    """Members with the seeds' values where those are not empty. seeds: member_id and the columns."""
    s = seeds.select("member_id", *[F.col(c).alias(f"_{c}") for c in columns])
    out = members.join(s, "member_id", "left")
    return out.select(*[F.coalesce(F.when(F.col(f"_{c}") != "", F.col(f"_{c}")), F.col(c)).alias(c) if c in columns else F.col(c) for c in members.columns])


def state_coverage_overlay(t: Tables, static: DataFrame) -> DataFrame:
    """(state, n_members, n_releases): what is stored, over static rows for states that it lacks. static: state, n_members, n_releases."""
    per = visible(t.releases).groupBy("member_id").agg(n().alias("n"))
    live = active(t.members).join(per, "member_id", "left").groupBy("state").agg(n().alias("live_members"), F.coalesce(F.sum("n"), F.lit(0)).alias("live_releases"))
    both = static.join(live, "state", "full")
    return both.select("state", F.coalesce("live_members", "n_members").alias("n_members"), F.coalesce("live_releases", "n_releases").alias("n_releases"))


def monthly_volume(t: Tables, sessions: list[tuple[str, str, str]] = SESSIONS) -> DataFrame:
    """(month, n, session): visible releases by month; the session that overlaps the month, if one does."""
    month = F.to_date(F.date_trunc("month", "published_at"))
    per = visible(t.releases).where("published_at is not null").groupBy(month.alias("month")).agg(n().alias("n"))
    ends = F.last_day("month")
    name = F.coalesce(*[F.when((F.col("month") <= F.lit(b).cast("date")) & (ends >= F.lit(a).cast("date")), s) for s, a, b in sessions], F.lit(None).cast("string"))
    return per.withColumn("session", name)


# ---------------------------------------------------------------- addresses


def is_external(url: Column, first_party: list[str] = FIRST_PARTY) -> Column:
    """Whether an address names none of the first-party hosts; an empty one is not external."""
    inside = reduce(lambda a, b: a | b, [F.lower(url).contains(h) for h in first_party])
    return F.when(url.isNull() | (url == ""), False).otherwise(~inside)


def bad_url_reason(url: Column, government: list[str] = GOVERNMENT, social: list[str] = SOCIAL) -> Column:
    """Why an address is no release, by precedence: host, social network, listing, listing with an anchor; else null."""
    host = F.lower(F.regexp_extract(url, r"^[^:/]+://([^/?#]*)", 1))
    any_of = lambda hosts: reduce(lambda a, b: a | b, [host.contains(h) for h in hosts])
    before, anchor = F.regexp_extract(url, "^([^#]*)", 1), url.rlike("#.")
    return (
        F.when(~any_of(government), F.concat(F.lit("non-government domain: "), host))
        .when(any_of(social), F.concat(F.lit("social media: "), host))
        .when(url.rlike("/press-releases/?$"), "listing page URL, not a detail page")
        .when(anchor & before.rlike("/press-releases/?$"), "listing page with anchor")
    )


def url_window(url: Column, lastmod: Column | None = None, start: str = WINDOW_START, as_of: str = AS_OF) -> Column:
    """in, pre or undated, by a year of this century in an address's path (from the start's year to now's; before it), else by its last
    modification."""
    years = F.transform(F.regexp_extract_all(url, F.lit("/(20[0-9]{2})(?=/)"), 1), lambda y: y.cast("int"))
    first, last = int(start[:4]), int(as_of[:4])
    by = F.when(F.exists(years, lambda y: y.between(first, last)), "in").when(F.exists(years, lambda y: y < first), "pre")
    if lastmod is None:
        return by.otherwise("undated")
    return by.when(lastmod.isNull(), "undated").when(lastmod >= F.lit(start[:10]).cast("date"), "in").otherwise("pre")


def sitemap_sections(urls: DataFrame, least: int = 3, samples: int = 3) -> DataFrame:
    """(section, label, n, in_window, pre_window, undated, sample, category) of the sections with at least so many addresses. urls: url,
    lastmod. The sample: the smallest addresses, of which a window keeps so many a section."""
    window = url_window(F.col("url"), F.col("lastmod"))
    s = urls.select(C.section_of_url(F.col("url")).alias("section"), "url", window.alias("w"))
    first = F.row_number().over(Window.partitionBy("section").orderBy("url"))
    per = s.groupBy("section").agg(n().alias("n"), *[F.count_if(F.col("w") == w).alias(c) for w, c in (("in", "in_window"), ("pre", "pre_window"), ("undated", "undated"))]).where(F.col("n") >= least)
    some = s.withColumn("rn", first).where(F.col("rn") <= samples).groupBy("section").agg(F.array_join(F.array_sort(F.collect_list("url")), " ").alias("sample"))
    category = C.classify(F.lit(""), F.col("section"))
    return per.join(some, "section").select("section", C.section_label(F.col("section")).alias("label"), "n", "in_window", "pre_window", "undated", "sample", category.alias("category"))


def member_sections(pages: DataFrame, words: str = SECTION_WORDS, least: int = 5, k: int = 6) -> DataFrame:
    """(member_id, rank, section, label, n): each member's largest sections whose address names documents. pages: member_id, url."""
    per = pages.select("member_id", C.section_of_url(F.col("url")).alias("section")).where(F.col("section").rlike(words)).groupBy("member_id", "section").agg(n().alias("n")).where(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy("member_id").orderBy(F.desc("n"), "section"))
    return per.withColumn("rank", rank).where(F.col("rank") <= k).select("member_id", "rank", "section", C.section_label(F.col("section")).alias("label"), "n")


def url_pattern_audit(pages: DataFrame, patterns: list[str]) -> DataFrame:
    """(kind, pattern, is_deleted, n): addresses by the first pattern that they contain, by host and by root. pages: url, is_deleted."""
    url = F.col("url")
    first = F.coalesce(*[F.when(url.contains(p), p) for p in patterns], F.lit("other"))
    host, root = F.regexp_replace(url, "^https?://([^/]+).*$", "$1"), F.regexp_replace(url, "^https?://([^/]+)(/[^/]+/?[^/]*).*$", "$1$2")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("pattern")) for k, c in (("pattern", first), ("host", host), ("root", root))]))
    return pages.select(each.alias("x"), "is_deleted").groupBy("x.kind", "x.pattern", "is_deleted").agg(n().alias("n"))


# ---------------------------------------------------------------- repair, runs, edits, alerts


def repair_candidates(t: Tables) -> DataFrame:
    """(kind, release_id, member_id) of live releases to repair: without a date, or with a body of fewer than 50 characters."""
    kinds = F.array(F.when(F.col("published_at").isNull(), "null_date"), F.when(F.coalesce(F.length("body_text"), F.lit(0)) < 50, "no_body"))
    r = t.releases.where("deleted_at is null").select("release_id", "member_id", F.explode(F.array_compact(kinds)).alias("kind"))
    return r.select("kind", "release_id", "member_id")


def repair_kinds(releases: DataFrame, members: DataFrame, start: str = WINDOW_START, short: int = 50, sure: float = 0.9) -> DataFrame:
    """(kind, release_id, member_id) of live releases to repair, by all four kinds: ``null_date``; ``no_body`` (none or a short one);
    ``weak_date`` (from ``start`` on, of no known source, from an address, or below the confidence ``sure``); ``document_body`` (press releases of the
    state senate that are a PDF or a press.php page, without a body).

    releases: release_id, member_id, url, published_at, body_text, content_type, deleted_at, date_source, confidence. Nulls of a source or
    confidence are weak; an unknown member has no chamber."""
    empty = F.coalesce(F.length("body_text"), F.lit(0)) < short
    weak = F.coalesce(F.col("published_at") >= ts(start), F.lit(False)) & (F.col("date_source").isNull() | (F.col("date_source") == "url_path") | F.coalesce(F.col("confidence") < sure, F.lit(False)))
    url = F.lower(F.coalesce("url", F.lit("")))
    document = (F.col("chamber") == "tx_senate") & (F.col("content_type") == "press_release") & (url.endswith(".pdf") | url.contains("press.php")) & empty
    r = releases.where("deleted_at is null").join(members.select("member_id", "chamber"), "member_id", "left")
    kinds = F.array(F.when(F.col("published_at").isNull(), "null_date"), F.when(empty, "no_body"), F.when(weak, "weak_date"), F.when(document, "document_body"))
    return r.select("release_id", "member_id", F.explode(F.array_compact(kinds)).alias("kind")).select("kind", "release_id", "member_id")


def ranked_feed(t: Tables, index: DataFrame, term: str, number: int = 1, size: int = 25) -> DataFrame:
    """(release_id, score, day): a page of the feed's releases with a term, by rank, then the newest first. The term's postings decide; texts
    aren't read."""
    score = F.aggregate(F.sequence(F.lit(1), F.col("hits")), F.lit(0.0), lambda s, j: s + 0.1 / (j.cast("double") * j)) / 1.64493406685
    hits = index.where(F.col("term") == term).select("release_id", F.size("positions").alias("hits"))
    at = C.effective_date(F.col("published_at"), F.col("scraped_at"))
    rows = visible(t.releases).select("release_id", "member_id", at.alias("at")).join(active(t.members).select("member_id"), "member_id").join(hits, "release_id")
    rows = rows.select("release_id", F.round(score, 9).alias("score"), "at")
    return rows.orderBy(F.desc("score"), F.col("at").desc_nulls_last(), "release_id").offset((number - 1) * size).limit(size).select("release_id", "score", F.to_date("at").alias("day"))


def offenders(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """(check_id, n_offenders) of the corpus checks: how many live releases, or members, each is about, in one pass over the releases."""
    live, at = F.col("deleted_at").isNull(), F.col("published_at")
    wrong = {
        "q05_short_titles": F.coalesce(F.length(F.trim("title")), F.lit(0)) < 5,
        "q07_undated": at.isNull(),
        "q08_dates_out_of_range": (at < ts("2010-01-01 00:00:00")) | (at > ts(as_of) + days(60)),
        "q09_future_dates": (at > ts(as_of) + days(1)) & (at <= ts(as_of) + days(60)),
        "q21_no_body": F.coalesce(F.length("body_text"), F.lit(0)) <= 100,
    }
    one = t.releases.agg(*[F.count_if(live & c).alias(k) for k, c in wrong.items()])
    silent = active(t.members).join(t.releases.where(live).select("member_id").distinct(), "member_id", "left_anti").agg(n().alias("q03_silent_members"))
    both = one.crossJoin(F.broadcast(silent))  # one row each
    return both.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), F.col(k).alias("n_offenders")) for k in [*wrong, "q03_silent_members"]])).alias("x")).select("x.*")


def contact_summary(pages: DataFrame, contacts: DataFrame) -> DataFrame:
    """(outcome, n_pages, n_contacts): pages with a named contact (``found``), with addresses only (``email_only``), and with none (``not_found``)."""
    per = contacts.groupBy("page_id").agg(n().alias("c"), F.count("name").alias("named"), F.count("email").alias("mails"))
    outcome = F.when(F.col("named") > 0, "found").when(F.col("mails") > 0, "email_only").otherwise("not_found")
    return pages.select("page_id").join(per, "page_id", "left").groupBy(outcome.alias("outcome")).agg(n().alias("n_pages"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_contacts"))


def feed_summary(members: DataFrame, best: DataFrame) -> DataFrame:
    """(method, has_feed, eligible, n): active members by how they are collected, whether they have a feed, and whether their best one fits. best: as
    ``best_feeds`` gives it."""
    m = active(members).join(best.select("member_id", "eligible"), "member_id", "left")
    return m.groupBy(F.coalesce("collection_method", F.lit("none")).alias("method"), F.col("eligible").isNotNull().alias("has_feed"), F.coalesce("eligible", F.lit(False)).alias("eligible")).agg(n().alias("n"))


def source_candidates(sources: DataFrame, method: str = "httpx") -> DataFrame:
    """(source_id) of the sources of a method whose selectors are missing or known to be too wide. sources: source_id,
    collection_method, selectors (JSON)."""
    item, title = F.get_json_object("selectors", "$.list_item"), F.get_json_object("selectors", "$.title")
    missing = lambda c: F.coalesce(c, F.lit("")) == ""
    return sources.where(F.col("collection_method") == method).where(missing(item) | missing(title) | item.isin(BAD_SELECTORS)).select("source_id")


def run_stats(outcomes: DataFrame) -> DataFrame:
    """Totals of each run: by outcome, members seen, with new releases, with updates. outcomes: run_id, member_id, outcome."""
    of = lambda o: F.col("outcome") == o
    some = lambda o: F.countDistinct(F.when(of(o), F.col("member_id")))
    return outcomes.groupBy("run_id").agg(
        *[F.count_if(of(o)).alias(f"total_{o}") for o in ("inserted", "updated", "skipped", "error")], F.countDistinct("member_id").alias("members"), some("inserted").alias("members_with_new"), some("updated").alias("members_with_updates")
    )


def alerts_open(alerts: DataFrame, k: int = 50) -> DataFrame:
    """The k newest alerts that nobody has acknowledged. alerts: alert_id, created_at, acknowledged, ..."""
    return alerts.where("not acknowledged").orderBy(F.desc("created_at"), F.desc("alert_id")).limit(k)


def edit_totals(t: Tables) -> DataFrame:
    """One row: live releases, versions, releases with one, tombstones, and the edit rate in percent."""
    r = t.releases.agg(F.count_if(F.col("deleted_at").isNull()).alias("total_releases"), F.count("deleted_at").alias("tombstones"))
    v = t.versions.agg(n().alias("total_versions"), F.countDistinct("release_id").alias("releases_with_versions"))
    return r.join(F.broadcast(v)).withColumn("edit_rate", F.round(100.0 * F.col("releases_with_versions") / F.col("total_releases"), 4))


def most_edited(t: Tables, k: int = 10) -> DataFrame:
    per = t.versions.groupBy("release_id").agg(n().alias("n_versions"), F.max("captured_at").alias("latest_edit"))
    return per.join(t.releases.select("release_id", "member_id"), "release_id").orderBy(F.desc("n_versions"), F.desc("latest_edit"), "release_id").limit(k)


def edits_by_month(t: Tables, k: int = 12) -> DataFrame:
    per = t.versions.groupBy(F.to_date(F.date_trunc("month", "captured_at")).alias("month")).agg(n().alias("edits"), F.countDistinct("release_id").alias("releases_edited"))
    return per.orderBy(F.desc("month")).limit(k)


def coverage_percentiles(audit: DataFrame) -> DataFrame:
    """One row: mean, median and tenth percentile (the element before a tenth of the sorted values) of the confidence. The values are
    counted first, so a window sees one row for each that occurs (101 at most, as they are whole percents)."""
    c = audit.groupBy("confidence").agg(n().alias("k"))
    up = F.sum("k").over(Window.orderBy("confidence"))
    c = c.withColumn("up", up).withColumn("total", F.sum("k").over(Window.partitionBy()))
    at = lambda place: F.min(F.when(F.col("up") > place, F.col("confidence")))
    total = F.col("total")
    middle = (at(F.floor((total - 1) / 2)) + at(F.floor(total / 2))) / 2
    return c.agg(F.round(F.sum(F.col("confidence") * F.col("k")) / F.max("total"), 4).alias("mean"), F.round(middle, 4).alias("median"), at(F.greatest(F.lit(0), F.floor(total / 10) - 1)).alias("p10"))


def judged_checks(report: DataFrame, bounds: dict[str, tuple[str, float]]) -> DataFrame:
    """(check_id, observed, threshold, passed) of a report's checks. bounds: check -> ("least" or "most", value)."""
    limit = F.create_map(*[F.lit(x) for k, (_, v) in bounds.items() for x in (k, float(v))])[F.col("check_id")]
    least = F.col("check_id").isin([k for k, (side, _) in bounds.items() if side == "least"])
    return report.where(F.col("check_id").isin(list(bounds))).select("check_id", "observed", limit.alias("threshold"), F.when(least, F.col("observed") >= limit).otherwise(F.col("observed") <= limit).alias("passed"))


def missing_urls(members: DataFrame, allowed: list[str]) -> DataFrame:
    """(full_name) of the members without an address that are not allowed to lack one. members: full_name, url."""
    return members.where(F.col("url").isNull() & ~F.col("full_name").isin(allowed)).select("full_name")


def since_moment(rows: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Rows published at the cut-off's moment or later; rows without a date stay. ``cutoff`` is one row."""
    return rows.join(F.broadcast(cutoff)).where(F.col("published_at").isNull() | (F.col("published_at") >= F.col("since"))).drop("since")
