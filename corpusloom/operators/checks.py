"""Corpus checks and health: each reads releases once, grouped by member or by type, and tells who offends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.tables import AS_OF, WINDOW_START, Tables, days, ts
from .stats import active, latest_probe, n, per_period, visible

# Counts that hint at a page limit, and the least rows expected of each type.
ROUND_COUNTS = [10, 20, 25, 50, 75, 100, 150, 200, 250, 300, 350, 400, 450]
TYPE_FLOORS = {"press_release": 30000, "statement": 300, "op_ed": 30, "blog": 100, "letter": 3, "floor_statement": 20, "presidential_action": 400}


def member_offenders(t: Tables, as_of: str = AS_OF, start: str = WINDOW_START) -> DataFrame:
    """(check_id, member_id, observed): thin feeds, round counts, ramp-ups, late starts and stale members, in one aggregation."""
    at = F.col("published_at")
    per = t.releases.where("deleted_at is null").groupBy("member_id").agg(
        n().alias("total"),
        F.count_if((at >= ts(start)) & (at < ts(start) + days(90))).alias("quarter"),
        F.count_if(at >= ts(as_of) - days(30)).alias("last_30"),
        F.min("published_at").alias("earliest"),
        F.max("published_at").alias("latest"),
    )
    per = per.join(active(t.members).select("member_id", "collection_method"), "member_id")
    monthly, total = F.col("quarter") / 3.0, F.col("total")
    row = lambda check, cond, seen: F.when(cond, F.struct(F.lit(check).alias("check_id"), seen.cast("long").alias("observed")))
    found = F.array(
        row("q13_round_count", total.isin(ROUND_COUNTS), total),
        row("q14_thin_feed", (F.col("collection_method") == "rss") & (total < 75), total),
        row("q15_ramp_up", (total < 500) & (monthly >= 1) & (F.col("last_30") >= 4 * monthly), F.col("last_30")),
        row("q18_reaches_back", F.col("earliest") <= ts(start) + days(58), F.datediff("earliest", ts(start))),
        row("q20_late_start", F.col("earliest") > ts(start) + days(60), F.datediff("earliest", ts(start))),
        row("q23_stale", F.col("latest") < ts(as_of) - days(60), F.datediff(ts(as_of), "latest")),
    )
    return per.select("member_id", F.explode(F.array_compact(found)).alias("x")).select("x.check_id", "member_id", "x.observed")


def type_offenders(t: Tables, start: str = WINDOW_START) -> DataFrame:
    """(check_id, content_type, observed): types below their floor, starting late, or clumped on few days."""
    at = F.col("published_at")
    since = at >= ts(start)
    per = t.releases.where("deleted_at is null").groupBy("content_type").agg(
        n().alias("total"), F.min("published_at").alias("earliest"), F.count_if(since).alias("dated"), F.countDistinct(F.when(since, F.to_date("published_at"))).alias("unique_days")
    )
    floors = F.create_map(*[F.lit(x) for kv in TYPE_FLOORS.items() for x in kv])[F.col("content_type")]
    row = lambda check, cond, seen: F.when(cond, F.struct(F.lit(check).alias("check_id"), seen.cast("long").alias("observed")))
    gap = F.datediff("earliest", ts(start))
    found = F.array(
        row("q24_below_floor", F.col("total") < floors, F.col("total")),
        row("q25_late_start", floors.isNotNull() & (F.col("total") >= 50) & (gap > 90), gap),
        row("q26_clumped", floors.isNotNull() & (F.col("dated") >= 30) & (F.col("unique_days") < F.least(F.floor(F.col("dated") * 0.2), F.lit(20))), F.col("unique_days")),
    )
    return per.select("content_type", F.explode(F.array_compact(found)).alias("x")).select("x.check_id", "content_type", "x.observed")


def url_violations(pages: DataFrame, suffixes: list[str], leaves: list[str], social: list[str]) -> DataFrame:
    """(page_id, rule) for each rule that an address breaks: outside the given hosts, a social network, a listing, a bare anchor."""
    host = F.lower(F.regexp_extract("url", r"^[^:/]+://([^/?#]*)", 1))
    rules = F.array(
        F.when(~F.exists(F.array(*[F.lit(s) for s in suffixes]), lambda s: host.endswith(s)), "foreign_host"),
        F.when(F.exists(F.array(*[F.lit(s) for s in social]), lambda s: host.contains(s)), "social"),
        F.when(C.is_listing_url(F.col("url"), leaves), "listing"),
        F.when(F.col("url").rlike("#.+"), "anchor"),
    )
    return pages.select("page_id", F.explode(F.array_compact(rules)).alias("rule"))


def duplicate_urls(pages: DataFrame, suffixes: list[str]) -> DataFrame:
    """(url, n) of normalised addresses that occur more than once."""
    return pages.groupBy(C.normalize_url(F.col("url"), suffixes).alias("url")).agg(n().alias("n")).where("n > 1")


def health_flags(t: Tables, as_of: str = AS_OF, lag: int = 5) -> DataFrame:
    """(member_id, flags): zero-records, live-http-N, live-zero-items, lag-Nd, round-count-N, comma-joined; healthy members have ''."""
    per = visible(t.releases).groupBy("member_id").agg(n().alias("total"), F.max("published_at").alias("latest"))
    m = active(t.members).select("member_id").join(per, "member_id", "left").join(latest_probe(t), "member_id", "left")
    late, total = F.datediff(ts(as_of), "latest"), F.coalesce("total", F.lit(0))
    flags = F.array(
        F.when(total == 0, "zero-records"),
        F.when(F.col("url_status") != 200, F.concat(F.lit("live-http-"), F.col("url_status").cast("string"))),
        F.when((F.col("url_status") == 200) & (F.col("items_found") == 0), "live-zero-items"),
        F.when(late > lag, F.concat(F.lit("lag-"), late.cast("string"), F.lit("d"))),
        F.when(total.isin(ROUND_COUNTS), F.concat(F.lit("round-count-"), total.cast("string"))),
    )
    return m.select("member_id", F.array_join(F.array_compact(flags), ",").alias("flags"))


def health_rollup(t: Tables) -> DataFrame:
    """(member_id, total, by_type): counts of each type as ``type:n``, comma-joined by type."""
    per = t.releases.where("deleted_at is null").groupBy("member_id", "content_type").agg(n().alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("content_type", "n"))), lambda s: F.concat_ws(":", s["content_type"], s["n"].cast("string")))
    return per.groupBy("member_id").agg(F.sum("n").alias("total"), F.array_join(listed, ",").alias("by_type"))


def deletions_by_month(t: Tables) -> DataFrame:
    return per_period(t.releases.where("deleted_at is not null"), "month", ["content_type"])


def weekly_histogram(t: Tables) -> DataFrame:
    """(member_id, active_weeks, span_weeks, median_week): the median is over the weeks with releases."""
    w = per_period(t.releases.where("deleted_at is null"), "week", ["member_id"])
    return w.groupBy("member_id").agg(n().alias("active_weeks"), (F.datediff(F.max("week"), F.min("week")) / 7 + 1).cast("long").alias("span_weeks"), F.expr("percentile(n, 0.5)").alias("median_week"))


def members_reached(t: Tables) -> DataFrame:
    """(month, new_members, reached): members with a first visible release in the month, and so far. The running count is over one
    row for each month."""
    first = visible(t.releases).where("published_at is not null").groupBy("member_id").agg(F.to_date(F.date_trunc("month", F.min("published_at"))).alias("month"))
    per = first.groupBy("month").agg(n().alias("new_members"))
    return per.withColumn("reached", F.sum("new_members").over(Window.orderBy("month")))


def recheck_candidates(checks: DataFrame, batch: int) -> DataFrame:
    """The ``batch`` addresses to check next: those never seen live first, then those not seen for longest."""
    seen = checks.groupBy("url").agg(F.max(F.when(F.col("status") == 200, F.col("checked_at"))).alias("last_live"))
    return seen.orderBy(F.asc_nulls_first("last_live"), "url").limit(batch).select("url", F.col("last_live").isNotNull().alias("ever_live"))


def redate(releases: DataFrame, found: DataFrame, sure: float = 0.9) -> DataFrame:
    """(release_id, outcome, published_at, confidence) of each release that a listing dates. ``conflict``: another day, but the
    stored date comes from the page's own metadata; ``updated``: another day, or a surer source; else ``unchanged``.

    releases: release_id, published_at, date_source, confidence. found: release_id, listed_at, listed_confidence."""
    j = releases.join(found, "release_id")
    moved = ~F.to_date("published_at").eqNullSafe(F.to_date("listed_at"))
    held = (F.col("date_source") == "meta_tag") & (F.col("confidence") >= sure) & F.col("published_at").isNotNull()
    outcome = F.when(moved & held, "conflict").when(~held & (moved | (F.col("listed_confidence") > F.coalesce("confidence", F.lit(0.0)))), "updated").otherwise("unchanged")
    new = F.col("outcome") == "updated"
    return j.withColumn("outcome", outcome).select(
        "release_id", "outcome", F.when(new, F.col("listed_at")).otherwise(F.col("published_at")).alias("published_at"), F.when(new, F.col("listed_confidence")).otherwise(F.col("confidence")).alias("confidence")
    )


def spread(members: list, max_run: int) -> list[int]:
    """Positions of a feed's rows in an order where no member follows itself more than ``max_run`` - 1 times while others wait."""
    waiting, order, last, run = list(range(len(members))), [], None, 0
    while waiting:
        at = next((j for j, i in enumerate(waiting) if run < max_run or members[i] != last), 0)
        i = waiting.pop(at)
        run, last = (run + 1 if members[i] == last else 1), members[i]
        order.append(i)
    return order


def diversified(feeds: DataFrame, key: str, size: int = 40, max_run: int = 2) -> DataFrame:
    """Each feed's newest ``size`` rows with ``place`` (from 1) such that no member fills more than ``max_run`` places in a row.

    The order is sequential by nature; a window cuts each feed to a page first, so a group is at most ``size`` rows."""
    w = Window.partitionBy(key).orderBy(F.col("effective_at").desc_nulls_last(), "release_id")
    pages = feeds.withColumn("at", F.row_number().over(w)).where(F.col("at") <= size).select(key, "release_id", "member_id", "at")

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("at", ignore_index=True)
        page = page.iloc[spread(page["member_id"].tolist(), max_run)].reset_index(drop=True)
        return page.assign(place=range(1, len(page) + 1))[[key, "place", "release_id", "member_id"]]

    return pages.groupBy(key).applyInPandas(run, f"{key} string, place int, release_id long, member_id long")


def sample(rows: DataFrame, key: str, size: int, seed: int = 7) -> DataFrame:
    """A repeatable sample: the rows with the smallest hashes of key and seed."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(size)
