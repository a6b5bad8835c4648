"""Feeds, joins, counts and series over releases and members. Every operator is lazy: tables in, a DataFrame out.

``members`` is the small side of every join here; Spark broadcasts it where its measured size allows, and otherwise joins by
shuffled keys, so nothing depends on the roster staying small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.tables import AS_OF, WINDOW_START, Tables, days, ts
from .nearest import nearest_in_time

# Content types that a feed accepts as a filter.
FEED_TYPES = ["press_release", "statement", "op_ed", "blog", "letter", "floor_statement", "presidential_action"]


def visible(releases: DataFrame) -> DataFrame:
    """Not deleted and no photo release; an unknown type drops out."""
    return releases.where(F.col("deleted_at").isNull() & (F.col("content_type") != "photo_release"))


def active(members: DataFrame, chamber: str | None = None) -> DataFrame:
    m = members.where("status = 'active'")
    return m if chamber is None else m.where(F.col("chamber") == chamber)


def n() -> Column:
    return F.count(F.lit(1))


def feed(t: Tables, party=None, state=None, member=None, kind=None, since=None, until=None, chamber=None, search=None) -> DataFrame:
    """Visible releases of active members under all given filters; ``until`` includes its day, an unknown type is ignored."""
    r = visible(t.releases)
    if member is not None:
        r = r.where(F.col("member_id") == member)
    if kind in FEED_TYPES:
        r = r.where(F.col("content_type") == kind)
    if since:
        r = r.where(F.col("published_at") >= ts(since))
    if until:
        r = r.where(F.col("published_at") < ts(until) + days(1))
    if search:
        for word in search.lower().split():
            r = r.where(F.array_contains(C.terms(F.concat_ws(" ", "title", "body_text")), F.regexp_replace(F.lit(word), "s$", "")))
    m = active(t.members, chamber)
    for c, v in (("party", party), ("state", state)):
        if v is not None:
            m = m.where(F.col(c) == v)
    return r.join(m, "member_id").withColumn("effective_at", C.effective_date(F.col("published_at"), F.col("scraped_at")))


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    return rows.orderBy(F.col("effective_at").desc_nulls_last(), "release_id").offset((number - 1) * size).limit(size)


def member_directory(t: Tables) -> DataFrame:
    """Every member with the count, first and last of its visible releases; those without have 0."""
    per = visible(t.releases).groupBy("member_id").agg(n().alias("n"), F.min("published_at").alias("first"), F.max("published_at").alias("last"))
    return t.members.join(per, "member_id", "left").select("member_id", "full_name", F.coalesce("n", F.lit(0)).alias("n_releases"), F.to_date("first").alias("first_day"), F.to_date("last").alias("last_day"))


def type_map(t: Tables) -> DataFrame:
    """(member_id, type_counts map) of visible releases."""
    per = visible(t.releases).groupBy("member_id", "content_type").agg(n().alias("n"))
    return per.groupBy("member_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("content_type", "n")))).alias("type_counts"))


def corpus_stats(t: Tables) -> DataFrame:
    """Per chamber: releases, members with releases, earliest and latest day."""
    return visible(t.releases).join(active(t.members), "member_id").groupBy("chamber").agg(n().alias("n_releases"), F.countDistinct("member_id").alias("n_members"), F.to_date(F.min("published_at")).alias("earliest"), F.to_date(F.max("published_at")).alias("latest"))


def ranked_members(t: Tables, since: str, k: int, least: bool = False) -> DataFrame:
    """The k most (or least, zeros included) active members since a moment."""
    per = visible(t.releases).where(F.col("published_at") >= ts(since)).groupBy("member_id").agg(n().alias("n"))
    m = active(t.members)
    if least:
        m = m.where(F.col("collection_method").isNotNull())
    rows = m.join(per, "member_id", "left" if least else "inner").select("member_id", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.orderBy(F.asc("n") if least else F.desc("n"), "member_id").limit(k)


def per_period(rows: DataFrame, period: str, keys: list[str]) -> DataFrame:
    """Counts by ``keys`` and week, month or day (a date) of publication."""
    day = F.to_date(F.date_trunc(period, "published_at"))
    return rows.where(F.col("published_at").isNotNull()).groupBy(*keys, day.alias(period)).agg(n().alias("n"))


def recent_types(t: Tables, n_days: int, as_of: str = AS_OF) -> DataFrame:
    return visible(t.releases).where(F.col("published_at") >= ts(as_of) - days(n_days)).groupBy("content_type").agg(n().alias("n"))


def chamber_activity(t: Tables, n_days: int, as_of: str = AS_OF) -> DataFrame:
    """Active members with their counts of the last days, zeros included."""
    per = visible(t.releases).where(F.col("published_at") >= ts(as_of) - days(n_days)).groupBy("member_id").agg(n().alias("n"))
    return active(t.members).join(per, "member_id", "left").select("member_id", "chamber", F.coalesce("n", F.lit(0)).alias("n"))


def swim_lanes(t: Tables, k: int) -> DataFrame:
    """The k members with most releases, each with its weeks as one array."""
    weeks = per_period(visible(t.releases), "week", ["member_id"])
    lanes = weeks.groupBy("member_id").agg(F.sum("n").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("week", "n"))), lambda s: F.concat_ws(":", s["week"].cast("string"), s["n"].cast("string"))), ",").alias("weeks"))
    return lanes.orderBy(F.desc("total"), "member_id").limit(k)


def state_composition(t: Tables) -> DataFrame:
    """Per state: active members, parties, and its colour."""
    s = active(t.members).groupBy("state").agg(n().alias("n_members"), F.array_sort(F.collect_set("party")).alias("p"))
    colour = F.when(F.array_contains("p", "D") & F.array_contains("p", "R"), "purple").when(F.array_contains("p", "D"), "blue").when(F.array_contains("p", "R"), "red").otherwise("gray")
    return s.select("state", "n_members", F.array_join("p", "").alias("parties"), colour.alias("colour"))


def member_share(t: Tables) -> DataFrame:
    """Each member's share of its chamber's visible releases, in percent."""
    per = visible(t.releases).join(active(t.members), "member_id").groupBy("chamber", "member_id").agg(n().alias("n"))
    return per.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("chamber")), 6))


def quality_totals(t: Tables) -> DataFrame:
    """Dated, undated, with body, without, distinct members: one pass."""
    c = lambda cond: F.count_if(cond)
    return t.releases.where("deleted_at is null").agg(
        n().alias("n"), c(F.col("published_at").isNotNull()).alias("dated"), c(F.col("published_at").isNull()).alias("undated"), c(F.length("body_text") > 100).alias("with_body"), c(F.coalesce(F.length("body_text"), F.lit(0)) <= 100).alias("without_body"), F.countDistinct("member_id").alias("n_members")
    )


def coverage_by_method(t: Tables) -> DataFrame:
    """Per collection method: members and their visible releases (members without releases count as members only)."""
    per = visible(t.releases).groupBy("member_id").agg(n().alias("n"), F.count("published_at").alias("dated"))
    return t.members.join(per, "member_id", "left").groupBy(F.coalesce("collection_method", F.lit("none")).alias("method")).agg(n().alias("n_members"), F.sum(F.coalesce("n", F.lit(0))).alias("n_releases"), F.sum(F.coalesce("dated", F.lit(0))).alias("n_dated"))


def coverage_depth(t: Tables) -> DataFrame:
    """complete, undated, empty or partial for each active member."""
    per = visible(t.releases).groupBy("member_id").agg(n().alias("n"), F.count("published_at").alias("dated"))
    c = F.coalesce("n", F.lit(0))
    d = F.coalesce("dated", F.lit(0))
    label = F.when(c == 0, "empty").when(d == 0, "undated").when(d == c, "complete").otherwise("partial")
    return active(t.members).join(per, "member_id", "left").select("member_id", c.alias("n"), d.alias("dated"), label.alias("depth"))


def member_intelligence(t: Tables) -> DataFrame:
    """Per member: totals by condition and its latest probe."""
    per = t.releases.groupBy("member_id").agg(
        n().alias("total"), F.count_if(F.col("deleted_at").isNull()).alias("active"), F.count("deleted_at").alias("deleted"), F.count("published_at").alias("dated"), F.count_if(F.length("body_text") > 100).alias("with_body")
    )
    return t.members.select("member_id").join(per, "member_id").join(latest_probe(t), "member_id", "left").select(
        "member_id", "total", "active", "deleted", "dated", "with_body", F.round(100.0 * F.col("dated") / F.col("total"), 4).alias("dated_pct"), "url_status", "passed"
    )


def latest_probe(t: Tables) -> DataFrame:
    """Each member's newest probe, and whether it passed (status 200 and something found)."""
    w = Window.partitionBy("member_id").orderBy(F.desc("checked_at"), F.desc("probe_id"))
    p = t.probes.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return p.select("member_id", "url_status", "items_found", ((F.col("url_status") == 200) & (F.col("items_found") > 0)).alias("passed"))


def drought(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """Days since the last record of each (member, type)."""
    last = visible(t.releases).where("published_at is not null").groupBy("member_id", "content_type").agg(F.max("published_at").alias("last"))
    return last.select("member_id", "content_type", F.datediff(ts(as_of), "last").cast("long").alias("days_since"))


def corpus_totals(t: Tables, as_of: str = AS_OF) -> DataFrame:
    live = F.col("deleted_at").isNull()
    within = lambda d: F.countDistinct(F.when(live & (F.col("published_at") >= ts(as_of) - days(d)), F.col("member_id")))
    return t.releases.agg(n().alias("total"), F.count("deleted_at").alias("tombstones"), F.count_if(F.col("published_at").isNull()).alias("undated"), within(7).alias("active_7d"), within(30).alias("active_30d"))


def edit_frequency(t: Tables) -> DataFrame:
    """How many releases have so many versions (0 included)."""
    per = t.versions.groupBy("release_id").agg(n().alias("v"))
    return t.releases.select("release_id").join(per, "release_id", "left").groupBy(F.coalesce("v", F.lit(0)).alias("n_versions")).agg(n().alias("n_releases"))


def url_sections(t: Tables, least: int) -> DataFrame:
    """Sections of the pages' addresses with at least so many pages."""
    return t.pages.groupBy(C.section_of_url(F.col("url")).alias("section")).agg(n().alias("n")).where(F.col("n") >= least).select("section", C.section_label(F.col("section")).alias("label"), "n")


def runs_summary(t: Tables) -> DataFrame:
    """Per run: its statistic from JSON (0 where absent) and its duration."""
    k = F.coalesce(F.get_json_object("stats", "$.k").try_cast("long"), F.lit(0))
    seconds = F.unix_timestamp(F.col("finished_at").cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))
    return t.runs.select("run_id", "run_type", k.alias("k"), seconds.alias("seconds"))


def related(t: Tables, k: int) -> DataFrame:
    """For each visible release of an active member, the k nearest in time (24 h at most) of other members of its chamber, by a sweep: rows are
    sent once, however many lie within a day of each other."""
    at = F.unix_timestamp(F.col("published_at").cast("timestamp"))
    v = visible(t.releases).where("published_at is not null").join(active(t.members), "member_id").select("release_id", "member_id", "chamber", at.alias("at"))
    return nearest_in_time(v, k)


def publication_gaps(t: Tables, least: int) -> DataFrame:
    """Members whose longest gap between releases is ``least`` days or more."""
    w = Window.partitionBy("member_id").orderBy("published_at", "release_id")
    v = t.releases.where("deleted_at is null and published_at is not null").withColumn("before", F.lag("published_at").over(w))
    gap = F.datediff("published_at", "before")
    return v.groupBy("member_id").agg(F.max(gap).cast("long").alias("max_gap")).where(F.col("max_gap") >= least)


def zero_run_weeks(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """Each member's longest run of weeks without a release, from its first week to ``as_of``, without a calendar table."""
    weeks = per_period(t.releases.where("deleted_at is null"), "week", ["member_id"]).select("member_id", "week")
    ends = weeks.select("member_id").distinct().withColumn("week", F.to_date(F.date_trunc("week", ts(as_of))) + F.expr("interval 7 days"))
    both = weeks.unionByName(ends.withColumn("week", F.to_date("week")))
    following = F.lead("week").over(Window.partitionBy("member_id").orderBy("week"))
    return both.withColumn("gap", F.datediff(following, "week") / 7 - 1).groupBy("member_id").agg(F.coalesce(F.max("gap"), F.lit(0.0)).cast("long").alias("longest_zero_run"))


def zero_months(t: Tables) -> DataFrame:
    """Months without a visible release between a member's first and last month."""
    months = per_period(visible(t.releases), "month", ["member_id"]).select("member_id", "month")
    span = months.groupBy("member_id").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    every = span.select("member_id", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return every.join(months, ["member_id", "month"], "left_anti")


# Totals that look like the end of a page of results.
ROUND_TOTALS = [10, 20, 25, 30, 40, 50, 60, 75, 100, 150, 200, 250, 300]


def coverage_audit(t: Tables, as_of: str = AS_OF, expected: str = WINDOW_START, threshold: int = 60, starts: dict[int, str] | None = None) -> DataFrame:
    """Severity and confidence (whole percent, halves to even) of each active member's coverage. ``starts``: member -> the day from which
    coverage is expected, where it isn't ``expected``."""
    per = t.releases.where("deleted_at is null").groupBy("member_id").agg(n().alias("total"), F.countDistinct(F.to_date("published_at")).alias("unique_days"), F.min("published_at").alias("earliest"))
    m = active(t.members).select("member_id").join(per, "member_id", "left").join(zero_run_weeks(t, as_of), "member_id", "left")
    m = m.withColumns({"total": F.coalesce("total", F.lit(0)), "unique_days": F.coalesce("unique_days", F.lit(0)), "zero_run": F.coalesce("longest_zero_run", F.lit(0))})
    peer = m.where("total > 0").agg(F.expr("percentile(total, 0.5)").alias("peer"))  # one row
    m = m.join(F.broadcast(peer))
    own = F.create_map(*[x for k, v in (starts or {}).items() for x in (F.lit(k).cast("long"), F.lit(v))])[F.col("member_id").cast("long")] if starts else F.lit(None).cast("string")
    begin = F.to_date(F.coalesce(own, F.lit(expected)))
    gap = F.datediff("earliest", begin)
    clump, ratio = F.try_divide("unique_days", "total"), F.try_divide("total", "peer")
    per_week = F.col("total") / F.greatest(F.lit(1), F.floor(F.datediff(ts(as_of), begin) / 7))
    m = m.withColumns({"gap": gap, "clump": clump, "ratio": ratio, "per_week": per_week})
    severity = (
        F.when(F.col("total") == 0, "NO_DATA")
        .when(F.col("gap") > threshold, "TRUNCATED")
        .when((F.col("clump") < 0.2) & (F.col("total") >= 30), "DATE_CLUMPED")
        .when((F.col("zero_run") >= 4) & (F.col("total") >= 30) & (F.col("per_week") >= 2), "INTERNAL_GAP")
        .when(F.col("ratio") < 0.25, "LOW_VOLUME")
        .when(F.col("gap") > 14, "SHALLOW")
        .otherwise("OK")
    )
    clamp = lambda x, low, high: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    start = 1 - clamp(F.greatest(F.lit(0), F.coalesce("gap", F.lit(0)) - 14) / 200, 0.0, 0.9)
    spare = F.greatest(F.lit(2.0), F.lit(4.0) / F.greatest(F.lit(0.5), F.col("per_week")))
    steady = 1 - clamp(F.greatest(F.lit(0.0), F.col("zero_run") - spare) / 20, 0.0, 0.5)
    volume = F.when((F.col("ratio") < 0.2) & F.col("total").isin(ROUND_TOTALS), 0.7).when(F.col("ratio") < 0.1, 0.8).otherwise(1.0)
    dates = clamp(0.6 + F.col("clump") * 0.5, 0.6, 1.0)
    m = m.withColumn("severity", severity)
    hard = F.when(F.col("severity") == "TRUNCATED", 0.3).when(F.col("severity") == "DATE_CLUMPED", 0.4).otherwise(1.0)
    confidence = F.when(F.col("total") == 0, 0.0).otherwise(clamp(start * steady * volume * dates * hard, 0.05, 1.0))
    return m.select("member_id", "total", "unique_days", "severity", F.bround(confidence * 100).cast("long").alias("confidence"))


def coverage_summary(t: Tables, starts: dict[int, str] | None = None) -> DataFrame:
    return coverage_audit(t, starts=starts).groupBy("severity").agg(n().alias("n"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))


def quality_report(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """(check_id, observed): the corpus checks that are sums over releases, in one pass."""
    live = F.col("deleted_at").isNull()
    share = lambda c: F.round(F.count_if(live & c) / F.count_if(live), 6)
    checks = {
        "q04_rows": F.count_if(live).cast("double"),
        "q05_short_titles": F.count_if(live & (F.coalesce(F.length(F.trim("title")), F.lit(0)) < 5)).cast("double"),
        "q07_dated_share": share(F.col("published_at").isNotNull()),
        "q08_dates_out_of_range": F.count_if(live & ((F.col("published_at") < ts("2010-01-01 00:00:00")) | (F.col("published_at") > ts(as_of) + days(60)))).cast("double"),
        "q09_future_dates": F.count_if(live & (F.col("published_at") > ts(as_of) + days(1)) & (F.col("published_at") <= ts(as_of) + days(60))).cast("double"),
        "q21_body_share": share(F.length("body_text") > 100),
        "q03_members": F.countDistinct(F.when(live, F.col("member_id"))).cast("double"),
    }
    one = t.releases.agg(*[c.alias(k) for k, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), F.col(k).alias("observed")) for k in checks])).alias("x")).select("x.*")


def low_volume(t: Tables) -> DataFrame:
    """Members with fewer releases than a tenth of the median (10 at least)."""
    per = t.releases.where("deleted_at is null").groupBy("member_id").agg(n().alias("n"))
    floor = per.agg(F.greatest(F.expr("percentile(n, 0.5)") * 0.1, F.lit(10.0)).alias("floor"))
    return per.join(F.broadcast(floor)).where(F.col("n") < F.col("floor")).select("member_id", "n")


def date_clumping(t: Tables) -> DataFrame:
    """Members with 30 releases or more on suspiciously few days."""
    per = t.releases.where("deleted_at is null and published_at is not null").groupBy("member_id").agg(n().alias("n"), F.countDistinct(F.to_date("published_at")).alias("unique_days"))
    return per.where("n >= 30 and unique_days < least(floor(0.2 * n), 20)")


def anomalies(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """(kind, member_id, observed): members gone silent, with many null dates, stale, or with future dates."""
    at, scraped = F.col("published_at"), F.col("scraped_at")
    live = F.col("deleted_at").isNull()
    since = lambda d: live & (at > ts(as_of) - days(d))
    fresh = scraped > ts(as_of) - days(3)
    per = t.releases.groupBy("member_id").agg(
        F.count_if(live).alias("total"), F.count_if(since(14)).alias("d14"), F.count_if(since(30)).alias("d30"), F.count_if(since(90)).alias("d90"),
        F.count_if(fresh).alias("fresh"), F.count_if(fresh & at.isNull()).alias("fresh_null"), F.max("published_at").alias("last"),
        F.count_if(live & (at > ts(as_of) + days(1)) & (at <= ts(as_of) + days(60))).alias("future"),
    )
    per = per.join(t.members.select("member_id", "collection_method"), "member_id", "left")
    row = lambda kind, cond, seen: F.when(cond, F.struct(F.lit(kind).alias("kind"), seen.cast("long").alias("observed")))
    found = F.array_compact(
        F.array(
            row("silent", (F.col("total") > 20) & (F.col("d14") == 0) & (F.col("d90") >= 30) & (F.col("d30") >= 5), F.col("d90")),
            row("null_dates", (F.col("fresh") > 3) & (F.col("fresh_null") > F.col("fresh") * 0.5), F.col("fresh_null")),
            row("stale", F.col("collection_method").isNotNull() & (F.col("last") < ts(as_of) - days(30)), F.datediff(ts(as_of), "last")),
            row("future_dates", F.col("future") > 0, F.col("future")),
        )
    )
    return per.select("member_id", F.explode(found).alias("x")).select("x.kind", "member_id", "x.observed")
