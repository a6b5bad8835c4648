"""Lookups and small reports over releases and members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import ACTIVITY_AS_OF, AS_OF, Tables, days, ts
from .stats import active, n, visible

# Name endings that are no family name.
NAME_SUFFIXES = ["jr", "sr", "ii", "iii", "iv"]


def family_name(full_name: Column) -> Column:
    """The last word of a name that isn't a suffix."""
    words = F.filter(F.split(F.trim(full_name), r"\s+"), lambda w: ~F.regexp_replace(F.lower(w), r"[.,]", "").isin(NAME_SUFFIXES))
    return F.regexp_replace(F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")), ",$", "")


def is_future_dated(published: Column, scraped: Column) -> Column:
    return F.coalesce(published > scraped + days(1), F.lit(False))


def state_coverage(t: Tables) -> DataFrame:
    """Per state and chamber: active members and their visible releases, zeros included."""
    per = visible(t.releases).groupBy("member_id").agg(n().alias("n"))
    m = active(t.members).join(per, "member_id", "left")
    return m.groupBy("state", "chamber").agg(n().alias("n_members"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_releases"))


def method_breakdown(t: Tables) -> DataFrame:
    return active(t.members).groupBy(F.coalesce("collection_method", F.lit("none")).alias("method")).agg(n().alias("n_members"))


def activity_intensity(t: Tables, floor: float = 0.25) -> DataFrame:
    """Each active member's releases on a logarithmic scale of its chamber's most active one, ``floor`` at least."""
    per = visible(t.releases).groupBy("member_id").agg(n().alias("n"))
    m = active(t.members).join(per, "member_id", "left").select("member_id", "chamber", F.coalesce("n", F.lit(0)).alias("n"))
    top = F.max("n").over(Window.partitionBy("chamber"))
    share = F.when(top > 0, F.log1p("n") / F.log1p(top)).otherwise(0.0)
    return m.select("member_id", "n", F.round(F.greatest(F.lit(floor), share), 6).alias("intensity"))


def edit_timing(t: Tables) -> DataFrame:
    """Versions by how long after the release they were captured."""
    v = t.versions.join(t.releases.select("release_id", "scraped_at"), "release_id")
    hours = (F.unix_timestamp(F.col("captured_at").cast("timestamp")) - F.unix_timestamp(F.col("scraped_at").cast("timestamp"))) / 3600
    bucket = F.when(hours < 1, "under an hour").when(hours <= 24, "a day").when(hours <= 168, "a week").otherwise("later")
    return v.groupBy(bucket.alias("bucket")).agg(n().alias("n"))


def ingest_cutoff(t: Tables, as_of: str = ACTIVITY_AS_OF, kind: str = "daily") -> DataFrame:
    """One row: the start of the last finished run of a kind, else a week before ``as_of``."""
    last = F.max(F.when((F.col("run_type") == kind) & F.col("finished_at").isNotNull(), F.col("started_at")))
    return t.runs.agg(F.coalesce(last, ts(as_of) - days(7)).alias("since"))


def since_cutoff(rows: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Rows published at the cut-off's day or later; rows without a date stay. ``cutoff`` is one row."""
    return rows.join(F.broadcast(cutoff)).where(F.col("published_at").isNull() | (F.to_date("published_at") >= F.to_date("since"))).drop("since")


def release_detail(t: Tables) -> DataFrame:
    """Releases with their member's party and state and the number of their versions."""
    v = t.versions.groupBy("release_id").agg(n().alias("v"))
    return t.releases.join(t.members.select("member_id", "party", "state"), "member_id").join(v, "release_id", "left").select("release_id", "member_id", "party", "state", F.coalesce("v", F.lit(0)).alias("n_versions"))


def stalest(t: Tables, k: int = 20) -> DataFrame:
    """The k active members whose last visible release is longest ago; those without one come first, with 0 releases."""
    per = visible(t.releases).groupBy("member_id").agg(n().alias("n"), F.max("published_at").alias("last"))
    return active(t.members).join(per, "member_id", "left").orderBy(F.asc_nulls_first("last"), "member_id").limit(k).select("member_id", F.coalesce("n", F.lit(0)).alias("n"), F.to_date("last").alias("last_day"))


def carried_dates(t: Tables) -> DataFrame:
    """(release_id, day): each release's day, or that of the member's nearest earlier release (by id) that has one."""
    w = Window.partitionBy("member_id").orderBy("release_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.releases.select("release_id", F.to_date(F.last("published_at", ignorenulls=True).over(w)).alias("day"))


def with_ancestors(sections: DataFrame) -> DataFrame:
    """(section, ancestor): each section cut at every slash, itself included."""
    parts = F.split(F.rtrim(F.col("section"), F.lit("/")), "/")
    return sections.select("section", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))).alias("ancestor"))


def untapped_sections(sections: DataFrame, collected: DataFrame) -> DataFrame:
    """Sections (``section``) that neither are, nor lie below or above, a collected one. Cutting each into its ancestors makes
    both prefix tests equi-joins."""
    below = with_ancestors(sections).join(collected.select(F.col("section").alias("ancestor")).distinct(), "ancestor", "left_semi").select("section")
    above = with_ancestors(collected.where("section <> ''")).select(F.col("ancestor").alias("section"))
    return sections.join(below.unionByName(above).distinct(), "section", "left_anti")
