"""Incremental operators: upsert with versions, insert-ignore, tombstones. The same functions serve batches and foreachBatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.tables import Tables

GONE = (404, 410)


def latest_of_batch(batch: DataFrame) -> DataFrame:
    """One row for each url of a batch: the last by hash order, so that a replay picks the same."""
    w = Window.partitionBy("url").orderBy("content_hash", "title")
    return batch.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(target: DataFrame, batch: DataFrame) -> DataFrame:
    """(url, title, body_text, content_hash, outcome, prior_body, prior_hash) of each url of a batch.

    ``inserted``: new. ``updated``: both hashes are known and differ; the prior body goes to the versions. ``touched``: seen
    again. Applied twice, the second time everything is touched."""
    old = target.select("url", F.col("body_text").alias("prior_body"), F.col("content_hash").alias("prior_hash"), F.lit(True).alias("_known"))
    b = latest_of_batch(batch).join(old, "url", "left")
    known = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    outcome = F.when(F.col("_known").isNull(), "inserted").when(known("content_hash") & known("prior_hash") & (F.col("content_hash") != F.col("prior_hash")), "updated").otherwise("touched")
    return b.withColumn("outcome", outcome).drop("_known")


def applied(target: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The target after an upsert: updated rows replaced, inserted ones added."""
    changed = outcomes.where("outcome <> 'touched'").select(target.columns)
    return target.join(changed.select("url"), "url", "left_anti").select(target.columns).unionByName(changed)


def archived(outcomes: DataFrame) -> DataFrame:
    """The version rows that an upsert adds."""
    return outcomes.where("outcome = 'updated'").select("url", F.col("prior_body").alias("body_text"), F.col("prior_hash").alias("content_hash"))


def insert_ignore(target: DataFrame, batch: DataFrame) -> DataFrame:
    return batch.dropDuplicates(["url"]).join(target.select("url"), "url", "left_anti")


def tombstones(checks: DataFrame) -> DataFrame:
    """(url, gone) of the urls with a 404 or 410 followed by three equal such checks; anything else in between starts anew."""
    w = Window.partitionBy("url").orderBy("checked_at", "page_id")
    s, before = F.col("status"), [F.lag("status", i).over(w) for i in (1, 2, 3)]
    gone = s.isin(*GONE) & (before[0] == s) & (before[1] == s) & before[2].isin(*GONE)
    return checks.withColumn("gone", gone).groupBy("url").agg(F.bool_or("gone").alias("gone")).where("gone")


def restored(tombs: DataFrame, checks: DataFrame) -> DataFrame:
    """Tombstoned urls whose newest check found them live."""
    last = checks.groupBy("url").agg(F.max_by("status", F.struct("checked_at", "status")).alias("status"))
    return tombs.join(last, "url").where("status = 200").select("url")


def append_probes(probes: DataFrame, path: str, run_id: str) -> None:
    """Append a run's probes to the log, in a folder for the run and folders for days below it. A run that is repeated replaces its own rows, so
    each counts once."""
    days = probes.withColumn("day", F.to_date("checked_at"))
    days.write.mode("overwrite").partitionBy("day").parquet(f"{path}/run_id={run_id}")


def newest_probes(log: DataFrame, since: str) -> DataFrame:
    """The newest probe of each member from a day on; only the folders of those days are read. Ties go to the larger probe_id."""
    names = [c for c in log.columns if c not in ("member_id", "day", "run_id")]
    rows = log.where(F.col("day") >= F.lit(since).cast("date"))
    return rows.groupBy("member_id").agg(F.max_by(F.struct(*names), F.struct("checked_at", "probe_id")).alias("x")).select("member_id", "x.*")


def edited_batch(t: Tables) -> DataFrame:
    """A batch derived from the releases: every second one, a third of them under a new url, a fifth edited."""
    hash_ = C.content_hash(F.col("body_text"))
    i = F.col("release_id")
    return t.releases.where(i % 2 == 0).select(
        F.when(i % 3 == 0, i + 1000000000).otherwise(i).alias("url"), "title", "body_text", F.when(i % 5 == 0, F.sha2(hash_, 256)).otherwise(hash_).alias("content_hash")
    )
