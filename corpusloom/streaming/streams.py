"""The incremental operators over streams. State is bounded by watermarks or by the number of addresses that fail at the moment."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import ingest
from ..sources.folders import exists

LOG = "url string, title string, body_text string, content_hash string"


def activity_windows(events: DataFrame, late: str = "7 days", size: str = "1 day") -> DataFrame:
    """(content_type, day, n) of tumbling windows by ``published_at``; rows later than ``late`` no longer count."""
    w = events.withWatermark("published_at", late).groupBy("content_type", F.window("published_at", size)).agg(F.count(F.lit(1)).alias("n"))
    return w.select("content_type", F.to_date("window.start").alias("day"), "n")


def first_seen(items: DataFrame, within: str = "30 days") -> DataFrame:
    """Each address once within a span of ``published_at``."""
    return items.withWatermark("published_at", within).dropDuplicatesWithinWatermark(["url"])


def gone_urls(checks: DataFrame, agree: int = 3) -> DataFrame:
    """(url, status, checked_at) when an address that failed with 404 or 410 fails ``agree`` more times with one and the same code.

    State for each failing address: its last code and the length of its run; any other answer removes it. Checks of one batch
    are taken in the order of ``checked_at``."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(frames)).sort_values("checked_at")
        code, equal, hits = state.get if state.exists else (0, 0, 0)
        found = []
        for status, at in zip(seen["status"], seen["checked_at"], strict=True):
            if status not in ingest.GONE:
                code, equal, hits = 0, 0, 0
                continue
            equal, hits, code = (equal + 1 if status == code else 1), hits + 1, int(status)
            # A hit before the agreeing ones; it may have had the other code.
            if equal >= agree and hits > agree:
                found.append((key[0], code, at))
        if hits:
            state.update((code, equal, hits))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(found, columns=["url", "status", "checked_at"])

    return checks.select("url", "status", "checked_at").groupBy("url").applyInPandasWithState(step, "url string, status int, checked_at timestamp", "code int, same int, hits int", "append", GroupStateTimeout.NoTimeout)


class GoneAddresses(StatefulProcessor):
    """Typed state of each failing address: its last code, the length of that code's run, all failures, and when it was last checked. Any other
    answer clears it; so does a timer, if an address isn't checked again for ``idle`` seconds of event time."""

    def __init__(self, agree: int, idle: int):
        self.agree, self.idle = agree, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "code int, same int, hits int, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        code, same, hits, last = self.run.get() if self.run.exists() else (0, 0, 0, 0)
        seen = sorted((at, int(status)) for frame in rows for at, status in zip(frame["checked_at"], frame["status"], strict=True) if pd.notna(at) and pd.notna(status))
        found = []
        for at, status in seen:
            last = max(last, int(at.timestamp() * 1000))
            if status not in ingest.GONE:
                code, same, hits = 0, 0, 0
                continue
            same, hits, code = (same + 1 if status == code else 1), hits + 1, status
            if same >= self.agree and hits > self.agree:
                found.append((key[0], code, at))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if hits:
            self.run.update((code, same, min(hits, self.agree + 1), last))
            self.handle.registerTimer(last + self.idle * 1000)
        elif self.run.exists():
            self.run.clear()
        yield pd.DataFrame(found, columns=["url", "status", "checked_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.run.clear()
        yield pd.DataFrame([], columns=["url", "status", "checked_at"])

    def close(self) -> None:
        pass


def gone_urls_expiring(checks: DataFrame, agree: int = 3, late: str = "1 day", idle: int = 30 * 86400) -> DataFrame:
    """``gone_urls`` with state that expires: an address that isn't checked for ``idle`` seconds is forgotten, so state holds no more than the
    addresses that failed within that time. Checks without time or status count for nothing; those later than ``late`` are dropped.

    Needs the session's state store to be RocksDB (``ROCKSDB``)."""
    rows = checks.select("url", "status", "checked_at").withWatermark("checked_at", late)
    return rows.groupBy("url").transformWithStateInPandas(GoneAddresses(agree, idle), "url string, status int, checked_at timestamp", "append", "eventTime")


#: The setting that ``gone_urls_expiring`` needs.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Batches of a change log after which it is merged into a snapshot.
SNAPSHOT_EVERY = 16
ENTRY = "snapshot long, folder string"


def newest_snapshot(spark: SparkSession, log: str, before: int | None = None) -> tuple[int, str] | None:
    """(last batch, folder) of the newest snapshot of a change log, below ``before`` if that is given. A snapshot is known by a row that is
    written after it is complete."""
    if not exists(spark, f"{log}-snapshots"):
        return None
    known = spark.read.schema(ENTRY).parquet(f"{log}-snapshots")
    known = known if before is None else known.where(F.col("snapshot") < before)
    last = known.agg(F.max(F.struct("snapshot", "folder")).alias("x")).first()["x"]
    return (last["snapshot"], last["folder"]) if last else None


def current(spark: SparkSession, log: str, before: int | None = None) -> DataFrame:
    """The newest row of each address of a change log, of batches below ``before`` if that is given: the newest snapshot and the batches since,
    whose folders are all that is read."""
    known = newest_snapshot(spark, log, before)
    rows = spark.read.schema(f"{LOG}, batch_id long").parquet(log)
    if before is not None:
        rows = rows.where(F.col("batch_id") < before)
    if known:
        rows = rows.where(F.col("batch_id") > known[0]).unionByName(spark.read.schema(LOG).parquet(known[1]).withColumn("batch_id", F.lit(known[0])))
    names = [c.split()[0] for c in LOG.split(", ")]
    return rows.groupBy("url").agg(F.max_by(F.struct(*names[1:]), "batch_id").alias("x")).select("url", "x.*")


def compact(spark: SparkSession, log: str, through: int) -> None:
    """Merge the batches up to ``through`` and the snapshot before them into a new snapshot. Done twice, or begun and broken off, it leaves
    the same rows; folders that no entry names are never read."""
    folder = f"{log}-snapshot-{through}-{uuid.uuid4().hex[:8]}"
    current(spark, log, through + 1).write.parquet(folder)
    spark.createDataFrame([(through, folder)], ENTRY).coalesce(1).write.mode("append").parquet(f"{log}-snapshots")


def upsert_stream(items: DataFrame, log: str, versions: str, checkpoint: str, snapshot_every: int = SNAPSHOT_EVERY) -> DataStreamWriter:
    """Writes inserted and updated rows to a change log and prior bodies to the versions, one folder for each batch, overwritten if
    the batch is replayed; a batch only sees the log of earlier batches, so a replay gives the same outcome. Every ``snapshot_every`` batches the log so far is
    merged into a snapshot, so a batch reads a snapshot and fewer than so many folders.

    items: url, title, body_text, content_hash."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = current(spark, log, batch_id) if batch_id else spark.createDataFrame([], LOG)
        found = ingest.upsert(before, batch.select("url", "title", "body_text", "content_hash"))
        changed = found.where("outcome <> 'touched'").select("url", "title", "body_text", "content_hash")
        ingest.archived(found).write.mode("overwrite").parquet(f"{versions}/batch_id={batch_id}")
        changed.write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")
        if (batch_id + 1) % snapshot_every == 0:
            compact(spark, log, batch_id)

    return items.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
