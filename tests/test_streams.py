"""Expiring state against the batch form, and a compacted change log against one that never is."""

import datetime
import random

import pytest

from corpusloom.operators import ingest
from corpusloom.streaming import streams

CHECKS = "url string, status int, checked_at timestamp, page_id long"


def minute(i):
    return datetime.datetime(2026, 4, 25) + datetime.timedelta(minutes=i)


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(streams.ROCKSDB[0], None)
    spark.conf.set(*streams.ROCKSDB)
    yield spark
    spark.conf.set(streams.ROCKSDB[0], old) if old else spark.conf.unset(streams.ROCKSDB[0])


def collected(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    q.processAllAvailable()
    rows = spark.sql(f"select * from {name}").collect()
    q.stop()
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_expiring_state_equals_the_batch(rocks, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"u{rng.randrange(12)}", rng.choice([404, 404, 404, 410, 200]), minute(i), 0) for i in range(150)]
    for k in range(3):
        rocks.createDataFrame(rows[k * 50 : k * 50 + 50], CHECKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rocks.createDataFrame([("u1", None, minute(0), 0), ("u2", 404, None, 0)], CHECKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema(CHECKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    want = {r.url for r in ingest.tombstones(rocks.createDataFrame(rows, CHECKS)).collect()}
    assert {r.url for r in collected(rocks, streams.gone_urls_expiring(stream), f"gone_{seed}", tmp_path)} == want and want


def test_state_expires(rocks, tmp_path):
    batches = [[("a", 404, minute(0)), ("b", 404, minute(0))], [("x", 200, minute(3 * 1440))], [("x", 200, minute(3 * 1440 + 1))], [("a", 404, minute(3 * 1440 + k)) for k in (2, 3, 4)]]
    for rows in batches:
        rocks.createDataFrame([(*r, 0) for r in rows], CHECKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema(CHECKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # The failure of three days ago is forgotten after one day, so three more are not enough; they are where state is kept.
    assert collected(rocks, streams.gone_urls_expiring(stream, idle=86400), "forgotten", tmp_path) == []
    assert {r.url for r in collected(rocks, streams.gone_urls_expiring(stream, idle=30 * 86400), "kept", tmp_path)} == {"a"}


def test_compacted_log_equals_the_whole_log(spark, tmp_path):
    rng, source = random.Random(4), str(tmp_path / "in")
    logs = {every: str(tmp_path / f"log{every}") for every in (2, 1000)}
    for step in range(5):
        rows = [(f"u{rng.randrange(8)}", "t", f"body {step} {rng.randrange(3)}", f"h{step}{rng.randrange(3)}") for _ in range(5)]
        spark.createDataFrame(rows, streams.LOG).dropDuplicates(["url"]).coalesce(1).write.mode("append").parquet(source)
        for every, log in logs.items():
            q = streams.upsert_stream(spark.readStream.schema(streams.LOG).parquet(source), log, f"{log}-versions", f"{log}-cp", every).start()
            q.processAllAvailable()
            q.stop()
    tables = {every: sorted(map(tuple, streams.current(spark, log).collect())) for every, log in logs.items()}
    assert tables[2] == tables[1000] and len(tables[2]) > 3
    versions = {every: sorted(tuple(r) for r in spark.read.parquet(f"{log}-versions").select("url", "body_text").collect()) for every, log in logs.items()}
    assert versions[2] == versions[1000]
    # Reads are bounded: a snapshot and the batches after it.
    assert streams.newest_snapshot(spark, logs[2])[0] == 3 and streams.newest_snapshot(spark, logs[1000]) is None
    assert not any(f"batch_id={k}" in f for f in streams.current(spark, logs[2]).inputFiles() for k in range(4)) or "PartitionFilters: [isnotnull(batch_id" in streams.current(spark, logs[2])._jdf.queryExecution().toString()
    # A replay of a batch sees what it saw first; a broken compaction leaves folders that nothing reads.
    assert sorted(map(tuple, streams.current(spark, logs[2], 2).collect())) == sorted(map(tuple, streams.current(spark, logs[1000], 2).collect()))
    streams.current(spark, logs[2]).where("url = 'u1'").write.parquet(f"{logs[2]}-snapshot-4-broken")
    assert sorted(map(tuple, streams.current(spark, logs[2]).collect())) == tables[2]
    streams.compact(spark, logs[2], 4)
    streams.compact(spark, logs[2], 4)
    assert sorted(map(tuple, streams.current(spark, logs[2]).collect())) == tables[2]
