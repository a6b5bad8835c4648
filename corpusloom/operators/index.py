"""A full-text index that is kept up: each batch of releases becomes a segment, deletes and new versions hide what older segments say of a
release, and segments of one size are merged.

A folder holds

* ``postings-<name>``: (term, release_id, positions) of a segment, each file sorted by (term, release_id), so a search reads only its terms'
  pages of each,
* ``docs-<name>``: the releases that a segment covers,
* ``hidden-<name>``: (release_id, upto): what segments numbered ``upto`` and below say of a release no longer holds. A batch writes only
  the releases that older segments cover, so this table is as small as what changed since the last merge,
* ``versions``: one row for each live segment of each version of the index. A version is appended last and in one job, so a reader sees a
  batch or a merge as a whole or not at all; a batch that failed half-way left folders that no version names.

One writer at a time; any number of readers. The rows of ``versions`` that are collected are those of one version: a segment for each
batch since the last merge, FAN for each tier at most.

Cases: null titles and bodies are empty; a null id is left out; of rows with one id in a batch, all are indexed as one release (positions of
either); deleting what isn't there does nothing; an empty batch adds nothing; searching an index without segments finds nothing.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from itertools import takewhile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.english import lexemes
from ..sources.folders import exists
from . import fulltext

VERSION = "version long, number long, kind string, name string, postings long"
POSTINGS = "term string, release_id long, positions array<int>"
HIDDEN = "release_id long, upto long"
#: So many segments of one tier are merged; a tier holds segments of at least FAN times as many postings as the one below.
FAN = 4
#: Rows of hidden releases that are sent to every executor, at most; more are joined by a shuffle.
HIDDEN_AT_HAND = 2_000_000


def segments(spark: SparkSession, folder: str) -> tuple[int, list]:
    """(version, rows) of the newest version."""
    if not exists(spark, f"{folder}/versions"):
        return 0, []
    known = spark.read.schema(VERSION).parquet(f"{folder}/versions")
    last = known.agg(F.max("version")).first()[0]
    return last or 0, known.where(F.col("version") == F.lit(last)).orderBy("number").collect()


def publish(spark: SparkSession, folder: str, version: int, rows: list[tuple]) -> None:
    spark.createDataFrame([(version, *r) for r in rows] or [(version, 0, "none", "", 0)], VERSION).coalesce(1).write.mode("append").parquet(f"{folder}/versions")


def parts(spark: SparkSession, folder: str, rows: list, kind: str, schema: str) -> DataFrame | None:
    """The tables of one kind of these segments, with the number of each."""
    found = [spark.read.schema(schema).parquet(f"{folder}/{kind}-{r['name']}").withColumn("number", F.lit(r["number"])) for r in rows if r["kind"] == kind]
    out = None
    for df in found:
        out = df if out is None else out.union(df)
    return out


def counted(spark: SparkSession, folder: str, number: int, name: str) -> list[tuple]:
    """The rows of a version for a segment's tables."""
    return [(number, kind, name, spark.read.schema(schema).parquet(f"{folder}/{kind}-{name}").count()) for kind, schema in (("postings", POSTINGS), ("docs", "release_id long"), ("hidden", HIDDEN)) if kind != "hidden" or exists(spark, f"{folder}/{kind}-{name}")]


def apply_batch(folder: str, batch: DataFrame, deleted: DataFrame | None = None, analyze: Callable = lexemes) -> None:
    """Index a batch (release_id, title, body_text) and hide the releases in ``deleted`` (release_id). Applied twice, the second time hides
    the first."""
    spark = batch.sparkSession
    version, rows = segments(spark, folder)
    number, name = max((r["number"] for r in rows), default=0) + 1, uuid.uuid4().hex[:12]
    batch = batch.where("release_id is not null")
    fulltext.write_postings(batch, f"{folder}/postings-{name}", analyze)
    ids = batch.select(F.col("release_id").cast("long").alias("release_id")).distinct()
    ids.write.parquet(f"{folder}/docs-{name}")
    changed = ids if deleted is None else ids.union(deleted.select(F.col("release_id").cast("long"))).distinct()
    older = parts(spark, folder, rows, "docs", "release_id long")
    if older is not None:
        changed.join(older.select("release_id").distinct(), "release_id", "left_semi").select("release_id", F.lit(number - 1).cast("long").alias("upto")).write.parquet(f"{folder}/hidden-{name}")
    publish(spark, folder, version + 1, [tuple(r)[1:] for r in rows if r["kind"] != "none"] + counted(spark, folder, number, name))


def visible_rows(found: DataFrame, spark: SparkSession, folder: str, rows: list) -> DataFrame:
    """What the hidden releases of a version's ``rows`` leave of the rows of its segments. Few of them are broadcast, so no posting is shuffled."""
    hidden = parts(spark, folder, rows, "hidden", HIDDEN)
    if hidden is None:
        return found.drop("number")
    last = hidden.groupBy(F.col("release_id").alias("_id")).agg(F.max("upto").alias("_upto"))
    if sum(r["postings"] for r in rows if r["kind"] == "hidden") <= HIDDEN_AT_HAND:
        last = F.broadcast(last)
    return found.join(last, (F.col("release_id") == F.col("_id")) & (F.col("number") <= F.col("_upto")), "left_anti").drop("number")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(term, release_id, positions) as it holds now. A filter on terms reaches the scan of every segment."""
    _, rows = segments(spark, folder)
    found = parts(spark, folder, rows, "postings", POSTINGS)
    return spark.createDataFrame([], POSTINGS) if found is None else visible_rows(found, spark, folder, rows)


def merge_segments(folder: str, spark: SparkSession, fan: int = FAN) -> bool:
    """Merge the newest neighbouring segments of one tier and below, of the lowest tier of which there are ``fan`` or more. Returns whether there
    were. The merged segments' folders stay, since readers may hold an older version."""
    version, rows = segments(spark, folder)
    sizes = [r for r in rows if r["kind"] == "postings"]
    tier = lambda r: int(math.log(max(r["postings"], 1), fan))
    for top in sorted({tier(r) for r in sizes}):
        run = list(takewhile(lambda r, top=top: tier(r) <= top, reversed(sizes)))
        if len(run) >= max(2, fan):
            break
    else:
        return False
    numbers, name, last = [r["number"] for r in run], uuid.uuid4().hex[:12], max(r["number"] for r in run)
    merged = [r for r in rows if r["number"] in numbers]
    found = parts(spark, folder, merged, "postings", POSTINGS)
    most = max(spark.read.schema(POSTINGS).parquet(f"{folder}/postings-{r['name']}").rdd.getNumPartitions() for r in run)
    fulltext.write_sorted(visible_rows(found, spark, folder, rows).coalesce(max(most, 1)), f"{folder}/postings-{name}")
    visible_rows(parts(spark, folder, merged, "docs", "release_id long"), spark, folder, rows).distinct().write.parquet(f"{folder}/docs-{name}")
    rest = [r for r in rows if r["number"] not in numbers and r["kind"] != "none"]
    if any(r["kind"] == "postings" for r in rest):  # older segments are still to be hidden from, newer numbers there are none
        first = min(numbers)
        old = [r for r in merged if r["kind"] == "hidden"]
        if old:
            kept = parts(spark, folder, old, "hidden", HIDDEN)
            kept.groupBy("release_id").agg(F.lit(first - 1).cast("long").alias("upto")).write.parquet(f"{folder}/hidden-{name}")
    new = counted(spark, folder, last, name)
    publish(spark, folder, version + 1, [tuple(r)[1:] for r in rest] + new)
    return True
