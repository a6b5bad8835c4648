"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabularies are; every operator that needs one takes the path as a parameter.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")

#: Rows of one Arrow batch. Long texts make large batches, so it is small.
BATCH_ROWS = 256


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file: from ``folder``, else from the installed package, else from TOKENIZERS."""
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = TOKENIZERS
    return os.path.join(folder, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def take(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns. Other columns, whatever their names or their case, can't make a name ambiguous."""
    have = df.columns
    place = {n: have.index(n) for n in names}
    return df.toDF(*[f"c{i}" for i in range(len(have))]).select(*[F.col(f"c{i}").alias(n) for n, i in place.items()])


#: Folders that this process made below the shared folder; what is left of them goes when it ends.
SCRATCH: dict[str, SparkSession] = {}


def checkpoint_base(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else the context's checkpoint folder. A folder of this machine stands in only
    where the master is local (tests); elsewhere executors and driver would not see the same files, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and every executor share")
    base = "file://" + os.path.join(tempfile.gettempdir(), "corpusloom-shared")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and every executor see. It lasts until ``discard`` or the end of this process."""
    path = f"{checkpoint_base(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    SCRATCH[path] = spark
    return path


def discard(*paths: str | None) -> None:
    """Delete folders of ``shared_dir`` whose rows nothing reads any more."""
    for path in paths:
        spark = SCRATCH.pop(path, None) if path else None
        if spark is not None:
            with suppress(Exception):  # a folder that can't be deleted must not fail the job
                jvm = spark._jvm
                to = jvm.org.apache.hadoop.fs.Path(path)
                to.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(to, True)


@atexit.register
def discard_all() -> None:
    discard(*SCRATCH)


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written`` and the folder, for ``discard``."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here, so a lost executor repeats little."""
    return written_at(df, name)[0]


#: A key is hot if more than this share of the rows have it, so there are at most 1 / HOT_SHARE hot keys in any table.
HOT_SHARE = 1 / 256
#: Parts that a hot key's rows are dealt to.
SALTS = 64


def hot_keys(counts: DataFrame, key: str, n: str, total: int | None = None) -> list:
    """The keys of ``counts`` (one row for each, with its number of rows ``n``) that hold more than HOT_SHARE of all rows: 255
    at most, by the pigeonhole principle."""
    if total is None:
        total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) > F.lit(total * HOT_SHARE)).select(key).collect()]


def salted_join(rows: DataFrame, one: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``one``, which has each key once. Rows of a ``hot`` key are dealt to SALTS parts, and only the row of
    ``one`` with such a key is repeated, so no task gets all rows of a frequent key."""
    if not hot:
        return rows.join(one, key, how)
    is_hot = F.col(key).isin(hot)
    by = F.xxhash64(*[c for c in rows.columns if c != key])
    rows = rows.withColumn("_salt", F.when(is_hot, F.pmod(by, F.lit(SALTS)).cast("int")).otherwise(0))
    one = one.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return rows.join(one, [key, "_salt"], how).drop("_salt")


def hash_sample(docs: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows of ``docs``, all if it has no more: those whose 64-bit hash of ``key`` is in the lowest part of its range. The
    part is computed in whole numbers, so it doesn't come out as nothing for any number of rows."""
    n = docs.count()
    if n <= most:
        return docs
    return docs.where(F.xxhash64(key) < F.lit(most * 2**64 // n - 2**63))


class Remembered(dict):
    """What a worker remembers, as two generations of at most ``limit`` bytes each: when the younger one is full it takes the older
    one's place."""

    #: Bytes that an entry takes besides its contents, about.
    ENTRY = 200

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.held = limit, 0
        self.older: dict = {}

    def clear(self) -> None:
        super().clear()
        self.held, self.older = 0, {}

    def keep(self, key, value, size: int):
        size += self.ENTRY
        if self.held + size > self.limit:
            older = dict(self)
            self.clear()
            self.older = older
        self.held += size
        self[key] = value
        return value


#: The operator whose tables this Python worker holds, and how it forgets them.
HOLDER: list = ["", None]


def holding(name: str, forget: Callable[[], object] | None = None) -> None:
    """Said by a task that begins the work of ``name``. Spark uses a worker again for later stages, so what another operator
    remembered there would stay beside this one's; it is forgotten, and freed memory goes back to the system."""
    if HOLDER[0] == name:
        return
    if HOLDER[1] is not None:
        HOLDER[1]()
    HOLDER[:] = name, forget
    pa.default_memory_pool().release_unused()


def small_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """Have Python workers get rows in small batches; texts may be long. Spark has this setting for a session only, so later
    queries of the session get small batches too; their results are the same."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys`` as one table each; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
        start = 0
        for i, mark in enumerate(marks):
            if mark != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, mark
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
