"""Mixing sources to target weights by iterative proportional fitting.

One pass over the texts gives each document its encoded tokens and its topic; the rest works on that table. Documents are aggregated
to cells (source, language, topic) with their token counts. The cells' token weights are raked: scaled in turn to each
dimension's target shares until all of them hold. A document's probability is its cell's raked weight over its
cell's tokens, times one factor that is calibrated so that the expected tokens of the sample are the budget although no
probability exceeds 1. Sampling is by a hash of doc_id, so it repeats.

Targets are shares by value, given by the caller (values that are not named share the rest as they occur), or powers of the natural
shares. If raking does not meet them to within TOLERANCE in SWEEPS sweeps, given targets are an error and powers a warning
(they may contradict each other where cells are empty); ``marginals`` reports every target with what was reached.

Topics: where documents have no column ``topic``, k-means over the hashed, weighted token counts of all documents. The mean of a
document's language is taken off first, so a topic is no language. Counts are written once, and once what they are after weights and
means, as two bytes for each place; every step of the fit is a pass over these that brings one row of sums from each task. Sums are of
multiples of GRAIN and so exact: topics don't depend on how rows are dealt over tasks.

Only the cell table is iterated on. One of CELLS_AT_HAND rows at most, by its count, is raked in the driver's memory (it holds sums, no
documents); a larger one is raked by Spark, written every AT_ONCE sweeps, with equal results. Documents meet the cells'
probabilities in one join (broadcast by Spark only if the measured size of the cell table allows it).

Cases: null source, language or topic is a value of its own; null and empty texts have no tokens and the probability of their
cell (1 where the whole cell has no tokens); repeated rows share their hash and so their fate; an empty table gives no rows;
other columns are kept by ``sample_documents`` and left out by the query.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import discard, small_batches, table, take, vocabulary, written, written_at
from .frames import encode_texts, gathered

DIMENSIONS = ["source", "lang", "topic"]
#: Target shares: the natural share of each value to this power, normalised. 1 keeps the shares, 0 makes them equal.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
#: Expected tokens of the sample, as a share of all tokens.
BUDGET = 0.5
#: Most sweeps (a multiple of AT_ONCE, the sweeps between two writes of the cell table), and the shares' tolerance.
SWEEPS, AT_ONCE, TOLERANCE = 60, 2, 1e-4
#: Most rows of a cell table that the driver rakes.
CELLS_AT_HAND = 50_000
#: Topics, and places of the hashed token counts.
TOPICS, PLACES = 8, 512
#: Most passes that move the topics' centers; fewer if one lowers the mean squared distance by less than this share of it.
PASSES, SETTLED = 25, 1e-4
#: Languages with a mean of their own, the most frequent ones; the documents of all others have the mean of all taken off.
LANGUAGES = 255
#: What coordinates are multiples of: those from -1 to 1 are two bytes, and sums of them exact in doubles, in any order, for 2^38 documents.
GRAIN = 2.0**-14
#: Most bytes of tasks' sums that the driver adds up; more are added by Spark first, SUMS_AT_ONCE tasks' together.
BYTES_AT_HAND, SUMS_AT_ONCE = 8 << 20, 16
NONE = "(none)"


# ---------------------------------------------------------------- tokens and topics


def token_arrays(texts: pa.Array, path: str) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u4")[:-1] for b in encode_texts(texts, path, 0)]


def packed(ids: np.ndarray) -> bytes:
    """How many ids fall on each place, as the narrowest whole numbers that hold them."""
    counts = np.bincount(ids % PLACES, minlength=PLACES)
    return counts.astype(np.min_scalar_type(counts.max()).newbyteorder("<")).tobytes()


def unpacked(packs: list[bytes]) -> np.ndarray:
    """One row of counts for each of ``packs``."""
    width = len(packs[0]) // PLACES
    if all(len(p) == width * PLACES for p in packs):
        return np.frombuffer(b"".join(packs), f"<u{width}").reshape(-1, PLACES)
    return np.array([np.frombuffer(p, f"<u{len(p) // PLACES}") for p in packs], np.int64)


#: Memory of this worker that batches use in turn; new arrays of their size would each time be got from the system and cleared.
ROOM: dict[str, np.ndarray] = {}


def room(use: str, rows: int) -> np.ndarray:
    if use not in ROOM or len(ROOM[use]) < rows:
        ROOM[use] = np.empty((rows, PLACES))
    return ROOM[use][:rows]


def rounded(v: np.ndarray) -> np.ndarray:
    return np.rint(v * (1 / GRAIN)) * GRAIN


def grains(v: np.ndarray) -> np.ndarray:
    """The rows of ``v`` at length 1, in place, as whole numbers of GRAIN."""
    v *= (1 / GRAIN / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12))[:, None]
    return np.rint(v, out=v)


def nearest(v: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each row and the square of its distance."""
    d = np.einsum("ij,ij->i", v, v)[:, None] - v @ (2 * centers.T) + (centers**2).sum(1)
    at = d.argmin(1)
    return at, np.maximum(d[np.arange(len(d)), at], 0)


class Topics:
    """Weights of the places, the mean of each language (at None that of all documents), and the topics' centers."""

    #: Logarithms of one more than the usual counts.
    LOGS = np.log1p(np.arange(256.0))

    def __init__(self, weights: np.ndarray, means: dict | None = None, centers: np.ndarray | None = None):
        self.weights, self.means = weights, means or {None: np.zeros(PLACES)}
        self.centers = np.zeros((0, PLACES)) if centers is None else centers
        self.place = {x: i for i, x in enumerate(self.means)}
        self.rows = np.array(list(self.means.values()))

    def marks(self, langs: list[str | None]) -> np.ndarray:
        return np.array([self.place.get(x, self.place[None]) for x in langs])

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        """The weighted logarithms of rows of counts, as all rows here in ``room``: they last until the next batch."""
        v = room("v", len(counts))
        np.take(self.LOGS, counts, out=v, mode="clip") if counts.dtype.itemsize == 1 else np.log1p(counts, out=v)
        v *= self.weights
        return v

    def placed(self, counts: np.ndarray, langs: list[str | None]) -> np.ndarray:
        """Whole numbers of GRAIN."""
        v = self.weighted(counts)
        v *= (1 / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12))[:, None]
        v -= np.take(self.rows, self.marks(langs), axis=0, out=room("means", len(v)), mode="clip")
        return grains(v)

    def of(self, packs: list[bytes | None], langs: list[str | None]) -> list[str]:
        out, some = [NONE] * len(packs), [i for i, p in enumerate(packs) if p is not None]
        if some and len(self.centers):
            v = self.placed(unpacked([packs[i] for i in some]), [langs[i] for i in some])
            v *= GRAIN
            at, _ = nearest(v, self.centers)
            for i, t in zip(some, at.tolist(), strict=True):
                out[i] = f"topic {t}"
        return out


def of_all(rows: DataFrame, step: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...], add: Callable = np.add) -> np.ndarray:
    """``step`` of all batches of ``rows``, put together by ``add``: first in a task, then over tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total = add(total, step(b))
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for x in b.column(0).to_pylist():
                total = add(total, np.frombuffer(x).reshape(shape))
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts, tasks = rows.mapInArrow(run, "sums binary"), rows.rdd.getNumPartitions()
    while tasks * np.zeros(shape).nbytes > BYTES_AT_HAND and tasks > SUMS_AT_ONCE:
        tasks = -(-tasks // SUMS_AT_ONCE)
        parts = parts.repartition(tasks).mapInArrow(together, "sums binary")
    total = np.zeros(shape)
    for r in parts.collect():
        total = add(total, np.frombuffer(r.sums).reshape(shape))
    return total


def by_mark(marks: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each mark the sum of its rows of ``v``, with their number as the last column."""
    of = (marks == np.arange(n)[:, None]).astype(np.float64)
    return np.hstack([of @ v, of.sum(1)[:, None]])


def farther(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two (distance, row) that with the greater distance, and of equal ones the greater row."""
    return max(a, b, key=lambda x: x.tolist())


def counts_and_langs(b: pa.RecordBatch) -> tuple[np.ndarray, list]:
    return unpacked(b.column(0).to_pylist()), b.column(1).to_pylist()


def coordinates(b: pa.RecordBatch) -> np.ndarray:
    at = b.column(0)
    whole = np.frombuffer(at.buffers()[2], "<i2", len(at) * PLACES, 2 * PLACES * at.offset).reshape(-1, PLACES)
    return np.multiply(whole, GRAIN, out=room("v", len(whole)))


def fit_topics(rows: DataFrame, topics: int = TOPICS) -> Topics:
    """Topics of all documents, from their (counts, lang); those without tokens have no counts."""
    rows = small_batches(rows.where("counts is not null").select("counts", "lang"))

    def seen_in(b: pa.RecordBatch) -> np.ndarray:
        counts, _ = counts_and_langs(b)
        return np.append((counts > 0).sum(0), len(counts))

    seen = of_all(rows, seen_in, (PLACES + 1,))
    weights = np.log((1 + seen[-1]) / (1 + seen[:-1]))
    if not seen[-1]:
        return Topics(weights)
    langs = rows.where("lang <> ''").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    plain = Topics(weights, {x: np.zeros(PLACES) for x in [None, *[r.lang for r in langs]]})

    def sums_of(b: pa.RecordBatch) -> np.ndarray:
        counts, of = counts_and_langs(b)
        return by_mark(plain.marks(of), grains(plain.weighted(counts)), len(plain.means))

    sums = of_all(rows, sums_of, (len(plain.means), PLACES + 1))
    sums[:, :-1] *= GRAIN
    means = {x: s[:-1] / max(s[-1], 1) for x, s in zip(plain.means, sums, strict=True)} | {None: sums[:, :-1].sum(0) / seen[-1]}
    fitted = Topics(weights, means)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                whole = fitted.placed(*counts_and_langs(b)).astype("<i2")
                yield pa.record_batch([pa.array([x.tobytes() for x in whole], pa.binary())], ["v"])

    placed, at = written_at(rows.mapInArrow(place, "v binary"), "mixture-places")
    fitted.centers = centers_of(placed, topics, seen[-1])
    discard(at)
    return fitted


def centers_of(placed: DataFrame, k: int, n: float) -> np.ndarray:
    """k-means of the ``n`` rows of ``placed`` from farthest-first centers; fewer centers where there are fewer different rows."""
    def farthest(c: np.ndarray) -> np.ndarray:
        def step(b: pa.RecordBatch) -> np.ndarray:
            v = coordinates(b)
            away = nearest(v, c)[1]
            return max((np.append(away[i], v[i]) for i in np.flatnonzero(away == away.max())), key=lambda x: x.tolist())

        return of_all(placed, step, (PLACES + 1,), farther)

    def moved(c: np.ndarray) -> tuple[np.ndarray, float]:
        def step(b: pa.RecordBatch) -> np.ndarray:
            v = coordinates(b)
            at, away = nearest(v, c)
            return np.append(by_mark(at, v, len(c)), rounded(away).sum())

        total = of_all(placed, step, (len(c) * (PLACES + 1) + 1,))
        sums = total[:-1].reshape(-1, PLACES + 1)
        return np.where(sums[:, -1:] > 0, rounded(sums[:, :-1] / np.maximum(sums[:, -1:], 1)), c), total[-1] / n

    mean = rounded(of_all(placed, lambda b: coordinates(b).sum(0), (PLACES,)) / n)
    c = farthest(mean[None])[None, 1:]
    while len(c) < k and (far := farthest(c))[0] > 1e-12:
        c = np.vstack([c, far[1:]])
    before = np.inf
    for _ in range(PASSES):
        new, away = moved(c)
        if before - away <= SETTLED * away or np.array_equal(new, c):
            break
        c, before = new, away
    return c


def tagged(docs: DataFrame, path: str | None = None, topics: Topics | None = None, keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` in the shared folder: their columns (or those named by ``keep``) as c0, c1, ... by their places, with
    ``_topic`` (the column ``topic`` where there is one) and ``_n_tokens``."""
    path = path or vocabulary("word_bpe_49k.json")
    names = docs.columns
    text, lang = names.index("text"), names.index("lang")
    kept = [i for i, n in enumerate(names) if keep is None or n in keep]
    own = names.index("topic") if "topic" in names else None
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    last = ("_topic", "string") if own is not None else ("_counts", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            ids = token_arrays(b.column(text), path)
            of = b.column(own).cast(pa.string()) if own is not None else pa.array([packed(i) if len(i) else None for i in ids], pa.binary())
            yield pa.record_batch([*[b.column(i) for i in kept], of, pa.array(map(len, ids), pa.int64())], [*[f"c{i}" for i in kept], last[0], "_n_tokens"])

    schema = StructType([plain.schema.fields[i] for i in kept]).add(*last).add("_n_tokens", LongType())
    rows = small_batches(plain).mapInArrow(run, schema)
    if own is not None:
        return written(rows, "mixture-rows")
    rows, at = written_at(rows, "mixture-counts")
    named = F.col(f"c{lang}").cast("string")
    fitted = topics or fit_topics(rows.select(F.col("_counts").alias("counts"), named.alias("lang")))

    @F.arrow_udf("string")
    def topic(counts: pa.Array, of: pa.Array) -> pa.Array:
        return pa.array(fitted.of(counts.to_pylist(), of.to_pylist()), pa.string())

    out = written(rows.withColumn("_topic", topic("_counts", named)).drop("_counts"), "mixture-rows")
    discard(at)
    return out


def value(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NONE))


def keyed(docs: DataFrame, path: str | None = None, topics: Topics | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) of each row."""
    d = take(docs, "doc_id", "text", "source", "lang", *(["topic"] if "topic" in docs.columns else []))
    t = tagged(d, path, topics, ["doc_id", "source", "lang"])
    return t.select(F.col("c0").alias("doc_id"), value(F.col("c2")).alias("source"), value(F.col("c3")).alias("lang"), value(F.col("_topic")).alias("topic"), F.col("_n_tokens").alias("n_tokens"))


# ---------------------------------------------------------------- raking


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def natural_shares(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(value, share) of a dimension: natural shares to a power, normalised. A value without tokens has no share."""
    raised = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("t")).select(dimension, F.when(F.col("t") > 0, F.pow("t", F.lit(power))).otherwise(0.0).alias("r"))
    total = raised.agg(F.sum("r")).first()[0] or 1.0
    return raised.select(dimension, (F.col("r") / F.lit(total)).alias("share"))


def given_shares(cells: DataFrame, dimension: str, shares: dict[str, float]) -> DataFrame:
    """(value, share) of a dimension: the shares named, and for the other values what is left, as they occur."""
    left = 1.0 - sum(shares.values())
    if left < -1e-9 or min(shares.values(), default=0) < 0:
        raise ValueError(f"the target shares of {dimension} are negative or sum to more than 1")
    named = F.col(dimension).isin(list(shares))
    rest = cells.where(~named).agg(F.sum("tokens")).first()[0] or 0
    if left > 1e-9 and not rest:
        raise ValueError(f"the target shares of {dimension} sum to {1 - left} and no other value has tokens")
    of = F.create_map(*[F.lit(x) for kv in shares.items() for x in (kv[0], float(kv[1]))])[F.col(dimension)] if shares else F.lit(None).cast("double")
    return cells.groupBy(dimension).agg(F.sum("tokens").alias("t")).select(dimension, F.when(named, of).otherwise(F.col("t") * F.lit(max(left, 0.0) / max(rest, 1))).alias("share"))


def unmet(miss: float, sweeps: int, tolerance: float, strict: bool) -> None:
    if miss >= tolerance:
        said = f"raking misses a target share by {miss:.4f} after {sweeps} sweeps: the targets contradict each other where cells are empty"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=3)


def raked_at_hand(cells: DataFrame, dims: list[str], sweeps: int, tolerance: float) -> tuple[DataFrame, float]:
    """The sweeps of ``rake`` over a small cell table."""
    rows = cells.orderBy(*DIMENSIONS).collect()
    w, miss = np.array([r.weight for r in rows], float), 0.0
    marks = {d: np.unique([r[d] for r in rows], return_inverse=True)[1] for d in dims} if rows else {}
    shares = {d: np.array([r[f"_{d}"] for r in rows], float) for d in dims}
    for _ in range(sweeps if rows else 0):
        miss = 0.0
        for d in dims:
            held = np.bincount(marks[d], w)[marks[d]]
            miss = max(miss, float(np.abs(held - shares[d]).max()))
            w = np.where(held > 0, w * shares[d] / np.where(held > 0, held, 1.0), 0.0)
        if miss < tolerance:
            break
    new = [(*[r[c] for c in cells.columns if c != "weight"], float(x)) for r, x in zip(rows, w, strict=True)]
    schema = StructType([f for f in cells.schema.fields if f.name != "weight"]).add("weight", "double")
    return cells.sparkSession.createDataFrame(new, schema), miss


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE, strict: bool = True) -> DataFrame:
    """Adds ``weight``, which sums to 1 and has each target's shares to within ``tolerance``, and the targets as ``_source`` and so
    on. If they don't hold after ``sweeps`` that is an error, or with ``strict`` off a warning."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    now = cells
    for d, shares in targets.items():
        now = now.join(shares.withColumnRenamed("share", f"_{d}"), d, "left")
    now, at = written_at(now.withColumn("weight", F.col("tokens") / F.lit(float(total))), "cells")
    if now.count() <= CELLS_AT_HAND:
        now, miss = raked_at_hand(now, list(targets), sweeps, tolerance)
        discard(at)
        unmet(miss, sweeps, tolerance, strict)
        return now.select(*cells.columns, "weight", *[f"_{d}" for d in targets])
    miss = 0.0
    for _ in range(-(-sweeps // AT_ONCE)):
        for _ in range(AT_ONCE):
            here = F.lit(0.0)
            for d in targets:
                now = now.withColumn("_held", F.sum("weight").over(Window.partitionBy(d)))
                now = now.withColumn("_miss", F.greatest(here, F.abs(F.col("_held") - F.col(f"_{d}"))))
                now = now.withColumn("weight", F.when(F.col("_held") > 0, F.col("weight") * F.col(f"_{d}") / F.col("_held")).otherwise(0.0))
                here = F.col("_miss")
        before = at
        now, at = written_at(now, "cells")
        discard(before)
        miss = now.agg(F.max("_miss")).first()[0] or 0.0
        if miss < tolerance:
            break
        now = now.drop("_held", "_miss")
    unmet(miss, sweeps, tolerance, strict)
    return now.select(*cells.columns, "weight", *[f"_{d}" for d in targets])


def marginals(cells: DataFrame) -> DataFrame:
    """(dimension, value, target, reached) of raked cells."""
    dims = [d for d in DIMENSIONS if f"_{d}" in cells.columns]
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col(f"_{d}").alias("target")) for d in dims]))
    return cells.select(each.alias("x"), "weight").groupBy("x.dimension", "x.value").agg(F.max("x.target").alias("target"), F.sum("weight").alias("reached"))


def calibrate(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Adds ``probability``: min(1, factor * weight / tokens), with the factor for which the expected tokens are the budget."""
    rate = F.col("weight") / F.col("tokens")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    low, high = 0.0, 1.0
    expected = lambda f: F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(float(f)) * rate))
    some = cells.where("tokens > 0 and weight > 0")
    top = some.agg(F.max(F.lit(1.0) / rate), F.sum("tokens")).first()
    if top[0] is not None:
        high, want = float(top[0]), min(budget * total, float(top[1]))
        for _ in range(4):  # each pass over the cells narrows the factor 64 times
            points = [low + (high - low) * i / 64 for i in range(65)]
            sums = some.agg(*[expected(p) for p in points]).first()
            k = next((i for i, s in enumerate(sums) if s >= want), 64)
            low, high = points[max(0, k - 1)], points[k]
    return cells.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(high) * rate)).otherwise(1.0))


def plan(rows: DataFrame, powers: dict[str, float] | None = None, budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(source, lang, topic, tokens, docs, weight, probability) of each cell of ``rows`` (as ``keyed`` makes them), with the targets
    as _source, _lang, _topic. ``targets``: dimension -> value -> share; other dimensions follow ``powers``."""
    cells, at = written_at(cells_of(rows), "cells")
    targets, powers = targets or {}, POWERS if powers is None else powers
    shares = {d: given_shares(cells, d, targets[d]) if d in targets else natural_shares(cells, d, powers[d]) for d in DIMENSIONS if d in targets or d in powers}
    out = written(calibrate(rake(cells, shares, strict=bool(targets)), budget), "cell-probabilities")
    discard(at)
    return out


def marginals(plan: DataFrame) -> DataFrame:
    """(dimension, value, target, reached, miss) of the target shares of a plan: where targets contradict each other, raking can't
    reach them all, and this says by how much which are missed."""
    total = plan.agg(F.sum("weight").alias("total"))
    dims = [d for d in DIMENSIONS if f"_{d}" in plan.columns]
    each = plan.select("weight", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col(f"_{d}").cast("double").alias("target")) for d in dims])).alias("x")).select("x.*", "weight")
    sums = each.groupBy("dimension", "value").agg(F.max("target").alias("target"), F.sum("weight").alias("weight")).crossJoin(F.broadcast(total))
    return sums.select("dimension", "value", "target", (F.col("weight") / F.col("total")).alias("reached"), F.abs(F.col("weight") / F.col("total") - F.col("target")).alias("miss"))


def chosen(doc_id: Column, probability: Column, seed: int = 11) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)) < probability * float(1 << 52)


def sampled(docs: DataFrame, powers: dict[str, float] | None = None, budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, kept) of each row."""
    rows = keyed(docs)
    p = plan(rows, powers, budget, targets).select(*DIMENSIONS, "probability")
    return rows.join(p, DIMENSIONS).withColumn("kept", chosen(F.col("doc_id"), F.col("probability")))


def sample_documents(docs: DataFrame, powers: dict[str, float] | None = None, budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are in the sample."""
    names = docs.columns
    c = {n: F.col(f"c{names.index(n)}") for n in ("doc_id", "source", "lang")}
    rows = tagged(docs)
    keys = {"source": value(c["source"]), "lang": value(c["lang"]), "topic": value(F.col("_topic"))}
    p = plan(rows.select(*[k.alias(d) for d, k in keys.items()], F.col("_n_tokens").alias("n_tokens")), powers, budget, targets)
    p = p.select(*[F.col(d).alias(f"_{d}_") for d in DIMENSIONS], "probability")
    joined = rows.join(p, [k == F.col(f"_{d}_") for d, k in keys.items()])
    return joined.where(chosen(c["doc_id"], F.col("probability"))).select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


def op3_mixture_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(table(spark, sf_dir, "documents"))
