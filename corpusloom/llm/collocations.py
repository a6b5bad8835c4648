"""Phrase collocation mining by dynamic itemset counting.

The corpus is dealt to SHARDS shards of equal rows (as the hashes of their words, written once), which are scanned in a cycle, one a step. All words are counted from the
first step on. A longer phrase becomes active as soon as both its subphrases (without its last, without its first word) have
reached the threshold, in whatever step that happens; so lengths are interleaved, and pairs and triples are counted while words
still are. A phrase is counted for one full cycle from the step after that, and is complete then. Scans end when no
phrase is open, after at most one cycle for each length.

* While phrases are mined, a phrase is its 64-bit hash. Which subphrases have reached the threshold, and which did so within the last
  cycle, is told to the scanning tasks by two bitmaps of hashes, of BITMAP_BITS bits whatever the corpus. An occurrence is counted if both
  subphrases are in the first and one of them is in the second. A wrong bit only makes a phrase be counted too early or too long.
* Each step writes (hash, count) of some megabytes at a time. Of a hash the part of its range and the low 32 bits are kept; the number of parts
  grows with the corpus, so that few hashes are taken for equal. Counts of the last SHARDS steps are summed for each hash: that window
  has each shard once, so at the end of a phrase's cycle the sum is its true count, and more only where hashes are equal. So no frequent phrase is missed.
* One last scan settles the phrases found: their occurrences are counted by their words, which leaves out those that only a shared hash or a
  wrong bit let pass, so counts are exact.

Scores, cuts and the rule on longer phrases then need only joins of frequent phrases with frequent phrases; frequent first or last
words are dealt to salted parts, arithmetic is done in decimals of 38 digits.

Cases: null and empty texts have no words; a null lang is ``und``; repeated rows count each time; ties are ordered by count, then
phrase in UTF-8 byte order; an empty table gives no rows; texts of any length are read whole, phrases never cross texts
or pieces; other columns are left out.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, SALTS, discard, grouped, holding, hot_keys, salted_join, shared_dir, small_batches, table, take, written, written_at
from .neardup import C1, HASHES, mix

#: Shards of a cycle.
SHARDS = 2
#: Occurrences of a frequent phrase, and words of the longest ones.
LEAST, LONGEST = 30, 4
#: Phrases of a lang in the report.
REPORTED = 2000
#: Share in percent of a phrase's occurrences that lie in one longer phrase and make it superfluous.
COVERED = 80
#: Bits of a bitmap of phrases; a bound on what is broadcast.
BITMAP_BITS = 1 << 26
#: Bytes of text, and of words' hashes, that are counted together.
TEXT_BYTES, HASH_BYTES = 6 << 20, 8 << 20

#: Words of the corpus for each part of the range of hashes; a task sums the counts of a part at a time.
SUMMED = 1_000_000
PACKED = "part int, hash binary, n binary"
DECIMAL = "decimal(38,0)"
#: The last two bits of a phrase's hash hold its number of words less one.
SIZE_BITS = np.uint64(3)


def has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def factorized(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each value in order of first occurrence, first position of each number)."""
    codes = pc.dictionary_encode(pa.array(key)).indices.to_numpy()
    first = np.empty(codes.max() + 1 if len(codes) else 0, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, first


def words_of(langs: pa.Array, texts: pa.Array):
    """Of the words of these texts in a row, with an empty one at least between pieces: (ids, texts' ends, names, homes), where ids are numbers
    from 0 and -1 for the empty ones, and names and homes the word and the lang of each id."""
    # "." stands for the end of a piece. No word holds one.
    text = pc.replace_substring_regex(pc.ascii_lower(texts.cast(pa.large_string())), r"[.,;:!?\x0A-\x0D]+", " . ")
    parts = pc.ascii_split_whitespace(text)
    coded = parts.flatten().dictionary_encode()
    vocabulary, at = coded.dictionary, coded.indices.to_numpy()
    lang = langs.dictionary_encode()
    ends = parts.offsets.to_numpy()
    empty = pc.is_in(vocabulary, pa.array([".", ""], vocabulary.type)).to_numpy(zero_copy_only=False)[at]
    of = np.repeat(lang.indices.to_numpy(), np.diff(ends)).astype(np.int64)
    ids, first = factorized(np.where(empty, -1, of * len(vocabulary) + at))
    if empty.any():  # the number of the empty ones goes to the end and becomes -1
        none = ids[empty.argmax()]
        ids = np.where(ids == none, -1, ids - (ids > none))
        first = np.delete(first, none)
    return ids, ends, vocabulary.take(pa.array(at[first])).cast(pa.string()), lang.dictionary.take(pa.array(of[first]))


def hashes_of(names: pa.Array, homes: pa.Array) -> np.ndarray:
    """The hash of each word; it depends on the lang, and is never 0."""
    holding("collocations", HASHES.clear)
    lang = homes.dictionary_encode()
    seeds = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in lang.dictionary.to_pylist()], np.uint64)
    words = np.fromiter(map(HASHES.__getitem__, names.to_pylist()), np.uint64, len(names))
    return np.maximum(mix(words ^ seeds[lang.indices.to_numpy()]) & ~SIZE_BITS, np.uint64(4))


def hashed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of each text's words, 0 between pieces, as bytes of unsigned 64-bit integers, and how many they are."""
    for b in blocks(batches, TEXT_BYTES):
        ids, ends, names, homes = words_of(b["lang"], b["text"])
        values = pa.py_buffer(np.append(hashes_of(names, homes), np.uint64(0))[ids])
        for k in range(0, len(ends) - 1, BATCH_ROWS):
            at = ends[k : k + BATCH_ROWS + 1].astype(np.int64)
            part = pa.py_buffer(np.asarray(at - at[0], np.int32) * 8)
            yield pa.record_batch([pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, part, values.slice(at[0] * 8, (at[-1] - at[0]) * 8)]), pa.array(np.diff(at))], ["words", "n_words"])


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict[str, pa.Array]]:
    """The columns of the batches, ``size`` bytes at a time."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield {c: x.combine_chunks() for c, x in zip(b.schema.names, pa.Table.from_batches(held).columns, strict=True)}
            held, n = [], 0
            pa.default_memory_pool().release_unused()
    if n:
        yield {c: x.combine_chunks() for c, x in zip(held[0].schema.names, pa.Table.from_batches(held).columns, strict=True)}


def phrases(words: np.ndarray, ends: np.ndarray, reached: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, begin, hash, marked) for each size, of word hashes in a row: the phrases whose subphrases are all marked by the bitmap, and
    at which words marked ones of that size begin."""
    begin, n = np.flatnonzero(words), len(words)
    follows = np.ones(n + 1, bool)  # whether a word is of the same text as the one before
    follows[ends] = False
    h = words[begin]
    for size in range(1, LONGEST + 1):
        marked = np.zeros(n + 1, bool)
        marked[begin] = has(reached, h)
        yield size, begin, h, marked
        whole = np.zeros(n, np.uint64)
        whole[begin] = h
        begin = np.flatnonzero(marked[:n] & marked[1:] & follows[1:])
        h = mix(whole[begin] * C1 + words[begin + size]) & ~SIZE_BITS | np.uint64(size)


def packed(h: np.ndarray, n: np.ndarray, parts: int) -> pa.RecordBatch:
    """Hashes with their counts as one row for each part of the range of hashes: (part, hash, n), the latter as bytes of unsigned 32-bit
    integers: a part and the low half of a hash stand for the hash. Millions of counts are then some rows to write and shuffle."""
    part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    present, start = np.unique(part[order], return_index=True)
    edges = [*(4 * start).tolist(), 4 * len(h)]

    def cut(x: np.ndarray) -> pa.Array:
        raw = x[order].astype(np.uint32).tobytes()
        return pa.array([raw[i:j] for i, j in zip(edges, edges[1:], strict=False)], pa.binary())

    return pa.record_batch([pa.array(present), cut(h), cut(n)], ["part", "hash", "n"])


def active_phrases(batches: Iterator[pa.RecordBatch], reached: np.ndarray, recent: np.ndarray, all_words: bool, parts: int) -> Iterator[pa.RecordBatch]:
    """Counts of the active phrases, and of all words if ``all_words``, ``packed``."""
    holding("collocations", HASHES.clear)
    for b in blocks(batches, HASH_BYTES):
        words, new, counted = np.frombuffer(b"".join(b["words"].to_pylist()), np.uint64), None, []
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(b["words"]).to_numpy() // 8)])
        for size, begin, h, _ in phrases(words, ends, reached):
            counted.append((h if all_words else h[:0]) if size == 1 else h[new[begin] | new[begin + 1]])
            new = np.zeros(len(words) + 1, bool)
            new[begin] = has(recent, h)
        found = pc.value_counts(pa.array(np.concatenate(counted)))
        yield packed(found.field(0).to_numpy(), found.field(1).to_numpy(), parts)


def reaching(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The hashes whose counts sum to ``least`` or more, ``packed``; those that come without counts are known and left out. Rows come sorted
    by part."""
    values = lambda x: np.frombuffer(b"".join(x.drop_null().to_pylist()), np.uint32)
    for t in grouped(batches, ["part"]):
        counts = t.filter(pc.is_valid(t["n"]))
        sums = pa.table({"h": values(counts["hash"]), "n": values(counts["n"])}).group_by("h", use_threads=False).aggregate([("n", "sum")])
        h = sums["h"].to_numpy()[sums["n_sum"].to_numpy() >= least]
        fresh = h[~np.isin(h, values(t.filter(pc.is_null(t["n"]))["hash"]))]
        yield pa.record_batch([t["part"].slice(0, 1).combine_chunks(), pa.array([fresh.tobytes()], pa.binary()), pa.nulls(1, pa.binary())], ["part", "hash", "n"])


def bits_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(word, bits, size) of a bitmap of ``width`` bits for each hash."""
    for b in batches:
        for raw in b.column(0).to_pylist():
            h = np.frombuffer(raw, np.uint32).astype(np.uint64)
            at = h & np.uint64(width - 1)
            bits = np.uint64(1) << (at & np.uint64(63))
            yield pa.record_batch([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array(bits.view(np.int64)), pa.array((h & SIZE_BITS).astype(np.int32) + 1)], ["word", "bits", "size"])


def settled_phrases(batches: Iterator[pa.RecordBatch], reached: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(lang, size, phrase, n) of the marked phrases by their words, and the number of all words of each lang as phrases of size 0."""
    for b in blocks(batches, TEXT_BYTES):
        ids, ends, names, homes = words_of(b["lang"], b["text"])
        h = np.append(hashes_of(names, homes), np.uint64(0))[ids]
        home, first = factorized(homes.dictionary_encode().indices.to_numpy())
        n = np.bincount(home[ids[ids >= 0]], minlength=len(first))
        yield pa.record_batch([homes.take(pa.array(first)), pa.array(np.zeros(len(first), np.int32)), pa.array([""] * len(first), pa.string()), pa.array(n, pa.int64())], ["lang", "size", "phrase", "n"])
        for size, begin, _, marked in phrases(h, ends, reached):
            begin = begin[marked[begin]]
            code = ids[begin].astype(np.int64)
            for k in range(1, size):
                code = factorized(code.astype(np.int64) * len(names) + ids[begin + k])[0]
            code, first = factorized(code)
            n, begin = np.bincount(code, minlength=len(first)), begin[first]
            for k in range(0, len(n), 8192):
                at = begin[k : k + 8192]
                parts = [names.take(pa.array(ids[at + i])) for i in range(size)]
                phrase = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
                yield pa.record_batch([homes.take(pa.array(ids[at])), pa.array(np.full(len(at), size, np.int32)), phrase, pa.array(n[k : k + 8192], pa.int64())], ["lang", "size", "phrase", "n"])


def frequent_phrases(docs: DataFrame, least: int = LEAST, shards: int = SHARDS, trace: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all phrases of up to LONGEST words with f >= least occurrences, and (lang, n), the number of all words.
    ``trace``, if given, gets the number of phrases of each length that reached the threshold in each step."""
    spark = docs.sparkSession
    texts = small_batches(take(docs, "lang", "text").where("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"))
    folder = shared_dir(spark, "phrase-shards")
    rows = texts.mapInArrow(hashed_texts, "words binary, n_words long").withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
    rows.write.option("compression", "zstd").partitionBy("shard").parquet(folder)  # rows are dealt out in turn, so shards have equal rows
    rows = spark.read.schema("words binary, n_words long, shard int").parquet(folder)
    parts = (rows.agg(F.sum("n_words")).first()[0] or 0) // SUMMED + 1
    news: list[np.ndarray] = []
    steps: list[tuple[DataFrame, str]] = []
    totals: list[tuple[DataFrame, str]] = []
    reached = np.zeros(BITMAP_BITS // 64, np.uint64)
    last = step = 0
    while step < shards or step <= last + shards:
        recent = np.bitwise_or.reduce(news[-shards:]) if news else reached
        told = [spark.sparkContext.broadcast(x) for x in (reached, recent)]
        count = partial(lambda told, all_words, batches: active_phrases(batches, told[0].value, told[1].value, all_words, parts), told, step < shards)
        steps.append(written_at(small_batches(rows.where(F.col("shard") == step % shards).select("words")).mapInArrow(count, PACKED), "phrase-step"))
        for x in told:
            x.destroy()
        window = steps[0][0]
        for df, _ in [*steps[1:], *totals]:  # phrases that reached the threshold before come without counts
            window = window.union(df)
        window = window.repartition(parts, "part").sortWithinPartitions("part")
        totals.append(written_at(window.mapInArrow(lambda batches: reaching(batches, least), PACKED), "phrase-totals"))
        if len(steps) == shards:
            discard(steps.pop(0)[1])
        fresh = totals[-1][0].select("hash").mapInArrow(lambda batches, width=BITMAP_BITS: bits_of(batches, width), "word long, bits long, size int")
        marks = fresh.groupBy("word").agg(F.bit_or("bits").alias("bits"), F.min("size").alias("size")).toArrow()
        new = np.zeros(BITMAP_BITS // 64, np.uint64)
        new[marks["word"].to_numpy()] = marks["bits"].to_numpy().view(np.uint64)
        news = [*news[1 - shards :], new] if shards > 1 else [new]
        reached = reached | new
        if marks.num_rows and pc.min(marks["size"]).as_py() < LONGEST:
            last = step
        if trace is not None:
            trace.append({r["size"]: r["count"] for r in fresh.groupBy("size").count().collect()})
        step += 1
        del window, fresh
        gc.collect()
        spark._jvm.System.gc()  # Spark deletes shuffle files of plans that the driver has let go of; else those of all steps stay
    discard(folder, *(path for _, path in steps), *(path for _, path in totals))
    told = spark.sparkContext.broadcast(reached)
    counts = texts.mapInArrow(lambda batches: settled_phrases(batches, told.value), "lang string, size int, phrase string, n long")
    found = written(counts.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f")).where(f"f >= {least} OR size = 0"), "frequent-phrases")
    told.destroy()
    return found.where("size > 0").select("lang", "size", "phrase", "f"), found.where("size = 0").select("lang", F.col("f").alias("n"))


def key_of(lang: str, phrase: str):
    """One string for a lang and a phrase."""
    return F.concat(F.length(lang).cast("string"), F.lit(" "), F.col(lang), F.lit(" "), F.col(phrase))


def words_between(first, n):
    """The phrase of n words of ``w`` from the first (counted from 1)."""
    return F.array_join(F.slice(F.col("w"), first, n), " ")


def scored_phrases(found: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words and more: the cut with the lowest score, and of those the first."""
    phrases = found.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("w"))
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    parts = cuts.select(
        "lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit(True).alias("left"), words_between(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("left"), words_between(F.col("k") + 1, F.col("size") - F.col("k")).alias("part")))).alias("p")
    ).select("lang", "phrase", "a", "k", "p.left", "p.part")
    parts = parts.withColumn("key", key_of("lang", "part")).drop("part")
    counts = found.select(key_of("lang", "phrase").alias("key"), "f")
    hot = hot_keys(parts.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "key", "rows")
    both = salted_join(parts, counts, "key", hot)
    both = both.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.expr(f"(cast(a as {DECIMAL}) * 2000000) div (cast(l as {DECIMAL}) + r)")
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def superfluous(found: DataFrame, percent: int = COVERED) -> DataFrame:
    """(lang, phrase) of the phrases of which ``percent`` or more lie in a longer frequent phrase."""
    longer = found.where("size > 2").select("lang", "f", "size", F.split("phrase", " ").alias("w"))
    inner = longer.withColumn("m", F.explode(F.expr("sequence(2, size - 1)"))).withColumn("i", F.explode(F.expr("sequence(1, size - m + 1)")))
    most = inner.select("lang", words_between(F.col("i"), F.col("m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    return found.join(most, ["lang", "phrase"]).where(f"cast(longest as {DECIMAL}) * 100 >= cast(f as {DECIMAL}) * {percent}").select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, report: int = REPORTED, percent: int = COVERED, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``report`` best phrases of each lang."""
    found, n_words = frequent_phrases(docs, least, shards)
    left = scored_phrases(found).join(superfluous(found, percent), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each part of a lang first, so that no task ranks all of a lang's phrases.
    parts = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= report)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= report)
    return best.join(n_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_dynamic_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of each lang of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, size, w[i : i + size - 1] AS w
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS size))),
counts AS (SELECT lang, size, w, count(*) AS f FROM grams GROUP BY ALL),
found AS (SELECT * FROM counts WHERE f >= 30),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
cuts AS (SELECT lang, w, f AS a, size, unnest(range(1, size)) AS k FROM found WHERE size > 1),
scored AS (
  SELECT c.lang, c.w, c.a, c.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM cuts c
  JOIN found l ON l.lang = c.lang AND l.w = c.w[1 : c.k]
  JOIN found r ON r.lang = c.lang AND r.w = c.w[c.k + 1 : c.size]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
inside AS (
  SELECT lang, w[i : i + m - 1] AS w, max(f) AS longest
  FROM (SELECT lang, w, f, m, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM found WHERE size > 2))
  GROUP BY ALL),
kept AS (
  SELECT b.lang, array_to_string(b.w, ' ') AS phrase, a, l, r, score
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.w = b.w
  WHERE i.longest IS NULL OR 100::HUGEINT * i.longest < 80::HUGEINT * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total ON total.lang = kept.lang
QUALIFY rank <= 2000
"""
