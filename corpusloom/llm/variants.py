"""Spelling variants by blocked Gram matrices of letter counts.

A word is a vector of letter counts. One inserted or deleted letter moves it by a squared distance of 1, one replaced letter by
exactly 2, so two words are near only if the squared distance of their counts is 1 (lengths differ by one) or 2 (same length).
Words are dealt to blocks; for two blocks the NumPy product of their count matrices gives all squared distances at once
(``|a|^2 + |b|^2 - 2 ab``), and only pairs at those distances are verified letter by letter.

A block's key is the word's length and its counts of GROUPS groups of letters. An edit changes the length by at most one and moves at
most one letter from a group to another, so a block meets only blocks of its own length that differ so, and blocks of the next length
with one letter more in one group: no near pair lies elsewhere. Blocks hold about BLOCK words; a key with more has several, and
every pair of blocks is a row that is dealt out by itself, so a crowded key is spread over the tasks. Words of any length and number are
compared.

The words themselves come from runs of letters, of which a known share (1 in 97 by CRC-32 of ``doc_id:run``) loses one letter. The CRC-32
of a concatenation follows from those of its parts by a linear map that depends on the second part's length, so one CRC
for each document and each different run of a batch suffices; NumPy combines them for all occurrences.

Cases: null and empty texts have no runs; a null doc_id counts as an empty one; repeated rows count each time; an empty table has no words; words
without near words have n_near 0; of near words with equally many occurrences the smallest in code-point order is the form; other columns
are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import holding, small_batches, table, take, written
from .frames import gathered

#: Words of a block, at about most.
BLOCK = 512
#: Letters are dealt to so many groups for the keys of blocks.
GROUPS = 5
#: Words have at least so many code points and occurrences.
LEAST_LENGTH, LEAST_N = 5, 3
#: A run whose CRC-32 this divides loses a letter.
DIVISOR = 97
#: Letters: a to z, and U+00C0 to U+00FF.
LETTERS = 26 + 64


#: Letter of each code point, as a number from 0 to LETTERS - 1.
LETTER_OF = np.zeros(256, np.int64)
LETTER_OF[97:123] = np.arange(26)
LETTER_OF[0xC0:] = np.arange(26, LETTERS)
# Groups of about the same frequency in Western languages.
GROUP_OF = np.zeros(256, np.int64)
for k, group in enumerate(("er", "nio", "atp", "shdlc", "ubmfgywvkjxqz")):
    GROUP_OF[[ord(c) for c in group]] = k
GROUP_OF[0xC0:] = np.arange(64) % GROUPS  # other letters in turn


class Crc:
    """CRC-32 of a concatenation from the CRC-32 of its parts."""

    @staticmethod
    def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The product of two linear maps on 32 bits, each given by its 32 columns."""
        out = np.zeros(32, np.uint32)
        for bit in range(32):
            out ^= np.where(b >> np.uint32(bit) & np.uint32(1), a[bit], np.uint32(0)).astype(np.uint32)
        return out

    @staticmethod
    @lru_cache(maxsize=64)
    def power(k: int) -> np.ndarray:
        """The map that appends 2 ** k zero bits to what a CRC-32 has read."""
        if k:
            return Crc.times(Crc.power(k - 1), Crc.power(k - 1))
        return np.array([0xEDB88320, *(1 << b for b in range(31))], np.uint32)

    @staticmethod
    @lru_cache(maxsize=4096)
    def shift(n: int) -> np.ndarray:
        """Tables of the map that appends n bytes, one for each byte of the CRC-32 before: 4 x 256."""
        columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
        bits = n * 8
        for k in range(bits.bit_length()):
            if bits >> k & 1:
                columns = Crc.times(Crc.power(k), columns)
        values = np.arange(256, dtype=np.uint32)
        out = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for bit in range(8):
                out[byte] ^= np.where(values >> np.uint32(bit) & np.uint32(1), columns[8 * byte + bit], np.uint32(0)).astype(np.uint32)
        return out


def joined_crc(first: np.ndarray, at: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of first parts, given by theirs, followed by second parts: of part ``at[i]`` the CRC-32 is ``ends[at[i]]`` and the number
    of bytes ``lengths[at[i]]``."""
    known, table_of = np.unique(lengths, return_inverse=True)
    tables = np.stack([Crc.shift(int(n)) for n in known]).reshape(-1) if len(known) else np.zeros(0, np.uint32)
    out, row = ends[at], (table_of * 1024)[at]
    for byte in range(4):
        out ^= tables[row + (byte * 256 + (first >> np.uint32(8 * byte) & np.uint32(255)))]
    return out


def counted_words(ids: list, texts: pa.Array, divisor: int) -> dict[str, int]:
    """Occurrences of each word in these documents."""
    text = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    parts = pc.ascii_split_whitespace(pc.replace_substring_regex(text, r"[^a-z\x{C0}-\x{FF}]+", " "))
    runs = parts.flatten()
    offsets = parts.offsets.to_numpy()
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    coded = runs.dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    raw = [w.encode() for w in words]
    heads = np.array([zlib.crc32((b"" if i is None else str(i).encode()) + b":") for i in ids], np.uint32)
    ends = np.array([zlib.crc32(r) for r in raw], np.uint32)
    h = joined_crc(heads[doc], at, ends, np.array([len(r) for r in raw], np.int64))
    size = np.array([len(w) for w in words], np.int64)[at]
    cut = (h % divisor == 0) & (size > 0)
    out = dict(zip(words, np.bincount(at[~cut], minlength=len(words)).tolist(), strict=True))
    out.pop("", None)
    for w, k in zip(at[cut].tolist(), (h[cut].astype(np.int64) % size[cut]).tolist(), strict=True):
        word = words[w][:k] + words[w][k + 1 :]
        out[word] = out.get(word, 0) + 1
    return out


def word_counts(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """(word, n) of the words with at least LEAST_LENGTH code points and LEAST_N occurrences."""
    d = take(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("variants")
        for b in gathered(batches):
            texts = b.column(1)
            if texts.offset:  # pyarrow's ascii_lower reads a slice at the wrong place
                texts = texts.take(pa.array(np.arange(len(texts))))
            counts = {w: n for w, n in counted_words(b.column(0).to_pylist(), texts, divisor).items() if n and len(w) >= LEAST_LENGTH}
            for part in pa.table([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"]).to_batches(8192):
                yield part

    found = small_batches(d).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_N)


def keyed_words(words: DataFrame) -> DataFrame:
    """(length, key, word, n): ``key`` holds the counts of the letter groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word = b.column(0).to_pylist()
            keys = []
            for w in word:
                codes = np.frombuffer(w.encode("latin-1"), np.uint8)
                keys.append(np.bincount(GROUP_OF[codes], minlength=GROUPS).tolist())
            yield pa.record_batch([pa.array([len(w) for w in word], pa.int32()), pa.array(keys, pa.list_(pa.int32())), b.column(0), b.column(1)], ["length", "key", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "length int, key array<int>, word string, n long")


def met_blocks(key: str = "key", length: str = "length"):
    """The (length, key) of the blocks that a block meets: itself, those that have one letter in another group, and those that have
    one letter more. The former are met from the smaller key only."""
    moved = ", ".join(f"({i}, {j})" for i in range(GROUPS) for j in range(GROUPS) if i != j)
    step = "transform({key}, (c, g) -> c + if(g = m.col1, -1, 0) + if(g = m.col2, 1, 0))".format(key=key)
    same = f"filter(transform(array({moved}), m -> {step}), k -> k > {key})"
    more = f"transform(sequence(0, {GROUPS - 1}), i -> transform({key}, (c, g) -> c + if(g = i, 1, 0)))"
    return F.expr(
        f"concat(array(struct({length} AS length, {key} AS key)), transform({same}, k -> struct({length} AS length, k AS key)), transform({more}, k -> struct({length} + 1 AS length, k AS key)))"
    )


def matrix(words: str, length: int) -> np.ndarray:
    """Code points of words of one length, given as one string, a row each."""
    return np.frombuffer(words.encode("latin-1"), np.uint8).reshape(-1, length)


def letter_counts(codes: np.ndarray, kind: type) -> np.ndarray:
    n = len(codes)
    flat = LETTER_OF[codes] + np.arange(n)[:, None] * LETTERS
    return np.bincount(flat.ravel(), minlength=n * LETTERS).reshape(n, LETTERS).astype(kind)


def near_in_blocks(x: np.ndarray, y: np.ndarray, same_block: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the near pairs of two blocks of words; those of ``y`` have the length of those of ``x`` or one letter more."""
    apart = y.shape[1] - x.shape[1]
    kind = np.float32 if y.shape[1] < 2000 else np.float64  # products of counts stay exact
    p, q = letter_counts(x, kind), letter_counts(y, kind)
    # |p|^2 + |q|^2 - 2 pq as one product: two more columns carry the squares.
    p2, q2 = (p * p).sum(1)[:, None], (q * q).sum(1)[:, None]
    square = np.hstack([p, p2, np.ones_like(p2)]) @ np.hstack([-2 * q, np.ones_like(q2), q2]).T
    i, j = np.nonzero(square == (1 if apart else 2))
    if same_block:
        i, j = i[i < j], j[i < j]
    good = np.zeros(len(i), bool)
    step = max(1, (8 << 20) // y.shape[1])
    for k in range(0, len(i), step):
        u, v = x[i[k : k + step]], y[j[k : k + step]]
        if not apart:
            good[k : k + step] = (u != v).sum(1) == 1
        else:  # u is v without one letter: all before some place agree, and all from there on one place further
            width = x.shape[1]
            differs, shifted = u != v[:, :-1], u != v[:, 1:]
            head = np.where(differs.any(1), differs.argmax(1), width)
            tail = np.where(shifted.any(1), shifted[:, ::-1].argmax(1), width)
            good[k : k + step] = head + tail >= width
    return i[good], j[good]


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): both directions of each pair of words that one inserted, deleted or replaced code point parts."""
    keyed = written(keyed_words(words), "keyed-words")
    sizes = keyed.groupBy("length", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = keyed.join(sizes, ["length", "key"]).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    # A block's words have one length, so one string holds them.
    blocks = dealt.groupBy("length", "key", "block").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("w"))
    blocks = written(blocks.select("length", "key", "block", F.array_join("w.word", "").alias("words"), F.col("w.n").alias("ns")), "word-blocks")
    met = blocks.withColumn("other", F.explode(met_blocks()))
    others = sizes.select(F.col("length").alias("l"), F.col("key").alias("k"), F.col("blocks").alias("others"))
    met = met.join(others, (F.col("other.length") == F.col("l")) & (F.col("other.key") == F.col("k")))
    itself = (F.col("l") == F.col("length")) & (F.col("k") == F.col("key"))
    met = met.select("length", "words", "ns", "l", "k", "block", itself.alias("itself"), F.explode(F.sequence(F.when(itself, F.col("block")).otherwise(0), F.col("others") - 1)).alias("m"))
    right = blocks.select(F.col("length").alias("l"), F.col("key").alias("k"), F.col("block").alias("m"), F.col("words").alias("words_m"), F.col("ns").alias("ns_m"))
    # A merge join deals both sides out, so the products are spread however small the tables are.
    pairs = met.join(right.hint("merge"), ["l", "k", "m"]).select("length", "words", "ns", "l", "words_m", "ns_m", (F.col("itself") & (F.col("m") == F.col("block"))).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            length, words, _, other_length, other_words, _, same = (c.to_pylist() if k not in (2, 5) else None for k, c in enumerate(b.columns))
            for r in range(b.num_rows):
                i, j = near_in_blocks(matrix(words[r], length[r]), matrix(other_words[r], other_length[r]), same[r])
                if not len(i):
                    continue
                an, cn = (b.column(k)[r].values.to_numpy() for k in (2, 5))
                p, q, m, n = words[r], other_words[r], length[r], other_length[r]
                left, right = [p[k * m : k * m + m] for k in i.tolist()], [q[k * n : k * n + n] for k in j.tolist()]
                out[0] += left + right
                out[1] += right + left
                out[2] += [cn[j], an[i]]
            yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(np.concatenate(out[2]) if out[2] else [], pa.int64())], ["word", "near", "near_n"])

    return pairs.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to their end. A form has at least twice the occurrences of its word, so
    chains have no cycle and are at most as long as the logarithm of the largest count; each round doubles what is followed."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n)."""
    words = written(words.select("word", "n"), "words")
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best"))
    strong = -F.col("best.minus") >= 2 * F.col("n")
    found = written(
        words.join(best, "word", "left").select("word", F.when(strong, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, -F.col("best.minus")).alias("form_n")), "word-forms"
    )
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_gram_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words' number, form and root."""
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))
