"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and exact verification.

A document is the set of its distinct word shingles, kept as 64-bit hashes. Its sketch has REGISTERS registers
``floor(1 - log_b(min of exponentials))``: exponentially spaced, truncated minima, merged by their maximum (``merge``), so a
part of a set never has to be seen again. Two registers agree with a probability of the Jaccard similarity or a little more.

1. Documents with equal sets form a class; only classes go on, so any number of exact copies costs one row each.
2. Bands of registers are hashed. Each bucket of two or more classes names its smallest class the leader, and every other
   member makes one row with it: a star, not pairs. Members of a bucket always share a leader.
3. The similarity of member and leader is estimated from their registers by maximum likelihood, given their sizes; pairs for
   which the threshold is out of reach are left out, the others are verified on their full sets.
4. Members that are linked with their leader need no comparison among themselves. The others (strays) are compared with every
   member of their leader's star, in blocks that are dealt over the cluster: registers first, then full sets. A block sends on
   only the links that join what it has not joined, so no pairs of a group are written out.
5. Links are contracted to components by alternating large-star and small-star steps on written tables.

With BANDS[threshold] a linked pair shares no band with a probability of about 1e-8. A pair is left out by its registers (step 3)
only where its likelihood within the threshold is smaller by a factor of e^OUT_OF_REACH, or more than a quarter of all registers
beyond the expected share differ; what remains is verified exactly. There are no caps on buckets or partners. Rows of a frequent
band, leader, digest or node are dealt to several tasks (``salted_join``).

Cases: documents without words or with null text have an empty set and are linked with nothing; texts with fewer words than a
shingle are one shingle of all of them; rows with a null doc_id take no part and are kept; rows that share a doc_id are one
document; ties go to the smaller doc_id; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, discard, grouped, holding, hot_keys, salted_join, small_batches, table, take, written, written_at

REGISTERS, BASE = 160, 1.02
#: Threshold in percent -> (bands, registers of a band).
BANDS = {85: (32, 5), 80: (40, 4)}
#: A pair is left out if its likelihood within the threshold is smaller than the best by this factor's logarithm.
OUT_OF_REACH = 14.0
#: Members of a block, and shingles of a block, at about most.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 18

#: Rows of 64 bits in the bitmap that thins out the texts before their shuffle; a bound on what is broadcast.
BITMAP_WORDS = 1 << 18

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S29, S32 = np.uint64(29), np.uint64(32)


class WordHashes(Remembered):
    """word -> 64-bit hash."""

    def __missing__(self, word: str) -> int:
        h = self.older.get(word)
        return self.keep(word, xxhash.xxh3_64_intdigest(word.encode("utf-8")) if h is None else h, 2 * len(word))


HASHES = WordHashes(40 << 20)


def mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> S29)) * C2
    return v ^ (v >> S32)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles of k words, in lower-case ASCII."""
    holding("shingles", HASHES.clear)
    t = text or ""
    words = WORD.findall(t.lower() if t.isascii() else t.translate(LOWER))
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, n)
    if n < k:
        v = np.full(1, n, np.uint64)
        for i in range(n):
            v = mix(v * C1 + h[i : i + 1])
        return v
    m = n - k + 1
    v = h[:m] ^ C3
    for j in range(1, k):
        v = mix(v * C1 + h[j : j + m])
    return np.unique(v)


def seeds(m: int) -> np.ndarray:
    return mix(np.arange(1, m + 1, dtype=np.uint64) * C3)


SEEDS = seeds(REGISTERS // 2)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set of hashes."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(hashes), 1024):
        v = (hashes[k : k + 1024, None] ^ SEEDS[None, :]) * C2
        v = (v ^ (v >> S32)) * C3
        np.minimum(low, v.view(np.uint32).min(0), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def in_reach(n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray, percent: int) -> np.ndarray:
    """Whether the Jaccard similarity may be ``percent`` or more, by likelihood: ``more`` and ``less`` count the registers in
    which a is above and below b."""
    total = (n_a + n_b).astype(np.float64)
    u, v = n_a / total, n_b / total
    most = np.minimum(u / v, v / u)
    share = np.linspace(0, 1, 41)[None, :]
    floor = np.minimum(percent / 100, most)[:, None]
    grid = np.concatenate([floor * share, floor + (most[:, None] - floor) * share], 1)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up = np.maximum(p(u[:, None] - v[:, None] * grid), 1e-9)
    down = np.maximum(p(v[:, None] - u[:, None] * grid), 1e-9)
    same = np.maximum(1 - up - down, 1e-9)
    ll = more[:, None] * np.log(up) + less[:, None] * np.log(down) + (REGISTERS - more - less)[:, None] * np.log(same)
    return ll.max(1) - ll[:, 41:].max(1) < OUT_OF_REACH


def registers_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


# ---------------------------------------------------------------- steps


def features(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, digest, sketch) of each row; digest and sketch are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, k) for t in b.column(1).to_pylist()]
            n = pa.array([len(s) for s in sets], pa.int64())
            digest = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
            yield pa.record_batch([b.column(0), n, digest, pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())], ["doc_id", "n", "digest", "sketch"])

    return small_batches(take(docs, "doc_id", "text")).mapInArrow(run, "doc_id long, n long, digest binary, sketch binary")


def band_rows(classes: DataFrame, percent: int) -> DataFrame:
    """(band, node): the hash of each band of each class."""
    bands, rows = BANDS[percent]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = registers_of(b.column(1))[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
            v = np.broadcast_to(seeds(bands)[None, :], r.shape[:2])
            for j in range(rows):
                v = mix(v * C1 + r[:, :, j])
            yield pa.record_batch([pa.array(v.view(np.int64).ravel()), pa.array(np.repeat(b.column(0).to_numpy(), bands))], ["band", "node"])

    return classes.select("node", "sketch").mapInArrow(run, "band long, node long")


def stars(classes: DataFrame, percent: int) -> tuple[DataFrame, list[int]]:
    """(leader, node, n, near): every other member of a bucket with the bucket's leader; ``near``: the threshold is in reach. And the
    leaders with very many members."""
    rows = band_rows(classes, percent)
    buckets, buckets_at = written_at(rows.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("c")).where("c > 1"), "buckets")
    star = salted_join(rows, buckets.select("band", "leader"), "band", hot_keys(buckets, "band", "c")).where("node <> leader").select("leader", "node").distinct()
    star, star_at = written_at(star, "star-members")
    hot = hot_keys(star.groupBy("leader").agg(F.count(F.lit(1)).alias("c")), "leader", "c")
    own = classes.select("node", "n", "sketch")
    led = classes.select(F.col("node").alias("leader"), F.col("n").alias("leader_n"), F.col("sketch").alias("leader_sketch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(2).to_numpy(), b.column(4).to_numpy()
            a, c = registers_of(b.column(3)), registers_of(b.column(5))
            near = np.minimum(n, m) * 100 >= np.maximum(n, m) * percent
            near &= in_reach(n, m, (a > c).sum(1), (a < c).sum(1), percent)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(near)], ["leader", "node", "n", "near"])

    both = salted_join(star.join(own, "node"), led, "leader", hot).select("leader", "node", "n", "sketch", "leader_n", "leader_sketch")
    out = written(both.mapInArrow(run, "leader long, node long, n long, near boolean"), "stars")
    discard(buckets_at, star_at)
    return out, hot


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, n, sketch, items array<long>) of the wanted nodes, from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            keep, n, sk, items = [], [], [], []
            for i, (node, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if (node, t) == last:  # a repeated row
                    continue
                last = (node, t)
                s = shingles(t, k)
                if len(s):
                    keep.append(i)
                    n.append(len(s))
                    sk.append(sketch(s).tobytes())
                    items.append(s.view(np.int64))
            yield pa.record_batch([b.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(sk, pa.binary()), pa.array(items, pa.list_(pa.int64()))], ["node", "n", "sketch", "items"])

    wanted = written(wanted, "wanted-nodes")
    d = small_batches(take(docs, "doc_id", "text")).withColumnRenamed("doc_id", "node")
    h = F.xxhash64("node").bitwiseAND(F.lit(64 * BITMAP_WORDS - 1).cast("long"))
    # A bitmap of the wanted nodes' hashes, of BITMAP_WORDS rows at most: most other texts are left out before the shuffle.
    bits = wanted.groupBy(F.shiftright(h, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(xxhash64(node) & 63 as int))")).alias("bits"))
    d = d.withColumn("word", F.shiftright(h, 6)).join(F.broadcast(bits), "word").where(F.expr("(shiftright(bits, cast(xxhash64(node) & 63 as int)) & 1) = 1"))
    d = d.join(wanted, "node").select("node", "text")
    return d.mapInArrow(run, "node long, n long, sketch binary, items array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, hot: list[int]) -> DataFrame:
    """(leader, node, linked) of the pairs, by their full sets."""
    led = sets.select(F.col("node").alias("leader"), F.col("items").alias("leader_items"))
    common = F.size(F.array_intersect("items", "leader_items")).cast("long")
    union = F.size("items") + F.size("leader_items") - common
    both = salted_join(pairs.select("leader", "node").join(sets.select("node", "items"), "node"), led, "leader", hot)
    return both.select("leader", "node", (common * 100 >= union * percent).alias("linked"))


def stray_blocks(marked: DataFrame, hot: list[int]) -> DataFrame:
    """(leader, a, kind, b, node, side): the blocks of each star with strays, as pairs of blocks. kind 0: strays a with strays
    b; kind 1: strays a with linked members b. ``side`` says which of the two the node is in (2: both)."""
    count = lambda c, s: F.greatest(F.ceil(c / BLOCK_ROWS), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    stray = ~F.col("linked")
    size = marked.groupBy("leader").agg(
        F.count(F.lit(1)).alias("c"),
        F.sum(stray.cast("long")).alias("strays"),
        count(F.sum(stray.cast("long")), F.sum(F.when(stray, F.col("n")).otherwise(0))).alias("sb"),
        count(F.sum((~stray).cast("long")), F.sum(F.when(stray, 0).otherwise(F.col("n")))).alias("cb"),
    )
    size = written(size.where("c > 1 and strays > 0").select("leader", "sb", "cb"), "star-sizes")
    m = salted_join(marked, size, "leader", hot)
    i = F.pmod(F.xxhash64("node"), F.when(stray, F.col("sb")).otherwise(F.col("cb"))).cast("int")
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    part = lambda a, kind, b, side: F.struct(a.alias("a"), F.lit(kind).alias("kind"), b.alias("b"), side.cast("int").alias("side"))
    of_stray = F.concat(
        F.transform(up_to("sb"), lambda j: part(F.least(F.col("i"), j), 0, F.greatest(F.col("i"), j), F.when(F.col("i") == j, 2).when(F.col("i") < j, 0).otherwise(1))),
        F.when(F.col("cb") > 0, F.transform(up_to("cb"), lambda j: part(F.col("i"), 1, j, F.lit(0)))).otherwise(F.expr("array()")),
    )
    of_core = F.transform(up_to("sb"), lambda j: part(j, 1, F.col("i"), F.lit(1)))
    m = m.withColumn("i", i).withColumn("p", F.explode(F.when(stray, of_stray).otherwise(of_core)))
    return m.select("leader", "p.a", "p.kind", "p.b", "node", "p.side")


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def block_links(nodes, n, regs, sets, left, right, percent) -> list[tuple[int, int]]:
    """Links between two blocks that join what is not yet joined."""
    found, joined = [], Union(len(nodes))
    pairs = []
    for x in left:
        ys = right[right > x] if left is right else right
        ys = ys[np.minimum(n[ys], n[x]) * 100 >= np.maximum(n[ys], n[x]) * percent]
        if not len(ys):
            continue
        more, less = (regs[x] > regs[ys]).sum(1), (regs[x] < regs[ys]).sum(1)
        rough = more + less < REGISTERS * (1 - percent / 100 + 0.25)
        ys, more, less = ys[rough], more[rough], less[rough]
        if len(ys):
            ok = in_reach(np.full(len(ys), n[x]), n[ys], more, less, percent)
            pairs += [(int(d), int(x), int(y)) for d, y in zip((more + less)[ok], ys[ok], strict=True)]
    for _, x, y in sorted(pairs):
        rx, ry = joined.find(x), joined.find(y)
        if rx == ry:
            continue
        a, b = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
        at = np.searchsorted(b, a)
        common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
        if common * 100 >= (len(a) + len(b) - common) * percent:
            joined.up[rx] = ry
            found.append((int(nodes[x]), int(nodes[y])))
    return found


def stray_links(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of strays, by blocks."""
    rows = blocks.join(sets, "node").select("leader", "a", "kind", "b", "side", "node", "n", "sketch", "items")
    rows = rows.repartition("leader", "a", "kind", "b").sortWithinPartitions("leader", "a", "kind", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["leader", "a", "kind", "b"]):
            side = t.column("side").to_numpy()
            left = np.flatnonzero(side != 1)
            right = left if (side == 2).all() else np.flatnonzero(side != 0)
            items = t.column("items").combine_chunks()
            flat, ends = items.flatten().to_numpy(), items.offsets.to_numpy()
            sets_ = [np.sort(flat[a:b]) for a, b in zip(ends - ends[0], ends[1:] - ends[0], strict=False)]
            links = block_links(t.column("node").to_numpy(), t.column("n").to_numpy(), registers_of(t.column("sketch")), sets_, left, right, percent)
            if links:
                yield pa.record_batch([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    return small_batches(rows).mapInArrow(run, "a long, b long")


def smallest_neighbours(pairs: DataFrame, name: str) -> tuple[DataFrame, list[int], str]:
    """(u, m): the smallest v of each u; the u with very many rows; the folder."""
    low, at = written_at(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")), name)
    return low.select("u", "m"), hot_keys(low, "u", "c"), at


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node that has a link, with the smallest node of its component."""
    edges, edges_at = written_at(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not now.n or (now.n, now.h) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = (now.n, now.h)
        # Large star: each node sends its larger neighbours to the smallest of all its neighbours and itself.
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, hot, low_at = smallest_neighbours(pairs, "large-low")
        large = salted_join(pairs, low.select("u", F.least("u", "m").alias("m")), "u", hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_at = written_at(large, "large-star")
        discard(edges_at, low_at)
        # Small star: each node sends its smaller neighbours and itself to the smallest of them.
        low, hot, low_at = smallest_neighbours(large, "small-low")
        near = salted_join(large, low, "u", hot)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        edges, edges_at = written_at(small.where("u <> v").distinct(), "small-star")
        discard(large_at, low_at)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row: the size of its set, the smallest doc_id that links of ``percent``
    or more reach, and whether that is its own."""
    feats = written(features(docs, k), "shingle-features")
    some = feats.where("n > 0 and doc_id is not null")
    classes, classes_at = written_at(some.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")), "shingle-classes")
    star, hot = stars(classes, percent)
    big = star.groupBy("leader").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("leader")
    near = star.where("near")
    wanted = near.select("node").unionByName(near.select(F.col("leader").alias("node"))).unionByName(salted_join(star, big, "leader", hot).select("node")).distinct()
    sets, sets_at = written_at(full_sets(docs, wanted, k), "shingle-sets")
    seen, seen_at = written_at(verified(near, sets, percent, hot).groupBy("leader", "node").agg(F.max("linked").alias("linked")), "star-links")
    marked, marked_at = written_at(star.join(seen, ["leader", "node"], "left").withColumn("linked", F.coalesce("linked", F.lit(False))), "marked-stars")
    more = stray_links(stray_blocks(marked, hot), sets, percent)
    links = seen.where("linked").select(F.col("leader").alias("a"), F.col("node").alias("b")).unionByName(more)
    rooted = components(links)
    discard(sets_at, seen_at, marked_at)
    roots, roots_at = written_at(classes.select("digest", "node", "copies").join(rooted, "node", "left").select("digest", "copies", F.coalesce("root", "node").alias("root")), "class-roots")
    discard(classes_at)
    out = salted_join(some.select("digest", "doc_id", "n"), roots.select("digest", "root"), "digest", hot_keys(roots, "digest", "copies")).select("doc_id", "n", "root")
    rest = feats.where("not (n > 0 and doc_id is not null)").select("doc_id", "n", F.col("doc_id").alias("root"))
    out = out.unionByName(rest)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("root"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are their group's smallest doc_id or in no group."""
    gone = near_duplicates(docs, k, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.join(gone, F.col(f"c{names.index('doc_id')}") == F.col("_gone"), "left_anti").toDF(*names)


def op8_setsketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


# Exact, by the shingles themselves; for small tables.
OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 85 * (p.n + q.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.seen),
m AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.doc_id = d.doc_id
"""
