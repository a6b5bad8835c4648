"""Exact top-k search by inner product: a dual-tree search over cover trees.

Vectors are dealt to the cells of a few pivots (the top level of the tree, fitted on a bounded sample), and large cells to
chunks by a hash, so a block is small whatever the data, also where one vector is very frequent. A task builds the cover tree of its block and that of the
queries it gets, and walks both at once: a pair of nodes is left out when no product between them can reach the worst kth
score of the queries below the query node. With centres c and covering radii r,
``q.x <= cq.cx + |cq| rx + |cx| rq + rq rx``.

Queries first meet the blocks of their own cell, which gives each a kth score; then the other blocks, where that score
prunes from the start and only products that reach it are sent on. Blocks whose summary can't reach the worst kth score of a
group of queries don't get the group at all.

Trees: level 0 is one point; level l + 1 holds the points of level l (nesting) and others until every point is within
``scale / BASE`` of one (covering); any two points of a level are farther apart than its scale (separation), and each one's parent
is the nearest point of the level above. Levels are taken from one farthest-first order. A node's radius is measured, so pruning is
exact. Descent stops where nodes hold LEAF points or fewer, or where the next level would hold more than a SPANth of the
points: there a matrix product costs less than bounds. In a node pair's turn all remaining data nodes of a level are bounded at once.

Cases: vectors that are null or hold a null or non-finite component take no part; only vectors of equal length are compared;
repeated candidates count each time; a repeated query counts once; ties go to the smaller vec_id; a query with no candidate has no
rows; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import grouped, table, take, written

#: Vectors of a block: a 64th of all, within these bounds, so that small tables keep all cores busy.
BLOCK_ROWS = (1024, 16384)
#: Queries of a group.
GROUP_ROWS = 256
#: Queries that a task searches at once.
QUERY_ROWS = GROUP_ROWS * 8
#: Pivots and the size of the sample that they are chosen from (farthest-first).
PIVOTS, PIVOT_SAMPLE = 32, 4096
#: Ratio of the scales of two levels, most points of a node that is not split, fewest points for each node of a level, and points
#: whose products are taken at once.
BASE, LEAF, SPAN, SCAN = 1.5, 64, 16, 1024
#: Leaves and levels of the queries' trees are finer: a query node's bounds are as wide as the node.
QUERY_LEAF, QUERY_SPAN = 16, 6
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Level:
    """The nodes of one level, in the order of their points: each holds the points lo to hi of the tree's order."""

    scale: float
    center: np.ndarray
    norm: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


class CoverTree:
    """``order``: the points in the order of the leaves; ``levels``: from the root down."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, span: int = SPAN):
        points = points.astype(np.float64)
        n = len(points)
        away = lambda i: np.sqrt(((points - points[i]) ** 2).sum(1))
        centers = [int(((points - points.mean(0)) ** 2).sum(1).argmin())]
        near, owner = away(centers[0]), np.zeros(n, np.int64)
        scale = float(near.max())
        made = [(scale, 1, owner)]  # scale, number of centers, the center of each point
        while near.max() > 0 and np.bincount(owner).max() > leaf:
            scale /= BASE
            near_, owner_, more = near.copy(), owner.copy(), list(centers)
            while near_.max() > scale and len(more) <= n // span:
                i = int(near_.argmax())
                far = away(i)
                owner_[far < near_] = len(more)
                near_ = np.minimum(near_, far)
                more.append(i)
            if near_.max() > scale:
                break
            if len(more) > len(centers):
                near, owner, centers = near_, owner_, more
                made.append((scale, len(centers), owner))
        # The ancestor of each point in each level: the parent of a center is the center of the level above that is nearest to it.
        up = owner
        chain = [up]
        for _, _, above in made[-2::-1]:
            up = above[np.array(centers)][up]
            chain.insert(0, up)
        self.order = np.lexsort(chain[::-1])
        self.levels = []
        for (scale, _, _), mine in zip(made, chain, strict=True):
            mine = mine[self.order]
            lo = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            hi = np.append(lo[1:], n)
            center = points[np.array(centers)[mine[lo]]]
            dist = np.sqrt(((points[self.order] - np.repeat(center, hi - lo, 0)) ** 2).sum(1))
            self.levels.append(Level(scale, center, np.sqrt((center**2).sum(1)), np.maximum.reduceat(dist, lo), lo, hi))

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The children of nodes, in the next level."""
        here, lo = self.levels[level], self.levels[level + 1].lo
        return spans(np.searchsorted(lo, here.lo[nodes]), np.searchsorted(lo, here.hi[nodes]))


def spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0], ..., hi[0] - 1, lo[1], ..."""
    n = hi - lo
    return np.arange(n.sum()) + np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Best:
    """The k best (score, id) of each query so far. ``floor``: a score that the query has k candidates for elsewhere."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k = k
        self.compared = 0
        self.score = np.full((n, k), LEAST)
        self.id = np.full((n, k), MOST)
        self.floor = floor
        self.worst = floor.copy()

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Scores (rows x ids) of the given queries; only those that reach a query's worst score matter."""
        self.compared += scores.size
        hit = allowed & (scores >= self.worst[rows][:, None])
        if hit.sum() > 8 * self.k * len(rows) and scores.shape[1] > self.k:
            # Many reach it (at first): of each query only those that reach its kth here.
            s = np.where(hit, scores, LEAST)
            hit &= s >= np.partition(s, -self.k, 1)[:, -self.k][:, None]
        r, c = np.nonzero(hit)
        if not len(r):
            return
        some = np.unique(r)
        row = np.concatenate([r, np.repeat(some, self.k)])
        score = np.concatenate([scores[r, c], self.score[rows[some]].ravel()])
        ident = np.concatenate([ids[c], self.id[rows[some]].ravel()])
        order = np.lexsort((ident, ~score, row))
        first = np.searchsorted(row[order], some)
        take_ = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.score[rows[some]] = score[take_].reshape(-1, self.k)
        self.id[rows[some]] = ident[take_].reshape(-1, self.k)
        self.worst[rows[some]] = np.maximum(self.floor[rows[some]], self.score[rows[some], -1])


def dual_search(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int, xt: CoverTree | None = None) -> Best:
    """The k best of ``x`` for each of ``q``; in the order of ``q``. ``xt``: the tree of x, if it is at hand."""
    qt, xt = CoverTree(q, QUERY_LEAF, QUERY_SPAN), xt or CoverTree(x)
    best = Best(len(q), k, floor)
    turn = [(0, 0, 0, np.zeros(1, np.int64))]  # level and node of the queries, level and nodes of the data
    while turn:
        ql, a, xl, nodes = turn.pop()
        here, there = qt.levels[ql], xt.levels[xl]
        mine = qt.order[here.lo[a] : here.hi[a]]
        # No product of a query below a and a vector below a node is larger than its reach.
        reach = there.center[nodes] @ here.center[a] + here.norm[a] * there.radius[nodes] + there.norm[nodes] * here.radius[a] + here.radius[a] * there.radius[nodes]
        reach += 1e-9 * np.abs(reach) + 1e-6
        keep = reach >= best.worst[mine].min()
        nodes, reach = nodes[keep], reach[keep]
        if not len(nodes):
            continue
        q_leaf, x_leaf = ql == len(qt.levels) - 1, xl == len(xt.levels) - 1
        if not x_leaf and (q_leaf or there.radius[nodes].max() >= here.radius[a]):
            turn.append((ql, a, xl + 1, xt.below(xl, nodes)))
        elif not q_leaf:
            turn += [(ql + 1, int(c), xl, nodes) for c in qt.below(ql, np.array([a]))]
        else:
            nodes = nodes[np.argsort(-reach)]
            reach = -np.sort(-reach)
            held = np.cumsum(there.hi[nodes] - there.lo[nodes])
            done, few = 0, LEAF  # few at first, so that a worst score is known soon
            while done < len(nodes) and reach[done] >= best.worst[mine].min():
                end = max(done + 1, int(np.searchsorted(held, (held[done - 1] if done else 0) + few, "right")))
                part = xt.order[spans(there.lo[nodes[done:end]], there.hi[nodes[done:end]])]
                for k0 in range(0, len(part), SCAN):
                    rows = part[k0 : k0 + SCAN]
                    best.offer(mine, products(q[mine], x[rows]), x_ids[rows], q_ids[mine][:, None] != x_ids[rows][None, :])
                done, few = end, min(2 * few, SCAN)
    return best


def vectors(df: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component; only vectors that take part."""
    d = take(df, "vec_id", "embedding")
    x = F.transform("embedding", lambda c: c.cast("double"))
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return d.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("vec_id").isNotNull()).where(ok).select("vec_id", F.transform(x, lambda c: F.floor(F.lit(scale) * c)).alias("v"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def pivots_of(sample: DataFrame) -> dict[int, np.ndarray]:
    """Pivots for each length of vector, farthest-first among at most PIVOT_SAMPLE vectors (those with the smallest hash)."""
    rows = sample.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()
    out = {}
    for dim in {len(r.v) for r in rows}:
        m = np.array([r.v for r in rows if len(r.v) == dim], np.float64)
        near, chosen = ((m - m[0]) ** 2).sum(1), [0]
        while len(chosen) < PIVOTS and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, ((m - m[chosen[-1]]) ** 2).sum(1))
        out[dim] = m[chosen]
    return out


def with_cells(vecs: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds ``cell``: dim * PIVOTS + the nearest pivot (0 for a length that the sample lacks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.array([len(v) for v in b.column(1)], np.int64)
            cell = dims * PIVOTS
            for dim in set(dims.tolist()):
                at = np.flatnonzero(dims == dim)
                p = pivots.get(dim)
                if p is not None:
                    m = matrix(pa.chunked_array([b.column(1).take(pa.array(at))])).astype(np.float64)
                    cell[at] += ((m**2).sum(1)[:, None] - 2 * m @ p.T + (p**2).sum(1)[None, :]).argmin(1)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cell)], ["vec_id", "v", "cell"])

    return vecs.mapInArrow(run, "vec_id long, v array<long>, cell long")


def chunk_counts(vecs: DataFrame, rows: tuple[int, int]) -> dict[int, int]:
    """Number of chunks of each cell. At most PIVOTS cells for each length of vector, whatever the table."""
    n = {r.cell: r.n for r in vecs.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = min(max(sum(n.values()) // 64, rows[0]), rows[1])
    return {c: -(-x // size) for c, x in n.items()}


def in_chunks(vecs: DataFrame, counts: dict[int, int], name: str) -> DataFrame:
    """Adds ``chunk``, by hash within the cell."""
    n = F.create_map(*[F.lit(int(x)) for kv in counts.items() for x in kv])[F.col("cell")] if counts else F.lit(1)
    return vecs.withColumn(name, F.pmod(F.xxhash64("vec_id"), n.cast("long")))


def summaries(blocks: DataFrame, chunk: str) -> DataFrame:
    """(cell, chunk, center, radius, norm) of each block: its mean, the farthest vector from it, the mean's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["cell", chunk]):
            m = matrix(t.column("v")).astype(np.float64)
            c = m.mean(0)
            r = np.sqrt(((m - c) ** 2).sum(1).max())
            yield pa.record_batch([t.column("cell")[:1].combine_chunks(), t.column(chunk)[:1].combine_chunks(), pa.array([c], pa.list_(pa.float64())), pa.array([r]), pa.array([float(np.sqrt(c @ c))])], ["cell", chunk, "center", "radius", "norm"])

    rows = blocks.select("cell", chunk, "v").repartition("cell", chunk).sortWithinPartitions("cell", chunk)
    return rows.mapInArrow(run, f"cell long, {chunk} long, center array<double>, radius double, norm double")


def pieces(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, table) of consecutive rows with equal ``keys``, at most ``rows`` of them: the rows come sorted by them, and a longer run
    comes in several pieces, so that no run is held whole."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for batch in batches:
        marks = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
        start = 0
        while start < len(marks):
            if held and (marks[start] != last or n == rows):
                yield last, pa.Table.from_batches(held)
                held, n = [], 0
            last, end = marks[start], start + 1
            while end < len(marks) and marks[end] == last and n + end - start < rows:
                end += 1
            held.append(batch.slice(start, end - start))
            n, start = n + end - start, end
    if held:
        yield last, pa.Table.from_batches(held)


def search_blocks(data: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """data: (cell, chunk, vec_id, v). asked: (cell, chunk, vec_id, v, floor): queries sent to that block. Each block's k best
    of each of its queries, of the scores that reach the query's floor: (query_id, vec_id, score).

    A task holds one block and at most QUERY_ROWS queries (and the batch that is read), however many queries a block gets."""
    rows = data.select("cell", "chunk", F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("long").alias("floor")).unionByName(asked.select("cell", "chunk", F.lit(1).alias("kind"), "vec_id", "v", "floor"))
    rows = rows.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, x_ids, x, tree = None, None, None, None
        for (*at, kind), t in pieces(batches, ["cell", "chunk", "kind"], QUERY_ROWS):
            if kind == 0:
                # The vectors of a block come first; a block of more than one piece is put together.
                ids, v = t.column("vec_id").to_numpy(), matrix(t.column("v"))
                x_ids, x = (np.concatenate([x_ids, ids]), np.concatenate([x, v])) if at == block else (ids, v)
                block, tree = at, None
            elif at == block:
                ids, v = t.column("vec_id").to_numpy(), matrix(t.column("v"))
                floor = t.column("floor").to_pandas().fillna(LEAST).to_numpy(np.int64)
                tree = tree or CoverTree(x)
                best = dual_search(ids, v, floor, x_ids, x, k, tree)
                hit = best.id != MOST
                yield pa.record_batch([pa.array(np.repeat(ids, k)[hit.ravel()]), pa.array(best.id.ravel()[hit.ravel()]), pa.array(best.score.ravel()[hit.ravel()])], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vecs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of ``vecs`` other than its own. Both have (vec_id, v)."""
    pivots = pivots_of(vecs)
    vecs, queries = with_cells(vecs, pivots), with_cells(queries.dropDuplicates(["vec_id", "v"]), pivots)
    counts, groups = chunk_counts(vecs, BLOCK_ROWS), chunk_counts(queries, (GROUP_ROWS, GROUP_ROWS))
    blocks = written(in_chunks(vecs, counts, "chunk"), "vector-blocks")
    asked = written(in_chunks(queries, groups, "member"), "vector-queries")
    # Every block of a length of vector, as (cell, chunks) pairs; the pairs are as many as the cells.
    cells = F.array(*[F.struct(F.lit(c // PIVOTS).cast("int").alias("dim"), F.lit(c).cast("long").alias("cell"), F.lit(n).cast("long").alias("chunks")) for c, n in counts.items()]) if counts else F.expr("cast(array() as array<struct<dim:int,cell:bigint,chunks:bigint>>)")
    chunks_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    # Own cell first: each query to every chunk of it.
    own = asked.withColumn("to", F.filter(cells, lambda c: c["cell"] == F.col("cell"))[0]).where("to is not null")
    own = own.withColumn("chunk", chunks_of(F.col("to.chunks"))).withColumn("floor", F.lit(None).cast("long"))
    near = written(search_blocks(blocks, own, k), "near-products")
    floors = top(near, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    known = written(asked.join(floors, "vec_id", "left"), "query-floors")
    # Then, of the other cells, the blocks whose bound reaches the worst floor of a group of queries.
    ends = written(summaries(blocks, "chunk"), "block-summaries").select(F.col("cell").alias("to_cell"), F.col("chunk").alias("to_chunk"), F.col("center").alias("xc"), F.col("radius").alias("xr"), F.col("norm").alias("xn"))
    worst = known.groupBy("cell", "member").agg(F.min(F.coalesce("floor", F.lit(-(1 << 63)))).alias("worst"))
    group = summaries(known, "member").join(worst, ["cell", "member"]).withColumn("to", F.explode(F.filter(cells, lambda c: (c["dim"] == F.size("center")) & (c["cell"] != F.col("cell")))))
    pairs = group.withColumn("to_chunk", chunks_of(F.col("to.chunks"))).withColumn("to_cell", F.col("to.cell")).join(ends, ["to_cell", "to_chunk"])
    dot = F.aggregate(F.zip_with("center", "xc", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    bound = dot + F.col("norm") * F.col("xr") + F.col("xn") * F.col("radius") + F.col("radius") * F.col("xr")
    pairs = pairs.where(bound + F.abs(bound) * 1e-9 + 1e-6 >= F.col("worst")).select("cell", "member", "to_cell", "to_chunk")
    far = known.join(pairs, ["cell", "member"]).select(F.col("to_cell").alias("cell"), F.col("to_chunk").alias("chunk"), "vec_id", "v", "floor")
    return top(near.unionByName(search_blocks(blocks, far, k)), k).select("query_id", "rank", "vec_id", "score")


def op9_cover_tree_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(table(spark, sf_dir, "embeddings"))
    return top_k(v, v.where(F.col("vec_id") % 50 == 0))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
