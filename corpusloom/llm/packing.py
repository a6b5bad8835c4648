"""Packing by sum of squares: documents are placed online into windows of a fixed number of ids.

A level array counts the open windows by fill: ``n[h]`` windows hold h ids. A piece of s ids goes into the level h (0 is a new
window) after which the sum of ``n[h] ** 2`` over the partial fills is smallest; of equal levels the fullest is taken. So no fill
becomes crowded, and for nearly every piece that comes there is a window that it completes.

A document longer than a window fills whole windows first; only its rest is placed. When OPEN windows are open, the most crowded
level is poured together: its windows top each other up, cutting a piece where a window is full. At the end of a partition
all open windows are poured together, and what is left, less than one window, becomes sequences of powers of two ids, which need
no padding. Each partition of the documents is packed by one task; nothing is shuffled, and a task holds at most OPEN windows.

Cases: null and empty texts are documents with just the end id; rows with a null doc_id and repeated rows are documents of their
own; texts of any length are cut; an empty table gives no sequence; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, take, vocabulary
from .frames import encode_texts, gathered

#: Ids of a window.
WINDOW = 2048
#: Most windows of a task that are open at a time.
OPEN = 4096
#: Sequences of one Arrow batch.
BATCH_SEQUENCES = 256
FAR = np.iinfo(np.int64).max


class Window:
    """Pieces (document, start, ids as bytes of little-endian unsigned 32-bit integers) and the number of their ids."""

    __slots__ = ("pieces", "fill")

    def __init__(self):
        self.pieces, self.fill = [], 0

    def add(self, doc: int, start: int, ids: bytes) -> None:
        self.pieces.append((doc, start, ids))
        self.fill += len(ids) // 4


def pour(windows: list[Window], size: int) -> tuple[list[Window], Window | None]:
    """Full windows made of these, and the one that remains partly filled. The fullest are topped up from the emptiest, and a
    piece is cut where a window becomes full."""
    windows = sorted(windows, key=lambda w: -w.fill)
    full, i, j = [], 0, len(windows) - 1
    while i < j:
        into, source = windows[i], windows[j]
        while source.pieces and into.fill < size:
            doc, start, ids = source.pieces.pop()
            part = ids[: (size - into.fill) * 4]
            into.add(doc, start, part)
            source.fill -= len(part) // 4
            if len(part) < len(ids):
                source.pieces.append((doc, start + len(part) // 4, ids[len(part) :]))
        if into.fill == size:
            full.append(into)
            i += 1
        if not source.pieces:
            j -= 1
    return full, windows[i] if i == j else None


def powers_of_two(window: Window) -> list[Window]:
    """The ids of a window as windows of as few powers of two as they need, the largest first."""
    out, size = [], 0
    for doc, start, ids in window.pieces:
        while ids:
            if not size:
                out.append(Window())
                size = 1 << (window.fill.bit_length() - 1)
            part = ids[: (size - out[-1].fill) * 4]
            out[-1].add(doc, start, part)
            start, ids = start + len(part) // 4, ids[len(part) :]
            if out[-1].fill == size:
                window.fill -= size
                size = 0
    return out


class Packer:
    """Places pieces by the smallest sum of squares; windows that are done wait in ``done``."""

    def __init__(self, size: int = WINDOW, most: int = OPEN):
        self.size, self.most, self.open = size, most, 0
        self.n = np.zeros(size + 1, np.int64)
        self.at: list[list[Window]] = [[] for _ in range(size + 1)]
        self.done: list[Window] = []

    def level(self, s: int) -> int:
        """The level for a piece of s ids: what each choice adds to the sum of squares follows from two entries of the array."""
        n, last = self.n, self.size - s
        # A window that becomes full leaves the sum: 1 - 2 n[h]. A new one comes in: 2 n[s] + 1.
        best, cost = (last, 1 - 2 * n[last]) if n[last] else (0, 2 * n[s] + 1)
        if last > 1:
            adds = np.where(n[1:last] > 0, 2 * (n[s + 1 : self.size] - n[1:last]) + 2, FAR)[::-1]
            k = int(adds.argmin())
            if adds[k] < cost or (adds[k] == cost and not best):
                best = last - 1 - k
        return best

    def put(self, window: Window) -> None:
        if window.fill == self.size:
            self.done.append(window)
            return
        self.at[window.fill].append(window)
        self.n[window.fill] += 1
        self.open += 1

    def add(self, doc: int, ids: bytes) -> None:
        """All ids of a document: whole windows, then the rest by the level array."""
        whole = len(ids) // (self.size * 4) * self.size * 4
        for k in range(0, whole, self.size * 4):
            window = Window()
            window.add(doc, k // 4, ids[k : k + self.size * 4])
            self.done.append(window)
        s = (len(ids) - whole) // 4
        if not s:
            return
        h = self.level(s)
        if h:
            window = self.at[h].pop()
            self.n[h] -= 1
            self.open -= 1
        else:
            window = Window()
        window.add(doc, whole // 4, ids[whole:])
        self.put(window)
        if self.open >= self.most:
            crowded = int(self.n.argmax())
            self.settle([crowded] if self.n[crowded] > 1 else list(range(1, self.size)))

    def settle(self, levels: list[int]) -> None:
        """Pour the open windows of these levels together."""
        windows = [w for h in levels for w in self.at[h]]
        for h in levels:
            self.at[h], self.n[h] = [], 0
        self.open -= len(windows)
        full, left = pour(windows, self.size)
        self.done += full
        if left is not None:
            self.put(left)

    def finish(self) -> None:
        self.settle(list(range(1, self.size)))
        for h in np.flatnonzero(self.n):
            for window in self.at[h]:
                self.done += powers_of_two(window)
            self.at[h], self.n[h] = [], 0
        self.open = 0


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """One row for each sequence: (sequence_id, n_ids, padded, ids, pieces). ``ids`` are little-endian unsigned 32-bit integers
    without padding, ``padded`` is the length that the sequence takes, ``pieces`` its (doc_id, start, length, doc_tokens, offset)
    in order. Sequence ids are unique, not consecutive."""
    path = path or vocabulary("word_bpe_49k.json")
    d = take(docs, "doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()

    def sequences(windows: list[Window], known: dict, first: int, id_type: pa.DataType) -> pa.RecordBatch:
        pieces = [(*known[doc], start, len(ids) // 4) for w in windows for doc, start, ids in w.pieces]
        lengths = [x[3] for x in pieces]
        counts = np.array([len(w.pieces) for w in windows])
        ends = np.concatenate([[0], np.cumsum(counts)])
        run = np.concatenate([[0], np.cumsum(lengths)])
        offset = run[:-1] - np.repeat(run[ends[:-1]], counts)
        fill = [w.fill for w in windows]
        fields = [pa.array([x[0] for x in pieces], id_type), pa.array([x[2] for x in pieces], pa.int64()), pa.array(lengths, pa.int64()), pa.array([x[1] for x in pieces], pa.int64()), pa.array(offset, pa.int64())]
        return pa.record_batch(
            [
                pa.array(np.arange(first, first + len(windows)), pa.int64()),
                pa.array(fill, pa.int64()),
                pa.array([n if n & (n - 1) == 0 else window for n in fill], pa.int64()),
                pa.array([b"".join([x[2] for x in w.pieces]) for w in windows], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["doc_id", "start", "length", "doc_tokens", "offset"])),
            ],
            ["sequence_id", "n_ids", "padded", "ids", "pieces"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, known, seen = Packer(window), {}, 0
        at = TaskContext.get().partitionId() << 40
        id_type = pa.int64()

        def done(all_of_them: bool) -> Iterator[pa.RecordBatch]:
            nonlocal at
            while len(packer.done) >= (1 if all_of_them else BATCH_SEQUENCES):
                part, packer.done = packer.done[:BATCH_SEQUENCES], packer.done[BATCH_SEQUENCES:]
                yield sequences(part, known, at, id_type)
                at += len(part)

        for b in gathered(batches):
            id_type = b.column(0).type
            for doc_id, ids in zip(b.column(0).to_pylist(), encode_texts(b.column(1), path, end_id), strict=True):
                known[seen] = (doc_id, len(ids) // 4)
                packer.add(seen, ids)
                seen += 1
                yield from done(False)
            if len(known) > 4 * OPEN:  # documents that no open or waiting window holds are forgotten
                held = {doc for level in [*packer.at, packer.done] for w in level for doc, _, _ in w.pieces}
                known = {doc: known[doc] for doc in held}
        packer.finish()
        yield from done(True)

    pieces = f"array<struct<doc_id:{kind},start:bigint,length:bigint,doc_tokens:bigint,offset:bigint>>"
    return small_batches(d).mapInArrow(run, f"sequence_id long, n_ids long, padded long, ids binary, pieces {pieces}")


def padding_share(sequences: DataFrame) -> DataFrame:
    """One row (n_sequences, n_ids, padding): the ids that the sequences hold and those that padding adds."""
    return sequences.agg(F.count(F.lit(1)).alias("n_sequences"), F.coalesce(F.sum("n_ids"), F.lit(0)).alias("n_ids"), F.coalesce(F.sum(F.col("padded") - F.col("n_ids")), F.lit(0)).alias("padding"))


def pieces_of(sequences: DataFrame) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    each = sequences.select("sequence_id", "padded", "ids", F.explode("pieces").alias("p"))
    crc = F.expr("crc32(substring(ids, cast(p.offset * 4 + 1 as int), cast(p.length * 4 as int)))")
    return each.select("p.doc_id", "p.start", "p.length", crc.alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset", "padded")


def op13_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids."""
    return pieces_of(pack_documents(table(spark, sf_dir, "documents")))
