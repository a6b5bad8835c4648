"""Token-ID output: independent zstandard frames with a trailing seek table.

A shard is a run of zstandard frames, each of which decompresses alone, then one skippable frame with the seek table, so any
zstandard tool reads the shard as one stream. Layout (all numbers little-endian):

* data frame: ids of consecutive documents as unsigned 32-bit integers, at most FRAME_IDS ids in a frame unless one document
  alone has more (it then spans several frames, so memory stays bounded),
* skippable frame (magic 0x184D2A5E, length): a zstandard-compressed table of the frames (offset, compressed bytes, ids,
  CRC-32 of the raw bytes) and of the documents (doc_id, first frame, first id in that frame, number of ids), then a footer
  (compressed length of the table, its CRC-32, magic "LOOMSEEK").

A reader takes the footer, the table, and then only the frames of the documents it wants; every frame is checked against its
CRC-32 before use.

Documents are dealt out by ranges of doc_id and sorted within them, so that shard k holds smaller ids than shard k + 1 and
``start`` is a count within the shard plus the totals of the shards before, a running sum over one row for each shard.

The ids are the tokenizers library's for every text. For the vocabulary whose normaliser and word pattern are FOLDING, chunks of text
are encoded once and remembered; with any other vocabulary each text goes through the library whole.

Cases: null and empty texts have just the end id; rows with a null doc_id come first (Spark sorts nulls first); repeated
doc_ids keep one entry for each row, in the order of their texts; an empty table gives no shard and no rows; other columns
are left out.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import holding, shared_dir, small_batches, table, take, vocabulary, written
from .files import reading, size, writing

#: Most ids of one frame.
FRAME_IDS = 1 << 16
#: About so many characters of text make one shard.
SHARD_CHARS = 64 << 20
#: Bytes of chunks and ids that a worker remembers: with more, numbering the known chunks of each batch takes longer than new ones take.
REMEMBERED = 14 << 20
#: Bytes that a remembered chunk takes besides its contents, and most bytes of one.
ENTRY, LONGEST = 20, 1 << 10
#: Bytes of text that are encoded together.
GATHERED = 6 << 20
#: Texts with one of these stay as they are. Of the characters up to U+024F only U+0130 has a lower case that is no letter (it ends in a
#: combining dot), none composes with another and none is changed by NFC; "<|" may begin a special token.
ODD = r"[^\x00-\x{24f}]|\x{130}|<\|"
#: A chunk that is one word of the pattern below. NFC leaves these letters as they are, and each has one letter as its lower case.
WORD = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+$"
#: The printable characters of bytes, but that of the blank.
SYMBOLS = {b: c for c, b in byte_symbols().items() if b != 0x20}
# The normaliser's steps and the word pattern under which a text's ids are those of its chunks, folded as below.
FOLDING = (["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

MAGIC, SKIPPABLE = b"LOOMSEEK", 0x184D2A5E
FRAME = np.dtype([("offset", "<u8"), ("bytes", "<u4"), ("ids", "<u4"), ("crc", "<u4")])
DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("first", "<u4"), ("ids", "<u8")])
FOOTER = struct.Struct("<II8s")


def folds(path: str) -> bool:
    """Whether the vocabulary's normaliser and word pattern are those of FOLDING."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    steps = [s.get("type") for s in (j.get("normalizer") or {}).get("normalizers", [])]
    split = next((p["pattern"].get("Regex") for p in (j.get("pre_tokenizer") or {}).get("pretokenizers", []) if p.get("type") == "Split"), None)
    return (steps, split) == FOLDING


def spelled(text: str) -> str:
    """``text`` with a printable character for each byte, as byte-level vocabularies spell it; blanks stay."""
    return text if text.isascii() else text.encode().decode("latin-1").translate(SYMBOLS)


class Chunks:
    """Chunk of text between white space -> its ids by the tokenizers library. The vocabulary's pattern never crosses white
    space, so a text's ids are those of its chunks in turn. New chunks go through the library together: those that are one WORD as
    the words of a tokenizer that has the vocabulary's merges only, since normaliser and pattern leave them as they are but for
    lower case; all others through the whole tokenizer, parted by one of its special tokens.

    Known chunks stand before the new ones when these are numbered, so one pass of Arrow finds both. Those that came up in
    most batches are kept."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.known, self.ids, self.seen = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, np.int32)
        self.folds = folds(path)
        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        if self.folds:
            self.sep_id, self.sep = next((i, x.content) for i, x in sorted(t.get_added_tokens_decoder().items()) if x.special and not (x.lstrip or x.rstrip or x.single_word))
            self.odd = self.sep[0]
            self.plain, suffix = Tokenizer(t.model), t.model.end_of_word_suffix
            self.plain.pre_tokenizer = WhitespaceSplit()
            self.last = np.zeros(t.get_vocab_size(), bool)  # the ids that end a word
            self.last[[i for x, i in t.get_vocab(with_added_tokens=False).items() if suffix and x.endswith(suffix)]] = True

    def of_words(self, words: list[str]) -> pa.Array | None:
        """The ids of each of WORDs; None if these don't say where words end, since the vocabulary lacks a byte or marks no ends."""
        ids = [np.array(self.plain.encode_batch_fast([spelled(" ".join(words[k : k + 4096]).lower())], add_special_tokens=False)[0].ids, "<u4") for k in range(0, len(words), 4096)]
        ids = np.concatenate(ids) if ids else np.zeros(0, "<u4")
        ends = np.append(0, np.flatnonzero(self.last[ids]) + 1)
        if len(ends) != len(words) + 1 or ends[-1] != len(ids):
            return None
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer((ends * 4).astype("<i8")), pa.py_buffer(ids)])

    def of_any(self, chunks: list[str]) -> pa.Array:
        """The ids of each chunk."""
        out = {}
        plain = [c for c in chunks if self.odd not in c]
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([self.sep.join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends, raw = [*(np.flatnonzero(ids == self.sep_id) * 4).tolist(), len(ids) * 4], ids.tobytes()
            at = 0
            for c, end in zip(part, ends, strict=True):
                out[c] = raw[at:end]
                at = end + 4
        for c in chunks:
            if self.odd in c:
                out[c] = np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
        return pa.array([out[c] for c in chunks], pa.large_binary())

    def learn(self, chunks: pa.Array) -> pa.Array:
        """The ids of these chunks, by the library."""
        is_word = pc.match_substring_regex(chunks, WORD).to_numpy(zero_copy_only=False)
        words = self.of_words(chunks.filter(pa.array(is_word)).to_pylist())
        if words is None:
            return self.of_any(chunks.to_pylist())
        place = np.empty(len(chunks), np.int64)
        place[np.append(np.flatnonzero(is_word), np.flatnonzero(~is_word))] = np.arange(len(chunks))
        return pa.concat_arrays([words, self.of_any(chunks.filter(pa.array(~is_word)).to_pylist())]).take(pa.array(place))

    def all(self, chunks: pa.Array) -> pa.Array:
        """The ids of each chunk, as bytes."""
        n = len(self.known)
        coded = pa.concat_arrays([self.known, chunks]).dictionary_encode()
        self.known, at = coded.dictionary, coded.indices[n:]
        self.ids = pa.concat_arrays([self.ids, self.learn(self.known[n:])])
        out = self.ids.take(at)
        self.seen = np.append(self.seen, np.zeros(len(self.known) - n, np.int32))
        self.seen[at.to_numpy()] += 16
        if self.known.nbytes + self.ids.nbytes + self.seen.nbytes > REMEMBERED:
            self.forget()
        return out

    def forget(self) -> None:
        """Keep the chunks that came up in most batches, later batches counting more: half of what may be held."""
        size = (pc.binary_length(self.known).to_numpy() + pc.binary_length(self.ids).to_numpy()).astype(np.int64) + ENTRY
        first = np.argsort(-self.seen, kind="stable")
        first = first[size[first] <= LONGEST]
        kept = np.sort(first[np.cumsum(size[first]) <= REMEMBERED // 2])
        self.known, self.ids, self.seen = self.known.take(pa.array(kept)), self.ids.take(pa.array(kept)), self.seen[kept] // 2


@lru_cache(maxsize=2)
def chunks_of(path: str) -> Chunks:
    return Chunks(path)


def encode_texts(texts: pa.Array, path: str, end_id: int) -> list[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit integers, with the end id.

    Fewer different chunks remain where ASCII letters are put in lower case and marks between a letter and white space are
    parted from the word, as the vocabulary does both itself; texts with ODD characters stay as they are, since there a lower
    case letter could compose with what follows, or a special token arise."""
    holding("chunks", chunks_of.cache_clear)
    if texts.offset:  # pyarrow's ascii_lower reads a slice at the wrong place
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts, end = pc.fill_null(texts.cast(pa.large_string()), ""), struct.pack("<I", end_id)
    chunks = chunks_of(path)
    if not chunks.folds:
        return [np.array(e.ids, "<u4").tobytes() + end for e in chunks.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
    parted = pc.replace_substring_regex(pc.ascii_lower(texts), r"(\p{L})([.,;:!?|*#$%&]+)(\s)", r"\1 \2\3")
    parts = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, ODD), texts, parted))
    ids = chunks.all(parts.flatten())
    _, ends, data = ids.buffers()
    bounds = np.frombuffer(ends, "<i8", len(ids) + 1, ids.offset * 8) if len(ids) else np.zeros(1, "<i8")
    offsets = parts.offsets.to_numpy()
    at = bounds[offsets - offsets[0]].tolist()
    view = memoryview(data if data is not None else b"")
    return [view[a:b].tobytes() + end for a, b in zip(at, at[1:], strict=False)]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold GATHERED bytes: more of a worker's chunks are then found once for many texts."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= GATHERED:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
            pa.default_memory_pool().release_unused()
    yield from pa.Table.from_batches(held).combine_chunks().to_batches() if held else []


class ShardWriter:
    """Puts the ids of documents, in the order they come, into one file."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.frames: list[tuple] = []
        self.docs: list[tuple] = []
        self.held: list[bytes] = []
        self.n = 0
        self.pack = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        if self.n and self.n + n > FRAME_IDS:
            self.flush()
        self.docs.append((doc_id or 0, doc_id is None, len(self.frames), self.n, n))
        for k in range(0, len(ids), FRAME_IDS * 4):
            if k:
                self.flush()
            self.held.append(ids[k : k + FRAME_IDS * 4])
            self.n += len(self.held[-1]) // 4

    def flush(self) -> None:
        if self.n:
            raw = b"".join(self.held)
            data = self.pack.compress(raw)
            self.out.write(data)
            self.frames.append((self.at, len(data), self.n, zlib.crc32(raw)))
            self.at += len(data)
            self.held, self.n = [], 0

    def close(self) -> None:
        self.flush()
        head = struct.pack("<II", len(self.frames), len(self.docs))
        seek = zstandard.compress(head + np.array(self.frames, FRAME).tobytes() + np.array(self.docs, DOC).tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE, len(seek) + FOOTER.size) + seek + FOOTER.pack(len(seek), zlib.crc32(seek), MAGIC))


class Shard:
    """Random access to one file: ``docs`` is the table of its documents; ``ids(k)`` decompresses only what document k needs."""

    def __init__(self, file, length: int):
        self.file = file
        file.seek(length - FOOTER.size)
        n, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        file.seek(length - FOOTER.size - n)
        seek = file.read(n)
        if zlib.crc32(seek) != crc:
            raise ValueError("the seek table is damaged")
        raw = zstandard.decompress(seek)
        frames, docs = struct.unpack_from("<II", raw)
        self.frames = np.frombuffer(raw, FRAME, frames, 8)
        self.docs = np.frombuffer(raw, DOC, docs, 8 + frames * FRAME.itemsize)
        self.open: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.open[0] != k:
            f = self.frames[k]
            self.file.seek(int(f["offset"]))
            raw = zstandard.ZstdDecompressor().decompress(self.file.read(int(f["bytes"])), max_output_size=int(f["ids"]) * 4)
            if zlib.crc32(raw) != f["crc"]:
                raise ValueError(f"frame {k} is damaged")
            self.open = (k, raw)
        return self.open[1]

    def ids(self, k: int) -> bytes:
        d = self.docs[k]
        left, frame, first, out = int(d["ids"]) * 4, int(d["frame"]), int(d["first"]) * 4, []
        while left > 0:
            part = self.frame(frame)[first : first + left]
            out.append(part)
            left, frame, first = left - len(part), frame + 1, 0
        return b"".join(out)


def write_token_shards(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the ids of every text in ascending order of doc_id. Returns (shard, uri, n_docs, n_ids), one row for each shard."""
    path = path or vocabulary("word_bpe_49k.json")
    d = take(docs, "doc_id", "text")
    chars = d.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // SHARD_CHARS), min(-(-chars >> 20), 4 * d.sparkSession.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{part:06d}.tok.zst"
        docs_n = ids_n = 0
        with writing(uri) as out:
            w = ShardWriter(out)
            for b in gathered(batches):
                for doc_id, ids in zip(b.column(0).to_pylist(), encode_texts(b.column(1), path, end_id), strict=True):
                    w.add(doc_id, ids)
                    docs_n, ids_n = docs_n + 1, ids_n + len(ids) // 4
            w.close()
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([uri]), pa.array([docs_n], pa.int64()), pa.array([ids_n], pa.int64())], ["shard", "uri", "n_docs", "n_ids"])

    ranged = small_batches(d).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ranged.mapInArrow(run, "shard int, uri string, n_docs long, n_ids long"), "token-shards")


def read_token_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: ``start`` counts the ids of all documents before."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each SHARD_CHARS of the corpus
    listed = shards.where("n_docs > 0").select(F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "uri")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, uri in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with reading(uri) as f:
                    shard = Shard(f, size(uri))
                    n = shard.docs["ids"].astype(np.int64)
                    first = start + np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
                    for k in range(0, len(n), 4096):
                        crc = [zlib.crc32(shard.ids(i)) for i in range(k, min(k + 4096, len(n)))]
                        part = shard.docs[k : k + 4096]
                        yield pa.record_batch([pa.array(part["doc_id"].astype(np.int64), mask=part["null"].astype(bool)), pa.array(first[k : k + 4096]), pa.array(n[k : k + 4096]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.repartition(max(1, shards.count()), "uri").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents in ``wanted.doc_id``. Each shard gets the ids in its range and decompresses only their frames."""
    entries = shards.select("shard", "uri").repartition("uri").mapInArrow(_listed, "shard int, uri string, doc_id long, position int")
    found = entries.join(take(wanted, "doc_id").distinct(), "doc_id").repartition("uri").sortWithinPartitions("uri", "position")
    return found.mapInArrow(_fetch, "doc_id long, ids array<long>")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for shard, uri in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            with reading(uri) as f:
                docs = Shard(f, size(uri)).docs
            for k in range(0, len(docs), 65536):
                part = docs[k : k + 65536]
                m = len(part)
                yield pa.record_batch([pa.array([shard] * m, pa.int32()), pa.array([uri] * m), pa.array(part["doc_id"].astype(np.int64), mask=part["null"].astype(bool)), pa.array(np.arange(k, k + m, dtype=np.int32))], ["shard", "uri", "doc_id", "position"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .common import grouped

    for t in grouped(batches, ["uri"]):
        uri = t.column("uri")[0].as_py()
        with reading(uri) as f:
            shard = Shard(f, size(uri))
            for doc_id, k in zip(t.column("doc_id").to_pylist(), t.column("position").to_pylist(), strict=True):
                ids = np.frombuffer(shard.ids(k), "<u4").astype(np.int64)
                yield pa.record_batch([pa.array([doc_id], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["doc_id", "ids"])


def op5_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_token_shards(write_token_shards(docs, shared_dir(spark, "token-frames")))
