"""BPE encoding and decoding by a tokenization automaton.

A merge list is compiled into a deterministic automaton over tokens that accepts exactly the sequences BPE produces. The
automaton starts with one state in which every base symbol loops; each merge ``(u, v) -> w`` then applies one gadget, in
order of rank:

* the state reached by ``u`` is split from its siblings and loses the arc ``v`` (and, for ``u = v``, the new arc ``w``),
* every state that had ``u`` followed by ``v`` gains the arc ``w``,
* ``w`` leads to a copy of the state that ``v`` led to at that moment.

So the state after a token depends on that token alone. The gadgets are stored as flat tables (left part, right part, rank
of each token; cut arcs with the rank of the gadget that cut them); whether a state has an arc is a walk down the gadgets
that built it, and every answer enters the transition table, so that the walk is made once for each pair in a worker.

A pre-split word is encoded in one pass over its bytes: after byte i the automaton has read the only accepted path that
spells the prefix, whose last arc is kept. The path is then read backwards. Decoding emits the labels of the arcs.

Cases: null and empty texts have no tokens; repeated rows and ties give the same row each; an empty table gives an empty
result; other columns of the input are left out; a null id stays null.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import Remembered, holding, small_batches, table, take, vocabulary

# Fixed value: the pattern of public byte-level BPE that splits text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of one generation of words that a worker remembers.
REMEMBERED = 40 << 20
#: Arcs of the transition table a worker remembers.
ARCS = 1_000_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The compiled merges of one byte-level vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        symbols = byte_symbols()
        self.special = special
        self.label = {i: bytes(symbols[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in special.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        self.table: dict[int, bool] = {}
        made = {i for t, i in vocab.items() if len(t) == 1}
        self.token = {self.label[i]: i for i in made}
        for k, (a, b) in enumerate(merges):
            self.gadget(k, vocab[a], vocab[b], vocab[a + b], made)
        # Tokens by their bytes from the last to the first: node and byte -> node, node -> token.
        self.step: dict[int, int] = {}
        self.ends = [None]
        for label, t in self.token.items():
            node = 0
            for byte in reversed(label):
                node = self.step.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(None)
            self.ends[node] = t

    def gadget(self, k: int, u: int, v: int, w: int, made: set[int]) -> None:
        """Apply merge k. A merge whose pair no accepted sequence holds changes nothing."""
        if u not in made or v not in made or w in made or not self.has(u, v, k):
            return
        self.cut[u, v] = k
        if u == v:
            self.cut[u, w] = k
        self.parts[w], self.rank[w] = (u, v), k
        made.add(w)
        self.token[self.label[w]] = w

    def has(self, a: int, b: int, until: int) -> bool:
        """Whether, before gadget ``until``, the state after ``a`` has the arc ``b``."""
        while True:
            cut = self.cut.get((a, b))
            if cut is not None and cut < until:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if rb > ra:  # the arc came with gadget rb, wherever its left part's arc was
                b, until = self.parts[b][0], rb
            else:  # the state is a copy of the one after a's right part, made at gadget ra
                a, until = self.parts[a][1], ra

    def arc(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= ARCS:
                self.table.clear()
            found = self.table[key] = self.has(a, b, 1 << 60)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        whole = self.token.get(word)
        if whole is not None:
            return [whole]
        last, start = [-1] * (n + 1), [0] * (n + 1)
        step, ends, known, arc = self.step.get, self.ends, self.table.get, self.arc
        for i in range(1, n + 1):
            found, node, j = [], 0, i
            while j and (node := step(node << 8 | word[j - 1])) is not None:
                j -= 1
                t = ends[node]
                if t is not None:
                    found.append(j)
                    found.append(t)
            while found:  # the longest first
                t, j = found.pop(), found.pop()
                if j:
                    ok = known(last[j] << 32 | t)
                    if ok is None:
                        ok = arc(last[j], t)
                    if not ok:
                        continue
                last[i], start[i] = t, j
                break
        ids, i = [], n
        while i:
            ids.append(last[i])
            i = start[i]
        return ids[::-1]

    def decode(self, ids) -> str:
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    model = j["model"]
    merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
    return Automaton(model["vocab"], merges, {t["content"]: t["id"] for t in j.get("added_tokens") or []})


class Words(Remembered):
    """word -> (the decimals of its ids joined by commas, the labels of its arcs)."""

    def __init__(self, auto: Automaton):
        super().__init__(REMEMBERED)
        self.auto = auto

    def __missing__(self, word: str):
        out = self.older.get(word)
        if out is None:
            ids = self.auto.encode_word(word.encode("utf-8"))
            out = (",".join(map(str, ids)), b"".join(map(self.auto.label.__getitem__, ids)))
        return self.keep(word, out, 2 * len(word) + len(out[0]) + len(out[1]))


class Counts(Remembered):
    """word -> number of its ids."""

    def __init__(self, auto: Automaton):
        super().__init__(REMEMBERED)
        self.auto = auto

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = len(self.auto.encode_word(word.encode("utf-8")))
        return self.keep(word, n, 2 * len(word))


@lru_cache(maxsize=2)
def counter(path: str) -> Counts:
    return Counts(automaton(path))


@lru_cache(maxsize=2)
def encoder(path: str):
    auto = automaton(path)
    special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(auto.special, key=len, reverse=True)) + ")") if auto.special else None
    return auto, Words(auto), regex.compile(WORDS).findall, special


def forget() -> None:
    """Drops what this process remembers of automata and words."""
    for remembered in (encoder, counter, automaton):
        remembered.cache_clear()


def pieces(text: str, path: str) -> list[tuple[str, bytes]]:
    """(decimals, label) of each word of a text, special tokens' strings as such."""
    auto, words, split, special = encoder(path)
    if special is None or not any(s in text for s in auto.special):
        return [words[w] for w in split(text)]
    out = []
    for k, part in enumerate(special.split(text)):
        out += [(str(auto.special[part]), part.encode())] if k % 2 else [words[w] for w in split(part)]
    return out


def count(text: str, path: str) -> int:
    """Number of a text's ids, without the ids."""
    auto, _, split, special = encoder(path)
    of = counter(path).__getitem__
    if special is None or not any(s in text for s in auto.special):
        return sum(map(of, split(text)))
    return sum(1 if k % 2 else sum(map(of, split(part))) for k, part in enumerate(special.split(text)))


def encode(text: str | None, path: str) -> list[int]:
    return [int(i) for p in pieces(text or "", path) for i in p[0].split(",")]


def decode(ids: list[int], path: str) -> str:
    return automaton(path).decode(ids)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, n_tokens) of each row, in one pass without a shuffle."""
    path = path or vocabulary("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            holding("bpe", forget)
            ids = [encode(t, path) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64())], ["doc_id", "ids", "n_tokens"])

    d = take(docs, id_col, text_col).toDF("doc_id", "text")
    return small_batches(d).mapInArrow(run, f"doc_id {d.schema[0].dataType.simpleString()}, ids array<int>, n_tokens long")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    path = path or vocabulary("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            holding("bpe", forget)
            texts = [decode(ids or [], path) for ids in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    d = take(encoded, "doc_id", "ids")
    return small_batches(d).mapInArrow(run, f"doc_id {d.schema[0].dataType.simpleString()}, text string")


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of each row."""
    path = path or vocabulary("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            holding("bpe", forget)
            yield pa.record_batch([b.column(0), pa.array([count(t or "", path) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    d = take(docs, "doc_id", "text")
    return small_batches(d).mapInArrow(run, f"doc_id {d.schema[0].dataType.simpleString()}, n_tokens long")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the ids of each text and what they decode to, as digests, so that
    neither leaves its task."""
    path = path or vocabulary("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            holding("bpe", forget)
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1).to_pylist():
                found = pieces(t or "", path)
                ids = ",".join([p[0] for p in found])
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text = b"".join([p[1] for p in found]).decode("utf-8", "replace")
                text_sha.append(hashlib.sha256(text.encode("utf-8")).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    d = take(docs, "doc_id", "text")
    return small_batches(d).mapInArrow(run, f"doc_id {d.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
