"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: the conditions that any text holding a match must
meet. One pass over a block of documents, whatever the number of rules, makes postings: for each trigram of the queries the
ascending rows that have it. A query intersects (AND) and unites (OR) postings, and only the candidate rows are searched with
the expression. Rules for which no trigram is mandatory search every row.

A scan keeps postings where the texts are, a block of a partition at a time (BLOCK_BYTES of text), so neither is shuffled and
memory is bounded by a block. ``trigram_index`` makes the same postings as a table, to be written once and asked by later
rules (``candidates_in``). Matching folds ASCII letters to lower case in the index, which only widens the candidates.

Cases: null and empty texts have no spans; every row is judged alone, so repeated rows and null ids change nothing; very long
texts are searched whole, and each expression takes time linear in the text; an empty table gives no rows; other columns are
left out.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches, table, take

# ---------------------------------------------------------------- trigram queries

#: A query is True (no condition), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple

#: Of a string's trigrams a query keeps so many, those with the rarest letters; leaving some out only widens the candidates.
MANDATORY = 3
COMMON = "etaonihsrdlu"
#: Most strings that an exact set may hold before it is turned into trigrams.
EXACT = 64
#: Bytes of text in one block of postings, at about most (one text alone may have more).
BLOCK_BYTES = 4 << 20


def both(a: Query, b: Query) -> Query:
    if a is True:
        return b
    if b is True or a == b:
        return a
    parts = [p for q in (a, b) for p in (q[1] if isinstance(q, tuple) and q[0] == "and" else (q,))]
    return ("and", tuple(dict.fromkeys(parts)))


def either(queries: list[Query]) -> Query:
    if True in queries or not queries:
        return True
    parts = tuple(dict.fromkeys(p for q in queries for p in (q[1] if isinstance(q, tuple) and q[0] == "or" else (q,))))
    return parts[0] if len(parts) == 1 else ("or", parts)


def trigrams_of(strings: set[str]) -> Query:
    """What holds if one of the strings occurs."""
    out = []
    for s in sorted(strings):
        q: Query = True
        for g in sorted({s[i : i + 3] for i in range(len(s) - 2)}, key=commonness)[:MANDATORY]:
            q = both(q, g)
        out.append(q)
    return either(out)


def commonness(trigram: str) -> tuple[int, str]:
    return sum(12 - COMMON.find(c) for c in trigram if c in COMMON), trigram


class Part:
    """What is known of a piece of an expression: the exact set of strings it matches (or None), and a query."""

    def __init__(self, exact: set[str] | None, query: Query = True):
        self.exact, self.query = exact, query

    def known(self) -> Query:
        return self.query if self.exact is None else both(self.query, trigrams_of(self.exact))


def concat(parts: list[Part]) -> Part:
    run: set[str] | None = {""}
    query: Query = True
    whole = True
    for p in parts:
        if p.exact is not None and run is not None and len(run) * len(p.exact) <= EXACT:
            run = {a + b for a in run for b in p.exact}
            query = both(query, p.query)
            continue
        query = both(both(query, trigrams_of(run)), p.query)
        whole = False
        run = p.exact if p.exact is not None else {""}
    return Part(run, query) if whole else Part(None, both(query, trigrams_of(run)))


def analyse(tree) -> Part:
    parts = []
    for op, arg in tree:
        if op is sre.LITERAL:
            parts.append(Part({chr(arg).lower() if chr(arg).isascii() else chr(arg)}))
        elif op is sre.IN:
            chars: set[str] | None = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < 4:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    chars = None
                    break
            parts.append(Part(chars if chars and len(chars) <= 4 else None))
        elif op is sre.SUBPATTERN:
            parts.append(analyse(arg[3]))
        elif op is sre.BRANCH:
            options = [analyse(x) for x in arg[1]]
            if all(o.exact is not None for o in options) and sum(len(o.exact) for o in options) <= EXACT and all(o.query is True for o in options):
                parts.append(Part(set().union(*[o.exact for o in options])))
            else:
                parts.append(Part(None, either([o.known() for o in options])))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, sub = arg
            inner = analyse(sub)
            if (low, high) == (0, 1) and inner.exact is not None and inner.query is True:
                parts.append(Part(inner.exact | {""}))
            elif low == high and inner.exact is not None and len(inner.exact) == 1 and low * max(map(len, inner.exact)) <= 16:
                parts.append(Part({next(iter(inner.exact)) * low}, inner.query))
            else:
                parts.append(Part(None, inner.known() if low else True))
        elif op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
            parts.append(Part({""}) if op is sre.AT else Part(None))
        else:
            parts.append(Part(None))
    return concat(parts)


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of an expression, over text in lower case. True: no trigram is mandatory."""
    return analyse(sre_parser.parse(pattern)).known()


def trigrams_in(q: Query) -> set[str]:
    if q is True:
        return set()
    return {q} if isinstance(q, str) else set().union(*map(trigrams_in, q[1]))


# ---------------------------------------------------------------- rules


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    accept: Callable[[re.Match], bool] | None = None


def long_value(m: re.Match) -> bool:
    return len(m[2]) >= 6


def long_access(m: re.Match) -> bool:
    return m.end() - m.start() >= 20


def long_hex(m: re.Match) -> bool:
    return m.end() - m.start() >= 24


# The base rules, in the order in which equal starts are listed.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", long_value),
    Rule("access", r"AKIA[A-Z0-9]+", long_access),
    Rule("hex", r"[0-9a-f]+", long_hex),
]
# The published shapes of well-known credentials, which the method adds.
ADDED = [
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("github", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("stripe", r"\b[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("bearer", r"\b[Aa]uthorization: ?[Bb]earer [A-Za-z0-9._~+/-]{16,}"),
    Rule("url_login", r"\b(?:postgres|postgresql|mysql|mongodb|redis|amqp|https?|ftp)://[A-Za-z0-9._-]+:[^\s:@/]{4,64}@[A-Za-z0-9.-]+"),
]
RULES = BASE + ADDED


class Lookup:
    """Trigrams by the number of their three bytes."""

    def __init__(self, trigrams: list[str]):
        self.trigrams = trigrams
        self.place = np.zeros(1 << 24, np.uint16)  # 0: no trigram of any query
        for i, g in enumerate(trigrams):
            a, b, c = g.encode("utf-8")[:3]  # of a longer one the first three bytes are mandatory as well
            self.place[a << 16 | b << 8 | c] = i + 1

    def postings(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """trigram -> the ascending rows whose text has it, for texts in lower case."""
        gap = b"\xff\xff"  # never part of UTF-8, so no trigram reaches from text to text
        codes = np.frombuffer(gap.join(texts) + gap, np.uint8)
        ends = np.cumsum([len(t) + 2 for t in texts])
        three = codes[:-2].astype(np.uint32)
        for part in (codes[1:-1], codes[2:]):
            three <<= 8
            three |= part
        found = self.place[three]
        at = np.flatnonzero(found)
        row = np.searchsorted(ends, at, "right")
        pairs = np.unique(found[at].astype(np.int64) * len(texts) + row)
        marks, rows = pairs // len(texts), pairs % len(texts)
        bounds = np.searchsorted(marks, np.arange(1, len(self.trigrams) + 2))
        return {g: rows[a:b] for g, a, b in zip(self.trigrams, bounds, bounds[1:], strict=False)}


def rows_for(q: Query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    """The rows of a block of n texts that meet a query."""
    if q is True:
        return np.arange(n)
    if isinstance(q, str):
        return postings[q]
    parts = [rows_for(p, postings, n) for p in q[1]]
    return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True) if q[0] == "and" else np.union1d(a, b), parts)


@lru_cache(maxsize=1)
def compiled():
    out = []
    for order, r in enumerate(RULES):
        q = trigram_query(r.pattern)
        fast = r"[0-9a-f]{24,}" if r.kind == "hex" else r.pattern  # a run shorter than 24 fails wherever it is entered
        out.append((order, r.kind, re.compile(fast, re.ASCII), q, r.accept))
    return out, Lookup(sorted(set().union(*[trigrams_in(x[3]) for x in out])))


def block_spans(texts: list[str]) -> list[list[tuple[int, int, str, int]]]:
    """For each text of a block its spans (start, order of the kind, kind, end), sorted."""
    rules, lookup = compiled()
    postings = lookup.postings([t.encode("utf-8").lower() for t in texts])
    found: list[list] = [[] for _ in texts]
    for order, kind, pattern, q, accept in rules:
        for i in rows_for(q, postings, len(texts)).tolist():
            found[i] += [(m.start(), order, kind, m.end()) for m in pattern.finditer(texts[i]) if accept is None or accept(m)]
    for f in found:
        f.sort()
    return found


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of consecutive rows with about BLOCK_BYTES of text."""
    ids, texts, n = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or "")
            n += len(texts[-1])
            if n >= BLOCK_BYTES:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def trigram_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(trigram, id): the documents whose text in lower case has each of the trigrams; one row for each, made block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(trigrams)
        for ids, texts in blocks(batches):
            for g, rows in lookup.postings([t.encode("utf-8").lower() for t in texts]).items():
                yield pa.record_batch([pa.array([g] * len(rows), pa.string()), pa.array([ids[i] for i in rows.tolist()], pa.int64())], ["trigram", "id"])

    d = take(docs, id_col, text_col).toDF("id", "text").where("id is not null")
    return small_batches(d).select(F.col("id").cast("long"), "text").mapInArrow(run, "trigram string, id long").distinct()


def candidates_in(index: DataFrame, pattern: str) -> DataFrame | None:
    """(id) of the indexed documents that may match an expression; None if no trigram is mandatory, so that all must be searched."""
    q = trigram_query(pattern)
    if q is True:
        return None
    asked = sorted(trigrams_in(q))

    def meets(part: Query) -> Column:
        if isinstance(part, str):
            return F.array_contains("found", part)
        return reduce(lambda a, b: a & b if part[0] == "and" else a | b, [meets(p) for p in part[1]])

    return index.where(F.col("trigram").isin(asked)).groupBy("id").agg(F.collect_set("trigram").alias("found")).where(meets(q)).select("id")


def joined(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of each row; places in code points, ``end`` exclusive."""
    d = take(docs, id_col, text_col).toDF("doc_id", "text")
    id_type = to_arrow_type(d.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            spans = [[{"kind": k, "start": s, "end": e} for s, _, k, e in f] for f in block_spans(texts)]
            yield pa.record_batch([pa.array(ids, id_type), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "spans"])

    return small_batches(d).mapInArrow(run, f"doc_id {d.schema[0].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")


def op6_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [[s["kind"] for s in row] for row in b.column(1).to_pylist()]
            n = [pa.array([k.count(r.kind) for k in kinds], pa.int64()) for r in BASE]
            texts = [[f"{s['kind']}:{s['start']}:{s['end']}" for s in row] for row in b.column(1).to_pylist()]
            base = {r.kind for r in BASE}
            sha = [hashlib.sha256(",".join(x for x, k in zip(t, ks, strict=True) if k in base).encode()).hexdigest() for t, ks in zip(texts, kinds, strict=True)]
            yield pa.record_batch([b.column(0), *n, pa.array(sha), pa.array([",".join(t) for t in texts], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    spans = find_secrets(table(spark, sf_dir, "documents"))
    return spans.mapInArrow(run, f"doc_id {spans.schema[0].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
