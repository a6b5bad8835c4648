"""Personal data by candidate gradient boosting.

Generators of high recall propose spans, which may overlap: things with an @ or spelt-out addresses, dotted and coloned numbers,
long groups of digits with separators, account numbers. Each candidate gets features of its format (digits, separators,
groups) and of its context (characters beside it, telling words before it). Boosted trees, trained here by
Spark's GBTClassifier on a bounded sample, score them; the score's threshold is calibrated on held-out candidates so that at
least PRECISION of what lies above it is personal data. Candidates that pass are added to the spans of the base rules, which
always stay. A candidate that overlaps a base span adds nothing, unless it is of a CONTAINER kind and holds that span and more
(an account number whose digits alone look like a card). Where accepted candidates overlap, the kind that says most wins, then the score.

Training labels are weak. Positive are loose forms of base spans, in the place where the span was found (an address spelt out, a
phone number without its +, a card regrouped), numbers generated for that place (social security, IBAN, IPv6), and candidates of the text that
hold a strict format. Negative are the text's other candidates that the base rules leave to the trees (others are never scored), and
DECOYS put between its words: dates, times, counts, part numbers, prose with "at" and "dot". The facts that make a label (check sums,
valid ranges, a leading +, @domain) are no features, so format and context decide. The sample: the candidates of about SAMPLE_DOCS
documents, chosen by a hash of doc_id, and of these at most SAMPLE_CANDIDATES; all forms of a value go to one side of the held-out split.
The fitted trees are flat arrays in the tasks' closure, so texts are read once and nothing is shuffled.

Cases: null and empty texts have no spans; rows are judged one by one, so repeated rows and null ids change nothing; very long
texts are searched whole, in time linear in the text (n log n in its spans); with no sample of both classes (or an empty table) only the base rules act; other columns are
left out.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, holding, small_batches, table, take

SAMPLE_DOCS, SAMPLE_CANDIDATES = 20_000, 20_000
PRECISION = 0.98
TREES, DEPTH = 10, 3

# The base rules' kinds, in the order in which equal starts are listed, then the added kinds.
BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["address", "ipv6", "iban", "ssn", "number"]
KINDS = BASE_KINDS + ADDED_KINDS
ORDER = {k: i for i, k in enumerate(KINDS)}
#: Kinds that may hold spans of the base rules; they also win over the kinds of any number or address.
CONTAINERS = {"ipv6", "iban", "ssn"}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a run of digits is entered at its start only
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, str, int]  # start, order of the kind, kind, end


def digits_of(s: str) -> str:
    return "".join([c for c in s if c in "0123456789"])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) < 4 and int(s or 0) <= 255


def emails(t: str) -> Iterator[tuple[int, int]]:
    """As the expression finds them, but from each @ outwards, so that long runs without one cost nothing."""
    done, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(t, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = t.find("@", max(at + 1, done))


def base_spans(t: str) -> list[Span]:
    out: list[Span] = []
    if "@" in t:
        out += [(a, 0, "email", b) for a, b in emails(t)]
    if t.count(".") > 2:
        out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(t) if all(map(octet, m[0].split(".")))]
    for m in CARD.finditer(t):
        if m.end() - m.start() > 11:
            d = digits_of(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, "card", m.end()))
    if "+" in t:
        out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(t) if 9 <= len(digits_of(m[0])) <= 15]
    out.sort()
    return out


# ---------------------------------------------------------------- candidates

GENERATORS = [
    ("address", "@", re.compile(r"[^\s@<>()\[\],;:\"]{1,64}@[^\s@<>()\[\],;:\"]{1,255}")),
    ("address", " at ", re.compile(r"\b[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z]{2,24}){1,3}\b")),
    ("address", "at", re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?[(\[{]at[)\]}] ?[A-Za-z0-9-]{1,63}(?: ?[(\[{]?(?:dot|\.)[)\]}]? ?[A-Za-z]{2,24}){1,3}")),
    ("ipv6", ":", re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")),
    ("iban", "", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ssn", "-", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("number", "", re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,23}(?![0-9A-Za-z])")),
]
DIGIT = re.compile(r"[0-9]")
LAST_LETTERS = re.compile(r"[A-Za-z]*\Z")
WORDS_BEFORE = [re.compile(w) for w in (r"(?i)tel|phone|call|mobile|fax", r"(?i)mail|contact", r"(?i)card|visa|amex|credit", r"(?i)\bip\b|server|host|address", r"(?i)ssn|social|iban|account")]


def candidates(t: str) -> list[tuple[int, int, str]]:
    some = DIGIT.search(t) is not None
    out = []
    for kind, mark, pattern in GENERATORS:
        if mark in t if mark else some:
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(t)]
    return out


def strict(kind: str, s: str) -> bool:
    """Whether the format that the kind names holds to the letter."""
    if kind == "iban":
        x = s.replace(" ", "")
        return len(x) >= 15 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    if kind == "ssn":
        return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"
    if kind == "ipv6":
        try:
            return s.count(":") > 2 and ipaddress.ip_address(s).version == 6
        except ValueError:
            return False
    return False


def features(t: str, start: int, end: int, kind: str) -> list[float]:
    s = t[start:end]
    d = digits_of(s)
    groups = [len(g) for g in re.split(r"[^0-9]+", s) if g]
    before, after = t[max(0, start - 24) : start], t[end : end + 1]
    letters = sum(c.isalpha() for c in s)
    return [
        float(ORDER[kind]),
        len(s),
        len(d),
        letters,
        len(s) - len(d) - letters,
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        groups[0] if groups else 0,
        groups[-1] if groups else 0,
        len({c for c in s if not c.isalnum()}),
        float(any(c in s for c in "([{")),
        s.count("-"),
        s.count("."),
        s.count(" "),
        s.count(":"),
        len(LAST_LETTERS.search(s)[0]),
        float(before[-1:].isspace() or not before),
        float(after.isspace() or after in ".,;:!?" or not after),
        *[float(bool(w.search(before))) for w in WORDS_BEFORE],
    ]


class Covered:
    """Sorted spans, asked by bisection what they cover."""

    def __init__(self, spans: list[Span]):
        self.whole = {(a, b) for a, _, _, b in spans}
        self.starts = [s[0] for s in spans]
        self.ends: list[int] = []  # of each span and those before it, the largest end
        for _, _, _, b in spans:
            self.ends.append(max(b, self.ends[-1]) if self.ends else b)

    def overlaps(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start

    def crosses(self, at: int) -> bool:
        """Whether a span begins before ``at`` and ends after it."""
        k = bisect_left(self.starts, at)
        return k > 0 and self.ends[k - 1] > at

    def leaves(self, start: int, end: int, kind: str) -> bool:
        """Whether a candidate is left to the trees by the base rules."""
        if not self.overlaps(start, end):
            return True
        return kind in CONTAINERS and (start, end) not in self.whole and not self.crosses(start) and not self.crosses(end)


# ---------------------------------------------------------------- weak labels

# Countries with the form of their account numbers (A: letter, 0: digit).
IBAN_FORMS = {"DE": "0" * 18, "ES": "0" * 20, "FR": "0" * 23, "GB": "AAAA" + "0" * 14, "NL": "AAAA" + "0" * 10}
ENDINGS = ["com", "org", "net", "gov", "edu", "info", "de", "fr", "es", "co.uk"]
#: Characters kept on both sides of a planted form.
AROUND = 40


def key_of(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=4).digest(), "big")


def loose_forms(kind: str, s: str, rng: random.Random) -> list[str]:
    """Ways to write a base rule's span that the base rules miss."""
    d = digits_of(s)
    if kind == "email":
        local, host = s.rsplit("@", 1)
        dot = rng.choice([" dot ", "[dot]", " (dot) "])
        return [f"{local} at {host.replace('.', ' dot ')}", f"{local} [at] {host.replace('.', dot)}", f"{local}{rng.choice(['(at)', ' {at} '])}{host}"]
    if kind == "phone":
        n, by = d[-10:], rng.choice(["-", ".", " ", "/"])
        parts = [n[:3], n[3:6], n[6:]]
        return [s[1:], f"({n[:3]}) {n[3:6]}-{n[6:]}", by.join(parts), by.join([d[:-10] or "1", *parts])]
    if kind == "card":
        by = rng.choice([".", "/", "  "])
        return [by.join(d[i : i + 4] for i in range(0, len(d), 4))]
    return []


def generated(words: list[str], rng: random.Random) -> list[str]:
    """A valid social security number, an account number, an IPv6 address, and the loose forms of an address made of words."""
    area = rng.choice([x for x in range(1, 900) if x != 666])
    country = rng.choice(sorted(IBAN_FORMS))
    body = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c == "A" else "0123456789") for c in IBAN_FORMS[country])
    iban = f"{country}{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}{body}"
    if rng.random() < 0.5:
        iban = " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))
    ip = ipaddress.IPv6Address(0x20010DB8 << 96 | rng.getrandbits(rng.choice([32, 64, 96])))
    one, two, host = (rng.choice(words) for _ in range(3))
    local = rng.choice([one, f"{one}.{two}", f"{one}{rng.randrange(100)}"])
    address = f"{local}@{host}.{rng.choice(ENDINGS)}"
    return [f"{area:03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}", iban, str(ip), *loose_forms("email", address, rng)]


def decoys(words: list[str], rng: random.Random) -> list[str]:
    """Things that look like candidates and are no personal data: one of each sort."""
    r, word = rng.randrange, lambda: rng.choice(words)
    y, m, day = r(1900, 2030), r(1, 13), r(1, 29)
    return [
        rng.choice([f"{y}-{m:02d}-{day:02d}", f"{day:02d}/{m:02d}/{y}", f"{day:02d}.{m:02d}.{y}", f"{y}-{y + r(1, 30)}"]),
        rng.choice([f"978-{r(10)}-{r(10, 100)}-{r(100000, 1000000)}-{r(10)}", f"{r(1, 1000)} {r(1000):03d} {r(1000):03d}", f"{r(10)}.{r(10**6, 10**10)}", str(r(10**6, 10**18))]),
        rng.choice([f"{r(24):02d}:{r(60):02d}:{r(60):02d}", ":".join(f"{r(256):02x}" for _ in range(6)), f"{r(1, 10)}:{r(1, 10)}:{r(1, 10)}"]),
        f"{rng.choice('ABCDEFGH')}{rng.choice('KLMNPRST')}{r(10, 100)} {r(1000, 10000)} {rng.choice('XYZ')}{r(100, 1000)}",
        rng.choice([f"{word()} at {word()} dot {word()}", f"{word()}@{word()}"]),
    ]


def planted(before: str, s: str, after: str, y: int, key: int) -> Iterator[tuple[list[float], int, int]]:
    """The candidates at ``s`` between the two texts, as far as the base rules leave them to the trees."""
    before, after = before[-AROUND:], after[:AROUND]
    t, start, end = before + s + after, len(before), len(before) + len(s)
    covered = Covered(base_spans(t))
    for a, e, kind in candidates(t):
        if a < end and start < e and covered.leaves(a, e, kind) and (not y or 2 * (min(e, end) - max(a, start)) >= max(e - a, end - start)):
            yield features(t, a, e, kind), y, key


def examples(t: str) -> Iterator[tuple[list[float], int, int]]:
    """(features, label, key) of a text's candidates and of the forms planted in it. Equal values have equal keys."""
    base = base_spans(t)
    covered = Covered(base)
    for a, e, kind in candidates(t):
        if covered.leaves(a, e, kind):
            yield features(t, a, e, kind), int(strict(kind, t[a:e])), key_of(t[a:e])
    for a, _, kind, e in base:
        words = [w for w in re.findall(r"[A-Za-z]+", t[max(0, a - AROUND * 10) : e + AROUND * 10]) if len(w) > 1] or ["word"]
        key = key_of(t[a:e])
        rng = random.Random(key)
        for s in loose_forms(kind, t[a:e], rng) + generated(words, rng):
            yield from planted(t[max(0, a - AROUND) : a], s, t[e : e + AROUND], 1, key)
        for s in decoys(words, rng):
            at = t.find(" ", rng.randrange(len(t)))
            if at >= 0 and not covered.overlaps(at - AROUND, at + AROUND):
                yield from planted(t[max(0, at - AROUND) : at + 1], s, t[at : at + AROUND], 0, key)


# ---------------------------------------------------------------- trees


class Model:
    """Fitted trees as arrays, and the margin from which on a candidate is personal data."""

    def __init__(self, trees: list[tuple], threshold: float):
        self.trees, self.threshold = trees, threshold

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for weight, feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                inner = feature[at] >= 0
                go = np.where(x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at], left[at], right[at])
                at = np.where(inner, go, at)
            out += weight * value[at]
        return out


def flat(tree, weight: float) -> tuple:
    feature, cut, left, right, value = [], [], [], [], []

    def add(node) -> int:
        i = len(feature)
        for column, x in ((feature, -1), (cut, 0.0), (left, i), (right, i), (value, float(node.prediction()))):
            column.append(x)
        if node.subtreeDepth():
            feature[i], cut[i] = node.split().featureIndex(), float(node.split().threshold())
            left[i], right[i] = add(node.leftChild()), add(node.rightChild())
        return i

    add(tree._call_java("rootNode"))
    return weight, np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value)


def calibrated(margins: np.ndarray, labels: np.ndarray) -> float:
    """The smallest margin such that of the candidates with it or a larger one at least PRECISION are positive."""
    order = np.argsort(-margins)
    m, right = margins[order], np.cumsum(labels[order])
    last = np.append(m[1:] != m[:-1], True)  # candidates of equal margins pass or fail together
    good = np.flatnonzero(last & (right >= PRECISION * np.arange(1, len(m) + 1)))
    return float(m[good[-1]]) if len(good) else float("inf")


def train(docs: DataFrame) -> Model | None:
    """A model from the documented sample of ``docs``; None where it has not both classes."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors

    d = take(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, key = [], [], []
            for t in b.column(0).to_pylist():
                for one in examples(t) if t else ():
                    for column, value in zip((x, y, key), one, strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32()), pa.array(key, pa.int64())], ["x", "y", "key"])

    sample = small_batches(hash_sample(d, "doc_id", SAMPLE_DOCS).select("text")).mapInArrow(run, "x array<double>, y int, key long")
    rows = sample.orderBy("key", "y", "x").limit(SAMPLE_CANDIDATES).collect()
    fit = [(Vectors.dense(r.x), float(r.y)) for r in rows if r.key % 10 < 7]
    held = [r for r in rows if r.key % 10 >= 7]
    if len({y for _, y in fit}) < 2 or not held:
        return None
    spark = docs.sparkSession
    model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(spark.createDataFrame(fit, ["x", "y"]).coalesce(1))
    trees = [flat(t, w) for t, w in zip(model.trees, model.treeWeights, strict=True)]
    margins = Model(trees, 0).margins(np.array([r.x for r in held]))
    return Model(trees, calibrated(margins, np.array([r.y for r in held])))


def spans_of(t: str | None, model: Model | None) -> list[Span]:
    """All spans of a text, sorted: those of the base rules and the candidates that the model selects."""
    if not t:
        return []
    base = base_spans(t)
    if model is None:
        return base
    covered = Covered(base)
    left = [c for c in candidates(t) if covered.leaves(*c)]
    if not left:
        return base
    margins = model.margins(np.array([features(t, *c) for c in left])).tolist()
    passed = [(kind not in CONTAINERS, -m, a, e, kind) for m, (a, e, kind) in zip(margins, left, strict=True) if m >= model.threshold]
    starts: list[int] = []
    chosen: list[Span] = []
    for _, _, a, e, kind in sorted(passed):
        k = bisect_left(starts, e)
        if not k or chosen[k - 1][3] <= a:
            starts.insert(k, a)
            chosen.insert(k, (a, ORDER[kind], kind, e))
    return sorted(base + chosen)


def find_personal_data(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of each row; places in code points, ``end`` exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            holding("personal data")
            spans = [[{"kind": k, "start": s, "end": e} for s, _, k, e in spans_of(t, model)] for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "spans"])

    d = small_batches(take(docs, "doc_id", "text"))
    return d.mapInArrow(run, f"doc_id {d.schema[0].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span (overlapping ones as one) as [KIND]."""
    if not spans:
        return text
    out, done, k = [], 0, 0
    while k < len(spans):
        start, _, kind, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][3])
            k += 1
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def redacted_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, with all their columns, the personal data in their texts redacted and ``n_chars`` as it is then."""

    def cleaned(t: str | None) -> str | None:
        holding("personal data")
        return redact(t, spans_of(t, model))

    clean = F.udf(cleaned, "string", useArrow=True)
    names = docs.columns
    out = small_batches(docs).toDF(*[f"c{i}" for i in range(len(names))])
    i = names.index("text")
    out = out.withColumn(f"c{i}", clean(F.col(f"c{i}")))
    if "n_chars" in names:
        out = out.withColumn(f"c{names.index('n_chars')}", F.length(f"c{i}").cast(docs.schema["n_chars"].dataType))
    return out.toDF(*names)


def op7_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spans = find_personal_data(docs, train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in row] for row in b.column(1).to_pylist()]
            n = [pa.array([sum(k == kind for k, _ in r) for r in rows], pa.int64()) for kind in BASE_KINDS]
            sha = [hashlib.sha256(",".join(x for k, x in r if k in BASE_KINDS).encode()).hexdigest() for r in rows]
            yield pa.record_batch([b.column(0), *n, pa.array(sha), pa.array([",".join(x for _, x in r) for r in rows], pa.string())], ["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"])

    return spans.mapInArrow(run, f"doc_id {spans.schema[0].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string")
