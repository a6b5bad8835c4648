"""Spelling variants against plain loops over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from corpusloom.llm import variants


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(words):
    out = {}
    for w, n in words.items():
        near = [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = [form, n, len(near), words[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return out


def got(df):
    return {r.word: [r.form, r.n, r.n_near, r.form_n, r.root] for r in df.collect()}


def test_crc_of_parts():
    rng = random.Random(1)
    a = [rng.randbytes(rng.randrange(12)) for _ in range(500)]
    b = [rng.randbytes(rng.choice([0, 1, 3, 9, 300, 70_000])) for _ in range(500)]
    crc = lambda x: np.array([zlib.crc32(v) for v in x], np.uint32)
    assert variants.joined_crc(crc(a), np.arange(500), crc(b), np.array([len(v) for v in b])).tolist() == crc([x + y for x, y in zip(a, b, strict=True)]).tolist()


def test_whole_operator(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 7)  # so that keys have several blocks
    rng = random.Random(5)
    stems = ["colour", "ÀÉseñor", "straÿße", "letters", "aaaaa", "aaaaaa", "abcabc", "bcabca", "z" * 3000]
    texts = [None, "", "12 34 ×÷", "color Color COLOR colour colour colour colour colour colour colour-x"]
    for _ in range(400):
        word = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k = rng.randrange(len(word) + 1)
            word = word[:k] + rng.choice(["", rng.choice("abcÀé")]) + word[k + rng.choice([0, 1]) :]
        texts.append((word + rng.choice([" ", ",", "1", "\n"])) * rng.choice([1, 2, 3, 5, 9, 40]) + " colour")
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "colour letters " * 3), (7, texts[7]), (7, texts[7])]
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, word int, n string").repartition(3)
    words = plain_words(rows)
    assert {r.word: r.n for r in variants.word_counts(docs).collect()} == words
    want = plain_variants(words)
    assert sum(v[0] is not None for v in want.values()) > 20 and max(v[2] for v in want.values()) > 5
    assert got(variants.spelling_variants(variants.word_counts(docs))) == want
    assert got(variants.spelling_variants(variants.word_counts(docs.where("false")))) == {}


def test_chains_end_at_their_root(spark):
    """Each form has twice its word's occurrences: a chain of eight words."""
    chain = ["abcdefgh"[: k + 5] for k in range(4)] + ["abcdefgx", "abcdefyx", "abcdezyx"]
    words = spark.createDataFrame([(w, 3 * 2**k) for k, w in enumerate(chain)], "word string, n long")
    assert got(variants.spelling_variants(words)) == plain_variants({w: 3 * 2**k for k, w in enumerate(chain)})


def test_near_in_blocks_by_brute_force():
    rng = random.Random(2)
    for n in (5, 6, 9):
        a, b = (sorted({"".join(rng.choice("abé") for _ in range(m)) for _ in range(150)}) for m in (n, n + 1))
        x, y = variants.matrix("".join(a), n), variants.matrix("".join(b), n + 1)
        assert {(a[i], b[j]) for i, j in zip(*variants.near_in_blocks(x, y, False), strict=True)} == {(v, w) for v in a for w in b if one_edit(v, w)}
        assert {(a[i], a[j]) for i, j in zip(*variants.near_in_blocks(x, x, True), strict=True)} == {(v, w) for v in a for w in a if v < w and one_edit(v, w)}
