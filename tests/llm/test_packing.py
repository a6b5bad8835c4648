"""Sum-of-squares packing against its definition: choices by brute force, ids by the library, windows by their contract."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from corpusloom.llm import packing
from corpusloom.llm.common import vocabulary

SIZE = 16


def ids(n, first=0):
    return np.arange(first, first + n, dtype="<u4").tobytes()


@pytest.mark.parametrize("seed", range(5))
def test_each_piece_goes_where_the_sum_of_squares_is_smallest(seed):
    rng, packer = random.Random(seed), packing.Packer(SIZE)
    for doc in range(400):
        s = rng.choice([1, 2, 3, 5, 7, 9, 11, 15])
        before = packer.n.copy()
        h = packer.level(s)

        def after(level, before=before, s=s):
            n = before.copy()
            n[level] -= level > 0
            n[level + s] += 1
            return int((n[1:SIZE] ** 2).sum())

        choices = [0] + [k for k in range(1, SIZE - s + 1) if before[k]]
        assert h in choices and after(h) == min(map(after, choices))
        packer.add(doc, ids(s))
        assert [len(x) for x in packer.at] == packer.n.tolist() and packer.n.sum() == packer.open


@pytest.mark.parametrize("lengths", [[9] * 50, [16, 32, 48], [1], [], [17, 31, 5, 1, 1, 1], [8] * 7, [15] * 100 + [3] * 10])
def test_every_id_is_packed_once(lengths):
    packer = packing.Packer(SIZE, most=10)
    for doc, n in enumerate(lengths):
        packer.add(doc, ids(n, 1000 * doc))
        assert packer.open < 10
    packer.finish()
    got = defaultdict(list)
    for w in packer.done:
        assert sum(len(x[2]) // 4 for x in w.pieces) == w.fill and (w.fill == SIZE or w.fill & (w.fill - 1) == 0)
        for doc, start, raw in w.pieces:
            got[doc].append((start, raw))
    for doc, n in enumerate(lengths):
        parts = sorted(got[doc])
        assert [p[0] for p in parts] == [0, *np.cumsum([len(p[1]) // 4 for p in parts]).tolist()[:-1]]
        assert b"".join(p[1] for p in parts) == ids(n, 1000 * doc)
    assert sum(w.fill < SIZE for w in packer.done) <= SIZE.bit_length()


def test_pieces_of_documents(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rng = random.Random(3)
    texts = [None, "", "same", "same", "İstanbul <|endoftext|> ½", "w " * 9000] + [" ".join(rng.choice(["alpha", "beta", "rationale", "x7"]) for _ in range(rng.choice([3, 40, 700, 2300]))) for _ in range(60)]
    rows = [(i, x, 7, "clash") for i, x in enumerate(texts)] + [(None, "no id", 1, "c"), (None, "no id", 1, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, offset string").repartition(3)
    sequences = packing.pack_documents(docs)
    pieces = packing.pieces_of(sequences).collect()
    want = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for i, x in enumerate(texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, x in want.items():
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(x), zlib.crc32(x[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(x)
    assert sorted(p.start for p in by_doc[None])[:2] == [0, 0]
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    total = packing.padding_share(sequences).first()
    assert total.padding == 0 and total.n_ids == sum(map(len, want.values())) + 2 * len(t.encode("no id", add_special_tokens=False).ids) + 2
    assert packing.pieces_of(packing.pack_documents(docs.where("false"))).count() == 0
    assert packing.padding_share(packing.pack_documents(docs.where("false"))).first().n_sequences == 0
