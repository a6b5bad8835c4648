"""What goes through which tokenizer, and what a worker remembers of it."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import frames
from corpusloom.llm.common import vocabulary

PATH = vocabulary("word_bpe_49k.json")
LETTERS = [chr(i) for i in [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x130), *range(0x131, 0x250)]]


class Counting:
    """A tokenizer that keeps what it was asked."""

    def __init__(self, of):
        self.of, self.asked = of, []

    def encode_batch_fast(self, texts, **how):
        self.asked += texts
        return self.of.encode_batch_fast(texts, **how)

    def encode(self, text, **how):
        self.asked.append(text)
        return self.of.encode(text, **how)


@pytest.fixture
def chunks():
    frames.chunks_of.cache_clear()
    yield frames.chunks_of(PATH)
    frames.chunks_of.cache_clear()


def plain(texts):
    t = Tokenizer.from_file(PATH)
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 7], "<u4").tobytes() for x in texts]


def texts_of(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("etaoinshrdlu" * 4 + "".join(LETTERS), k=rng.randrange(1, 14)))
    return [" ".join(rng.choice([word(), word(), "It's", "a-b", "<x", "42", word().upper() + "."]) for _ in range(150)) for _ in range(n)] + ["", None, "<|endoftext|> of", "ALİ ﬁ K é word", "w" * 3000]


def test_only_chunks_that_are_no_word_go_through_the_whole_tokenizer(chunks):
    whole = chunks.tokenizer = Counting(chunks.tokenizer)
    texts = texts_of(1) + [f"x{c}y {c.upper()}" for c in LETTERS]
    assert frames.encode_texts(pa.array(texts), PATH, 7) == plain(texts)
    seen = {c for x in whole.asked for c in x.split(chunks.sep)}
    assert {"it's", "a-b", "<x", "42", "<|endoftext|>", "ﬁ"} <= seen
    assert not [c for c in seen if c.isascii() and c.isalpha()] and not seen & {"x" + c + "y" for c in LETTERS}


def test_known_chunks_are_not_encoded_again(chunks):
    texts = texts_of(2)
    first = frames.encode_texts(pa.array(texts), PATH, 7)
    chunks.tokenizer, chunks.plain = Counting(chunks.tokenizer), Counting(chunks.plain)
    assert frames.encode_texts(pa.array(texts[::-1]), PATH, 7) == first[::-1]
    assert not chunks.tokenizer.asked and not chunks.plain.asked


def test_what_is_remembered_is_bounded_and_frequent_chunks_stay(chunks, monkeypatch):
    monkeypatch.setattr(frames, "REMEMBERED", 600_000)  # about two of these batches
    for seed in range(8):
        texts = texts_of(seed) + ["often " * 3]
        assert frames.encode_texts(pa.array(texts), PATH, 7) == plain(texts)
        assert chunks.known.nbytes + chunks.ids.nbytes + chunks.seen.nbytes <= 600_000
        assert len(chunks.known) == len(chunks.ids) == len(chunks.seen)
    kept = chunks.known.to_pylist()
    assert len(kept) < 15_000
    assert {"often", "it's", "42"} <= set(kept) and len(set(kept)) == len(kept) and "w" * 3000 not in kept


def test_a_vocabulary_that_marks_no_ends_of_words(chunks):
    chunks.last[:] = False
    texts = texts_of(3)
    assert frames.encode_texts(pa.array(texts), PATH, 7) == plain(texts)
