"""Raking against plain numpy, targets given by the caller, contradictions, and the cases of the docstring."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import mixing
from corpusloom.llm.common import vocabulary


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(2)
    themes = [["ship", "sea", "sail", "wind"], ["bread", "oven", "flour", "salt"], ["court", "law", "judge", "case"]]
    rows = []
    for i in range(900):
        words = rng.choice(themes[i % 3], 5 + i % 40)
        rows.append((i, " ".join(words) + " .", f"l{i // 3 % 2}", f"s{min(i // 7 % 5, 2)}", 0, "clash"))
    rows += [(900, None, "l0", "s0", 0, "clash"), (901, "", None, None, 0, "clash"), (None, "sea wind", "l1", "s1", 0, "clash"), (5, rows[5][1], *rows[5][2:]), (902, "salt " * 30_000, "l0", "s0", 0, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _TOPIC_ string")


def test_tokens_are_encoded_tokens_and_topics_are_not_languages(docs):
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rows = mixing.keyed(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    assert all(r.n_tokens == len(t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids) for r in rows)
    assert {r.topic for r in rows if r.doc_id in (900, 901)} == {mixing.NONE}
    theme = {}
    for r in rows:
        if r.doc_id is not None and r.doc_id < 900:
            theme.setdefault(r.topic, set()).add(r.doc_id % 3)
    assert all(len(t) == 1 for t in theme.values()) and len(theme) >= 3
    assert {r.lang for r in rows if r.topic == next(iter(theme))} >= {"l0", "l1"}


def plain_rake(cells, targets, sweeps=200):
    w = np.array([c["tokens"] for c in cells], float)
    w /= w.sum()
    for _ in range(sweeps):
        for d, shares in targets.items():
            for v, share in shares.items():
                at = np.array([c[d] == v for c in cells])
                if w[at].sum() > 0:
                    w[at] *= share / w[at].sum()
    return w


@pytest.mark.parametrize("at_hand", [mixing.CELLS_AT_HAND, 0])
def test_weights_equal_plain_raking(docs, monkeypatch, at_hand):
    monkeypatch.setattr(mixing, "CELLS_AT_HAND", at_hand)
    rows = mixing.keyed(docs).withColumn("topic", F.when(F.col("topic") == mixing.NONE, "none").otherwise("some")).where("lang <> '(none)'").cache()
    got = mixing.plan(rows, budget=0.3).collect()
    targets = {}
    for d, power in mixing.POWERS.items():
        sums = {}
        for c in got:
            sums[c[d]] = sums.get(c[d], 0) + c.tokens
        raised = {v: t**power if t else 0.0 for v, t in sums.items()}
        targets[d] = {v: x / sum(raised.values()) for v, x in raised.items()}
    assert np.allclose([c.weight for c in got], plain_rake(got, targets), atol=1e-3)
    total = sum(c.tokens for c in got)
    assert abs(sum(c.tokens * c.probability for c in got) / total - 0.3) < 1e-3
    report = mixing.marginals(mixing.plan(rows, budget=0.3)).collect()
    assert all(abs(r.target - r.reached) < 1e-3 for r in report)


def test_given_targets_hold_and_contradictions_are_errors(spark, docs):
    rows = mixing.keyed(docs).where("lang <> '(none)'").cache()
    cells = mixing.plan(rows, powers={}, targets={"lang": {"l0": 0.9}, "source": {"s1": 0.5, "s0": 0.1}}).collect()
    share = lambda d, v: sum(c.weight for c in cells if c[d] == v)
    assert abs(share("lang", "l0") - 0.9) < 1e-3 and abs(share("source", "s1") - 0.5) < 1e-3 and abs(share("source", "s2") - 0.4) < 1e-3
    apart = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, n_tokens long")
    with pytest.raises(ValueError, match="contradict"):
        mixing.plan(apart, powers={}, targets={"source": {"a": 0.9}, "lang": {"x": 0.2}})
    with pytest.raises(ValueError, match="more than 1"):
        mixing.plan(apart, targets={"source": {"a": 0.9, "b": 0.9}})


def test_query_keeps_every_row_and_the_sample_follows_it(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op3_mixture_raking(spark, str(tmp_path)).collect()
    assert len(got) == docs.count()
    kept = sorted(str(r.doc_id) for r in got if r.kept)
    sample = mixing.sample_documents(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert sample.columns == docs.columns and sorted(str(r.doc_id) for r in sample.collect()) == kept
    assert len({(r.doc_id, r.kept) for r in got if r.doc_id == 5}) == 1  # repeated rows share their fate
    expected = sum(r.n_tokens * r.probability for r in got)
    assert abs(expected / sum(r.n_tokens for r in got) - mixing.BUDGET) < 1e-3
    assert mixing.sample_documents(docs.where("false")).count() == 0 and mixing.sampled(docs.where("false")).count() == 0


def test_a_topic_column_is_used(docs):
    rows = mixing.keyed(docs.withColumn("topic", F.lit("mine"))).select("topic").distinct().collect()
    assert [r.topic for r in rows] == ["mine"]


def test_encoding_of_a_slice():
    import pyarrow as pa

    from corpusloom.llm import frames
    from corpusloom.llm.common import vocabulary

    path = vocabulary("word_bpe_49k.json")
    texts = ["Überall, where it WAS.", None, "", "ÀÉ È, ok. "] * 50
    whole = frames.encode_texts(pa.array(texts), path, 2)
    for at in (1, 3, 101):
        assert frames.encode_texts(pa.array(texts).slice(at, 60), path, 2) == whole[at : at + 60]


def test_a_worker_holds_one_operators_tables():
    import pyarrow as pa

    from corpusloom.llm import bpe, frames, neardup
    from corpusloom.llm.common import HOLDER, holding, vocabulary

    neardup.shingles("some words to remember", 3)
    assert neardup.HASHES
    first = frames.encode_texts(pa.array(["some words"]), vocabulary("word_bpe_49k.json"), 2)
    assert not neardup.HASHES and frames.chunks_of.cache_info().currsize
    holding("bpe", bpe.forget)
    assert not frames.chunks_of.cache_info().currsize and HOLDER[0] == "bpe"
    assert bpe.decode(bpe.encode("some words", vocabulary("byte_bpe_50k.json")), vocabulary("byte_bpe_50k.json")) == "some words"
    holding("quality")
    assert not bpe.encoder.cache_info().currsize
    assert frames.encode_texts(pa.array(["some words"]), vocabulary("word_bpe_49k.json"), 2) == first


def test_a_sample_of_very_many_rows_is_not_empty(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from corpusloom.llm.common import hash_sample

    rows = spark.range(20_000_000)
    assert hash_sample(rows, "id", 30_000_000).count() == 20_000_000
    assert 1700 < hash_sample(rows, "id", 2000).count() < 2300
    count = DataFrame.count
    monkeypatch.setattr(DataFrame, "count", lambda self: 30_000_000_000)
    some = hash_sample(rows, "id", 15_000)  # a share of one in two million
    monkeypatch.setattr(DataFrame, "count", count)
    assert 1 <= some.count() <= 40


def test_marginals_say_what_was_reached(spark):
    from corpusloom.llm import mixing

    rows = spark.createDataFrame([("a", "en", "t", 10)] * 3 + [("b", "en", "t", 10)] + [("b", "de", "t", 10)], "source string, lang string, topic string, n_tokens long")
    got = {(r.dimension, r.value): r for r in mixing.marginals(mixing.plan(rows, targets={"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.8, "de": 0.2}})).collect()}
    assert all(abs(r.reached - r.target) < 1e-3 and abs(r.miss) < 1e-3 for r in got.values()) and got["source", "a"].target == 0.5


def test_topics_come_from_all_documents(spark):
    rng = np.random.default_rng(3)
    themes = [["ship", "sea", "sail", "wind"], ["bread", "oven", "flour", "salt"], ["court", "law", "judge", "case"], ["goal", "match", "team", "coach"], ["piano", "song", "choir", "drum"], ["river", "lake", "fish", "boat"], ["horse", "farm", "barn", "hay"], ["atom", "laser", "proton", "quark"]]
    high = [r.id for r in spark.range(4000).where(F.xxhash64("id") >= 0).limit(200).collect()]  # a sample of the lower hashes has none of these
    theme = {i: i % 7 for i in range(4000)} | dict.fromkeys(high, 7)
    rows = [(i, " ".join(rng.choice(themes[t], 12)), f"l{i % 2}", "s") for i, t in theme.items()]
    of = {}
    for r in mixing.keyed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect():
        of.setdefault(r.topic, set()).add(theme[r.doc_id])
    assert len(of) == 8 and all(len(t) == 1 for t in of.values())


def plain_topics(counts, langs, k=mixing.TOPICS):
    """The fit of ``fit_topics`` by plain numpy over all rows at once."""
    unit = lambda v: v / np.maximum(np.sqrt((v**2).sum(1)), 1e-12)[:, None]
    round_ = lambda v: np.rint(v / mixing.GRAIN) * mixing.GRAIN
    weights = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0)))
    v = unit(np.log1p(counts) * weights)
    v = round_(unit(v - np.array([round_(v)[[x == y for y in langs]].mean(0) for x in langs])))
    away = lambda c: ((v[:, None] - c) ** 2).sum(2)
    top = lambda d: max(range(len(v)), key=lambda i: (d[i], v[i].tolist()))
    c = v[[top(away(round_(v.mean(0))[None])[:, 0])]]
    while len(c) < k:
        c = np.vstack([c, v[top(away(c).min(1))]])
    before = np.inf
    for _ in range(mixing.PASSES):
        at, d = away(c).argmin(1), round_(away(c).min(1)).mean()
        new = np.array([round_(v[at == j].mean(0)) if (at == j).any() else c[j] for j in range(k)])
        if before - d <= mixing.SETTLED * d or np.array_equal(new, c):
            break
        c, before = new, d
    return c


@pytest.mark.parametrize("parts, at_hand", [(1, 8 << 20), (7, 8 << 20), (7, 0)])
def test_topics_equal_plain_k_means_however_rows_are_dealt(spark, monkeypatch, parts, at_hand):
    monkeypatch.setattr(mixing, "BYTES_AT_HAND", at_hand)
    monkeypatch.setattr(mixing, "SUMS_AT_ONCE", 2)
    rng = np.random.default_rng(4)
    counts = rng.poisson(rng.gamma(0.3, 2, (6, mixing.PLACES))[rng.integers(0, 6, 150)])
    counts[:2, :3] = [[300, 0, 70_000], [256, 1, 2]]  # wider than a byte
    langs = [f"l{i % 3}" for i in range(150)]
    packs = [mixing.packed(np.repeat(np.arange(mixing.PLACES), c)) for c in counts]
    rows = spark.createDataFrame([*zip(packs, langs, strict=True), (None, "l0")], "counts binary, lang string").repartition(parts)
    assert np.array_equal(mixing.unpacked(packs), counts)
    assert np.array_equal(mixing.fit_topics(rows).centers, plain_topics(counts, langs))
