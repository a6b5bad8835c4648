"""The chain and each of its stages against plain versions, on a table with nulls, empty and long texts, copies and clashing columns."""

import random
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import bpe, lengths, mixing, neardup, pii, quality
from corpusloom.llm.common import vocabulary

WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha") for b in ("lor", "mit", "nus", "pel", "rat", "sig", "tun", "vex")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "en"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for i in range(160):
        t = text(rng, 60 + i % 90)
        if i % 8 == 1:
            t = out[-1][1]  # an exact copy
        if i % 8 == 3:
            words = out[-1][1].split(" ")
            words[5] = "changed"
            t = " ".join(words)  # a near copy
        if i % 8 == 5:
            t += f" write to jo{i}@example.org or call +1 (212) 555-{1000 + i} from 10.0.0.{i}"
        out.append((i, t, ["en", "de"][i % 2], f"s{i // 16 % 3}", len(t), "clash"))
    out += [(200, None, None, None, None, "clash"), (201, "", "en", "s0", 0, "clash"), (202, "too short", "en", "s0", 9, "clash"), (203, "the same words again " * 60, "en", "s0", 1, "clash")]
    out += [(204, text(rng, 30_000), "en", "s1", 1, "clash"), (None, text(rng, 80), "en", "s1", 1, "clash")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, N_WORDS string").cache()


def plain_quality(t):
    """Whether the base rules and the rest of the current policy keep a text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    repeat = {p for places in seen.values() if len(places) > 1 for i in places for p in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = sum(map(len, words))
    whole = [words[i : i + 200] for i in range(0, len(words) - len(words) % 200, 200)]
    fails = [
        len(words) < 50,
        100 * len(repeat) > 50 * len(words),
        100 * sum(c in "#*$%&|<>" for c in t or "") > 10 * chars,
        len(lines) >= 4 and 100 * (len(lines) - len(set(lines))) > 50 * len(lines),
        bool(words) and not 2 * len(words) <= chars <= 20 * len(words),
        sum(c.isalpha() for c in t or "") >= 100 and sum(c != c.lower() for c in t) * 100 > 50 * sum(c != c.lower() or c != c.upper() for c in t),
        bool(words) and 100 * (t or "").count("!") > 50 * len(words),
        bool(whole) and 100 * sum(len(set(w)) for w in whole) < 5 * 200 * len(whole),
    ]
    return not any(fails)


def plain_near(rows, k=5, percent=80):
    """The rows that are the smallest of their group."""
    sets = {}
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if i is not None and words:
            sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [r for r in rows if r[0] not in root or find(r[0]) == r[0]]


def test_quality_stage(spark, docs, rows):
    kept = corpus_pipeline.quality_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in rows if plain_quality(r[1])), key=str)
    assert corpus_pipeline.quality_stage(spark, docs.where("false"), "").count() == 0


def test_quality_verdicts_do_not_depend_on_length():
    rng = random.Random(1)
    long = " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(100_000))
    n = dict(zip(quality.MEASURES, quality.measure(long), strict=True))
    assert 100 * n["n_window_distinct"] > 60 * (n["n_words"] - n["n_words"] % quality.WINDOW)


def test_near_duplicate_stage(spark, docs, rows):
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(plain_near(rows), key=str)
    assert corpus_pipeline.near_duplicate_stage(spark, docs.where("false"), "").count() == 0


def test_personal_data_stage(spark, docs, rows):
    out = {r.doc_id: r for r in corpus_pipeline.personal_data_stage(spark, docs, "").collect()}
    assert len(out) == len({r[0] for r in rows})
    for i, t, *_ in rows:
        assert out[i].text == pii.redact(t, pii.base_spans(t or "")) or "@" not in out[i].text
        assert (out[i].text is None) == (t is None) and (t is None or out[i].n_chars == len(out[i].text))
        if not pii.candidates(t or ""):
            assert out[i].text == t
    assert corpus_pipeline.personal_data_stage(spark, docs.where("false"), "").count() == 0


def test_mixture_stage(spark, docs):
    kept = corpus_pipeline.mixture_stage(spark, docs, "")
    assert kept.columns == docs.columns
    said = {str(r.doc_id) for r in mixing.sampled(docs, budget=corpus_pipeline.MIXTURE_BUDGET).collect() if r.kept}
    assert {str(r.doc_id) for r in kept.collect()} == said


def test_encoding_stage(spark, docs, rows):
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for r, row in zip(sorted(corpus_pipeline.encoding_stage(spark, docs, "").collect(), key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0])), strict=True):
        assert (r.doc_id, list(r.ids), r.n_tokens) == (row[0], t.encode(row[1] or "").ids, len(r.ids))


def test_chain(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = {r[0] for r in plain_near([r for r in rows if plain_quality(r[1])])}
    assert got.keys() <= left and len(got) >= 0.5 * len(left)
    whole = dict((r[0], r[1]) for r in rows)
    for i, r in got.items():
        out = bpe.decode(list(r.ids), vocabulary("byte_bpe_50k.json"))
        assert "@example.org" not in out and (out == whole[i] or "[" in out)
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


# ---------------------------------------------------------------- near-duplicates and lengths by themselves


def test_links_near_the_threshold(spark):
    """Pairs with similarities from 84 to 87 percent: exactly those of 85 or more are linked."""
    rng = random.Random(3)
    rows, want = [], 0
    for p in range(300):
        n, common = 200, 181 + p % 6  # 198 shingles each, 179 to 184 in common
        a = [f"a{p}_{i}" for i in range(n)]
        b = a[:common] + [f"b{p}_{i}" for i in range(n - common)]
        one, two = ({tuple(x[i : i + 3]) for i in range(n - 2)} for x in (a, b))
        want += 100 * len(one & two) >= 85 * len(one | two)
        rows += [(2 * p, " ".join(a)), (2 * p + 1, " ".join(b))]
    rng.shuffle(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sum(not r.kept for r in got) == want and 0 < want < 300
    assert all(r.component_id == r.doc_id - r.doc_id % 2 for r in got if not r.kept)


def test_an_exact_tie_links(spark):
    """85 of 100 shingles in common is a link, 84 of 100 none."""
    rows = []
    for k, common in enumerate((85, 84)):
        words = [f"w{k}_{i}" for i in range(102)]
        a = words[: common + 2]  # common shingles of three words
        b = words  # 100 shingles, of which the first are those of a
        rows += [(10 * k, " ".join(a)), (10 * k + 1, " ".join(b))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {0: 0, 1: 0, 10: 10, 11: 11}


def test_near_duplicates_with_null_and_repeated_ids_and_a_frequent_leader(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = [(None, " ".join(base), "x", 1), (0, " ".join(base), "x", 1), (0, " ".join(base), "x", 1)]
    for i in range(1, 400):  # one large group of near copies
        words = list(base)
        words[rng.randrange(120)] = f"z{i}"
        rows.append((i, " ".join(words), "x", 1))
    rows += [(1000 + i, " ".join(f"q{i}_{j}" for j in range(60)), "x", 1) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, DIGEST_ string, n int")
    got = neardup.near_duplicates(d, 3, 85).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id is not None and r.doc_id < 400} == {0}
    assert all(r.component_id == r.doc_id for r in got if r.doc_id is not None and r.doc_id >= 1000)
    assert all(r.kept for r in got if r.doc_id is None)


def test_lengths_against_the_library(spark, docs, rows):
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    n = sorted(len(t.encode(r[1] or "").ids) for r in rows)
    d = docs.withColumnRenamed("N_WORDS", "n_docs")  # clashes with a column of the histogram
    totals = lengths.context_totals(lengths.length_histogram(d))
    for r in totals.collect():
        assert r.n_docs == n.count(r.n_tokens) and r.docs_at_least == sum(x >= r.n_tokens for x in n) and r.docs_below == sum(x < r.n_tokens for x in n)
        assert r.tokens_at_least == sum(x for x in n if x >= r.n_tokens) and r.kept_tokens == sum(min(x, r.n_tokens) for x in n) and r.total_tokens == sum(n)
    points = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.point: r.n_tokens for r in lengths.length_quantiles(totals, points).collect()}
    assert got == {p: next(x for x in n if sum(y <= x for y in n) >= p * len(n)) for p in points}
    for limit in (0, 1, 77, n[-1], n[-1] + 5):
        assert lengths.truncated_total(totals, limit).first().kept_tokens == sum(min(x, limit) for x in n)
