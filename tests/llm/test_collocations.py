"""Dynamic itemset counting against counts of all phrases by plain loops, and the query against its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from corpusloom.llm import collocations


def plain_counts(rows):
    f = defaultdict(Counter)
    for lang, text in rows:
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang or "und"][tuple(words[i : i + size])] += 1
    return f


def plain_report(rows, least, report, percent):
    out = []
    for lang, f in plain_counts(rows).items():
        n, kept = sum(v for k, v in f.items() if len(k) == 1), []
        for p, a in f.items():
            if len(p) > 1 and a >= least:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                if not any(len(q) > len(p) and b >= least and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in f.items()):
                    kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:report], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def random_rows(seed, n):
    """Words of few and many kinds; some phrases begin late, so that they reach the threshold in later cycles."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de", None])
        words = []
        for _ in range(rng.choice([0, 1, 5, 60])):
            late = i > n // 2
            words.append(rng.choice(["New York", "new york city hall", "a", "b", "é", "(x)", "z\x00", "une", " "] + ["late comer phrase here", "late comer"] * late + [f"w{rng.randrange(40)}"]))
            words.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "; "]))
        rows.append((lang, "".join(words)))
    return rows


@pytest.mark.parametrize(("seed", "shards"), [(1, 4), (3, 1)])
def test_counts_and_report(spark, seed, shards):
    rows = random_rows(seed, 120) + [("en", None), ("en", ""), ("de", "a b " * 2000), ("de", "a b " * 2000)]
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame([(i, *r, 5, "clash") for i, r in enumerate(rows)], "doc_id long, lang string, text string, n int, phrase string").repartition(3)
    trace = []
    found, n_words = collocations.frequent_phrases(docs, 8, shards, trace)
    want = {(lang, " ".join(p), len(p)): n for lang, f in plain_counts(rows).items() for p, n in f.items() if n >= 8}
    assert {(r.lang, r.phrase, r["size"]): r.f for r in found.collect()} == want
    assert sum(sum(x.values()) for x in trace) >= len(want) and len(trace) <= 5 * shards
    assert {r.lang: r.n for r in n_words.collect()} == {lang: sum(n for p, n in f.items() if len(p) == 1) for lang, f in plain_counts(rows).items() if f}
    if shards > 1:  # lengths are interleaved: longer phrases arise before all words have
        first = next(i for i, x in enumerate(trace) if x.get(2))
        assert first < shards and any(x.get(1) for x in trace[first:])
    got = sorted(tuple(r) for r in collocations.collocations(docs, 8, 12, 60, shards).collect())
    assert got == plain_report(rows, 8, 12, 60)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BITMAP_BITS", 64)
    rows = random_rows(9, 80)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    found, _ = collocations.frequent_phrases(docs, 6)
    assert {(r.lang, r.phrase): r.f for r in found.collect()} == {(lang, " ".join(p)): n for lang, f in plain_counts(rows).items() for p, n in f.items() if n >= 6}


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).count() == 0


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(collocations.OP11_SQL).fetchall()
    got = [tuple(r) for r in collocations.op11_dynamic_collocations(spark, sf).collect()]
    assert len(want) >= 50 and sorted(got) == sorted(want)
