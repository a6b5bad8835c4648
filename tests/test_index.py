"""A maintained index against one made anew, after random batches, deletes and merges; searches on it; repeated rows."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.english import lexemes, light_lexemes
from corpusloom.operators import fulltext, index
from corpusloom.sources.folders import shared_folder

ROWS = "release_id long, title string, body_text string"
WORDS = ["tax", "taxes", "water", "the", "Running", "farm", "farms", "bill", "co-op"]


def table(df):
    return sorted((r.term, r.release_id, tuple(r.positions)) for r in df.collect())


@pytest.mark.parametrize(("seed", "analyze"), [(1, lexemes), (2, light_lexemes)])
def test_after_any_changes_it_equals_an_index_made_anew(spark, seed, analyze):
    rng, now, folder = random.Random(seed), {}, shared_folder(spark, "test-index")
    assert index.read_index(spark, folder).count() == 0
    merged = 0
    for step in range(6):
        text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(6)))
        batch = {rng.randrange(30): (rng.choice([None, text()]), text()) for _ in range(rng.choice([0, 1, 8, 20]))}
        gone = [rng.randrange(30) for _ in range(rng.choice([0, 2]))]
        index.apply_batch(folder, spark.createDataFrame([(k, *v) for k, v in batch.items()], ROWS), spark.createDataFrame([(g,) for g in gone], "release_id long") if gone else None, analyze)
        for g in gone:
            now.pop(g, None)
        now |= batch
        merged += index.merge_segments(folder, spark, 2 if step % 2 else 3)
        if step in (2, 5):
            anew = fulltext.postings(spark.createDataFrame([(k, *v) for k, v in now.items()], ROWS), analyze)
            assert table(index.read_index(spark, folder)) == table(anew)
    assert merged and len([r for r in index.segments(spark, folder)[1] if r["kind"] == "postings"]) < 6
    found = fulltext.search(index.read_index(spark, folder), all_of=["farms"], none_of=["water"], analyze=analyze)
    have = {k: analyze(" ".join(x for x in v if x is not None)) for k, v in now.items()}
    (farm,) = analyze("farms")
    assert sorted(r.release_id for r in found.collect()) == sorted(k for k, v in have.items() if farm in v and "water" not in v)


def test_a_failed_batch_changes_nothing(spark, monkeypatch):
    folder = shared_folder(spark, "test-index")
    index.apply_batch(folder, spark.createDataFrame([(1, "tax", "water")], ROWS))
    before = table(index.read_index(spark, folder))

    def fails(*_):
        raise RuntimeError("no")

    monkeypatch.setattr(index, "publish", fails)
    with pytest.raises(RuntimeError):
        index.apply_batch(folder, spark.createDataFrame([(1, "farm", ""), (2, "farm", "")], ROWS), spark.createDataFrame([(1,)], "release_id long"))
    monkeypatch.undo()
    assert table(index.read_index(spark, folder)) == before


def test_terms_reach_the_scans(spark, capsys):
    folder = shared_folder(spark, "test-index")
    for k in (1, 2):
        index.apply_batch(folder, spark.createDataFrame([(k, "tax", "water"), (5, "tax", "bill")], ROWS))
    fulltext.search(index.read_index(spark, folder), all_of=["tax"]).explain()
    plan = capsys.readouterr().out
    assert plan.count("EqualTo(term,tax)") + plan.count("In(term") >= 2


def test_repeated_rows_of_a_release(spark):
    rows = spark.createDataFrame([(1, "tax bill", ""), (1, "tax bill", ""), (1, "bill for water", ""), (2, "tax", None)], ROWS)
    found = fulltext.postings(rows.union(rows))
    assert [r.release_id for r in fulltext.search(found, all_of=["tax", "water"]).collect()] == [1]
    assert sorted(r.release_id for r in fulltext.search(found, phrase="tax bill").collect()) == [1]
    assert fulltext.rank(found.where(F.lit(False)), "tax", 5).count() == 0
