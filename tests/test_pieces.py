"""Texts analysed by pieces against the analysers on whole texts; an index is made without a shuffle of postings."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import fulltext, index, terms
from corpusloom.sources.folders import shared_folder
from corpusloom.sources.tables import Tables

ODD = ["", " ", "...", "the of", "İx K ſ AB c\x1cd s ss", "<b>x y</b> a-b http://h.org/a?b c@d.org", "a <!-- b c --> d & &amp; /x/y z", "runs, running. Été 1.5 -3 v1.2.3", "word " * 5000, *(chr(c) + "a" + chr(c) for c in range(0x2100))]


@pytest.mark.parametrize("analyze", list(fulltext.PIECES))
def test_pieces_equal_whole_texts(analyze):
    got = [{} for _ in ODD]
    for term, i, at in zip(*(x.tolist() if hasattr(x, "tolist") else x.to_pylist() for x in fulltext.grouped_places(ODD, *fulltext.PIECES[analyze])), strict=True):
        got[i][term] = at
    assert got == [analyze(x) for x in ODD]


def test_an_index_is_made_without_shuffling_postings(spark, monkeypatch, capsys):
    folder, rows = shared_folder(spark, "test-index"), "release_id long, title string, body_text string"
    seen = []
    plain = fulltext.write_sorted
    monkeypatch.setattr(fulltext, "write_sorted", lambda df, path: (df.sortWithinPartitions("term").explain(), seen.append(path), plain(df, path)))
    for k in (1, 2):
        index.apply_batch(folder, spark.createDataFrame([(k, "tax", "water"), (5, "tax", "bill")], rows))
        index.merge_segments(folder, spark, 2)
    plans = capsys.readouterr().out
    assert len(seen) == 3 and "rangepartitioning" not in plans and "SortMergeJoin" not in plans


def test_postings_of_repeated_ids(spark):
    rows = [(1, "a b", "a"), (1, "a", None), (2, "c", "")]
    d = spark.createDataFrame(rows, "release_id long, title string, body_text string")
    got = {(r.term, r.release_id): (r.positions, r.n) for r in terms.postings(Tables(None, d, *[None] * 6)).collect()}
    assert got == {("a", 1): ([0, 0, 2], 3), ("b", 1): ([1], 1), ("c", 2): ([0], 1)}
    assert "Exchange" not in terms.postings(Tables(None, d.where(F.col("release_id") == 2), *[None] * 6))._jdf.queryExecution().executedPlan().toString()
