"""English full-text search on postings: the index is made once, written sorted by term, and every search reads its terms' rows only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.english import lexemes, light_lexemes, light_terms, stemmed_terms, words
from ..functions.headline import headline
from ..functions.lexer import chunks, typed_lexemes, typed_terms
from ..sources.folders import small_batches

#: Postings of an Arrow batch at most, characters of texts that are analysed at once, about, and rows that a worker gets at once.
BATCH, CHARACTERS, ROWS = 50_000, 1_500_000, 1000
#: How an analyser's texts fall into pieces, and the terms at the places of different pieces.
PIECES = {lexemes: (words, stemmed_terms), light_lexemes: (words, light_terms), typed_lexemes: (chunks, typed_terms)}


def grouped_places(texts: list[str], split: Callable[[list[str]], tuple], terms_of: Callable[[pa.Array], tuple]) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """(terms, index of the text, places) of some texts, by term within a text. A piece is analysed once, however often it occurs."""
    pieces, of_text = split(texts)
    coded = pieces.dictionary_encode()
    size, terms = terms_of(coded.dictionary)
    terms = terms.dictionary_encode()
    flat = terms.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    code = coded.indices.to_numpy().astype(np.int64)
    n = size[code]  # places of each piece in order
    at = np.arange(n.sum())
    term = flat[np.repeat((np.cumsum(size) - size)[code] - (np.cumsum(n) - n), n) + at]
    doc = np.repeat(np.repeat(np.arange(len(texts)), of_text), n)
    place = at - np.searchsorted(doc, np.arange(len(texts)))[doc]
    doc, place, term = (x[term >= 0] for x in (doc, place, term))
    key = doc * max(len(terms.dictionary), 1) + term
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
    found = order[starts]
    return terms.dictionary.take(pa.array(term[found])), doc[found], places


def postings(releases: DataFrame, analyze: Callable[[str | None], dict[str, list[int]]] = lexemes) -> DataFrame:
    """(term, release_id, positions) of titles and bodies. A text's postings are grouped inside its row, so nothing is shuffled. The analysers
    are those of PIECES."""
    split, terms_of = PIECES[analyze]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, held, start = b.column(0), b.column(1).to_pylist(), 0, 0
            for i, x in enumerate(texts):
                held += len(x)
                if held >= CHARACTERS or i + 1 == len(texts):
                    terms, doc, places = grouped_places(texts[start : i + 1], split, terms_of)
                    out = pa.record_batch([terms, ids.take(pa.array(doc + start)), places], ["term", "release_id", "positions"])
                    yield from (out.slice(k, BATCH) for k in range(0, out.num_rows, BATCH))
                    held, start = 0, i + 1

    texts = releases.select(F.col("release_id").cast("long").alias("release_id"), F.concat_ws(" ", "title", "body_text").alias("text"))
    return small_batches(texts, ROWS).mapInArrow(run, "term string, release_id long, positions array<int>")


def write_postings(releases: DataFrame, path: str, analyze: Callable = lexemes) -> None:
    """Postings as Parquet, each file sorted by (term, release_id): a search for a term reads the pages of each file whose bounds hold it."""
    write_sorted(postings(releases, analyze), path)


def write_sorted(rows: DataFrame, path: str) -> None:
    """Rows are sorted where they are, so a text is analysed once and no posting is shuffled."""
    rows.sortWithinPartitions("term", "release_id").write.mode("overwrite").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def wanted(words: list[str], analyze: Callable = lexemes) -> list[str]:
    """The stems of a query's words, without stop words."""
    return list(analyze(" ".join(words)))


def has_phrase(at: Column, phrase: str, analyze: Callable = lexemes) -> Column:
    """Whether a phrase's terms are found as far from each other as in the phrase; ``at`` maps terms to positions."""
    (first, start), *rest = sorted(((t, i) for t, places in analyze(phrase).items() for i in places), key=lambda x: x[1])
    starts = F.coalesce(at[first], F.array().cast("array<int>"))

    def begins(p: Column) -> Column:
        ok = F.lit(True)
        for term, i in rest:
            ok &= F.coalesce(F.array_contains(at[term], p + (i - start)), F.lit(False))
        return ok

    return F.exists(starts, begins)


def search(index: DataFrame, all_of: list[str] = (), any_of: list[str] = (), none_of: list[str] = (), phrase: str = "", analyze: Callable = lexemes) -> DataFrame:
    """(release_id) of the releases that hold all, any and none of the words, and the phrase. Words are analysed as texts are; those
    that are only stop words ask for nothing, and a query that asks for nothing finds nothing. Repeated rows of a release count as one text."""
    every, some, never, inside = (wanted(words, analyze) for words in (all_of, any_of, none_of, [phrase]))
    asked = [*every, *some, *inside]
    rows = index.where(F.col("term").isin([*asked, *never]) if asked else F.lit(False))
    # A group holds a row for each term of the query, and more only where rows of a release differ.
    r = rows.groupBy("release_id").agg(F.collect_set(F.struct("term", "positions")).alias("found"))
    places = lambda t: F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("found", lambda x: x["term"] == t), lambda x: x["positions"]))))
    terms = F.array_distinct(F.transform("found", lambda x: x["term"]))
    r = r.select("release_id", F.map_from_entries(F.transform(terms, lambda t: F.struct(t.alias("term"), places(t).alias("positions")))).alias("at"))
    has = lambda t: F.map_contains_key("at", t)
    for t in every:
        r = r.where(has(t))
    if some:
        r = r.where(F.arrays_overlap(F.map_keys("at"), F.array(*[F.lit(t) for t in some])))
    for t in never:
        r = r.where(~has(t))
    if inside:
        r = r.where(has_phrase(F.col("at"), phrase, analyze))
    return r.select("release_id")


def headlines(releases: DataFrame, index: DataFrame, words: list[str], k: int = 25, analyze: Callable = lexemes) -> DataFrame:
    """(release_id, snippet) of the k releases (a page of results) with all words, the newest first: only their bodies are read for snippets."""
    found = search(index, all_of=words, analyze=analyze)
    page = releases.join(found, "release_id", "left_semi").orderBy(F.col("published_at").desc_nulls_last(), "release_id").limit(k)
    terms = wanted(words, analyze)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([headline(t, terms, analyze) for t in b.column(1).to_pylist()], pa.string())], ["release_id", "snippet"])

    return page.select("release_id", "body_text").mapInArrow(run, "release_id long, snippet string")


def rank(index: DataFrame, word: str, k: int, analyze: Callable = lexemes) -> DataFrame:
    """(release_id, hits, score): the best k releases for one word, 0.1 * sum of 1/j^2 over its hits, scaled."""
    score = F.aggregate(F.sequence(F.lit(1), F.col("hits")), F.lit(0.0), lambda s, j: s + 0.1 / (j.cast("double") * j)) / 1.64493406685
    r = index.where(F.col("term").isin(wanted([word], analyze))).select("release_id", F.size("positions").alias("hits"))
    return r.select("release_id", "hits", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "release_id").limit(k)


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n_releases, n_hits) of every term."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("n_releases"), F.sum(F.size("positions")).alias("n_hits"))
