"""Token counts by an exact length histogram.

Documents are encoded once; only ``(n_tokens, number of documents)`` is aggregated, with partial sums before the shuffle, so
a corpus of any size becomes one row for each length that occurs. Suffix sums over the lengths then answer, for every context
limit L: how many documents have at least L tokens, how many tokens a cut at L keeps and drops, and quantiles.

The suffix sums are made in two levels (within blocks of lengths, then over blocks), so no window holds the whole histogram.

Cases: null and empty texts have length 0 and count as documents; repeated rows count each time; an empty table gives an
empty histogram; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import token_counts
from .common import table, written

#: Lengths in one block of the suffix sums.
BLOCK = 256


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs) with one row for each encoded length that occurs. Written, as the totals read it more than once."""
    return written(token_counts(docs, path).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "length-histogram")


def context_totals(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram, taken as a context limit: n_docs of that length, docs_at_least (L tokens or more),
    tokens_at_least (their tokens), docs_below, kept_tokens (all tokens after a cut at L), dropped_tokens."""
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    sups = blocks.groupBy(F.floor(F.col("block") / BLOCK).alias("sup")).agg(F.sum("d").alias("sd"), F.sum("t").alias("st"))
    # Over the blocks of blocks: one row for each 65,536 lengths, so a handful whatever the corpus.
    above_sup = Window.orderBy(F.desc("sup")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("sup")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sups = sups.select("sup", F.coalesce(F.sum("sd").over(above_sup), F.lit(0)).alias("sup_d"), F.coalesce(F.sum("st").over(above_sup), F.lit(0)).alias("sup_t"), F.sum("sd").over(whole).alias("all_d"), F.sum("st").over(whole).alias("all_t"))
    above = Window.partitionBy("sup").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocks.withColumn("sup", F.floor(F.col("block") / BLOCK))
        .select("sup", "block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t"))
        .join(sups, "sup")
        .select("block", (F.col("d") + F.col("sup_d")).alias("above_d"), (F.col("t") + F.col("sup_t")).alias("above_t"), "all_d", "all_t")
    )
    here = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = h.withColumns({"d": F.sum("n_docs").over(here), "t": F.sum("tokens").over(here)}).join(blocks, "block")
    at_d, at_t = F.col("d") + F.col("above_d"), F.col("t") + F.col("above_t")
    dropped = at_t - F.col("n_tokens") * at_d
    return out.select(
        "n_tokens",
        "n_docs",
        at_d.alias("docs_at_least"),
        at_t.alias("tokens_at_least"),
        (F.col("all_d") - at_d).alias("docs_below"),
        (F.col("all_t") - dropped).alias("kept_tokens"),
        dropped.alias("dropped_tokens"),
        F.col("all_t").alias("total_tokens"),
        F.col("all_d").alias("total_docs"),
    )


def length_quantiles(totals: DataFrame, points: list[float]) -> DataFrame:
    """(point, n_tokens): the smallest length that at least the given share of documents does not exceed."""
    up_to = F.col("docs_below") + F.col("n_docs")
    return totals.agg(*[F.min(F.when(up_to >= F.lit(p) * F.col("total_docs"), F.col("n_tokens"))).alias(f"q{k}") for k, p in enumerate(points)]).select(
        F.explode(F.array(*[F.struct(F.lit(p).alias("point"), F.col(f"q{k}").alias("n_tokens")) for k, p in enumerate(points)])).alias("x")
    ).select("x.*")


def truncated_total(totals: DataFrame, limit: int) -> DataFrame:
    """One row (limit, kept_tokens): all tokens after a cut at any limit, whether or not a document has that length."""
    longer = totals.where(F.col("n_tokens") > limit)
    return totals.agg(F.max("total_tokens").alias("total")).join(
        longer.agg(F.coalesce(F.sum(F.col("n_docs") * (F.col("n_tokens") - limit)), F.lit(0)).alias("cut"))
    ).select(F.lit(limit).alias("limit"), (F.coalesce("total", F.lit(0)) - F.col("cut")).alias("kept_tokens"))


def op4_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each length of the whole table, with the totals of that context limit."""
    return context_totals(length_histogram(table(spark, sf_dir, "documents")))
