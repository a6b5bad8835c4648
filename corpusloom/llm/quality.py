"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps its failures as bits of one long and the measurements behind
them. A policy is a named, versioned set of rules, that is a mask: applying one, comparing versions or asking what a rule alone
costs (ablation) are bitwise operations over the ledger, without the texts. Ablations first count documents by their whole
mask, so only the masks that occur are aggregated further.

Words are runs without ASCII white space; lines are split at line feeds. A word is in a repeated window if a run of three words
that holds it comes twice or more in the text.

Cases: null and empty texts have no words and fail the base rules; rows are judged one by one, so repeated rows and null ids
change nothing; very long texts are held one at a time; an empty table gives an empty ledger; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import holding, small_batches, table, take

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: What is measured of a text, in the order of the ledger's columns.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_exclaims", "n_window_distinct"]

#: Words of a window in which distinct words are counted; only whole windows count, so that the share does not fall with length.
WINDOW = 200

#: The rules: a name, and the SQL over the measurements that is true where a text fails. A rule's place is its bit; new rules
#: are added at the end, so that older ledgers and policies stay valid.
RULES = [
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * word_chars"),
    ("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    ("shouting", "n_upper + n_lower >= 100 and 100 * n_upper > 50 * (n_upper + n_lower)"),
    ("exclamations", "n_words > 0 and 100 * n_exclaims > 50 * n_words"),
    ("few_distinct_words", f"n_words >= {WINDOW} and 100 * n_window_distinct < 5 * (n_words - n_words % {WINDOW})"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Policies by version: the rules that reject.
POLICIES = {
    "base": ["too_few_words", "repeated_windows"],
    "v1": ["too_few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length"],
    "v2": [name for name, _ in RULES],
}
CURRENT = "v2"


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def measure(text: str | None) -> tuple[int, ...]:
    t = text or ""
    words = WORD.findall(t)
    n = len(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        covered = bytearray(n)
        for i, w in enumerate(windows):
            if counts[w] > 1:
                covered[i] = covered[i + 1] = covered[i + 2] = 1
        repeated = sum(covered)
    lines, dup = t.split("\n"), 0
    if len(lines) > 1:
        full = [x for x in lines if WORD.search(x)]
        dup, n_lines = len(full) - len(set(full)), len(full)
    else:
        n_lines = int(n > 0)
    upper, lower = case_counts(t)
    symbols = sum(map(t.count, "#*$%&|<>"))
    return n, sum(map(len, words)), symbols, n_lines, dup, repeated, upper, lower, t.count("!"), sum(len(set(words[i : i + WINDOW])) for i in range(0, n - n % WINDOW, WINDOW))


def case_counts(t: str) -> tuple[int, int]:
    """Letters that change when lower-cased, and when upper-cased."""
    if t.isascii():
        b = t.encode()
        upper = len(b) - len(b.translate(None, UPPER))
        return upper, len(b) - len(b.translate(None, LOWER))
    low, up = t.lower(), t.upper()
    if len(low) == len(t) == len(up):
        return sum(map(str.__ne__, t, low)), sum(map(str.__ne__, t, up))
    return sum(c != c.lower() for c in t), sum(c != c.upper() for c in t)


UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the measurements), in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            holding("quality")
            rows = [measure(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), *[pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]] if rows else [b.column(0), *[pa.array([], pa.int64())] * len(MEASURES)], ["doc_id", *MEASURES])

    d = take(docs, id_col, text_col).toDF("doc_id", "text")
    return small_batches(d).mapInArrow(run, f"doc_id {d.schema[0].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES))


def fail_bits() -> Column:
    """The ledger's long, of the measurements."""
    bits = F.lit(0).cast("long")
    for name, rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, the measurements, fail_bits): every rule, evaluated once."""
    return measured(docs).withColumn("fail_bits", fail_bits())


def passes(policy: str = CURRENT) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(rule, n_failed, n_only, n_without): documents that fail a rule, that only this rule of the policy rejects, and that the
    policy would keep without it."""
    m = mask(policy)
    seen = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    per = [
        F.struct(
            F.lit(r).alias("rule"),
            F.when(F.col("bits").bitwiseAND(F.lit(BIT[r]).cast("long")) != 0, F.col("n")).otherwise(F.lit(0)).alias("failed"),
            F.when(F.col("bits") == BIT[r], F.col("n")).otherwise(F.lit(0)).alias("only"),
            F.when(F.col("bits").bitwiseAND(F.lit(m & ~BIT[r]).cast("long")) == 0, F.col("n")).otherwise(F.lit(0)).alias("without"),
        )
        for r in POLICIES[policy]
    ]
    return seen.select(F.explode(F.array(*per)).alias("x")).groupBy("x.rule").agg(F.sum("x.failed").alias("n_failed"), F.sum("x.only").alias("n_only"), F.sum("x.without").alias("n_without"))


def policy_counts(led: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """(policy, n_kept, n_docs) of each version."""
    seen = led.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    per = [F.struct(F.lit(p).alias("policy"), F.when(passes(p), F.col("n")).otherwise(F.lit(0)).alias("kept"), F.col("n").alias("n")) for p in policies or POLICIES]
    return seen.select(F.explode(F.array(*per)).alias("x")).groupBy("x.policy").agg(F.sum("x.kept").alias("n_kept"), F.sum("x.n").alias("n_docs"))


def judged_text(text: str | None) -> tuple[int, ...]:
    holding("quality")
    return measure(text)


def kept_documents(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the policy keeps. One pass: no join, no shuffle."""
    of = F.udf(judged_text, "struct<" + ", ".join(f"{m}: long" for m in MEASURES) + ">", useArrow=True)
    names = docs.columns
    plain = small_batches(docs).toDF(*[f"c{i}" for i in range(len(names))])
    judged = plain.withColumn("_m", of(F.col(f"c{names.index('text')}"))).select("*", *[F.col(f"_m.{m}").alias(m) for m in MEASURES])
    return judged.withColumn("fail_bits", fail_bits()).where(passes(policy)).select(*[F.col(f"c{i}") for i in range(len(names))]).toDF(*names)


def op10_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledger(table(spark, sf_dir, "documents"))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask("base")).cast("long")) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), passes().alias("kept"), "fail_bits")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
k AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM k),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  length(t) - length(replace(t, '!', '')) AS n_exclaims,
  list_sum(list_transform(range(0, len(ws) // 200), lambda i: len(list_distinct(ws[i * 200 + 1:i * 200 + 200])))) AS n_distinct,
  len(list_filter(string_split(t, ''), lambda x: x <> lower(x))) AS n_upper, len(list_filter(string_split(t, ''), lambda x: x <> upper(x))) AS n_lower
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
b AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 16 ELSE 0 END
  + CASE WHEN n_upper + n_lower >= 100 AND 100 * n_upper > 50 * (n_upper + n_lower) THEN 32 ELSE 0 END
  + CASE WHEN n_words > 0 AND 100 * n_exclaims > 50 * n_words THEN 64 ELSE 0 END
  + CASE WHEN n_words >= 200 AND 100 * n_distinct < 5 * (n_words - n_words % 200) THEN 128 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
