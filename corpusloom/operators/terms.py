"""Search and term statistics: postings, ranked and faceted search, trends, log-odds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.english import light_lexemes
from ..sources.tables import AS_OF, WINDOW_START, Tables, days, ts
from . import fulltext
from .stats import active, n, per_period, visible

# Words that trending terms leave out.
TREND_STOP = [
    "senator", "senators", "press", "release", "statement", "announce", "announces", "urge", "urges", "call", "calls", "join", "joins", "lead",
    "leads", "support", "supports", "introduce", "introduces", "legislation", "bipartisan", "their", "about", "after", "would", "could", "should",
    "which", "where", "other", "there", "these", "those", "being", "through", "between", "under", "during", "before", "above", "below", "against",
    "without", "within", "along", "among", "across", "behind", "beyond", "since", "until", "while", "around", "inside", "outside", "today", "more",
    "than", "from", "this", "that", "with", "have", "will", "into", "over", "your", "what", "when", "they", "them", "also",
]

# Words that a member's or a chamber's terms leave out.
PROCEDURAL = [
    "senator", "senators", "press", "release", "statement", "announces", "urges", "calls", "joins", "leads", "supports", "introduces", "legislation",
    "bipartisan", "their", "about", "after", "would", "could", "should", "which", "where", "other", "there", "these", "those", "being", "through",
    "between", "under", "during", "before", "above", "below", "against", "without", "within", "along", "among", "across", "behind", "beyond",
    "since", "until", "while", "around", "inside", "outside", "today", "washington", "office", "united", "states", "american", "americans",
    "members", "member", "following", "every", "first", "again", "including", "continue", "continues", "important", "provide", "provides",
]
SIGNATURE_STOP = [*PROCEDURAL, "releases", "letter", "letters", "floor", "remark", "remarks"]


def distinct_words(rows: DataFrame, words: Column, keep: list[str]) -> DataFrame:
    """(keep..., word): the distinct words of each row, made distinct inside the row, so nothing is shuffled for it."""
    return rows.select(*keep, F.explode(F.array_distinct(words)).alias("word"))


def stems(title: Column) -> Column:
    return F.transform(C.title_words(title, ""), lambda w: F.regexp_replace(w, "s$", ""))


def trending(t: Tables, scope: str = "month", as_of: str = AS_OF, k: int = 30, prior: str = "same_calendar") -> DataFrame:
    """(word, recent_count, prior_count, delta): both windows are counted in one scan. The scope ``ytd`` compares this year so far with the
    same days of the year before (``same_calendar``), or with that year up to as long before this one's start as now is after it
    (``as_written``)."""
    length, least = {"week": (7, 2), "month": (30, 3), "ytd": (None, 5), "all": (None, 30)}[scope]
    v = visible(t.releases)
    if scope == "ytd":
        now, at = ts(as_of), F.col("published_at")
        start = F.date_trunc("year", now).cast("timestamp_ntz")
        year = F.expr("interval 1 year")
        end = {"same_calendar": now - year, "as_written": start - (now - start)}[prior] + days(1)
        v = v.where((at >= start) | ((at >= start - year) & (at < end))).withColumn("recent", at >= start)
    elif length is None:
        v = v.where(F.col("published_at") >= ts(WINDOW_START)).withColumn("recent", F.lit(True))
    else:
        v = v.where(F.col("published_at") >= ts(as_of) - days(2 * length)).withColumn("recent", F.col("published_at") >= ts(as_of) - days(length))
    w = distinct_words(v, stems(F.col("title")), ["recent"]).where((F.length("word") > 4) & ~F.col("word").isin(TREND_STOP))
    c = w.groupBy("word").agg(F.count_if(F.col("recent")).alias("recent_count"), F.count_if(~F.col("recent")).alias("prior_count")).where(F.col("recent_count") >= least)
    delta = F.lit(0).cast("long") if scope == "all" else F.col("recent_count") - F.col("prior_count")
    return c.select("word", "recent_count", "prior_count", delta.alias("delta")).orderBy(F.desc("recent_count"), "word").limit(k)


def trend_direction(recent: Column, prior: Column) -> Column:
    return F.when((recent == 0) & (prior == 0), "none").when(prior == 0, "new").when(recent > prior, "up").when(recent < prior, "down").otherwise("flat")


def topic_trends(t: Tables, chamber: str, as_of: str = AS_OF, k: int = 20) -> DataFrame:
    """Title stems of a chamber's last 30 days without the members' own surnames."""
    m = active(t.members, chamber)
    surnames = m.select(F.regexp_replace(F.lower(F.element_at(F.split("full_name", " "), -1)), "s$", "").alias("word")).distinct()
    v = visible(t.releases).where(F.col("published_at") >= ts(as_of) - days(30)).join(m.select("member_id"), "member_id")
    w = distinct_words(v, stems(F.col("title")), []).where((F.length("word") > 4) & ~F.col("word").isin(PROCEDURAL))
    return w.join(surnames, "word", "left_anti").groupBy("word").agg(n().alias("n")).where("n >= 3").orderBy(F.desc("n"), "word").limit(k)


def member_topic_trends(t: Tables, as_of: str = AS_OF, window: int = 180, k: int = 5) -> DataFrame:
    """Every member's words of title and body, its recent half-window against the one before: top k each."""
    v = visible(t.releases).where(F.col("published_at") >= ts(as_of) - days(window))
    v = v.withColumn("recent", F.col("published_at") >= ts(as_of) - days(window // 2))
    words = C.title_words(F.concat_ws(" ", "title", "body_text"), " ")
    w = distinct_words(v, words, ["member_id", "recent"]).where((F.length("word") > 4) & ~F.col("word").isin(PROCEDURAL))
    c = w.groupBy("member_id", "word").agg(F.count_if(F.col("recent")).alias("recent_count"), F.count_if(~F.col("recent")).alias("prior_count")).where("recent_count >= 2")
    rank = F.row_number().over(Window.partitionBy("member_id").orderBy(F.desc("recent_count"), "prior_count", "word"))
    return c.withColumn("rank", rank).where(F.col("rank") <= k)


def party_skew(t: Tables, k: int = 12, least: int = 12) -> DataFrame:
    """Words of titles that one party uses more, by log-odds with add-one smoothing: top k of each side."""
    v = visible(t.releases).where(F.col("published_at") >= ts(WINDOW_START)).join(active(t.members, "senate").where("party in ('D', 'R')").select("member_id", "party"), "member_id")
    w = v.select("party", F.explode(C.title_words(F.col("title"), " ")).alias("word")).where((F.length("word") > 4) & ~F.col("word").isin(TREND_STOP))
    c = w.groupBy(F.regexp_replace("word", "s$", "").alias("word")).agg(F.count_if(F.col("party") == "D").alias("d_count"), F.count_if(F.col("party") == "R").alias("r_count")).where(F.col("d_count") + F.col("r_count") >= least)
    total = c.agg(F.sum("d_count").alias("d"), F.sum("r_count").alias("r"))  # one row
    odds = F.log(((F.col("d_count") + 1) / (F.col("d") + 1)) / ((F.col("r_count") + 1) / (F.col("r") + 1)))
    s = c.join(F.broadcast(total)).select("word", "d_count", "r_count", F.round(odds, 6).alias("log_odds"))
    return s.orderBy(F.desc("log_odds"), "word").limit(k).withColumn("side", F.lit("D")).unionByName(s.orderBy("log_odds", "word").limit(k).withColumn("side", F.lit("R")))


def signature_terms(t: Tables, k: int = 5, least: int = 3) -> DataFrame:
    """Every member's words by log-odds against all others', top k each: one aggregation by (member, word), not a loop."""
    v = visible(t.releases).where(F.col("published_at") >= ts(WINDOW_START)).join(active(t.members).select("member_id"), "member_id")
    w = v.select("member_id", F.explode(C.title_words(F.col("title"), " ")).alias("word")).where((F.length("word") > 4) & ~F.col("word").isin(SIGNATURE_STOP))
    mine = w.groupBy("member_id", "word").agg(n().alias("s"))
    words, members = mine.groupBy("word").agg(F.sum("s").alias("w")), mine.groupBy("member_id").agg(F.sum("s").alias("m"))
    c = mine.where(F.col("s") >= least).join(words, "word").join(members, "member_id").join(F.broadcast(mine.agg(F.sum("s").alias("a"))))
    s, r = F.col("s"), F.col("w") - F.col("s")
    odds = F.log((s + 1) / (F.col("m") - s + 1)) - F.log((r + 1) / (F.col("a") - F.col("m") - r + 1))
    c = c.select("member_id", "word", "s", F.round(odds, 6).alias("log_odds"))
    rank = F.row_number().over(Window.partitionBy("member_id").orderBy(F.desc("log_odds"), "word"))
    return c.withColumn("rank", rank).where(F.col("rank") <= k)


# ---------------------------------------------------------------- search


def postings(t: Tables) -> DataFrame:
    """(term, release_id, positions, n): the inverted index of titles and bodies. A text's places are grouped inside its row; only where several
    rows have one id are their postings shuffled together."""
    p = fulltext.postings(t.releases, light_lexemes)
    if not t.releases.groupBy("release_id").count().where("count > 1").isEmpty():
        p = p.groupBy("term", "release_id").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    return p.withColumn("n", F.size("positions").cast("long"))


def may_have(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows whose title or body contains every term as a piece of text: a cheap test in generated code, passed by all rows that hold the
    terms as words, so that the analyser runs on few rows."""
    text = F.lower(F.concat_ws(" ", "title", "body_text"))
    for w in wanted:
        rows = rows.where(text.contains(w))
    return rows


def with_all(t: Tables, wanted: list[str]) -> DataFrame:
    """(release_id) of the releases that have every term. Terms are looked up in each row, so nothing is shuffled."""
    have = C.terms(F.concat_ws(" ", "title", "body_text"))
    return may_have(t.releases, wanted).where(F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), have)) == 0)


def search(t: Tables, all_of: list[str] = (), any_of: list[str] = (), none_of: list[str] = (), phrase: str = "") -> DataFrame:
    """Releases by required, alternative and excluded terms and a phrase."""
    have = C.terms(F.concat_ws(" ", "title", "body_text"))
    lits = lambda ws: F.array(*[F.lit(w) for w in ws])
    r = may_have(t.releases, [*all_of, *phrase.split()])
    if all_of:
        r = r.where(F.size(F.array_except(lits(all_of), have)) == 0)
    if any_of:
        r = r.where(F.arrays_overlap(have, lits(any_of)))
    if none_of:
        r = r.where(~F.arrays_overlap(have, lits(none_of)))
    if phrase:
        r = r.where(F.concat(F.lit(" "), F.array_join(have, " "), F.lit(" ")).contains(f" {phrase} "))
    return r


def rank_single(t: Tables, term: str, k: int) -> DataFrame:
    """The best k releases for one term: 0.1 * sum 1/j^2 over its hits, scaled as the public ranking function of PostgreSQL."""
    hits = F.size(F.filter(C.terms(F.concat_ws(" ", "title", "body_text")), lambda w: w == term))
    score = F.aggregate(F.sequence(F.lit(1), F.col("hits")), F.lit(0.0), lambda s, j: s + 0.1 / (j.cast("double") * j)) / 1.64493406685
    r = may_have(t.releases, [term]).select("release_id", hits.alias("hits")).where("hits > 0").select("release_id", "hits", F.round(score, 9).alias("score"))
    return r.orderBy(F.desc("score"), "release_id").limit(k)


def rank_all(t: Tables, first: str, second: str, k: int) -> DataFrame:
    """The best k releases that hold both terms: 1 - product of (1 - 0.1 * sqrt(w(d))) over pairs of their positions with
    w(d) = 1 / (1.005 + 0.05 * exp(d / 1.5 - 2)), as the public ranking function of PostgreSQL. Positions over 100 apart add less
    than a double can tell from nothing, so each hit looks only at the terms near it, and a text is passed once."""
    words, near = C.terms(F.concat_ws(" ", "title", "body_text")), 100
    weight = lambda d: F.sqrt(1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2.0)))
    at = lambda term: F.filter(F.transform(F.col("words"), lambda w, i: F.when(w == term, i)), lambda i: i.isNotNull())
    r = may_have(t.releases, [first, second]).select("release_id", words.alias("words")).where(F.array_contains("words", first) & F.array_contains("words", second))
    r = r.select("release_id", "words", F.explode(at(first)).alias("a"))
    low, high = F.greatest(F.col("a") - near, F.lit(0)), F.col("a") + near
    around = F.slice("words", low + 1, high - low + 1)
    logs = F.transform(around, lambda w, i: F.when(w == second, F.ln(1.0 - 0.1 * weight(F.abs(i + low - F.col("a")).cast("double")))).otherwise(0.0))
    r = r.select("release_id", F.aggregate(logs, F.lit(0.0), lambda s, x: s + x).alias("log"))
    r = r.groupBy("release_id").agg(n().alias("hits"), F.round(1.0 - F.exp(F.sum("log")), 6).alias("score"))
    return r.orderBy(F.desc("score"), "release_id").limit(k)


def headlines(t: Tables, wanted: list[str], fragments: int = 2, longest: int = 18) -> DataFrame:
    """(release_id, snippet) of the releases with every term: up to two windows of words that do not overlap, each opened five words
    before a hit, hits in <mark>, joined by an ellipsis. A window's words are found by the analyser's rule, one word at a time."""
    words = F.filter(F.split(F.coalesce("body_text", F.lit("")), r"\s+"), lambda w: w != "")
    is_hit = lambda w: F.arrays_overlap(C.terms(w), F.array(*[F.lit(x) for x in wanted]))
    r = with_all(t, wanted).select("release_id", words.alias("w"))
    r = r.withColumn("at", F.filter(F.transform("w", lambda w, i: F.when(is_hit(w), i)), lambda i: i.isNotNull()))
    picked = F.aggregate("at", F.array().cast("array<int>"), lambda s, i: F.when((F.size(s) < fragments) & ((F.size(s) == 0) | (i - 5 >= F.element_at(s, -1) + longest)), F.array_append(s, F.greatest(i - 5, F.lit(0)))).otherwise(s))
    marked = lambda s: F.array_join(F.transform(F.slice("w", s + 1, longest), lambda w: F.when(is_hit(w), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)), " ")
    return r.select("release_id", F.array_join(F.transform(picked, marked), " … ").alias("snippet"))


def facets(t: Tables, term: str, party: str | None = None, kind: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """(facet, key, n) of a search; each facet leaves out its own filter and keeps the others. The filters are flags, so all
    facets come from one pass. With an ``index`` (postings), texts aren't read."""
    found = search(t, all_of=[term]) if index is None else t.releases.join(index.where(F.col("term") == term).select("release_id").distinct(), "release_id", "left_semi")
    r = found.where(F.col("deleted_at").isNull() & (F.col("content_type") != "photo_release")).join(active(t.members), "member_id")
    p = F.lit(True) if party is None else F.col("party") == party
    c = F.lit(True) if kind is None else F.col("content_type") == kind
    rows = F.array_compact(
        F.array(
            F.when(c, F.struct(F.lit("party").alias("facet"), F.col("party").alias("key"))),
            F.when(p, F.struct(F.lit("type").alias("facet"), F.col("content_type").alias("key"))),
            F.when(p & c, F.struct(F.lit("state").alias("facet"), F.col("state").alias("key"))),
        )
    )
    return r.select(F.explode(rows).alias("x")).groupBy("x.facet", "x.key").agg(n().alias("n"))


def hits(t: Tables, wanted: list[str], index: DataFrame | None = None) -> DataFrame:
    """(term, release columns) of the visible releases that hold each of several terms: one scan for all terms, of the postings if there is
    an ``index``, so that texts aren't read."""
    if index is not None:
        of = index.where(F.col("term").isin(wanted)).select("release_id", "term").distinct()
        v = visible(t.releases).where(F.col("published_at") >= ts(WINDOW_START)).select("release_id", "member_id", "published_at", "title")
        return v.join(of, "release_id")
    have = C.terms(F.concat_ws(" ", "title", "body_text"))
    v = visible(t.releases).where(F.col("published_at") >= ts(WINDOW_START))
    text = F.lower(F.concat_ws(" ", "title", "body_text"))
    v = v.where(reduce(lambda a, b: a | b, [text.contains(w) for w in wanted]))
    return v.select("release_id", "member_id", "published_at", "title", F.explode(F.array_intersect(F.array(*[F.lit(w) for w in wanted]), have)).alias("term"))


def term_counts_by_member(t: Tables, term: str, index: DataFrame | None = None) -> DataFrame:
    """Active members with the number of their releases that hold a term, zeros included."""
    per = hits(t, [term], index).groupBy("member_id").agg(n().alias("n"))
    return active(t.members).select("member_id").join(per, "member_id", "left").select("member_id", F.coalesce("n", F.lit(0)).alias("n"))


def term_series(t: Tables, wanted: list[str], index: DataFrame | None = None) -> DataFrame:
    return per_period(hits(t, wanted, index), "week", ["term"])


def series_matrix(t: Tables, wanted: list[str], index: DataFrame | None = None) -> DataFrame:
    """Weeks by terms, zeros filled."""
    return term_series(t, wanted, index).groupBy("week").pivot("term", wanted).agg(F.sum("n")).na.fill(0)


def term_timeline(t: Tables, term: str, k: int = 5, index: DataFrame | None = None) -> DataFrame:
    """The k weeks with most hits, each with its earliest release."""
    h = hits(t, [term], index).withColumn("week", F.to_date(F.date_trunc("week", "published_at")))
    top = h.groupBy("week").agg(n().alias("n")).orderBy(F.desc("n"), "week").limit(k)
    first = F.row_number().over(Window.partitionBy("week").orderBy("published_at", "release_id"))
    return h.join(top, "week").withColumn("rn", first).where("rn = 1").select("week", "n", "release_id")


def topic_owners(t: Tables, wanted: list[str], k: int = 3, index: DataFrame | None = None) -> DataFrame:
    """The k members with most releases that hold each term."""
    per = hits(t, wanted, index).join(active(t.members, "senate").select("member_id"), "member_id").groupBy("term", "member_id").agg(n().alias("n"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("n"), "member_id"))
    return per.withColumn("rank", rank).where(F.col("rank") <= k)
