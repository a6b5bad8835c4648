"""Titles, people's names, slugs and tenure, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Small words of titles, named entities, nicknames.
SMALL_WORDS = ["a", "an", "the", "and", "but", "or", "for", "nor", "on", "at", "to", "by", "of", "in", "is", "it", "as"]
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“"}
NICKNAMES = {
    "charles": ["chuck", "charlie"],
    "william": ["bill", "will", "willie"],
    "robert": ["bob", "rob", "robbie"],
    "richard": ["rick", "dick", "richie"],
    "michael": ["mike", "mikey"],
    "timothy": ["tim", "timmy"],
    "thomas": ["tom", "tommy"],
    "edward": ["ed", "ted", "eddie"],
    "theodore": ["ted", "teddy"],
    "james": ["jim", "jimmy", "jamie"],
    "patricia": ["pat", "patty", "trish"],
    "patrick": ["pat", "paddy"],
    "catherine": ["cathy", "kate", "katie", "cat"],
    "katherine": ["kate", "kathy", "katie"],
    "elizabeth": ["liz", "beth", "betty", "ellie"],
    "margaret": ["maggie", "meg", "peggy"],
    "joseph": ["joe", "joey"],
    "joshua": ["josh"],
    "benjamin": ["ben", "benji"],
    "alexander": ["alex"],
    "christopher": ["chris", "kit"],
    "daniel": ["dan", "danny"],
    "raphael": ["raph"],
    "cynthia": ["cindy"],
    "martin": ["marty"],
    "mitchell": ["mitch"],
    "ronald": ["ron"],
    "donald": ["don", "donny"],
    "cornelius": ["neil"],
    "cory": ["corey"],
    "bernard": ["bernie"],
    "angus": ["gus"],
}


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _numbered(text: Column, pattern: str, base: int) -> Column:
    """Text with each match of the pattern as the character of that number; numbers that are no character stay as they are."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    numbers = F.regexp_extract_all(text, F.lit(pattern), 1)

    def char(whole: Column, number: Column) -> Column:
        code = F.when(F.length(number) <= 8, F.conv(number, base, 10).cast("long"))
        good = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(whole)

    chars = F.zip_with(found, numbers, char)
    return F.array_join(F.zip_with(parts, chars, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")


def decode_entities(text: Column) -> Column:
    """Numbered entities (hexadecimal, decimal, and hexadecimal ones that lack their #), then named ones."""
    step = lambda pattern, base: lambda x: _numbered(x, pattern, base)
    for pattern, base in ((r"&#x([0-9a-fA-F]+);?", 16), (r"&#([0-9]+);?", 10), (r"&x([0-9a-fA-F]+);?", 16)):
        text = let(text, step(pattern, base))
    for name, char in [kv for kv in ENTITIES.items() if kv[0] != "amp"] + [("amp", "&")]:
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def normalize_title(title: Column) -> Column:
    """Entities decoded; titles of which 70 % of the letters are capitals in title case: acronyms of two to four letters stay,
    small words after the first become lower case. Null stays null."""

    def recased(piece: Column, at: Column) -> Column:
        core = F.regexp_replace(piece, "[^a-zA-Z]", "")
        small = F.array_contains(strings(SMALL_WORDS), F.lower(core))
        return F.when(core.rlike("^[A-Z]{2,4}$") & ~small, piece).when((at > 0) & small, F.lower(piece)).otherwise(F.concat(F.upper(F.substring(piece, 1, 1)), F.lower(F.substr(piece, F.lit(2)))))

    def cased(text: Column) -> Column:
        letters, capitals = F.length(F.regexp_replace(text, "[^a-zA-Z]", "")), F.length(F.regexp_replace(text, "[^A-Z]", ""))
        pieces = F.regexp_extract_all(text, F.lit(r"\s+|\S+"), 0)
        return F.when((letters == 0) | (capitals < 0.7 * letters), text).otherwise(F.array_join(F.transform(pieces, recased), ""))

    return let(decode_entities(title), cased)


def name_exclusions(full_name: Column, entity_id: Column) -> Column:
    """Sorted tokens of a name and an id, with the nicknames of formal names and the formal names of nicknames; over two letters."""
    back: dict[str, list[str]] = {}
    for formal, nicks in NICKNAMES.items():
        for nick in nicks:
            back.setdefault(nick, []).append(formal)
    known = F.create_map(*[F.lit(x) for k, v in (back | NICKNAMES).items() for x in (k, " ".join(v))])
    tokens = F.split(F.lower(F.concat_ws(" ", full_name, entity_id)), "[^a-z]+")
    more = F.flatten(F.transform(tokens, lambda w: F.split(F.coalesce(known[w], F.lit("")), " ")))
    return F.array_sort(F.array_distinct(F.filter(F.concat(tokens, more), lambda w: F.length(w) > 2)))


def entity_key(full_name: Column) -> Column:
    """``last-first`` of a name, without suffix, initials and other characters than letters; one word alone is its own key."""
    name = F.regexp_replace(full_name, r"\s+(Jr\.|Sr\.|III|II|IV)\s*$", "")
    parts = F.split(F.trim(F.regexp_replace(name, r"\s+[A-Z]\.(\s+|$)", " ")), r"\s+")
    bare = lambda w: F.regexp_replace(F.lower(w), "[^a-z]", "")
    return F.when(F.size(parts) >= 2, F.concat_ws("-", bare(F.element_at(parts, -1)), bare(F.element_at(parts, 1)))).otherwise(bare(full_name))


def slug_candidates(section: Column) -> Column:
    """Post-type slugs to try for a section, from its last part to its first: as it is, with _ or nothing for -, and singular."""

    def forms(part: Column) -> Column:
        dashed, plural, single = part.contains("-"), part.endswith("s"), F.regexp_replace(part, "s$", "")
        return F.array_compact(
            F.array(
                part,
                F.when(dashed, F.replace(part, F.lit("-"), F.lit("_"))),
                F.when(dashed, F.replace(part, F.lit("-"), F.lit(""))),
                F.when(plural, single),
                F.when(plural & dashed, F.replace(single, F.lit("-"), F.lit("_"))),
            )
        )

    parts = F.filter(F.split(section, "/"), lambda p: p != "")
    return F.array_distinct(F.flatten(F.transform(F.reverse(parts), forms)))


def years_in_office(first_term: Column, as_of: Column) -> Column:
    years = F.datediff(as_of, first_term) / 365.25
    return F.when(first_term.isNull(), "—").when(years < 1, "<1").otherwise(F.floor(years).cast("string"))


def next_election(term_end: Column) -> Column:
    """Terms end in January, so the election is in November of the year before."""
    return F.coalesce(F.concat(F.lit("Nov "), (F.year(term_end) - 1).cast("string")), F.lit("—"))


def migration_stamped(published: Column, modified: Column, day: str) -> Column:
    """Published on the day of a site's migration and modified within two minutes of that: the date is the migration's."""
    apart = F.abs(F.unix_timestamp(modified.cast("timestamp")) - F.unix_timestamp(published.cast("timestamp")))
    return F.coalesce((F.to_date(published) == F.lit(day).cast("date")) & (F.coalesce(apart, F.lit(0)) < 120), F.lit(False))


def numbered_slug(url: Column) -> Column:
    """Whether an address ends in -N, as a copy's does."""
    return url.rlike(r"-\d+/?$")


# Letters with marks (U+00C0 to U+017F) and the letters below them.
MARKED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1}
#: The stages by which a name is resolved, the surest first.
STAGES = ["id", "name", "plain", "no_suffix", "last_name"]


def without_marks(text: Column) -> Column:
    return F.translate(text, "".join(MARKED), "".join(MARKED.values()))


def without_suffix(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"(?i),?\s*\b(jr\.?|sr\.?|iii|ii|iv)$", ""))


def name_keys(full_name: Column, entity_id: Column | None = None) -> Column:
    """array of struct(stage, key) by which a name is known; a name that is asked for also has the stage ``no_suffix``, and its id is
    given, while a known one has the ids that its words make: last-first, and rest-first for more than two words."""
    lower = F.lower(F.trim(F.regexp_replace(full_name, r"\s+", " ")))
    plain = without_marks(lower)
    bare = without_suffix(plain)
    words = F.split(plain, " ")
    made = F.array(F.concat_ws("-", F.element_at(words, -1), F.get(words, F.lit(0))), F.concat_ws("-", F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), "-"), F.get(words, F.lit(0))))
    ids = F.array(F.lower(entity_id)) if entity_id is not None else F.when(F.size(words) > 1, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))
    as_stage = lambda k, keys: F.transform(keys, lambda x: F.struct(F.lit(k).alias("stage"), x.alias("key")))
    last = F.element_at(F.split(bare if entity_id is not None else plain, " "), -1)
    all_keys = F.concat(as_stage(0, ids), as_stage(1, F.array(lower)), as_stage(2, F.array(plain)), as_stage(3, F.array(bare if entity_id is not None else plain)), as_stage(4, F.array(last)))
    return F.filter(all_keys, lambda x: x["key"].isNotNull() & (x["key"] != ""))


def resolve_names(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(ask_id, known_id, stage) of every row of ``asked`` (ask_id, entity_id, full_name): the one entity of ``known`` (known_id, full_name) that it means, by the
    first stage at which exactly one fits; nulls where none does. A key that fits several at a stage decides nothing there.

    All stages are one join on (stage, key), whose known side has each key once. Repeated rows of ``known`` count as one entity; repeated
    rows of ``asked`` give one row; null names and ids have no keys."""
    keys = known.select("known_id", F.explode(name_keys(F.col("full_name"))).alias("k")).select("known_id", "k.stage", "k.key")
    sure = keys.groupBy("stage", "key").agg(F.min("known_id").alias("known_id"), F.max("known_id").alias("other")).where("known_id = other").drop("other")
    wanted = asked.select("ask_id", F.explode_outer(name_keys(F.col("full_name"), F.coalesce("entity_id", F.lit("")))).alias("k")).select("ask_id", "k.stage", "k.key")
    first = wanted.join(sure, ["stage", "key"], "left").groupBy("ask_id").agg(F.min(F.when(F.col("known_id").isNotNull(), F.struct("stage", "known_id"))).alias("x"))
    stage = F.when(F.col("x.stage") == 0, STAGES[0])
    for k, name in enumerate(STAGES[1:], 1):
        stage = stage.when(F.col("x.stage") == k, name)
    return first.select("ask_id", "x.known_id", stage.alias("stage"))
