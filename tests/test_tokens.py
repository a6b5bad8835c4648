"""Literal tokens of each type, and covers and fragments by brute force."""

import random
import re

import pytest

from corpusloom.functions.english import light_lexemes
from corpusloom.functions.headline import covers, fragments, headline
from corpusloom.functions.lexer import tokens, typed_lexemes


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The naïve plan9", [("asciiword", "The"), ("word", "naïve"), ("numword", "plan9")]),
        ("up-to-date", [("asciihword", "up-to-date"), ("hword_asciipart", "up"), ("hword_asciipart", "to"), ("hword_asciipart", "date")]),
        ("covid-19 élan-vital", [("numhword", "covid-19"), ("hword_asciipart", "covid"), ("hword_numpart", "19"), ("hword", "élan-vital"), ("hword_part", "élan"), ("hword_asciipart", "vital")]),
        ("-12 +3 7 3.14 -0.5 1.5e-7 8.3.0", [("int", "-12"), ("int", "+3"), ("uint", "7"), ("float", "3.14"), ("float", "-0.5"), ("sfloat", "1.5e-7"), ("version", "8.3.0")]),
        ("mail a.b+c@x.example.org, please", [("asciiword", "mail"), ("email", "a.b+c@x.example.org"), ("asciiword", "please")]),
        ("https://www.example.org/news/item.html?x=1.", [("url", "www.example.org/news/item.html?x=1"), ("host", "www.example.org"), ("url_path", "/news/item.html?x=1")]),
        ("see example.org.", [("asciiword", "see"), ("host", "example.org")]),
        ("/usr/local/foo.txt", [("file", "/usr/local/foo.txt")]),
        ("<b>bold</b> &amp; x<!-- no -->", [("asciiword", "bold"), ("asciiword", "x")]),
        ("", []),
        (None, []),
    ],
)
def test_types(text, want):
    assert list(tokens(text)) == want


def test_places_of_typed_lexemes():
    assert typed_lexemes("The well-known farms at farm.example.org") == {"well-known": [1], "well": [2], "known": [3], "farm": [4], "farm.example.org": [6]}
    assert typed_lexemes("running-shoes ran -5 times") == {"running-shoe": [0], "run": [1], "shoe": [2], "ran": [3], "-5": [4], "time": [5]}
    assert typed_lexemes("x" * 100_000)["x" * 100_000] == [0]


def plain_covers(places):
    have = sorted({p for at in places for p in at})
    whole = [(a, b) for a in have for b in have if a <= b and all(any(a <= p <= b for p in at) for at in places)]
    return sorted(w for w in whole if not any(v != w and w[0] <= v[0] and v[1] <= w[1] for v in whole))


@pytest.mark.parametrize("seed", range(40))
def test_covers_and_fragments_by_brute_force(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 60)
    words = [rng.choice(["a", "is", "word", "longer", "tax", "farm", "water"]) for _ in range(n)]
    terms = rng.sample(["tax", "farm", "water"], rng.choice([1, 2, 3]))
    places = [[i for i, w in enumerate(words) if w == t] for t in terms]
    found = list(covers(places))
    assert found == (plain_covers(places) if all(places) else [])
    parts = fragments(words, places, 2, 12, 4, 3)
    assert len(parts) <= 2 and all(a <= b for a, b in parts) and all(b - a < 12 for a, b in parts) and all(x[1] < y[0] for x, y in zip(parts, parts[1:], strict=False))
    if found:
        hits = {p for at in places for p in at}
        best = max(sum(1 for h in hits if h in range(s, s + 12) and c[0] <= h <= c[1]) for c in found for s in (h for h in hits if c[0] <= h <= c[1]))
        assert max(sum(1 for h in hits if a <= h <= b) for a, b in parts) >= min(best, max(sum(1 for h in hits if c[0] <= h <= min(c[1], c[0] + 11)) for c in found))
    else:
        assert parts == [(0, min(4, n) - 1)]


def test_headline_marks_hits():
    text = "of the it " * 10 + "farm bills and taxes on water now " + "of it " * 10
    shown = headline(text, ["farm", "water"], light_lexemes)
    assert shown.startswith("<mark>farm</mark>") and "<mark>water</mark>" in shown and len(shown.split()) <= 18 and re.sub("</?mark>", "", shown) in " ".join(text.split())
    assert headline(None, ["x"], light_lexemes) == headline("", ["x"], light_lexemes) == ""
    assert headline("one two three", ["x"], light_lexemes) == "one two three"
