"""The English analyser: lower case, words of letters and digits, stop words left out, stems by the published Porter2 rules."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The stop words of English full-text search.
STOP = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing",
    "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
]

# Words whose stem the rules would miss, and words that are their own stem.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl",
}
OWN_STEM = ["sky", "news", "howe", "atlas", "cosmos", "bias", "andes"]
OWN_STEM_SINGULAR = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
OWN_PREFIX = ["gener", "commun", "arsen"]

# Suffixes and what they become, within the first region, then within it after those; and those that go within the second region.
FIRST = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
SECOND = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
THIRD = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]

VOWELS = frozenset("aeiouy")
WORD = re.compile(r"[a-z0-9]+")
SKIPPED = frozenset(STOP)


def region(w: str, start: int) -> int:
    """The place after the first consonant that follows a vowel, from ``start`` on."""
    return next((i + 1 for i in range(start + 1, len(w)) if w[i] not in VOWELS and w[i - 1] in VOWELS), len(w))


def ends_short(w: str) -> bool:
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in VOWELS and w[-1] not in "wxY" and w[-2] in VOWELS and w[-3] not in VOWELS


def longest(w: str, suffixes) -> str:
    return max((s for s in suffixes if w.endswith(s)), key=len, default="")


def without_plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and not VOWELS.isdisjoint(w[:-2]):
        return w[:-1]
    return w


def without_tense(w: str, r1: int) -> str:
    s = longest(w, ["eed", "eedly", "ed", "edly", "ing", "ingly"])
    base = w[: len(w) - len(s)]
    if s in ("eed", "eedly"):
        return base + "ee" if len(base) >= r1 else w
    if not s or VOWELS.isdisjoint(base):
        return w
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
        return base[:-1]
    return base + "e" if r1 >= len(base) and ends_short(base) else base


def without_ending(w: str, r1: int, r2: int) -> str:
    s = longest(w, FIRST)
    base = w[: len(w) - len(s)]
    if s and len(base) >= r1 and (s != "ogi" or base.endswith("l")) and (s != "li" or base[-1:] in tuple("cdeghkmnrt")):
        w = base + FIRST[s]
    s = longest(w, SECOND)
    base = w[: len(w) - len(s)]
    if s and len(base) >= (r2 if s == "ative" else r1):
        w = base + SECOND[s]
    s = longest(w, THIRD)
    base = w[: len(w) - len(s)]
    if s and len(base) >= r2 and (s != "ion" or base.endswith(("s", "t"))):
        w = base
    last = len(w) - 1
    if w.endswith("e") and (last >= r2 or (last >= r1 and not ends_short(w[:-1]))):
        return w[:-1]
    return w[:-1] if w.endswith("ll") and last >= r2 else w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The Porter2 stem of a word in lower case; words with digits, and those of one or two letters, stay."""
    if len(word) < 3 or not word.isalpha() or word in OWN_STEM:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = ""
    for c in word:  # a y that is a consonant
        w += "Y" if c == "y" and (not w or w[-1] in VOWELS) else c
    prefix = next((p for p in OWN_PREFIX if w.startswith(p)), "")
    r1 = len(prefix) or region(w, 0)
    r2 = region(w, r1)
    w = without_plural(w)
    if w in OWN_STEM_SINGULAR:
        return w
    w = without_tense(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    return without_ending(w, r1, r2).replace("Y", "y")


#: Bytes of other characters than those of words, in lower case, become blanks.
BLANKED = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """(all words in order, words of each text); each word is analysed by itself."""
    bare = pa.array([x.lower().encode("utf-8", "replace").translate(BLANKED) for x in texts], pa.binary()).cast(pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(bare))
    found, n = pc.list_flatten(lists), pc.list_value_length(lists).to_numpy()
    empty = pc.equal(found, "")  # a text without words is split into one
    if pc.any(empty).as_py():
        empty = empty.to_numpy(zero_copy_only=False)
        n = n - np.bincount(np.repeat(np.arange(len(texts)), n)[empty], minlength=len(texts))
        found = found.filter(pa.array(~empty))
    return found, n


def light_terms(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of places of each word, which is one, the light analyser's terms there)."""
    return np.ones(len(words), np.int64), pc.replace_substring_regex(words, "s$", "")


def stemmed_terms(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of places of each word, which is one, the stems there; null for a stop word)."""
    return np.ones(len(words), np.int64), pa.array([None if w in SKIPPED else stem(w) for w in words.to_pylist()], pa.string())


def light_lexemes(text: str | None) -> dict[str, list[int]]:
    """The light analyser's terms of a text with their places, as ``columns.terms`` gives them."""
    found: dict[str, list[int]] = {}
    for i, m in enumerate(WORD.finditer((text or "").lower())):
        found.setdefault(m[0].removesuffix("s"), []).append(i)
    return found


def lexemes(text: str | None) -> dict[str, list[int]]:
    """The stems of a text with their places, from 0; stop words have a place and no entry."""
    found: dict[str, list[int]] = {}
    for i, m in enumerate(WORD.finditer((text or "").lower())):
        if m[0] not in SKIPPED:
            found.setdefault(stem(m[0]), []).append(i)
    return found
