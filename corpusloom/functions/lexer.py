"""Tokens of a text by type, as full-text parsers of databases tell them apart: words, mixed words, numbers with their signs, versions, hosts,
addresses, paths, e-mail, hyphenated compounds with their parts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .english import SKIPPED, stem

HOST = r"(?:[a-z0-9_](?:[a-z0-9_-]*[a-z0-9_])?\.)+[a-z]{2,}(?::[0-9]+)?"
#: The first type that fits at a place; of those that name nothing (tags, entities, protocols) no token is made.
FORMS = [
    ("tag", r"</?[a-z][^<>]*>|<!--.*?-->"),
    ("entity", r"&(?:[a-z][a-z0-9]*|#[0-9]+|#x[0-9a-f]+);"),
    ("protocol", r"[a-z][a-z0-9+.-]*://"),
    ("email", r"[a-z0-9_](?:[\w.+-]*\w)?@" + HOST),
    ("url", HOST + r"(?:/[^\s<>\"']*|\?[^\s<>\"']+)"),
    ("host", HOST + r"(?![\w@])"),
    ("file", r"(?<![\w/])/?[a-z0-9_][\w.-]*(?:/[\w.-]*\w)+|(?<![\w/])/[\w.-]*\w"),
    ("sfloat", r"(?<![\w.])[-+]?[0-9]+(?:\.[0-9]+)?e[-+]?[0-9]+(?!\w)"),
    ("version", r"(?<![\w.])[0-9]+(?:\.[0-9]+){2,}(?![\w])"),
    ("float", r"(?<![\w.])[-+]?[0-9]+\.[0-9]+(?!\w)"),
    ("int", r"(?<![\w.])[-+][0-9]+(?!\w)"),
    ("compound", r"[^\W_]+(?:-[^\W_]+)+"),
    ("uint", r"[0-9]+(?![^\W_])"),
    ("word", r"[^\W_]+"),
]
TOKEN = re.compile("|".join(f"(?P<{kind}>{form})" for kind, form in FORMS), re.I | re.S)
SILENT = ("tag", "entity", "protocol")
#: Types whose lexemes are stems.
STEMMED = ("asciiword", "word", "asciihword", "hword", "hword_asciipart", "hword_part")


def kind_of(word: str, prefix: str = "", suffix: str = "word") -> str:
    """asciiword, word or numword, and the like for compounds and their parts."""
    plain = word.replace("-", "")
    return prefix + ("num" if any(c.isdigit() for c in plain) else "ascii" if plain.isascii() else "") + suffix


def tokens(text: str | None) -> Iterator[tuple[str, str]]:
    """(type, token) in order. A compound comes as a whole, then its parts; an address as a whole, then its host and path."""
    for m in TOKEN.finditer(text or ""):
        kind, token = m.lastgroup, m[0]
        if kind in SILENT:
            continue
        if kind == "url":
            token = token.rstrip(".,;:!?)")
            host, slash, path = token.partition("/")
            if not slash:
                host, slash, path = token.partition("?")
            if not path:
                yield "host", host
                continue
            yield kind, token
            yield "host", host
            yield "url_path", slash + path
        elif kind == "compound":
            yield kind_of(token, suffix="hword"), token
            for part in token.split("-"):
                yield kind_of(part, "hword_", "part"), part
        else:
            yield kind_of(token) if kind == "word" else kind, token


def lexemes_of(piece: str) -> Iterator[str | None]:
    """The lexeme at each place; None for a stop word."""
    for kind, token in tokens(piece):
        token = token.lower()
        if kind in STEMMED:
            if token in SKIPPED:
                yield None
                continue
            token = "-".join(stem(p) if k + 1 == token.count("-") + 1 else p for k, p in enumerate(token.split("-"))) if "-" in token else stem(token)
        yield token


def typed_lexemes(text: str | None) -> dict[str, list[int]]:
    """Lexemes with their places from 0, a place for every token: words and parts of compounds as stems, without stop words; all else in lower
    case."""
    found: dict[str, list[int]] = {}
    for i, token in enumerate(lexemes_of(text or "")):
        if token is not None:
            found.setdefault(token, []).append(i)
    return found


#: Only tags and comments go over white space.
MARKUP = re.compile(r"<(?:/?[a-z]|!--)", re.I)


#: A chunk that is one word, and marks after it of which no token is made.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)[.,;:!?)]*")


def chunks(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """(pieces in order, pieces of each text): what stands between white space has its tokens by itself; a text that may hold tags is one piece."""
    found = [[x] if MARKUP.search(x) else x.split() for x in texts]
    return pa.array([c for x in found for c in x], pa.string()), np.array([len(x) for x in found], np.int64)


def terms_of_chunk(chunk: str) -> list[str | None]:
    plain = PLAIN.fullmatch(chunk)
    if not plain:
        return list(lexemes_of(chunk))
    word = plain[1].lower()
    return [None if word in SKIPPED else stem(word)]


def typed_terms(chunks: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of places of each chunk, the lexemes there; null for a stop word)."""
    found = [terms_of_chunk(c) for c in chunks.to_pylist()]
    return np.array([len(x) for x in found], np.int64), pa.array([t for x in found for t in x], pa.string())
