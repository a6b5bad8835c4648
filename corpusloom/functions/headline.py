"""Headlines of search results by covers: the shortest stretches of a text that hold every term of the query."""

from __future__ import annotations

from collections.abc import Callable, Iterator


def covers(places: list[list[int]]) -> Iterator[tuple[int, int]]:
    """(first, last) of each minimal stretch with a place of every list: none lies inside another. Lists are sorted."""
    if not places or not all(places):
        return
    merged = sorted((p, k) for k, at in enumerate(places) for p in at)
    have, missing, left = [0] * len(places), len(places), 0
    for p, k in merged:
        missing -= have[k] == 0
        have[k] += 1
        if missing:
            continue
        while have[merged[left][1]] > 1:  # the first place of the stretch isn't needed
            have[merged[left][1]] -= 1
            left += 1
        yield merged[left][0], p
        have[merged[left][1]] -= 1
        missing += 1
        left += 1


def pieces(cover: tuple[int, int], hits: list[int], longest: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, hits) of a cover, cut into parts of at most ``longest`` words that begin and end with a hit."""
    inside = [h for h in hits if cover[0] <= h <= cover[1]]
    while inside:
        part = [h for h in inside if h < inside[0] + longest]
        yield part[0], part[-1], len(part)
        inside = inside[len(part) :]


def fragments(words: list[str], places: list[list[int]], most: int = 2, longest: int = 18, least: int = 6, short: int = 3) -> list[tuple[int, int]]:
    """(first, last) of at most ``most`` stretches that do not overlap, in order: those with most hits, of equal ones the shortest, of those
    the first; widened to ``longest`` words, to both sides alike; words of ``short`` letters or fewer at either end go, unless they are hits or the
    stretch would fall below ``least`` words. Without a cover the first ``least`` words."""
    hits = sorted({p for at in places for p in at})
    found = sorted({x for c in covers(places) for x in pieces(c, hits, longest)}, key=lambda x: (-x[2], x[1] - x[0], x[0]))
    chosen: list[tuple[int, int]] = []
    for first, last, _ in found:
        if len(chosen) == most:
            break
        if any(a <= last and first <= b for a, b in chosen):
            continue
        low = max((b + 1 for a, b in chosen if b < first), default=0)
        high = min((a - 1 for a, b in chosen if a > last), default=len(words) - 1)
        first = max(low, first - (longest - (last - first + 1)) // 2)
        last = min(high, first + longest - 1)
        marked = set(hits)
        while last - first + 1 > least and first not in marked and len(words[first]) <= short:
            first += 1
        while last - first + 1 > least and last not in marked and len(words[last]) <= short:
            last -= 1
        chosen.append((first, last))
    return sorted(chosen) or ([(0, min(least, len(words)) - 1)] if words else [])


def headline(text: str | None, terms: list[str], analyze: Callable, most: int = 2, longest: int = 18, least: int = 6, short: int = 3) -> str:
    """The fragments of a text with its hits in <mark>, joined by an ellipsis. A word is a hit if the analyser finds a term in it."""
    words = (text or "").split()
    of = [[i for i, found in enumerate(map(analyze, words)) if t in found] for t in terms]
    hits = {i for at in of for i in at}
    show = lambda i: f"<mark>{words[i]}</mark>" if i in hits else words[i]
    return " … ".join(" ".join(map(show, range(a, b + 1))) for a, b in fragments(words, of, most, longest, least, short))
