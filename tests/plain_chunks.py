"""Greedy chunk rules for one text, step by step: what the folds on the JVM are held against."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from math import sqrt

_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z\"])|(?<=\n)\s*\n")
_SEPARATORS = ("\n\n", "\n", " ")
#: Longer texts are walked word by word and piece by piece: a list of all their words would be many times their size.
_LONG = 1_000_000


def words(s: str) -> Iterator[str]:
    return iter(s.split()) if len(s) <= _LONG else (m[0] for m in re.finditer(r"\S+", s))


def pieces(s: str, sep: str) -> Iterator[str]:
    """What s.split(sep) gives, one after the other."""
    if len(s) <= _LONG:
        yield from s.split(sep)
        return
    at = 0
    while (end := s.find(sep, at)) >= 0:
        yield s[at:end]
        at = end + len(sep)
    yield s[at:]


def tokens(s: str) -> int:
    n = len(s.split()) if len(s) <= _LONG else sum(1 for _ in words(s))
    return max(1, round(n * 1.3)) if s else 0


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _SENTENCE.split(text)) if s]


def windows(text: str, size: int) -> list[str]:
    w, n = words(text), int(size / 1.3)
    return list(iter(lambda: " ".join(islice(w, n)), ""))


def tail(units: list[str], overlap: int) -> list[str]:
    """The longest run of whole units at the end with at most `overlap` tokens."""
    keep, total = len(units), 0
    while keep and total + tokens(units[keep - 1]) <= overlap:
        keep -= 1
        total += tokens(units[keep])
    return units[keep:]


def by_sentence(text: str, size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    fresh = False
    for s in sentences(text):
        if tokens(s) > size:
            if fresh:
                out.append(" ".join(held))
            *full, last = windows(s, size)
            out += full
            held, fresh = [last], True
            continue
        if held and sum(map(tokens, held)) + tokens(s) > size:
            if fresh:
                out.append(" ".join(held))
            held = tail(held, overlap)
        held.append(s)
        fresh = True
    return [*out, " ".join(held)] if held and fresh else out


def recursive(text: str, size: int, overlap: int, level: int = 0) -> list[str]:
    if tokens(text) <= size:
        return [text] if text.strip() else []
    if level == len(_SEPARATORS):
        return [text[i : i + 4 * size] for i in range(0, len(text), 4 * size)]
    sep = _SEPARATORS[level]
    out: list[str] = []
    held: list[str] = []
    total, fresh = 0, False
    for piece in pieces(text, sep):
        n = tokens(piece)
        if not n:
            continue
        if n > size:
            if fresh:
                out.append(sep.join(held))
            out += recursive(piece, size, overlap, level + 1)
            held, total, fresh = [], 0, False
            continue
        if held and total + n > size:
            if fresh:
                out.append(sep.join(held))
            held = tail(held, overlap)
            total = sum(map(tokens, held))
        held.append(piece)
        total, fresh = total + n, True
    return [*out, sep.join(held)] if fresh else out


def cosine(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    dot = sum(n * b[t] for t, n in a.items())
    return dot / sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def similarities(parts: list[str], buffer: int = 1) -> list[float]:
    join = lambda ks: sum((bags[k] for k in ks), Counter())
    bags: dict[int, Counter] = {}  # of the sentences around the break only
    out, made = [], 0
    for i in range(1, len(parts)):
        for k in range(made, min(len(parts), i + buffer)):
            bags[k] = Counter(m[0] for m in re.finditer(r"[a-z0-9]+", parts[k].lower()))
            made = k + 1
        bags.pop(i - buffer - 1, None)
        out.append(cosine(join(range(max(0, i - buffer), i)), join(range(i, min(len(parts), i + buffer)))))
    return out


def threshold(sims: list[float], percentile: int = 95) -> float:
    return sorted(sims)[max(0, int(len(sims) * (100 - percentile) / 100) - 1)] if sims else 0.3


def semantic(text: str, size: int, overlap: int, percentile: int = 95) -> list[str]:
    parts = sentences(text)
    sims = similarities(parts)
    cut = threshold(sims, percentile)
    out: list[str] = []
    held: list[str] = []
    for i, s in enumerate(parts):
        if held and (sims[i - 1] < cut or sum(map(tokens, held)) + tokens(s) > size):
            out.append(" ".join(held))
            held = tail(held, overlap)
        held.append(s)
    return [*out, " ".join(held)] if held else out


def hierarchy(text: str, sizes: tuple[int, int, int] = (2048, 512, 128)) -> list[tuple[str, str | None, str, str]]:
    """(key, parent key, kind, text) of parents, children and grandchildren."""
    out: list[tuple[str, str | None, str, str]] = []
    c = g = 0
    for p, parent in enumerate(recursive(text, sizes[0], 0)):
        out.append((f"P{p}", None, "parent", parent))
        for child in recursive(parent, sizes[1], 0):
            out.append((f"C{c}", f"P{p}", "child", child))
            for grand in recursive(child, sizes[2], 0):
                out.append((f"G{g}", f"C{c}", "grandchild", grand))
                g += 1
            c += 1
    return out
