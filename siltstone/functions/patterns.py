"""Patterns of plain Python by the letters that they begin with.

Python tries a pattern at every place of a text, and one of several alternatives, or with a word's edge first, has no letters that it could look for. Here each
alternative is tried only where its first letters stand, which a plain search finds; matches are those of the whole pattern, with the groups
of their alternative alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_HEAD = re.compile(r"(?:\\b)?([a-z ]+)(?![?*+{])")


def alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between the bars that stand in no bracket."""
    parts, depth = [""], 0
    for token in re.findall(r"\\.|\[(?:\\.|[^\]])*\]|.", pattern, re.S):
        depth += (token == "(") - (token == ")")
        if token == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += token
    return parts


Part = tuple[str, list[str], re.Pattern]  # an alternative: the letters that it begins with, or none; words of which a match then holds one; itself


def _next(part: Part, text: str, at: int) -> re.Match | None:
    head, words, pattern = part
    if not head:
        return pattern.search(text, at) if any(w in text for w in words) else None
    while (at := text.find(head, at)) >= 0:
        if match := pattern.match(text, at):
            return match
        at += 1
    return None


def first(parts: list[Part], text: str) -> re.Match | None:
    """The first match of any part; of parts that match at one place the first counts."""
    best, end = None, len(text)
    for part in parts:
        head, _, pattern = part
        if not head:
            match = _next(part, text, 0)
            if match and (best is None or match.start() < end):
                best, end = match, match.start()
            continue
        at = text.find(head)
        while 0 <= at < end:
            if match := pattern.match(text, at):
                best, end = match, at
                break
            at = text.find(head, at + 1)
    return best


def each(parts: list[Part], text: str) -> Iterator[re.Match]:
    """All matches of the parts that don't overlap, from the left. None may be empty."""
    live = [(match, part) for part in parts if (match := _next(part, text, 0))]
    while live:
        best = live[0][0] if len(live) == 1 else min((match for match, _ in live), key=re.Match.start)
        yield best
        end = best.end()
        live = [(later, part) for match, part in live if (later := match if match.start() >= end else _next(part, text, end))]


class Pattern:
    """A pattern in lower case, for texts in lower case. ``words``: every match holds one of them, as its alternative has it; for those that begin with no letters."""

    def __init__(self, pattern: str, flags: int = 0, words: tuple[str, ...] = ()):
        self.parts: list[Part] = []
        for part in alternatives(pattern):
            head = _HEAD.match(part)
            self.parts.append((head[1] if head else "", [w for w in words if w in part] or [""], re.compile(part, flags)))

    def search(self, text: str) -> re.Match | None:
        return first(self.parts, text)

    def each(self, text: str) -> Iterator[re.Match]:
        return each(self.parts, text)
