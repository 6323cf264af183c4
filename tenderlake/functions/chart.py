"""A chart parser for short statements: words become edges, rules join neighbouring edges to larger ones, and the best row of edges that doesn't overlap is the reading."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

Value = dict


@dataclass(frozen=True)
class Edge:
    kind: str
    start: int
    end: int  # behind the last word
    words: int  # that it explains
    value: Value


@dataclass(frozen=True)
class Rule:
    """``kind`` from a ``left`` and a ``right`` edge with at most ``gap`` words between. ``join`` makes the value from both, or None if they don't fit."""

    kind: str
    left: str
    right: str
    join: Callable[[Value, Value], Value | None] = lambda a, b: {**a, **b}
    gap: int = 0


#: A word, or a sign by itself.
TOKEN = re.compile(r"\d+|[^\W\d_]+(?:['’][^\W\d_]+)*|[^\w\s]|_", re.U)


def tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text)]


def parse(edges: Sequence[Edge], rules: Sequence[Rule]) -> list[Edge]:
    """All edges that the rules make of the given ones. Of edges of one kind over the same words that which explains most words stays, of equal ones the first."""
    by_left: dict[str, list[Rule]] = {}
    by_right: dict[str, list[Rule]] = {}
    for r in rules:
        by_left.setdefault(r.left, []).append(r)
        by_right.setdefault(r.right, []).append(r)
    best: dict[tuple[str, int, int], Edge] = {}
    starts: dict[tuple[str, int], set[int]] = {}  # kind and start: ends
    ends: dict[tuple[str, int], set[int]] = {}
    todo = sorted(edges, key=lambda e: (e.start, e.end, e.kind), reverse=True)
    while todo:
        e = todo.pop()
        key = (e.kind, e.start, e.end)
        if key in best and best[key].words >= e.words:
            continue
        best[key] = e
        starts.setdefault((e.kind, e.start), set()).add(e.end)
        ends.setdefault((e.kind, e.end), set()).add(e.start)
        made = []
        for r in by_left.get(e.kind, ()):
            for at in range(e.end, e.end + r.gap + 1):
                made += [(r, e, best[r.right, at, end]) for end in sorted(starts.get((r.right, at), ()))]
        for r in by_right.get(e.kind, ()):
            for at in range(e.start, e.start - r.gap - 1, -1):
                made += [(r, best[r.left, start, at], e) for start in sorted(ends.get((r.left, at), ()))]
        for r, a, b in made:
            value = r.join(a.value, b.value)
            if value is not None:
                todo.append(Edge(r.kind, a.start, b.end, a.words + b.words, value))
    return list(best.values())


def reading(edges: Sequence[Edge], goals: Sequence[str], n: int) -> list[Edge]:
    """Of the edges of the goals' kinds the row without overlaps that explains most words of the ``n``; of equally good ones that of fewest edges, then that whose edges begin first and are longest."""
    at: dict[int, list[Edge]] = {}
    for e in edges:
        if e.kind in goals:
            at.setdefault(e.start, []).append(e)
    # From the end: words explained, fewest edges, and the row.
    rest: list[tuple[int, int, tuple]] = [(0, 0, ())] * (n + 1)
    for i in range(n - 1, -1, -1):
        found = rest[i + 1]
        for e in sorted(at.get(i, ()), key=lambda e: (-e.end, goals.index(e.kind))):
            words, fewer, row = rest[e.end]
            if (words + e.words, fewer - 1) > found[:2] or ((words + e.words, fewer - 1) == found[:2] and (not found[2] or found[2][0].start > i)):
                found = (words + e.words, fewer - 1, (e, row))
        rest[i] = found
    out, row = [], rest[0][2]
    while row:
        out.append(row[0])
        row = row[1]
    return out
