"""Boolean trigram queries derived from regular expressions.

A query is a disjunction of clauses (a set of sets of trigrams): a text that
the regex matches holds all trigrams of at least one clause. A clause without
trigrams asks for nothing, so a query with one is no restriction. Every step
may only loosen the query, never tighten it.

For each part of the expression four things are kept: the strings it can match
exactly, if they are few; else the strings a match can begin and end with
(two characters are enough), and the query that any match fulfils. Parts are
joined as the expression joins them, and the trigrams across each joint are
added.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser as parser

MOST_STRINGS, MOST_CLAUSES, MOST_REPEATS = 48, 64, 3
Query = frozenset[frozenset[str]]
ANYTHING: Query = frozenset([frozenset()])
EMPTY = frozenset([""])


def _absorb(clauses) -> Query:
    """Without clauses that ask for more than another one does."""
    kept: list[frozenset[str]] = []
    for c in sorted(set(clauses), key=lambda c: (len(c), sorted(c))):
        if not any(k <= c for k in kept):
            kept.append(c)
    return frozenset(kept) if len(kept) <= MOST_CLAUSES else ANYTHING


def either(a: Query, b: Query) -> Query:
    return _absorb(a | b)


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_CLAUSES:
        # Either side alone is still necessary; the one whose least clause asks for more is kept.
        return max(a, b, key=lambda q: min(map(len, q)))
    return _absorb(x | y for x, y in product(a, b))


def of_strings(strings: frozenset[str]) -> Query:
    """What any text with one of the strings holds."""
    if not strings or min(map(len, strings)) < 3:
        return ANYTHING
    return _absorb(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


@dataclass(frozen=True)
class Part:
    exact: frozenset[str] | None
    first: frozenset[str] = EMPTY
    last: frozenset[str] = EMPTY
    query: Query = ANYTHING

    def loose(self) -> Part:
        """The same without exact strings."""
        if self.exact is None:
            return self
        return Part(None, _cut(self.exact, 0), _cut(self.exact, 1), of_strings(self.exact))


def _cut(strings: frozenset[str], end: int) -> frozenset[str]:
    for n in (2, 1):
        some = frozenset(s[-n:] if end else s[:n] for s in strings)
        if len(some) <= MOST_STRINGS:
            return some
    return EMPTY


ANY_CHARACTER = Part(None)
NOTHING = Part(EMPTY)


def _pairs(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
    return frozenset(x + y for x, y in product(a, b))


def follow(x: Part, y: Part) -> Part:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MOST_STRINGS:
        return Part(_pairs(x.exact, y.exact))
    a, b = x.loose(), y.loose()
    joint = of_strings(_pairs(a.last, b.first)) if len(a.last) * len(b.first) <= MOST_CLAUSES else ANYTHING
    first = _cut(_pairs(x.exact, b.first), 0) if x.exact is not None and len(x.exact) * len(b.first) <= 4 * MOST_STRINGS else a.first
    last = _cut(_pairs(a.last, y.exact), 1) if y.exact is not None and len(y.exact) * len(a.last) <= 4 * MOST_STRINGS else b.last
    return Part(None, first, last, both(both(a.query, b.query), joint))


def choose(x: Part, y: Part) -> Part:
    if x.exact is not None and y.exact is not None and len(x.exact | y.exact) <= MOST_STRINGS:
        return Part(x.exact | y.exact)
    a, b = x.loose(), y.loose()
    return Part(None, _cut(a.first | b.first, 0), _cut(a.last | b.last, 1), either(a.query, b.query))


def _class(items, fold) -> Part:
    chars: set[str] = set()
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            chars.add(fold(chr(value)))
        elif name == "RANGE" and value[1] - value[0] < MOST_STRINGS:
            chars.update(fold(chr(c)) for c in range(value[0], value[1] + 1))
        else:
            return ANY_CHARACTER
    return Part(frozenset(chars)) if 0 < len(chars) <= 8 else ANY_CHARACTER


def _part(tree, fold) -> Part:
    out = NOTHING
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            here = Part(frozenset([fold(chr(value))]))
        elif name == "IN":
            here = _class(value, fold)
        elif name in ("NOT_LITERAL", "ANY"):
            here = ANY_CHARACTER
        elif name == "SUBPATTERN":
            here = _part(value[3], fold)
        elif name == "ATOMIC_GROUP":
            here = _part(value, fold)
        elif name == "BRANCH":
            options = [_part(x, fold) for x in value[1]]
            here = options[0]
            for x in options[1:]:
                here = choose(here, x)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value[0], value[1], _part(value[2], fold)
            if low == 0:
                here = choose(inner, NOTHING) if high == 1 else ANY_CHARACTER
            else:
                here = inner
                for _ in range(min(low, MOST_REPEATS) - 1):
                    here = follow(here, inner)
                if high != low or low > MOST_REPEATS:
                    # More of the same may stand between the beginning and the end.
                    here = here.loose()
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            here = NOTHING
        else:
            here = ANY_CHARACTER
        out = follow(out, here)
    return out


def derive(regex: str, ignore_case: bool = False) -> list[list[str]]:
    """The clauses of a regex, sorted; empty where no trigram is mandatory. With ``ignore_case`` the trigrams are those of the text in lower case."""
    fold = str.lower if ignore_case else str
    query = _part(parser.parse(regex), fold).loose().query
    return sorted(sorted(c) for c in query) if all(query) else []
