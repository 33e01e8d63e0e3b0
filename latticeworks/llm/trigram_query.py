"""Boolean trigram queries derived from regular expressions.

An expression is parsed and walked. Each part gives what is known of the
strings it matches, letters folded: all of them where they are few, else their
possible beginnings and ends of up to two characters and a query that each of
them satisfies. Joining two parts crosses what one ends with and what the next
begins with; alternatives unite; what may be left out or repeated loosens. The
query is a disjunction of sets of trigrams: a text with a match holds all
trigrams of one of the sets. It is a necessary condition only, so that whatever
an expression says beyond it (lookarounds, anchors, references) may be ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

#: Strings kept whole, characters of a class taken one by one, sets of a query, and copies of what repeats.
FEW, CLASS, SETS, COPIES = 64, 8, 64, 3

#: Disjunction of sets of trigrams; the empty set is always satisfied.
Query = frozenset[frozenset[str]]
ALWAYS: Query = frozenset([frozenset()])


def simple(sets: set[frozenset[str]] | Query) -> Query:
    """Without sets that hold another one; a query of too many sets gives way to their weakest."""
    least = frozenset(s for s in sets if not any(o < s for o in sets))
    return least if len(least) <= SETS else ALWAYS


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > SETS * SETS:
        return min(a, b, key=lambda q: sum(map(len, q)) == 0)
    joined = simple({x | y for x in a for y in b})
    return joined if joined != ALWAYS or ALWAYS in (a, b) else max(a, b, key=lambda q: min(map(len, q)))


def grams(strings: frozenset[str]) -> Query:
    """What holds of a text that contains one of some strings."""
    return simple({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def fold(c: str) -> str:
    return c.lower() if "A" <= c <= "Z" else c


@dataclass(frozen=True)
class Known:
    """Strings a part matches: all (``exact``), or what they begin and end with and satisfy."""

    exact: frozenset[str] | None
    first: frozenset[str]
    last: frozenset[str]
    query: Query

    def loose(self) -> Known:
        if self.exact is None:
            return self
        return Known(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), both(self.query, grams(self.exact)))

    def final(self) -> Query:
        k = self.loose()
        return both(k.query, both(grams(k.first), grams(k.last)))


def _exactly(strings: frozenset[str]) -> Known:
    k = Known(strings, frozenset(), frozenset(), ALWAYS)
    return k if len(strings) <= FEW else k.loose()


ANYTHING = Known(None, frozenset([""]), frozenset([""]), ALWAYS)
NOTHING = _exactly(frozenset([""]))


def then(a: Known, b: Known) -> Known:
    """One part after another."""
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= FEW:
        return Known(frozenset(x + y for x in a.exact for y in b.exact), frozenset(), frozenset(), both(a.query, b.query))
    x, y = a.loose(), b.loose()
    first = frozenset((s + t)[:2] for s in a.exact for t in y.first) if a.exact is not None else x.first
    last = frozenset((s + t)[-2:] for s in x.last for t in b.exact) if b.exact is not None else y.last
    seam = grams(frozenset(s + t for s in (a.exact or x.last) for t in (b.exact or y.first)))
    return Known(None, first, last, both(both(x.query, y.query), seam))


def either(a: Known, b: Known) -> Known:
    if a.exact is not None and b.exact is not None and a.query == b.query == ALWAYS:
        return _exactly(a.exact | b.exact)
    x, y = a.loose(), b.loose()
    return Known(None, x.first | y.first, x.last | y.last, simple(x.query | y.query))


def _class(items: list) -> Known:
    found: set[str] = set()
    for kind, value in items:
        if kind is C.LITERAL:
            found.add(fold(chr(value)))
        elif kind is C.RANGE and value[1] - value[0] < CLASS:
            found |= {fold(chr(c)) for c in range(value[0], value[1] + 1)}
        else:  # a wide range, a category or a negation
            return ANYTHING
    return _exactly(frozenset(found)) if len(found) <= CLASS else ANYTHING


def _walk(parsed) -> Known:
    out = NOTHING
    for kind, value in parsed:
        if kind is C.LITERAL:
            part = _exactly(frozenset([fold(chr(value))]))
        elif kind is C.IN:
            part = _class(value)
        elif kind is C.SUBPATTERN:
            part = _walk(value[-1])
        elif kind is C.ATOMIC_GROUP:
            part = _walk(value)
        elif kind is C.BRANCH:
            ways = [_walk(x) for x in value[1]]
            part = ways[0]
            for w in ways[1:]:
                part = either(part, w)
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, inner = value
            one = _walk(inner)
            part = NOTHING
            for _ in range(min(least, COPIES)):
                part = then(part, one)
            if most == 1 and least == 0:
                part = either(NOTHING, one)
            elif most != least or least > COPIES:
                # what repeats may begin and end anew, so a copy at either end and anything between
                part = then(then(part, ANYTHING), one) if least else ANYTHING
        elif kind in (C.AT, C.ASSERT, C.ASSERT_NOT):
            part = NOTHING
        else:
            part = ANYTHING
        out = then(out, part)
    return out


def derive(regex: str) -> list[frozenset[str]]:
    """Sets of trigrams, one of which a text with a match holds whole; none if the expression forces no trigram."""
    found = _walk(parser.parse(regex)).final()
    return sorted(found, key=sorted) if all(found) else []
