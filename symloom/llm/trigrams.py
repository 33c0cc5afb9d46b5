"""Boolean trigram queries from regular expressions.

A query holds for every lower-cased text that the regex matches: nested tuples ("and", ...) and
("or", ...) over trigrams, or ANY where nothing can be said. What a sub-expression is known to
match exactly, begin with and end with is carried upwards, and trigrams are taken where known
strings get long or meet.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass, field

Query = tuple | str
ANY: Query = ()
#: Most strings of one set, and most characters of a class that is spelled out.
STRINGS, SPELLED = 64, 8


def conj(*parts: Query) -> Query:
    found: list[Query] = []
    for p in parts:
        found += p[1:] if isinstance(p, tuple) and p[:1] == ("and",) else [p] if p != ANY else []
    found = list(dict.fromkeys(found))
    return ANY if not found else found[0] if len(found) == 1 else ("and", *found)


def disj(*parts: Query) -> Query:
    if ANY in parts or not parts:
        return ANY
    found: list[Query] = []
    for p in parts:
        found += p[1:] if isinstance(p, tuple) and p[0] == "or" else [p]
    found = list(dict.fromkeys(found))
    flat = [frozenset(p[1:]) if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in found]
    found = [p for p, f in zip(found, flat, strict=True) if not any(g < f for g in flat)]  # a or (a and b) is a
    return found[0] if len(found) == 1 else ("or", *found)


def of_string(s: str) -> Query:
    return conj(*(s[i : i + 3] for i in range(len(s) - 2)))


def of_strings(strings: set[str]) -> Query:
    return disj(*(of_string(s) for s in sorted(strings)))


@dataclass
class Known:
    """Of what a sub-expression matches: all of it, if known; how it begins and ends; what it needs."""

    exact: set[str] | None
    prefix: set[str] = field(default_factory=lambda: {""})
    suffix: set[str] = field(default_factory=lambda: {""})
    need: Query = ANY

    def begins(self) -> set[str]:
        return self.prefix if self.exact is None else self.exact

    def ends(self) -> set[str]:
        return self.suffix if self.exact is None else self.exact

    def needs(self) -> Query:
        return self.need if self.exact is None else conj(self.need, of_strings(self.exact))


def _cross(a: set[str], b: set[str]) -> set[str]:
    return {x + y for x in a for y in b}


def _short(strings: set[str], end: bool) -> set[str]:
    """Only the two characters that a neighbour's can join to trigrams."""
    return {s[-2:] if end else s[:2] for s in strings}


def join(a: Known, b: Known) -> Known:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= STRINGS:
        return Known(_cross(a.exact, b.exact), need=conj(a.need, b.need))
    meet = ANY
    if len(a.ends()) * len(b.begins()) <= STRINGS:
        meet = of_strings(_cross(_short(a.ends(), True), _short(b.begins(), False)))
    prefix, suffix = a.begins(), b.ends()
    if a.exact is not None and len(a.exact) * len(b.begins()) <= STRINGS:
        prefix = _cross(a.exact, b.begins())
    if b.exact is not None and len(b.exact) * len(a.ends()) <= STRINGS:
        suffix = _cross(a.ends(), b.exact)
    return Known(None, prefix, suffix, conj(a.needs(), b.needs(), meet))


def either(parts: list[Known]) -> Known:
    exact = None
    if all(p.exact is not None for p in parts):
        exact = set().union(*(p.exact for p in parts))
        if len(exact) <= STRINGS and all(p.need == ANY for p in parts):
            return Known(exact)
    prefix, suffix = set().union(*(p.begins() for p in parts)), set().union(*(p.ends() for p in parts))
    small = lambda s: s if len(s) <= STRINGS else {""}
    return Known(None, small(prefix), small(suffix), disj(*(p.needs() for p in parts)))


def _spelled(items: list) -> set[str] | None:
    found: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < 2 * SPELLED:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= SPELLED else None


def known(parsed) -> Known:
    out = Known({""})
    for op, value in parsed:
        if op is sre.LITERAL:
            part = Known({chr(value).lower()})
        elif op is sre.IN:
            chars = _spelled(value)
            part = Known(chars)
        elif op is sre.SUBPATTERN:
            part = known(value[3])
        elif op is sre.BRANCH:
            part = either([known(b) for b in value[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = value[0], value[1], known(value[2])
            if (low, high) == (0, 1):
                part = either([inner, Known({""})])
            elif low == high and inner.exact is not None and len(inner.exact) ** low <= STRINGS:
                part = Known({""})
                for _ in range(low):
                    part = join(part, inner)
            elif low:
                part = Known(None, inner.begins(), inner.ends(), inner.needs())
            else:
                part = Known(None)
        elif op is sre.AT:
            part = Known({""})
        else:
            part = Known(None)
        out = join(out, part)
    return out


def query(pattern: str) -> Query:
    """What every match needs, over lower-cased text."""
    return known(sre_parser.parse(pattern)).needs()


def terms(q: Query) -> list[str]:
    """The trigrams of a query, in order."""
    if isinstance(q, str):
        return [q]
    return sorted({t for part in q[1:] for t in terms(part)}) if q else []
