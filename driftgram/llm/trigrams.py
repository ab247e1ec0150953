"""Boolean trigram queries derived from regular expressions.

A query is a conjunction of clauses; a clause is a disjunction of alternatives; an alternative
is a set of trigrams that must all occur. Any text that a regex matches satisfies its query.
Texts and literals are compared with ASCII letters in lower case, which only widens the query.

Edge cases: an empty pattern, and one of which no three characters are certain, has an empty query,
which every text satisfies; a pattern that Python's parser doesn't know is an error.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser

MAX_EXACT = 64

Query = frozenset[frozenset[frozenset[str]]]


def _lower(code: int) -> str:
    return chr(code + 32) if 65 <= code <= 90 else chr(code)


def _class(items: list) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            out.add(_lower(value))
        elif kind is sre.RANGE and value[1] - value[0] < 8:
            out |= {_lower(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 4 else None


def _exact(node: tuple) -> set[str] | None:
    """Every string (lower case) that the node can match, or None where that set is large."""
    kind, value = node
    if kind is sre.LITERAL:
        return {_lower(value)}
    if kind is sre.IN:
        return _class(value)
    if kind is sre.SUBPATTERN:
        return _sequence_exact(value[3])
    if kind is sre.BRANCH:
        parts = [_sequence_exact(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[1] is not sre.MAXREPEAT and value[1] <= 3:
        one = _sequence_exact(value[2])
        if one is None:
            return None
        out, power = set(), {""}
        for times in range(value[1] + 1):
            out |= power if times >= value[0] else set()
            power = {a + b for a in power for b in one}
        return out if len(out) <= MAX_EXACT else None
    if kind is sre.AT or kind in (sre.ASSERT, sre.ASSERT_NOT):
        return {""}
    return None


def _sequence_exact(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _exact(node)
        if more is None or len(out) * len(more) > MAX_EXACT:
            return None
        out = {a + b for a in out for b in more}
    return out


def _clause(strings: set[str]) -> set[frozenset[frozenset[str]]]:
    """The clause "one of these strings occurs"; nothing if one of them has no trigram."""
    if not strings or min(map(len, strings)) < 3:
        return set()
    return {frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)}


def _walk(nodes) -> set[frozenset[frozenset[str]]]:
    clauses: set = set()
    run = {""}
    for node in nodes:
        kind, value = node
        exact = _exact(node)
        if exact is not None and len(run) * len(exact) <= MAX_EXACT:
            run = {a + b for a in run for b in exact}
            continue
        clauses |= _clause(run)
        run = exact if exact is not None else {""}
        if exact is None and kind is sre.SUBPATTERN:
            clauses |= _walk(value[3])
        elif exact is None and kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] >= 1:
            clauses |= _walk(value[2])
        elif exact is None and kind is sre.BRANCH:
            sides = [_walk(x) for x in value[1]]
            if all(sides):  # one clause of each side at least: their union must hold
                clauses.add(frozenset().union(*(min(s, key=lambda c: (len(c), sorted(map(sorted, c)))) for s in sides)))
    return clauses | _clause(run)


def query(pattern: str) -> Query:
    """Clauses that every match of ``pattern`` satisfies; empty if none is mandatory."""
    return frozenset(_walk(parser.parse(pattern)))
