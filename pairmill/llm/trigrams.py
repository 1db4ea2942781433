"""Boolean trigram queries of regular expressions.

For a pattern this derives which trigrams a text must hold to have a match: a disjunction of trigram sets, in lower
case. The empty set in it means that nothing is mandatory. Literals, small character classes, alternatives and optional
parts are expanded into the exact strings they stand for; whatever can repeat, or stands for too many strings, ends the
strings before it.
"""

from __future__ import annotations

import re._constants as c
import re._parser as parser
from itertools import product

# Strings that are kept apart while a pattern is read, and characters of a class that are expanded.
MOST_STRINGS = 64
MOST_CHARS = 8

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _either(a: Query, b: Query) -> Query:
    """Alternatives, without those that another one makes superfluous."""
    both = a | b
    return frozenset(q for q in both if not any(p < q for p in both))


def _both(a: Query, b: Query) -> Query:
    found: Query = frozenset()
    for p, q in product(a, b):
        found = _either(found, frozenset([p | q]))
    return found


def _of_strings(strings: set[str]) -> Query:
    found: Query = frozenset()
    for s in strings:
        s = s.lower()
        found = _either(found, frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]))
    return found


def _exact(op, arg) -> set[str] | None:
    """The strings that one element stands for, or None if they are too many or none are certain."""
    if op is c.LITERAL:
        return {chr(arg)}
    if op is c.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is c.LITERAL:
                chars.add(chr(value))
            elif kind is c.RANGE and value[1] - value[0] < MOST_CHARS:
                chars.update(map(chr, range(value[0], value[1] + 1)))
            else:
                return None
        return chars if len(chars) <= MOST_CHARS else None
    if op is c.SUBPATTERN:
        return _exact_sequence(arg[3])
    if op is c.BRANCH:
        found: set[str] = set()
        for branch in arg[1]:
            strings = _exact_sequence(branch)
            if strings is None:
                return None
            found |= strings
        return found if len(found) <= MOST_STRINGS else None
    if op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[1] == 1:
        strings = _exact_sequence(arg[2])
        return None if strings is None else strings | ({""} if arg[0] == 0 else set())
    if op is c.AT:
        return {""}
    return None


def _exact_sequence(elements) -> set[str] | None:
    strings = {""}
    for op, arg in elements:
        more = _exact(op, arg)
        if more is None or len(strings) * len(more) > MOST_STRINGS:
            return None
        strings = {a + b for a, b in product(strings, more)}
    return strings


def _inside(op, arg) -> Query:
    """What an element demands that stands for no certain strings."""
    if op is c.SUBPATTERN:
        return _of_sequence(arg[3])
    if op is c.BRANCH:
        found: Query = frozenset()
        for branch in arg[1]:
            found = _either(found, _of_sequence(branch))
        return found
    if op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] > 0:
        return _of_sequence(arg[2])
    return ANY


def _of_sequence(elements) -> Query:
    query, strings = ANY, {""}
    for op, arg in elements:
        more = _exact(op, arg)
        if more is not None and len(strings) * len(more) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, more)}
            continue
        query = _both(query, _of_strings(strings))
        strings = {""} if more is None else more
        if more is None:
            query = _both(query, _inside(op, arg))
    return _both(query, _of_strings(strings))


def trigram_query(pattern: str) -> Query:
    """The sets of trigrams one of which a text with a match holds. ``ANY`` if nothing is mandatory."""
    query = _of_sequence(parser.parse(pattern))
    return ANY if frozenset() in query else query
