"""Boolean trigram queries that every match of a regular expression satisfies."""

from __future__ import annotations

import re
from itertools import product

_SRE = re._parser  # the standard library's own parse tree
#: An expression is kept as its full set of strings up to this many of them.
MAX_STRINGS = 64
REPEATS = {"MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"}

# A condition is a set of alternatives, each a set of trigrams that must all occur.
# ALWAYS, the alternative that needs nothing, makes a rule scan all texts.
Condition = frozenset[frozenset[str]]
ALWAYS: Condition = frozenset({frozenset()})


def _both(a: Condition, b: Condition) -> Condition:
    return _least(frozenset(x | y for x in a for y in b))


def _least(a: Condition) -> Condition:
    """Without alternatives that ask for more than another does."""
    return frozenset(x for x in a if not any(y < x for y in a))


def _of_strings(strings: set[str]) -> Condition:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _repeated(strings: set[str] | None, n: int) -> set[str] | None:
    """All ways to write n of some strings side by side, if they are not too many."""
    if strings is None or n > 8 or len(strings) ** n > MAX_STRINGS:
        return None
    return {"".join(x) for x in product(strings, repeat=n)}


def trigram_query(pattern: str) -> Condition:
    """The condition, over lower-cased text, that any text with a match of pattern meets."""

    def sequence(items) -> tuple[set[str] | None, Condition]:
        """(all strings it can be, or None; what must occur in it otherwise)."""
        needed, run, whole = ALWAYS, {""}, True
        for op, value in items:
            if str(op) in REPEATS and value[0] and value[1] > value[0] and (edge := _repeated(sequence(value[2])[0], value[0])):
                # What is repeated stands beside what comes before and beside what comes after.
                before = {a + b for a, b in product(run, edge)} if len(run) * len(edge) <= MAX_STRINGS else run
                needed, run, whole = _both(needed, _of_strings(before)), edge, False
                continue
            strings, inner = node(op, value)
            grown = None if strings is None or len(run) * len(strings) > MAX_STRINGS else {a + b for a, b in product(run, strings)}
            if grown is not None:
                run = grown
                continue
            needed, whole = _both(needed, _of_strings(run)), False
            if strings is None:
                needed, run = _both(needed, inner), {""}
            else:
                run = strings
        return (run, ALWAYS) if whole else (None, _both(needed, _of_strings(run)))

    def node(op, value) -> tuple[set[str] | None, Condition]:
        name = str(op)
        if name == "LITERAL":
            return {chr(value).lower()}, ALWAYS
        if name == "IN":
            if all(str(o) == "LITERAL" for o, _ in value):
                return {chr(v).lower() for _, v in value}, ALWAYS
            return None, ALWAYS
        if name == "SUBPATTERN":
            return sequence(value[3])
        if name == "BRANCH":
            found = [sequence(x) for x in value[1]]
            if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= MAX_STRINGS:
                return set().union(*(s for s, _ in found)), ALWAYS
            return None, _least(frozenset().union(*(c if s is None else _of_strings(s) for s, c in found)))
        if name in REPEATS:
            low, high, items = value
            strings, inner = sequence(items)
            if strings is not None and high == 1:
                return (strings if low else strings | {""}), ALWAYS
            if low == high and (all_of := _repeated(strings, low)):
                return all_of, ALWAYS
            return None, (inner if strings is None else _of_strings(strings)) if low else ALWAYS
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            return {""}, ALWAYS
        return None, ALWAYS

    strings, needed = sequence(_SRE.parse(pattern))
    return needed if strings is None else _of_strings(strings)
