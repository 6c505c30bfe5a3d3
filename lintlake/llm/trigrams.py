"""Required trigrams of a regular expression, as a formula over a trigram index.

A formula is True (nothing required), a three-letter string, or ("and" | "or", parts). It holds for every text the
expression can match, in lower case, so a text without it needs no look by the expression. Literals beyond ASCII, whose
case has many forms, require nothing.
"""

from __future__ import annotations

import re._constants as c
import re._parser as parser

import numpy as np

MAX_EXACT = 16
PER_LITERAL = 3


def _join(op: str, parts: list):
    """The parts under one operator, simplified."""
    if op == "or" and any(p is True for p in parts):
        return True
    flat = []
    for p in parts:
        if p is not True and p not in flat:
            flat.append(p)
    if not flat:
        return True
    return flat[0] if len(flat) == 1 else (op, tuple(flat))


def _grams(text: str):
    """At most `PER_LITERAL` trigrams of a literal, spread over it: each is required, and the rest would say little more."""
    n = len(text) - 2
    places = range(n) if n <= PER_LITERAL else sorted({round(k * (n - 1) / (PER_LITERAL - 1)) for k in range(PER_LITERAL)})
    return _join("and", [text[i : i + 3] for i in places])


def _any_of(texts):
    return _join("or", [_grams(t) for t in texts])


def _expand(node):
    """(exact strings the node stands for or None, formula) of one parsed node."""
    op, arg = node
    if op is c.LITERAL:
        return ({chr(arg).lower()}, True) if arg < 128 else (None, True)
    if op is c.IN:
        if any(o is c.LITERAL and a > 127 for o, a in arg):
            return None, True
        letters = {chr(a).lower() for o, a in arg if o is c.LITERAL}
        if len(arg) <= 8 and all(o is c.LITERAL for o, _ in arg):
            return letters, True
        return None, True
    if op is c.SUBPATTERN:
        return _sequence(arg[3])
    if op is c.ATOMIC_GROUP:
        return _sequence(arg)
    if op is c.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        exact = set().union(*[e for e, _ in parts if e is not None])
        if all(e is not None for e, _ in parts) and len(exact) <= MAX_EXACT:
            return exact, True
        return None, _join("or", [_any_of(e) if e is not None else f for e, f in parts])
    if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
        least, most, body = arg
        exact, formula = _sequence(body)
        if exact is not None and (least, most) == (0, 1):
            return exact | {""}, True
        if exact is not None and least == most == 1:
            return exact, True
        if least == 0:
            return None, True
        return None, _any_of(exact) if exact is not None else formula
    if op is c.ASSERT and arg[0] == 1:
        exact, formula = _sequence(arg[1])
        return None, _any_of(exact) if exact is not None else formula
    if op is c.AT or op in (c.ASSERT, c.ASSERT_NOT):
        return {""}, True
    return None, True


def _sequence(nodes):
    """As `_expand`, of nodes that follow each other."""
    run, parts, whole = {""}, [], True
    for node in nodes:
        exact, formula = _expand(node)
        if exact is not None and len(run) * len(exact) <= MAX_EXACT:
            run = {a + b for a in run for b in exact}
            continue
        parts.append(_any_of(run))
        if exact is not None:
            run = exact
        else:
            parts.append(formula)
            run = {""}
        whole = False
    if whole:
        return run, True
    parts.append(_any_of(run))
    return None, _join("and", parts)


def required(pattern: str, flags: int = 0):
    """The trigram formula of a pattern."""
    exact, formula = _sequence(parser.parse(pattern, flags))
    return _any_of(exact) if exact is not None else formula


def leaves(formula) -> set[str]:
    """All trigrams of a formula."""
    if formula is True:
        return set()
    if isinstance(formula, str):
        return {formula}
    return set().union(*[leaves(p) for p in formula[1]])


def holds(formula, held: dict[str, np.ndarray], n: int) -> np.ndarray:
    """The formula over n texts; `held` says of a trigram which texts have it, none where it is not listed."""
    if formula is True:
        return np.ones(n, bool)
    if isinstance(formula, str):
        return held[formula] if formula in held else np.zeros(n, bool)
    out = holds(formula[1][0], held, n)
    for part in formula[1][1:]:
        more = holds(part, held, n)
        out = out & more if formula[0] == "and" else out | more
    return out
