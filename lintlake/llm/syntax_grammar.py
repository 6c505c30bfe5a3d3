"""Permissible pairs of adjacent tokens, derived from grammars.

A grammar is text: `name = alternative | alternative` with token classes and rule names, `( )`, `?`, `*` and `+`. Of
every rule the first and last tokens and whether it may be empty are found as a fixed point; wherever two parts follow
each other in an alternative, every last token of the one may stand before every first token of the other.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"[()?*+|]|[^\s()?*+|]+")


def _parse(text: str) -> dict[str, tuple]:
    rules: dict[str, tuple] = {}
    name = None
    bodies: dict[str, str] = {}
    for line in text.strip().split("\n"):
        if not line.strip():
            continue
        head = re.match(r"\s*(\w+) = (.*)", line)
        if head:
            name = head[1]
            bodies[name] = bodies[name] + " | " + head[2] if name in bodies else head[2]
        else:
            bodies[name] += " " + line.strip()
    for name, body in bodies.items():
        tokens = _TOKEN.findall(body)
        node, at = _alternatives(tokens, 0)
        if at != len(tokens):
            raise ValueError(f"rule {name}: {tokens[at:]}")
        rules[name] = node
    return rules


def _alternatives(tokens: list[str], at: int) -> tuple[tuple, int]:
    options, sequence = [], []
    while at < len(tokens) and tokens[at] != ")":
        t = tokens[at]
        if t == "|":
            options.append(("seq", tuple(sequence)))
            sequence, at = [], at + 1
            continue
        if t == "(":
            node, at = _alternatives(tokens, at + 1)
        else:
            node = ("sym", t)
        at += 1
        while at < len(tokens) and tokens[at] in "?*+":
            node = (tokens[at], node)
            at += 1
        sequence.append(node)
    options.append(("seq", tuple(sequence)))
    return (options[0] if len(options) == 1 else ("or", tuple(options))), at


class Grammar:
    """First, last and adjacent tokens of the rules of a grammar."""

    def __init__(self, text: str):
        self.rules = _parse(text)
        self.known: dict[str, tuple[bool, frozenset, frozenset]] = {r: (False, frozenset(), frozenset()) for r in self.rules}
        self.pairs: set[tuple[str, str]] = set()
        while True:
            before = (dict(self.known), len(self.pairs))
            for r, node in self.rules.items():
                self.known[r] = self._look(node)
            if before == (self.known, len(self.pairs)):
                break

    def _look(self, node: tuple) -> tuple[bool, frozenset, frozenset]:
        kind = node[0]
        if kind == "sym":
            return self.known.get(node[1], (False, frozenset([node[1]]), frozenset([node[1]])))
        if kind == "or":
            parts = [self._look(n) for n in node[1]]
            return any(p[0] for p in parts), frozenset().union(*[p[1] for p in parts]), frozenset().union(*[p[2] for p in parts])
        if kind in "?*+":
            empty, first, last = self._look(node[1])
            if kind in "*+":
                self.pairs |= {(a, b) for a in last for b in first}
            return empty or kind in "?*", first, last
        empty, first, last = True, frozenset(), frozenset()
        for part in node[1]:
            e, f, t = self._look(part)
            self.pairs |= {(a, b) for a in last for b in f}
            first = first | f if empty else first
            last = last | t if e else t
            empty = empty and e
        return empty, first, last

    def first(self, rule: str) -> frozenset:
        return self.known[rule][1]

    def last(self, rule: str) -> frozenset:
        return self.known[rule][2]
