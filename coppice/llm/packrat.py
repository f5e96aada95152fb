"""Parsing expression grammars, compiled to memoising recognisers over tokens.

Notation: ``rule <- a b / c``; ``'text'`` matches a token by its text, ``KIND`` by its kind, a lower
case name is a rule; ``* + ? & ! ( )`` as usual; ``~nl`` holds where a line break precedes the token.
The first alternative that matches is taken. Rules that are named more than once and look at more than
a fixed number of tokens remember their result at every position, so a text is recognised in linear time. The furthest token at which a match failed is kept.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

_NOTE = re.compile(r"\s*(?:(#[^\n]*)|(<-)|'((?:[^'\\]|\\.)*)'|(~nl)|([A-Za-z_][A-Za-z_0-9]*)|([/*+?&!()]))")


class Tokens:
    """The tokens of a text: kinds, texts (of strings only a mark), offsets, line breaks before."""

    __slots__ = ("at", "kinds", "nl", "texts")

    def __init__(self):
        self.kinds: list[str] = []
        self.texts: list[str] = []
        self.at: list[int] = []
        self.nl: list[bool] = []

    def add(self, kind: str, text: str, at: int, nl: bool) -> None:
        self.kinds.append(kind)
        self.texts.append(text)
        self.at.append(at)
        self.nl.append(nl)


def _read(source: str) -> dict[str, tuple]:
    """The rules of a grammar as nested tuples."""
    notes, at = [], 0
    source = source.strip() + "\n"
    while at < len(source.rstrip()):
        m = _NOTE.match(source, at)
        if not m:
            raise ValueError(f"grammar: {source[at : at + 40]!r}")
        at = m.end()
        if m[1] is None:
            notes.append(("<-", "") if m[2] else ("lit", m[3].replace("\\'", "'")) if m[3] is not None else ("nl", "") if m[4] else ("id", m[5]) if m[5] else ("op", m[6]))
    rules: dict[str, tuple] = {}
    pos = 0

    def choice() -> tuple:
        nonlocal pos
        alts = [sequence()]
        while pos < len(notes) and notes[pos] == ("op", "/"):
            pos += 1
            alts.append(sequence())
        return alts[0] if len(alts) == 1 else ("alt", alts)

    def sequence() -> tuple:
        nonlocal pos
        parts = []
        while pos < len(notes):
            kind, text = notes[pos]
            if kind == "<-" or (kind, text) in (("op", "/"), ("op", ")")) or (kind == "id" and pos + 1 < len(notes) and notes[pos + 1][0] == "<-"):
                break
            if kind == "op" and text in "&!":
                pos += 1
                parts.append(("and" if text == "&" else "not", suffixed()))
            else:
                parts.append(suffixed())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def suffixed() -> tuple:
        nonlocal pos
        kind, text = notes[pos]
        pos += 1
        if (kind, text) == ("op", "("):
            node = choice()
            assert notes[pos] == ("op", ")"), "grammar: ) expected"
            pos += 1
        elif kind == "lit":
            node = ("lit", text)
        elif kind == "nl":
            node = ("nl",)
        else:
            node = ("kind", text) if text.isupper() else ("rule", text)
        while pos < len(notes) and notes[pos][0] == "op" and notes[pos][1] in "*+?":
            node = ({"*": "star", "+": "plus", "?": "opt"}[notes[pos][1]], node)
            pos += 1
        return node

    while pos < len(notes):
        name = notes[pos][1]
        pos += 2
        rules[name] = choice()
    return rules


class Grammar:
    """A compiled grammar; the first rule is the start."""

    def __init__(self, source: str):
        self.rules = _read(source)
        self.start = next(iter(self.rules))
        self.literals: set[str] = set()
        #: How often the grammar names each rule; what is named once is never tried twice from one caller,
        #: whose own results are remembered.
        self.uses = dict.fromkeys(self.rules, 0) | {self.start: 2}
        for node in self.rules.values():
            self._count(node)
        self.T: list[str] = []
        self.K: list[str] = []
        self.C: list[int] = []
        self.NL: list[bool] = []
        self.far = [0]
        self.by_kind: dict[str, tuple[dict[str, int], int]] = {}
        self.members: list[tuple[str, str | None]] = []
        self.memos: list[dict[int, int]] = []
        self._firsts()
        self.made: dict[str, Callable[[int], int]] = {}
        self.parse = self._rule(self.start)

    def _count(self, node: tuple) -> None:
        if node[0] == "lit":
            self.literals.add(node[1])
        elif node[0] == "rule":
            self.uses[node[1]] += 1
        for x in node[1:]:
            if isinstance(x, list):
                for y in x:
                    self._count(y)
            elif isinstance(x, tuple):
                self._count(x)

    def _firsts(self) -> None:
        """The tokens that each rule can start with, and whether it can be empty; to a fixed point."""
        self.first: dict[str, tuple[frozenset, bool]] = {r: (frozenset(), False) for r in self.rules}
        changed = True
        while changed:
            changed = False
            for r, node in self.rules.items():
                new = self._first(node)
                if new != self.first[r]:
                    self.first[r], changed = new, True

    def _first(self, node: tuple) -> tuple[frozenset, bool]:
        op = node[0]
        if op in ("lit", "kind"):
            return frozenset([node]), False
        if op == "rule":
            return self.first[node[1]]
        if op in ("and", "not", "nl"):
            return frozenset(), True
        if op in ("star", "opt"):
            return self._first(node[1])[0], True
        if op == "plus":
            return self._first(node[1])
        if op == "alt":
            parts = [self._first(x) for x in node[1]]
            return frozenset().union(*(f for f, _ in parts)), any(e for _, e in parts)
        got: frozenset = frozenset()
        for x in node[1]:
            f, empty = self._first(x)
            got |= f
            if not empty:
                return got, False
        return got, True

    def _add_kind(self, kind: str) -> None:
        """Number the classes of a kind's tokens: one for each text the grammar names, one for all others."""
        at = len(self.members)
        texts = {t: at + 1 + i for i, t in enumerate(sorted(self.literals))}
        self.members += [(kind, None), *((kind, t) for t in texts)]
        self.by_kind[kind] = (texts, at)

    def _starts(self, node: tuple, c: int) -> bool:
        firsts, empty = self._first(node)
        kind, text = self.members[c]
        return empty or ("kind", kind) in firsts or (text is not None and ("lit", text) in firsts)

    def _rule(self, name: str) -> Callable[[int], int]:
        if name in self.made:
            return self.made[name]
        if self.uses[name] == 1 or self._flat(self.rules[name]):
            self.made[name] = self._make(self.rules[name])
            return self.made[name]
        memo: dict[int, int] = {}
        self.memos.append(memo)
        body: list[Callable[[int], int]] = []

        def run(p: int) -> int:
            r = memo.get(p)
            if r is None:
                r = memo[p] = body[0](p)
            return r

        self.made[name] = run
        body.append(self._make(self.rules[name]))
        return run

    def _flat(self, node: tuple) -> bool:
        """Whether a rule looks at a fixed number of tokens only: to remember that costs more than to look."""
        parts = [y for x in node[1:] for y in (x if isinstance(x, list) else [x]) if isinstance(y, tuple)]
        return node[0] not in ("rule", "star", "plus") and all(self._flat(y) for y in parts)

    def _make(self, node: tuple) -> Callable[[int], int]:
        op, far = node[0], self.far
        if op == "lit":
            T, want = self.T, node[1]

            def lit(p: int) -> int:
                if T[p] == want:
                    return p + 1
                if p > far[0]:
                    far[0] = p
                return -1

            return lit
        if op == "kind":
            K, want = self.K, node[1]

            def kind(p: int) -> int:
                if K[p] == want:
                    return p + 1
                if p > far[0]:
                    far[0] = p
                return -1

            return kind
        if op == "rule":
            return self._rule(node[1])
        if op == "nl":
            NL = self.NL
            return lambda p: p if NL[p] else -1
        if op in ("and", "not"):
            f, wanted = self._make(node[1]), op == "and"

            def look(p: int) -> int:
                kept = far[0]
                ok = f(p) >= 0
                far[0] = kept
                return p if ok == wanted else -1

            return look
        C = self.C
        if op in ("star", "plus", "opt"):
            f, inner = self._make(node[1]), node[1]
            can: dict[int, bool] = {}
            starts = self._starts

            if op == "opt" and inner[0] in ("lit", "kind"):

                def token(p: int) -> int:
                    c = C[p]
                    ok = can.get(c)
                    if ok is None:
                        ok = can[c] = starts(inner, c)
                    if ok:
                        return p + 1
                    if p > far[0]:
                        far[0] = p
                    return p

                return token
            if op == "opt":

                def opt(p: int) -> int:
                    c = C[p]
                    ok = can.get(c)
                    if ok is None:
                        ok = can[c] = starts(inner, c)
                    if not ok:
                        if p > far[0]:
                            far[0] = p
                        return p
                    q = f(p)
                    return p if q < 0 else q

                return opt

            least = op == "plus"

            def star(p: int) -> int:
                begun = p
                while True:
                    c = C[p]
                    ok = can.get(c)
                    if ok is None:
                        ok = can[c] = starts(inner, c)
                    if not ok:
                        if p > far[0]:
                            far[0] = p
                        break
                    q = f(p)
                    if q <= p:
                        break
                    p = q
                return -1 if least and p == begun else p

            return star
        if op == "seq":
            fs = tuple(self._make(x) for x in node[1])
            if len(fs) == 2:
                f, g = fs

                def two(p: int) -> int:
                    p = f(p)
                    return -1 if p < 0 else g(p)

                return two
            if len(fs) == 3:
                f, g, h = fs

                def three(p: int) -> int:
                    p = f(p)
                    if p < 0:
                        return -1
                    p = g(p)
                    return -1 if p < 0 else h(p)

                return three

            def seq(p: int) -> int:
                for f in fs:
                    p = f(p)
                    if p < 0:
                        return -1
                return p

            return seq
        options = [(x, self._make(x)) for x in node[1]]
        table: dict[int, tuple | None] = {}
        starts = self._starts

        def alt(p: int) -> int:
            c = C[p]
            if c in table:
                fs = table[c]
            else:
                fit = [(x, f) for x, f in options if starts(x, c)]
                # a token that the first fitting alternative is made of decides at once
                fs = table[c] = None if fit and fit[0][0][0] in ("lit", "kind") else tuple(f for _, f in fit)
            if fs is None:
                return p + 1
            for f in fs:
                q = f(p)
                if q >= 0:
                    return q
            if not fs and p > far[0]:
                far[0] = p
            return -1

        return alt

    def recognise(self, tokens: Tokens) -> tuple[bool, int]:
        """Whether the whole input is of the grammar, and the furthest token at which it failed."""
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))
        self.K[:] = [*tokens.kinds, "EOF"]
        self.T[:] = [*tokens.texts, ""]
        self.NL[:] = [*tokens.nl, True]
        by_kind = self.by_kind
        for k in set(self.K).difference(by_kind):
            self._add_kind(k)
        C = [texts.get(t, other) for (texts, other), t in zip([by_kind[k] for k in self.K], self.T)]
        self.C[:] = C
        for m in self.memos:
            m.clear()
        self.far[0] = 0
        end = self.parse(0)
        return end == len(self.K), min(self.far[0], len(self.K) - 1)
