"""Several grammars as one deterministic automaton.

Patterns of a small regular language (characters, [classes], groups, |, ?, *, +, {m,}, {m,n}, \\w \\d \\s) are joined in one
nondeterministic automaton; its subset construction is done as texts ask for it and kept, so a character costs one
look-up. A match is the longest; at the same end the grammar named first wins.
"""

from __future__ import annotations

_SETS = {"w": frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"), "d": frozenset("0123456789"), "s": frozenset(" \t\n\r\x0b\x0c")}


class _Parser:
    """Pattern -> fragments of (state, what it reads, next state); what is (negated, characters) or None for nothing."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[tuple[bool, frozenset] | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        self.text, self.at = pattern, 0
        out = self.choice()
        if self.at != len(pattern):
            raise ValueError(f"unreadable pattern at {self.at}")
        return out

    def choice(self) -> tuple[int, int]:
        a, b = self.state(), self.state()
        while True:
            x, y = self.sequence()
            self.edges[a].append((None, x))
            self.edges[y].append((None, b))
            if self.at < len(self.text) and self.text[self.at] == "|":
                self.at += 1
                continue
            return a, b

    def sequence(self) -> tuple[int, int]:
        first = last = self.state()
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            begin = self.at
            a, b = self.atom()
            low, high = self.count()
            behind = self.at
            # each repetition is read anew from the pattern
            copies = [(a, b)]
            for _ in range(max(low, high or 1) - 1):
                self.at = begin
                copies.append(self.atom())
            self.at = behind
            for k, (x, y) in enumerate(copies):
                self.edges[last].append((None, x))
                if k >= low:
                    self.edges[last].append((None, y))
                last = y
            if high is None:  # the last copy may repeat
                self.edges[copies[-1][1]].append((None, copies[-1][0]))
        return first, last

    def count(self) -> tuple[int, int | None]:
        c = self.text[self.at : self.at + 1]
        if c and c in "?*+":
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c == "{":
            end = self.text.index("}", self.at)
            low, comma, high = self.text[self.at + 1 : end].partition(",")
            self.at = end + 1
            return int(low), (int(high) if high else None) if comma else int(low)
        return 1, 1

    def atom(self) -> tuple[int, int]:
        c = self.text[self.at]
        self.at += 1
        if c == "(":
            out = self.choice()
            if self.text[self.at : self.at + 1] != ")":
                raise ValueError("open group")
            self.at += 1
            return out
        a, b = self.state(), self.state()
        self.edges[a].append((self.charset(c), b))
        return a, b

    def charset(self, c: str) -> tuple[bool, frozenset]:
        if c == "\\":
            self.at += 1
            name = self.text[self.at - 1]
            return False, _SETS.get(name, frozenset("\n" if name == "n" else name))
        if c != "[":
            return False, frozenset(c)
        negated = self.text[self.at] == "^"
        self.at += negated
        chars: set[str] = set()
        while self.text[self.at] != "]":
            c = self.text[self.at]
            self.at += 1
            if c == "\\":
                chars |= self.charset("\\")[1]
            elif self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                chars |= {chr(x) for x in range(ord(c), ord(self.text[self.at + 1]) + 1)}
                self.at += 2
            else:
                chars.add(c)
        self.at += 1
        return negated, frozenset(chars)


class Automaton:
    """One automaton over named patterns; run from a place, it gives the end and the name of the longest match."""

    def __init__(self, patterns: dict[str, str]):
        parser = _Parser()
        start = parser.state()
        self.names: dict[int, int] = {}
        self.order = list(patterns)
        for k, pattern in enumerate(patterns.values()):
            a, b = parser.add(pattern)
            parser.edges[start].append((None, a))
            self.names[b] = k
        self.edges = parser.edges
        self.sets: list[frozenset[int]] = []
        self.ids: dict[frozenset[int], int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[str | None] = []
        self.start = self._id(frozenset([start]))

    def _id(self, states: frozenset[int]) -> int:
        closed, todo = set(states), list(states)
        while todo:
            for reads, to in self.edges[todo.pop()]:
                if reads is None and to not in closed:
                    closed.add(to)
                    todo.append(to)
        key = frozenset(closed)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            first = min((self.names[s] for s in key if s in self.names), default=None)
            self.accepts.append(None if first is None else self.order[first])
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        to = self._id(frozenset(t for s in self.sets[state] for reads, t in self.edges[s] if reads is not None and (c in reads[1]) != reads[0]))
        if len(self.moves[state]) < 4096:  # other scripts' characters are not all kept
            self.moves[state][c] = to
        return to

    def match(self, text: str, at: int) -> tuple[int, str] | None:
        """(end, name) of the longest match that starts at a place."""
        state, best = self.start, None
        while True:
            if self.accepts[state] is not None:
                best = (at, self.accepts[state])
            if at == len(text):
                return best
            c = text[at]
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if not self.sets[state]:
                return best
            at += 1
