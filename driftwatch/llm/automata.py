"""Byte automata of small regular expressions: parsed, determinised by subset construction, minimised, and kept as transition arrays.

An expression has ASCII literals, classes, groups, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}`` and the escapes of
punctuation and of ``\\xHH``. A negated class stands for any other byte, so also for those of longer code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ANY = frozenset(range(256))


class _Parser:
    """An expression to nested tuples: ``("set", bytes)``, ``("cat", parts)``, ``("alt", parts)``, ``("rep", part, least, most)``."""

    def __init__(self, pattern: str, fold: bool):
        self.text, self.at, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise ValueError(f"the expression {self.text!r} ends too early")
        self.at += 1
        return self.text[self.at - 1]

    def whole(self):
        found = self.either()
        if self.at < len(self.text):
            raise ValueError(f"{self.text!r} has a {self.peek()!r} that nothing opens")
        return found

    def either(self):
        parts = [self.row()]
        while self.peek() == "|":
            self.take()
            parts.append(self.row())
        return ("alt", parts) if len(parts) > 1 else parts[0]

    def row(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.one()))
        return ("cat", parts)

    def one(self):
        c = self.take()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            inner = self.either()
            if self.take() != ")":
                raise ValueError(f"a group of {self.text!r} isn't closed")
            return inner
        if c == "[":
            return ("set", self.either_case(self.members()))
        if c in "*+?{.^$":
            raise ValueError(f"{c!r} isn't expected in {self.text!r}")
        return ("set", self.either_case({self.code(c)}))

    def code(self, c: str) -> int:
        if c != "\\":
            if ord(c) > 127:
                raise ValueError(f"{c!r} isn't ASCII")
            return ord(c)
        c = self.take()
        if c == "x":
            return int(self.take() + self.take(), 16)
        if c.isalnum():
            raise ValueError(f"the escape \\{c} isn't known")
        return ord(c)

    def members(self) -> set[int]:
        out: set[int] = set()
        negated = self.peek() == "^"
        self.at += negated
        while (c := self.take()) != "]":
            low = high = self.code(c)
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                high = self.code(self.take())
            out |= {*range(low, high + 1)}
        return ANY - out if negated else out

    def either_case(self, codes: set[int] | frozenset[int]) -> frozenset[int]:
        letters = {x for x in codes if chr(x).isalpha() and x < 128} if self.fold else set()
        return frozenset(codes | {x ^ 32 for x in letters})

    def repeated(self, part):
        while (c := self.peek()) and c in "*+?{":
            self.take()
            if c == "{":
                end = self.text.index("}", self.at)
                least, _, most = self.text[self.at : end].partition(",")
                most = most if "," in self.text[self.at : end] else least
                self.at = end + 1
                part = ("rep", part, int(least), int(most) if most else None)
            else:
                part = ("rep", part, int(c == "+"), 1 if c == "?" else None)
        return part


def parse(pattern: str, fold: bool = False):
    """The tree of an expression; letters stand for either case where ``fold``."""
    return _Parser(pattern, fold).whole()


def backward(tree):
    """The tree of the reversed words."""
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return ("rep", backward(tree[1]), *tree[2:])
    parts = [backward(x) for x in tree[1]]
    return (tree[0], parts[::-1] if tree[0] == "cat" else parts)


class _Nfa:
    """States with moves by byte sets and free moves."""

    def __init__(self):
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append(None)
        self.free.append([])
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """Adds a tree behind ``start``; the state in which its words end."""
        kind = tree[0]
        if kind == "set":
            end, at = self.state(), self.state()
            self.free[start].append(at)
            self.moves[at] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        end = self.state()
        if kind == "alt":
            for part in tree[1]:
                self.free[self.add(part, start)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end)
            return end
        for _ in range(most - least):
            self.free[start].append(end)
            start = self.add(part, start)
        self.free[start].append(end)
        return end

    def closed(self, states: set[int]) -> frozenset[int]:
        out, todo = set(states), [*states]
        while todo:
            for x in self.free[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(out)


@dataclass(frozen=True)
class Automaton:
    """A minimal deterministic automaton: ``delta[state, classes[byte]]`` is the next state.

    ``accepts[state]`` has bit r set where a word of expression r ends; accepting states come last, from ``first_accept`` on.
    ``dead`` is the state from which nothing is accepted, or -1; ``breaks[byte]`` says that a byte leads every state to ``start``.
    """

    delta: np.ndarray
    classes: np.ndarray
    accepts: np.ndarray
    start: int
    first_accept: int
    dead: int
    breaks: np.ndarray


def compiled(trees: list, anywhere: bool) -> Automaton:
    """One automaton for all trees, whose words may begin ``anywhere`` or at the start only."""
    nfa = _Nfa()
    start = nfa.state()
    ends = {}
    for i, tree in enumerate(trees):
        ends[nfa.add(tree, start)] = 1 << i
    sets = sorted({m[0] for m in nfa.moves if m}, key=sorted)
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
    example = [int(np.flatnonzero(classes == k)[0]) for k in range(len(kinds))]
    first = nfa.closed({start})
    number, order, rows = {first: 0}, [first], []
    for states in order:  # it grows while new sets of states are found
        moves = [nfa.moves[x] for x in states if nfa.moves[x]]
        row = []
        for byte in example:
            after = nfa.closed({to for codes, to in moves if byte in codes} | ({start} if anywhere else set()))
            if after not in number:
                number[after] = len(order)
                order.append(after)
            row.append(number[after])
        rows.append(row)
    delta = np.array(rows, np.int32)
    accepts = np.array([sum(bit for end, bit in ends.items() if end in states) for states in order], np.int64)
    block = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:  # states stay together as long as all their moves lead to the same blocks
        found = np.unique(np.column_stack([block, block[delta]]), axis=0, return_inverse=True)[1].ravel()
        if found.max() == block.max():
            break
        block = found
    one = np.array([np.flatnonzero(block == b)[0] for b in range(block.max() + 1)])
    rank = np.empty(len(one), np.int64)
    rank[np.argsort(accepts[one] != 0, kind="stable")] = np.arange(len(one))
    least = np.empty((len(one), delta.shape[1]), np.int32)
    least[rank] = rank[block[delta[one]]]
    took = np.zeros(len(one), np.int64)
    took[rank] = accepts[one]
    begin = int(rank[block[0]])
    stuck = np.flatnonzero((took == 0) & (least == np.arange(len(one))[:, None]).all(1))
    return Automaton(least, classes, took, begin, int((took == 0).sum()), int(stuck[0]) if len(stuck) else -1, (least == begin).all(0)[classes])
