"""Regular expressions to transition arrays: subset construction and minimisation, over bytes.

The expressions know literals, escapes (``\\x20``), classes, ``.``-free groups, ``|``, ``?``, ``*``, ``+`` and ``{n}``.
"""

from __future__ import annotations

import numpy as np

ANY = frozenset(range(256))


class _Builder:
    """Pieces of a nondeterministic automaton: ``empty[s]`` are moves without a byte, ``by[s]`` the one with a set of bytes."""

    def __init__(self) -> None:
        self.empty: list[set[int]] = []
        self.by: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append(set())
        self.by.append(None)
        return len(self.by) - 1

    def build(self, tree: tuple, start: int) -> int:
        """The state in which ``tree`` ends when it begins in ``start``."""
        kind, *of = tree
        if kind == "set":
            self.by[start] = (of[0], end := self.state())
            return end
        if kind == "cat":
            for part in of[0]:
                self.empty[start].add(inner := self.state())
                start = self.build(part, inner)
            return start
        end = self.state()
        if kind == "or":
            for part in of[0]:
                self.empty[start].add(inner := self.state())
                self.empty[self.build(part, inner)].add(end)
            return end
        self.empty[start].add(inner := self.state())  # "?", "*" or "+"
        last = self.build(of[0], inner)
        self.empty[last].add(end)
        if kind in "*+":
            self.empty[last].add(inner)
        if kind in "?*":
            self.empty[start].add(end)
        return end


def parse(pattern: str) -> tuple:
    """The tree of an expression."""
    at = 0

    def byte() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def one() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            inner = either()
            at += 1
            return inner
        if pattern[at] == "[":
            at += 1
            negated = pattern[at] == "^"
            at += negated
            found: set[int] = set()
            while pattern[at] != "]":
                low = high = byte()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    high = byte()
                found.update(range(low, high + 1))
            at += 1
            return ("set", ANY - found if negated else frozenset(found))
        return ("set", frozenset([byte()]))

    def sequence() -> tuple:
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            part = one()
            while at < len(pattern) and pattern[at] in "?*+{":
                if pattern[at] == "{":
                    end = pattern.index("}", at)
                    part = ("cat", [part] * int(pattern[at + 1 : end]))
                    at = end + 1
                else:
                    part = (pattern[at], part)
                    at += 1
            parts.append(part)
        return ("cat", parts)

    def either() -> tuple:
        nonlocal at
        options = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("or", options)

    return either()


def fold_case(tree: tuple) -> tuple:
    """Letters stand for both cases."""
    kind, *of = tree
    if kind == "set":
        return ("set", frozenset(y for x in of[0] for y in ({x, x ^ 32} if 65 <= x & ~32 <= 90 else {x})))
    return (kind, [fold_case(x) for x in of[0]] if kind in ("cat", "or") else fold_case(of[0]))


def backwards(tree: tuple) -> tuple:
    """The same words read from their end."""
    kind, *of = tree
    if kind == "set":
        return tree
    if kind == "cat":
        return ("cat", [backwards(x) for x in reversed(of[0])])
    return (kind, [backwards(x) for x in of[0]] if kind == "or" else backwards(of[0]))


def compile_trees(trees: list[tuple], anywhere: bool) -> tuple[np.ndarray, list[frozenset[int]]]:
    """A minimal deterministic automaton: ``moves[state, byte]`` and the trees that end in each state.

    State 0 is the start.  With ``anywhere`` a match may begin at any byte; else state -1 stands for no match any more.
    """
    nfa = _Builder()
    start = nfa.state()
    ends = {}
    for k, tree in enumerate(trees):
        nfa.empty[start].add(inner := nfa.state())
        ends[nfa.build(tree, inner)] = k

    def closed(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if nfa.by[x] or x in ends)

    first = closed({start})
    number, rows, todo = {first: 0}, [], [first]
    for states in todo:  # grows while it is read
        targets: dict[int, set[int]] = {b: set() for b in range(256)}
        for s in states:
            if nfa.by[s]:
                for b in nfa.by[s][0]:
                    targets[b].add(nfa.by[s][1])
        row, cache = np.full(256, -1), {}
        for b, to in targets.items():
            if to or anywhere:
                key = frozenset(to)
                if key not in cache:
                    cache[key] = closed(to | ({start} if anywhere else set()))
                    if cache[key] not in number:
                        number[cache[key]] = len(number)
                        todo.append(cache[key])
                row[b] = number[cache[key]]
        rows.append(row)
    moves = np.array(rows)
    accepts = [frozenset(ends[s] for s in states if s in ends) for states in todo]
    # minimisation: split classes of states until bytes no longer tell members apart
    kinds = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
    group = np.array([kinds[a] for a in accepts])
    while True:
        after = np.where(moves < 0, -1, group[moves])
        fresh = np.unique(np.column_stack([group, after]), axis=0, return_inverse=True)[1].ravel()
        if fresh.max() == group.max():
            break
        group = fresh
    order = [int(group[0]), *(g for g in range(group.max() + 1) if g != group[0])]
    renumber = {g: i for i, g in enumerate(order)}
    some = [int(np.flatnonzero(group == g)[0]) for g in order]
    new = np.vectorize(renumber.get)(group)
    return np.where(moves[some] < 0, -1, new[moves[some]]), [accepts[s] for s in some]
