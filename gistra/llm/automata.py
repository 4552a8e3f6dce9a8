"""Regular expressions over bytes compiled to minimal deterministic automata.

Expressions are built with the functions below (no pattern syntax). ``compile_dfa`` numbers all rules'
positions together, builds the subsets of positions that are alive after each byte, and merges states that
no continuation tells apart.
"""

from __future__ import annotations

import numpy as np

Node = tuple


def cls(*chars: str | bytes) -> Node:
    """One byte of those given; ``a-z`` in a three-character argument is a range."""
    out: set[int] = set()
    for c in chars:
        b = c.encode() if isinstance(c, str) else c
        out |= set(range(b[0], b[2] + 1)) if len(b) == 3 and b[1:2] == b"-" else set(b)
    return ("cls", frozenset(out))


def seq(*nodes: Node) -> Node:
    return ("seq", nodes)


def alt(*nodes: Node) -> Node:
    return ("alt", nodes)


def opt(node: Node) -> Node:
    return alt(node, seq())


def star(node: Node) -> Node:
    return ("star", node)


def times(node: Node, n: int) -> Node:
    return seq(*[node] * n)


def text(s: str, any_case: bool = False) -> Node:
    return seq(*[cls(c.lower() + c.upper()) if any_case else cls(c) for c in s])


def reverse(node: Node) -> Node:
    kind, x = node
    if kind == "cls":
        return node
    if kind == "star":
        return star(reverse(x))
    return (kind, tuple(reverse(n) for n in (x[::-1] if kind == "seq" else x)))


class _Positions:
    """First, last and follow sets of an expression's byte positions."""

    def __init__(self):
        self.bytes: list[frozenset[int]] = []
        self.follow: list[set[int]] = []

    def add(self, node: Node) -> tuple[bool, set[int], set[int]]:
        """(can be empty, first positions, last positions)"""
        kind, x = node
        if kind == "cls":
            self.bytes.append(x)
            self.follow.append(set())
            p = {len(self.bytes) - 1}
            return False, p, p
        if kind == "star":
            _, first, last = self.add(x)
            for p in last:
                self.follow[p] |= first
            return True, first, last
        parts = [self.add(n) for n in x]
        if kind == "alt":
            return any(p[0] for p in parts), set().union(*(p[1] for p in parts)), set().union(*(p[2] for p in parts))
        empty, first, last = True, set(), set()
        for e, f, l in parts:
            for p in last:
                self.follow[p] |= f
            first, last, empty = first | f if empty else first, last | l if e else l, empty and e
        return empty, first, last


class Dfa:
    """table[state * 256 + byte] is the next state times 256; ``accepts[state]`` has the rules that match there.

    State 0 is the start; accepting states have the highest numbers, from ``accepting`` on (times 256).
    """

    def __init__(self, table: np.ndarray, accepts: list[tuple[int, ...]], dead: int):
        order = sorted(range(len(accepts)), key=lambda s: (s != 0, bool(accepts[s]), s))
        rank = np.argsort(order)
        self.table = (rank[table[order]] * 256).reshape(-1).tolist()
        self.accepts = [accepts[s] for s in order]
        self.accepting = 256 * next((i for i, a in enumerate(self.accepts) if a and i), len(order))
        self.dead = 256 * int(rank[dead]) if dead >= 0 else -1
        self.states = len(order)

    def longest(self, data, start: int, stop: int, step: int = 1) -> int | None:
        """How many bytes from ``start`` (towards ``stop``) the longest match takes."""
        s, best, n = 0, None, 0
        for i in range(start, stop, step):
            s = self.table[s + data[i]]
            if s == self.dead:
                break
            n += 1
            if s >= self.accepting:
                best = n
        return best


def compile_dfa(rules: list[Node], search: bool) -> Dfa:
    """One automaton for all rules; with ``search`` a match may begin at any byte."""
    pos, first, ends = _Positions(), set(), {}
    for k, rule in enumerate(rules):
        empty, f, last = pos.add(rule)
        if empty:
            raise ValueError("a rule that matches nothing at all can't be searched for")
        first |= f
        ends |= dict.fromkeys(last, k)
    # bytes that no position tells apart go the same way
    kinds = np.unique(np.array([[b in s for s in pos.bytes] for b in range(256)]), axis=0, return_inverse=True)[1].reshape(-1)
    shown = [int(np.flatnonzero(kinds == k)[0]) for k in range(kinds.max() + 1)]
    # a state: the positions that the byte just read was matched at; "start" is none read yet
    states, todo, rows = {None: 0}, [None], []
    while todo:
        state = todo.pop(0)
        ready = set(first) if state is None or search else set()
        for p in state or ():
            ready |= pos.follow[p]
        row = []
        for b in shown:
            new = frozenset(p for p in ready if b in pos.bytes[p])
            if search and not new:
                new = None  # nothing alive: as at the start
            if new not in states:
                states[new] = len(states)
                todo.append(new)
            row.append(states[new])
        rows.append(row)
    table = np.array(rows)[:, kinds]
    accepts = [tuple(sorted({ends[p] for p in s or () if p in ends})) for s in states]
    # minimisation: refine by what follows until no class splits
    names = sorted(set(accepts))
    part = np.array([names.index(a) for a in accepts])
    narrow = np.array(rows)
    while True:
        new = np.unique(np.column_stack([part, part[narrow]]), axis=0, return_inverse=True)[1].reshape(-1)
        if new.max() == part.max():
            break
        part = new
    _, chosen = np.unique(part, return_index=True)
    dead = next((i for i, s in enumerate(states) if s is not None and not s), -1)
    # renumber so that the start comes first
    renamed = np.argsort(np.argsort([-1 if p == part[0] else p for p in range(len(chosen))]))
    small = np.empty((len(chosen), 256), int)
    small[renamed] = renamed[part[table[chosen]]]
    kept = [()] * len(chosen)
    for p, c in enumerate(chosen):
        kept[renamed[p]] = accepts[c]
    return Dfa(small, kept, int(renamed[part[dead]]) if dead >= 0 else -1)
