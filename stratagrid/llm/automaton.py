"""Regular expressions over bytes, compiled by subset construction and minimised into transition arrays.

The syntax is what rules need: literals, escapes (\\xHH, \\ before a symbol), classes with ranges and ^, groups,
|, ?, *, + and counts {m}, {m,}, {m,n}.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ALL = frozenset(range(256))


def _parse(pattern: str, any_case: bool):
    """A tree of ("set", bytes), ("cat", parts), ("alt", parts), ("repeat", part, low, high or None)."""
    at = 0

    def cased(found: frozenset[int]) -> frozenset[int]:
        if not any_case:
            return found
        return found | {b ^ 32 for b in found if 65 <= b <= 90 or 97 <= b <= 122}

    def one() -> int:
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
        if c.isalnum():
            raise ValueError(f"\\{c} is not understood in {pattern!r}")
        return ord(c)

    def klass() -> frozenset[int]:
        nonlocal at
        negated = pattern[at] == "^"
        at += negated
        found: set[int] = set()
        while pattern[at] != "]":
            low = one()
            high = low
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                high = one()
            found |= set(range(low, high + 1))
        at += 1
        return _ALL - cased(frozenset(found)) if negated else cased(frozenset(found))

    def atom():
        nonlocal at
        if pattern[at] == "(":
            at += 3 if pattern.startswith("(?:", at) else 1
            inner = union()
            at += 1
            return inner
        if pattern[at] == "[":
            at += 1
            return ("set", klass())
        return ("set", cased(frozenset({one()})))

    def counted():
        nonlocal at
        part = atom()
        while at < len(pattern) and pattern[at] in "?*+{":
            c = pattern[at]
            at += 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, None)}[c]
            if c == "{":
                end = pattern.index("}", at)
                first, comma, last = pattern[at:end].partition(",")
                low, high = int(first), int(first) if not comma else int(last) if last else None
                at = end + 1
            part = ("repeat", part, low, high)
        return part

    def sequence():
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(counted())
        return ("cat", parts)

    def union():
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return ("alt", parts) if len(parts) > 1 else parts[0]

    tree = union()
    if at != len(pattern):
        raise ValueError(f"unbalanced: {pattern!r}")
    return tree


def _reversed(tree):
    kind = tree[0]
    if kind == "cat":
        return ("cat", [_reversed(x) for x in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [_reversed(x) for x in tree[1]])
    if kind == "repeat":
        return ("repeat", _reversed(tree[1]), *tree[2:])
    return tree


class _Graph:
    """States with edges on byte sets and empty edges."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree, start: int) -> int:
        """Build tree from start; the state in which it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.edges[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                into = self.state()
                self.empty[start].append(into)
                self.empty[self.add(part, into)].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self.add(part, start)
            self.empty[start].append(end)
        return end

    def closed(self, states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """table[state, column[byte]] is the next state and accept[state] a bit for each pattern that ends there;
    state 0 is the start. Where dead is not negative, that state can't be left."""

    table: np.ndarray
    column: np.ndarray
    accept: np.ndarray
    dead: int

    def rows(self) -> list[list]:
        """The transition arrays as lists that lead to one another: row[byte] is the next row, row[256] its
        accept bits. The dead row is replaced by None."""
        rows: list[list] = [[] for _ in self.table]
        for k, row in enumerate(rows):
            row.extend(None if x == self.dead else rows[x] for x in self.table[k][self.column].tolist())
            row.append(int(self.accept[k]))
        return rows


def compile_patterns(patterns: list[tuple[str, bool]], anywhere: bool = False, backward: bool = False) -> Automaton:
    """patterns: (pattern, any case). anywhere: matches may begin at each byte, not only at the first.
    backward: the automaton reads matches from their end to their start."""
    graph = _Graph()
    start, ends = graph.state(), {}
    for k, (pattern, any_case) in enumerate(patterns):
        tree = _parse(pattern, any_case)
        into = graph.state()
        graph.empty[start].append(into)
        ends[graph.add(_reversed(tree) if backward else tree, into)] = 1 << k
    # Bytes that no edge tells apart share a column.
    seen: dict[tuple, int] = {}
    sets = list({s for edges in graph.edges for s, _ in edges})
    column = np.array([seen.setdefault(tuple(b in s for s in sets), len(seen)) for b in range(256)])
    members = [int(np.flatnonzero(column == c)[0]) for c in range(len(seen))]
    first = graph.closed({start})
    number, order, table = {first: 0}, [first], []
    for states in order:
        row = []
        for b in members:
            into = {to for x in states for s, to in graph.edges[x] if b in s}
            following = graph.closed(into | {start} if anywhere else into)
            if following not in number:
                number[following] = len(order)
                order.append(following)
            row.append(number[following])
        table.append(row)
    table_ = np.array(table)
    accept = np.array([sum(ends.get(x, 0) for x in states) for states in order], dtype=np.int64)
    # Minimisation: states stay together while they accept alike and lead to states that are together.
    _, group = np.unique(accept, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([group, group[table_]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == group.max():
            break
        group = finer
    _, heads = np.unique(group, return_index=True)
    rank = np.argsort(np.argsort(heads))  # the start's group comes first
    small = rank[group[table_[heads]]][np.argsort(heads)]
    kept = accept[heads][np.argsort(heads)]
    stuck = [k for k in range(len(small)) if kept[k] == 0 and (small[k] == k).all()]
    return Automaton(small.astype(np.uint16 if len(small) < 1 << 16 else np.int32), column, kept, stuck[0] if stuck else -1)
