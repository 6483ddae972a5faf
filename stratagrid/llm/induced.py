"""Suffixes sorted by induction, with common-prefix values carried along, for shards larger than memory.

S*-suffixes (each the start of a rise) are ordered first: their substrings get names by rank, and the string of
names is sorted by the same means, recursively, with its common prefixes translated back. From them the order of
all other suffixes is induced: a suffix that has just come up in sorted order makes known its left neighbour,
which is put into a priority queue under its first character. Tuples (position, common prefix with the one
before it in its bucket) wait there until their bucket's turn; queues beyond the memory given go to disk, and so
do arrays over all positions. A neighbour's common prefix is one more than the least value that came up since
the last suffix with the same first character.

Names of a string with more than MOST_NAMES different ones are so near to being ranks that 1, 2, 4, ... of them
at once are compared instead of going down another level.

Orders and values are right up to `depth` characters: suffixes that agree so far count as equal.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np


MOST_NAMES, BLOCK = 1 << 12, 1 << 20


def array(n: int, kind, memory: int) -> np.ndarray:
    """Zeros; in a file that is gone when the array is, if there are more than so many."""
    if n <= memory:
        return np.zeros(n, dtype=kind)
    with tempfile.TemporaryFile() as file:
        file.truncate(n * np.dtype(kind).itemsize)
        return np.memmap(file, dtype=kind, mode="r+", shape=(n,))


class DiskQueue:
    """A priority queue of (position, value) tuples by character, first in first out within one. Arrays are
    kept in memory up to a number of tuples, then the longest buckets' go to a file."""

    def __init__(self, characters: int, memory: int) -> None:
        self.chunks: list[list] = [[] for _ in range(characters)]
        self.held, self.memory, self.file = np.zeros(characters, dtype=np.int64), memory, None

    def push(self, character: int, position: np.ndarray, value: np.ndarray) -> None:
        self.chunks[character].append((position, value))
        self.held[character] += len(position)
        if self.held.sum() > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for c in np.argsort(-self.held)[: max(1, len(self.held) // 8)].tolist():
            kept = [x for x in self.chunks[c] if isinstance(x[0], np.ndarray)]
            if not kept:
                continue
            position, value = (np.concatenate(x) for x in zip(*kept))
            at = self.file.seek(0, os.SEEK_END)
            self.file.write(position.tobytes() + value.tobytes())
            self.chunks[c] = [x for x in self.chunks[c] if not isinstance(x[0], np.ndarray)] + [(at, len(position))]
            self.held[c] = 0

    def _load(self, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(at)
        data = self.file.read(n * 6)
        return np.frombuffer(data, dtype=np.int32, count=n), np.frombuffer(data, dtype=np.int16, offset=4 * n)

    def pop(self, character: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of a character, in the order in which they came."""
        found = [x if isinstance(x[0], np.ndarray) else self._load(*x) for x in self.chunks[character]]
        self.chunks[character] = []
        self.held[character] = 0
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.int16)
        return tuple(np.concatenate(x) for x in zip(*found))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _refine(rank: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks (the number of smaller elements) within whole classes of equal rank, split further by key."""
    joint = (rank.astype(np.uint64) << np.uint64(32)) | key.astype(np.uint64)
    order = np.argsort(joint, kind="stable")
    joint = joint[order]
    new = np.flatnonzero(np.concatenate([[True], joint[1:] != joint[:-1]]))
    high = joint >> np.uint64(32)
    old = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]]))
    n = len(joint)
    first = np.repeat(new, np.diff(np.append(new, n)))
    start = np.repeat(old, np.diff(np.append(old, n)))
    out = np.empty(n, dtype=np.int64)
    out[order] = high.astype(np.int64) + first - start
    return out


def _unsettled(rank: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Those of among whose rank another shares."""
    r = rank[among]
    order = np.argsort(r, kind="stable")
    s = r[order]
    same = np.zeros(len(s), dtype=bool)
    if len(s) > 1:
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.zeros(len(s), dtype=bool)
    out[order] = same
    return among[out]


class Shard:
    """text: characters from 2 on, and 1 between the strings of the shard; its last character is 0, and no
    other is."""

    def __init__(self, text: np.ndarray, depth: int, memory: int = 1 << 24) -> None:
        self.text, self.depth, self.memory = text, depth, memory
        self.characters = int(text.max()) + 1
        n = len(text)
        #: The last position of the run of equal characters that each position is in, and whether the string
        #: rises after that.
        self.run_end, self.rising, self.marked = (array(n, k, memory) for k in (np.int32, bool, bool))
        following, up = n - 1, True
        for a in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
            b = min(a + BLOCK, n - 1)
            if a < b:
                step = np.diff(text[a : b + 1].astype(np.int32))
                at = np.where(step != 0, np.arange(a, b), n)
                at = np.minimum.accumulate(at[::-1])[::-1]
                open_ = at == n
                self.rising[a:b] = np.where(open_, up, step[np.where(open_, 0, at - a)] > 0)
                self.run_end[a:b] = np.where(open_, following, at)
            if b == n - 1 and a <= n - 1:
                self.run_end[n - 1], self.rising[n - 1] = n - 1, True
            if a < b:
                following, up = int(self.run_end[a]), bool(self.rising[a])

    def s_star(self) -> np.ndarray:
        return np.flatnonzero(self.rising[1:] & ~self.rising[:-1]) + 1

    def order_s_star(self) -> tuple[np.ndarray, np.ndarray]:
        """S*-suffixes in order, and the common prefix of each with the one before it: their substrings are named
        by rank, then names of 1, 2, 4, ... substrings at once."""
        star = self.s_star()
        m, text = len(star), self.text
        if not m:
            return star, np.zeros(0, np.int16)
        ends = np.append(star[1:], star[-1])

        def kind(at: np.ndarray) -> np.ndarray:
            return text[at].astype(np.int64) * 2 + self.rising[at]

        rank = _refine(np.zeros(m, dtype=np.int64), kind(star))
        active, offset = np.arange(m), 1
        while True:
            active = _unsettled(rank, active)
            active = active[star[active] + offset <= ends[active]]
            if not len(active) or offset > self.depth:
                break
            rank[active] = _refine(rank[active], kind(star[active] + offset))
            offset += 1
        names = np.unique(rank, return_inverse=True)[1].astype(np.int32)
        if names.max(initial=0) + 1 < min(m, MOST_NAMES):
            return self._by_recursion(star, names)
        levels = [self._kept(rank)]
        active, reach, covered = np.arange(m), 1, 2
        while covered < 2 * self.depth:
            active = _unsettled(rank, active)
            if not len(active):
                break
            following = active + reach
            key = np.where(following < m, rank[np.minimum(following, m - 1)] + 1, 0)
            rank[active] = _refine(rank[active], key)
            levels.append(self._kept(rank))
            reach, covered = reach * 2, covered * 2
        order = np.argsort(rank, kind="stable")
        return star[order], self._common(star, order, levels)

    def _by_recursion(self, star: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes of the string of names, and as many characters as their common names have. A name has
        two characters at least, so half the depth in names is enough."""
        m = len(star)
        below = array(m + 1, np.int32, self.memory)
        below[:m] = names + 1
        order, value = Shard(below, self.depth // 2 + 1, self.memory).sort()
        order, value = order[1:], value[1:].astype(np.int64)  # the first is the end mark
        a, b = order[:-1], order[1:]
        value = value[1:]
        last = np.append(star, len(self.text))
        shared = np.minimum(last[np.minimum(a + value, m)] - star[a], last[np.minimum(b + value, m)] - star[b])
        return star[order], self._longer(star[a], star[b], np.minimum(shared, self.depth))

    def _kept(self, rank: np.ndarray) -> np.ndarray:
        """A copy of the ranks for later, in a file if they are many."""
        out = array(len(rank), np.int32, self.memory)
        out[:] = rank
        return out

    def _common(self, star: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        m, depth = len(star), self.depth
        a, b = order[:-1].copy(), order[1:].copy()
        a0, b0 = star[a], star[b]
        for k in range(len(levels) - 1, -1, -1):
            inside = (a + (1 << k) < m) & (b + (1 << k) < m)
            same = inside & (levels[k][np.minimum(a, m - 1)] == levels[k][np.minimum(b, m - 1)]) & (star[a] - a0 < depth)
            a[same] += 1 << k
            b[same] += 1 << k
        return self._longer(a0, b0, np.minimum(star[a] - a0, depth))

    def _longer(self, x0: np.ndarray, y0: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Common prefixes of neighbours, of which so much is known, carried on character by character."""
        n, text, depth = len(self.text), self.text, self.depth
        value = value.copy()
        going = np.flatnonzero(value < depth)
        while len(going):
            x, y = x0[going] + value[going], y0[going] + value[going]
            inside = (x < n) & (y < n)
            going = going[inside & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])]
            value[going] += 1
            going = going[value[going] < depth]
        return np.append(0, value).astype(np.int16)

    def mark_repeats(self) -> np.ndarray:
        """Which suffixes agree with another for `depth` characters."""
        self._run(None)
        return self.marked

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in order, and the common prefix of each with the one before it."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        self._run(found)
        found.reverse()
        return tuple(np.concatenate(x) for x in zip(*found))

    def _run(self, found: list | None) -> None:
        stars, values = self.order_s_star()
        queue, done = DiskQueue(self.characters, self.memory), DiskQueue(self.characters, self.memory)
        try:
            self._pass(queue, stars, values, done, None)
            self._pass(queue, None, None, done, found)
        finally:
            queue.close()
            done.close()

    def _pass(self, queue: DiskQueue, stars, values, done: DiskQueue, found: list | None) -> None:
        """Falling suffixes upwards from the S*, then, with stars None, rising ones downwards from the falling."""
        text, depth, up = self.text, self.depth, stars is not None
        since = np.full(self.characters, depth, dtype=np.int16)
        begun = np.zeros(self.characters, dtype=bool)
        edges = np.searchsorted(text[stars], np.arange(self.characters + 1)) if up else None

        def come_up(position: np.ndarray, value: np.ndarray) -> None:
            """Put the left neighbours of suffixes that come up one after another into the queue."""
            nonlocal since
            at = position - 1
            chosen = np.flatnonzero((at >= 0) & (self.rising[at] != up))
            low = value.min()
            c = text[at[chosen]]
            by = np.argsort(c, kind="stable")
            chosen, c = chosen[by], c[by]
            ends = np.append(value, np.int16(depth))
            touched = np.unique(c)
            later = np.minimum(since, low)
            for k, i, j in zip(touched.tolist(), np.searchsorted(c, touched).tolist(), np.searchsorted(c, touched, side="right").tolist()):
                own = chosen[i:j]
                least = np.minimum.reduceat(ends, np.append(own + 1, 0) if own[-1] + 1 > len(value) else own + 1)
                first = min(since[k], value[: own[0] + 1].min()) if begun[k] else -1
                found = np.minimum(np.append(np.int16(first), least[: len(own) - 1]) + 1, depth).astype(np.int16)
                later[k] = least[len(own) - 1] if own[-1] + 1 < len(value) else depth
                begun[k] = True
                queue.push(k, at[own].astype(np.int32), found)
            since = later

        for c in range(self.characters) if up else range(self.characters - 1, -1, -1):
            parts = []
            while True:  # a neighbour with the same character joins this bucket's end
                position, value = queue.pop(c)
                if not len(position):
                    break
                parts.append((position, value))
                before = parts[-2][0][-1:] if len(parts) > 1 else position[:0]
                self._mark(before, position, value)
                come_up(position, value)
            if up:
                if parts:
                    done.push(c, *(np.concatenate(x) for x in zip(*parts)))
                position, value = stars[edges[c] : edges[c + 1]], values[edges[c] : edges[c + 1]].copy()
            else:
                position, value = done.pop(c)
                if found is not None:
                    self._gather(found, c, parts, position, value)
                # Downwards, a suffix's value is what it shares with the next one up.
                position, value = position[::-1], np.append(np.int16(0), value[:0:-1])
            if len(position):
                value = value.astype(np.int16)
                value[0] = self._border(parts[-1][0][-1], position[0]) if parts else 0
                if not up and value[0] >= depth:
                    self.marked[[parts[-1][0][-1], position[0]]] = True
                come_up(position, value)

    def _gather(self, found: list, c: int, parts: list, falling: np.ndarray, values: np.ndarray) -> None:
        """A bucket in order: falling suffixes, then the rising ones, which came up in the other direction."""
        if c == 0:
            found.append((np.array([len(self.text) - 1], dtype=np.int32), np.zeros(1, np.int16)))
            return
        rising, shared = (np.concatenate(x)[::-1] for x in zip(*parts)) if parts else (falling[:0], values[:0])
        position, value = np.concatenate([falling, rising]), np.concatenate([values, shared[-1:] * 0, shared[:-1]])
        if len(falling) and len(rising):
            value[len(falling)] = self._border(rising[0], falling[-1])
        found.append((position, value.astype(np.int16)))

    def _border(self, a: int, b: int) -> int:
        """What a rising and a falling suffix share: the shorter run of their first character."""
        return min(int(self.run_end[a] - a) + 1, int(self.run_end[b] - b) + 1, self.depth)

    def _mark(self, before: np.ndarray, position: np.ndarray, value: np.ndarray) -> None:
        deep = np.flatnonzero(value >= self.depth)
        if len(deep):
            line = np.concatenate([before, position])
            shift = len(line) - len(position)
            self.marked[position[deep]] = True
            self.marked[line[deep + shift - 1]] = True


def repeats(strings: list[bytes], depth: int, memory: int = 1 << 24) -> list[np.ndarray]:
    """For each string, which of its positions start a substring of `depth` bytes that also starts anywhere else
    in the strings."""
    if not strings:
        return []
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    text = array(int(lengths.sum()) + len(strings) + 1, np.int16, memory)
    text[:] = 1
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    for s, at in zip(strings, starts.tolist()):
        text[at : at + len(s)] = np.frombuffer(s, dtype=np.uint8).astype(np.int16) + 2
    text[-1] = 0
    marked = Shard(text, depth, memory).mark_repeats()
    return [marked[a : a + max(0, n - depth + 1)] for a, n in zip(starts.tolist(), lengths.tolist())]
