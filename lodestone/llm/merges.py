"""Byte-pair merging of many words at once, and a memory of words; what the encoders of whole vocabularies share.

Words lie end to end in one array of symbols.  In each round every word that still can joins its first pair
of lowest rank, all words at once in numpy; words of more than ``LONG`` symbols are merged by a heap instead,
whose work is n log n in a word's length.  Results are those of merging one pair after the other.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np

NEVER = (1 << 31) - 1
LONG = 64


def offsets(sizes: np.ndarray) -> np.ndarray:
    """Where each of consecutive runs of ``sizes`` begins, and where the last ends."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def gather(at: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``rows`` of ``values``, whose offsets are ``at``, end to end, and their sizes."""
    begin = at[rows]
    sizes = at[rows + 1] - begin
    end = np.cumsum(sizes)
    return values[np.repeat(begin - (end - sizes), sizes) + np.arange(end[-1] if len(end) else 0)], sizes


def group_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each of consecutive runs of ``values``; empty runs have 0."""
    total = offsets(values)
    ends = offsets(sizes)
    return total[ends[1:]] - total[ends[:-1]]


class Merges:
    """Pairs of symbols that join: (left, right) -> (rank, joined); of equal ranks the pair further left goes first."""

    def __init__(self, left: Iterable[int], right: Iterable[int], rank: Iterable[int], joined: Iterable[int]) -> None:
        a, b = np.array(list(left), dtype=np.int64), np.array(list(right), dtype=np.int64)
        keys = (a << 32) | b
        _, first = np.unique(keys, return_index=True)
        self.keys, self.rank, self.joined = keys[first], np.array(list(rank), dtype=np.int64)[first], np.array(list(joined), dtype=np.int64)[first]
        # open addressing: the pairs of a slot's chain stand in the slots that follow it
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.slots = np.full((1 << self.bits) + 64, -1, dtype=np.int32)
        left_over = np.arange(len(self.keys))
        at = self._slot(self.keys)
        while len(left_over):
            free = self.slots[at] < 0
            self.slots[at[free]] = left_over[free]
            lost = self.slots[at] != left_over
            left_over, at = left_over[lost], at[lost] + 1
            if len(at) and at.max() >= len(self.slots):
                raise ValueError("too many pairs share a slot")
        self._dict: dict[tuple[int, int], tuple[int, int]] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, joined) of each pair; rank is NEVER where nothing joins."""
        rank, joined = np.full(len(a), NEVER, dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        keys = (a << 32) | b
        todo, at = np.arange(len(a)), self._slot(keys)
        while len(todo):
            k = self.slots[at]
            some = k >= 0
            todo, at, k = todo[some], at[some], k[some]
            hit = self.keys[k] == keys[todo]
            rank[todo[hit]], joined[todo[hit]] = self.rank[k[hit]], self.joined[k[hit]]
            todo, at = todo[~hit], at[~hit] + 1
        return rank, joined

    def merge(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words of ``sizes`` after merging, and the words' new sizes."""
        long_ = sizes > LONG
        if not long_.any():
            return self._rounds(ids, sizes)
        new, at = np.empty_like(sizes), offsets(sizes)
        found: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(sizes)
        for k in np.flatnonzero(long_).tolist():
            found[k] = np.array(self._heap(ids[at[k] : at[k + 1]].tolist()), dtype=np.int64)
        short = np.flatnonzero(~long_)
        part, part_sizes = self._rounds(gather(at, ids, short)[0], sizes[short])
        part_at = offsets(part_sizes)
        for j, k in enumerate(short.tolist()):
            found[k] = part[part_at[j] : part_at[j + 1]]
        new = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.concatenate(found), new

    def _rounds(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, word = ids.astype(np.int64), np.flatnonzero(sizes)
        left = sizes[word].copy()
        rank, joined = np.full(len(ids), NEVER, dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        at = offsets(left)
        inner = np.ones(len(ids), dtype=bool)
        inner[at[1:] - 1] = False
        inner = np.flatnonzero(inner)
        rank[inner], joined[inner] = self.look(ids[inner], ids[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            at = offsets(left)
            best = np.minimum.reduceat((rank << 32) | np.arange(len(ids)), at[:-1])
            live = (best >> 32) < NEVER
            if not live.all():
                rest = np.repeat(live, left)
                done.append((word[~live], left[~live], ids[~rest]))
                gone = np.cumsum(np.where(live, 0, left))[live]
                ids, rank, joined, word, left = ids[rest], rank[rest], joined[rest], word[live], left[live]
                best = (best[live] & 0xFFFFFFFF) - gone
            else:
                best = best & 0xFFFFFFFF
            if not len(word):
                break
            ids[best] = joined[best]
            keep = np.ones(len(ids), dtype=bool)
            keep[best + 1] = False
            ids, rank, joined = ids[keep], rank[keep], joined[keep]
            best -= np.arange(len(best))
            left = left - 1
            end = np.cumsum(left)
            last, first = best + 1 == end, best == end - left
            rank[best[last]] = NEVER
            i = np.concatenate([best[~last], best[~first] - 1])
            rank[i], joined[i] = self.look(ids[i], ids[i + 1])
        if not done:
            return ids, sizes.copy()
        word, part = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(word)
        new = np.zeros(len(sizes), dtype=np.int64)
        new[word] = part
        return gather(offsets(part), np.concatenate([d[2] for d in done]), order)[0], new

    def _heap(self, ids: list[int]) -> list[int]:
        if not self._dict:
            self._dict = {(k >> 32, k & 0xFFFFFFFF): (r, j) for k, r, j in zip(self.keys.tolist(), self.rank.tolist(), self.joined.tolist(), strict=True)}
        pairs, n = self._dict, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = pairs[a, b][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := pairs.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := pairs.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]


class Memory:
    """What words encode to, as runs of flat arrays; the first ``most`` words of at most ``longest`` letters are remembered.

    encode: from words to (sizes, values) for each of the arrays, in their order.
    """

    def __init__(self, encode: Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]], most: int = 150_000, longest: int = 40) -> None:
        self.encode, self.most, self.longest = encode, most, longest
        self.index: dict[str, int] = {}
        self.at: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.passing: list[str] = []

    def rows(self, words: list[str]) -> np.ndarray:
        """The run of each of ``words``; valid until the next call."""
        self._forget()
        index = self.index
        try:
            return np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
        except KeyError:
            pass
        new = [w for w in dict.fromkeys(words) if w not in index]
        short = [w for w in new if len(w) <= self.longest][: max(0, self.most - len(index))]
        if len(short) < len(new):
            kept = set(short)
            self.passing = [w for w in new if w not in kept]
            new = short + self.passing
        index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
        for k, (sizes, values) in enumerate(self.encode(new)):
            if k == len(self.at):
                self.at.append(np.zeros(1, dtype=np.int64))
                self.values.append(values[:0])
            self.at[k] = np.concatenate([self.at[k], self.at[k][-1] + np.cumsum(sizes, dtype=np.int64)])
            self.values[k] = np.concatenate([self.values[k], values])
        return np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))

    def _forget(self) -> None:
        if self.passing:
            for w in self.passing:
                del self.index[w]
            n = len(self.index)
            self.at = [a[: n + 1].copy() for a in self.at]
            self.values = [v[: a[-1]].copy() for a, v in zip(self.at, self.values, strict=True)]
            self.passing = []

    def runs(self, k: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Array k's runs of ``rows`` end to end, and their sizes."""
        return gather(self.at[k], self.values[k], rows) if self.at else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def by_size(texts: list[str], most: int = 1_000_000) -> Iterator[list[str]]:
    """``texts`` in consecutive parts of about ``most`` characters, one text at least."""
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part
