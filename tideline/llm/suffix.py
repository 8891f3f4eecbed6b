"""External induced sorting of suffixes with common-prefix values, for one shard of text.

The shard is cut at its S* suffixes (starts of ascending slopes). S* substrings are named by their order; the reduced string of names is
sorted first, by doubling suffix tuples (rank, rank of the next half), each round an external distribution sort. From the sorted S*
suffixes all descending (L) suffixes are induced in one ascending scan, and from those all ascending (S) suffixes in one descending
scan. The scans run over one queue per first character; together the queues are the priority queue of the method: their heads are
taken in character order, and a tuple (position, common prefix with the tuple before) goes to the queue of the character before
it. The common prefix of two neighbours in a queue is one more than the least common prefix met between their sources.

Queues hold up to ``memory`` tuples and spill the rest to unlinked files in the task's scratch folder, where Spark spills too; the
text and the arrays over all positions are mapped files beyond ``memory`` entries. Nothing outlives the task, and a lost
executor only repeats it. Common prefixes are counted up to ``depth``; suffixes that agree that far stand in any order.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)


def scratch() -> str | None:
    first = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return first if first and os.path.isdir(first) else None


def array(n: int, dtype, memory: int) -> np.ndarray:
    """An empty array, in a mapped unlinked file if it is large."""
    if n <= memory:
        return np.empty(n, dtype)
    with tempfile.TemporaryFile(dir=scratch()) as f:
        f.truncate(n * np.dtype(dtype).itemsize)
        return np.memmap(f, dtype, "r+", shape=(n,))


def order_of(keys: np.ndarray, memory: int) -> np.ndarray:
    """Stable argsort; beyond ``memory`` keys a distribution sort, range by range."""
    if len(keys) <= memory:
        return np.argsort(keys, kind="stable")
    parts = -(-len(keys) // (memory // 2))
    sample = np.sort(keys[:: max(1, len(keys) // (64 * parts))])
    cuts = np.unique(sample[:: max(1, len(sample) // parts)][1:])
    out, at = array(len(keys), np.int64, memory), 0
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        inside = np.ones(len(keys), bool) if lo is None else keys >= lo
        if hi is not None:
            inside &= keys < hi
        rows = np.flatnonzero(inside)
        out[at : at + len(rows)] = rows[np.argsort(keys[rows], kind="stable")]
        at += len(rows)
    return out


class Queue:
    """Tuples (position, common prefix) in order; what exceeds ``memory`` lies on disk."""

    def __init__(self, memory: int):
        self.memory, self.blocks, self.held, self.file, self.size = memory, [], 0, None, 0

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        block = np.empty(len(pos), [("p", np.int64), ("l", np.int16)])
        block["p"], block["l"] = pos, lcp
        self.size += len(block)
        if self.held + len(block) > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=scratch())
            self.file.seek(0, 2)
            self.blocks.append((self.file.tell(), len(block)))
            self.file.write(block.tobytes())
        else:
            self.blocks.append(block)
            self.held += len(block)

    def merged(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Block i, after as many of the next blocks have been merged into it as are held in memory."""
        j = i
        while j < len(self.blocks) and not isinstance(self.blocks[j], tuple):
            j += 1
        if j > i + 1:
            self.blocks[i:j] = [np.concatenate(self.blocks[i:j])]
        return self.block(i)

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        b = self.blocks[i]
        if isinstance(b, tuple):
            self.file.seek(b[0])
            b = np.frombuffer(self.file.read(b[1] * 10), [("p", np.int64), ("l", np.int16)])
        return b["p"], b["l"]


class Minima:
    """Least values over ranges of one block."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-step], low[step:]))
            step *= 2

    def over(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Ends inclusive; no empty ranges."""
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int16)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            row = self.levels[level]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(level)) + 1])
        return out


class Induced:
    """The sorted suffixes of ``text`` (whole numbers; the last one is the only and least 0) in queues by first character."""

    def __init__(self, text: np.ndarray, depth: int, memory: int = 1 << 25):
        self.t, self.n, self.depth, self.memory = text, len(text), depth, memory
        self.sigma = int(text.max()) + 1
        step = np.sign(np.diff(text.astype(np.int32))).astype(np.int8)
        turns = np.flatnonzero(step)
        change = np.searchsorted(turns, np.arange(self.n - 1))  # each position's next place where the text changes
        self.run = array(self.n, np.int16, memory)  # length of the run of one character from here on, up to depth
        self.rises = array(self.n, bool, memory)
        self.run[:-1] = np.minimum(turns[change] - np.arange(self.n - 1) + 1, depth)
        self.rises[:-1] = step[turns[change]] > 0
        self.run[-1], self.rises[-1] = 1, True
        self.stars = np.flatnonzero(self.rises[1:] & ~self.rises[:-1]) + 1
        self.hashed = self._hash()
        self.falling = [Queue(memory // 64) for _ in range(self.sigma)]
        self.rising = [Queue(memory // 64) for _ in range(self.sigma)]
        self._induce()

    def _hash(self) -> np.ndarray:
        rng = np.random.default_rng(3)
        codes = rng.integers(0, 1 << 63, 2 * self.sigma, dtype=np.uint64)[2 * self.t.astype(np.int64) + self.rises]
        powers = np.full(self.n, MULTIPLIER)
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=np.uint64)
        out = array(self.n + 1, np.uint64, self.memory)
        out[0] = 0
        np.cumsum(codes * self.powers, out=out[1:])
        return out

    def _equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the texts and slopes from a and b agree over a length; a < b."""
        left = (self.hashed[a + length] - self.hashed[a]) * self.powers[b - a]
        return left == self.hashed[b + length] - self.hashed[b]

    def sorted_stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the S* suffixes in order, common prefix of each with the one before)."""
        stars, m = self.stars, len(self.stars)
        end = np.r_[stars[1:], self.n - 1] + 1
        inverse = pow(int(MULTIPLIER), -1, 1 << 64)
        back = np.full(self.n, np.uint64(inverse))
        back[0] = 1
        back = np.cumprod(back, dtype=np.uint64)
        marks = (self.hashed[end] - self.hashed[stars]) * back[stars] + (end - stars).astype(np.uint64)
        del back
        _, first, name = np.unique(marks, return_index=True, return_inverse=True)
        # The slopes stand beside the characters, so that no S* substring is another one's beginning.
        typed = (2 * self.t.astype(np.uint16) + self.rises).astype(">u2").tobytes()
        strings = [typed[2 * a : 2 * b] for a, b in zip(stars[first].tolist(), end[first].tolist())]
        place = np.empty(len(first), np.int64)
        place[sorted(range(len(strings)), key=strings.__getitem__)] = np.arange(len(first))
        rank, reach = place[name], 1
        while 2 * reach <= self.depth and rank.max(initial=0) + 1 < m:  # an S* substring has two characters at least
            key = rank * (m + 1)
            key[: m - reach] += rank[reach:] + 1
            order = order_of(key, self.memory)
            fresh = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
            rank = np.empty(m, np.int64)
            rank[order] = fresh
            reach *= 2
        order = stars[order_of(rank, self.memory)]
        return order, self.common(order)

    def common(self, order: np.ndarray) -> np.ndarray:
        """Common prefixes of neighbours, by bisection over fingerprints of the text."""
        a, b = np.minimum(order[:-1], order[1:]), np.maximum(order[:-1], order[1:])
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.depth, self.n - b)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_] + 1) // 2
            same = self._equal(a[open_], b[open_], mid)
            lo[open_] = np.where(same, mid, lo[open_])
            hi[open_] = np.where(same, hi[open_], mid - 1)
        # Slopes are part of the fingerprints: they may end a common prefix early, at its last run of one character.
        both = np.minimum(self.run[np.minimum(a + lo, self.n - 1)], self.run[np.minimum(b + lo, self.n - 1)])
        more = np.where(self.t[np.minimum(a + lo, self.n - 1)] == self.t[np.minimum(b + lo, self.n - 1)], both, 0)
        return np.r_[0, np.minimum(lo + more, self.depth)].astype(np.int16)

    def _scan(self, pos, lcp, queues, pending, rising: bool) -> None:
        """Induce what stands before ``pos``; lcp is the common prefix with the suffix scanned before."""
        before = np.maximum(pos - 1, 0)
        ok = np.flatnonzero((pos > 0) & (self.rises[before] == rising))
        least = lcp.min()
        if not len(ok):
            np.minimum(pending, least, out=pending)
            return
        char = self.t[before[ok]]
        by = np.argsort(char, kind="stable")
        at, char = ok[by], char[by]
        first = np.r_[True, char[1:] != char[:-1]]
        head = np.flatnonzero(first)
        tail = np.r_[head[1:], len(at)] - 1
        lo = np.r_[0, at[:-1] + 1]
        lo[head] = 0
        minima = Minima(lcp)
        found = minima.over(lo, at)
        targets = char[head]
        empty = np.fromiter((queues[c].size == 0 for c in targets), bool, len(targets))
        found[head] = np.where(empty, -1, np.minimum(found[head], pending[targets]))
        found = np.minimum(found + 1, self.depth).astype(np.int16)
        rest = np.full(len(targets), self.depth, np.int16)
        left = at[tail] + 1
        some = np.flatnonzero(left < len(lcp))
        if len(some):
            rest[some] = minima.over(left[some], np.full(len(some), len(lcp) - 1))
        np.minimum(pending, least, out=pending)
        pending[targets] = rest
        for c, a, b in zip(targets.tolist(), head.tolist(), tail.tolist()):
            queues[c].push(pos[at[a : b + 1]] - 1, found[a : b + 1])

    def _induce(self) -> None:
        stars, star_lcp = self.sorted_stars()
        chars = self.t[stars]
        bounds = np.searchsorted(chars, np.arange(self.sigma + 1))
        pending = np.full(self.sigma, self.depth, np.int16)
        for c in range(self.sigma):
            queue, i, last = self.falling[c], 0, None
            while i < len(queue.blocks):
                pos, lcp = queue.merged(i)
                self._scan(pos, lcp, self.falling, pending, False)
                i, last = i + 1, pos[-1]
            a, b = bounds[c], bounds[c + 1]
            if b > a:
                lcp = star_lcp[a:b].copy()
                lcp[0] = 0 if last is None else min(self.run[last], self.run[stars[a]])
                self._scan(stars[a:b], lcp, self.falling, pending, False)
        pending[:] = self.depth
        self.seams = []
        for c in range(self.sigma - 1, -1, -1):
            queue, i, last = self.rising[c], 0, None
            while i < len(queue.blocks):
                pos, lcp = queue.merged(i)
                self._scan(pos, lcp, self.rising, pending, True)
                i, last = i + 1, pos[-1]
            queue, after = self.falling[c], None
            for i in range(len(queue.blocks) - 1, -1, -1):
                pos, lcp = queue.block(i)
                if after is None:
                    after = 0 if last is None else min(self.run[last], self.run[pos[-1]])
                    self.seams.append((int(pos[-1]), -1 if last is None else int(last), int(after)))
                self._scan(pos[::-1], np.r_[after, lcp[:0:-1]].astype(np.int16), self.rising, pending, True)
                after = lcp[0]

    def repeated(self) -> np.ndarray:
        """Marks the positions whose next ``depth`` characters also start elsewhere."""
        out = array(self.n, bool, self.memory)
        out[:] = False
        for queue in [*self.falling, *self.rising]:
            before = None
            for i in range(len(queue.blocks)):
                pos, lcp = queue.block(i)
                full = lcp >= self.depth
                out[pos[full]] = True
                out[pos[:-1][full[1:]]] = True
                if before is not None and full[0]:
                    out[before] = True
                before = pos[-1]
        for a, b, lcp in self.seams:
            if b >= 0 and lcp >= self.depth:
                out[[a, b]] = True
        return out

    def suffixes(self) -> np.ndarray:
        """All positions but the last in order."""
        parts = []
        for c in range(self.sigma):
            parts += [self.falling[c].block(i)[0] for i in range(len(self.falling[c].blocks))]
            parts += [self.rising[c].block(i)[0][::-1] for i in range(len(self.rising[c].blocks) - 1, -1, -1)]
        return np.concatenate(parts)


def repeats(strings: list[bytes], depth: int, memory: int = 1 << 25) -> list[np.ndarray]:
    """For each string: marks of the places whose ``depth`` bytes lie within it and also start elsewhere, in any of the strings."""
    sizes = np.array([len(s) for s in strings], np.int64)
    total = int(sizes.sum()) + len(strings)
    if not len(strings) or sizes.max() < depth:
        return [np.zeros(n, bool) for n in sizes]
    text = array(total + 1, np.uint16, memory)
    at = 0
    for s in strings:
        text[at : at + len(s)] = np.frombuffer(s, np.uint8)
        text[at : at + len(s)] += 2
        text[at + len(s)] = 1
        at += len(s) + 1
    text[total] = 0
    marks = Induced(text, depth, memory).repeated()
    out, at = [], 0
    for n in sizes.tolist():
        m = np.zeros(n, bool)
        if n >= depth:
            m[: n - depth + 1] = marks[at : at + n - depth + 1]
        out.append(m)
        at += n + 1
    return out
