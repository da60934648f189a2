"""External induced sorting of the suffixes of a text, with common prefixes.

Suffixes that begin an ascending run after a descending one (LMS) are sorted first; their order induces all others in one
falling and one rising sweep. A sweep takes suffixes from a priority queue and puts the suffixes one symbol longer back into
it, each with the length of the prefix that it shares with the one before it in its bucket: one more than the least common
prefix between the two suffixes that led there. LMS substrings are sorted by the same sweeps, named, and the text of the
names, a half as long at most, is sorted by recursion.

The queue keeps a bounded number of bytes in memory and the rest in runs on disk; texts, names and orders are files that are
read through maps. So a text can be far larger than memory. All files are unnamed, private to the task and gone with it.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of a queue that stay in memory.
MEMORY = 32 << 20
#: Entries that a sweep takes at once, at most, and positions that are read at once.
BLOCK = 1 << 16
#: Bytes that the last step of the recursion holds for each byte of the names.
HELD = 6
#: Common prefixes are counted up to this; it must exceed the length that is asked for.
MOST = 255


class Spool:
    """An array written in order to an unnamed file and then read through a map."""

    def __init__(self, kind):
        self.file, self.kind, self.n = tempfile.TemporaryFile(), np.dtype(kind), 0

    def append(self, x: np.ndarray) -> None:
        x = np.ascontiguousarray(x, self.kind)
        self.file.write(x.tobytes())
        self.n += len(x)

    def array(self, mode: str = "r") -> np.ndarray:
        self.file.flush()
        return np.memmap(self.file, self.kind, mode, shape=(self.n,)) if self.n else np.zeros(0, self.kind)


def blocks(x: np.ndarray, backwards: bool = False) -> Iterator[np.ndarray]:
    for a in range(0, len(x), BLOCK):
        yield np.asarray(x[max(0, len(x) - a - BLOCK) : len(x) - a][::-1] if backwards else x[a : a + BLOCK])


class Queue:
    """Priority queue of numbered values: least key first, of equal keys first come first. Nothing is pushed below the least key.

    Keys are dealt to drawers, one a key if keys are few. What is pushed is dealt when the next drawer is opened, or when it
    grows. Beyond `memory` bytes all drawers are written out, one run each. Drawers of one key are read in blocks; the
    entries of others are sorted as their drawer's turn comes. Values stand alone where the drawer tells the key.
    """

    def __init__(self, keys: int, memory: int):
        n = keys if keys <= 1024 else 512
        self.width = -(-keys // n)
        self.near: list[list] = [[] for _ in range(n)]
        self.far: list[list] = [[] for _ in range(n)]
        self.memory, self.held, self.file, self.now = memory, 0, None, 0
        self.fresh: list[tuple] = []
        self.waiting = 0
        self.columns = 1 if self.width == 1 else 2
        self.keys = self.values = np.zeros(0, np.int64)

    def push(self, key: np.ndarray, value: np.ndarray) -> None:
        if not len(key):
            return
        if self.width > 1 and (inside := key < (self.now + 1) * self.width).any():
            keys, values = np.concatenate([self.keys, key[inside]]), np.concatenate([self.values, value[inside]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.values = keys[order], values[order]
            key, value = key[~inside], value[~inside]
        self.fresh.append((key, value))
        self.waiting += len(key)
        if self.waiting >= BLOCK:
            self.deal()

    def deal(self) -> None:
        """Puts what was pushed into its drawers, in order."""
        if not self.waiting:
            return
        key, value = (x[0] if len(x) == 1 else np.concatenate(x) for x in zip(*self.fresh, strict=True))
        self.fresh, self.waiting = [], 0
        drawer = (key // self.width).astype(np.uint16)
        order = np.argsort(drawer, kind="stable")
        drawer = drawer[order]
        rows = value[order] if self.width == 1 else np.stack([key[order], value[order]], 1)
        cuts = [0, *(np.flatnonzero(drawer[1:] != drawer[:-1]) + 1).tolist(), len(rows)]
        for k, d in enumerate(drawer[cuts[:-1]].tolist()):
            self.near[d].append(rows[cuts[k] : cuts[k + 1]])
        self.held += rows.nbytes
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        for d, parts in enumerate(self.near):
            if parts:
                run = np.concatenate(parts)
                self.far[d].append((at, len(run)))
                at += self.file.write(run.tobytes())
                self.near[d] = []
        self.file.flush()
        self.held = 0

    def load(self, d: int, most: int | None) -> np.ndarray:
        """The rows of a drawer in the order they came, about `most` of them: runs on disk first."""
        out, n = [], 0
        size = 8 * self.columns
        while self.far[d] and (most is None or n < most):
            at, rows = self.far[d].pop(0)
            take = rows if most is None else min(rows, most)
            if take < rows:
                self.far[d].insert(0, (at + take * size, rows - take))
            self.file.seek(at)
            out.append(np.frombuffer(self.file.read(take * size), np.int64).reshape(-1, self.columns))
            n += take
        if not self.far[d] and (most is None or n < most):
            self.held -= sum(p.nbytes for p in self.near[d])
            out += [p.reshape(-1, self.columns) for p in self.near[d]]
            self.near[d] = []
        return out[0] if len(out) == 1 else np.concatenate(out)

    def fill(self) -> bool:
        """Whether there is an entry; the front then begins with the least."""
        while not len(self.keys):
            self.deal()
            if not self.near[self.now] and not self.far[self.now]:
                if self.now + 1 == len(self.near):
                    return False
                self.now += 1
            elif self.width == 1:
                self.values = self.load(self.now, BLOCK).ravel()
                self.keys = np.full(len(self.values), self.now, np.int64)
            else:
                rows = self.load(self.now, None)
                rows = rows[np.argsort(rows[:, 0], kind="stable")]
                self.keys, self.values = rows[:, 0], rows[:, 1]
        return True

    def take(self, n: int) -> None:
        self.keys, self.values = self.keys[n:], self.values[n:]


def run_length(text: np.ndarray, at: int) -> int:
    """How often the symbol at a place repeats from there on, up to MOST."""
    part = text[at : at + MOST]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def sweep(text: np.ndarray, symbols: int, feed: Iterable[tuple], rising: bool, memory: int, common: bool) -> Iterator[tuple]:
    """Blocks (fed, value) in order: falling suffixes and seeds from the least up, or rising suffixes and fed ones from the greatest down.

    A value is a position times 256 plus the common prefix with the entry before; feed has blocks of values. fed: whether
    the entry came from there. Key 2 s (+ 1 for fed ones, which come after those of their bucket that are found), mirrored
    if rising.
    """
    queue = Queue(2 * symbols, memory)
    code = (lambda s: 2 * (symbols - 1 - s)) if rising else (lambda s: 2 * s)
    for value in feed:
        queue.push(code(text[value >> 8].astype(np.int64)) + 1, value)
    since = np.full(symbols, -1, np.int16)  # least common prefix since the last push to a bucket; -1 if there was none
    last_key, last_at, size = -9, 0, BLOCK if queue.width == 1 else 1024
    while queue.fill():
        key, value = queue.keys[:size], queue.values[:size]
        pos = value >> 8
        symbol = symbols - 1 - (key >> 1) if rising else key >> 1
        before = text[np.maximum(pos - 1, 0)].astype(np.int64)
        go = (before < symbol) | ((before == symbol) & (key & 1 == 0)) if rising else before >= symbol
        go &= pos > 0
        cut = len(key)
        if queue.width > 1:
            # an entry leads to nothing that would come before a later one of the batch
            ahead = np.minimum.accumulate(np.where(go, code(before), np.iinfo(np.int64).max))
            late = key[1:] > ahead[:-1]
            if late.any():
                cut = int(late.argmax()) + 1
                key, value, pos, go, before = key[:cut], value[:cut], pos[:cut], go[:cut], before[:cut]
            size = min(BLOCK, max(1024, 2 * cut))
        queue.take(cut)
        t = np.flatnonzero(go)
        s, grown = before[t], 0
        if common:
            lcp = value & 255
            # a bucket's found and fed suffixes differ in how their first symbol's run ends
            if key[0] & 1 and last_key == key[0] - 1:
                lcp[0] = min(run_length(text, int(pos[0])), run_length(text, last_at))
            value = pos << 8 | lcp
            padded = np.append(lcp, MOST)
            tails = int(lcp.min())
            if len(t):
                order = np.argsort(s.astype(np.uint16), kind="stable")
                t, s = t[order], s[order]
                first = np.append(True, s[1:] != s[:-1])
                begin = np.where(first, 0, np.append(0, t[:-1] + 1))
                least = np.minimum.reduceat(padded, np.stack([begin, t + 1], 1).ravel())[::2]
                least[first] = np.minimum(least[first], since[s[first]])
                grown = np.minimum(least + 1, MOST)
            np.minimum(since, tails, out=since)
            if len(t):
                end = np.append(first[1:], True)
                rest = np.minimum.accumulate(padded[::-1])[::-1]
                since[s[end]] = rest[t[end] + 1]
            last_key, last_at = int(key[-1]), int(pos[-1])
        yield key & 1 == 1, value
        queue.push(code(s), (pos[t] - 1) << 8 | grown)


def induced(text: np.ndarray, symbols: int, seeds: Iterable[np.ndarray], memory: int, common: bool = False) -> Iterator[tuple]:
    """All suffixes but the last from the greatest down, as sweep gives them, from LMS suffixes in order (or in any order, to sort LMS substrings)."""
    falling = Spool(np.int64)
    for fed, value in sweep(text, symbols, seeds, False, memory, common):
        falling.append(value[~fed])
    found = falling.array()

    def back() -> Iterator[np.ndarray]:
        after = 0  # read downwards, a suffix shares with the one before it what that one shared upwards
        for x in blocks(found, backwards=True):
            yield x >> 8 << 8 | np.append(after, x[:-1] & 255)
            after = x[-1] & 255

    yield from sweep(text, symbols, back(), True, memory, common)


def lms_positions(text: np.ndarray) -> np.ndarray:
    """Places of symbols that are smaller than the one before, and begin a suffix smaller than the next, in order; the last is one."""
    out, n = [], len(text)
    later, upper = True, False  # whether the suffix after the block ascends; whether its first place may be LMS
    for end in range(n, 0, -BLOCK):
        begin = max(0, end - BLOCK)
        part = text[begin : end + 1].astype(np.int64)
        if end == n:
            part = np.append(part, -1)  # the last suffix counts as ascending
        step = np.diff(part)
        if end == n:
            step[-1] = 1
        turn = np.flatnonzero(step)
        at = np.searchsorted(turn, np.arange(len(step)))
        up = np.append(step[turn] > 0, later)[at]
        if upper and not up[-1]:
            out.append(np.array([end]))
        out.append(np.flatnonzero(up[1:] & ~up[:-1])[::-1] + begin + 1)
        later = upper = bool(up[0])
    spool = Spool(np.int64)
    for x in reversed(out):
        spool.append(x[::-1])
    return spool.array()


def differs(text: np.ndarray, lms: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the LMS substrings at a and b differ: all their symbols are compared."""

    def size(p: np.ndarray) -> np.ndarray:
        at = np.searchsorted(lms, p)
        return lms[np.minimum(at + 1, len(lms) - 1)] - p + 1

    n = size(a)
    out = n != size(b)
    same = np.flatnonzero(~out)
    ends = np.cumsum(n[same])
    begin = 0
    while begin < len(same):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + 4 * BLOCK, "right")))
        rows, m = same[begin:stop], n[same[begin:stop]]
        heads = np.cumsum(m) - m
        inner = np.arange(int(m.sum())) - np.repeat(heads, m)
        unequal = text[np.repeat(a[rows], m) + inner] != text[np.repeat(b[rows], m) + inner]
        out[rows] = np.logical_or.reduceat(unequal, heads)
        begin = stop
    return out


def upwards(descending: Spool, n: int) -> np.ndarray:
    """The positions of a spool from the least up, the text's last one before all."""
    out = Spool(np.int64)
    out.append(np.array([n - 1]))
    for x in blocks(descending.array(), backwards=True):
        out.append(x)
    return out.array()


def seeds_in_order(text: np.ndarray, symbols: int, depth: int, memory: int) -> np.ndarray:
    """LMS positions, sorted by `depth` symbols at least: substrings are sorted and named, the text of names is sorted by recursion."""
    lms = lms_positions(text)
    if len(lms) < 2:
        return lms
    found = Spool(np.int64)
    for fed, value in induced(text, symbols, (p << 8 for p in blocks(lms)), memory):
        pos = value[~fed] >> 8
        pos = pos[pos > 0]
        found.append(pos[text[pos - 1] > text[pos]])
    order = upwards(found, len(text))
    names = np.memmap(tempfile.TemporaryFile(), np.int64, "w+", shape=(len(lms),))
    name, before = -1, None
    for pos in blocks(order):
        fresh = differs(text, lms, np.append(pos[:1] if before is None else before, pos[:-1]), pos)
        fresh[0] |= before is None
        own = name + np.cumsum(fresh)
        names[np.searchsorted(lms, pos)] = own
        name, before = int(own[-1]), pos[-1:]
    if name + 1 == len(lms) or depth <= 2:
        return order
    out = Spool(np.int64)
    depth = -(-depth // 2)
    whole = HELD * names.nbytes <= memory
    for x in blocks(doubled(names, depth) if whole else suffix_order(names, name + 1, depth, memory)):
        out.append(lms[x])
    return out.array()


def doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes of a text of names, sorted by `depth` names at least, in memory: ranks of pairs of ranks."""
    rank, hop = np.array(names), 1
    order = np.argsort(rank, kind="stable")
    while hop < depth:
        pair = rank * (len(rank) + 1)
        pair[:-hop] += rank[hop:] + 1
        order = np.argsort(pair, kind="stable")
        fresh = np.append(True, pair[order][1:] != pair[order][:-1])
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all():
            break
        hop *= 2
    return order


def suffix_order(text: np.ndarray, symbols: int, depth: int, memory: int = MEMORY) -> np.ndarray:
    """Positions of all suffixes, sorted by `depth` symbols at least. The last symbol of a text is its only 0."""
    seeds = seeds_in_order(text, symbols, depth, memory)
    found = Spool(np.int64)
    for _, value in induced(text, symbols, (p << 8 for p in blocks(seeds)), memory):
        found.append(value >> 8)
    return upwards(found, len(text))


def seed_prefixes(text: np.ndarray, seeds: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """Blocks of values: seeds with the number of symbols, `length` at most, that each shares with the one before. text is padded by `length`."""
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    before = None
    for pos in blocks(seeds):
        out = []
        a = np.append(pos[:1] if before is None else before, pos[:-1])
        for k in range(0, len(pos), 4096):
            unequal = view[a[k : k + 4096]] != view[pos[k : k + 4096]]
            out.append(np.where(unequal.any(1), unequal.argmax(1), length))
        lcp = np.concatenate(out)
        if before is None:
            lcp[0] = 0
        yield pos << 8 | lcp
        before = pos[-1:]


def shared_prefixes(text: np.ndarray, symbols: int, length: int, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (positions, common prefix with the position before) of the suffixes from the greatest down, sorted by `length` symbols.

    text: symbols below `symbols`, 512 at most, the last its only 0. Common prefixes are exact below `length`, and at least that if not.
    """
    if length >= MOST or symbols > 512:
        raise ValueError(f"the length must be less than {MOST}, symbols 512 at most")
    seeds = seeds_in_order(text, symbols, length, memory)
    padded = Spool(text.dtype)
    for x in blocks(text):
        padded.append(x)
    padded.append(np.zeros(length, text.dtype))
    for _, value in induced(text, symbols, seed_prefixes(padded.array(), seeds, length), memory, common=True):
        yield value >> 8, value & 255
