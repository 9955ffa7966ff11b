"""Suffix order and common prefixes of a set of strings by external induced sorting.

The strings stand one after the other, each closed by the symbol 0, at which
every comparison ends.  The suffixes at the left-most smaller positions are
ordered first: their substrings are sorted and named, and the string of names
is ordered by the same procedure (by doubling, once it fits in memory).  All
other suffixes follow by induction from two priority queues, one upwards and
one downwards.  A queue takes tuples of a symbol, a place and a common prefix
in batches; it deals them into ranges of symbols, keeps a bounded number in
memory, and appends the rest to a file for each range.

The common prefix of two suffixes that are pushed one after the other to a
symbol is one more than the least on the way between those that push them, so
it travels with the tuples and no two suffixes are compared again; only the
seeds' own prefixes come from the text.  Nothing beyond DEPTH is ordered or
counted.

Types, names, orders and prefixes are arrays of a ``Store``: in files from a
number of elements on, and read and written in blocks.  Substrings are sorted
in ranges of their first symbols, each range in memory; a range that does not
fit is dealt again, by the next symbols where all of it agree in these.  What
is in memory at once is a few blocks, a range of a queue, and a few words for
each file.  The files lie in a folder of the task's own and go with it; a lost
task is run anew from its input.
"""

from __future__ import annotations

import heapq
import os
import shutil
import tempfile

import numpy as np

#: Tuples that a queue holds in memory, elements of an array that is kept in memory, and names that are ordered in memory.
IN_MEMORY, BASE = 500_000, 250_000
#: Elements of an array in a file that are looked at together.
BLOCK = 1 << 18
#: Common prefixes are counted up to this.
DEPTH = 200
#: Tuples of a range of symbols, where a symbol has no more than that itself.
RANGE = 16_384
NONE = np.iinfo(np.int64).max
FAR = np.uint8(255)


class Store:
    """A folder for the files of one sort; it goes when the sort ends."""

    def __init__(self, in_memory: int = IN_MEMORY, base: int = BASE):
        self.in_memory, self.base, self.path, self.n = in_memory, base, None, 0
        self.depth = self.spilled = 0  # levels of the recursion, tuples that a queue wrote

    def file(self) -> str:
        if self.path is None:
            self.path = tempfile.mkdtemp(prefix="suffixes-")
        self.n += 1
        return os.path.join(self.path, str(self.n))

    def array(self, n: int, dtype) -> np.ndarray:
        if n <= self.in_memory:
            return np.empty(n, dtype)
        name = self.file()
        out = np.asarray(np.memmap(name, dtype, "w+", shape=(n,)))
        os.unlink(name)  # the mapping keeps it; it goes with the array
        return out

    def spans(self, n: int):
        """(first, end) of the blocks of an array."""
        step = max(1, min(self.in_memory, BLOCK))
        return [(a, min(a + step, n)) for a in range(0, n, step)]

    def made(self, n: int, dtype, values) -> np.ndarray:
        """An array whose blocks are values(first, end)."""
        out = self.array(n, dtype)
        for a, b in self.spans(n):
            out[a:b] = values(a, b)
        return out

    def gathered(self, parts, dtype) -> np.ndarray:
        """The parts one after the other; how many elements there will be need not be known."""
        held, n, name, f = [], 0, None, None
        for x in parts:
            held.append(np.ascontiguousarray(x, dtype))
            n += len(x)
            if f is None and n > self.in_memory:
                name = self.file()
                f = open(name, "wb")
            if f is not None:
                for y in held:
                    f.write(y.tobytes())
                held.clear()
        if f is None:
            return np.concatenate(held) if held else np.zeros(0, dtype)
        f.close()
        out = np.asarray(np.memmap(name, dtype, "r+", shape=(n,)))
        os.unlink(name)
        return out

    def dealt(self, n: int, parts: int, rows):
        """(part, rows) in order of parts, from blocks of rows: rows(first, end) gives the part and the columns (long) of each."""
        names: dict[int, str] = {}
        for a, b in self.spans(n):
            part, *columns = rows(a, b)
            order = np.argsort(part, kind="stable")
            part, table = part[order], np.stack([x[order] for x in columns], axis=1).astype(np.int64)
            cuts = np.flatnonzero(np.diff(part)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
                k = int(part[x])
                if k not in names:
                    names[k] = self.file()
                with open(names[k], "ab") as f:
                    f.write(table[x:y].tobytes())
        for k in sorted(names):
            size = os.path.getsize(names[k]) // 8 // len(columns)
            table = np.asarray(np.memmap(names[k], np.int64, "r+", shape=(size, len(columns))))
            os.unlink(names[k])
            yield k, table.T

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.path is not None:
            shutil.rmtree(self.path, ignore_errors=True)


class Queue:
    """A priority queue of (symbol, place, common prefix): least symbol first, among equals the first that came.

    What is pushed is never less than what was popped last.
    """

    def __init__(self, counts: np.ndarray, store: Store):
        """counts: for each symbol the number of tuples that will come."""
        self.store = store
        self.range_of = store.array(len(counts), np.int64)
        first, alone, at, before, base, was_big, r = [], [], 0, 0, 0, False, -1
        for a, b in store.spans(len(counts)):
            c = np.asarray(counts[a:b])
            ends = before + np.cumsum(c)
            bases, big = (ends - c) // RANGE, c > RANGE  # such a symbol is a range of its own
            new = np.diff(bases, prepend=base) > 0
            new |= big | np.append(was_big, big[:-1])
            new[0] |= a == 0
            here = r + np.cumsum(new)
            self.range_of[a:b] = here
            first.append(a + np.flatnonzero(new))
            alone.append(here[big])
            before, base, was_big, r = int(ends[-1]), int(bases[-1]), bool(big[-1]), int(here[-1])
        n = r + 1
        self.first = np.concatenate(first) if first else np.zeros(0, np.int64)  # the least symbol of each range
        self.alone = np.zeros(n, dtype=bool)
        for x in alone:
            self.alone[x] = True
        self.blocks: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(n)]
        self.waiting: list[int] = []  # ranges with tuples, as a heap
        self.files: dict[int, str] = {}
        self.held, self.at = 0, -1
        self.now = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))

    def push(self, *tuples: np.ndarray) -> None:
        if not len(tuples[0]):
            return
        r = self.range_of[tuples[0]]
        if r[0] == self.at and (len(r) == 1 or (r == self.at).all()):
            self._merge(tuples)
            return
        order = np.argsort(r, kind="stable")
        r, tuples = r[order], tuple(x[order] for x in tuples)
        cuts = np.flatnonzero(np.diff(r)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(r)]):
            k, part = int(r[a]), tuple(x[a:b] for x in tuples)
            if k == self.at:
                self._merge(part)
            else:
                if not self.blocks[k] and k not in self.files:
                    heapq.heappush(self.waiting, k)
                self.blocks[k].append(part)
                self.held += b - a
        if self.held > self.store.in_memory:
            self._spill()

    def _merge(self, new: tuple[np.ndarray, ...]) -> None:
        now = self.now
        if not self.alone[self.at]:
            order = np.argsort(new[0], kind="stable")
            new = tuple(x[order] for x in new)
            if len(now[0]) and new[0][0] < now[0][-1]:
                at = np.searchsorted(now[0], new[0], "right")
                if len(at) == 1:  # long repeats come one by one
                    self.now = tuple(np.concatenate((x[: at[0]], y, x[at[0] :])) for x, y in zip(now, new))
                else:
                    self.now = tuple(np.insert(x, at, y) for x, y in zip(now, new))
                return
        self.now = tuple(np.concatenate(x) for x in zip(now, new)) if len(now[0]) else new

    def _spill(self) -> None:
        self.store.spilled += self.held
        for k, blocks in enumerate(self.blocks):
            if blocks:
                with open(self.files.setdefault(k, self.files.get(k) or self.store.file()), "ab") as f:
                    for b in blocks:
                        f.write(np.stack([x.astype(np.int64) for x in b], axis=1).tobytes())
                blocks.clear()
        self.held = 0

    def head(self, seed: int | None) -> tuple[np.ndarray, ...]:
        """The rest of the current range, in order; the next range is opened if the next seed does not lie before it."""
        if not len(self.now[0]) and self.waiting and (seed is None or self.range_of[seed] >= self.waiting[0]):
            self.at = k = heapq.heappop(self.waiting)
            parts = []
            if k in self.files:
                symbol, place, prefix = np.fromfile(self.files[k], np.int64).reshape(-1, 3).T
                parts.append((symbol, place, prefix.astype(np.uint8)))
                os.unlink(self.files.pop(k))
            parts += self.blocks[k]
            self.held -= sum(len(b[0]) for b in self.blocks[k])
            self.blocks[k] = []
            self.now = tuple(np.concatenate(x) for x in zip(*parts))
            if not self.alone[k]:
                order = np.argsort(self.now[0], kind="stable")
                self.now = tuple(x[order] for x in self.now)
        return self.now

    def limit(self) -> int:
        """The least symbol of the ranges that wait."""
        return int(self.first[self.waiting[0]]) if self.waiting else NONE

    def pop(self, n: int) -> None:
        self.now = tuple(x[n:] for x in self.now)


class Least:
    """For each symbol, the least common prefix since the last push to it."""

    def __init__(self, most: int):
        self.since = np.full(most + 1, FAR)

    def pushed(self, prefix: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """For pushes at these places of a batch, the least prefix since the push before to the same symbol."""
        k = len(prefix)
        out = np.empty(len(at), dtype=np.uint8)
        before = np.minimum.accumulate(prefix)
        if len(at):
            order = np.argsort(symbol, kind="stable")
            j, s = at[order], symbol[order]
            first = np.concatenate([[True], s[1:] != s[:-1]])
            got = np.empty(len(j), dtype=np.uint8)
            got[first] = np.minimum(self.since[s[first]], before[j[first]])
            again = np.flatnonzero(~first)
            if len(again):
                a, b = j[again - 1] + 1, j[again]
                level = np.log2(b - a + 1).astype(np.int64)
                table = [prefix]
                for i in range(int(level.max())):
                    x = table[-1].copy()
                    x[: k - (1 << i)] = np.minimum(x[: k - (1 << i)], table[-1][1 << i :])
                    table.append(x)
                table = np.stack(table)
                got[again] = np.minimum(table[level, a], table[level, b - (1 << level) + 1])
            out[order] = got
            last = np.append(np.flatnonzero(first)[1:], len(j)) - 1
        if k:
            np.minimum(self.since, before[-1], out=self.since)
        if len(at):
            after = np.append(np.minimum.accumulate(prefix[::-1])[::-1], FAR)
            self.since[s[last]] = after[j[last] + 1]
        return out


def tally(symbols: np.ndarray, wanted: np.ndarray, most: int, store: Store) -> np.ndarray:
    """For each symbol, how many places of the wanted type it has."""
    out = store.array(most + 1, np.int64)
    out[:] = 0
    for a, b in store.spans(len(symbols)):
        np.add.at(out, symbols[a:b][wanted[a:b]], 1)
    return out


def preceding(symbols: np.ndarray, store: Store) -> np.ndarray:
    """For each place, how many of the same symbol stand directly before it."""
    out, before, length = store.array(len(symbols), np.int32), -1, 0
    for a, b in store.spans(len(symbols)):
        t, here = symbols[a:b], np.arange(b - a)
        new = np.append(t[0] != before, t[1:] != t[:-1])
        start = np.maximum.accumulate(np.where(new, here, -1))
        got = np.where(start >= 0, here - start, here + length)
        out[a:b] = got
        before, length = t[-1], int(got[-1]) + 1
    return out


def induce(
    symbols: np.ndarray, run: np.ndarray, wanted: np.ndarray, seeds: np.ndarray, seed_prefix: np.ndarray | None, counts: np.ndarray, store: Store
) -> tuple[np.ndarray, np.ndarray | None]:
    """The places of the wanted type in order, from the ordered seeds, and the common prefix of each with the one before (and a 0).

    symbols: the text's symbols, as the queue is to order them; a tuple comes
    before a seed of its symbol.  seed_prefix: common prefixes of the seeds, or
    None if none are to be carried.  counts: the tally of what is wanted.
    """
    carry = seed_prefix is not None
    count = int(counts.sum())
    queue = Queue(counts, store)
    same = None if carry else preceding(symbols, store)
    least = Least(len(counts) - 1) if carry else None
    out, filled, at, batch = store.array(count, np.int64), 0, 0, 1_024
    prefixes = store.array(count + 1, np.uint8) if carry else None
    if carry:
        prefixes[count] = 0
    last_key, last_run = -1, 0
    while True:
        qs, qp, ql = queue.head(int(symbols[seeds[at]]) if at < len(seeds) else None)
        if not len(qs) and at >= len(seeds):
            break
        ss = symbols[seeds[at : at + batch]]
        if not len(qs):  # seeds alone, up to the next range
            a, b = 0, int(np.searchsorted(ss, queue.limit(), "left"))
        elif queue.alone[queue.at]:  # all of one symbol, and before any seed of it
            b = int(np.searchsorted(ss, qs[0], "left"))
            a = 0 if b else min(65_536, len(qs))
        else:
            a = min(batch, len(qs))
            if not carry and a < len(qs):  # all tuples of a symbol
                a = int(np.searchsorted(qs, qs[a - 1], "right"))
            b = int(np.searchsorted(ss, qs[a - 1], "right" if a == len(qs) else "left"))
            if b == len(ss) and at + b < len(seeds):  # more seeds may come in between
                a = int(np.searchsorted(qs[:a], ss[b - 1], "right"))
        ss = ss[:b].astype(np.int64)
        if a and b:
            key = np.concatenate([qs[:a].astype(np.int64) * 2, ss * 2 + 1])
            order = np.argsort(key, kind="stable")
            key, place = key[order], np.concatenate([qp[:a], seeds[at : at + b]])[order]
        else:
            order, (key, place) = None, (qs[:a].astype(np.int64) * 2, qp[:a]) if a else (ss * 2 + 1, seeds[at : at + b])
        before = place - 1
        push = (before >= 0) & wanted[before]
        gives = np.where(push, symbols[before], NONE >> 2)
        ours = order < a if order is not None else np.full(len(key), a > 0)
        own_queue, whole = ours, 1
        if not carry and a and not queue.alone[queue.at]:
            whole = 0  # a symbol waits until all its tuples have come
            again = ours & (gives * 2 == key)
            if again.any():
                # a run of one symbol follows at once: first each tuple, then the place before each, and so on
                more = np.where(again, same[place], 0)
                which = np.repeat(np.arange(len(key)), more + 1)
                step = np.arange(len(which)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
                at_once = np.lexsort((step, key[which])) if len(which) else which
                which, step = which[at_once], step[at_once]
                key, place, ours, own_queue = key[which], place[which] - step, ours[which], ours[which] & (step == 0)
                before = place - 1
                push = (before >= 0) & wanted[before]
                gives = np.where(push, symbols[before], NONE >> 2)
                push &= ~ours | (gives * 2 != key)
                gives[~push] = NONE >> 2
        k = len(key)
        if k > 1:
            stop = key[1:] - whole >= 2 * np.minimum.accumulate(gives)[:-1]
            if stop.any():
                k = int(np.argmax(stop)) + 1
        mine, from_queue = ours[:k], int(own_queue[:k].sum())
        seeds_done = k - int(mine.sum())
        done = place[:k][mine]
        out[filled : filled + len(done)] = done
        push = push[:k]
        carried = np.zeros(k, dtype=np.uint8)
        if carry:
            own = ql[:a] if not b else seed_prefix[at : at + b] if not a else np.concatenate([ql[:a], seed_prefix[at : at + b]])[order]
            key, runs = key[:k], run[place[:k]]
            prior, prior_run = np.concatenate([[last_key], key[:-1]]), np.concatenate([[last_run], runs[:-1]]).astype(np.uint8)
            prefix = np.where(key == prior, own[:k], np.where((key ^ 1) == prior, np.minimum(runs, prior_run), 0)).astype(np.uint8)
            prefixes[filled : filled + len(done)] = prefix[mine]
            pushed = np.flatnonzero(push)
            carried[pushed] = np.minimum(least.pushed(prefix, pushed, gives[pushed]), DEPTH - 1) + 1
            last_key, last_run = int(key[-1]), int(runs[-1])
        filled += len(done)
        queue.pop(from_queue)
        at += seeds_done
        queue.push(gives[:k][push], before[:k][push], carried[push])
        batch = min(65_536, max(16, 4 * k))
    assert filled == count
    return out, prefixes


def types(text: np.ndarray, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """For each place, whether its suffix is smaller than the next (the end of a string is), and the length of its run of equal symbols, DEPTH at most."""
    n = len(text)
    small, run = store.array(n, bool), store.array(n, np.uint8)
    after, after_small, after_run = -1, True, 0
    for a, b in reversed(store.spans(n)):
        t = text[a:b].astype(np.int64)
        m, following = b - a, np.append(t[1:], after)
        differ = np.flatnonzero(t != following)  # the last place of each run
        here = np.arange(m)
        end = np.append(differ, m)[np.searchsorted(differ, here)]
        is_small = np.append(t < following, after_small)
        if b == n:
            is_small[m - 1] = True
        is_small = is_small[end] | (t == 0)
        length = np.where(end < m, end + 1, m + after_run) - here
        small[a:b], run[a:b] = is_small, np.minimum(length, DEPTH)
        after, after_small, after_run = int(t[0]), bool(is_small[0]), min(int(length[0]), DEPTH)
    return small, run


class Substrings:
    """The substrings from one left-most smaller place to the next, by words of some symbols each."""

    def __init__(self, text: np.ndarray, small: np.ndarray, lms: np.ndarray):
        self.text, self.small, self.lms = text, small, lms
        self.bits = int(text.max()).bit_length() + 1
        self.per = 62 // self.bits

    def lengths(self, which: np.ndarray) -> np.ndarray:
        lms = self.lms
        return np.where(which + 1 < len(lms), lms[np.minimum(which + 1, len(lms) - 1)], lms[-1] + 1) - lms[which] + 1

    def words(self, which: np.ndarray, word: int) -> np.ndarray:
        key, at, left = np.zeros(len(which), dtype=np.int64), self.lms[which], self.lengths(which)
        for i in range(word * self.per, (word + 1) * self.per):
            p = np.minimum(at + i, len(self.text) - 1)
            key = key << self.bits | np.where(i < left, self.text[p].astype(np.int64) * 2 + self.small[p], 0)
        return key

    def ordered(self, which: np.ndarray, word: int, store: Store):
        """(substrings, whether each differs from the one before) in parts, for some that agree in all words before this one."""
        n = len(which)
        if n <= max(2, store.in_memory):
            yield self._in_memory(np.asarray(which), word)
            return
        sample = np.sort(self.words(np.asarray(which[:: max(1, n // 65_536)]), word))
        cuts = np.unique(sample[:: max(1, len(sample) // (4 * n // store.in_memory + 1))])

        def rows(a, b):
            key = self.words(which[a:b], word)
            at = np.searchsorted(cuts, key, "left")
            same = cuts[np.minimum(at, len(cuts) - 1)] == key
            return 2 * at + (same & (at < len(cuts))), which[a:b]

        for part, (some,) in store.dealt(n, 2 * len(cuts) + 1, rows):
            if part % 2 == 0:
                yield from self.ordered(some, word, store)
            elif int(self.lengths(some[:1])[0]) > (word + 1) * self.per:
                yield from self.ordered(some, word + 1, store)
            else:
                for a, b in store.spans(len(some)):
                    new = np.zeros(b - a, dtype=bool)
                    new[0] = a == 0
                    yield some[a:b], new

    def _in_memory(self, which: np.ndarray, word: int) -> tuple[np.ndarray, np.ndarray]:
        length, n = self.lengths(which), len(which)
        name = np.zeros(n, dtype=np.int64)  # of those that are equal so far, how many in all are smaller
        open_, first = np.arange(n), True
        while len(open_):
            key = self.words(which[open_], word)
            order = np.argsort(key, kind="stable") if first else np.lexsort((key, name[open_]))
            open_, key, first = open_[order], key[order], False
            group = name[open_]
            own = np.concatenate([[True], group[1:] != group[:-1]])
            new = own | np.concatenate([[True], key[1:] != key[:-1]])
            here = np.arange(len(open_))
            name[open_] = group + np.maximum.accumulate(np.where(new, here, 0)) - np.maximum.accumulate(np.where(own, here, 0))
            sizes = np.diff(np.append(np.flatnonzero(new), len(open_)))
            word += 1
            open_ = open_[np.repeat(sizes > 1, sizes) & (length[open_] > word * self.per)]
        order = np.argsort(name, kind="stable")
        return which[order], np.diff(name[order], prepend=-1) != 0


def named(text: np.ndarray, small: np.ndarray, lms: np.ndarray, store: Store) -> tuple[np.ndarray, np.ndarray | None]:
    """The name of each substring from one left-most smaller place to the next, in order of the substrings; their order, if all differ.

    Ends of strings have the name 0 and come first.
    """
    names, spans = store.array(len(lms), np.int64), store.spans(len(lms))
    names[:] = 0
    ends = store.gathered((a + np.flatnonzero(text[lms[a:b]] == 0) for a, b in spans), np.int64)
    others = store.gathered((a + np.flatnonzero(text[lms[a:b]]) for a, b in spans), np.int64)
    last = 0

    def numbered():
        nonlocal last
        for a, b in store.spans(len(ends)):
            yield ends[a:b]
        if len(others):
            for which, new in Substrings(text, small, lms).ordered(others, 0, store):
                names[which] = last + np.cumsum(new)
                last += int(new.sum())
                yield which

    order = store.gathered(numbered(), np.int64)
    return names, order if last == len(others) else None


def doubled(names: np.ndarray) -> np.ndarray:
    """Where the recursion ends: the order of a string of names that fits in memory, by doubling, to a depth of DEPTH names."""
    n = len(names)
    zero = np.flatnonzero(names == 0)
    end = np.append(zero, n)[np.searchsorted(zero, np.arange(n))]  # of the own string
    which = np.flatnonzero(names)
    rank = np.zeros(n + 1, dtype=np.int64)
    which = which[np.argsort(names[which], kind="stable")]
    key, base, step = names[which], np.ones(len(which), dtype=np.int64), 1
    while len(which):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (base[1:] != base[:-1])])
        own = np.concatenate([[True], base[1:] != base[:-1]])  # equal so far: places that follow each other from the base on
        here = np.arange(len(which))
        rank[which] = base + np.maximum.accumulate(np.where(new, here, 0)) - np.maximum.accumulate(np.where(own, here, 0))
        firsts = np.flatnonzero(new)
        sizes = np.diff(np.append(firsts, len(which)))
        which = which[np.repeat(sizes > 1, sizes)]
        if step >= DEPTH:
            break
        base, key = rank[which], rank[np.minimum(which + step, end[which])]
        order = np.lexsort((key, base))
        which, key, base = which[order], key[order], base[order]
        step *= 2
    some = np.flatnonzero(names)
    return some[np.argsort(rank[some], kind="stable")]


def common(text: np.ndarray, order: np.ndarray, store: Store) -> np.ndarray:
    """The common prefix of each of these places with the one before, DEPTH at most; it ends before a 0."""
    out = store.array(len(order), np.uint8)
    out[:1] = 0
    padded = store.array(len(text) + DEPTH, text.dtype)
    padded[: len(text)] = text
    padded[len(text) :] = 0
    view = np.lib.stride_tricks.sliding_window_view(padded, DEPTH)
    short = 16  # most end early
    for i in range(1, len(order), 40_000):
        a, b = order[i - 1 : i + 39_999], order[i : i + 40_000]
        a = a[: len(b)]
        for width in (short, DEPTH):
            x, y = view[a, :width], view[b, :width]
            differ = (x != y) | (x == 0)
            found = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
            if width == short:
                got, on = found, np.flatnonzero(found == short)
                a, b = a[on], b[on]
                if not len(on):
                    break
            else:
                got[on] = found
        out[i : i + len(got)] = got
    return out


def suffix_order(text: np.ndarray, store: Store, carry: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """The places of all suffixes that do not begin with 0, in order to a depth of DEPTH, and the common prefix of each with the one before.

    Common prefixes are DEPTH at most; without ``carry`` there are none.
    """
    if not len(text) or not text.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    n, most = len(text), int(text.max())
    small, run = types(text, store)

    def places():
        for a, b in store.spans(n):
            t, before = text[a:b], np.append(a > 0 and small[a - 1], small[a : b - 1])
            first = small[a:b] & ~before
            first[0] &= a > 0
            yield a + np.flatnonzero(first | (t == 0))

    lms = store.gathered(places(), np.int64)
    names, order = named(text, small, lms, store)
    if order is None:
        store.depth += 1
        rest = doubled(np.asarray(names)) if len(names) <= store.base else suffix_order(names, store, False)[0]

        def ends_first():
            for a, b in store.spans(len(names)):
                yield a + np.flatnonzero(names[a:b] == 0)
            for a, b in store.spans(len(rest)):
                yield rest[a:b]

        order = store.gathered(ends_first(), np.int64)
        del rest
    seeds = store.made(len(order), np.int64, lambda a, b: lms[order[a:b]])
    del names, order, lms
    larger_places = store.made(n, bool, lambda a, b: ~small[a:b])
    n_larger = tally(text, larger_places, most, store)
    larger, lcp = induce(text, run, larger_places, seeds, common(text, seeds, store) if carry else None, n_larger, store)
    del seeds
    turned = store.made(n, text.dtype, lambda a, b: most - text[a:b].astype(np.int64))
    smaller_places = store.made(n, bool, lambda a, b: small[a:b] & (text[a:b] != 0))
    n_smaller = tally(turned, smaller_places, most, store)
    # downwards: a place's common prefix with the one before it is that of the next with it upwards
    smaller, down = induce(turned, run, smaller_places, larger[::-1], lcp[1:][::-1] if carry else None, n_smaller, store)
    del turned, smaller_places, larger_places
    return _merged(text, small, run, (larger, lcp, n_larger), (smaller[::-1], down[1:][::-1] if carry else None, n_smaller[::-1]), store)


def _merged(text, small, run, larger, smaller, store: Store) -> tuple[np.ndarray, np.ndarray | None]:
    """Both types as one: of each symbol first the larger, then the smaller."""
    (large, lcp, n_large), (less, down, n_less) = larger, smaller
    size = len(large) + len(less)
    both, prefix = store.array(size, np.int64), store.array(size, np.uint8) if lcp is not None else None
    through, below = store.array(len(n_large), np.int64), store.array(len(n_less), np.int64)
    np.cumsum(n_large, out=through)
    np.cumsum(n_less, out=below)
    below -= n_less
    for places, shift, own in ((large, below, lcp), (less, through, down)):
        for a, b in store.spans(len(places)):
            to = np.arange(a, b) + shift[text[places[a:b]]]
            both[to] = places[a:b]
            if own is not None:
                prefix[to] = own[a:b]
    if prefix is not None and size:
        prefix[0] = 0
        for a, b in store.spans(size - 1):  # where the larger of a symbol end and the smaller begin, both have a run of that symbol
            x, y = both[a:b], both[a + 1 : b + 1]
            same, turn = text[x] == text[y], small[x] != small[y]
            got = np.where(turn, np.minimum(run[x], run[y]), prefix[a + 1 : b + 1])
            prefix[a + 1 : b + 1] = np.where(same, got, 0)
    return both, prefix
