"""Repeated byte strings by a suffix array built with external induced sorting.

`suffixes` sorts all suffixes of a shard by induced sorting: leftmost-S suffixes are sorted by
naming the substrings between them and sorting the string of names by the same induction,
down to a string whose names all differ; from them the L suffixes and then the S suffixes of
the text are induced through a priority queue that is keyed by the first symbol. An entry
carries its suffix and the common prefix with the entry before it; common prefixes of induced
suffixes come from a range minimum over the entries that lie between their sources.

All arrays that grow with the shard (text, types, queues, names, ranks) come from a `Spool`: the
first `Spool.memory` bytes are in memory, the rest are files of the task. Queues are read and
filled in batches of at most BATCH entries; a string of names is ordered in runs of symbols of
about that size, of which one symbol alone may make a larger one. So what a task holds of a
shard's suffixes is bounded by these two, while its distinct strings are held once.

`remove_repeats` cuts the corpus into shards by window anchor (repeats.py), so that equal
windows meet in one shard. Equal strings are merged as they come, each with the smallest
document that has it. Only windows whose fingerprints are counted more than once in a shard are
sorted; counts of fingerprints are never too low, and the suffix array decides.

A null text is empty. A null doc_id comes after all others; documents of equal doc_id
(or two null ones) don't remove each other's bytes. Texts shorter than a window, equal
rows and empty tables are ordinary.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernels as K
from lodestone.llm import repeats as R
from lodestone.llm.common import dealt, parts_for
from lodestone.llm.substring import SPAN, spans_from

U = np.uint64
NONE = 255
LAST = R.LAST
#: Entries that are handled together.
BATCH = 1 << 18
#: Bytes of strings that await being merged, and cells that count windows.
MERGE, CELLS = 32 << 20, 1 << 24
#: Symbols of the text: the end, between strings, and bytes from 2. UTF-8 has no byte above 247.
SIGMA = 250


class Spool:
    """Arrays that are files when they are large; all vanish when the block ends."""

    memory = 8 << 20

    def __enter__(self) -> Spool:
        self.folder: tempfile.TemporaryDirectory | None = None
        self.used = self.files = 0
        return self

    def __exit__(self, *_) -> None:
        if self.folder:
            self.folder.cleanup()

    def array(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if self.used + size <= self.memory:
            self.used += size
            return np.zeros(n, dtype)
        self.folder = self.folder or tempfile.TemporaryDirectory(prefix="suffix-")
        self.files += 1
        return np.memmap(os.path.join(self.folder.name, str(self.files)), dtype, "w+", shape=(max(1, n),))[:n]

    def put(self, a: np.ndarray) -> np.ndarray:
        out = self.array(len(a), a.dtype)
        out[:] = a
        return out


def parts(n: int) -> Iterator[slice]:
    for i in range(0, n, BATCH):
        yield slice(i, min(n, i + BATCH))


class Least:
    """Range minima of small integers."""

    def __init__(self, d: np.ndarray):
        rows = [d]
        while (step := 1 << (len(rows) - 1)) * 2 <= len(d):
            last = rows[-1]
            nxt = last.copy()
            nxt[: len(d) - step] = np.minimum(last[: len(d) - step], last[step:])
            rows.append(nxt)
        self.table = np.stack(rows)

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of d[low..high], both included; NONE where there is nothing."""
        n = high - low + 1
        some = n > 0
        j = np.log2(np.maximum(n, 1)).astype(np.int64)
        low = np.where(some, low, 0)
        high = np.where(some, high, 0)
        out = np.minimum(self.table[j, low], self.table[j, np.maximum(high - (1 << j) + 1, 0)])
        return np.where(some, out, NONE)


def types(t: np.ndarray, spool: Spool) -> np.ndarray:
    """Which suffixes are S: less than the one that follows. The last symbol is the only 0."""
    n = len(t)
    out = spool.array(n, bool)
    out[n - 1] = True
    # from the end: a place like the next one has its type
    for p in reversed(list(parts(n - 1))):
        a, b = t[p], t[p.start + 1 : p.stop + 1]
        less, differs = a < b, np.flatnonzero(a != b)
        nxt = np.searchsorted(differs, np.arange(len(a)))
        inside = nxt < len(differs)
        value = np.full(len(a), bool(out[p.stop]))
        value[inside] = less[differs[nxt[inside]]]
        out[p] = value
    return out


def leftmost(is_s: np.ndarray, spool: Spool) -> np.ndarray:
    """Places of S suffixes after an L, and the last one."""
    found = [np.flatnonzero(is_s[p.start + 1 : p.stop + 1] & ~is_s[p]) + p.start + 1 for p in parts(len(is_s) - 1)]
    stars = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int32)
    if not len(stars) or stars[-1] != len(is_s) - 1:
        stars = np.append(stars, np.int32(len(is_s) - 1))
    return spool.put(stars)


def symbol_runs(t: np.ndarray, is_s: np.ndarray, sigma: int, s_type: bool) -> list[tuple[int, int]]:
    """Ranges of symbols, in order, in which no place's suffix is induced by another's.

    A symbol that induces itself stands alone. S suffixes go down.
    """
    alone = np.zeros(sigma, bool)
    bound = np.full(sigma, -1 if s_type else sigma, np.int64)
    for p in parts(len(t) - 1):
        mine = is_s[p] == s_type
        a, b = t[p][mine].astype(np.int64), t[p.start + 1 : p.stop + 1][mine].astype(np.int64)
        alone[a[a == b]] = True
        pairs = np.unique((np.minimum(a, b) * sigma + np.maximum(a, b))[a != b])
        low, high = pairs // sigma, pairs % sigma
        if s_type:
            np.maximum.at(bound, high, low)
        else:
            np.minimum.at(bound, low, high)
    bound, alone, out = bound.tolist(), alone.tolist(), []
    if not s_type:
        c = 0
        while c < sigma:
            s, limit = c, bound[c]
            if not alone[c]:
                while s + 1 < limit and s + 1 < sigma and not alone[s + 1]:
                    s += 1
                    limit = min(limit, bound[s])
            out.append((c, s + 1))
            c = s + 1
    else:
        c = sigma - 1
        while c >= 0:
            s, limit = c, bound[c]
            if not alone[c]:
                while s - 1 > limit and s > 0 and not alone[s - 1]:
                    s -= 1
                    limit = max(limit, bound[s])
            out.append((s, c + 1))
            c = s - 1
    return out


class Queue:
    """Priority queue of suffixes by first symbol; equal symbols leave as they came.

    Each symbol's entries have their own stretch of one array, which is a file when it is
    large. An entry has the common prefix with the one before it, up to cap.
    """

    def __init__(self, spool: Spool, counts: np.ndarray, cap: int):
        self.head = np.concatenate(([0], np.cumsum(counts)))
        self.fill = self.head[:-1].copy()
        self.at = spool.array(int(self.head[-1]), np.int32)
        self.cap = cap
        self.common = spool.array(len(self.at), np.uint8)
        self.since = np.full(len(counts), NONE, np.uint8)

    def push(self, entries: np.ndarray, symbols: np.ndarray, sources: np.ndarray, d: np.ndarray) -> None:
        """d: common prefix of each of the batch's sources with the one before it."""
        least = Least(d)
        if len(entries):
            order = np.argsort(symbols.astype(np.uint8), kind="stable")
            q = symbols[order]
            first, size = K.by_group(q)
            slots = np.repeat(self.fill[q[first]] - first, size) + np.arange(len(q))
            self.at[slots] = entries[order]
            src = sources[order]
            low = np.empty(len(q), np.int64)
            low[1:] = src[:-1] + 1
            low[first] = 0
            value = least(low, src)
            value[first] = np.minimum(value[first], self.since[q[first]])
            value = np.minimum(value.astype(np.int64) + 1, self.cap)
            value[first[self.fill[q[first]] == self.head[q[first]]]] = 0
            self.common[slots] = value
        np.minimum(self.since, d.min() if len(d) else NONE, out=self.since)
        if len(entries):
            last = src[first + size - 1]
            self.since[q[first]] = least(last + 1, np.full(len(last), len(d) - 1))
            self.fill[q[first]] += size


def seam(t: np.ndarray, x: np.ndarray, y: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of suffixes of one symbol of which one leaves its run of it first."""
    x, y = np.atleast_1d(x).astype(np.int64), np.atleast_1d(y).astype(np.int64)
    out, live = np.full(len(x), cap), np.arange(len(x))
    for k in range(1, cap):
        i, j = x[live] + k, y[live] + k
        inside = np.maximum(i, j) < len(t)
        same = inside.copy()
        same[inside] = (t[i[inside]] == t[x[live[inside]]]) & (t[j[inside]] == t[y[live[inside]]])
        out[live[~same]] = k
        live = live[same]
        if not len(live):
            break
    return out


def induced(t: np.ndarray, sigma: int, is_s: np.ndarray, seeds: np.ndarray, seed_common: np.ndarray, spool: Spool, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in order, each with the common prefix with the one before it up to cap, in
    batches, from the sorted leftmost-S suffixes."""
    n = len(t)
    l_count, s_count = np.zeros(sigma, np.int64), np.zeros(sigma, np.int64)
    for p in parts(n):
        kind = is_s[p]
        l_count += np.bincount(t[p][~kind], minlength=sigma)
        s_count += np.bincount(t[p][kind], minlength=sigma)
    l_queue, s_queue = Queue(spool, l_count, cap), Queue(spool, s_count, cap)
    seed_count = np.zeros(sigma, np.int64)
    for p in parts(len(seeds)):
        seed_count += np.bincount(t[seeds[p]], minlength=sigma)
    seed_at = np.concatenate(([0], np.cumsum(seed_count)))

    def sweep(queue, runs, other, other_at, other_common, pushes_s, down):
        def push(items, d):
            prev = items - 1
            src = np.flatnonzero((items > 0) & (is_s[prev] == pushes_s))
            e = prev[src]
            queue.push(e, t[e].astype(np.int64), src, d)

        def others(c, c2):
            """What else the symbols have, in order, in batches."""
            a, b = int(other_at[c]), int(other_at[c2])
            for p in parts(b - a):
                if not down:
                    yield np.array(other[a + p.start : a + p.stop]), np.array(other_common[a + p.start : a + p.stop])
                else:
                    low, high = b - p.stop, b - p.start
                    d = np.zeros(high - low, np.uint8)
                    above = np.array(other_common[low + 1 : min(high + 1, b)])[::-1]
                    d[len(d) - len(above) :] = above
                    yield np.array(other[low:high])[::-1], d

        def sizes(c, c2):
            return int(queue.head[c2] - queue.head[c] + other_at[c2] - other_at[c])

        def bounded(runs):
            """Runs of at most BATCH entries where they have more than one symbol."""
            for c, c2 in runs:
                while c < c2:
                    if down:
                        low = c2 - 1
                        while low > c and sizes(low - 1, c2) <= BATCH:
                            low -= 1
                        yield low, c2
                        c2 = low
                    else:
                        high = c + 1
                        while high < c2 and sizes(c, high + 1) <= BATCH:
                            high += 1
                        yield c, high
                        c = high

        for c, c2 in bounded(runs):
            if c2 - c == 1:
                seen, last = int(queue.head[c]), -1
                while seen < queue.fill[c]:
                    upto = min(int(queue.fill[c]), seen + BATCH)
                    items = np.array(queue.at[seen:upto])
                    last = int(items[-1])
                    d = np.array(queue.common[seen:upto])
                    seen = upto
                    push(items, d)
                for x, d in others(c, c2):
                    if last != -2:
                        d[0] = seam(t, last, x[0], cap)[0] if last >= 0 else 0
                        last = -2
                    push(x, d)
            else:
                a, b = queue.head[c], queue.head[c2]
                mine = np.array(queue.at[a:b])
                rest = list(others(c, c2))
                x = np.concatenate([mine[:0], *[r[0] for r in rest]])
                d = np.concatenate([np.zeros(0, np.uint8), *[r[1] for r in rest]])
                first, second = t[mine].astype(np.int64), t[x].astype(np.int64)
                key = np.concatenate(((sigma - first) * 2, (sigma - second) * 2 + 1) if down else (first * 2, second * 2 + 1))
                order = np.argsort(key.astype(np.uint16), kind="stable")
                items = np.concatenate((mine, x))[order]
                # an entry's d holds while the one before it is of its own kind and symbol
                both = np.concatenate((queue.common[a:b], d))[order]
                k = key[order]
                if len(k):
                    fresh = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                    both[fresh] = 0
                    joins = fresh[1:][(k[fresh[1:]] >> 1) == (k[fresh[1:] - 1] >> 1)]
                    both[joins] = seam(t, items[joins - 1], items[joins], cap)
                push(items, both)

    sweep(l_queue, symbol_runs(t, is_s, sigma, False), seeds, seed_at, seed_common, False, False)
    # S suffixes are induced downwards, each symbol's from the greatest; the order of their
    # queue is the reverse of the suffix array's. The last symbol's suffix is induced by none.
    s_queue.at[0] = n - 1
    s_queue.fill[0] = 1
    sweep(s_queue, symbol_runs(t, is_s, sigma, True), l_queue.at, l_queue.head, l_queue.common, True, True)

    for c in range(sigma):
        a, b = int(l_queue.head[c]), int(l_queue.head[c + 1])
        for p in parts(b - a):
            yield np.array(l_queue.at[a + p.start : a + p.stop]), np.array(l_queue.common[a + p.start : a + p.stop])
        last = int(l_queue.at[b - 1]) if b > a else -1
        a, b = int(s_queue.head[c]), int(s_queue.head[c + 1])
        for p in parts(b - a):
            low, high = b - p.stop, b - p.start
            items = np.array(s_queue.at[low:high])[::-1]
            # an entry's d is with the one before it in the queue, which stands after it here
            d = np.zeros(len(items), np.uint8)
            above = np.array(s_queue.common[low + 1 : min(high + 1, b)])[::-1]
            d[len(d) - len(above) :] = above
            if not p.start and last >= 0:
                d[0] = seam(t, last, items[0], cap)[0]
            yield items, d


def names(t: np.ndarray, is_s: np.ndarray, stars: np.ndarray, sigma: int, spool: Spool) -> tuple[np.ndarray, int]:
    """Order-keeping numbers of the substrings between leftmost-S places, and their count.
    Substrings are sorted by ranges of their first symbols."""
    out = spool.array(len(stars), np.int32)
    count = np.zeros(sigma, np.int64)
    for p in parts(len(stars)):
        count += np.bincount(t[stars[p]], minlength=sigma)
    upto, base, c = np.cumsum(count), 0, 0
    while c < sigma:
        before = int(upto[c - 1]) if c else 0
        c2 = max(c + 1, int(np.searchsorted(upto, before + 4 * BATCH, "right")))
        if upto[c2 - 1] > before:
            if c == 0 and c2 == sigma:
                mine = np.arange(len(stars))
            else:
                mine = np.concatenate([np.flatnonzero((first >= c) & (first < c2)) + p.start for p in parts(len(stars)) for first in (t[stars[p]],)])
            got, n = named(t, is_s, stars, mine, sigma)
            out[mine] = got + base
            base += n
        c = c2
    return out, base


def named(t: np.ndarray, is_s: np.ndarray, stars: np.ndarray, mine: np.ndarray, sigma: int) -> tuple[np.ndarray, int]:
    """Numbers of some of the substrings among themselves, by refining ties."""
    bits = int(2 * sigma + 2).bit_length()
    per = max(1, 62 // bits)
    begin = stars[mine].astype(np.int64)
    size = np.where(mine + 1 < len(stars), stars[np.minimum(mine + 1, len(stars) - 1)] - begin, 0) + 1
    rank = np.zeros(len(mine), np.int64)
    active = np.arange(len(mine))
    done = 0
    while len(active):
        column = np.zeros(len(active), np.int64)
        for j in range(per):
            inside = size[active] > done + j
            p = np.where(inside, begin[active] + done + j, 0)
            column = (column << bits) | np.where(inside, t[p].astype(np.int64) * 2 + is_s[p] + 1, 0)
        order = np.lexsort((column, rank[active])) if done else np.argsort(column)
        r, c = rank[active][order], column[order]
        group = np.concatenate(([True], r[1:] != r[:-1]))
        new = group | np.concatenate(([True], c[1:] != c[:-1]))
        at = np.arange(len(order))
        group_start = np.maximum.accumulate(np.where(group, at, 0))
        sub_start = np.maximum.accumulate(np.where(new, at, 0))
        rank[active[order]] = r + sub_start - group_start
        done += per
        _, count = K.by_group(sub_start)
        more = np.repeat(count > 1, count)
        kept = active[order][more]
        active = kept[size[kept] > done]
    present = np.zeros(len(mine) + 1, bool)
    present[rank] = True
    dense = np.cumsum(present) - 1
    return dense[rank], int(dense[-1]) + 1


def by_rank(t: np.ndarray, is_s: np.ndarray, s_type: bool, bounds: np.ndarray, first_slot: np.ndarray, rank: np.ndarray, spool: Spool) -> None:
    """Gives the suffixes of one type their places in the suffix array, symbol by symbol: those
    of a symbol follow the ranks of the suffixes that induce them. Runs of symbols are ordered
    together; where a suffix of the run induces another, ranks of ever longer chains decide."""
    n, sigma = len(t), len(bounds) - 1
    places = spool.array(int(bounds[-1]), np.int32)
    fill = bounds[:-1].copy()
    for p in parts(n - 1):
        mine = np.flatnonzero(is_s[p] == s_type) + p.start
        symbol = t[mine]
        order = np.argsort(symbol, kind="stable")
        first, size = K.by_group(symbol[order])
        heads = symbol[order][first]
        places[np.repeat(fill[heads] - first, size) + np.arange(len(mine))] = mine[order]
        fill[heads] += size
    where = spool.array(n, np.int32)
    c, c2 = (0, 0) if not s_type else (sigma, sigma)
    while (c2 < sigma) if not s_type else (c > 0):
        if s_type:
            c2 = c
            c = min(c2 - 1, int(np.searchsorted(bounds, bounds[c2] - BATCH)))
        else:
            c = c2
            c2 = max(c + 1, int(np.searchsorted(bounds, bounds[c] + BATCH, "right")) - 1)
        low, high = int(bounds[c]), int(bounds[c2])
        if low == high:
            continue
        m = places[low:high].astype(np.int64)
        src = m + 1
        symbol, source = t[m].astype(np.int64), t[src]
        open_ = (source >= c) & (source < c2) & (is_s[src] == s_type)
        # where the rank isn't known yet, all of the source's symbol and type count alike
        key = symbol * n + np.where(open_, first_slot[source], rank[src])
        order = np.argsort(key)
        if open_.any():
            where[m] = np.arange(len(m))
            nxt = np.arange(len(m))
            nxt[open_] = where[src[open_]]
            while True:
                k = key[order]
                mine = np.empty(len(m), np.int64)
                mine[order] = np.cumsum(np.concatenate(([0], k[1:] != k[:-1])))
                if mine[order[-1]] == len(m) - 1:
                    break
                key = mine * len(m) + mine[nxt]
                order = np.argsort(key)
                nxt = nxt[nxt]
        done = symbol[order]
        rank[m[order]] = first_slot[done] + np.arange(low, high) - bounds[done]


def sort_names(t: np.ndarray, sigma: int, spool: Spool) -> np.ndarray:
    """The suffix array of a string of names of which the last is the only 0."""
    n = len(t)
    is_s = types(t, spool)
    seeds = seeds_of(t, sigma, is_s, spool)
    count = np.zeros((2, sigma), np.int64)
    for p in parts(n):
        for kind in (0, 1):
            count[kind] += np.bincount(t[p][is_s[p] == bool(kind)], minlength=sigma)
    start = np.cumsum(count.sum(0)) - count.sum(0)
    rank = spool.array(n, np.int32)
    # Leftmost-S suffixes count as the first of their symbol's S suffixes, in their order.
    seed_count = np.zeros(sigma, np.int64)
    for p in parts(len(seeds)):
        seed_count += np.bincount(t[seeds[p]], minlength=sigma)
    seed_at = np.cumsum(seed_count) - seed_count
    for p in parts(len(seeds)):
        symbol = t[seeds[p]]
        rank[seeds[p]] = start[symbol] + count[0][symbol] + np.arange(p.start, p.stop) - seed_at[symbol]
    with Spool() as inner:
        by_rank(t, is_s, False, np.concatenate(([0], np.cumsum(count[0]))), start, rank, inner)
    s_bounds = count[1].copy()
    s_bounds[0] = 0  # the last symbol's suffix is induced by none
    rank[n - 1] = 0
    with Spool() as inner:
        by_rank(t, is_s, True, np.concatenate(([0], np.cumsum(s_bounds))), start + count[0], rank, inner)
    out = spool.array(n, np.int32)
    for p in parts(n):
        out[rank[p]] = np.arange(p.start, p.stop)
    return out


def seeds_of(t: np.ndarray, sigma: int, is_s: np.ndarray, spool: Spool) -> np.ndarray:
    """The leftmost-S suffixes in order."""
    with Spool() as inner:
        stars = leftmost(is_s, inner)
        number, count = names(t, is_s, stars, sigma, inner)
        seeds = spool.array(len(stars), np.int32)
        if count == len(stars):
            for p in parts(len(stars)):
                seeds[number[p]] = stars[p]
        else:
            order = sort_names(number, count, inner)
            for p in parts(len(stars)):
                seeds[p] = stars[order[p]]
    return seeds


def adjacent(t: np.ndarray, seeds: np.ndarray, cap: int, spool: Spool) -> np.ndarray:
    """Common prefix of each suffix with the one before it, up to cap; t has cap + 8 symbols
    more than its suffixes reach. Eight symbols at a time."""
    eight = np.ndarray(len(t) - 7, "<u8", t, strides=(1,))
    out = spool.array(len(seeds), np.uint8)
    for p in parts(len(seeds)):
        b = seeds[p].astype(np.int64)
        a = np.concatenate((seeds[max(0, p.start - 1) : max(0, p.start - 1) + 1].astype(np.int64), b[:-1]))
        common, live = np.full(len(a), cap, np.int64), np.arange(len(a))
        for k in range(0, cap, 8):
            differ = eight[a[live] + k] ^ eight[b[live] + k]
            end = differ != 0
            d = differ[end]
            common[live[end]] = k + (np.bitwise_count((d & (~d + U(1))) - U(1)) >> 3)
            live = live[~end]
            if not len(live):
                break
        out[p] = np.minimum(common, cap)
    if len(seeds):
        out[0] = 0
    return out


def suffixes(t: np.ndarray, sigma: int, cap: int, spool: Spool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of 8-bit symbols below sigma of which the last is the only 0: all suffixes in order, and
    the common prefix of each with the one before it, up to cap, in batches."""
    n = len(t)
    longer = spool.array(n + cap + 8, np.uint8)
    longer[:n] = t
    if n == 1:
        yield np.zeros(1, np.int32), np.zeros(1, np.uint8)
        return
    t = longer[:n]
    is_s = types(t, spool)
    seeds = seeds_of(t, sigma, is_s, spool)
    yield from induced(t, sigma, is_s, seeds, adjacent(longer, seeds, cap, spool), spool, cap)


def pieces(width: int, gram: int, shards: int) -> Callable:
    """Map stage: the byte strings of runs of windows that may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            data, length, h1, h2, anchor, key, start = (np.concatenate(x) for x in zip(*held, strict=True))
            at = np.concatenate(([0], np.cumsum(length)))[:-1]
            doc = key["doc"]
            order = np.lexsort((doc, h2, h1))
            a, b = h1[order], h2[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            first = np.flatnonzero(new)
            least = np.empty(len(order), np.int64)
            count = np.diff(np.append(first, len(order)))
            least[order] = np.repeat(doc[order[first]], count)
            # Wholly repeated from a smaller document nearby: no need to ask others.
            known = np.flatnonzero(doc > least)
            if len(known):
                spans = np.empty(len(known), SPAN)
                spans["start"], spans["count"] = start[known], length[known] - width + 1
                yield R.per_row(key[known], spans, shards)
            # One string of each group, and all its places in the smallest document.
            string = np.empty(len(order), np.int64)
            string[order] = np.repeat(order[first], count)
            sent = order[first]
            shard = R.shard_of(anchor, shards)
            places = np.flatnonzero(doc == least)
            order2 = np.argsort(shard[sent], kind="stable")
            sent = sent[order2]
            places = places[np.argsort(shard[places], kind="stable")]
            s_first, s_size = K.by_group(shard[sent])
            p_cut = np.searchsorted(shard[places], shard[sent[s_first]])
            p_end = np.searchsorted(shard[places], shard[sent[s_first]], "right")
            out = []
            number = np.empty(len(order), np.int64)
            for f, n, p, e in zip(s_first, s_size, p_cut, p_end, strict=True):
                i = sent[f : f + n]
                number[i] = np.arange(n)
                j = places[p:e]
                texts = K.pack(3, data=data[K.ranges(at[i], length[i])], length=length[i].astype(np.int32))
                where = K.pack(string=number[string[j]].astype(np.int32), start=np.diff(start[j], prepend=0).astype(np.int32), **R.packed_rows(key[j]))
                out.append((int(shard[i[0]]), R.PROBES, 0, 0, len(texts).to_bytes(4, "little") + texts + where))
            if out:
                yield R.to_batch(out)

        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            keys, runs = R.identities(batch), batch.column("runs")
            for a, b in K.chunks(offsets):
                part = data[offsets[a] : offsets[b]]
                value = K.BYTE_VALUES[part]
                rs, rows = [], []
                for i in range(a, b):
                    rs.append(R.joined_runs(runs, i))
                    rows.append(len(rs[-1]))
                r = np.concatenate(rs)
                base = np.repeat(offsets[a:b] - offsets[a], rows)
                start = r["start"].astype(np.int64)
                length = r["count"].astype(np.int64) + width - 1
                x, y = base + start, base + start + length
                h1, h2 = K.spot_hashes(part, x, length, True)
                take = part[K.ranges(x, length)]
                anchor = K.least_between(K.POLY_A.windows(value, gram), x, y - gram + 1)
                held.append((take, length, h1, h2, anchor, np.repeat(keys[a:b], rows), start))
                size += len(take)
                if size >= R.FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


class Strings:
    """Distinct strings of a shard, merged as they come, with the least document of each."""

    def __init__(self):
        self.data, self.length = np.zeros(0, np.uint8), np.zeros(0, np.int64)
        self.h1, self.h2 = np.zeros(0, U), np.zeros(0, U)
        self.least = np.zeros(0, np.int64)
        self.waiting: list[tuple] = []
        self.size = 0

    def add(self, data: np.ndarray, length: np.ndarray, least: np.ndarray, number: np.ndarray) -> None:
        """`number` will hold the strings' numbers when they are merged."""
        self.waiting.append((data, length.astype(np.int64), least, number))
        self.size += len(data)
        if self.size > max(MERGE, len(self.data)):
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        n = len(self.length)
        h1, h2 = [self.h1], [self.h2]
        for data, length, _, _ in self.waiting:
            a, b = K.spot_hashes(data, np.cumsum(length) - length, length, True)
            h1.append(a)
            h2.append(b)
        h1, h2 = np.concatenate(h1), np.concatenate(h2)
        # stable: a string that is known comes before its copies
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        first = order[new]
        rep = np.empty(len(order), np.int64)
        rep[order] = np.repeat(first, np.diff(np.append(np.flatnonzero(new), len(order))))
        fresh = np.zeros(len(order), bool)
        fresh[first] = True
        fresh[:n] = False
        number = np.concatenate((np.arange(n), n + np.cumsum(fresh[n:]) - 1))
        least = np.concatenate([self.least, *[w[2] for w in self.waiting]])
        own = number[rep]
        out = np.full(n + int(fresh.sum()), LAST, np.int64)
        np.minimum.at(out, own, least)
        self.least = out
        data, lengths, at = [self.data], [self.length], n
        for bytes_, length, _, place in self.waiting:
            mine = fresh[at : at + len(length)]
            begin = np.cumsum(length) - length
            data.append(bytes_[K.ranges(begin[mine], length[mine])])
            lengths.append(length[mine])
            place[:] = own[at : at + len(length)]
            at += len(length)
        self.data, self.length = np.concatenate(data), np.concatenate(lengths)
        self.h1, self.h2 = np.concatenate((h1[:n], h1[fresh])), np.concatenate((h2[:n], h2[fresh]))
        self.waiting, self.size = [], 0


def counted(data: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches (string, offset, length) of windows counted more than once; counts, in two
    rows of cells, are never too low."""
    bounds = np.concatenate(([0], np.cumsum(length)))
    cells = np.zeros((2, CELLS), np.uint8)

    def every():
        for a, b in K.chunks(bounds, 4 * K.CHUNK):
            part = data[bounds[a] : bounds[b]]
            w = K.POLY_A.windows(K.BYTE_VALUES[part], width)
            ok = K.inside(bounds[a : b + 1] - bounds[a], width, len(part))
            yield a, b, [(w & U(CELLS - 1)).astype(np.int64), ((w >> U(32)) & U(CELLS - 1)).astype(np.int64)], ok

    for _, _, at, ok in every():
        for row, cell in zip(cells, at, strict=True):
            cell = cell[ok]
            # seen before, or twice here
            once = row[cell] > 0
            row[cell[once]] = 2
            cell = cell[~once]
            row[cell] = 1
            order = np.sort(cell)
            row[order[1:][order[1:] == order[:-1]]] = 2
    out = [(np.zeros(0, np.int64),) * 3]
    for a, b, cell, ok in every():
        at = np.flatnonzero(ok & (np.minimum(cells[0][cell[0]], cells[1][cell[1]]) > 1))
        if not len(at):
            continue
        own = np.searchsorted(bounds[a : b + 1] - bounds[a], at, "right") - 1 + a
        new = np.flatnonzero(np.concatenate(([True], (at[1:] > at[:-1] + width) | (own[1:] != own[:-1]))))
        last = np.append(new[1:], len(at)) - 1
        out.append((own[new], at[new] + bounds[a] - bounds[own[new]], at[last] - at[new] + width))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def marked(data: np.ndarray, length: np.ndarray, least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of windows that start in a string of a smaller document too, in order."""
    own, offset, size = counted(data, length, width)
    if not len(own):
        return own, offset
    n, total = len(own), int(size.sum()) + len(own) + 1
    begin = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    at = (np.cumsum(length) - length)[own] + offset
    places, groups = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    with Spool() as spool:
        t, inner = spool.array(total, np.uint8), spool.array(total, bool)
        t[:] = 1
        for a, b in K.chunks(np.append(begin, total), 4 * K.CHUNK):
            here = K.ranges(begin[a:b], size[a:b])
            t[here] = data[K.ranges(at[a:b], size[a:b])] + np.uint8(2)
            inner[K.ranges(begin[a:b], size[a:b] - width + 1)] = True
        t[total - 1] = 0
        group = 0
        for place, common in suffixes(t, SIGMA, width, spool):
            g = group + np.cumsum(common < width)
            group = int(g[-1])
            keep = inner[place]
            place, g = place[keep], g[keep]
            if not len(place):
                continue
            # a group of one goes, but for the first and the last, which may go on
            like = g[1:] == g[:-1]
            keep = np.concatenate((like, [True])) | np.concatenate(([True], like))
            places.append(place[keep].astype(np.int64))
            groups.append(g[keep])
    place, g = np.concatenate(places), np.concatenate(groups)
    if not len(place):
        return place, place
    of = np.searchsorted(begin, place, "right") - 1
    value = least[own[of]]
    first, count = K.by_group(g)
    hit = np.repeat(np.minimum.reduceat(value, first), count) < value
    place, of = place[hit], of[hit]
    string, start = own[of], offset[of] + place - begin[of]
    order = np.lexsort((start, string))
    return string[order], start[order]


def groups(width: int, shards: int) -> Callable:
    """Reduce stage: sorts the suffixes of a shard's strings and marks repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, numbers = Strings(), []
        with tempfile.SpooledTemporaryFile(MERGE) as places:
            sizes = []
            for batch in batches:
                kinds = batch.column("kind").to_numpy()
                for i in np.flatnonzero(kinds == R.PROBES):
                    blob = batch.column("blob")[i].as_py()
                    cut = 4 + int.from_bytes(blob[:4], "little")
                    x, y = K.unpack(blob[4:cut]), K.unpack(blob[cut:])
                    least = np.full(len(x["length"]), LAST, np.int64)
                    np.minimum.at(least, y["string"], R.unpacked_rows(y)["doc"])
                    numbers.append(np.empty(len(least), np.int32))
                    pool.add(x["data"], x["length"], least, numbers[-1])
                    places.write(blob[cut:])
                    sizes.append(len(blob) - cut)
                if (kinds == R.DIRECT).any():
                    yield batch.filter(pa.array(kinds == R.DIRECT))
            if not numbers:
                return
            pool.merge()
            owner, offset = marked(pool.data, pool.length, pool.least, width)
            spans, of = spans_from(offset, owner)
            cut = np.searchsorted(of, np.arange(len(pool.length) + 1))
            windows = pool.length - width + 1
            least = pool.least
            del pool, owner, offset, of
            places.seek(0)
            for number, size in zip(numbers, sizes, strict=True):
                y = K.unpack(places.read(size))
                key, start, string = R.unpacked_rows(y), np.cumsum(y["start"].astype(np.int64)), number[y["string"]]
                whole = np.flatnonzero(key["doc"] > least[string])
                if len(whole):
                    out = np.empty(len(whole), SPAN)
                    out["start"], out["count"] = start[whole], windows[string[whole]]
                    yield R.per_row(key[whole], out, shards)
                rest = np.flatnonzero(key["doc"] == least[string])
                many = (cut[1:] - cut[:-1])[string[rest]]
                out = spans[K.ranges(cut[string[rest]], many)]
                out["start"] += np.repeat(start[rest], many).astype(np.int32)
                if len(out):
                    yield R.per_row(np.repeat(key[rest], many), out, shards)

    return R.by_shard(run)


def finish(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            ids, spans = batch.column("doc_id").cast(pa.int64()), batch.column("spans")
            for a, b in K.chunks(offsets, 4 * K.CHUNK):
                removed, runs = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                kept = []
                for i in range(a, b):
                    part = data[offsets[i] : offsets[i + 1]]
                    if (s := spans[i].as_py()) is not None:
                        s = np.frombuffer(b"".join(s), SPAN)
                        gone = K.covered(s["start"], s["start"] + s["count"] + width - 1, len(part))
                        removed[i - a] = gone.sum()
                        runs[i - a] = np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]
                        part = part[~gone]
                    kept.append(part.tobytes())
                digests = pa.array([hashlib.sha256(x).hexdigest() for x in kept])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(removed), pa.array(runs), pa.array(kept, pa.binary()), digests],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
                )

    return run


def remove_repeats(docs: DataFrame, width: int = 50, gram: int = 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, kept_sha256)."""
    docs = R.keyed(docs, width)
    runs = R.repeated_runs(docs, width, gram, False, mb_per_shard=32, bits=24)
    shards = parts_for(docs, 8)
    found = docs.join(runs.hint("shuffle_hash"), ["doc", "key"]).select("doc_id", "doc", "key", "text", "runs")
    blocks = found.mapInArrow(pieces(width, gram, shards), R.BLOCK)
    hits = dealt(blocks, shards).mapInArrow(groups(width, shards), R.BLOCK)
    spans = hits.groupBy("doc", "key").agg(F.collect_list("blob").alias("spans"))
    both = docs.join(spans.hint("shuffle_hash"), ["doc", "key"], "left").select("doc_id", "doc", "key", "text", "spans")
    return both.mapInArrow(finish(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def brute(docs: list[tuple[int | None, str | None]], width: int) -> list[tuple[int, int, int, bytes]]:
    """Plain Python for tests: (n_bytes, n_removed, n_spans, kept)."""
    raw = [(LAST if d is None else d, (t or "").encode()) for d, t in docs]
    first: dict[bytes, int] = {}
    for d, t in raw:
        for i in range(len(t) - width + 1):
            w = t[i : i + width]
            first[w] = min(first.get(w, LAST), d)
    out = []
    for d, t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if first[t[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    return out
