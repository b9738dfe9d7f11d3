"""Language-model scoring by prediction by partial matching, with a word baseline.

A trie of contexts up to `order` bytes is made of the byte n-grams of all training texts.
A symbol's probability comes from the
longest context known: (2c - 1) / 2n if the context was followed by it c of n times, by
d kinds of symbol in all; else an escape d / 2n leads to the next shorter context, in
which the symbols of the longer one are excluded. After the empty context all symbols
left are equal. A text is preceded by marks of its start and ends with one end symbol, so
probabilities of texts sum to one. As no symbol is counted while scoring, exclusion
depends on the context alone, and each node keeps its parent's totals without its symbols.

`score` also gives the log10 probability by add-one word unigrams. Words are dealt by hash;
each block of texts asks once for its distinct words and gets their training counts back, so
no vocabulary is collected or broadcast and a frequent word costs one entry a block.

No n-gram is left out. Counts of the training texts are summed in shards, by the hash of a
context's last NEAR bytes, so that a shard has all contexts of that length and more that end so;
what is shorter, at most 2^(8 NEAR) n-grams whatever the input, is broadcast. Texts are written
in blocks; each block asks every shard once for its distinct n-grams, and the answers meet the
block again. A shard is asked in several places, each of which has its trie, as many as its
occurrences in the training texts call for, so a frequent context is no hot spot; a place reads
its trie first and then answers block by block, holding one. `ppm_fit` makes the same trie in
one piece, for models that fit one machine; there alone a caller may cut it to `max_nodes`
n-grams of the longest kind.

A-Z are lower-cased. A null text is empty and has just its end. A null doc_id is an
ordinary row; equal rows have equal scores; without training texts all bytes are equally
likely. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernels as K
from lodestone.llm import repeats as R
from lodestone.llm.common import PARTS, dealt, parts_for, saved

U = np.uint64
MARK = 255  # start and end: no UTF-8 text has this byte
END = 0x454E44  # hash of the end token
TALLY = 64
NEAR = 3  # last bytes of a context by which the trie is dealt
TRIE, ASKED, WORD = 0, 1, 2  # kinds of blocks, in the order in which a place needs them
OCCURRENCES = 16 << 20  # of a shard's n-grams in the training texts, for which it is asked in one place
TEXTS = "block long, blob binary"
SCORED = "doc_id long, key long, score double"
RESULT = "doc_id long, n_tokens long, n_known long, part double, score double"


def padded(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts, each after `order` marks and before one; where each begins."""
    size = np.diff(offsets)
    begin = offsets[:-1] + np.arange(len(size)) * (order + 1)
    out = np.full(int(offsets[-1]) + len(size) * (order + 1), MARK, np.uint8)
    out[K.ranges(begin + order, size)] = K.LOWER[data]
    return out, begin


def grams(text: np.ndarray, order: int) -> np.ndarray:
    """Number of each run of order + 1 bytes."""
    n = max(0, len(text) - order)
    c = np.zeros(n, U)
    for j in range(order + 1):
        c <<= U(8)
        c |= text[j : j + n]
    return c


def count_grams(order: int, shards: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            v, n = np.unique(np.concatenate(held), return_counts=True)
            yield R.to_batch(R.emit(R.shard_of(v, shards), R.PROBES, lambda i: K.pack(v=v[i], n=n[i].astype(np.uint32)), shards))

        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            for a, b in K.chunks(offsets):
                text, begin = padded(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], order)
                held.append(grams(text, order)[K.ranges(begin, np.diff(offsets[a : b + 1]) + 1)])
                size += len(held[-1])
                if size >= R.FLUSH // 2:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


class Sums:
    """Counts of n-grams that come in parts."""

    def __init__(self):
        self.v, self.n = np.zeros(0, U), np.zeros(0, np.int64)
        self.vs, self.ns, self.waiting = [], [], 0

    def add(self, v: np.ndarray, n: np.ndarray) -> None:
        self.vs.append(v)
        self.ns.append(n.astype(np.int64))
        self.waiting += len(v)
        if self.waiting > max(1 << 20, len(self.v)):
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        u, at = np.unique(np.concatenate([self.v, *self.vs]), return_inverse=True)
        self.n = np.bincount(at, np.concatenate([self.n, *self.ns]), len(u)).astype(np.int64)
        self.v, self.vs, self.ns, self.waiting = u, [], [], 0
        return self.v, self.n


def sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's n-grams with their counts, and how many have each small count."""
    sums = Sums()
    for batch in batches:
        for blob in batch.column("blob"):
            x = K.unpack(blob.as_py())
            sums.add(x["v"], x["n"])
    v, n = sums.merged()
    if len(v):
        tally = np.bincount(np.minimum(n, TALLY), minlength=TALLY + 1)
        for i in range(0, len(v), 1 << 18):
            blob = K.pack(v=v[i : i + (1 << 18)], n=n[i : i + (1 << 18)], tally=tally if not i else tally * 0)
            yield R.to_batch([(0, 0, 0, 0, blob)])


def at_least(count: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                x = K.unpack(blob.as_py())
                keep = x["n"] >= count
                yield R.to_batch([(0, 0, 0, 0, K.pack(v=x["v"][keep], n=x["n"][keep]))])

    return run


def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(TALLY + 1, np.int64)
    for batch in batches:
        for blob in batch.column("blob"):
            total += K.unpack(blob.as_py())["tally"]
    yield R.to_batch([(0, 0, 0, 0, K.pack(tally=total))])


class Trie:
    """Contexts up to `order` bytes, as sorted arrays by order, and a hash table of the
    longest n-grams. A shard's trie has the n-grams of contexts shorter than NEAR from `low`."""

    def __init__(self, order: int, v: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray] | None = None):
        self.order = order
        by_rank = np.argsort(v)
        v, n = v[by_rank], n[by_rank].astype(np.float64)
        self.gram, self.log_count, self.node, self.top_total, self.top_escape = [None] * (order + 1), [None] * (order + 1), [None] * (order + 1), [None] * (order + 1), [None] * (order + 1)
        self.below_total, self.below_escape = [None] * (order + 1), [None] * (order + 1)
        counts: list = [None] * (order + 1)
        for k in range(order, -1, -1):
            if low is not None and k == min(order, NEAR) - 1:
                v, n = low[0], low[1].astype(np.float64)
            elif k < order:
                v, at = np.unique(v & U((1 << 8 * (k + 1)) - 1), return_inverse=True)
                n = np.bincount(at, n, len(v))
            self.gram[k], counts[k] = v, n
        kinds: list = [None] * (order + 1)
        sums: list = [None] * (order + 1)
        log = lambda x: np.log10(np.maximum(x, 1e-300))
        for k in range(order + 1):
            v, n = self.gram[k], counts[k]
            first, d = K.by_group(v >> U(8))
            self.node[k], kinds[k] = (v >> U(8))[first], d.astype(np.float64)
            sums[k] = np.add.reduceat(n, first) if len(v) else np.zeros(0)
            self.log_count[k] = log(n - 0.5)
            self.top_total[k] = log(sums[k])
            self.top_escape[k] = log(kinds[k] / 2) - self.top_total[k]
            if k:
                parent = np.searchsorted(self.node[k - 1], self.node[k] & U((1 << 8 * (k - 1)) - 1))
                mine = counts[k - 1][np.searchsorted(self.gram[k - 1], v & U((1 << 8 * k) - 1))]
                left_n = sums[k - 1][parent] - (np.add.reduceat(mine, first) if len(v) else 0)
                left_d = kinds[k - 1][parent] - kinds[k]
                self.below_total[k] = log(left_n)
                self.below_escape[k] = np.where(left_n > 0, log(left_d / 2) - log(left_n), 0.0)
        self.unseen = -math.log10(256 - len(self.gram[0])) if len(self.gram[0]) < 256 else -300.0
        v = self.gram[order]
        bits = max(10, int(2 * len(v) + 1).bit_length())
        self.shift = U(64 - bits)
        self.slots, self.values = np.zeros(1 << bits, U), np.zeros(1 << bits, np.float32)
        which = np.repeat(self.top_total[order], kinds[order].astype(np.int64)) if len(v) else np.zeros(0)
        value = (self.log_count[order] - which).astype(np.float32)
        todo, at = np.arange(len(v)), self._slot(v)
        while len(todo):
            free = np.flatnonzero(self.slots[at[todo]] == 0)
            _, one = np.unique(at[todo[free]], return_index=True)
            won = todo[free[one]]
            self.slots[at[won]], self.values[at[won]] = v[won] + U(1), value[won]
            lost = np.ones(len(todo), bool)
            lost[free[one]] = False
            todo = todo[lost]
            at[todo] = (at[todo] + 1) & ((1 << bits) - 1)
        # The walk never finds a longest n-gram that the table lacks.
        self.gram[order], self.log_count[order] = np.zeros(0, U), np.zeros(0)

    def _slot(self, v: np.ndarray) -> np.ndarray:
        return ((v * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def log10(self, v: np.ndarray) -> np.ndarray:
        """log10 probability of each n-gram's last byte after the others."""
        out = np.zeros(len(v))
        key, at = v + U(1), self._slot(v)
        todo = np.arange(len(v))
        missing = []
        mask = len(self.slots) - 1
        got = self.slots[at]
        hit = got == key
        out[hit] = self.values[at[hit]]
        missing.append(np.flatnonzero(got == 0))
        todo = np.flatnonzero(~hit & (got != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            got = self.slots[at[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            missing.append(todo[got == 0])
            todo = todo[~hit & (got != 0)]
        miss = np.concatenate(missing)
        if len(miss):
            u, back = np.unique(v[miss], return_inverse=True)
            out[miss] = self._walk(u)[back]
        return out

    def _walk(self, v: np.ndarray) -> np.ndarray:
        """The same by the trie, from the longest context down."""
        out = np.zeros(len(v))
        todo, child = np.arange(len(v)), np.full(len(v), -1)

        def find(array, x):
            i = np.minimum(np.searchsorted(array, x), max(0, len(array) - 1))
            return (i, array[i] == x) if len(array) else (i, np.zeros(len(x), bool))

        for k in range(self.order, -1, -1):
            if not len(todo):
                break
            g = v[todo] & U((1 << 8 * (k + 1)) - 1)
            node, known = find(self.node[k], g >> U(8))
            gram, found = find(self.gram[k], g)
            down = child[todo] >= 0
            c = child[todo]
            found &= known
            log_c = self.log_count[k][gram] if len(self.gram[k]) else np.zeros(len(todo))
            step = np.zeros(len(todo))
            if down.any():
                total, escape = self.below_total[k + 1], self.below_escape[k + 1]
                step[down] = np.where(found[down], log_c[down] - total[c[down]], escape[c[down]])
            first = known & ~down
            if first.any():
                i = node[first]
                step[first] = np.where(found[first], log_c[first] - self.top_total[k][i], self.top_escape[k][i])
            out[todo] += step
            child[todo] = np.where(known, node, -1)
            todo = todo[~found]
        out[todo] += self.unseen
        return out


def ppm_fit(docs: DataFrame, order: int = 5, max_nodes: int | None = None) -> Trie:
    """From docs (text): counts of all n-grams of all rows, in one piece at the driver."""
    shards = parts_for(docs, 64)
    blocks = docs.select("text").mapInArrow(count_grams(order, shards), R.BLOCK)
    sums = saved(blocks.repartitionById(shards, F.col("shard")).mapInArrow(sum_counts, R.BLOCK), "ppm-counts")
    tally = sum((K.unpack(bytes(r.blob))["tally"] for r in sums.mapInArrow(tallies, R.BLOCK).toLocalIterator()), np.zeros(TALLY + 1, np.int64))
    count = 1
    above = np.cumsum(tally[::-1])[::-1]
    while max_nodes is not None and count < TALLY and above[count] > max_nodes:
        count += 1
    parts = [K.unpack(bytes(r.blob)) for r in sums.mapInArrow(at_least(count), R.BLOCK).toLocalIterator()]
    v = np.concatenate([np.zeros(0, U), *[x["v"] for x in parts]])
    n = np.concatenate([np.zeros(0, np.int64), *[x["n"] for x in parts]])
    if max_nodes is not None and len(v) > max_nodes:  # counts above the tally: the most frequent, ties by number
        keep = np.lexsort((v, -n))[:max_nodes]
        v, n = v[keep], n[keep]
    return Trie(order, v, n)


def ppm_score(docs: DataFrame, trie: Trie) -> DataFrame:
    """(doc_id, key, score) for each keyed row: log10 probability of its text."""
    shared = docs.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            scores = np.zeros(batch.num_rows)
            for a, b in K.chunks(offsets):
                text, begin = padded(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], trie.order)
                size = np.diff(offsets[a : b + 1]) + 1
                v = grams(text, trie.order)[K.ranges(begin, size)]
                scores[a:b] = np.add.reduceat(trie.log10(v), np.cumsum(size) - size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(scores)], ["doc_id", "key", "score"])

    return docs.mapInArrow(run, SCORED)


def text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map stage: whole texts of some megabytes in one block with their rows."""
    first, number = TaskContext.get().partitionId() << 32, 0
    held, size = [], 0

    def flush():
        data, sizes, doc, null, learn = (np.concatenate(x) for x in zip(*held, strict=True))
        blob = K.pack(data=data, size=sizes, doc=doc, null=null, learn=learn)
        return pa.RecordBatch.from_arrays([pa.array([first + number]), pa.array([blob], pa.binary())], ["block", "blob"])

    for batch in batches:
        data, offsets = K.text_bytes(batch.column("text"))
        doc = batch.column("doc_id").cast(pa.int64())
        null = doc.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        doc = doc.fill_null(0).to_numpy()
        learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(np.uint8)
        for a, b in K.chunks(offsets):
            held.append((K.LOWER[data[offsets[a] : offsets[b]]], np.diff(offsets[a : b + 1]), doc[a:b], null[a:b], learn[a:b]))
            size += int(offsets[b] - offsets[a]) + b - a
            if size >= R.FLUSH // 2:
                yield flush()
                held, size, number = [], 0, number + 1
    if held:
        yield flush()


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    for batch in batches:
        for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob"), strict=True):
            yield block, K.unpack(blob.as_py())


def block_grams(x: dict[str, np.ndarray], order: int, learned: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A block's n-grams, one for each symbol, and the number of each row's; or those of its
    training rows."""
    data, size = x["data"], x["size"]
    if learned:
        some = x["learn"] > 0
        if not some.all():
            data, size = data[np.repeat(some, size)], size[some]
    text, begin = padded(data, np.append(0, np.cumsum(size)), order)
    return grams(text, order)[K.ranges(begin, size + 1)], size + 1


def block_words(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's tokens, an end after each row's words, and the rows' numbers of them."""
    offsets = np.append(0, np.cumsum(x["size"]))
    hashes, sizes = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for a, b in K.chunks(offsets):
        w = K.Words(x["data"][offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        n = np.diff(w.rows)
        out = np.full(len(w) + b - a, END, U)
        out[np.arange(len(w)) + w.row_of()] = w.hashes()
        hashes.append(out)
        sizes.append(n + 1)
    return np.concatenate(hashes), np.concatenate(sizes)


def home(v: np.ndarray, order: int, shards: int) -> np.ndarray:
    """The shard that knows an n-gram's contexts."""
    return R.shard_of((v >> U(8)) & U((1 << 8 * min(order, NEAR)) - 1), shards)


def count_low(order: int, shards: int) -> Callable:
    """Map stage: counts of the training texts' n-grams of contexts shorter than NEAR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for _, x in blocks_of(batches):
            v, _ = block_grams(x, order, True)
            u, n = np.unique((v & U((1 << 8 * min(order, NEAR)) - 1)).astype(np.uint32), return_counts=True)
            sums.add(u.astype(U), n)
        v, n = sums.merged()
        if len(v):
            yield R.to_batch(R.emit(R.shard_of(v, shards), TRIE, lambda i: K.pack(v=v[i], n=n[i]), shards))

    return run


def count_learned(order: int, shards: int) -> Callable:
    """Map stage: counts of the training texts' n-grams by shard, of several blocks together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()

        def flush():
            v, n = sums.merged()
            if len(v):
                yield R.to_batch(R.emit(home(v, order, shards), TRIE, lambda i: K.pack(v=np.diff(v[i], prepend=U(0)), n=n[i].astype(np.uint32)), shards))

        for _, x in blocks_of(batches):
            u, n = np.unique(block_grams(x, order, True)[0], return_counts=True)
            sums.add(u, n)
            if len(sums.v) + sums.waiting > 4 << 20:
                yield from flush()
                sums = Sums()
        yield from flush()

    return run


def sum_learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce stage: a shard's n-grams with their counts; `doc` tells their occurrences."""
    sums, shard = Sums(), 0
    for batch in batches:
        shard = batch.column("shard")[0].as_py()
        for blob in batch.column("blob"):
            x = K.unpack(blob.as_py())
            sums.add(np.cumsum(x["v"]), x["n"])
    v, n = sums.merged()
    for i in range(0, len(v), 1 << 18):
        part = slice(i, i + (1 << 18))
        yield R.to_batch([(shard, TRIE, int(n[part].sum()), 0, K.pack(v=np.diff(v[part], prepend=U(0)), n=n[part]))])


def ask(order: int, shards: int, first, count) -> Callable:
    """Map stage: each block's distinct n-grams by place; the places of shard s are count[s]
    from first[s]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, many = first.value, count.value
        for block, x in blocks_of(batches):
            u = np.unique(block_grams(x, order)[0])
            rows = R.emit(home(u, order, shards), ASKED, lambda i, u=u: K.pack(v=np.diff(u[i], prepend=U(0))), shards)
            mine = int(K.mix(np.array([block], U))[0] >> U(1))
            yield R.to_batch([(int(base[s]) + mine % int(many[s]), kind, s, block, blob) for s, kind, _, _, blob in rows])

    return run


def answer(order: int, low) -> Callable:
    """Reduce stage: a place's trie, which comes first, and what each block asked of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vs, ns, trie = [np.zeros(0, U)], [np.zeros(0, np.int64)], None
        for batch in batches:
            for kind, shard, block, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "doc", "key")), batch.column("blob"), strict=True):
                x = K.unpack(blob.as_py())
                v = np.cumsum(x["v"])
                if kind == TRIE:
                    vs.append(v)
                    ns.append(x["n"])
                    continue
                if trie is None:
                    trie = Trie(order, np.concatenate(vs), np.concatenate(ns), low.value)
                    vs = ns = None
                yield R.to_batch([(0, ASKED, shard, block, K.pack(value=trie.log10(v).astype(np.float32)))])

    return R.by_shard(run)


def ask_words(shards: int) -> Callable:
    """Map stage: each block's distinct tokens by shard, with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, x in blocks_of(batches):
            v, size = block_words(x)
            u, at = np.unique(v, return_inverse=True)
            n = np.bincount(at[np.repeat(x["learn"] > 0, size)], minlength=len(u))
            rows = R.emit(R.shard_of(u, shards), WORD, lambda i, u=u, n=n: K.pack(v=u[i], n=n[i].astype(np.uint32)), shards)
            if rows:
                yield R.to_batch([(s, kind, s, block, blob) for s, kind, _, _, blob in rows])

    return run


def answer_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce stage: training counts of each block's tokens, and the shard's totals (kind TRIE)."""
    asked, sums = [], Sums()
    for batch in batches:
        for shard, block, blob in zip(*(batch.column(c).to_pylist() for c in ("doc", "key")), batch.column("blob"), strict=True):
            asked.append((shard, block, blob.as_py()))
            x = K.unpack(asked[-1][2])
            sums.add(x["v"], x["n"])
    v, n = sums.merged()
    yield R.to_batch([(0, TRIE, int(n.sum()), int((n > 0).sum()), b"")])
    for shard, block, blob in asked:
        yield R.to_batch([(0, WORD, shard, block, K.pack(value=n[np.searchsorted(v, K.unpack(blob)["v"])]))])


def settle(order: int, shards: int, word_shards: int) -> Callable:
    """A block's rows with their scores, from its texts and all shards' answers."""

    def spread(u: np.ndarray, shard: np.ndarray, answers: dict[int, np.ndarray]) -> np.ndarray:
        members = np.argsort(shard, kind="stable")
        first, n = K.by_group(shard[members])
        if len(first) != len(answers):
            raise ValueError(f"{len(answers)} answers of {len(first)} shards")
        value = np.zeros(len(u))
        for a, m in zip(first, n, strict=True):
            value[members[a : a + m]] = answers[int(shard[members[a]])]
        return value

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        x = K.unpack(block.column("blob")[0].as_py())
        got: dict[int, dict] = {ASKED: {}, WORD: {}}
        for kind, s, blob in zip(*(answers.column(c).to_pylist() for c in ("kind", "doc")), answers.column("blob"), strict=True):
            got[kind][s] = K.unpack(blob.as_py())["value"]
        v, size = block_grams(x, order)
        u, back = np.unique(v, return_inverse=True)
        scores = np.add.reduceat(spread(u, home(u, order, shards), got[ASKED])[back], np.cumsum(size) - size)
        v, size = block_words(x)
        u, back = np.unique(v, return_inverse=True)
        count = spread(u, R.shard_of(u, word_shards), got[WORD])[back]
        at = np.cumsum(size) - size
        return pa.table({
            "doc_id": pa.array(x["doc"], mask=x["null"] > 0), "n_tokens": pa.array(size), "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), at)),
            "part": pa.array(np.add.reduceat(np.log10(count + 1.0), at)), "score": pa.array(scores),
        })

    return run


def score(docs: DataFrame, learn, order: int = 5) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of docs
    (doc_id, text), learning from those where the column `learn` holds."""
    spark = docs.sparkSession
    flagged = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    shards, word_shards = parts_for(docs, 32), parts_for(docs, 256)
    texts = saved(flagged.mapInArrow(text_blocks, TEXTS), "ppm-texts")

    words = dealt(texts.mapInArrow(ask_words(word_shards), R.BLOCK), word_shards).mapInArrow(R.by_shard(answer_words), R.BLOCK)
    words = saved(words, "base-answers")
    whole = words.where(F.col("kind") == TRIE).agg(F.sum("doc"), F.sum("key")).first()
    n, v = whole[0] or 0, whole[1] or 0

    parts = texts.mapInArrow(count_low(order, 8), R.BLOCK).repartitionById(8, F.col("shard")).mapInArrow(sum_counts, R.BLOCK)
    sums = Sums()
    for r in parts.select("blob").collect():
        x = K.unpack(bytes(r.blob))
        sums.add(x["v"], x["n"])
    low = spark.sparkContext.broadcast(sums.merged())

    counts = saved(dealt(texts.mapInArrow(count_learned(order, shards), R.BLOCK), shards).mapInArrow(R.by_shard(sum_learned), R.BLOCK), "ppm-counts")
    times = {r.shard: r.n for r in counts.groupBy("shard").agg(F.sum("doc").alias("n")).collect()}
    many = np.array([1 + times.get(s, 0) // OCCURRENCES for s in range(shards)], np.int32)
    base = np.cumsum(many) - many
    places = int(many.sum())
    first, count = spark.sparkContext.broadcast(base), spark.sparkContext.broadcast(many)
    where = spark.createDataFrame(pd.DataFrame({"shard": np.arange(shards), "first": base, "many": many}), "shard int, first int, many int")
    tries = counts.join(where, "shard").select(
        F.explode(F.sequence("first", F.col("first") + F.col("many") - 1)).alias("shard"), "kind", F.col("shard").cast("long").alias("doc"), "key", "blob"
    )
    asked = tries.unionByName(texts.mapInArrow(ask(order, shards, first, count), R.BLOCK))
    parts = min(places, PARTS)
    asked = asked.repartitionById(parts, F.pmod(F.col("shard"), F.lit(parts)).cast("int")).sortWithinPartitions("shard", "kind")
    answers = asked.mapInArrow(answer(order, low), R.BLOCK).unionByName(words.where(F.col("kind") == WORD))
    answers = answers.select("kind", "doc", F.col("key").alias("block"), "blob")
    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(settle(order, shards, word_shards), RESULT)
    return scored.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("part") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        "score",
    )


def brute_ppm(train: list[bytes], order: int) -> Callable[[bytes], float]:
    """Plain Python for tests: a scorer of texts."""
    low = bytes(K.LOWER)
    counts: dict[bytes, dict[int, int]] = {}
    for t in train:
        t = bytes([MARK]) * order + t.translate(low) + bytes([MARK])
        for i in range(order, len(t)):
            for k in range(order + 1):
                counts.setdefault(t[i - k : i], {}).setdefault(t[i], 0)
                counts[t[i - k : i]][t[i]] += 1

    def one(ctx: bytes, x: int) -> float:
        out, gone = 1.0, set()
        for k in range(order, -1, -1):
            seen = {s: c for s, c in counts.get(ctx[order - k :], {}).items() if s not in gone}
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if x in seen:
                return out * (seen[x] - 0.5) / n
            out *= d / 2 / n
            gone |= set(seen)
        return out / (256 - len(gone))

    def total(text: bytes) -> float:
        t = bytes([MARK]) * order + text.translate(low) + bytes([MARK])
        return sum(math.log10(one(t[i - order : i], t[i])) for i in range(order, len(t)))

    return total
