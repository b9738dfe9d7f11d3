"""Benchmark passages in documents: SimHash windows, Hamming blocks, exact similarity.

Words are A-Z lower-cased; items and windows are compared as multisets of their five-word
shingles (an item of fewer words by its whole sequence). For every item length, windows
of that many words get a 128-bit SimHash of their distinct pairs of shingle and occurrence
number, whose angle follows the weighted similarity. Sixteen one-byte
blocks index the items' fingerprints: two fingerprints within RADIUS bits differ in at
most RADIUS // 16 bits of some block, so looking up every value that near to each block
finds all items within the radius. Candidates are verified by weighted Jaccard
similarity of the whole windows. A window isn't fingerprinted if too few of its shingles stand in
any item of its length for one to be similar; which item it may be is up to the index.

Windows meet items in tiles of TILE by TILE, whatever the number of items of one length.

Documents never move, and are read once: items are broadcast in slices of at most SLICE bytes
of text, and a task holds one slice at a time. Texts shorter than an item are compared as a whole. Null or
blank texts and items match nothing; a null doc_id or item_id is carried as null; equal
items are one. Empty tables give no rows.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernels as K
from lodestone.llm import repeats as R

U = np.uint64
BITS, BLOCKS, RADIUS = 128, 16, 44
SLICE, TILE = 8 << 20, 512
SCHEMA = "doc_id long, item_id long, start long, n_words long, distance int, similarity double"
NEAR = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)], np.uint8)


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    if len(h) >= width:
        return K.POLY_A.windows(h, width)
    return K.mix(K.POLY_B.prefix(h)[-1:] + U(len(h))) if len(h) else np.zeros(0, U)


def signs(sh: np.ndarray, number: np.ndarray | None = None) -> np.ndarray:
    """+1 or -1 for each bit of each shingle, or of its occurrence of that number."""
    if number is not None:
        sh = sh ^ K.mix((number - 1).astype(U))  # the first is the shingle itself
    both = np.stack([K.mix(sh ^ U(0x1F83D9AB)), K.mix(sh ^ U(0x5BE0CD19))], 1)
    return np.unpackbits(both.view(np.uint8).reshape(len(sh), BITS // 8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(sh: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash bytes of windows of `size` shingles."""
    n = len(sh)
    u, value = np.unique(sh, return_inverse=True)
    if len(u) < n:
        place = np.sort(value * n + np.arange(n))

        def among(p, a, b):
            """How many of sh[a:b] equal sh[p]."""
            return np.searchsorted(place, value[p] * n + b) - np.searchsorted(place, value[p] * n + a)

        # The next window lacks the last occurrence of what leaves and has one more of what comes.
        first, i = np.arange(size), np.arange(n - size)
        total = np.empty((n - size + 1, BITS), np.int32)
        total[0] = signs(sh[:size], among(first, 0, first + 1)).sum(0)
        total[1:] = signs(sh[size:], among(i + size, i + 1, i + size + 1)) - signs(sh[i], among(i, i, i + size))
        return np.packbits(np.cumsum(total, axis=0)[starts] > 0, axis=1)
    total = np.zeros((len(sh) + 1, BITS), np.int32)
    np.cumsum(signs(sh), axis=0, out=total[1:])
    return np.packbits(total[starts + size] - total[starts] > 0, axis=1)


class Items:
    """Items of a slice, by number of words, with their Hamming block index."""

    def __init__(self, rows: list[tuple[int | None, str]], width: int):
        self.width, self.ids, self.words = width, [], []
        self.shingles: list[np.ndarray] = []
        self.weights: list[Counter] = []
        lengths = defaultdict(list)
        for item_id, text in rows:
            raw = np.frombuffer(text.encode(), np.uint8)
            h = K.Words(K.LOWER[raw], np.array([0, len(raw)])).hashes()
            if len(h):
                lengths[len(h)].append(len(self.ids))
                self.ids.append(item_id)
                self.words.append(len(h))
                self.shingles.append(shingles(h, width))
                self.weights.append(Counter(self.shingles[-1].tolist()))
        known = [(int(x), len(sh)) for i, sh in enumerate(self.shingles) for x in self.weights[i]]
        #: Items of fewer words than a shingle, by their one shingle.
        self.whole = {int(sh[0]): [] for i, sh in enumerate(self.shingles) if self.words[i] < width}
        for i, sh in enumerate(self.shingles):
            if self.words[i] < width:
                self.whole[int(sh[0])].append(i)
        # The numbers of shingles of the items that a shingle stands in.
        pairs = np.unique(np.array(known, [("shingle", U), ("size", np.int64)]))
        first, size = K.by_group(pairs["shingle"])
        self.known, self.first, self.count, self.sizes = pairs["shingle"][first], first, size, pairs["size"].copy()
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known & U((1 << 20) - 1)).astype(np.int64)] = True
        self.short = sorted(n for n in lengths if n < width)
        self.index = {}
        for n, members in lengths.items():
            if n >= width:
                prints = np.concatenate([fingerprints(self.shingles[i], np.zeros(1, np.int64), len(self.shingles[i])) for i in members])
                self.index[n - width + 1] = (np.array(members), prints)

    def seen(self, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of shingles that some item has, and their numbers in `known`."""
        at = np.flatnonzero(self.maybe[(sh & U((1 << 20) - 1)).astype(np.int64)])
        if not len(at) or not len(self.known):
            return at[:0], at[:0]
        i = np.minimum(np.searchsorted(self.known, sh[at]), len(self.known) - 1)
        same = self.known[i] == sh[at]
        return at[same], i[same]

    def match(self, h: np.ndarray, sim: float) -> list[tuple]:
        """Best window for each item that reaches the similarity in these words."""
        best: dict[int, tuple] = {}
        n_words = len(h)
        for n in {*self.short, *([n_words] if n_words < self.width else [])}:
            if n > n_words:
                continue
            p = K.POLY_B.prefix(h)
            sh = K.mix((p[n:] - p[: n_words - n + 1]) * K.POLY_B.down[: n_words - n + 1] + U(n))
            for at in self.seen(sh)[0]:
                for i in self.whole.get(int(sh[at]), ()):
                    if i not in best:
                        best[i] = (int(at), n, 0, 1.0)
        if n_words >= self.width:
            sh = K.POLY_A.windows(h, self.width)
            at, which = self.seen(sh)
            size = self.sizes[K.ranges(self.first[which], self.count[which])]
            places = np.repeat(at, self.count[which])
            order = np.argsort(size, kind="stable")
            size, places = size[order], places[order]
            for f, n in zip(*K.by_group(size), strict=True):
                m = int(size[f])
                width = min(m, len(sh))
                # so many shingles in common at least make the windows similar
                need = int(np.ceil(sim * (width + m) / (1 + sim) - 1e-9))
                if m in self.index and n >= need:
                    have = np.concatenate(([0], np.cumsum(np.bincount(places[f : f + n], minlength=len(sh)))))
                    starts = np.flatnonzero(have[width:] - have[: len(sh) - width + 1] >= need)
                    self._windows(sh, m, starts, sim, best)
        return [(self.ids[i], *v) for i, v in best.items()]

    def _windows(self, sh: np.ndarray, m: int, starts: np.ndarray, sim: float, best: dict) -> None:
        size = min(m, len(sh))
        members, prints = self.index[m]
        # successive windows are fingerprinted together
        runs = np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1)
        for part in (run[a : a + TILE] for run in runs for a in range(0, len(run), TILE)):
            low, high = int(part[0]), int(part[-1]) + size
            got = fingerprints(sh[low:high], part - low, size)
            for c in range(0, len(prints), TILE):
                theirs = prints[c : c + TILE]
                near = np.zeros((len(got), len(theirs)), bool)
                for b in range(BLOCKS):
                    near |= NEAR[got[:, b, None], theirs[None, :, b]] <= RADIUS // BLOCKS
                w, k = np.nonzero(near)
                distance = NEAR[got[w], theirs[k]].sum(1)
                ok = distance <= RADIUS
                for s, j, d in zip(part[w[ok]].tolist(), k[ok].tolist(), distance[ok].tolist(), strict=True):
                    i = int(members[c + j])
                    if i in best and best[i][3] == 1.0:
                        continue
                    mine = self.weights[i]
                    window = Counter(sh[s : s + size].tolist())
                    both = sum(min(n, mine[x]) for x, n in window.items() if x in mine)
                    score = both / (size + m - both)
                    if score >= sim and (i not in best or score > best[i][3] or score == best[i][3] and s < best[i][0]):
                        best[i] = (s, size + self.width - 1, d, score)

    def hits(self, column: pa.Array, sim: float) -> Iterator[tuple[int, list[tuple]]]:
        """Rows with matches, and these."""
        data, offsets = K.text_bytes(column)
        for a, b in K.chunks(offsets):
            w = K.Words(K.LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a])
            h, size = w.hashes(), np.diff(w.rows)
            touched = (size < self.width) & (size > 0)
            if self.short:
                touched |= size > 0
            if len(h) >= self.width:
                at, _ = self.seen(K.POLY_A.windows(h, self.width))
                touched[np.searchsorted(w.rows, at, "right") - 1] = True
            for i in np.flatnonzero(touched):
                if found := self.match(h[w.rows[i] : w.rows[i + 1]], sim):
                    yield a + int(i), found


def indexes(items: DataFrame, width: int) -> list:
    """Broadcast indexes of all items (item_id, text), each packed and of a slice of bounded size."""
    items = items.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    slices = max(1, -(-total // (SLICE // 2)))
    shared = []
    for i in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i) if slices > 1 else items
        index = Items([(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()], width)
        shared.append(items.sparkSession.sparkContext.broadcast(pickle.dumps(index)))
    return shared


def each(shared: list) -> Callable[[], Iterator[Items]]:
    """The indexes one after another; a single one is unpacked but once."""
    held: list[Items] = []

    def run() -> Iterator[Items]:
        if len(shared) == 1:
            if not held:
                held.append(pickle.loads(shared[0].value))
            yield held[0]
        else:
            for part in shared:
                yield pickle.loads(part.value)

    return run


def scan(shared: list, sim: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
        slices = each(shared)
        for batch in batches:
            ids = batch.column("doc_id")
            for items in slices():
                out = [(ids[i].as_py(), *hit) for i, found in items.hits(batch.column("text"), sim) for hit in found]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def matches(docs: DataFrame, items: DataFrame, sim: float = 0.75, width: int = 5) -> DataFrame:
    """(doc_id, item_id, start, n_words, distance, similarity): for each row and item
    the most similar window, the first of equals, if it reaches `sim`."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan(indexes(items, width), sim), SCHEMA)


def clean(docs: DataFrame, items: DataFrame, sim: float = 0.75, width: int = 5) -> DataFrame:
    """The rows, all columns, that match no item; nothing is shuffled."""
    shared = indexes(items, width)
    slices = []

    def chosen(texts: pa.Array) -> np.ndarray:
        if not slices:
            slices.append(each(shared))
        ok = np.ones(len(texts), bool)
        for index in slices[0]():
            ok[[i for i, _ in index.hits(texts, sim)]] = False
        return ok

    return R.filtered(docs, chosen)


def brute(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], sim: float, width: int = 5) -> dict:
    """Plain Python for tests: (doc_id, item_id) to the best similarity."""
    import re

    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
    grams = lambda w: [tuple(w[i : i + width]) for i in range(len(w) - width + 1)] or ([tuple(w)] if w else [])
    out = {}
    for item_id, t in items:
        iw = words(t)
        mine = Counter(grams(iw))
        for doc_id, d in docs:
            dw = words(d)
            if not dw or not iw:
                continue
            n = min(len(iw), len(dw))
            if n >= width and not set(mine) & set(grams(dw)):
                continue
            top = 0.0
            for s in range(len(dw) - n + 1):
                win = Counter(grams(dw[s : s + n]))
                both = sum((win & mine).values())
                top = max(top, both / (sum(win.values()) + sum(mine.values()) - both))
            if top >= sim:
                out[doc_id, item_id] = top
    return out
