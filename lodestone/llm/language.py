"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of a bounded sample of labelled text. A
document is parsed greedily into the longest phrases that occur in the sample; the
phrases needed, times the bits that point into the sample, per symbol, estimate its cross
entropy with the language. The language of the least wins; ties go to the lesser name.
Symbols are lower-cased ASCII letters and the bytes of other letters; every run of other
signs counts byte by byte as one separator symbol.

Whole texts are parsed as one sequence of phrases. So that numpy can step through thousands of
places at once, stretches of at most STRETCH symbols are first parsed each from a new phrase;
then every stretch is parsed again from the state that the one before it ends in, until both
parses are in one state, after which they agree. A stretch in which they never meet ends in
another state, and the one after it is parsed once more.

The sample of a language is at most `sample_bytes` symbols: a piece of at most PIECE
characters from each distinct text with letters in order of hash, then second pieces, until
there are enough. A long text's pieces stand at hashed places in equal stretches of it. Every language is learned: automata are broadcast, compressed, in
slices of SLICE languages, of which a task holds one at a time, and the least cost over all
slices wins. A null text or one without a letter is `und` with score 0, as is everything when
no language is learned. Null languages aren't learned; the empty name is a name.
Repeated rows are predicted alike. An empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernels as K
from lodestone.llm import repeats as R

STRETCH, PIECE, SLICE = 512, 1024, 8
FOLD = np.zeros(256, np.uint8)
FOLD[97:123] = FOLD[65:91] = np.arange(1, 27)
FOLD[128:] = np.arange(27, 155)


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton: state 0 is the root, every path a substring."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Model:
    """Some languages' automata in one table.

    table[state, symbol] is four times the next state plus the phrases that end there: none
    while the phrase goes on, one where a new phrase begins, two where it begins with a
    symbol that the sample lacks.
    """

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        folded = {k: FOLD[np.frombuffer(samples[k], np.uint8)] for k in self.names}
        used = sorted({int(c) for v in folded.values() for c in np.unique(v)} | {0})
        # The last two symbols are one that no sample has and the padding.
        self.code = np.full(256, len(used), np.uint8)
        for i, c in enumerate(used):
            self.code[FOLD == c] = i
        self.width = len(used) + 2
        rank = {c: i for i, c in enumerate(used)}
        tables, self.roots, self.bits, base = [], [], [], 0
        for k in self.names:
            nxt = automaton([rank[int(c)] for c in folded[k]])
            n = len(nxt)
            t = np.empty((n, self.width), np.int32)
            root = np.full(self.width, (base << 2) | 2, np.int32)
            for c, q in nxt[0].items():
                root[c] = ((base + q) << 2) | 1
            t[:] = root
            for s, row in enumerate(nxt):
                if row:
                    t[s, list(row)] = [(base + q) << 2 for q in row.values()]
            t[0, root == ((base << 2) | 2)] = (base << 2) | 1
            t[:, -1] = (base + np.arange(n)) << 2
            tables.append(t)
            self.roots.append(base)
            self.bits.append(math.log2(max(2, len(folded[k]))))
            base += n
        self.table = np.concatenate(tables).reshape(-1) if tables else np.zeros(0, np.int32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": K.pack(table=self.table)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, table=K.unpack(state["table"])["table"])

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each row in each language."""
        size = np.diff(offsets)
        parts = -(-size // STRETCH)
        row = np.repeat(np.arange(len(size)), parts)
        number = K.ranges(np.zeros(len(size), np.int64), parts)
        # Stretches of a row are of almost equal size.
        low = offsets[row] + number * size[row] // np.maximum(parts[row], 1)
        high = offsets[row] + (number + 1) * size[row] // np.maximum(parts[row], 1)
        out = np.zeros((len(size), len(self.names)), np.int64)
        if not len(row):
            return out
        code = self.code[data].astype(np.int64)
        roots = np.array(self.roots, np.int64)[None, :]
        order = np.argsort(low - high, kind="stable")
        first, length = low[order], (high - low)[order]
        # lanes that still have a symbol at each step: stretches are sorted by length
        live = np.searchsorted(-length, -np.arange(int(length[0])), "left")
        state = np.repeat(roots, len(row), 0)
        count = np.zeros((len(row), len(self.names)), np.int64)
        for step, n in enumerate(live.tolist()):
            v = self.table[state[:n] * self.width + code[first[:n] + step][:, None]]
            count[:n] += v & 3
            state[:n] = v >> 2
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        state, count = state[back], count[back]
        redo = np.flatnonzero(number > 0)
        more = np.zeros_like(count)
        while len(redo):
            redo = self._again(code, low, high, roots, state, more, redo)
            redo = redo[redo < len(row)]
            redo = redo[number[redo] > 0]
        count += more
        last = number == parts[row] - 1
        count[last] += state[last] != roots
        np.add.at(out, row, count)
        return out

    def _again(self, code, low, high, roots, state, more, redo) -> np.ndarray:
        """Parses stretches from the ends of those before them; `more` gets the phrases more than
        from their own starts, `state` their ends. Those after a changed end are returned."""
        lane = np.repeat(redo, len(self.names))
        lang = np.tile(np.arange(len(self.names)), len(redo))
        one, two = state[lane - 1, lang], roots[0][lang]
        extra = np.zeros(len(lane), np.int64)
        changed = []
        more[redo] = 0
        at = low[lane]
        while len(lane):
            met, ended = one == two, at == high[lane]
            done = met | ended
            if done.any():
                more[lane[done], lang[done]] = extra[done]
                late = ended & ~met
                if late.any():
                    x, y = lane[late], lang[late]
                    changed.append(x[state[x, y] != one[late]] + 1)
                    state[x, y] = one[late]
                keep = ~done
                lane, lang, one, two, extra, at = (z[keep] for z in (lane, lang, one, two, extra, at))
                if not len(lane):
                    break
            c = code[at]
            v, w = self.table[one * self.width + c], self.table[two * self.width + c]
            extra += (v & 3) - (w & 3)
            one, two = v >> 2, w >> 2
            at = at + 1
        return np.unique(np.concatenate(changed)) if changed else np.zeros(0, np.int64)

    def costs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row in each language."""
        return self.phrases(data, offsets) * np.array(self.bits)[None, :]


def chosen(h: np.ndarray, n: np.ndarray, sample_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of these hashes and lengths that a sample takes: hash, length, pieces of each."""
    h, at = np.unique(h, return_index=True)
    n, most = n[at], -(-sample_bytes // PIECE)
    pieces = np.minimum(-(-n // PIECE), most)
    each = np.minimum(PIECE, n // pieces)
    taken, left = np.zeros(len(h), np.int64), sample_bytes
    for j in range(most):
        some = np.flatnonzero(pieces > j)
        if left <= 0 or not len(some):
            break
        some = some[: np.searchsorted(np.cumsum(each[some]), left) + 1]
        taken[some] += 1
        left -= int(each[some].sum())
    some = taken > 0
    return h[some], n[some], taken[some]


def candidates(sample_bytes: int) -> Callable:
    """Map stage: the texts that samples of a task's rows alone would take; those of the
    whole sample are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            code, h, n = lang.indices.to_numpy(), batch.column("h").to_numpy(), batch.column("n").to_numpy()
            order = np.argsort(code, kind="stable")
            for a, m in zip(*K.by_group(code[order]), strict=True):
                i = order[a : a + m]
                name = lang.dictionary[int(code[i[0]])].as_py()
                old = held.get(name, (h[:0], n[:0]))
                held[name] = chosen(np.append(old[0], h[i]), np.append(old[1], n[i]), sample_bytes)[:2]
        for name, (h, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(h), pa.array(n)], ["lang", "h", "n"])

    return run


def fit(docs: DataFrame, sample_bytes: int = 16_384) -> dict[str, bytes]:
    """From docs (doc_id, text, lang): each language's sample."""
    rows = docs.select("lang", "text", F.xxhash64(F.lit("language"), "text").alias("h"))
    rows = rows.where("lang is not null").where(F.regexp_like("text", F.lit(r"\p{L}")))
    some = rows.select("lang", "h", F.length("text").cast("long").alias("n")).mapInArrow(candidates(sample_bytes), "lang string, h long, n long")

    def settle(part: pa.Table) -> pa.Table:
        h, n, taken = chosen(part.column("h").to_numpy(), part.column("n").to_numpy(), sample_bytes)
        return pa.table({"lang": pa.array([part.column("lang")[0].as_py()] * len(h), pa.string()), "h": h, "n": n, "taken": taken})

    sample = some.groupBy("lang").applyInArrow(settle, "lang string, h long, n long, taken long")
    # stretch i of p of the text's n characters; its piece stands at a hashed place in it
    places = (
        sample.withColumn("p", F.expr(f"least((n + {PIECE - 1}) div {PIECE}, {-(-sample_bytes // PIECE)})"))
        .withColumn("j", F.expr("explode(sequence(0L, taken - 1))"))
        .withColumn("i", F.expr("(j + pmod(xxhash64('first', h), p)) % p"))
        .withColumn("low", F.expr("i * n div p"))
        .withColumn("size", F.expr("(i + 1) * n div p - low"))
        .withColumn("width", F.expr(f"least(size, {PIECE})"))
        .selectExpr("lang", "h", "j", "int(low + pmod(xxhash64('place', h, j), size - width + 1) + 1) AS start", "int(width) AS width")
    )
    pieces = (
        rows.join(F.broadcast(places), ["lang", "h"])
        .select("lang", "j", "h", F.expr("substring(text, start, width)").alias("text"))
        .distinct()
        .orderBy("lang", "j", "h")
        .collect()
    )
    samples: dict[str, bytes] = {}
    for r in pieces:
        samples[r.lang] = (samples.get(r.lang, b"") + b"\n" + r.text.encode())[:sample_bytes]
    return samples


def tag(shared: list) -> Callable:
    """Languages of a batch's rows by the slices' packed models, in order of names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = pickle.loads(shared[0].value) if len(shared) == 1 else None
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            names, scores = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            best, least = np.full(batch.num_rows, "und", object), np.full((batch.num_rows, 2), np.inf)
            for part in shared:
                model = only or pickle.loads(part.value)
                for a, b in K.chunks(offsets, 4 * K.CHUNK):
                    cost = model.costs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    at = cost.argmin(1)
                    won = cost[np.arange(b - a), at] < least[a:b, 0]
                    best[a:b][won] = np.array(model.names, object)[at[won]]
                    least[a:b] = np.sort(np.concatenate((least[a:b], cost), 1), 1)[:, :2]
                del model
            if shared:
                names[letters] = best[letters]
                # the runner-up's share of both costs
                one, two = least[letters].T
                scores[letters] = 1.0
                some = np.isfinite(two)
                scores[np.flatnonzero(letters)[some]] = two[some] / np.maximum(one[some] + two[some], 1e-9)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "key", "lang_pred", "score"]
            )

    return run


def predict(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """(doc_id, key, lang_pred, score) for every row."""
    letters = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    context, names = docs.sparkSession.sparkContext, sorted(samples)
    slices = [{k: samples[k] for k in names[i : i + SLICE]} for i in range(0, len(names), SLICE)]
    shared = [context.broadcast(pickle.dumps(Model(x))) for x in slices]
    return R.keyed(docs).withColumn("letters", letters).mapInArrow(tag(shared), "doc_id long, key long, lang_pred string, score double")


def brute(text: bytes, sample: bytes) -> int:
    """Plain Python for tests: phrases of a whole text."""
    t, s = bytes(FOLD[np.frombuffer(text, np.uint8)]), bytes(FOLD[np.frombuffer(sample, np.uint8)])
    i = n = 0
    while i < len(t):
        k = 1
        while i + k < len(t) and t[i : i + k + 1] in s:
            k += 1
        i, n = i + k, n + 1
    return n
